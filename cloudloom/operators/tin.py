"""Triangulations: Delaunay per tile with a halo, and interpolation as joins.

Triangles come from an incremental Delaunay triangulation of a tile's points and of those
a few points' distance around it.  Points further off, up to a widest halo, are inserted
only where they lie in the circumcircle of a triangle (or beyond a hull edge) that reaches
the tile: the tile's triangles are those of all points of the halo at the cost of few.
The tile that owns a triangle's centroid keeps it.  Heights under points and cell centres
come from the same call; other uses of triangles (rasters and points of a given table,
hulls) are joins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import attribute
from ..functions.lattice import centre, column_of, covering, row_of, with_centre
from ..functions.predicates import all_of
from .tiles import numbers

TRIANGLE = "tri_id long, " + ", ".join(f"{v}{c} double" for v in "abc" for c in "xyz")


class Triangulation:
    """Incremental Delaunay triangulation (Bowyer and Watson) with walking point location.

    Corners 0 to 2 are far away; the points follow, and more can be added.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, span: float | None = None):
        self.cx, self.cy = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2
        far = 1e3 * (span or max(float(np.ptp(x)), float(np.ptp(y)), 1e-9))
        self.x, self.y = [-far, far, 0.0], [-far, -far, far]
        self.tri: list[tuple[int, int, int] | None] = [(0, 1, 2)]
        self.nb: list[list[int]] = [[-1, -1, -1]]  # neighbour opposite to each corner
        self.free: list[int] = []
        self.last = 0
        self.add(x, y)

    def add(self, x: np.ndarray, y: np.ndarray) -> range:
        """Numbers of further points, not inserted yet."""
        first = len(self.x)
        # a point's own noise settles ties on circles and lines alike in every tile
        noise = [(np.modf(np.sin(x * a + y * b) * 43758.5453)[0]) * 1e-8 for a, b in ((12.9898, 78.233), (39.3468, 11.1351))]
        self.x += (x - self.cx + noise[0]).tolist()
        self.y += (y - self.cy + noise[1]).tolist()
        return range(first, len(self.x))

    def locate(self, p: int) -> int:
        X, Y, px, py, t = self.x, self.y, self.x[p], self.y[p], self.last
        for _ in range(4 * len(self.tri) + 10):
            tri = self.tri[t]
            for k in range(3):
                a, b = tri[(k + 1) % 3], tri[(k + 2) % 3]
                if (X[b] - X[a]) * (py - Y[a]) - (Y[b] - Y[a]) * (px - X[a]) < 0 and self.nb[t][k] >= 0:
                    t = self.nb[t][k]
                    break
            else:
                return t
        return t

    def _holds(self, t: int, px: float, py: float) -> bool:
        a, b, c = self.tri[t]
        X, Y = self.x, self.y
        ax, ay, bx, by, cx, cy = X[a] - px, Y[a] - py, X[b] - px, Y[b] - py, X[c] - px, Y[c] - py
        return (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0

    def insert(self, p: int, t: int | None = None) -> None:
        px, py = self.x[p], self.y[p]
        start = self.locate(p) if t is None else t
        bad, stack, edges = {start}, [start], []
        while stack:
            t = stack.pop()
            tri, nb = self.tri[t], self.nb[t]
            for k in range(3):
                o = nb[k]
                if o in bad:
                    continue
                if o >= 0 and self._holds(o, px, py):
                    bad.add(o)
                    stack.append(o)
                else:
                    edges.append((tri[(k + 1) % 3], tri[(k + 2) % 3], o, t))
        edges = [e for e in edges if e[2] not in bad]
        for t in bad:
            self.tri[t] = None
            self.free.append(t)
        by_start, by_end = {}, {}
        made = []
        for a, b, o, was in edges:
            t = self.free.pop() if self.free else len(self.tri)
            if t == len(self.tri):
                self.tri.append(None)
                self.nb.append([-1, -1, -1])
            self.tri[t], self.nb[t] = (p, a, b), [o, -1, -1]
            if o >= 0:
                corner = self.tri[o]
                for k in range(3):
                    if corner[(k + 1) % 3] == b and corner[(k + 2) % 3] == a:
                        self.nb[o][k] = t
            by_start[a], by_end[b] = t, t
            made.append((t, a, b))
        for t, a, b in made:
            self.nb[t][1] = by_start.get(b, -1)  # across (p, b)
            self.nb[t][2] = by_end.get(a, -1)  # across (p, a)
        self.last = made[-1][0]

    def all(self) -> np.ndarray:
        """Corners of all triangles, those with far corners too."""
        return np.array([t for t in self.tri if t is not None], dtype=np.int64).reshape(-1, 3)

    def triangles(self) -> np.ndarray:
        """Triangles of points, counted from 0."""
        t = self.all()
        return t[t.min(axis=1) >= 3] - 3


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Order along a snake of strips: neighbours in it are near each other."""
    n = max(1, int(np.sqrt(len(x) / 4)))
    width = max(float(np.ptp(x)), 1e-9) / n
    strip = np.minimum(((x - x.min()) / width).astype(int), n - 1)
    return np.lexsort((np.where(strip % 2, -y, y), strip))


def delaunay(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of the triangles, counter-clockwise; points at one place are triangulated once."""
    if len(x) < 3:
        return np.zeros((0, 3), np.int64)
    _, first = np.unique(np.column_stack([x, y]), axis=0, return_index=True)
    first = first[_curve(x[first], y[first])]
    if len(first) < 3:
        return np.zeros((0, 3), np.int64)
    t = Triangulation(x[first], y[first])
    for p in range(3, len(first) + 3):
        t.insert(p)
    return first[t.triangles()]


def _wanting(t: Triangulation, core: tuple[float, float, float, float], near: float, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """For every triangle that reaches the core (xmin, ymin, xmax, ymax) the point deepest in its circumcircle, if any.

    All points within ``near`` of the core are in the triangulation already, so circles
    that stay there hold none of these.
    """
    tri = t.all()
    X, Y = np.array(t.x), np.array(t.y)
    tx, ty = X[tri], Y[tri]
    x0, y0, x1, y1 = core[0] - t.cx, core[1] - t.cy, core[2] - t.cx, core[3] - t.cy
    far = tri < 3
    reach = (tx.min(1) <= x1) & (tx.max(1) >= x0) & (ty.min(1) <= y1) & (ty.max(1) >= y0)
    hull = far.sum(axis=1) == 1
    if hull.any():  # beyond the hull edge, on the left of its corners in order
        k = far[hull].argmax(axis=1)
        rows = np.arange(hull.sum())
        ax, ay = tx[hull][rows, (k + 1) % 3], ty[hull][rows, (k + 1) % 3]
        bx, by = tx[hull][rows, (k + 2) % 3], ty[hull][rows, (k + 2) % 3]
        left = [(bx - ax) * (v - ay) - (by - ay) * (u - ax) > 0 for u, v in ((x0, y0), (x0, y1), (x1, y0), (x1, y1))]
        reach[hull] &= np.any(left, axis=0)
    bx, by, cx, cy = (v[:, k] - v[:, 0] for k in (1, 2) for v in (tx, ty))
    with np.errstate(divide="ignore", invalid="ignore"):
        d = 2 * (bx * cy - by * cx)
        u, v = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        r = np.hypot(u, v) * (1 + 1e-6)
        u, v = u + tx[:, 0], v + ty[:, 0]
        reach &= ~((u - r >= x0 - near) & (v - r >= y0 - near) & (u + r <= x1 + near) & (v + r <= y1 + near))
    found = [np.zeros(0, np.int64)]
    qx, qy = px - t.cx, py - t.cy
    corners, sides = tx[reach], ty[reach]
    for lo in range(0, len(corners), 64):
        ax, bx, cx = (corners[lo : lo + 64, k, None] - qx for k in range(3))
        ay, by, cy = (sides[lo : lo + 64, k, None] - qy for k in range(3))
        depth = (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay)
        deepest = depth.argmax(axis=1)
        found.append(deepest[depth[np.arange(len(depth)), deepest] > 0])
    return np.unique(np.concatenate(found))


def delaunay_of_tile(x: np.ndarray, y: np.ndarray, core: tuple[float, float, float, float], near: float) -> np.ndarray:
    """Triangles of all points as far as they reach the core, from those within ``near`` of it and any that these want."""
    if len(x) < 3:
        return np.zeros((0, 3), np.int64)
    _, first = np.unique(np.column_stack([x, y]), axis=0, return_index=True)
    fx, fy = x[first], y[first]
    close = (fx >= core[0] - near) & (fx <= core[2] + near) & (fy >= core[1] - near) & (fy <= core[3] + near)
    if not close.any():
        close[np.argmin(np.abs(fx - (core[0] + core[2]) / 2) + np.abs(fy - (core[1] + core[3]) / 2))] = True
    own, rest = first[close], first[~close]
    own = own[_curve(x[own], y[own])]
    t = Triangulation(x[own], y[own], max(float(np.ptp(fx)), float(np.ptp(fy)), 1e-9))
    for p in range(3, len(own) + 3):
        t.insert(p)
    while len(rest):
        wanted = _wanting(t, core, near, x[rest], y[rest])
        if not len(wanted):
            break
        more = rest[wanted]
        more = more[_curve(x[more], y[more])]
        for p in t.add(x[more], y[more]):
            t.insert(p)
        own, rest = np.r_[own, more], np.delete(rest, wanted)
    return own[t.triangles()]


def longest_edge(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    sides = [np.hypot(x[t[:, i]] - x[t[:, j]], y[t[:, i]] - y[t[:, j]]) for i, j in ((0, 1), (1, 2), (2, 0))]
    return np.max(sides, axis=0)


def tile_triangles(points: pd.DataFrame, tile: tuple[int, int], size: float, triangles: np.ndarray) -> pd.DataFrame:
    """The triangles whose centroid the tile owns."""
    x, y = points["X"].to_numpy(), points["Y"].to_numpy()
    return triangle_rows(points, tile, own_triangles(x, y, triangles, tile, size))


#: Points of a tile, and the distance around it, in distances between points, from which it begins.
TILE_POINTS, NEAR = 800, 4.0


@dataclass
class Extent:
    """A cloud's box, the tiles that suit its density, and the distance ``near`` a tile from which it begins."""

    box: tuple[float, float, float, float] | None
    tile: float
    near: float


def extent_of(points: DataFrame, tile: float | None, halo: float) -> Extent:
    """Tiles are no narrower than one and a half halos, so that a point goes to few of them."""
    n, *box = points.agg(F.count(F.lit(1)), F.min("X"), F.min("Y"), F.max("X"), F.max("Y")).first()
    if not n:
        return Extent(None, tile or 1.0, halo)
    apart = (max(box[2] - box[0], 1e-6) * max(box[3] - box[1], 1e-6) / n) ** 0.5
    return Extent(tuple(box), tile or max(apart * TILE_POINTS**0.5, 1.5 * halo), min(halo, NEAR * apart))


def _around_tiles(points: DataFrame, tile: float, halo: float) -> DataFrame:
    """Points once for each tile that they lie within ``halo`` of."""
    from ..functions.lattice import around

    reach = max(1, int(np.ceil(halo / tile)))
    wide = points.withColumn("__d", F.explode(around(reach, "i", "j")))
    wide = wide.withColumns({"tile_x": column_of(F.col("X"), tile) + F.col("__d.i"), "tile_y": row_of(F.col("Y"), tile) + F.col("__d.j")})
    b, size = F.lit(float(halo)), F.lit(float(tile))
    near = lambda c, t: (F.col(c) >= F.col(t) * size - b) & (F.col(c) <= (F.col(t) + 1) * size + b)
    return wide.where(near("X", "tile_x") & near("Y", "tile_y")).drop("__d")


def _core(key: tuple[int, int], tile: float) -> tuple[float, float, float, float]:
    return key[0] * tile, key[1] * tile, (key[0] + 1) * tile, (key[1] + 1) * tile


def triangulate(df: DataFrame, max_edge: float = 0.0, conditions=None, use_attribute: str = "Z", tile: float | None = None, halo: float = 20.0) -> DataFrame:
    """Triangles (tri_id, ax … cz) of the accepted points.

    Triangles with an edge of ``max_edge`` or more go (0: none; negative: only those stay).
    ``halo`` is how far around its tile a triangle's circumcircle is looked into: those of
    wider ones may differ from those of the whole cloud.
    """
    points = df.where(all_of(df, conditions)).select("X", "Y", attribute(df, use_attribute).alias("Z"))
    extent = extent_of(points, tile, halo)
    size, near = extent.tile, extent.near

    def run(key, own):
        key = (int(key[0]), int(key[1]))
        x, y = own["X"].to_numpy(), own["Y"].to_numpy()
        t = own_triangles(x, y, delaunay_of_tile(x, y, _core(key, size), near), key, size)
        if max_edge and len(t):
            long = longest_edge(x, y, t) >= abs(max_edge)
            t = t[~long] if max_edge > 0 else t[long]
        return triangle_rows(own, key, t)

    return _around_tiles(points, size, halo).groupBy("tile_x", "tile_y").applyInPandas(run, TRIANGLE)


def own_triangles(x: np.ndarray, y: np.ndarray, t: np.ndarray, key: tuple[int, int], size: float) -> np.ndarray:
    """Those whose centroid the tile owns."""
    if not len(t):
        return t
    # sorted, so that the sum is the same to the last bit whatever corner a tile names first
    mx, my = np.sort(x[t], axis=1).sum(axis=1) / 3, np.sort(y[t], axis=1).sum(axis=1) / 3
    return t[(np.floor(mx / size) == key[0]) & (np.ceil(my / size) - 1 == key[1])]


def triangle_rows(points: pd.DataFrame, key: tuple[int, int], t: np.ndarray) -> pd.DataFrame:
    x, y, z = (points[c].to_numpy() for c in ("X", "Y", "Z"))
    first = ((key[0] & 0xFFFFF) << 43) | ((key[1] & 0xFFFFF) << 23)
    out = {"tri_id": np.arange(len(t), dtype=np.int64) + first}
    for k, v in enumerate("abc"):
        out |= {f"{v}x": x[t[:, k]], f"{v}y": y[t[:, k]], f"{v}z": z[t[:, k]]}
    return pd.DataFrame(out)


def heights_at(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(height, triangle) under every point; nan and -1 where no triangle lies over it."""
    height, at = np.full(len(px), np.nan), np.full(len(px), -1, np.int64)
    if not len(t) or not len(px):
        return height, at
    tx, ty = x[t], y[t]
    lo_x, lo_y = px.min(), py.min()
    n = max(1, int(np.sqrt(len(t))))
    wx, wy = max(float(np.ptp(px)), 1e-9) / n, max(float(np.ptp(py)), 1e-9) / n
    cell = lambda v, lo, w: np.clip(np.floor((v - lo) / w), -1, n).astype(np.int64)
    key = np.clip(cell(px, lo_x, wx), 0, n - 1) * n + np.clip(cell(py, lo_y, wy), 0, n - 1)
    order = np.argsort(key, kind="stable")
    key = key[order]
    i0, i1 = np.maximum(cell(tx.min(1) - 1e-7, lo_x, wx), 0), np.minimum(cell(tx.max(1) + 1e-7, lo_x, wx), n - 1)
    j0, j1 = np.maximum(cell(ty.min(1) - 1e-7, lo_y, wy), 0), np.minimum(cell(ty.max(1) + 1e-7, lo_y, wy), n - 1)
    columns = np.maximum(i1 - i0 + 1, 0) * (j1 >= j0)
    # a row of cells of a triangle's box is one run of the sorted points
    tri = np.repeat(np.arange(len(t)), columns)
    i = i0[tri] + np.arange(len(tri)) - np.repeat(np.cumsum(columns) - columns, columns)
    first, end = np.searchsorted(key, i * n + j0[tri]), np.searchsorted(key, i * n + j1[tri], side="right")
    runs = end - first
    for lo in range(0, len(tri), 50_000):  # pairs are made for a bounded number of runs at once
        r = runs[lo : lo + 50_000]
        who = np.repeat(tri[lo : lo + 50_000], r)
        p = order[np.repeat(first[lo : lo + 50_000], r) + np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r)]
        ax, bx, cx = tx[who].T
        ay, by, cy = ty[who].T
        det = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
        with np.errstate(divide="ignore", invalid="ignore"):
            wa = ((by - cy) * (px[p] - cx) + (cx - bx) * (py[p] - cy)) / det
            wb = ((cy - ay) * (px[p] - cx) + (ax - cx) * (py[p] - cy)) / det
        wc = 1 - wa - wb
        ok = (det != 0) & (wa >= -_EPS) & (wb >= -_EPS) & (wc >= -_EPS)
        p, who = p[ok], who[ok]
        v = wa[ok] * z[t[who, 0]] + wb[ok] * z[t[who, 1]] + wc[ok] * z[t[who, 2]]
        back = np.argsort(-v, kind="stable")  # of several at an edge the lowest is written last
        height[p[back]] = np.fmin(height[p[back]], v[back])
        at[p[back]] = who[back]
    return height, at


def surface_heights(ground: DataFrame, points: DataFrame | None, tile: float | None = None, halo: float = 20.0, res: float | None = None, carry: bool = False) -> DataFrame:
    """Heights of the triangulated ground (X, Y, Z): (pid, __v) under points, or (col, row, __v) at cell centres.

    With ``carry`` all columns of the points stand beside ``__v``, so that no join need bring them together.
    """
    extent = extent_of(ground, tile, halo)
    if res is not None:  # whole cells in a tile
        extent.tile = max(1, round(extent.tile / res)) * res
    size, box, near = extent.tile, extent.box, extent.near
    carried = {f.name: f.dataType.simpleString() for f in points.schema if carry or f.name == "pid"} if res is None else {"col": "bigint", "row": "bigint"}
    schema = ", ".join([*[f"`{n}` {kind}" for n, kind in carried.items()], "__v double"])
    if box is None:
        return ground.sparkSession.createDataFrame([], schema)

    def run(key, own):
        key = (key[0].as_py(), key[1].as_py())
        asked = numbers(own, "__q").astype(bool)
        x, y, z = (numbers(own, c)[~asked] for c in "XYZ")
        if res is None:
            wanted = own.filter(pa.array(asked))
            px, py = numbers(wanted, "X"), numbers(wanted, "Y")
            ids = {n: wanted.column(f"__own{i}") for i, n in enumerate(carried)}
        else:
            (c0, c1), (r0, r1) = ([int(round(k * size / res)) for k in (at, at + 1)] for at in key)
            cols, rows = (g.ravel() for g in np.meshgrid(np.arange(c0, c1), np.arange(r0, r1)))
            px, py = (cols + 0.5) * res, (rows + 0.5) * res
            inside = (px >= box[0]) & (px <= box[2]) & (py >= box[1]) & (py <= box[3])
            px, py, ids = px[inside], py[inside], {"col": cols[inside], "row": rows[inside]}
        v, at = heights_at(px, py, x, y, z, delaunay_of_tile(x, y, _core(key, size), near)) if len(px) else (np.zeros(0), np.zeros(0, np.int64))
        found = at >= 0
        columns = [pa.array(c).filter(pa.array(found)) if isinstance(c, np.ndarray) else c.filter(pa.array(found)) for c in ids.values()]
        return pa.table([*columns, pa.array(v[found])], names=[*ids, "__v"])

    asks = points is not None
    none = {f"__own{i}": F.lit(None).cast(kind) for i, kind in enumerate(carried.values())} if asks else {}
    rows = _around_tiles(ground.select("X", "Y", "Z", F.lit(False).alias("__q")), size, halo).withColumns(none)
    if asks:
        own = points.select(*[F.col(f"`{n}`").alias(f"__own{i}") for i, n in enumerate(carried)], "X", "Y", F.lit(0.0).alias("Z"), F.lit(True).alias("__q"))
        rows = rows.unionByName(own.withColumns({"tile_x": column_of(F.col("X"), size), "tile_y": row_of(F.col("Y"), size)}))
    return rows.groupBy("tile_x", "tile_y").applyInArrow(run, schema)


#: Barycentric weights of (px, py), with a tolerance at the edges.
_DET = "((by - cy) * (ax - cx) + (cx - bx) * (ay - cy))"
_WA = f"((by - cy) * (px - cx) + (cx - bx) * (py - cy)) / {_DET}"
_WB = f"((cy - ay) * (px - cx) + (ax - cx) * (py - cy)) / {_DET}"
_EPS = 2e-8


def _inside(joined: DataFrame) -> DataFrame:
    """Rows whose point (px, py) lies in the triangle, with the height of the plane as ``__v``."""
    w = joined.where(f"{_DET} <> 0").withColumns({"__wa": F.expr(_WA), "__wb": F.expr(_WB)})
    w = w.withColumn("__wc", F.lit(1.0) - F.col("__wa") - F.col("__wb"))
    w = w.where(f"__wa >= -{_EPS} and __wb >= -{_EPS} and __wc >= -{_EPS}")
    return w.withColumn("__v", F.expr("__wa * az + __wb * bz + __wc * cz")).drop("__wa", "__wb", "__wc")


def _cells_of(triangles: DataFrame, cell: float) -> DataFrame:
    """Triangles once for each cell that their box touches."""
    low, high = (lambda c: F.least(f"a{c}", f"b{c}", f"c{c}")), (lambda c: F.greatest(f"a{c}", f"b{c}", f"c{c}"))
    wide = triangles.withColumn("__c", F.explode(covering(low("x"), high("x"), "x", cell)))
    return wide.withColumn("__r", F.explode(covering(low("y"), high("y"), "y", cell)))


def interpolate(points: DataFrame, triangles: DataFrame, cell: float = 2.0) -> DataFrame:
    """(pid, __v): heights of the triangulation under the points it covers."""
    keyed = points.select("pid", F.col("X").alias("px"), F.col("Y").alias("py"), column_of(F.col("X"), cell).alias("__c"), row_of(F.col("Y"), cell).alias("__r"))
    return _inside(keyed.join(_cells_of(triangles, cell), ["__c", "__r"])).groupBy("pid").agg(F.min("__v").alias("__v"))


def rasterize_triangulation(triangles: DataFrame, res: float, band: str = "z") -> DataFrame:
    """Heights at the cell centres that the triangulation covers."""
    cells = _cells_of(triangles, res).withColumns({"px": centre(F.col("__c"), res), "py": centre(F.col("__r"), res)})
    out = _inside(cells).groupBy(F.col("__c").alias("col"), F.col("__r").alias("row")).agg(F.min("__v").alias(band))
    return with_centre(out, res).select("col", "row", "x", "y", band)


def hull_edges(triangles: DataFrame) -> DataFrame:
    """The contour: edges that one triangle has only, as (x1, y1, x2, y2).

    Directions are counted against each other: what is left of any triangles closes to rings,
    also where triangles of two tiles differ (circles wider than the halo) and an edge has three.
    """
    ends = F.array(*[F.struct(F.col(f"{u}x").alias("x1"), F.col(f"{u}y").alias("y1"), F.col(f"{v}x").alias("x2"), F.col(f"{v}y").alias("y2")) for u, v in ("ab", "bc", "ca")])
    edges = triangles.select(F.explode(ends).alias("e")).select("e.*")
    forward = F.struct("x1", "y1") <= F.struct("x2", "y2")
    back = F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    key = F.when(forward, F.struct("x1", "y1", "x2", "y2")).otherwise(back)
    net = edges.groupBy(key.alias("k")).agg(F.sum(F.when(forward, 1).otherwise(-1)).alias("n")).where("n <> 0")
    kept = net.select(F.col("k.x1").alias("x1"), F.col("k.y1").alias("y1"), F.col("k.x2").alias("x2"), F.col("k.y2").alias("y2"), "n")
    return kept.select(F.when(F.col("n") > 0, F.struct("x1", "y1", "x2", "y2")).otherwise(back).alias("e"), F.explode(F.array_repeat(F.lit(0), F.abs("n").cast("int")))).select("e.*")


def hull_rings(triangles: DataFrame) -> DataFrame:
    """(ring_id, n, area, ring): the contour's closed rings, outer ones counter-clockwise with a positive area.

    Edges are linked end to start (by rank where rings touch in a point) and labelled by
    pointer doubling, so the number of rounds grows with the logarithm of the longest
    ring; one task walks a ring.
    """
    from pyspark.sql import Window

    from .neighbours import write_once

    # a corner is left by the edge of the same rank that reaches it
    by = lambda *c: Window.partitionBy(*c).orderBy("x1", "y1", "x2", "y2")
    edges = hull_edges(triangles).withColumn("id", F.monotonically_increasing_id())
    edges = write_once(edges.withColumns({"out": F.row_number().over(by("x1", "y1")), "into": F.row_number().over(by("x2", "y2"))}))
    start = edges.select(F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("out").alias("into"), F.col("id").alias("next"))
    links = write_once(edges.join(start, ["x2", "y2", "into"]).select("id", "next", F.least("id", "next").alias("label")))
    first = links.select("id", F.col("next").alias("step"))
    while True:
        ahead = links.select(F.col("id").alias("next"), F.col("next").alias("after"), F.col("label").alias("other"))
        new = write_once(links.join(ahead, "next").select("id", F.col("after").alias("next"), F.least("label", "other").alias("label"), (F.col("other") < F.col("label")).alias("moved")))
        links = new.drop("moved")
        if not new.where("moved").take(1):
            break

    def walk(key, own):
        following = dict(zip(own["id"], own["step"]))
        place = dict(zip(own["id"], zip(own["x1"], own["y1"])))
        at, ring = min(following), []
        for _ in range(len(following)):
            ring.append(place[at])
            at = following[at]
        ring.append(ring[0])
        x, y = np.array(ring).T
        area = float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)
        return pd.DataFrame({"ring_id": [key[0]], "n": [len(ring)], "area": [area], "ring": [[{"x": a, "y": b} for a, b in ring]]})

    whole = edges.select("id", "x1", "y1").join(first, "id").join(links.select("id", "label"), "id")
    return whole.groupBy("label").applyInPandas(walk, "ring_id long, n long, area double, ring array<struct<x:double,y:double>>")


def ground_of(df: DataFrame, classes) -> DataFrame:
    return df.where(all_of(df, f"Classification %in% {' '.join(map(str, classes))}")).select("X", "Y", "Z")


def normalize(df: DataFrame, store_in: str = "", classes=(2, 9), **options) -> DataFrame:
    """Heights above the ground triangulation; points it doesn't cover go."""
    from ..functions.attributes import find

    found = surface_heights(ground_of(df, classes), df, carry=True, **options)
    out = found.withColumn(store_in or find(df, "Z"), F.col(find(df, "Z")) - F.col("__v"))
    return out.drop("__v")


def hag(df: DataFrame, **options) -> DataFrame:
    return normalize(df, "HAG", **options)


def surface_raster(ground: DataFrame, res: float, **options) -> DataFrame:
    """Heights of the triangulated points (X, Y, Z) at the cell centres that they cover."""
    found = surface_heights(ground, None, res=res, **options)
    return with_centre(found, res).select("col", "row", "x", "y", F.col("__v").alias("z"))


def dtm(df: DataFrame, res: float = 1.0, add_class=(), **options) -> DataFrame:
    """Ground surface: classes 2, 9 and those added."""
    return surface_raster(ground_of(df, (2, 9, *add_class)), res, **options)


def dsm(df: DataFrame, res: float = 1.0, tin: bool = False, **options) -> DataFrame:
    """Surface of the highest points, or of the first returns' triangulation."""
    from .raster import rasterize

    if tin:
        return surface_raster(df.where(all_of(df, "ReturnNumber == 1")).select("X", "Y", "Z"), res, **options)
    return rasterize(df, res, ["max"]).withColumnRenamed("max", "z")


chm = dsm

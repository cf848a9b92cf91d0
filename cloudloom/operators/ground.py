"""Ground classification per tile: cloth simulation and progressive TIN densification."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import find
from ..functions.predicates import all_of
from .spatial import with_halo
from .tiles import numbers, pairs
from .tin import Triangulation, _curve

WATER, NOISE = 9, 7


def _per_tile(df: DataFrame, tile: float, halo: float, function) -> DataFrame:
    """``df`` with ``__flag`` from ``function(points of a tile and its halo)``; a halo's copies have coordinates only."""
    names = df.columns
    columns = [c for c in names if c != "__ok"]
    wide = with_halo(df, tile, halo).where(~F.col("is_buffer") | F.col("__ok"))
    own = [F.when(~F.col("is_buffer"), F.col(f"`{c}`")).alias(c) for c in columns if c not in ("X", "Y", "Z")]
    wide = wide.select(*own, "X", "Y", "Z", "__ok", "tile_x", "tile_y", "is_buffer")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], "__flag int"])

    def run(table):
        flags = np.zeros(table.num_rows, dtype=np.int32)
        ok = numbers(table, "__ok").astype(bool)
        if ok.any():
            flags[ok] = function(*(numbers(table, c)[ok] for c in "XYZ"))
        core = ~numbers(table, "is_buffer").astype(bool)
        return table.filter(pa.array(core)).select(names).append_column("__flag", pa.array(flags[core]))

    return wide.groupBy("tile_x", "tile_y").applyInArrow(run, schema)


def cloth(x: np.ndarray, y: np.ndarray, z: np.ndarray, resolution: float, rigidness: int, iterations: int, time_step: float, slope_smooth: bool) -> np.ndarray:
    """Heights of a cloth that falls on the upside-down cloud, at the points."""
    up = -z
    x0, y0 = np.floor(x.min() / resolution) * resolution - resolution, np.floor(y.min() / resolution) * resolution - resolution
    nx, ny = int((x.max() - x0) / resolution) + 3, int((y.max() - y0) / resolution) + 3
    ci, cj = np.rint((x - x0) / resolution).astype(int), np.rint((y - y0) / resolution).astype(int)
    floor = np.full((nx, ny), -np.inf)
    np.maximum.at(floor, (ci, cj), up)
    for _ in range(nx + ny):  # particles without a point take the height of their neighbours
        empty = np.isinf(floor)
        if not empty.any():
            break
        padded = np.pad(floor, 1, constant_values=-np.inf)
        near = np.max([padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]], axis=0)
        floor = np.where(empty, near, floor)
    height = np.full((nx, ny), up.max() + 0.05)
    before, free = height.copy(), np.ones((nx, ny), bool)
    gravity = 0.2 * time_step * time_step
    share = {1: 0.3, 2: 0.5, 3: 0.7}.get(rigidness, 0.3)
    for _ in range(iterations):
        moved = np.where(free, height + 0.99 * (height - before) - gravity, height)
        before = height
        for axis in (0, 1):
            a = [slice(None), slice(None)]
            b = [slice(None), slice(None)]
            a[axis], b[axis] = slice(0, -1), slice(1, None)
            gap = moved[tuple(b)] - moved[tuple(a)]
            fa, fb = free[tuple(a)], free[tuple(b)]
            step = gap * share * np.where(fa & fb, 0.5, 1.0)
            moved[tuple(a)] += np.where(fa, step, 0.0)
            moved[tuple(b)] -= np.where(fb, step, 0.0)
        hit = free & (moved <= floor)
        moved = np.where(hit, floor, moved)
        free &= ~hit
        change = np.abs(moved - before).max()
        height = moved
        if change < 0.005:
            break
    if slope_smooth:  # free particles next to settled ones at nearly their height settle on the ground too
        for _ in range(3):
            padded = np.pad(np.where(free, np.nan, height), 1, constant_values=np.nan)
            stack = np.array([padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]])
            close = free & (np.nanmin(np.where(np.isnan(stack), np.inf, np.abs(stack - floor)), axis=0) < 0.3)
            height = np.where(close, floor, height)
            free &= ~close
    u, v = (x - x0) / resolution, (y - y0) / resolution
    i, j = np.clip(u.astype(int), 0, nx - 2), np.clip(v.astype(int), 0, ny - 2)
    fu, fv = u - i, v - j
    h = height
    return -(h[i, j] * (1 - fu) * (1 - fv) + h[i + 1, j] * fu * (1 - fv) + h[i, j + 1] * (1 - fu) * fv + h[i + 1, j + 1] * fu * fv)


def classify_with_csf(
    df: DataFrame, slope_smooth: bool = False, class_threshold: float = 0.5, cloth_resolution: float = 0.5, rigidness: int = 1,
    iterations: int = 500, time_step: float = 0.65, classification: int = 2, conditions=None, tile: float = 20.0,
) -> DataFrame:
    """Points near a settled cloth become ground; an earlier ground class is reset, water stays."""
    column = find(df, "Classification")

    def run(x, y, z):
        return (np.abs(z - cloth(x, y, z, cloth_resolution, rigidness, iterations, time_step, slope_smooth)) <= class_threshold).astype(np.int32)

    found = _per_tile(df.withColumn("__ok", all_of(df, conditions)), tile, min(5 * cloth_resolution, tile), run)
    kind = df.schema[column].dataType
    old = F.when(F.col(column) == classification, F.lit(0).cast(kind)).otherwise(F.col(column))
    new = F.when((F.col("__flag") == 1) & (F.col(column) != WATER), F.lit(classification).cast(kind)).otherwise(old)
    return found.withColumn(column, new).select(df.columns)


def _triangle_of(px: np.ndarray, py: np.ndarray, tx: np.ndarray, ty: np.ndarray, test) -> np.ndarray:
    """The first triangle (corners tx, ty) that holds each point, or -1.

    ``test(points, triangles)`` gives the places of the pairs that hold; pairs are those of one cell.
    """
    found = np.full(len(px), len(tx), np.int64)
    if not len(px) or not len(tx):
        return found - len(tx) - 1
    lo, hi = (np.array([f(tx), f(ty)]) for f in (np.min, np.max))
    n = max(1, int((2 * len(tx)) ** 0.5))
    wide = np.maximum(hi - lo, 1e-9) / n
    cell = lambda v, axis: np.clip(np.floor((v - lo[axis]) / wide[axis]), 0, n - 1).astype(np.int64)
    key = cell(px, 0) * n + cell(py, 1)
    order = np.argsort(key, kind="stable")
    key = key[order]
    pad = 1e-7
    i0, i1, j0, j1 = cell(tx.min(1) - pad, 0), cell(tx.max(1) + pad, 0), cell(ty.min(1) - pad, 1), cell(ty.max(1) + pad, 1)
    columns = i1 - i0 + 1
    # a column of cells of a triangle's box is one run of the sorted points
    tri = np.repeat(np.arange(len(tx)), columns)
    i = i0[tri] + np.arange(len(tri)) - np.repeat(np.cumsum(columns) - columns, columns)
    first, end = np.searchsorted(key, i * n + j0[tri]), np.searchsorted(key, i * n + j1[tri], side="right")
    for run, place in pairs(first, end):
        who, p = tri[run], order[place]
        ok = test(p, who)
        np.minimum.at(found, p[ok], who[ok])
    return np.where(found < len(tx), found, -1)


def _weights(x, y, t, p) -> np.ndarray:
    """The weights of the corners ``t`` at the points ``p``; not finite where the corners lie on a line."""
    (ax, bx, cx), (ay, by, cy) = x[t].T, y[t].T
    with np.errstate(divide="ignore", invalid="ignore"):
        det = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
        wa = ((by - cy) * (x[p] - cx) + (cx - bx) * (y[p] - cy)) / det
        wb = ((cy - ay) * (x[p] - cx) + (ax - cx) * (y[p] - cy)) / det
        return np.column_stack([wa, wb, 1 - wa - wb])


class _Surface:
    """A growing triangulation of some of the points that knows the triangle of every other point.

    A point belongs to the triangle in which the triangulation would insert it.  Only points
    of triangles that went are looked for again, among those that came.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, ground: np.ndarray):
        self.x, self.y, self.z = x, y, z
        self.t = Triangulation(x, y)
        self.px, self.py = np.array(self.t.x[3:]), np.array(self.t.y[3:])
        self.at = np.full(len(x), -1, np.int64)  # the slot of the triangle
        self.weights = np.zeros((len(x), 3))
        self.slots = np.zeros((0, 3), np.int64)
        self.vertex: dict[tuple[float, float], int] = {}
        self.height = np.arange(len(x))  # whose height stands at a corner: of points at one place the first
        self.left = np.flatnonzero(~ground)
        self.insert(np.flatnonzero(ground))

    def insert(self, points: np.ndarray) -> np.ndarray:
        """The other points whose triangle changed."""
        for p in points[_curve(self.x[points], self.y[points])].tolist() if len(points) else ():
            v = self.vertex.setdefault((self.x[p], self.y[p]), p)
            if v == p:
                self.t.insert(p + 3)
            self.height[v] = min(self.height[v], p)
        slots = np.array([c or (-1, -1, -1) for c in self.t.tri], np.int64) - 3
        slots[slots.min(axis=1) < 0] = -1
        before = np.full_like(slots, -2)
        before[: len(self.slots)] = self.slots
        came = (slots != before).any(axis=1)
        self.slots = slots
        self.left = self.left[~np.isin(self.left, points)]
        moved = self.left[(self.at[self.left] < 0) | came[self.at[self.left]]]
        new = np.flatnonzero(came & (slots[:, 0] >= 0))
        tx, ty, mx, my = self.px[slots[new]], self.py[slots[new]], self.px[moved], self.py[moved]

        def inside(p, k):
            ok = np.arange(len(p))
            for a, b in ((0, 1), (1, 2), (2, 0)):
                q, at = p[ok], k[ok]
                ok = ok[(tx[at, b] - tx[at, a]) * (my[q] - ty[at, a]) - (ty[at, b] - ty[at, a]) * (mx[q] - tx[at, a]) >= 0]
            return ok

        at = _triangle_of(mx, my, tx, ty, inside)
        self.at[moved] = np.where(at >= 0, new[at] if len(new) else -1, -1)
        w = _weights(self.x, self.y, slots[self.at[moved]], moved)
        with np.errstate(invalid="ignore"):
            odd = (self.at[moved] < 0) | ~(w.min(axis=1) >= -1e-6)
        if odd.any():  # on the side of a triangle without width: any other that touches the point
            every = np.flatnonzero(slots[:, 0] >= 0)
            lost = moved[odd]

            def touches(p, k):
                with np.errstate(invalid="ignore"):
                    return np.flatnonzero(_weights(self.x, self.y, slots[every[k]], lost[p]).min(axis=1) >= -1e-9)

            at = _triangle_of(self.x[lost], self.y[lost], self.x[slots[every]], self.y[slots[every]], touches)
            self.at[lost] = np.where(at >= 0, every[at], -1)
            w[odd] = _weights(self.x, self.y, slots[self.at[lost]], lost)
        self.weights[moved] = w
        return moved[self.at[moved] >= 0]

    def corners(self, points: np.ndarray) -> np.ndarray:
        return self.slots[self.at[points]]

    def off(self, points: np.ndarray) -> np.ndarray:
        """Vertical distance to the surface."""
        return np.abs(self.z[points] - (self.weights[points] * self.z[self.height[self.corners(points)]]).sum(1))


def densify(x: np.ndarray, y: np.ndarray, z: np.ndarray, res: float, angle: float, distance: float, spacing: float, rounds: int = 12) -> np.ndarray:
    """1 for ground: seeds are the lowest points of coarse cells; points near the growing surface join.

    Points around the cloud, as high as the nearest seed, carry the surface to its edges.
    """
    n = len(x)
    cells = pd.DataFrame({"i": np.floor(x / res), "j": np.floor(y / res), "z": z})
    seeds = cells.groupby(["i", "j"])["z"].idxmin().to_numpy()
    bx, by = (np.linspace(v.min() - res, v.max() + res, max(3, int(np.ptp(v) / res) + 2)) for v in (x, y))
    edge = np.array([(u, v) for u in bx for v in by if u in (bx[0], bx[-1]) or v in (by[0], by[-1])])
    nearest = np.argmin((edge[:, :1] - x[seeds]) ** 2 + (edge[:, 1:] - y[seeds]) ** 2, axis=1)
    x, y, z = np.r_[x, edge[:, 0]], np.r_[y, edge[:, 1]], np.r_[z, z[seeds][nearest]]
    ground = np.arange(len(x)) >= n
    ground[seeds] = True
    limit = np.tan(np.radians(angle))
    surface = _Surface(x, y, z, ground)
    off, joins = np.full(len(x), np.inf), np.zeros(len(x), bool)
    moved = surface.left[surface.at[surface.left] >= 0]
    for _ in range(rounds):
        joins[surface.left[surface.at[surface.left] < 0]] = False
        off[moved] = surface.off(moved)
        corners = surface.corners(moved)
        sides = np.hypot(x[moved][:, None] - x[corners], y[moved][:, None] - y[corners])
        slope = np.abs(z[moved][:, None] - z[surface.height[corners]]) / np.maximum(sides, 1e-9)
        joins[moved] = (off[moved] <= distance) & (slope.max(axis=1) <= limit) & (sides.min(axis=1) >= spacing)
        next_ = surface.left[joins[surface.left]]
        if not len(next_):
            break
        # of several points for one triangle the nearest to its plane goes first
        next_ = next_[np.lexsort((next_, off[next_], surface.at[next_]))]
        next_ = next_[np.r_[True, surface.at[next_[1:]] != surface.at[next_[:-1]]]]
        ground[next_] = True
        moved = surface.insert(next_)
    rest = surface.left[surface.at[surface.left] >= 0]
    ground[rest[surface.off(rest) <= spacing]] = True
    return ground[:n].astype(np.int32)


def classify_with_ptd(
    df: DataFrame, res: float = 10.0, angle: float = 30.0, distance: float = 2.0, spacing: float = 0.25, classification: int = 2, conditions=None, tile: float = 30.0, halo: float = 30.0
) -> DataFrame:
    """Progressive densification: accepted points become ground or unclassified (1)."""
    column = find(df, "Classification")
    marked = df.withColumn("__ok", all_of(df, conditions))
    found = _per_tile(marked, tile, halo, lambda x, y, z: densify(x, y, z, res, angle, distance, spacing))
    kind = df.schema[column].dataType
    new = F.when(F.col("__flag") == 1, F.lit(classification).cast(kind)).when(F.col("__ok"), F.lit(1).cast(kind)).otherwise(F.col(column))
    return found.withColumn(column, new).select(df.columns)

"""Neighbourhoods: radius joins, k nearest, and what builds on them.

Counts within a radius and local maxima come from tiles with a halo (``tiles``).  A radius
join sends one side to the cells around it and joins on the cell, so it is an equality
join that the engine can balance; no index and no halo is needed.  The k nearest come from tiles that are split until each holds a bounded number of points,
with a halo as wide as the answers need; what a halo does not prove is asked again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attributes import attribute, find
from ..functions.lattice import column_of, row_of, voxel
from ..functions.metrics import aggregates
from ..functions.predicates import all_of
from ..sources.points import shared_folder
from . import tiles as L


def write_once(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the folder all executors share, read again: a cut in the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)  # when the application ends
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_AXES = (("X", column_of), ("Y", row_of), ("Z", column_of))


def _cell_names(dims: int) -> list[str]:
    return [f"__c{k}" for k in range(dims)]


def with_cells(df: DataFrame, h: float, dims: int) -> DataFrame:
    return df.withColumns({n: index(F.col(axis), h) for n, (axis, index) in zip(_cell_names(dims), _AXES)})


def _spread(df: DataFrame, dims: int, reach: int = 1) -> DataFrame:
    """Every row once for each cell within ``reach`` of its own."""
    from ..functions.lattice import around

    names = _cell_names(dims)
    wide = df.withColumn("__d", F.explode(around(reach, *names)))
    return wide.withColumns({n: F.col(n) + F.col(f"__d.{n}") for n in names}).drop("__d")


def squared_distance(dims: int = 3, suffix: str = "2") -> Column:
    out = None
    for axis, _ in _AXES[:dims]:
        d = F.col(axis) - F.col(axis + suffix)
        out = d * d if out is None else out + d * d
    return out


def radius_pairs(seeds: DataFrame, points: DataFrame, radius: float, dims: int = 3, keep: list[str] = (), few: bool = False) -> DataFrame:
    """Pairs of seeds and points at most ``radius`` apart.

    Columns of the seeds, ``pid2``, the coordinates and ``keep`` of the point suffixed with
    2, and ``d2``.  Cells are two radii wide.  Points, or seeds where they are ``few``, go to
    the cells that the box around them touches, one to eight; the others have one cell.
    """
    names = _cell_names(dims)
    axes = [a for a, _ in _AXES[:dims]]
    cell, reach = 2.0 * radius, radius * (1 + 1e-9)

    def touched(df: DataFrame) -> DataFrame:
        for n, (axis, index) in zip(names, _AXES[:dims]):
            df = df.withColumn(n, F.explode(F.sequence(index(F.col(axis) - reach, cell), index(F.col(axis) + reach, cell))))
        return df

    def one(df: DataFrame) -> DataFrame:
        return with_cells(df, cell, dims)

    other = (one if few else touched)(points).select(*names, F.col("pid").alias("pid2"), *[F.col(a).alias(f"{a}2") for a in [*axes, *keep]])
    joined = (touched if few else one)(seeds).join(other, names)
    return joined.withColumn("d2", squared_distance(dims)).where(F.col("d2") <= radius * radius).drop(*names)


#: Points that a tile of the k-nearest search should hold, and how often a tile is halved at most.
TILE_POINTS, MAX_LEVEL = 32_000, 24
#: Points whose distances are computed at once.
_LEAF = 64
#: Tiles that are split further are broadcast up to so many (24 bytes each), more are joined.
BROADCAST_TILES = 200_000


def _leaves(xyz: np.ndarray) -> list[np.ndarray]:
    """Rows in groups of at most _LEAF near ones: halved along the longest side."""
    out, stack = [], [np.arange(len(xyz))]
    while stack:
        own = stack.pop()
        if len(own) <= _LEAF:
            out.append(own)
            continue
        axis = int(np.ptp(xyz[own], axis=0).argmax())
        half = len(own) // 2
        order = own[np.argpartition(xyz[own, axis], half)]
        stack += [order[:half], order[half:]]
    return out


def nearest_in_tile(seeds: np.ndarray, xyz: np.ndarray, pid: np.ndarray, k: int, halo: float) -> tuple[np.ndarray, np.ndarray]:
    """(index, d2) of the ``k`` nearest points of every seed, by distance and pid; -1 and infinity where fewer.

    Points beyond ``halo`` of a seed are not looked for.  Of points at one place only the
    first ``k`` by pid can be among the nearest of any seed.
    """
    order = np.lexsort((pid, xyz[:, 2], xyz[:, 1], xyz[:, 0]))
    same = np.r_[False, (xyz[order[1:]] == xyz[order[:-1]]).all(axis=1)]
    at = np.arange(len(order))
    place = at - np.maximum.accumulate(np.where(same, 0, at))
    kept = order[place < k]
    x, y, z = (np.ascontiguousarray(xyz[kept, axis]) for axis in range(3))  # by x
    pid = pid[kept]
    index = np.full((len(seeds), k), -1, np.int64)
    d2 = np.full((len(seeds), k), np.inf)
    for leaf in _leaves(seeds):
        own = seeds[leaf]
        lo, hi = own.min(axis=0), own.max(axis=0)
        left = np.arange(len(leaf))
        r = max(float((hi - lo).max()) / 2, halo / 8, 1e-9)
        while len(left):
            r = min(r, halo)
            a, b = np.searchsorted(x, (lo[0] - r, np.nextafter(hi[0] + r, np.inf)))
            v, w = y[a:b], z[a:b]
            near = a + np.flatnonzero((v >= lo[1] - r) & (v <= hi[1] + r) & (w >= lo[2] - r) & (w <= hi[2] + r))
            if len(near) >= k or r >= halo:
                d = np.zeros((len(left), len(near)))
                for axis, values in enumerate((x, y, z)):
                    step = own[left, axis][:, None] - values[near]
                    step *= step
                    d += step
                ranked = _first(d, pid[near], k)
                best = np.take_along_axis(d, ranked, axis=1)
                done = np.ones(len(left), bool) if r >= halo else best[:, -1] <= r * r
                rows = leaf[left[done]]
                m = best.shape[1]
                d2[rows, :m], index[rows, :m] = best[done], kept[near][ranked[done]]
                left = left[~done]
            r *= 2
    return index, d2


def _first(d: np.ndarray, pid: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest of every row, by value and then by pid."""
    if d.shape[1] <= k:
        return np.lexsort((np.broadcast_to(pid, d.shape), d), axis=1)
    some = np.argpartition(d, k - 1, axis=1)[:, :k]
    values = np.take_along_axis(d, some, axis=1)
    kth = values.max(axis=1)
    ranked = np.take_along_axis(some, np.lexsort((pid[some], values), axis=1), axis=1)
    tied = np.flatnonzero((d <= kth[:, None]).sum(axis=1) > k)
    if len(tied):  # all that tie with the k-th are looked at, so that the pid decides
        own = np.where(d[tied] <= kth[tied, None], d[tied], np.inf)
        ranked[tied] = np.lexsort((np.broadcast_to(pid, own.shape), own), axis=1)[:, :k]
    return ranked


def _tiles(points: DataFrame, k: int) -> tuple[float, float, float, int, int]:
    """(side of a tile, halo, widest extent, points of a tile, of all) for points of even density; tiles of dense spots are split later."""
    box = points.agg(F.count(F.lit(1)), *[f(a) for a in "XYZ" for f in (F.min, F.max)]).first()
    if not box[0]:
        return 1.0, 1.0, 0.0, TILE_POINTS, 0
    per = min(TILE_POINTS, max(2_000, box[0] // 64))
    sides = [max(box[hi] - box[lo], 1e-3) for lo, hi in ((1, 2), (3, 4), (5, 6))]
    volume = sides[0] * sides[1] * sides[2]
    # twice the radius of a sphere that holds k of them
    halo = 2.0 * (volume * (k + 1) / (4.19 * box[0])) ** (1 / 3)
    side = max((sides[0] * sides[1] * per / box[0]) ** 0.5, halo)
    return side, halo, max(sides), per, box[0]


def _shrink(level: int) -> float:
    """A split tile's halo follows the distance of points in space, not on the ground."""
    return 2.0 ** (-2.0 * level / 3.0) * (1 - 1e-12)


def _by_tile(rows: DataFrame, levels: DataFrame | None, side: float, halo: float) -> DataFrame:
    """Rows once for every (split) tile that they lie within the tile's halo of: __i, __j, __l, __core.

    Without ``levels`` no tile is split.  A tile of level l has a side of 2**-l of the plain one and a halo of 2**(-2 l / 3).
    """
    from ..functions.lattice import around

    wide = rows.withColumns({"__ti": column_of(F.col("X"), side), "__tj": column_of(F.col("Y"), side)}).withColumn("__d", F.explode(around(1, "i", "j")))
    wide = wide.withColumns({"__bi": F.col("__ti") + F.col("__d.i"), "__bj": F.col("__tj") + F.col("__d.j")})
    b = F.lit(float(halo))
    reach = lambda c, t: (F.col(c) >= F.col(t) * side - b) & (F.col(c) <= (F.col(t) + 1) * side + b)
    wide = wide.where(reach("X", "__bi") & reach("Y", "__bj"))
    if levels is None:
        core = (F.col("__bi") == F.col("__ti")) & (F.col("__bj") == F.col("__tj"))
        return wide.select(*rows.columns, F.col("__bi").alias("__i"), F.col("__bj").alias("__j"), F.lit(0).alias("__l"), core.alias("__core"))
    wide = wide.join(levels, ["__bi", "__bj"], "left").withColumn("__l", F.coalesce("__l", F.lit(0)))
    scale = F.pow(F.lit(2.0), F.col("__l"))
    small, narrow = F.lit(float(side)) / scale, b * F.pow(F.lit(2.0), F.col("__l") * F.lit(-2.0 / 3.0))
    for c, t, n in (("X", "__bi", "__i"), ("Y", "__bj", "__j")):
        first, last = (F.col(t) * scale).cast("bigint"), ((F.col(t) + 1) * scale - 1).cast("bigint")
        within = lambda x, a=first, z=last: F.greatest(a, F.least(z, F.floor(x / small)))
        wide = wide.withColumn(n, F.explode(F.sequence(within(F.col(c) - narrow), within(F.col(c) + narrow))))
    own = lambda c, t, n: F.greatest((F.col(t) * scale).cast("bigint"), F.least(((F.col(t) + 1) * scale - 1).cast("bigint"), F.floor(F.col(c) / small))) == F.col(n)
    core = (F.col("__bi") == F.col("__ti")) & (F.col("__bj") == F.col("__tj")) & own("X", "__bi", "__i") & own("Y", "__bj", "__j")
    return wide.withColumn("__core", core).select(*rows.columns, "__i", "__j", "__l", "__core")


def nearest_reduced(seeds: DataFrame, points: DataFrame, k: int, reduce: Callable, schema: str, keep: list[str] = (), carry: list[str] = ()) -> DataFrame:
    """``reduce`` of the ``k`` nearest points of every seed, as rows of ``schema``.

    ``reduce(pid, near, d2, columns)`` gets the seeds' pids, positions in ``columns`` of
    their neighbours (pid, X, Y, Z and ``keep`` as arrays) with -1 where there are fewer
    than k, and squared distances; it returns columns by name.  Where that is one row a seed,
    the seeds' columns ``carry`` can stand beside them.  Tiles that hold more than
    TILE_POINTS are split to their density.  Where seeds and points are one table, its rows
    are shuffled once.  The few seeds whose k-th neighbour may lie beyond their tile's halo
    are sent to the cells around them, wider ones each round.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    columns = list(dict.fromkeys(["pid", "X", "Y", "Z", *keep]))
    carry = [c for c in carry if c != "pid"]
    same = seeds is points
    side, halo, widest, per, n = _tiles(points, k)
    wanted = min(k, n)
    counts = points.groupBy(column_of(F.col("X"), side).alias("__bi"), column_of(F.col("Y"), side).alias("__bj")).agg(F.count(F.lit(1)).alias("n"))
    level = F.least(F.ceil(F.log(F.col("n") / per) / F.log(F.lit(4.0))), F.lit(MAX_LEVEL)).cast("int")
    # a tile of even density holds a few more or less than it should
    levels = write_once(counts.where(F.col("n") > 1.25 * per).select("__bi", "__bj", level.alias("__l")))
    split = levels.count()
    known = None if not split else F.broadcast(levels) if split <= BROADCAST_TILES else levels
    place = ["__i", "__j", "__l", "__seed"]
    kinds = {f.name: f.dataType for f in seeds.schema}
    kept = [F.col(f"`{c}`").alias(f"__own{i}") for i, c in enumerate(carry)]
    owned = [f"__own{i}" for i in range(len(carry))]
    if same:
        wide = _by_tile(points.select(*columns, *kept), known, side, halo).withColumn("__seed", F.col("__core"))
        wide = wide.select(*columns, *[F.when(F.col("__core"), F.col(c)).alias(c) for c in owned], *place)
    else:
        points = points.select(*columns)
        pad = {c: F.lit(None).cast(points.schema[c].dataType) for c in columns if c not in ("pid", "X", "Y", "Z")}
        asked = _by_tile(seeds.select("pid", "X", "Y", "Z", *kept), known, side, 0.0).where("__core").withColumns(pad | {"__seed": F.lit(True)})
        given = _by_tile(points, known, side, halo).withColumns({c: F.lit(None).cast(kinds[n]) for c, n in zip(owned, carry)} | {"__seed": F.lit(False)})
        wide = asked.select(*columns, *owned, *place).unionByName(given.select(*columns, *owned, *place))
    out_type = StructType.fromDDL(schema)
    full = StructType(list(out_type.fields))
    for c, n in zip(owned, carry):
        full = full.add(c, kinds[n])
    for c in ("__sx", "__sy", "__sz"):  # where open seeds are
        full = full.add(c, "double")
    full = full.add("__open", "boolean")
    target = to_arrow_schema(full)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        narrow = halo * _shrink(key[2].as_py())
        is_seed = L.numbers(table, "__seed").astype(bool)
        if not is_seed.any():
            return target.empty_table()
        own = table.filter(pa.array(is_seed))
        rest = table if same else table.filter(pa.array(~is_seed))
        held = {c: L.numbers(rest, c) for c in columns}
        places = lambda t: np.column_stack([L.numbers(t, c) for c in "XYZ"]).astype(float)
        at, pid = places(own), L.numbers(own, "pid")
        near, d2 = nearest_in_tile(at, places(rest), held["pid"], k, narrow)
        proven = d2[:, wanted - 1] <= narrow * narrow
        result = reduce(pid[proven], near[proven], d2[proven], held)
        size = len(result["pid"])
        done = {f.name: pa.array(result[f.name], target.field(f.name).type, from_pandas=True) for f in out_type.fields}
        done |= {c: own.column(c).filter(pa.array(proven)) for c in owned}
        parts = [pa.table([done[f.name] if f.name in done else pa.array([False] * size) if f.name == "__open" else pa.nulls(size, f.type) for f in target], schema=target)]
        if not proven.all():
            left = own.filter(pa.array(~proven))
            size = left.num_rows
            open_ = {"pid": left.column("pid"), "__open": pa.array([True] * size)} | {c: left.column(c) for c in owned}
            open_ |= {s: pa.array(at[~proven, axis]) for axis, s in enumerate(("__sx", "__sy", "__sz"))}
            parts.append(pa.table([open_[f.name] if f.name in open_ else pa.nulls(size, f.type) for f in target], schema=target))
        return pa.concat_tables(parts)

    found = write_once(wide.groupBy("__i", "__j", "__l").applyInArrow(run, full))
    own_names = [F.col(c).alias(n) for c, n in zip(owned, carry)]
    done = found.where("not __open").select(*out_type.names, *own_names)
    left = found.where("__open").select("pid", F.col("__sx").alias("X"), F.col("__sy").alias("Y"), F.col("__sz").alias("Z"), *owned)
    if not left.take(1):
        return done

    def one(key, rows):
        rows = rows.sort_values(["d2", "pid2"], kind="stable")
        held = {c: rows[f"{c}2"].to_numpy() for c in columns}
        near, d2 = np.full((1, k), -1, np.int64), np.full((1, k), np.inf)
        near[0, : len(rows)], d2[0, : len(rows)] = np.arange(len(rows)), rows["d2"].to_numpy()
        return pd.DataFrame(reduce(np.array([key[0]]), near, d2, held))

    left = write_once(left)
    beside = left.select("pid", *own_names)
    left = left.select("pid", "X", "Y", "Z")
    points = write_once(points.select(*columns))
    window = Window.partitionBy("pid").orderBy("d2", "pid2")
    h = halo
    while True:
        # every pair within h is found, so k of them within h are the nearest k
        last = h > 2 * widest
        axes = _cell_names(3)
        other = with_cells(points, h, 3).select(*axes, *[F.col(c).alias(f"{c}2") for c in columns])
        pairs = _spread(with_cells(left, h, 3), 3).join(other, axes).withColumn("d2", squared_distance(3)).where(F.col("d2") <= h * h)
        pairs = write_once(pairs.select("pid", "d2", *[f"{c}2" for c in columns]).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k))
        reached = pairs.where(F.col("rank") == wanted).select("pid")
        part = pairs if last else pairs.join(reached, "pid", "left_semi")
        more = part.drop("rank").groupBy("pid").applyInPandas(one, schema)
        done = done.unionByName(more.join(beside, "pid") if carry else more)
        if last:
            return done
        left = write_once(left.join(reached, "pid", "left_anti"))
        if not left.take(1):
            return done
        h *= 2


def nearest_neighbours(seeds: DataFrame, points: DataFrame, k: int, radius: float | None = None, keep: list[str] = (), places: bool = True) -> DataFrame:
    """The ``k`` nearest points of every seed (itself included where it is one of them), ties by pid.

    Rows: pid, rank, pid2, X2, Y2, Z2 (unless without ``places``), d2 and ``keep`` suffixed with
    2.  Within ``radius`` if given, by a radius join that also carries the seeds' columns.
    """
    if radius is not None:
        window = Window.partitionBy("pid").orderBy("d2", "pid2")
        pairs = radius_pairs(seeds, points, radius, 3, keep)
        return pairs.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    types = {f.name: f.dataType.simpleString() for f in points.schema}
    given = [*("XYZ" if places else ""), *keep]
    schema = ", ".join(["pid bigint", "rank int", "pid2 bigint", *[f"{c}2 {types[c]}" for c in given], "d2 double"])

    def pairs_of(pid, near, d2, held):
        row, rank = np.nonzero(near >= 0)
        at = near[row, rank]
        out = {"pid": pid[row], "rank": rank + 1, "pid2": held["pid"][at]}
        return out | {f"{c}2": held[c][at] for c in given} | {"d2": d2[row, rank]}

    return nearest_reduced(seeds, points, k, pairs_of, schema, keep)


def classify(df: DataFrame, flagged: Column, classification: int) -> DataFrame:
    column = find(df, "Classification")
    return df.withColumn(column, F.when(flagged, F.lit(classification).cast(df.schema[column].dataType)).otherwise(F.col(column)))


def classify_with_sor(df: DataFrame, k: int = 8, m: float = 6, classification: int = 18, scope: list[str] = ()) -> DataFrame:
    """Statistical outliers: mean distance to ``k`` neighbours over mean + m sd, of all points or of each scope."""

    def mean_distance(pid, near, d2, held):
        # the point itself, or one at its very place, is the first
        d = np.where(np.isfinite(d2[:, 1:]), d2[:, 1:], np.nan)
        n = np.isfinite(d).sum(axis=1)
        return {"pid": pid, "__mean": np.where(n > 0, np.nansum(np.sqrt(d), axis=1) / np.maximum(n, 1), np.nan)}

    # written by the search, with the points' columns
    mean = nearest_reduced(df, df, k + 1, mean_distance, "pid bigint, __mean double", carry=df.columns)
    with_mean = mean.withColumn("__mean", F.when(~F.isnan("__mean"), F.col("__mean")))
    stats = with_mean.groupBy(*scope).agg((F.avg("__mean") + F.lit(float(m)) * F.stddev_samp("__mean")).alias("__limit"))
    if scope:
        limited = with_mean.join(stats, list(scope), "left")
    else:
        limited = with_mean.withColumn("__limit", F.lit(stats.first()[0]).cast("double"))
    return classify(limited, F.coalesce(F.col("__mean") > F.col("__limit"), F.lit(False)), classification).select(df.columns)


def classify_with_ipf(df: DataFrame, r: float = 1.0, n: int = 1, classification: int = 18) -> DataFrame:
    """Isolated points: at most ``n`` others within ``r``, counted in tiles."""
    side = L.side_of(df, r)
    if side is None:
        return _ipf_by_joins(df, r, n, classification)
    flagged = L.in_tiles(df, side, r, ["X", "Y", "Z"], lambda table, core: pa.array(_isolated(table, core, r, n)), ("__flag", "boolean"))
    return classify(flagged, F.col("__flag"), classification).select(df.columns)


def _isolated(table: pa.Table, core: np.ndarray, r: float, n: int) -> np.ndarray:
    """Which of a tile's own points have at most ``n`` others within ``r``.

    Two points of a cell with side r / sqrt(3) are within r, so crowded cells are cleared first.
    """
    xyz = np.column_stack([L.numbers(table, c) for c in "XYZ"]).astype(float)
    known = np.isfinite(xyz).all(axis=1)
    flag = np.zeros(len(xyz), bool)
    xyz, own = xyz[known], core[known]
    in_cell = lambda h: L.Cells(*np.floor(xyz / h).astype(np.int64).T)
    tight = in_cell(r / 3**0.5 * (1 - 1e-9))
    _, at, crowd = np.unique(tight.keys, return_inverse=True, return_counts=True)
    many = np.zeros(len(xyz), np.int64)
    many[tight.order] = crowd[at]
    seeds = np.flatnonzero(own & (many <= n + 1))
    counts = np.zeros(len(seeds), np.int64)
    cells = in_cell(r * (1 + 1e-9))
    for first, end in cells.runs(seeds):
        for who, place in L.pairs(first, end):
            d2 = 0.0
            for axis in range(3):
                step = xyz[seeds[who], axis] - xyz[cells.order[place], axis]
                d2 = d2 + step * step
            counts += np.bincount(who[d2 <= r * r], minlength=len(seeds))
    flag[np.flatnonzero(known)[seeds[counts <= n + 1]]] = True
    return flag[core]


def _ipf_by_joins(df: DataFrame, r: float, n: int, classification: int) -> DataFrame:
    """Isolated points of a cloud with too full a tile.

    Two points of a cell with side r / sqrt(3) are within r, so crowded cells are cleared
    by one aggregate; only points of the other cells are joined to what is around them.
    """
    cell = r / 3**0.5 * (1 - 1e-9)
    cells = {name: index(F.col(axis), cell) for name, (axis, index) in zip(("__a", "__b", "__c"), _AXES)}
    slim = df.select("pid", "X", "Y", "Z").withColumns(cells)
    sparse = slim.groupBy(*cells).agg(F.count(F.lit(1)).alias("__m")).where(F.col("__m") <= n + 1).drop("__m")
    seeds = slim.join(sparse, list(cells), "left_semi").select("pid", "X", "Y", "Z")
    counts = radius_pairs(seeds, df, r).groupBy("pid").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") <= n + 1)
    return classify(df.join(counts, "pid", "left"), F.col("__n").isNotNull(), classification).select(df.columns)


def classify_with_ivf(df: DataFrame, res: float | tuple[float, float, float] = 5.0, n: int = 6, classification: int = 18, conditions=None) -> DataFrame:
    """Isolated voxels: fewer than ``n`` points in the 26 voxels around a point's own, counted in tiles."""
    keys = ["vx", "vy", "vz"]
    accepted = all_of(df, conditions)
    width = 2.0 * (res if isinstance(res, (int, float)) else max(res[:2])) * (1 + 1e-9)
    side = L.side_of(df, width)
    if side is None:
        return _ivf_by_joins(df, res, n, classification, accepted)
    keyed = voxel(df, res).withColumn("__ok", accepted)
    flagged = L.in_tiles(keyed, side, width, [*keys, "__ok"], lambda table, core: pa.array(_in_sparse_voxels(table, core, n)), ("__flag", "boolean"), [*keys, "__ok"])
    return classify(flagged, F.col("__flag"), classification).select(df.columns)


def _in_sparse_voxels(table: pa.Table, core: np.ndarray, n: int) -> np.ndarray:
    """Which of a tile's own accepted points have fewer than ``n`` in the 26 voxels around theirs."""
    ok = table.column("__ok").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
    axes = [table.column(c) for c in ("vx", "vy", "vz")]
    known = np.all([a.is_valid().to_numpy(zero_copy_only=False) for a in axes], axis=0)
    flag = ok.copy()  # a point without a place has nothing around it
    rows = np.flatnonzero(ok & known)
    cells = L.Cells(*[a.fill_null(0).to_numpy(zero_copy_only=False)[rows] for a in axes])
    sorted_rows = cells.order
    total = -(np.searchsorted(cells.keys, cells.keys, side="right") - np.searchsorted(cells.keys, cells.keys))
    for first, end in cells.runs(sorted_rows):
        total += end - first
    flag[rows[sorted_rows]] = total < n
    return flag[core]


def _ivf_by_joins(df: DataFrame, res: float | tuple[float, float, float], n: int, classification: int, accepted: Column) -> DataFrame:
    """Isolated voxels of a cloud with too full a tile.

    Voxels are counted before their counts are spread, so the shuffle holds voxels, not points.
    """
    from ..functions.lattice import around

    keyed = voxel(df, res)
    keys = ["vx", "vy", "vz"]
    counts = keyed.where(accepted).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    spread = counts.withColumn("__d", F.explode(around(1, *keys))).where("not (__d.vx = 0 and __d.vy = 0 and __d.vz = 0)")
    around_sum = spread.select(*[(F.col(k) + F.col(f"__d.{k}")).alias(k) for k in keys], "__n").groupBy(*keys).agg(F.sum("__n").alias("__n"))
    joined = keyed.join(around_sum, keys, "left")
    return classify(joined, accepted & (F.coalesce("__n", F.lit(0)) < n), classification).select(df.columns)


def local_maximum(df: DataFrame, ws: float, min_height: float = 2.0, use_attribute: str = "Z", conditions=None) -> DataFrame:
    """Points that no point of the open disc of diameter ``ws`` exceeds; of equals the first by pid stays.

    Points at the very same place don't exclude each other when equal.
    """
    accepted = df.where(all_of(df, conditions))
    return _with_maxima(accepted, ws, min_height, use_attribute, None, "__top").where("__top = 1").drop("__top")


def local_maximum_flag(df: DataFrame, ws: float, min_height: float = 2.0, store_in: str = "is_maximum", use_attribute: str = "Z", conditions=None) -> DataFrame:
    """All points, with 1 in a column for local maxima and 0 for the others."""
    return _with_maxima(df, ws, min_height, use_attribute, conditions, store_in)


def _with_maxima(df: DataFrame, ws: float, min_height: float, use_attribute: str, conditions, store_in: str) -> DataFrame:
    half = ws / 2
    side = L.side_of(df, half)
    if side is None:
        found = _maxima_by_joins(df, half, min_height, use_attribute, conditions).select("pid", F.lit(1).alias("__hit"))
        return df.drop(store_in).join(found, "pid", "left").withColumn(store_in, F.coalesce("__hit", F.lit(0))).drop("__hit")
    columns = [c for c in df.columns if c != store_in]
    keyed = df.withColumns({"__v": attribute(df, use_attribute).cast("double"), "__ok": all_of(df, conditions)}).select(*columns, "__v", "__ok")
    return L.in_tiles(keyed, side, half, ["pid", "X", "Y", "__v", "__ok"], lambda table, core: pa.array(_maxima(table, core, half, min_height)), (store_in, "int"), ["__v", "__ok"])


def _maxima(table: pa.Table, core: np.ndarray, half: float, min_height: float) -> np.ndarray:
    """1 for each of a tile's own points that no accepted one nearer than ``half`` exceeds.

    A small cell's own maximum rules out most of its points, and of its equals all but those
    at the place of the first; what is left of a cell is compared as one.
    """
    ok = table.column("__ok").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
    columns = [L.numbers(table, c) for c in ("X", "Y", "__v", "pid")]
    rows = np.flatnonzero(ok & ~np.isnan(columns[0].astype(float) + columns[1] + columns[2]))
    x, y, v, pid = (c[rows] for c in columns)
    hit = np.zeros(table.num_rows, np.int32)
    if not len(rows):
        return hit[core]
    in_cell = lambda h: L.Cells(np.floor(x / h).astype(np.int64), np.floor(y / h).astype(np.int64))
    # any two points of a cell with this side are less than half a window apart
    tight = in_cell(half / 1.5)
    starts = np.flatnonzero(np.r_[True, tight.keys[1:] != tight.keys[:-1]])
    cell = np.empty(len(rows), np.int64)
    cell[tight.order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rows)]))
    highest = np.maximum.reduceat(v[tight.order], starts)
    top = np.flatnonzero(v == highest[cell])
    top = top[np.lexsort((pid[top], cell[top]))]  # one or more a cell, in the order of cells
    first = top[np.flatnonzero(np.r_[True, cell[top[1:]] != cell[top[:-1]]])]
    top = top[(x[top] == x[first[cell[top]]]) & (y[top] == y[first[cell[top]]])]
    asked = first[highest >= min_height]
    higher, rival = np.zeros(len(starts), bool), np.full(len(starts), np.iinfo(np.int64).max)
    cells = in_cell(half * (1 + 1e-9))
    for begin, end in cells.runs(asked):
        for who, place in L.pairs(begin, end):
            p, q = asked[who], cells.order[place]
            near = (v[q] >= v[p]) & ((x[p] - x[q]) * (x[p] - x[q]) + (y[p] - y[q]) * (y[p] - y[q]) < half * half)
            p, q = p[near], q[near]
            above = v[q] > v[p]
            higher[cell[p[above]]] = True
            equal = ~above & ((x[p] != x[q]) | (y[p] != y[q]))
            np.minimum.at(rival, cell[p[equal]], pid[q[equal]])
    stays = core[rows[top]] & (v[top] >= min_height) & ~higher[cell[top]] & (rival[cell[top]] > pid[top])
    hit[rows[top[stays]]] = 1
    return hit[core]


def _maxima_by_joins(df: DataFrame, half: float, min_height: float, use_attribute: str, conditions) -> DataFrame:
    """The maxima's pids in a cloud with too full a tile.

    A cell's own maximum already rules out most points, so only the rest is joined to its surroundings.
    """
    points = df.where(all_of(df, conditions)).withColumn("__v", attribute(df, use_attribute))
    side = half / 1.5
    seeds = points.where(F.col("__v") >= min_height).select("pid", "X", "Y", "__v")
    per_cell = points.groupBy(column_of(F.col("X"), side).alias("__i"), row_of(F.col("Y"), side).alias("__j")).agg(F.max("__v").alias("__top"))
    seeds = seeds.withColumns({"__i": column_of(F.col("X"), side), "__j": row_of(F.col("Y"), side)}).join(per_cell, ["__i", "__j"]).where("__v = __top").drop("__i", "__j", "__top")
    pairs = radius_pairs(seeds, points, half, 2, ["__v"]).where(f"d2 < {half * half!r}")
    beaten = pairs.where("__v2 > __v or (__v2 = __v and pid2 < pid and (X2 <> X or Y2 <> Y))").select("pid").distinct()
    return seeds.select("pid").join(beaten, "pid", "left_anti")


def local_maximum_raster(raster: DataFrame, band: str, ws: float, min_height: float = 2.0) -> DataFrame:
    """Local maxima of a raster's cell centres, with heights to the millimetre: (fid, x, y, z)."""
    z = F.round(F.col(band) * 1000) / 1000
    cells = raster.where(F.col(band).isNotNull()).select(
        (F.col("row") * F.lit(1 << 32) + F.pmod(F.col("col"), F.lit(1 << 32))).alias("pid"), F.col("x").alias("X"), F.col("y").alias("Y"), z.alias("Z")
    )
    return local_maximum(cells, ws, min_height).select(F.col("pid").alias("fid"), F.col("X").alias("x"), F.col("Y").alias("y"), F.col("Z").alias("z"))


def neighborhood_metrics(seeds: DataFrame, points: DataFrame, metrics: list[str], k: int = 10, r: float = 0.0) -> DataFrame:
    """Metrics of the points around every seed: within ``r``, the ``k`` nearest, or both; (pid, x, y, z, metrics)."""
    from ..functions.metrics import parse

    names = {find(points, parse(m).attribute.strip("|")) for m in metrics} - {None, "X", "Y", "Z"}
    keep = sorted(names)
    slim = write_once(seeds.select("pid", "X", "Y", "Z"))
    if r > 0 and not k:
        near = radius_pairs(slim, points, r, 3, keep, few=True)
    else:
        near = nearest_neighbours(slim, points, k, radius=r if r > 0 else None, keep=keep)
    values = near.select(F.col("pid").alias("__s"), *[F.col(f"{a}2").alias(a) for a in ["X", "Y", "Z", *keep]])
    out = values.groupBy("__s").agg(*aggregates(values, metrics))
    return slim.join(out, slim["pid"] == out["__s"]).select("pid", F.col("X").alias("x"), F.col("Y").alias("y"), F.col("Z").alias("z"), *metrics)

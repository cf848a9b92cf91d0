"""Sampling per cell, per voxel, and by minimum distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import find
from ..functions.lattice import column_of, row_of, voxel, with_cell
from ..functions.predicates import all_of
from .raster import best_per_cell
from .tiles import Cells, in_tiles, numbers, pairs, side_of

_MULTIPLIER, _MODULUS = 2654435761, 4294967296


def priority(pid: Column, seed: int = 0) -> Column:
    """A pseudo-random order that only depends on the point's id: id times the multiplier, modulo 2**32.

    The product of two such numbers has up to 64 bits, so it is made of the halves of one.
    """
    modulus, multiplier = F.lit(_MODULUS).cast("bigint"), F.lit(_MULTIPLIER).cast("bigint")
    low = F.pmod(F.pmod(pid, modulus) + F.lit(seed % _MODULUS).cast("bigint"), modulus)
    high = F.pmod(F.shiftright(low, 16) * multiplier, F.lit(1 << 16)) * F.lit(1 << 16)
    return F.pmod(high + low.bitwiseAND(F.lit(0xFFFF).cast("bigint")) * multiplier, modulus)


def _one_of_each(df: DataFrame, keys: list[str], seed: int, columns: list[str]) -> DataFrame:
    order = F.struct(priority(F.col("pid"), seed).alias("k"), F.col("pid"))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("p")).select("p.*")


def sampling_pixel(df: DataFrame, res: float, method: str = "random", use_attribute: str = "Z", conditions=None, seed: int = 0) -> DataFrame:
    """One point of every cell: at random, or the extreme of an attribute.  Points that fail the filter stay."""
    accepted = all_of(df, conditions)
    chosen = df.where(accepted)
    if method == "random":
        picked = _one_of_each(with_cell(chosen, res), ["col", "row"], seed, df.columns)
    else:
        picked = best_per_cell(chosen, res, method, find(df, use_attribute) or use_attribute)
    return picked if conditions is None else picked.unionByName(df.where(~accepted))


def sampling_voxel(df: DataFrame, res: float, conditions=None, seed: int = 0) -> DataFrame:
    """One random point of every voxel.  Points that fail the filter stay."""
    accepted = all_of(df, conditions)
    picked = _one_of_each(voxel(df.where(accepted), res), ["vx", "vy", "vz"], seed, df.columns)
    return picked if conditions is None else picked.unionByName(df.where(~accepted))


def _settled(table: pa.Table, core: np.ndarray, ends: tuple[float, float, float, float], d: float) -> np.ndarray:
    """0 for each of a tile's own points that is not taken, 1 taken, 2 where that hangs on points not seen.

    Points go by their order in batches, each as large as all before.  A point near one that is
    taken is not taken; of the others those without an earlier undecided one are taken, until
    nothing changes.  What lies nearer than ``d`` to the end of what is seen, and what waits for
    it, stays open.
    """
    x, y, z = (numbers(table, c).astype(float) for c in "XYZ")
    order = np.lexsort((numbers(table, "pid"), numbers(table, "__p")))
    seen_to_the_end = (x - d > ends[0]) & (x + d < ends[1]) & (y - d > ends[2]) & (y + d < ends[3])
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    axes = [np.floor(v / (d * (1 + 1e-9))).astype(np.int64) for v in (x, y, z)]
    state = np.full(len(x), 2, np.int8)
    known = np.zeros(0, np.int64)  # taken or open so far

    def near(rows, others):
        """Pairs of rows and others less than d apart."""
        if not len(rows) or not len(others):
            return
        both = np.r_[rows, others]
        cells = Cells(*(a[both] for a in axes))
        for first, end in cells.runs(np.arange(len(rows))):
            for who, at in pairs(first, end):
                q = cells.order[at]
                who, q = who[q >= len(rows)], both[q[q >= len(rows)]]
                p = rows[who]
                ok = (x[p] - x[q]) * (x[p] - x[q]) + (y[p] - y[q]) * (y[p] - y[q]) + (z[p] - z[q]) * (z[p] - z[q]) < d * d
                yield p[ok], q[ok]

    lo = 0
    while lo < len(order):
        batch = order[lo : max(2 * lo, 1024)]
        lo = max(2 * lo, 1024)
        blocked = np.zeros(len(x), bool)
        for p, q in near(batch, known):
            state[p[state[q] == 1]] = 0
            blocked[p[state[q] == 2]] = True
        batch = batch[state[batch] == 2]
        free = batch[seen_to_the_end[batch] & ~blocked[batch]]
        waits = [(p[e], q[e]) for p, q in near(free, batch) for e in [place[q] < place[p]]]
        p, q = (np.concatenate(v) if waits else np.zeros(0, np.int64) for v in (zip(*waits) if waits else ((), ())))
        while True:
            held = np.zeros(len(x), bool)
            held[p[state[q] != 0]] = True
            now = free[(state[free] == 2) & ~held[free]]
            if not len(now):
                break
            state[now] = 1
            state[p[(state[q] == 1) & (state[p] == 2)]] = 0
            left = (state[p] == 2) & (state[q] != 0)
            p, q = p[left], q[left]
        known = np.r_[known, batch[state[batch] != 0]]
    return state[core].astype(np.int32)


def sampling_poisson(df: DataFrame, distance: float, max_rounds: int = 60, seed: int = 0) -> DataFrame:
    """A maximal set of points no two of which are nearer than ``distance``, in 3-D.

    The points are those that greedy selection in the order of a hash of their ids takes.
    Tiles with a halo settle nearly all; the few that hang on points beyond a halo are
    settled in rounds of joins.  Every round takes the points that come first among their
    undecided neighbours, and drops the neighbours of what was taken.
    """
    from .neighbours import radius_pairs, write_once

    h = float(distance)
    halo = 4 * h
    side = side_of(df, halo)
    keyed = df.withColumn("__p", priority(F.col("pid"), seed))
    if side is None:
        slim = write_once(keyed.select("pid", "__p", "X", "Y", "Z"))
        taken, open_points = None, slim
    else:

        def settle(key, table, core):
            i, j = key[0].as_py() * side, key[1].as_py() * side
            return pa.array(_settled(table, core, (i - halo, i + side + halo, j - halo, j + side + halo), h))

        found = write_once(in_tiles(keyed, side, halo, ["pid", "__p", "X", "Y", "Z"], settle, ("__s", "int"), keyed=True).where("__s > 0"))
        taken = found.where("__s = 1").drop("__s")
        open_points = found.where("__s = 2").drop("__s")
        # points of another tile may be settled that this one had not seen
        covered = radius_pairs(open_points.select("pid", "__p", "X", "Y", "Z"), taken, h, 3, ["__p"], few=True).where(f"d2 < {h * h!r}").select("pid").distinct()
        open_points = write_once(open_points.join(covered, "pid", "left_anti"))
    columns = [F.col(f"`{c}`") for c in df.columns]
    for _ in range(max_rounds):
        if not open_points.take(1):
            break
        slim = open_points.select("pid", "__p", "X", "Y", "Z")
        earlier = radius_pairs(slim, slim, h, 3, ["__p"]).where(f"d2 < {h * h!r} and (__p2 < __p or (__p2 = __p and pid2 < pid))")
        first = write_once(open_points.join(earlier.select("pid").distinct(), "pid", "left_anti"))
        taken = first if taken is None else taken.unionByName(first)
        covered = radius_pairs(slim, first, h).where(f"d2 < {h * h!r}").select("pid").distinct()
        open_points = write_once(open_points.join(covered, "pid", "left_anti"))
    else:
        if open_points.take(1):
            raise RuntimeError(f"sampling did not settle in {max_rounds} rounds")
    if side is None:
        return df.join(taken.select("pid"), "pid", "left_semi") if taken is not None else df.limit(0)
    return taken.select(*columns)

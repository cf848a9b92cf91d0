"""Tiles with a halo as Arrow tables: one shuffle brings every point to all that it may matter for.

Points go to the tile they lie in with all their columns, and to the tiles they lie near
with the few that a neighbour needs.  Within a tile rows are sorted by cell, so that
what lies around a row is a few runs of the sorted rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lattice import around, column_of

#: Points that a tile should hold.
TILE_POINTS = 32_000
#: A tile with more is too much for one task: operators go by joins on cells then.
MOST_POINTS = 3_000_000


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column without nulls as an array; nulls of doubles are nan."""
    return table.column(name).to_numpy(zero_copy_only=False)


def side_of(points: DataFrame, halo: float) -> float | None:
    """The side of tiles for points of even density, no narrower than four halos; None where a tile would be too full."""
    n, x0, x1, y0, y1 = points.agg(F.count(F.lit(1)), F.min("X"), F.max("X"), F.min("Y"), F.max("Y")).first()
    if not n or x0 is None or y0 is None:
        return 4 * halo
    per = min(TILE_POINTS, max(2_000, n // 64))
    wide, high = max(x1 - x0, 1e-3), max(y1 - y0, 1e-3)
    side = (wide * high * per / n) ** 0.5
    side = max(side if side < min(wide, high) else max(wide, high) * per / n, 4 * halo)
    tiles = (column_of(F.col("X"), side).alias("i"), column_of(F.col("Y"), side).alias("j"))
    most = points.groupBy(*tiles).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if most > 4 * TILE_POINTS and side > 4 * halo:  # uneven: as narrow as the fullest needs
        side = max(side * (TILE_POINTS / most) ** 0.5, 4 * halo)
        tiles = (column_of(F.col("X"), side).alias("i"), column_of(F.col("Y"), side).alias("j"))
        most = points.groupBy(*tiles).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return side if most <= MOST_POINTS else None


def spread(df: DataFrame, side: float, halo: float, shared: list[str]) -> DataFrame:
    """Rows once for every tile (__i, __j) that they lie within ``halo`` of; ``__core`` in their own.

    Elsewhere all columns but the ``shared`` ones are null.  Rows without a place have one tile.
    """
    home = {"__ti": F.coalesce(column_of(F.col("X"), side), F.lit(0)), "__tj": F.coalesce(column_of(F.col("Y"), side), F.lit(0))}
    b, size = F.lit(float(halo)), F.lit(float(side))

    def reach(c: str, t: str, d: str) -> Column:
        low, high = (F.col(d) < 0) & (F.col(c) - F.col(t) * size <= b), (F.col(d) > 0) & ((F.col(t) + 1) * size - F.col(c) <= b)
        return (F.col(d) == 0) | low | high

    core = (F.col("__d.i") == 0) & (F.col("__d.j") == 0)
    wide = df.withColumns(home).withColumn("__d", F.explode(around(1, "i", "j")))
    wide = wide.where(core | (reach("X", "__ti", "__d.i") & reach("Y", "__tj", "__d.j")))
    kept = [F.col(f"`{c}`") if c in shared else F.when(core, F.col(f"`{c}`")).alias(c) for c in df.columns]
    return wide.select(*kept, (F.col("__ti") + F.col("__d.i")).alias("__i"), (F.col("__tj") + F.col("__d.j")).alias("__j"), core.alias("__core"))


def in_tiles(df: DataFrame, side: float, halo: float, shared: list[str], function: Callable[..., pa.Array], out: tuple[str, str], drop: list[str] = (), keyed: bool = False) -> DataFrame:
    """``df`` with a column ``out`` (name and type): ``function(table, core)`` gives the values of a tile's own rows, in their order.

    The table holds the tile's rows and those within ``halo`` of it.  Columns in ``drop`` are only
    there for the function.  With ``keyed`` it gets the tile's numbers first.
    """
    columns = [c for c in df.columns if c not in drop]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], f"`{out[0]}` {out[1]}"])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        core = numbers(table, "__core").astype(bool)
        values = function(key, table, core) if keyed else function(table, core)
        return table.filter(pa.array(core)).select(columns).append_column(out[0], values)

    return spread(df, side, halo, shared).groupBy("__i", "__j").applyInArrow(run, schema)


def _spaced(a: np.ndarray) -> tuple[np.ndarray, int]:
    """Whole numbers by rank from 1, where neighbours stay neighbours and gaps are one wide; and the ranks' bound."""
    u, at = np.unique(a, return_inverse=True)
    gaps = np.where(u[1:] - u[:-1] == 1, 1, 2)
    rank = np.r_[1, 1 + np.cumsum(gaps)]
    return rank[at.ravel()].astype(np.int64), int(rank[-1]) + 2


class Cells:
    """Rows by cell: ``order`` sorts them so that cells above each other are one run."""

    def __init__(self, *axes: np.ndarray):
        spaced = [_spaced(a) for a in axes]
        column, self.widths = spaced[0][0], [w for _, w in spaced[1:-1]]
        for rank, width in spaced[1:-1]:
            column = column * width + rank
        self.columns, at = np.unique(column, return_inverse=True)
        self.rank, self.width = spaced[-1]
        self.column, self.at = column, at.ravel()
        key = self.at * self.width + self.rank
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def runs(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each column of cells around, where in ``order`` the rows at and around each row's height begin and end."""
        shifts = (-1, 0, 1)
        steps = [i * self.widths[0] + j for i in shifts for j in shifts] if self.widths else shifts
        column, rank = self.column[rows], self.rank[rows]
        for step in steps:
            at = np.searchsorted(self.columns, column + step)
            near = np.minimum(at, len(self.columns) - 1)
            there = self.columns[near] == column + step
            first = np.searchsorted(self.keys, near * self.width + rank - 1)
            end = np.searchsorted(self.keys, near * self.width + rank + 1, side="right")
            yield first, np.where(there, end, first)


def pairs(first: np.ndarray, end: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the run, place) for all places of all runs, about ``most`` at once."""
    n = end - first
    total = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most)))
        r = n[lo:hi]
        if total[hi - 1] > (total[lo - 1] if lo else 0):
            yield np.repeat(np.arange(lo, hi), r), np.arange(r.sum()) + np.repeat(first[lo:hi] - (np.cumsum(r) - r), r)
        lo = hi

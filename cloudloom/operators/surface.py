"""Canopy surfaces: spike-free triangulation, pit filling and tree segmentation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lattice import with_centre
from ..functions.predicates import all_of
from .raster import offsets_within
from .spatial import with_halo
from .tin import TRIANGLE, Triangulation, rasterize_triangulation, tile_triangles


def spike_free_triangles(x: np.ndarray, y: np.ndarray, z: np.ndarray, freeze: float, buffer: float) -> np.ndarray:
    """Triangles of points inserted from the top; a small triangle is frozen against points well below it."""
    if len(x) < 3:
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((y, x, -z))
    _, first = np.unique(np.column_stack([x, y])[order], axis=0, return_index=True)
    order = order[np.sort(first)]
    t = Triangulation(x[order], y[order])
    z = [0.0, 0.0, 0.0, *z[order].tolist()]  # as the corners are numbered
    limit = freeze * freeze
    for p in range(3, len(order) + 3):
        at = t.locate(p)
        tri = t.tri[at]
        if min(tri) >= 3:
            sides = [(t.x[a] - t.x[b]) ** 2 + (t.y[a] - t.y[b]) ** 2 for a, b in ((tri[0], tri[1]), (tri[1], tri[2]), (tri[2], tri[0]))]
            if max(sides) < limit and z[p] < min(z[c] for c in tri) - buffer:
                continue
        t.insert(p, at)
    return order[t.triangles()]


def spikefree(df: DataFrame, res: float = 0.5, freeze_distance: float = 0.5, height_buffer: float = 0.5, conditions=None, tile: float = 20.0, halo: float = 2.0) -> DataFrame:
    """Raster of the spike-free surface of the accepted points."""
    points = df.where(all_of(df, conditions)).select("X", "Y", "Z")

    def run(key, own):
        x, y, z = (own[c].to_numpy() for c in "XYZ")
        return tile_triangles(own, key, tile, spike_free_triangles(x, y, z, freeze_distance, height_buffer))

    triangles = with_halo(points, tile, halo).groupBy("tile_x", "tile_y").applyInPandas(run, TRIANGLE)
    return rasterize_triangulation(triangles, res)


def _around(raster: DataFrame, band: str, size: int, centre_too: bool) -> DataFrame:
    """(col, row, v): the values in a square of ``size`` cells around every cell, one row each."""
    half = size // 2
    shifts = [(i, j) for i in range(-half, half + 1) for j in range(-half, half + 1) if centre_too or i or j]
    array = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j")) for i, j in shifts])
    wide = raster.select("col", "row", F.col(band).alias("v"), F.explode(array).alias("d"))
    return wide.select((F.col("col") + F.col("d.i")).alias("col"), (F.col("row") + F.col("d.j")).alias("row"), "v")


def pit_fill(raster: DataFrame, band: str, res: float, lap_size: int = 3, thr_lap: float = 0.1, thr_spk: float = -0.1, med_size: int = 3, dil_radius: int = 0) -> DataFrame:
    """Pits and spikes, by the difference to the mean around them, become the median of the sound cells around."""
    means = _around(raster, band, lap_size, False).groupBy("col", "row").agg(F.avg("v").alias("__m"))
    base = raster.select("col", "row", F.col(band).alias("__v")).join(means, ["col", "row"], "left")
    lap = F.col("__m") - F.col("__v")
    flagged = base.withColumn("__bad", F.coalesce((lap > thr_lap) | (lap < thr_spk), F.lit(False)))
    if dil_radius:
        shifts = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j")) for i, j in offsets_within(2 * dil_radius, 1.0)])
        grown = flagged.where("__bad").withColumn("d", F.explode(shifts)).select((F.col("col") + F.col("d.i")).alias("col"), (F.col("row") + F.col("d.j")).alias("row"), F.lit(True).alias("__g")).distinct()
        flagged = flagged.join(grown, ["col", "row"], "left").withColumn("__bad", F.coalesce("__g", F.lit(False))).drop("__g")
    sound = flagged.where(~F.col("__bad")).withColumnRenamed("__v", "__s")
    medians = _around(sound, "__s", max(med_size, 3), False).groupBy("col", "row").agg(F.percentile("v", F.lit(0.5)).alias("__f"))
    out = flagged.join(medians, ["col", "row"], "left")
    value = F.when(F.col("__bad"), F.coalesce("__f", "__v")).otherwise(F.col("__v"))
    return with_centre(out.withColumn(band, value), res).select("col", "row", "x", "y", band)


def grow_regions(heights: dict[tuple[int, int], float], seeds: list[tuple], res: float, th_tree: float, th_seed: float, th_cr: float, max_cr: float) -> dict[tuple[int, int], int]:
    """Cell -> seed id, from seeds (id, col, row, x, y, z).

    Round by round, regions in the order of their seeds' cells (from the top left, row by
    row) take the free neighbours of their cells that are higher than the smaller of
    ``th_seed`` of the seed's height and ``th_cr`` of the crown's mean, higher than
    ``th_tree``, at most 1.05 of the seed's height, and nearer to it than half ``max_cr``.
    As means move, cells refused in one round are tried again in the next, until none grows.
    """
    owner: dict[tuple[int, int], int] = {}
    starts = {(c, r): (fid, x, y, z) for fid, c, r, x, y, z in sorted(seeds) if (c, r) in heights}
    owner |= {cell: start[0] for cell, start in starts.items()}
    border = {cell: [cell] for cell in sorted(starts, key=lambda cell: (-cell[1], cell[0]))}
    sums = {cell: [heights[cell], 1] for cell in starts}
    reach = (max_cr / 2) ** 2
    grown = True
    while grown:
        grown = False
        for seed, cells in border.items():
            fid, x, y, top = starts[seed]
            total = sums[seed]
            still = []
            for c, r in cells:
                least = min(top * th_seed, total[0] / total[1] * th_cr)
                waits = False
                for cell in ((c, r + 1), (c - 1, r), (c + 1, r), (c, r - 1)):
                    v = heights.get(cell)
                    if v is None or cell in owner or v <= th_tree or v > 1.05 * top:
                        continue
                    if ((cell[0] + 0.5) * res - x) ** 2 + ((cell[1] + 0.5) * res - y) ** 2 >= reach:
                        continue
                    if v > least:
                        owner[cell] = fid
                        total[0] += v
                        total[1] += 1
                        still.append(cell)
                        grown = True
                    else:
                        waits = True
                if waits:
                    still.append((c, r))
            border[seed] = still
    return owner


def region_growing(raster: DataFrame, band: str, seeds: DataFrame, res: float, th_tree: float = 2.0, th_seed: float = 0.45, th_cr: float = 0.55, max_cr: float = 20.0, tile: float = 40.0) -> DataFrame:
    """(col, row, x, y, region): tree crowns grown from seeds (fid, x, y, z), per tile with a halo of ``max_cr``."""
    from ..functions.lattice import column_of, row_of

    cells = raster.select("col", "row", F.col("x").alias("X"), F.col("y").alias("Y"), F.col(band).alias("v"), F.lit(None).cast("bigint").alias("fid"))
    tops = seeds.select(column_of(F.col("x"), res).alias("col"), row_of(F.col("y"), res).alias("row"), F.col("x").alias("X"), F.col("y").alias("Y"), F.col("z").alias("v"), "fid")

    def run(own):
        is_seed = own["fid"].notna()
        grid = own[~is_seed & own["v"].notna()]
        heights = dict(zip(zip(grid["col"].tolist(), grid["row"].tolist()), grid["v"].tolist()))
        starts = [(int(f), c, r, x, y, v) for f, c, r, x, y, v in own.loc[is_seed, ["fid", "col", "row", "X", "Y", "v"]].itertuples(index=False)]
        owner = grow_regions(heights, starts, res, th_tree, th_seed, th_cr, max_cr)
        core = grid[~grid["is_buffer"]]
        rows = [(c, r, owner[c, r]) for c, r in zip(core["col"].tolist(), core["row"].tolist()) if (c, r) in owner]
        return pd.DataFrame(rows, columns=["col", "row", "region"])

    out = with_halo(cells.unionByName(tops), tile, min(max_cr, tile)).groupBy("tile_x", "tile_y").applyInPandas(run, "col long, row long, region long")
    return with_centre(out, res).select("col", "row", "x", "y", "region")

"""Spatial queries and tiles: plots, rectangles, chunks and their halos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lattice import around, column_of, covering, row_of
from ..functions.predicates import all_of

#: Plots by cell are broadcast up to so many rows (under 100 bytes each), more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def circles(spark: SparkSession, rows: list[tuple[int, float, float, float]]) -> DataFrame:
    return spark.createDataFrame([(int(q), float(x), float(y), float(r)) for q, x, y, r in rows], "query_id int, xc double, yc double, r double")


def rectangles(spark: SparkSession, rows: list[tuple[int, float, float, float, float]]) -> DataFrame:
    return spark.createDataFrame([(int(q), *map(float, r)) for q, *r in rows], "query_id int, xmin double, ymin double, xmax double, ymax double")


def _matched(points: DataFrame, plots: DataFrame, box: tuple[str, str, str, str], exact: str, cell: float | None) -> DataFrame:
    """Points joined to the plots whose box and exact condition hold them.

    Plots are exploded to the cells they touch, cells as wide as a plot is on average, so
    that a point is tested against the plots of its own cell only.  One box around all
    plots is pushed to the scan.
    """
    xmin, ymin, xmax, ymax = box
    ends = plots.agg(*[F.expr(x) for x in (f"min({xmin})", f"min({ymin})", f"max({xmax})", f"max({ymax})", f"avg(greatest({xmax} - ({xmin}), {ymax} - ({ymin})))")]).first()
    if ends[0] is None:
        return points.limit(0).join(plots, F.lit(False))
    cell = cell or max(ends[4], 1e-6)
    spread = plots.withColumn("__c", F.explode(covering(F.expr(xmin), F.expr(xmax), "x", cell))).withColumn("__r", F.explode(covering(F.expr(ymin), F.expr(ymax), "y", cell)))
    if spread.count() <= BROADCAST_ROWS:
        spread = F.broadcast(spread)
    near = points.where(F.col("X").between(ends[0], ends[2]) & F.col("Y").between(ends[1], ends[3]))
    keyed = near.withColumns({"__c": column_of(F.col("X"), cell), "__r": row_of(F.col("Y"), cell)})
    boxed = f"X between {xmin} and {xmax} and Y between {ymin} and {ymax} and {exact}"
    return keyed.join(spread, ["__c", "__r"]).where(boxed).drop("__c", "__r")


def in_circles(points: DataFrame, plots: DataFrame, conditions=None, cell: float | None = None) -> DataFrame:
    """Points of every closed circle (query_id, xc, yc, r); a point may lie in several."""
    exact = "(X - xc) * (X - xc) + (Y - yc) * (Y - yc) <= r * r"
    return _matched(points.where(all_of(points, conditions)), plots, ("xc - r", "yc - r", "xc + r", "yc + r"), exact, cell)


def in_rectangles(points: DataFrame, plots: DataFrame, conditions=None, cell: float | None = None) -> DataFrame:
    """Points of every closed rectangle (query_id, xmin, ymin, xmax, ymax)."""
    return _matched(points.where(all_of(points, conditions)), plots, ("xmin", "ymin", "xmax", "ymax"), "true", cell)


def with_tile(df: DataFrame, size: float) -> DataFrame:
    """Half-open tiles: every point has one."""
    return df.withColumns({"tile_x": column_of(F.col("X"), size), "tile_y": row_of(F.col("Y"), size)})


def with_halo(df: DataFrame, size: float, buffer: float) -> DataFrame:
    """Points once for each tile that they belong to or lie within ``buffer`` of; ``is_buffer`` tells which."""
    if buffer > size:
        raise ValueError("the buffer is wider than a tile")
    own = with_tile(df, size).withColumn("__d", F.explode(around(1, "i", "j")))
    tx, ty = F.col("tile_x") + F.col("__d.i"), F.col("tile_y") + F.col("__d.j")
    x0, y0 = tx * F.lit(float(size)), ty * F.lit(float(size))
    b = F.lit(float(buffer))
    core = (F.col("__d.i") == 0) & (F.col("__d.j") == 0)
    near = (F.col("X") >= x0 - b) & (F.col("X") <= x0 + size + b) & (F.col("Y") >= y0 - b) & (F.col("Y") <= y0 + size + b)
    return own.where(core | near).select(*df.columns, tx.alias("tile_x"), ty.alias("tile_y"), (~core).alias("is_buffer"))


def halo_counts(df: DataFrame, size: float, buffer: float, noprocess=None) -> DataFrame:
    """Points and buffer points of every tile with points of its own; ``noprocess`` tiles only lend theirs."""
    spread = with_halo(df, size, buffer)
    counts = spread.groupBy("tile_x", "tile_y").agg(F.count_if(~F.col("is_buffer")).alias("npoints"), F.count_if("is_buffer").alias("nbuffer"))
    counts = counts.where("npoints > 0")
    return counts.where(~noprocess) if noprocess is not None else counts

"""Rasters: a row per cell with ``col``, ``row``, the centre ``x``, ``y`` and a column per band."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lattice import covering, with_cell, with_centre
from ..functions.metrics import aggregates
from ..functions.predicates import all_of

NODATA = -9999.0
_FOCAL = {
    "mean": F.avg,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
}


def _cells(df: DataFrame, res: float, window: float | None) -> DataFrame:
    """Points with the cells they count for: their own, or all whose window holds them."""
    if not window or window <= res:
        return with_cell(df, res)
    reach = (window - res) / 2
    wide = df.withColumn("col", F.explode(covering(F.col("X") - reach, F.col("X") + reach, "x", res)))
    return wide.withColumn("row", F.explode(covering(F.col("Y") - reach, F.col("Y") + reach, "y", res)))


def rasterize(
    df: DataFrame,
    res: float,
    metrics: list[str] = ("z_max",),
    conditions: str | list[str] | None = None,
    default_value: float | None = None,
    window: float | None = None,
) -> DataFrame:
    """Metrics of the points of every cell; with ``window`` a cell takes in a wider square.

    Cells without an accepted point are absent, or, with ``default_value``, the cells that
    hold any point get that value; then the filter can't go below the aggregation.
    """
    metrics = list(metrics)
    accepted = all_of(df, conditions)
    if default_value is None:
        cells = _cells(df.where(accepted), res, window)
        out = cells.groupBy("col", "row").agg(*aggregates(df, metrics))
    else:
        cells = _cells(df, res, window)
        out = cells.groupBy("col", "row").agg(*aggregates(df, metrics, accepted, default_value))
    return with_centre(out, res).select("col", "row", "x", "y", *metrics)


def aggregate_expressions(df: DataFrame, res: float, window: float | None = None, conditions=None, **expressions: Column) -> DataFrame:
    """User expressions per cell: each keyword is a band."""
    cells = _cells(df.where(all_of(df, conditions)), res, window)
    out = cells.groupBy("col", "row").agg(*[e.alias(n) for n, e in expressions.items()])
    return with_centre(out, res).select("col", "row", "x", "y", *expressions)


def aggregate_function(df: DataFrame, res: float, function: Callable, bands: list[str], window: float | None = None, conditions=None) -> DataFrame:
    """A Python function per cell: it gets the cell's points as a pandas frame, and returns one number per band."""
    import pandas as pd

    cells = _cells(df.where(all_of(df, conditions)), res, window)

    def run(key, points):
        values = function(points)
        values = list(values.values()) if isinstance(values, dict) else list(values) if hasattr(values, "__len__") else [values]
        if len(values) != len(bands):
            raise ValueError(f"the function returned {len(values)} numbers for {len(bands)} bands")
        return pd.DataFrame([[*key, *map(float, values)]], columns=["col", "row", *bands])

    schema = "col long, row long, " + ", ".join(f"`{b}` double" for b in bands)
    return with_centre(cells.groupBy("col", "row").applyInPandas(run, schema), res).select("col", "row", "x", "y", *bands)


def offsets_within(size: float, res: float) -> list[tuple[int, int]]:
    """Cell offsets whose centres lie in a disc of diameter ``size``, at least the cell itself."""
    radius = max(size / 2, res / 2)
    reach = int(radius / res + 1e-9)
    return [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if (i * i + j * j) * res * res <= radius * radius + 1e-9]


def focal(raster: DataFrame, size: float, res: float, function: str = "mean", bands: list[str] | None = None) -> DataFrame:
    """A statistic over the disc around every cell of the raster's extent, cells without data included.

    Every cell hands its values to the cells around it; absent cells and nulls say nothing.
    """
    bands = bands or [c for c in raster.columns if c not in ("col", "row", "x", "y")]
    shifts = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j")) for i, j in offsets_within(size, res)])
    box = raster.agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1"))
    spread = raster.select("col", "row", *bands).withColumn("d", F.explode(shifts))
    spread = spread.withColumns({"col": F.col("col") + F.col("d.i"), "row": F.col("row") + F.col("d.j")})
    inside = spread.join(F.broadcast(box)).where("col between c0 and c1 and row between r0 and r1")
    out = inside.groupBy("col", "row").agg(*[_FOCAL[function](b).alias(b) for b in bands])
    return with_centre(out, res).select("col", "row", "x", "y", *bands)


def filter_with_grid(df: DataFrame, res: float, operation: str = "min", conditions=None, tie: tuple[str, ...] = ("pid",)) -> DataFrame:
    """One lowest or highest point of every cell among those that meet the conditions."""
    return best_per_cell(df.where(all_of(df, conditions)), res, operation, "Z", tie)


def best_per_cell(df: DataFrame, res: float, operation: str, attribute: str, tie: tuple[str, ...] = ("pid",)) -> DataFrame:
    """The first point of each cell by an attribute, ties by ``tie``.

    An aggregate of the whole row instead of a window: minima are combined before the
    shuffle, so a crowded cell is no hot partition.
    """
    if operation not in ("min", "max"):
        raise ValueError(f"{operation!r} is neither min nor max")
    sign = F.col(attribute).cast("double") if operation == "min" else -F.col(attribute).cast("double")
    order = F.struct(sign.alias("k"), *[F.col(t) for t in tie])
    cells = with_cell(df, res)
    best = cells.groupBy("col", "row").agg(F.min_by(F.struct(*df.columns), order).alias("p"))
    return best.select("p.*")

"""Summaries of a point table: counts, histograms, and metrics per tile or plot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import attribute
from ..functions.metrics import aggregates
from ..functions.predicates import all_of


def _rows(df: DataFrame, section: str, key: Column) -> DataFrame:
    return df.groupBy(key.cast("double").alias("key")).agg(F.count(F.lit(1)).alias("value")).select(F.lit(section).alias("section"), "key", "value")


def summarise(df: DataFrame, zwbin: float = 2.0, iwbin: float = 50.0, conditions=None) -> DataFrame:
    """Long table (section, key, value): counts, points per return and class, histograms by lower edge.

    One aggregation over all sections: every point is exploded to its keys, and counts are
    combined before the shuffle.
    """
    points = df.where(all_of(df, conditions))
    at = lambda name: attribute(df, name)
    entry = lambda section, key, on=F.lit(True): F.when(on, F.struct(F.lit(section).alias("section"), key.cast("double").alias("key")))
    zero = F.lit(0.0)
    entries = F.array(
        entry("npoints", zero),
        entry("nsingle", zero, at("NumberOfReturns") == 1),
        entry("nwithheld", zero, at("Withheld") != 0),
        entry("nsynthetic", zero, at("Synthetic") != 0),
        entry("return", at("ReturnNumber")),
        entry("class", at("Classification")),
        entry("z_histogram", F.floor(at("Z") / zwbin) * F.lit(float(zwbin))),
        entry("i_histogram", F.floor(at("Intensity") / iwbin) * F.lit(float(iwbin))),
    )
    keyed = points.select(F.explode(F.array_compact(entries)).alias("e"))
    return keyed.groupBy("e.section", "e.key").agg(F.count(F.lit(1)).alias("value")).select("section", "key", "value")


def histogram(df: DataFrame, name: str, width: float, dense: bool = False) -> DataFrame:
    """(key, value): points per bin of an attribute, by lower edge; dense has the empty bins too."""
    bins = df.groupBy(F.floor(attribute(df, name) / F.lit(float(width))).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("value"))
    if dense:
        ends = bins.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).where("lo is not null")
        every = ends.select(F.explode(F.sequence("lo", "hi")).alias("bin"))
        bins = every.join(bins, "bin", "left").withColumn("value", F.coalesce("value", F.lit(0).cast("bigint")))
    return bins.select((F.col("bin") * F.lit(float(width))).alias("key"), "value")


def metrics_by(df: DataFrame, keys: list[str], metrics: list[str], conditions=None) -> DataFrame:
    """Metrics per group, of tiles or of plots."""
    points = df.where(all_of(df, conditions))
    return points.groupBy(*keys).agg(*aggregates(df, metrics))


def bounding_boxes(df: DataFrame, keys: list[str]) -> DataFrame:
    """The box of every group: the hull that a header gives."""
    return df.groupBy(*keys).agg(F.min("X").alias("xmin"), F.min("Y").alias("ymin"), F.max("X").alias("xmax"), F.max("Y").alias("ymax"))

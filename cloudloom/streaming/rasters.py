"""The streamable metrics as Structured Streaming: rasters that grow with a folder of clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.lattice import with_cell, with_centre
from ..functions.metrics import aggregates, is_streamable
from ..functions.predicates import all_of


def read_point_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def streaming_rasterize(points: DataFrame, res: float, metrics: list[str], conditions=None) -> DataFrame:
    """A streaming aggregate per cell; only metrics with constant state (min, max, count)."""
    if not is_streamable(metrics):
        raise ValueError("only min, max and count can be streamed")
    cells = with_cell(points.where(all_of(points, conditions)), res)
    return with_centre(cells.groupBy("col", "row").agg(*aggregates(points, metrics)), res).select("col", "row", "x", "y", *metrics)

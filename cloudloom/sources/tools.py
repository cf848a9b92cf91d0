"""Small helpers: what the session has, whether a cloud is indexed, accuracy of a table, what filters look like."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .files import store_of

FILTERS = """attribute op value(s), all conditions must hold
  ==  !=  >  >=  <  <=      one number
  %in%  %out%               numbers
  %between%                 two numbers in any order, the upper one excluded
attributes: standard names and their short forms, |name| for absolute values; a missing one is 0"""

TRANSFORMS = """operations of a transformation: - + * / and = (with a place to store it)"""


def filter_usage() -> str:
    return FILTERS


def transform_usage() -> str:
    return TRANSFORMS


def available_threads(spark: SparkSession) -> int:
    """Tasks that run at once."""
    return spark.sparkContext.defaultParallelism


def available_memory(spark: SparkSession) -> dict[str, int]:
    """Bytes left and in all for execution and storage, over all executors."""
    left = whole = 0
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    values = status.values().iterator()
    while values.hasNext():
        pair = values.next()
        whole, left = whole + pair._1(), left + pair._2()
    return {"available": left, "total": whole}


def is_indexed(path: str) -> bool:
    """Whether every row group of a Parquet cloud has the ranges of X and Y, by which queries are pruned."""
    from pyarrow import dataset as ds

    store, target = store_of(path)
    pieces = list(ds.dataset(target, filesystem=store, format="parquet", partitioning="hive").get_fragments())
    groups = [g for piece in pieces for g in piece.row_groups]
    return bool(groups) and all(g.statistics and {"X", "Y"} <= set(g.statistics) for g in groups)


def guessed_accuracy(values: np.ndarray) -> float:
    """The power of ten at which most of the values are whole numbers, 1e-8 at the finest."""
    v = np.abs(np.asarray(values, dtype=float))
    left = np.ones(len(v), bool)
    counts = np.zeros(9, int)
    for digits in range(9):
        scaled = v * 10.0**digits
        whole = left & ((np.abs(scaled - np.round(scaled)) <= np.finfo(float).eps * np.maximum(scaled, 1.0) * 10) | (digits == 8))
        counts[digits] = whole.sum()
        left &= ~whole
    return 10.0 ** -int(counts.argmax())


def from_frame(spark: SparkSession, frame: pd.DataFrame, accuracy: tuple[float, float, float] | None = None) -> DataFrame:
    """A cloud from a pandas table: X, Y and Z are needed and brought to their (guessed) accuracy.

    Column names are taken as attributes, whatever their spelling.
    """
    from ..functions.attributes import canonical

    own = frame.rename(columns={c: canonical(c) for c in frame.columns})
    if missing := [a for a in "XYZ" if a not in own]:
        raise ValueError(f"the table has no {missing[0]}")
    steps = accuracy or tuple(guessed_accuracy(own[a].to_numpy()) if len(own) else 1.0 for a in "XYZ")
    for a, step in zip("XYZ", steps):
        digits = max(0, round(-np.log10(step)))
        own[a] = (np.round(own[a].to_numpy(dtype=float) / step) * step).round(digits)
    return spark.createDataFrame(own) if len(own) else spark.createDataFrame([], ", ".join(f"`{c}` double" for c in own.columns))

"""The metric language: ``attribute_metric`` strings as aggregate expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attributes import attribute

_PLAIN = ("min", "max", "count", "mean", "median", "sd", "cv", "sum", "mode", "skew", "kurt")
_PERCENTILE = re.compile(r"p(\d+(?:\.\d+)?)")
_ABOVE = re.compile(r"above(-?\d+(?:\.\d+)?)")
# Older one-word names of the metrics and what they stand for.
LEGACY = {"zmax": "z_max", "zmin": "z_min", "zmean": "z_mean", "zmedian": "z_median", "zsd": "z_sd", "zcv": "z_cv", "imax": "i_max", "imin": "i_min", "imean": "i_mean", "imedian": "i_median", "isd": "i_sd", "icv": "i_cv"}
STREAMABLE = {"max", "min", "count", "z_max", "z_min"}


@dataclass(frozen=True)
class Metric:
    name: str
    attribute: str
    kind: str
    value: float | None = None


def _kind(text: str) -> tuple[str, float | None] | None:
    if text in _PLAIN:
        return text, None
    if m := _PERCENTILE.fullmatch(text):
        if not 0 <= float(m[1]) <= 100:
            raise ValueError(f"percentile {text!r} is not within 0 and 100")
        return "p", float(m[1])
    if m := _ABOVE.fullmatch(text):
        return "above", float(m[1])
    return None


def parse(text: str) -> Metric:
    """Split at the last underscore whose suffix is a metric; without an attribute it is Z."""
    name = LEGACY.get(text, text)
    if (found := _kind(name)) is not None:
        return Metric(text, "Z", *found)
    attr, _, suffix = name.rpartition("_")
    if attr and (found := _kind(suffix)) is not None:
        return Metric(text, attr, *found)
    raise ValueError(f"{text!r} is no metric")


def is_streamable(metrics: list[str]) -> bool:
    return all(m in STREAMABLE for m in metrics)


def aggregate(df: DataFrame, text: str, where: Column | None = None) -> Column:
    """The aggregate of one metric over the rows that ``where`` accepts, named as given."""
    m = parse(text)
    value = attribute(df, m.attribute)
    if where is not None:
        value = F.when(where, value)
    n = F.count(value) if where is not None else F.count(F.lit(1))
    mean, sd = F.avg(value), F.stddev_samp(value)
    out = {
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "count": lambda: n.cast("bigint"),
        "mean": lambda: mean,
        "median": lambda: F.percentile(value, F.lit(0.5)),
        "sd": lambda: F.when(n > 1, sd),
        "cv": lambda: F.when((n > 1) & (mean != 0), sd / mean),
        "sum": lambda: F.sum(value),
        "mode": lambda: F.mode(value, True),
        "skew": lambda: F.when(n > 1, F.skewness(value)),
        "kurt": lambda: F.when(n > 1, F.kurtosis(value) + 3.0),
        "p": lambda: F.percentile(value, F.lit((m.value or 0.0) / 100.0)),
        "above": lambda: F.avg((value > F.lit(m.value)).cast("double")),
    }[m.kind]()
    return out.alias(text)


def aggregates(df: DataFrame, metrics: list[str], where: Column | None = None, default: float | None = None) -> list[Column]:
    """All metrics; groups without an accepted row get ``default``."""
    out = []
    for text in metrics:
        column = aggregate(df, text, where)
        if default is not None and parse(text).kind != "count":
            column = F.coalesce(column, F.lit(float(default))).alias(text)
        out.append(column)
    return out

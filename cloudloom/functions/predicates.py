"""The predicate language: ``attribute operator values`` strings as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attributes import attribute

#: Tried in this order, so that a longer operator wins over its own beginning.
_OPERATORS = ("%between%", "%in%", "%out%", "==", "!=", ">=", "<=", ">", "<")
_COMPARE = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
}


def parse(condition: str) -> tuple[str, str, list[float]] | None:
    """(attribute, operator, values); None for an empty condition or a native reader flag."""
    text = condition.strip()
    if not text or text.startswith("-"):
        return None
    for op in _OPERATORS:
        name, found, rest = text.partition(op)
        if not found:
            continue
        try:
            values = [float(v) for v in re.split(r"[\s,]+", rest.strip()) if v]
        except ValueError:
            raise ValueError(f"values of {condition!r} are not numbers") from None
        wanted = 2 if op == "%between%" else 1
        if not name.strip() or len(values) < wanted or (op not in ("%in%", "%out%") and len(values) != wanted):
            raise ValueError(f"{condition!r} needs an attribute and {wanted} value(s)")
        return name.strip(), op, values
    raise ValueError(f"{condition!r} has no operator")


def predicate(df: DataFrame, condition: str) -> Column:
    """One condition; ``%between%`` is half-open and takes its bounds in any order."""
    parsed = parse(condition)
    if parsed is None:
        return F.lit(True)
    name, op, values = parsed
    value = attribute(df, name)
    if op == "%between%":
        low, high = sorted(values)
        return (value >= low) & (value < high)
    if op == "%in%":
        return value.isin(values)
    if op == "%out%":
        return ~value.isin(values)
    return _COMPARE[op](value, F.lit(values[0]))


def all_of(df: DataFrame, conditions: str | list[str] | None) -> Column:
    """All conditions of a filter; no condition accepts every point."""
    if isinstance(conditions, str):
        conditions = [conditions]
    parts = [predicate(df, c) for c in conditions or [] if parse(c) is not None]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def in_rectangle(xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    return F.col("X").between(xmin, xmax) & F.col("Y").between(ymin, ymax)


def in_circle(xc: float, yc: float, r: float) -> Column:
    """Closed disc, behind the box that row-group statistics can prune by."""
    near = in_rectangle(xc - r, yc - r, xc + r, yc + r)
    return near & (((F.col("X") - xc) * (F.col("X") - xc) + (F.col("Y") - yc) * (F.col("Y") - yc)) <= r * r)


def random_fraction(p: float, seed: int = 0) -> Column:
    return F.rand(seed) <= p


# The strings that the named filters stand for, and the codes of the standard classes.
def keep_class(*classes: int) -> str:
    return f"Classification %in% {' '.join(map(str, classes))}"


def drop_class(*classes: int) -> str:
    return f"Classification %out% {' '.join(map(str, classes))}"


def keep_first() -> str:
    return "ReturnNumber == 1"


def drop_first() -> str:
    return "ReturnNumber != 1"


def keep_ground() -> str:
    return keep_class(2)


def drop_ground() -> str:
    return drop_class(2)


def keep_ground_and_water() -> str:
    return keep_class(2, 9)


def keep_noise() -> str:
    return keep_class(7, 18)


def drop_noise() -> str:
    return drop_class(7, 18)


def keep_z_above(z: float) -> str:
    return f"Z >= {z}"


def keep_z_below(z: float) -> str:
    return f"Z < {z}"


def drop_z_above(z: float) -> str:
    return f"Z < {z}"


def drop_z_below(z: float) -> str:
    return f"Z >= {z}"


def keep_z_between(low: float, high: float) -> list[str]:
    """Both ends belong to the interval."""
    return [f"Z >= {low}", f"Z <= {high}"]


def drop_z_between(df: DataFrame, low: float, high: float) -> Column:
    """Points outside the closed interval: a disjunction, so a Column and not a string."""
    return ~all_of(df, keep_z_between(low, high))


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["X", "Y", "Z"])

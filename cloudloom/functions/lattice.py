"""The global lattice: one grid anchored at 0, so that tiles agree without coordination.

Cells are closed at their left and at their top edge: a point on a horizontal grid line
belongs to the cell below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_of(x: Column, res: float) -> Column:
    return F.floor(x / F.lit(float(res))).cast("bigint")


def row_of(y: Column, res: float) -> Column:
    return (F.ceil(y / F.lit(float(res))) - 1).cast("bigint")


def centre(index: Column, res: float) -> Column:
    return (index.cast("double") + F.lit(0.5)) * F.lit(float(res))


def with_cell(df: DataFrame, res: float, x: str = "X", y: str = "Y") -> DataFrame:
    return df.withColumns({"col": column_of(F.col(x), res), "row": row_of(F.col(y), res)})


def with_centre(df: DataFrame, res: float) -> DataFrame:
    return df.withColumns({"x": centre(F.col("col"), res), "y": centre(F.col("row"), res)})


def covering(lower: Column, upper: Column, axis: str, res: float) -> Column:
    """Indices of the cells that a closed interval touches, as an array."""
    index = column_of if axis == "x" else row_of
    return F.sequence(index(lower, res), index(upper, res))


def voxel(df: DataFrame, res: float | tuple[float, float, float]) -> DataFrame:
    rx, ry, rz = (res, res, res) if isinstance(res, (int, float)) else res
    return df.withColumns({"vx": column_of(F.col("X"), rx), "vy": column_of(F.col("Y"), ry), "vz": column_of(F.col("Z"), rz)})


def around(reach: int, *names: str) -> Column:
    """Structs of the offsets from -reach to reach in every named direction, as an array."""
    from itertools import product

    return F.array(*[F.struct(*[F.lit(d).cast("bigint").alias(n) for d, n in zip(at, names)]) for at in product(range(-reach, reach + 1), repeat=len(names))])

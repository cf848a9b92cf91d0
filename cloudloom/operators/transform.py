"""Transformation of points with a raster, a matrix or a triangulation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lattice import column_of, row_of

_CORNERS = ((0, 0), (1, 0), (0, 1), (1, 1))


def _applied(df: DataFrame, value: Column, operation: str, store_in: str) -> DataFrame:
    """``-`` and ``+`` change Z, or go to an attribute, and drop points without a value; ``=`` leaves them."""
    if operation not in ("-", "+", "="):
        raise ValueError(f"{operation!r} is none of - + =")
    if operation == "=":
        if not store_in:
            raise ValueError("operation = needs an attribute to store in")
        old = F.col(store_in) if store_in in df.columns else F.lit(None)
        return df.withColumn(store_in, F.coalesce(value, old.cast("double")))
    result = F.col("Z") - value if operation == "-" else F.col("Z") + value
    return df.where(value.isNotNull()).withColumn(store_in or "Z", result)


def raster_nearest(df: DataFrame, raster: DataFrame, band: str, res: float) -> DataFrame:
    """Points with ``__v``, the value of the cell they lie in."""
    cells = raster.select(F.col("col").alias("__c"), F.col("row").alias("__r"), F.col(band).alias("__v"))
    keyed = df.withColumns({"__c": column_of(F.col("X"), res), "__r": row_of(F.col("Y"), res)})
    return keyed.join(cells, ["__c", "__r"], "left").drop("__c", "__r")


def raster_bilinear(df: DataFrame, raster: DataFrame, band: str, res: float) -> DataFrame:
    """Points with ``__v`` from the four cells around them; absent cells lose their weight.

    The cells are first gathered to quads, so that every point meets one row only.
    """
    corner = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j")) for i, j in _CORNERS])
    spread = raster.where(F.col(band).isNotNull()).select("col", "row", F.col(band).alias("v"), F.explode(corner).alias("d"))
    at = lambda i, j: F.max(F.when((F.col("d.i") == i) & (F.col("d.j") == j), F.col("v"))).alias(f"__v{i}{j}")
    quads = spread.groupBy((F.col("col") - F.col("d.i")).alias("__c"), (F.col("row") - F.col("d.j")).alias("__r")).agg(*[at(i, j) for i, j in _CORNERS])
    u, v = F.col("X") / F.lit(float(res)) - F.lit(0.5), F.col("Y") / F.lit(float(res)) - F.lit(0.5)
    keyed = df.withColumns({"__c": F.floor(u).cast("bigint"), "__r": F.floor(v).cast("bigint")})
    joined = keyed.join(quads, ["__c", "__r"], "left")
    fx, fy = u - F.col("__c"), v - F.col("__r")
    weight = lambda i, j: (fx if i else F.lit(1.0) - fx) * (fy if j else F.lit(1.0) - fy)
    total = sum((F.when(F.col(f"__v{i}{j}").isNotNull(), weight(i, j)).otherwise(0.0) for i, j in _CORNERS), F.lit(0.0))
    value = sum((F.coalesce(F.col(f"__v{i}{j}") * weight(i, j), F.lit(0.0)) for i, j in _CORNERS), F.lit(0.0))
    out = joined.withColumn("__v", F.when(total > 0, value / total))
    return out.drop("__c", "__r", *[f"__v{i}{j}" for i, j in _CORNERS])


def transform_with_raster(df: DataFrame, raster: DataFrame, band: str, res: float, operation: str = "-", store_in: str = "", bilinear: bool = True) -> DataFrame:
    valued = (raster_bilinear if bilinear else raster_nearest)(df, raster, band, res)
    return _applied(valued, F.col("__v"), operation, store_in).drop("__v")


def load_matrix(values: list[float], check: bool = True) -> np.ndarray:
    """A 4 x 4 matrix by rows; checked to be a rotation with a shift."""
    if len(values) != 16:
        raise ValueError("a matrix has 16 values")
    m = np.array(values, dtype=float).reshape(4, 4)
    if check:
        r = m[:3, :3]
        if not np.allclose(r @ r.T, np.eye(3), atol=1e-6) or abs(np.linalg.det(r) - 1) > 1e-6:
            raise ValueError("the matrix is no rotation")
    return m


def transform_with_matrix(df: DataFrame, matrix: np.ndarray, scale: float | None = None) -> DataFrame:
    """Homogeneous transform of the coordinates; with ``scale`` they are truncated to its multiples."""
    axes = [F.col(a) for a in "XYZ"]
    new = []
    for row in np.asarray(matrix, dtype=float)[:3]:
        value = sum((F.lit(float(m)) * a for m, a in zip(row, axes)), F.lit(0.0)) + F.lit(float(row[3]))
        if scale:
            value = F.when(value < 0, F.ceil(value / scale)).otherwise(F.floor(value / scale)) * F.lit(float(scale))
        new.append(value)
    return df.withColumns(dict(zip("XYZ", new)))


def transform_with_triangulation(df: DataFrame, triangles: DataFrame, operation: str = "-", store_in: str = "", cell: float = 2.0) -> DataFrame:
    from .tin import interpolate

    valued = df.join(interpolate(df.select("pid", "X", "Y"), triangles, cell), "pid", "left")
    return _applied(valued, F.col("__v"), operation, store_in).drop("__v")

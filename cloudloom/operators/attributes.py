"""Row and column operators: deletion, editing, attribute definition, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.attributes import COORDINATES, TYPES, canonical, clamped, find
from ..functions.lattice import column_of, row_of
from ..functions.predicates import all_of

_SPARK_TYPES = {"smallint": "ushort", "tinyint": "char", "int": "int", "bigint": "int64", "float": "float", "double": "double"}


def filter_points(df: DataFrame, conditions: str | list[str]) -> DataFrame:
    """The points that meet all conditions; comparisons reach the Parquet scan."""
    return df.where(all_of(df, conditions))


def delete_points(df: DataFrame, conditions: str | list[str]) -> DataFrame:
    """The points that don't meet all conditions."""
    if not conditions:
        raise ValueError("delete_points needs a filter")
    return df.where(~all_of(df, conditions))


def delete_noise(df: DataFrame) -> DataFrame:
    return delete_points(df, "Classification %in% 7 18")


def delete_ground(df: DataFrame) -> DataFrame:
    return delete_points(df, "Classification %in% 2")


def storage_type(df: DataFrame, column: str):
    """The numeric type of a column: that of its metadata, else one of its Spark type."""
    field = df.schema[column]
    named = field.metadata.get("type") if field.metadata else None
    return TYPES[named or _SPARK_TYPES.get(field.dataType.simpleString(), "double")]


def edit_attribute(df: DataFrame, attribute: str, value: float, conditions: str | list[str] | None = None, kind: str | None = None) -> DataFrame:
    """Set an attribute on the points that meet the conditions, clamped to its type."""
    name = canonical(attribute)
    if name in COORDINATES:
        raise ValueError("coordinates can't be edited")
    column = find(df, attribute)
    if column is None:
        raise ValueError(f"there is no attribute {attribute!r}")
    stored = TYPES[kind] if kind else storage_type(df, column)
    new = clamped(F.lit(float(value)), stored).cast(df.schema[column].dataType)
    return df.withColumn(column, F.when(all_of(df, conditions), new).otherwise(F.col(column)))


def add_attribute(df: DataFrame, kind: str, name: str, description: str = "", scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """A new attribute of zeros; the same definition again changes nothing, another one is an error."""
    if kind not in TYPES:
        raise ValueError(f"{kind!r} is no attribute type")
    if canonical(name) != name or name in COORDINATES:
        raise ValueError(f"{name!r} is reserved")
    metadata = {"type": kind, "description": description, "scale": scale, "offset": offset}
    if name in df.columns:
        if df.schema[name].metadata == metadata:
            return df
        raise ValueError(f"{name!r} exists with another definition")
    stored = "double" if scale != 1.0 or offset != 0.0 else TYPES[kind].spark
    return df.withColumn(name, F.lit(0).cast(stored)).withMetadata(name, metadata)


def remove_attributes(df: DataFrame, names: list[str]) -> DataFrame:
    """Without the named attributes; coordinates stay, unknown names are ignored."""
    found = {find(df, n) for n in names} - {None}
    return df.drop(*[c for c in found if canonical(c) not in COORDINATES])


def keep_attributes(df: DataFrame, names: list[str]) -> DataFrame:
    """The coordinates, the point id and the named attributes."""
    found = {find(df, n) for n in names} | {c for c in df.columns if canonical(c) in COORDINATES or c == "pid"}
    return df.select(*[c for c in df.columns if c in found])


def add_rgb(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(0).cast("int") for c in "RGB" if c not in df.columns})


def remove_rgb(df: DataFrame) -> DataFrame:
    return df.drop("R", "G", "B")


def set_crs(df: DataFrame, crs: int | str) -> DataFrame:
    """Label the coordinates with an EPSG code or WKT; nothing is reprojected."""
    note = {"epsg": crs} if isinstance(crs, int) else {"wkt": crs}
    return df.withMetadata("X", {**(df.schema["X"].metadata or {}), **note})


def sort_points(df: DataFrame, cell: float = 50.0, tie: tuple[str, ...] = ("pid",)) -> DataFrame:
    """Points by row and column of coarse cells: ranges over the cluster, sorted within each."""
    keys = [-row_of(F.col("Y"), cell), column_of(F.col("X"), cell)]
    keyed = df.withColumns({"__row": keys[0], "__col": keys[1]})
    order = ["__row", "__col", *tie]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("__row", "__col")


def stop_if_outside(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, tile: float) -> DataFrame:
    """The points of the tiles that touch a box: what later stages go on with."""
    col, row = column_of(F.col("X"), tile), row_of(F.col("Y"), tile)
    x0, y0 = col * F.lit(float(tile)), row * F.lit(float(tile))
    return df.where((x0 <= xmax) & (x0 + tile >= xmin) & (y0 <= ymax) & (y0 + tile >= ymin))


def stop_if_chunk_id_below(df: DataFrame, index: int, order: Column) -> DataFrame:
    """The points of the chunks whose 0-based number is at least ``index`` - 1."""
    return df.where(order >= index - 1)


def nothing(df: DataFrame, loop: bool = False) -> DataFrame:
    if loop:
        df.count()
    return df


def info(df: DataFrame) -> DataFrame:
    """One row: number of points, box, area, density, and the schema as text."""
    box = df.agg(
        F.count(F.lit(1)).alias("npoints"),
        *[f(c).alias(f"{n}_{c.lower()}") for c in COORDINATES for n, f in (("min", F.min), ("max", F.max))],
    )
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return box.withColumn("area", area).withColumn("density", F.when(area > 0, F.col("npoints") / area)).withColumn("schema", F.lit(schema))


def union_points(*frames: DataFrame) -> DataFrame:
    """Many clouds as one; attributes that a cloud lacks are 0."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    zeros = [f.name for f in out.schema.fields if isinstance(f.dataType, T.NumericType) and any(f.name not in x.columns for x in frames)]
    return out.fillna(0, subset=zeros) if zeros else out

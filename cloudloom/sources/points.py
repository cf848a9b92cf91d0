"""Points from the tables at hand: views of business tables as point clouds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where a local session leaves it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = f"file://{tempfile.mkdtemp(prefix='cloudloom-')}"
        named = _own_folders[app]
    return named.rstrip("/")


def read_points(spark: SparkSession, path: str | list[str], conditions=None, depth: int = -1) -> DataFrame:
    """A Parquet cloud, filtered; ``depth`` limits the levels of a cloud written with levels of detail."""
    from ..functions.predicates import all_of

    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if depth >= 0 and "depth" in df.columns:
        df = df.where(F.col("depth") <= depth)
    return df.where(all_of(df, conditions))


def lineitem_points(spark: SparkSession, sf_dir: str, with_pid: bool = False) -> DataFrame:
    """The order lines as a cloud of even density, about 4.8 points a unit of area.

    ``pid`` is the order line's key and its number among rows of the same key, in the
    order of the other attributes: ids without a sort of the whole table.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    days = F.unix_date(F.to_date("l_shipdate")).cast("double")
    flag = F.col("l_returnflag")
    points = {
        "X": (days - 8035.0) / 20.0 + F.col("l_quantity") / 1000.0,
        "Y": F.col("l_partkey").cast("double") * 0.05,
        "Z": F.col("l_extendedprice") / 1000.0,
        "Intensity": F.round(F.col("l_discount") * 1000.0).cast("int"),
        "ReturnNumber": F.col("l_linenumber"),
        "Classification": F.when(flag == "N", 1).when(flag == "A", 2).otherwise(9),
        "NumberOfReturns": F.when(F.col("l_linestatus") == "F", 1).otherwise(2),
        "UserData": F.round(F.col("l_tax") * 100.0).cast("int"),
        "PointSourceID": F.col("l_suppkey"),
    }
    if not with_pid:
        return lines.select(*[c.alias(n) for n, c in points.items()])
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    pid = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 64 + F.row_number().over(order)
    return lines.select(pid.cast("bigint").alias("pid"), *[c.alias(n) for n, c in points.items()])


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a cloud: hours since 2024 by user by value, with the event's id as pid."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hours = (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6 - 1704067200.0) / 3600.0
    return events.select(
        F.col("event_id").alias("pid"), hours.alias("X"), F.col("user_id").cast("double").alias("Y"), F.col("value").alias("Z"),
        F.get_json_object("props", "$.k").cast("int").alias("Intensity"), F.pmod(F.crc32(F.col("event_type").cast("binary")), F.lit(32)).cast("int").alias("Classification"),
    )

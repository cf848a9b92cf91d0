"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The six white-space characters of the contracts: blank and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` names it on a cluster.  Only where that is
    unset in a local session, as in tests, a temporary folder takes its place; elsewhere
    executors could not see such a folder, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = f"file://{tempfile.mkdtemp(prefix='cloudloom-')}"
        named = _own_dirs[app]
    return named.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    It cuts the lineage: what follows reads files that outlive any executor.  They are
    deleted when the application ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    file_system, target = _file(spark, path)
    file_system.deleteOnExit(target)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def _file(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables from ``written`` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_written_path", None) if df is not None else None:
            file_system, target = _file(df.sparkSession, path)
            file_system.delete(target, True)


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of few rows while texts go through workers, for the memory of both sides.

    Only what is written inside is affected; the session's setting comes back after it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before))) if int(before) > 0 else str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def strings(batch, column: int, rows: int = 500) -> Iterator[str | None]:
    """A text column of an Arrow batch, a few rows at a time, so that a batch is not held twice."""
    values = batch.column(column)
    for at in range(0, len(values), rows):
        yield from values.slice(at, rows).to_pylist()


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns named like those an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])

"""Files: small ones and headers through Hadoop's file systems, and files that tasks write.

Tasks write through Arrow's file systems (mounted folders, HDFS, S3, GCS), under a name of
their own that becomes the file's name when it is whole, so that a repeated task does no harm.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def binary_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, content) of whole files: one file is one row, and so one task's work."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def head(spark: SparkSession, path: str | list[str], n: int) -> bytes:
    """The first bytes of the first file."""
    return bytes(binary_files(spark, path).orderBy("path").select(F.substring("content", 1, n).alias("h")).first()[0])


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def write_file(path: str, chunks: Iterable[bytes]) -> None:
    """A file from pieces of bytes, whole or not at all."""
    store, target = store_of(path)
    folder = posixpath.dirname(target)
    store.create_dir(folder, recursive=True)
    own = f"{folder}/.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as stream:
        for chunk in chunks:
            stream.write(chunk)
    store.move(own, target)


def named(pattern: str, key: Iterable) -> str:
    """``pattern`` with its star replaced by the parts of a key."""
    return pattern.replace("*", "_".join(str(k) for k in key), 1)


def not_an_input(path: str, inputs: Iterable[str]) -> None:
    """Writing over a file that is read is an error."""
    plain = lambda p: p.removeprefix("file://").rstrip("/")
    if any(plain(path) == plain(i) for i in inputs):
        raise ValueError(f"the output {path!r} is one of the inputs")

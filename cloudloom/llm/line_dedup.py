"""Removal of lines that many documents share.

Lines are normalised, hashed and exploded; documents are counted per hash; lines at or
over the threshold go, and each text is put together again by line position.  Only
hashes and positions are shuffled for counting; a text moves once, to meet its mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACES, UPPER, fresh, written

#: A set of shared lines of at most this many rows (12 bytes each) is broadcast; a
#: larger one is joined by a shuffle whose skewed partitions are split at run time.
BROADCAST_ROWS = 500_000


def line_keys(text: Column) -> Column:
    """The normalised lines of ``text``: stripped at both ends, A-Z lower-cased."""
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "\n", -1)
    return F.transform(lines, lambda x: F.btrim(x, F.lit(SPACES)))


def _hashed(key: Column, min_chars: int) -> Column:
    """96 bits of a key; null where the key is too short to be counted."""
    return F.when(F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.hash(key).alias("b")))


def shared_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """Hashes (a, b) of the lines found in at least ``min_docs`` distinct documents.

    A document contributes each hash once; the count of distinct ids is pre-aggregated
    by (hash, id), so a line found in every document is no hot key.
    """
    each = docs.select(
        F.col(id_col).alias("id"),
        F.explode(F.array_distinct(F.transform(line_keys(F.col(text_col)), lambda k: _hashed(k, min_chars)))).alias("h"),
    ).where("h is not null")
    return (
        each.select("id", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
        .groupBy("a", "b")
        .agg(F.count_distinct("id").alias("n"))
        .where(F.col("n") >= min_docs)
        .select("a", "b")
    )


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``docs`` with shared lines taken out of ``text_col``, plus n_lines and n_dropped.

    Null and empty texts are one empty line, which is never dropped where ``min_chars``
    is 1 or more; a null text becomes an empty one.  Rows repeated under one id count as
    one document; rows without an id count for no line, but lose shared lines.  A text
    whose lines all go becomes empty.  An empty table gives an empty table.  Columns of
    ``docs`` named n_lines or n_dropped are replaced.
    """
    heavy = written(shared_lines(docs, id_col, text_col, min_docs, min_chars), "shared-lines")
    n_heavy = heavy.count()
    heavy = heavy.withColumn("heavy", F.lit(True))
    if n_heavy <= broadcast_rows:
        heavy = F.broadcast(heavy)

    key = F.struct(F.xxhash64(id_col, text_col).alias("k1"), F.hash(id_col, text_col).alias("k2"))
    lines = docs.select(
        key.alias("k"),
        F.posexplode(F.transform(line_keys(F.col(text_col)), lambda x: _hashed(x, min_chars))).alias("pos", "h"),
    ).select("k.k1", "k.k2", "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    marks = (
        lines.join(heavy, ["a", "b"], "left")
        .groupBy("k1", "k2")
        .agg(
            F.max("heavy").alias("any"),
            F.sort_array(F.collect_set(F.struct("pos", F.col("heavy").isNull().alias("keep")))).alias("m"),
        )
        .where("any")
        .select(F.struct("k1", "k2").alias("__ld_k"), F.transform("m", lambda x: x["keep"]).alias("__ld_keep"))
    )
    base = fresh(docs, "n_lines", "n_dropped").withColumn("__ld_k", key)
    joined = base.join(marks, "__ld_k", "left")
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    kept = F.filter(split, lambda x, i: F.col("__ld_keep")[i])
    return joined.select(
        *[
            F.when(F.col("__ld_keep").isNull(), F.coalesce(F.col(text_col), F.lit("")))
            .otherwise(F.array_join(kept, "\n"))
            .alias(c)
            if c == text_col
            else F.col(c)
            for c in base.columns
            if c != "__ld_k"
        ],
        F.size(split).cast("long").alias("n_lines"),
        F.when(F.col("__ld_keep").isNull(), F.lit(0))
        .otherwise(F.size(F.filter("__ld_keep", lambda x: ~x)))
        .cast("long")
        .alias("n_dropped"),
    )

"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact check.

Documents and benchmark items are sequences of lower-cased letter-and-digit words and of
their five-word shingles.  A window as long as an item is looked at wherever it holds a
shingle of that item (no other window can be similar to it at all).  Windows and items
get 64-bit SimHashes; a multi-index over blocks of the fingerprint finds every item
within the Hamming radius of a window; weighted Jaccard similarity of the shingle
multisets decides.

All of it is DataFrame expressions.  With a benchmark of a checked size the whole search
is one pass over the documents without a shuffle; for a larger one, hashes and positions
alone are joined by a shuffle, and a document's windows come back to it by one more.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bits of the blocks; with 5 blocks and radius 24 one block differs in 4 bits at most.
BLOCKS, RADIUS = (13, 13, 13, 13, 12), 24
#: A side of at most this many rows (under 100 bytes each) is broadcast.
BROADCAST_ROWS = 600_000
#: Fingerprints by block and value are broadcast up to so many for each of those rows (8 bytes each).
PER_ROW = 5
WORD = r"[\p{L}\p{N}]+"


def shingles(text: Column, width: int) -> Column:
    """64-bit hashes of the word shingles, in order; none for a text of fewer words."""
    words = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))

    def of(hashes: Column) -> Column:
        last = F.size(hashes) - width
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[hashes[i + j] for j in range(width)]))
        return F.when(last >= 0, each).otherwise(F.expr("cast(array() as array<bigint>)"))

    # one evaluation of the words, used many times: an array of one element is transformed
    return F.transform(F.array(words), of)[0]


def simhash(hashes: Column, planes: int) -> Column:
    """The 64-bit majority of the hashes' bits.

    ``planes`` words hold all 64 bit counts, one binary digit of every count each, so that
    a hash is added by a few bit operations; the counts are then compared with half the
    number of hashes, digit by digit.  2 ** planes must exceed that number.
    """
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(planes)])

    def add(acc: Column, h: Column) -> Column:
        carry, out = h, []
        for k in range(planes):
            out.append(acc[f"c{k}"].bitwiseXOR(carry).alias(f"c{k}"))
            carry = carry.bitwiseAND(acc[f"c{k}"])
        return F.struct(*out)

    half = F.floor(F.size(hashes) / 2).cast("long")

    def decide(acc: Column) -> Column:
        more, equal = F.lit(0).cast("long"), F.lit(-1).cast("long")
        for k in reversed(range(planes)):
            digit = -F.shiftright(half, k).bitwiseAND(F.lit(1).cast("long"))  # all ones or all zeros
            own = acc[f"c{k}"]
            more = more.bitwiseOR(equal.bitwiseAND(own).bitwiseAND(F.bitwise_not(digit)))
            equal = equal.bitwiseAND(F.bitwise_not(own.bitwiseXOR(digit)))
        return more

    return F.aggregate(hashes, zero, add, decide)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of smaller over sum of larger weights; a shingle weighs as often as it occurs."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))

    def least(acc: Column, x: Column) -> Column:
        return acc + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x)))

    both = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(F.array_distinct(b), F.lit(0), least))
    return both / (F.size(a) + F.size(b) - both)


def _blocks(fp: Column) -> Column:
    """array<struct<block, value>> of a fingerprint."""
    at, out = 0, []
    for k, bits in enumerate(BLOCKS):
        value = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")
        out.append(F.struct(F.lit(k).alias("block"), value.alias("value")))
        at += bits
    return F.array(*out)


def _masks(bits: int) -> list[int]:
    """All values of ``bits`` bits with as many ones as a block may differ in."""
    most = RADIUS // len(BLOCKS)
    return [sum(1 << b for b in own) for n in range(most + 1) for own in combinations(range(bits), n)]


def _maybe_broadcast(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    min_similarity: float = 0.8,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(id, item, similarity, start, n_words): one row per document and item found in it.

    ``start`` is the first word of the most similar window (the earliest of equals) and
    ``n_words`` its length.  Documents and items of fewer than ``width`` words, null and
    empty texts have no shingle and match nothing.  A document shorter than an item is one
    window.  Rows repeated under one id count once; rows without an id are not looked at.
    Other columns are left alone, whatever their names.  SimHash is a statistical filter:
    bits of fingerprints at a similarity of exactly 0.8 differ with a chance of 0.15, so
    that one window in some millions lies beyond the radius.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), shingles(F.col(item_text_col), width).alias("b"))
    items = written(items.where("size(b) > 0").distinct(), "items")
    longest = items.agg(F.max(F.size("b"))).first()[0] or 1
    planes = int(longest).bit_length() + 1
    # windows are as long as the items that share the shingle at this place
    anchors = items.select(F.posexplode("b").alias("q", "h"), F.size("b").alias("m")).groupBy("h").agg(F.collect_set(F.struct("q", "m")).alias("at"))
    anchors = written(anchors, "anchors")

    s = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), shingles(F.col(text_col), width).alias("s"))
    most = lambda n: F.greatest(n - F.col("w.m"), F.lit(0))
    start = lambda n: F.greatest(F.lit(0), F.least(F.col("p") - F.col("w.q"), most(n)))
    if anchors.count() <= broadcast_rows:
        met = s.select("id", "s", F.posexplode("s").alias("p", "h")).join(F.broadcast(anchors), "h").select("id", "s", "p", F.explode("at").alias("w"))
        windows = met.select("id", start(F.size("s")).alias("start"), F.slice("s", start(F.size("s")) + 1, F.col("w.m")).alias("a"))
    else:
        # texts stay where they are; a text is told by its id and a hash of its shingles
        s = s.withColumn("key", F.xxhash64("id", "s"))
        places = s.select("id", "key", F.size("s").alias("n"), F.posexplode("s").alias("p", "h")).join(anchors, "h").select("id", "key", "n", "p", F.explode("at").alias("w"))
        wanted = places.groupBy("id", "key").agg(F.collect_set(F.struct(start(F.col("n")).alias("start"), F.col("w.m").alias("m"))).alias("ws"))
        met = s.join(wanted, ["id", "key"]).select("id", "s", F.explode("ws").alias("w"))
        windows = met.select("id", "w.start", F.slice("s", F.col("w.start") + 1, F.col("w.m")).alias("a"))
    windows = windows.withColumn("fp", simhash(F.col("a"), planes))

    own = written(items.select("item", "b", simhash(F.col("b"), planes).alias("item_fp")), "fingerprints")
    masks = F.array(*[F.array(*[F.lit(m) for m in _masks(bits)]) for bits in BLOCKS])
    near = own.select("item_fp").distinct().select("item_fp", F.explode(_blocks(F.col("item_fp"))).alias("k")).withColumn("mask", F.explode(masks[F.col("k.block")]))
    near = near.groupBy(F.col("k.block").alias("block"), F.col("k.value").bitwiseXOR(F.col("mask")).alias("value")).agg(F.collect_list("item_fp").alias("fps"))
    near = written(near, "near")
    if (near.agg(F.sum(F.size("fps"))).first()[0] or 0) <= PER_ROW * broadcast_rows:
        near = F.broadcast(near)

    probes = windows.select("id", "start", "a", "fp", F.explode(_blocks(F.col("fp"))).alias("k")).select("id", "start", "a", "fp", "k.block", "k.value")
    within = F.filter("fps", lambda x: F.bit_count(F.col("fp").bitwiseXOR(x)) <= RADIUS)
    found = probes.join(near, ["block", "value"]).select("id", "start", "a", F.explode(within).alias("item_fp"))
    found = found.join(_maybe_broadcast(own, broadcast_rows // 10), "item_fp")
    found = found.withColumn("similarity", weighted_jaccard(F.col("a"), F.col("b"))).where(F.col("similarity") >= min_similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"), (F.size("a") + width - 1).alias("n")))
    out = found.groupBy("id", "item").agg(best.alias("best"))
    return out.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "best.similarity", (-F.col("best.before")).alias("start"), F.col("best.n").alias("n_words")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents in which a benchmark item is found; rows without an id stay."""
    leaks = written(find_leaks(docs, benchmark, id_col, **options).select(id_col).distinct(), "leaks")
    return docs.join(leaks, id_col, "left_anti")

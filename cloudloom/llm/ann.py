"""Approximate nearest neighbours by inner product over an inverted multi-index.

Vectors are split in halves, each half is quantised by its own codebook, and an entry's
cell is the pair of centroids.  A query walks the cells by summed distance with a heap
(the multi-sequence algorithm) until the cells hold a given share of all entries, and no
fewer than the rows asked for; the entries of those cells are reranked by the exact inner product.

Equal vectors are one entry that carries its smallest ids.  Non-empty cells, in order, are
dealt over shards of a bounded number of entries, a crowded cell over several of them; a
query goes only to the shards that hold one of its cells, with a bit for each, and queries
meet a shard in blocks of a bounded number.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bound on the rows that the codebooks are fitted on, whatever the size of the table.
SAMPLE_ROWS = 10_000
#: Centroids of a half: about four times the root of the number of rows, at most so many.
MAX_CENTROIDS = 128
#: Entries of a shard, and queries that meet it at once: 64 dimensions in double precision are about 4 and 2 MB.
SHARD_ENTRIES, BLOCK_QUERIES = 8_000, 4_000
_QUERY_STEP = 256


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """At most ``k`` centroids of the rows of ``x``."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        for j in range(len(c)):
            if (own := near == j).any():
                c[j] = x[own].mean(axis=0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)


def multi_sequence(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Pairs (i, j) by increasing d1[i] + d2[j] until their counts add up to ``wanted``."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    o1, o2, counts = o1.tolist(), o2.tolist(), counts.tolist()
    heap, out, got = [(s1[0] + s2[0], 0, 0)], [], 0
    while heap and got < wanted:
        _, a, b = heap[0]
        out.append((o1[a], o2[b]))
        got += counts[o1[a]][o2[b]]
        # the next pair of the row follows; a row opens when the first pair of the one before it goes
        if b + 1 < len(s2):
            heapq.heapreplace(heap, (s1[a] + s2[b + 1], a, b + 1))
        else:
            heapq.heappop(heap)
        if not b and a + 1 < len(s1):
            heapq.heappush(heap, (s1[a + 1] + s2[0], a + 1, 0))
    return out


def deal_cells(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, parts): cells in order over shards of ``most`` entries; a larger cell has several to itself."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    shard, held = 0, 0
    for c in np.flatnonzero(counts).tolist():
        n = int(counts[c])
        if held and held + n > most:
            shard, held = shard + 1, 0
        first[c], parts[c] = shard, -(-n // most)
        held += n
        if n > most:
            shard, held = shard + int(parts[c]), 0
    return first, parts


def usable(value, dims: int | None = None) -> np.ndarray | None:
    """A vector in double precision; None if it is null, zero or not all finite numbers."""
    if value is None or any(v is None for v in value):
        return None
    x = np.asarray(value, dtype=np.float64)
    if not len(x) or (dims is not None and len(x) != dims) or not np.isfinite(x).all() or not x.any():
        return None
    return x


def _rows(batch: pa.RecordBatch, dims: int) -> tuple[list[int], np.ndarray]:
    """Positions and vectors of the usable rows of a batch's second column."""
    col = batch.column(1)
    flat = col.flatten()
    if not col.null_count and not flat.null_count and len(flat) == dims * len(col):
        offsets = col.offsets.to_numpy()
        if (np.diff(offsets) == dims).all():
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            ok = np.flatnonzero(np.isfinite(x).all(axis=1) & x.any(axis=1))
            return ok.tolist(), x[ok]
    got = [(i, v) for i, value in enumerate(col.to_pylist()) if (v := usable(value, dims)) is not None]
    return [i for i, _ in got], np.array([v for _, v in got]).reshape(-1, dims)


def one_vector_per_id(base: DataFrame, dims: int) -> tuple[DataFrame, int]:
    """``base`` with the smallest usable vector of every id, and its number of rows.

    Ids alone are counted first; vectors move only where an id is repeated.
    """
    ids = written(base.groupBy("id").count(), "ids")
    rows, most = ids.agg(F.sum("count"), F.max("count")).first()
    if (most or 0) > 1:
        again = ids.where("count > 1").select("id")
        fine = f"size(v) = {dims} and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
        kept = base.join(again, "id", "left_semi").where(fine).groupBy("id").agg(F.min("v").alias("v"))
        base = written(base.join(again, "id", "left_anti").unionByName(kept), "vectors")
    return base, rows or 0


def search(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_where: str = "vec_id % 20 = 0",
    k: int = 20,
    centroids: int | None = None,
    share: float = 0.4,
    sample_rows: int = SAMPLE_ROWS,
    shard_entries: int = SHARD_ENTRIES,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest entries found for every query row.

    Queries are the rows that ``query_where`` selects by their id; candidates are all rows
    but those with the query's own id.  Nearness is the inner product in double precision;
    ties go to the smaller id.  Vectors that are null, zero, of another length than the
    sample's usual one, or that hold null or non-finite components take no part, nor do
    rows without an id.  An id has one vector: of rows repeated under it, the smallest
    usable one (by components, left to right) counts, as a query and as a candidate.
    With fewer than ``k`` candidates all are returned; an empty table gives an empty
    result; other columns are left alone, whatever their names.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    result = "query_id long, rank int, vec_id long, score double"
    sample = [x for r in base.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toLocalIterator() if (x := usable(r[1])) is not None]
    if not sample:
        return spark.createDataFrame([], result)
    lengths = [len(x) for x in sample]
    dims = max(sorted(set(lengths)), key=lengths.count)
    fit = np.array([x for x in sample if len(x) == dims])
    base, rows = one_vector_per_id(base, dims)
    half = dims // 2
    wide = centroids or int(min(MAX_CENTROIDS, max(8, 4 * np.sqrt(rows))))
    books = kmeans(fit[:, :half], wide) if half else np.zeros((1, 0)), kmeans(fit[:, half:], wide)
    k1, k2 = len(books[0]), len(books[1])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _rows(batch, dims)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            cell = nearest(x[:, :half], books[0]) * k2 + nearest(x[:, half:], books[1]) if len(at) else np.zeros(0, int)
            raw = [r.tobytes() for r in x + 0.0]  # -0.0 is 0.0
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cell.astype(np.int32)), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())],
                names=["id", "cell", "key", "v"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal vectors of a task become one row with the smallest ids: enough for any query's answer."""
        held: dict[bytes, list] = {}
        for batch in index(batches):
            for i, cell, key, v in zip(*(c.to_pylist() for c in batch.columns)):
                own = held.setdefault(key, [cell, v, set()])[2]
                own.add(i)
                if len(own) > 4 * (k + 1):
                    held[key][2] = set(heapq.nsmallest(k + 1, own))
            if len(held) >= 20_000:
                yield _entries(held)
                held = {}
        if held:
            yield _entries(held)

    def _entries(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(held), pa.binary()),
                pa.array([x[0] for x in held.values()], pa.int32()),
                pa.array([x[1] for x in held.values()], pa.binary()),
                pa.array([heapq.nsmallest(k + 1, x[2]) for x in held.values()], pa.list_(pa.int64())),
            ],
            names=["key", "cell", "v", "ids"],
        )

    entries = base.mapInArrow(merge, "key binary, cell int, v binary, ids array<long>").groupBy("key").agg(
        F.first("cell").alias("cell"), F.first("v").alias("v"), F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
    )
    entries = written(entries, "entries")
    counts = np.zeros(k1 * k2, dtype=np.int64)
    for cell, n in entries.groupBy("cell").count().collect():  # MAX_CENTROIDS squared at most
        counts[cell] = n
    total = int(counts.sum())
    if not total:
        return spark.createDataFrame([], result)
    # k others at least: one entry may hold the query's own id alone
    wanted = min(total, max(int(np.ceil(share * total)), k + 1))
    first, parts = deal_cells(counts, shard_entries)
    filled = np.flatnonzero(counts)
    # a shard's cells are a range; those of a split cell hold that cell alone
    shards = int((first + parts)[filled].max())
    shard_of = first[filled]
    low = np.zeros(shards, np.int64)
    high = np.full(shards, -1, np.int64)
    for c, s, n in zip(filled.tolist(), shard_of.tolist(), parts[filled].tolist()):
        for own in range(s, s + n):
            low[own] = c if high[own] < 0 else low[own]
            high[own] = c

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(1).to_numpy()
            salt = np.array([int.from_bytes(x[:4], "little") for x in batch.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((first[cell] + salt % parts[cell]).astype(np.int32)), *batch.columns[1:]], names=["shard", "cell", "v", "ids"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.reshape(k1, k2)
        for batch in batches:
            at, x = _rows(batch, dims)
            ids = batch.column(0).take(pa.array(at, pa.int64())).to_pylist()
            # a larger inner product is nearer, so the distances are the negated products
            d1, d2 = -(x[:, :half] @ books[0].T), -(x[:, half:] @ books[1].T)
            out: list[tuple] = []
            for i, q, a, b in zip(ids, x, d1, d2):
                mask = np.zeros(k1 * k2, dtype=bool)
                mask[[m * k2 + n for m, n in multi_sequence(a, b, table, wanted)]] = True
                raw = q.tobytes()
                for s in range(shards):
                    if (own := mask[low[s] : high[s] + 1]).any():
                        out.append((s, i, raw, np.packbits(own).tobytes()))
                if len(out) > 20_000:
                    yield _sent(out)
                    out = []
            yield _sent(out)

    def _sent(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "id", "v", "cells"])

    asked = vectors.where(query_where).select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    asked = written(asked, "asked")
    blocks = max(1, -(-asked.count() // block_queries))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    sent = base.join(asked, "id", "left_semi").mapInArrow(walk, "shard int, id long, v binary, cells binary").withColumn("block", block)
    sent = written(sent, "queries")
    dealt = entries.select("key", "cell", "v", "ids").mapInArrow(deal, "shard int, cell int, v binary, ids array<long>")
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def rerank(left, right):
        out = []
        if len(left) and len(right):
            right = right.sort_values("cell", kind="stable")
            start = int(low[right["shard"].iloc[0]])
            x = np.frombuffer(b"".join(right["v"]), dtype=np.float64).reshape(-1, dims)
            longest = np.sqrt((x * x).sum(axis=1).max())
            cell = right["cell"].to_numpy()
            ids = right["ids"].tolist()
            least = np.array([v[0] for v in ids], dtype=np.int64)
            edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            for at in range(0, len(left), _QUERY_STEP):
                part = left.iloc[at : at + _QUERY_STEP]
                q = np.frombuffer(b"".join(part["v"]), dtype=np.float64).reshape(-1, dims)
                seen = np.unpackbits(np.frombuffer(b"".join(part["cells"]), dtype=np.uint8).reshape(len(q), -1), axis=1).astype(bool)
                score = np.full((len(q), len(x)), -np.inf)
                for s, e in zip(edges[:-1], edges[1:]):
                    if (who := np.flatnonzero(seen[:, cell[s] - start])).size:
                        score[who, s:e] = q[who] @ x[s:e].T
                n = min(len(x), k + 1)
                # what rounding may have put behind the last one of the best counts too
                floor = np.partition(score, len(x) - n, axis=1)[:, len(x) - n] - 1e-14 * dims * longest * np.sqrt((q * q).sum(axis=1))
                for i, own in enumerate(part["id"].tolist()):
                    close = np.flatnonzero((score[i] >= floor[i]) & np.isfinite(score[i]))
                    exact = np.cumsum(x[close] * q[i], axis=1)[:, -1]
                    # of k + 1 entries by score and smallest id, k ids at least are others
                    order = np.lexsort((least[close], -exact))[: k + 1]
                    found = [(-exact[j], v) for j in order.tolist() for v in ids[close[j]] if v != own]
                    out += [(own, v, -value) for value, v in heapq.nsmallest(k, found)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = sent.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bulk-synchronous best fit: documents and gaps (what is left of the open sequences) are
range-sorted by length together, in ranges that hold equal numbers; a sweep over each range
gives every gap the largest documents that it holds, that is, every document the smallest
gap that is its successor in the order.  What a range leaves, documents too long for its
gaps and gaps without a shorter document, is matched across ranges by rank, from counts
of each range alone.  Gaps are updated, and the rounds go on until all documents are placed; a round
that places none opens as many sequences as the rest must have at least.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import strings, written

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Texts of other characters, or with very long words, go to the reference tokenizer; on
#: these two libraries agree, and the other one is four times faster.
_UNUSUAL = re.compile(r"[^\n\x20-\x7e¡-¬®-ɏ]")
_LONG_WORD = 200

_loaded: dict = {}


def _encoders(tokenizer_path: str, ranks_path: str | None):
    key = (tokenizer_path, ranks_path)
    if key not in _loaded:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(tokenizer_path)
        fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _loaded[key] = slow, fast
    return _loaded[key]


def encode(text: str, tokenizer_path: str, ranks_path: str | None) -> list[int]:
    """The ids of ``text``, without special tokens added."""
    slow, fast = _encoders(tokenizer_path, ranks_path)
    if fast is None or _UNUSUAL.search(text) or "<|endoftext|>" in text or max(map(len, text.split()), default=0) > _LONG_WORD:
        return slow.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than the rest."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, (starts[i + 1] if i + 1 < len(starts) else n) - s) for i, s in enumerate(starts)]


def successor_sweep(sizes: list[int], is_gap: list[bool]) -> tuple[list[tuple[int, int]], list[int], list[int], list[tuple[int, int]]]:
    """One sweep over documents and gaps in order of size, documents before gaps of their size.

    Returns (document, gap) matches, the documents left, the gaps left, and (gap, room) for
    the gaps that took a document; all as positions, ascending.  A gap takes the largest
    document before it that no earlier gap took, and goes on while the next one fits too.
    """
    waiting: list[int] = []
    matches, free, used = [], [], []
    for i, (size, gap) in enumerate(zip(sizes, is_gap)):
        if not gap:
            waiting.append(i)
            continue
        room = size
        while waiting and sizes[waiting[-1]] <= room:
            d = waiting.pop()
            matches.append((d, i))
            room -= sizes[d]
        if room == size:
            free.append(i)
        else:
            used.append((i, room))
    return matches, waiting, free, used


def across(left: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Matches between partitions, from (part, documents, largest, gaps, smallest) of what each has left.

    Returns (part of documents, first rank, end rank, part of gaps, first gap, documents a gap):
    ranks count documents from the largest, gaps count from the smallest.  A partition's
    gaps take documents of the nearest partition before it, several each where the
    smallest gap holds so many of the largest document.
    """
    waiting: list[list[int]] = []  # part, next rank, documents, largest
    out = []
    for part, docs, largest, gaps, smallest in sorted(left):
        at = 0
        while at < gaps and waiting:
            own = waiting[-1]
            each = max(1, smallest // own[3])
            taken = min(own[2] - own[1], (gaps - at) * each)
            out.append((own[0], own[1], own[1] + taken, part, at, each))
            at += -(-taken // each)
            own[1] += taken
            if own[1] == own[2]:
                waiting.pop()
        if docs:
            waiting.append([part, 0, docs, largest])
    return out


_ROW = "part int, kind int, key long, size int, at long, seq long"
_PLACED, _DOC, _FREE, _USED, _SUMMARY = range(5)
#: Documents and gaps of a range (16 bytes each).
RANGE_ROWS = 20_000


def _sweep_range(key, table):
    """The documents and gaps (key, size, gap) of one range: placed documents, documents and gaps left, and one summary."""
    rows = table.sort_by([("size", "ascending"), ("gap", "ascending"), ("key", "ascending")])
    number, size, gap = (rows[c].to_numpy() for c in ("key", "size", "gap"))
    matches, docs, free, used = successor_sweep(size.tolist(), gap.tolist())
    d, g = (np.array([x[k] for x in matches], dtype=np.int64) for k in (0, 1))
    u = np.array([x[0] for x in used], dtype=np.int64)
    # the summary: documents left with the largest, gaps left with the smallest
    parts = [(_SUMMARY, [len(docs)], [size[docs[-1]] if docs else 0], [len(free)], [size[free[0]] if free else 0])]
    parts.append((_PLACED, number[d], size[d], np.zeros(len(d)), number[g]))
    parts.append((_DOC, number[docs], size[docs], np.arange(len(docs))[::-1], np.zeros(len(docs))))
    parts.append((_FREE, number[free], size[free], np.arange(len(free)), np.zeros(len(free))))
    parts.append((_USED, number[u], [x[1] for x in used], np.zeros(len(u)), np.zeros(len(u))))
    columns = {
        "part": (np.concatenate([np.full(len(x[1]), key[0].as_py()) for x in parts]), pa.int32()),
        "kind": (np.concatenate([np.full(len(x[1]), x[0]) for x in parts]), pa.int32()),
    }
    for k, (name, kind) in enumerate((("key", pa.int64()), ("size", pa.int32()), ("at", pa.int64()), ("seq", pa.int64())), 1):
        columns[name] = np.concatenate([np.asarray(x[k], dtype=np.int64) for x in parts]), kind
    return pa.table({name: pa.array(v, t) for name, (v, t) in columns.items()})


def ranges_of(counts: dict[tuple[int, bool], int], most: int) -> list[tuple[int, bool, int, int]]:
    """(size, gap, first, parts): ranges of about ``most`` rows over classes in order.

    A larger class has several ranges to itself, so that many equal lengths are no hot one.
    """
    out, at, held = [], 0, 0
    for (size, gap), n in sorted(counts.items()):
        if held and held + n > most:
            at, held = at + 1, 0
        parts = -(-n // most)
        out.append((size, gap, at, parts))
        held += n
        if n > most:
            at, held = at + parts, 0
    return out


def best_fit(sizes: DataFrame, capacity: int) -> DataFrame:
    """(key, seq, offset): places of (key, size) in sequences of ``capacity``.

    Keys are distinct, sizes from 1 to ``capacity``.  Documents over half the capacity open
    a sequence each, named by their key; other sequences have negative numbers.  Only
    counts by length (at most ``capacity`` each) and by range come to the driver.
    """
    spark = sizes.sparkSession
    small = F.col("size") * 2 <= capacity
    docs, big = sizes.where(small), sizes.where(~small)
    placed = [big.select("key", F.col("key").alias("seq"), "size")]
    gaps = big.select("key", (capacity - F.col("size")).cast("int").alias("size")).where("size > 0")
    opened, before = 0, None
    while True:
        both = docs.select("key", "size", F.lit(False).alias("gap")).unionByName(gaps.select("key", "size", F.lit(True).alias("gap")))
        counts = {(r["size"], r["gap"]): r["count"] for r in both.groupBy("size", "gap").count().collect()}
        left = {size: n for (size, gap), n in counts.items() if not gap}
        if not left:
            break
        tokens, least = sum(size * n for size, n in left.items()), min(left)
        # no document left fits a smaller gap
        counts = {c: n for c, n in counts.items() if not c[1] or c[0] >= least}
        both = both.where(~F.col("gap") | (F.col("size") >= least))
        new = 0
        if before is None:
            new = -(-max(0, tokens - sum(size * n for (size, gap), n in counts.items() if gap)) // capacity)
        elif sum(left.values()) == before:
            new = -(-tokens // capacity)
        if new:  # sequences that the documents left need at least
            more = spark.range(opened, opened + new).select((-F.col("id") - 1).alias("key"), F.lit(capacity).cast("int").alias("size"), F.lit(True).alias("gap"))
            both, opened = both.unionByName(more), opened + new
            counts[capacity, True] = counts.get((capacity, True), 0) + new
        before = sum(left.values())
        ranges = F.broadcast(spark.createDataFrame(ranges_of(counts, RANGE_ROWS), "size int, gap boolean, first int, parts int"))
        dealt = both.join(ranges, ["size", "gap"]).withColumn("part", F.col("first") + F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        swept = written(dealt.select("part", "key", "size", "gap").groupBy("part").applyInArrow(_sweep_range, _ROW), "swept")
        kind = lambda k: swept.where(F.col("kind") == k)
        # one row a range
        hits = across([(r["part"], r["key"], r["size"], r["at"], r["seq"]) for r in kind(_SUMMARY).collect()])
        now = kind(_PLACED).select("key", "seq", "size")
        docs, gaps = kind(_DOC), kind(_USED).select("key", "size")
        free = kind(_FREE).select("part", "at", "key", "size")
        if hits:
            table = F.broadcast(spark.createDataFrame(hits, "part int, lo long, hi long, gap_part int, first long, each long"))
            met = docs.join(table, "part").where("at >= lo and at < hi")
            met = met.select(F.col("gap_part").alias("part"), F.expr("first + (at - lo) div each").alias("at"), F.struct("key", "size").alias("doc"))
            taken = met.groupBy("part", "at").agg(F.collect_list("doc").alias("docs"))  # what one gap holds
            free = written(free.join(taken, ["part", "at"], "left"), "taken")
            now = now.unionByName(free.select(F.explode("docs").alias("doc"), F.col("key").alias("seq")).select("doc.key", "seq", "doc.size"))
            rest = F.aggregate(F.coalesce("docs", F.array().cast("array<struct<key:bigint,size:int>>")), F.col("size"), lambda acc, x: acc - x["size"])
            free = free.select("key", rest.alias("size"))
            gone = F.broadcast(spark.createDataFrame(list({h[0]: h[2] for h in sorted(hits)}.items()), "part int, end long"))
            docs = docs.join(gone, "part", "left").where("end is null or at >= end")
        placed.append(now)
        gaps = gaps.unionByName(free.select("key", "size")).where("size > 0")
        docs = docs.select("key", "size")
    out = placed[0]
    for one in placed[1:]:
        out = out.unionByName(one)
    earlier = F.expr("sum(size) over (partition by seq order by size desc, key rows between unbounded preceding and 1 preceding)")
    return out.select("key", "seq", F.coalesce(earlier, F.lit(0)).cast("long").alias("offset"))


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    tokenizer_path: str | None = None,
    ranks_path: str | None = None,
    keep_ids: bool = True,
) -> DataFrame:
    """Pieces of the documents with their places: one row per piece.

    Columns: the id, piece, start, length, ids_crc32, ids (only with ``keep_ids``),
    sequence_id and offset.  A null or empty text is the end id alone.  Repeated rows and
    rows without an id are packed once each.  An empty table gives an empty one.  Other
    columns are left out, so none clashes; an id column must not bear one of these names.
    ``tokenizer_path`` defaults to the public byte-level vocabulary; ``ranks_path`` may
    name the same vocabulary as ranks, for the faster library.
    """
    own = ["piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    if id_col.lower() in own:
        raise ValueError(f"the id column {id_col!r} has the name of a column of the result")
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path, ranks_path = public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)

    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType)]
        + [T.StructField(c, t) for c, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))]
        + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else [])
    )

    def tokenise(batches):
        for batch in batches:
            rows, piece, start, length, crc, ids_out = [], [], [], [], [], []
            for i, text in enumerate(strings(batch, 1)):
                ids = np.array(encode(text or "", tokenizer_path, ranks_path) + [end_id], dtype="<u4")
                for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                    own = ids[s : s + n]
                    rows.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(own.tobytes()))
                    if keep_ids:
                        ids_out.append(own.astype("int32"))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            if keep_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    # keys are given once, when the pieces are written
    pieces = written(docs.select(id_col, text_col).mapInArrow(tokenise, schema).withColumn("__pk_key", F.monotonically_increasing_id()), "pieces")
    part = pieces.where(F.col("length") < capacity)
    places = best_fit(part.select(F.col("__pk_key").alias("key"), F.col("length").cast("int").alias("size")), capacity)
    whole = pieces.where(F.col("length") == capacity).select(*schema.names, F.col("__pk_key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    shared = part.join(places, part["__pk_key"] == places["key"]).select(*schema.names, F.col("seq").alias("sequence_id"), "offset")
    return whole.unionByName(shared)

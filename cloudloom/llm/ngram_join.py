"""Exact Jaccard self-join of documents' word-shingle sets, as connected classes.

Equal sets are one node.  Every set is sorted in one global order, frequent shingles
last, and its first elements (the prefix) are indexed: sets similar enough share an
element of their prefixes.  Index lists are in blocks by set size; an entry is sent only
to the blocks that its size and its position in its set leave open, the others are
skipped.  Links between highly similar sets are found first: sets that vary one text are
compared with that text, those not linked to it with each other as matrices, and other
lists with a few of their sets only.  The classes found then answer for their members,
and the lists are searched again only across classes.  An
upper bound on the overlap, from counts of the elements' hash ranges, drops most
candidates before any two sets meet; the rest are verified on whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, strings, written
from .graph import components

#: Shingles among the first elements (twice the prefix) of more sets than this go to the
#: end of the order, at most MAX_FREQUENT of them (8 bytes each).  Both only steer the
#: work: any order gives the same links.
FREQUENT, MAX_FREQUENT = 16, 1_000_000
#: Documents of at most this many ids (8 bytes each) are broadcast to fetch their sets.
BROADCAST_ROWS = 500_000
#: Sets around one text from which their pairs are compared in place, and the least size of
#: the blocks that they are compared in.
CLUSTER, CLUSTER_BLOCK = 64, 128
#: Hash ranges counted for the upper bound on the overlap.
RANGES = 64
#: Blocks of sizes within the ratio of the threshold.
SUB_BLOCKS = 4
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_LIST = pa.schema([("token", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; one for a shorter text, none for no words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six blanks only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(width, len(h))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        acc = acc * _M[j % len(_M)] + h[j : len(h) - k + 1 + j]
    return np.unique(_mix(acc))


def set_id(own: np.ndarray, shared: frozenset = frozenset()) -> tuple[int, int]:
    """A set's 64-bit id and 64 more bits, from all its elements.

    The other half is the id where the first one is of ``shared``, the ids that several
    different sets have.
    """
    first, second = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype=">i8").tolist()
    return (second, first) if first in shared else (first, second)


def ranges_of(own: np.ndarray) -> bytes:
    """Counts of a set's elements by hash range."""
    return np.bincount((own >> np.uint64(58)).astype(np.int64), minlength=RANGES).astype("<u4").tobytes()


class Threshold:
    """Bounds that 100 * intersection >= percent * union sets."""

    def __init__(self, percent: int):
        self.p = percent

    def probe(self, n: int) -> int:
        """Prefix of the larger set."""
        return n - -(-self.p * n // 100) + 1

    def index(self, n: int) -> int:
        """Prefix of the smaller set."""
        return n - -(-2 * self.p * n // (100 + self.p)) + 1

    def holds(self, both: int, nx: int, ny: int) -> bool:
        return 100 * both >= self.p * (nx + ny - both)


def _bounded(percent: int) -> str:
    """SQL: sizes nx <= ny and a shared element at i and j leave room for the overlap."""
    need = f"{percent} * (nx + ny)"
    return f"100 * nx >= {percent} * ny and {100 + percent} * least(nx - i, ny - j) >= {need}"


def ngram_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    frequent: int = FREQUENT,
    max_frequent: int = MAX_FREQUENT,
) -> DataFrame:
    """(id, n_shingles, component_id, n_members): the classes of documents linked by similarity.

    Two documents link where 100 * intersection >= ``percent`` * union of their sets of
    ``width``-word shingles (A-Z lower-cased); component_id is the smallest id reachable.
    A text with fewer words is one shingle; a null, empty or blank text has none and
    stays alone.  Repeated rows of one id link like copies.  A row without an id takes no
    part: its component_id is null.  An empty table gives an empty one.
    """
    with small_batches(docs.sparkSession):
        return _Join(docs, id_col, text_col, width, percent, frequent, max_frequent).classes()


class _Join:
    def __init__(self, docs, id_col, text_col, width, percent, frequent, max_frequent):
        self.spark = docs.sparkSession
        self.id_col, self.width, self.t = id_col, width, Threshold(percent)
        self.frequent, self.max_frequent = frequent, max_frequent
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        self.id_type = docs.schema[id_col].dataType.simpleString()
        self.shared: frozenset = frozenset()

    def members(self) -> DataFrame:
        """(id, sid, more, n, ranges, prefix): every document's set; its first elements, once per set and task."""
        width, t, shared = self.width, self.t, self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                sid, more, n, ranges, prefix = [], [], [], [], []
                for text in strings(batch, 1):
                    own = shingle_set(text, width)
                    n.append(len(own))
                    key, rest = set_id(own, shared) if len(own) else (None, None)
                    sid.append(key)
                    more.append(rest)
                    new = key is not None and key not in seen
                    if new:
                        seen.add(key)
                    ranges.append(ranges_of(own) if new else None)
                    prefix.append(own[: 2 * t.probe(len(own))].view(np.int64) if new else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sid, pa.int64()), pa.array(more, pa.int64()), pa.array(n, pa.int32()), pa.array(ranges, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))],
                    names=["id", "sid", "more", "n", "ranges", "prefix"],
                )

        return self.docs.mapInArrow(run, f"id {self.id_type}, sid long, more long, n int, ranges binary, prefix array<long>")

    def members_and_nodes(self) -> tuple[DataFrame, DataFrame]:
        """``members`` and (sid, id, n, ranges), a row for every different set.

        Sets are told apart by 128 bits.  Where different ones share the 64 bits of the id,
        some in 10^10 documents, all but their other half is computed again.
        """
        while True:
            members = written(self.members(), "members")
            of_sets = members.where("sid is not null and id is not null")
            nodes = of_sets.groupBy("sid").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("ranges").alias("ranges"), F.min("more").alias("lo"), F.max("more").alias("hi"))
            nodes = written(nodes, "nodes")
            clash = [r[0] for r in nodes.where("lo <> hi").select("sid").toLocalIterator()]
            if not clash:
                return members, nodes.drop("lo", "hi")
            self.shared |= frozenset(clash)
            discard(members, nodes)

    def index(self, hot: np.ndarray) -> DataFrame:
        """(token, sid, n, pos) of all prefixes in the order (frequent, hash); lists of one set are left out."""
        width, t, clash = self.width, self.t, self.shared
        shared = self.spark.sparkContext.broadcast(hot)

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            late = shared.value
            seen: set[int] = set()
            for batch in batches:
                token, sid, size = [], [], []
                for text in strings(batch, 1):
                    own = shingle_set(text, width)
                    if not len(own) or (key := set_id(own, clash)[0]) in seen:
                        continue
                    seen.add(key)
                    p = t.probe(len(own))
                    if len(late):
                        at = np.searchsorted(late, own)
                        at[at == len(late)] = 0
                        is_late = late[at] == own
                        if is_late[:p].any():
                            own = np.concatenate([own[~is_late], own[is_late]])
                    token.append(own[:p].view(np.int64))
                    sid.append(key)
                    size.append((len(own), p))
                if token:
                    ps = np.array([p for _, p in size])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(token)),
                            pa.array(np.repeat(np.array(sid, np.int64), ps)),
                            pa.array(np.repeat(np.array([n for n, _ in size], np.int32), ps)),
                            pa.array(np.concatenate([np.arange(p, dtype=np.int32) for p in ps])),
                        ],
                        schema=_LIST,
                    )

        def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by (token, sid); a list's end may lie in a later batch."""
            held = pa.table({f.name: pa.array([], f.type) for f in _LIST})
            open_token = None  # of a list whose rows have begun to go out

            def shared_rows(rows: pa.Table, last: bool):
                nonlocal open_token
                token, sid = rows["token"].to_numpy(), rows["sid"].to_numpy()
                keep = np.r_[True, (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])]
                rows, token, sid = rows.filter(pa.array(keep)), token[keep], sid[keep]
                starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
                runs = np.diff(np.r_[starts, len(token)])
                tail = 0 if last else (runs[-1] if runs[-1] < 50_000 else 0)
                many = np.repeat(runs > 1, runs) | (token == open_token if open_token is not None else False)
                if tail:
                    out, rest = rows.slice(0, len(rows) - tail).filter(pa.array(many[: len(rows) - tail])), rows.slice(len(rows) - tail)
                else:
                    out, rest = rows.filter(pa.array(many)), rows.slice(0, 0)
                    open_token = token[-1]
                return out, rest

            for batch in batches:
                held = pa.concat_tables([held, pa.Table.from_batches([batch.cast(_LIST) if batch.schema != _LIST else batch])])
                if len(held) > 200_000:
                    out, held = shared_rows(held, False)
                    yield from out.combine_chunks().to_batches()
            if len(held):
                yield from shared_rows(held, True)[0].combine_chunks().to_batches()

        schema = "token long, sid long, n int, pos int"
        dealt = self.docs.where("id is not null").mapInArrow(entries, schema).repartition("token").sortWithinPartitions("token", "sid")
        return dealt.mapInArrow(lists, schema)

    def size_block(self, n: Column) -> Column:
        """Blocks of sizes on a logarithmic scale, SUB_BLOCKS of them for the ratio of the threshold."""
        ratio = math.log(100 / self.t.p) if self.t.p < 100 else 1.0
        return F.floor(F.log(F.greatest(n, F.lit(1.0))) / (ratio / SUB_BLOCKS)).cast("int")

    def possible(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (a, b) whose counts by hash range allow the overlap."""
        t = self.t
        side = lambda c: nodes.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("ranges").alias(f"r{c}"))
        joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                na, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
                ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, RANGES) for i in (4, 5))
                most = np.minimum(ra, rb).sum(axis=1).astype(np.int64)
                ok = pa.array(100 * most >= t.p * (na + nb - most))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

        return joined.mapInArrow(run, "a long, b long")

    def sets_of(self, sids: DataFrame, nodes: DataFrame) -> DataFrame:
        """(sid, elements) of the given sets, from the whole texts of one document each."""
        width, clash = self.width, self.shared
        ids = written(sids.join(nodes, "sid").select("id").distinct(), "wanted")
        if ids.count() <= BROADCAST_ROWS:
            ids = F.broadcast(ids)

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = {}
                for text in strings(batch, 1):
                    own = shingle_set(text, width)
                    if len(own):
                        got[set_id(own, clash)[0]] = own.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.binary())], names=["sid", "elements"])

        found = self.docs.join(ids, "id", "left_semi").mapInArrow(sets, "sid long, elements binary")
        return written(found.groupBy("sid").agg(F.first("elements").alias("elements")), "sets")

    def verified(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (a, b) that hold on whole sets."""
        t = self.t
        table = self.sets_of(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), nodes)
        side = lambda c: table.select(F.col("sid").alias(c), F.col("elements").alias(f"e{c}"))
        joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ea", "eb")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = []
                for ea, eb in zip(batch.column(2), batch.column(3)):
                    x, y = np.frombuffer(ea.as_py(), np.uint64), np.frombuffer(eb.as_py(), np.uint64)
                    ok.append(t.holds(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
                ok = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

        return joined.mapInArrow(run, "a long, b long")

    def clusters(self, shared: DataFrame, weight: DataFrame) -> DataFrame:
        """(sid, cluster, m, parts): sets gathered around the text that they vary, CLUSTER or more of them.

        A list's hub is its set of most weight; a set belongs to its heaviest hub.  They are
        compared in blocks; ``parts`` is the number of blocks.
        """
        lists = shared.join(weight, "sid").groupBy("token").agg(F.max(F.struct("weight", "sid")).alias("hub"), F.count("*").alias("m")).where(f"m >= {CLUSTER}")
        own = shared.join(lists, "token").groupBy("sid").agg(F.max("hub").alias("hub")).select("sid", F.col("hub.sid").alias("cluster"))
        own = written(own, "hubs")
        sizes = own.groupBy("cluster").agg(F.count("*").alias("m")).where(f"m >= {CLUSTER}")
        block = F.least(F.greatest(F.lit(CLUSTER_BLOCK), F.sqrt("m") * 3), F.lit(2000))
        return written(own.join(sizes, "cluster").select("sid", "cluster", "m", F.ceil(F.col("m") / block).cast("int").alias("parts")), "clusters")

    def within(self, clusters: DataFrame, nodes: DataFrame) -> DataFrame:
        """Links (a, b) inside clusters, as forests.

        Every set is compared with its hub first.  Those not linked to it are compared with
        all sets of their cluster, block by block, as matrices; sets that both are linked
        to the hub need no comparison.
        """
        t = self.t
        table = self.sets_of(clusters.select("sid").union(clusters.select("cluster")).distinct(), nodes)
        part = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
        cell = lambda i, j, left: (F.col("cluster"), i.alias("i"), j.alias("j"), F.lit(left).alias("left"), F.col("sid"), F.col("elements"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        zero = F.lit(0)

        def compare(rows):
            sid, is_left = rows["sid"].to_numpy(), rows["left"].to_numpy(dtype=bool)
            left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
            sets = [np.frombuffer(e, np.uint64) for e in rows["elements"]]
            size = np.array([len(x) for x in sets], dtype=np.int64)
            _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(sets)), size)
            shared = times[column] > 1  # an element of one set only adds nothing
            row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
            both = np.zeros((len(left), len(right)), np.float32)
            for lo in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
                now = (column >= lo) & (column < lo + 4096)
                m = np.zeros((len(sets), 4096), np.float32)
                m[row[now], column[now] - lo] = 1
                both += m[left] @ m[right].T
            both = both.astype(np.int64)
            ok = 100 * both >= t.p * (size[left][:, None] + size[right][None, :] - both)
            root = list(range(len(sets)))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            out = []
            first = {int(v): k for k, v in enumerate(sid)}  # a set may be on both sides
            for x, y in zip(*np.nonzero(ok)):
                a, b = int(sid[left[x]]), int(sid[right[y]])
                u, v = find(first[a]), find(first[b])
                if u != v:
                    root[u] = v
                    out.append((a, b))
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        def linked(left: DataFrame, right: DataFrame) -> DataFrame:
            return left.unionByName(right).groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long")

        # the hub goes to every block of its cluster, so that no task has all of a large one
        members = clusters.where("sid <> cluster")
        hubs = clusters.select("cluster", "parts").distinct().withColumn("sid", F.col("cluster")).join(table, "sid").withColumn("other", each("parts"))
        spokes = written(linked(hubs.select(*cell(zero, F.col("other"), True)), members.join(table, "sid").select(*cell(zero, part("parts"), False))), "spokes")
        apart = members.join(spokes.select(F.col("b").alias("sid"), F.col("a").alias("cluster")), ["sid", "cluster"], "left_anti")
        sizes = apart.groupBy("cluster").agg(F.ceil(F.count("*") * F.max("parts") / F.max("m")).cast("int").alias("rows"))
        open_ = clusters.join(sizes, "cluster").join(apart.select("sid", F.lit(True).alias("apart")), "sid", "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
        open_ = written(open_, "open")
        if not open_.take(1):
            return spokes
        own = open_.join(table, "sid")
        left = own.where("apart").withColumn("other", each("parts")).select(*cell(part("rows"), F.col("other"), True))
        right = own.withColumn("other", each("rows")).select(*cell(F.col("other"), part("parts"), False))
        return spokes.unionByName(linked(left, right))

    def classes(self) -> DataFrame:
        p = self.t.p
        members, nodes = self.members_and_nodes()
        tokens = members.where("id is not null").select(F.explode("prefix").alias("token")).groupBy("token").count()
        late = written(tokens.where(F.col("count") > self.frequent), "frequent")
        # the counts from which at most max_frequent shingles are left, from the histogram of counts
        least, held = self.frequent + 1, 0
        for r in late.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).toLocalIterator():
            held += r["n"]
            if held > self.max_frequent:
                least = r["count"] + 1
                break
        late = late.where(F.col("count") >= least).select("token")
        hot = np.sort(np.array([r[0] for r in late.toLocalIterator()], dtype=np.int64).view(np.uint64))
        index = written(self.index(hot), "index")

        # Blocks of sizes on a logarithmic scale: similar sets are in one block or in neighbouring
        # ones, with a margin for rounding where their sizes are just within the threshold.
        ratio = math.log(100 / p) * (1 + 1e-9) if p < 100 else 1.0
        block = F.floor(F.log(F.col("n")) / ratio).cast("int")
        blocks = index.withColumn("block", block)
        # answers of highly similar sets first: each block against three of its sets, the one
        # whose shingles are in the most lists (the text that the others vary) and two by hash
        lens = blocks.groupBy("token", "block").agg(F.count("*").alias("m")).where("m > 1")
        shared = written(blocks.join(lens, ["token", "block"]), "shared")
        weight = shared.groupBy("sid").agg(F.sum("m").alias("weight"))
        pick = lambda *by: F.max(F.struct(*by, "sid", "n"))
        clusters = self.clusters(shared, weight)
        inner = written(self.within(clusters, nodes), "inner") if clusters.take(1) else None
        centres = shared.join(weight, "sid").groupBy("token", "block").agg(
            pick("weight").alias("c0"),
            pick(F.xxhash64(F.lit(1), "sid")).alias("c1"),
            pick(F.xxhash64(F.lit(2), "sid")).alias("c2"),
        )
        centres = centres.select("token", "block", F.array(*[F.struct(f"c{k}.sid", f"c{k}.n") for k in range(3)]).alias("cs"))
        star = shared.join(centres, ["token", "block"]).withColumn("c", F.explode(F.array_distinct("cs"))).where("sid <> c.sid")
        star = star.where(f"100 * least(n, c.n) >= {p} * greatest(n, c.n)")
        star = star.select(F.least("sid", "c.sid").alias("a"), F.greatest("sid", "c.sid").alias("b")).distinct()
        if inner is not None:
            side = lambda c: clusters.select(F.col("sid").alias(c), F.col("cluster").alias(f"k{c}"))
            star = star.join(side("a"), "a", "left").join(side("b"), "b", "left").where("ka is null or kb is null or ka <> kb").select("a", "b")
        star = written(self.possible(written(star, "star"), nodes), "possible")
        links = written(self.verified(star, nodes), "links")
        if inner is not None:
            links = links.unionByName(inner)
        roots = written(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "roots")

        # then only what lies across the classes found
        named = blocks.join(roots, blocks["sid"] == roots["node"], "left").select("token", "sid", "n", "pos", F.coalesce("root", "sid").alias("root"))
        named = named.join(clusters.select("sid", "cluster"), "sid", "left").withColumn("cluster", F.coalesce("cluster", "sid"))
        named = written(named, "named")
        discard(index, shared)
        mixed = named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
        mixed = written(named.join(mixed, "token", "left_semi"), "mixed")
        discard(named)
        short = mixed.where(f"pos < n - ceil({2 * p} * n / {100 + p}) + 1").select(
            "token", self.size_block(F.col("n")).alias("block"), F.col("sid").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("i"), F.col("root").alias("rx"), F.col("cluster").alias("kx")
        )
        # the sizes nx <= ny that a set of ny leaves open at its position j
        smallest = F.col("n") * (p / 100)
        largest = F.least(F.col("n").cast("double"), (F.col("n") - F.col("pos")) * ((100 + p) / p) - F.col("n"))
        wide = 1e-9
        reach = F.sequence(self.size_block(smallest * (1 - wide)), self.size_block(largest * (1 + wide)))
        long = mixed.where(largest * (1 + wide) >= F.greatest(smallest, F.lit(1.0))).select("token", F.explode(reach).alias("block"), F.col("sid").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("j"), F.col("root").alias("ry"), F.col("cluster").alias("ky"))
        met = short.join(long, ["token", "block"]).where("rx <> ry and kx <> ky and (nx < ny or (nx = ny and x < y))").where(_bounded(p))
        pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
        pairs = written(self.possible(written(pairs, "pairs"), nodes), "possible")
        discard(mixed)
        if pairs.take(1):
            links = links.unionByName(written(self.verified(pairs, nodes), "links"))
            roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

        # a class's id is the smallest document id of its sets
        top = nodes.join(roots, nodes["sid"] == roots["node"], "left").select("sid", F.coalesce("root", "sid").alias("root"), "id")
        least = top.groupBy("root").agg(F.min("id").alias("component_id"))
        by_set = written(top.join(least, "root").select("sid", "component_id"), "by-set")
        out = members.join(by_set, "sid", "left").select(
            F.col("id").alias(self.id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")
        )
        return out

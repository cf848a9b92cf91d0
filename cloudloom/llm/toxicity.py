"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the mean of the embeddings of its hashed parts (the word and its
beginnings), so that unseen words have one too.  Filters of several widths slide over
the words; the largest activations of each filter are pooled and a logistic unit gives
the score.  The network is trained in numpy on the driver's machine, on a bounded sample
of labelled rows, in a process of its own whose memory goes with it; scoring is one pass
over the documents, without a shuffle.  Thresholds are calibrated by language on the
scores of all labelled rows.
"""

from __future__ import annotations

import ctypes
import gc
import os
import pickle
import re
import subprocess
import sys
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, strings, written

BUCKETS, DIMS, FILTERS = 1 << 15, 16, 8
WIDTHS = (1, 2, 3)
#: Activations are pooled as the mean of the largest 1, 4 and 16.
POOLS = (1, 4, 16)
PARTS = (3, 4, 5, 6, 7, 8, 10)
#: Bounds on the labelled rows that the network is fitted on.
MAX_TOXIC, MAX_CLEAN = 1000, 2000
#: Words whose projections a worker holds before it starts afresh.
_CACHE_WORDS = 120_000
_WORD = re.compile(r"[^\W_]+")
_held: dict[str, tuple[dict[str, int], list[np.ndarray]]] = {}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def parts_of(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    raw = [f"<{word[:40]}>"] + [f"<{word[:n]}" for n in PARTS if len(word) >= n]
    return [zlib.crc32(x.encode()) % BUCKETS for x in raw]


@dataclass
class Model:
    """The network's weights, the thresholds by language ('' for any other), and, for their
    calibration, the ids it was fitted on with counts of their scores by (language, label,
    hundredth), each from a network fitted on the others."""

    emb: np.ndarray
    conv: dict[int, np.ndarray]  # width -> (width, DIMS, FILTERS)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    thresholds: dict[str, float] = field(default_factory=dict)
    fitted: list = field(default_factory=list)
    folds: Counter = field(default_factory=Counter)

    def table(self, parts: list[list[int]]) -> np.ndarray:
        """Projections of words on every filter and offset: (words, offsets * FILTERS)."""
        n = [len(p) for p in parts]
        flat = self.emb[np.fromiter((i for p in parts for i in p), dtype=np.int64, count=sum(n))]
        at = np.r_[0, np.cumsum(n)[:-1]].astype(np.int64)
        words = np.add.reduceat(flat, at, axis=0) / np.array(n, dtype=np.float32)[:, None]
        return words @ np.concatenate([self.conv[w][j] for w in WIDTHS for j in range(w)], axis=1)

    def activations(self, rows: np.ndarray) -> np.ndarray:
        """ReLU activations of a document, (positions, widths * FILTERS), from its words' projections."""
        n, at, out = len(rows), 0, []
        for w in WIDTHS:
            z = rows[:, at * FILTERS : (at + 1) * FILTERS] + self.bias[w]
            for j in range(1, w):
                z[: n - j] += rows[j:, (at + j) * FILTERS : (at + j + 1) * FILTERS]
            at += w
            out.append(z)
        return np.maximum(np.concatenate(out, axis=1), 0.0)

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(pooled @ self.out, -30, 30)))


def pool(z: np.ndarray, with_places: bool = False):
    """Means of the largest activations of each filter, the log length and a one."""
    n, f = z.shape
    k = POOLS[-1]
    if n < k:
        z = np.concatenate([z, np.zeros((k - n, f), np.float32)])
    if with_places:
        places = np.argpartition(-z, k - 1, axis=0)[:k]
        top = np.take_along_axis(z, places, axis=0)
        order = np.argsort(-top, axis=0, kind="stable")
        top, places = np.take_along_axis(top, order, axis=0), np.take_along_axis(places, order, axis=0)
    else:
        top = -np.sort(-np.partition(z, len(z) - k, axis=0)[len(z) - k :], axis=0)
    feats = np.concatenate([top[:m].mean(axis=0) for m in POOLS] + [np.array([np.log1p(n) / 10.0, 1.0], np.float32)])
    return (feats, places, top) if with_places else feats


def gradients(model: Model, docs: list[np.ndarray], parts: list[list[int]], y: np.ndarray, weights: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """Gradients of the weighted mean log loss over documents of word numbers.

    Returns those of the output, filters and biases by name, and the rows of the
    embeddings that change, with theirs.
    """
    width_of = [w for w in WIDTHS for _ in range(w)]
    offset_of = [j for w in WIDTHS for j in range(w)]
    used = np.unique(np.concatenate(docs or [np.zeros(0, int)]))
    local = [parts[i] for i in used]
    rows = model.table(local) if len(used) else np.zeros((0, len(width_of) * FILTERS), np.float32)
    grad = {"out": np.zeros_like(model.out, dtype=np.float64)}
    grad |= {f"c{w}": np.zeros_like(model.conv[w], dtype=np.float64) for w in WIDTHS}
    grad |= {f"b{w}": np.zeros_like(model.bias[w], dtype=np.float64) for w in WIDTHS}
    g_rows = np.zeros_like(rows)
    scale = 1.0 / weights.sum()
    for words, label, weight in zip(docs, y, weights):
        idx = np.searchsorted(used, words)
        z = model.activations(rows[idx])
        feats, places, top = pool(z, with_places=True)
        g = weight * scale * (model.score(feats) - label)
        grad["out"] += g * feats
        back = np.zeros_like(top, dtype=np.float64)
        for m, part in zip(POOLS, np.split(model.out[:-2], len(POOLS))):
            back[:m] += g * part / m
        back = back * (top > 0)
        n = len(idx)
        for a in range(len(width_of)):
            w, j = width_of[a], offset_of[a]
            cols = slice(WIDTHS.index(w) * FILTERS, (WIDTHS.index(w) + 1) * FILTERS)
            if j == 0:
                grad[f"b{w}"] += back[:, cols].sum(axis=0)
            at = places[:, cols] + j
            ok = at < n
            if ok.any():
                cc = np.broadcast_to(np.arange(a * FILTERS, (a + 1) * FILTERS), at.shape)[ok]
                np.add.at(g_rows, (idx[at[ok]], cc), back[:, cols][ok])
    hit = np.flatnonzero(g_rows.any(axis=1))
    if not len(hit):
        return grad, np.zeros(0, np.int64), np.zeros((0, DIMS))
    size = np.array([len(local[i]) for i in hit])
    flat = np.concatenate([local[i] for i in hit]).astype(np.int64)
    words = np.add.reduceat(model.emb[flat], np.r_[0, np.cumsum(size)[:-1]], axis=0) / size[:, None]
    g_words = np.zeros((len(hit), DIMS))
    for a in range(len(width_of)):
        w, j = width_of[a], offset_of[a]
        own_rows = g_rows[hit, a * FILTERS : (a + 1) * FILTERS]
        grad[f"c{w}"][j] += words.T @ own_rows
        g_words += own_rows @ model.conv[w][j].T
    touched, inverse = np.unique(flat, return_inverse=True)
    g_emb = np.zeros((len(touched), DIMS))
    np.add.at(g_emb, inverse, np.repeat(g_words / size[:, None], size, axis=0))
    return grad, touched, g_emb


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, epochs: int = 6, seed: int = 7) -> Model:
    """The network fitted to texts with labels 0 and 1; embeddings start from log-odds."""
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], dtype=np.int64) for t in texts]
    parts = [parts_of(w) for w in vocab]
    y = labels.astype(np.float64)
    emb = (rng.normal(size=(BUCKETS, DIMS)) * 0.05).astype(np.float32)
    counts = np.zeros((2, BUCKETS))
    for own, label in zip(docs, labels):
        if len(own):
            found = np.unique(np.concatenate([parts[i] for i in np.unique(own)]))
            counts[int(label), found] += 1
    total = np.array([(labels == 0).sum(), (labels == 1).sum()]) + 1.0
    odds = np.log((counts[1] + 0.5) / total[1]) - np.log((counts[0] + 0.5) / total[0])
    emb[:, 0] = np.where(counts.sum(axis=0) >= 4, np.clip(odds, -1.0, 4.0), 0.0)
    conv = {w: (rng.normal(size=(w, DIMS, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        conv[w][:, 0, : FILTERS // 2] = 1.0 / w
    bias = {w: np.zeros(FILTERS, np.float32) - np.linspace(0.0, 2.0, FILTERS).astype(np.float32) for w in WIDTHS}
    n_out = len(WIDTHS) * FILTERS * len(POOLS) + 2
    out = np.zeros(n_out)
    model = Model(emb, conv, bias, out)
    params = {"out": out, **{f"c{w}": conv[w] for w in WIDTHS}, **{f"b{w}": bias[w] for w in WIDTHS}}
    first = {k: np.zeros_like(v, dtype=np.float64) for k, v in params.items()}
    second = {k: np.zeros_like(v, dtype=np.float64) for k, v in params.items()}
    seen = np.zeros(BUCKETS)
    step = 0
    batch = max(32, min(200, len(docs) // 8 or 32))
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(docs), batch):
            own = order[lo : lo + batch]
            grad, touched, g_emb = gradients(model, [docs[i] for i in own], parts, y[own], weights[own])
            if len(touched):
                seen[touched] += (g_emb**2).mean(axis=1)
                emb[touched] -= (0.02 * g_emb / (np.sqrt(seen[touched])[:, None] + 1e-8)).astype(np.float32)
            step += 1
            for k, v in params.items():
                g = grad[k] + (1e-3 * v if k == "out" else 1e-4 * v)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                v -= (0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(v.dtype)
    return model


def scores_of(model: Model, texts: Iterable[str | None], cache: dict[str, int], table: list[np.ndarray]) -> np.ndarray:
    """Scores of texts; ``cache`` and ``table`` hold the projections of the words met so far."""
    out = []
    for text in texts:
        words = words_of(text)
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if new:
            if len(cache) + len(new) > _CACHE_WORDS and cache:
                cache.clear()
                table.clear()
                new = list(dict.fromkeys(words))
            base = len(cache)
            rows = model.table([parts_of(w) for w in new]).astype(np.float32)
            if not table or base + len(rows) > len(table[0]):
                grown = np.zeros((max(4096, base + len(rows), min(2 * (base + len(rows)), _CACHE_WORDS)), rows.shape[1]), np.float32)
                if base:
                    grown[:base] = table[0][:base]
                table[:] = [grown]
            table[0][base : base + len(rows)] = rows
            cache.update((w, base + i) for i, w in enumerate(new))
        if words:
            z = model.activations(table[0][np.fromiter(map(cache.__getitem__, words), np.int64, len(words))])
        else:
            z = np.zeros((0, len(WIDTHS) * FILTERS), np.float32)
        out.append(model.score(pool(z)))
    return np.array(out)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that the labels are never learnt from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    lang_col: str | None = "lang",
    max_toxic: int = MAX_TOXIC,
    max_clean: int = MAX_CLEAN,
    epochs: int = 6,
    folds: int = 3,
) -> Model:
    """The classifier trained on a hash-ordered sample of the labelled, not held-out rows.

    At most ``max_toxic`` and ``max_clean`` rows; rows are weighted so that the classes
    keep their shares.  Several labels of an id count as toxic if one is.  Without labels
    of both classes every score is the share of toxic labels, or 0.  With ``folds`` the
    sample's rows are also scored by networks fitted on the other folds, for ``calibrate``.
    Texts leave the driver's process for the one that trains.
    """
    known = known_labels(labels, id_col, label_col)
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = None
    for value, most in ((1, max_toxic), (0, max_clean)):
        part = known.where(F.col("y") == value).orderBy(F.xxhash64(id_col), id_col).limit(most)
        picked = part if picked is None else picked.unionByName(part)
    lang = F.col(lang_col) if lang_col and lang_col in docs.columns else F.lit("")
    text = docs.where(f"`{id_col}` is not null").select(id_col, F.col(text_col).alias("t"), F.coalesce(lang, F.lit("")).alias("g"))
    rows = text.join(F.broadcast(picked), id_col).orderBy(F.xxhash64(id_col), id_col).limit(max_toxic + max_clean).collect()
    y = np.array([r["y"] for r in rows])
    share = shares.get(1, 0) / max(1, sum(shares.values()))
    if len(set(y.tolist())) < 2:
        flat = Model(np.zeros((BUCKETS, DIMS), np.float32), {w: np.zeros((w, DIMS, FILTERS), np.float32) for w in WIDTHS}, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, np.zeros(len(WIDTHS) * FILTERS * len(POOLS) + 2))
        flat.out[-1] = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        flat.thresholds = {"": 0.5}
        return flat
    per_class = np.array([(y == v).sum() for v in (0, 1)])
    weight = np.array([shares[0] / per_class[0], shares[1] / per_class[1]])[y]
    fold = np.arange(len(y)) % max(1, folds)
    tested = folds > 1 and min((y[fold != f] == 1).sum() for f in range(folds)) >= 10 and min((y[fold != f] == 0).sum() for f in range(folds)) > 0
    texts, about = [r["t"] or "" for r in rows], [(r[id_col], r["g"]) for r in rows]
    del rows
    job = pickle.dumps((texts, y, weight, fold, range(folds) if tested else [], epochs))
    del texts
    model, tests = _in_own_process(job)
    del job
    released()
    model.thresholds = {"": 0.5}
    model.fitted = [x for x, _ in about]
    for f, scores in enumerate(tests):
        for i, v in zip(np.flatnonzero(fold == f), scores):
            model.folds[about[i][1], int(y[i]), int(v * 100)] += 1
    return model


def fitted(job: bytes) -> tuple[Model, list[np.ndarray]]:
    """The network of a pickled sample, and the scores of each fold's rows by one fitted on the others."""
    texts, y, weight, fold, tested, epochs = pickle.loads(job)
    model, tests = train(texts, y, weight, epochs), []
    for f in tested:
        trial = train([t for t, o in zip(texts, fold) if o != f], y[fold != f], weight[fold != f], epochs)
        tests.append(scores_of(trial, [texts[i] for i in np.flatnonzero(fold == f)], {}, []))
    return model, tests


#: What is printed on the way goes to the errors, the result to the pipe.
_OWN = """
import os, pickle, sys
pipe = os.fdopen(os.dup(1), "wb")
os.dup2(2, 1)
from cloudloom.llm.toxicity import fitted
pickle.dump(fitted(sys.stdin.buffer.read()), pipe)
pipe.close()
"""


def _in_own_process(job: bytes) -> tuple[Model, list[np.ndarray]]:
    """``fitted`` in a process of its own: what training holds would stay with the driver otherwise."""
    env = os.environ | {"PYTHONPATH": os.pathsep.join(os.path.abspath(p) for p in sys.path)}
    return pickle.loads(subprocess.run([sys.executable, "-c", _OWN], input=job, stdout=subprocess.PIPE, env=env, check=True).stdout)


def released() -> None:
    """Give back the memory of the sample's texts."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def known_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y) of the ids that may be learnt from."""
    known = labels.where(f"`{label_col}` is not null and `{id_col}` is not null").groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    return known.where(~held_out(id_col)).where("y in (0, 1)")


def calibrate(scored: DataFrame, labels: DataFrame, model: Model, id_col: str = "doc_id", label_col: str = "toxic", lang_col: str = "lang") -> dict[str, float]:
    """Thresholds by language from scored rows (id, language, score) and all labels that are not held out.

    A language's threshold is the one of best F1, or that of all languages where it has
    under ten toxic rows; 0.5 without any.  Rows that the network was fitted on count with
    the scores of the networks fitted on other folds.
    """
    known = known_labels(labels, id_col, label_col)
    counts = Counter(model.folds)
    if model.fitted:
        own = scored.sparkSession.createDataFrame([(x,) for x in model.fitted], scored.select(id_col).schema)
        known = known.join(F.broadcast(own), id_col, "left_anti")
    lang = F.coalesce(F.col(lang_col), F.lit("")) if lang_col in scored.columns else F.lit("")
    every = scored.select(id_col, lang.alias("g"), F.floor(F.col("score") * 100).cast("int").alias("s")).join(known, id_col)
    for r in every.groupBy("g", "y", "s").count().collect():  # languages by 2 by 101
        counts[r["g"], r["y"], r["s"]] += r["count"]
    return _calibrate(counts) if any(label for _, label, _ in counts) else {"": 0.5}


def _calibrate(counts: Counter) -> dict[str, float]:
    """Thresholds by language of best F1, from rows counted by (language, label, score in hundredths)."""

    def best(tally: np.ndarray) -> float:
        over = tally[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows by label with at least that score
        grid = np.arange(10, 91)
        f1 = 2 * over[1, grid] / np.maximum(1e-9, over[:, grid].sum(axis=0) + tally[1].sum())
        return float(grid[f1 >= f1.max() - 1e-9].mean() / 100)

    tallies: dict[str, np.ndarray] = {"": np.zeros((2, 101))}
    for (lang, label, at), n in counts.items():
        for name in {lang, ""}:
            tallies.setdefault(name, np.zeros((2, 101)))[label, at] += n
    return {name: best(tally) for name, tally in sorted(tallies.items()) if not name or tally[1].sum() >= 10}


def score(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``threshold`` (the language's) and ``toxic`` (score at or over it).

    The score depends on the text alone; the language chooses a threshold only.  Null
    and empty texts get the score of no words.  Columns of these names are replaced.
    """
    base = fresh(docs, "score", "threshold", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())])
    at = base.columns.index(text_col)

    key = uuid.uuid4().hex

    def run(batches):
        own = shared.value
        if key not in _held:  # a worker goes on with the words of its earlier tasks
            _held.clear()
            _held[key] = {}, []
        cache, table = _held[key]
        for batch in batches:
            got = scores_of(own, strings(batch, at), cache, table)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=schema.names)

    return decided(base.mapInArrow(run, schema), model.thresholds, lang_col)


def decided(scored: DataFrame, thresholds: dict[str, float], lang_col: str | None = "lang") -> DataFrame:
    """``scored`` with ``threshold`` and ``toxic``, by language."""
    limit = F.lit(thresholds.get("", 0.5))
    if lang_col and lang_col in scored.columns:
        for lang, value in sorted(thresholds.items()):
            if lang:
                limit = F.when(F.col(lang_col) == lang, value).otherwise(limit)
    return scored.withColumn("threshold", limit).withColumn("toxic", F.col("score") >= F.col("threshold"))


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", lang_col: str = "lang", **options) -> DataFrame:
    """``docs`` (or the columns ``keep`` of it) with score, threshold and toxic: fitted, scored and calibrated.

    Scores are written once; thresholds are read off them.  Rows without an id are scored
    like any other; an empty table gives an empty one; unlabelled tables get score 0.
    """
    model = fit(docs, labels, id_col=id_col, lang_col=lang_col, **options)
    scored = score(docs, model, lang_col=lang_col).drop("threshold", "toxic")
    wide = [c for c in dict.fromkeys([*(keep or docs.columns), id_col, *([lang_col] if lang_col in docs.columns else [])]) if c.lower() not in ("score", "threshold", "toxic")]
    scored = written(scored.select(*wide, "score"), "scored")
    thresholds = calibrate(scored, labels, model, id_col, options.get("label_col", "toxic"), lang_col)
    out = decided(scored, thresholds, lang_col)
    return out.select(*[c for c in (keep or docs.columns) if c.lower() not in ("score", "threshold", "toxic")], "score", "threshold", "toxic")

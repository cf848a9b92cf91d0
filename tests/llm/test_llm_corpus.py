"""Packing, toxicity, joins, search and decontamination against plain versions."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import ann, decontaminate, graph, ngram_join, packing, toxicity

WORDS = "alpha beta gamma delta omega sigma kappa theta lorem ipsum dolor amet quick brown fox jumps over lazy dog".split()


def texts_of(n, seed=0, low=0, high=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))) for _ in range(n)]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- packing --------------------------------------------------------------------------------
def test_pieces_tile_sequences_and_decode(spark):
    texts = [*texts_of(60, 1, 0, 400), None, "", "<|endoftext|> in text", "日本語 text", "x" * 3000, "word " * 3000]
    rows = [*enumerate(texts), (0, texts[0]), (None, "without an id")]
    got = packing.pack_documents(docs_of(spark, rows), capacity=256).collect()
    slow, _ = packing._encoders(public_tokenizers.path(packing.TOKENIZER), None)
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.length, tuple(r.ids)))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    for i, text in enumerate(texts):
        pieces = sorted(set(by_doc[i]))
        ids = [t for _, _, part in pieces for t in part]
        assert ids == slow.encode(text or "", add_special_tokens=False).ids + [0]
        assert all(n == 256 for _, n, _ in pieces[1:])
    assert len(by_doc[0]) == 2 * len(set(by_doc[0])) and len(by_doc[None]) == 1
    total = sum(r.length for r in got)
    assert len(by_sequence) <= total / 256 * 1.1 + 2
    assert packing.pack_documents(docs_of(spark, [])).collect() == []


def best_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b >= n]
        if fit:
            bins.remove(min(fit))
        bins.append(min(fit, default=capacity) - n)
    return len(bins)


def test_sweep_gives_every_gap_the_largest_document_left(spark):
    rng = random.Random(5)
    for _ in range(200):
        rows = sorted((rng.randint(1, 40), rng.random() < 0.4) for _ in range(rng.randint(0, 30)))
        sizes, gaps = [n for n, _ in rows], [g for _, g in rows]
        matches, docs, free, used = packing.successor_sweep(sizes, gaps)
        left, want = [], []
        for i, (n, gap) in enumerate(rows):
            if not gap:
                left.append(i)
            else:
                room = n
                while left and sizes[left[-1]] <= room:
                    room -= sizes[left[-1]]
                    want.append((left.pop(), i))
        assert matches == want and docs == left
        assert sorted(free + [i for i, _ in used]) == [i for i, (_, g) in enumerate(rows) if g]


def test_matches_across_partitions_take_each_document_and_gap_once(spark):
    rng = random.Random(6)
    for _ in range(200):
        left, lo = [], 1
        for part in range(rng.randint(1, 8)):
            hi = lo + rng.randint(0, 9)
            left.append((part, rng.randint(0, 6), rng.randint(lo, hi), rng.randint(0, 6), hi))
            lo = hi
        by_part = {p: (d, big, g, small) for p, d, big, g, small in left}
        docs, gaps = Counter(), Counter()
        for part, lo_, hi_, gap_part, first, each in packing.across(left):
            assert part < gap_part and each * by_part[part][1] <= max(by_part[gap_part][3], by_part[part][1])
            docs.update((part, k) for k in range(lo_, hi_))
            gaps.update({(gap_part, first + k // each) for k in range(hi_ - lo_)})
        assert set(docs.values()) | set(gaps.values()) <= {1}
        assert all(k < by_part[p][0] for p, k in docs) and all(k < by_part[p][2] for p, k in gaps)


def test_ranges_split_large_classes():
    counts = {(1, False): 3, (1, True): 4, (2, False): 25, (3, True): 9, (4, True): 2}
    assert packing.ranges_of(counts, 10) == [(1, False, 0, 1), (1, True, 0, 1), (2, False, 1, 3), (3, True, 4, 1), (4, True, 5, 1)]


@pytest.mark.parametrize("kind,rows", [("mixed", 20_000), ("mixed", 50), ("equal", 100), ("halves", 20_000), ("tiny", 100)])
def test_packing_is_as_tight_as_best_fit_decreasing(spark, monkeypatch, kind, rows):
    monkeypatch.setattr(packing, "RANGE_ROWS", rows)
    rng = random.Random(7)
    n = {"mixed": lambda: rng.randint(1, 255), "equal": lambda: 100, "halves": lambda: rng.choice([128, 129, 64]), "tiny": lambda: rng.randint(1, 4)}[kind]
    lengths = [n() for _ in range(600)]
    table = spark.createDataFrame(list(enumerate(lengths)), "key long, size int")
    held = defaultdict(list)
    for r in packing.best_fit(table, 256).collect():
        held[r.seq].append((r.offset, lengths[r.key]))
    for own in held.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:])) and max(a + n for a, n in own) <= 256
    assert sum(map(len, held.values())) == 600 and len(held) <= best_fit_decreasing(lengths, 256) * 1.01 + 1


# --- toxicity -------------------------------------------------------------------------------
def test_classifier_learns_from_the_training_rows_only(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(700):
        toxic = i % 4 == 0
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(40)]
        if toxic:
            for k in rng.sample(range(40), 5):
                words[k] = "zork" + rng.choice(WORDS)
        rows.append((i, " ".join(words), "en" if i // 4 % 2 else "fr"))
        held = zlib.crc32(str(i).encode()) % 4 == 2
        labels.append((i, int(not toxic) if held else int(toxic)))  # held-out labels are wrong on purpose
    docs = spark.createDataFrame([*rows, (9000, None, None), (9001, "", "en"), (9002, "zorkx " * 9000, "xx")], "doc_id long, text string, lang string")
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs.selectExpr("*", "1 as score", "2 as threshold", "3 as y", "4 as g"), labelled).collect()}
    right = sum((got[i].score >= 0.3) == (i % 4 == 0) for i in range(700))
    assert right >= 690 and got[9000].score == got[9001].score and 0 <= got[9002].score <= 1
    assert all(0.1 <= r.threshold <= 0.9 for r in got.values()) and all(r.toxic == (r.score >= r.threshold) for r in got.values())
    few = toxicity.classify(docs, labelled, keep=["doc_id"])
    assert few.columns == ["doc_id", "score", "threshold", "toxic"] and few.count() == 703
    assert toxicity.classify(docs.limit(0), labelled).collect() == []


def plain_score(model, text):
    """The network by its definition, word by word."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    vectors = [np.mean([model.emb[i] for i in toxicity.parts_of(w)], axis=0) for w in words]
    pooled = []
    for w in toxicity.WIDTHS:
        z = np.zeros((max(len(words), 16), toxicity.FILTERS))
        for i in range(len(words)):
            for j in range(w):
                if i + j < len(words):
                    z[i] += vectors[i + j] @ model.conv[w][j]
            z[i] = np.maximum(z[i] + model.bias[w], 0)
        pooled.append(-np.sort(-z, axis=0))
    feats = [np.concatenate([z[:m].mean(axis=0) for z in pooled]) for m in toxicity.POOLS]
    return 1 / (1 + np.exp(-(np.concatenate([*feats, [np.log1p(len(words)) / 10, 1.0]]) @ model.out)))


def small_model(n=40, epochs=2):
    rng = random.Random(12)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30))) for _ in range(n)]
    return texts, toxicity.train(texts, np.arange(n) % 2, np.ones(n), epochs)


def test_scores_match_a_plain_forward_pass():
    texts, model = small_model()
    for batch in (texts, [*texts[:5], None, "", "x", "é_ü 1"]):
        got = toxicity.scores_of(model, batch, {}, [])
        assert np.allclose(got, [plain_score(model, t) for t in batch], atol=1e-5)


def test_gradients_match_finite_differences():
    texts, model = small_model(12)
    vocab: dict = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in toxicity.words_of(t)]) for t in texts]
    parts = [toxicity.parts_of(w) for w in vocab]
    y, weights = np.arange(12) % 2, np.linspace(1, 2, 12)
    rng = np.random.default_rng(3)
    model.emb = model.emb.astype(np.float64)
    model.conv = {w: v.astype(np.float64) for w, v in model.conv.items()}
    model.bias = {w: v.astype(np.float64) + rng.normal(size=v.shape) * 1e-3 for w, v in model.bias.items()}

    def loss():
        p = np.array([plain_score(model, t) for t in texts])
        return -(weights * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weights.sum()

    grad, touched, g_emb = toxicity.gradients(model, docs, parts, y, weights)
    checks = [(model.out, k, grad["out"][k]) for k in (0, 5, 40, -1)]
    checks += [(model.conv[w], (w - 1, 2, f), grad[f"c{w}"][w - 1, 2, f]) for w in toxicity.WIDTHS for f in (0, 3)]
    checks += [(model.bias[w], f, grad[f"b{w}"][f]) for w in toxicity.WIDTHS for f in (0, 2)]
    checks += [(model.emb, (touched[k], 1), g_emb[k, 1]) for k in (0, 7, len(touched) - 1)]
    for array, at, want in checks:
        held, step = array[at], 1e-5
        array[at] = held + step
        up = loss()
        array[at] = held - step
        down = loss()
        array[at] = held
        assert abs((up - down) / (2 * step) - want) <= 1e-4 + 0.02 * abs(want), at


def test_network_learns_an_order_of_words_that_odds_of_words_cannot_tell():
    rng = random.Random(13)
    texts, y = [], []
    for i in range(900):
        words = [rng.choice(WORDS[5:]) for _ in range(20)]
        at = rng.randrange(18)
        words[at : at + 2] = ["alpha", "beta"] if i % 2 else ["beta", "alpha"]
        texts.append(" ".join(words))
        y.append(i % 2)
    y = np.array(y)
    right = []
    for epochs in (0, 12):  # 0: the network as it starts, from the odds of words
        model = toxicity.train(texts[:700], y[:700], np.ones(700), epochs)
        right.append(((toxicity.scores_of(model, texts[700:], {}, []) >= 0.5) == y[700:]).mean())
    assert right[0] < 0.65 and right[1] > 0.9, right


def test_scores_need_labels_of_both_classes(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    for labels in ([], [(1, 0)], [(1, None)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all(0 <= r.score < 0.01 for r in toxicity.score(docs, model).collect())



def test_rows_outside_the_fitting_sample_calibrate_their_language(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        toxic, lang = i % 3 == 0, "es" if i % 30 < 2 else "en"
        rows.append((i, " ".join(rng.choice(["vile", "scum"] if toxic and rng.random() < 0.3 else WORDS) for _ in range(20)), lang, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"), max_toxic=30, max_clean=60, epochs=2)
    thresholds = toxicity.calibrate(toxicity.score(docs.drop("toxic"), model), docs.select("doc_id", "toxic"), model)
    assert set(thresholds) == {"", "en", "es"}  # es has about 15 toxic rows, of which 3 are in the sample


def test_networks_are_trained_outside_the_driver_as_in_it(spark, monkeypatch):
    driver, train = os.getpid(), toxicity.train

    def elsewhere(*args):
        assert os.getpid() != driver  # the driver holds neither texts nor what training needs
        return train(*args)

    monkeypatch.setattr(toxicity, "train", elsewhere)
    rows = [(i, t + (" vile" if i % 3 == 0 else ""), "en", int(i % 3 == 0)) for i, t in enumerate(texts_of(200, 9, 1, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"), max_toxic=30, max_clean=60, epochs=2)
    # the same rows in the order of the fit, and the same folds
    text, toxic = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    assert model.fitted == [r.doc_id for r in docs.where(docs.doc_id.isin(model.fitted)).orderBy(F.xxhash64("doc_id")).collect()]
    texts, y = [text[i] for i in model.fitted], np.array([toxic[i] for i in model.fitted])
    known = Counter(r[3] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2)
    weight = np.array([known[0] / (y == 0).sum(), known[1] / (y == 1).sum()])[y]
    plain = train(texts, y, weight, 2)
    np.testing.assert_allclose(model.emb, plain.emb, rtol=1e-5, atol=1e-6)
    np.testing.assert_allclose(model.out, plain.out, rtol=1e-5, atol=1e-6)
    folds = Counter()
    for f in range(3):
        own = np.arange(len(y)) % 3 == f
        trial = train([t for t, o in zip(texts, own) if not o], y[~own], weight[~own], 2)
        folds.update(("en", int(label), int(v * 100)) for label, v in zip(y[own], toxicity.scores_of(trial, [t for t, o in zip(texts, own) if o], {}, [])))
    assert model.folds == folds and sum(folds.values()) == len(y)


def test_calibration_takes_the_best_f1():
    counts = Counter({("en", 0, 20): 50, ("en", 0, 45): 9, ("en", 1, 60): 12, ("de", 1, 30): 9, ("de", 0, 10): 5})
    got = toxicity._calibrate(counts)
    assert set(got) == {"", "en"} and 0.45 < got["en"] <= 0.6


# --- components, n-gram join ----------------------------------------------------------------
def plain_components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(150, 151), (151, 151), (152, 150)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = plain_components(160, edges)
    assert got == {x: want[x] for x in range(160) if want.count(want[x]) > 1}


def plain_sets(texts, width):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append({tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
    return out


def near_copies(seed, families, members, edits):
    rng = random.Random(seed)
    out = []
    for f in range(families):
        base = [rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(rng.randint(3, 120))]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("frequent,width,percent", [(16, 4, 85), (0, 4, 85), (2, 5, 80)])
def test_classes_match_brute_force(spark, frequent, width, percent):
    passage = " ".join(f"shared{i}" for i in range(40))
    texts = near_copies(6, 25, 8, 6) + [f"{passage} {t}" for t in near_copies(7, 6, 6, 3)] + near_copies(8, 1, 150, 5)
    texts += [None, "", " \t", "one", "one", "One two", "one  two", "one two three four five", "É a b c d", "é a b c d", "w " * 5000]
    random.Random(9).shuffle(texts)
    sets = plain_sets(texts, width)
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = plain_components(len(texts), edges)
    rows = [*enumerate(texts), (None, texts[3])]
    got = {r.doc_id: r for r in ngram_join.ngram_classes(docs_of(spark, rows), width=width, percent=percent, frequent=frequent).collect()}
    assert {i: got[i].component_id for i in range(len(texts))} == dict(enumerate(want))
    assert all(got[i].n_shingles == len(sets[i]) for i in range(len(texts))) and got[None].component_id is None


def test_join_takes_empty_tables_and_repeated_rows(spark):
    assert ngram_join.ngram_classes(docs_of(spark, [])).collect() == []
    rows = ngram_join.ngram_classes(docs_of(spark, [(5, "a b c d e f")] * 3 + [(2, "A b c d e f")])).collect()
    assert len(rows) == 4 and {r.component_id for r in rows} == {2}


# --- search ---------------------------------------------------------------------------------
def exact_search(ids, x, k):
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            scored = sorted((-float(np.cumsum(q * v)[-1]), j) for j, v in zip(ids, x) if j != i)
            out[i] = scored[:k]
    return out


def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[:300] = x[7]  # many equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [1.0, None] + [1.0] * 14), (2080, [1.0] * 5), (None, [1.0] * 16)]
    got = defaultdict(dict)
    for r in ann.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    want = exact_search(range(1500), x.astype(np.float64), 20)
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q].values()} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, own in got.items():
        order = [own[k] for k in range(1, 21)]
        assert order == sorted(order, key=lambda t: (-t[1], t[0])) and q not in {v for v, _ in order}
        assert all(s == float(np.cumsum(x[q].astype(np.float64) * x[v].astype(np.float64))[-1]) for v, s in order)
    assert [own[1][0] for q, own in got.items() if q == 20] == [0]  # the smallest of the equal ones


def test_search_of_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(few, share=1.0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]
    assert ann.search(few.limit(0)).collect() == []


def test_search_of_few_rows_gives_all_candidates_by_default(spark):
    rng = np.random.default_rng(4)
    for n in (3, 15, 21, 30):
        rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 8)))]
        got = Counter(r.query_id for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
        assert got == {i: min(20, n - 1) for i in range(0, n, 20)}


def test_ties_repeated_ids_and_small_shards(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8))
    x[1:381, 1:] = 0.0  # equal scores for a query along the first axis
    x[1:381, 0] = 1.0
    x[1:381, 1] = np.arange(380)
    x[0] = [1.0] + [0.0] * 7
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), share=1.0, shard_entries=50, block_queries=6).collect()
    want = exact_search(range(400), x, 20)
    for q, own in want.items():
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(v, -s) for s, v in own]
    again = [(0, [9.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.7, 0.0]), (1, [0.5, 0.0]), (2, [0.6, 0.0]), (2, None), (2, [0.1, None])]
    got = ann.search(spark.createDataFrame(again, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as score", "3 as shard")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 2, 0.6), (0, 2, 1, 0.5)]


def test_cells_are_dealt_over_shards_of_bounded_size():
    counts = np.array([0, 3, 2, 25, 0, 4, 4, 1, 10])
    first, parts = ann.deal_cells(counts, 10)
    assert first.tolist() == [0, 0, 0, 1, 0, 4, 4, 4, 5] and parts.tolist() == [1, 1, 1, 3, 1, 1, 1, 1, 1]


# --- decontamination ------------------------------------------------------------------------
def test_leaks_match_brute_force(spark):
    rng = random.Random(10)
    vocab = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choice(vocab) for _ in range(rng.randint(15, 60))) for _ in range(30)] + ["too short item", None, "a b a b a b a b a b a b a b"]
    docs = []
    for _ in range(200):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 150))]
        if rng.random() < 0.5:
            leak = (rng.choice(items[:30])).split()
            for _ in range(rng.choice([0, 0, 1, 2, 8])):
                leak[rng.randrange(len(leak))] = "edited"
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() + "!!" for w in leak] if rng.random() < 0.3 else leak
        docs.append(" ".join(body))
    docs += [None, "", items[0], items[32] + " a b a b"]
    shingles = lambda t: [tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 4)]
    want = {}
    for d, text in enumerate(docs):
        s = shingles(text)
        for i, item in enumerate(items):
            b = shingles(item)
            for at in range(max(1, len(s) - len(b) + 1)) if s and b else ():
                x, y = Counter(s[at : at + len(b)]), Counter(b)
                both = sum((x & y).values())
                want[d, i] = max(want.get((d, i), 0), both / (sum(x.values()) + sum(y.values()) - both))
    want = {k: v for k, v in want.items() if v >= 0.8}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for limit in (600_000, 0):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(docs_of(spark, list(enumerate(docs)) * 2), bench, broadcast_rows=limit).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    kept = decontaminate.decontaminate(docs_of(spark, [*enumerate(docs), (None, items[0])]), bench)
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {d for d, _ in want} | {None}


def test_simhash_is_the_majority(spark):
    rng = random.Random(11)
    lists = [[rng.randint(-(2**63), 2**63 - 1) for _ in range(rng.randint(1, 60))] for _ in range(40)]
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i long, h array<long>").select("i", decontaminate.simhash(F.col("h"), 7).alias("f")).collect()
    for r in got:
        h = lists[r.i]
        want = sum(1 << b for b in range(64) if sum((v >> b) & 1 for v in h) > len(h) // 2)
        assert r.f & (2**64 - 1) == want

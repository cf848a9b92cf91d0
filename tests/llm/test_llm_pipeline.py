"""The pipeline's stages on a small corpus, and the queries' contracts."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from cloudloom.llm import ann, decontaminate, line_dedup, ngram_join, packing, pii, secrets, toxicity, url_filter
from cloudloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    once = text(60)
    rows = [(1, None, None, None, None), (2, "", "en", "", 0), (3, once, "en", "a", 1), (3, once, "en", "a", 1), (4, once + " more", None, "b", 2), (None, once, "en", "c", 3), (None, None, "en", "c", 3)]
    rows += [(5, text(30_000), "de", "d", 4), (6, "x" * 200_000, "de", "d", 5), (7, "\n" * 5000, "fr", "d", 6), (8, "same\nline", "fr", "d", 7)]
    return spark.createDataFrame(rows + [(20 + i, f"same\n{text(20)}", "fr", "e", 8) for i in range(12)], DOCUMENT)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_tables(spark, name, stage):
    docs = odd_documents(spark)
    out = stage(spark, docs, SF)
    ids = Counter(r.doc_id for r in out.select("doc_id").collect())
    if name != "packing":
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    if name in ("line_dedup", "decontaminate"):
        assert sum(ids.values()) == docs.count()
    if name == "ngram_join":
        assert set(ids) == {None, 1, 2, 3, 5, 6, 7, 8, *range(20, 32)} and ids[3] == 1 and ids[None] == 2
    if name == "packing":
        assert set(ids) == {r.doc_id for r in docs.collect()} and ids[None] == 2
    assert stage(spark, docs.limit(0), SF).collect() == []


def test_operators_take_columns_that_clash_and_empty_tables(spark):
    docs = odd_documents(spark).where("doc_id < 5 or doc_id > 7")
    names = "id key seq size sid n token pos block root cluster part at gap kind k1 k2 a b h m heavy keep ranges prefix more start end score item fp similarity w s p length piece text2 doc y g".split()
    wide = docs.selectExpr("*", *[f"{i} as {n}" for i, n in enumerate(names)])
    empty = wide.limit(0)
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6"), (None, "a"), (2, None)], "item_id long, text string").selectExpr("*", *[f"'x' as {n}" for n in ("item", "b", "q", "h", "at", "start")])
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (3, None)], "doc_id long, toxic int").selectExpr("*", "1 as y", "2 as text", "3 as lang")
    calls = {
        "dedup": (lambda d: line_dedup.line_dedup(d, min_docs=10), docs.count()),
        "pii": (lambda d: pii.find_pii(d), docs.count()),
        "secrets": (lambda d: secrets.scan_secrets(d, forest=secrets.train_forest(*_tiny())), None),
        "join": (lambda d: ngram_join.ngram_classes(d), docs.count()),
        "leaks": (lambda d: decontaminate.find_leaks(d, bench), None),
        "clean": (lambda d: decontaminate.decontaminate(d, bench, broadcast_rows=0), None),
        "toxic": (lambda d: toxicity.classify(d, labels), docs.count()),
        "pack": (lambda d: packing.pack_documents(d, keep_ids=False), None),
    }
    for name, (call, rows) in calls.items():
        got = call(wide).collect()
        assert rows is None or len(got) == rows, name
        assert call(empty).collect() == [], name
    pages = spark.createDataFrame([(1, "http://a.net/x", "<p>x"), (None, None, None)], "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as path", "3 as rule", "4 as mass", "5 as jump", "6 as linked", "7 as score")
    assert len(url_filter.judge_urls(pages).collect()) == 2 and url_filter.judge_urls(pages.limit(0)).collect() == []
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>, id long, v int, cell int")).collect() == []
    with pytest.raises(ValueError):
        packing.pack_documents(docs.withColumnRenamed("doc_id", "piece"), id_col="piece")


def _tiny():
    import numpy as np

    return np.random.default_rng(0).random((40, len(secrets.FEATURES))), np.arange(40) % 2


def test_stages_keep_columns_and_only_remove(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before and len(after) >= 0.5 * len(before), name
        out.write.parquet(f"{tmp_path}/{name}")
        docs, before = spark.read.parquet(f"{tmp_path}/{name}"), after
    packed = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").collect()}
    assert packed == before


def test_near_copy_stage_keeps_one_of_each_class_and_rows_without_an_id(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (1, text + " x"), (1, text + " x"), (7, "other words that stand alone here"), (None, text), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id or -1 for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [-1, -1, 1, 7]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


def test_line_dedup_stage_returns_every_row(spark):
    rows = [(i, "a shared line\nanother one", 26) for i in range(12)] + [(20, "a shared line\nits own", 21), (21, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_shared_lines(spark, docs, SF).collect()}
    assert got == {i: ("", 0) for i in range(12)} | {20: ("its own", 7), 21: ("", 0)}

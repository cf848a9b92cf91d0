"""The corpus operators as queries over the tables, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .ann import search
from .common import table
from .decontaminate import find_leaks
from .html_extract import extract_text
from .line_dedup import line_dedup
from .ngram_join import ngram_classes
from .packing import pack_documents
from .pii import pii_report
from .secrets import scan_secrets
from .url_filter import judge_urls


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate for a secret with its score and the forest's decision."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return scan_secrets(docs, path_col="source").drop("source")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents are dropped from all of them."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii_report(table(spark, sf_dir, "documents"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    out = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), capacity=2048, end_id=0, keep_ids=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = toxicity.classify(docs, table(spark, sf_dir, "labels"), keep=["doc_id", "lang"])
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted, "threshold", "toxic")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by Jaccard similarity of 4-word shingles, 0.85 or more."""
    return ngram_classes(table(spark, sf_dir, "documents"), width=4, percent=85)


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    return search(table(spark, sf_dir, "embeddings"), query_where="vec_id % 20 = 0", k=20)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the similarity."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_pii": op3_pii,
    "op4_html_extract": op4_html_extract,
    "op5_url_filter": op5_url_filter,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_join": op8_ngram_join,
    "op9_ann": op9_ann,
    "op10_decontaminate": op10_decontaminate,
}

ORACLES = {
    "op2_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (
            SELECT doc_id, pos, line,
                   translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines),
        heavy AS (
            SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(heavy.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (heavy.key IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN heavy ON keyed.key = heavy.key
        GROUP BY doc_id
    """,
    "op8_ngram_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0),
        shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM places),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
        both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach(doc_id, root) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT y, root FROM reach JOIN both_ways ON x = reach.doc_id)
        SELECT documents.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id
        FROM documents JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY documents.doc_id
    """,
    "op10_decontaminate": r"""
        WITH texts AS (
            SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
            UNION ALL SELECT 'b', item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') FROM benchmark),
        places AS (SELECT side, id, w, len(w) - 4 AS n, unnest(range(0, len(w) - 4)) AS p FROM texts WHERE len(w) > 4),
        shingles AS (SELECT side, id, n, p, array_to_string(w[p + 1:p + 5], ' ') AS g FROM places),
        d AS (SELECT * FROM shingles WHERE side = 'd'), b AS (SELECT * FROM shingles WHERE side = 'b'),
        windows AS (
            SELECT DISTINCT d.id AS doc_id, b.id AS item_id, b.n AS m, greatest(0, least(d.p - b.p, greatest(d.n - b.n, 0))) AS start
            FROM d JOIN b ON d.g = b.g),
        own AS (SELECT doc_id, item_id, m, start, d.g, count(*) AS c FROM windows JOIN d ON d.id = doc_id AND d.p >= start AND d.p < start + m GROUP BY ALL),
        items AS (SELECT id AS item_id, g, count(*) AS c FROM b GROUP BY ALL),
        total AS (SELECT doc_id, item_id, m, start, sum(c) AS n FROM own GROUP BY ALL),
        both_sides AS (SELECT doc_id, own.item_id, m, start, sum(least(own.c, items.c)) AS c FROM own JOIN items ON own.item_id = items.item_id AND own.g = items.g GROUP BY ALL),
        scored AS (SELECT doc_id, item_id, start, n, CAST(c AS DOUBLE) / CAST(n + m - c AS DOUBLE) AS similarity FROM total JOIN both_sides USING (doc_id, item_id, m, start)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS k FROM scored WHERE similarity >= 0.8)
        SELECT doc_id, item_id, similarity, CAST(start AS INT) AS start, CAST(n + 4 AS INT) AS n_words FROM ranked WHERE k = 1
    """,
}

"""Verdicts on pages from URL rules and from trust propagated over the host graph.

Links of the pages are aggregated to host edges.  Personalised PageRank from trusted
seeds follows the edges; distrust from blocked seeds follows them in reverse, so that a
host linking to blocked ones is distrusted.  A seed's mass is the share of the host's
pages that rules decide that way.  A page without a rule gets its host's verdict, by
thresholds on the host's distrust and trust, its own seed mass included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, fresh, written

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = _rest(url)
    return F.when(rest.isNull(), "").otherwise(ascii_lower(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = _rest(url)
    return F.when(rest.isNull(), "").otherwise(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as ``host/path``, or null."""
    out = F.lit(None).cast("string")
    for _, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.lit(rule_host + rule_path)).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): links between different hosts, counted before the shuffle."""
    links = pages.where(F.col(html_col).isNotNull()).select(
        url_host(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(html_col, F.lit(LINK), F.lit(1))).alias("to")
    )
    target = F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to"))
    return (
        links.select("src", url_host(target).alias("dst"))
        .where("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-5) -> DataFrame:
    """Personalised PageRank: (host, score, linked) from seeds (host, mass) over (src, dst, weight).

    ``linked`` is the part of the score that came over links, without the host's own seed.

    A seed jumps with (1 - damping) of its mass.  Mass that has nowhere to go is let go:
    scores rank hosts, they need not add up to one.  Rounds go on until no host's score
    changes by more than ``tolerance``; as a round passes on at most ``damping`` of what
    changed, they end.  A host's out-links share its score by weight; contributions are
    summed before the shuffle, so a host with many in-links is no hot key.  Every round is
    written to the shared folder, so that a lost executor costs one round at most.
    """
    jump = F.col("mass") * (1 - damping)
    start = written(seeds.where("mass > 0").select("host", jump.alias("jump")), "seeds")
    score, held = start.select("host", F.col("jump").alias("score"), F.lit(0.0).alias("linked")), None
    shares = edges.join(edges.groupBy("src").agg(F.sum("weight").alias("all")), "src").select(
        "src", "dst", (F.col("weight") / F.col("all")).alias("share")
    )
    shares = written(shares, "shares")
    if not shares.take(1) or not start.take(1):
        return score
    while True:
        moved = (
            score.join(shares, score["host"] == shares["src"])
            .groupBy(F.col("dst").alias("host"))
            .agg((F.sum(F.col("score") * F.col("share")) * damping).alias("got"))
        )
        before = score.select("host", F.col("score").alias("was"))
        linked, own = F.coalesce("got", F.lit(0.0)), F.coalesce("jump", F.lit(0.0))
        new = moved.join(start, "host", "full").select("host", (linked + own).alias("score"), linked.alias("linked"))
        new = written(new.join(before, "host", "left").withColumn("change", F.abs(F.col("score") - F.coalesce("was", F.lit(0.0)))), "rank")
        discard(held)
        score, held = new.select("host", "score", "linked"), new
        if (new.agg(F.max("change")).first()[0] or 0.0) <= tolerance:
            return score


#: Host scores of at most this many rows (under 100 bytes each) are broadcast, more are joined.
BROADCAST_ROWS = 100_000


def judge_urls(
    pages: DataFrame,
    url_col: str = "url",
    html_col: str = "html",
    rules=RULES,
    damping: float = 0.85,
    max_distrust: float = 1.0,
    min_share: float = 0.5,
    min_linked: float = 1e-3,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``pages`` with host, path, rule, trust, distrust and verdict.

    Seeds are the hosts of pages that a rule decides; a seed's mass is the share of such
    pages among all of its host.  A page without a rule is blocked where its host's
    distrust exceeds ``max_distrust`` times its trust, and is more than a trace: rules
    block at least ``min_share`` of the host's pages, or at least ``min_linked`` came over
    links (a host that links to nothing but a blocked one gets 0.1275 over the number of
    hosts that link there).  So one blocked section does not condemn a host.  Null URLs and
    URLs without ``://`` have an empty host and path, fit no rule and are allowed: they
    are no host.  Repeated rows are judged alike and count as often; an empty table gives
    an empty one; columns of these names are replaced.
    """
    names = ("host", "path", "rule", "trust", "distrust", "verdict", "__uf_share", "__uf_linked")
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    side = lambda r: _side(r, rules)
    ruled = pages.select(host.alias("host"), path.alias("path")).where("host <> ''").select("host", side(rule_of(F.col("host"), F.col("path"), rules)).alias("side"))
    share = lambda v: F.avg((F.coalesce("side", F.lit("")) == v).cast("double"))
    hosts = written(ruled.groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")), "hosts")
    edges = written(host_edges(pages, url_col, html_col), "host-edges")
    tolerance = min_linked / 100
    trust = propagate(edges, hosts.select("host", F.col("good").alias("mass")), damping, tolerance)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(back, hosts.select("host", F.col("bad").alias("mass")), damping, tolerance)
    scores = hosts.select("host", F.col("bad").alias("__uf_share")).join(trust.select("host", F.col("score").alias("trust")), "host", "left")
    scores = written(scores.join(distrust.select("host", F.col("score").alias("distrust"), F.col("linked").alias("__uf_linked")), "host", "left"), "scores")
    if scores.count() <= broadcast_rows:
        scores = F.broadcast(scores)
    named = fresh(pages, *names).withColumns({"host": host, "path": path})
    named = named.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    out = named.join(scores, "host", "left").fillna(0.0, ["trust", "distrust", "__uf_share", "__uf_linked"])
    bad = (F.col("distrust") > F.col("trust") * max_distrust) & ((F.col("__uf_share") >= min_share) | (F.col("__uf_linked") >= min_linked))
    verdict = F.coalesce(side(F.col("rule")), F.when(bad, "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).drop("__uf_share", "__uf_linked")


def _side(rule: Column, rules) -> Column:
    """The verdict of a rule given as ``host/path``."""
    out = F.lit(None).cast("string")
    for verdict, rule_host, rule_path in rules:
        out = F.when(rule == rule_host + rule_path, verdict).otherwise(out)
    return out

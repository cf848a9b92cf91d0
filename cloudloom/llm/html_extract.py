"""Main text of web pages: block parsing, then nearest-URL page differencing.

A page is parsed into text blocks.  Blocks in page furniture (menus, footers, adverts,
forms and the like) go, and so do blocks outside an article or main element where there
is one.  Then every page is differenced: the pages of a host are ordered by URL path, a
page is paired with the neighbour whose path is nearest, their blocks are aligned by
longest common subsequence, and blocks that both share are deleted (``shared_blocks``
says when one neighbour is evidence enough).  Only 64-bit hashes of the blocks travel.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, strings, written
from .url_filter import url_host, url_path

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script|style|noscript|template|textarea|iframe|svg|select|title|annotation|annotation-xml"
#: Elements that begin and end a block.
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag closes though its end tag is left out, and where the search for it stops.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)), "tr": (("tr",), ("table",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
#: What may stand in a head whose end tag is left out.
_IN_HEAD = frozenset("head base link meta title noscript style script template".split())
#: End tags don't reach out of these, unless they are a table's own.
_SCOPE = frozenset("td th table caption".split())
_TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
#: Elements that are page furniture wherever they stand.
_FURNITURE = frozenset("head nav footer aside menu dialog button fieldset audio video canvas".split())
#: Words that mark an element as page furniture where its class or id holds no other words but plain ones.
_MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsbygoogle banner banners sponsor sponsors sponsored promo promos promotion cookie cookies consent gdpr "
    "notice notices notification notifications alert alerts sidebar comment comments disqus reply replies respond share sharing sharedaddy related recommended recommendations "
    "newsletter subscribe subscription signup login popup modal breadcrumb breadcrumbs navbar navigation footer masthead pagination pager paywall".split()
)
#: Words that mark furniture too, but within an article only where the element is mostly links.
_DOUBTFUL = frozenset("menu menus nav widget widgets social toolbar overlay skip".split())
_PLAIN_WORDS = frozenset(
    "a and area article bar block bottom box btn button buttons center col column container content desktop fixed float footer form global group header home icon icons inline inner item items js "
    "left link links list main mobile module nav outer page pane panel popular post posts primary right row secondary section show site slot small sticky story the to top unit ui view "
    "wp wrap wrapper l m s x xs sm md lg xl".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
#: An attribute's value is quoted only after an equals sign; any other quote is a character.
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<svg(?=[\s/])[^>]*+(?<=/)>"
    rf"|<(?P<raw>{_RAW})(?=[\s/>])(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
_TAG_START = re.compile(r"<[a-z/!?]", re.I)
_ATTR = re.compile(r"([^\s\"'>/=][^\s>/=]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Pages looked at on either side of a page; the nearest one is differenced, the others vote.
WINDOW = 2
#: Up to so many pages with deleted blocks are broadcast (a few positions each), more are joined.
BROADCAST_ROWS = 200_000


def _marks(value: str) -> int:
    """2 if a token of a class or id names page furniture, 1 if it may, 0 if none does.

    All words of the token count: ``cookie-banner`` and ``siteFooter`` are furniture,
    ``alert-fatigue`` and ``social-history`` are subjects.
    """
    most = 0
    for token in value.split():
        words = [w.lower() for w in _WORD.findall(token) if not w.isdigit()]
        known = [2 if w in _MARKED else w in _DOUBTFUL for w in words]
        if any(known) and all(k or w in _PLAIN_WORDS for k, w in zip(known, words)):
            most = max(most, *known)
    return most


def _furniture(name: str, attrs: str, in_article: bool) -> int:
    """2 for page furniture, 3 for a form, 1 for what is furniture only if it is mostly links, 0 for content."""
    if name == "form":
        return 3
    if name in _FURNITURE or (name == "header" and not in_article):
        return 2
    if not attrs or name in ("html", "body", "main", "article"):
        return 0
    doubt = 0
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            mark = _marks(value)
            if mark == 2 or (mark and not in_article):
                return 2
            doubt = max(doubt, mark)
        elif key == "role" and value.lower() in _ROLES:
            return 2
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return 2
        elif key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return 2
    return doubt


class _Open:
    """The open elements: where each name is open, the block elements, and the scopes of end tags."""

    def __init__(self):
        self.stack: list[tuple] = []  # (name, furniture, first block, characters, those in links, headings)
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []
        self.skip = -1  # place of the outermost furniture

    def top(self, name: str) -> int:
        at = self.where.get(name)
        return at[-1] if at else -1

    def push(self, name: str, furniture: int, *state) -> None:
        at = len(self.stack)
        self.stack.append((name, furniture, *state))
        self.where.setdefault(name, []).append(at)
        if name in _BLOCKS:
            self.blocks.append(at)
        if name in _SCOPE:
            self.scopes.append(at)
        if furniture == 2 and self.skip < 0:
            self.skip = at

    def pop_to(self, at: int) -> list[tuple]:
        """Close the element at place ``at`` and all within it; what was closed, the innermost first."""
        gone = self.stack[at:][::-1]
        del self.stack[at:]
        for name, *_ in gone:
            self.where[name].pop()
        for places in (self.blocks, self.scopes):
            while places and places[-1] >= at:
                places.pop()
        if self.skip >= at:
            self.skip = -1
        return gone


def parse_blocks(page: str) -> tuple[list[str], list[int], bool]:
    """(blocks, own, bounded): all blocks outside furniture, the positions of those that are
    the page's own text, and whether an article or main element bounds them.

    Blocks are decoded, runs of white space are one space, ends are trimmed.  End tags
    that HTML lets out are implied, so furniture ends with its element or its parent.  An
    article or main element bounds the text only if it holds the larger part of what is
    not links: a teaser card does not discard the page around it.  A form goes unless it
    wraps the page (an article, a main element or a first heading begins in it).
    """
    blocks: list[str | None] = []
    places: list[tuple[bool, bool, bool]] = []  # in an article, in a main element, mostly links
    buffer: list[str] = []
    opened = _Open()
    chars = linked = heads = 0
    since = (0, 0)
    at = 0

    def flush() -> None:
        nonlocal since
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                blocks.append(text)
                places.append((opened.top("article") >= 0, opened.top("main") >= 0, 2 * (linked - since[1]) > chars - since[0]))
            buffer.clear()
        since = chars, linked

    def closed(place: int) -> None:
        flush()
        for _, furniture, first, before, links, headings in opened.pop_to(place):
            if (furniture == 1 and 2 * (linked - links) > chars - before) or (furniture == 3 and heads == headings):
                blocks[first:] = [None] * (len(blocks) - first)

    def text_of(part: str) -> None:
        nonlocal chars, linked
        buffer.append(part)
        size = len(part) - part.count(" ")
        chars += size
        linked += size * (opened.top("a") >= 0)

    # no tag ends beyond the last bracket; without that bound, tags that never end cost a scan each
    bound = page.rfind(">") + 1
    m = None
    for m in _TOKEN.finditer(page, 0, bound):
        if opened.skip < 0 and m.start() > at:
            text_of(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if opened.skip < 0 and m["raw"] is None and m[0][:4].lower() not in ("<!--", "<svg"):
                flush()
            continue
        block = name in _BLOCKS
        if not m["close"] and name not in _IN_HEAD and (head := opened.top("head")) >= 0:
            closed(head)
        if name == "br" and opened.skip < 0:
            buffer.append(" ")
        if m["close"]:
            place = opened.top(name)
            if place < 0 or (not block and opened.blocks and place < opened.blocks[-1]) or (name not in _TABLE and opened.scopes and place < opened.scopes[-1]):
                if block and opened.skip < 0:
                    flush()
                continue
            if block or opened.stack[place][1]:
                closed(place)
            else:
                opened.pop_to(place)
            continue
        if block:
            if opened.skip < 0:
                flush()
            p = opened.top("p")
            if p >= 0 and name != "table" and not (opened.scopes and p < opened.scopes[-1]):
                closed(p)
            if name in _IMPLIED:
                names, bounds = _IMPLIED[name]
                bound = max(opened.top(x) for x in bounds)
                ends = [x for x in map(opened.top, names) if x > bound]
                if ends:
                    closed(min(ends))
        if name in _VOID or m["attrs"].endswith("/"):
            continue
        furniture = 0 if opened.skip >= 0 else _furniture(name, m["attrs"], opened.top("article") >= 0)
        if furniture:
            flush()
        if name == "a" and (link := opened.top("a")) >= 0 and (not opened.blocks or link > opened.blocks[-1]):
            opened.pop_to(link)
        if block or furniture or opened.skip >= 0 or (name == "a" and "href" in m["attrs"].lower()):
            opened.push(name, furniture, len(blocks), chars, linked, heads)
        heads += opened.skip < 0 and name in ("article", "main", "h1")
    unclosed = m is not None and at == bound and ((m["raw"] and "</" not in m[0][-40:]) or (m[0].startswith("<!--") and not m[0].endswith("-->")))
    if opened.skip < 0 and at < len(page) and not unclosed:
        text_of(_TAG_START.split(page[at:], maxsplit=1)[0])
    closed(0)
    left = [i for i, x in enumerate(blocks) if x is not None]  # the others were closed as furniture
    places = [places[i] for i in left]
    texts = [blocks[i] for i in left]
    total = sum(len(x) for x, place in zip(texts, places) if not place[2])
    for kind in (0, 1):
        own = [i for i, place in enumerate(places) if place[kind]]
        if 2 * sum(len(texts[i]) for i in own) > total:
            return texts, own, True
    return texts, list(range(len(texts))), False


def shared_positions(a: list[str], b: list[str]) -> set[int]:
    """Positions of ``a`` on a longest common subsequence of the lines of both.

    Bit-parallel: one wide integer a line of ``a``, so long pages stay cheap.
    """
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for line in a:
        u = v & where.get(line, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out: set[int] = set()
    j = len(b) - 1
    for i in range(len(a) - 1, -1, -1):
        # zero bits of a row count the subsequence; step along a, or along b, to where it grew
        while j >= 0 and (rows[i] >> j) & 1:
            j -= 1
        if j < 0:
            break
        before = rows[i - 1] if i else full
        if (before >> j) & 1 and where.get(a[i], 0) >> j & 1:
            out.add(i)
            j -= 1
    return out


def shared_blocks(own: list, sizes: list[int], bounded: bool, near: list[list], most: float = 0.8) -> set[int]:
    """Positions of ``own`` to delete, given the blocks of the pages around it, the nearest first.

    Without an article the blocks shared with the nearest page go.  One neighbour is not
    evidence enough within an article, nor where the neighbour may be a copy (over ``most``
    of the characters are shared): there a block must also be shared with more than half of
    the pages around, two at least.  Copies have no say on that: pages that share over
    ``most`` of the article, or, without an article, all blocks.  A page without an article
    whose nearest page has all its blocks stays whole.
    """
    if not own or not near:
        return set()
    mine = set(own)
    shares = [set() if mine.isdisjoint(x) else shared_positions(own, x) for x in near]
    copies = [sum(sizes[i] for i in s) > most * sum(sizes) for s in shares]
    if not bounded and (not copies[0] or len(shares[0]) == len(own)):
        return set() if copies[0] else shares[0]
    if bounded:
        voters = [s for s, copy in zip(shares, copies) if not copy]
    else:
        voters = [s for s in shares if len(s) < len(own)]
    if len(voters) < 2:
        return set()
    return {i for i in voters[0] if 2 * sum(i in s for s in voters) > len(voters)}


def _nearness(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        n += 1
    return n


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """One row per page: the id, url, text and n_chars (code points).

    A null or empty page has an empty text.  The pages around one are up to ``WINDOW``
    before and after it on its host, in the order of (host, path, id) over the whole table.
    Of the two beside it, the one with the longer common path is the nearest, the earlier
    one if both are as near.  A page alone on its host keeps all its blocks.
    """
    spark = pages.sparkSession
    base = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), F.col(html_col).alias("html")
    )
    fields = [("id", pages.schema[id_col].dataType), ("url", T.StringType()), ("host", T.StringType()), ("path", T.StringType()), ("blocks", T.ArrayType(T.StringType()))]
    fields += [("keys", T.ArrayType(T.LongType())), ("own", T.ArrayType(T.IntegerType())), ("bounded", T.BooleanType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def parse(batches):
        for batch in batches:
            blocks, keys, owns, bounds = [], [], [], []
            for page in strings(batch, 4):
                every, own, bounded = parse_blocks(page or "")
                blocks.append([every[i] for i in own])
                keys.append([xxhash.xxh3_64_intdigest(x) - 2**63 for x in every])
                owns.append(own)
                bounds.append(bounded)
            more = [pa.array(blocks, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64())), pa.array(owns, pa.list_(pa.int32())), pa.array(bounds, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *more], names=schema.names)

    parsed = written(base.mapInArrow(parse, schema).withColumn("row", F.monotonically_increasing_id()), "blocks")
    ordered, gone = _gone(spark, parsed)
    gone = written(gone, "gone")
    discard(ordered)
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    kept = F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda x, i: ~F.array_contains("gone", i)))
    text = parsed.join(gone, "row", "left").select("id", "url", F.array_join(kept, "\n\n").alias("text"))
    return text.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))


def _gone(spark, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages in order as a written table, and (row, gone): positions among the blocks of
    a page that differencing deletes, where there are any."""
    lean = parsed.select("row", "id", "host", "path", "keys", "own", "bounded", F.transform("blocks", lambda x: F.char_length(x)).alias("sizes"))
    ranked_schema = T.StructType([*lean.schema.fields, T.StructField("part", T.LongType()), T.StructField("at", T.LongType())])

    def number(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * k, pa.int64()), pa.array(range(n, n + k), pa.int64())], names=ranked_schema.names
            )
            n += k

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = lean.repartitionByRange(n_parts, "host", "path", "id", "row").sortWithinPartitions("host", "path", "id", "row")
    ordered = table = written(ordered.mapInArrow(number, ranked_schema), "ordered")
    offset, rows = 0, []
    for part, n in sorted(ordered.groupBy("part").count().collect()):  # a row for each partition
        rows.append((part, offset))
        offset += n
    if not rows:
        return table, parsed.select("row", F.expr("cast(null as array<int>)").alias("gone")).limit(0)
    ordered = ordered.join(F.broadcast(spark.createDataFrame(rows, "part long, offset long")), "part").withColumn("rank", F.col("offset") + F.col("at"))
    own = ordered.where("size(own) > 0")
    steps = F.array(*[F.lit(d).cast("long") for d in range(-WINDOW, WINDOW + 1) if d])
    wanted = own.select("host", F.col("rank").alias("of"), F.explode(F.transform(steps, lambda d: F.col("rank") + d)).alias("rank"))
    near = ordered.select("rank", F.col("host").alias("near_host"), F.struct("rank", "path", "keys").alias("near"))
    partners = wanted.join(near, "rank").where("host = near_host").groupBy("of").agg(F.sort_array(F.collect_list("near")).alias("near"))
    joined = own.join(partners, own["rank"] == partners["of"]).select("row", own["rank"], "path", "keys", "own", "sizes", "bounded", "near")

    def compare(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                # the pages beside come first, the one with the longer common path before the other
                near = sorted(row["near"], key=lambda x: (abs(x["rank"] - row["rank"]), -_nearness(row["path"], x["path"]), x["rank"]))
                gone = shared_blocks([row["keys"][i] for i in row["own"]], row["sizes"], row["bounded"], [x["keys"] for x in near])
                if gone:
                    found.append((row["row"], sorted(gone)))
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([g for _, g in found], pa.list_(pa.int32()))], names=["row", "gone"])

    return table, joined.mapInArrow(compare, "row long, gone array<int>")

"""Personal data: patterns propose spans, checksums confirm them, context adjusts.

Everything is DataFrame expressions over one row, so the whole operator is a projection
of the scan: no shuffle, no Python.  Patterns use possessive quantifiers and anchors at
the start of a run, so that they stay linear on long runs of digits or letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Kinds in the order that breaks ties; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
# Lengths of the national account numbers' IBANs, from the public registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_IBAN = "|".join(f"(?:{'|'.join(v.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, v in IBAN_LENGTHS.items())
#: \G or a look-behind lets a match begin only where a run begins or the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Numbers that the base pattern swallows together with their neighbours, or that lack a plus.
STRICT_PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9])"
#: Words that raise or lower the score of a span near them.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write|mailto)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|call|tel|mobile|fax|cell|whatsapp)\b",
    "iban": r"(?i)\b(?:iban|account|bank|transfer|swift|bic)\b",
    "ssn": r"(?i)\b(?:ssn|social|security|taxpayer)\b",
}
AGAINST = r"(?i)\b(?:version|order|invoice|serial|isbn|sku|part no|build|example)\b"
#: Score of a pattern alone, of one that a checksum or range confirms, and of the context.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.4}
BONUS, MALUS, WINDOW = 0.25, 0.15, 40


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks passes its mod-97 check."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        value = F.when(code >= 65, code - 55).otherwise(code - 48)
        return (acc * F.when(value >= 10, 100).otherwise(10) + value) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the non-overlapping matches, in code points.

    The pieces between matches and the matches themselves add up to the offsets; a text
    without a match is searched once.
    """
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + F.char_length(x["h"])
        one = F.struct(start.alias("start"), end.alias("end"), x["h"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def placed(hits: Column) -> Column:
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h")))
        return F.when(F.size(hits) == 0, none).otherwise(F.aggregate(pairs, zero, step, lambda acc: acc["out"]))

    # one evaluation of the hits, used many times: an array of one element is transformed
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), placed)[0]


def _confirmed(kind: str, value: Column) -> Column:
    """Whether the kind's own validator accepts a match."""
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(value, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)") & ~value.rlike("-00-") & ~value.rlike("-0000$")
    return F.lit(True)


#: A text without this character or pattern has no match of the kind.
_NEEDS = {"email": "@", "ip": ".", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": "+", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "-"}


def _proposed(text: Column, kind: str, pattern: str) -> Column:
    need = _NEEDS[kind]
    there = text.contains(need) if len(need) == 1 else text.rlike(need)
    found = F.filter(matches(text, pattern), lambda x: _confirmed(kind, x["value"]))
    return F.when(there, found).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)"))


def _scored(text: Column, kind: str, spans: Column, base: bool, prior: float) -> Column:
    def one(x: Column) -> Column:
        before = F.substring(text, F.greatest(x["start"] - WINDOW + 1, F.lit(1)), F.least(x["start"], F.lit(WINDOW)))
        after = F.substring(text, x["end"] + 1, F.lit(WINDOW))
        near = F.concat_ws(" ", before, after)
        score = F.lit(prior) + F.when(near.rlike(CONTEXT[kind]), BONUS).otherwise(0.0) - F.when(near.rlike(AGAINST), MALUS).otherwise(0.0)
        return F.struct(
            x["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            x["end"].alias("end"),
            F.lit(kind).alias("kind"),
            F.lit(base).alias("base"),
            F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3).alias("score"),
        )

    return F.transform(spans, one)


def find_pii(docs: DataFrame, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """``docs`` with ``pii``: array<struct<start, rank, end, kind, base, score>>, by start.

    Base spans (email, ip, card, phone) that their validator accepts always stay; the
    others (IBAN, social-security numbers, phones that the base pattern runs together
    with a neighbour or that have no plus) are added where their score reaches
    ``min_score``.  Offsets are code points, end exclusive.  Null and empty texts have
    an empty array; repeated rows are judged alike; a column named pii is replaced.
    """
    out = fresh(docs, "pii").withColumn("__pii_t", F.coalesce(F.col(text_col), F.lit("")))
    t = F.col("__pii_t")
    out = out.withColumns({f"__pii_{k}": _proposed(t, k, PATTERNS[k]) for k in KINDS})
    out = out.withColumn(
        "__pii_more", F.when(t.rlike("[0-9]{3}[.-][0-9]{4}"), _proposed_strict(t)).otherwise(F.filter(F.col("__pii_phone"), lambda x: F.lit(False)))
    )
    base_phone = F.col("__pii_phone")
    apart = F.filter("__pii_more", lambda x: ~F.exists(base_phone, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    parts = [_scored(t, k, F.col(f"__pii_{k}"), k in BASE, PRIOR[k]) for k in KINDS]
    parts.append(_scored(t, "phone", apart, False, 0.5))
    every = F.concat(*parts)
    kept = F.filter(every, lambda x: x["base"] | (x["score"] >= min_score))
    inner = [c for c in out.columns if c.startswith("__pii_")]
    return out.withColumn("pii", F.sort_array(kept)).drop(*inner)


def _proposed_strict(text: Column) -> Column:
    return F.filter(matches(text, STRICT_PHONE), lambda x: _confirmed("phone", x["value"]))


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda x: x["base"] & (x["kind"] == kind))).cast("long")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the spans of every document."""
    found = find_pii(docs.select(id_col, text_col), text_col)
    base = F.filter("pii", lambda x: x["base"])
    return found.select(
        id_col,
        *[_count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_digest(base), 256).alias("base_sha256"),
        _digest(F.col("pii")).alias("spans"),
        F.size(F.filter("pii", lambda x: ~x["base"])).cast("long").alias("n_added"),
        F.array_max(F.transform("pii", lambda x: x["score"])).alias("max_score"),
    )

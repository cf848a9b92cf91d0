"""Secret scan: patterns propose candidates, a random forest removes false positives.

The forest looks at a candidate's length, character transitions, dictionary coverage,
its path and the words around it.  It is trained from labelled findings, whose features
are computed by the very expressions that score the documents; the trained trees become
an array literal that is walked by expressions.  Scanning is a projection of the
documents: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import base64
import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh
from .pii import matches

# Words and pairs of letters that are common in texts and identifiers.
DICTIONARY = (
    "account access action address admin array async auth authorization bearer before build button cache change check client code commit config "
    "connection content context controller count create credential data database default delete description document element enabled "
    "error event example export factory field file filter format function global group handler header hidden http image import index "
    "input insert instance internal invalid item java json key label length library license line list loader local location login main "
    "manager master message method model module name network node null number object option order package page param parent parser "
    "password path placeholder point private process profile project property provider public query random read record reference "
    "release remote remove replace report request resource response result return route sample schema search secret section select "
    "sequence server service session setting simple single size source start state static status storage stream string style system "
    "table target task template test text time token total track transaction type undefined update upload user util value variable "
    "version view warning window with word write your here change this that from have not and the for insert dummy fake"
).split()
LETTER_PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
KEYWORDS = r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|authorization|auth|client[_-]?key)"
HARMLESS = r"(?i)\b(?:sha-?(?:1|256|512)?|md5|commit|checksum|digest|hash|uuid|guid|example|sample|placeholder|dummy|fake|etag|revision|rev|integrity|isbn|order|invoice|tracking|version)\b"
KNOWN = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_.-]+|sk_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}|-----BEGIN (?s:.*))$"
PATH_AGAINST = r"(?i)(?:test|spec|example|sample|fixture|mock|doc|lock|vendor|node_modules|\.min\.|\.svg|\.md$)"
PATH_FOR = r"(?i)(?:\.env|config|secret|credential|settings|deploy|\.pem$|\.ya?ml$|\.properties$)"

#: A run of 16 or more token characters with a digit in it, and base64 padding.
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]*+[0-9])[A-Za-z0-9+/_.-]{16,}+={0,2}"
)
#: What is assigned to a keyword, of any length and characters: all between quotes, else all up to white space or a closing mark.
ASSIGNED = (
    KEYWORDS + r"(?:s|key|value|[_-]\w{1,32})?[\"'`\]]{0,2}[\x20\t]{0,8}(?:=>|:=|[=:])[\x20\t]{0,8}(?:bearer[\x20\t]+|basic[\x20\t]+)?"
    r"(?:\"[^\"\n]++(?=\")|'[^'\n]++(?=')|`[^`\n]++(?=`)|[^\s\"'`](?:[^\s\"'`,;)\]}>]|[,;)\]}>]++(?![\s\"'`]|$))*+)"
)
#: The part of such a match before the value.
_LEAD = KEYWORDS + r"(?:s|key|value|[_-]\w{1,32})?[\"'`\]]{0,2}[\x20\t]{0,8}(?:=>|:=|[=:])[\x20\t]{0,8}(?:bearer[\x20\t]+|basic[\x20\t]+)?[\"'`]?"
#: The password of a URL, and a private key's block of text.
URL_PASSWORD = r"://[^\s/@:\"'<>]++:[^\s/@\"'<>]++(?=@)"
_URL_LEAD = r"://[^\s/@:\"'<>]++:"
KEY_BLOCK = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=,:\s\\]++|-(?!----END))*+(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?"
WINDOW = 40
FEATURES = (
    "length", "digits", "uppers", "hexes", "transitions", "letter_pairs", "vowels", "dictionary", "distinct",
    "keyword", "assigned", "quoted", "harmless", "path_against", "path_for", "known", "runs", "symbols", "url", "code",
)
TREES, DEPTH = 25, 6


def features(value: Column, before: Column, after: Column, path: Column) -> Column:
    """array<double> of FEATURES for a candidate, the text before and after it, and its path."""
    n = F.greatest(F.char_length(value), F.lit(1)).cast("double")
    low = F.lower(value)
    count = lambda pattern, x=value: F.regexp_count(x, F.lit(pattern)).cast("double")
    letters = F.greatest(count("[A-Za-z]"), F.lit(1.0))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "-")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    near = F.concat_ws(" ", before, after)
    by_name = {
        "length": n,
        "digits": count("[0-9]") / n,
        "uppers": count("[A-Z]") / n,
        "hexes": count("[0-9a-fA-F]") / n,
        "transitions": F.char_length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / n,
        "letter_pairs": count(f"(?=(?:{'|'.join(LETTER_PAIRS)})).", low) / n,
        "vowels": count("[aeiou]", low) / letters,
        "dictionary": F.lit(1.0) - F.char_length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "keyword": flag(before.rlike(KEYWORDS)),
        "assigned": flag(before.rlike(r"(?:[:=]|=>|Bearer)\s*[\"'`]?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "harmless": flag(near.rlike(HARMLESS) | before.rlike(r"(?i)(?:integrity|sha\d*|md5)[-_:=]?$")),
        "path_against": flag(path.rlike(PATH_AGAINST)),
        "path_for": flag(path.rlike(PATH_FOR)),
        "known": flag(value.rlike(KNOWN)),
        "runs": flag(value.rlike(r"(.)\1{3,}|0123|1234|abcd|(?i)xxxx")),
        "symbols": count("[+/_=.-]") / n,
        "code": flag(value.rlike(r"^[$<{*%]|[(\[]$|^[A-Za-z_]+(?:\.[A-Za-z_]+)+[(\[]?")),
        "url": flag(before.rlike(r"://[^\s/@:]+:$") & after.startswith("@")),
    }
    return F.array(*[by_name[f] for f in FEATURES])


def labelled_findings(n: int = 2400, seed: int = 11) -> list[tuple[str, str, int]]:
    """(text, path, label) rows with one candidate each; 1 is a secret.  A fifth is short, all letters, or very long.

    A stand-in for a triage log where none is at hand: ``n`` rows drawn from shapes of real
    secrets and of what scanners usually mistake for them.
    """
    rng = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    text = lambda k, chars: "".join(rng.choice(chars) for _ in range(k))
    hexes = lambda k: text(k, "0123456789abcdef")
    words = lambda k, sep: sep.join(rng.choice(DICTIONARY) for _ in range(k))
    filler = lambda: " ".join(text(rng.randint(2, 9), "etaoinshrdlucm") for _ in range(rng.randint(0, 5)))
    good_paths = ["app/config.py", ".env", "deploy/settings.yml", "src/main.java", "notes.txt", "src7", "", "credentials.properties"]
    bad_paths = ["tests/test_auth.py", "docs/readme.md", "package-lock.json", "vendor/a.min.js", "src3", "", "src/util.go"]
    b64 = lambda k: base64.urlsafe_b64encode(rng.randbytes(k)).decode().rstrip("=")
    names = ["token", "api_key", "secret", "password", "SECRET_KEY", "access_key", "passwd", "pwd", "client_secret", "auth_token"]
    rows = []
    while len(rows) < n:
        if rng.random() < 0.2:
            label = rng.randint(0, 1)
            if label:
                kind = rng.randint(0, 6)
                if kind == 5:
                    rows.append((f"{filler()} {rng.choice(['postgres', 'mysql', 'https', 'amqp', 'redis'])}://{text(rng.randint(3, 9), alnum[26:52])}:{text(rng.randint(8, 24), alnum + '!%$*')}@{words(2, '.')}:5432/db".strip(), rng.choice(good_paths), 1))
                    continue
                if kind == 6:
                    body = "\n".join(base64.b64encode(rng.randbytes(48)).decode() for _ in range(rng.randint(3, 20)))
                    rows.append((f"{filler()}\n-----BEGIN {rng.choice(['RSA ', 'EC ', ''])}PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----\n", rng.choice(good_paths), 1))
                    continue
                value = rng.choice([
                    lambda: f"eyJ{b64(24)}.eyJ{b64(rng.randint(60, 240))}.{b64(32)}", lambda: text(rng.randint(129, 400), alnum), lambda: text(rng.randint(18, 48), alnum[:52]),
                    lambda: text(rng.randint(8, 15), alnum + "!@#$%&*"), lambda: rng.choice(DICTIONARY).capitalize() + text(rng.randint(3, 5), "0123456789") + rng.choice("!@#$%"),
                ])()
                lead = rng.choice(names) + rng.choice([' = "{}"', '="{}"', ": {}", "={}", ": '{}'"])
            else:
                value, lead = rng.choice([
                    lambda: (rng.choice(["password", "PASSWORD", "pass", "${DB_PASS}", "xxxxx", "secret", "$PASSWORD", "{password}"]), rng.choice(["https", "postgres", "mysql"]) + "://user:{}@" + words(2, ".")),
                    lambda: (words(1, ""), rng.choice(names) + rng.choice([": {}", " = {}", "={}"])), lambda: (f"{words(2, '_')}", rng.choice(names) + rng.choice([" = {}", ': "{}"'])),
                    lambda: (rng.choice(["None", "null", "true", "false", "required", "string", "str", "changeme", "********", "xxxxxxxx", "<password>", "..."]), rng.choice(names) + rng.choice([": {}", ' = "{}"', "={}"])),
                    lambda: (f"{words(2, '.')}()", rng.choice(names) + " = {}"), lambda: (f"${{{words(2, '_').upper()}}}", rng.choice(names) + rng.choice([": {}", "={}"])),
                    lambda: (f"{words(rng.randint(16, 30), '/')}/v{rng.randint(1, 9)}.js", "{}"), lambda: (f"{words(rng.randint(16, 30), '-')}-{rng.randint(1, 99)}", "{}"),
                    lambda: (text(rng.randint(130, 400), "0123456789"), "{}"), lambda: (hexes(128), "sha512: {}"), lambda: (f"sha512-{base64.b64encode(rng.randbytes(64)).decode()}", 'integrity {}'),
                    lambda: (f"{words(1, '')}.{words(1, '')}[\"{words(2, '_').upper()}\"]", rng.choice(names) + " = {}"),
                ])()
            rows.append((f"{filler()} {lead.format(value)} {filler()}".strip(), rng.choice(good_paths[4:7] + (good_paths[:4] if label else bad_paths)), label))
        elif rng.random() < 0.5:
            value = rng.choice([
                lambda: hexes(rng.choice([32, 40, 40, 48, 64])), lambda: text(rng.randint(20, 48), alnum), lambda: "AKIA" + text(16, alnum[:26] + alnum[52:]),
                lambda: "ghp_" + text(36, alnum), lambda: "sk_live_" + text(24, alnum), lambda: base64.b64encode(rng.randbytes(rng.choice([24, 30, 33]))).decode(),
            ])()
            if not any(c.isdigit() for c in value):
                value += "7"
            name = rng.choice(["token", "api_key", "secret", "password", "SECRET_KEY", "access_key", "auth_token", "client_secret", "Authorization: Bearer", "TOKEN"])
            joint = rng.choice([' = "{}"', '="{}"', ": {}", "={}", ": '{}'", ' = "{}"']) if "Bearer" not in name else " {}"
            line = f"{filler()} {name}{joint.format(value)} {filler()}"
            if rng.random() < 0.2:
                line = line.upper()
            rows.append((line.strip(), rng.choice(good_paths + bad_paths[4:]), 1))
        else:
            shape = rng.randint(0, 9)
            camel = "".join(w.capitalize() for w in words(rng.randint(3, 5), " ").split())
            value, lead = {
                0: (hexes(40), rng.choice(["commit ", "rev ", "revision: "])),
                1: (hexes(64), rng.choice(["sha256:", "checksum: ", "digest = "])),
                2: (f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", rng.choice(["uuid ", "id=", "guid: "])),
                3: (f"{camel}{rng.randint(1, 99)}", rng.choice(["new ", "class ", ""])),
                4: (f"{words(3, '/')}/{words(1, '')}{rng.randint(1, 9)}.{rng.choice(['java', 'html', 'py', 'png'])}", ""),
                5: (f"{words(3, '-')}-{rng.randint(10, 9999)}", rng.choice(["", "key: ", "token = "])),
                6: (rng.choice(["XXXXXXXXXXXXXXXX1234", "your-api-key-here-0000", "0123456789abcdef0123", "changeme-password-1234", "example_token_12345678", "1234567890123456"]), rng.choice(["token = ", "api_key: ", "password="])),
                7: (str(rng.randint(10**15, 10**16)), rng.choice(["", "order ", "no. "])),
                8: (f"{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(100, 255)}.{text(3, 'nmtr')}", ""),
                9: (text(rng.randint(14, 22), "etaoinshrdlu") + str(rng.randint(1, 99)), ""),
            }[shape]
            rows.append((f"{filler()} {lead}{value} {filler()}".strip(), rng.choice(bad_paths + good_paths[3:7]), 0))
    return rows


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> list[tuple[list[int], list[float], list[float]]]:
    """Complete binary trees as (feature, threshold) by node and the share of secrets by leaf."""
    rng = np.random.default_rng(seed)
    tries = max(1, int(math.sqrt(x.shape[1])) + 1)
    out = []
    for _ in range(trees):
        inner, leaves = 2**depth - 1, 2**depth
        feat, thr, leaf = [0] * inner, [math.inf] * inner, [0.0] * leaves
        rows = {0: rng.integers(0, len(y), len(y))}
        for node in range(inner + leaves):
            own = rows.get(node, np.zeros(0, int))
            if node >= inner:
                leaf[node - inner] = float((y[own].sum() + 0.5) / (len(own) + 1.0))
                continue
            best = (math.inf, 0, math.inf)
            if len(own) > 3 and 0 < y[own].sum() < len(own):
                for f in rng.choice(x.shape[1], tries, replace=False):
                    order = own[np.argsort(x[own, f], kind="stable")]
                    v, hits = x[order, f], np.cumsum(y[order])
                    cut = np.flatnonzero(v[1:] > v[:-1])
                    if not len(cut):
                        continue
                    nl = cut + 1.0
                    nr, pl, pr = len(own) - nl, hits[cut] / nl, (hits[-1] - hits[cut]) / (len(own) - nl)
                    gini = (nl * pl * (1 - pl) + nr * pr * (1 - pr)) / len(own)
                    k = int(np.argmin(gini))
                    if gini[k] < best[0]:
                        best = (float(gini[k]), int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
            _, feat[node], thr[node] = best
            right = x[own, best[1]] > best[2]
            rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
        # an unsplit node sends all rows left: its other leaves repeat what the left ones say
        out.append((feat, [t if math.isfinite(t) else 1e300 for t in thr], leaf))
    return out


def forest_score(x: Column, forest: list) -> Column:
    """Mean share of secrets over the trees, as an expression on the feature array."""
    depth = int(math.log2(len(forest[0][2])))
    trees = F.array(
        *[
            F.struct(
                F.array(*[F.lit(v) for v in feat]).alias("f"), F.array(*[F.lit(v) for v in thr]).alias("t"), F.array(*[F.lit(v) for v in leaf]).alias("leaf")
            )
            for feat, thr, leaf in forest
        ]
    )

    def one(acc: Column, tree: Column) -> Column:
        step = lambda i, _: i * 2 + 1 + F.when(x[tree["f"][i]] > tree["t"][i], 1).otherwise(0)
        return acc + tree["leaf"][F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step) - (2**depth - 1)]

    return F.aggregate(trees, F.lit(0.0), one) / len(forest)


def candidates(docs: DataFrame, text_col: str, path: Column) -> DataFrame:
    """``docs`` exploded to one row per candidate, with ``__sc_c`` (start, end, value) and ``__sc_x`` (features).

    Candidates are long runs with a digit, whatever is assigned to a keyword, passwords in
    URLs, and blocks of private keys.  A span that several propose is one candidate.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def after_lead(found: Column, lead: str) -> Column:
        def value_of(m: Column) -> Column:
            value = F.regexp_replace(m["value"], f"^{lead}", "")
            return F.struct((m["end"] - F.char_length(value)).alias("start"), m["end"].alias("end"), value.alias("value"))

        return F.transform(found, value_of)

    proposed = F.array_union(matches(text, CANDIDATE), after_lead(matches(text, ASSIGNED), _LEAD))
    proposed = F.array_union(proposed, F.when(text.contains("://"), after_lead(matches(text, URL_PASSWORD), _URL_LEAD)).otherwise(none))
    proposed = F.array_union(proposed, F.when(text.contains("-----BEGIN"), matches(text, KEY_BLOCK)).otherwise(none))
    each = docs.withColumn("__sc_c", F.explode(proposed))
    c = F.col("__sc_c")
    before = F.substring(text, F.greatest(c["start"] - WINDOW + 1, F.lit(1)), F.least(c["start"], F.lit(WINDOW)))
    after = F.substring(text, c["end"] + 1, F.lit(WINDOW))
    return each.withColumn("__sc_x", features(c["value"], before, after, F.coalesce(path, F.lit(""))))


def fit(spark: SparkSession, findings: list[tuple[str, str, int]] | None = None, max_rows: int = 5000) -> list:
    """The forest fitted on labelled findings (text, path, label), at most ``max_rows`` of them."""
    rows = (findings or labelled_findings())[:max_rows]
    frame = spark.createDataFrame(rows, "text string, path string, label int")
    # of several candidates in one finding the longest is meant
    every = candidates(frame.withColumn("row", F.monotonically_increasing_id()), "text", F.col("path")).select("row", "__sc_x", "label").collect()
    longest: dict = {}
    for r in every:
        if r["row"] not in longest or r["__sc_x"][0] > longest[r["row"]]["__sc_x"][0]:
            longest[r["row"]] = r
    got = [(r["__sc_x"], r["label"]) for _, r in sorted(longest.items())]
    return train_forest(np.array([r[0] for r in got]), np.array([r[1] for r in got]))


def scan_secrets(
    docs: DataFrame, text_col: str = "text", path_col: str | None = None, forest: list | None = None, threshold: float = 0.5
) -> DataFrame:
    """One row per candidate: the columns of ``docs`` but the text, and start, end, sha256, score, is_secret.

    Offsets are code points, end exclusive.  The candidate itself is not repeated, only its
    digest.  Null and empty texts have no candidate and give no row; a null path says
    nothing.  Columns of these names are replaced.  ``path_col`` names the file path.
    """
    forest = forest or fit(docs.sparkSession)
    base = fresh(docs, "start", "end", "sha256", "score", "is_secret")
    path = F.col(path_col) if path_col else F.lit("")
    found = candidates(base, text_col, path)
    found = found.withColumn("score", F.round(forest_score(F.col("__sc_x"), forest), 6))
    return found.select(
        *[F.col(c) for c in base.columns if c != text_col],
        F.col("__sc_c.start").alias("start"),
        F.col("__sc_c.end").alias("end"),
        F.sha2(F.col("__sc_c.value"), 256).alias("sha256"),
        "score",
        (F.col("score") >= threshold).alias("is_secret"),
    )

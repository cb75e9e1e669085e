"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Only DataFrame functions touch the texts. One job finds the candidates with
their votes and writes them to the shared folder; what the driver gets are
counts of vote patterns, whose number is bounded by the kinds, labelers and
buckets and not by the data.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: In the order that breaks ties; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = r"[A-Za-z0-9._%+-]"
#: Leftmost matches of the base patterns. Look-behind and possessive repeats keep the search linear on long runs:
#: a match that may begin inside a run may begin where the run or the search does.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\x22']?\x20*[=:]\x20*[\x22']?[A-Za-z0-9_+/=-]{8,}",
    "national": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Gazetteers of the labelers.
TOP_DOMAINS = "com org net edu gov mil int info io co de fr es uk eu it nl ch at be pl se no dk fi pt ie us ca au jp cn in br ru".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92".split()
CARD_PREFIXES = "4 51 52 53 54 55 34 37 35 36 38 6011 62 64 65".split()
LOCAL_NETS = "0. 10. 127. 192.168. 169.254. 255.".split()
PLACEHOLDERS = "changeme password example xxxxxxxx placeholder undefined".split()
CONTEXT = {
    "email": r"(?i)mail|contact|write|from|to:|@",
    "ip": r"(?i)\bip\b|address|server|host|client|login|addr",
    "card": r"(?i)card|visa|master|amex|credit|debit|pay|account",
    "phone": r"(?i)tel|phone|call|fax|mobile|cell|contact|handy",
    "secret": r"(?i)login|user|auth|key|secret|cred",
}
AGAINST = r"(?i)\b(?:version|release|isbn|issn|doi|section|fig|page|id|no|order|invoice)\b[\x20.:#]*$"
LABELERS = ("form", "gazetteer", "context", "edge")
#: A vote is 1 for personal data, 0 against, 2 for none.
YES, NO, NONE = 1, 0, 2
NEAR = 40
LENGTHS = (8, 16, 32)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    value = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int")  # noqa: E731  the i-th from the right

    def part(i: Column) -> Column:
        twice = value(i) * 2
        return F.when(i % 2 == 0, value(i)).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + part(i))
    return total % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    """The base check of a match."""
    d = _digits(s)
    if kind == "ip":
        return s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    return F.length(d).between(9, 15) if kind == "phone" else F.lit(kind == "email")


def _vote(yes: Column, no: Column | None = None) -> Column:
    v = F.when(yes, YES)
    return (v.when(no, NO) if no is not None else v).otherwise(NONE)


def _form(kind: str, s: Column, ok: Column) -> Column:
    if kind == "email":
        return _vote(s.rlike(r"^[A-Za-z0-9][^@]*@.*\.[A-Za-z]{2,}$") & ~s.contains(".."), F.lit(True))
    if kind == "secret":
        varied = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
        return _vote(varied & (F.length(s) >= 16), ~varied)
    return _vote(ok, ~ok)


def _gazetteer(kind: str, s: Column) -> Column:
    d = _digits(s)
    if kind == "email":
        return _vote(F.lower(F.substring_index(s, ".", -1)).isin(TOP_DOMAINS), s.rlike(r"\.[0-9]+$"))
    if kind == "card":
        known = d.rlike(f"^(?:{'|'.join(CARD_PREFIXES)})")
        return _vote(known, ~known)
    if kind == "phone":
        known = ~s.startswith("+") | d.rlike(f"^(?:{'|'.join(CALLING_CODES)})")
        return _vote(known, ~known)
    if kind == "ip":
        return _vote(F.lit(False), s.rlike(f"^(?:{'|'.join(x.replace('.', '[.]') for x in LOCAL_NETS)})"))
    return _vote(F.lit(False), F.lower(s).rlike("|".join(PLACEHOLDERS)))


def _context(kind: str, before: Column, after: Column) -> Column:
    left, right = F.right(before, F.lit(NEAR)), F.left(after, F.lit(NEAR))
    return _vote(left.rlike(CONTEXT[kind]) | right.rlike(CONTEXT[kind]), left.rlike(AGAINST))


def _side(c: Column) -> Column:
    """0 nothing or white space, 1 letter, 2 digit, 3 other."""
    return F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike(r"^\p{L}$"), 1).when(c.rlike("^[0-9]$"), 2).otherwise(3)


def _found(name: str, text: Column) -> Column:
    """Candidates of one pattern, in order: an array of structs with positions in code points and votes."""
    kind = "phone" if name == "national" else name
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[name]), F.lit(0))
    # the pieces between the matches give the positions
    pieces = F.split(text, PATTERNS[name], -1)
    empty = F.array().cast("array<struct<s:string,before:string,after:string,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        end = acc["end"] + F.length(x["before"]) + F.length(x["s"])
        one = F.struct(x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after"), end.alias("end"))
        return F.struct(end.alias("end"), F.concat(acc["out"], F.array(one)).alias("out"))

    n = F.size(hits)
    parts = F.arrays_zip(hits.alias("s"), F.slice(pieces, 1, n).alias("before"), F.slice(pieces, 2, n).alias("after"))
    placed = F.aggregate(parts, F.struct(F.lit(0).alias("end"), empty.alias("out")), step, lambda acc: acc["out"])
    if name == "national":  # a part of an international number isn't one
        placed = F.filter(placed, lambda x: ~x["before"].rlike(r"\+[0-9]{1,3}[\x20().-]*$"))

    def judged(x: Column) -> Column:
        s = F.regexp_extract(x["s"], r"[=:]\x20*[\x22']?(.*)$", 1) if kind == "secret" else x["s"]
        base = F.lit(False) if name in ("secret", "national") else _valid(kind, s)
        ok = (F.length(_digits(s)) == 10) if name == "national" else base
        left, right = _side(F.right(x["before"], F.lit(1))), _side(F.left(x["after"], F.lit(1)))
        glued = left.isin(1, 2) | right.isin(1, 2)
        size = sum((F.length(s) > n).cast("int") for n in LENGTHS)
        votes = {"form": _form(kind, s, ok), "gazetteer": _gazetteer(kind, s), "context": _context(kind, x["before"], x["after"]), "edge": _vote(F.lit(False), glued)}
        return F.struct(
            (x["end"] - F.length(s)).alias("start"), x["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), base.alias("base"),
            *(votes[k].alias(k) for k in LABELERS), size.alias("size"), left.alias("left"), right.alias("right"),
        )

    return F.transform(placed, judged)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the array of candidate spans, one row per row of docs; a null text counts as empty."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select("doc_id", t.alias("text"))
    text = F.col("text")
    digit = text.rlike("[0-9]")
    gate = {"email": text.contains("@"), "phone": text.contains("+"), "secret": text.contains("=") | text.contains(":")}
    parts = {k: F.when(gate.get(k, digit), _found(k, text)) for k in PATTERNS}
    df = df.withColumns({f"__{k}": c for k, c in parts.items()})
    whole = F.concat(*(F.coalesce(f"__{k}", F.array().cast(df.schema["__ip"].dataType)) for k in PATTERNS))
    return df.select("doc_id", whole.alias("spans"))


def expectation_maximisation(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> dict:
    """Posterior that a span is personal data, by (kind, votes), from counts of (kind, votes, n).

    Two classes and independent labelers given the class, by kind; each
    labeler's chances of voting yes, no or nothing in each class are
    estimated. Their Dirichlet prior, a quarter of the kind's spans in
    weight, is of labelers that are right four times in five, which tells the
    classes apart where all spans of a kind are alike.
    """
    post: dict = {}
    for kind in {k for k, _, _ in patterns}:
        own = [(v, n) for k, v, n in patterns if k == kind]
        believed = [[0.48, 0.12, 0.4], [0.12, 0.48, 0.4]]
        strength = max(2.0, sum(n for _, n in own) / 4)
        chance = [believed for _ in LABELERS]
        prior = 0.5
        for _ in range(rounds):
            weight = [[[strength * x for x in row] for row in believed] for _ in LABELERS]
            mass, total = 1.0, 2.0
            for votes, n in own:
                odds = math.log(prior / (1 - prior))
                odds += sum(math.log(chance[j][1][v] / chance[j][0][v]) for j, v in enumerate(votes))
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
                post[kind, votes] = p
                mass, total = mass + n * p, total + n
                for j, v in enumerate(votes):
                    weight[j][1][v] += n * p
                    weight[j][0][v] += n * (1 - p)
            prior = mass / total
            chance = [[[x / sum(w) for x in w] for w in pair] for pair in weight]
    return post


def features(kind: int, votes: tuple[int, ...], size: int, left: int, right: int) -> list[int]:
    """Indices of a span's features among `width()`: kind with each vote, kind with length, what stands beside it."""
    k, v = len(KINDS), len(LABELERS)
    own = [kind * 3 * v + 3 * j + x for j, x in enumerate(votes)]
    at = k * 3 * v
    return [*own, at + kind * (len(LENGTHS) + 1) + size, at + k * (len(LENGTHS) + 1) + left, at + k * (len(LENGTHS) + 1) + 4 + right]


def width() -> int:
    return len(KINDS) * (3 * len(LABELERS) + len(LENGTHS) + 1) + 8


def span_classifier(rows: list[tuple[tuple, float, int]], steps: int = 300, l2: float = 1e-3) -> list[float]:
    """Weights and bias of a logistic regression on (features, target, n), by gradient descent."""
    if not rows:
        return [0.0] * (width() + 1)
    x = np.zeros((len(rows), width() + 1))
    for i, (f, _, _) in enumerate(rows):
        x[i, [*features(*f), width()]] = 1
    y, n = np.array([r[1] for r in rows]), np.array([float(r[2]) for r in rows])
    share, w = np.sqrt(n) / np.sqrt(n).sum(), np.zeros(width() + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 4.0 * (x.T @ (share * (p - y)) + l2 * w)
    return [float(v) for v in w]


def fit(found: DataFrame) -> list[float]:
    """Weights of the span classifier, from the candidates of all documents."""
    keys = ["kind", *LABELERS, "size", "left", "right"]
    spans = found.select(F.explode("spans").alias("x")).select(*(F.col("x")[k].alias(k) for k in keys))
    rows = spans.groupBy(*keys).count().orderBy(*keys).collect()
    votes = lambda r: tuple(r[k] for k in LABELERS)
    patterns: dict = defaultdict(int)
    for r in rows:
        patterns[r["kind"], votes(r)] += r["count"]
    post = expectation_maximisation(sorted((k, v, n) for (k, v), n in patterns.items()))
    return span_classifier([((r["kind"], votes(r), r["size"], r["left"], r["right"]), post[r["kind"], votes(r)], r["count"]) for r in rows])


def _score(x: Column, weights: list[float]) -> Column:
    """The log odds of a candidate."""
    k, v = len(KINDS), len(LABELERS)
    table, sizes = F.array(*map(F.lit, weights)), len(LENGTHS) + 1
    at = k * 3 * v
    places = [x["kind"] * (3 * v) + 3 * j + x[name] for j, name in enumerate(LABELERS)]
    places += [x["kind"] * sizes + at + x["size"], x["left"] + (at + k * sizes), x["right"] + (at + k * sizes + 4)]
    return sum((table[p] for p in places), F.lit(weights[-1]))


def _joined(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, comma-joined; equal ones once."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.array_distinct(F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"]))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Personal data in every row of docs.

    n_email, n_ip, n_card and n_phone count the base spans; `base` and
    `spans` list base and all spans, as kind:start:end in code points. Spans
    the classifier gives `threshold` or more are added to the base ones:
    credentials, national phone numbers, and matches that fail a base check
    but convince. A null or empty text has no spans. Repeated rows each give a
    row; an empty table gives an empty result; columns other than doc_id and
    text are ignored.
    """
    found = materialize(candidates(docs))
    weights = fit(found)
    level = math.log(threshold / (1 - threshold))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long")
    df = found.withColumn("base", base).withColumn(
        "all", F.filter("spans", lambda x: x["base"] | (_score(x, weights) >= level))
    )
    return df.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:4]), _joined(F.col("base")).alias("base"), _joined(F.col("all")).alias("spans")
    )

"""Personal data by weak supervision, in DataFrame functions only.

1. Strict patterns give the base spans, looser ones further candidates. Texts are read once; spans are written.
2. Five labelers vote for, against or not at all on every candidate: its format, a gazetteer, the words before it, its
   borders and its grouping.
3. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is and how
   likely each pattern is personal data. The counts are at most kinds x 3^5 rows, whatever the corpus.
4. A logistic span classifier is trained on those likelihoods over votes, length and share of digits, from the counts
   of distinct feature rows, and decides which candidates are added. Base spans always stay.

No join and no shuffle of texts: only counts are grouped.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpgrid.llm.common import documents, stored

BASE = ("email", "ip", "card", "phone")
KINDS = BASE + ("name", "secret", "ssn")
LABELERS = ("v_format", "v_gazetteer", "v_context", "v_border", "v_group")
CONTEXT = 32  # characters before a span that the context labeler sees
BLOCK = 64

# Patterns. A look-behind with \G lets a long run be tried once only, from its start or from the last match's end;
# possessive groups need no stack. Both leave the leftmost matches of the plain patterns as they are.
LOCAL = r"A-Za-z0-9._%+-"
STRICT = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]++"
    r"\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z]{2,}",
    "phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?",
    "secret": r"(?<![0-9A-Fa-f])[0-9a-f]{32,64}(?![0-9A-Fa-f])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must have before a pattern is tried on it.
GATE = {
    ("email", True): "@",
    ("ip", True): r"[0-9]\.[0-9]",
    ("card", True): r"[0-9](?:[\x20-]?[0-9]){12}",
    ("phone", True): r"\+[0-9]",
    ("email", False): r"[\[(\x20]dot[\])\x20]",
    ("phone", False): r"[0-9]{3}[\x20.-][0-9]{4}",
    ("name", False): r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.?\x20[A-Z]",
    ("secret", False): r"[0-9a-f]{32}",
    ("ssn", False): r"[0-9]-[0-9]{2}-[0-9]",
}
OCTETS = r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])){3}$"
#: The gazetteer: endings, prefixes and titles known for a kind.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])\x20]\x20?)(?:com|org|net|edu|gov|io|info|de|fr|es|eu|uk)$",
    "ip": r"^(?:10|127|172|192|8|1)\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|62|35)",
    "phone": r"^(?:\+1|\+33|\+34|\+44|\+49|\(?[2-9][0-9]{2}\)?)",
    "name": r"^(?:Mr|Mrs|Ms|Dr|Prof)",
    "secret": r"(?=.*[a-f])(?=.*[0-9])",
    "ssn": r"^(?!000|666|9)",
}
#: Words before a span that speak for a kind, and those that speak against any.
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach)",
    "ip": r"(?i)(?:\bip\b|address|host|server|from|login)",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|payment)",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|contact)",
    "name": r"(?i)(?:name|dear|contact|signed|from)",
    "secret": r"(?i)(?:token|key|secret|password|passwd|auth|api)",
    "ssn": r"(?i)(?:ssn|social|security|tax)",
}
AGAINST = r"(?i)(?:version|isbn|issn|order|invoice|page|figure|section|sha|md5|commit|checksum)"
GROUPING = {
    "email": r"^[^\x20]+$",
    "ip": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
    "card": r"^(?:[0-9]{4}[\x20-]){3}[0-9]{1,7}$|^3[47][0-9]{2}[\x20-][0-9]{6}[\x20-][0-9]{5}$",
    "phone": r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$",
    "name": r"\x20[A-Z][a-z]+\x20[A-Z]",
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$",
    "ssn": r"-",
}


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_sums(values: Column) -> Column:
    """The sums of all entries up to each one, block by block, so long arrays cost little more than their length."""

    def total(block):
        return F.aggregate(block, F.lit(0), lambda x, y: x + y)

    def sums(block, start):
        return F.transform(block, lambda _, i: start + total(F.slice(block, 1, i + 1)))

    def of_blocks(blocks):
        return let(
            F.transform(blocks, total),
            lambda totals: F.flatten(
                F.transform(blocks, lambda block, i: let(total(F.slice(totals, 1, i)), lambda start: sums(block, start)))
            ),
        )

    def of_values(v):
        last = F.ceil(F.size(v) / BLOCK).cast("int") - 1
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
        return let(blocks, of_blocks)

    return let(values, of_values)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(13, 19), F.call_function("luhn_check", _digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _matches(text: Column, kind: str, strict: bool) -> Column:
    """The leftmost matches of a pattern as (kind, start, end, value, before, after), in code points."""
    pattern = (STRICT if strict else LOOSE)[kind]

    def span(end, value):
        start = end - F.length(value)
        return F.struct(
            F.lit(kind).alias("kind"),
            start.alias("start"),
            end.alias("end"),
            value.alias("value"),
            F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))).alias("before"),
            F.substring(text, end + 1, F.lit(1)).alias("after"),
        )

    def spans(found):
        # What stands before each match, then the match: their lengths add up to its end.
        steps = F.zip_with(
            F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m)
        )
        return F.zip_with(running_sums(steps), found, span)

    kind_of = "array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>"
    return F.when(
        text.rlike(GATE[kind, strict]), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)
    ).otherwise(F.array().cast(kind_of))


def _voted(x: Column) -> Column:
    """A candidate with its votes (1 for, -1 against, 0 none) and the other features of the classifier."""
    kind, value = x["kind"], x["value"]

    def by_kind(table, of):
        picked = F.lit(False)
        for name, pattern in table.items():
            picked = F.when(kind == name, of.rlike(pattern)).otherwise(picked)
        return picked

    valid = F.lit(True)
    for name in ("ip", "card", "phone"):
        valid = F.when(kind == name, _valid(name, value)).otherwise(valid)
    strict = by_kind({k: "^(?:" + p.replace(r"|\G", "") + ")$" for k, p in STRICT.items()}, value)
    glued = x["before"].rlike("[A-Za-z0-9]$") | x["after"].rlike("^[A-Za-z0-9]")
    digits = F.length(_digits(value)) / F.length(value)
    return F.struct(
        kind.alias("kind"),
        x["start"].alias("start"),
        x["end"].alias("end"),
        (strict & valid & kind.isin(*BASE)).alias("base"),
        F.when(~valid, -1).when(strict, 1).otherwise(0).alias("v_format"),
        F.when(by_kind(GAZETTEER, value), 1).otherwise(-1).alias("v_gazetteer"),
        F.when(by_kind(CUES, x["before"]), 1).when(x["before"].rlike(AGAINST), -1).otherwise(0).alias("v_context"),
        F.when(glued, -1).otherwise(1).alias("v_border"),
        F.when(by_kind(GROUPING, value), 1).otherwise(0).alias("v_group"),
        F.least(F.floor(F.log2(F.length(value))), F.lit(7)).cast("int").alias("size"),
        F.floor(4 * digits).cast("int").alias("digits"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, more) of every document: its base spans and the further candidates, both with votes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = kept.select(
        "doc_id",
        *(_matches(F.col("text"), kind, True).alias(f"s_{kind}") for kind in BASE),
        *(_matches(F.col("text"), kind, False).alias(f"l_{kind}") for kind in LOOSE),
    )
    every = F.concat(*(f"s_{k}" for k in BASE), *(f"l_{k}" for k in LOOSE))
    voted = found.select("doc_id", F.transform(every, _voted).alias("spans"))
    return voted.select(
        "doc_id",
        F.filter("spans", lambda x: x["base"]).alias("base"),
        F.filter("spans", lambda x: ~x["base"]).alias("more"),
    )


def estimate(rows: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> dict:
    """EM over (kind, votes, count): the likelihood that a pattern of votes is personal data, and the
    reliability of each labeler, P(vote | truth), shared by all kinds. Starts from the majority of votes."""
    kinds = sorted({k for k, _, _ in rows})
    votes = np.array([v for _, v, _ in rows]) + 1
    count = np.array([n for _, _, n in rows], dtype=float)
    of = np.array([kinds.index(k) for k, _, _ in rows])
    truth = 1 / (1 + np.exp(-(votes - 1).sum(axis=1).astype(float)))
    for _ in range(rounds):
        prior = np.array([(1 + (count * truth)[of == k].sum()) / (2 + count[of == k].sum()) for k in range(len(kinds))])
        score = np.log(prior[of]) - np.log(1 - prior[of])
        says = np.zeros((2, votes.shape[1], 3))
        for j, vote in product(range(votes.shape[1]), range(3)):
            at = votes[:, j] == vote
            says[1, j, vote] = 1 + (count * truth)[at].sum()
            says[0, j, vote] = 1 + (count * (1 - truth))[at].sum()
        says /= says.sum(axis=2, keepdims=True)
        for j in range(votes.shape[1]):
            score += np.log(says[1, j, votes[:, j]]) - np.log(says[0, j, votes[:, j]])
        truth = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return {"truth": {(k, tuple(v)): float(t) for (k, v, _), t in zip(rows, truth, strict=True)}, "says": says}


FEATURES = ("kind", *LABELERS, "size", "digits")


def train(rows: list[tuple[tuple, float, int]], rounds: int = 30, ridge: float = 1.0) -> dict[tuple[str, str], float]:
    """Weights of the span classifier by Newton steps: (feature, value) -> weight, from (features, likelihood, count)."""
    names = sorted({(f, str(v)) for x, _, _ in rows for f, v in zip(FEATURES, x, strict=True)}) + [("", "")]
    place = {n: i for i, n in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, (values, _, _) in enumerate(rows):
        x[i, [place[f, str(v)] for f, v in zip(FEATURES, values, strict=True)]] = 1
    x[:, -1] = 1
    y, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], dtype=float)
    n = n / n.sum() * min(n.sum(), 1e6)
    w = np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (n * p * (1 - p))[:, None]) + ridge * np.eye(len(names))
        w -= np.linalg.solve(hessian, x.T @ (n * (p - y)) + ridge * w)
    return dict(zip(names, w.tolist(), strict=True))


def _score(x: Column, weights: dict[tuple[str, str], float]) -> Column:
    total = F.lit(weights.get(("", ""), 0.0))
    for feature in FEATURES:
        own = {v: w for (f, v), w in weights.items() if f == feature}
        if own:
            table = F.create_map(*(F.lit(z) for pair in own.items() for z in pair))
            total = total + F.coalesce(F.try_element_at(table, x[feature].cast("string")), F.lit(0.0))
    return total


def _listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    def of(kind):
        own = F.transform(F.filter(spans, lambda x: x["kind"] == kind), lambda x: F.struct(x["start"], x["end"]))
        return F.transform(F.array_sort(own), lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))

    return F.array_join(F.concat(*map(of, kinds)), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row of ``docs``.

    Spans are in code points, the end exclusive. A null or empty text has none. Added spans never
    overlap base spans. With no candidate at all in the corpus, nothing is trained and nothing added.
    """
    found = stored(candidates(docs), "pii-candidates")
    spans = found.select(F.explode(F.concat("base", "more")).alias("x")).select("x.*")
    counted = spans.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by the features' values
    weights: dict[tuple[str, str], float] = {}
    if counted:
        pattern: dict[tuple, int] = {}
        for r in counted:
            key = (r["kind"], tuple(r[v] for v in LABELERS))
            pattern[key] = pattern.get(key, 0) + r["n"]
        truth = estimate([(k, v, n) for (k, v), n in sorted(pattern.items())])["truth"]
        weights = train(
            [(tuple(r[f] for f in FEATURES), truth[r["kind"], tuple(r[v] for v in LABELERS)], r["n"]) for r in sorted(counted)]
        )
    added = (
        F.filter(
            F.filter("more", lambda x: _score(x, weights) >= 0) if weights else F.slice("more", 1, 0),
            lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
        )
        if weights
        else F.slice("more", 1, 0)
    )
    listed = found.withColumn("added", added)

    def number(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return listed.select(
        "doc_id",
        *(number(kind) for kind in BASE),
        F.sha2(_listed(F.col("base"), BASE), 256).alias("base_sha256"),
        _listed(F.concat("base", "added"), KINDS).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op5_pii(spark, sf_dir):
    return find_personal_data(documents(spark, sf_dir))

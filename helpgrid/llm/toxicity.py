"""Toxicity by maximum-scoring segments of token log-odds.

1. A lexicon: words (and the first letters of longer words) get the log-odds of standing in toxic and in clean
   documents, with an informative Dirichlet prior, drawn towards zero by two standard deviations. It is fitted on at most
   ``MAX_LABELS`` labelled documents and holds every entry that is still not zero then, rare ones too; so the words of
   these documents bound what is broadcast.
2. A linear scan over every whole text finds all maximal segments whose sum of scores no extension raises. Words
   outside the lexicon cost ``GAP``, so scores are negative in the mean and segments stay local.
3. Extreme-value calibration: by chance a text of n words has a segment above S with expectation K n exp(-lambda S). Lambda
   follows from the clean words' scores, K from the clean documents. A document's statistic
   is the significance of all its segments beyond chance.
4. A logistic curve over that statistic gives the score; its counts come from labelled documents that the lexicon has not seen.
"""

from __future__ import annotations

import math
import string
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpgrid.llm.common import WordCache, bounded_labels, documents, ship_package, stored, table

MAX_LABELS = 200_000
PRIOR = 1000.0  # pseudo-count of the prior, shared by all words as they occur
GAP = 0.3
STEM, STEM_OF = 5, 7  # first characters that stand for a word of at least so many
PUNCTUATION = string.punctuation.encode()
BIN = 0.25  # width of the calibration's bins


def forms(word: bytes) -> list[bytes]:
    """What a word is counted as: itself without punctuation around it, and its stem, marked."""
    word = word.strip(PUNCTUATION)
    if not word:
        return []
    letters = word.decode("utf-8", "replace")
    return [word, b"\x00" + letters[:STEM].encode()] if len(letters) >= STEM_OF else [word]


def _presence(batches):
    counts: defaultdict[bytes, list[int]] = defaultdict(lambda: [0, 0])

    def rows():
        words = list(counts)
        toxic, clean = zip(*counts.values(), strict=True)
        counts.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())],
            names=["form", "toxic", "clean"],
        )

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
            seen = {f for w in set((text.as_py() or b"").lower().split()) for f in forms(w)}
            for form in seen:
                counts[form][0 if label else 1] += 1
            if len(counts) > 500_000:
                yield rows()
    if counts:
        yield rows()


def log_odds(counts: DataFrame) -> tuple[dict[bytes, float], list[tuple[float, float]]]:
    """The lexicon and the distribution of scores in clean documents, as (score, share), from (form, toxic, clean)."""
    totals = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    if not totals.t or not totals.c:
        return {}, []
    every = totals.t + totals.c
    prior = PRIOR * (F.col("toxic") + F.col("clean")) / every
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(a / (totals.t + PRIOR - a)) - F.log(b / (totals.c + PRIOR - b))
    sure = F.abs(odds) - 2 * F.sqrt(1 / a + 1 / b)
    ranked = (
        counts.select("form", "clean", (F.signum(odds) * sure).alias("score"), sure.alias("sure"))
        .where("sure > 0")
        .orderBy(F.desc("sure"), "form")
        .collect()  # forms of at most MAX_LABELS documents
    )
    lexicon = {bytes(r.form): r.score for r in ranked}
    shares: defaultdict[float, float] = defaultdict(float)
    for r in ranked:
        shares[round(r.score - GAP, 2)] += r.clean / totals.c
    shares[-GAP] += max(0.0, 1 - sum(shares.values()))
    return lexicon, sorted(shares.items())


def decay(shares: list[tuple[float, float]]) -> float:
    """Lambda: the positive root of sum p exp(lambda s) = 1; large where positive scores hardly occur."""
    low, high = 1e-6, 50.0
    s, p = (np.array(x) for x in zip(*shares, strict=True))
    if not (s > 0).any():
        return 1.0
    for _ in range(100):
        middle = (low + high) / 2
        if (p * np.exp(np.minimum(middle * s, 700))).sum() < 1:
            low = middle
        else:
            high = middle
    return min(max(low, 0.05), 5.0)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, sum), in linear time; end exclusive."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int]] = []
    links: list[int] = []  # for each, the place of the nearest earlier one that starts lower, or -1
    for start, end in zip(at.tolist(), (at + 1).tolist(), strict=True):
        while True:
            j = len(found) - 1
            while j >= 0 and sums[found[j][0]] >= sums[start]:
                j = links[j]
            if j < 0 or sums[found[j][1]] >= sums[end]:
                found.append((start, end))
                links.append(j)
                break
            start = found[j][0]
            del found[j:], links[j:]
    return [(a, b, float(sums[b] - sums[a])) for a, b in found]


def _scan(shared):
    lexicon = shared.value

    def of(word: bytes) -> float:
        known = [lexicon[f] for f in forms(word) if f in lexicon]
        return (max(known) if known else 0.0) - GAP

    def run(batches):
        cache = WordCache(of, np.float64)
        for batch in batches:
            words, sums, spans = [], [], []
            for text in batch.column("text"):
                scores = cache.values_of((text.as_py() or b"").lower().split())
                found = maximal_segments(scores)
                words.append(len(scores))
                sums.append([s for _, _, s in found])
                spans.append([f"{a}:{b}" for a, b, _ in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(words, pa.int64()),
                    pa.array(sums, pa.list_(pa.float64())),
                    pa.array(spans, pa.list_(pa.string())),
                ],
                names=["doc_id", "words", "sums", "spans"],
            )

    return run


def logistic(counts: list[tuple[float, int, int]]) -> tuple[float, float, float]:
    """(intercept, slope, step at zero) of the chance of label 1, from (statistic, positives, negatives)."""
    if not counts:
        return (-20.0, 0.0, 0.0)
    x, pos, neg = (np.array(c, dtype=float) for c in zip(*counts, strict=True))
    features = np.stack([np.ones_like(x), x, x > 0], axis=1)
    n, w = pos + neg, np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        hessian = features.T @ (features * (n * p * (1 - p))[:, None]) + 0.05 * np.eye(3)
        step = np.linalg.solve(hessian, features.T @ (n * p - pos) + 0.05 * w)
        w -= np.clip(step, -2, 2)
    return tuple(float(v) for v in w)


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_words, n_segments, p_value, segments) for every row of ``docs``.

    Labels count only where crc32(doc_id) mod ``folds`` is not ``held_out``: the last fold calibrates, the others
    make the lexicon. A null or empty text has no segment and gets the score of texts without any. A null
    doc_id is not held out. Without labels of both kinds all scores are near 0. ``segments`` are start:end in words.
    """
    spark = docs.sparkSession
    ship_package(spark)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(folds))
    kept = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")
    )
    learn = labels.withColumn("_fold", fold).where(F.col("_fold") != held_out).drop("_fold")
    known = stored(bounded_labels(learn, label, MAX_LABELS), "toxic-labels").withColumn("fold", fold)
    last = folds - 1 if held_out != folds - 1 else folds - 2
    teach = known.where(F.col("fold") != last).select("doc_id", "label")
    counts = stored(
        kept.join(F.broadcast(teach), "doc_id")  # at most MAX_LABELS rows of 12 bytes
        .select("text", "label")
        .mapInArrow(_presence, "form binary, toxic long, clean long")
        .groupBy("form")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")),
        "toxic-forms",
    )
    lexicon, shares = log_odds(counts)
    rate = decay(shares) if shares else 1.0
    shared = spark.sparkContext.broadcast(lexicon)
    found = stored(
        kept.mapInArrow(_scan(shared), "doc_id long, words long, sums array<double>, spans array<string>"), "toxic-segments"
    )
    size = F.greatest("words", F.lit(1))
    top = F.coalesce(F.array_max("sums"), F.lit(0.0))
    judge = known.where(F.col("fold") == last).select("doc_id", "label")
    tested = found.join(judge, "doc_id").select("label", "words", "sums")
    mean = tested.where("label = 0").agg(F.avg(rate * top - F.log(size)).alias("m")).first().m
    log_k = min(0.0, (mean if mean is not None else 0.0) - 0.5772)
    beyond = F.aggregate(
        F.transform("sums", lambda s: F.greatest(rate * s - F.log(size) - log_k, F.lit(0.0))), F.lit(0.0), lambda x, y: x + y
    )
    binned = (
        tested.select("label", (F.round(beyond / BIN) * BIN).alias("bin"))
        .select("label", F.least("bin", F.lit(100.0)).alias("bin"))
        .groupBy("bin")
        .agg(F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("n"))
        .collect()  # at most 100 / BIN rows
    )
    intercept, slope, step = logistic([(r.bin, r.pos, r.n - r.pos) for r in sorted(binned)] if lexicon else [])
    statistic = F.least(F.round(beyond / BIN) * BIN, F.lit(100.0))
    line = intercept + slope * statistic + F.when(statistic > 0, step).otherwise(0.0)
    score = 1 / (1 + F.exp(-line))
    return found.select(
        "doc_id",
        F.coalesce(fold == held_out, F.lit(False)).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        F.col("words").alias("n_words"),
        F.size("sums").alias("n_segments"),
        (1 - F.exp(-size * math.exp(log_k) * F.exp(-rate * top))).alias("p_value"),
        F.array_join("spans", ",").alias("segments"),
    )


def op3_toxicity(spark, sf_dir):
    return score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))

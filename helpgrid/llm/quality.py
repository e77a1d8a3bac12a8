"""Quality grades by ordinal cumulative-link regression over hashed text.

P(grade >= k) = logistic(w.x - t_k): one weight vector for all grades and ordered thresholds t_1 < t_2 < ... Features
are hashed words and word shapes, scaled to unit length, and buckets of the text's size, variety and repetition.

The model is fitted on at most ``MAX_LABELS`` labelled documents. Their features are written once; in each round
every partition makes a pass of stochastic gradient steps from the shared weights, and the weights are
averaged. Every whole text is then scored: expected grade and the probability of at least a given grade.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from helpgrid.llm.common import WordCache, bounded_labels, documents, ship_package, stored, table

MAX_LABELS = 200_000
DIM = 1 << 16
SIDE = 256  # the last features are buckets
PARTS, ROUNDS, BATCH, RATE = 16, 5, 32, 0.5
PUNCTUATION = string.punctuation.encode()
SHAPES = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"9"))


def word_features(word: bytes) -> int:
    """Two hashed features in one number: the word itself, lower-cased without punctuation, and its shape."""
    shape = word
    for pattern, letter in SHAPES:
        shape = pattern.sub(letter, shape)
    bare = word.strip(PUNCTUATION).lower()
    room = DIM - SIDE
    return (xxhash.xxh64_intdigest(b"w" + bare) % room) << 32 | (xxhash.xxh64_intdigest(b"s" + shape) % room)


def features(text: bytes, cache: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text; empty without words."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    codes = cache.values_of(words)
    places, values = [], []
    for of in (codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)):
        place, n = np.unique(of.astype(np.int64), return_counts=True)
        value = np.sqrt(n)
        places.append(place)
        values.append(value / np.linalg.norm(value))
    variety = len(np.unique(codes)) / len(words)
    repeats = float((codes[1:] == codes[:-1]).mean()) if len(words) > 1 else 0.0
    first = DIM - SIDE
    buckets = [
        min(int(np.log2(len(words))), 31),
        32 + int(variety * 31),
        64 + int(np.sqrt(repeats) * 31),
        96 + min(int(len(text) / len(words)), 31),
    ]
    places.append(first + np.array(buckets))
    values.append(np.full(len(buckets), 0.5))
    return np.concatenate(places), np.concatenate(values)


def _extract(batches):
    cache = WordCache(word_features)
    for batch in batches:
        rows = [features(x.as_py() or b"", cache) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("label"),
                pa.array([p for p, _ in rows], pa.list_(pa.int64())),
                pa.array([v for _, v in rows], pa.list_(pa.float64())),
            ],
            names=["label", "places", "values"],
        )


def thresholds(steps: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free numbers: the first, then the logarithms of the gaps."""
    return steps[0] + np.concatenate([[0.0], np.cumsum(np.exp(steps[1:]))])


def tails(score: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade >= k) for each score (rows) and grade from the second on (columns)."""
    return 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -30, 30)))


def slopes(score: np.ndarray, grade: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the negative log-likelihood by score and by each threshold (rows: documents)."""
    p = tails(score, cuts)
    one, zero = np.ones((len(score), 1)), np.zeros((len(score), 1))
    wide = np.hstack([one, p, zero])
    slope = np.hstack([zero, p * (1 - p), zero])
    row = np.arange(len(score))
    likelihood = np.maximum(wide[row, grade] - wide[row, grade + 1], 1e-9)
    by_cut = np.zeros((len(score), len(cuts) + 2))
    by_cut[row, grade] += slope[row, grade] / likelihood
    by_cut[row, grade + 1] -= slope[row, grade + 1] / likelihood
    by_score = -(slope[row, grade] - slope[row, grade + 1]) / likelihood
    return by_score, by_cut[:, 1:-1]


def _pass(grades: list[int], model, seed: int):
    def run(batches):
        weights, steps, squares, step_squares = (x.copy() for x in model.value)
        labels, sizes, places, values = [], [], [], []
        for batch in batches:  # numbers stay in flat arrays: 12 bytes a feature
            labels.append(np.searchsorted(grades, batch.column("label").to_numpy()))
            sizes.append(np.diff(batch.column("places").offsets.to_numpy()))
            places.append(batch.column("places").flatten().to_numpy().astype(np.int32))
            values.append(batch.column("values").flatten().to_numpy())
        if not labels:
            return
        labels, sizes, places, values = (np.concatenate(x) for x in (labels, sizes, places, values))
        begins = np.cumsum(sizes) - sizes
        order = np.random.default_rng(seed).permutation(len(labels))
        for start in range(0, len(order), BATCH):
            part = order[start : start + BATCH]
            size = sizes[part]
            at = np.arange(size.sum()) + np.repeat(begins[part] - (np.cumsum(size) - size), size)
            place, value = places[at], values[at]
            row = np.repeat(np.arange(len(part)), size)
            score = np.bincount(row, weights[place] * value, minlength=len(part))
            by_score, by_cut = slopes(score, labels[part], thresholds(steps))
            gradient = np.bincount(place, by_score[row] * value, minlength=DIM) / len(part)
            at = np.flatnonzero(gradient)
            squares[at] += gradient[at] ** 2
            weights[at] -= RATE * gradient[at] / (np.sqrt(squares[at]) + 1e-6)
            cut = by_cut.mean(axis=0)
            by_step = np.cumsum(cut[::-1])[::-1].copy()
            by_step[1:] *= np.exp(steps[1:])
            step_squares += by_step**2
            steps = steps - RATE * by_step / (np.sqrt(step_squares) + 1e-6)
        if len(labels):
            state = [weights, steps, squares, step_squares]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(labels)]), pa.array([b"".join(x.astype(np.float64).tobytes() for x in state)], pa.binary())],
                names=["n", "state"],
            )

    return run


def fit(rows: DataFrame, grades: list[int], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, threshold steps) from (label, places, values). The state that reaches the driver in a round
    is 1 MB for each of PARTS partitions."""
    cuts = len(grades) - 1
    steps = np.zeros(cuts)
    state = [np.zeros(DIM), steps, np.full(DIM, 1e-8), np.full(cuts, 1e-8)]
    ends = np.cumsum([len(x) for x in state])[:-1]
    for turn in range(rounds):
        model = rows.sparkSession.sparkContext.broadcast(state)
        done = rows.mapInArrow(_pass(grades, model, turn), "n long, state binary").collect()
        done.sort(key=lambda r: (r.n, bytes(r.state)))
        if not done:  # no labelled document is there
            break
        n = np.array([r.n for r in done], dtype=float)
        total = sum(w * np.frombuffer(r.state, np.float64) for w, r in zip(n / n.sum(), done, strict=True))
        state = [x.copy() for x in np.split(total, ends)]
    return state[0], state[1]


def _grade(shared):
    def run(batches):
        weights, cuts, grades = shared.value
        cache = WordCache(word_features)
        levels = np.array(grades, dtype=float)
        for batch in batches:
            score, words = [], []
            for text in batch.column("text"):
                place, value = features(text.as_py() or b"", cache)
                score.append(float(weights[place] @ value))
                words.append(len(place) > 0)
            tail = tails(np.array(score), cuts) * np.array(words)[:, None]
            expected = levels[0] + tail @ np.diff(levels)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in batch.schema.names if c != "text"]
                + [pa.array(expected), pa.array(list(tail), pa.list_(pa.float64()))],
                names=[c for c in batch.schema.names if c != "text"] + ["expected_grade", "tails"],
            )

    return run


def grade_documents(
    docs: DataFrame, labels: DataFrame, column: str = "quality", keep: tuple[str, ...] = ("doc_id",), folds: int = 5
) -> DataFrame:
    """(*keep, expected_grade, tails) for every row of ``docs``; ``tails`` has P(grade >= k) for each grade
    that occurs in the labels but the least.

    Labels whose crc32(doc_id) mod ``folds`` is 0 are held out. A null or empty text surely has the
    least grade. With fewer than two grades in the labels every text has the only one, and without labels
    grade 0; ``tails`` is then empty.
    """
    spark = docs.sparkSession
    ship_package(spark)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(folds))
    known = stored(bounded_labels(labels.where(fold != 0), column, MAX_LABELS), "grades")
    grades = sorted(r.label for r in known.select("label").distinct().limit(1000).collect())
    text = F.col("text").cast("string").cast("binary").alias("text")
    if len(grades) < 2:
        only = float(grades[0]) if grades else 0.0
        return docs.select(
            *keep, F.lit(only).alias("expected_grade"), F.array().cast("array<double>").alias("tails")
        )
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).join(F.broadcast(known), "doc_id")
    order = F.xxhash64("places", "values")
    rows = stored(
        taught.select("label", "text")
        .mapInArrow(_extract, "label int, places array<long>, values array<double>")
        .where(F.size("places") > 0)
        .repartition(PARTS, order)
        .sortWithinPartitions(order, "label"),  # so that a rerun trains in the same order
        "graded-features",
    )
    weights, steps = fit(rows, grades)
    shared = spark.sparkContext.broadcast((weights, thresholds(steps), grades))
    kept = docs.select(*keep, text)
    schema = StructType([f for f in kept.schema if f.name != "text"])
    schema = schema.add("expected_grade", DoubleType()).add("tails", ArrayType(DoubleType()))
    return kept.mapInArrow(_grade(shared), schema)


def op9_quality(spark, sf_dir):
    graded = grade_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    tail = F.coalesce(F.try_element_at("tails", F.lit(1)), F.lit(1.0))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    return graded.select(
        "doc_id",
        F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        "expected_grade",
        tail.alias("tail_probability"),
        (tail >= 0.5).alias("accepted"),
    )


def accepted(spark, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """The documents whose chance of more than the least grade is at least ``least``, with their columns.

    Texts pass through the tasks that grade them, so nothing is shuffled.
    """
    passed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    graded = grade_documents(passed, table(spark, sf_dir, "labels"), keep=("row",))
    tail = F.coalesce(F.try_element_at("tails", F.lit(1)), F.lit(1.0))
    return graded.where(tail >= least).select("row.*")

"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

The vocabulary falls into 1024 buckets: one for each of the most frequent words, the rest by hash. 32 classes hold
32 buckets each. With the words before as context,

    P(word) = P(class | context) * P(bucket | class, word before) * P(word | bucket),

where the first factor is a softmax over n-gram and skip features in a hashed table, the second a softmax with one weight for each
bucket before and bucket, and the last comes from exact counts over all training texts. So every factor is normalised over a few dozen entries, and
the model's log-probability is the unigram base plus a gain that depends on buckets only.

1. Counts of all words over all training texts. The ``FREQUENT`` most frequent go to every task.
2. Every text is encoded once: its buckets, two bytes a token, and the sums that its frequent words give.
3. Distributed gradient updates: texts fall into shards of about ``SHARD`` tokens by a hash of id and text, so neither files nor
   cores decide what is trained together. A shard's task steps through its positions in the order of the hashes, from the shared
   weights, by about ``STEP`` positions; weights are averaged block by block on the executors. The shards of a round start
   from the average of the round before; each position is trained once. The second factor has its optimum in closed form:
   where the gradient of the likelihood with a prior of ``PRIOR`` positions that follow the buckets' shares is zero. Its counts add up
   over all shards.
4. Gains are computed from the buckets in sparse numpy batches. Rare words leave the task as (row, word, times) and meet
   their counts in a join; none of them is frequent, so no key of that join is hot.

The table of word pairs has a cell for every word of the counted vocabulary, rounded up to a power of two,
between ``CELLS``; beyond, more pairs share a cell, as in any hashed model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpgrid.llm.common import documents, ship_package, stored
from helpgrid.llm.words import WHITE_SPACE, word_slices

CLASSES = MEMBERS = 32
BUCKETS = CLASSES * MEMBERS
OWN = BUCKETS // 2  # most frequent words with a bucket of their own
FREQUENT = 1 << 17
CELLS = 1 << 13, 1 << 17  # least and greatest number of cells for word pairs
ROUNDS, RATE, PRIOR = 2, 0.05, 16.0
SHARD = 1 << 22  # tokens that one task trains
PIECE = 1 << 16  # positions of a text that stay together in a shard
CHUNK = 4096  # positions scored together
STEP = 2048  # positions of a gradient step
WORDS = 1 << 20  # counts of words that a task gathers before it adds them up
BLOCKS = 64
END = xxhash.xxh64_intdigest(b"\x00end") >> 1
SMOOTH = 0.1


def word_hash(word: bytes) -> int:
    """63 bits, so that it is a positive long."""
    return xxhash.xxh64_intdigest(word) >> 1


#: White space separates words, A-Z become lower case.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in WHITE_SPACE], np.uint8)


def _count(batches):
    pending, size = [], 0

    def rows():
        words, counts = (np.concatenate(x) for x in zip(*pending, strict=True))
        order = np.argsort(words, kind="stable")
        words, counts = words[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        return pa.record_batch({"word": words[first].view(np.int64), "n": np.add.reduceat(counts, first)})

    for batch in batches:
        for _, texts, words in word_slices(batch, LOWER):
            hashes = np.fromiter(map(word_hash, words.vocabulary.to_pylist()), np.uint64, len(words.vocabulary))
            pending.append((np.append(hashes, np.uint64(END)), np.append(np.bincount(words.codes, minlength=len(hashes)), texts)))
            size += len(hashes)
            if size > WORDS:
                yield rows()
                pending, size = [], 0
    if pending:
        yield rows()


class Vocabulary:
    """The frequent words by rank, and the shares of the buckets. Its size is bounded by FREQUENT."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, rest: dict[int, tuple[int, int]], total: int, types: int):
        self.rank = {int(w): i for i, w in enumerate(words)}
        self.total, self.types = total, types
        self.cells = min(max(CELLS[0], 1 << (types - 1).bit_length() if types else 0), CELLS[1])
        self.denominator = total + SMOOTH * (types + 1)
        self.log10 = np.log10((counts + SMOOTH) / self.denominator) if len(counts) else np.empty(0)
        shared = OWN + (words & (OWN - 1))
        self.bucket = np.where(np.arange(len(words)) < OWN, np.arange(len(words)), shared).astype(np.int64)
        n, v = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for low, (count, kinds) in rest.items():
            n[OWN + low], v[OWN + low] = count, kinds
        own = min(OWN, len(words))
        n[:own], v[:own] = counts[:own], 1
        np.subtract.at(n, shared[:own], counts[:own])
        np.subtract.at(v, shared[:own], 1)
        self.share = (n + SMOOTH * (v + 1)) / self.denominator

    def code(self, word: bytes) -> int:
        """The rank of a frequent word; otherwise its hash with the highest bit set."""
        of = word_hash(word)
        return self.rank.get(of, of | 1 << 63)

    @property
    def end(self) -> int:
        return self.rank.get(END, END | 1 << 63)

    def buckets(self, codes: np.ndarray) -> np.ndarray:
        rare = codes >> np.uint64(63) == 1
        of = np.empty(len(codes), np.int64)
        of[rare] = OWN + (codes[rare] & np.uint64(OWN - 1)).astype(np.int64)
        of[~rare] = self.bucket[codes[~rare].astype(np.int64)]
        return of

    def class_bias(self) -> np.ndarray:
        """The logarithms of the classes' shares: with all other weights zero, the model says what the counts say."""
        return np.log(self.share.reshape(CLASSES, MEMBERS).sum(axis=1) / self.share.sum()).astype(np.float32)


def contexts(padded: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, target) of the positions after the first three of ``padded``.

    The rows of ``places`` are the features' rows of the table: the word before, the next two before it (skips) and the pair
    of the two words before.
    """
    padded = padded.astype(np.int64)
    back = [padded[3 - i : len(padded) - i] for i in (1, 2, 3)]
    pair = (back[0] * BUCKETS + back[1]).astype(np.uint32) * np.uint32(0x9E3779B1)
    cell = (pair.astype(np.uint64) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
    return np.stack([back[0], BUCKETS + back[1], 2 * BUCKETS + back[2], 3 * BUCKETS + cell]), padded[3:]


def _logits(weights, bias, places):
    x = weights.take(places[0], axis=0)
    for place in places[1:]:
        x += weights.take(place, axis=0)
    x += bias
    x -= x.max(axis=1, keepdims=True)
    return x


def member_logs(counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """ln P(bucket | its class, bucket before), by bucket before and bucket; ``counts`` are those of all such pairs."""
    by_class = counts.astype(np.float64).reshape(BUCKETS, CLASSES, MEMBERS)
    prior = share.reshape(CLASSES, MEMBERS) / share.reshape(CLASSES, MEMBERS).sum(axis=1, keepdims=True)
    chance = (by_class + PRIOR * prior) / (by_class.sum(axis=2, keepdims=True) + PRIOR)
    return np.log(chance).astype(np.float32).reshape(BUCKETS, BUCKETS)


def log_probability(weights, bias, members, places, target) -> np.ndarray:
    """ln P(bucket | context) for each position."""
    x = _logits(weights, bias, places)
    of_class = x[np.arange(len(x)), target // MEMBERS] - np.log(np.exp(x).sum(axis=1))
    return of_class + members[places[0], target]


def _update(weights, squares, place, gradient):
    """An Adagrad step on the given rows; gradients of the same row are added up first."""
    if len(weights) <= 1 << 16:
        place = place.astype(np.uint16)  # sorted by radix
    order = np.argsort(place, kind="stable")
    place = place[order]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    rows = place[first].astype(np.int64)
    total = np.add.reduceat(gradient.take(order, axis=0), first, axis=0)
    seen = squares.take(rows, axis=0) + total**2
    squares[rows] = seen
    weights[rows] -= RATE * total / (np.sqrt(seen) + 1e-4)


def train_step(weights, squares, bias, places, target) -> None:
    x = _logits(weights, bias, places)  # becomes the gradient of -ln softmax of the class
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    x[np.arange(len(x)), target // MEMBERS] -= 1
    for place in places:
        _update(weights, squares, place, x)


def _encode(model):
    def run(batches):
        vocabulary = model.value
        end = np.array([vocabulary.end], np.uint64)
        for batch in batches:
            for first, texts, words in word_slices(batch, LOWER):
                known = np.fromiter(map(vocabulary.code, words.vocabulary.to_pylist()), np.uint64, len(words.vocabulary))
                codes = np.insert(np.append(known, end)[words.codes], words.bounds[1:], end)  # an end after each text
                starts = words.bounds + np.arange(texts + 1)
                often = codes >> np.uint64(63) == 0
                logs = np.zeros(len(codes))
                logs[often] = vocabulary.log10[codes[often].astype(np.int64)]
                of = np.repeat(np.arange(texts), np.diff(starts))[~often]
                rare = codes[~often] & np.uint64((1 << 63) - 1)
                order = np.lexsort((rare, of))
                of, rare = of[order], rare[order]
                new = np.ones(len(rare) + 1, bool)
                new[1:-1] = (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])
                at = np.flatnonzero(new)  # where each (text, word) begins; the last is the end
                ends = pa.array(np.searchsorted(of[at[:-1]], np.arange(texts + 1)), pa.int32())
                buckets = pa.py_buffer(vocabulary.buckets(codes).astype(np.int16))
                given = {n: batch.column(n).slice(first, texts) for n in ("row", "doc_id", "held_out", "key")}
                yield pa.record_batch(
                    given
                    | {
                        "n_tokens": pa.array(np.diff(starts)),
                        "known": pa.array(np.add.reduceat(often, starts[:-1], dtype=np.int64)),
                        "base": pa.array(np.add.reduceat(logs, starts[:-1])),
                        "buckets": pa.Array.from_buffers(pa.binary(), texts, [None, pa.py_buffer((2 * starts).astype(np.int32)), buckets]),
                        "rare": pa.ListArray.from_arrays(ends, pa.array(rare[at[:-1]].view(np.int64))),
                        "times": pa.ListArray.from_arrays(ends, pa.array(np.diff(at))),
                    }
                )

    return run


ENCODED = (
    "row long, doc_id long, held_out boolean, key long, n_tokens long, known long, base double, buckets binary,"
    " rare array<long>, times array<long>"
)


def _pieces(end: int, shards: int):
    """Texts in pieces of ``PIECE`` positions, each with the three buckets before it."""

    def run(batches):
        for batch in batches:
            shard, keys, data = [], [], []
            for key, buckets in zip(batch.column("key").to_pylist(), batch.column("buckets"), strict=True):
                padded = np.concatenate([np.full(3, end, np.int16), np.frombuffer(buckets.as_py(), np.int16)])
                for at in range(0, len(padded) - 3, PIECE):
                    of = xxhash.xxh64_intdigest(b"%d %d" % (key, at))
                    shard.append(of % shards)
                    keys.append(of >> 1)
                    data.append(padded[at : at + PIECE + 3].tobytes())
            yield pa.record_batch(
                {"shard": pa.array(shard, pa.int64()), "key": pa.array(keys, pa.int64()), "data": pa.array(data, pa.binary())}
            )

    return run


def _train(model):
    """Steps through a shard: the blocks of its weights, and how often each bucket follows each."""

    def run(batches):
        vocabulary, flat = model.value
        weights = flat.copy()
        squares, bias = np.full_like(weights, 0.5), vocabulary.class_bias()
        counts = np.zeros(BUCKETS * BUCKETS, np.int32)
        shard, seen, waiting, pending = None, 0, 0, []

        def step():
            places, target = (np.concatenate(x, axis=-1) for x in zip(*pending, strict=True))
            train_step(weights, squares, bias, places, target)
            np.add.at(counts, places[0] * BUCKETS + target, 1)
            pending.clear()

        for batch in batches:
            for of, data in zip(batch.column("shard"), batch.column("data"), strict=True):
                shard, padded = of.as_py(), np.frombuffer(data.as_py(), np.int16)
                for at in range(0, len(padded) - 3, CHUNK):
                    places, target = contexts(padded[at : at + CHUNK + 3], vocabulary.cells)
                    pending.append((places, target))
                    seen += len(target)
                    waiting += len(target)
                    if waiting >= STEP:
                        step()
                        waiting = 0
        if waiting:
            step()
        if seen:
            yield pa.record_batch(
                {
                    "block": pa.array(range(BLOCKS), pa.int64()),
                    "shard": pa.array([shard] * BLOCKS, pa.int64()),
                    "seen": pa.array([seen] * BLOCKS, pa.int64()),
                    "weights": pa.array([x.tobytes() for x in np.array_split(weights, BLOCKS)], pa.binary()),
                    "counts": pa.array([x.tobytes() for x in np.array_split(counts, BLOCKS)], pa.binary()),
                }
            )

    return run


TRAINED = "block long, shard long, seen long, weights binary, counts binary"


def _combine(batches):
    """The average of each block's weights, by positions seen, and the sum of its counts; rows come in the order of blocks."""
    block, total, seen, counts = None, 0.0, 0, 0

    def done():
        average = (total / seen).astype(np.float32)
        return pa.record_batch({"block": [block], "weights": [average.tobytes()], "counts": [counts.tobytes()]})

    for batch in batches:
        columns = (batch.column(n) for n in ("block", "seen", "weights", "counts"))
        for of, n, weights, pairs in zip(*columns, strict=True):
            if block is not None and of.as_py() != block:
                yield done()
                total, seen, counts = 0.0, 0, 0
            block, seen = of.as_py(), seen + n.as_py()
            total = total + n.as_py() * np.frombuffer(weights.as_py(), np.float32).astype(np.float64)
            counts = counts + np.frombuffer(pairs.as_py(), np.int32).astype(np.int64)
    if block is not None:
        yield done()


def _gain(model, end: int):
    def run(batches):
        vocabulary, weights, members = model.value
        bias, log_share = vocabulary.class_bias(), np.log(vocabulary.share)
        for batch in batches:
            gains = []
            for buckets in batch.column("buckets"):
                padded = np.concatenate([np.full(3, end, np.int16), np.frombuffer(buckets.as_py(), np.int16)])
                gain = 0.0
                for at in range(0, len(padded) - 3, CHUNK):
                    places, target = contexts(padded[at : at + CHUNK + 3], vocabulary.cells)
                    got = log_probability(weights, bias, members, places, target)
                    gain += float((got - log_share[target]).sum())
                gains.append(gain / np.log(10))
            given = ["row", "doc_id", "held_out", "n_tokens", "known", "base"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in given), pa.array(gains, pa.float64())], names=[*given, "gain"])

    return run


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, gain double"


def _fitted(taught: DataFrame, vocabulary: Vocabulary, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights and the table of ``member_logs``, trained on the encoded texts. Both have a bounded size."""
    spark = taught.sparkSession
    weights = np.zeros((3 * BUCKETS + vocabulary.cells, CLASSES), np.float32)
    counts = np.zeros((BUCKETS, BUCKETS), np.int64)
    shards = -(-vocabulary.total // SHARD)
    pieces = taught.select("key", "buckets").mapInArrow(_pieces(end, shards), "shard long, key long, data binary")
    rounds = min(ROUNDS, shards)
    for i in range(rounds):
        model = spark.sparkContext.broadcast((vocabulary, weights))
        mine = pieces if rounds == 1 else pieces.where(F.col("shard") % rounds == i)
        blocks = (
            mine.repartitionById(-(-shards // rounds), F.expr(f"int(shard div {rounds})"))  # a task a shard
            .sortWithinPartitions("key", "data")
            .mapInArrow(_train(model), TRAINED)
            .repartition(BLOCKS, "block")
            .sortWithinPartitions("block", "shard")
            .mapInArrow(_combine, "block long, weights binary, counts binary")
            .collect()  # the model once: 25 MB at most
        )
        model.unpersist()
        if blocks:
            blocks.sort(key=lambda r: r.block)
            weights = np.frombuffer(b"".join(r.weights for r in blocks), np.float32).reshape(weights.shape)
            counts += np.frombuffer(b"".join(r.counts for r in blocks), np.int64).reshape(counts.shape)
    return weights, member_logs(counts, vocabulary.share)


def score_texts(docs: DataFrame, folds: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Tokens are the words without ASCII white space, A-Z lower-cased, and one end. Texts whose
    crc32(doc_id) mod ``folds`` is 0 are held out of all training; a null doc_id is not. A null or empty text has the end as
    its only token. Very long texts are trained in pieces and scored whole. Repeated rows each count and each get a row;
    equal texts get equal scores. Words of equal count are ranked by their 63-bit hash, which tells words apart. Of other columns
    none is read or kept. An empty table gives no rows; if nothing is left to train on, every word is unknown. Scores do not depend on
    the files' layout or the cluster (rows of null doc_id apart, which are spread by their place).
    """
    spark = docs.sparkSession
    ship_package(spark)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(folds))
    kept = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")
    )
    taught = kept.where(F.coalesce(fold, F.lit(1)) != 0).select("text")
    counts = stored(
        taught.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts"
    )
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toPandas()
    rest = counts.groupBy(F.col("word").bitwiseAND(OWN - 1).alias("low")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")
    )
    vocabulary = Vocabulary(
        top["word"].to_numpy(np.int64),
        top["n"].to_numpy(np.int64),
        {r.low: (r.n, r.v) for r in rest.collect()},  # OWN rows
        total.n or 0,
        total.v,
    )
    model = spark.sparkContext.broadcast(vocabulary)
    row = F.monotonically_increasing_id()
    rows = kept.select(
        row.alias("row"),
        "doc_id",
        F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        F.xxhash64(F.coalesce("doc_id", row), "text").alias("key"),
        "text",
    )
    encoded = stored(rows.mapInArrow(_encode(model), ENCODED), "lm-encoded")
    end = int(vocabulary.buckets(np.array([vocabulary.end], np.uint64))[0])
    weights, members = _fitted(encoded.where("NOT held_out"), vocabulary, end)
    model = spark.sparkContext.broadcast((vocabulary, weights, members))
    columns = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "buckets"]
    scored = encoded.select(*columns).mapInArrow(_gain(model, end), SCORED)
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("word"), "x.times"
    )
    n = F.coalesce("n", F.lit(0))
    sums = (
        rare.join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10((n + SMOOTH) / F.lit(float(vocabulary.denominator)))).alias("rare_base"),
            F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0))
    return scored.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(vocabulary.total)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("gain")).alias("score"),
    )


def op7_lm_scoring(spark, sf_dir):
    return score_texts(documents(spark, sf_dir))

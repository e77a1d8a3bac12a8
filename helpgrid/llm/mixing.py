"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is dealt out in equal blocks of words. The highest quotients ``target / (2 * seats + 1)`` give
each source its whole number of blocks; the same rule deals a source's blocks to its shards in
proportion to their words. Inside a shard, a seeded order of the documents picks what fills the quota.

A source has one shard for each ``SHARD_WORDS`` words, so a source with a third of all rows is
split into as many tasks as its size needs. What reaches the driver is one row a source, at most
``MAX_SOURCES``; the operator raises beyond that.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpgrid.llm.common import documents, ship_package, stored

SHARD_WORDS = 1 << 19
#: Words of a block: a millionth of the corpus, but no more than this.
BLOCK_WORDS = 1024
MAX_SOURCES = 100_000
MAX_REPEATS = 3
SWAPS, STARTS = 16, 8
WORD = r"[^\x20\x09-\x0D]+"


def apportion(votes: list[float] | np.ndarray, seats: int) -> np.ndarray:
    """Whole seats for each entry by highest quotients ``vote / (2 * seats + 1)``; ties go to the earlier.

    A search for the quotient of the last seat gives all but a few seats at once, whatever their number.
    """
    votes = np.maximum(np.asarray(votes, dtype=np.float64), 0)
    won = np.zeros(len(votes), dtype=np.int64)
    if seats <= 0 or not votes.sum() > 0:
        return won

    def above(quotient: float) -> np.ndarray:
        return np.maximum(np.ceil((votes / quotient - 1) / 2), 0).astype(np.int64)

    low, high = votes.sum() / (4.0 * seats + 4 * len(votes)), votes.max()
    for _ in range(100):
        middle = (low + high) / 2
        if above(middle).sum() > seats:
            low = middle
        else:
            high = middle
    won = above(high)
    heap = [(-v / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, won, strict=True)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(won.sum())):
        _, i = heapq.heappop(heap)
        won[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * won[i] + 1), i))
    return won


def capped_targets(sizes: list[int], weights: list[float], cap: float = MAX_REPEATS) -> list[float]:
    """The sum of ``sizes`` shared by weight, none above ``cap`` times its size; the excess is reshared."""
    targets = [0.0] * len(sizes)
    open_, rest = list(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        share = {i: rest * weights[i] / total if total else 0.0 for i in open_}
        over = [i for i in open_ if share[i] > cap * sizes[i]]
        for i in over or open_:
            targets[i] = float(cap * sizes[i]) if over else share[i]
        if not over:
            break
        rest -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def ranked_weights(sources: list[str | None], cycle: tuple[float, ...] = (5, 2, 1)) -> dict[str | None, float]:
    """Weights in turn to the sources by code point, null last."""
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(order)}


def fill(sizes: np.ndarray, quota: float) -> np.ndarray:
    """How often each document is taken so that the words come to the quota, in the given order.

    Where documents are so few that this misses by a thousandth, the order is begun at other places too, and the
    nearest choice is taken.
    """
    best, missed = None, np.inf
    for start in np.linspace(0, len(sizes), STARTS, endpoint=False).astype(int):
        times = np.roll(_filled(np.roll(sizes, -start), quota), start)
        off = abs(float((sizes * times).sum()) - quota)
        if off < missed:
            best, missed = times, off
        if missed <= quota / 1000:
            break
    return best


def _filled(sizes: np.ndarray, quota: float) -> np.ndarray:
    """Whole rounds first, then documents from the start while they fit, then from the rest the largest that
    fit the gap; last, documents change places as long as that comes nearer. No document is taken over MAX_REPEATS times.
    """
    total = int(sizes.sum())
    rounds = min(int(quota // total), MAX_REPEATS) if total else 0
    times = np.full(len(sizes), rounds, dtype=np.int64)
    if not total or rounds == MAX_REPEATS:
        return times
    gap = quota - rounds * total
    taken = np.cumsum(sizes) <= gap
    gap -= sizes[taken].sum()
    for _ in range(64):
        fits = np.flatnonzero(~taken & (sizes <= gap) & (sizes > 0))
        if not len(fits):
            break
        by_size = fits[np.argsort(-sizes[fits], kind="stable")]
        chosen = by_size[np.cumsum(sizes[by_size]) <= gap]
        taken[chosen] = True
        gap -= sizes[chosen].sum()
    for _ in range(SWAPS):
        if abs(gap) < 1:
            break
        out, in_ = np.flatnonzero(taken), np.flatnonzero(~taken & (sizes > 0))
        # A taken document (or none) makes place for one that is not taken; the size that fits best is next to a search's place.
        out = np.append(out, -1)
        freed = np.where(out >= 0, sizes[out], 0)
        by_size = in_[np.argsort(sizes[in_], kind="stable")]
        if not len(by_size):
            break
        at = np.searchsorted(sizes[by_size], freed + gap)
        near = by_size[np.stack([np.maximum(at - 1, 0), np.minimum(at, len(by_size) - 1)])]
        left = np.abs(gap - (sizes[near] - freed))
        side, i = np.unravel_index(np.argmin(left), left.shape)
        if left[side, i] >= abs(gap):
            break
        gap -= sizes[near[side, i]] - freed[i]
        taken[near[side, i]] = True
        if out[i] >= 0:
            taken[out[i]] = False
    return times + taken


def _shard_quotas(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("shard")
    return frame[["s", "shard"]].assign(quota=apportion(frame["words"].to_numpy(), int(frame["seats"].iloc[0])))


def _take(block: int):
    def run(rows: pa.Table, quotas: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        size = rows.column("size").to_numpy()
        quota = quotas.column("quota")[0].as_py() * block if quotas.num_rows else 0
        return pa.table(
            {"s": rows.column("s"), "doc_id": rows.column("doc_id"), "key": rows.column("key"), "size": size, "taken": size * fill(size, quota)}
        )

    return run


def mix_sources(
    docs: DataFrame,
    size: Column | None = None,
    weights=ranked_weights,
    seed: int = 7,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, source, key, size, source_size, target, taken) for every row of ``docs``.

    ``taken`` is the document's size times 0 to 3. ``key`` is a hash of id, text and seed. A null
    text has size 0, which is never taken; a null source is a source of its own. An empty table gives an empty result.
    Rows that repeat id and text are drawn one by one. Reruns agree, whatever the partitioning.
    """
    spark = docs.sparkSession
    ship_package(spark)
    if size is None:
        size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0))
    sized = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            size.cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text")).alias("key"),
        ),
        "sizes",
    )
    found = sized.groupBy("source").agg(F.sum("size").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; raise MAX_SOURCES if the driver can hold them")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    weight = weights([r.source for r in found])
    targets = capped_targets([r.words for r in found], [weight[r.source] for r in found])
    total = sum(r.words for r in found)
    block = min(block_words, max(1, total >> 20))
    seats = apportion(targets, round(total / block))
    plan = spark.createDataFrame(
        [
            (i, r.source, int(r.words), float(t), int(n), max(1, -(-r.words // shard_words)))
            for i, (r, t, n) in enumerate(zip(found, targets, seats, strict=True))
        ],
        "s int, source string, source_size long, target double, seats long, shards long",
    )
    plan = F.broadcast(plan)  # at most MAX_SOURCES rows
    dealt = (
        sized.where("size > 0")
        .join(plan, sized["source"].eqNullSafe(plan["source"]))
        .select("s", "seats", F.pmod("key", "shards").alias("shard"), "doc_id", "key", "size")
    )
    quotas = stored(
        dealt.groupBy("s", "seats", "shard")
        .agg(F.sum("size").alias("words"))
        .groupBy("s")
        .applyInPandas(_shard_quotas, "s int, shard long, quota long"),
        "quotas",
    )
    taken = (
        dealt.select("s", "shard", "doc_id", "key", "size")
        .groupBy("s", "shard")
        .cogroup(quotas.groupBy("s", "shard"))
        .applyInArrow(_take(block), "s int, doc_id long, key long, size long, taken long")
        .join(plan, "s")
    )
    empty = (
        sized.where("size = 0")
        .withColumn("taken", F.lit(0).cast("long"))
        .join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    )
    columns = ["doc_id", "source", "key", "size", "source_size", "target", "taken"]
    return taken.select(columns).unionByName(empty.select(columns))


def op2_mixing(spark, sf_dir):
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each with the words taken and how often it is repeated.

    ``taken``, ``n_words`` and ``repeats`` replace columns of these names; others keep their values, whatever their names.
    Of rows that repeat id and text each gets the largest number of words that one of them has.
    """
    mix = (
        mix_sources(docs)
        .where("taken > 0")
        .groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
        .agg(F.max("taken").alias("taken"), F.max("size").alias("n_words"))
    )
    names = [c for c in docs.columns if c not in ("taken", "n_words", "repeats")]
    rows = docs.select(
        F.struct(*names).alias("doc"),
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(F.lit(7), F.col("doc_id").cast("long"), F.col("text")).alias("hash"),
    )
    met = rows.join(mix, F.col("hash").eqNullSafe(F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")))
    return met.select("doc.*", "taken", "n_words", F.expr("taken div n_words").alias("repeats"))

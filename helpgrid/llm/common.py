"""What the operators share: table access, written intermediates and word hashing in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from helpgrid.session import scratch_path, ship_package

__all__ = ["WordCache", "bounded_labels", "documents", "drop_stored", "lower_ascii", "mix", "only_ids", "ship_package", "stored", "table"]

#: A cache of words in a task starts anew beyond this many entries (about 50 MB).
CACHE_WORDS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def stored(frame: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """The frame written below ``spark.checkpoint.dir`` and read again.

    Cuts the lineage: a lost executor costs its running tasks, not the work before.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    writer = frame.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    found = spark.read.schema(frame.schema).parquet(path)
    found.stored_at = path
    return found


def drop_stored(*frames: DataFrame) -> None:
    """Deletes the tables of frames that ``stored`` returned, once all that reads them has been written."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case and no other character, without Python.

    Plain ``lower`` does the same wherever all characters are ASCII, and much faster.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over the whole range (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


class WordCache(dict):
    """Remembers a value for each word, up to a bound; ``values`` maps a list of words."""

    def __init__(self, of: Callable[[bytes], int] = xxhash.xxh64_intdigest, dtype=np.uint64):
        super().__init__()
        self.of, self.dtype = of, dtype

    def __missing__(self, word: bytes):
        value = self.of(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value
        return value

    def values_of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=self.dtype, count=len(words))


def rows_of(batches: Iterator, *columns: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of Python values, one batch at a time."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def bounded_labels(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, label) of at most ``bound`` labelled documents, the same ones at every run.

    A label is the largest of a document's non-null labels. Up to ``bound`` labels all are
    taken; beyond, those whose hashed id is smallest. This is the documented bound of the sample that a
    classifier is fitted on, and makes a broadcast of it safe: 16 bytes a row.
    """
    one = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hashes of all runs of ``width`` words, in order; of fewer words, their whole sequence as one.

    Hashes have 64 bits: two given texts of a thousand words agree in one by chance about once in 10^13 pairs.
    """
    if not len(words):
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - width + 1, width, np.uint64)
        for i in range(width):
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - width + 1 + i]
    return mix(total)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes(words, width))


#: Bits of a filter: at most 64 MB, whatever the number of hashes. More hashes only let more rows pass.
FILTER_BITS, FILTER_SEGMENT = 1 << 29, 1 << 16
#: A hash sets so many bits of one block of 512, so that a look reads one cache line.
PROBES, BLOCK_BITS = 4, 9


def _blocks(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bit of the block, spread hash) of each hash in a filter of ``size`` bits."""
    spread = mix(hashes.view(np.uint64))
    block = (spread & np.uint64((size >> BLOCK_BITS) - 1)) << np.uint64(BLOCK_BITS)
    return block.astype(np.int64), spread


def _probe(spread: np.ndarray, turn: int) -> np.ndarray:
    """The bit inside its block that each hash sets; blocks are told by the 20 lowest bits at most."""
    return (spread >> np.uint64(28 + BLOCK_BITS * turn) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)


class HashFilter:
    """A blocked Bloom filter of bounded size that says which hashes cannot be in a set. Of absent hashes, less than
    one in 200 passes, up to 2^25 hashes in the set. Broadcast with the tasks that use it."""

    def __init__(self, plane: np.ndarray):
        self.plane = plane

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        block, spread = _blocks(hashes, len(self.plane) * 8)
        at = None
        for turn in range(PROBES):
            bit = block + _probe(spread, turn)
            on = self.plane[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1
            at = np.flatnonzero(on) if at is None else at[on]
            block, spread = block[on], spread[on]
        found = np.zeros(len(hashes), bool)
        found[at] = True
        return found


def _planes(size: int):
    """The parts of a task's own filter that hold a hash: (segment, plane)."""

    def run(batches):
        import pyarrow as pa

        plane = np.zeros(size // 8, np.uint8)
        for batch in batches:
            block, spread = _blocks(batch.column(0).to_numpy(), size)
            for turn in range(PROBES):
                bit = block + _probe(spread, turn)
                np.bitwise_or.at(plane, bit >> 3, np.uint8(1) << (bit & 7).astype(np.uint8))
        plane = plane.reshape(-1, FILTER_SEGMENT // 8)
        for segment in np.flatnonzero(plane.any(axis=1)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int64()), pa.array([plane[segment].tobytes()], pa.binary())], names=["segment", "plane"]
            )

    return run


def _united(batches):
    """Planes sorted by segment to one plane a segment, one row in memory at a time."""
    import pyarrow as pa

    def row(segment, plane):
        return pa.RecordBatch.from_arrays(
            [pa.array([segment], pa.int64()), pa.array([plane.tobytes()], pa.binary())], names=["segment", "plane"]
        )

    current, plane = None, None
    for segment, part in rows_of(batches, "segment", "plane"):
        bits = np.frombuffer(part, np.uint8)
        if segment == current:
            plane |= bits
        else:
            if current is not None:
                yield row(current, plane)
            current, plane = segment, bits.copy()
    if current is not None:
        yield row(current, plane)


def hash_filter(hashes: DataFrame, n: int) -> HashFilter:
    """A filter over the only column (long, not null) of ``hashes``, of about ``n`` distinct ones; 16 bits for each.

    Every task fills a filter of its own, of bounded size; the parts that hold a hash are united by segment, and come
    to the driver in one job (64 MB at most), as a job for each partition would take longer the more of them there are.
    """
    size = FILTER_SEGMENT
    while size < min(16 * n, FILTER_BITS):
        size *= 2
    parts = (
        hashes.mapInArrow(_planes(size), "segment long, plane binary")
        .repartition("segment")
        .sortWithinPartitions("segment")
        .mapInArrow(_united, "segment long, plane binary")
    )
    plane = np.zeros(size // 8, np.uint8)
    for batch in parts.toArrow().to_batches():
        for segment, part in zip(batch.column("segment").to_pylist(), batch.column("plane"), strict=True):
            plane[segment * FILTER_SEGMENT // 8 :][: FILTER_SEGMENT // 8] = np.frombuffer(part.as_buffer(), np.uint8)
    return HashFilter(plane)


def _may_have(column: str, shared):
    def run(batches):
        for batch in batches:
            values = batch.column(column)
            known = values.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(known & shared.value.may_have(values.fill_null(0).to_numpy()))

    return run


def only_keys(frame: DataFrame, column: str, shared) -> DataFrame:
    """The rows whose ``column`` (long) may be in the filter that is broadcast as ``shared``."""
    return frame.mapInArrow(_may_have(column, shared), frame.schema)


def only_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id (long) is in ``ids``; others are dropped by a filter before anything is shuffled."""
    ship_package(docs.sparkSession)
    ids = stored(ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "ids")
    shared = docs.sparkSession.sparkContext.broadcast(hash_filter(ids, ids.count()))
    return only_keys(docs, "doc_id", shared).join(ids, "doc_id", "left_semi")


def key_columns() -> dict[str, Column]:
    """``_k1`` and ``_k2``, which identify a document: rows that repeat id and text are one."""
    return {
        "_k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))),
        "_k2": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))),
    }


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns(key_columns())


def _flag(shared):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            may = shared.value.may_have(batch.column("_h").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(may)], names=[*batch.schema.names, "_may"])

    return run


def without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` but for the rows whose ``keys`` (_k1, _k2: longs, not null) are in ``gone``.

    A filter of bounded size lets all other rows straight through: only the few it cannot tell are shuffled.
    """
    spark = docs.sparkSession
    ship_package(spark)
    both = F.xxhash64("_k1", "_k2")
    gone = stored(gone.select("_k1", "_k2").distinct(), "gone")
    shared = spark.sparkContext.broadcast(hash_filter(gone.select(both), gone.count()))
    keys = keys or key_columns()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *(c.alias(k) for k, c in keys.items())).withColumn("_h", both)
    schema = StructType([*rows.schema.fields, StructField("_may", BooleanType())])
    flagged = rows.mapInArrow(_flag(shared), schema)
    stays = flagged.where(~F.col("_may")).select("_row.*")
    return stays.unionByName(flagged.where("_may").join(gone.hint("merge"), ["_k1", "_k2"], "left_anti").select("_row.*"))

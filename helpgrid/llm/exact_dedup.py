"""Exact dedup by two-pass Bloom filtering.

Pass one adds the 64-bit hash of every text to a Bloom filter that counts to two. Pass two looks
every row up: a hash that was added once has a cell that was filled once, and its row passes straight through.
Only rows whose cells were all filled twice are shuffled and grouped by their SHA-256.

The filter is split into segments of fixed size. A hash belongs to one segment, so the segments
are filled by separate tasks from 8-byte hashes, which every batch reduces to distinct ones first:
a text that makes up a third of all rows counts once or twice a batch. Filters are sized by
the number of rows and never exceed ``MAX_CELLS``: beyond, hashes are split into classes, each a folder of
the written digests. Classes are filtered one after another: each reads only its own folder, and its rows are written and its filter is
destroyed before the next one begins. False positives only cost a shuffled row.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpgrid.llm.common import mix, ship_package, stored

#: Cells for each row, cells a hash fills, cells of a segment, and cells of a filter (a bit each: 64 MB).
CELLS_PER_ROW, PROBES, SEGMENT, MAX_CELLS = 16, 3, 1 << 16, 1 << 29


def _digest(batches):
    for batch in batches:
        text = batch.column("text").cast(pa.string())
        normal = pc.fill_null(pc.ascii_lower(text), "").cast(pa.binary()).to_pylist()
        sha = [hashlib.sha256(x).digest() for x in normal]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("row"),
                pa.array(sha, pa.binary()),
                pa.array(np.frombuffer(b"".join(x[:8] for x in sha), np.int64), pa.int64()),
            ],
            names=["doc_id", "row", "sha", "h"],
        )


def _cells(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each hash and its cells inside, PROBES to a row."""
    a = mix(h.view(np.uint64))
    b = mix(a ^ np.uint64(0x5BF03635))
    cells = np.stack([(b >> np.uint64(16 * i)) % np.uint64(SEGMENT) for i in range(PROBES)], axis=1)
    return (a % np.uint64(segments)).astype(np.int64), cells.astype(np.int64)


def _seen(segments: int):
    def run(batches):
        for batch in batches:
            h, n = np.unique(batch.column("h").to_numpy(), return_counts=True)
            segment, _ = _cells(h, segments)
            yield pa.RecordBatch.from_arrays(
                [pa.array(segment), pa.array(h), pa.array(n > 1)], names=["segment", "h", "twice"]
            )

    return run


def _fill(segments: int):
    def run(key, table):
        h = table.column("h").to_numpy()
        twice = table.column("twice").to_numpy(zero_copy_only=False)
        _, cells = _cells(h, segments)
        filled = np.bincount(cells.ravel(), np.repeat(twice + 1, PROBES), minlength=SEGMENT)
        plane = np.packbits(filled > 1).tobytes()
        return pa.table({"segment": [key[0].as_py()], "plane": [plane]})

    return run


def _look_up(segments: int, broadcast):
    def run(batches):
        plane = broadcast.value
        for batch in batches:
            segment, cells = _cells(batch.column("h").to_numpy(), segments)
            at = segment[:, None] * SEGMENT + cells
            maybe = ((plane[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "row", "sha")] + [pa.array(maybe)],
                names=["doc_id", "row", "sha", "maybe"],
            )

    return run


def _flagged(rows: DataFrame, n: int) -> DataFrame:
    """The rows of one class with ``maybe``, written: false only where no other row has the same hash."""
    segments = max(1, -(-n * CELLS_PER_ROW // SEGMENT))
    filled = (
        rows.select("h")
        .mapInArrow(_seen(segments), "segment long, h long, twice boolean")
        .groupBy("segment")
        .applyInArrow(_fill(segments), "segment long, plane binary")
    )
    plane = np.zeros(segments * SEGMENT // 8, np.uint8)
    for segment, part in filled.toLocalIterator():  # MAX_CELLS bits at most
        plane[segment * SEGMENT // 8 :][: SEGMENT // 8] = np.frombuffer(part, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(plane)
    flagged = stored(rows.mapInArrow(_look_up(segments, shared), "doc_id long, row long, sha binary, maybe boolean"), "flagged")
    shared.destroy()
    return flagged


def exact_duplicates(docs: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest
    doc_id stays. A null text counts as empty; a null doc_id is the smallest; of
    rows that repeat text and doc_id one stays. Very long texts are hashed whole. Of other columns none is read or kept.
    An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    n = docs.count()
    classes = max(1, -(-n * CELLS_PER_ROW // max_cells))
    digests = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(_digest, "doc_id long, row long, sha binary, h long")
    if classes == 1:
        flagged = _flagged(stored(digests, "digests"), n)
    else:
        of = F.pmod(F.xxhash64("h"), F.lit(classes))
        digests = stored(digests.withColumn("class", of), "digests", partition_by=["class"])
        parts = [_flagged(digests.where(F.col("class") == c), -(-n // classes)) for c in range(classes)]
        flagged = reduce(DataFrame.unionByName, parts)
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    alone = flagged.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha
    )
    again = flagged.where("maybe").select("doc_id", "row", "sha")
    groups = again.groupBy("sha").agg(
        F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    # One row a group on one side: a hot text is a skewed join, which adaptive execution splits.
    together = again.join(groups.hint("merge"), "sha").select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        sha,
    )
    return alone.unionByName(together)


def op10_exact_dedup(spark, sf_dir):
    from helpgrid.llm.common import documents

    return exact_duplicates(documents(spark, sf_dir))


OP10_SQL = """
WITH d AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS sha
    FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY sha)
"""

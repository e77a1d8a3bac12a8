"""Search for complaints as they arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from helpgrid.operators.index import Index, current_index, open_index
from helpgrid.operators.search import retrieve
from helpgrid.operators.triage import complaints


def pinned(spark: SparkSession, head: str, note: str) -> Index:
    """The version that the note names; without a note the current one, which is noted first."""
    try:
        return open_index(spark, spark.read.schema("path string").parquet(note).first().path)
    except (AnalysisException, AttributeError):  # no note, or none that was finished
        version = current_index(spark, head)
        spark.createDataFrame([(version.path,)], "path string").coalesce(1).write.mode("overwrite").parquet(note)
        return version


def start_triage(
    queries: DataFrame,
    index: Index | str,
    out: str,
    checkpoint: str,
    top_k: int = 5,
    alpha: float = 0.5,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Writes the top articles of every streamed complaint below ``out``.

    ``index`` is a version, or the folder below which versions are published (``publish_index``): then every micro-batch
    takes the current one, notes it below ``out`` and keeps to it when it is run again after a failure. The ranges of
    a query's scores depend on the version alone, so each micro-batch is complete in itself and no state
    is kept; a repeated batch replaces its own folder. A search reads the postings of the batch's terms only.
    """

    def write(batch: DataFrame, number: int) -> None:
        # the batch feeds several jobs; held rows are recomputed from the source if lost
        batch.persist()
        try:
            version = index if isinstance(index, Index) else pinned(batch.sparkSession, index, f"{out}/_versions/batch={number}")
            hits = retrieve(version, complaints(batch), top_k, alpha)
            hits.write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            batch.unpersist()

    return (
        queries.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

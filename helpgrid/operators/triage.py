"""Triage of complaints: search, prompt, reply, steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpgrid.functions import display as D
from helpgrid.functions.text import strip
from helpgrid.operators.replies import numbered


CLASSES = ("category", "subcategory", "journey_stage")


def complaints(queries: DataFrame) -> DataFrame:
    """Queries whose text holds more than blanks."""
    return queries.where(strip(F.col("text")) != "")


def score_bars(hits: DataFrame) -> DataFrame:
    """The hits with every score limited to 1, as a bar shows it."""
    scores = ("semantic_score", "keyword_score", "hybrid_score")
    return hits.withColumns({name: D.clamped(F.col(name)) for name in scores})


def classified(queries: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row per answered complaint, with the marks shown for missing parts."""
    shown = extracted.select(
        "query_id",
        "status",
        *(F.coalesce(c, F.lit("—")).alias(c) for c in CLASSES),
        F.coalesce("confidence", F.lit("Low")).alias("confidence"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        "resolution_steps",
    )
    return (
        complaints(queries)
        .select("query_id", F.col("text").alias("complaint"))
        .join(shown, "query_id")
        .withColumn("confidence_tier", D.confidence_tier(F.col("confidence")))
    )


def triage_steps(queries: DataFrame, extracted: DataFrame) -> DataFrame:
    """The classified complaints, one row per resolution step."""
    return numbered(classified(queries, extracted))

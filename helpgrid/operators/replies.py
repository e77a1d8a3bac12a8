"""Tables of raw model replies turned into records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpgrid.functions import replies as R
from helpgrid.schemas import ARTICLE_FIELDS
from helpgrid.session import scratch_path

RESPONSE_TEXTS = ("category", "subcategory", "journey_stage", "confidence", "summary")

# The record that stands for a response that is not a JSON object. Its only step is
# the reply itself.
UNREADABLE = {
    "category": "Unknown",
    "subcategory": "Unknown",
    "journey_stage": "Unknown",
    "confidence": "Low",
    "summary": "Could not parse response.",
}

# Reasons given with the zero scores of a judgement that could not be used.
PARSE_ERROR = "Parse error"
CALL_ERROR = "Error"


def parsed(raw: DataFrame) -> DataFrame:
    """Adds ``payload``, the reply without its fence, and ``value``, its strict JSON reading."""
    return raw.withColumn("payload", R.without_fence(F.col("raw"))).withColumn(
        "value", R.strict_json(F.col("payload"))
    )


def _failed(df: DataFrame):
    return F.col("status") == "error" if "status" in df.columns else F.lit(False)


def extract_responses(responses: DataFrame) -> DataFrame:
    """``responses`` with ``raw`` replaced by status, five texts and resolution_steps.

    A key that the reply leaves out is null; a reply that is no JSON object gives the fallback
    record and the status ``fallback``.
    """
    value = F.col("value")
    good = F.col("good")
    kept = [c for c in responses.columns if c not in ("raw", "status")]
    rows = parsed(responses).withColumn("good", R.is_object(value))
    return rows.select(
        *kept,
        F.when(good, "ok").otherwise("fallback").alias("status"),
        *(
            F.when(good, R.field(value, name)).otherwise(F.lit(UNREADABLE[name])).alias(name)
            for name in RESPONSE_TEXTS
        ),
        F.when(good, R.text_list(value, "resolution_steps"))
        .otherwise(F.array("payload"))
        .alias("resolution_steps"),
    )


def extract_judgements(judgements: DataFrame) -> DataFrame:
    """``judgements`` with ``raw`` replaced by status, two scores and two reasons.

    Missing scores are 0 and missing reasons empty. A failed call (``status`` = error) or a reply
    that is no JSON object scores 0 twice. Scores are not clamped.
    """
    value = F.col("value")
    failed, good = F.col("failed"), F.col("good")
    kept = [c for c in judgements.columns if c not in ("raw", "status")]
    rows = (
        parsed(judgements.withColumn("failed", F.coalesce(_failed(judgements), F.lit(False))))
        .withColumn("good", ~failed & R.is_object(value))
    )
    trouble = F.when(failed, F.lit(CALL_ERROR)).otherwise(F.lit(PARSE_ERROR))

    def score(name):
        found = F.coalesce(R.field(value, name, "double"), F.lit(0.0))
        return F.when(good, found).otherwise(F.lit(0.0)).alias(name)

    def reason(name):
        return F.when(good, R.field_or(value, name, "")).otherwise(trouble).alias(name)

    return rows.select(
        *kept,
        F.when(failed, "error").when(good, "ok").otherwise("parse_error").alias("status"),
        score("faithfulness"),
        reason("faithfulness_reason"),
        score("answer_relevance"),
        reason("relevance_reason"),
    )


def extract_articles(generated: DataFrame) -> DataFrame:
    """One row per article in the replies that are JSON lists; other replies give none.

    A key that no article of the whole table has becomes an empty text; one that only some lack is
    null for those. Further keys are dropped. Columns: those of ``generated`` but raw, position
    (from 0) and the five article fields.
    """
    kept = [c for c in generated.columns if c not in ("raw", "status")]
    listed = F.when(
        R.is_array(F.col("value")), F.try_variant_get(F.col("value"), "$", "array<variant>")
    )
    items = _positions(parsed(generated).select(*kept, listed.alias("items")), "items", "item")
    # Which keys occur decides over all rows: the parsed items are written, so no reply is parsed twice.
    path = scratch_path(generated.sparkSession, "items")
    items.write.parquet(path)
    items = generated.sparkSession.read.schema(items.schema).parquet(path)
    item = F.col("item")
    present = items.agg(
        F.struct(*(F.bool_or(R.has_field(item, n)).alias(n) for n in ARTICLE_FIELDS))
    ).scalar()
    return items.select(
        *kept,
        "position",
        *(
            F.when(present.getField(name), R.field(item, name))
            .otherwise(F.lit(""))
            .alias(name)
            for name in ARTICLE_FIELDS
        ),
    )


def status_counts(extracted: DataFrame) -> DataFrame:
    """Records per status."""
    return extracted.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def numbered(extracted: DataFrame, steps: str = "resolution_steps") -> DataFrame:
    """One row per resolution step: the other columns, step (from 1) and text."""
    kept = [c for c in extracted.columns if c != steps]
    return _positions(extracted, steps, "text").select(
        *kept, (F.col("position") + 1).alias("step"), "text"
    )


def _positions(df: DataFrame, listed: str, name: str) -> DataFrame:
    """One row per item of the array column ``listed``: the other columns, position and the item.

    The outer form, less its null rows, keeps the optimizer from testing the size of the array in
    a filter below, which would compute an extracted array twice.
    """
    kept = [c for c in df.columns if c != listed]
    exploded = df.select(*kept, F.posexplode_outer(listed).alias("position", name))
    return exploded.where(F.col("position").isNotNull())

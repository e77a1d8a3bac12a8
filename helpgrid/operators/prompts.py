"""Prompt texts built from retrieved articles.

The lists collected here hold the top k articles of one query, never more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIAGE_INSTRUCTIONS = (
    "You sort customer complaints for a support desk. Use the knowledge base entries below to "
    "choose the category of the complaint and the steps that resolve it. Answer with one JSON "
    "object that has the keys category, subcategory, journey_stage, confidence (High, Medium or "
    "Low), summary (one sentence) and resolution_steps (a list of texts). Write nothing else."
)
JUDGE_INSTRUCTIONS = (
    "You check answers given to customer complaints. Give two scores from 0 to 1: faithfulness, "
    "how far the answer rests on the context, and answer_relevance, how far it solves the "
    "complaint. Answer with one JSON object that has the keys faithfulness, faithfulness_reason, "
    "answer_relevance and relevance_reason. Write nothing else."
)
#: What each field of a new article holds, in the words of this library.
FIELD_NOTES = {
    "category": "as given for its place",
    "subcategory": "a short name for the narrower topic",
    "journey_stage": "where in an order's life it comes up",
    "issue_description": "what a customer would report",
    "resolution_steps": "what an agent does about it, numbered, as a single text",
}
GENERATE_INSTRUCTIONS = (
    "The reply is read by a program: a JSON array, an object per article, all fields texts.\n"
    + "\n".join(f"- {name}: {note}" for name, note in FIELD_NOTES.items())
)
#: Before and after the number of articles, and before and after their categories.
GENERATE_OPENING = ("Articles that the help desk still lacks: ", ".\nTheir categories by place: [", "].\n\n")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# The layout of an entry in the two contexts.


def context_entry() -> Column:
    """One article in the triage prompt."""
    return F.concat(
        F.lit("\n["), F.col("rank").cast("string"), F.lit("] Category: "), _text("category"),
        F.lit(" > "), _text("subcategory"),
        F.lit("\n    Stage: "), _text("journey_stage"),
        F.lit("\n    Issue: "), _text("issue_description"),
        F.lit("\n    Resolution: "), _text("resolution_steps"), F.lit("\n"),
    )


def judge_entry() -> Column:
    """One article in the judge prompt."""
    return F.concat(
        F.lit("["), _text("category"), F.lit(" > "), _text("subcategory"), F.lit("]: "),
        _text("issue_description"), F.lit(" | "), _text("resolution_steps"),
    )


def by_rank(hits: DataFrame, entry: Column, separator: str, name: str) -> DataFrame:
    """The entries of each query, joined in rank order: query_id, ``name``."""
    listed = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"))))
    joined = F.array_join(F.transform(listed, lambda x: x.entry), separator)
    return hits.groupBy("query_id").agg(joined.alias(name))


def context_block(hits: DataFrame) -> DataFrame:
    return by_rank(hits, context_entry(), "", "context")


def judge_context(hits: DataFrame) -> DataFrame:
    return by_rank(hits, judge_entry(), "\n", "judge_context")


def triage_prompts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id and prompt; a query without hits has an empty context."""
    joined = queries.select("query_id", "text").join(context_block(hits), "query_id", "left")
    return joined.select(
        "query_id",
        F.concat(
            F.lit(TRIAGE_INSTRUCTIONS),
            F.lit('\n\nWhat the customer wrote:\n"""'), _text("text"), F.lit('"""\n\n'),
            F.lit("Entries found for it, best first:"), _text("context"),
            F.lit("\n\nNow give that one object."),
        ).alias("prompt"),
    )


def judge_prompts(queries: DataFrame, hits: DataFrame, extracted: DataFrame) -> DataFrame:
    """query_id and prompt; the extracted response is shown as JSON."""
    shown = extracted.select(
        "query_id",
        F.to_json(
            F.struct(
                "category", "subcategory", "journey_stage", "confidence", "summary",
                "resolution_steps",
            ),
            {"ignoreNullFields": "false"},
        ).alias("response"),
    )
    joined = (
        queries.select("query_id", "text")
        .join(judge_context(hits), "query_id", "left")
        .join(shown, "query_id", "left")
    )
    return joined.select(
        "query_id",
        F.concat(
            F.lit(JUDGE_INSTRUCTIONS),
            F.lit("\n\nThe complaint was:\n"), _text("text"),
            F.lit("\n\nThe entries at hand were:\n"), _text("judge_context"),
            F.lit("\n\nThe answer to be checked is:\n"), _text("response"),
        ).alias("prompt"),
    )

"""The corpus pipeline: from raw documents to a training mix, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpgrid.llm.common import documents, stored, without
from helpgrid.llm.decontamination import decontaminated
from helpgrid.llm.line_dedup import dedup_lines
from helpgrid.llm.mixing import mixed
from helpgrid.llm.ngram_join import linked_documents
from helpgrid.llm.quality import accepted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of a grade above the least is at least a half."""
    return accepted(spark, docs, sf_dir)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their later repeated runs of lines; ``n_chars`` follows the text.

    A document of which nothing but white space is left was repeated as a whole, and goes. Null and empty texts stay;
    other columns keep their values, whatever their names.
    """
    given = [F.col(c) for c in docs.columns]
    done = dedup_lines(docs.select(F.struct(*given).alias("doc"), "doc_id", "text"))
    left = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = done.where((F.col("n_removed") == 0) | left)
    changed = {c: F.col("doc")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(changed["n_chars"])
    return kept.select(*(changed[c].alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 80 % of their runs of five words, the one with the smallest doc_id.

    Rows that repeat a text are one group; documents without words are no copies of each other and stay, null texts too.
    A null doc_id counts as the largest; of equal ids the row that is read first stays. Other columns keep their values.
    """
    rows = stored(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    texts = rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))
    linked = stored(
        linked_documents(texts, width=5, percent=80).where("n_shingles > 0 AND component_id IS NOT NULL"),
        "linked",
    )
    several = linked.groupBy("component_id").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = linked.join(several.hint("merge"), "component_id").select("component_id", F.col("doc_id").alias("row"))
    ids = members.join(rows.select("row", F.col("doc.doc_id").cast("long").alias("id")), "row")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("first"))
    copies = ids.join(first.hint("merge"), "component_id").where("row != first").select("row")
    number = {"_k1": F.col("row"), "_k2": F.lit(0).cast("long")}
    gone = copies.select(*(c.alias(k) for k, c in number.items()))
    return without(rows, gone, number).select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminated(spark, docs, sf_dir)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with the words taken of each and how often it is repeated."""
    return mixed(spark, docs, sf_dir)


#: (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The stages are trained, hashed and seeded: SQL cannot express run(). The tests hold near_dedup against brute force and run()
#: against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over all documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


pipeline = run

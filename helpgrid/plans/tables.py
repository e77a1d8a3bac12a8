"""The given tables in the roles of knowledge base, labelled queries and model replies.

Articles are all ``documents``, with the label and vector of the embedding that has the same id;
articles without one have no category and no vector. Queries are all ``benchmark`` passages, with
the embedding, label and source that carry their id. Replies are written from the texts and labels,
in a wrapping that depends on the language of the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helpgrid.operators.index import Index, build_index
from helpgrid.session import small

_indexes: dict[tuple, Index] = {}
_schemas: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its schema is looked up once in a session."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("kb_id"), "embedding")


def first_line():
    return F.substring_index("text", "\n", 1)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("category")
    )
    rest = F.when(
        F.contains("text", F.lit("\n")),
        F.substr("text", F.length(first_line()) + 2),
    )
    return documents.join(small(labels), "doc_id", "left").select(  # texts are not shuffled
        F.col("doc_id").alias("kb_id"),
        "category",
        F.col("source").alias("subcategory"),
        F.col("lang").alias("journey_stage"),
        first_line().alias("issue_description"),
        rest.alias("resolution_steps"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    embeddings = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        "embedding",
        F.col("label").cast("string").alias("expected_category"),
    )
    sources = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"), F.col("source").alias("expected_subcategory")
    )
    return items.join(embeddings, "query_id", "left").join(sources, "query_id", "left")


def user_turns(turns: DataFrame) -> DataFrame:
    """The complaints among the turns of conversations (a batch table or a stream)."""
    return turns.where(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text"
    )


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the articles, built by the first query of a session that needs it."""
    key = (spark.sparkContext.applicationId, sf_dir, *_versions(spark, sf_dir))
    if key not in _indexes:
        _indexes[key] = build_index(articles(spark, sf_dir), vectors(spark, sf_dir))
    return _indexes[key]


def _versions(spark: SparkSession, sf_dir: str) -> list:
    """When the indexed tables were last written, and their rows. Reads no column."""
    return [
        table(spark, sf_dir, name)
        .agg(F.max("_metadata.file_modification_time"), F.count(F.lit(1)))
        .first()
        for name in ("documents", "embeddings")
    ]


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw reply per document: plain, fenced, followed by more text, or not JSON."""
    lines = F.split("text", "\n")
    confidence = (
        F.when(F.col("n_chars") < 500, "High")
        .when(F.col("n_chars") < 2000, "Medium")
        .when(F.col("n_chars") < 5000, "Low")
        .when(F.col("n_chars") < 9000, "Unsure")
    )

    def reply(steps):
        return F.to_json(
            F.struct(
                F.col("source").alias("category"),
                F.col("lang").alias("subcategory"),
                F.concat(F.lit("Stage "), "lang").alias("journey_stage"),
                confidence.alias("confidence"),
                first_line().alias("summary"),
                steps.alias("resolution_steps"),
            ),
            {"ignoreNullFields": "false"},
        )

    body = F.when(F.size(lines) > 1, reply(lines)).otherwise(reply(F.col("text")))
    raw = (
        F.when(F.col("lang") == "en", body)
        .when(F.col("lang") == "de", F.concat(F.lit("\n```json\n"), body, F.lit("\n```\n")))
        .when(F.col("lang") == "es", F.concat(body, F.lit(" trailing")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"), raw.alias("raw")
    )


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw judgement per labelled document; some lack keys, some are lists or no JSON."""
    faithfulness = F.concat(F.lit('"faithfulness": '), F.col("quality").cast("string"))
    relevance = F.concat(F.lit('"answer_relevance": '), (1 - F.col("toxic")).cast("string"))
    reasons = F.concat(
        F.lit('"faithfulness_reason": "quality of '), "source",
        F.lit('", "relevance_reason": "tone of '), "source", F.lit('"'),
    )
    full = F.concat(
        F.lit("{"), faithfulness, F.lit(", "), relevance, F.lit(", "), reasons, F.lit("}")
    )
    raw = (
        F.when(F.col("lang") == "en", full)
        .when(
            F.col("lang") == "de",
            F.concat(F.lit("```json\n{"), faithfulness, F.lit("}\n```")),
        )
        .when(F.col("lang") == "es", F.concat(F.lit("["), full, F.lit("]")))
        .otherwise(F.concat(F.lit("```JSON\n"), full, F.lit("\n```")))
    )
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return (
        table(spark, sf_dir, "labels")
        .join(documents, "doc_id")
        .select(F.col("doc_id").alias("query_id"), raw.alias("raw"))
    )


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply for every five documents: lists, fenced lists, bare objects, or trailing text."""
    labels = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("label")
    )
    item = F.struct(
        F.coalesce("label", "source").alias("category"),
        F.col("source").alias("subcategory"),
        F.when(F.col("lang") != "es", F.col("lang")).alias("journey_stage"),
        first_line().alias("issue_description"),
        F.col("n_chars").alias("length"),
    )
    batches = (
        table(spark, sf_dir, "documents")
        .join(small(labels), "doc_id", "left")
        .groupBy(F.floor(F.col("doc_id") / 5).alias("batch_id"))
        .agg(
            F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("listed"),
            F.count_if(F.col("lang") == "fr").alias("kind"),
        )
        .withColumn("items", F.transform("listed", lambda x: x.item))
    )
    body = F.to_json("items")
    raw = (
        F.when(F.col("kind") == 0, body)
        .when(F.col("kind") == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("kind") == 2, F.to_json(F.get("items", F.lit(0))))
        .otherwise(F.concat(body, F.lit(" done")))
    )
    return batches.select("batch_id", raw.alias("raw"))


def allowed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.col("label").cast("string").alias("category"))
        .distinct()
    )

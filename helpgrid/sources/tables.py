"""Reading and writing knowledge bases, query sets, vectors and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpgrid.operators.growth import conform
from helpgrid.schemas import ARTICLE, ARTICLE_FIELDS, LABELLED_COMPLAINT
from helpgrid.session import written

# RFC 4180: a quote inside quotes is doubled, and fields keep their blanks and line breaks.
CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

# A file that one task reads whole has about this many bytes of text.
FILE_BYTES = 32 << 20


def _empty_as_null(df: DataFrame) -> DataFrame:
    return df.select(
        *(
            F.when(F.col(f.name) != "", F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        )
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with header. All columns have the given types; only empty fields are null.

    A file with line breaks inside fields is read by one task, so large tables should come as
    many files, or as Parquet.
    """
    return _empty_as_null(spark.read.options(**CSV).schema(schema).csv(path))


def read_articles_csv(spark: SparkSession, path: str, with_key: bool = False) -> DataFrame:
    """A knowledge base; ``with_key`` if its first column is kb_id, else rows are counted from 0."""
    if with_key:
        schema = T.StructType([T.StructField("kb_id", T.LongType()), *ARTICLE.fields])
        return read_csv(spark, path, schema)
    return read_positions(spark, path, ARTICLE, "kb_id")


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set: query_id (from 0), text and the two expected labels."""
    rows = read_positions(spark, path, LABELLED_COMPLAINT, "query_id")
    return rows.withColumnRenamed("complaint", "text")


def labelled_queries(spark: SparkSession, cases: list[tuple[str, str, str]]) -> DataFrame:
    """An evaluation set from a list written in the program."""
    rows = [(i, *case) for i, case in enumerate(cases)]
    return spark.createDataFrame(
        rows, "query_id long, text string, expected_category string, expected_subcategory string"
    )


def read_positions(spark: SparkSession, path: str, schema: T.StructType, name: str) -> DataFrame:
    """A CSV table with ``name``, the row's position from 0: files in the order of their paths, rows as they stand in them.

    A file with quoted line breaks is read by one task, in order. Rows are numbered once and written with their
    numbers; each file starts after the rows of those before it, which takes one row a file.
    """
    rows = spark.read.options(**CSV).schema(schema).csv(path)
    marked = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"))
    marked = written(_empty_as_null(marked), "positions")
    files = marked.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_row") - F.col("_first")
    return marked.join(F.broadcast(starts), "_file").select(place.alias(name), *schema.names)


def read_vectors(spark: SparkSession, path: str, key: str, vector: str) -> DataFrame:
    """Vectors for articles (kb_id) or queries, as written by an embedding job."""
    return spark.read.parquet(path).select(
        F.col(key).alias("kb_id"), F.col(vector).cast("array<float>").alias("embedding")
    )


def attach_vectors(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Queries with their vector; a query without one keeps a null."""
    return queries.join(
        vectors.select(F.col("kb_id").alias("query_id"), "embedding"), "query_id", "left"
    )


def write_articles(
    articles: DataFrame, path: str, mode: str = "append", kind: str = "parquet", key: bool = True
) -> None:
    """Appends to the knowledge base at ``path``, or overwrites it.

    ``articles`` must not be read from ``path`` when it is overwritten.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be append or overwrite")
    columns = ["kb_id", *ARTICLE_FIELDS] if key else list(ARTICLE_FIELDS)
    rows = conform(articles, ["kb_id"] if key else []).select(*columns)
    if kind == "csv":
        rows.write.mode(mode).options(**CSV).csv(path)
    else:
        rows.write.mode(mode).format(kind).save(path)


def write_ordered_csv(rows: DataFrame, path: str, key: str, columns: list[str]) -> None:
    """The columns without the key as CSV files, in its order over files and lines.

    One task reads a file whose fields hold line breaks, so there are as many files as the text needs, and two at least.
    """
    text = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in columns]
    size = rows.agg(F.coalesce(F.sum(reduce(Column.__add__, text)), F.lit(0))).first()[0]
    ordered = rows.repartitionByRange(max(2, -(-size // FILE_BYTES)), key).sortWithinPartitions(key)
    ordered.select(*columns).write.options(**CSV).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A breakdown as CSV with header, replacing an earlier one."""
    report.write.mode("overwrite").options(**CSV).csv(path)

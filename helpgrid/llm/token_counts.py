"""Token counts as delta-maintained rollups.

A store is a folder with a ledger of signed rows (one per document, tokenizer and batch) and the
additive totals of each batch. A batch of changes inserts, revises or deletes documents: the ledger's
rows of the touched documents are taken back with negative sign and the new counts are added. Totals are the
sum over committed batches, so a commit costs what changed and never recounts the corpus.

A batch is committed once its totals are written. Repeating a committed batch changes nothing;
repeating one that was cut off replaces its own folders.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpgrid.llm.common import documents, only_ids, ship_package, stored, table
from helpgrid.session import scratch_path

KEYS = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern published with the vocabulary, which splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A tokenizer: given once in each task, returns the function that counts the tokens of a text.
Counter = Callable[[], Callable[[str], int]]


def words() -> Callable[[str], int]:
    """Counts the runs of characters other than ASCII white space."""
    return lambda text: len(text.encode().split())


class BytePairs:
    """Counts byte-pair tokens. The driver reads the rank file; tasks get its content, a few MB at most."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as file:
            self.content = file.read()

    def __call__(self) -> Callable[[str], int]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.content.splitlines())}
        encoding = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))


def _count(counters: dict[str, Counter], shared):
    def run(batches):
        made = {name: make() for name, make in shared.value.items()}
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for name, count in made.items():
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("doc_id", "source", "lang")]
                    + [
                        pa.array([name] * len(texts), pa.string()),
                        pa.array([1] * len(texts), pa.int64()),
                        pa.array([count(x) for x in texts], pa.int64()),
                    ],
                    names=["doc_id", "source", "lang", "tokenizer", "docs", "tokens"],
                )

    return run


def counted(docs: DataFrame, counters: dict[str, Counter]) -> DataFrame:
    """Ledger rows of the documents: one for each of them and each tokenizer version."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(counters)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")),
    ).mapInArrow(_count(counters, shared), LEDGER)


class TokenRollup:
    """The store in ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def batches(self) -> list[str]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/totals")
        files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(hadoop):
            return []
        names = [x.getPath().getName() for x in files.listStatus(hadoop)]
        return sorted(n for n in names if self._exists(f"{self.path}/totals/{n}/_SUCCESS"))

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{name}" for name in self.batches()]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, batch: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Applies one batch; False if it was committed before.

        ``upserts`` has ledger rows (see :func:`counted`): all rows that share a doc_id together
        replace the document of that id. ``deletes`` has a doc_id column; unknown ids change nothing. A null doc_id is
        an id like others.
        """
        if self._exists(f"{self.path}/totals/{batch}/_SUCCESS"):
            return False
        upserts = None if upserts is None else stored(upserts, "upserts")  # counted once, read twice
        touched = [x.select(F.col("doc_id").cast("long").alias("id")) for x in (upserts, deletes) if x is not None]
        if not touched:
            raise ValueError("a batch needs upserts or deletes")
        ids = reduce(DataFrame.union, touched).distinct()
        ledger = self._read("ledger", LEDGER)
        signed = (
            ledger.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
            .groupBy("doc_id", *KEYS)
            .agg((-F.sum("docs")).alias("docs"), (-F.sum("tokens")).alias("tokens"))
            .where("docs != 0 OR tokens != 0")
        )
        if upserts is not None:
            signed = signed.unionByName(upserts)
        signed.write.mode("overwrite").parquet(f"{self.path}/ledger/{batch}")
        written = self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger/{batch}")
        _sums(written).write.mode("overwrite").parquet(f"{self.path}/totals/{batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens): what the committed batches add up to."""
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        return _sums(self._read("totals", schema)).where("docs != 0 OR tokens != 0")


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def op6_token_counts(spark, sf_dir, vocabulary: str = VOCABULARY):
    """Totals after three batches over the whole table: all documents come in, those labelled toxic
    return with their digits masked, those labelled as of low quality are deleted. The first batch is sent twice.
    """
    counters = {"words-1": words, "byte_bpe_50k-1": BytePairs(vocabulary)}
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    store = TokenRollup(spark, scratch_path(spark, "token-rollup"))
    everything = counted(docs, counters)
    store.commit("1-load", everything)
    store.commit("1-load", everything)
    masked = only_ids(docs, labels.where("toxic = 1")).withColumn("text", F.regexp_replace("text", "[0-9]", "0"))
    store.commit("2-mask", counted(masked, counters))
    store.commit("3-delete", deletes=labels.where("quality = 0"))
    return store.totals()

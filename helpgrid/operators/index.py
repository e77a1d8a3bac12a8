"""The search index: postings, document frequencies, norms and vectors, as written tables.

An index is a version on top of segments. A segment holds what one build or refresh has added, and never changes:

``counts``    one row per article: kb_id, terms, counts, n_terms
``terms``     one row per term of the segment: shard, code, term, df
``postings``  one row per article and term: shard, code, kb_id, tf
``vectors``   articles with a vector: kb_id, embedding, length

A term's code is its 64-bit hash; the few terms that share one get another number, and a code is never changed. ``terms`` and
``postings`` lie in folders by the leading bits of the code (the shard) and are sorted by code, so
a search for some terms reads their shards, and inside them the pages that hold their codes. A term found in a
third of all articles is spread over as many files as it needs.

A version adds up its segments: document frequencies are sums over segments, and ``sums`` has what an article's norm
follows from. With idf = A - g, where A = ln(1 + n) + 1 depends on the number of articles and g = ln(1 + df) on the
term, the squared norm is ``A^2 s0 - 2 A s1 + s2`` for the sums s0, s1, s2 of tf^2, tf^2 g and tf^2 g^2 over an article's terms.
New articles change A for all at no cost, and s1 and s2 only through the terms they contain.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helpgrid.functions.text import corpus_text, with_term_counts
from helpgrid.functions.vectors import checked_vector, l2_norm
from helpgrid.session import BROADCAST_BYTES, PARTITION_ROWS, partitions_for, scratch_path, setting, ship_package, written

# At most this many terms, and this many bytes of them, are broadcast as frequent ones.
FREQUENT_TERMS = 400_000
FREQUENT_BYTES = 32 << 20
# Postings of a shard, about; a power of two of shards is taken.
SHARD_POSTINGS = 1 << 22
# Codes are looked up by shard up to this many, and listed in the filter of a scan up to this many.
SHARDED_CODES, LISTED_CODES = 100_000, 500
# Files of shards that a task keeps open; with more shards than that its rows are sorted by shard.
OPEN_SHARDS = 64
# Rows that leave a task at once.
TERM_ROWS = 1 << 17
# Terms of at least this many articles are heavy: their postings are spread over tasks by article.
HEAVY = 1 << 17
# A refresh that would make more segments than this merges them into one.
SEGMENTS = 16

# Sorted texts and codes are written as differences.
PACKED = {"compression": "zstd", "parquet.writer.version": "v2"}

COUNTS = "kb_id long, terms array<string>, counts array<int>, n_terms int"
TERMS = "code long, term string, df long, shard int"
POSTINGS = "code long, kb_id long, tf int, shard int"
# As written: df counts articles of the segment alone.
WRITTEN_POSTINGS = f"{POSTINGS}, df long"
VECTORS = "kb_id long, embedding array<float>, length double"
SUMS = "kb_id long, n_terms int, has_vector boolean, s0 double, s1 double, s2 double"
CODES = "term string, code long"


@dataclass(frozen=True)
class Segment:
    """What one build or refresh has added. There are ``2 ** bits`` shards."""

    path: str
    bits: int

    def shards(self, codes: Sequence[int]) -> list[int]:
        return sorted({(code & (1 << 64) - 1) >> (64 - self.bits) for code in codes}) if self.bits else [0]


@dataclass(frozen=True)
class Index:
    """One version of an index. ``n`` articles, ``n_vectors`` of them with a vector, hold ``n_postings`` (article, term) pairs."""

    spark: SparkSession
    path: str
    segments: tuple[Segment, ...]
    n: int
    n_postings: int
    n_vectors: int
    dimension: int | None

    def _read(self, kind: str, schema: str, codes: Sequence[int] | None = None, part: tuple[int, int] | None = None) -> DataFrame:
        """``part``: a number of leading bits and what they are, of the codes that are wanted; only their shards are read."""
        parts = []
        for segment in self.segments:
            rows = self.spark.read.schema(schema).parquet(f"{segment.path}/{kind}")
            if part is not None:
                shared = min(part[0], segment.bits)
                rows = rows.where(F.shiftright("shard", segment.bits - shared) == part[1] >> (part[0] - shared))
            if codes is not None:
                rows = rows.where(_one_of("shard", segment.shards(codes)))
                if len(codes) <= LISTED_CODES:
                    rows = rows.where(_one_of("code", codes))
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts)

    @property
    def counts(self) -> DataFrame:
        return self._read("counts", COUNTS)

    @property
    def vectors(self) -> DataFrame:
        return self._read("vectors", VECTORS)

    def postings(self, codes: Sequence[int] | None = None) -> DataFrame:
        """code, kb_id, tf; of the shards that ``codes`` lie in, and of these codes alone if they are few."""
        return self._read("postings", POSTINGS, codes).drop("shard")

    def frequencies(self, codes: Sequence[int] | None = None) -> DataFrame:
        """code, term, df; limited like ``postings``."""
        rows = self._read("terms", TERMS, codes).drop("shard")
        if len(self.segments) == 1:
            return rows
        return rows.groupBy("code", "term").agg(F.sum("df").alias("df"))

    def met(self, kind: str, schema: str, terms: DataFrame, how: str = "inner") -> DataFrame:
        """The rows of all segments' tables with a code of ``terms`` (code and other numbers), joined where they lie.

        ``terms`` are broadcast in parts, by the leading bits of their codes. Each part meets its own shards, so that the tables are read once
        and not shuffled, however many terms there are.
        """
        size, codes = terms.count() * (8 * len(terms.columns) + 8), few_codes(terms)
        bits = (size // FREQUENT_BYTES).bit_length()
        parts = []
        for number in range(1 << bits):
            mine = terms.where(F.shiftrightunsigned("code", 64 - bits) == number) if bits else terms
            parts.append(self._read(kind, schema, codes, (bits, number)).drop("shard").join(F.broadcast(mine), "code", how))
        return reduce(DataFrame.unionByName, parts)

    @property
    def terms(self) -> DataFrame:
        return self.frequencies().select("term", "df")

    @property
    def idf(self) -> DataFrame:
        return self.terms.withColumn("idf", smoothed_idf(F.col("df"), self.n))

    @property
    def sums(self) -> DataFrame:
        return self.spark.read.schema(SUMS).parquet(f"{self.path}/sums")

    @property
    def norms(self) -> DataFrame:
        """kb_id, n_terms, has_vector and the Euclidean length of the article's tf-idf vector."""
        a = F.log(F.lit(1.0 + self.n)) + F.lit(1.0)
        squared = a * a * F.col("s0") - F.lit(2.0) * a * F.col("s1") + F.col("s2")
        return self.sums.select("kb_id", "n_terms", "has_vector", F.sqrt(F.greatest(squared, F.lit(0.0))).alias("norm"))

    @property
    def moved(self) -> dict[str, int]:
        """The few terms whose code is not their hash."""
        rows = self.spark.read.schema(CODES).parquet(f"{self.path}/codes").collect()
        return {row.term: row.code for row in rows}

    def code(self, term: Column) -> Column:
        return unique_code(term, self.moved)


def _one_of(column: str, numbers: Sequence[int]) -> Column:
    """As SQL, the numbers cross to the JVM at once."""
    return F.expr(f"{column} IN ({', '.join(f'{x}L' if column == 'code' else str(x) for x in numbers)})") if numbers else F.lit(False)


def smoothed_idf(df: Column, n: int) -> Column:
    return F.log((F.lit(1.0) + F.lit(float(n))) / (F.lit(1.0) + df)) + F.lit(1.0)


def term_hash(term: Column) -> Column:
    return F.xxhash64(term)


def shared_codes(terms: DataFrame) -> list[tuple[int, str]]:
    """(code, term) of the terms (code, term) that have their code in common with another one, all but the first of each.

    With 64 bits, a vocabulary of ten billion terms has about three such pairs, so they are few whatever the data.
    """
    n, n_codes = terms.agg(F.count(F.lit(1)), F.count_distinct("code")).first()
    if n == n_codes:
        return []
    shared = terms.groupBy("code").agg(F.array_sort(F.collect_list("term")).alias("terms")).where("size(terms) > 1")
    rest = F.slice("terms", F.lit(2), F.size("terms") - 1)
    return [tuple(r) for r in shared.select("code", F.explode(rest).alias("term")).orderBy("code", "term").collect()]


def free_codes(count: int, taken_by: DataFrame) -> list[int]:
    """The least numbers from 0 on that are no code of ``taken_by`` (code)."""
    codes: list[int] = []
    candidate = 0
    while len(codes) < count:
        tried = list(range(candidate, candidate + 2 * count))
        taken = {row.code for row in taken_by.where(F.col("code").isin(tried)).select("code").collect()}
        codes += [code for code in tried if code not in taken]
        candidate = tried[-1] + 1
    return codes[:count]


def unique_code(term: Column, moved: dict[str, int]) -> Column:
    if not moved:
        return term_hash(term)
    listed = F.create_map(*(F.lit(x) for pair in moved.items() for x in pair))
    return F.coalesce(F.try_element_at(listed, term).cast("long"), term_hash(term))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Redistributes ``df`` if it comes in fewer files than there are task slots.

    One large file that cannot be split would otherwise be tokenized by a single task. A table of
    many files is left where it is.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= slots else df.repartition(key)


def postings(counts: DataFrame) -> DataFrame:
    """One row per article and term: the other columns of ``counts``, term and tf."""
    kept = [c for c in counts.columns if c not in ("terms", "counts")]
    return counts.select(*kept, F.inline(F.arrays_zip("terms", "counts"))).select(
        *kept, F.col("terms").alias("term"), F.col("counts").alias("tf")
    )


def document_frequencies(counts: DataFrame) -> DataFrame:
    """Articles per term. Partial counts are made before the shuffle, so no term is a hot key."""
    return (
        counts.select(F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def _with_codes(counts: DataFrame, moved: dict[str, int]) -> DataFrame:
    ship_package(counts.sparkSession)
    return counts.select("kb_id", "terms", "counts", F.transform("terms", lambda term: unique_code(term, moved)).alias("codes"))


def _slices(codes: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of codes, as numbers from 0."""
    return (codes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(codes), dtype=np.int64)


def _lists(values: np.ndarray | pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values) if isinstance(values, np.ndarray) else values)


def _begins(codes: np.ndarray) -> np.ndarray:
    """Where runs of equal codes begin."""
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, dtype=np.int64)


def _out(columns: dict[str, np.ndarray | pa.Array], codes: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    rows = pa.record_batch(columns | {"code": codes, "shard": _slices(codes, bits).astype(np.int32)})
    for start in range(0, rows.num_rows, TERM_ROWS):
        yield rows.slice(start, TERM_ROWS)


def segment_terms(counts: DataFrame, bits: int, moved: dict[str, int], slice_bits: int = 0) -> DataFrame:
    """code, term, df, clash and shard of every code, in tasks sorted by code.

    Articles per term are counted batch by batch before the only shuffle, so no term is a hot key, and a task holds the terms of one
    batch, however many articles it reads. Codes are spread evenly, so their leading bits (a slice) make even tasks. A batch's terms of a
    slice cross as one row, sorted as text, in which neighbours share their beginnings. ``clash`` marks codes that several terms have; only
    one is named.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = batch.column("terms").flatten().dictionary_encode()
            number = met.indices.to_numpy()
            if not len(number):
                continue
            first = np.flatnonzero(number > np.concatenate([[-1], np.maximum.accumulate(number)[:-1]]))
            slices = _slices(batch.column("codes").flatten().to_numpy()[first], slice_bits)
            order = pc.array_sort_indices(met.dictionary).to_numpy()
            order = order[np.argsort(slices[order], kind="stable")]
            held = np.bincount(slices)
            ends = np.concatenate([[0], np.cumsum(held[held > 0])])
            texts = pc.binary_join(_lists(met.dictionary.take(pa.array(order)), ends), "\n")
            columns = [pa.array(np.flatnonzero(held).astype(np.int32)), texts, _lists(np.bincount(number)[order].astype(np.int32), ends)]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "terms", "dfs"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(c).flatten() for c in ("terms", "codes", "dfs")] for batch in batches if batch.num_rows]
        if not parts:
            return
        terms, codes, dfs = (pa.concat_arrays(c) for c in zip(*parts))
        codes = codes.to_numpy()
        order = np.argsort(codes, kind="stable")
        codes, terms = codes[order], terms.take(pa.array(order))
        begins = _begins(codes)
        other = np.concatenate([[False], pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False)])
        other[begins] = False
        df = np.add.reduceat(dfs.to_numpy()[order].astype(np.int64), begins)
        yield from _out({"term": terms.take(pa.array(begins)), "df": df, "clash": np.logical_or.reduceat(other, begins)}, codes[begins], bits)

    met = _with_codes(counts, moved).select("terms", "codes").mapInArrow(count, "slice int, terms string, dfs array<int>")
    met = met.repartitionById(1 << slice_bits, "slice").select(F.split("terms", "\n").alias("terms"), "dfs")
    met = met.select("terms", F.transform("terms", lambda term: unique_code(term, moved)).alias("codes"), "dfs")
    return met.mapInArrow(add_up, "term string, df long, clash boolean, code long, shard int")


def segment_postings(counts: DataFrame, bits: int, moved: dict[str, int], slice_bits: int = 0, heavy: Sequence[int] = ()) -> DataFrame:
    """kb_id, tf, df, code and shard of all postings of a segment but those of ``heavy`` codes, in tasks sorted by code.

    A batch's postings of a slice cross as one row, with each code once. A task gets all postings of its codes, which no code has many of, and counts
    them: so ``df``, of the segment, is written with each posting, and meets no table of terms.
    """
    left_out = np.array(heavy, dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, tf = (batch.column(c).flatten().to_numpy() for c in ("codes", "counts"))
            kb_id = np.repeat(batch.column("kb_id").to_numpy(), batch.column("codes").value_lengths().fill_null(0).to_numpy())
            if len(left_out):
                kept = ~np.isin(codes, left_out)
                codes, tf, kb_id = codes[kept], tf[kept], kb_id[kept]
            if not len(codes):
                continue
            order = np.argsort(codes.view(np.uint64), kind="stable")
            codes, tf, kb_id = codes[order], tf[order], kb_id[order]
            begins = _begins(codes)
            slices = _slices(codes[begins], slice_bits)
            held = np.bincount(slices)
            ends = np.concatenate([[0], np.cumsum(held[held > 0])])
            all_ends = np.concatenate([begins, [len(codes)]])[ends]
            each = np.diff(np.concatenate([begins, [len(codes)]])).astype(np.int32)
            columns = [pa.array(np.flatnonzero(held).astype(np.int32)), _lists(codes[begins], ends), _lists(each, ends)]
            yield pa.RecordBatch.from_arrays([*columns, _lists(kb_id, all_ends), _lists(tf, all_ends)], ["slice", "codes", "each", "kb_ids", "tfs"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(c).flatten().to_numpy() for c in ("codes", "each", "kb_ids", "tfs")] for batch in batches if batch.num_rows]
        if not parts:
            return
        codes, each, kb_id, tf = (np.concatenate(c) for c in zip(*parts))
        codes = np.repeat(codes, each)
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        begins = _begins(codes)
        df = np.diff(np.concatenate([begins, [len(codes)]]))
        yield from _out({"kb_id": kb_id[order], "tf": tf[order], "df": np.repeat(df, df)}, codes, bits)

    dealt = _with_codes(counts, moved).mapInArrow(deal, "slice int, codes array<long>, each array<int>, kb_ids array<long>, tfs array<int>")
    dealt = dealt.repartitionById(1 << slice_bits, "slice").drop("slice")
    return dealt.mapInArrow(gather, "kb_id long, tf int, df long, code long, shard int")


def article_counts(articles: DataFrame, stop_words=None) -> DataFrame:
    """Term counts of the corpus text of each article."""
    corpus = spread(articles, "kb_id").select(
        F.col("kb_id").cast("long").alias("kb_id"), corpus_text().alias("corpus")
    )
    return with_term_counts(corpus, "corpus", stop_words).select(
        "kb_id", "terms", "counts", F.size("terms").alias("n_terms")
    )


def coded(counts: DataFrame, moved: dict[str, int]) -> DataFrame:
    """One row per article and term: kb_id, term, tf, code."""
    return postings(counts.select("kb_id", "terms", "counts")).withColumn("code", unique_code(F.col("term"), moved))


def frequent_from(frequencies: DataFrame, n_postings: int) -> int:
    """The least document frequency at which a term is broadcast.

    At most n_postings / f terms occur in f or more articles, which bounds their number whatever
    the data; the bytes are measured, and the limit raised until they fit.
    """
    least = max(1, -(-n_postings // FREQUENT_TERMS))
    while True:
        size = frequencies.where(F.col("df") >= least).agg(F.count(F.lit(1)) * 24).first()[0]
        if size <= FREQUENT_BYTES:
            return least
        least *= 2


def weighed(tall: DataFrame, sorted_postings: DataFrame, frequencies: DataFrame, n_postings: int) -> DataFrame:
    """kb_id, code, term, tf and df of every posting.

    Frequent terms hold most postings; their df is broadcast to the rows of ``tall`` (from the articles' counts),
    which never move. The postings of all others are shuffled by code, and no key is larger than the limit.
    """
    least = frequent_from(frequencies, n_postings)
    frequent = F.broadcast(frequencies.where(F.col("df") >= least).select("code", "df"))
    columns = ["kb_id", "code", "term", "tf", "df"]
    tasks = -(-n_postings // PARTITION_ROWS)
    rare = _dealt(sorted_postings.join(frequent, "code", "left_anti"), tasks, "code").join(
        _dealt(frequencies.where(F.col("df") < least), tasks, "code"), "code"
    )
    return tall.join(frequent, "code").select(*columns).unionByName(rare.select(*columns))


def _dealt(rows: DataFrame, tasks: int, key: str) -> DataFrame:
    """Rows that are shuffled by ``key`` in any case, in more partitions than are set if they need ``tasks``."""
    return rows.repartition(tasks, key) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def tfidf_weights(index: Index) -> DataFrame:
    """The normalized tf-idf matrix in long form: kb_id, term, tf, weight."""
    rows = weighed(coded(index.counts, index.moved), index.postings(), index.frequencies(), index.n_postings)
    weight = F.col("tf") * smoothed_idf(F.col("df"), index.n) / F.col("norm")
    norms = index.norms
    if index.n * 32 <= BROADCAST_BYTES:
        norms = F.broadcast(norms)
    else:
        tasks = -(-index.n_postings // PARTITION_ROWS)
        rows, norms = _dealt(rows, tasks, "kb_id"), _dealt(norms, tasks, "kb_id")
    return rows.join(norms, "kb_id").select("kb_id", "term", "tf", weight.alias("weight"))


def article_sums(tall: DataFrame, sorted_postings: DataFrame, frequencies: DataFrame, n_postings: int) -> DataFrame:
    """kb_id, s0, s1 and s2 of whole articles, from the same rows as ``weighed``.

    Most terms occur in one article. Sums are taken of what g and g^2 exceed those of such a term by, and s0 times these are added
    at the end, so that their postings meet no frequency and are not shuffled by article.
    """
    least = max(2, frequent_from(frequencies, n_postings))
    frequent = F.broadcast(frequencies.where(F.col("df") >= least).select("code", "df"))
    tasks = -(-n_postings // PARTITION_ROWS)
    shared = frequencies.where((F.col("df") > 1) & (F.col("df") < least)).select("code", "df")
    rare = _dealt(sorted_postings.join(frequent, "code", "left_anti"), tasks, "code").join(_dealt(shared, tasks, "code"), "code")

    one, g = F.log(F.lit(2.0)), F.log(F.lit(1.0) + F.col("df"))
    square, zero = (F.col("tf") * F.col("tf")).cast("double"), F.lit(0.0)
    above = [F.coalesce(square * (g - one), zero).alias("d1"), F.coalesce(square * (g * g - one * one), zero).alias("d2")]
    rows = tall.join(frequent, "code", "left").select("kb_id", square.alias("s0"), *above)
    rows = rows.unionByName(rare.select("kb_id", zero.alias("s0"), *above))
    sums = rows.groupBy("kb_id").agg(*(F.sum(c).alias(c) for c in ("s0", "d1", "d2")))
    return sums.select("kb_id", "s0", (F.col("d1") + one * F.col("s0")).alias("s1"), (F.col("d2") + one * one * F.col("s0")).alias("s2"))


def segment_sums(counts: DataFrame, written_postings: DataFrame) -> DataFrame:
    """``article_sums`` of articles whose terms are in one segment alone, whose postings have their df with them.

    Before the shuffle the sums of an article are added up in each task, so that it gets no more rows than tasks times articles.
    """
    one, g = F.log(F.lit(2.0)), F.log(F.lit(1.0) + F.col("df"))
    square, zero = (F.col("tf") * F.col("tf")).cast("double"), F.lit(0.0)
    above = [F.sum(square * (g - one)).alias("d1"), F.sum(square * (g * g - one * one)).alias("d2")]
    shared = written_postings.where("df > 1").groupBy("kb_id").agg(*above)
    s0 = F.aggregate("counts", zero, lambda total, tf: total + tf * tf)
    sums = counts.select("kb_id", s0.alias("s0")).join(shared, "kb_id", "left")
    s1, s2 = (F.coalesce(d, zero) + w * F.col("s0") for d, w in (("d1", one), ("d2", one * one)))
    return sums.select("kb_id", "s0", s1.alias("s1"), s2.alias("s2"))


def build_index(
    articles: DataFrame,
    vectors: DataFrame | None = None,
    path: str | None = None,
    stop_words=None,
) -> Index:
    """Indexes ``articles`` (kb_id and the five text fields) and ``vectors`` (kb_id, embedding).

    An article without a vector counts as a zero vector. ``path`` must be new and readable by all
    executors; by default it lies below ``spark.checkpoint.dir``.
    """
    path = path or scratch_path(articles.sparkSession, "index")
    article_counts(articles, stop_words).write.options(**PACKED).parquet(f"{path}/segment/counts")
    return _index_counts(articles.sparkSession, path, vectors)


def compact_index(index: Index, path: str | None = None) -> Index:
    """The same index in one segment."""
    path = path or scratch_path(index.spark, "index")
    index.counts.write.options(**PACKED).parquet(f"{path}/segment/counts")
    return _index_counts(index.spark, path, index.vectors.drop("length"), index.dimension)


def _index_counts(spark: SparkSession, path: str, vectors: DataFrame | None, dimension: int | None = None) -> Index:
    """An index of one segment, whose counts have been written."""
    segment, counts, n, n_postings = _open_segment(spark, path)
    with partitions_for(spark, n_postings):
        return _index_segment(spark, path, segment, counts, n, n_postings, vectors, dimension)


def _index_segment(
    spark: SparkSession, path: str, segment: Segment, counts: DataFrame, n: int, n_postings: int, vectors: DataFrame | None, dimension: int | None
) -> Index:
    check_unique(counts, "kb_id")
    shares = _write_terms(counts, segment, {}, n_postings)
    dimension = dimension or _dimension(vectors)
    n_vectors = _write_vectors(spark, vectors, dimension, segment)
    index = Index(spark, path, (segment,), n, n_postings, n_vectors, dimension)
    shared = shared_codes(index.frequencies()) if shares else []
    moved = dict(zip((term for _, term in shared), free_codes(len(shared), index.frequencies()) if shared else []))
    if moved:
        _write_terms(counts, segment, moved, n_postings)
    _write_postings(counts, segment, moved, n_postings)
    sums = segment_sums(counts, spark.read.schema(WRITTEN_POSTINGS).parquet(f"{segment.path}/postings"))
    return _finish(index, moved, _of_all(segment, counts, sums))


def refresh_index(
    index: Index,
    new_articles: DataFrame,
    vectors: DataFrame | None = None,
    path: str | None = None,
    stop_words=None,
) -> Index:
    """A new version of the index with ``new_articles`` and their ``vectors`` added as a segment.

    Old segments stay as they are, and old versions keep working. Of the old articles only the sums of those that
    contain a term of the new ones change, by the postings of these terms. Beyond ``SEGMENTS`` segments
    all are merged into one.
    """
    spark = index.spark
    path = path or scratch_path(spark, "index")
    article_counts(new_articles, stop_words).write.options(**PACKED).parquet(f"{path}/segment/counts")
    segment, counts, n, n_postings = _open_segment(spark, path)
    with partitions_for(spark, index.n_postings + n_postings):
        done = _refreshed(index, path, segment, counts, n, n_postings, vectors)
        return compact_index(done) if len(done.segments) > SEGMENTS else done


def _refreshed(
    index: Index, path: str, segment: Segment, counts: DataFrame, n: int, n_postings: int, vectors: DataFrame | None
) -> Index:
    spark = index.spark
    check_unique(counts, "kb_id")
    again = index.sums.join(counts.select("kb_id"), "kb_id", "left_semi").limit(5).collect()
    if again:
        raise ValueError(f"kb_id must be unique; in the index already: {sorted(r.kb_id for r in again)}")

    moved = index.moved
    shares = _write_terms(counts, segment, moved, n_postings)

    def own_terms() -> DataFrame:
        rows = spark.read.schema(TERMS).parquet(f"{segment.path}/terms")
        return rows.select("code", "term", F.col("df").alias("more"))

    added = own_terms()
    held = _held_terms(index, added)
    clashing = _clashes(held, added, shares)
    if clashing:
        taken = index.frequencies().select("code").unionByName(added.select("code"))
        moved = moved | dict(zip(clashing, free_codes(len(clashing), taken)))
        _write_terms(counts, segment, moved, n_postings)
        added = own_terms()
        held = _held_terms(index, added)
    _write_postings(counts, segment, moved, n_postings)
    dimension = index.dimension or _dimension(vectors)
    n_vectors = index.n_vectors + _write_vectors(spark, vectors, dimension, segment)

    # terms of the new articles with their df before and after; of other terms nothing changes
    met_path = f"{path}/changed"
    added.join(held.select("code", "df"), "code", "left").select(
        "code", "term", F.coalesce("df", F.lit(0)).alias("before"), (F.coalesce("df", F.lit(0)) + F.col("more")).alias("df")
    ).write.parquet(met_path)
    changed = spark.read.parquet(met_path)
    known = changed.where("before > 0").select("code", "before", "df", (F.col("df") - F.col("before")).alias("more"))
    alone = Index(spark, path, (segment,), n, n_postings, 0, dimension)
    own_moves = _moves(alone, known, "more").withColumnsRenamed({"d1": "m1", "d2": "m2"})
    moves = _moves(index, known, "before")
    own = segment_sums(counts, spark.read.schema(WRITTEN_POSTINGS).parquet(f"{segment.path}/postings")).join(own_moves, "kb_id", "left")
    s1, s2 = (F.col(s) + F.coalesce(m, F.lit(0.0)) for s, m in (("s1", "m1"), ("s2", "m2")))
    new_sums = own.select("kb_id", "s0", s1.alias("s1"), s2.alias("s2"))
    zero = F.lit(0.0)
    old_sums = index.sums.join(moves, "kb_id", "left").select(
        "kb_id", "n_terms", "has_vector", "s0",
        (F.col("s1") + F.coalesce("d1", zero)).alias("s1"),
        (F.col("s2") + F.coalesce("d2", zero)).alias("s2"),
    )
    version = Index(spark, path, (*index.segments, segment), index.n + n, index.n_postings + n_postings, n_vectors, dimension)
    return _finish(version, moved, old_sums.unionByName(_of_all(segment, counts, new_sums)))


def _moves(index: Index, known: DataFrame, before: str) -> DataFrame:
    """kb_id, d1 and d2: by how much an article's s1 and s2 change where the df of its ``known`` terms was ``before`` and is now df."""
    g, h = F.log(F.lit(1.0) + F.col("df")), F.log(F.lit(1.0) + F.col(before))
    square = (F.col("tf") * F.col("tf")).cast("double")
    steps = known.select("code", (g - h).alias("d1"), (g * g - h * h).alias("d2"))
    met = index.met("postings", POSTINGS, steps)
    return met.groupBy("kb_id").agg(F.sum(square * F.col("d1")).alias("d1"), F.sum(square * F.col("d2")).alias("d2"))


def open_index(spark: SparkSession, path: str) -> Index:
    """A version written earlier."""
    row = spark.read.parquet(f"{path}/about").first()
    segments = tuple(Segment(s.path, s.bits) for s in row.segments)
    return Index(spark, path, segments, row.n, row.n_postings, row.n_vectors, row.dimension)


def publish_index(index: Index, head: str) -> None:
    """Makes a version the current one below ``head``, a folder of which each row names a version."""
    spark = index.spark
    schema = "number long, path string"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(head)
    known = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop)
    last = spark.read.schema(schema).parquet(head).agg(F.max("number")).first()[0] if known else None
    row = [((last or 0) + 1, index.path)]
    spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(head)


def current_index(spark: SparkSession, head: str) -> Index:
    """The version that was published last."""
    row = spark.read.schema("number long, path string").parquet(head).orderBy(F.desc("number"), "path").first()
    return open_index(spark, row.path)


def check_unique(rows: DataFrame, key: str) -> None:
    """Raises if a key is null or two rows have the same one, and names some of these keys."""
    wrong = (F.col("n") > 1) | F.col(key).isNull()
    again = [r[0] for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(wrong).limit(5).collect()]
    if None in again:
        raise ValueError(f"{key} must not be null")
    if again:
        raise ValueError(f"{key} must be unique; repeated: {sorted(again)}")


def _open_segment(spark: SparkSession, path: str) -> tuple[Segment, DataFrame, int, int]:
    """The segment whose counts have been written below ``path``: itself, its counts, articles and postings."""
    counts = spark.read.schema(COUNTS).parquet(f"{path}/segment/counts")
    n, n_postings = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    return Segment(f"{path}/segment", (n_postings // SHARD_POSTINGS).bit_length()), counts, n, n_postings


def _shard(bits: int) -> Column:
    return F.shiftrightunsigned("code", 64 - bits).cast("int") if bits else F.lit(0)


def _slice_bits(n_postings: int) -> int:
    """Slices have at most about ``PARTITION_ROWS`` postings; there are more of them where that makes few."""
    bits = (n_postings // PARTITION_ROWS).bit_length()
    return bits + 1 if 0 < bits < 4 else bits


def _write_terms(counts: DataFrame, segment: Segment, moved: dict[str, int], n_postings: int) -> bool:
    """Whether terms share a code. The table has all terms either way."""
    path = f"{segment.path}/terms"
    _write_shards(segment_terms(counts, segment.bits, moved, _slice_bits(n_postings)), path)
    if not counts.sparkSession.read.schema("clash boolean").parquet(path).where("clash").limit(1).count():
        return False
    rows = document_frequencies(counts).select(unique_code(F.col("term"), moved).alias("code"), "term", "df")
    rows = rows.withColumn("shard", _shard(segment.bits)).repartition("shard", F.shiftrightunsigned("code", 64 - max(8, segment.bits + 2)))
    _write_shards(rows.sortWithinPartitions("code"), path)
    return True


def _write_postings(counts: DataFrame, segment: Segment, moved: dict[str, int], n_postings: int) -> None:
    """Slices of codes, and for heavy terms ranges of code and article: such a term fills as many tasks and files as it needs."""
    spark, path = counts.sparkSession, f"{segment.path}/postings"
    terms = spark.read.schema(TERMS).parquet(f"{segment.path}/terms").where(F.col("df") >= HEAVY).select("code", "df")
    heavy = terms.where(F.col("df") >= max(HEAVY, frequent_from(terms, n_postings)))
    codes = sorted(row.code for row in heavy.select("code").collect())
    _write_shards(segment_postings(counts, segment.bits, moved, _slice_bits(n_postings), codes), path)
    if codes:
        rows = coded(counts, moved).join(F.broadcast(heavy), "code").select("code", "kb_id", "tf", "df").withColumn("shard", _shard(segment.bits))
        _write_shards(rows.repartitionByRange("shard", "code", "kb_id").sortWithinPartitions("code"), path, "append")


def _write_shards(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes a folder a shard and keeps the order of the rows, which start with their code.

    A sort by shard first would compare whole rows, as nearly all of a task lie in one or two shards. A task keeps the files of
    its few shards open instead.
    """
    with setting(rows.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_SHARDS)):
        rows.write.mode(mode).options(**PACKED).partitionBy("shard").parquet(path)


def _dimension(vectors: DataFrame | None) -> int | None:
    if vectors is None:
        return None
    first = vectors.where("embedding is not null").select(F.size("embedding")).first()
    return first[0] if first else None


def _write_vectors(spark: SparkSession, vectors: DataFrame | None, dimension: int | None, segment: Segment) -> int:
    if vectors is None or dimension is None:
        rows = spark.createDataFrame([], VECTORS)
    else:
        # only vectors of the segment's articles count
        known = spark.read.schema(COUNTS).parquet(f"{segment.path}/counts").select(F.col("kb_id").cast("long").alias("kb_id"))
        given = vectors.where("embedding is not null").select(
            F.col("kb_id").cast("long").alias("kb_id"), checked_vector(F.col("embedding").cast("array<float>"), dimension).alias("embedding")
        )
        rows = given.join(known, "kb_id", "left_semi").select("kb_id", "embedding", l2_norm(F.col("embedding")).alias("length"))
    rows.write.parquet(f"{segment.path}/vectors")
    return spark.read.schema(VECTORS).parquet(f"{segment.path}/vectors").count()


def few_codes(terms: DataFrame) -> list[int] | None:
    """The codes of a few terms; None for many."""
    rows = terms.select("code").distinct().limit(SHARDED_CODES + 1).toArrow()["code"].to_pylist()
    return None if len(rows) > SHARDED_CODES else sorted(rows)


def _held_terms(index: Index, added: DataFrame) -> DataFrame:
    """code, term and df of the terms in the index that have a code of ``added``."""
    rows = index.met("terms", TERMS, added.select("code"), "left_semi")
    return written(rows.groupBy("code", "term").agg(F.sum("df").alias("df")), "held-terms")


def _clashes(held: DataFrame, added: DataFrame, shares: bool) -> list[str]:
    """New terms that share a code with another term, ``held`` or new; new ones with each other only if ``shares``."""
    old = held.select("code", F.col("term").alias("other"))
    met = {row.term for row in added.join(old, "code").where("term != other").select("term").distinct().collect()}
    listed = {term for _, term in shared_codes(added)} if shares else set()
    if listed:  # a term that the index has keeps its code
        listed -= {row.other for row in old.where(F.col("other").isin(sorted(listed))).collect()}
    return sorted(met | listed)


def _of_all(segment: Segment, counts: DataFrame, sums: DataFrame) -> DataFrame:
    """All articles of a segment with their sums, zero for those without terms."""
    held = counts.sparkSession.read.schema(VECTORS).parquet(f"{segment.path}/vectors").select("kb_id", F.lit(True).alias("held"))
    zero = F.lit(0.0)
    return counts.select("kb_id", "n_terms").join(held, "kb_id", "left").join(sums, "kb_id", "left").select(
        "kb_id", "n_terms", F.col("held").isNotNull().alias("has_vector"), *(F.coalesce(c, zero).alias(c) for c in ("s0", "s1", "s2"))
    )


def _finish(index: Index, moved: dict[str, int], sums: DataFrame) -> Index:
    spark = index.spark
    sums.write.parquet(f"{index.path}/sums")
    spark.createDataFrame(list(moved.items()), CODES).coalesce(1).write.parquet(f"{index.path}/codes")
    segments = [(segment.path, segment.bits) for segment in index.segments]
    spark.createDataFrame(
        [(segments, index.n, index.n_postings, index.n_vectors, index.dimension)],
        "segments array<struct<path:string,bits:int>>, n long, n_postings long, n_vectors long, dimension int",
    ).coalesce(1).write.parquet(f"{index.path}/about")
    return index

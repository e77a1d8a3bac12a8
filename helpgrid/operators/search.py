"""Hybrid top-k search of a whole table of queries against an index.

Keyword scores come from a join: the terms of a pass of queries are broadcast to the postings of these terms, and the
products are summed by query and article. Semantic scores of all articles are computed by tasks over the vectors, which
return ranges and each query's best articles, never all pairs. Scores are scaled by the range over **all** articles; an
article without a common term, or without a vector, has a score of zero that is implied and takes part in the range.

The best k by the fused score are among few candidates. Without looking at keywords, the best by semantic score are
(any article above one of them has a higher semantic score, and keywords only add), so the tasks over the
vectors need not know who shares a term. Of the articles that do, those stay whose keyword score and the best semantic
score there is reach the threshold: the k-th best of all lower bounds known by then. Only for them the semantic score is looked up.

Pairs that share a term grow with the product of queries and articles. Beyond ``LISTED_PAIRS`` they are neither shuffled nor
written: tasks hold whole articles, with their postings of the pass's terms and their vectors, and return ranges first and
then, with the scaling known, each query's best articles by the fused score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helpgrid.functions.text import with_term_counts
from helpgrid.operators import scoring
from helpgrid.operators.index import Index, check_unique, few_codes, smoothed_idf
from helpgrid.session import BROADCAST_BYTES, partitions_for, ship_package, small, written

# Queries are broadcast in passes of at most this many bytes.
PASS_BYTES = 64 << 20
# Pairs whose vectors one task multiplies.
PAIRS = 1 << 14
# Up to this many (query, article) pairs of a pass, a search lists those that share a term.
LISTED_PAIRS = 1 << 24
# Postings that a task holds to score its articles, about.
POSTINGS_PER_TASK = 1 << 22
# From this many files of vectors on, a first part of them gives the floors for the others.
FLOOR_FILES = 64

RANGES = (
    "query_id long, sem_min double, sem_max double, kw_min double, kw_max double, n_matched long"
)
CANDIDATES = "query_id long, alpha double, kb_id long, rank_key long, semantic double"
FUSED = f"{CANDIDATES}, keyword double"
BEST = "query_id long, kb_id long, has_vector boolean, keyword double, low double, pairs long"
HITS = (
    "query_id long, alpha double, rank int, kb_id long, semantic_score double, keyword_score double, hybrid_score double"
)


# The codes of a pass unless these are many, and query_id, code and weight times idf, written.
PassTerms = tuple[list[int] | None, DataFrame]


# --- keyword scores ---------------------------------------------------------------------------


def query_terms(index: Index, queries: DataFrame, stop_words=None) -> tuple[DataFrame, list[int] | None]:
    """The terms of the queries (query_id, term, tf, code), and their codes unless these are many."""
    counted = with_term_counts(queries.select("query_id", "text"), "text", stop_words)
    rows = (
        counted.select("query_id", F.inline(F.arrays_zip("terms", "counts")))
        .select("query_id", F.col("terms").alias("term"), F.col("counts").alias("tf"))
        .withColumn("code", index.code(F.col("term")))
    )
    terms = written(rows, "query-terms")
    return terms, few_codes(terms)


def query_weights(index: Index, queries: DataFrame, stop_words=None) -> DataFrame:
    """tf-idf weights of the queries: query_id, term, tf, idf, weight.

    Terms that the index does not know are dropped before the length is taken. A query without a
    known term has no rows.
    """
    return _weights(index, *query_terms(index, queries, stop_words)).drop("code")


def _weights(index: Index, terms: DataFrame, codes: list[int] | None) -> DataFrame:
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 48), F.lit(0))).first()[0]
    known = index.frequencies(codes).select("code", "term", smoothed_idf(F.col("df"), index.n).alias("idf"))
    rows = known.join(F.broadcast(terms) if size <= PASS_BYTES else terms, ["code", "term"])
    raw = F.col("tf") * F.col("idf")
    length = F.sqrt(F.sum(raw * raw).over(Window.partitionBy("query_id")))
    return rows.select("query_id", "code", "term", "tf", "idf", (raw / length).alias("weight"))


def _pass_weights(index: Index, queries: DataFrame) -> PassTerms:
    terms, codes = query_terms(index, queries)
    weights = _weights(index, terms, codes).select("query_id", "code", (F.col("weight") * F.col("idf")).alias("weight"))
    return codes, written(weights, "query-weights")


def keyword_pairs(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, kb_id, has_vector and keyword (the cosine) of every query and article that share a term.

    ``queries`` are one pass. The postings of a term lie in as many files as they need, and their products are summed by
    query and article, so a term of a third of all articles makes no large task.
    """
    codes, weights = _pass_weights(index, queries)
    products = (
        index.postings(codes)
        .join(F.broadcast(weights), "code")
        .select("query_id", "kb_id", (F.col("tf") * F.col("weight")).alias("part"))
    )
    norms = index.norms.select("kb_id", "has_vector", "norm")
    if index.n * 32 <= BROADCAST_BYTES:
        norms = F.broadcast(norms)
    else:  # summed and joined by article, with one shuffle for both
        products = products.repartition("kb_id")
    cosine = F.round(F.col("dot") / F.col("norm"), scoring.SCORE_DECIMALS)
    return (
        products.groupBy("query_id", "kb_id")
        .agg(F.sum("part").alias("dot"))
        .join(norms, "kb_id")
        .select("query_id", "kb_id", "has_vector", cosine.alias("keyword"))
    )


def _shared_weights(weights: DataFrame, ids: np.ndarray | None = None) -> scoring.QueryWeights:
    """The weights of a pass for its tasks: of the queries that have some, or of all ``ids`` (sorted)."""
    table = weights.toArrow().sort_by([("query_id", "ascending"), ("code", "ascending")])
    query = table["query_id"].to_numpy()
    ids = np.unique(query) if ids is None else ids
    return scoring.QueryWeights(ids, np.searchsorted(ids, query), table["code"].to_numpy(), table["weight"].to_numpy())


def _whole_articles(index: Index, terms: PassTerms, vectors: bool = False) -> DataFrame:
    """The postings of a pass's terms, a row for each article's norm and, if wanted, one for its vector, dealt by article."""
    codes, weights = terms
    met = index.postings(codes).join(F.broadcast(weights.select("code").distinct()), "code", "left_semi")
    unknown, none = F.lit(None), F.lit(0)
    norm, has_vector = unknown.cast("double").alias("norm"), unknown.cast("boolean").alias("has_vector")
    rows = met.select("kb_id", "code", "tf", norm, has_vector)
    code, tf = none.cast("long").alias("code"), none.alias("tf")
    rows = rows.unionByName(index.norms.select("kb_id", code, tf, "norm", "has_vector"))
    size = index.n_postings
    if vectors:  # empty arrays for the others: a batch with null ones takes time quadratic in its rows to hand over
        dense = index.vectors.select("kb_id", code, tf, norm, has_vector, "embedding")
        rows = rows.withColumn("embedding", F.array().cast("array<float>")).unionByName(dense)
        size += index.n_vectors * (index.dimension or 0)
    tasks = max(index.spark.sparkContext.defaultParallelism, size // POSTINGS_PER_TASK + 1)
    return rows.repartition(tasks, "kb_id")


def best_keyword_pairs(index: Index, terms: PassTerms, top_k: int) -> DataFrame:
    """What ``keyword_pairs`` has that a search by keywords alone needs: the best ``top_k`` pairs of every query, and its range.

    The postings of the pass's terms are dealt by article, with each article's norm, and the products of an article are summed inside
    its task, so the pairs are neither shuffled nor written. Rows are as in ``scoring.best_by_keywords``; some more
    pairs than the best may come. ``terms`` are those of one pass, whose weights every task gets.
    """
    shared = index.spark.sparkContext.broadcast(_shared_weights(terms[1]))

    def task(batches):
        yield from scoring.best_by_keywords(batches, shared.value, top_k)

    return _whole_articles(index, terms).mapInArrow(task, BEST)


def keyword_spans(index: Index, terms: PassTerms) -> DataFrame:
    """query_id, kw_min, kw_max, n_pairs and n_matched of the pairs that ``keyword_pairs`` has, summed inside tasks as well."""
    shared = index.spark.sparkContext.broadcast(_shared_weights(terms[1]))

    def task(batches):
        yield from scoring.keyword_ranges(batches, shared.value)

    found = _whole_articles(index, terms).mapInArrow(task, "query_id long, kw_min double, kw_max double, n_pairs long")
    spans = found.groupBy("query_id").agg(F.min("kw_min").alias("kw_min"), F.max("kw_max").alias("kw_max"), F.sum("n_pairs").alias("n_pairs"))
    return spans.withColumn("n_matched", F.col("n_pairs"))


# --- passes of queries ------------------------------------------------------------------------


def pass_count(queries: DataFrame, index: Index, limit: int = PASS_BYTES) -> int:
    """How many passes keep every broadcast within ``limit`` bytes, by measuring each. Refuses repeated ids.

    A query that alone is larger than the limit raises it to twice its own size.
    """
    vector = 8 * (index.dimension or 0)
    # a text yields at most its words, as many bigrams of twice the length, and their numbers
    size = F.octet_length(F.coalesce("text", F.lit(""))) * 8 + vector + 32
    sizes = queries.groupBy("query_id").agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("rows"))
    total, longest, rows = sizes.agg(
        F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0)), F.max(F.when(F.col("query_id").isNull(), 2).otherwise(F.col("rows")))
    ).first()
    if (rows or 1) > 1:
        check_unique(queries, "query_id")
    passes = 1
    while total > max(limit, 2 * longest):
        largest = sizes.groupBy(_pass_of(passes).alias("pass")).agg(F.sum("size").alias("bytes")).agg(F.max("bytes")).first()[0]
        if largest <= max(limit, 2 * longest):
            break
        passes = max(passes + 1, -(-passes * largest // limit))
    return passes


def _pass_of(passes: int):
    return F.pmod(F.xxhash64("query_id"), F.lit(passes))


@dataclass
class Pass:
    """One pass of queries: all of them, those with a vector as blocks, and the pairs that share a term, if wanted.

    ``spans`` has the ranges of the keyword scores where ``pairs`` are the best ones only, or where there are too many to list:
    then ``terms`` are those of the pass, for tasks that score whole articles.
    """

    queries: DataFrame
    blocks: list[scoring.QueryBlock]
    pairs: DataFrame | None
    spans: DataFrame | None = None
    terms: PassTerms | None = None


def _blocks(index: Index, queries: DataFrame) -> list[scoring.QueryBlock]:
    """The query vectors, whose bytes ``pass_count`` has checked, as unit vectors. None without vectors on both sides."""
    if index.dimension is None or "embedding" not in queries.columns:
        return []
    table = queries.select("query_id", F.col("embedding").cast("array<double>")).where("embedding IS NOT NULL").toArrow()
    table = table.sort_by("query_id").combine_chunks()
    dense = np.zeros((table.num_rows, index.dimension))
    for row, vector in enumerate(table["embedding"]):
        if len(vector) != index.dimension:
            raise ValueError(f"expected a query vector of {index.dimension} numbers, found {len(vector)}")
        dense[row] = vector.values.to_numpy()
    return scoring.blocks_of(table["query_id"].to_numpy(), scoring.unit_rows(dense))


def _passes(index: Index, queries: DataFrame, limit: int, kinds: str, best: int | None = None) -> Iterator[Pass]:
    """``kinds``: k for keyword scores, s for semantic ones. ``best``: how many pairs of a query are enough, unless all are needed."""
    passes = pass_count(queries, index, limit)
    for number in range(passes):
        part = queries if passes == 1 else queries.where(_pass_of(passes) == number)
        blocks = _blocks(index, part) if "s" in kinds else []
        most = part.count() * index.n if "k" in kinds else 0
        if most > LISTED_PAIRS:
            terms = _pass_weights(index, part)
            if best is None:
                yield Pass(part, blocks, None, keyword_spans(index, terms), terms)
                continue
            found = written(best_keyword_pairs(index, terms, best), "pairs")
            spans = found.groupBy("query_id").agg(
                F.min("low").alias("kw_min"), F.max("keyword").alias("kw_max"), F.sum("pairs").alias("n_pairs")
            )
            pairs = found.where("kb_id IS NOT NULL").select("query_id", "kb_id", "has_vector", "keyword")
            yield Pass(part, blocks, pairs, spans.withColumns({"kw_max": F.coalesce("kw_max", F.lit(0.0)), "n_matched": F.col("n_pairs")}))
            continue
        with partitions_for(index.spark, most):
            pairs = written(keyword_pairs(index, part), "pairs") if "k" in kinds else None
        yield Pass(part, blocks, pairs)


def _gather(parts: Iterator[DataFrame], spark, schema: str) -> DataFrame:
    """The union of the passes."""
    empty = spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts, empty)


# --- ranges -----------------------------------------------------------------------------------


def _implied(name: str, function, known: Column) -> Column:
    """The range's end, with the zero of articles that are not listed."""
    return F.when(known, F.coalesce(F.col(name), F.lit(0.0))).otherwise(function(F.coalesce(F.col(name), F.lit(0.0)), F.lit(0.0)))


def _ranges(index: Index, one: Pass) -> DataFrame:
    spark = index.spark
    found = one.queries.select("query_id")
    if one.blocks:
        shared = spark.sparkContext.broadcast(one.blocks)

        def task(batches):
            yield from scoring.score_ranges(batches, shared.value)

        dense = index.vectors.select("kb_id", "embedding").mapInArrow(task, "query_id long, sem_min double, sem_max double")
        dense = dense.groupBy("query_id").agg(F.min("sem_min").alias("sem_min"), F.max("sem_max").alias("sem_max"))
        found = found.join(dense, "query_id", "left")
    else:
        found = found.select("query_id", F.lit(0.0).alias("sem_min"), F.lit(0.0).alias("sem_max"))
    if one.spans is not None:
        found = found.join(one.spans, "query_id", "left")
    elif one.pairs is not None:
        sparse = one.pairs.groupBy("query_id").agg(
            F.min("keyword").alias("kw_min"), F.max("keyword").alias("kw_max"), F.count_if(F.col("keyword") > 0).alias("n_matched"), F.count(F.lit(1)).alias("n_pairs")
        )
        found = found.join(sparse, "query_id", "left")
    else:
        zero = F.lit(0.0)
        found = found.withColumns({"kw_min": zero, "kw_max": zero, "n_matched": F.lit(0), "n_pairs": F.lit(0)})
    all_vectors, all_pairs = F.lit(index.n_vectors == index.n), F.coalesce("n_pairs", F.lit(0)) == index.n
    return found.select(
        "query_id",
        _implied("sem_min", F.least, all_vectors).alias("sem_min"),
        _implied("sem_max", F.greatest, all_vectors).alias("sem_max"),
        _implied("kw_min", F.least, all_pairs).alias("kw_min"),
        _implied("kw_max", F.greatest, all_pairs).alias("kw_max"),
        F.coalesce("n_matched", F.lit(0)).cast("long").alias("n_matched"),
    )


def score_ranges(index: Index, queries: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Per query: least and greatest raw score of each kind over all articles, and ``n_matched``,
    the number of articles that share a term with the query. Without articles there are no ranges."""
    ship_package(index.spark)
    if index.n == 0:
        return index.spark.createDataFrame([], RANGES)
    parts = (_ranges(index, one) for one in _passes(index, queries, pass_bytes, "ks"))
    return _gather(parts, index.spark, RANGES)


# --- ranking ----------------------------------------------------------------------------------


def _scaling(index: Index, one: Pass, scaled: bool) -> DataFrame:
    """Per query: what to subtract from and divide by, and the least and greatest scaled semantic score."""
    if not scaled:
        return one.queries.select(
            "query_id", *(F.lit(x).alias(c) for c, x in zip(("sem_low", "sem_width", "kw_low", "kw_width"), (0.0, 1.0, 0.0, 1.0))),
            F.lit(-1.0 if one.blocks else 0.0).alias("sem_least"), F.lit(1.0 if one.blocks else 0.0).alias("sem_most"),
        )
    found = _ranges(index, one)

    def ends(kind: str):
        low, high = F.col(f"{kind}_min"), F.col(f"{kind}_max")
        return F.when(high > low, low).otherwise(0.0), F.when(high > low, high - low).otherwise(1.0)

    (sem_low, sem_width), (kw_low, kw_width) = ends("sem"), ends("kw")
    return found.select(
        "query_id", sem_low.alias("sem_low"), sem_width.alias("sem_width"), kw_low.alias("kw_low"), kw_width.alias("kw_width"),
        ((F.col("sem_min") - sem_low) / sem_width).alias("sem_least"), ((F.col("sem_max") - sem_low) / sem_width).alias("sem_most"),
    )


def _fused(alpha, semantic: Column, keyword: Column) -> Column:
    """The hybrid score of raw scores, for a row that has the query's scaling."""
    return alpha * ((semantic - F.col("sem_low")) / F.col("sem_width")) + (1.0 - alpha) * (
        (keyword - F.col("kw_low")) / F.col("kw_width")
    )


def _scales(one: Pass, rows: dict, alphas: list[float], floors: dict) -> list[scoring.Scales]:
    out = []
    for block in one.blocks:
        mine = [rows[int(i)] for i in block.ids]
        least = np.iinfo(np.int64).min
        out.append(
            scoring.Scales(
                np.array([r.sem_low for r in mine]),
                np.array([r.sem_width for r in mine]),
                np.array([-r.kw_low / r.kw_width for r in mine]),
                np.array([[floors.get((int(i), alpha), least) for i in block.ids] for alpha in alphas]),
            )
        )
    return out


def _best_by_vector(index: Index, one: Pass, rows: dict, alphas: list[float], top_k: int) -> DataFrame:
    """query_id, alpha, kb_id, rank_key, semantic: the best ``top_k`` articles with a vector, keywords left aside.

    With many files a first part of them, about the root of their number, is searched before the others; nothing
    below its k-th best needs to leave a task after that.
    """
    spark = index.spark
    order = Window.partitionBy("query_id", "alpha").orderBy(F.desc("rank_key"), "kb_id")

    def search(vectors: DataFrame, floors: dict) -> DataFrame:
        shared = spark.sparkContext.broadcast((one.blocks, _scales(one, rows, alphas, floors)))

        def task(batches):
            yield from scoring.best_articles(batches, *shared.value, alphas, top_k)

        found = vectors.select("kb_id", "embedding").mapInArrow(task, CANDIDATES)
        best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k)
        return written(best, "best")

    vectors = index.vectors
    files = sorted(vectors.inputFiles())
    if len(files) < FLOOR_FILES:
        return search(vectors, {}).drop("place")
    step = math.isqrt(len(files))
    read = spark.read.schema(vectors.schema)
    first = search(read.parquet(*files[::step]), {})
    floors = {(r.query_id, r.alpha): r.rank_key for r in first.where(F.col("place") == top_k).collect()}
    rest = search(read.parquet(*(f for i, f in enumerate(files) if i % step)), floors)
    return first.unionByName(rest).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k).drop("place")


def _lowest(index: Index, top_k: int, bare: bool) -> list[int]:
    """The lowest ids of all articles, or of those without a vector."""
    rows = index.sums.where("NOT has_vector") if bare else index.sums
    return [r.kb_id for r in rows.orderBy("kb_id").select("kb_id").limit(top_k).collect()]


def _ranked(index: Index, one: Pass, alphas: list[float], top_k: int, scaled: bool, kinds: str) -> DataFrame:
    scaling = written(_scaling(index, one, scaled), "scaling")
    per_query = F.broadcast(scaling)  # a few numbers for each query of the pass
    rows = {r.query_id: r for r in scaling.collect()}
    if one.terms is not None:
        every = _best_fused(index, one, rows, alphas, top_k).join(per_query, "query_id")
    else:
        scored = _candidates(index, one, scaling, rows, alphas, top_k)
        every = scored.join(per_query, "query_id").withColumn("alpha", F.explode(F.lit(alphas).cast("array<double>")))
    hybrid = every.withColumn("hybrid_score", _fused(F.col("alpha"), F.col("semantic"), F.col("keyword")))
    order = Window.partitionBy("query_id", "alpha").orderBy(F.desc(_rank_key(F.col("hybrid_score"))), "kb_id")
    unknown = F.lit(None).cast("double")
    semantic = (F.col("semantic") - F.col("sem_low")) / F.col("sem_width")
    keyword = (F.col("keyword") - F.col("kw_low")) / F.col("kw_width")
    return (
        hybrid.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_k)
        .select(
            "query_id", "alpha", "rank", "kb_id",
            (semantic if "s" in kinds else unknown).alias("semantic_score"),
            (keyword if "k" in kinds else unknown).alias("keyword_score"),
            "hybrid_score",
        )
    )


def _best_fused(index: Index, one: Pass, rows: dict, alphas: list[float], top_k: int) -> DataFrame:
    """query_id, alpha, kb_id, rank_key, semantic, keyword: the best ``top_k`` articles.

    Tasks hold whole articles, with the postings of the pass's terms and the vector, and score them with every query, so that neither
    pairs nor candidates leave them.
    """
    spark = index.spark
    ids = np.array(sorted(rows), dtype=np.int64)
    vectors = np.zeros((len(ids), index.dimension if one.blocks else 0))
    for block in one.blocks:
        vectors[np.searchsorted(ids, block.ids)] = block.dense
    numbers = (np.array([rows[int(i)][c] for i in ids]) for c in ("sem_low", "sem_width", "kw_low", "kw_width"))
    shared = spark.sparkContext.broadcast((_shared_weights(one.terms[1], ids), scoring.Fusion(vectors, *numbers)))

    def task(batches):
        yield from scoring.best_fused(batches, *shared.value, alphas, top_k)

    found = _whole_articles(index, one.terms, vectors=bool(one.blocks)).mapInArrow(task, FUSED)
    order = Window.partitionBy("query_id", "alpha").orderBy(F.desc("rank_key"), "kb_id")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k)
    return written(best.drop("place"), "best")


def _candidates(index: Index, one: Pass, scaling: DataFrame, rows: dict, alphas: list[float], top_k: int) -> DataFrame:
    """query_id, kb_id, semantic, keyword: pairs that hold the best ``top_k`` of every alpha."""
    spark = index.spark
    per_query = F.broadcast(scaling)
    unknown = F.lit(None).cast("double")

    # candidates whose keyword score is taken for zero
    dense = [alpha for alpha in alphas if alpha > 0] if one.blocks else []
    listed = []
    if dense:
        found = _best_by_vector(index, one, rows, dense, top_k)
        listed.append(found.select("query_id", "kb_id", "semantic"))
        if index.n_vectors < index.n:
            ids = _lowest(index, top_k, bare=True)
            listed.append(scaling.select("query_id", F.explode(F.lit(ids).cast("array<long>")).alias("kb_id"), F.lit(0.0).alias("semantic")))
    # articles that tie at zero: those of queries without a vector, or where the vector does not count
    ids = F.lit(_lowest(index, top_k, bare=False)).cast("array<long>")
    same = F.lit(0.0) if not one.blocks else unknown
    if len(dense) < len(alphas):
        listed.append(scaling.select("query_id", F.explode(ids).alias("kb_id"), same.alias("semantic")))
    elif one.blocks:
        held = [int(i) for block in one.blocks for i in block.ids]
        without = scaling.join(F.broadcast(spark.createDataFrame([(i,) for i in held], "query_id long")), "query_id", "left_anti")
        listed.append(without.select("query_id", F.explode(ids).alias("kb_id"), F.lit(0.0).alias("semantic")))
    zero = reduce(DataFrame.unionByName, listed).groupBy("query_id", "kb_id").agg(F.max("semantic").alias("semantic"))
    zero = written(zero, "candidates")

    candidates = zero.withColumn("keyword", unknown)
    if one.pairs is not None:
        candidates = candidates.unionByName(_with_keywords(one, per_query, zero, alphas, top_k))
    candidates = candidates.groupBy("query_id", "kb_id").agg(F.max("semantic").alias("semantic"), F.max("keyword").alias("keyword"))
    candidates = candidates.withColumn("keyword", F.coalesce("keyword", F.lit(0.0)))
    return _with_semantic(index, one, written(candidates, "candidates")) if one.blocks else candidates


def _rank_key(hybrid: Column) -> Column:
    return F.rint(hybrid * scoring.RANK_SCALE)


def _with_keywords(one: Pass, per_query: DataFrame, zero: DataFrame, alphas: list[float], top_k: int) -> DataFrame:
    """query_id, kb_id, semantic (null if not known), keyword: the pairs that may be among the best, and the candidates so far."""
    semantic = F.when(~F.col("has_vector"), F.lit(0.0)) if one.blocks else F.lit(0.0)
    pairs = one.pairs.withColumn("semantic", semantic).drop("has_vector")
    best = Window.partitionBy("query_id").orderBy(F.desc(_rank_key((F.col("keyword") - F.col("kw_low")) / F.col("kw_width"))), "kb_id")
    top = pairs.join(per_query.select("query_id", "kw_low", "kw_width"), "query_id").withColumn("place", F.row_number().over(best))
    top = top.where(F.col("place") <= top_k).select("query_id", "kb_id", "semantic", "keyword")
    if max(alphas) == 0:  # by keywords alone: these are the best, if they are better than nothing at all
        return top
    top = written(top, "top")
    listed = small(zero.select("query_id", "kb_id"))
    mixed = [alpha for alpha in alphas if 0 < alpha < 1]
    if not mixed:
        return top.unionByName(pairs.join(listed, ["query_id", "kb_id"])).distinct()

    # lower bounds: a semantic score that is not known yet is at least the least one, a keyword score at least zero
    known = zero.withColumn("keyword", F.lit(0.0)).unionByName(top).join(per_query, "query_id")
    least = F.coalesce("semantic", F.col("sem_least") * F.col("sem_width") + F.col("sem_low"))
    bounds = (
        known.select("*", F.explode(F.lit(mixed).cast("array<double>")).alias("alpha"))
        .groupBy("query_id", "alpha", "kb_id")
        .agg(F.max(_fused(F.col("alpha"), least, F.col("keyword"))).alias("bound"))
    )
    order = Window.partitionBy("query_id", "alpha").orderBy(F.desc("bound"))
    kth = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") == top_k)
    thresholds = kth.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("alpha", (F.col("bound") - 2 / scoring.RANK_SCALE).alias("least")))).alias("thresholds")
    )
    plan = per_query.join(written(thresholds, "thresholds"), "query_id", "left")  # both have a row a query of the pass
    most = F.coalesce("semantic", F.col("sem_most") * F.col("sem_width") + F.col("sem_low"))
    reaches = F.coalesce(F.size("thresholds"), F.lit(0)) < len(mixed)
    for number in range(len(mixed)):
        t = F.get("thresholds", F.lit(number))
        reaches = reaches | (_fused(t.alpha, most, F.col("keyword")) >= t.least)
    rows = pairs.join(F.broadcast(plan), "query_id").where(reaches).select("query_id", "kb_id", "semantic", "keyword")
    return rows.unionByName(top).unionByName(pairs.join(listed, ["query_id", "kb_id"])).distinct()


def _with_semantic(index: Index, one: Pass, candidates: DataFrame) -> DataFrame:
    """The candidates with their semantic score looked up where it is missing."""
    asked = one.queries.where("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("wanted"))
    missing = candidates.where("semantic IS NULL").drop("semantic")
    missing = missing.repartition(1 + missing.count() // PAIRS, "kb_id")
    vectors = index.vectors
    if index.n_vectors * (4 * index.dimension + 64) <= BROADCAST_BYTES:
        vectors = F.broadcast(vectors)
    met = missing.join(vectors, "kb_id", "left").join(F.broadcast(asked), "query_id", "left")  # the vectors of one pass
    product = F.aggregate(F.zip_with("wanted", "embedding", lambda a, b: a * b.cast("double")), F.lit(0.0), lambda x, y: x + y)
    size = F.sqrt(F.aggregate("wanted", F.lit(0.0), lambda x, y: x + y * y)) * F.col("length")
    cosine = F.when(size > 0, F.round(product / size, scoring.SCORE_DECIMALS)).otherwise(0.0)
    known = met.select("query_id", "kb_id", cosine.alias("semantic"), "keyword")
    return candidates.where("semantic IS NOT NULL").unionByName(known)


def sweep(
    index: Index,
    queries: DataFrame,
    top_k: int = 5,
    alphas: Sequence[float] = (0.5,),
    scaled: bool = True,
    used_only: bool = False,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """The ``top_k`` articles of every query for each alpha, scoring the articles once for all.

    ``queries`` has query_id (unique), text and, for semantic scores, embedding; it is read a few
    times. Both scores are scaled to 0..1 per query over all articles, zeros included, unless all
    are equal; ``scaled=False`` keeps the raw cosines. ``used_only`` leaves a score that no alpha
    weighs uncomputed and null. Returns query_id, alpha, rank, kb_id, semantic_score,
    keyword_score and hybrid_score. Ties of the score, to nine decimals, go to the lower kb_id; where fewer
    than ``top_k`` articles score above zero, the lowest ids follow.
    """
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    alphas = [float(alpha) for alpha in alphas]
    if any(not 0.0 <= alpha <= 1.0 for alpha in alphas):
        raise ValueError("alpha must lie between 0 and 1")
    spark = index.spark
    ship_package(spark)
    kinds = "ks"
    if used_only:
        kinds = ("k" if min(alphas) < 1 else "") + ("s" if max(alphas) > 0 else "")
    if top_k == 0 or index.n == 0:
        return spark.createDataFrame([], HITS)
    best = top_k if max(alphas, default=1.0) == 0 else None  # by keywords alone
    parts = (_ranked(index, one, alphas, top_k, scaled, kinds) for one in _passes(index, queries, pass_bytes, kinds, best))
    return _gather(parts, spark, HITS)


def retrieve(
    index: Index, queries: DataFrame, top_k: int = 5, alpha: float = 0.5, **options
) -> DataFrame:
    """``sweep`` for a single alpha: query_id, rank, kb_id and the three scores."""
    return sweep(index, queries, top_k, (alpha,), **options).drop("alpha")


def with_articles(hits: DataFrame, articles: DataFrame) -> DataFrame:
    """Adds the article's columns to each hit, after the ranking has thrown away all others.

    The hits are written and counted: as long as they are within ``BROADCAST_BYTES`` they go to the articles, which
    stay in place. Beyond, the join shuffles both.
    """
    return articles.join(small(written(hits, "hits")), "kb_id")

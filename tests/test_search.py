from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from brute import Brute, make_articles, make_vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpgrid.operators import index as I
from helpgrid.operators import scoring
from helpgrid.operators import search as S
from helpgrid.operators.index import build_index

ARTICLE_COLUMNS = (
    "kb_id long, category string, subcategory string, journey_stage string, "
    "issue_description string, resolution_steps string"
)
QUERIES = [
    (0, "My refund has not reached my bank", [1.0, 0, 2, 0, -1, 0]),
    (1, "locked account, password reset login", [0.0, 1, 0, 0, 0, 3]),
    (2, "zzz unknown words", [0.0, -1, 1, 1, 0, 0]),
    (3, "", [1.0, 1, 1, 1, 1, 1]),
    (4, None, [2.0, 0, 0, 0, 0, 0]),
    (5, "the and of", [0.0] * 6),
    (6, "parcel courier parcel naïve café wallet", None),
    (7, "payment", [-1.0, -2, -3, 0, 0, 1]),
]


def frames(spark, rows, vectors):
    vectors = {i: [float(x) for x in v] for i, v in vectors.items()}
    articles = spark.createDataFrame(rows, ARTICLE_COLUMNS)
    return articles, spark.createDataFrame(
        list(vectors.items()), "kb_id long, embedding array<float>"
    )


@pytest.fixture(scope="module")
def rows():
    return make_articles(40)


@pytest.fixture(scope="module")
def held(rows):
    ids = [row[0] for row in rows]
    return make_vectors(ids[: len(ids) * 3 // 4])


@pytest.fixture(scope="module")
def index(spark, rows, held):
    return build_index(*frames(spark, rows, held))


@pytest.fixture(scope="module")
def brute(rows, held):
    return Brute(rows, held)


@pytest.fixture(scope="module")
def queries(spark):
    floats = [(i, text, None if v is None else [float(x) for x in v]) for i, text, v in QUERIES]
    return spark.createDataFrame(floats, "query_id long, text string, embedding array<float>")


def check(found, brute, queries, k, alpha, scaled=True):
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    for query_id, text, vector in queries:
        expected = brute.top(text, vector, k, alpha, scaled)
        hits = got.get(query_id, [])
        assert [h.rank for h in hits] == list(range(1, len(expected) + 1))
        assert [h.kb_id for h in hits] == [e[0] for e in expected]
        for h, (_, sem, kw, hybrid) in zip(hits, expected):
            assert h.semantic_score == pytest.approx(sem, abs=1e-9)
            assert h.keyword_score == pytest.approx(kw, abs=1e-9)
            assert h.hybrid_score == pytest.approx(hybrid, abs=1e-9)


@pytest.mark.parametrize("k,alpha", [(3, 0.5), (5, 0.0), (5, 1.0), (1, 0.3), (500, 0.7)])
def test_retrieve_equals_brute_force(index, queries, brute, k, alpha):
    check(S.retrieve(index, queries, k, alpha), brute, QUERIES, k, alpha)


def test_raw_scores(index, queries, brute):
    check(S.retrieve(index, queries, 4, 0.5, scaled=False), brute, QUERIES, 4, 0.5, scaled=False)


def test_many_passes_give_the_same_hits(index, queries, brute):
    assert S.pass_count(queries, index, 500) > 1
    check(S.retrieve(index, queries, 3, 0.5, pass_bytes=500), brute, QUERIES, 3, 0.5)


def test_one_large_query_does_not_multiply_the_passes(spark, index):
    rows = [(i, "refund", None) for i in range(50)] + [(50, "refund " * 5000, None)]
    many = spark.createDataFrame(rows, "query_id long, text string, embedding array<float>")
    assert S.pass_count(many, index, 2000) < 10


def test_sweep_ranks_every_alpha(index, queries, brute):
    found = S.sweep(index, queries, 3, (0.0, 0.4, 1.0))
    for alpha in (0.0, 0.4, 1.0):
        check(found.where(F.col("alpha") == alpha), brute, QUERIES, 3, alpha)


def test_unused_scores_are_null(index, queries, brute):
    for alpha, missing in ((0.0, "semantic_score"), (1.0, "keyword_score")):
        found = S.retrieve(index, queries, 4, alpha, used_only=True)
        assert found.where(F.col(missing).isNotNull()).count() == 0
        whole = S.retrieve(index, queries, 4, alpha)
        columns = ["query_id", "rank", "kb_id", "hybrid_score"]
        assert sorted(found.select(columns).collect()) == sorted(whole.select(columns).collect())


def test_queries_without_vectors(index, queries, brute):
    without = [(i, text, None) for i, text, _ in QUERIES]
    check(S.retrieve(index, queries.drop("embedding"), 3, 0.5), brute, without, 3, 0.5)


def test_order_of_articles_does_not_matter(spark, rows, held, queries, brute):
    articles, vectors = frames(spark, rows[::-1], dict(reversed(held.items())))
    other = build_index(articles.repartition(13), vectors.repartition(5))
    check(S.retrieve(other, queries, 5, 0.5), brute, QUERIES, 5, 0.5)


def test_one_article(spark, queries):
    rows = [(9, "Payment", "Refund", "Billing", "refund missing", None)]
    vectors = {9: [-1.0, 0, 0, 0, 0, 0]}
    index = build_index(*frames(spark, rows, vectors))
    check(S.retrieve(index, queries, 3, 0.5), Brute(rows, vectors), QUERIES, 3, 0.5)


def test_equal_vectors_stay_raw(spark, queries):
    rows = make_articles(30, seed=5)
    vectors = {row[0]: [0.5, 0.75, 0.25, 1.5, 3.0, 0.625] for row in rows}
    index = build_index(*frames(spark, rows, vectors))
    check(S.retrieve(index, queries, 4, 0.5), Brute(rows, vectors), QUERIES, 4, 0.5)


def test_own_text_comes_first(spark, index, rows):
    from brute import corpus_of

    asked = spark.createDataFrame(
        [(row[0], corpus_of(row)) for row in rows], "query_id long, text string"
    )
    found = S.retrieve(index, asked, 1, 0.0, scaled=False).collect()
    texts = {row[0]: corpus_of(row) for row in rows}
    assert len(found) == len(rows)
    for hit in found:
        assert hit.keyword_score == pytest.approx(1.0)
        assert texts[hit.kb_id] == texts[hit.query_id]


def test_limits(index, queries):
    assert S.retrieve(index, queries, 0).count() == 0
    with pytest.raises(ValueError):
        S.retrieve(index, queries, -1)
    with pytest.raises(ValueError):
        S.retrieve(index, queries, 3, 1.5)


def test_no_queries(index, queries):
    assert S.retrieve(index, queries.limit(0), 3).count() == 0
    assert S.score_ranges(index, queries.limit(0)).count() == 0


def test_ranges(index, queries, brute):
    found = {r.query_id: r for r in S.score_ranges(index, queries).collect()}
    for query_id, text, vector in QUERIES:
        sem, kw = brute.raw_scores(text, vector)
        row = found[query_id]
        assert row.n_matched == sum(x > 0 for x in kw.values())
        assert (row.sem_min, row.sem_max) == pytest.approx((min(sem.values()), max(sem.values())))
        assert (row.kw_min, row.kw_max) == pytest.approx((min(kw.values()), max(kw.values())))


def test_query_vector_of_wrong_length(spark, index):
    asked = spark.createDataFrame(
        [(1, "refund", [1.0, 2.0])], "query_id long, text string, embedding array<float>"
    )
    with pytest.raises(ValueError, match="6 numbers, found 2"):
        S.retrieve(index, asked, 3)


@pytest.mark.parametrize("k,alpha", [(3, 0.5), (2, 1.0), (4, 0.2)])
def test_small_blocks_and_runs(monkeypatch, index, queries, brute, k, alpha):
    """The task's own loops: several blocks of queries, runs of a few articles, many batches."""
    monkeypatch.setattr(scoring, "QUERIES_PER_BLOCK", 3)
    blocks = S._blocks(index, queries)
    assert len(blocks) == 3 and sum(len(b.ids) for b in blocks) == 7
    table = index.vectors.toArrow().combine_chunks()
    whole = pa.Table.from_batches(scoring.score_ranges(iter(table.to_batches()), blocks)).to_pylist()
    monkeypatch.setattr(scoring, "CELLS", 16)
    batches = table.to_batches(max_chunksize=7)
    assert pa.Table.from_batches(scoring.score_ranges(iter(batches), blocks)).to_pylist() == whole
    scales = [scoring.Scales(*(np.full(len(b.ids), x) for x in (0.0, 1.0, 0.0)), np.full((1, len(b.ids)), -(1 << 62))) for b in blocks]
    best = pa.Table.from_batches(scoring.best_articles(iter(batches), blocks, scales, [1.0], k)).to_pylist()
    held = {r["kb_id"] for r in table.select(["kb_id"]).to_pylist()}
    for query_id, text, vector in QUERIES:
        if vector is not None:
            hits = sorted((r for r in best if r["query_id"] == query_id), key=lambda r: (-r["rank_key"], r["kb_id"]))[:k]
            wanted = [e for e in brute.top(text, vector, 10_000, 1.0, False) if e[0] in held]
            assert [(h["kb_id"], h["semantic"]) for h in hits] == [(e[0], pytest.approx(e[1], abs=1e-12)) for e in wanted[:k]]


def test_floors_of_a_first_part_keep_candidates_few(monkeypatch, spark, rows, held, queries, brute):
    """Vectors in many files: the k-th best of a part of them bounds what the other tasks return."""
    articles, vectors = frames(spark, rows, held)
    monkeypatch.setattr(S, "FLOOR_FILES", 4)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # every file a task of its own
    try:
        many = build_index(articles, vectors.repartition(16))
        files = many.vectors.inputFiles()
        check(S.retrieve(many, queries, 2, 0.5), brute, QUERIES, 2, 0.5)
        one = next(S._passes(many, queries, S.PASS_BYTES, "s"))
        scaling = {r.query_id: r for r in S._scaling(many, one, False).collect()}
        seen = []
        real = S.written
        monkeypatch.setattr(S, "written", lambda df, label: seen.append(df) or real(df, label))
        found = S._best_by_vector(many, one, scaling, [1.0], 2)
        assert len(files) >= 16 and found.count() == 2 * 7
        returned = [df._jdf.queryExecution().executedPlan() and df.count() for df in seen]
        assert len(seen) == 2 and sum(returned) < 2 * 7 * 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_unit_rows_keep_zero():
    assert np.array_equal(scoring.unit_rows(np.zeros((2, 3))), np.zeros((2, 3)))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan(index, queries):
    found = S.retrieve(index, queries, 3)
    plan = found._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_keywords_need_no_python_and_read_their_terms_only(monkeypatch, spark, rows, held, queries, brute):
    """Shards and codes of the query's terms reach the scan, and the join with the query's terms is a broadcast."""
    monkeypatch.setattr(I, "SHARD_POSTINGS", 20)
    sharded = build_index(*frames(spark, rows, held))
    assert sharded.segments[0].bits > 2
    seen = []
    real = S.written
    monkeypatch.setattr(S, "written", lambda df, label: seen.append((label, plan_of(df))) or real(df, label))
    found = S.retrieve(sharded, queries, 5, 0.0, used_only=True)
    plans = [plan for _, plan in seen] + [plan_of(found)]
    assert not any("MapInArrow" in plan or "Python" in plan for plan in plans)
    pairs = next(plan for label, plan in seen if label == "pairs")
    assert "PartitionFilters: [shard#" in pairs and "PushedFilters: [In(code" in pairs
    assert "BroadcastHashJoin" in pairs and "SortMergeJoin" not in pairs
    codes = S.query_terms(sharded, queries.where("query_id = 7"))[1]
    read = set(sharded.postings(codes).select("_metadata.file_path").distinct().toPandas().iloc[:, 0])
    assert len(codes) == 1 and 0 < len(read) <= 2 < len(sharded.postings().inputFiles())
    whole = found.drop("semantic_score")
    wanted = S.retrieve(sharded, queries, 5, 0.0).drop("semantic_score")
    assert sorted(whole.collect()) == sorted(wanted.collect())


def test_a_term_of_a_third_of_all_articles_makes_no_large_task(spark):
    """Its postings lie in several files, and its products are spread by article."""
    rows = [(i, "x", "y", "z", "common" if i % 3 == 0 else f"word{i} other{i}", None) for i in range(6000)]
    articles = spark.createDataFrame(rows, ARTICLE_COLUMNS)
    index = build_index(articles)
    asked = spark.createDataFrame([(0, "common"), (1, "common word1")], "query_id long, text string")
    pairs = S.keyword_pairs(index, asked)
    sizes = [r["count"] for r in pairs.groupBy(F.pmod(F.xxhash64("query_id", "kb_id"), F.lit(8))).count().collect()]
    assert pairs.count() == 2 * 2000 + 1 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    found = S.retrieve(index, asked, 3, 0.0).collect()
    assert [(r.query_id, r.kb_id) for r in sorted(found)] == [(0, 0), (0, 3), (0, 6), (1, 0), (1, 1), (1, 3)] or len(found) == 6


@pytest.mark.parametrize("alpha", [0.0, 0.25, 0.5, 0.9])
def test_only_candidates_are_looked_up(monkeypatch, index, queries, brute, alpha):
    """Pairs below the threshold are left out, and the hits stay the same."""
    seen = []
    real = S._with_semantic
    monkeypatch.setattr(S, "_with_semantic", lambda i, one, c: seen.append((c.count(), one.pairs.count())) or real(i, one, c))
    check(S.retrieve(index, queries, 2, alpha), brute, QUERIES, 2, alpha)
    (candidates, pairs), = seen
    assert candidates < pairs + 2 * 3 * len(QUERIES)
    if alpha == 0.0:
        assert candidates < 6 * 2 * len(QUERIES)


def test_repeated_ids_are_refused(spark, index, queries, rows, held):
    with pytest.raises(ValueError, match=r"query_id must be unique; repeated: \[1\]"):
        S.retrieve(index, queries.union(queries.where("query_id = 1")), 3, 0.5)
    articles, vectors = frames(spark, [*rows, rows[0]], held)
    with pytest.raises(ValueError, match="kb_id must be unique"):
        build_index(articles, vectors)


@pytest.mark.parametrize("k, task", [(1, 1 << 22), (3, 50), (100, 50)])
def test_many_pairs_are_summed_inside_tasks(monkeypatch, index, queries, brute, k, task):
    """Beyond a number of pairs neither their products nor the pairs are shuffled or written, and the hits stay the same."""
    monkeypatch.setattr(S, "LISTED_PAIRS", 0)
    monkeypatch.setattr(S, "POSTINGS_PER_TASK", task)
    monkeypatch.setattr(S, "keyword_pairs", None)
    check(S.retrieve(index, queries, k, 0.0), brute, QUERIES, k, 0.0)
    check(S.retrieve(index, queries, k, 0.0, scaled=False), brute, QUERIES, k, 0.0, scaled=False)


@pytest.mark.parametrize("k, task, run", [(1, 1 << 22, 4096), (3, 50, 7), (100, 50, 7)])
def test_many_hybrid_pairs_are_scored_inside_tasks(monkeypatch, index, queries, brute, k, task, run):
    """Beyond a number of pairs no search lists them, whatever the alphas, and hits and ranges stay the same."""
    monkeypatch.setattr(S, "LISTED_PAIRS", 0)
    monkeypatch.setattr(S, "POSTINGS_PER_TASK", task)
    monkeypatch.setattr(S, "keyword_pairs", None)
    monkeypatch.setattr(S, "_with_semantic", None)
    monkeypatch.setattr(scoring, "ARTICLES_PER_RUN", run)
    found = S.sweep(index, queries, k, (0.0, 0.4, 1.0)).collect()
    for alpha in (0.0, 0.4, 1.0):
        rows = index.spark.createDataFrame([r for r in found if r.alpha == alpha], S.HITS)
        check(rows, brute, QUERIES, k, alpha)
    check(S.retrieve(index, queries, k, 0.5, scaled=False), brute, QUERIES, k, 0.5, scaled=False)
    without = [(i, text, None) for i, text, _ in QUERIES]
    check(S.retrieve(index, queries.drop("embedding"), k, 0.5), brute, without, k, 0.5)
    test_ranges(index, queries, brute)


def test_a_search_of_many_pairs_shuffles_no_pairs(monkeypatch, spark, rows, held, queries):
    """What is dealt has a row a posting, an article and a vector, however many queries ask for it."""
    monkeypatch.setattr(S, "LISTED_PAIRS", 0)
    index = build_index(*frames(spark, rows, held))
    more = reduce(DataFrame.unionByName, [queries.withColumn("query_id", F.col("query_id") + 100 * i) for i in range(5)])
    dealt = []
    real = S._whole_articles
    monkeypatch.setattr(S, "_whole_articles", lambda *a, **b: dealt.append(real(*a, **b)) or dealt[-1])
    S.retrieve(index, queries, 3, 0.5).collect()
    S.retrieve(index, more, 3, 0.5).collect()
    sizes = [df.count() for df in dealt]
    assert sizes[:2] == sizes[2:] and sizes[1] == sizes[0] + len(held)


@pytest.mark.parametrize("alphas, k, run, cells", [([0.5], 3, 4096, 1 << 21), ([0.0, 0.3, 1.0], 4, 7, 30)])
def test_fused_scores_of_runs_and_blocks(monkeypatch, alphas, k, run, cells):
    """Articles without postings or without a vector, and queries without either, are scored too; ties go to the lower id."""
    monkeypatch.setattr(scoring, "ARTICLES_PER_RUN", run)
    monkeypatch.setattr(scoring, "CELLS", cells)
    random = np.random.default_rng(2)
    tf, weight = random.integers(0, 3, (30, 12)), random.integers(0, 3, (9, 12)) / 3
    weight[4], tf[3] = 0, 0
    vectors, wanted = random.integers(-2, 3, (30, 4)).astype(float), random.integers(-2, 3, (9, 4)).astype(float)
    vectors[::3], wanted[5] = 0, 0
    norm = random.integers(20, 40, 30).astype(float)
    norm[3] = 0
    rows = [(int(i) * 10, int(c), int(tf[i, c]), None, None, []) for i, c in zip(*np.nonzero(tf))]
    rows += [(i * 10, 0, 0, float(norm[i]), i % 3 > 0, []) for i in range(30)]
    rows += [(i * 10, 0, 0, None, None, vectors[i].tolist()) for i in range(30) if i % 3]
    random.shuffle(rows)
    kinds = {"kb_id": pa.int64(), "code": pa.int64(), "tf": pa.int32(), "norm": pa.float64(), "has_vector": pa.bool_(), "embedding": pa.list_(pa.float32())}
    parts = [pa.RecordBatch.from_pylist([dict(zip(kinds, r)) for r in part], schema=pa.schema(kinds)) for part in (rows[:40], [], rows[40:])]
    q, code = np.nonzero(weight)
    weights = scoring.QueryWeights(np.arange(9) + 100, q, code, weight[q, code])
    fusion = scoring.Fusion(scoring.unit_rows(wanted), *(np.full(9, x) for x in (-0.5, 1.5, 0.01, 0.25)))
    found = pa.Table.from_batches(scoring.best_fused(iter(parts), weights, fusion, alphas, k)).to_pylist()
    keyword = np.round(weight @ tf.T / np.where(norm > 0, norm, 1), 12)
    semantic = np.round(scoring.unit_rows(wanted) @ scoring.unit_rows(vectors).T, 12)
    spans = {r["query_id"] - 100: r for r in pa.Table.from_batches(scoring.keyword_ranges(iter(parts), weights)).to_pylist()}
    assert sorted(spans) == [query for query in range(9) if keyword[query].any()]
    for query, span in spans.items():
        with_terms = keyword[query, tf.any(axis=1)]
        assert (span["kw_min"], span["kw_max"]) == pytest.approx((with_terms.min(), with_terms.max()), abs=1e-11)
        assert span["n_pairs"] == (keyword[query] > 0).sum()
    for alpha in alphas:
        key = np.rint((alpha * (semantic + 0.5) / 1.5 + (1 - alpha) * (keyword - 0.01) / 0.25) * 1e9)
        for query in range(9):
            best = sorted((-key[query, i], i * 10) for i in range(30))[:k]
            mine = sorted((-r["rank_key"], r["kb_id"], r["semantic"], r["keyword"]) for r in found if (r["query_id"], r["alpha"]) == (query + 100, alpha))
            assert [m[1] for m in mine] == [i for _, i in best]
            assert [m[2:] for m in mine] == [pytest.approx((semantic[query, i // 10], keyword[query, i // 10]), abs=1e-11) for _, i in best]


@pytest.mark.parametrize("run, products, cells", [(4096, 1 << 21, 1 << 21), (7, 5, 30)])
def test_runs_of_articles_and_products(monkeypatch, run, products, cells):
    monkeypatch.setattr(scoring, "ARTICLES_PER_RUN", run)
    monkeypatch.setattr(scoring, "PRODUCTS", products)
    monkeypatch.setattr(scoring, "CELLS", cells)
    random = np.random.default_rng(1)
    tf, weight = random.integers(0, 3, (30, 12)), random.integers(0, 3, (9, 12)) / 3
    weight[4] = 0
    norm = random.integers(20, 40, 30).astype(float)
    a, code = np.nonzero(tf)
    postings = [(int(i) * 10, int(c), int(tf[i, c]), None, None) for i, c in zip(a, code)]
    postings += [(i * 10, 0, 0, float(norm[i]), i % 2 == 0) for i in range(30)]
    schema = pa.schema({"kb_id": pa.int64(), "code": pa.int64(), "tf": pa.int32(), "norm": pa.float64(), "has_vector": pa.bool_()})
    random.shuffle(postings)
    parts = [pa.record_batch([list(c) for c in zip(*p)], schema=schema) for p in (postings[:50], [], postings[50:]) if p]
    q, code = np.nonzero(weight)
    ids, place = np.unique(q, return_inverse=True)
    weights = scoring.QueryWeights(ids, place, code, weight[q, code])
    rows = pa.Table.from_batches(scoring.best_by_keywords(iter(parts), weights, 3)).to_pylist()
    score = np.round(weight @ tf.T / norm, 12)
    for query in range(9):
        wanted = sorted((-score[query, i], i * 10) for i in range(30) if score[query, i] > 0)[:3]
        mine = [r for r in rows if r["query_id"] == query]
        hits = sorted((-r["keyword"], r["kb_id"]) for r in mine if r["kb_id"] is not None)
        assert hits[: len(wanted)] == [(pytest.approx(s, abs=1e-11), i) for s, i in wanted]
        assert all(r["has_vector"] == (r["kb_id"] % 20 == 0) for r in mine if r["kb_id"] is not None)
        about = [(r["low"], r["pairs"]) for r in mine if r["kb_id"] is None]
        matched = int((score[query] > 0).sum())
        assert about == ([(pytest.approx(score[query].min(), abs=1e-11), matched)] if matched else [])


def test_scores_that_share_a_rank_key_all_stay():
    """The lower kb_id of nearly equal scores may win once they are scaled; of equal ones the first are enough."""
    unit = 10**12
    key = np.array([[unit - 900, unit, unit, unit - 900, unit - 5000, 0, unit - 900], [0, 0, 7 * unit // 8, 0, 0, 0, unit // 2]])
    row, column, least = scoring._leading(key, 2)
    assert sorted(zip(row.tolist(), column.tolist())) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 2), (1, 6)]
    assert least.tolist() == [unit, unit // 2]


def test_few_scores_are_ranked_once_there_are_floors(monkeypatch):
    """After the first run of articles only scores that reach the floor of their query are ranked, and the best are those of all."""
    rng = np.random.default_rng(7)
    n, terms = 4000, 60
    tf = rng.integers(0, 4, (n, terms)) * (rng.random((n, terms)) < 0.3)
    norm, ids = np.sqrt((tf * tf).sum(1)) + 1.0, rng.permutation(n) + 1000
    article, code = np.nonzero(tf)
    rows = pa.record_batch({"kb_id": np.concatenate([ids[article], ids]), "code": np.concatenate([code, np.zeros(n, int)]),
                            "tf": np.concatenate([tf[article, code], np.zeros(n, int)]).astype(np.int32),
                            "norm": pa.array([None] * len(code) + norm.tolist()), "has_vector": pa.array([None] * len(code) + [False] * n)})
    weight = rng.random((20, terms)) * (rng.random((20, terms)) < 0.2)
    q, code = np.nonzero(weight)
    cells = []
    real = scoring._leading
    monkeypatch.setattr(scoring, "_leading", lambda key, k: cells.append(key.size) or real(key, k))
    monkeypatch.setattr(scoring, "ARTICLES_PER_RUN", 500)
    found = pa.Table.from_batches(scoring.best_by_keywords(iter([rows]), scoring.QueryWeights(np.arange(20), q, code, weight[q, code]), 3)).to_pylist()
    assert sum(cells) < 20 * n / 4
    scores = np.round((weight @ tf.T) / norm, scoring.SCORE_DECIMALS)
    for i in range(20):
        mine = sorted((-round(r["keyword"], 9), r["kb_id"]) for r in found if r["query_id"] == i and r["kb_id"] is not None)[:3]
        assert mine == sorted(zip((-np.round(scores[i], 9)).tolist(), ids.tolist()))[:3]
        (low,) = [r["low"] for r in found if r["query_id"] == i and r["kb_id"] is None]
        assert low == scores[i].min()

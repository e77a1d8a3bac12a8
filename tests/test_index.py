import pyarrow.parquet as pq
import pytest
from brute import Brute, make_articles, make_vectors
from pyspark.sql import functions as F
from test_search import ARTICLE_COLUMNS, frames

from helpgrid.operators import index as I


def tables(index):
    """The contents of an index, less the order of its rows."""
    postings = {(r.kb_id, r.code): r.tf for r in index.postings().collect()}
    norms = {r.kb_id: (r.n_terms, r.has_vector, round(r.norm, 9)) for r in index.norms.collect()}
    vectors = {r.kb_id: (r.embedding, round(r.length, 9)) for r in index.vectors.collect()}
    terms = {r.term: (r.code, r.df) for r in index.frequencies().collect()}
    idf = {r.term: round(r.idf, 9) for r in index.idf.collect()}
    return postings, norms, vectors, terms, idf


@pytest.fixture(scope="module")
def rows():
    return make_articles(60, seed=8)


@pytest.fixture(scope="module")
def vectors(rows):
    return make_vectors([row[0] for row in rows][::2])


@pytest.fixture(scope="module")
def index(spark, rows, vectors):
    return I.build_index(*frames(spark, rows, vectors))


def test_weights(index, rows, vectors):
    brute = Brute(rows, vectors)
    got = {(r.kb_id, r.term): r.weight for r in I.tfidf_weights(index).collect()}
    expected = {(i, t): x for i, w in brute.weights.items() for t, x in w.items()}
    assert got.keys() == expected.keys()
    assert all(got[key] == pytest.approx(expected[key], abs=1e-12) for key in got)
    assert index.n_postings == len(expected)


def test_rare_terms_by_shuffle(monkeypatch, spark, rows, vectors, index):
    """With few frequent terms allowed, most go through the shuffle; the index is the same."""
    monkeypatch.setattr(I, "FREQUENT_TERMS", 40)
    assert I.frequent_from(index.frequencies(), index.n_postings) > 1
    other = I.build_index(*frames(spark, rows, vectors))
    assert tables(other) == tables(index)


def test_frequent_terms_fit_the_byte_limit(monkeypatch, index):
    monkeypatch.setattr(I, "FREQUENT_BYTES", 200)
    least = I.frequent_from(index.frequencies(), index.n_postings)
    assert index.terms.where(F.col("df") >= least).count() * 24 <= 200


def test_refresh_equals_rebuild(spark, rows, vectors, index):
    old, new = rows[:50], rows[50:]
    old_ids = {row[0] for row in old}
    first = I.build_index(*frames(spark, old, {i: v for i, v in vectors.items() if i in old_ids}))
    articles, added = frames(spark, new, {i: v for i, v in vectors.items() if i not in old_ids})
    second = I.refresh_index(first, articles, added)
    assert (second.n, second.n_postings, second.n_vectors) == (index.n, index.n_postings, index.n_vectors)
    assert len(second.segments) == 2 and second.segments[0] == first.segments[0]
    assert tables(second) == tables(index)
    compact = I.compact_index(second)
    assert len(compact.segments) == 1 and tables(compact) == tables(index)
    assert tables(I.open_index(spark, second.path)) == tables(index)


def test_many_refreshes(monkeypatch, spark, rows, vectors, index):
    """Article by article, in shards and with shuffles where there is nothing to broadcast, merged now and then."""
    monkeypatch.setattr(I, "SEGMENTS", 3)
    monkeypatch.setattr(I, "SHARD_POSTINGS", 30)
    monkeypatch.setattr(I, "FREQUENT_BYTES", 100)
    monkeypatch.setattr(I, "SHARDED_CODES", 8)
    part, held = I.build_index(*frames(spark, rows[:40], {i: v for i, v in vectors.items() if i in {r[0] for r in rows[:40]}})), []
    for low in range(40, len(rows), 13):
        some = rows[low : low + 13]
        ids = {r[0] for r in some}
        part = I.refresh_index(part, *frames(spark, some, {i: v for i, v in vectors.items() if i in ids} or {-1: [0.0] * 6}))
        held.append(len(part.segments))
    assert 1 in held and max(held) > 1
    assert tables(part) == tables(index)


def test_ids_are_refused_twice(spark, rows, vectors, index):
    articles, given = frames(spark, rows[:2], vectors)
    with pytest.raises(ValueError, match="in the index already"):
        I.refresh_index(index, articles, given)
    with pytest.raises(ValueError, match="must not be null"):
        I.build_index(spark.createDataFrame([(None, "a", "b", "c", "d", "e")], ARTICLE_COLUMNS))


def test_open(spark, index):
    again = I.open_index(spark, index.path)
    assert again == index
    assert tables(again) == tables(index)


def test_without_vectors(spark, rows):
    articles = spark.createDataFrame(rows, ARTICLE_COLUMNS)
    index = I.build_index(articles)
    assert index.dimension is None and index.n_vectors == 0
    assert index.vectors.count() == 0 and index.norms.where("has_vector").count() == 0


def test_wrong_dimension_fails(spark, rows):
    vectors = {rows[0][0]: [1.0, 2.0], rows[1][0]: [1.0, 2.0, 3.0]}
    with pytest.raises(Exception, match="expected a vector"):
        I.build_index(*frames(spark, rows, vectors))


def test_empty_texts(spark):
    rows = [(1, None, None, None, None, None), (2, "the", "of", "x", "a", "b")]
    index = I.build_index(spark.createDataFrame(rows, ARTICLE_COLUMNS))
    assert (index.n, index.n_postings) == (2, 0)
    assert sorted(r.norm for r in index.norms.collect()) == [0.0, 0.0]


def test_terms_with_one_hash(monkeypatch, spark, rows, vectors, index):
    """With a poor hash many terms collide; codes stay unique and the hits the same."""
    from helpgrid.operators.search import retrieve

    asked = spark.createDataFrame(
        [(0, "refund customer card"), (1, "café naïve parcel late")], "query_id long, text string"
    )
    expected = sorted(retrieve(index, asked, 5, 0.0).collect())
    monkeypatch.setattr(I, "term_hash", lambda term: F.pmod(F.xxhash64(term), F.lit(60)))
    poor = I.build_index(*frames(spark, rows, vectors))
    codes = poor.terms.select(poor.code(F.col("term")).alias("code"))
    assert len(poor.moved) > 20
    assert codes.distinct().count() == poor.terms.count()
    assert sorted(retrieve(poor, asked, 5, 0.0).collect()) == expected
    # new terms that meet the code of an old one get another; no code is changed
    some = {row[0] for row in rows[:30]}
    part = I.build_index(*frames(spark, rows[:30], {i: v for i, v in vectors.items() if i in some}))
    grown = I.refresh_index(part, *frames(spark, rows[30:], {i: v for i, v in vectors.items() if i not in some}))
    before, after = ({r.term: r.code for r in x.frequencies().collect()} for x in (part, grown))
    assert all(after[t] == code for t, code in before.items())
    assert len(set(after.values())) == len(after) == index.terms.count()
    assert sorted(retrieve(grown, asked, 5, 0.0).collect()) == expected


@pytest.fixture
def two_partitions(spark):
    """Few partitions are set, and none are put together."""
    wanted = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    given = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    yield
    for name, value in given.items():
        spark.conf.set(name, value)


def test_partitions_grow_in_number_with_the_postings(monkeypatch, spark, two_partitions):
    """A task of a build must not hold more postings because there are more articles."""
    monkeypatch.setattr("helpgrid.session.PARTITION_ROWS", 100, raising=False)
    monkeypatch.setattr(I, "PARTITION_ROWS", 100, raising=False)
    monkeypatch.setattr(I, "BROADCAST_BYTES", 0, raising=False)
    names = "kb_id long, category string, subcategory string, journey_stage string, issue_description string, resolution_steps string"
    rows = [(i, "c", "s", "j", f"word{i} other{i % 7}", None) for i in range(400)]
    index = I.build_index(spark.createDataFrame(rows, names))
    sizes = [r["count"] for r in index.postings().groupBy(F.input_file_name()).count().collect()]
    assert index.n_postings >= 1200 and max(sizes) <= 3 * 100
    assert spark.conf.get("spark.sql.shuffle.partitions") == "2"
    weights = I.tfidf_weights(index)
    assert weights.rdd.getNumPartitions() >= index.n_postings // 100
    assert weights.groupBy("kb_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).where("abs(n - 1) > 1e-9").count() == 0
    more = spark.createDataFrame([(i, "c", "s", "j", f"word{i} other{i % 7}", None) for i in range(400, 420)], names)
    grown, whole = I.refresh_index(index, more), I.build_index(spark.createDataFrame(rows, names).unionByName(more))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "2"
    near = grown.norms.alias("a").join(whole.norms.alias("b"), "kb_id").where("abs(a.norm - b.norm) < 1e-9")
    assert near.count() == 420


def test_terms_of_one_article_are_not_joined(spark, index):
    """The sums of articles do not need the postings of the terms that no other article has."""
    frequencies = index.frequencies()
    common = index.postings().join(frequencies.where("df > 1").select("code"), "code", "left_semi")
    assert common.count() < index.n_postings
    tall = I.coded(index.counts, index.moved)
    found = I.article_sums(tall, common, frequencies, index.n_postings)
    got = {r.kb_id: (r.s0, r.s1, r.s2) for r in found.collect()}
    wanted = {r.kb_id: (r.s0, r.s1, r.s2) for r in index.sums.where("n_terms > 0").collect()}
    assert got.keys() == wanted.keys()
    assert all(got[i] == pytest.approx(wanted[i], rel=1e-12) for i in got)


def test_files_of_shards_are_in_order(monkeypatch, spark, rows):
    """A task that writes several shards sorts by the code alone, and its files are in order."""
    monkeypatch.setattr(I, "SHARD_POSTINGS", 200)
    name = "spark.sql.maxConcurrentOutputFileWriters"
    given = spark.conf.get(name)
    index = I.build_index(spark.createDataFrame(rows, ARTICLE_COLUMNS))
    assert spark.conf.get(name) == given and index.segments[0].bits >= 3
    for kind, schema in (("postings", I.POSTINGS), ("terms", I.TERMS)):
        files = spark.read.schema(schema).parquet(f"{index.segments[0].path}/{kind}").inputFiles()
        assert len(files) >= 1 << index.segments[0].bits
        for file in files:
            codes = pq.ParquetFile(file.removeprefix("file://")).read(["code"])["code"].to_pylist()
            assert codes == sorted(codes)


def test_terms_are_shuffled_once(monkeypatch, spark, rows, vectors, index):
    """Terms are counted in batches, dealt out by their codes and added up there; codes are counted only where terms share one."""
    dealt = I.segment_terms(index.counts, 3, {})
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan
    wanted = sorted(I.document_frequencies(index.counts).collect())
    assert sorted(dealt.select("term", "df").collect()) == wanted and dealt.where("clash").count() == 0
    # an article a batch, so that every term comes several times
    monkeypatch.setattr(I, "TERM_ROWS", 3)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        assert sorted(I.segment_terms(index.counts, 0, {}).select("term", "df").collect()) == wanted
    finally:
        spark.conf.set(name, given)

    def counted(terms):
        raise AssertionError("no terms share a code")

    monkeypatch.setattr(I, "shared_codes", counted)
    again = I.build_index(*frames(spark, rows, vectors))
    assert sorted(again.frequencies().collect()) == sorted(index.frequencies().collect())


def test_terms_that_share_a_code_are_found(monkeypatch, spark, index):
    monkeypatch.setattr(I, "term_hash", lambda term: F.pmod(F.xxhash64(term), F.lit(60)))
    found = I.segment_terms(index.counts, 0, {})
    wanted = I.document_frequencies(index.counts).groupBy(I.term_hash(F.col("term")).alias("code"))
    wanted = wanted.agg(F.sum("df").alias("df"), (F.count(F.lit(1)) > 1).alias("clash")).select("code", "df", "clash")
    assert sorted(found.select("code", "df", "clash").collect()) == sorted(wanted.collect())


def test_postings_are_shuffled_once_and_packed(monkeypatch, spark, rows, vectors, index):
    """A batch's postings of a slice cross as one row, with what the sums need, and heavy terms are spread by article."""
    plan = I.segment_postings(index.counts, 0, {})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    written = spark.read.schema(I.WRITTEN_POSTINGS).parquet(f"{index.segments[0].path}/postings")
    df = {r.code: r.df for r in index.frequencies().collect()}
    assert all(r.df == df[r.code] for r in written.collect())
    plan = I.segment_sums(index.counts, written)._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan.lower() and "inline" not in plan.lower()

    monkeypatch.setattr(I, "HEAVY", 3)
    monkeypatch.setattr(I, "FREQUENT_TERMS", 1 << 40)
    again = I.build_index(*frames(spark, rows, vectors))
    assert sorted(again.postings().collect()) == sorted(index.postings().collect())
    got, wanted = ({r.kb_id: (r.s0, r.s1, r.s2) for r in x.sums.collect()} for x in (again, index))
    assert got.keys() == wanted.keys() and all(got[i] == pytest.approx(wanted[i], rel=1e-12) for i in got)


def test_texts_are_not_shuffled_for_their_labels(spark, tmp_path):
    from helpgrid.plans import tables as T

    texts = [(i, f"line {i}\nmore", "en", "src", 9) for i in range(20)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    held = [(i, [0.5], i % 3) for i in range(10)]
    spark.createDataFrame(held, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    name = "spark.sql.autoBroadcastJoinThreshold"
    given = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        found = T.articles(spark, str(tmp_path))
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r.kb_id: r.category for r in found.collect()} == {i: str(i % 3) if i < 10 else None for i in range(20)}
    finally:
        spark.conf.set(name, given)


@pytest.mark.parametrize("shard, most", [(1 << 22, 1 << 25), (200, 300)])
def test_a_refresh_joins_old_postings_where_they_lie(monkeypatch, spark, rows, index, shard, most):
    """Terms of the new articles are broadcast in parts that meet their own shards; old postings and terms are not dealt by code."""
    monkeypatch.setattr(I, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(I, "FREQUENT_BYTES", most)
    monkeypatch.setattr(I, "SHARDED_CODES", 4)
    monkeypatch.setattr(I, "frequent_from", lambda frequencies, n: 1 << 40)
    half = len(rows) // 2
    seen = []
    real = I.Index.met
    monkeypatch.setattr(I.Index, "met", lambda *a: seen.append(real(*a)) or seen[-1])
    part = I.build_index(spark.createDataFrame(rows[:half], ARTICLE_COLUMNS))
    grown = I.refresh_index(part, spark.createDataFrame(rows[half:], ARTICLE_COLUMNS))
    whole = I.build_index(spark.createDataFrame(rows, ARTICLE_COLUMNS))
    assert sorted(grown.terms.collect()) == sorted(whole.terms.collect())
    got, wanted = ({r.kb_id: (r.s0, r.s1, r.s2) for r in x.sums.collect()} for x in (grown, whole))
    assert got.keys() == wanted.keys() and all(got[i] == pytest.approx(wanted[i], rel=1e-9, abs=1e-9) for i in got)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in seen]
    assert len(plans) == 3 and all("hashpartitioning(code" not in plan and "BroadcastHashJoin" in plan for plan in plans)
    assert most > 300 or plans[0].count("BroadcastHashJoin") > 1

import json

import pytest
from brute import make_articles, make_vectors
from pyspark.sql import functions as F
from stubs import first_category, strict_judge
from test_search import frames

from helpgrid.operators import jobs
from helpgrid.operators import search as S
from helpgrid.operators.index import build_index, current_index, publish_index, refresh_index
from helpgrid.session import scratch_path
from helpgrid.streaming.triage import start_triage


@pytest.fixture(scope="module")
def kb(spark):
    rows = make_articles(30, seed=3)
    articles, vectors = frames(spark, rows, make_vectors([row[0] for row in rows]))
    return articles, build_index(articles, vectors)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [
        (0, "parcel late driver", "Delivery", "Delivery 1"),
        (1, "refund to my card", "Payment", "Payment 2"),
        (2, "password reset login", "Account", "Account 3"),
    ]
    return spark.createDataFrame(
        rows, "query_id long, text string, expected_category string, expected_subcategory string"
    )


def test_evaluate(kb, labelled):
    articles, index = kb
    done = jobs.evaluate(index, articles, labelled, first_category, strict_judge, 3, 0.0)
    retrieval = {r.query_id: r for r in done.retrieval.collect()}
    generation = {r.query_id: r for r in done.generation.collect()}
    assert set(retrieval) == set(generation) == {0, 1, 2}
    # the call for the second query failed: fallback record, judged unreadable
    assert generation[1].llm_category == "Unknown"
    assert (generation[1].faithfulness, generation[1].faithfulness_reason) == (0.0, "Parse error")
    assert generation[0].llm_category == (retrieval[0].retrieved_categories[0] or "")
    assert (generation[0].answer_relevance, generation[0].relevance_reason) == (0.5, "half")
    row = done.metrics.first()
    assert row.faithfulness == pytest.approx(2 / 3) and row.answer_relevance == pytest.approx(1 / 3)
    assert done.tiers.count() == 6
    assert 4 in [r.position for r in done.advice.collect()]


def test_triage(kb, labelled, spark):
    articles, index = kb
    blank = spark.createDataFrame([(9, " \n")], "query_id long, text string")
    asked = labelled.select("query_id", "text").unionByName(blank)
    done = jobs.triage(index, articles, asked, first_category, 2, 0.0)
    rows = {r.query_id: r for r in done.classified.collect()}
    assert set(rows) == {0, 1, 2}
    assert (rows[0].status, rows[0].confidence_tier) == ("ok", "high")
    assert (rows[1].status, rows[1].confidence_tier) == ("fallback", "low")
    assert done.hits.count() == 6


def test_stream_equals_batch(kb, labelled, spark):
    _, index = kb
    asked = labelled.select("query_id", "text")
    source = scratch_path(spark, "complaints")
    for query_id in (0, 1, 2):
        asked.where(F.col("query_id") == query_id).coalesce(1).write.mode("append").parquet(source)
    stream = (
        spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(source)
    )
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    start_triage(stream, index, out, state, 3, 0.0).awaitTermination()
    found = spark.read.parquet(out)
    assert found.select("batch").distinct().count() == 3
    got = sorted(tuple(r) for r in found.drop("batch").collect())
    assert got == sorted(tuple(r) for r in S.retrieve(index, asked, 3, 0.0).collect())
    # nothing new, nothing written
    start_triage(stream, index, out, state, 3, 0.0).awaitTermination()
    assert spark.read.parquet(out).count() == len(got)


def test_stream_keeps_to_the_version_it_has_taken(kb, labelled, spark):
    """A refresh between two batches is picked up by the next one; a batch that is run again keeps its version."""
    articles, index = kb
    head, source = scratch_path(spark, "head"), scratch_path(spark, "complaints")
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    publish_index(index, head)
    asked = labelled.select("query_id", "text")

    def run(query_id, state):
        asked.where(F.col("query_id") == query_id).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(asked.schema).parquet(source)
        start_triage(stream, head, out, state, 1, 0.0).awaitTermination()
        return {r.query_id: r.kb_id for r in spark.read.parquet(out).collect()}

    before = run(0, state)
    new = spark.createDataFrame([(5000, "parcel late driver refund to my card")], "kb_id long, issue_description string")
    fields = {c: F.lit("") for c in ("category", "subcategory", "journey_stage", "resolution_steps")}
    grown = refresh_index(index, new.withColumns(fields))
    publish_index(grown, head)
    assert current_index(spark, head).path == grown.path
    after = run(1, state)
    assert after[0] == before[0] != 5000 and after[1] == 5000
    # the state is lost: both complaints come again as batch 0, which had taken the old version
    again = run(2, scratch_path(spark, "state"))
    assert again[0] == before[0] and again[1] == 5000  # batch 1 is still there
    first = {r.query_id: r.kb_id for r in spark.read.parquet(f"{out}/batch=0").collect()}
    assert set(first) == {0, 1, 2} and 5000 not in first.values()


def reply_of(*issues, category="Account"):
    return json.dumps([{"category": category, "issue_description": x} for x in issues])


def test_growth_gives_free_ids_again_and_again(kb, spark):
    articles, index = kb
    n = articles.count()
    allowed = spark.createDataFrame([("Account",)], "category string")
    first = spark.createDataFrame(
        [(0, reply_of("brand new wallpaper", "other thing")), (1, reply_of("odd", category="Pets")), (2, "no list")],
        "batch_id long, raw string",
    )
    grown = jobs.grow(index, articles, first, allowed)
    assert grown.counts.first() == (2, n + 2) and grown.rejected.count() == 1
    again = jobs.grow(grown.index, grown.articles, first, allowed)
    ids = [r.kb_id for r in again.articles.select("kb_id").collect()]
    assert len(ids) == len(set(ids)) == again.index.n == n + 4
    query = spark.createDataFrame([(1, "wallpaper")], "query_id long, text string")
    hits = S.retrieve(again.index, query, 2, 0.0).collect()
    assert {h.kb_id for h in hits} == {r.kb_id for r in again.articles.where("issue_description LIKE '%wallpaper'").collect()}


def test_grown_articles_get_vectors(spark):
    from stubs import three_numbers

    rows = make_articles(12, seed=5)
    articles, vectors = frames(spark, rows, make_vectors([r[0] for r in rows], dimension=3))
    index = build_index(articles, vectors)
    replies = spark.createDataFrame([(0, reply_of("brand new wallpaper", "bad one"))], "batch_id long, raw string")
    log = scratch_path(spark, "log")
    grown = jobs.grow(index, articles, replies, embedder=three_numbers, log=log)
    assert (grown.index.n, grown.index.n_vectors) == (index.n + 2, index.n_vectors + 1)  # the call for the bad one fails
    asked = spark.createDataFrame([(1, "", [1.0, 0.0, 0.0])], "query_id long, text string, embedding array<float>")
    hit = S.retrieve(grown.index, asked, 1, 1.0, scaled=False).first()
    named = {r.kb_id: r.issue_description for r in grown.articles.collect()}
    assert named[hit.kb_id] == "brand new wallpaper" and hit.semantic_score == pytest.approx(1.0)
    with pytest.raises(ValueError, match="batch_id must not be null"):
        jobs.grow(index, articles, spark.createDataFrame([(None, "[]")], "batch_id long, raw string"))

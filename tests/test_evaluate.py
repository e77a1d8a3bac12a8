import pytest
from pyspark.sql import functions as F

from helpgrid.functions import display as D
from helpgrid.operators import evaluate as E
from helpgrid.operators import prompts as P
from helpgrid.operators import triage as H

LABELLED = "query_id long, text string, expected_category string, expected_subcategory string"
HITS = "query_id long, rank int, category string, subcategory string, hybrid_score double"


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [
        (0, "zero", "A", "a1"),
        (1, "one", "B", "b1"),
        (2, "two", "C", "c1"),
        (3, "three", None, "a1"),
    ]
    return spark.createDataFrame(rows, LABELLED)


@pytest.fixture(scope="module")
def hits(spark):
    rows = [
        (0, 1, "A", "x", 0.9),
        (0, 2, "A", "a1", 0.5),
        (1, 1, "A", "b1", 1.0),
        (1, 2, None, None, 0.2),
        (1, 3, "B", "b2", 0.1),
        (3, 1, None, "a1", 0.3),
    ]
    return spark.createDataFrame(rows, HITS).repartition(3)


def test_per_query(labelled, hits):
    got = {r.query_id: r for r in E.evaluate_retrieval(labelled, hits).collect()}
    assert got[0].retrieved_categories == ["A", "A"]
    assert got[0].hybrid_scores == [0.9, 0.5]
    assert (got[0].hit, got[0].sub_hit, got[0].reciprocal_rank) == (True, True, 1.0)
    assert got[0].avg_hybrid_score == pytest.approx(0.7)
    # the subcategory may be met under another category
    assert (got[1].hit, got[1].sub_hit) == (True, True)
    assert got[1].reciprocal_rank == pytest.approx(1 / 3)
    assert got[1].retrieved_categories == ["A", None, "B"]
    assert got[2].retrieved_categories == [] and got[2].avg_hybrid_score == 0.0
    assert (got[2].hit, got[2].sub_hit, got[2].reciprocal_rank) == (False, False, 0.0)
    assert (got[3].hit, got[3].sub_hit, got[3].reciprocal_rank) == (False, True, 0.0)


def test_summary(labelled, hits):
    row = E.summarize_retrieval(E.evaluate_retrieval(labelled, hits)).first()
    assert tuple(row) == pytest.approx((0.5, 0.75, (1 + 1 / 3) / 4, (0.7 + 1.3 / 3 + 0.3) / 4, 4))
    empty = E.summarize_retrieval(E.evaluate_retrieval(labelled.limit(0), hits)).first()
    assert tuple(empty) == (None, None, None, None, 0)


def test_sweep_counts_queries_without_hits(spark, labelled, hits):
    ranked = hits.withColumn("alpha", F.lit(0.5))
    params = spark.createDataFrame([(0.5, 1), (0.5, 3), (0.9, 1)], "alpha double, k int")
    got = {(r.alpha, r.k): r for r in E.sweep_summary(labelled, ranked, params).collect()}
    whole = E.summarize_retrieval(E.evaluate_retrieval(labelled, hits)).first()
    names = ["hit_rate", "sub_hit_rate", "mrr", "avg_hybrid_score", "n_queries"]
    assert [got[0.5, 3][n] for n in names] == pytest.approx([whole[n] for n in names])
    assert [got[0.5, 1][n] for n in names] == pytest.approx([0.25, 0.5, 0.25, 2.2 / 4, 4])
    assert [got[0.9, 1][n] for n in names] == pytest.approx([0, 0, 0, 0, 4])


def metrics(spark, *values):
    names = [column for _, column in E.METRICS]
    return spark.createDataFrame([values], ", ".join(f"{n} double" for n in names))


def test_tiers(spark):
    rows = E.metric_table(metrics(spark, 0.75, 0.5, 0.4999, 0.125, 1.0, None)).orderBy("position")
    got = [(r.metric, r.shown, r.tier) for r in rows.collect()]
    assert got == [
        ("Hit Rate @K", "75%", "good"),
        ("Subcat Hit Rate", "50%", "ok"),
        ("MRR @K", "50%", "bad"),
        ("Avg Hybrid Score", "12%", "bad"),
        ("Faithfulness", "100%", "good"),
        ("Answer Relevance", None, None),
    ]


def test_advice(spark):
    def given(*values):
        return [r.position for r in E.advice(metrics(spark, *values)).orderBy("position").collect()]

    assert given(0.8, 0.0, 0.7, 0.0, 0.8, 0.8) == [0]
    assert given(0.79, 0.0, 0.7, 0.0, 0.8, 0.1) == [1, 4]
    assert given(0.1, 0.1, 0.1, 0.1, 0.1, 0.1) == [1, 2, 3, 4]
    assert given(None, None, None, None, None, None) == [0]


def test_generation(spark, labelled):
    extracted = spark.createDataFrame(
        [(0, "A", None)], "query_id long, category string, subcategory string"
    )
    judged = spark.createDataFrame(
        [(1, "ok", 0.5, "f", 1.0, "r")],
        "query_id long, status string, faithfulness double, faithfulness_reason string, "
        "answer_relevance double, relevance_reason string",
    )
    rows = E.evaluate_generation(labelled, extracted, judged)
    got = {r.query_id: tuple(r)[2:] for r in rows.collect()}
    assert got[0] == ("A", "", 0.0, 0.0, "", "")
    assert got[1] == ("", "", 0.5, 1.0, "f", "r")
    summary = E.summarize_judgements(judged.union(judged.selectExpr(
        "9L", "'parse_error'", "1.5D", "'x'", "0.0D", "'y'"
    ))).first()
    assert tuple(summary) == (1.0, 0.5, 1, 1, 2)


def test_breakdown_cells(spark):
    row = spark.range(1).select(
        D.preview(F.lit("abcdef"), 4),
        D.preview(F.lit("ab"), 4),
        D.number(F.lit(0.125), 2),
        D.percent(F.lit(0.125)),
        D.mark(F.lit(True)),
        D.mark(F.lit(False)),
        D.confidence_tier(F.lit("High")),
        D.confidence_tier(F.lit("high")),
        D.confidence_tier(F.lit(None).cast("string")),
        D.clamped(F.lit(1.2)),
        D.clamped(F.lit(-0.2)),
        D.numbered_steps(F.lit("1. Do 2.5 things. 2. Wait. 10. Call us.")),
    )
    assert list(row.first()) == [
        "abcd...", "ab...", "0.12", "12%", "✅", "❌", "high", "low", "low", 1.0, -0.2,
        ["1. Do 2.5 things.", "2. Wait.", "10. Call us."],
    ]


def test_prompts(spark):
    hits = spark.createDataFrame(
        [
            (1, 2, "B", "b", None, "issue 2", "steps 2"),
            (1, 1, "A", "a", "Checkout", "issue 1", None),
        ],
        "query_id long, rank int, category string, subcategory string, journey_stage string, "
        "issue_description string, resolution_steps string",
    )
    context = P.context_block(hits).first().context
    assert context == (
        "\n[1] Category: A > a\n    Stage: Checkout\n    Issue: issue 1\n    Resolution: \n"
        "\n[2] Category: B > b\n    Stage: \n    Issue: issue 2\n    Resolution: steps 2\n"
    )
    judge = P.judge_context(hits).first().judge_context
    assert judge == "[A > a]: issue 1 | \n[B > b]: issue 2 | steps 2"
    queries = spark.createDataFrame([(1, "help"), (2, "none")], "query_id long, text string")
    got = {r.query_id: r.prompt for r in P.triage_prompts(queries, hits).collect()}
    assert '"""help"""' in got[1] and context in got[1]
    assert got[2].endswith("best first:\n\nNow give that one object.")


def test_classified(spark):
    queries = spark.createDataFrame(
        [(1, " \n\t"), (2, "help"), (3, "more")], "query_id long, text string"
    )
    extracted = spark.createDataFrame(
        [(1, "ok", "A", "a", "s", "High", "x", ["1"]), (2, "ok", None, "b", None, None, None, [])],
        "query_id long, status string, category string, subcategory string, journey_stage string, "
        "confidence string, summary string, resolution_steps array<string>",
    )
    rows = H.classified(queries, extracted).collect()
    assert [tuple(r) for r in rows] == [
        (2, "help", "ok", "—", "b", "—", "Low", "", [], "low")
    ]


def test_report_cells_without_separators_and_with_missing_categories(spark):
    row = spark.range(1).select(D.number(F.lit(1234.5), 2), D.number(F.lit(0.125), 2), D.percent(F.lit(12.345)))
    assert list(row.first()) == ["1234.50", "0.12", "1234%"]
    report = spark.createDataFrame(
        [("c", "A", "a", ["A", None, "B"], True, False, 1.0, 0.5)],
        "complaint string, expected_category string, expected_subcategory string, retrieved_categories array<string>, "
        "hit boolean, sub_hit boolean, reciprocal_rank double, avg_hybrid_score double",
    )
    assert E.retrieval_breakdown(report).first()["Retrieved Categories"] == "A, -, B"

"""The pipeline and the queries of the subpackage."""

import pytest
from compare import connect, differences
from llm_cases import SF_DIR, awkward, empty, real
from pyspark.sql import functions as F
from test_llm_similar import expected_components

import corpus_pipeline
from helpgrid.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    columns, extra, lacking, *_ = differences(spark, connect(SF_DIR), QUERIES[name], ORACLE[name], SF_DIR)
    assert not columns and not extra and not lacking


def test_every_operator_has_a_query():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14))


def test_stages_keep_the_columns(spark):
    for make in (awkward, empty):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF_DIR).columns == docs.columns, name


CLASHING = ("_k1", "_k2", "_lines", "_every", "removed", "n_lines", "n_removed", "_row", "row", "doc", "_id", "_hash", "_key", "hash", "id", "_may", "_h")


def test_columns_of_any_name_keep_their_values(spark):
    given = awkward(spark).withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1))) for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, given, SF_DIR)
        rows = done.collect()
        assert rows and len(set(done.columns)) == len(done.columns), name
        for row in rows:
            number = -1 if row.doc_id is None else row.doc_id
            assert all(row[c] == f"{c}{number}" for c in CLASHING), name


def test_near_dedup_keeps_one_of_each_group(spark):
    docs = real(spark).unionByName(real(spark).limit(20))  # rows that repeat
    groups = {}
    for doc_id, _, component in expected_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80):
        groups.setdefault(component, set()).add(doc_id)
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF_DIR).collect()]
    assert sorted(kept) == sorted(min(g) for g in groups.values())


def test_run(spark):
    docs = real(spark)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.count(), stage(spark, docs, SF_DIR)
        assert 0 < docs.count() <= before, name
    assert sorted(corpus_pipeline.run(spark, SF_DIR).select(docs.columns).collect()) == sorted(docs.collect())

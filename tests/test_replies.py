import json

import pytest
from pyspark.sql import functions as F

from helpgrid.functions import replies as R
from helpgrid.operators import replies as M

FENCE = "```"
# raw reply, text after fence removal, kind of JSON value or None
CASES = [
    ('{"category":"A"}', '{"category":"A"}', "object"),
    (f'{FENCE}json\n{{"category":"A"}}\n{FENCE}', '\n{"category":"A"}\n', "object"),
    (f'{FENCE}\n{{"category":"A"}}\n{FENCE}', '\n{"category":"A"}\n', "object"),
    (f' \n\t{FENCE}json\n{{"category":"A"}}\n{FENCE}\n', '\n{"category":"A"}\n', "object"),
    (f"{FENCE}JSON\n{{}}\n{FENCE}", "JSON\n{}\n", None),
    (f"{FENCE} json\n{{}}\n{FENCE}", " json\n{}\n", None),
    (f'{FENCE}json\n{{"a":"x {FENCE} y"}}\n{FENCE}', '\n{"a":"x ', None),
    ('{"category":"A"} trailing', '{"category":"A"} trailing', None),
    ('{"category":"A"},{"category":"B"}', '{"category":"A"},{"category":"B"}', None),
    ('[{"category":"A"},{"category":"B"}]', '[{"category":"A"},{"category":"B"}]', "array"),
    ("[]", "[]", "array"),
    ("{}", "{}", "object"),
    ("", "", None),
    ("   ", "", None),
    ("json", "json", None),
    (FENCE, "", None),
    (f"{FENCE}json", "", None),
    ('{"resolution_steps":"one"}', '{"resolution_steps":"one"}', "object"),
    ('{"a":1}], junk', '{"a":1}], junk', None),
    ('{"a":1}}, junk', '{"a":1}}, junk', None),
    ("1}, junk", "1}, junk", None),
    ("1] , [2", "1] , [2", None),
    ('1, "value": 2', '1, "value": 2', None),
    ('1}, {"value": 2', '1}, {"value": 2', None),
    ("12", "12", "other"),
    ('"text"', '"text"', "other"),
    ("null", "null", "other"),
    ('{"a": [1, {"b": "]}"}]}', '{"a": [1, {"b": "]}"}]}', "object"),
    ("{'a': 1}", "{'a': 1}", None),
]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(i, r) for i, (r, _, _) in enumerate(CASES)] + [(999, None)]
    return spark.createDataFrame(rows, "query_id long, raw string")


def test_fences_and_strict_json(raw):
    value = F.col("value")
    kind = (
        F.when(R.is_object(value), "object")
        .when(R.is_array(value), "array")
        .when(value.isNotNull(), "other")
    )
    got = {r[0]: (r[1], r[2]) for r in M.parsed(raw).select("query_id", "payload", kind).collect()}
    for i, (text, payload, expected) in enumerate(CASES):
        assert got[i] == (payload, expected), text
        try:
            found = json.loads(payload)
            names = {dict: "object", list: "array"}
            assert names.get(type(found), "other") == expected, text
        except json.JSONDecodeError:
            assert expected is None, text
    assert got[999] == (None, None)


def test_responses(raw):
    got = {r.query_id: r for r in M.extract_responses(raw).collect()}
    for i, (_, payload, kind) in enumerate(CASES):
        row = got[i]
        if kind == "object":
            assert row.status == "ok"
        else:
            assert row.status == "fallback"
            assert (row.category, row.subcategory, row.journey_stage) == ("Unknown",) * 3
            assert (row.confidence, row.summary) == ("Low", "Could not parse response.")
            assert row.resolution_steps == [payload]
    assert got[0].category == "A" and got[0].summary is None and got[0].resolution_steps == []
    assert got[17].resolution_steps == ["one"]


def test_judgements(spark):
    rows = [
        (0, '{"faithfulness":0.5}', "ok"),
        (1, "no json", "ok"),
        (2, None, "error"),
        (3, '[{"faithfulness":1}]', "ok"),
        (4, '{"faithfulness":1.5,"faithfulness_reason":"r","answer_relevance":1,'
            '"relevance_reason":"s"}', "ok"),
        (5, '{"faithfulness":1}', "error"),
    ]
    given = spark.createDataFrame(rows, "query_id long, raw string, status string")
    got = {r.query_id: tuple(r)[1:] for r in M.extract_judgements(given).collect()}
    assert got == {
        0: ("ok", 0.5, "", 0.0, ""),
        1: ("parse_error", 0.0, "Parse error", 0.0, "Parse error"),
        2: ("error", 0.0, "Error", 0.0, "Error"),
        3: ("parse_error", 0.0, "Parse error", 0.0, "Parse error"),
        4: ("ok", 1.5, "r", 1.0, "s"),
        5: ("error", 0.0, "Error", 0.0, "Error"),
    }


def test_articles_and_missing_keys(spark):
    rows = [
        (0, '[{"category":"A","issue_description":"i","more":1},{"category":null}]'),
        (1, '{"category":"bare"}'),
        (2, "[]"),
        (3, f'{FENCE}json\n[{{"subcategory":"s","category":"B"}}]\n{FENCE}'),
    ]
    given = spark.createDataFrame(rows, "batch_id long, raw string")
    got = sorted(tuple(r) for r in M.extract_articles(given).collect())
    # no article has a stage or steps; some lack the subcategory or the issue
    assert got == [
        (0, 0, "A", None, "", "i", ""),
        (0, 1, None, None, "", None, ""),
        (3, 0, "B", "s", "", None, ""),
    ]


def test_numbered_steps(spark):
    given = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id long, steps array<string>")
    rows = [tuple(r) for r in M.numbered(given, "steps").orderBy("step").collect()]
    assert rows == [(1, 1, "a"), (1, 2, "b")]


def test_status_counts(raw):
    got = {r.status: r.n for r in M.status_counts(M.extract_responses(raw)).collect()}
    good = sum(kind == "object" for _, _, kind in CASES)
    assert got == {"ok": good, "fallback": len(CASES) + 1 - good}


def test_extraction_stays_in_the_jvm(raw):
    plan = M.extract_responses(raw)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan

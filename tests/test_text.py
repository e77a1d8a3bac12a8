import pytest
from brute import terms_of

from helpgrid.functions import text as X

CASES = [
    ("café über naïve", ["café", "über", "naïve"]),
    ("₹1,200 charged", ["200", "charged"]),
    ("Don't", ["don"]),
    ("a_b", ["a_b"]),
    ("3-5", []),
    ("", []),
    (None, []),
    ("The and of", []),
    ("refund", ["refund"]),
    ("paid don paid", ["paid", "don", "paid"]),
]


def test_stop_words():
    words = X.english_stop_words()
    assert len(words) == len(set(words)) == 318
    assert "paid" not in words and "the" in words


def test_words(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string")
    got = {r.id: r.words for r in X.with_words(df, "text").collect()}
    assert [got[i] for i in range(len(CASES))] == [words for _, words in CASES]


def test_other_stop_words(spark):
    df = spark.createDataFrame([("it's an o'clock refund",)], "text string")
    assert X.with_words(df, "text", []).first().words == ["it", "an", "clock", "refund"]
    assert X.with_words(df, "text", ["refund", "o'c"]).first().words == ["it", "an", "clock"]


@pytest.mark.parametrize(
    "text",
    ["refund", "refund refund", "late parcel late parcel late", "b b a a b b a", "", "the", None]
    + ["x1 " * 500 + "y2 " * 300, "Zug zug ZUG Äpfel äpfel"],
)
def test_term_counts(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    row = X.with_term_counts(df, "text").first()
    assert row.terms == sorted(row.terms, key=lambda t: t.encode())
    assert dict(zip(row.terms, row.counts)) == dict(terms_of(text or ""))


def test_corpus_text_leaves_out_the_stage(spark):
    df = spark.createDataFrame(
        [("A", None, "Stage", "issue", None), (None, "b", "Stage", None, "steps")],
        "category string, subcategory string, journey_stage string, issue_description string, "
        "resolution_steps string",
    )
    assert [r[0] for r in df.select(X.corpus_text()).collect()] == ["A  issue ", " b  steps"]


def test_strip(spark):
    df = spark.createDataFrame([(" \t\r\n a b\n",)], "text string")
    assert df.select(X.strip(df.text)).first()[0] == "a b"

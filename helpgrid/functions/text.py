"""Corpus text, tokens and term counts, as expressions evaluated row by row in the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Runs of two or more Unicode word characters. Java's \w covers ASCII only.
WORD = r"[\p{L}\p{N}_]{2,}"

# What Python's str.strip() removes from the texts at hand; Spark's trim() removes spaces only.
BLANKS = " \t\n\r"


@cache
def english_stop_words() -> tuple[str, ...]:
    text = resources.files(__package__).joinpath("english_stop_words.txt").read_text("utf-8")
    return tuple(
        word
        for line in text.splitlines()
        if not line.startswith("#")
        for word in line.split()
    )


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def corpus_text() -> Column:
    """Category, subcategory, issue and resolution; nulls count as empty, the stage is left out."""
    fields = ("category", "subcategory", "issue_description", "resolution_steps")
    parts: list[Column] = []
    for name in fields:
        parts += [F.lit(" "), F.coalesce(F.col(name), F.lit(""))]
    return F.concat(*parts[1:])


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def without_stop_words(tokens: str, stop_words: Iterable[str]) -> Column:
    """The array column ``tokens`` less the stop words. As SQL, the list crosses to the JVM once."""
    listed = ", ".join("'" + word.replace("'", r"\'") + "'" for word in stop_words)
    if not listed:
        return F.col(tokens)
    return F.expr(f"filter(`{tokens}`, word -> word NOT IN ({listed}))")


def with_bigrams(tokens: Column) -> Column:
    """The tokens followed by every pair of neighbours, joined by one space."""
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.size(tokens) - 1),
        F.slice(tokens, F.lit(2), F.size(tokens) - 1),
        lambda left, right: F.concat(left, F.lit(" "), right),
    )
    return F.when(F.size(tokens) > 1, F.concat(tokens, pairs)).otherwise(tokens)


def with_words(df: DataFrame, text: str, stop_words: Iterable[str] | None = None) -> DataFrame:
    """Adds ``words``: the tokens of ``text`` that are not stop words, in order."""
    stop = english_stop_words() if stop_words is None else stop_words
    return df.withColumn("words", words(F.coalesce(F.col(text), F.lit("")))).withColumn(
        "words", without_stop_words("words", stop)
    )


def with_term_counts(
    df: DataFrame, text: str, stop_words: Iterable[str] | None = None
) -> DataFrame:
    """Adds ``terms`` (distinct words and bigrams, sorted) and ``counts`` in step with them.

    Counting runs inside the row, by sorting the terms and measuring the runs of equal ones, so a
    text is never exploded and shuffled only to be grouped again.
    """
    last = F.size("sorted_terms")
    starts = F.when(
        last > 0,
        F.filter(
            F.sequence(F.lit(1), last),
            lambda i: (i == 1)
            | (F.get("sorted_terms", i - 1) != F.get("sorted_terms", i - 2)),
        ),
    ).otherwise(F.array().cast("array<int>"))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(last + 1))
    return (
        with_words(df, text, stop_words)
        .withColumn("sorted_terms", F.sort_array(with_bigrams(F.col("words"))))
        .withColumn("starts", starts)
        .withColumn("terms", F.transform("starts", lambda i: F.get("sorted_terms", i - 1)))
        .withColumn(
            "counts",
            F.when(
                F.size("starts") > 0, F.zip_with(ends, "starts", lambda end, start: end - start)
            ).otherwise(F.array().cast("array<int>")),
        )
        .drop("words", "sorted_terms", "starts")
    )

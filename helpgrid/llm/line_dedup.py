"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A run of consecutive lines is long enough when it has ``min_lines`` lines or ``min_words`` words. The
shortest long-enough runs that start at a line, or end at it, are its windows. Each window selects the
least of its line hashes as fingerprint, so two documents that share any long-enough run share a fingerprint.

1. Every document gives its windows and its distinct fingerprints.
2. Fingerprints that occur at two places or more are joined back: only their windows go on.
3. Of equal windows, the first by (doc_id, line) stays and the later ones are repeated. The windows from a line on
   extend a match forwards and those up to a line extend it backwards, so together they cover the whole of
   every repeated run.
4. The lines of later repeated runs are deleted.

Every join has one row a key on one side, and every count is pre-aggregated, so a line that stands in a third of
all documents is one row a task in a count and a skewed join otherwise, which adaptive execution splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpgrid.llm.common import documents, keyed, stored

MIN_LINES, MIN_WORDS = 3, 50
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"^[\x20\x09-\x0D]*$"


def _lines(text):
    """The lines of a text that are not blank, with their place among all its lines."""
    every = F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")
    numbered = F.transform(every, lambda line, i: F.struct(line.alias("line"), i.alias("at")))
    return F.filter(numbered, lambda x: ~x["line"].rlike(BLANK))


def _windows(keyed: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(_k1, _k2, windows): the windows of each document, as (at, n, k1, k2, mark, mark_at)."""
    rows = keyed.select("_k1", "_k2", _lines(F.col("text")).alias("lines")).select(
        "_k1",
        "_k2",
        F.transform("lines", lambda x: F.xxhash64(F.trim(x["line"]))).alias("a"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(1), F.trim(x["line"]))).alias("b"),
        F.transform("lines", lambda x: F.regexp_count(x["line"], F.lit(WORD))).alias("w"),
    )

    def words(start, n):
        parts = [F.coalesce(F.get(F.col("w"), start + i), F.lit(0)) for i in range(n)]
        return reduce(lambda x, y: x + y, parts)

    def window(start, n):
        a = F.slice("a", start + 1, n)
        marks = F.transform(a, lambda h, i: F.struct(h.alias("mark"), (start + i).alias("mark_at")))
        mark = F.array_min(marks)
        return F.struct(
            start.alias("at"),
            n.alias("n"),
            F.xxhash64(a).alias("k1"),
            F.xxhash64(F.slice("b", start + 1, n)).alias("k2"),
            mark["mark"].alias("mark"),
            mark["mark_at"].alias("mark_at"),
        )

    def length(first_of):
        """The least number of lines that make a run long enough; null if none does."""
        tried = F.lit(None).cast("int")
        for n in range(min_lines, 0, -1):
            enough = F.lit(True) if n == min_lines else words(first_of(n), n) >= min_words
            inside = (first_of(n) >= 0) & (first_of(n) + n <= F.size("a"))
            tried = F.when(inside & enough, F.lit(n)).otherwise(tried)
        return tried

    at = F.transform("a", lambda _, i: i)
    forward = F.transform(at, lambda i: F.struct(i.alias("s"), length(lambda n: i).alias("n")))
    backward = F.transform(at, lambda i: F.struct(i.alias("e"), length(lambda n: i - n + 1).alias("n")))
    backward = F.transform(backward, lambda x: F.struct((x["e"] - x["n"] + 1).alias("s"), x["n"].alias("n")))
    spans = F.array_distinct(F.filter(F.concat(forward, backward), lambda x: x["n"].isNotNull()))
    return rows.withColumn("spans", spans).select(
        "_k1", "_k2", F.transform("spans", lambda x: window(x["s"], x["n"])).alias("windows")
    )


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(_k1, _k2, removed): for each document that repeats an earlier run, the places of the lines to delete
    among its lines that are not blank."""
    windows = stored(_windows(keyed(docs), min_lines, min_words).dropDuplicates(["_k1", "_k2"]), "windows")
    marks = windows.select(
        F.explode(F.array_distinct(F.transform("windows", lambda x: F.struct(x["mark"], x["mark_at"])))).alias("m")
    ).select("m.mark")
    shared = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select("mark")
    open_ = stored(
        windows.select("_k1", "_k2", F.explode("windows").alias("x"))
        .select("_k1", "_k2", "x.*")
        .join(shared.hint("merge"), "mark")
        .select("_k1", "_k2", "at", "n", "k1", "k2"),
        "open-windows",
    )
    first = (
        open_.groupBy("k1", "k2")
        .agg(F.min(F.struct("_k1", "_k2", "at")).alias("first"), F.count(F.lit(1)).alias("places"))
        .where("places > 1")
        .drop("places")
    )
    later = open_.join(first.hint("merge"), ["k1", "k2"]).where(F.struct("_k1", "_k2", "at") > F.col("first"))
    return (
        later.select("_k1", "_k2", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("line"))
        .groupBy("_k1", "_k2")
        .agg(F.collect_set("line").alias("removed"))
    )


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines of later repeated runs deleted from ``text``, and what was done in ``n_lines``,
    ``n_removed`` and ``removed`` (places, counted over lines that are not blank).

    A run is repeated when the same lines, apart from spaces at their ends, stand at an earlier (doc_id, line): in
    a smaller doc_id or further up in the same document; a null doc_id comes first. Blank lines count for nothing and
    are never deleted. A null text stays null. Rows that repeat id and text are one document and get the same text.
    Columns of ``docs`` under the three names are replaced.
    """
    rows = keyed(docs.drop("n_lines", "n_removed", "removed"))
    removed = repeated_lines(docs, min_lines, min_words)
    every = F.split("text", "\n")
    lines = _lines(F.col("text"))
    deleted = F.transform("removed", lambda i: F.element_at(F.col("_lines"), i + 1)["at"])
    kept = F.array_except(F.sequence(F.lit(0), F.size(F.col("_every")) - 1), deleted)
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at(F.col("_every"), i + 1)), "\n")
    )
    return (
        rows.join(removed, ["_k1", "_k2"], "left")
        .withColumns({"_every": every, "_lines": lines})
        .withColumns({"text": text, "n_lines": F.size("_lines").cast("long")})
        .withColumn("removed", F.array_sort(F.coalesce("removed", F.array().cast("array<int>"))))
        .withColumn("n_removed", F.size("removed").cast("long"))
        .drop("_k1", "_k2", "_every", "_lines")
    )


def op1_line_dedup(spark, sf_dir):
    done = dedup_lines(documents(spark, sf_dir))
    return done.select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256"),
    )


OP1_SQL = r"""
WITH every AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
    FROM documents
), lines AS (
    SELECT doc_id, place, trim(line, ' ') AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w,
           row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS pos
    FROM every WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), near AS (
    SELECT *, lead(line) OVER d AS l1, lead(line, 2) OVER d AS l2, lead(w) OVER d AS w1,
           lag(line) OVER d AS p1, lag(line, 2) OVER d AS p2, lag(w) OVER d AS v1
    FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), windows AS (
    SELECT doc_id, pos,
           CASE WHEN w >= 50 THEN 1 WHEN l1 IS NOT NULL AND w + w1 >= 50 THEN 2 WHEN l2 IS NOT NULL THEN 3 END AS n,
           CASE WHEN w >= 50 THEN [line] WHEN l1 IS NOT NULL AND w + w1 >= 50 THEN [line, l1] ELSE [line, l1, l2] END AS run
    FROM near
    UNION
    SELECT doc_id, pos - n + 1, n, run FROM (
        SELECT doc_id, pos,
               CASE WHEN w >= 50 THEN 1 WHEN p1 IS NOT NULL AND w + v1 >= 50 THEN 2 WHEN p2 IS NOT NULL THEN 3 END AS n,
               CASE WHEN w >= 50 THEN [line] WHEN p1 IS NOT NULL AND w + v1 >= 50 THEN [p1, line] ELSE [p2, p1, line] END AS run
        FROM near)
), ranked AS (
    SELECT doc_id, pos, n, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS turn FROM windows WHERE n IS NOT NULL
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM ranked WHERE turn > 1
), marked AS (
    SELECT e.doc_id, e.place, e.line, l.pos, g.pos IS NOT NULL AS gone
    FROM every e LEFT JOIN lines l USING (doc_id, place) LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
)
SELECT doc_id, count(pos) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE gone), '') AS removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""

import pytest
from helpgrid.schemas import ARTICLE_FIELDS
from helpgrid.session import scratch_path
from helpgrid.sources import tables as IO

ROWS = [
    (0, "A", 'say "hi", then', "s", " blanks kept ", "1. One.\n2. Two.\r\n3. Three."),
    (1, None, "NA", "null", "None", ""),
    (2, "B", "x", "", "comma, comma", '"'),
    (3, "\\", "back\\slash", "\\n", "é ü ₹", "\t"),
]


def frame(spark):
    return spark.createDataFrame(
        ROWS, "kb_id long, " + ", ".join(f"{name} string" for name in ARTICLE_FIELDS)
    )


def empty_to_none(rows):
    return sorted((tuple(None if x == "" else x for x in row) for row in rows), key=lambda r: r[0])


@pytest.mark.parametrize("parts", [1, 3])
def test_csv_round_trip(spark, parts):
    path = scratch_path(spark, "kb")
    IO.write_articles(frame(spark).repartition(parts), path, "overwrite", "csv")
    got = IO.read_articles_csv(spark, path, with_key=True)
    assert sorted(tuple(r) for r in got.collect()) == empty_to_none(ROWS)


def test_foreign_csv(spark, tmp_path):
    """As other programs write it: quotes only where needed, doubled inside."""
    path = tmp_path / "kb.csv"
    path.write_text(
        ",".join(ARTICLE_FIELDS) + '\nA,b,c,"one, ""two""\nthree",4\nB,,NA,12,"1. x. 2. y."\n',
        encoding="utf-8",
    )
    got = [tuple(r) for r in IO.read_articles_csv(spark, str(path)).orderBy("kb_id").collect()]
    assert got == [
        (0, "A", "b", "c", 'one, "two"\nthree', "4"),
        (1, "B", None, "NA", "12", "1. x. 2. y."),
    ]


def test_labelled(spark, tmp_path):
    path = tmp_path / "cases.csv"
    path.write_text("complaint,expected_category,expected_subcategory\nhelp,A,a\nmore,B,b\n")
    want = [(0, "help", "A", "a"), (1, "more", "B", "b")]
    assert [tuple(r) for r in IO.read_labelled_csv(spark, str(path)).orderBy("query_id").collect()] == want
    cases = [("help", "A", "a"), ("more", "B", "b")]
    assert [tuple(r) for r in IO.labelled_queries(spark, cases).collect()] == want


def test_positions_over_files(spark, tmp_path):
    """Files count in the order of their paths, whatever their sizes, and rows as they stand in them."""
    sizes = [3, 40, 0, 1, 17]
    wanted = []
    for number, size in enumerate(sizes):
        names = [f"f{number}-{i}" for i in range(size)]
        wanted += names
        rows = [f'{name},"line\nbreak, {name}",x,"say ""hi""",' for name in names]
        (tmp_path / f"part-{number}.csv").write_text("\n".join([",".join(ARTICLE_FIELDS), *rows]) + "\n")
    got = IO.read_articles_csv(spark, str(tmp_path)).orderBy("kb_id").collect()
    assert [r.kb_id for r in got] == list(range(len(wanted)))
    assert [r.category for r in got] == wanted
    assert got[5].subcategory == f"line\nbreak, {wanted[5]}" and got[5].resolution_steps is None


def test_ordered_files_are_as_many_as_the_text_needs(monkeypatch, spark, tmp_path):
    """A task reads one file, so files must not grow with the table."""
    monkeypatch.setattr(IO, "FILE_BYTES", 1000)
    rows = [(i, f"c{i}", None, "", f"line\nbreak {i}", "x" * 20) for i in range(300)]
    given = spark.createDataFrame(rows[::-1], "kb_id long, category string, subcategory string, journey_stage string, issue_description string, resolution_steps string")
    IO.write_ordered_csv(given, str(tmp_path / "kb"), "kb_id", ARTICLE_FIELDS)
    sizes = [p.stat().st_size for p in (tmp_path / "kb").glob("part-*.csv")]
    assert len(sizes) >= 10 and max(sizes) < 3 * 1000
    got = IO.read_articles_csv(spark, str(tmp_path / "kb")).orderBy("kb_id").collect()
    assert [(r.kb_id, r.category, r.subcategory) for r in got] == [(i, f"c{i}", None) for i in range(300)]


def test_append_and_overwrite(spark):
    path = scratch_path(spark, "kb")
    IO.write_articles(frame(spark), path, "overwrite")
    IO.write_articles(frame(spark).select("kb_id", "category"), path, "append")
    got = spark.read.parquet(path)
    assert got.count() == 8 and got.where("subcategory = ''").count() == 4
    IO.write_articles(frame(spark), path, "overwrite")
    assert spark.read.parquet(path).count() == 4
    with pytest.raises(ValueError):
        IO.write_articles(frame(spark), path, "merge")


def test_vectors(spark):
    path = scratch_path(spark, "vectors")
    spark.createDataFrame([(7, [1.0, 2.0])], "vec_id long, v array<double>").write.parquet(path)
    vectors = IO.read_vectors(spark, path, "vec_id", "v")
    assert vectors.dtypes == [("kb_id", "bigint"), ("embedding", "array<float>")]
    queries = spark.createDataFrame([(7, "a"), (8, "b")], "query_id long, text string")
    got = {r.query_id: r.embedding for r in IO.attach_vectors(queries, vectors).collect()}
    assert got == {7: [1.0, 2.0], 8: None}

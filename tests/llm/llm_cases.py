"""Documents that are awkward in every way, for all operators."""

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "label string, key string, size int, taken int, target string, removed string, hash string, tails int"
)
EXTRA = ("x", "y", 7, 8, "z", "w", "v", 9)
RUN = "One line of the run.\nAnother line of the run.\nThe third line of the run."
LONG = " ".join(f"word{i % 977} Of{i}" for i in range(60_000))
TEXTS = [
    None,
    "",
    " \t\n\r\x0b\x0c ",
    "One",
    "one",
    "Twice The Same",
    "twice the same",
    "ÄÖ stays as it is",
    "äö stays as it is",
    RUN,
    "Before.\n" + RUN + "\nAfter.",
    RUN + "\n" + RUN,
    LONG,
    LONG + " and more",
    "mail a@b.co and 1.2.3.4 or +1 (555) 123-4567 or 4111 1111 1111 1111 end",
    "x" * 30_000,
    "1" * 30_000,
    "a b " * 5_000,
]


def rows():
    out = [(i, text, "en", f"s{i % 3}", len(text or ""), *EXTRA) for i, text in enumerate(TEXTS)]
    out += [(3, "One", None, None, None, *[None] * 8)] * 2  # rows that repeat id and text
    out += [(None, "no id", "en", "s0", 5, *EXTRA), (None, "no id", "en", "s0", 5, *EXTRA), (None, None, None, None, None, *[None] * 8)]
    return out


def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def real(spark, name="documents"):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")

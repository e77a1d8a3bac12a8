"""Benchmark decontamination by template canonicalisation.

Numbers, numbers with a unit and runs of name words become one typed placeholder each, other words are lower-cased
without punctuation. Windows of ``WIDTH`` such tokens are templates: a question with other numbers and names, also of
more or fewer words, has the same windows. Three views of a text differ in what is a name: capitalised words inside
sentences; those at the start of sentences, too; none, so that a copy in other case matches. Windows of the
documents are hash-joined with those of the benchmark, and what stood in the placeholders must fit: along one alignment
of a document with an item, the same value of the item must stand for the same value of the document. Windows of fewer
than ``LITERALS`` words that are no placeholder match by their values, word for word. An item of fewer words than that
matches a line, or a whole text, of the same words.

A filter of bounded size over the benchmark's window hashes goes to every task. Only windows that pass are
shuffled, so a corpus of clean documents moves next to nothing, however large the benchmark is.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpgrid.llm.common import HashFilter, WordCache, documents, hash_filter, keyed, mix, ship_package, stored, table, without

WIDTH = 8
LITERALS = 4  # words of a window that are no placeholder, at least
#: Windows in a row that make a document contaminated (a run of WIDTH + RUN - 1 words), or all that an item has.
RUN = 6
CHUNK = 1 << 16  # words of several texts that are hashed at once
PUNCTUATION = string.punctuation.encode()
NUMBER = re.compile(rb"[+-]?[0-9][0-9.,:/]*")
AMOUNT = re.compile(rb"([+-]?[0-9][0-9.,:/]*)([a-z%\xc2\xb0]+)")
#: The units, as fixed values.
UNITS = frozenset(
    b"mm cm m km in ft yd mi mg g kg lb oz t ml l gal s sec min h hr hrs ms mph kmh kph hz khz mhz ghz w kw kwh v a j kj cal "
    b"kcal k c f pa kpa bar mol usd eur gbp dollar dollars euro euros cent cents pound pounds percent meter meters metre "
    b"metres kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms ounce ounces liter liters "
    b"litre litres second seconds minute minutes hour hours day days week weeks month months year years degree degrees %".split()
)
NUM, AMOUNTS, NAMED = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"\x00num", b"\x00amount", b"\x00name"))
INSIDE, STARTS, CASELESS = VIEWS = range(3)
VERBATIM, LINE = 3, 4  # seeds of hashes of values
STEP = 0x9E3779B97F4A7C15
VALUE = (1 << 60) - 1


def classify(word: bytes) -> int:
    """The hash of a word without punctuation and case, whose last bits are flags: 1 a number, 2 a unit, both a number
    with its unit, 4 like a name, 8 ends a sentence. 0 for a word of punctuation alone."""
    core = word.strip(PUNCTUATION)
    if not core:
        return 0
    letters = core.decode("utf-8", "replace")
    low = letters.lower().encode()
    flags = 8 if word.rstrip(b"\"')]}").endswith((b".", b"!", b"?", b":")) else 0
    if NUMBER.fullmatch(low):
        flags |= 1
    elif (parts := AMOUNT.fullmatch(low)) and parts[2] in UNITS:
        number, unit = (xxhash.xxh64_intdigest(x) >> 4 for x in parts.groups())
        return (number + unit * STEP & VALUE) << 4 | flags | 3  # as of two words
    elif low in UNITS:
        flags |= 2
    elif letters.isalpha() and letters[0].isupper() and letters[1:].islower():
        flags |= 4
    return xxhash.xxh64_intdigest(low) >> 4 << 4 | flags


def tokens(codes: np.ndarray, view: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, value, slot, first) of texts that begin at ``starts``, in a view: what stands in templates, the hashed
    value, whether it is a placeholder, and its first word.

    A number and the unit after it are one token, and so are name words in a row inside one sentence.
    """
    value, flags = codes >> np.uint64(4), (codes & np.uint64(15)).astype(np.int64)
    before = np.concatenate([[8], flags[:-1]])
    before[starts] = 8
    kind = flags & 3
    unit = (kind == 2) & (before & 3 == 1)
    opens = before & 8 > 0
    name = (flags & 4 > 0) & (view != CASELESS) & (~opens | (view == STARTS))
    joined = unit | (name & np.concatenate([[False], name[:-1]]) & ~opens)
    first = np.flatnonzero(~joined)
    ends = np.append(first[1:], len(codes))
    place = np.arange(len(codes)) - np.repeat(first, ends - first)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.append(np.uint64(1), np.full(int(place.max()), STEP, np.uint64)), dtype=np.uint64)
        value = np.add.reduceat(value * powers[place], first) & np.uint64(VALUE)
    amount = (kind[first] == 3) | ((kind[first] == 1) & (ends - first > 1))
    token = np.select([amount, kind[first] == 1, name[first]], [AMOUNTS, NUM, NAMED], value)
    return token, value, amount | (kind[first] == 1) | name[first], first


def _rolled(token: np.ndarray, width: int, seed: int, at: np.ndarray | None = None) -> np.ndarray:
    """The hashes of all windows, or of those at the places ``at``."""
    n = len(token) - width + 1
    with np.errstate(over="ignore"):
        total = np.full(n if at is None else len(at), width + (seed << 8), np.uint64)
        for i in range(width):
            total *= np.uint64(STEP)
            total += token[i : n + i] if at is None else token[at + i]
    return mix(total)


def windows(codes: np.ndarray, owner: np.ndarray, widths: tuple[int, ...] | None = None, shared: HashFilter | None = None):
    """Tuples (view, width, owner, hash, at, lengths, slots, rich, total) of arrays for each view and width of several
    texts, only of windows that may be in the filter if there is one. ``owner`` numbers the text of each word. Slots are
    the hashed values in the windows' placeholders, one window after the other, as many as its length says. Of a
    single text, rich is the number of windows with ``LITERALS`` literal words and total that of all windows.

    Without ``widths`` there is one text, and one of fewer than ``WIDTH`` tokens has one window. Windows of fewer literals
    are hashed by their values, in the view without case, and have no slots.
    """
    many = np.bincount(owner)[owner] >= LITERALS
    codes, owner = codes[many], owner[many]
    if not len(codes):
        return
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    for view in VIEWS:
        token, value, slot, first = tokens(codes, view, starts)
        home = owner[first]
        begins = np.searchsorted(first, starts)  # the first token of each text
        begin = np.repeat(begins, np.diff(np.append(begins, len(token))))
        filled = np.concatenate([[0], np.cumsum(slot)])
        kept = value[slot].view(np.int64)
        for wide in widths or (min(WIDTH, len(token)),):
            n = len(token) - wide + 1
            if n < 1:
                continue
            whole = home[:n] == home[wide - 1 :]
            enough = wide - (filled[wide:] - filled[:n]) >= LITERALS
            hashes = _rolled(token, wide, view)
            if view == CASELESS:
                poor = np.flatnonzero(whole & ~enough)
                hashes[poor] = _rolled(value, wide, VERBATIM, poor)
                at = np.flatnonzero(whole)
            else:
                at = np.flatnonzero(whole & enough)
            rich, hashes = int((whole & enough).sum()), hashes[at]
            if shared is not None:
                on = shared.may_have(hashes)
                at, hashes = at[on], hashes[on]
            lengths = np.where(enough[at], filled[at + wide] - filled[at], 0)
            ends = np.cumsum(lengths)
            slots = kept[np.arange(lengths.sum()) + np.repeat(filled[at] - ends + lengths, lengths)]
            yield view, wide, home[at], hashes, at - begin[at], lengths, slots, rich, int(whole.sum())


def _lines(text: bytes, classes: WordCache, codes: np.ndarray, width: int | None, shared: HashFilter | None):
    """An item of fewer than ``LITERALS`` words as one window, or the lines of a document of so few words, of width 0."""
    lines = [codes]
    if width == 0:
        parts = (classes.values_of(x) for x in map(bytes.split, text.split(b"\n")) if x)
        lines += [x[x > 0] for x in parts]
    hashes = [_rolled(x >> np.uint64(4), len(x), LINE) for x in lines if 0 < len(x) < LITERALS]
    found = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]))
    if shared is not None:
        found = found[shared.may_have(found)]
    none = np.zeros(len(found), np.int64)
    yield CASELESS, 0, none, found, none, none, none[:0], 0, 1


def _rows(keys: list, parts: list[tuple]) -> pa.RecordBatch:
    """Rows of WINDOWS; ``parts`` are the tuples of ``windows``, whose owners number ``keys``."""
    empty = np.empty(0, np.int64)
    owner, hashes, places, lengths, slots = (
        np.concatenate([empty, *(part[i].view(np.int64) for part in parts)]) for i in range(2, 7)
    )
    repeated = [np.repeat([part[i] for part in parts], [len(part[3]) for part in parts]) for i in (0, 1, 7, 8)]
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys, pa.int64()).take(pa.array(owner)),
            pa.array(hashes),
            pa.array(places),
            pa.ListArray.from_arrays(offsets, pa.array(slots)),
            *(pa.array(x, pa.int64()) for x in repeated),
        ],
        names=["key", "hash", "at", "slots", "view", "width", "rich", "total"],
    )


def _item_windows(batches):
    """Rows of the windows of the benchmark's items."""
    classes = WordCache(classify)
    for batch in batches:
        keys, parts = batch.column("item_id").to_pylist(), []
        for i, text in enumerate(batch.column("text")):
            value = text.as_py() or b""
            codes = classes.values_of(value.split())
            codes = codes[codes > 0]
            found = _lines(value, classes, codes, None, None) if 0 < len(codes) < LITERALS else windows(codes, np.zeros(len(codes), np.int64))
            parts += [(view, wide, home + i, *rest) for view, wide, home, *rest in found]
        yield _rows(keys, parts)


def _document_windows(shared, widths: tuple[int, ...]):
    """Rows of the windows of documents that pass the filter; several texts are hashed at once, until they have ``CHUNK`` words."""
    wide = tuple(w for w in widths if w)

    def found(first: int, texts: list[bytes], classes: WordCache, words: list[bytes], counts: list[int]):
        codes = classes.values_of(words)
        owner = np.repeat(np.arange(first, first + len(counts)), counts)[codes > 0]
        codes = codes[codes > 0]
        yield from windows(codes, owner, wide, shared.value)
        if 0 in widths:  # some item has few words
            ends = np.searchsorted(owner, np.arange(first, first + len(counts) + 1))
            for i, text in enumerate(texts):
                for view, width, home, *rest in _lines(text, classes, codes[ends[i] : ends[i + 1]], 0, shared.value):
                    yield view, width, home + first + i, *rest

    def run(batches):
        classes = WordCache(classify)
        for batch in batches:
            keys = list(range(batch.num_rows))
            first, texts, words, counts = 0, [], [], []
            for i, text in enumerate(batch.column("text")):
                value = text.as_py() or b""
                own = value.split()
                texts.append(value)
                words += own
                counts.append(len(own))
                if len(words) < CHUNK and i + 1 < batch.num_rows:
                    continue
                out = _rows(keys, list(found(first, texts, classes, words, counts)))
                row = out.column("key")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_k1").take(row), batch.column("_k2").take(row), *(out.column(c) for c in ("hash", "at", "slots"))],
                    names=["_k1", "_k2", "hash", "at", "slots"],
                )
                first, texts, words, counts = i + 1, [], [], []

    return run


WINDOWS = "key long, hash long, at long, slots array<long>, view long, width long, rich long, total long"
SUSPECTS = "_k1 long, _k2 long, hash long, at long, slots array<long>"


def contaminated(docs: DataFrame, benchmark: DataFrame, run: int = RUN) -> DataFrame:
    """(_k1, _k2, doc_id, item_id, n_windows, coverage, reparameterised): the items found in each document.

    ``n_windows`` counts the item's windows that one alignment matches with consistent slots, ``coverage`` is
    their share. ``reparameterised`` says that some slot holds another value than the item's. A null or
    empty text matches nothing, nor does an item without words or with a null id. Rows of ``docs`` that repeat id and
    text give one result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text = F.col("text").cast("string").cast("binary").alias("text")
    items = stored(
        benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), text).mapInArrow(
            _item_windows, WINDOWS
        ),
        "benchmark-windows",
    )
    # An item of fewer tokens than a window has one window, as wide as it is: documents need that width as well.
    narrow = items.where(F.col("width") < WIDTH).select("width").distinct().collect()
    widths = (WIDTH, *sorted(x.width for x in narrow))
    distinct = items.select("hash").distinct()
    shared = spark.sparkContext.broadcast(hash_filter(distinct, distinct.count()))
    rows = keyed(docs.select("doc_id", "text")).select("_k1", "_k2", text)
    found = stored(rows.mapInArrow(_document_windows(shared, widths), SUSPECTS), "suspect-windows")
    met = found.withColumnRenamed("slots", "theirs").join(
        items.select("hash", F.col("key").alias("item_id"), F.col("at").alias("item_at"), "slots", "view", "rich", "total"), "hash"
    )
    aligned = met.select(
        "_k1", "_k2", "item_id", "view", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", "rich", "total", "slots", "theirs"
    ).distinct()
    place = ["_k1", "_k2", "item_id", "view", "shift"]
    pairs = aligned.select(*place, F.explode(F.arrays_zip("slots", "theirs")).alias("p")).select(*place, "p.*")
    values = pairs.groupBy(*place, "slots").agg(F.min("theirs").alias("low"), F.max("theirs").alias("high"))
    fits = values.groupBy(*place).agg(
        F.min((F.col("low") == F.col("high")).cast("int")).alias("fits"),
        F.max((F.col("low") != F.col("slots")).cast("int")).alias("other"),
    )
    literal = aligned.groupBy(*place).agg(
        F.count_distinct("item_at").alias("n_windows"),
        F.count_distinct(F.when(F.size("slots") == 0, F.col("item_at"))).alias("n_plain"),
        F.first(F.when(F.col("view") == INSIDE, F.col("rich")).otherwise(F.col("total"))).alias("total"),
    )
    judged = literal.join(fits, place, "left").select(
        *place,
        F.when(F.coalesce("fits", F.lit(1)) == 1, F.col("n_windows")).otherwise(F.col("n_plain")).alias("n_windows"),
        "total",
        ((F.coalesce("fits", F.lit(1)) == 1) & (F.coalesce("other", F.lit(0)) == 1)).alias("other"),
    )
    return (
        judged.where(F.col("n_windows") >= F.least(F.lit(run), F.col("total")))
        .groupBy("_k1", "_k2", "item_id")
        .agg(F.max(F.struct("n_windows", "total", "other")).alias("best"))
        .select(
            "_k1",
            "_k2",
            F.when(F.col("_k1") != F.lit(-(2**63)), F.col("_k1")).alias("doc_id"),
            "item_id",
            F.col("best.n_windows").alias("n_windows"),
            (F.col("best.n_windows") / F.col("best.total")).alias("coverage"),
            F.col("best.other").alias("reparameterised"),
        )
    )


def op8_decontamination(spark, sf_dir):
    """One row for each contaminated document; clean ones have none."""
    hits = contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return hits.groupBy("_k1", "_k2").agg(
        F.first("doc_id").alias("doc_id"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.max("n_windows").alias("n_windows"),
        F.max("coverage").alias("coverage"),
        F.max("reparameterised").alias("reparameterised"),
        F.lit(True).alias("contaminated"),
    ).drop("_k1", "_k2")


def decontaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item is found."""
    return without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))

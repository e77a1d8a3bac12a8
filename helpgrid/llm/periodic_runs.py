"""Periodic runs of words, found by recompression.

A slice of texts becomes one string of word numbers, with a separator of its own around every text.
Rounds of block compression (a stretch of one symbol becomes one symbol) and pair compression (the
alphabet is parted in two, and each left symbol before a right one becomes one symbol with it) turn it
into a run-length grammar. Both decide locally where symbols end, so equal stretches are cut
alike but at their ends. How far two places agree, forwards or backwards, is read off the grammar by
climbing from the words to longer symbols while they are equal, one step a level at most, and descending again.

Candidates lie on a harmonic grid: a run of period q spans at least ``m = max(6 - q, 3 q)`` places that
equal the word q further on, so one of the places 0, m, 2 m, ... is among them. That is about
``n log(n) / 3`` pairs of places for n words, for all periods together. Extending a pair both ways gives
the run; the same stretch found for a multiple of its period is dropped. Only texts with a pair that still climbs
get a higher level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpgrid.llm.common import documents, mix, ship_package
from helpgrid.llm.words import Words, word_slices

#: A run has at least this many words, and at least this many times its period.
LEAST, REPEATS = 6, 4
#: Pairs of places that are made, and that are extended, at a time.
MADE, EXTENDED = 1 << 19, 1 << 17

RUNS = "array<struct<start:long,length:long,period:long>>"


@dataclass
class Level:
    """One string of the grammar. ``opens`` marks the symbols that begin a symbol of the next level.

    Places are numbered by the symbol that follows. ``up`` gives a place of the next level (only where
    ``opens``), ``down`` the place here of each place there. ``begin`` and ``end`` enclose the block of
    each symbol; they are None where pairs are compressed.
    """

    symbols: np.ndarray
    opens: np.ndarray
    up: np.ndarray
    down: np.ndarray
    begin: np.ndarray | None
    end: np.ndarray | None

    def step(self, at: np.ndarray, back: np.ndarray) -> np.ndarray:
        """How many equal symbols follow (precede, where ``back``) each place inside their block."""
        if self.begin is None:
            return np.ones(len(at), np.int64)
        return np.where(back, at - self.begin[at - back], self.end[at - back] - at)


def _numbers(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, int]:
    """One number for each distinct pair, and how many there are."""
    codes, distinct = pd.factorize(left * (int(right.max()) + 1) + right)
    return codes.astype(np.int64), len(distinct)


def _compress(symbols: np.ndarray, free: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(opens, starts, symbols of the next level, least unused number). Even levels compress blocks."""
    opens = np.ones(len(symbols), bool)
    if number % 2 == 0:
        opens[1:] = symbols[1:] != symbols[:-1]
        starts = np.flatnonzero(opens)
        sizes = np.diff(np.append(starts, len(symbols)))
        longer = np.flatnonzero(sizes > 1)
        above = symbols[starts]
        if len(longer):
            codes, n = _numbers(above[longer], sizes[longer])
            above[longer], free = free + codes, free + n
        return opens, starts, above, free
    # A symbol's side is a hash bit; separators (below 0) have none. Of the two orders the one with more pairs is taken.
    odd = np.uint64(int(mix(np.array([number], np.uint64))[0]) | 1)
    with np.errstate(over="ignore"):
        side = (symbols.astype(np.uint64) * odd) >> np.uint64(63) == 0
    word = symbols >= 0
    here, there = side & word, ~side & word
    pairs = here[:-1] & there[1:]
    other = there[:-1] & here[1:]
    if other.sum() > pairs.sum():
        pairs = other
    opens[1:] = ~pairs
    starts = np.flatnonzero(opens)
    above = symbols[starts]
    first = np.flatnonzero(pairs)
    if len(first):
        codes, n = _numbers(symbols[first], symbols[first + 1])
        above[np.searchsorted(starts, first)], free = free + codes, free + n
    return opens, starts, above, free


class Grammar:
    """The texts of a slice as one string: separator, words of the first text, separator, ..., last separator."""

    def __init__(self, words: Words):
        n = len(words.bounds) - 1
        self.base = words.bounds[:-1] + np.arange(1, n + 1)  # the place of each text's first word
        self.symbols = np.empty(len(words.codes) + n + 1, np.int64)
        is_word = np.ones(len(self.symbols), bool)
        is_word[self.base - 1] = is_word[-1] = False
        self.symbols[is_word] = words.codes
        self.symbols[~is_word] = -1 - np.arange(n + 1)
        self.free = len(words.vocabulary)

    def extend(self, text: np.ndarray, i: np.ndarray, j: np.ndarray, back: np.ndarray) -> np.ndarray:
        """How many words agree after the places i < j of a text, or before them where ``back``."""
        i, j, start = i.copy(), j.copy(), i
        sign = np.where(back, -1, 1)
        stop = np.full(len(i), -1)
        active = np.arange(len(i))
        levels: list[Level] = []
        symbols, free = self.symbols, self.free
        while len(active):
            number = len(levels)
            opens, starts, above, free = _compress(symbols, free, number)
            block = np.cumsum(opens) - 1
            begin = end = None
            if number % 2 == 0:
                begin, end = starts[block], np.append(starts[1:], len(symbols))[block]
            level = Level(symbols, opens, block, starts, begin, end)
            levels.append(level)
            # climb
            a, b, way = i[active], j[active], back[active]
            same = symbols[a - way] == symbols[b - way]
            inside = same & ~(opens[a] & opens[b])
            step, other = level.step(a, way), level.step(b, way)
            moved = np.where(inside, np.minimum(step, other) * sign[active], 0)
            i[active], j[active] = a + moved, b + moved
            halts = ~same | (inside & (step != other))
            stop[active[halts]] = number
            active = active[~halts]
            # the next level keeps the texts that still have an active pair, and the separators around them
            keep = np.zeros(len(self.base) + 2, bool)
            keep[text[active] + 1] = True
            separator = above < 0
            own = -above[separator]  # the separator before text t is -1 - t
            kept = keep[own[np.cumsum(separator) - 1]]
            kept[separator] |= keep[own - 1]
            place = np.cumsum(kept) - 1
            level.up, level.down = place[block], starts[kept]
            i[active], j[active] = level.up[i[active]], level.up[j[active]]
            symbols = above[kept]
        for number in range(len(levels) - 2, -1, -1):
            level, above = levels[number], np.flatnonzero(stop > number)
            a, b, way = level.down[i[above]], level.down[j[above]], back[above]
            same = level.symbols[a - way] == level.symbols[b - way]
            moved = np.where(same, np.minimum(level.step(a, way), level.step(b, way)) * sign[above], 0)
            i[above], j[above] = a + moved, b + moved
        return np.abs(i - start)


def _pairs(sizes: np.ndarray):
    """(text, place, period) on the grid of each text, by rising period, in bounded runs."""
    longest = np.where(sizes >= LEAST, sizes // REPEATS, 0)
    text = np.repeat(np.arange(len(sizes)), longest)
    period = np.arange(len(text)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    order = np.argsort(period, kind="stable")
    text, period = text[order], period[order]
    space = np.maximum(LEAST - period, (REPEATS - 1) * period)
    count = (sizes[text] - period - 1) // space + 1
    done = np.concatenate(([0], np.cumsum(count)))
    low = 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(done, done[low] + MADE, side="right")) - 1)
        n = count[low:high]
        at = np.arange(done[high] - done[low]) - np.repeat(done[low:high] - done[low], n)
        yield np.repeat(text[low:high], n), at * np.repeat(space[low:high], n), np.repeat(period[low:high], n)
        low = high


class Found:
    """The runs found so far, as places in the grammar's string, and the longest one over each place."""

    def __init__(self, size: int):
        self.text = self.begin = self.end = self.period = np.empty(0, np.int64)
        self.over = np.full(size, -1)

    def covers(self, i: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether a pair only finds a known run again."""
        run = self.over[i]
        known = run >= 0
        out = np.zeros(len(i), bool)
        run = run[known]
        out[known] = (i[known] + period[known] < self.end[run]) & (period[known] % self.period[run] == 0)
        return out

    def add(self, text, begin, end, period) -> None:
        columns = [np.concatenate(x) for x in zip((self.text, self.begin, self.end, self.period), (text, begin, end, period))]
        order = np.lexsort((columns[3], columns[2], columns[1]))
        columns = [c[order] for c in columns]
        first = np.ones(len(order), bool)  # of one stretch the least period stays
        first[1:] = (np.diff(columns[1]) != 0) | (np.diff(columns[2]) != 0)
        self.text, self.begin, self.end, self.period = (c[first] for c in columns)
        for run in np.argsort(self.end - self.begin, kind="stable"):
            self.over[self.begin[run] : self.end[run]] = run


def find_runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run, by text, start and period."""
    grammar = Grammar(words)
    found = Found(len(grammar.symbols))
    held, size = [], 0

    def extend():
        text, i, period = (np.concatenate(x) for x in zip(*held))
        fresh = ~found.covers(i, period)
        text, i, period = text[fresh], i[fresh], period[fresh]
        if not len(text):
            return
        both = np.concatenate((i, i))
        far = np.concatenate((i + period, i + period))
        back = np.repeat([False, True], len(i))
        after, before = np.split(grammar.extend(np.concatenate((text, text)), both, far, back), 2)
        length = after + before + period
        run = length >= np.maximum(LEAST, REPEATS * period)
        begin = (i - before)[run]
        found.add(text[run], begin, begin + length[run], period[run])

    for text, place, period in _pairs(words.sizes):
        i = grammar.base[text] + place
        equal = np.flatnonzero(grammar.symbols[i] == grammar.symbols[i + period])
        text, i, period = text[equal], i[equal], period[equal]
        if size + len(text) > EXTENDED and held:
            extend()
            held, size = [], 0
        held.append((text, i, period))
        size += len(text)
    if held:
        extend()
    order = np.lexsort((found.period, found.begin))
    text = found.text[order]
    start = found.begin[order] - grammar.base[text] if len(text) else found.begin
    return text, start, (found.end - found.begin)[order], found.period[order]


def _kept(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """A text without what its runs repeat."""
    if len(start):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        words = map(words.__getitem__, np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist())
    return b" ".join(words)


def _collapse(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        given = pc.fill_null(batch.column("text"), "").cast(pa.large_binary())
        for first, n, words in word_slices(batch):
            text, start, length, period = find_runs(words)
            lists = (x.as_py().split() for x in given.slice(first, n))
            cut = np.searchsorted(text, np.arange(n + 1))
            texts = [_kept(x, *(c[a:b] for c in (start, length, period))) for x, a, b in zip(lists, cut, cut[1:])]
            offsets = pa.array(cut.astype(np.int32))
            runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, n), pa.ListArray.from_arrays(offsets, runs), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "runs", "collapsed"],
            )


def collapse_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) for every row of ``docs``: its periodic runs and its text without their repetitions.

    Words are runs of characters other than ASCII white space. A run (start, length, period) is a stretch of at
    least 6 words and 4 times its smallest period whose words equal the word one period further on, as long as it
    can be. ``collapsed`` leaves out what lies in a run after its first period; words are joined by one space.

    Nulls and texts without words have no runs and an empty ``collapsed``; a null doc_id stays null. Runs
    are listed by start, then period; of equal stretches the smallest period counts. Repeated rows give a row each, an
    empty table an empty result. Texts of any length are read whole, in memory in proportion to the longest one.
    Other columns are not read and may have any name.
    """
    ship_package(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_collapse, f"doc_id long, runs {RUNS}, collapsed string")


def with_repetitions(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where one document in ten goes on repeating some of its words from one of them on.

    With h the CRC-32 of the decimal doc_id and g = h div 10: if h mod 10 is 0, each word i >= a of n becomes
    word a + (i - a) mod p, where a = g mod n and p = 1 + (n - a) div (3 + g mod 8). A null doc_id changes nothing.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(10)) == 0, F.lit(False))
    words = given.withColumn("words", F.when(chosen, F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w != '')")))
    numbers = (
        words.withColumn("n", F.size("words"))
        .withColumn("g", F.expr("crc32(encode(cast(doc_id AS string), 'UTF-8')) div 10"))
        .withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n AS int)")))
        .withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) AS int)"))
    )
    changed = F.expr("array_join(transform(sequence(0, n - 1), i -> get(words, if(i < a, i, a + (i - a) % p))), ' ')")
    return numbers.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir):
    """Runs and collapsed texts of all documents, as digests, with one document in ten made repetitive first."""
    found = collapse_runs(with_repetitions(documents(spark, sf_dir)))
    line = "concat(r.start, ',', r.length, ',', r.period, '\\n')"
    longest = "array_min(transform(runs, r -> struct(-r.length AS l, r.start AS s, r.period AS p)))"
    return found.withColumn("best", F.expr(longest)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("(1000 * -best.l) div best.p").alias("exponent_milli"),
        F.sha2(F.encode(F.expr(f"array_join(transform(runs, r -> {line}), '')"), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )

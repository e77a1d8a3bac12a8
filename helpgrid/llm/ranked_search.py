"""Ranked lexical search of many items at once, by common-subexpression evaluation.

An item's score in a document is a sum over its terms, so items that share terms share partial sums. The
terms of every item of a block are put in one order (frequent in the block first) and the pair of neighbours that
most items have is replaced by a node of its own, again and again, until no pair occurs twice: each node
is a term set that several items share, made of two smaller ones. A batch of documents fills one accumulator
a term, adds each node's two children once, and an item is the sum of the nodes and terms that are left of it.

Documents are split once: the first pass writes the counts of the items' terms in each document, from which the
document frequencies follow; the second weighs and adds them up. All sums are in 64-bit integers. A task returns its best
documents of each item, and a window function ranks what the tasks return.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helpgrid.llm.common import documents, ship_package, stored, table
from helpgrid.llm.words import word_slices

TOP = 10
#: Terms of a text are at most its bytes; items are taken in passes of about this many bytes, which bounds a broadcast.
PASS_BYTES = 4 << 20
#: Items whose term sets are mined together, and the cells of a task's accumulators.
BLOCK_ITEMS, CELLS = 512, 1 << 22

#: ASCII letters and digits and all bytes beyond ASCII make terms; A-Z become a-z.
_TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_TABLE = np.frombuffer(_TERMS, np.uint8)
_MATCHED = "doc_id long, n long, terms array<int>, counts array<int>"
_BEST = "item int, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    """The maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased."""
    return text.translate(_TERMS).split()


@dataclass
class Block:
    """How to add up a block of items.

    ``terms`` are numbers of the vocabulary and name the accumulators 0, 1, ...; node i is the sum of the accumulators
    ``left[i]`` and ``right[i]`` and is accumulator ``len(terms) + i``; an item is the sum of its ``parts``.
    """

    terms: np.ndarray
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    items: list[int] = field(default_factory=list)
    parts: list[list[int]] = field(default_factory=list)


def mine(items: dict[int, list[int]]) -> Block:
    """The shared term sets of a block of items (item: its terms, repeats included).

    The second occurrence of a term in an item is an atom of its own with the same accumulator.
    """
    atoms, names = {}, {}
    for item, terms in items.items():
        seen: Counter = Counter()
        atoms[item] = []
        for term in terms:
            atoms[item].append(names.setdefault((term, seen[term]), len(names)))
            seen[term] += 1
    often = Counter(a for row in atoms.values() for a in row)
    rows = {item: sorted(row, key=lambda a: (-often[a], a)) for item, row in atoms.items()}
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for item, row in rows.items():
        for pair in zip(row, row[1:]):
            where[pair].add(item)
    queue = [(-len(found), pair) for pair, found in where.items() if len(found) > 1]
    heapq.heapify(queue)
    children, n = [], len(names)
    while queue:
        count, pair = heapq.heappop(queue)
        if len(where[pair]) != -count:  # has changed since
            if len(where[pair]) > 1:
                heapq.heappush(queue, (-len(where[pair]), pair))
            continue
        node = n + len(children)
        children.append(pair)
        changed = set()
        for item in list(where[pair]):
            row = rows[item]
            at = row.index(pair[0])
            low = max(0, at - 1)
            for old in zip(row[low : at + 3], row[low + 1 : at + 3]):
                where[old].discard(item)
            row[at : at + 2] = [node]
            for new in zip(row[low : at + 2], row[low + 1 : at + 2]):
                where[new].add(item)
                changed.add(new)
        for new in changed:
            if len(where[new]) > 1:
                heapq.heappush(queue, (-len(where[new]), new))
    terms = sorted({term for term, _ in names})
    place = {term: i for i, term in enumerate(terms)}
    # atoms become the accumulators of their terms, nodes follow them
    accumulator = [place[term] for term, _ in names] + [len(terms) + i for i in range(len(children))]
    block = Block(np.array(terms, np.int64))
    block.left = [accumulator[a] for a, _ in children]
    block.right = [accumulator[b] for _, b in children]
    for item, row in rows.items():
        block.items.append(item)
        block.parts.append([accumulator[a] for a in row])
    return block


def _match(shared):
    def run(batches):
        numbers = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for first, n, words in word_slices(batch, _TABLE):
                number = np.array([numbers.get(w, -1) for w in words.vocabulary.to_pylist()] or [-1], np.int64)
                found = number[words.codes]
                row = np.repeat(np.arange(n), words.sizes)[found >= 0]
                cell, counts = np.unique(row * (len(numbers) + 1) + found[found >= 0], return_counts=True)
                offsets = pa.array(np.searchsorted(cell // (len(numbers) + 1), np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (cell % (len(numbers) + 1), counts)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, n), pa.array(words.sizes), *lists], names=["doc_id", "n", "terms", "counts"]
                )

    return run


def _lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """25 + (75 n N) div L for each document of n terms, exact also beyond 64 bits."""
    if len(n) and int(n.max()) * 75 * documents >= 1 << 63:
        return np.array([25 + 75 * x * documents // total for x in n.tolist()], np.int64)
    return 25 + 75 * n * documents // total


class _Best:
    """The best documents of each item so far. Ties go to the smaller doc_id, null last."""

    def __init__(self, items: int, top: int):
        self.top, self.floor = top, np.ones(items, np.int64)
        self.item = self.score = self.id = np.empty(0, np.int64)
        self.null = np.empty(0, bool)

    def add(self, item, score, ids, null):
        item, score = np.concatenate((self.item, item)), np.concatenate((self.score, score))
        ids, null = np.concatenate((self.id, ids)), np.concatenate((self.null, null))
        order = np.lexsort((ids, null, -score, item))
        item, score = item[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept, last = rank < self.top, rank == self.top - 1
        self.floor[item[last]] = score[last]
        self.item, self.score, self.id, self.null = item[kept], score[kept], ids[order][kept], null[order][kept]


def _score(shared, top: int):
    def run(batches):
        blocks, weights, n_documents, total = shared.value
        n_items = 1 + max((i for block in blocks for i in block.items), default=-1)
        best = _Best(n_items, top)
        for batch in batches:
            doc = batch.column("doc_id")
            null = doc.is_null().to_numpy(zero_copy_only=False)
            ids = doc.fill_null(0).to_numpy()
            terms, counts = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))
            sizes = np.diff(batch.column("terms").offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            m = _lengths(batch.column("n").to_numpy(), n_documents, max(1, total))
            impact = weights[terms] * (1_000_000_000 * counts // (1000 * counts + 8 * m[row]))
            for block in blocks:
                _add_up(block, batch.num_rows, row, terms, impact, len(weights), best, ids, null)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item, pa.int32()), pa.array(best.id, mask=best.null), pa.array(best.score)], names=["item", "doc_id", "score"]
        )

    return run


def _add_up(block, rows, row, terms, impact, vocabulary, best, ids, null):
    """Scores the documents of a batch for the items of a block, in runs that keep the accumulators small."""
    n = len(block.terms) + len(block.left)
    place = np.full(vocabulary, -1)
    place[block.terms] = np.arange(len(block.terms))
    at = place[terms]
    mine = at >= 0
    at, row, impact = at[mine], row[mine], impact[mine]
    width = max(1, CELLS // max(1, n))
    for low in range(0, rows, width):
        high = min(low + width, rows)
        a, b = np.searchsorted(row, (low, high))
        if a == b:
            continue
        sums = np.zeros((n, high - low), np.int64)
        sums[at[a:b], row[a:b] - low] = impact[a:b]
        for i, (left, right) in enumerate(zip(block.left, block.right), len(block.terms)):
            np.add(sums[left], sums[right], out=sums[i])
        found = []
        for item, parts in zip(block.items, block.parts):
            score = sums[parts[0]] if len(parts) == 1 else sums[parts].sum(axis=0)
            column = np.flatnonzero(score >= best.floor[item])
            if len(column):
                found.append((np.full(len(column), item), score[column], column + low))
        if found:
            item, score, column = (np.concatenate(x) for x in zip(*found))
            best.add(item, score, ids[column], null[column])


def _passes(items: DataFrame, limit: int) -> list[DataFrame]:
    """The items, in parts that are small enough to broadcast."""
    size = items.agg(F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64), F.lit(0))).first()[0]
    n = max(1, -(-size // limit))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.where(part == i) if n > 1 else items for i in range(n)]


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest-scoring documents of each item, scores above 0 only.

    With N documents that hold a term, L terms in them, n in a document, df documents that hold a term and tf its
    occurrences in one, a term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))); a document scores the sum of
    ``w * ((1000000000 tf) div (1000 tf + 8 m))`` over the item's terms, repeats included, with ``m = 25 + (75 n N) div L``.

    Ties go to the smaller doc_id, a null doc_id last; rows that repeat a doc_id are documents of their own, and rows that
    repeat an item_id items of their own. Null and empty texts and items without terms match nothing; items without
    matches have no rows, and so have empty tables. Texts of any length are read whole; a task holds the longest one.
    An item larger than ``pass_bytes`` makes a pass of its own. Other columns are not read and may have any name.
    """
    spark = docs.sparkSession
    ship_package(spark)
    context = spark.sparkContext
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    results = []
    for part in _passes(asked, pass_bytes):
        rows = [(r.item_id, terms_of((r.text or "").encode())) for r in part.collect()]  # at most pass_bytes, or one item
        rows = sorted((r for r in rows if r[1]), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        numbers = {term: i for i, term in enumerate(sorted({t for _, terms in rows for t in terms}))}
        matched = stored(given.mapInArrow(_match(context.broadcast(numbers)), _MATCHED), "matched")
        n_documents, total = matched.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(numbers), np.int64)
        for r in matched.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the items
            df[r["term"]] = r["count"]
        weights = np.floor(1000 * np.log((2 * n_documents + 2) / (2 * df + 1))).astype(np.int64)
        blocks = [
            mine({i: [numbers[t] for t in rows[i][1]] for i in range(low, min(low + BLOCK_ITEMS, len(rows)))})
            for low in range(0, len(rows), BLOCK_ITEMS)
        ]
        shared = context.broadcast((blocks, weights, n_documents, total))
        best = matched.where("size(terms) > 0").mapInArrow(_score(shared, top), _BEST)
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "item int, item_id long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        found = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        results.append(stored(found, "ranked"))
    out = results[0]
    for found in results[1:]:
        out = out.unionByName(found)
    return out


def op11_ranked_search(spark, sf_dir):
    """The ten best documents of every benchmark item among all documents."""
    return rank_documents(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH word AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
),
count AS (SELECT doc_id, term, count(*) AS tf FROM word GROUP BY doc_id, term),
length AS (SELECT doc_id, sum(tf) AS n FROM count GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n) AS terms FROM length),
asked AS (
    SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
),
weight AS (
    SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * max(docs) + 2) / (2 * count(*) + 1))) AS HUGEINT) AS w
    FROM count, total WHERE term IN (SELECT term FROM asked) GROUP BY term
),
size AS (SELECT doc_id, CAST(25 + (75 * n * docs) // terms AS HUGEINT) AS m FROM length, total),
score AS (
    SELECT a.item_id, c.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM asked a JOIN count c USING (term) JOIN weight USING (term) JOIN size s ON s.doc_id = c.doc_id
    GROUP BY a.item_id, c.doc_id
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM score WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10
"""

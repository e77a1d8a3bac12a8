"""Inner products of a block of queries with a batch of articles, inside one task.

Spark hands each task a stream of Arrow batches of vectors. The task holds one batch and one block of queries at a
time, and returns a few rows per query: the range of its scores, or its best articles so far. The table
of all (query, article) pairs is never emitted. Keyword scores have the postings of whole articles in place of vectors,
and fused scores have both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Cells of one score matrix.
CELLS = 1 << 21
QUERIES_PER_BLOCK = 1024

# Articles whose keyword scores with a block of queries are held at a time, and products summed at once.
ARTICLES_PER_RUN, PRODUCTS = 4096, 1 << 16
# Articles of a task that a search by keywords scores first, for floors under the others.
FIRST_ARTICLES = 256

# Scores keep this many decimals, so that the order of a summation cannot make equal scores differ.
SCORE_DECIMALS = 12
# Articles are ranked by the fused score to nine decimals, then by kb_id.
RANK_SCALE = 1e9
# Keyword scores that differ by more than this, in units of the last decimal kept, never share a rank key.
NEAR = 2 * round(10**SCORE_DECIMALS / RANK_SCALE)


@dataclass
class QueryBlock:
    """Queries, sorted by id, as unit vectors."""

    ids: np.ndarray
    dense: np.ndarray


@dataclass
class Scales:
    """Per query of a block: least semantic score, width of its range, and what a score of no keywords is scaled to.

    ``floors`` has a row for each alpha: articles whose key lies below cannot be among the best.
    """

    low: np.ndarray
    width: np.ndarray
    no_keywords: np.ndarray
    floors: np.ndarray


def blocks_of(ids: np.ndarray, dense: np.ndarray) -> list[QueryBlock]:
    step = QUERIES_PER_BLOCK
    return [QueryBlock(ids[i : i + step], dense[i : i + step]) for i in range(0, len(ids), step)]


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(length > 0, length, 1.0)[:, None]


def scored(batches: Iterator[pa.RecordBatch], blocks: list[QueryBlock]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the block, kb_ids and scores (article down, query across) of one run of articles after another."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch["kb_id"].to_numpy()
        values = batch["embedding"].flatten().to_numpy(zero_copy_only=False)
        dense = unit_rows(values.astype(np.float64).reshape(len(ids), -1))
        for i, block in enumerate(blocks):
            run = max(1, CELLS // len(block.ids))
            for first in range(0, len(ids), run):
                part = slice(first, first + run)
                yield i, ids[part], np.round(dense[part] @ block.dense.T, SCORE_DECIMALS)


def score_ranges(batches: Iterator[pa.RecordBatch], blocks: list[QueryBlock]) -> Iterator[pa.RecordBatch]:
    """Per query: least and greatest score over the task's articles."""
    held: dict[int, list[np.ndarray]] = {}
    for i, _, scores in scored(batches, blocks):
        low, high = scores.min(0), scores.max(0)
        if i in held:
            low, high = np.minimum(low, held[i][0]), np.maximum(high, held[i][1])
        held[i] = [low, high]
    for i, seen in held.items():
        columns = [pa.array(c) for c in (blocks[i].ids, *seen)]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "sem_min", "sem_max"])


def best_articles(
    batches: Iterator[pa.RecordBatch],
    blocks: list[QueryBlock],
    scales: list[Scales],
    alphas: list[float],
    top_k: int,
) -> Iterator[pa.RecordBatch]:
    """Per alpha and query: the task's ``top_k`` articles by fused score, were they without keywords, above the floor."""
    best: dict[tuple[int, int], list[np.ndarray]] = {}
    for i, ids, scores in scored(batches, blocks):
        scale = scales[i]
        scaled = ((scores - scale.low) / scale.width).T
        for a, alpha in enumerate(alphas):
            hybrid = alpha * scaled + (1.0 - alpha) * scale.no_keywords[:, None]
            found = _top(ids, np.rint(hybrid * RANK_SCALE).astype(np.int64), top_k, scores.T)
            best[a, i] = _better(best.get((a, i)), found, top_k)
    for (a, i), (ids, key, scores) in best.items():
        above = key >= scales[i].floors[a][:, None]
        query = np.broadcast_to(blocks[i].ids[:, None], key.shape)[above]
        columns = [query, np.full(len(query), alphas[a]), ids[above], key[above], scores[above]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "alpha", "kb_id", "rank_key", "semantic"])


def _top(ids: np.ndarray, key: np.ndarray, top_k: int, *scores: np.ndarray) -> list[np.ndarray]:
    """The best articles of each query: by key, then by the lower kb_id. One whole number orders them."""
    n = len(ids)
    chosen = np.broadcast_to(np.arange(n), key.shape)
    if n > top_k:
        place = np.empty(n, dtype=np.int64)
        place[np.argsort(ids)] = np.arange(n)
        ordered = key * n - place
        chosen = np.argpartition(ordered, n - top_k, axis=1)[:, n - top_k :]
    return [ids[chosen], *(np.take_along_axis(c, chosen, axis=1) for c in (key, *scores))]


def _better(before: list[np.ndarray] | None, found: list[np.ndarray], top_k: int) -> list[np.ndarray]:
    """The best of what ``_top`` has found in two runs of articles."""
    if before is None:
        return found
    found = [np.concatenate(pair, axis=1) for pair in zip(before, found)]
    order = np.lexsort((found[0], -found[1]), axis=1)[:, :top_k]
    return [np.take_along_axis(c, order, axis=1) for c in found]


# --- keyword scores ---------------------------------------------------------------------------


@dataclass
class QueryWeights:
    """Weights of the terms of queries: ``query`` is a place in ``ids``, and rows are sorted by it."""

    ids: np.ndarray
    query: np.ndarray
    code: np.ndarray
    weight: np.ndarray


@dataclass
class Articles:
    """A task's articles by kb_id, and their postings (code, tf) by article, which is a place in ``ids``.

    ``vectors`` are unit vectors of the articles at ``with_vector``.
    """

    ids: np.ndarray
    norm: np.ndarray
    has_vector: np.ndarray
    article: np.ndarray
    code: np.ndarray
    tf: np.ndarray
    with_vector: np.ndarray
    vectors: pa.Array | None

    def matched(self) -> Articles:
        """Those with a posting."""
        used, article = np.unique(self.article, return_inverse=True)
        rest = self.ids[used], self.norm[used], self.has_vector[used]
        return Articles(*rest, article, self.code, self.tf, np.zeros(0, dtype=np.int64), None)

    def runs(self, start: int = 0) -> Iterator[tuple[slice, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """One run of articles after another, with its postings: where each code's begin, articles and tf.

        ``code`` has numbers from 0 (``_numbered``). The first run has ``start`` articles, if that is given.
        """
        codes = int(self.code.max(initial=-1)) + 1
        ends = [*([start] if 0 < start < len(self.ids) else []), len(self.ids)]
        for first, last in zip([0, *ends], ends):
            for at in range(first, last, ARTICLES_PER_RUN):
                to = min(at + ARTICLES_PER_RUN, last)
                a, b = np.searchsorted(self.article, (at, to))
                by_code = a + np.argsort(self.code[a:b], kind="stable")
                begins = np.concatenate([[0], np.cumsum(np.bincount(self.code[a:b], minlength=codes))])
                yield slice(at, to), (begins, self.article[by_code] - at, self.tf[by_code])

    def dense(self, run: slice, dimension: int) -> np.ndarray:
        """The unit vectors of a run, zeros for articles without one."""
        dense = np.zeros((len(self.ids[run]), dimension))
        a, b = np.searchsorted(self.with_vector, (run.start, run.stop))
        if b > a:
            values = self.vectors.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
            dense[self.with_vector[a:b] - run.start] = unit_rows(values.astype(np.float64).reshape(b - a, dimension))
        return dense


def _whole_articles(batches: Iterator[pa.RecordBatch]) -> Articles | None:
    """From postings (kb_id, code, tf), one row an article with its norm, and one with its vector, if these are wanted.

    ``embedding`` is empty in rows of the other kinds.
    """
    batches = [batch for batch in batches if batch.num_rows]
    if not batches:
        return None
    table = pa.Table.from_batches(batches)
    is_norm = table["norm"].is_valid().to_numpy()
    articles, code, tf = (table[c].to_numpy() for c in ("kb_id", "code", "tf"))
    held, norm = articles[is_norm], table["norm"].to_numpy()[is_norm]
    has_vector = table["has_vector"].to_numpy()[is_norm].astype(bool)
    order = np.argsort(held)
    held, norm, has_vector = held[order], norm[order], has_vector[order]
    posting, with_vector, vectors = ~is_norm, np.zeros(0, dtype=np.int64), None
    if "embedding" in table.column_names:
        is_vector = pc.list_value_length(table["embedding"]).to_numpy() > 0
        posting &= ~is_vector
        at = np.flatnonzero(is_vector)
        at = at[np.argsort(articles[at])]
        with_vector, vectors = np.searchsorted(held, articles[at]), table["embedding"].combine_chunks().take(pa.array(at))
    article = np.searchsorted(held, articles[posting])
    order = np.argsort(article, kind="stable")
    return Articles(held, norm, has_vector, article[order], code[posting][order], tf[posting][order].astype(np.float64), with_vector, vectors)


def _numbered(articles: Articles, weights: QueryWeights) -> tuple[Articles, QueryWeights]:
    """Numbers from 0 for the codes of the task's postings; weights of other terms are left out."""
    codes, code = np.unique(articles.code, return_inverse=True)
    place = np.searchsorted(codes, weights.code)
    held = np.flatnonzero(codes[np.minimum(place, len(codes) - 1)] == weights.code) if len(codes) else place[:0]
    return replace(articles, code=code), replace(weights, query=weights.query[held], code=place[held], weight=weights.weight[held])


def best_by_keywords(batches: Iterator[pa.RecordBatch], weights: QueryWeights, top_k: int) -> Iterator[pa.RecordBatch]:
    """Per query: the task's best ``top_k`` articles by keyword score, and what it found.

    The rows are postings (kb_id, code, tf) of whole articles, and for each article one row with its norm. Equal scores go to the
    lower kb_id; scores too near for the rank key to tell are all kept, as the lower kb_id of them may win. ``low`` and ``pairs`` of the
    rows without kb_id are the least score, zero for articles without a common term, and the number of articles with one.

    The best of a short first run of articles give floors, and of the others only scores that reach the floor of their query are
    looked at one by one. A query that has met an article without a common term has zero for its least score; from then
    on ``pairs`` counts no more, and stays below the number of articles.
    """
    articles = _whole_articles(batches)
    if articles is None or not len(weights.ids):
        return
    articles, weights = _numbered(articles.matched(), weights)
    held, norm, has_vector = articles.ids, articles.norm, articles.has_vector

    best = BestKeywords(len(weights.ids), top_k)
    low, pairs = np.full(len(weights.ids), np.inf), np.zeros(len(weights.ids), dtype=np.int64)
    for run, mine in articles.runs(FIRST_ARTICLES):
        n = len(held[run])
        step = max(1, CELLS // 8 // n)  # few enough for a cache
        found = []
        for start in range(0, len(weights.ids), step):
            block = slice(start, start + step)
            dot = _products(weights, block, mine, n)
            open_ = np.flatnonzero(low[block] > 0)
            if len(open_):
                low[start + open_] = np.minimum(low[start + open_], np.round((dot[open_] / norm[run]).min(1), SCORE_DECIMALS))
                pairs[start + open_] += np.count_nonzero(dot[open_], axis=1)
            row, column = _reaching(dot, norm[run], best.floor[block], top_k)
            found.append((start + row, column, np.round(dot[row, column] / norm[run][column], SCORE_DECIMALS)))
        query, column, scores = (np.concatenate(c) for c in zip(*found))
        best.add(query, held[run][column], has_vector[run][column], scores)
    yield _found(weights.ids[best.query], best.kb_id, best.has_vector, best.score)
    seen = pairs > 0
    none = pa.nulls(int(seen.sum()), pa.int64())
    columns = [weights.ids[seen], none, none.cast(pa.bool_()), none.cast(pa.float64()), low[seen], pairs[seen]]
    yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], BEST_COLUMNS)


class BestKeywords:
    """The best articles so far of a task's queries, in order. ``floor`` is the key of the k-th best, zero until there are as many."""

    def __init__(self, queries: int, top_k: int):
        self.top_k, self.floor = top_k, np.zeros(queries, dtype=np.int64)
        self.query, self.kb_id = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.has_vector, self.score = np.zeros(0, dtype=bool), np.zeros(0)

    def add(self, query: np.ndarray, *found: np.ndarray) -> None:
        """``found``: kb_id, has_vector and a score above zero of articles none of which was added to the query before."""
        if not len(query):
            return
        touched = np.zeros(len(self.floor), dtype=bool)
        touched[query] = True
        again = touched[self.query]
        before = self.query, self.kb_id, self.has_vector, self.score
        query, kb_id, has_vector, score = (np.concatenate([old[again], new]) for old, new in zip(before, (query, *found)))
        key = np.rint(score * 10**SCORE_DECIMALS).astype(np.int64)
        order = np.lexsort((kb_id, -key, query))
        query, kb_id, has_vector, score, key = (c[order] for c in (query, kb_id, has_vector, score, key))
        kth = _places(query[1:] != query[:-1]) == self.top_k - 1
        self.floor[query[kth]] = key[kth]
        # of equal keys the first are enough; of those near the k-th best all values stay
        kept = (key >= self.floor[query] - NEAR) & (_places((query[1:] != query[:-1]) | (key[1:] != key[:-1])) < self.top_k)
        now = (c[kept] for c in (query, kb_id, has_vector, score))
        self.query, self.kb_id, self.has_vector, self.score = (np.concatenate([old[~again], new]) for old, new in zip(before, now))


def _places(begins: np.ndarray) -> np.ndarray:
    """The number of each row in its group, from 0. ``begins`` has all rows but the first, which begins a group."""
    starts = np.concatenate([[0], np.flatnonzero(begins) + 1])
    return np.arange(len(begins) + 1) - np.repeat(starts, np.diff(np.concatenate([starts, [len(begins) + 1]])))


BEST_COLUMNS = ["query_id", "kb_id", "has_vector", "keyword", "low", "pairs"]


def keyword_ranges(batches: Iterator[pa.RecordBatch], weights: QueryWeights) -> Iterator[pa.RecordBatch]:
    """Per query that shares a term with one of the task's articles: range of its keyword scores, and the number of such articles.

    The rows are as in ``best_by_keywords``. Articles of the task without a common term count as zero in the range.
    """
    articles = _whole_articles(batches)
    if articles is None or not len(weights.ids):
        return
    articles, weights = _numbered(articles.matched(), weights)
    low, high = np.full(len(weights.ids), np.inf), np.zeros(len(weights.ids))
    pairs = np.zeros(len(weights.ids), dtype=np.int64)
    for run, mine in articles.runs():
        norm = articles.norm[run]
        step = max(1, CELLS // len(norm))
        for start in range(0, len(weights.ids), step):
            block = slice(start, start + step)
            dot = _products(weights, block, mine, len(norm))
            pairs[block] += np.count_nonzero(dot, axis=1)
            dot /= norm
            low[block], high[block] = np.minimum(low[block], dot.min(1)), np.maximum(high[block], dot.max(1))
    seen = pairs > 0
    columns = [weights.ids[seen], np.round(low[seen], SCORE_DECIMALS), np.round(high[seen], SCORE_DECIMALS), pairs[seen]]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "kw_min", "kw_max", "n_pairs"])


@dataclass
class Fusion:
    """Per query, in the order of the weights' ``ids``: unit vector (zeros for none), and what is subtracted from and divides its scores."""

    vectors: np.ndarray
    sem_low: np.ndarray
    sem_width: np.ndarray
    kw_low: np.ndarray
    kw_width: np.ndarray


def best_fused(
    batches: Iterator[pa.RecordBatch], weights: QueryWeights, fusion: Fusion, alphas: list[float], top_k: int
) -> Iterator[pa.RecordBatch]:
    """Per alpha and query: the task's ``top_k`` articles by the fused score.

    The rows are as in ``best_by_keywords``, of all articles, and one row more for each vector. The scores of a run of
    articles with a block of queries are held at a time. Equal scores, to the decimals of the rank, go to the lower kb_id.
    """
    articles = _whole_articles(batches)
    if articles is None or not len(weights.ids):
        return
    articles, weights = _numbered(articles, weights)
    best: dict[tuple[int, int], list[np.ndarray]] = {}
    step = max(1, CELLS // ARTICLES_PER_RUN)
    for run, mine in articles.runs():
        ids, dense = articles.ids[run], articles.dense(run, fusion.vectors.shape[1])
        norm = np.where(articles.norm[run] > 0, articles.norm[run], 1.0)
        for start in range(0, len(weights.ids), step):
            block = slice(start, start + step)
            keyword = np.round(_products(weights, block, mine, len(ids)) / norm, SCORE_DECIMALS)
            semantic = np.round(fusion.vectors[block] @ dense.T, SCORE_DECIMALS)
            scaled = (semantic - fusion.sem_low[block, None]) / fusion.sem_width[block, None]
            matched = (keyword - fusion.kw_low[block, None]) / fusion.kw_width[block, None]
            for a, alpha in enumerate(alphas):
                key = np.rint((alpha * scaled + (1.0 - alpha) * matched) * RANK_SCALE).astype(np.int64)
                best[a, start] = _better(best.get((a, start)), _top(ids, key, top_k, semantic, keyword), top_k)
    for (a, start), (ids, key, semantic, keyword) in best.items():
        query = np.repeat(weights.ids[start : start + step], ids.shape[1])
        columns = [query, np.full(len(query), alphas[a]), *(c.ravel() for c in (ids, key, semantic, keyword))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "alpha", "kb_id", "rank_key", "semantic", "keyword"])


def _found(query: np.ndarray, kb_id: np.ndarray, has_vector: np.ndarray, keyword: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(c) for c in (query, kb_id, has_vector, keyword)]
    columns += [pa.nulls(len(query), pa.float64()), pa.nulls(len(query), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, BEST_COLUMNS)


def _products(weights: QueryWeights, block: slice, postings: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Sums of tf * weight by query of the block and article of the run. ``postings`` are as ``runs`` has them."""
    begins, article, tf = postings
    size = len(weights.ids[block])
    a, b = np.searchsorted(weights.query, (block.start, block.start + size))
    left, right = begins[weights.code[a:b]], begins[weights.code[a:b] + 1]
    found = np.flatnonzero(right > left)
    counts, left = (right - left)[found], left[found]
    cell, weight = (weights.query[a:b][found] - block.start) * n, weights.weight[a:b][found]
    dot = np.zeros(size * n)
    ends = np.cumsum(counts)
    at = 0
    while at < len(found):  # a term has at most a run of postings, so a step has few more than PRODUCTS
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PRODUCTS, "right")))
        many = counts[at:to]
        before = np.cumsum(many) - many
        place = np.repeat(left[at:to] - before, many) + np.arange(many.sum())
        # cells of these queries only, which are neighbours
        base = cell[at]
        top = cell[to - 1] + n
        where = np.repeat(cell[at:to] - base, many) + article[place]
        dot[base:top] += np.bincount(where, tf[place] * np.repeat(weight[at:to], many), top - base)
        at = to
    return dot.reshape(size, n)


def _reaching(dot: np.ndarray, norm: np.ndarray, floor: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (row, column) above zero that may be among the best ``top_k`` of their row, by the floor of the row's key if it has one."""
    least = np.maximum((floor - 2 * NEAR) / 10**SCORE_DECIMALS, 0.0)
    row, column = np.divmod(np.flatnonzero(dot > least[:, None] * norm), dot.shape[1])
    # of rows that many reach, and of those without a floor, the leading ones alone are listed
    many = np.bincount(row, minlength=len(dot)) > 16 * top_k
    if not many.any():
        return row, column
    key = np.rint(np.round(dot[many] / norm, SCORE_DECIMALS) * 10**SCORE_DECIMALS).astype(np.int64)
    lead, place, _ = _leading(key, top_k)
    few = ~many[row]
    return np.concatenate([row[few], np.flatnonzero(many)[lead]]), np.concatenate([column[few], place])


def _leading(key: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (row, column) that may be among the best ``top_k`` of their row, and the k-th best key of each row.

    Columns are in the order of ids. Of equal keys the first ``top_k`` are enough; of keys that are near the k-th best all
    values have to stay. Zeros are not listed.
    """
    rows, n = key.shape
    if n <= top_k:
        row, column = np.nonzero(key)
        return row, column, np.zeros(rows, dtype=np.int64)
    ordered = key * n + np.arange(n - 1, -1, -1)
    chosen = np.argpartition(ordered, n - top_k, axis=1)[:, n - top_k :]
    least = np.take_along_axis(key, chosen, axis=1).min(1)
    equal = (key == least[:, None]).sum(1)
    near = (np.abs(key - least[:, None]) <= NEAR).sum(1)
    plain = near == equal
    row, column = np.repeat(np.flatnonzero(plain), top_k), chosen[plain].ravel()
    more = [(row, column)]
    for r in np.flatnonzero(~plain):
        at = np.flatnonzero(key[r] >= least[r] - NEAR)
        at = at[np.argsort(-key[r][at], kind="stable")]
        values = key[r][at]
        place = np.arange(len(at)) - np.searchsorted(-values, -values, "left")
        at = at[place < top_k]
        more.append((np.full(len(at), r), at))
    row, column = (np.concatenate(c) for c in zip(*more))
    some = key[row, column] > 0
    return row[some], column[some], least

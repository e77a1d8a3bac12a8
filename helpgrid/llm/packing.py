"""Mixture-controlled packing of token streams into windows.

The documents of a source are one queue of tokens, in a seeded order. Every window is to hold each source in
its share of all tokens, which are the proportions that can be kept to the last window when each token is
packed once. Deficit round-robin fills the windows: a window adds its share to each source's deficit, a
source whose deficit reaches the next piece (``grain`` tokens, or what is left of the document) is
served up to its deficit, and what is not served is carried to the next window. Where all deficits are too small
to fill a window, the source that is due next is served ahead of its turn and owes the tokens.

Partitions are cut so that the carry between them is known without a pass from one to the next: of P
partitions, partition p takes of a queue of N tokens those from ``(2 p N + P) div 2 P`` on, so every source enters
with a deficit of ``p N / P`` less that number, at most half a token. A document's place in its queue is what
its task has counted of the source before it, plus the tokens of the source in earlier tasks, whose sums are small: texts
are encoded once and their ids cross the network once. A document longer than a partition is cut.
All windows of a partition are full but its last tokens, which make windows of powers of two and so need no padding either.
"""

from __future__ import annotations

import heapq
import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helpgrid.llm.common import documents, ship_package, stored
from helpgrid.llm.words import Words, word_slices

WINDOW, GRAIN = 4096, 256
#: Tokens of a partition, which one task packs.
PARTITION = 1 << 22
#: Encoded words that a task keeps, and words that are encoded together.
CACHE_WORDS, TOGETHER = 500_000, 64
#: Sums of tasks are broadcast up to this many bytes.
BROADCAST_BYTES = 32 << 20

PIECES = "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


#: Classes of bytes: 1 an ASCII letter, 2 other ASCII but digits and white space, 0 all else. A-Z become a-z.
_FOLD = np.array([32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_CLASS = np.array([1 if chr(c).isalpha() else 0 if chr(c) in "0123456789 \t\n\r\x0b\x0c" else 2 for c in range(128)] + [0] * 128, np.uint8)


def _cut_words(data: np.ndarray) -> np.ndarray:
    """Cuts between an ASCII letter and a mark, but for letters after an apostrophe, which may belong to it."""
    kind = _CLASS[data]
    return ((kind[:-1] == 1) & (kind[1:] == 2)) | ((kind[:-1] == 2) & (kind[1:] == 1) & (data[:-1] != 39))


class WordPieces:
    """A vocabulary of the ``tokenizers`` library that lower-cases and whose tokens depend on nothing outside a word.

    Words end at ASCII white space and between ASCII letters and other marks, as its file's patterns have it: what
    differs only in case or in marks around it is encoded once.

    The driver reads the file; tasks get its content, a few MB. ``end`` is the id that closes every document.
    """

    def __init__(self, path: str, end: int = 2):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            self.content, self.end = file.read(), end
        largest = max(end, Tokenizer.from_str(self.content).get_vocab_size(with_added_tokens=True))
        self.width = 2 if largest < 1 << 16 else 4  # bytes of an id on its way to a partition

    def __call__(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task keeps to its own core
        tokenizer = Tokenizer.from_str(self.content)
        tokenizer.encode_special_tokens = True  # their strings in a text are then ordinary text
        return Encoder(tokenizer)


class Encoder:
    """The ids of distinct words, many words a call. A control character stands between them, alone, and its id cuts the ids."""

    MARK = "\x01"

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.mark = tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.known: dict[bytes, int] = {}
        self.flat, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        flat, sizes = [], []
        for low in range(0, len(words), TOGETHER * TOGETHER):
            texts = [word.decode() for word in words[low : low + TOGETHER * TOGETHER]]
            lots = [texts[i : i + TOGETHER] for i in range(0, len(texts), TOGETHER)]
            joined = [f" {self.MARK} ".join(lot) for lot in lots]
            for lot, text, encoded in zip(lots, joined, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                if len(self.mark) != 1 or text.count(self.MARK) != len(lot) - 1:
                    rows = [self.tokenizer.encode(word, add_special_tokens=False).ids for word in lot]
                    flat += [np.array(row, np.uint32) for row in rows]
                    sizes += [np.array([len(row)]) for row in rows]
                    continue
                ids = np.array(encoded.ids, np.uint32)
                marks = np.flatnonzero(ids == self.mark[0])
                sizes.append(np.diff(np.concatenate(([-1], marks, [len(ids)]))) - 1)
                flat.append(np.delete(ids, marks))
        return np.concatenate(flat or [np.empty(0, np.uint32)]), np.concatenate(sizes or [np.empty(0, np.int64)])

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, size): where each word's ids lie. Frequent words are known from earlier calls."""
        at = np.array([self.known.get(word, -1) for word in words], np.int64)
        new = np.flatnonzero(at < 0)
        flat, sizes = self._encode([words[i] for i in new])
        first = np.empty(len(words), np.int64)
        size = np.empty(len(words), np.int64)
        begins = np.cumsum(self.sizes) - self.sizes
        first[at >= 0], size[at >= 0] = begins[at[at >= 0]], self.sizes[at[at >= 0]]
        first[new], size[new] = len(self.flat) + np.cumsum(sizes) - sizes, sizes
        ids = np.concatenate((self.flat, flat))
        if len(self.known) + len(new) > CACHE_WORDS:  # starts anew with the words of this call
            self.known, self.sizes, self.flat = {}, sizes, flat
        else:
            self.sizes, self.flat = np.concatenate((self.sizes, sizes)), ids
        if len(new) <= CACHE_WORDS:
            self.known.update(zip((words[i] for i in new), range(len(self.sizes) - len(new), len(self.sizes))))
        else:
            self.sizes, self.flat = self.sizes[:0], self.flat[:0]
        return ids, first, size


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... (``sizes`` of them) of every run, one run after the other."""
    return np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def token_ids(words: Words, encode: Encoder, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in one array and how many each text has. Every distinct word is encoded once."""
    flat, first, size = encode(words.vocabulary.to_pylist())
    of_word = size[words.codes]
    until = np.concatenate(([0], np.cumsum(of_word)))
    counts = np.diff(until[words.bounds]) + 1
    ids = np.full(int(counts.sum()), end, np.uint32)
    place = np.ones(len(ids), bool)
    place[np.cumsum(counts) - 1] = False
    ids[place] = flat[_spread(first[words.codes], of_word)]
    return ids, counts


def _encode(shared):
    """Adds ``n``, ``ids`` and ``before``, the tokens of the same source earlier in the same task."""

    def run(batches):
        tokenizer = shared.value
        encode, width = tokenizer(), tokenizer.width
        seen: dict[str | None, int] = {}
        for batch in batches:
            for first, rows, words in word_slices(batch, _FOLD, _cut_words):
                ids, counts = token_ids(words, encode, tokenizer.end)
                part, before = batch.slice(first, rows), np.empty(rows, np.int64)
                queue = part.column("source").dictionary_encode(null_encoding="encode")
                for number, source in enumerate(queue.dictionary.to_pylist()):
                    mine = np.flatnonzero(queue.indices.to_numpy() == number)
                    until = seen.get(source, 0) + np.cumsum(counts[mine])
                    before[mine], seen[source] = until - counts[mine], int(until[-1])
                offsets = np.concatenate(([0], np.cumsum(counts))) * width
                buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids.astype(f"<u{width}"))]
                data = pa.BinaryArray.from_buffers(pa.binary(), rows, buffers)
                columns = [*(part.column(c) for c in ("doc_id", "source", "task")), pa.array(before), pa.array(counts), data]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "task", "before", "n", "ids"])

    return run


def queue_starts(tokens: DataFrame) -> DataFrame:
    """(source, task, first, size): where the documents of a task start in their source's queue, and its tokens in all.

    Tasks follow each other in the order of a hash. One row a source and task is all that a window function sees.
    """
    sums = tokens.groupBy("source", "task").agg(F.sum("n").alias("n"))
    queue = Window.partitionBy("source")
    before = queue.orderBy(F.xxhash64("task", F.lit(12)), "task").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        "source", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(queue).alias("size")
    )


def _cut(p: str, partitions: int) -> str:
    """SQL: the place in a queue of ``size`` tokens at which partition ``p`` starts."""
    return f"cast((2 * cast({p} AS decimal(20, 0)) * size + {partitions}) div {2 * partitions} AS bigint)"


def _part(place: str, partitions: int) -> str:
    """SQL: the partition that a place in a queue belongs to, which is the last one that does not start after it."""
    return f"((2 * cast({place} AS decimal(20, 0)) + 1) * {partitions} - 1) div (2 * size)"


def serve(lengths: list[list[int]], carry: list[float], window: int, grain: int):
    """Deficit round-robin over the queues of a partition: (window, offset, queue, piece, start, length).

    ``lengths`` holds the tokens of each queue's pieces in order. Every window but the last is full.
    """
    left = [sum(x) for x in lengths]
    total = sum(left)
    share = [window * n / total if total else 0.0 for n in left]  # what a window adds to a deficit
    deficit, at, done, seen = list(carry), [0] * len(left), [0] * len(left), [0] * len(left)

    def due(q: int) -> float:
        """The window in which the deficit reaches the next piece."""
        need = min(grain, lengths[q][at[q]] - done[q])
        return seen[q] + max(0, math.ceil((need - deficit[q]) / share[q]))

    ring = [(due(q), q) for q in range(len(left)) if left[q]]
    heapq.heapify(ring)
    number, offset = 0, 0
    while ring:
        when, q = heapq.heappop(ring)
        if when > number:  # nobody is due: served ahead, with what the next piece needs
            allowed = min(grain, lengths[q][at[q]] - done[q])
        else:
            deficit[q] += share[q] * (number - seen[q])
            seen[q] = number
            allowed = max(int(deficit[q]), min(grain, lengths[q][at[q]] - done[q]))
        while allowed > 0 and left[q]:
            rest = lengths[q][at[q]] - done[q]
            take = min(allowed, rest, window - offset)
            yield number, offset, q, at[q], done[q], take
            offset, allowed = offset + take, allowed - take
            deficit[q] -= take
            left[q] -= take
            done[q] += take
            if take == rest:
                at[q], done[q] = at[q] + 1, 0
            if offset == window:
                number, offset = number + 1, 0
                break
        if left[q]:
            heapq.heappush(ring, (due(q), q))


def _tail(length: int):
    """The powers of two that add up to ``length``, greatest first, with where each starts."""
    out, start = [], 0
    for bit in range(length.bit_length() - 1, -1, -1):
        if length >> bit & 1:
            out.append((start, 1 << bit))
            start += 1 << bit
    return out


def _pack(window: int, grain: int, width: int):
    def run(key, table):
        p = key[0].as_py()
        table = table.sort_by([("source", "ascending"), ("begin", "ascending")]).combine_chunks()
        n = table.column("length").to_numpy()
        queue = table.column("source").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], queue[1:] != queue[:-1])))
        ends = np.append(starts[1:], len(n))
        carry = table.column("carry").to_numpy()[starts].tolist()
        out = np.array(list(serve([n[a:b].tolist() for a, b in zip(starts, ends)], carry, window, grain)), np.int64).reshape(-1, 6)
        number, offset, q, piece, start, length = out.T
        piece = piece + starts[q]
        # the last tokens become windows of powers of two
        total = int(length.sum())
        sequence = number.copy()
        tail = total % window
        if tail:
            parts = _tail(tail)
            first = total // window
            last = np.flatnonzero(number == first)
            cut = np.array([a for a, _ in parts] + [tail])
            begins, finishes = offset[last], offset[last] + length[last]
            one = np.searchsorted(cut, begins, side="right") - 1
            several = np.searchsorted(cut, finishes, side="left") - one
            rows = np.repeat(np.arange(len(last)), several)
            part = _spread(one, several)
            low, high = np.maximum(begins[rows], cut[part]), np.minimum(finishes[rows], cut[part + 1])
            keep = np.arange(len(out))[number < first]
            piece = np.concatenate((piece[keep], piece[last][rows]))
            start = np.concatenate((start[keep], start[last][rows] + low - begins[rows]))
            offset = np.concatenate((offset[keep], low - cut[part]))
            sequence = np.concatenate((sequence[keep], first + part))
            length = np.concatenate((length[keep], high - low))
        ids = table.column("ids").combine_chunks()
        offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset :][: len(ids)] // width
        data = np.frombuffer(ids.buffers()[2], np.uint8)
        data = data[: len(data) // width * width].view(f"<u{width}")
        flat = data[_spread(offsets[piece] + start, length)].astype("<u4")
        bounds = np.concatenate(([0], 4 * np.cumsum(length))).astype(np.int32)
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(flat.tobytes())])
        take = pa.array(piece)
        return pa.table(
            {
                "doc_id": table.column("doc_id").take(take),
                "source": table.column("source").take(take),
                "start": pa.array(table.column("start").to_numpy()[piece] + start),
                "length": pa.array(length),
                "doc_tokens": table.column("doc_tokens").take(take),
                "sequence_id": pa.array((p << 32) + sequence),
                "offset": pa.array(offset),
                "ids": packed,
            }
        )

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: WordPieces,
    window: int = WINDOW,
    grain: int = GRAIN,
    partition: int = PARTITION,
) -> DataFrame:
    """(doc_id, source, start, length, doc_tokens, sequence_id, offset, ids) for every piece of every document.

    A document is its ids and the closing id. Each id lies in one piece; the pieces of a sequence follow each other
    without gaps. Sequences have ``window`` ids but for the last ones of a partition, whose sizes are powers
    of two. ``ids`` are little-endian unsigned 32-bit numbers.

    A null or empty text is its closing id alone; a null source is a source of its own; a null doc_id stays null.
    Repeated rows are packed each. Queues follow the order of the rows in their files; the same files read in
    the same way give the same packing. An empty table gives an empty result. A document longer than a partition is cut;
    a task holds the longest text and one partition. Other columns are not read and may have any name.
    """
    spark = docs.sparkSession
    ship_package(spark)
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.spark_partition_id().alias("task"),
        F.col("text").cast("string").alias("text"),
    )
    shared = spark.sparkContext.broadcast(tokenizer)
    columns = "doc_id long, source string, task int, before long, n long, ids binary"
    tokens = stored(given.mapInArrow(_encode(shared), columns), "tokens")
    starts = stored(queue_starts(tokens), "starts")
    total, size = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], starts.agg(
        F.coalesce(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64), F.lit(0))
    ).first()[0]
    partitions = max(1, -(-total // partition))
    same = F.col("t.source").eqNullSafe(F.col("s.source")) & (F.col("t.task") == F.col("s.task"))
    small = F.broadcast(starts) if size <= BROADCAST_BYTES else starts
    placed = tokens.alias("t").join(small.alias("s"), same).select(
        "t.source", "doc_id", "n", "ids", "size", (F.col("before") + F.col("first")).alias("begin")
    )
    first, last = _part("begin", partitions), _part("(begin + n - 1)", partitions)
    ids = f"substring(ids, cast({tokenizer.width} * start + 1 AS int), cast({tokenizer.width} * length AS int))"
    return (
        placed.withColumn("p", F.explode(F.expr(f"sequence({first}, {last})")))
        .withColumn("start", F.expr(f"greatest({_cut('p', partitions)} - begin, 0)"))
        .withColumn("length", F.expr(f"least({_cut('(p + 1)', partitions)} - begin, n) - start"))
        .withColumn("carry", F.expr(f"cast(cast(p AS decimal(20, 0)) * size % {partitions} AS double) / {partitions}"))
        .withColumn("carry", F.expr("if(carry >= 0.5, carry - 1, carry)"))
        .select("p", "source", "doc_id", F.expr("begin + start").alias("begin"), "start", "length", "carry", F.col("n").alias("doc_tokens"), F.expr(ids).alias("ids"))
        .groupBy("p")
        .applyInArrow(_pack(window, grain, tokenizer.width), PIECES)
    )


def op12_packing(spark, sf_dir, vocabulary: str | None = None):
    """Where each piece of every document lies, with the CRC-32 of its ids."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    found = pack_documents(documents(spark, sf_dir), WordPieces(vocabulary))
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )

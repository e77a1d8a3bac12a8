"""Texts of an Arrow batch as numbered words, a bounded slice at a time and without a Python object a word."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of a slice together have at most this many bytes, or are a single text.
SLICE_BYTES = 8 << 20

#: What becomes of each byte, where 32 separates words: here the ASCII white space 09-0D and 20.
WHITE_SPACE = np.array([32 if 9 <= c <= 13 else c for c in range(256)], np.uint8)


@dataclass
class Words:
    """The words of some texts: ``codes`` numbers them in ``vocabulary``, ``bounds`` cuts them into texts."""

    codes: np.ndarray
    bounds: np.ndarray
    vocabulary: pa.Array

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)


#: Where words are cut further: whether there is a cut between each byte and the next.
Cut = Callable[[np.ndarray], np.ndarray]


def numbered(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WHITE_SPACE, cut: Cut | None = None) -> Words:
    """The words of the texts that ``offsets`` cuts out of the bytes ``data``, mapped by ``table``."""
    low, high = int(offsets[0]), int(offsets[-1])
    data, offsets = table[data[low:high]], offsets - low
    inside = data != 32
    edge = np.zeros(len(data) + 1, bool)  # between which bytes a text ends
    edge[offsets] = True
    opens = inside & edge[:-1]
    opens[1:] |= inside[1:] & ~inside[:-1]
    closes = inside & edge[1:]
    closes[:-1] |= inside[:-1] & ~inside[1:]
    if cut and len(data):
        between = cut(data) & inside[1:] & inside[:-1]
        opens[1:] |= between
        closes[:-1] |= between
    starts = np.flatnonzero(opens)
    until = np.concatenate(([0], np.cumsum(np.flatnonzero(closes) + 1 - starts)))
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(until.astype(np.int64)), pa.py_buffer(data[inside])]
    ).dictionary_encode()
    return Words(words.indices.to_numpy().astype(np.int64), np.searchsorted(starts, offsets), words.dictionary)


def of_texts(texts: list[bytes], table: np.ndarray = WHITE_SPACE, cut: Cut | None = None) -> Words:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts], dtype=np.int64)))
    return numbered(np.frombuffer(b"".join(texts), np.uint8), offsets, table, cut)


def word_slices(
    batch: pa.RecordBatch, table: np.ndarray = WHITE_SPACE, cut: Cut | None = None, limit: int = SLICE_BYTES
) -> Iterator[tuple[int, int, Words]]:
    """(first row, rows, words): the texts of a batch in order; a null text is empty."""
    text = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, last - first, numbered(data, offsets[first : last + 1], table, cut)
        first = last

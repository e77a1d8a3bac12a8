"""Packing: every id in one place, windows full, sources in proportion."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_cases import SF_DIR, awkward, empty, real, rows
from tokenizers import Tokenizer

from helpgrid.llm import packing
from helpgrid.llm.words import of_texts

PATH = public_tokenizers.path("word_bpe_49k.json")
#: Texts in which word ends, marks, letters that change with case and special strings meet white space.
ODD = ["á ́b", "É É é", "ΣΑΣ ΟΔΟΣ Σ", "don't DON'T ' t's 's 'tis a.'s x-'t \"'re\" ('ll) ''d'D", "a=\u0338b E\u0301x -\u2026- …a… 3a4.5b c'é'sé", "x　y z", "<|endoftext|> <|startoftext|>a", "ﬁ ½ ①", "\x1c\x1d a\x85b", "가각 한"]


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_word_by_word(spark, encode, monkeypatch):
    texts = [*ODD, "a\x01 \x01 b", *(r.text for r in real(spark).collect())]
    wanted = [encode(x) for x in texts]
    for limit in (300_000, 3000, 10):  # words are known from earlier slices, or forgotten again
        monkeypatch.setattr(packing, "CACHE_WORDS", limit)
        encoder, found = packing.WordPieces(PATH)(), []
        for low in range(0, len(texts), 40):
            ids, counts = packing.token_ids(of_texts([x.encode() for x in texts[low : low + 40]], packing._FOLD, packing._cut_words), encoder, 2)
            found += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert found == wanted


def check(found, given, encode, window=4096):
    """Every id of every document lies in one piece, and pieces fill sequences without gaps."""
    wanted = Counter((i, tuple(encode(text))) for i, text in given)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        pieces[r.doc_id].append((r.start, ids.tolist(), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    by_id = defaultdict(list)
    for i, ids in wanted.elements():
        by_id[i].append(list(ids))
    assert pieces.keys() == by_id.keys()
    for i, documents in by_id.items():
        if len(documents) == 1:
            found_ids = [x for start, ids, _ in sorted(pieces[i]) for x in ids]
            assert found_ids == documents[0] and {n for _, _, n in pieces[i]} == {len(found_ids)}
            assert [start for start, _, _ in sorted(pieces[i])] == np.cumsum([0] + [len(x) for _, x, _ in sorted(pieces[i])])[:-1].tolist()
        else:
            assert sum(len(ids) for _, ids, _ in pieces[i]) == sum(map(len, documents))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)
    return sequences


@pytest.mark.parametrize("window,grain,partition", [(4096, 128, 1 << 22), (64, 8, 5000), (256, 1000, 900)])
def test_pack(spark, encode, window, grain, partition):
    tokenizer = packing.WordPieces(PATH)
    for docs, given in ((real(spark), [(r.doc_id, r.text) for r in real(spark).collect()]), (awkward(spark), [r[:2] for r in rows()])):
        found = packing.pack_documents(docs, tokenizer, window, grain, partition).collect()
        check(found, given, encode, window)
    assert packing.pack_documents(empty(spark), tokenizer).count() == 0


def test_windows_keep_the_proportions(spark, encode):
    docs = real(spark).repartition(5)
    window, grain = 1024, 64
    found = packing.pack_documents(docs, packing.WordPieces(PATH), window, grain, partition=40_000).collect()
    total = Counter()
    for r in found:
        total[r.source] += r.length
    share = {s: n / sum(total.values()) for s, n in total.items()}
    served, filled = Counter(), 0
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append(r)
    for key in sorted(by_sequence):
        inside = Counter()
        for r in by_sequence[key]:
            inside[r.source] += r.length
            filled += r.length
        served.update(inside)
        for s in share:  # the deficit that is carried on never grows beyond a few pieces
            assert abs(served[s] - share[s] * filled) <= 2 * grain + share[s] * window + len(share)
    assert all(served[s] == total[s] for s in total)
    again = packing.pack_documents(docs, packing.WordPieces(PATH), window, grain, partition=40_000).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, found), key=str)


def test_serve_fills_windows_and_pays_deficits():
    lengths = [[5] * 400, [1] * 30, [700], [3, 90, 2]]
    out = list(packing.serve(lengths, [0.0] * 4, 50, 10))
    assert Counter(w for w, *_ in out) .keys() == set(range(-(-sum(map(sum, lengths)) // 50)))
    for queue, pieces in enumerate(lengths):
        mine = [(piece, start, take) for _, _, q, piece, start, take in out if q == queue]
        assert mine == sorted(mine)
        assert [sum(t for p, _, t in mine if p == piece) for piece in range(len(pieces))] == pieces


def test_query(spark, encode):
    found = packing.op12_packing(spark, SF_DIR).collect()
    ids = {r.doc_id: encode(r.text) for r in real(spark).collect()}
    for r in found:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in found) == sum(map(len, ids.values()))

"""Periodic runs against a scan of every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from llm_cases import SF_DIR, awkward, empty, real, rows

from helpgrid.llm import periodic_runs
from helpgrid.llm.words import of_texts


def slow_runs(words):
    found = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        x = 0
        while x + q < n:
            y = x
            while y + q < n and words[y] == words[y + q]:
                y += 1
            if y + q - x >= max(6, 4 * q):
                found.setdefault((x, y + q), q)
            x = max(y, x + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def repeated(doc_id, words):
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def runs_of(texts):
    words = of_texts([b" ".join(x) for x in texts])
    out = [[] for _ in texts]
    for t, *run in zip(*(x.tolist() for x in periodic_runs.find_runs(words))):
        out[t].append(tuple(run))
    return out


def made(pick, n):
    """Words with repetitions inside repetitions."""
    kind = pick.randrange(4)
    if kind == 0:
        return [pick.choice([b"a", b"b"]) for _ in range(n)]
    if kind == 1:
        unit = [pick.choice([b"a", b"b", b"c"]) for _ in range(pick.randint(1, 9))]
        return (unit * n)[: pick.randint(0, n)] + made(pick, n // 3 if n > 9 else 0) if n else []
    if kind == 2:
        unit = made(pick, pick.randint(0, max(1, n // 6)))
        return unit * pick.randint(3, 6) + [b"z"] * pick.randint(0, 7)
    return [b"%d" % pick.randrange(30) for _ in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_a_scan(seed, monkeypatch):
    if seed % 2:  # pairs in many small lots
        monkeypatch.setattr(periodic_runs, "MADE", 7)
        monkeypatch.setattr(periodic_runs, "EXTENDED", 5)
    pick = random.Random(seed)
    texts = [made(pick, pick.randint(0, 90)) for _ in range(120)] + [[], [b"a"] * 500, [b"a", b"b"] * 3, [b"a"] * 6, [b"a"] * 5]
    fibonacci = [[b"a"], [b"a", b"b"]]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts.append(fibonacci[-1] * 5)
    assert runs_of(texts) == [slow_runs(x) for x in texts]


def test_grammar_extends_like_a_scan():
    pick = random.Random(4)
    texts = [made(pick, 200) for _ in range(20)]
    words = of_texts([b" ".join(x) for x in texts])
    grammar = periodic_runs.Grammar(words)
    text = np.array([t for t in range(20) if len(texts[t]) > 1 for _ in range(50)])
    places = [sorted(pick.sample(range(len(texts[t])), 2)) for t in text]
    i, j = (grammar.base[text] + np.array([p[k] for p in places]) for k in (0, 1))
    for back in (False, True):
        got = grammar.extend(text, i, j, np.full(len(i), back))
        for t, (a, b), found in zip(text, places, got):
            w, n = texts[t], 0
            while (a - n - 1 >= 0 and w[a - n - 1] == w[b - n - 1]) if back else (b + n < len(w) and w[a + n] == w[b + n]):
                n += 1
            assert found == n


def test_query_equals_a_scan(spark):
    found = {r.doc_id: r for r in periodic_runs.op13_periodic_runs(spark, SF_DIR).collect()}
    docs = real(spark).collect()
    assert len(docs) == len(found)
    several = 0
    for doc in docs:
        words = repeated(doc.doc_id, doc.text.encode().split())
        runs, row = slow_runs(words), found[doc.doc_id]
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
        assert row.n_runs == len(runs)
        assert row.runs_sha256 == hashlib.sha256(listed).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, runs)).hexdigest()
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        wanted = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        assert (row.start, row.length, row.period, row.exponent_milli) == wanted
        several += len(runs) > 0
    assert several > 10


def test_awkward_texts(spark):
    for docs, given in ((awkward(spark), rows()), (awkward(spark).repartition(3), rows()), (empty(spark), [])):
        found = sorted((r.doc_id or -1, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.collapse_runs(docs).collect())
        wanted = []
        for row in given:
            words = (row[1] or "").encode().split()
            runs = [] if len(set(words)) == len(words) or len(words) > 50_000 else slow_runs(words) if len(words) < 300 else [(0, 10_000, 2)]
            wanted.append((row[0] or -1, runs, collapsed(words, runs).decode()))
        assert found == sorted(wanted)
    planted = periodic_runs.with_repetitions(awkward(spark)).collect()
    given = sorted((str(r[0]), b" ".join(repeated(r[0], (r[1] or "").encode().split()))) for r in rows())
    assert sorted((str(r.doc_id), b" ".join((r.text or "").encode().split())) for r in planted) == given

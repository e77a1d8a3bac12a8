"""Ranked search against a scan of all documents for each item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import awkward, empty, real, rows

from helpgrid.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def scan(docs, items, top=10):
    counts = [(i, Counter(terms(text))) for i, text in docs]
    n = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in counts:
            m = 25 + 75 * sum(c.values()) * n // total if total else 0
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:top], 1)]
    return sorted(out, key=str)


def found_in(docs, items, **options):
    return sorted((tuple(r) for r in ranked_search.rank_documents(docs, items, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"pass_bytes": 2000}, {"top": 3}])
def test_real_documents(spark, options, monkeypatch):
    docs, items = real(spark), real(spark, "benchmark")
    wanted = scan([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], options.get("top", 10))
    assert found_in(docs, items, **options) == wanted
    assert len(ranked_search._passes(items, 2000)) > 1
    assert found_in(docs.repartition(7), items, **options) == wanted


def test_awkward(spark):
    asked = [(1, "one of1 word3 word3"), (1, "Twice the SAME äö"), (2, None), (None, "no id x a b"), (3, ""), (4, "absent"), (5, "mail a@b.co 4111")]
    items = spark.createDataFrame([(*a, "z", 1) for a in asked], "item_id long, text string, rank string, score int")
    wanted = scan([r[:2] for r in rows()], asked)
    assert found_in(awkward(spark), items) == wanted
    assert found_in(awkward(spark), items, pass_bytes=10) == wanted
    assert found_in(empty(spark), items) == []
    assert found_in(awkward(spark), items.limit(0)) == []


def test_terms_and_lengths():
    for text in ("A-b_C9 é́ÀÉ\x7f~x¡", "", "…–", "ſK" + "K"):
        assert [t.decode() for t in ranked_search.terms_of(text.encode())] == terms(text)
    n = np.array([0, 3, 10**9])
    assert ranked_search._lengths(n, 10**12, 10**13).tolist() == [25 + 75 * x * 10**12 // 10**13 for x in n.tolist()]


@pytest.mark.parametrize("seed", range(5))
def test_mined_sets_add_up(seed):
    """Every item is the multiset of its terms, and shared sets save additions."""
    pick = random.Random(seed)
    common = [[pick.randrange(200) for _ in range(6)] for _ in range(4)]
    items = {i: [pick.randrange(200) for _ in range(pick.randint(1, 9))] + pick.choice(common) for i in range(40)}
    block = ranked_search.mine(items)
    whole = [Counter([int(t)]) for t in block.terms]
    for left, right in zip(block.left, block.right):
        assert left < len(whole) and right < len(whole)
        whole.append(whole[left] + whole[right])
    assert {i: sum((whole[p] for p in parts), Counter()) for i, parts in zip(block.items, block.parts)} == {i: Counter(t) for i, t in items.items()}
    assert len(block.left) + sum(len(p) - 1 for p in block.parts) < 0.8 * sum(len(t) - 1 for t in items.values())

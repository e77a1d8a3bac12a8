"""Toxicity, quality, personal data and language-model scores."""

import hashlib
import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from llm_cases import SF_DIR, awkward, empty, real, rows

from helpgrid.llm import lm_scoring, pii, quality, toxicity


def slow_segments(scores):
    """Maximal segments by the definition of Ruzzo and Tompa: recursion on the best segment."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 1e-12 and (best is None or total > best[0] + 1e-12):
                best = (total, a, b + 1)
    if best is None:
        return []
    _, a, b = best
    left = slow_segments(scores[:a])
    return left + [(a, b)] + [(x + b, y + b) for x, y in slow_segments(scores[b:])]


def test_lexicon_holds_every_sure_form(spark):
    counts = [(b"vile%d" % i, 9, 1) for i in range(40_000)] + [(b"kind%d" % i, 0, 4_000) for i in range(30_000)] + [(b"even", 50, 50)]
    lexicon, shares = toxicity.log_odds(spark.createDataFrame(counts, "form binary, toxic long, clean long"))
    assert {f for f, score in lexicon.items() if score > 0} >= {b"vile%d" % i for i in range(40_000)}
    for form, toxic, clean in counts[::997]:
        t, c = (sum(x[i] for x in counts) for i in (1, 2))
        prior = toxicity.PRIOR * (toxic + clean) / (t + c)
        a, b = toxic + prior, clean + prior
        odds = math.log(a / (t + toxicity.PRIOR - a)) - math.log(b / (c + toxicity.PRIOR - b))
        sure = abs(odds) - 2 * math.sqrt(1 / a + 1 / b)
        assert lexicon.get(form, 0.0) == pytest.approx(math.copysign(max(sure, 0.0), odds), rel=1e-9)
    assert sum(share for _, share in shares) == pytest.approx(1)


def test_maximal_segments():
    pick = np.random.default_rng(5)
    for _ in range(200):
        scores = pick.normal(-0.3, 1, pick.integers(0, 25))
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(scores)] == slow_segments(list(scores))


def test_toxicity(spark):
    labels = real(spark, "labels")
    found = {r.doc_id: r for r in toxicity.op3_toxicity(spark, SF_DIR).collect()}
    assert set(found) == {r.doc_id for r in real(spark).select("doc_id").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    odd = toxicity.score_toxicity(awkward(spark), labels)
    assert odd.count() == len(rows())
    assert toxicity.score_toxicity(empty(spark), labels).count() == 0
    none = toxicity.score_toxicity(awkward(spark), labels.limit(0))
    assert all(r.score < 0.01 for r in none.collect())


def test_toxicity_is_found_in_held_out_documents(spark):
    words = ["calm", "river", "stone", "house", "green", "walk", "table", "bread"]
    bad = ["vile", "scum"]
    texts, marks = [], []
    for i in range(400):
        text = [words[(i * 7 + j * j) % 8] for j in range(40)]
        if i % 4 == 0:
            text[5:7] = bad
        texts.append((i, " ".join(text)))
        marks.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame(marks + [(None, 1), (5, None)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(docs, labels).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in found)
    assert {r.segments for r in found if r.predicted} == {"5:7"}


def test_ordinal_slopes_equal_differences():
    pick = np.random.default_rng(1)
    score, grade, steps = pick.normal(size=6), np.array([0, 1, 2, 3, 1, 2]), np.array([-1.0, 0.2, -0.3])

    def loss(score, cuts):
        p = np.hstack([np.ones((6, 1)), quality.tails(score, cuts), np.zeros((6, 1))])
        return -np.log(p[np.arange(6), grade] - p[np.arange(6), grade + 1])

    cuts = quality.thresholds(steps)
    by_score, by_cut = quality.slopes(score, grade, cuts)
    assert by_score == pytest.approx((loss(score + 1e-6, cuts) - loss(score - 1e-6, cuts)) / 2e-6, abs=1e-5)
    for k in range(3):
        d = np.eye(3)[k] * 1e-6
        assert by_cut[:, k] == pytest.approx((loss(score, cuts + d) - loss(score, cuts - d)) / 2e-6, abs=1e-5)


def test_four_grades(spark):
    kinds = ["awful ### junk", "poor dull text", "fair plain words", "fine clear prose"]
    texts = [(i, " ".join([kinds[i % 4]] * 6 + [f"n{i}"])) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 2 * (i % 4)) for i in range(400)], "doc_id long, quality int")
    found = quality.grade_documents(docs, labels).collect()
    assert all(len(r.tails) == 3 and sorted(r.tails, reverse=True) == r.tails for r in found)
    assert sum(abs(r.expected_grade - 2 * (r.doc_id % 4)) < 1 for r in found) > 380


def test_quality(spark):
    labels = {r.doc_id: r.quality for r in real(spark, "labels").collect()}
    found = quality.op9_quality(spark, SF_DIR).collect()
    assert len(found) == real(spark).count()
    right = [r.accepted == (labels[r.doc_id] == 1) for r in found if r.doc_id in labels]
    assert sum(right) >= 0.9 * len(right)
    kept = quality.accepted(spark, awkward(spark), SF_DIR)
    assert kept.columns == awkward(spark).columns
    assert all((r.text or "").split() for r in kept.collect())
    assert quality.accepted(spark, empty(spark), SF_DIR).count() == 0
    only = quality.grade_documents(awkward(spark), real(spark, "labels").limit(0))
    assert {r.expected_grade for r in only.collect()} == {0.0}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


TRICKY = [
    "a@b.c_d@e.f x@y.z. x@y.com- @.@.a@b..c",
    "1.2.3.4.5.6.7.8 256.1.1.1 00001.002.3.255 1.2.3",
    "4111 1111 1111 1111 x 4111-1111-1111-1112 +1 (555) 123-4567 + 5 +12",
    "é😀 a@b.co +49 30 1234567 " * 200,
    "a" * 50_000 + "@" + "b." * 3000 + "c",
    "1." * 9000,
    'token = "1eb9c654e721b4f812088970e66a6345cee33dd6" mail 555-123-4567',
]


def test_personal_data(spark):
    docs = real(spark).select("doc_id", "text")
    extra = spark.createDataFrame([(10**6 + i, x) for i, x in enumerate(TRICKY)], "doc_id long, text string")
    for frame in (awkward(spark).select("doc_id", "text"), docs.unionByName(extra)):
        pairs = Counter()
        for r in frame.collect():
            spans = base_spans(r.text)
            kinds = Counter(s.split(":")[0] for s in spans)
            sha = hashlib.sha256(",".join(spans).encode()).hexdigest()
            pairs[(r.doc_id, *(kinds[k] for k in PATTERNS), sha)] += 1
        found = pii.find_personal_data(frame).collect()
        assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found) == pairs
    assert pii.find_personal_data(empty(spark)).count() == 0


def test_added_spans_keep_the_base(spark):
    texts = {r.doc_id: r.text for r in real(spark).collect()}
    for r in pii.op5_pii(spark, SF_DIR).collect():
        spans = [s for s in r.spans.split(",") if s]
        assert set(base_spans(texts[r.doc_id])) <= set(spans)
        assert len(spans) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added


def test_estimate_finds_the_reliable_labelers():
    pick = np.random.default_rng(2)
    votes = Counter()
    for _ in range(5000):
        truth = pick.random() < 0.4
        say = [int(truth if pick.random() < p else not truth) * 2 - 1 for p in (0.95, 0.9, 0.8, 0.55, 0.5)]
        votes[tuple(say)] += 1
    found = pii.estimate([("x", v, n) for v, n in sorted(votes.items())])
    assert found["truth"]["x", (1, 1, 1, -1, -1)] > 0.95 > 0.05 > found["truth"]["x", (-1, -1, -1, 1, 1)]
    right = found["says"][1, :, 2]
    assert right[0] > right[2] > right[4] and right[0] == pytest.approx(0.95, abs=0.04)


def expected_base(pairs):
    tokens = [(text or "").encode().lower().split() + [None] for _, text in pairs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in pairs]
    counts = Counter(t for ts, h in zip(tokens, held) if not h for t in ts)
    n, v = sum(counts.values()), len(counts)
    for (doc_id, _), ts, h in zip(pairs, tokens, held):
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        yield doc_id, h, len(ts), sum(counts[t] > 0 for t in ts), n, round(base, 4)


@pytest.mark.parametrize("frequent", [1 << 17, 50])  # all words known to the tasks, and most of them joined
def test_base_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    for docs in (awkward(spark), real(spark)):
        pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        found = lm_scoring.score_texts(docs).collect()
        got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found)
        assert got == Counter(expected_base(pairs))
        assert all(r.score < 0 for r in found)
    assert lm_scoring.score_texts(empty(spark)).count() == 0


def test_probabilities_add_up():
    vocabulary = lm_scoring.Vocabulary(np.arange(1000) * 7919, np.arange(1000, 0, -1), {i: (2000, 9) for i in range(512)}, 1024_000, 4608)
    pick = np.random.default_rng(0)
    weights = pick.normal(0, 0.5, (3 * lm_scoring.BUCKETS + vocabulary.cells, lm_scoring.CLASSES)).astype(np.float32)
    members = lm_scoring.member_logs(pick.integers(0, 4, (lm_scoring.BUCKETS,) * 2), vocabulary.share)
    total = 0.0
    for b in range(lm_scoring.BUCKETS):
        places, target = lm_scoring.contexts(np.array([77, 9, 3, b], np.int16), vocabulary.cells)
        assert places[:3].tolist() == [[3], [1024 + 9], [2048 + 77]] and target.tolist() == [b]
        total += math.exp(lm_scoring.log_probability(weights, vocabulary.class_bias(), members, places, target)[0])
    assert total == pytest.approx(1, abs=1e-4)


def test_training_learns_what_follows(spark):
    docs = spark.createDataFrame([(i, "tick tock " * 60) for i in range(40)], "doc_id long, text string")
    for r in lm_scoring.score_texts(docs).collect():
        assert r.score > r.base_score


def slow_model(sequences, vocabulary, end):
    """One gradient step over all positions and the counted second factor, by the formulas: ln P(bucket | context)."""
    one = lm_scoring
    table = np.zeros((3 * one.BUCKETS + vocabulary.cells, one.CLASSES))
    share = vocabulary.share / vocabulary.share.sum()
    by_class = share.reshape(one.CLASSES, one.MEMBERS).sum(axis=1)
    follows = Counter()

    def features(sequence, i):
        back = [sequence[i - k] if i >= k else end for k in (1, 2, 3)]
        cell = ((back[0] * one.BUCKETS + back[1]) * 0x9E3779B1 % 2**32) * vocabulary.cells >> 32
        return [back[0], one.BUCKETS + back[1], 2 * one.BUCKETS + back[2], 3 * one.BUCKETS + cell]

    def classes(at):
        x = np.log(by_class) + table[at].sum(axis=0)
        return np.exp(x) / np.exp(x).sum()

    slopes = [{} for _ in range(4)]  # each kind of feature makes its step by itself
    for s in sequences:
        for i, b in enumerate(s):
            at = features(s, i)
            slope = classes(at) - (np.arange(one.CLASSES) == b // one.MEMBERS)
            for kind, row in zip(slopes, at, strict=True):
                kind[row] = kind.get(row, 0) + slope
            follows[at[0], b] += 1
    for kind in slopes:
        for row, slope in kind.items():
            table[row] -= one.RATE * slope / (np.sqrt(0.5 + slope**2) + 1e-4)

    def log_of(s, i):
        at, b = features(s, i), s[i]
        low = b // one.MEMBERS * one.MEMBERS
        n = sum(follows[at[0], c] for c in range(low, low + one.MEMBERS))
        member = (follows[at[0], b] + one.PRIOR * share[b] / by_class[b // one.MEMBERS]) / (n + one.PRIOR)
        return math.log(classes(at)[b // one.MEMBERS] * member)

    return log_of


def test_scores_are_those_of_the_formulas(spark):
    rows = [(i, text) for i, text in enumerate(["a b c a b", "b c", None, "", "c C x a  b\na", "unseen words"] * 4)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    words = {i: (text or "").lower().split() + [None] for i, text in rows}
    counts = Counter(w for i, ws in words.items() if i not in held for w in ws)
    code = {w: lm_scoring.END if w is None else lm_scoring.word_hash(w.encode()) for ws in words.values() for w in ws}
    top = sorted(counts, key=lambda w: (-counts[w], code[w]))
    low = {w: code[w] & (lm_scoring.OWN - 1) for w in top}
    rest = {x: (sum(counts[w] for w in top if low[w] == x), sum(low[w] == x for w in top)) for x in low.values()}
    vocabulary = lm_scoring.Vocabulary(
        np.array([code[w] for w in top]), np.array([counts[w] for w in top]), rest, counts.total(), len(top)
    )
    bucket = {w: top.index(w) if w in top else lm_scoring.OWN + (code[w] & (lm_scoring.OWN - 1)) for w in code}
    sequences = {i: [bucket[w] for w in ws] for i, ws in words.items()}
    log_of = slow_model([s for i, s in sequences.items() if i not in held], vocabulary, bucket[None])
    got = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and held
    for r in got:
        s = sequences[r.doc_id]
        gain = sum(log_of(s, i) - math.log(vocabulary.share[b]) for i, b in enumerate(s)) / math.log(10)
        assert r.score == pytest.approx(r.base_score + gain, abs=1e-4)


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD", 1 << 14)
    docs = real(spark).select("doc_id", "text")
    found = [
        {r.doc_id: r.score for r in lm_scoring.score_texts(docs.repartition(n)).select("doc_id", "score").collect()} for n in (1, 7)
    ]
    assert found[0].keys() == found[1].keys()
    assert all(found[0][i] == pytest.approx(found[1][i], rel=1e-6) for i in found[0])


def test_every_position_is_trained(monkeypatch):
    taught = Counter()
    monkeypatch.setattr(lm_scoring, "PIECE", 700)
    monkeypatch.setattr(lm_scoring, "train_step", lambda w, s, bias, places, target: taught.update(target.tolist()))
    texts = [" ".join(["tick", "tock"] * 10)[: 5 * i] for i in range(1, 20)] + ["tick " * 5_000, None, ""]
    words = [(text or "").encode().split() for text in texts]
    counts = Counter(lm_scoring.word_hash(w) for ws in words for w in ws) + Counter({lm_scoring.END: len(words)})
    top = counts.most_common()
    vocabulary = lm_scoring.Vocabulary(np.array([w for w, _ in top]), np.array([n for _, n in top]), {}, counts.total(), len(top))
    given = {"text": pa.array([t and t.encode() for t in texts], pa.binary())}
    given |= {n: pa.array([1] * len(texts), pa.int64()) for n in ("row", "doc_id", "key")} | {"held_out": pa.array([False] * len(texts))}
    encoded = list(lm_scoring._encode(SimpleNamespace(value=vocabulary))([pa.record_batch(given)]))
    flat = np.zeros((3 * lm_scoring.BUCKETS + vocabulary.cells, lm_scoring.CLASSES), np.float32)
    pieces = pa.Table.from_batches(lm_scoring._pieces(0, 3)(encoded))
    assert set(pieces.column("shard").to_pylist()) == {0, 1, 2}
    seen, follows = 0, 0
    for shard in range(3):
        mine = pieces.filter(pc.equal(pieces.column("shard"), shard)).to_batches()
        (blocks,) = lm_scoring._train(SimpleNamespace(value=(vocabulary, flat)))(mine)
        seen += blocks.column("seen").to_pylist()[0]
        follows += sum(np.frombuffer(x.as_py(), np.int32).sum() for x in blocks.column("counts"))
    assert taught == Counter({i: n for i, (_, n) in enumerate(top)})
    assert seen == follows == counts.total()

"""Exact dedup, mixing and token counts."""

import hashlib
import heapq
import random
import re
from collections import Counter, defaultdict

import pytest
from llm_cases import SF_DIR, TEXTS, awkward, empty, real, rows

from helpgrid.llm import exact_dedup, mixing, token_counts
from helpgrid.llm.exact_dedup import exact_duplicates
from helpgrid.session import scratch_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected_duplicates(pairs):
    groups = defaultdict(list)
    for doc_id, text in pairs:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out.update((i, keep, len(ids), sha) for i in ids)
    return out, len(groups)


@pytest.mark.parametrize("max_cells", [1 << 29, 1 << 6])  # one class of hashes and several
def test_exact_duplicates(spark, max_cells):
    for docs in (awkward(spark), real(spark)):
        pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        found = exact_duplicates(docs, max_cells if len(pairs) < 50 else 1 << 29).collect()
        wanted, groups = expected_duplicates(pairs)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == wanted
        kept = [r for r in found if r.kept]
        assert len(kept) == len({r.text_sha256 for r in kept}) == groups
        assert all(r.doc_id == r.keep_id for r in kept)
    assert exact_duplicates(empty(spark)).count() == 0


def test_each_class_reads_its_own_folder(spark, monkeypatch):
    plans, pairs = [], [(r.doc_id, r.text) for r in real(spark).select("doc_id", "text").collect()]
    flagged = exact_dedup._flagged

    def seen(rows, n):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        found = flagged(rows, n)
        assert rows.count() < len(pairs)
        return found

    monkeypatch.setattr(exact_dedup, "_flagged", seen)
    found = exact_duplicates(real(spark), len(pairs) * exact_dedup.CELLS_PER_ROW // 3).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected_duplicates(pairs)[0]
    assert len(plans) >= 3
    assert all(re.search(r"PartitionFilters: \[[^\]]*class", plan) for plan in plans)


def slow_apportion(votes, seats):
    won = [0] * len(votes)
    heap = [(-v, i) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i = heapq.heappop(heap)
        won[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * won[i] + 1), i))
    return won


def test_apportion_equals_seat_by_seat():
    pick = random.Random(3)
    for _ in range(200):
        votes = [pick.choice([0, 1.0, 5.0, pick.random() * 100]) for _ in range(pick.randint(1, 9))]
        seats = pick.randint(0, 70)
        assert list(mixing.apportion(votes, seats)) == slow_apportion(votes, seats)


def test_capped_targets():
    assert mixing.capped_targets([10, 100, 100], [5, 2, 1]) == [30, 120, 60]
    assert mixing.capped_targets([0, 0], [5, 2]) == [0, 0]
    assert mixing.capped_targets([], []) == []


def words(text):
    return len((text or "").encode().split())


@pytest.mark.parametrize("shard_words,slack", [(1 << 19, 60), (500, 4000)])  # one shard a source, and shards of a document or two
def test_mix(spark, shard_words, slack):
    docs = real(spark)
    found = mixing.mix_sources(docs, shard_words=shard_words).collect()
    assert {r.doc_id: r["size"] for r in found} == {r.doc_id: words(r.text) for r in docs.collect()}
    total = Counter()
    for r in found:
        total[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0
    targets = {r.source: r.target for r in found}
    sizes = {r.source: r.source_size for r in found}
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    for source, target in targets.items():
        assert target <= 3 * sizes[source] + 1e-6
        assert abs(total[source] - target) <= max(0.05 * target, slack)
    again = mixing.mix_sources(docs.repartition(7), shard_words=shard_words).collect()
    assert Counter(again) == Counter(found)


def test_mix_of_awkward_documents(spark):
    found = mixing.mix_sources(awkward(spark)).collect()
    assert Counter((r.doc_id, r["size"]) for r in found) == Counter((r[0], words(r[1])) for r in rows())
    assert all(r.taken == 0 for r in found if r["size"] == 0)
    assert mixing.mix_sources(empty(spark)).count() == 0
    assert mixing.mixed(spark, empty(spark), SF_DIR).count() == 0
    kept = mixing.mixed(spark, awkward(spark), SF_DIR)
    assert all(r.taken == r.repeats * r.n_words > 0 and r.text in TEXTS + ["no id"] for r in kept.collect())


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in store.totals().collect()}


def test_rollup_follows_inserts_revisions_and_deletes(spark):
    counters = {"words-1": token_counts.words}
    store = token_counts.TokenRollup(spark, scratch_path(spark, "rollup"))
    assert totals(store) == {}
    docs = awkward(spark)
    assert store.commit("1", token_counts.counted(docs, counters))
    assert not store.commit("1", token_counts.counted(docs, counters))
    wanted = defaultdict(lambda: (0, 0))
    for r in rows():
        n, t = wanted[r[3], r[2], "words-1"]
        wanted[r[3], r[2], "words-1"] = n + 1, t + words(r[1])
    assert totals(store) == dict(wanted)
    revised = spark.createDataFrame([(7, "now five words in it", "en", "s1")], "doc_id long, text string, lang string, source string")
    store.commit("2", token_counts.counted(revised, counters), deletes=spark.createDataFrame([(12,), (999,)], "doc_id long"))
    n, t = wanted["s1", "en", "words-1"]
    wanted["s1", "en", "words-1"] = n, t + 5 - words(TEXTS[7])
    n, t = wanted["s0", "en", "words-1"]
    wanted["s0", "en", "words-1"] = n - 1, t - words(TEXTS[12])
    assert totals(store) == dict(wanted)
    store.commit("3", token_counts.counted(empty(spark), counters))
    assert totals(store) == dict(wanted)


def test_token_query_equals_recounting(spark):
    bpe = token_counts.BytePairs()()
    labels = real(spark, "labels").collect()
    low, toxic = {r.doc_id for r in labels if r.quality == 0}, {r.doc_id for r in labels if r.toxic == 1}
    wanted = defaultdict(lambda: [0, 0])
    for r in real(spark).collect():
        if r.doc_id not in low:
            text = "".join("0" if c in "0123456789" else c for c in r.text) if r.doc_id in toxic else r.text
            for name, n in (("words-1", words(text)), ("byte_bpe_50k-1", bpe(text))):
                wanted[r.source, r.lang, name][0] += 1
                wanted[r.source, r.lang, name][1] += n
    found = token_counts.op6_token_counts(spark, SF_DIR).collect()
    assert {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in found} == dict(wanted)

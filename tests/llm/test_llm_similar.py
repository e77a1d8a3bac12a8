"""Line dedup, the n-gram join and decontamination."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from llm_cases import SF_DIR, awkward, empty, real, rows
from pyspark.sql import functions as F

from helpgrid.llm import decontamination, ngram_join
from helpgrid.llm.common import hash_filter
from helpgrid.llm.line_dedup import dedup_lines
from helpgrid.llm.ngram_join import linked_documents, op4_ngram_join


def lines_of(text):
    return [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]


def long_enough(run):
    return len(run) >= 3 or sum(len(x.encode().split()) for x in run) >= 50


def removed_lines(pairs):
    """Every line inside any long-enough run that stands earlier, by trying all runs."""
    seen, gone = {}, defaultdict(set)
    order = sorted(set(pairs), key=lambda p: (p[0] is not None, p[0] or 0))
    for doc_id, text in order:
        lines = [x.strip(" ") for x in lines_of(text)]
        for a in range(len(lines)):
            for b in range(a + 1, min(len(lines), a + 4) + 1):
                run = tuple(lines[a:b])
                if long_enough(run):
                    if run in seen:
                        gone[doc_id, text].update(range(a, b))
                    else:
                        seen[run] = True
    return gone


def test_lines(spark):
    for docs in (awkward(spark), real(spark)):
        found = dedup_lines(docs).select("doc_id", "text", "removed", "n_lines", "n_removed").collect()
        pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        gone = removed_lines(pairs)
        wanted = Counter()
        for doc_id, text in pairs:
            at = gone.get((doc_id, text), set())
            left, i = [], 0
            for line in (text or "").split("\n"):
                if not line.strip(" \t\r\x0b\x0c"):
                    left.append(line)
                    continue
                if i not in at:
                    left.append(line)
                i += 1
            after = None if text is None else "\n".join(left)
            wanted[doc_id, after, tuple(sorted(at)), len(lines_of(text)), len(at)] += 1
        assert Counter((r.doc_id, r.text, tuple(r.removed), r.n_lines, r.n_removed) for r in found) == wanted
    columns = dedup_lines(empty(spark))
    assert columns.count() == 0 and columns.columns.count("removed") == 1


def sets_of(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def expected_components(pairs, width, percent):
    sets = [sets_of(text, width) for _, text in pairs]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders[g] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(pairs):
        least[find(i)].append(doc_id)
    named = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return Counter((doc_id, len(sets[i]), named[find(i)] if sets[i] else doc_id) for i, (doc_id, _) in enumerate(pairs))


def family(n=60):
    """Near copies of one text at all distances, and chains of slow change."""
    base = [f"w{i}" for i in range(120)]
    out = [" ".join(base)]
    for i in range(n):
        words = list(base)
        for j in range(i % 5):
            words[(i * 7 + j * 29) % 120] = f"edit{i}-{j}"
        out.append(" ".join(words[: 120 - i % 4]))
    chain = [f"c{i}" for i in range(80)]
    for i in range(15):
        chain = chain[:]
        chain[(i * 5) % 80] = f"step{i}"
        out.append(" ".join(chain))
    return list(enumerate(out, start=100))


def test_links(spark):
    made = spark.createDataFrame(family(), "doc_id long, text string")
    for docs, width, percent in ((awkward(spark), 4, 85), (made, 4, 85), (made, 5, 80), (made, 2, 60), (real(spark), 5, 80)):
        pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        found = linked_documents(docs, width, percent).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == expected_components(pairs, width, percent)
    assert linked_documents(empty(spark)).count() == 0


def test_link_query(spark):
    pairs = [(r.doc_id, r.text) for r in real(spark).collect()]
    found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in op4_ngram_join(spark, SF_DIR).collect())
    assert found == expected_components(pairs, 4, 85)


QUESTION = "A train leaves for the distant town with 35 km to go and the driver meets Anna on the way after 2 hours of travel today"


def test_templates(spark):
    items = [(1, QUESTION), (2, None), (3, ""), (None, "no id at all in this one here now"), (4, "short but whole item")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = {
        1: "Words before. " + QUESTION + " Words after.",
        2: QUESTION.replace("35", "72").replace("Anna", "Peter").replace("2 hours", "9 days"),
        3: QUESTION.upper(),
        4: "Nothing of that kind is in here, only other words about 35 km and Anna.",
        5: "They say: short, but whole item!",
        6: " ".join(QUESTION.split()[:9]),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.reparameterised for r in decontamination.contaminated(docs, benchmark).collect()}
    assert found == {(1, 1): False, (2, 1): True, (5, 4): False} | ({(3, 1): False} if (3, 1) in found else {})


def test_inconsistent_slots_do_not_match(spark):
    item = "Add 5 to the number 5 and then take 5 away from what is left of the number 5 again"
    other = item.replace("5", "{}").format(1, 2, 3, 4)
    docs = spark.createDataFrame([(1, other), (2, item.replace("5", "8"))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in decontamination.contaminated(docs, benchmark).collect()] == [2]


def test_decontamination_of_the_tables(spark):
    grams = set()
    for r in real(spark, "benchmark").collect():
        words = r.text.lower().split()
        grams.update(tuple(words[i : i + 13]) for i in range(len(words) - 12))
    wanted = set()
    for r in real(spark).collect():
        words = r.text.lower().split()
        if any(tuple(words[i : i + 13]) in grams for i in range(len(words) - 12)):
            wanted.add(r.doc_id)
    found = {r.doc_id for r in decontamination.op8_decontamination(spark, SF_DIR).collect()}
    assert wanted <= found and len(found - wanted) <= 1
    left = decontamination.decontaminated(spark, real(spark), SF_DIR)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in real(spark).collect()} - found


def test_awkward_documents_are_clean(spark):
    left = decontamination.decontaminated(spark, awkward(spark), SF_DIR)
    assert left.columns == awkward(spark).columns and left.count() == len(rows())
    assert decontamination.decontaminated(spark, empty(spark), SF_DIR).count() == 0
    assert decontamination.contaminated(real(spark), real(spark, "benchmark").limit(0)).count() == 0


def found_by_text(spark, item, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    return {r.doc_id: r.reparameterised for r in decontamination.contaminated(docs, benchmark).collect()}


def test_values_of_other_lengths_and_case(spark):
    item = "Yesterday the teacher told John to share 3 kg of ripe apples with Paul before the class began and then count what was left"
    other = item.replace("John", "Mary Ann").replace("Paul", "Jean Luc Marc")
    texts = [other, item.replace("3 kg", "3kg"), item.replace("3 kg", "12kg"), item.upper(), item.title(), item.lower().replace("3 kg", "7kg")]
    texts.append("Yesterday the teacher went home with Mary Ann and 3 kg of other things that nobody ever wanted to share")
    assert found_by_text(spark, item, texts) == {0: True, 1: False, 2: True, 3: False, 4: False, 5: True}


def test_names_at_the_start_of_sentences(spark):
    item = "John has many red apples in his bag. John gives some of them to a friend. Paul eats all that he gets from him. How many are left?"
    texts = [item.replace("John", "Mary Ann").replace("Paul", "Luc"), item.replace("John gives", "Peter gives").replace("Paul", "John")]
    assert found_by_text(spark, item, texts)[0] is True


def test_items_of_numbers_names_or_few_words(spark):
    items = ["Compute 12 + 34 * 56 - 78 = ?", "Solve 3 4 5 6 7 8 9 10 now please", "Who Wrote The Great Gatsby And When?", "Define entropy."]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"Some words before it. {x} And some words after it." for x in items[:3]] + ["Read this:\ndefine entropy\nand more words"]
    texts += ["Compute 12 + 34 * 56 - 79 = ?", "Solve 3 4 5 6 7 8 9 11 now please", "Who Wrote The Great Novel And When?", "They define entropy as follows"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.item_id, r.reparameterised) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert found == {(i, i, False) for i in range(4)}


def test_filter_of_hashes(spark):
    hashes = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 220_000)
    inside, absent = hashes[:20_000], hashes[20_000:]
    frame = spark.createDataFrame([(int(x),) for x in inside], "h long").repartition(5)
    made = hash_filter(frame, len(inside))
    assert made.may_have(inside).all() and made.may_have(absent).mean() < 0.005
    assert made.may_have(absent[:0]).shape == (0,)
    assert not hash_filter(frame.limit(0), 0).may_have(inside).any()


def test_windows_of_several_texts_are_those_of_each():
    texts = [QUESTION, "", "two words", QUESTION.title(), "Anna Maria Smith saw 12 kg 5 3 kg.", "1 2 3 4 5 6 7 8 9", "kg of a b c d e f g h"] * 2
    classes = decontamination.WordCache(decontamination.classify)
    codes = [classes.values_of(x.encode().split()) for x in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in codes])

    def rows(codes, owner, first=0):
        for view, wide, home, hashes, at, lengths, slots, *_ in decontamination.windows(codes, owner, (8, 3)):
            ends = np.cumsum(lengths)
            for k, (i, h, a) in enumerate(zip(home, hashes, at, strict=True)):
                yield view, wide, int(i) + first, int(h), int(a), tuple(slots[ends[k] - lengths[k] : ends[k]].tolist())

    alone = [x for i, own in enumerate(codes) for x in rows(own, np.zeros(len(own), np.int64), i)]
    assert sorted(alone) == sorted(rows(np.concatenate(codes), owner)) and len(alone) > 100


def test_few_bits_of_a_shingle(monkeypatch, spark):
    """Repeated shingles are looked for by a part of their bits: with hardly any left, all links are the same."""
    wanted = sorted(linked_documents(real(spark), 4, 85).collect())
    monkeypatch.setattr(ngram_join, "SHORT", 7)
    assert sorted(linked_documents(real(spark), 4, 85).collect()) == wanted


def test_sketch_of_a_task_is_small():
    counts = np.random.default_rng(3).poisson(0.16, ngram_join.SKETCH_SEGMENT).astype(np.uint16)
    counts[[5, 70, 900, 65535]] = [14, 15, 16, 65535]
    packed = ngram_join._packed(counts)
    assert (ngram_join._unpacked(packed) == counts).all()
    assert 3 * len(packed) < 2 * len(zlib.compress(counts.tobytes(), 1))


def test_filter_comes_in_few_jobs(spark):
    """A job for each partition made the join slower the more partitions were set."""
    tracker, group = spark.sparkContext.statusTracker(), "filter-jobs"
    hashes = spark.range(0, 100_000, 1, 4).select(F.xxhash64("id").alias("h")).localCheckpoint()
    given = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.sparkContext.setJobGroup(group, "filter")
    try:
        found = hash_filter(hashes, 100_000)
        assert len(tracker.getJobIdsForGroup(group)) < 10
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", given)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.may_have(hashes.toPandas()["h"].to_numpy()).all()

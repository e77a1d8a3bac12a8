"""N-gram Jaccard join with adaptive multi-match prefixes.

Two sets of word shingles link when 100 * intersection >= percent * union. Shingles are put in one global
order, rare ones first. If two sets share at least c shingles, their prefixes of n - c + l shingles share at
least l. Every set picks its own l: a longer prefix meets more sets, but demands more shared
shingles of each before it is verified, and the estimated cost of both decides.

Steps, all on tables in the shared folder:

1. Rarity: every task counts shingles in a sketch of bounded size; the merged sketch is broadcast as one byte a cell.
   It only orders shingles, so its errors cost time, never links.
2. Prefixes of all documents. Equal sets share a key and count as one from here on.
3. Prefix shingles met by two keys or more remain, and keys that still have as many of them as they demand; only
   their sets are written for verification.
4. Rounds: in each prefix shingle that still joins different components, the sets are verified
   against one hub, each with the hub it shares most with. The first hubs are the sets with fewest
   shingles of their own. So a group of near copies costs one verification a member, not one a pair.
5. What is left: for every prefix shingle with several components, the members outside the largest one meet all
   members of other components. All pairs that pass the bounds below are verified, with no cap.
6. Components by label propagation over the verified links.

Bounds on a pair, all exact: sizes must allow the similarity; what both can still share from a common shingle on must reach the
overlap that their sizes demand; there must be as many shared prefix shingles as that overlap leaves once
everything behind the prefixes is counted as shared; and from the first of them on, both must have as many.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpgrid.llm.common import (
    WordCache,
    documents,
    drop_stored,
    hash_filter,
    only_keys,
    rows_of,
    ship_package,
    shingle_hashes,
    shingles,
    stored,
)

#: Cells of the rarity sketch: one for four shingles, up to a fixed number (a byte each in the broadcast).
SKETCH_SEGMENT, MAX_SEGMENTS = 1 << 16, 1 << 9
SHORTEST, LONGEST = 32, 16  # a set of n picks an l of at least n / SHORTEST and at most n / LONGEST, or 8
VERIFY_COST = 4  # a list entry against a shingle compared in verification, which costs one for so many
SHORT = (1 << 40) - 1  # the bits of a shingle by which repeated ones are looked for; fewer bytes to shuffle
ROUNDS = 4
SUB = 256  # documents handled together inside a task


def _sets(batch, width: int, words: WordCache):
    """(row in the batch, sorted distinct shingles) of every text."""
    for i, text in enumerate(batch.column("text")):
        value = text.as_py()
        yield i, shingles(words.values_of(value.lower().split()) if value else np.empty(0, np.uint64), width)


def _key(of: np.ndarray, seed: int) -> int | None:
    return xxhash.xxh64_intdigest(of.tobytes(), seed) - (1 << 63) if len(of) else None


def _text_hash(text) -> int:
    return xxhash.xxh64_intdigest(text.as_py() or b"") - (1 << 63)


def _cell(of: np.ndarray, cells: int) -> np.ndarray:
    return (of % np.uint64(cells)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts of one task, most of them 0 or 1: four bits a cell, 15 for more, and the larger ones after them in order."""
    low = np.minimum(counts, 15).astype(np.uint8)
    return zlib.compress((low[::2] | low[1::2] << 4).tobytes() + counts[counts >= 15].astype(np.uint16).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    data = zlib.decompress(packed)
    pairs = np.frombuffer(data, np.uint8, SKETCH_SEGMENT // 2)
    counts = np.empty(SKETCH_SEGMENT, np.uint16)
    counts[::2], counts[1::2] = pairs & 15, pairs >> 4
    counts[counts == 15] = np.frombuffer(data, np.uint16, offset=SKETCH_SEGMENT // 2)
    return counts


def _sketch(width: int, cells: int):
    def add(counts, pending):
        if pending:
            at, n = np.unique(_cell(np.concatenate(pending), len(counts)), return_counts=True)
            counts[at] = np.minimum(counts[at].astype(np.int64) + n, 65535)
            pending.clear()

    def run(batches):
        words, counts, pending = WordCache(), np.zeros(cells, np.uint16), []
        for batch in batches:
            for text in batch.column("text"):
                pending.append(shingle_hashes(words.values_of((text.as_py() or b"").lower().split()), width))
                if len(pending) >= SUB:
                    add(counts, pending)
        add(counts, pending)
        for segment in range(cells // SKETCH_SEGMENT):
            part = counts[segment * SKETCH_SEGMENT :][:SKETCH_SEGMENT]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment]), pa.array([_packed(part)], pa.binary())],
                    names=["segment", "counts"],
                )

    return run


def _merge(batches):
    """Adds up the counts of each segment, in streams sorted by segment; one byte a cell: log2 in half steps."""

    def coded():
        return pa.RecordBatch.from_arrays(
            [pa.array([current]), pa.array([np.round(2 * np.log2(1 + total)).astype(np.uint8).tobytes()], pa.binary())],
            names=["segment", "classes"],
        )

    current, total = None, None
    for batch in batches:
        for segment, counts in zip(*(batch.column(c).to_pylist() for c in ("segment", "counts")), strict=True):
            if segment != current:
                if current is not None:
                    yield coded()
                current, total = segment, np.zeros(SKETCH_SEGMENT, np.int64)
            total += _unpacked(counts)
    if current is not None:
        yield coded()


def least_overlap(n, percent: int):
    """Shingles that a set of n shares at least with any set it links to."""
    return -(-percent * n // 100)


def prefix(of: np.ndarray, classes: np.ndarray, percent: int, floor: float) -> tuple[np.ndarray, int]:
    """The prefix of a set in the global order (rarity class, then hash) and its number of demanded matches."""
    n = len(of)
    rarity = classes[_cell(of, len(classes))]
    ranked = np.argsort((rarity.astype(np.uint64) << np.uint64(56)) | (of >> np.uint64(8)), kind="stable")
    least = int(least_overlap(n, percent))
    most = min(max(8, n // LONGEST), least)
    ranked = ranked[: n - least + most]
    met = np.cumsum(np.maximum(2.0 ** (rarity[ranked] / 2) - floor, 0.01))
    matches = np.arange(max(1, n // SHORTEST), most + 1)
    at = met[n - least + matches - 1]
    best = int(matches[np.argmin(at * (1 + n / VERIFY_COST / matches))])
    return of[ranked[: n - least + best]], best


def _prefixes(width: int, percent: int, seed: int, shared):
    def run(batches):
        words, classes = WordCache(), shared.value
        floor = float(np.median(2.0 ** (classes[:SKETCH_SEGMENT] / 2)))
        for batch in batches:
            ids, seen = batch.column("doc_id"), set()
            rows: list[tuple] = []
            for i, of in _sets(batch, width, words):
                key, check = _key(of, seed), _key(of, seed + 1)
                tokens, matches = (None, None)
                if key is not None and key not in seen:
                    seen.add(key)
                    tokens, matches = prefix(of, classes, percent, floor)
                    tokens = tokens.view(np.int64)
                rows.append((i, len(of), key, check, matches, tokens, _text_hash(batch.column("text")[i])))
                if len(rows) >= SUB:
                    yield _prefix_rows(ids, rows)
                    rows = []
            if rows:
                yield _prefix_rows(ids, rows)

    return run


def _open_postings(shared):
    """The prefix shingles of a document that may be in the filter, with their places."""

    def run(batches):
        for batch in batches:
            tokens = batch.column("tokens")
            flat = tokens.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), tokens.value_lengths().to_numpy(zero_copy_only=False).astype(int))
            first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1]) if len(row) else np.empty(0, int)
            place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
            on = np.flatnonzero(shared.value.may_have(flat & SHORT)) if len(flat) else np.empty(0, int)
            at = pa.array(row[on])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in ("key", "n", "matches", "length")]
                + [pa.array(place[on], pa.int32()), pa.array(flat[on], pa.int64())],
                names=["key", "n", "matches", "length", "at", "token"],
            )

    return run


POSTINGS = "key long, n long, matches int, length int, at int, token long"


def _prefix_rows(ids, rows):
    i, n, key, check, matches, tokens, text = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(i)),
            pa.array(n, pa.int64()),
            pa.array(key, pa.int64()),
            pa.array(check, pa.int64()),
            pa.array(matches, pa.int32()),
            pa.array(tokens, pa.list_(pa.int64())),
            pa.array(text, pa.int64()),
        ],
        names=["doc_id", "n", "key", "check", "matches", "tokens", "text"],
    )


def _wanted_sets(width: int, seed: int, shared):
    def run(batches):
        words, wanted = WordCache(), shared.value
        for batch in batches:
            text_hashes = np.array([_text_hash(x) for x in batch.column("text")], np.int64)
            keys, sets, seen = [], [], set()
            for _, of in _sets(batch.filter(pa.array(wanted.may_have(text_hashes))), width, words):
                key = _key(of, seed)
                if key is None or key in seen:
                    continue
                seen.add(key)
                keys.append(key)
                sets.append(of.view(np.int64))
                if len(keys) >= SUB:
                    yield _set_rows(keys, sets)
                    keys, sets = [], []
            if keys:
                yield _set_rows(keys, sets)

    return run


def _set_rows(keys, sets):
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"]
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose sets link. A filter lets only sets of these pairs be shuffled. One side is unique
    by key, so a hub with many partners is a skewed join that adaptive execution can split."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    shared = pairs.sparkSession.sparkContext.broadcast(hash_filter(keys, keys.count()))
    sets = only_keys(sets, "key", shared)
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, comp) after joining the components that ``edges`` (a, b: keys) connect; the smallest label wins.

    Labels take the least label of their neighbours, then the label of that label, until nothing changes.
    Only components that an edge touches take part. ``labels`` is a stored table, dropped if another takes its place.
    """
    a, b = (labels.select(F.col("key").alias(k), F.col("comp").alias(c)) for k, c in (("a", "ca"), ("b", "cb")))
    links = edges.join(a, "a").join(b, "b").where("ca != cb").select("ca", "cb").distinct()
    links = stored(links.union(links.select("cb", "ca")).distinct().toDF("u", "v"), "links")
    if not links.limit(1).count():
        drop_stored(links)
        return labels
    root = stored(links.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "roots")
    root_table = root
    while True:
        near = (
            links.join(root.withColumnRenamed("node", "v"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        moved = root.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = stored(
            moved.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")),
            "roots",
        )
        drop_stored(root_table)
        if not new.where("root != old").limit(1).count():
            break
        root, root_table = new.select("node", "root"), new
    named = stored(
        labels.join(new.select(F.col("node").alias("comp"), "root"), "comp", "left").select(
            "key", F.coalesce("root", "comp").alias("comp")
        ),
        "labels",
    )
    drop_stored(links, new, labels)
    return named


def _kept(postings: DataFrame, percent: int) -> DataFrame:
    """Postings (key, n, matches, length, token, at) without shingles that only one key has, then without
    keys that have fewer than they, or the least set they can link to, demand; ``had`` is how many a key has,
    ``rank`` how many of them stand before."""
    demand = F.least(F.col("matches"), F.greatest(F.lit(1), F.floor(percent * F.col("n") / 100 / SHORTEST)))
    met = (
        postings.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("token")
    )
    own = Window.partitionBy("key")  # a key has no more rows than its prefix is long
    return (
        postings.join(met.hint("merge"), "token")
        .withColumn("had", F.count(F.lit(1)).over(own))
        .where(F.col("had") >= demand)
        .withColumn("rank", F.row_number().over(own.orderBy("at")) - 1)
    )


def _demand(percent: int):
    """The prefix shingles that two sets (the second one's columns end in _o) share at least if they link: the overlap
    that their sizes demand, less all that stands behind a prefix."""
    overlap = F.ceil(percent * (F.col("n") + F.col("n_o")) / (100 + percent))
    return overlap, overlap - F.greatest(F.col("n") - F.col("length"), F.col("n_o") - F.col("length_o"))


def _possible(percent: int):
    """Whether the sets of two postings of one shingle can link, and this can be the first shingle they share.

    From the first shared one on, each set must still have as many prefix shingles as the two must share.
    """
    overlap, demand = _demand(percent)
    sizes = 100 * F.least("n", "n_o") >= percent * F.greatest("n", "n_o")
    ahead = F.least(F.col("n") - F.col("at"), F.col("n_o") - F.col("at_o"))
    return (
        sizes
        & (F.least("rank", "rank_o") + ahead >= overlap)
        & (F.least(F.col("had") - F.col("rank"), F.col("had_o") - F.col("rank_o")) >= demand)
        & (F.col("comp") != F.col("comp_o"))
    )


COLUMNS = ("key", "n", "length", "at", "had", "rank", "comp")


def _candidates_by_hub(postings: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each set with the hub it shares most open prefix shingles with: (a, b), b the hub."""
    alone = (F.col("length") - F.col("had")) / F.col("n") if turn == 0 else F.lit(0.0)
    order = (alone.alias("alone"), F.xxhash64(F.lit(turn), F.col("key")).alias("o"))
    hubs = postings.groupBy("token").agg(
        F.min(F.struct(*order, *COLUMNS)).alias("hub"), F.min("comp").alias("low"), F.max("comp").alias("high")
    )
    hubs = hubs.where("low < high").select("token", *(F.col(f"hub.{c}").alias(f"{c}_o") for c in COLUMNS))
    met = postings.join(hubs.hint("merge"), "token").where(_possible(percent))
    shared = met.groupBy(F.col("key").alias("a"), F.col("key_o").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    return shared.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("best")).select("a", F.col("best.b").alias("b"))


def _candidates_left(postings: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that share as many prefix shingles as the overlap they need demands, stored."""
    sizes = postings.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("members"))
    largest = (
        sizes.groupBy("token")
        .agg(F.max(F.struct("members", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"))
        .where("comps > 1")
        .select("token", F.col("top.comp").alias("top"))
    )
    marked = stored(postings.join(largest.hint("merge"), "token"), "open-postings")
    outside = marked.where("comp != top").select("token", *(F.col(c).alias(f"{c}_o") for c in COLUMNS))
    once = (F.col("comp") == F.col("top")) | (F.col("key_o") < F.col("key"))
    pairs = outside.join(marked, "token").where(once & _possible(percent)).select(F.col("key_o").alias("a"), F.col("key").alias("b"))
    prefixes = postings.groupBy("key", "n", "length").agg(F.collect_set("token").alias("tokens"))  # no longer than a prefix
    both = (
        pairs.distinct()
        .join(prefixes.withColumnRenamed("key", "b"), "b")
        .join(prefixes.select(F.col("key").alias("a"), *(F.col(c).alias(f"{c}_o") for c in ("n", "length", "tokens"))), "a")
    )
    pairs = stored(both.where(F.size(F.array_intersect("tokens", "tokens_o")) >= _demand(percent)[1]).select("a", "b"), "pairs")
    drop_stored(marked)
    return pairs


def linked_documents(docs: DataFrame, width: int = 5, percent: int = 80, seed: int = 11) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased. A null or wordless text has no
    shingles and is linked with nothing; its component is its own doc_id. ``component_id`` is the smallest
    non-null doc_id of all rows that links reach. Rows that repeat a text are always linked, unless empty.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")
    )
    size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first().size or 0
    segments = 1
    while segments < min(size // 24 // SKETCH_SEGMENT, MAX_SEGMENTS):  # a word has about 6 bytes
        segments *= 2
    cells = segments * SKETCH_SEGMENT
    classes = np.zeros(cells, np.uint8)
    merged = (
        docs.mapInArrow(_sketch(width, cells), "segment long, counts binary")
        .repartition("segment")
        .sortWithinPartitions("segment")
        .mapInArrow(_merge, "segment long, classes binary")
    )
    for segment, part in rows_of(merged.toArrow().to_batches(), "segment", "classes"):  # 32 MB at most, in one job
        classes[segment * SKETCH_SEGMENT :][:SKETCH_SEGMENT] = np.frombuffer(part, np.uint8)
    rarity = spark.sparkContext.broadcast(classes)

    rows = stored(
        docs.mapInArrow(
            _prefixes(width, percent, seed, rarity),
            "doc_id long, n long, key long, check long, matches int, tokens array<long>, text long",
        ),
        "prefixes",
    )
    keys = stored(
        rows.where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min("doc_id").alias("least"), F.min("check").alias("low"), F.max("check").alias("high")),
        "keys",
    )
    if keys.where("low != high").limit(1).count():  # two sets under one 64-bit key
        return linked_documents(docs.withColumn("text", F.col("text").cast("string")), width, percent, seed + 2)

    prefixes = rows.where("tokens IS NOT NULL").select("key", "n", "matches", F.size("tokens").alias("length"), "tokens")
    # Copies of a text count as well, so a shingle met once is in no other set. Counted by a part of its bits: two shingles
    # that share it stay until their whole hashes are compared.
    again = stored(
        prefixes.select(F.explode("tokens").alias("token"))
        .select(F.col("token").bitwiseAND(F.lit(SHORT)).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("times"))
        .where("times > 1")
        .select("token"),
        "tokens",
    )
    shared = spark.sparkContext.broadcast(hash_filter(again, again.count()))
    postings = stored(prefixes.mapInArrow(_open_postings(shared), POSTINGS).distinct(), "postings")
    drop_stored(again)
    for _ in range(2):
        wide = postings
        postings = stored(_kept(wide.select("key", "n", "matches", "length", "at", "token"), percent), "postings")
        drop_stored(wide)
    labels = stored(postings.select("key", F.col("key").alias("comp")).distinct(), "labels")
    texts = rows.join(labels, "key", "left_semi").select("text").distinct()
    wanted = spark.sparkContext.broadcast(hash_filter(texts, labels.count()))
    sets = stored(
        docs.mapInArrow(_wanted_sets(width, seed, wanted), "key long, shingles array<long>")
        .join(labels, "key", "left_semi")
        .dropDuplicates(["key"]),
        "sets",
    )
    prefixes, rows = rows, stored(rows.select("doc_id", "n", "key"), "rows")
    drop_stored(prefixes)

    for turn in range(ROUNDS):
        open_ = postings.join(labels, "key")
        pairs = stored(_candidates_by_hub(open_, percent, turn), "pairs")
        edges = stored(_verified(pairs, sets, percent), "edges")
        labels = components(labels, edges)
        few = 2 * edges.count() < pairs.count()  # link to a hub that is left: no group of near copies is
        drop_stored(pairs, edges)
        if few:
            break
    pairs = _candidates_left(postings.join(labels, "key"), percent)
    drop_stored(postings)
    edges = stored(_verified(pairs, sets, percent), "edges")
    drop_stored(pairs, sets)
    labels = components(labels, edges)
    drop_stored(edges)

    rooted = keys.join(labels, "key", "left").select("key", "least", F.coalesce("comp", "key").alias("comp"))
    named = rooted.groupBy("comp").agg(F.min("least").alias("component_id"))
    # One row a component, and one a key, on the other side: large groups are skewed joins.
    by_key = rooted.join(named.hint("merge"), "comp").select("key", "component_id")
    linked = rows.where("key IS NOT NULL").select("doc_id", "n", "key").join(by_key.hint("merge"), "key")
    alone = rows.where("key IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def op4_ngram_join(spark, sf_dir):
    return linked_documents(documents(spark, sf_dir), width=4, percent=85)

"""SimHash near duplicates with pigeonring filtering.

1. A text's fingerprint has a bit set where over half of its shingles' hashes have it;
   repeated shingles count as often as they stand there.
2. Only distinct fingerprints are compared. Their 64 bits form a ring of SEGMENTS segments.
   If two fingerprints differ in at most BUDGET bits in total, then there is a segment from
   which every chain of ``l`` consecutive segments differs in at most ``l * BUDGET / SEGMENTS``
   bits. The first two links of such a chain are a join key: the first segment is equal, the
   second differs in one bit at most. A fingerprint is listed under its own key of every
   start, and under the keys with one more bit set in the second segment; of two fingerprints
   that differ there, the one without the bit so finds the other.
3. Pairs under one key go on through the longer chains, and what is left through the full
   Hamming check. A task returns a spanning forest of its links, never all pairs.
4. Keys with more than GROUP_ROWS rows are cut into blocks; every two blocks of a key are
   compared in a task of their own.
5. Alternating stars connect the forests.

Defined cases: null, empty and blank texts have the fingerprint zero and link like any
other; with fewer words than the shingle's the whole sequence is the one shingle; very long
texts are read in windows whose shingles overlap; rows with equal fingerprints are one node;
a null ``doc_id`` never names a component; an empty table gives an empty result; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from driftlens.llm.common import map_batches, materialize, text_or_empty, word_blocks
from driftlens.llm.components import components

WORDS, SEED = 4, 42
#: Fingerprints link at so many differing bits at most.
BUDGET = 4
WIDTHS = (13, 13, 13, 13, 12)
SEGMENTS = len(WIDTHS)
OFFSETS = tuple(sum(WIDTHS[:i]) for i in range(SEGMENTS))
#: Rows of one key that a task compares as they come, and the rows of a block of a larger one.
GROUP_ROWS = 2048
#: Pairs, and shingles, that one step holds.
STEP_PAIRS, STEP_SHINGLES = 1 << 20, 1 << 15


# ---------------------------------------------------------------- fingerprints


def _hashes(raw: bytes, words: int) -> Iterator[list[int]]:
    """The shingles' hashes in windows; windows share ``words - 1`` words."""
    digest, kept, any_full = xxhash.xxh64_intdigest, [], False
    for block in word_blocks(raw):
        found = kept + block
        if len(found) < words:
            kept = found
            continue
        any_full = True
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(found) - words + 1].tolist()
        stops = (ends[words - 1 :] - 1).tolist()
        for at in range(0, len(starts), STEP_SHINGLES):
            step = slice(at, at + STEP_SHINGLES)
            yield [digest(joined[a:b], SEED) for a, b in zip(starts[step], stops[step])]
        kept = found[len(found) - words + 1 :] if words > 1 else []
    if kept and not any_full:
        yield [digest(b" ".join(kept), SEED)]


def fingerprint(raw: bytes, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint of a text's UTF-8 bytes; only A-Z are lower-cased."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in _hashes(raw, words):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed long."""

    def make():
        def step(batch):
            found = np.array([fingerprint(x, words) for x in batch.column(1).to_pylist()], np.uint64)
            return {"doc_id": batch.column(0), "fp": pa.array(found.view(np.int64))}

        return step

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("raw"))
    return map_batches(source, "doc_id long, fp long", make)


# ---------------------------------------------------------------- candidates along the ring


def _chain_masks() -> np.ndarray:
    """[start, l]: the bits of the first ``l`` segments from ``start`` on."""
    own = [((1 << w) - 1) << o for w, o in zip(WIDTHS, OFFSETS)]
    rows = [[sum(own[(s + i) % SEGMENTS] for i in range(n)) for n in range(SEGMENTS + 1)] for s in range(SEGMENTS)]
    return np.array(rows, np.uint64)


CHAINS = _chain_masks()


def chain_budget(length: int) -> int:
    return length * BUDGET // SEGMENTS


def ring_keys(fps: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(keys, role, fps): role 0 under the own key, role 1 with one more bit in the second segment."""
    for start in range(SEGMENTS):
        after = (start + 1) % SEGMENTS
        first = (fps >> np.uint64(OFFSETS[start])) & np.uint64((1 << WIDTHS[start]) - 1)
        second = (fps >> np.uint64(OFFSETS[after])) & np.uint64((1 << WIDTHS[after]) - 1)
        key = np.uint64(start << 32) | (first << np.uint64(WIDTHS[after])) | second
        yield key, 0, fps
        for bit in range(WIDTHS[after]):
            unset = (second >> np.uint64(bit)) & np.uint64(1) == 0
            yield key[unset] | np.uint64(1 << bit), 1, fps[unset]


def within_reach(starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the pairs that pass the chains of three and more segments, the last of which is the ring."""
    at, differ = np.arange(len(a)), a ^ b
    for length in range(3, SEGMENTS + 1):
        near = np.bitwise_count(differ & CHAINS[starts, length]) <= chain_budget(length)
        at, differ, starts = at[near], differ[near], starts[near]
    return at


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each connected part of the links (a, b)."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    ends = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        least = np.minimum(label[ends[0]], label[ends[1]])
        for side in ends:
            np.minimum.at(low, label[side], least)
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


def links_of_groups(keys: np.ndarray, roles: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links in runs of equal keys; a run's role 0 rows come first and meet all later rows."""
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    stops = np.repeat(np.append(heads[1:], len(keys)), np.diff(np.append(heads, len(keys))))
    lefts = np.flatnonzero((roles == 0) & (stops - np.arange(len(keys)) > 1))
    partners = stops[lefts] - lefts - 1
    ends, found = np.cumsum(partners), [(np.zeros(0, np.uint64),) * 2]
    at = 0
    while at < len(lefts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_PAIRS, side="right")))
        own, n = lefts[at:upto], partners[at:upto]
        left = np.repeat(own, n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        near = within_reach((keys[left] >> np.uint64(32)).astype(np.int64), fps[left], fps[right])
        found.append(forest(fps[left[near]], fps[right[near]]))
        at = upto
    return tuple(np.concatenate(side) for side in zip(*found))


def links_of_blocks(key: int, own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between two blocks of one key."""
    start, found = key >> 32, [(np.zeros(0, np.uint64),) * 2]
    width = max(1, STEP_PAIRS // max(1, len(others)))
    for at in range(0, len(own), width):
        some = own[at : at + width]
        left, right = np.repeat(some, len(others)), np.tile(others, len(some))
        near = within_reach(np.full(len(left), start), left, right)
        near = near[left[near] != right[near]]
        found.append(forest(left[near], right[near]))
    return tuple(np.concatenate(side) for side in zip(*found))


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(links: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.uint64).view(np.int64)) for x in links], schema=EDGES)


def candidates(distinct: DataFrame) -> DataFrame:
    """(key, role, fp) for every fingerprint, start and bit."""
    schema = pa.schema([("key", pa.int64()), ("role", pa.int8()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for keys, role, own in ring_keys(fps):
                columns = keys.view(np.int64), np.full(len(keys), role, np.int8), own.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return distinct.select("fp").mapInArrow(run, "key long, role byte, fp long")


def _small_links(rows: DataFrame) -> DataFrame:
    """Links of keys with few rows: a stream of sorted rows, cut between keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.uint64)]
        for batch in batches:
            news = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            news = [news[0].view(np.uint64), news[1], news[2].view(np.uint64)]
            keys, roles, fps = (np.concatenate(x) for x in zip(rest, news))
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut:
                yield _edges(links_of_groups(keys[:cut], roles[:cut], fps[:cut]))
            rest = [keys[cut:], roles[cut:], fps[cut:]]
        if len(rest[0]):
            yield _edges(links_of_groups(*rest))

    return rows.repartition("key").sortWithinPartitions("key", "role").select("key", "role", "fp").mapInArrow(run, "a long, b long")


def _large_links(rows: DataFrame, group_rows: int) -> DataFrame:
    """Links of keys with many rows (``n``), every two of their blocks in a row of its own."""
    blocks = F.ceil(F.col("n") / group_rows)
    listed = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp", "role"), "blocks"))
    listed = materialize(
        listed.groupBy("key", "block", "blocks").agg(
            F.collect_list(F.when(F.col("role") == 0, F.col("fp"))).alias("own"),
            F.collect_list(F.when(F.col("role") == 1, F.col("fp"))).alias("flipped"),
        ),
        "simhash-blocks",
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = listed.select("key", F.col("block").alias("l"), "own", every.alias("r"))
    # Blocks meet in both orders; own rows against own rows are needed once.
    right = listed.select("key", F.col("block").alias("r"), F.col("own").alias("same"), "flipped", every.alias("l"))
    others = F.when(F.col("l") <= F.col("r"), F.concat("same", "flipped")).otherwise(F.col("flipped"))
    pairs = left.join(right, ["key", "l", "r"]).select("key", "own", others.alias("others"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                sides = [np.array(one.column(c)[0].values, np.int64).view(np.uint64) for c in (1, 2)]
                yield _edges(links_of_blocks(one.column(0)[0].as_py(), *sides))

    return pairs.mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): forests that connect the fingerprints of ``distinct`` (column fp) as all their links do."""
    rows = candidates(distinct)
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(counts.filter(F.col("n") > group_rows), "simhash-hot-keys")
    few = materialize(_small_links(rows.join(hot, "key", "left_anti")), "simhash-links")
    many = materialize(_large_links(rows.join(hot, "key"), group_rows), "simhash-block-links")
    return few.unionByName(many)


def link_components(docs: DataFrame, words: int = WORDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    rows = materialize(fingerprints(docs, words), "simhash-rows")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = materialize(components(links(distinct, group_rows)), "simhash-roots")
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "simhash-named")
    # Stored, so that both sides are plain exchanges and a hot component or fingerprint can be split.
    ids = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-ids")
    by_fp = materialize(named.join(ids, "root").select(F.col("fp").alias("own"), "component_id"), "simhash-by-fp")
    return rows.join(by_fp, F.col("fp") == F.col("own")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

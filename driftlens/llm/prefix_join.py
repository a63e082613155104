"""Jaccard join of word n-gram sets with prefix trees.

1. Every text becomes a sorted set of 64-bit shingle hashes, its tokens; equal sets are one node.
2. Linked sets differ in at most D tokens. Cut the hash space into more than D ranges, and they
   agree in the whole content of one at least. So a set leaves one hash for each of its
   ranges, and a set that shares none with another has no partner and goes no further. About
   nine tokens fill a range, so this does not wear off in a large table, in which single
   shingles, even the rarest, come back in foreign texts. Sizes fall into classes, each with
   cuts of its own; a set uses those of its class and, near its upper end, of the next.
3. Two linked sets share a token among their first ``n - ceil(0.9 n) + 1`` of any global order
   (prefix bound). Among the sets left a fixed sixth of the hash space comes first: tokens that
   one set alone has, then the others by their exact count. Whatever is left follows by hash.
   As a prefix is a tenth of a set, the counts of that sixth fix nearly every prefix, and a
   set with enough tokens of its own goes no further.
   Nodes that share a prefix token meet in the group of the token's least node. Only
   (token, node) pairs travel; whole sets are sent once per group, later.
4. Sets in a group that merely share a passage are told apart by occupancy: the hash space
   has PARTS parts, and an intersection is at most the sum of the smaller occupancies. A
   member without any partner in reach of the threshold leaves its group.
5. In a group the ordered sets are stored in a path-compressed trie. A set walks it, sharing
   the overlap counted so far with all sets below, and leaves a subtree when the lengths
   that remain cannot reach the threshold, or when all of it is already connected with it.
   A group yields a spanning forest of its links, never all pairs.
6. Alternating stars connect the forests.

A group beyond GROUP_TOKENS is cut into blocks. Every block also gets a few common members;
what they connect needs no further comparison. Members outside the group's largest component
are then compared with every block, so no link is lost.

Defined cases: null, empty or blank texts have an empty set and link with nothing; with
fewer words than n the whole sequence is the one shingle; rows of equal sets are one node;
a null ``doc_id`` never names a component; an empty table gives an empty result; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftlens.llm.common import SPACES, bitmap, in_bitmap, map_batches, materialize, windows
from driftlens.llm.components import components

WORDS = 3
#: Linked when PERCENT_OF * intersection >= PERCENT * union.
PERCENT, PERCENT_OF = 90, 100
#: Tokens of a range that says little, and for so many ranges there is one more than needed: few sets have more ranges that say little.
LIGHT, SPARE_OF = 1, 32
#: So many 256ths of the hash space are counted exactly and come first in the global order.
COUNTED = 44
#: Largest filter of the texts whose sets are needed, as a power of two of bits; 16 bits a text below it.
FILTER_BITS = 26
#: Tokens of one comparison unit (8 bytes each), and common members of the blocks of a large group.
GROUP_TOKENS = 1 << 20
COMMON_MEMBERS = 64
#: Parts of the hash space (2 bytes each per set), and the members up to which a group is examined by them.
PARTS, EXAMINED_MEMBERS = 256, 4096
#: Bytes of a text whose words are hashed at once.
HASHED_BYTES = 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte, the same for A-Z as for a-z, and which bytes are white space.
BYTE_VALUES = _mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8) + np.uint64(0x9E3779B97F4A7C15))
BLANK = np.isin(np.arange(256), list(SPACES))
#: An odd number, its powers, and those of the number that undoes a multiplication by it.
BASE = 0xD6E8FEB86659FD93


def _powers(base: int) -> np.ndarray:
    steps = np.full(2 * HASHED_BYTES, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


POWERS, UNDONE = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def word_hashes(raw: bytes) -> np.ndarray:
    """One hash for every word: a polynomial of its bytes, by differences of running sums.

    Beyond 2 * HASHED_BYTES the rest of ``raw`` is one word, as ``windows`` cuts texts.
    """
    if len(raw) > len(POWERS):
        at = 1 + max(raw.rfind(c, 0, HASHED_BYTES) for c in SPACES)
        return np.append(word_hashes(raw[:at]), _long_word(raw[at:]))
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(BLANK[data], out=inside[1:-1])
    borders = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = borders[::2], borders[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * POWERS[: len(data)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * UNDONE[starts] + (ends - starts).astype(np.uint64))


def _long_word(word: bytes) -> np.ndarray:
    """The same hash of one word of any length, part by part."""
    total = len(word)
    for at in range(0, len(word), HASHED_BYTES):
        values = BYTE_VALUES[np.frombuffer(word[at : at + HASHED_BYTES], np.uint8)]
        total += int(np.sum(values * POWERS[: len(values)])) * pow(BASE, at, 1 << 64)
    return _mixed(np.array([total % (1 << 64)], np.uint64))


class Shingler:
    def __init__(self, words: int = WORDS):
        self.words = words

    def hashes(self, text: str | bytes | None) -> np.ndarray:
        """Sorted distinct shingle hashes; only A-Z are lower-cased."""
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
        pieces = [word_hashes(piece) for piece in windows(raw, HASHED_BYTES)]
        ids = pieces[0] if len(pieces) == 1 else np.concatenate([np.zeros(0, np.uint64), *pieces])
        n = self.words
        if not len(ids):
            return ids
        if len(ids) < n:
            return np.array([xxhash.xxh64_intdigest(b" ".join(raw.lower().split()), seed=len(ids))], np.uint64)
        total = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            total = _mixed(total + ids[k : len(ids) - n + 1 + k] + np.uint64(k + 1))
        total.sort()
        return total[np.append(True, total[1:] != total[:-1])]


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // PERCENT_OF) + 1 if n else 0


def leading(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens that a set's prefix may hold, and how many of the prefix lie beyond the counted ones (less than 0: none)."""
    counted = ((hashes >> np.uint64(32)) & np.uint64(255)) < COUNTED
    first = hashes[counted]
    beyond = prefix_length(len(hashes)) - len(first)
    if beyond > 0:
        first = np.concatenate([first, hashes[~counted][:beyond]])
    return first.view(np.int64), beyond


def _size_classes() -> list[int]:
    """Least size of every class; sizes that can be linked lie in one class or in two that follow each other."""
    starts = [1, 2]
    while starts[-1] < 1 << 48:
        wide = starts[-1]
        for _ in range(2):
            wide = wide * PERCENT_OF // PERCENT + 1
        starts.append(wide)
    return starts


SIZE_CLASSES = _size_classes()


@cache
def cuts(size_class: int) -> tuple[np.ndarray, int, int]:
    """Where the hash space is cut for sets up to this class, the spare ranges, and the scheme's own number."""
    most = SIZE_CLASSES[size_class + 1] - 1
    # |x| + |y| - 2 I for the least overlap I: the tokens in which two linked sets differ at most.
    differ = 2 * most * (PERCENT_OF - PERCENT) // (PERCENT + PERCENT_OF)
    spare = 1 + differ // SPARE_OF
    ranges = differ + spare + 1
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    return edges, spare, int(_mixed(np.array([size_class + 1], np.uint64))[0] >> np.uint64(1))


def range_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hashes of what a set has in each range; linked sets that are not equal have one in common.

    Of two linked sets ``spare + 1`` ranges agree at least. Light ones, with LIGHT tokens at
    most, agree by chance too; they are left out by sets with no more than ``spare`` of them,
    as a heavy one then agrees as well.
    """
    size = len(hashes)
    largest = size * PERCENT_OF // PERCENT  # that a linked set may have
    if not (size + largest) * (PERCENT_OF - PERCENT) // (PERCENT + PERCENT_OF):
        return np.zeros(0, np.int64)  # linked with its equals only
    own = bisect_right(SIZE_CLASSES, size) - 1
    near = largest >= SIZE_CLASSES[own + 1]
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(hashes, out=sums[1:])
    out = []
    for size_class in (own, own + 1) if near else (own,):
        edges, spare, scheme = cuts(size_class)
        at = np.zeros(len(edges) + 2, np.int64)
        at[1:-1], at[-1] = np.searchsorted(hashes, edges), size
        chosen = at[1:] - at[:-1] > LIGHT
        if len(chosen) - np.count_nonzero(chosen) > spare:
            chosen[:] = True
        before = sums[at]
        out.append(_mixed((before[1:] - before[:-1] + np.arange(scheme, scheme + len(chosen), dtype=np.uint64))[chosen]))
    return np.concatenate(out).view(np.int64)


def node_of(hashes: np.ndarray) -> int | None:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63) if len(hashes) else None


def occupancy(hashes: np.ndarray) -> bytes:
    parts = (hashes >> np.uint64(24)) & np.uint64(PARTS - 1)
    return np.minimum(np.bincount(parts.astype(np.int64), minlength=PARTS), 0xFFFF).astype(np.uint16).tobytes()


def least_overlap(a, b):
    """The smallest intersection with which sets of sizes ``a`` and ``b`` are linked."""
    return -(-PERCENT * (a + b) // (PERCENT + PERCENT_OF))


def near_in_size(sizes: np.ndarray) -> np.ndarray:
    """Which sets have a partner of a size with which a link is possible at all."""
    order = np.argsort(sizes, kind="stable")
    n = sizes[order]
    close = n[:-1] >= least_overlap(n[:-1], n[1:])
    out = np.zeros(len(n), bool)
    out[order] = np.append(close, False) | np.append(False, close)
    return out


def plausible(sizes: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Which sets have a partner that sizes and occupancies do not rule out."""
    order = np.argsort(sizes, kind="stable")
    n, rows = sizes[order], parts[order]
    # A saturated count says nothing, so such sets are never ruled out by it.
    full = (rows == 0xFFFF).any(axis=1)
    found = np.zeros(len(n), bool)
    for i in range(len(n) - 1):
        upto = np.searchsorted(n, n[i] * PERCENT_OF / PERCENT, side="right")
        if upto > i + 1:
            bound = np.minimum(rows[i], rows[i + 1 : upto]).sum(axis=1, dtype=np.int64)
            near = (bound >= least_overlap(n[i], n[i + 1 : upto])) | full[i] | full[i + 1 : upto]
            found[i] |= near.any()
            found[i + 1 : upto] |= near
    out = np.zeros(len(n), bool)
    out[order] = found
    return out


# ---------------------------------------------------------------- passes over the texts


def _texts(docs: DataFrame, digest: Column | None = None) -> DataFrame:
    text = F.col("text").cast("string")
    texts = F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")
    return docs.select(*texts) if digest is None else docs.select(*texts, digest.alias("digest"))


def _chosen(batch: pa.RecordBatch, bits: np.ndarray | None) -> list[bytes | None]:
    """The texts of a slice, or those whose hash may be in the bitmap."""
    texts = batch.column(1).cast(pa.binary())
    if bits is not None:
        texts = texts.filter(pa.array(in_bitmap(bits, batch.column(2).to_numpy())))
    return texts.to_pylist()


OUTLINE = "doc_id long, n long, node long, h long, digest binary, ranges array<long>"


def _outline(docs: DataFrame, words: int, digest: Column | None = None) -> DataFrame:
    """One row per document; ``ranges`` has the hashes of every distinct set's ranges, once per slice."""

    def make():
        shingler = Shingler(words)

        def step(batch):
            out = {name: [] for name in ("n", "node", "ranges")}
            done = set()
            for text in _chosen(batch, None):
                hashes = shingler.hashes(text)
                node = node_of(hashes)
                out["n"].append(len(hashes))
                out["node"].append(node)
                out["ranges"].append(None if node is None or node in done else range_hashes(hashes))
                done.add(node)
            return {"doc_id": batch.column(0), "h": batch.column(2), "digest": batch.column(3), **out}

        return step

    digest = F.lit(None).cast("binary") if digest is None else digest
    return materialize(map_batches(_texts(docs, digest), OUTLINE, make), "join-outline")


def _partnered(outline: DataFrame) -> DataFrame:
    """(node, h) of the sets that agree with another one in a range; ``h`` is the hash of one of their texts."""
    width = int(outline.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = outline.filter("ranges is not null").select("node", F.explode("ranges").alias("range"))
    dealt = each.repartition(width, "range").sortWithinPartitions("range").select("range", "node")
    schema = pa.schema([("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last range so far and its first node go before the next batch, so no range is held as a whole.
        before = np.zeros((2, 0), np.int64)
        for batch in batches:
            ranges, nodes = np.hstack([before, [c.to_numpy() for c in batch.columns]])
            starts = np.append(True, ranges[1:] != ranges[:-1])
            first = nodes[np.flatnonzero(starts)[np.cumsum(starts) - 1]]
            differ = nodes != first
            before = np.array([ranges[-1:], first[-1:]])
            if differ.any():
                found = np.unique(np.concatenate([nodes[differ], first[differ]]))
                yield pa.RecordBatch.from_arrays([pa.array(found)], schema=schema)

    nodes = materialize(dealt.mapInArrow(run, "node long").distinct(), "join-partnered")
    return materialize(outline.select("node", "h").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("h").alias("h")), "join-near-texts")


def _broadcast(hashes: DataFrame):
    """Bitmap of the hashes (column h), at most 2**FILTER_BITS bits; one without bits if there are none."""
    bits = bitmap(hashes, hashes.count(), FILTER_BITS)
    return hashes.sparkSession.sparkContext.broadcast(np.zeros(1, np.uint8) if bits is None else bits)


PROFILE = "n long, node long, parts binary, beyond long, first array<long>"


def _profile(docs: DataFrame, words: int, wanted=None) -> DataFrame:
    """One row per text, or per text that may be ``wanted``; ``first`` has the leading tokens of every distinct set, once per slice."""

    def make():
        shingler, bits = Shingler(words), None if wanted is None else wanted.value

        def step(batch):
            out = {name: [] for name in ("n", "node", "parts", "beyond", "first")}
            done = set()
            for text in _chosen(batch, bits):
                hashes = shingler.hashes(text)
                node = node_of(hashes)
                first, beyond = (None, None) if node is None else leading(hashes)
                out["n"].append(len(hashes))
                out["node"].append(node)
                out["parts"].append(None if node is None else occupancy(hashes))
                out["beyond"].append(beyond)
                out["first"].append(None if node in done else first)
                done.add(node)
            return out if out["n"] else None

        return step

    return materialize(map_batches(_texts(docs), PROFILE, make), "join-profile")


def _prefixes(profile: DataFrame, nodes: DataFrame) -> DataFrame:
    """(token, node) of the prefix tokens that several sets have among their leading ones."""
    postings = profile.filter("first is not null").select("node", F.explode("first").alias("token"))
    seen = postings.groupBy("token").agg(F.count(F.lit(1)).alias("seen"), F.min("node").alias("least"), F.max("node").alias("most"))
    # Stored, so that the join's sides are plain exchanges and a hot token can be split.
    shared = materialize(seen.filter("least < most").select(F.col("token").alias("of_token"), "seen"), "join-shared")
    hits = materialize(postings.join(shared, F.col("token") == F.col("of_token")).select("node", "token", "seen"), "join-hits")
    counted = F.shiftright("token", 32).bitwiseAND(255) < COUNTED
    each = hits.join(nodes.select("node", "beyond"), "node").dropDuplicates(["node", "token"]).withColumn("counted", counted)
    of_node = Window.partitionBy("node")
    # Counted tokens that no other set has lead the prefix; the shared ones take the places left.
    ranked = each.withColumn("shared", F.count(F.when(F.col("counted"), 1)).over(of_node)).withColumn(
        "place", F.row_number().over(of_node.orderBy(~F.col("counted"), "seen", "token"))
    )
    within = ranked.filter(~F.col("counted") | (F.col("place") <= F.col("beyond") + F.col("shared")))
    return materialize(within.select("token", "node"), "join-prefixes")


def _sets(docs: DataFrame, wanted, words: int) -> DataFrame:
    """(node, tokens) of the sets that a group may need; ``wanted`` has one text at least of each."""

    def make():
        shingler, bits = Shingler(words), wanted.value

        def step(batch):
            found = {}
            for text in _chosen(batch, bits):
                hashes = shingler.hashes(text)
                node = node_of(hashes)
                if node is not None:
                    found[node] = hashes.tobytes()
            return {"node": list(found), "tokens": list(found.values())} if found else None

        return step

    return map_batches(_texts(docs), "node long, tokens binary", make)


# ---------------------------------------------------------------- the trie of one group


class SetTrie:
    """Path-compressed trie of ordered sets, as intervals of their lexicographic order."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())
        self.order, self.sets = order, [sets[i] for i in order]
        self.sizes = np.array([len(s) for s in self.sets])
        shared = [0] + [self._common(a, b) for a, b in zip(self.sets, self.sets[1:])]
        # Node: (first, last, depth at its end, children); its path is that of its first set.
        self.root = self._build(shared)

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _build(self, shared: list[int]) -> list:
        root = [0, len(self.sets), 0, []]
        stack = [root]
        for i in range(len(self.sets)):
            depth, last = shared[i], None
            while stack[-1][2] > depth:
                last = stack.pop()
                last[1] = i
            if last is not None and stack[-1][2] < depth:
                # The path of the node just closed is cut where the new set leaves it.
                between = [last[0], len(self.sets), depth, [last]]
                stack[-1][3][-1] = between
                stack.append(between)
            leaf = [i, len(self.sets), len(self.sets[i]), []]
            if len(self.sets[i]) > stack[-1][2]:
                stack[-1][3].append(leaf)
                stack.append(leaf)
            # A set that ends on the path needs no node: it lies in its interval already.
        for node in stack:
            node[1] = len(self.sets)
        return root

    def connect(self, probes: list[int] | None = None) -> np.ndarray:
        """Component label per set (position in the order given): its least position in trie order."""
        m = len(self.sets)
        roots = np.arange(m)
        rank = np.argsort(self.order)
        for i in range(m) if probes is None else sorted(rank[p] for p in probes):
            self._probe(i, roots)
        out = np.empty(m, np.int64)
        out[self.order] = roots
        return out

    def _probe(self, i: int, roots: np.ndarray) -> None:
        mine, size = self.sets[i], len(self.sets[i])
        # 19 I >= 9 (|x| + |y|) for 90 %: the least overlap with a set of a given size.
        need = least_overlap(size, self.sizes)
        stack = [(self.root, 0, 0, 0)]
        while stack:
            (first, last, depth, children), above, overlap, passed = stack.pop()
            if (roots[first:last] == roots[i]).all():
                continue
            path = self.sets[first][above:depth]
            if len(path):
                at = np.searchsorted(mine, path)
                overlap += int(np.count_nonzero(mine[np.minimum(at, size - 1)] == path))
                passed = int(np.searchsorted(mine, path[-1], side="right"))
            # What both sides still have beyond this point bounds the overlap from above.
            room = np.minimum(self.sizes[first:last] - depth, size - passed)
            if not (overlap + room >= need[first:last]).any():
                continue
            ended = first
            while ended < last and self.sizes[ended] == depth:
                if overlap >= need[ended] and roots[ended] != roots[i]:
                    a, b = sorted((roots[ended], roots[i]))
                    roots[roots == b] = a
                ended += 1
            stack.extend((child, depth, overlap, passed) for child in children)


def _forest(rows: list[tuple[int, bytes, bool]]) -> list[tuple[int, int]]:
    """Links (a, b) that span the components of one unit; with probes marked, only theirs are sought."""
    seen = {}
    for node, data, probe in rows:
        seen[node] = (data, probe or seen.get(node, (None, False))[1])
    nodes = list(seen)
    if len(nodes) < 2:
        return []
    trie = SetTrie([np.frombuffer(seen[n][0], np.uint64) for n in nodes])
    probes = [i for i, n in enumerate(nodes) if seen[n][1]]
    labels = trie.connect(probes)
    least = {}
    for node, label in zip(nodes, labels.tolist()):
        least[label] = min(node, least.get(label, node))
    return [(least[label], node) for node, label in zip(nodes, labels.tolist()) if node != least[label]]


def _by_group(rows: DataFrame, n_keys: int, solve, names: tuple[str, ...]) -> DataFrame:
    """``solve`` on every run of rows with equal leading columns; one run is held at a time.

    ``rows`` are partitioned and sorted by these columns; results are long columns.
    """
    schema = pa.schema([(name, pa.int64()) for name in names])

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(len(names))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n_keys] != current:
                    out += solve(held)
                    current, held = row[:n_keys], []
                held.append(row)
            if out:
                yield packed(out)
        if last := solve(held):
            yield packed(last)

    return rows.mapInArrow(run, ", ".join(f"{name} long" for name in names))


def _unit_links(units: DataFrame, keys: list[str]) -> DataFrame:
    """Forests of all units, from rows (keys..., node, tokens, probe)."""
    width, k = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(keys)
    dealt = units.repartition(width, *keys).sortWithinPartitions(*keys).select(*keys, "node", "tokens", "probe")
    return _by_group(dealt, k, lambda rows: _forest([r[k:] for r in rows]), ("a", "b"))


# ---------------------------------------------------------------- the join


def _groups(postings: DataFrame) -> DataFrame:
    """(pivot, node): nodes that share a prefix token meet under the token's least node."""
    shared = postings.groupBy("token").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).filter("pivot < other")
    # Stored, so that the join's sides are plain exchanges and a hot token can be split.
    shared = materialize(shared.select(F.col("token").alias("of_token"), "pivot"), "join-tokens")
    return materialize(
        postings.join(shared, F.col("token") == F.col("of_token")).select("pivot", "node").distinct(), "join-members"
    )


def _examined(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pivot, node, n) without the members that nothing in their group can be linked with."""
    counted = materialize(members.groupBy(F.col("pivot").alias("of")).agg(F.count(F.lit(1)).alias("m")), "join-sizes")
    width = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = members.join(counted, F.col("pivot") == F.col("of")).join(nodes.select("node", "n"), "node").select("pivot", "node", "n", "m")
    large = sized.filter(F.col("m") > EXAMINED_MEMBERS).select("pivot", "node", "n")

    def by_size(rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        return [r for r, k in zip(rows, near_in_size(np.array([r[2] for r in rows]))) if k]

    # Sizes first: they rule out most pairs that share a passage, before occupancies travel.
    few = sized.filter(F.col("m") <= EXAMINED_MEMBERS).select("pivot", "node", "n")
    few = _by_group(few.repartition(width, "pivot").sortWithinPartitions("pivot"), 1, by_size, ("pivot", "node", "n"))
    few = materialize(few, "join-near-sizes")
    small = few.join(nodes.select("node", "parts"), "node").select("pivot", "node", "n", "parts")

    def group_of(rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        parts = np.stack([np.frombuffer(r[3], np.uint16) for r in rows])
        keep = plausible(np.array([r[2] for r in rows]), parts)
        return [r[:3] for r, k in zip(rows, keep) if k]

    kept = _by_group(small.repartition(width, "pivot").sortWithinPartitions("pivot"), 1, group_of, ("pivot", "node", "n"))
    return materialize(kept.unionByName(large), "join-plausible")


def _without_subsets(members: DataFrame) -> DataFrame:
    """``members`` without the groups that lie inside another one, where all their pairs meet too.

    A group is compared with the first group that its pivot is a member of. That one has a
    smaller pivot, so of a chain of such groups the outermost always stays.
    """
    home = materialize(members.groupBy(F.col("node").alias("of")).agg(F.min("pivot").alias("home")), "join-homes")
    away = members.join(home, F.col("pivot") == F.col("of")).filter("home < pivot").select(F.col("pivot").alias("inner"), "node", "home")
    there = members.select(F.col("pivot").alias("home"), "node", F.lit(1).alias("there"))
    inside = away.join(there, ["home", "node"], "left").groupBy("inner").agg(F.count(F.lit(1)).alias("m"), F.count("there").alias("k"))
    inside = materialize(inside.filter("m = k").select(F.col("inner").alias("pivot")), "join-subsets")
    return materialize(members.join(inside, "pivot", "left_anti"), "join-groups")


def _placed(sized: DataFrame, group_tokens: int) -> DataFrame:
    """Members with their group's number of blocks and their own block."""
    loads = materialize(
        sized.groupBy(F.col("pivot").alias("of")).agg(F.ceil(F.sum("n") / group_tokens).alias("blocks"), F.count(F.lit(1)).alias("members")),
        "join-loads",
    )
    placed = sized.join(loads, F.col("pivot") == F.col("of")).drop("of")
    return materialize(placed.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))), "join-placed")


def links(docs: DataFrame, outline: DataFrame, words: int = WORDS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(node, root) of all sets that are linked with another."""
    near = _partnered(outline)
    profile = _profile(docs, words, _broadcast(near))
    named = profile.filter("node is not null")
    nodes = materialize(named.groupBy("node").agg(F.max("n").alias("n"), F.max("beyond").alias("beyond"), F.first("parts").alias("parts")), "join-nodes")
    members = _without_subsets(_examined(_groups(_prefixes(profile, nodes)), nodes))
    placed = _placed(members, group_tokens)
    wanted = _broadcast(materialize(near.join(members, "node", "left_semi").select("h"), "join-needed"))
    sets = materialize(
        _sets(docs, wanted, words).join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("tokens").alias("tokens")),
        "join-sets",
    )
    common = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(2)), F.col("members")) < COMMON_MEMBERS)
    where = F.when(common, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    units = placed.select("pivot", F.explode(where).alias("unit"), "node", F.lit(True).alias("probe"))
    edges = materialize(_unit_links(units.hint("merge").join(sets, "node"), ["pivot", "unit"]), "join-links")
    labels = components(edges)
    cut = placed.filter("blocks > 1")
    if not cut.limit(1).count():
        return labels
    # Groups cut into blocks: whatever lies outside a group's largest component meets every block.
    labels = materialize(labels, "join-labels")
    named = cut.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node"))
    named = materialize(named.drop("root"), "join-named")
    tally = named.groupBy("pivot", "label").agg(F.count(F.lit(1)).alias("size"))
    main = materialize(
        tally.groupBy(F.col("pivot").alias("of")).agg(F.max(F.struct("size", "label")).alias("top")).select("of", F.col("top.label").alias("main")),
        "join-main",
    )
    outside = materialize(
        named.join(main, F.col("pivot") == F.col("of")).filter("label != main").select("pivot", "node", "blocks", "block"), "join-outside"
    )
    parts = outside.groupBy(F.col("pivot").alias("of")).agg(F.collect_set("block").alias("parts"))
    probes = outside.select("pivot", F.col("block").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("unit"), "node", F.lit(True).alias("probe"))
    rest = cut.join(materialize(parts, "join-parts"), F.col("pivot") == F.col("of")).select(
        "pivot", F.explode("parts").alias("part"), F.col("block").alias("unit"), "node", F.lit(False).alias("probe")
    )
    # Their number is unknown to Catalyst, which must not take them for few and broadcast them.
    second = probes.unionByName(rest).hint("merge").join(sets, "node")
    more = materialize(_unit_links(second, ["pivot", "part", "unit"]), "join-more-links")
    return components(labels.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more))


def link_components(docs: DataFrame, words: int = WORDS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    outline = _outline(docs, words)
    labels = materialize(links(docs, outline, words, group_tokens), "join-roots")
    own = outline.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    rooted = materialize(own.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")), "join-rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "join-least")
    named = materialize(rooted.join(least, "root").select(F.col("node").alias("of_node"), "component_id"), "join-named-nodes")
    return outline.join(named, F.col("node") == F.col("of_node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with the first document of each group of linked texts; rows without an id stay.

    A document is an id and a text: an id with several texts names as many documents.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    outline = _outline(docs, WORDS, digest)
    labels = materialize(links(docs, outline, WORDS, GROUP_TOKENS), "join-roots")
    rows = outline.filter("doc_id is not null")
    own = rows.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    rooted = own.join(labels, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    # Texts without words are linked with none.
    first = rooted.select("first.doc_id", "first.digest").unionByName(rows.filter("node is null").select("doc_id", "digest").distinct())
    first = materialize(first.select("doc_id", "digest"), "join-first")
    # Rows travel as one struct, so that no column of theirs can clash with another.
    boxed = docs.select("doc_id", digest.alias("digest"), F.struct("*").alias("row"))
    kept = boxed.join(first, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    return kept.unionByName(boxed.filter("doc_id is null")).select("row.*")

"""Phrase collocations by direct-address tiling.

1. Words are counted and ranked by frequency over all languages; an id is a rank. A
   phrase of ``k`` words is a pair: the ids of its first and of its last ``k - 1`` words.
   So every level counts pairs of neighbouring ids, and the frequent pairs are ranked again
   and become the ids of the next level.
2. A pair's address puts the tile before the cell: a tile is a square of TILE by TILE ranks.
   Pairs are counted in buffers of fixed size. A tile that holds many of a buffer's pairs is
   counted by a dense ``bincount`` over its cells, all others as one sorted list of addresses.
   Tasks hand on their buffers' counts, and Spark adds them up.
3. Only neighbours whose ids are both frequent are counted: a phrase is no more frequent than
   its parts.
4. Ranks up to HEAD are handed to all tasks. A frequent item beyond them keeps a 61-bit hash
   as its id, is found by a bitmap of at most 2**FILTER_BITS bits and then counted like the
   others, always in sorted lists. A bitmap that is too full lets more pairs through, which
   the exact counts then drop.
5. The parts' counts of a phrase and its words follow from joins of the levels' tables.

Defined cases: a null text is empty, a null language is ``und`` and one with a language of
that name; phrases do not cross documents; texts of any length are read in windows that do
not break phrases; repeated rows count as often as they stand there; an empty table, or one
without frequent words, gives an empty result; columns other than text and lang are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from driftlens.llm.common import bitmap, in_bitmap, materialize, text_or_empty, windows

LEAST, MAX_WORDS, TOP = 100, 5, 2000
HEAD_BITS, TILE_BITS = 17, 11
HEAD, TILE = 1 << HEAD_BITS, 1 << TILE_BITS
#: A ranked word has so many bytes at most, which bounds what every task is handed.
HEAD_WORD_BYTES = 64
#: A tile is counted cell by cell if so many of a buffer's pairs lie in it.
DENSE_PAIRS = (TILE * TILE) // 16
BUFFER_PAIRS, STREAM_IDS = 1 << 21, 1 << 19
#: Distinct words that one task counts before it hands its counts on.
WORD_TABLE = 200_000
FILTER_BITS = 26

#: Ends of pieces become a full stop that stands alone; a tab is the other blank.
_PIECES = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")
_WORDS_ONLY = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"           ")
BREAK = -1
_TAIL = np.uint64(1 << 61)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tail_word(lang: bytes, word: bytes) -> int:
    """Id of a word without a rank."""
    return xxhash.xxh64_intdigest(lang + b"\0" + word) >> 3 | int(_TAIL)


def tail_pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids of pairs without a rank."""
    mixed = _mixed(_mixed(left.astype(np.uint64) + np.uint64(1)) + right.astype(np.uint64))
    return ((mixed >> np.uint64(3)) | _TAIL).astype(np.int64)


def address(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Tile row, tile column, row, column of pairs of ranks."""
    low = TILE - 1
    tile = (left >> TILE_BITS << (HEAD_BITS - TILE_BITS)) | (right >> TILE_BITS)
    return (tile << (2 * TILE_BITS)) | ((left & low) << TILE_BITS) | (right & low)


def pair_at(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, side = TILE - 1, HEAD_BITS - TILE_BITS
    tile, cell = place >> (2 * TILE_BITS), place & (TILE * TILE - 1)
    left, right = tile >> side, tile & ((1 << side) - 1)
    return (left << TILE_BITS) | (cell >> TILE_BITS), (right << TILE_BITS) | (cell & low)


def count_pairs(left: np.ndarray, right: np.ndarray, dense_pairs: int = DENSE_PAIRS) -> Iterator[tuple[np.ndarray, ...]]:
    """(left, right, count) arrays of a buffer's distinct pairs."""
    ranked = (left < HEAD) & (right < HEAD)
    place = address(left[ranked], right[ranked])
    tiles = place >> (2 * TILE_BITS)
    sparse = np.ones(len(place), bool)
    for tile in np.flatnonzero(np.bincount(tiles) >= dense_pairs):
        inside = tiles == tile
        cells = np.bincount(place[inside] & (TILE * TILE - 1))
        at = np.flatnonzero(cells)
        yield (*pair_at((int(tile) << (2 * TILE_BITS)) | at), cells[at])
        sparse &= ~inside
    at, counts = np.unique(place[sparse], return_counts=True)
    yield (*pair_at(at), counts)
    # Pairs with an id beyond the ranks have no address.
    pairs, counts = np.unique(np.stack((left[~ranked], right[~ranked]), axis=1), axis=0, return_counts=True)
    yield pairs[:, 0], pairs[:, 1], counts


# ---------------------------------------------------------------- ids of a level


class Level:
    """What every task is handed to turn a level's items into ids; of bounded size."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits

    def frequent(self, ids: np.ndarray) -> np.ndarray:
        """Whether tail ids may be frequent; never false for those that are."""
        return np.zeros(len(ids), bool) if self.bits is None else in_bitmap(self.bits, ids)


class WordLevel(Level):
    def __init__(self, ranked: list[tuple[bytes, bytes]], bits: np.ndarray | None):
        super().__init__(bits)
        self.ranks: dict[bytes, dict[bytes, int]] = {}
        for rank, (lang, word) in enumerate(ranked):
            self.ranks.setdefault(lang, {})[word] = rank

    def table(self, lang: bytes) -> WordTable:
        return WordTable(self, lang)


class WordTable(dict):
    """Ids of a language's words; a word that cannot be frequent is a break."""

    def __init__(self, level: WordLevel, lang: bytes):
        super().__init__(level.ranks.get(lang, {}))
        self.level, self.lang = level, lang
        # A full stop stands for the end of a piece and is in no word.
        self[b"."] = BREAK

    def __missing__(self, word: bytes) -> int:
        if self.level.bits is None:
            return BREAK
        own = tail_word(self.lang, word)
        return own if self.level.frequent(np.array([own]))[0] else BREAK


class PairLevel(Level):
    def __init__(self, left: np.ndarray, right: np.ndarray, bits: np.ndarray | None):
        """``left`` and ``right`` are the ranked pairs in order of rank."""
        super().__init__(bits)
        names = self.named(left, right)
        self.order = np.argsort(names)
        self.names, self.left, self.right = names[self.order], left[self.order], right[self.order]

    @staticmethod
    def named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Addresses of pairs of ranks, hashes of all others."""
        ranked = (left < HEAD) & (right < HEAD)
        return np.where(ranked, address(np.where(ranked, left, 0), np.where(ranked, right, 0)), tail_pair(left, right))

    def ids(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        names = self.named(left, right)
        out = np.full(len(names), BREAK, np.int64)
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            hit = (self.names[at] == names) & (self.left[at] == left) & (self.right[at] == right)
            out[hit] = self.order[at[hit]]
        if self.bits is not None:
            rest = np.flatnonzero(out == BREAK)
            own = tail_pair(left[rest], right[rest])
            may = self.frequent(own)
            out[rest[may]] = own[may]
        return out


def _bitmap(tail: DataFrame) -> np.ndarray | None:
    return bitmap(tail.select(F.col("id").alias("h")), tail.count(), FILTER_BITS)


# ---------------------------------------------------------------- passes over the texts


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary")
    return docs.select(lang.alias("lang"), text_or_empty().cast("binary").alias("raw"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, a): occurrences of every word, as bytes."""
    schema = pa.schema([("lang", pa.binary()), ("word", pa.binary()), ("a", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[bytes, Counter] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, table in tables.items():
                columns = [lang] * len(table), list(table), list(table.values())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            tables.clear()

        for lang, raw in _rows(batches):
            table = tables.setdefault(lang, Counter())
            for piece in windows(raw):
                table.update(piece.lower().translate(_WORDS_ONLY).split())
            if sum(map(len, tables.values())) > WORD_TABLE:
                yield from counted()
        yield from counted()

    return _texts(docs).mapInArrow(run, "lang binary, word binary, a long").groupBy("lang", "word").agg(F.sum("a").alias("a"))


class Stream:
    """Ids of a run of texts at the highest level, as pairs of neighbours."""

    def __init__(self, levels: list[Level]):
        self.words, self.pairs = levels[0], levels[1:]
        self.tables: dict[bytes, WordTable] = {}
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, lang: bytes, raw: bytes) -> None:
        table = self.tables.get(lang)
        if table is None:
            table = self.tables[lang] = self.words.table(lang)
        for piece in windows(raw):
            found = piece.lower().translate(_PIECES).replace(b".", b" . ").split()
            self.parts.append(np.fromiter(map(table.__getitem__, found), np.int64, len(found)))
            self.held += len(found)
        self.parts.append(np.array([BREAK]))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        self.parts, self.held = [], 0
        at = np.flatnonzero(ids != BREAK)
        ids = ids[at]
        for level in self.pairs:
            near = np.flatnonzero(at[1:] == at[:-1] + 1)
            found = level.ids(ids[near], ids[near + 1])
            kept = found != BREAK
            at, ids = at[near[kept]], found[kept]
        near = np.flatnonzero(at[1:] == at[:-1] + 1)
        return ids[near], ids[near + 1]


def pair_counts(docs: DataFrame, levels, least: int) -> DataFrame:
    """(left, right, a): the frequent pairs of neighbouring ids; ``levels`` is a broadcast."""
    schema = pa.schema([("left", pa.int64()), ("right", pa.int64()), ("a", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, buffers, held = Stream(levels.value), [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            left, right = (np.concatenate(x) for x in zip(*buffers))
            buffers.clear()
            for columns in count_pairs(left, right):
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], schema=schema)

        for lang, raw in _rows(batches):
            stream.add(lang, raw)
            if stream.held >= STREAM_IDS:
                buffers.append(stream.take())
                held += len(buffers[-1][0])
                if held >= BUFFER_PAIRS:
                    yield from counted()
                    held = 0
        buffers.append(stream.take())
        yield from counted()

    counts = _texts(docs).mapInArrow(run, "left long, right long, a long").groupBy("left", "right").agg(F.sum("a").alias("a"))
    return counts.filter(F.col("a") >= least)


# ---------------------------------------------------------------- levels


def _identified(rows: DataFrame, identify: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """``rows`` with their ids in a column ``id``, by the same code that the texts' passes use."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(identify(batch))], names=[*names, "id"])

    return rows.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, id long")


def _word_level(spark: SparkSession, words: DataFrame, head: int) -> tuple[WordLevel, DataFrame]:
    top = words.filter(F.length("word") <= HEAD_WORD_BYTES).orderBy(F.desc("a"), "lang", "word").limit(head).toArrow()
    ranked = list(zip(top.column("lang").to_pylist(), top.column("word").to_pylist()))
    shared = spark.sparkContext.broadcast(WordLevel(ranked, None))  # at most HEAD words of HEAD_WORD_BYTES bytes

    def identify(batch: pa.RecordBatch) -> np.ndarray:
        ranks = shared.value.ranks
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        found = ((ranks.get(lang, {}).get(word), lang, word) for lang, word in pairs)
        return np.array([tail_word(lang, word) if rank is None else rank for rank, lang, word in found], np.int64)

    named = materialize(_identified(words, identify), "collocation-words")
    tail = named.filter(F.col("id") >= HEAD)
    return WordLevel(ranked, _bitmap(tail)), named


def _pair_level(spark: SparkSession, pairs: DataFrame, head: int) -> tuple[PairLevel, DataFrame]:
    top = pairs.orderBy(F.desc("a"), "left", "right").limit(head).toArrow()
    left, right = (top.column(c).to_numpy().astype(np.int64) for c in ("left", "right"))
    shared = spark.sparkContext.broadcast(PairLevel(left, right, None))  # at most HEAD pairs

    def identify(batch: pa.RecordBatch) -> np.ndarray:
        own = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)]
        found = shared.value.ids(*own)
        return np.where(found == BREAK, tail_pair(*own), found)

    named = materialize(_identified(pairs, identify), "collocation-pairs")
    tail = named.filter(F.col("id") >= HEAD)
    return PairLevel(left, right, _bitmap(tail)), named


def _phrases(pairs: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases of a level with the counts of all their first and last parts."""
    names = ["id", "lang", "phrase", "last", "a", "firsts", "lasts"]
    left, right = (shorter.select(*(F.col(c).alias(f"{side}_{c}") for c in names)) for side in ("l", "r"))
    joined = pairs.join(left, F.col("left") == F.col("l_id")).join(right, F.col("right") == F.col("r_id"))
    return joined.select(
        "id", F.col("l_lang").alias("lang"), F.concat_ws(" ", "l_phrase", "r_last").alias("phrase"), F.col("r_last").alias("last"), "a",
        F.concat("l_firsts", F.array("l_a")).alias("firsts"), F.concat(F.array("r_a"), "r_lasts").alias("lasts"),
    )


def _uncovered(phrases: DataFrame, longer: DataFrame | None) -> DataFrame:
    """``phrases`` that no phrase with one more word holds as often; such covers are transitive."""
    if longer is None:
        return phrases
    ends = longer.select(F.col("left").alias("inner"), "a").unionByName(longer.select(F.col("right").alias("inner"), "a"))
    covers = ends.groupBy("inner").agg(F.max("a").alias("cover"))
    kept = phrases.join(covers, F.col("id") == F.col("inner"), "left").filter("cover is null or 100 * cover < 100 * a")
    return kept.select(*phrases.columns)


def _score(k: Column, a: Column, n: Column, part: Column, rest: Column) -> Column:
    """A cut with its exact score; factors of up to 18 digits keep the products within 38."""
    wide = [c.cast("decimal(18,0)") for c in (a, n, part, rest)]
    ratio = F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * wide[0] * wide[1]).cast("decimal(38,0)"), wide[2] * wide[3])
    return F.struct(ratio.alias("score"), k.alias("k"), part.alias("l"), rest.alias("r"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, head: int = HEAD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    spark = docs.sparkSession
    counts = materialize(word_counts(docs), "collocation-counts")
    totals = materialize(counts.groupBy("lang").agg(F.sum("a").alias("n")).select(F.col("lang").cast("string").alias("of"), "n"), "collocation-totals")
    level, words = _word_level(spark, counts.filter(F.col("a") >= least), head)
    none = F.array().cast("array<long>")
    texts = F.col("lang").cast("string").alias("lang"), F.col("word").cast("string").alias("phrase"), F.col("word").cast("string").alias("last")
    phrases = words.select("id", *texts, "a", none.alias("firsts"), none.alias("lasts"))
    levels, found, shorter = [level], [], None
    for size in range(2, MAX_WORDS + 1):
        shared = spark.sparkContext.broadcast(levels)  # at most HEAD items and a bitmap for each level
        pairs = materialize(pair_counts(docs, shared, least), "collocation-frequent")
        level, pairs = _pair_level(spark, pairs, head)
        if size > 2:
            found.append(_uncovered(phrases, pairs))
        phrases = materialize(_phrases(pairs, phrases), "collocation-phrases")
        levels.append(level)
        if not len(level.names):
            break
    found.append(phrases)
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    cuts = F.transform(F.sequence(F.lit(1), F.size("firsts")), lambda k: _score(
        k, F.col("a"), F.col("n"), F.get("firsts", k - 1), F.get("lasts", k - 1)))
    scored = candidates.join(totals, F.col("lang") == F.col("of")).withColumn("cut", F.array_min(cuts))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order).cast("long"))
    return flat.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Source divergence audit over a vocabulary held in minimal acyclic transducers.

1. Each language keeps the terms that stand in at least ``least`` of its documents. The kept
   terms are sorted by language and term; their places are the ordinals.
2. The HOT most frequent of them form one transducer that every task is handed. Texts are
   streamed through it, all words of a run of texts byte by byte at once, and the ordinals
   that come out are counted for each language and source.
3. Words that it does not accept are no terms, unless more than HOT terms are kept. A bitmap
   of at most 2**FILTER_BITS bits drops most of those that no other term equals; the counts of
   the rest are dealt to shards by hash. A shard builds the transducer of its own SHARD_TERMS
   or so terms as it reads them in order, and counts the words that it accepts.
4. Blocks of consecutive ordinals are compared for all sources of a language at once, in
   whole numbers: p < 2**31, so no term of a sum exceeds 64 bits. Only sums per pair, and
   the first terms of each source and block, leave a block.
5. Ties are broken by ordinal, which is the byte order of the terms.

Defined cases: null texts, languages and sources are ''; groups and languages without terms
take part in ``pair`` with the value zero if their language keeps no term, else with the
probabilities of counts of zero; a term of any length is counted, but only those up to
HOT_BYTES bytes are handed to all tasks; repeated rows count as often as they stand there; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftlens.llm.common import bitmap, in_bitmap, materialize, text_or_empty, windows
from driftlens.llm.transducer import EMPTY, Transducer

LEAST_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
#: Terms of the transducer that every task is handed, their longest, and the terms of a shard.
HOT, HOT_BYTES, SHARD_TERMS = 1 << 15, 64, 1 << 12
#: Bits of the table that tells words which may be terms beyond those from all others, at most.
FILTER_BITS = 26
#: Distinct terms and words that one task counts before it hands its counts on.
TABLE = 200_000
#: Bytes of text that step through the transducer at once.
STEP_BYTES = 1 << 21
#: Counts of ordinals that a task holds before it adds equal ones up, and hands on if many are left.
MERGE_CODES = 1 << 21
BLOCK_BITS = 10
#: The seed of Spark's own xxhash64.
HASH_SEED = 42

#: A-Z become a-z, other bytes below 0x80 blanks; a term is what lies between blanks.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _texts(docs: DataFrame) -> DataFrame:
    def key(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary").alias(name)

    return docs.select(key("lang"), key("source"), text_or_empty().cast("binary").alias("raw"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in range(3))


def _batch(schema: pa.Schema, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# ---------------------------------------------------------------- vocabulary


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, docs): in how many documents of its language a term stands."""
    schema = pa.schema([("lang", pa.binary()), ("term", pa.binary()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[bytes, Counter] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, table in tables.items():
                yield _batch(schema, ([lang] * len(table), list(table), list(table.values())))
            tables.clear()

        for lang, _, raw in _rows(batches):
            found: set[bytes] = set()
            for piece in windows(raw):
                found.update(piece.translate(_TERMS).split())
            tables.setdefault(lang, Counter()).update(found)
            if sum(map(len, tables.values())) > TABLE:
                yield from counted()
        yield from counted()

    return _texts(docs).mapInArrow(run, "lang binary, term binary, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def vocabulary(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, docs, ord): kept terms; ordinals ascend with (lang, term) and need not be dense."""
    kept = document_counts(docs).filter(F.col("docs") >= least).orderBy("lang", "term")
    return materialize(kept.withColumn("ord", F.monotonically_increasing_id()), "divergence-vocabulary")


class Hot:
    """The transducer of the most frequent terms, with each language's way into it."""

    def __init__(self, rows: list[tuple[bytes, bytes, int]], more: np.ndarray | None):
        rows = sorted(rows, key=lambda r: r[0] + b"\0" + r[1])
        self.transducer = Transducer(lang + b"\0" + term for lang, term, _ in rows)
        self.ords = np.array([r[2] for r in rows], np.int64)
        #: Bitmap of the kept terms beyond these, if there are any.
        self.more = more

    def may_be_terms(self, lang: bytes, words: list[bytes]) -> np.ndarray:
        hashes = (xxhash.xxh64_intdigest(lang + b"\0" + word, HASH_SEED) for word in words)
        return in_bitmap(self.more, np.fromiter(hashes, np.uint64, len(words)).view(np.int64))

    def way_in(self, lang: bytes) -> tuple[int, int]:
        return self.transducer.after(lang + b"\0")


# ---------------------------------------------------------------- recount


class Run:
    """Counts of the texts of a task, which step through the transducer in runs of STEP_BYTES."""

    def __init__(self, hot: Hot):
        self.hot, self.ways = hot, {}
        self.parts: list[bytes] = []
        self.part_groups: list[int] = []
        self.bytes_held = 0
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[tuple[bytes, bytes], int] = {}
        self.codes, self.counts, self.held = [], [], 0
        self.rest: dict[int, Counter] = {}

    def add(self, lang: bytes, source: bytes, piece: bytes) -> None:
        if lang not in self.ways:
            self.ways[lang] = self.hot.way_in(lang)
        self.parts.append(piece.translate(_TERMS) + b" ")
        self.part_groups.append(self.numbers.setdefault((lang, source), len(self.numbers)))
        self.bytes_held += len(piece) + 1

    def step(self) -> None:
        """All words held take their way through the transducer."""
        joined = b"".join(self.parts)
        data = np.frombuffer(joined, np.uint8)
        inside = np.concatenate(([False], data != 32))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, stops = edges[::2], edges[1::2]
        ends = np.cumsum(np.fromiter(map(len, self.parts), np.int64, len(self.parts)))
        group = np.array(self.part_groups, np.int64)[np.searchsorted(ends, starts, side="right")]
        ways = np.array([self.ways[lang] for lang, _ in self.numbers], np.int64)
        found = self.hot.transducer.ordinals(data, starts, stops - starts, ways[group, 0], ways[group, 1])
        accepted = found != EMPTY
        codes, counts = np.unique((group[accepted] << 32) | found[accepted], return_counts=True)
        self.codes.append(codes)
        self.counts.append(counts)
        self.held += len(codes)
        if self.held > MERGE_CODES:
            self.merge()
        if self.hot.more is not None:
            other = np.flatnonzero(~accepted)
            other = other[np.argsort(group[other], kind="stable")]
            words = [joined[a:b] for a, b in zip(starts[other].tolist(), stops[other].tolist())]
            bounds = np.searchsorted(group[other], np.arange(len(self.numbers) + 1))
            for number in range(len(self.numbers)):
                if bounds[number + 1] > bounds[number]:
                    self.rest.setdefault(number, Counter()).update(words[bounds[number] : bounds[number + 1]])
            if sum(map(len, self.rest.values())) > TABLE:
                self.prune()
        self.parts, self.part_groups, self.bytes_held = [], [], 0

    def merge(self) -> None:
        codes, inverse = np.unique(np.concatenate(self.codes), return_inverse=True)
        counts = np.zeros(len(codes), np.int64)
        np.add.at(counts, inverse, np.concatenate(self.counts))
        self.codes, self.counts, self.held = [codes], [counts], len(codes)

    def prune(self) -> None:
        """Forgets words that cannot be terms."""
        for (lang, _), number in self.numbers.items():
            if words := list(self.rest.get(number, ())):
                kept = self.hot.may_be_terms(lang, words)
                table = self.rest[number]
                self.rest[number] = Counter({w: table[w] for w, keep in zip(words, kept) if keep})

    def is_full(self) -> bool:
        return self.held > MERGE_CODES // 2 and len(self.codes) == 1 or sum(map(len, self.rest.values())) > TABLE // 2

    def take(self) -> Iterator[tuple[tuple[bytes, bytes], np.ndarray, np.ndarray, Counter]]:
        """((lang, source), ordinals, counts, other words) of each group; starts anew."""
        if self.codes:
            self.prune()
            self.merge()
            bounds = np.searchsorted(self.codes[0], np.arange(len(self.numbers) + 1) << 32)
            for number, key in enumerate(self.numbers):
                own = slice(bounds[number], bounds[number + 1])
                yield key, self.hot.ords[self.codes[0][own] & 0xFFFFFFFF], self.counts[0][own], self.rest.get(number, Counter())
        self.clear()


COUNTS = "lang binary, source binary, ord long, word binary, n long"
_COUNTS = pa.schema([("lang", pa.binary()), ("source", pa.binary()), ("ord", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])


def _streamed(docs: DataFrame, hot) -> DataFrame:
    """Counts of accepted terms (``ord``) and of other words (``word``); ``hot`` is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Run(hot.value)

        def counted() -> Iterator[pa.RecordBatch]:
            for (lang, source), ords, counts, rest in texts.take():
                n, k = len(ords), len(rest)
                columns = [lang] * n, [source] * n, ords, [None] * n, counts
                yield _batch(_COUNTS, columns)
                if k:
                    yield _batch(_COUNTS, ([lang] * k, [source] * k, [None] * k, list(rest), list(rest.values())))

        for lang, source, raw in _rows(batches):
            for piece in windows(raw):
                texts.add(lang, source, piece)
                if texts.bytes_held >= STEP_BYTES:
                    texts.step()
                    if texts.is_full():
                        yield from counted()
        if texts.parts:
            texts.step()
        yield from counted()

    return _texts(docs).mapInArrow(run, COUNTS)


def _in_shards(words: DataFrame, terms: DataFrame, shards: int) -> DataFrame:
    """(lang, source, ord, n) of the words that are terms; each shard has a transducer of its own."""
    schema = pa.schema([("lang", pa.binary()), ("source", pa.binary()), ("ord", pa.int64()), ("n", pa.int64())])

    def shard_of(term: str) -> Column:
        return F.pmod(F.xxhash64("lang", term), F.lit(shards)).alias("shard")

    none = F.lit(None)
    def key(term: str) -> Column:
        return F.concat("lang", F.lit(b"\0"), term).alias("key")

    kept = terms.select(shard_of("term"), F.lit(0).alias("kind"), "lang", key("term"), none.cast("binary").alias("source"), "ord", none.cast("long").alias("n"))
    asked = words.select(shard_of("word"), F.lit(1).alias("kind"), "lang", key("word"), "source", none.cast("long").alias("ord"), "n")
    rows = kept.unionByName(asked).repartition(F.col("shard")).sortWithinPartitions("shard", "kind", "key")

    def looked_up(transducer: Transducer, ords: np.ndarray, asked: list[tuple]) -> pa.RecordBatch:
        joined = [key for _, key, _, _ in asked]
        ends = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
        starts = np.concatenate(([0], ends[:-1]))
        way = np.full(len(joined), transducer.start), np.zeros(len(joined), np.int64)
        found = transducer.ordinals(np.frombuffer(b"".join(joined), np.uint8), starts, ends - starts, *way)
        hits = np.flatnonzero(found != EMPTY)
        own = [asked[i] for i in hits.tolist()]
        return _batch(schema, ([x[0] for x in own], [x[2] for x in own], ords[found[hits]], [x[3] for x in own]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, terms, ords, transducer, asked = None, [], [], None, []
        for batch in batches:
            for shard, kind, lang, key, source, ord_, n in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != current:
                    if asked and transducer:
                        yield looked_up(transducer, np.array(ords, np.int64), asked)
                    current, terms, ords, transducer, asked = shard, [], [], None, []
                if kind == 0:
                    terms.append(key)
                    ords.append(ord_)
                    continue
                if transducer is None and terms:
                    transducer, terms = Transducer(terms), []
                asked.append((lang, key, source, n))
                if len(asked) >= TABLE:
                    if transducer:
                        yield looked_up(transducer, np.array(ords, np.int64), asked)
                    asked = []
        if asked and transducer:
            yield looked_up(transducer, np.array(ords, np.int64), asked)

    columns = "shard", "kind", "lang", "key", "source", "ord", "n"
    return rows.select(*columns).mapInArrow(run, "lang binary, source binary, ord long, n long")


def recount(docs: DataFrame, terms: DataFrame, hot: int = HOT, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, source, ord, n): occurrences of every kept term in every group that has it."""
    spark = docs.sparkSession
    short = terms.filter(F.length("term") <= HOT_BYTES)
    handed = short.orderBy(F.desc("docs"), "ord").limit(hot).select("lang", "term", "ord").toArrow()
    rows = list(zip(*(handed.column(c).to_pylist() for c in ("lang", "term", "ord"))))
    taken = spark.createDataFrame(handed.select(["ord"]))
    rest = materialize(terms.join(taken, "ord", "left_anti"), "divergence-further-terms")
    beyond = rest.count()
    hashes = rest.select(F.xxhash64(F.concat("lang", F.lit(b"\0"), "term")).alias("h"))
    # At most HOT terms of HOT_BYTES bytes, and a bitmap: the table's slots are bounded by the terms' bytes.
    shared = spark.sparkContext.broadcast(Hot(rows, bitmap(hashes, beyond, FILTER_BITS)))
    streamed = _streamed(docs, shared).groupBy("lang", "source", "ord", "word").agg(F.sum("n").alias("n"))
    streamed = materialize(streamed, "divergence-streamed")
    counts = streamed.filter("ord is not null").select("lang", "source", "ord", "n")
    if not beyond:
        return counts
    more = _in_shards(streamed.filter("word is not null"), rest, -(-beyond // shard_terms))
    return materialize(counts.unionByName(more), "divergence-counts")


# ---------------------------------------------------------------- divergence


def probabilities(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 kept)), three digits at a time to stay in 64 bits."""
    whole = total + 2 * kept
    rest, out = counts + 2, np.zeros_like(counts)
    out, rest = rest // whole, rest % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return 1 + out


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


BLOCK = "lang binary, source binary, other binary, ord long, value long"
_BLOCK = pa.schema([("lang", pa.binary()), ("source", pa.binary()), ("other", pa.binary()), ("ord", pa.int64()), ("value", pa.int64())])


def compare_block(table: pa.Table) -> pa.Table:
    """Sums for pairs of sources (``other`` set) and first terms of sources (``ord`` set) of one block.

    Rows without ``ord`` list all groups of the language with their totals.
    """
    columns = {name: table.column(name).to_pylist() for name in ("lang", "source", "ord", "n", "total", "lang_total", "kept")}
    rows = list(zip(*columns.values()))
    roster = sorted((r[1], r[4]) for r in rows if r[2] is None)
    number = {source: i for i, (source, _) in enumerate(roster)}
    ords = sorted({r[2] for r in rows if r[2] is not None})
    place = {o: i for i, o in enumerate(ords)}
    lang, lang_total, kept = rows[0][0], columns["lang_total"][0], columns["kept"][0]
    counts = np.zeros((len(roster), len(ords)), np.int64)
    for _, source, o, n, *_ in rows:
        if o is not None:
            counts[number[source], place[o]] = n
    p = probabilities(counts, np.array([t for _, t in roster], np.int64)[:, None], kept)
    q = probabilities(counts.sum(axis=0), np.int64(lang_total), kept)
    out: list[tuple] = []
    for i, (source, _) in enumerate(roster):
        sums = distances(p[i], p[i + 1 :]).sum(axis=1)
        out += [(lang, source, roster[i + 1 + k][0], None, s) for k, s in enumerate(sums.tolist())]
        at = np.flatnonzero((counts[i] > 0) & (p[i] > q))
        values = distances(p[i, at], q[at])
        out += [(lang, source, None, ords[at[k]], int(values[k])) for k in np.lexsort((at, -values))[:TOP]]
    return pa.Table.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_BLOCK)], schema=_BLOCK)


def _ranked(rows: DataFrame, tie: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), tie)
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, least: int = LEAST_DOCS, hot: int = HOT, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far apart the sources of a language are, and by which terms."""
    terms = vocabulary(docs, least)
    counts = recount(docs, terms, hot, shard_terms)
    groups = materialize(_texts(docs).select("lang", "source").distinct(), "divergence-groups")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    sized = groups.join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    sized = materialize(sized.join(kept, "lang"), "divergence-sized")
    of_lang = materialize(sized.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.first("kept").alias("kept")), "divergence-langs")

    block = F.shiftright("ord", BLOCK_BITS).alias("block")
    blocks = materialize(terms.select("lang", block).distinct(), "divergence-blocks")
    none = F.lit(None).cast("long")
    roster = blocks.join(sized.select("lang", "source", "total"), "lang").select("lang", "block", "source", none.alias("ord"), none.alias("n"), "total")
    listed = counts.select("lang", block, "source", "ord", "n", none.alias("total")).unionByName(roster).join(of_lang, "lang")
    compared = listed.groupBy("lang", "block").applyInArrow(compare_block, BLOCK)
    compared = materialize(compared, "divergence-compared")

    sums = compared.filter("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    # A row for each two sources of a language is the result itself.
    pairs = groups.join(groups.withColumnRenamed("source", "other"), "lang").filter("source != other")
    pairs = pairs.join(both, ["lang", "source", "other"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    first = _ranked(compared.filter("other is null").drop("other"), "ord").filter(F.col("rank") <= TOP)
    first = first.join(terms.select("lang", "ord", F.col("term").alias("item")), ["lang", "ord"])
    parts = [_ranked(pairs, "other").withColumnRenamed("other", "item").withColumn("part", F.lit("pair")), first.withColumn("part", F.lit("term"))]
    text = [F.col(c).cast("string").alias(c) for c in ("lang", "source", "part", "item")]
    return parts[0].select(*text, "value", "rank").unionByName(parts[1].select(*text, "value", "rank"))

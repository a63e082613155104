"""Token files made of independent zstandard frames with a trailing seek table.

File format: one frame per document, holding its token ids as little-endian numbers; a
skippable frame with the documents' ids; and, last, the seek table as a skippable frame. The
table lists for every frame its packed size, plain size and checksum (the low 32 bits of
XXH64 of the plain bytes) and ends in a fixed-size footer, so a reader fetches the footer,
then the table, then only the frames it wants. Any zstandard tool unpacks the whole file.

Documents are dealt to files by ranges of ``doc_id``, so files follow one another in id
order. Every attempt of a task writes a file of its own name; the manifest names the files
of the attempts that succeeded, so files that lost executors leave behind are never read.

Defined cases: a null text is the empty text and holds the end id alone; null ids come
first; repeated rows are stored once each; an empty table gives no files and an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from driftlens.llm.bpe import CACHED_CHARS, TOKENIZER
from driftlens.llm.common import materialize, scratch_dir, text_or_empty

END_ID = 0
#: A task starts another file once its current one has this many bytes.
FILE_BYTES = 256 << 20
#: Chunks whose ids one Python worker keeps. A full table keeps what it has, which is what is
#: frequent, and starts anew after four times as many misses.
CHUNK_ENTRIES = 900_000
#: Marks at a chunk's end are asked apart from the word before them.
MARKS = string.punctuation
#: Longer runs of marks stay with their word.
MOST_MARKS = 8
#: New chunks that go to the library in one text.
JOINED_CHUNKS = 256
#: Texts of a library call, whose answers take many times the memory of their ids.
ASKED_TEXTS = 16
#: Bytes of text that are encoded in one step, unless one text is longer.
STEP_BYTES = 4 << 20
ANY_SPACE = re.compile(r"\s")
#: A newline that the tokenizer takes as a piece of its own, whatever stands around it.
NEWLINE = re.compile(r"\n(?<=\S\n)(?=\S)")
#: What begins the chunk of a text's start or of a line's; texts that hold one are asked whole.
START, LINE = "\ue000", "\ue001"
#: bpe.ENTANGLED for Arrow, whose \s has ASCII only.
_ARROW_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACED_BLANK = rf"(?:{_ARROW_SPACE}|\A) (?:{_ARROW_SPACE}|\z)"
#: Fixed values of the seekable format and of this file's own index frame.
SKIPPABLE_SEEK = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<III")
SKIP_HEAD = struct.Struct("<II")
INDEX_HEAD = struct.Struct("<QB")


class FrameFile:
    """Builds one file: append documents, then ``finish`` writes index and seek table."""

    def __init__(self, sink, wide: bool):
        self.sink, self.wide = sink, wide
        self.packer = zstandard.ZstdCompressor(level=1, write_checksum=True)
        self.entries, self.doc_ids, self.bytes, self.tokens = [], [], 0, 0

    def append(self, doc_id: int | None, ids: np.ndarray) -> None:
        plain = ids.astype("<u4" if self.wide else "<u2").tobytes()
        packed = self.packer.compress(plain)
        self.sink.write(packed)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.doc_ids.append(doc_id)
        self.bytes += len(packed)
        self.tokens += len(ids)

    def finish(self) -> None:
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        values = np.array([d if d is not None else 0 for d in self.doc_ids], "<i8")
        index = zstandard.ZstdCompressor().compress(values.tobytes() + known.tobytes())
        body = INDEX_HEAD.pack(len(self.doc_ids), 4 if self.wide else 2) + index
        self.sink.write(SKIP_HEAD.pack(SKIPPABLE_INDEX, len(body)) + body)
        # The index frame is listed as well, so that offsets up to the table add up.
        entries = [*self.entries, (SKIP_HEAD.size + len(body), 0, 0)]
        table = b"".join(ENTRY.pack(*e) for e in entries) + FOOTER.pack(len(entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(SKIP_HEAD.pack(SKIPPABLE_SEEK, len(table)) + table)
        self.sink.close()


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.source, size = source, source.size()
        count, flags, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a seekable token file with checksums")
        table = source.read_at(count * ENTRY.size, size - FOOTER.size - count * ENTRY.size)
        entries = np.frombuffer(table, "<u4").reshape(count, 3)
        self.sizes, self.plain, self.sums = entries[:, 0], entries[:, 1], entries[:, 2]
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        index = source.read_at(int(self.sizes[-1]), int(self.starts[-1]))
        kind, length = SKIP_HEAD.unpack_from(index)
        if kind != SKIPPABLE_INDEX:
            raise ValueError("the index frame is missing")
        self.n_docs, self.width = INDEX_HEAD.unpack_from(index, SKIP_HEAD.size)
        unpacked = zstandard.ZstdDecompressor().decompress(index[SKIP_HEAD.size + INDEX_HEAD.size : SKIP_HEAD.size + length])
        known = np.frombuffer(unpacked, np.uint8, offset=8 * self.n_docs)
        values = np.frombuffer(unpacked, "<i8", count=self.n_docs)
        self.doc_ids = [int(v) if k else None for v, k in zip(values, known)]
        self.unpacker = zstandard.ZstdDecompressor()

    def lengths(self) -> np.ndarray:
        """Tokens of every document, from the table alone."""
        return self.plain[: self.n_docs].astype(np.int64) // self.width

    def document(self, n: int) -> np.ndarray:
        """The ``n``-th document's ids; reads and unpacks its frame only."""
        plain = self.unpacker.decompress(self.source.read_at(int(self.sizes[n]), int(self.starts[n])))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != int(self.sums[n]):
            raise ValueError(f"frame {n} does not match its checksum")
        return np.frombuffer(plain, f"<u{self.width}").astype("<u4")


class LibraryEncoder:
    """The tokenizers library, asked once per distinct chunk.

    Texts are cut at blanks and at single newlines inside a line of text. A chunk's ids do not
    depend on its neighbours unless white space surrounds a blank or a special token's string
    occurs; such texts are handed to the library whole. So Arrow finds the distinct chunks of
    many texts, new ones are asked for in texts of many (a token that begins with the separator
    begins a chunk), and Arrow puts the ids of all chunks in order.

    Chunks are known by their first character: LINE for one after a newline, START for a
    text's first one, anything else for one after a blank.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.special_starts = {t[0] for t in special}
        vocabulary = self.library.get_vocab()
        self.begins = {}
        for lead in (" ", "\n"):
            letter = self.library.encode(lead + "a", add_special_tokens=False).tokens[0][0]
            self.begins[lead] = np.zeros(max(vocabulary.values()) + 1, bool)
            self.begins[lead][[n for token, n in vocabulary.items() if token.startswith(letter)]] = True
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.ending: dict[str, bool] = {}
        self.turned_away = 0

    @property
    def wide(self) -> bool:
        return self.library.get_vocab_size() > 1 << 16

    def _ask(self, texts: list[str]) -> list[bytes]:
        found = []
        for at in range(0, len(texts), ASKED_TEXTS):
            asked = self.library.encode_batch_fast(texts[at : at + ASKED_TEXTS], add_special_tokens=False)
            found += [array("I", f.ids).tobytes() for f in asked]
        return found

    def _ask_after(self, lead: str, words: list[str]) -> dict[str, bytes]:
        """Ids of words that follow the separator each, its own included; a word with white space is asked alone."""
        groups, alone, found = [], [], {}
        for at in range(0, len(words), JOINED_CHUNKS):
            group = words[at : at + JOINED_CHUNKS]
            if ANY_SPACE.search("".join(group)) or not all(group):
                alone += [w for w in group if not w or ANY_SPACE.search(w)]
                group = [w for w in group if w and not ANY_SPACE.search(w)]
            if group:
                groups.append(group)
        for group, packed in zip(groups, self._ask([lead + lead.join(g) for g in groups])):
            starts = np.flatnonzero(self.begins[lead][np.frombuffer(packed, "<u4")])
            if len(starts) != len(group):
                alone += group
                continue
            ends = [*(4 * starts[1:]).tolist(), len(packed)]
            found.update((w, packed[a:b]) for w, a, b in zip(group, (4 * starts).tolist(), ends))
        found.update(zip(alone, self._ask([lead + w for w in alone])))
        return found

    def _ask_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks, each with the blank or newline before it."""
        lines, firsts = [c for c in chunks if c[:1] == LINE], [c for c in chunks if c[:1] == START]
        found = self._ask_after(" ", [c for c in chunks if c[:1] not in (START, LINE)])
        # With white space of its own a first chunk could grow together with a newline.
        alone = [c for c in firsts if len(c) == 1 or ANY_SPACE.search(c)]
        found.update(zip(alone, self._ask([c[1:] for c in alone])))
        firsts = [c for c in firsts if c not in found]
        after = self._ask_after("\n", list({c[1:] for c in (*lines, *firsts)}))
        found.update((c, after[c[1:]]) for c in lines)
        found.update((c, after[c[1:]][4:]) for c in firsts)  # without the newline's id
        return found

    def _ends(self, letter: str) -> bool:
        """Whether marks after this character are a piece of their own."""
        if letter not in self.ending:
            pieces = self.library.pre_tokenizer.pre_tokenize_str(letter + ".")
            self.ending[letter] = len(pieces) == 2 and not letter.isspace()
        return self.ending[letter]

    def _has_special(self, text: str) -> bool:
        return any(c in text for c in self.special_starts) and bool(self.special.search(text))

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks, from the table or the library."""
        known = self.known
        if self.turned_away > 4 * CHUNK_ENTRIES:
            known.clear()
            self.turned_away = 0
        found = list(map(known.get, chunks))
        fresh = self._ask_chunks([c for c, ids in zip(chunks, found) if ids is None])
        if len(known) < CHUNK_ENTRIES and not self.turned_away:
            known.update((c, ids) for c, ids in fresh.items() if len(c) <= CACHED_CHARS)
        else:
            self.turned_away += len(fresh)
        return [fresh[c] if ids is None else ids for c, ids in zip(chunks, found)]

    def _known_marks(self, marks: list[str]) -> list[bytes]:
        new = [m for m in marks if m not in self.marks]
        fresh = dict(zip(new, self._ask(new)))
        found = [fresh[m] if m in fresh else self.marks[m] for m in marks]
        if len(self.marks) < CHUNK_ENTRIES:
            self.marks.update(fresh)
        return found

    def _look_up(self, chunks: pa.Array) -> pa.Array:
        """Ids of distinct chunks; marks at a chunk's end are looked up apart from the word before them."""
        word = pc.utf8_rtrim(chunks, MARKS)
        last = pc.utf8_slice_codeunits(word, -1).dictionary_encode()
        n_marks = pc.subtract(pc.binary_length(chunks), pc.binary_length(word)).to_numpy().copy()
        apart = np.array([self._ends(c) for c in last.dictionary.to_pylist()], bool)[last.indices.to_numpy()]
        n_marks[~apart | (n_marks > MOST_MARKS)] = 0
        words = pc.if_else(pa.array(n_marks > 0), word, chunks).dictionary_encode()
        values = self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        # Every chunk is a word's ids and then those of its marks, or none.
        both = np.full((len(chunks), 2), len(values), np.int64)
        both[:, 0] = words.indices.to_numpy()
        values.append(b"")
        for n in np.unique(n_marks[n_marks > 0]).tolist():
            rows = np.flatnonzero(n_marks == n)
            marks = pc.utf8_slice_codeunits(chunks.take(pa.array(rows)), -n).dictionary_encode()
            both[rows, 1] = len(values) + marks.indices.to_numpy()
            values += self._known_marks(marks.dictionary.to_pylist())
        _, ends, data = pa.array(values, pa.large_binary()).take(pa.array(both.ravel())).buffers()
        ends = np.frombuffer(ends, np.int64, both.size + 1)[::2].copy()
        return pa.Array.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(ends), data or pa.py_buffer(b"")])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        entangled = pc.match_substring_regex(pa.array(texts, pa.string()), SPACED_BLANK).to_pylist()
        whole = [n for n, t in enumerate(texts) if entangled[n] or START in t or LINE in t or self._has_special(t)]
        done = dict(zip(whole, self._ask([texts[n] for n in whole])))
        cut = [START + NEWLINE.sub(" " + LINE, t) for n, t in enumerate(texts) if n not in done]
        split = pc.split_pattern(pa.array(cut, pa.string()), " ")
        chunks = split.flatten().dictionary_encode()
        ids = self._look_up(chunks.dictionary).take(chunks.indices)
        _, ends, data = ids.buffers()
        borders = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()] // 4 if cut else []
        tokens = np.frombuffer(data, "<u4", borders[-1]) if cut and borders[-1] else np.empty(0, "<u4")
        joined = (tokens[a:b] for a, b in zip(borders, borders[1:]))
        return [np.frombuffer(done[n], "<u4") if n in done else next(joined) for n in range(len(texts))]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with up to STEP_BYTES of text (column 1), or one row."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = before = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, before + STEP_BYTES, side="right")))
        yield batch.slice(at, upto - at)
        at, before = upto, ends[upto - 1]


def file_system(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, n_bytes long"


def write_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode ``docs`` and write them in ascending ``doc_id`` order; one manifest row per file."""
    path = path or public_tokenizers.path(TOKENIZER)
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange(width, "doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = library_encoder(path), TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        system, root = file_system(folder)
        current, seq = None, 0

        def closed():
            current.finish()
            return pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "path": [name], "n_docs": [len(current.doc_ids)], "n_tokens": [current.tokens], "n_bytes": [current.bytes]},
                schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]),
            )

        for batch in batches:
            for step in steps(batch):
                for doc_id, ids in zip(step.column(0).to_pylist(), own.encode(step.column(1).to_pylist())):
                    if current is None:
                        name = f"tokens-{part:06d}-{seq:04d}-{attempt}.zst"
                        system.create_dir(root, recursive=True)
                        current = FrameFile(system.open_output_stream(f"{root}/{name}", compression=None), own.wide)
                    current.append(doc_id, np.append(ids, np.uint32(end_id)))
                    if current.bytes >= file_bytes:
                        yield closed()
                        current, seq = None, seq + 1
        if current is not None:
            yield closed()

    return materialize(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files."""
    # One row per file, so the running sum in one task stays small.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = placed.select("path", "start").repartition(width, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(f"{root}/{path}") as source:
                    reader = FrameReader(source)
                    lengths = reader.lengths()
                    starts = start + np.cumsum(lengths) - lengths
                    for at in range(0, reader.n_docs, 4096):
                        upto = min(reader.n_docs, at + 4096)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(reader.doc_ids[at:upto], pa.int64()), pa.array(starts[at:upto]), pa.array(lengths[at:upto]),
                            pa.array([zlib.crc32(reader.document(n).tobytes()) for n in range(at, upto)], pa.int64()),
                        ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, folder: str | None = None, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark, "token-files")
    return read_files(spark, write_files(docs, folder, path), folder)

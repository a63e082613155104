"""op5 and op7 against the tokenizers library, and their defined cases."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
import zstandard
from conftest_llm import ODD, prose
from pyarrow import fs as arrow_fs
from tokenizers import Tokenizer

from driftlens.llm import bpe, token_files as tf

PIECES = [
    "a", "b", "th", "the ", " ", "  ", "\n", "\t", "\r\n", "'s", "'", "é", "ß", "日本", "1", "23", "²", "_", "###", " ", "\x1c", "\x85",
    "<|endoftext|>", "!", " ing", "word, ", "Word. ", "😀", "é", "​", "　", "'LL", "aaaaaaaaaaaaaaaaaaaa", "\x00", "İ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(1)
    made = ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 30))) for _ in range(4000)]
    made += ["".join(chr(draw.randint(1, 0x2FFF)) for _ in range(20)) for _ in range(500)]
    return made + [t or "" for _, t, *_ in ODD] + ["ab" * 20_000, "-=" * 5_000]


def test_encoder_equals_the_library(library, texts):
    own = bpe.encoder(public_tokenizers.path(bpe.TOKENIZER))
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        joined, ids = own.encode(text)
        assert list(ids) == want.ids and joined == ",".join(map(str, want.ids))
        assert own.tables.decode(ids.astype(np.int64)) == library.decode(want.ids, skip_special_tokens=False)


def test_every_token_encodes_to_itself():
    tables = bpe.encoder(public_tokenizers.path(bpe.TOKENIZER)).tables
    draw = random.Random(2)
    for n in draw.sample(range(len(tables.bytes)), 2000):
        tables.order.pop(tables.bytes[n])  # else a whole token is looked up
        try:
            assert tables.encode_piece(tables.bytes[n]) == [n]
        finally:
            tables.order[tables.bytes[n]] = n


def test_a_full_table_changes_nothing(library, texts, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    monkeypatch.setattr(tf, "CHUNK_ENTRIES", 50)
    some = texts[:1500]
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    own, asking = bpe.Encoder(public_tokenizers.path(bpe.TOKENIZER)), tf.LibraryEncoder(public_tokenizers.path(bpe.TOKENIZER))
    assert [list(own.encode(t)[1]) for t in some] == want
    assert [list(x) for at in range(0, len(some), 100) for x in asking.encode(some[at : at + 100])] == want


def test_known_words_are_not_asked_again(library, monkeypatch):
    own, draw = tf.LibraryEncoder(public_tokenizers.path(bpe.TOKENIZER)), random.Random(3)
    words, marks = ["quatorze", "Ströme", "the", "señor", "x1"], ["", ",", ".", "!!", "%%%", ")."]
    own.encode([" ".join(["a", *words]), *words, *("a\n" + w for w in words), *("a" + m for m in marks)])
    texts = ["".join(f"{draw.choice(words)}{draw.choice(marks)}{draw.choice([' ', chr(10)])}" for _ in range(40)) + "the" for _ in range(50)]
    asked, ask = [], own._ask
    monkeypatch.setattr(own, "_ask", lambda some: asked.extend(some) or ask(some))
    assert [list(x) for x in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert asked == []


def test_odd_chunks_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(tf, "ASKED_TEXTS", 3)
    own, draw = tf.LibraryEncoder(public_tokenizers.path(bpe.TOKENIZER)), random.Random(4)
    pieces = [*PIECES, tf.START, tf.LINE, "\n\n", " \n", "\n ", "\n", "a\nb", "\u2003", "\u2028", "it's.", "r'", "'.", "x" + "." * 20, "日本.", "٣.", "\u0378.", "ʰ!"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 20))) for _ in range(4000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for at in range(0, len(texts), 400) for x in own.encode(texts[at : at + 400])] == want


def test_steps_hold_every_row_and_few_bytes(monkeypatch):
    monkeypatch.setattr(tf, "STEP_BYTES", 100)
    texts = ["a" * n for n in (0, 0, 99, 1, 1, 300, 0, 60, 40, 50, 51, 0)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    got = list(tf.steps(batch.slice(1)))
    assert [r for s in got for r in s.column(0).to_pylist()] == list(range(1, len(texts)))
    assert all(s.num_rows == 1 or sum(map(len, s.column(1).to_pylist())) <= 100 for s in got)
    assert list(tf.steps(batch.slice(0, 0))) == []


def test_bpe_defined_cases(odd, none, library):
    got = bpe.encode_documents(odd).collect()
    assert len(got) == len(ODD)
    text = {i: t or "" for i, t, *_ in ODD}
    for r in got:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert bpe.encode_documents(none).count() == 0


def test_files_hold_every_document_in_order(odd, none, library, tmp_path):
    got = tf.round_trip(odd, str(tmp_path / "t")).collect()
    assert len(got) == len(ODD) and tf.round_trip(none, str(tmp_path / "e")).count() == 0
    text, start = {i: t or "" for i, t, *_ in ODD}, 0
    for r in sorted(got, key=lambda r: r.start):
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids + [tf.END_ID]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert in_order == sorted(in_order, key=lambda i: (i is not None, i or 0))


def test_small_files_follow_one_another(make_docs, tmp_path):
    docs = make_docs([(i, prose(i, 40), "en", "s") for i in range(200)])
    manifest = tf.write_files(docs, str(tmp_path), file_bytes=2000)
    assert manifest.count() > 8
    got = sorted(tf.read_files(docs.sparkSession, manifest, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    ends = [r.start + r.n_tokens for r in got]
    assert [r.start for r in got] == [0, *ends[:-1]]


def written(tmp_path, wide=False):
    system, root = arrow_fs.LocalFileSystem(), str(tmp_path / "f.zst")
    file = tf.FrameFile(system.open_output_stream(root, compression=None), wide)
    parts = [np.arange(n, dtype=np.uint32) for n in (0, 1, 5000)]
    for k, ids in enumerate(parts):
        file.append(k if k else None, ids)
    file.finish()
    return system, root, parts


@pytest.mark.parametrize("wide", [False, True])
def test_frames_are_read_one_by_one(tmp_path, wide):
    system, root, parts = written(tmp_path, wide)
    reader = tf.FrameReader(system.open_input_file(root))
    assert reader.doc_ids == [None, 1, 2] and list(reader.lengths()) == [0, 1, 5000]
    assert all((reader.document(n) == ids).all() for n, ids in enumerate(parts))
    data = open(root, "rb").read()
    assert struct.unpack("<I", data[-4:])[0] == 0x8F92EAB1
    plain = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)
    assert plain == b"".join(p.astype("<u4" if wide else "<u2").tobytes() for p in parts)
    assert [int(s) for s in reader.sums[:3]] == [xxhash.xxh64_intdigest(p.astype("<u4" if wide else "<u2").tobytes()) & 0xFFFFFFFF for p in parts]


def test_damage_is_noticed(tmp_path):
    system, root, _ = written(tmp_path)
    reader = tf.FrameReader(system.open_input_file(root))
    reader.sums = reader.sums + np.uint32(1)
    with pytest.raises(ValueError):
        reader.document(2)
    open(root, "ab").write(b"junk")
    with pytest.raises(ValueError):
        tf.FrameReader(system.open_input_file(root))

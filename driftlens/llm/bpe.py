"""Exact byte-pair encoding in linear time, and decoding by an offset table.

An Aho-Corasick automaton over all tokens gives the longest token starting at every byte.
The encoder walks left to right with it. A token may follow its predecessor only if merging
would never have crossed the border between the two; that depends on the pair alone, so it
is a (memoised) table. Where no token fits, the last one is taken back and its next shorter
prefix is tried; a bit per position keeps a dead end from being entered twice, which makes
the walk linear. The result is what applying the merges in order gives.

Texts are cut at single blanks into chunks whose encodings do not depend on each other, and
chunk encodings are kept in a bounded table. Texts with runs of white space around blanks
take the pattern of the tokenizer over the whole text instead.

Defined cases: a null text is the empty text and has no ids; the strings of special tokens
inside a text become their ids; repeated rows give repeated rows; an empty table gives an
empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F

from driftlens.llm.common import map_batches, text_or_empty

TOKENIZER = "byte_bpe_50k.json"
#: Entries of the chunk and pretoken tables of one Python worker. A full table keeps what it
#: has, which is what is frequent, and starts anew after four times as many misses.
CACHE_ENTRIES = 400_000
#: Longer pieces are encoded each time instead of being kept.
CACHED_CHARS = 64
#: The published pretokenizer pattern, white space by its Unicode property.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: A blank with white space (or an end) on both sides: chunks would not be independent.
ENTANGLED = re.compile(r"(?:\s|\A) (?:\s|\Z)")


def byte_letters() -> list[str]:
    """The printable letter that a byte-level vocabulary file writes for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + hidden.index(b)) for b in range(256)]


class BytePairTables:
    """A vocabulary file's tokens by creation order: bytes first, then one per merge."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        letters = byte_letters()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        raw = {text: bytes(byte_of[c] for c in text) for text in model["vocab"] if all(c in byte_of for c in text)}
        self.ids = [model["vocab"][letters[b]] for b in range(256)]
        self.parts = [(b, b) for b in range(256)]
        self.bytes = [bytes([b]) for b in range(256)]
        order = {data: n for n, data in enumerate(self.bytes)}
        self.merged: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, text = (order[raw[left]], order[raw[right]]), left + right
            if raw[text] not in order:
                order[raw[text]] = len(self.bytes)
                self.bytes.append(raw[text])
                self.parts.append(pair)
                self.ids.append(model["vocab"][text])
            self.merged.setdefault(pair, order[raw[text]])
        self.order = order
        self.shorter = [next((order[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in order), -1) for t in self.bytes]
        self.automaton = ahocorasick.Automaton()
        for n, data in enumerate(self.bytes):
            self.automaton.add_word(data.decode("latin-1"), n)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab_size = max([*model["vocab"].values(), *self.special.values()]) + 1
        # Decoding: all tokens' bytes in one array, and where each id's bytes begin.
        of_id = {self.ids[n]: data for n, data in enumerate(self.bytes)} | {i: s.encode() for s, i in self.special.items()}
        self.offsets = np.zeros(self.vocab_size + 1, np.int64)
        self.offsets[1:] = np.cumsum([len(of_id.get(i, b"")) for i in range(self.vocab_size)])
        self.blob = np.frombuffer(b"".join(of_id.get(i, b"") for i in range(self.vocab_size)), np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens would end with just this border.

        Undo the later merge of the two again and again: at each step the pair across the
        border must not have been merged before the pieces that it would have broken up.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= CACHE_ENTRIES:
                self.fits.clear()
            known = self.fits[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        before = len(self.bytes) + 1
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            if left < 256 and right < 256:
                return True
            # On the left the later of both merges is undone strictly, on the right with its own turn.
            if left > right:
                before, left = left, self.parts[left][1]
            else:
                before, right = right + 1, self.parts[right][0]

    def encode_piece(self, data: bytes) -> list[int]:
        """Creation orders of one pretoken's tokens."""
        whole = self.order.get(data)
        if whole is not None:
            return [whole]
        text = data.decode("latin-1")
        # Often the greedy chain of longest matches already holds at every border.
        greedy = [token for _, token in self.automaton.iter_long(text)]
        if all(map(self.compatible, greedy, greedy[1:])):
            return greedy
        longest = [-1] * len(data)
        for end, token in self.automaton.iter(text):
            start = end + 1 - len(self.bytes[token])
            if longest[start] < 0 or len(self.bytes[longest[start]]) < end + 1 - start:
                longest[start] = token
        size, at, chosen = len(data), 0, []
        open_at = bytearray(b"\x01") * (size + 1)
        token = longest[0]
        while at < size:
            end = at + len(self.bytes[token])
            if open_at[end] and (not chosen or self.compatible(chosen[-1], token)):
                chosen.append(token)
                at = end
                token = longest[at] if at < size else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                open_at[at] = 0
                token = chosen.pop()
                at -= len(self.bytes[token])
                # The token taken back leads to a closed position now, so a shorter one is tried.
        return chosen

    def decode(self, ids: np.ndarray) -> str:
        starts, lengths = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(lengths)
        if not len(ids) or not ends[-1]:
            return ""
        index = np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)
        return self.blob[index].tobytes().decode("utf-8", "replace")


class Chunks(dict):
    """A bounded table of what ``encode`` gives for a piece of text."""

    def __init__(self, encode: Callable):
        super().__init__()
        self.encode, self.turned_away = encode, 0

    def __missing__(self, chunk: str):
        made = self.encode(chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.turned_away += 1
                if self.turned_away <= 4 * CACHE_ENTRIES:
                    return made
                self.clear()
                self.turned_away = 0
            self[chunk] = made
        return made


class Encoder:
    def __init__(self, path: str):
        self.tables = BytePairTables(path)
        self.pieces = Chunks(self._piece)
        self.after_blank = Chunks(lambda chunk: self._by_pattern(" " + chunk))
        self.at_start = Chunks(self._by_pattern)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.tables.special)) + ")") if self.tables.special else None

    def _piece(self, piece: str) -> list[int]:
        return [self.tables.ids[n] for n in self.tables.encode_piece(piece.encode("utf-8", "surrogatepass"))]

    def _by_pattern(self, text: str) -> tuple[str, bytes]:
        ids = list(chain.from_iterable(map(self.pieces.__getitem__, PATTERN.findall(text))))
        return ",".join(map(str, ids)), array("I", ids).tobytes()

    def _segment(self, text: str) -> list[tuple[str, bytes]]:
        if not text:
            return []
        if ENTANGLED.search(text):
            return [self._by_pattern(text)]
        first, *rest = text.split(" ")
        after = self.after_blank
        return ([self.at_start[first]] if first else []) + [after[c] for c in rest]

    def encode(self, text: str) -> tuple[str, np.ndarray]:
        """Decimal ids joined by commas, and the ids."""
        if self.specials is None or not self.specials.search(text):
            parts = self._segment(text)
        else:
            parts = []
            for n, part in enumerate(self.specials.split(text)):
                if n % 2:
                    special = self.tables.special[part]
                    parts.append((str(special), np.array([special], "<u4").tobytes()))
                else:
                    parts += self._segment(part)
        return ",".join([p[0] for p in parts]), np.frombuffer(b"".join([p[1] for p in parts]), "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker: tasks of a reused worker share the tables."""
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of every row of ``docs``."""
    path = path or public_tokenizers.path(TOKENIZER)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if with_ids else ""

    def make():
        own = encoder(path)

        def step(batch):
            encoded = [own.encode(t) for t in batch.column(1).to_pylist()]
            out = {
                "doc_id": batch.column(0),
                "n_tokens": [len(ids) for _, ids in encoded],
                "ids_sha256": [hashlib.sha256(text.encode()).hexdigest() for text, _ in encoded],
                "decoded_sha256": [
                    hashlib.sha256(own.tables.decode(ids.astype(np.int64)).encode()).hexdigest() for _, ids in encoded
                ],
            }
            return out | ({"ids": [ids.astype(np.int32) for _, ids in encoded]} if with_ids else {})

        return step

    return map_batches(source, schema, make)

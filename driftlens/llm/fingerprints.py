"""Exact duplicates by composable polynomial fingerprints.

A text's normal form is its UTF-8 bytes without white space. It is hashed in chunks;
chunk hashes combine by shifting the left one by the length of the right one, so a huge
text needs no pass over one long buffer and chunks may be hashed in any order. Rows with
equal fingerprints are then compared with the row that stays, chunk by chunk; a chunk is
the largest piece that any comparison holds.

Defined cases: a null text is the empty text, all empty texts are equal; repeated rows
(same id, same text) are members of one group of which one row is kept; a null ``doc_id``
loses every tie; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from driftlens.llm.common import SPACES, bitmap, in_bitmap, map_batches, materialize, text_or_empty

#: Two primes below 2**31: a chunk's weighted byte sum stays far inside 64 bits.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
CHUNK_BYTES = 1 << 16
KEY = ["f1", "f2", "n_bytes"]
#: Bits of the table of shared fingerprints that every task is handed, at most.
FILTER_BITS = 26


class Hasher:
    """Polynomial hashes of byte strings, modulo two primes."""

    def __init__(self, chunk_bytes: int = CHUNK_BYTES):
        self.chunk = chunk_bytes
        self.powers = []
        for prime, base in zip(PRIMES, BASES):
            table = np.ones(chunk_bytes, np.int64)
            for i in range(1, chunk_bytes):
                table[i] = int(table[i - 1]) * base % prime
            self.powers.append(table[::-1].copy())

    def of_chunk(self, data: bytes) -> tuple[int, int, int]:
        values = np.frombuffer(data, np.uint8).astype(np.int64) + 1
        return (*(int(values @ p[self.chunk - len(data) :]) % m for p, m in zip(self.powers, PRIMES)), len(data))

    @staticmethod
    def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
        """Hash of the concatenation; associative, so any bracketing gives the same."""
        shifted = ((a * pow(b, right[2], m) + c) % m for a, c, b, m in zip(left, right, BASES, PRIMES))
        return (*shifted, left[2] + right[2])

    def of(self, data: bytes) -> tuple[int, int, int]:
        total = (0, 0, 0)
        for at in range(0, len(data), self.chunk):
            total = self.combine(total, self.of_chunk(data[at : at + self.chunk]))
        return total


def normal_form(raw: bytes) -> bytes:
    return raw.translate(None, SPACES)


def fingerprints(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_text: bool = False, wanted=None) -> DataFrame:
    """(doc_id, n_chars, f1, f2, n_bytes, text_sha256[, body]) of every row of ``docs``.

    ``wanted``, a broadcast bitmap of fingerprints, leaves out rows whose fingerprint is not among them.
    """
    source = docs.select(
        "doc_id", F.length(text_or_empty()).cast("long").alias("n_chars"), text_or_empty().cast("binary").alias("raw")
    )
    schema = "doc_id long, n_chars long, f1 long, f2 long, n_bytes long, text_sha256 string"
    schema += ", body binary" if with_text else ""

    def make():
        hasher = Hasher(chunk_bytes)

        def step(batch):
            bodies = [normal_form(x) for x in batch.column(2).to_pylist()]
            hashes = [hasher.of(x) for x in bodies]
            if wanted is not None:
                marks = np.array([(h[0] << 31) | h[1] for h in hashes], np.int64)
                kept = np.flatnonzero(in_bitmap(wanted.value, marks)).tolist()
                batch, bodies, hashes = batch.take(pa.array(kept, pa.int64())), [bodies[i] for i in kept], [hashes[i] for i in kept]
            out = {"doc_id": batch.column(0), "n_chars": batch.column(1)}
            out |= {name: [h[i] for h in hashes] for i, name in enumerate(KEY)}
            return out | {"text_sha256": [hashlib.sha256(x).hexdigest() for x in bodies], "body": bodies}

        return step

    return map_batches(source, schema, make)


def _first() -> Column:
    """Orders a group's rows: most code points, then smallest id, null ids last."""
    return F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(_first()).alias("top"), F.count(F.lit(1)).alias("group_size")).select(
        *keys, F.col("top.id").alias("keep_id"), (-F.col("top.less")).alias("keep_chars"), "group_size"
    )


def differing(docs: DataFrame, profile: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(f1, f2, n_bytes, text_sha256) whose text is not that of the row its fingerprint group keeps.

    Only texts of groups with several rows travel: a bitmap of the shared fingerprints, of
    2**FILTER_BITS bits at most, drops the others in the pass that reads them. A bitmap that
    is too full lets more texts travel and changes nothing else. The kept row's chunks are
    stored once per group; a hot group's members are a skewed join side that Spark splits.
    """
    shared = _groups(profile, KEY).filter("group_size > 1").withColumnsRenamed({k: f"g_{k}" for k in KEY})
    # Stored, so that the texts' side is a plain exchange which can be split at a hot group.
    shared = materialize(shared, "dedup-shared")
    marks = shared.select(F.shiftleft("g_f1", 31).bitwiseOR(F.col("g_f2")).alias("h"))
    bits = bitmap(marks, shared.count(), FILTER_BITS)
    wanted = docs.sparkSession.sparkContext.broadcast(np.zeros(8, np.uint8) if bits is None else bits)
    texts = fingerprints(docs, chunk_bytes, with_text=True, wanted=wanted)
    members = texts.join(shared, [F.col(k) == F.col(f"g_{k}") for k in KEY])
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(chunk_bytes).cast("long"))
    chunks = members.select(
        *KEY, "text_sha256", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).alias("stays"),
        "body", F.explode(starts).alias("at"),
    ).select(*KEY, "text_sha256", "stays", "at", F.col("body").substr(F.col("at").cast("int") + 1, F.lit(chunk_bytes)).alias("chunk"))
    chunks = materialize(chunks, "dedup-chunks")
    kept = materialize(
        chunks.filter("stays").groupBy(*KEY, "at").agg(F.min("chunk").alias("kept_chunk")), "dedup-kept-chunks"
    )
    pairs = chunks.join(kept, [*KEY, "at"])
    return pairs.filter(F.col("chunk") != F.col("kept_chunk")).select(*KEY, "text_sha256").distinct()


def exact_groups(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, keep_id, group_size, kept, text_sha256."""
    profile = materialize(fingerprints(docs, chunk_bytes), "dedup-profile")
    odd = materialize(differing(docs, profile, chunk_bytes), "dedup-differing")
    keys = [*KEY, "variant"]
    # A fingerprint shared by different texts splits its group; such texts group by their digest.
    rows = profile.join(odd.withColumn("variant", F.col("text_sha256")), [*KEY, "text_sha256"], "left").withColumn(
        "variant", F.coalesce("variant", F.lit(""))
    )
    rows = materialize(
        rows.groupBy(*keys, "text_sha256", "n_chars", "doc_id").agg(F.count(F.lit(1)).alias("times")), "dedup-rows"
    )
    weighted = rows.groupBy(*keys).agg(F.min(_first()).alias("top"), F.sum("times").alias("group_size")).select(
        *keys, F.col("top.id").alias("keep_id"), (-F.col("top.less")).alias("keep_chars"), "group_size"
    )
    # Stored, so that both join sides are plain exchanges and a hot group can be split.
    groups = materialize(weighted, "dedup-groups")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")) & (F.col("copy") == 1)
    return rows.join(groups, keys).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(
        "doc_id", "n_chars", "keep_id", "group_size", stays.alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns unchanged."""
    kept = exact_groups(docs).filter("kept").select(
        F.col("doc_id").alias("_keep_id"), F.col("n_chars").alias("_keep_chars"), F.col("text_sha256").alias("_keep_sha")
    )
    digest = F.sha2(F.translate(text_or_empty(), SPACES.decode(), ""), 256)
    same = (
        F.col("doc_id").eqNullSafe(F.col("_keep_id"))
        & (F.length(text_or_empty()) == F.col("_keep_chars"))
        & (F.col("_digest") == F.col("_keep_sha"))
    )
    found = docs.withColumn("_digest", digest).join(kept, same)
    # Repeated rows with one id and one text: exactly one of them is returned.
    return found.dropDuplicates(["_digest", "doc_id", "_keep_chars"]).select(*docs.columns)

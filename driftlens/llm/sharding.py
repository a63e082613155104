"""Shards of near-equal bytes from sampled splitters.

Records are ordered by (hash of the text, hash of the id), so equal texts are neighbours
and yet every record has a key of its own. A size-weighted sample of keys gives quantile
boundaries of many fine ranges; a range that turns out overfull gets further boundaries
from a second sample of its own records, which also splits one text that holds a third of
all rows. Fine ranges are the unit of the shuffle. Exact range totals then give every
record its offset in the global order, and a shard is an equal stretch of bytes.

Defined cases: a null text counts 16 bytes, as the empty text; a null id sorts by its own
hash; repeated rows each get a slot; an empty table gives an empty result; a record larger
than a shard stays whole; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from driftlens.llm.common import materialize, text_or_empty

SHARDS = 40
OVERHEAD = 16
RANGES_PER_SHARD = 16
#: Fine ranges grow with the rows up to this many; the driver holds about OVERSAMPLE keys of 16 bytes for each.
ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 1 << 16
OVERSAMPLE = 16


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.col("doc_id"), F.lit(7)).alias("k2"),
    )


def sample_keys(rows: DataFrame, n: int) -> np.ndarray:
    """About ``n`` keys, each drawn with a chance in proportion to its size, sorted.

    A record is drawn when an exponential arrival with rate ``size`` comes before the time at
    which ``n`` are due. The arrival is a function of the key, so reruns draw the same, and
    only drawn keys leave their tasks.
    """
    total = rows.agg(F.sum("size")).first()[0] or 1
    uniform = (F.shiftrightunsigned(F.xxhash64("k1", "k2", F.lit(23)), 11) + 0.5) / F.lit(float(1 << 53))
    drawn = rows.filter(-F.log(uniform) / F.col("size") <= n / total).select("k1", "k2").collect()
    return np.sort(_bytes(np.array([r.k1 for r in drawn], np.int64), np.array([r.k2 for r in drawn], np.int64)))


def _bytes(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Keys as 16 bytes whose order is that of the two numbers taken without sign."""
    pairs = np.stack([k1, k2], axis=1).astype(">i8")
    return np.ascontiguousarray(pairs).view("S16").ravel()


def range_of(bounds: np.ndarray):
    @F.pandas_udf("int")
    def find(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, _bytes(k1.to_numpy(), k2.to_numpy()), side="right").astype("int32"))

    return find("k1", "k2")


def _quantiles(keys: np.ndarray, parts: int) -> np.ndarray:
    if len(keys) == 0 or parts < 2:
        return keys[:0]
    return np.unique(keys[[min(len(keys) - 1, len(keys) * i // parts) for i in range(1, parts)]])


def splitters(rows: DataFrame, n_ranges: int) -> np.ndarray:
    """Boundaries of fine ranges, overfull ones subdivided."""
    bounds = _quantiles(sample_keys(rows, n_ranges * OVERSAMPLE), n_ranges)
    filled = rows.withColumn("range", range_of(bounds))
    loads = {r["range"]: r.bytes for r in filled.groupBy("range").agg(F.sum("size").alias("bytes")).collect()}
    share = sum(loads.values()) / n_ranges
    full = {k: math.ceil(v / share) for k, v in loads.items() if v > 2 * share}
    if not full:
        return bounds
    within = filled.filter(F.col("range").isin(list(full)))
    keys = sample_keys(within, sum(full.values()) * OVERSAMPLE)
    owner = np.searchsorted(bounds, keys, side="right")
    more = [_quantiles(keys[owner == k], parts) for k, parts in full.items()]
    return np.unique(np.concatenate([bounds, *more]))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, key_range of every row of ``docs``."""
    rows = materialize(_keyed(docs), "shard-keys")
    n = rows.count()
    n_ranges = min(MAX_RANGES, max(shards * RANGES_PER_SHARD, n // ROWS_PER_RANGE))
    placed = rows.withColumn("key_range", range_of(splitters(rows, n_ranges)))
    placed = materialize(placed, "shard-ranges")
    # At most twice MAX_RANGES rows: a running sum in one task and a broadcast are bounded by that.
    before = Window.orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("key_range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).select(
        "key_range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    order = Window.partitionBy("key_range").orderBy("k1", "k2", "doc_id", "size")
    running = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("bytes_before") + running - F.col("size") / 2
    positioned = placed.join(F.broadcast(starts), "key_range").select(
        "doc_id", "size", "text_crc32", "key_range",
        F.least(F.lit(shards - 1), F.floor(middle * shards / F.col("total")).cast("int")).alias("shard"),
        (F.col("rows_before") + F.row_number().over(order) - 1).alias("position"),
    )
    positioned = materialize(positioned, "shard-positions")
    first = positioned.groupBy("shard").agg(F.min("position").alias("first"))
    return positioned.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot"), "key_range"
    )

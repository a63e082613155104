"""What several operators share: table access, word rules, scratch tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftlens.session import materialize, scratch_dir

__all__ = ["materialize", "scratch_dir", "documents", "text_or_empty", "map_batches", "windows", "word_blocks", "bitmap", "in_bitmap", "SPACES", "JAVA_SPACES"]

#: White space of the word rules, as bytes and inside a Java or DuckDB character class.
SPACES = b" \t\n\x0b\x0c\r"
STEP_ROWS = 512
JAVA_SPACES = r"[\x20\x09-\x0D]"
#: Bytes of a text that are cut into words at once.
WINDOW_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def windows(raw: bytes, size: int = WINDOW_BYTES) -> Iterator[bytes]:
    """Pieces of a text that end before white space, so that no word is cut."""
    at = 0
    while at < len(raw):
        space = _SPACE.search(raw, at + size)
        end = space.start() if space else len(raw)
        yield raw[at:end]
        at = end


def word_blocks(raw: bytes, size: int = WINDOW_BYTES) -> Iterator[list[bytes]]:
    """A text's words in order, in lists; only A-Z are lower-cased."""
    for piece in windows(raw, size):
        if words := piece.lower().split():
            yield words


def bitmap(hashes: DataFrame, n: int, most_bits: int) -> np.ndarray | None:
    """Bits of ``n`` hashes (column h, any longs): 16 or more for each, up to 2**most_bits in all."""
    if not n:
        return None
    width = min(most_bits, max(10, (16 * n).bit_length()))
    at = F.col("h").bitwiseAND((1 << width) - 1)
    words = hashes.select(F.shiftright(at, 5).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int")).alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (width - 5), "<u4")
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (signed longs) may be among those of the bitmap; never false for one that is."""
    at = hashes & (len(bits) * 8 - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def map_batches(
    df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list] | None]]
) -> DataFrame:
    """``mapInArrow`` over column dictionaries.

    ``make`` runs once per task and returns the function applied to slices of STEP_ROWS rows,
    which bounds what one step holds besides the batch itself.
    """
    arrow_schema = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                out = step(batch.slice(at, STEP_ROWS))
                if out is not None:
                    yield pa.RecordBatch.from_arrays(
                        [_column(out[f.name], f.type) for f in arrow_schema], schema=arrow_schema
                    )

    return df.mapInArrow(run, schema)


def _column(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))

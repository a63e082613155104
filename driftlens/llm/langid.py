"""Language identification by compression.

For each language, text of labelled rows becomes a raw-content zstandard dictionary. A text
is packed with every dictionary; the language whose dictionary packs it smallest wins. Long
texts are packed in windows that together cover all of it, so that late windows still lean
on the dictionary and not on earlier text. The margin to the runner-up is the score; below
``MIN_MARGIN`` the prediction counts as rejected.

Fitting bound: PIECES_PER_LANGUAGE rows of a language, one piece of PIECE_CHARS characters
each, are held on the driver; the rows are those with the smallest hash of id and text.

Defined cases: a text that is null or has no letter is ``und`` with score 0; ties go to the
language that sorts first and have score 0; with one learned language every score is 1, with
none everything is ``und``; repeated rows give repeated rows; an empty table gives an empty
result. Labels are read only to learn; a prediction sees the text alone.
"""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftlens.llm.common import map_batches

PIECES_PER_LANGUAGE = 384
PIECE_CHARS = 512
WINDOW_BYTES = 4096
LEVEL = 6
SHORT_BYTES = 512
#: Short texts show small differences; a slower level finds shorter matches.
SHORT_LEVEL = 19
MIN_MARGIN = 0.01
NOT_LETTERS = re.compile(r"[\W\d_]+")


def held_out(parts: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % parts == rest


def letters_of(text: str) -> str:
    """Lower-case words without digits, marks and punctuation, one blank between them."""
    return NOT_LETTERS.sub(" ", text.lower()).strip()


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary content per language from a bounded sample of labelled rows."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("doc_id", "text").alias("draw")
    )
    # The smallest draws of each language, by a rate that lets about twice as many through: a
    # hot language sends no more rows to the ranking than any other.
    rates = {r.lang: 2 * PIECES_PER_LANGUAGE / r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not rates:
        return {}
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col("lang")]
    share = F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53))
    order = Window.partitionBy("lang").orderBy("draw", "text")
    drawn = rows.filter(share <= rate).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= PIECES_PER_LANGUAGE)
    start = F.greatest(F.lit(1), F.floor((F.length("text") - PIECE_CHARS) / 2)).cast("int")
    pieces: dict[str, list[str]] = {}
    for row in drawn.select("lang", "n", F.col("text").substr(start, F.lit(PIECE_CHARS)).alias("piece")).orderBy("lang", "n").collect():
        pieces.setdefault(row.lang, []).append(letters_of(row.piece))
    return {lang: " ".join(parts).encode() for lang, parts in sorted(pieces.items())}


class Classifier:
    def __init__(self, contents: dict[str, bytes]):
        self.langs = list(contents)
        self.packers = {
            level: [self._packer(data, level) for data in contents.values()] for level in (LEVEL, SHORT_LEVEL)
        }

    @staticmethod
    def _packer(data: bytes, level: int) -> zstandard.ZstdCompressor:
        dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=level)
        return zstandard.ZstdCompressor(
            level=level, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False
        )

    def sizes(self, letters: str) -> list[int]:
        data = b" " + letters.encode() + b" "
        packers = self.packers[SHORT_LEVEL if len(data) <= SHORT_BYTES else LEVEL]
        windows = [data[at : at + WINDOW_BYTES] for at in range(0, len(data), WINDOW_BYTES)]
        return [sum(len(p.compress(w)) for w in windows) for p in packers]

    def predict(self, text: str | None) -> tuple[str, float]:
        letters = letters_of(text) if text else ""
        if not self.langs or not any(c.isalpha() for c in letters):
            return "und", 0.0
        ranked = sorted(zip(self.sizes(letters), self.langs))
        if len(ranked) == 1:
            return ranked[0][1], 1.0
        return ranked[0][1], 1.0 - ranked[0][0] / ranked[1][0]


def predict(docs: DataFrame, contents: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, accepted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(contents)  # bounded by the fitting bound
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def make():
        model = Classifier(shared.value)

        def step(batch):
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            return {
                "doc_id": batch.column(0), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found],
                "accepted": [f[1] >= MIN_MARGIN for f in found],
            }

        return step

    return map_batches(source, "doc_id long, lang_pred string, score double, accepted boolean", make)

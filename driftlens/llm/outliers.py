"""Quality rules: robust multivariate outliers among text statistics.

Every document gives a vector of transformed statistics. For each language and source the
minimum-covariance-determinant estimate is found by concentration steps over all documents:
distances are counted in logarithmic bins together with the sums that mean and covariance
need, the innermost bins that hold the wanted share give the next estimate. A step is one
combined aggregate, so a source with a third of all rows costs one task nothing special. Two
starts (medians with absolute deviations; plain moments) run side by side and the smaller
determinant wins. Distances are scaled down to the chi-squared median where the innermost share made
them too large, and documents beyond that distribution's far tail are rejected.

Cells of fewer than MIN_CELL documents pool by language, then with all that is left; a pool
still smaller rejects nothing.

Defined cases: a null text has no words and fails the base rule; null language or source is
a value of its own; ties and repeated rows get equal verdicts; constant statistics are held
apart from zero spread by FLOORS; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftlens.llm.common import SPACES, map_batches, materialize

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CELL = 100
SUBSET = 0.75
STEPS = 5
BINS_PER_DOUBLING = 16
#: Normal quantile of the cut: far beyond what clean documents reach.
CUT_Z = 5.0
FEATURES = ["x_words", "x_length", "x_symbols", "x_lines", "x_repeats"]
#: Spread below which a statistic says nothing, in the transformed units.
FLOORS = (0.6, 0.08, 0.5, 0.5, 0.13)
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in SPACES.decode())
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(SPACES.decode())]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    width = len(number)
    if width < 1 << 20:
        windows = (ids[:-2] * width + ids[1:-1]) * width + ids[2:]
        order = np.argsort(windows, kind="stable")
        equal = windows[order[1:]] == windows[order[:-1]]
        again = np.zeros(n - 2, bool)
        again[order[1:][equal]] = True
        again[order[:-1][equal]] = True
    else:
        triples = list(zip(ids[:-2], ids[1:-1], ids[2:]))
        counts = Counter(triples)
        again = np.array([counts[t] > 1 for t in triples])
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= again
    return int(inside.sum())


def statistics(docs: DataFrame) -> DataFrame:
    """Counts and transformed vector of every row of ``docs``."""
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang", "source"
    )
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in STATS)

    def make():
        def step(batch):
            found = [text_statistics(t) for t in batch.column(1).to_pylist()]
            out = {"doc_id": batch.column(0), "lang": batch.column(2), "source": batch.column(3)}
            return out | {c: [f[i] for f in found] for i, c in enumerate(STATS)}

        return step

    counted = map_batches(source, schema, make)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return counted.withColumn("base_failed", failed).withColumns({
        "x_words": F.log(words),
        "x_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "x_symbols": F.log1p(100 * F.col("n_symbols") / words),
        "x_lines": F.log1p(100 * F.col("n_dup_lines") / words),
        "x_repeats": F.asin(F.sqrt(F.col("n_repeat_words") / words)),
    })


def assign_models(rows: DataFrame) -> DataFrame:
    """``rows`` with the key of the estimate that judges them: cell, language or rest."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in ("lang", "source"))
    cell = F.concat_ws("\x1f", lang, source)
    for name, key, wider in (("cell", cell, lang), ("pool", F.col("cell"), F.lit("rest"))):
        rows = rows.withColumn(name, key)
        sizes = rows.filter(~F.col("base_failed")).groupBy(F.col(name).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
        sizes = materialize(sizes, "outlier-cells")
        small = F.coalesce(F.col("_n"), F.lit(0)) < MIN_CELL
        rows = rows.join(sizes, F.col(name) == F.col("_key"), "left").withColumn(
            "cell", F.when(small, wider).otherwise(F.col(name))
        ).drop("_key", "_n")
    return rows.withColumnRenamed("cell", "model").drop("pool")


def _distance() -> Column:
    parts = []
    for i, j in combinations_with_replacement(range(len(FEATURES)), 2):
        term = (F.col(FEATURES[i]) - F.col(f"m{i}")) * (F.col(FEATURES[j]) - F.col(f"m{j}")) * F.col(f"p{i}{j}")
        parts.append(term if i == j else 2 * term)
    return sum(parts[1:], parts[0])


def _bin() -> Column:
    return F.floor(BINS_PER_DOUBLING * F.log2(F.greatest(_distance(), F.lit(0.0)) + 1e-9)).cast("int")


PAIRS = list(combinations_with_replacement(range(len(FEATURES)), 2))
PARAMS = [f"m{i}" for i in range(len(FEATURES))] + [f"p{i}{j}" for i, j in PAIRS]
SUMS = ["n"] + [f"s{i}" for i in range(len(FEATURES))] + [f"q{i}{j}" for i, j in PAIRS]


def _moments() -> list[Column]:
    x = [F.col(c) for c in FEATURES]
    return (
        [F.count(F.lit(1)).alias("n")]
        + [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)]
        + [F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i, j in PAIRS]
    )


def _estimates(sums: DataFrame) -> DataFrame:
    """Mean, inverse covariance and log determinant from sums, one row per estimate."""

    def solve(frames):
        for frame in frames:
            out = frame[["model", "start"]].copy()
            n = frame["n"].to_numpy(float)
            mean = np.stack([frame[f"s{i}"].to_numpy(float) / n for i in range(len(FEATURES))], axis=1)
            cov = np.zeros((len(frame), len(FEATURES), len(FEATURES)))
            for i, j in PAIRS:
                cov[:, i, j] = cov[:, j, i] = frame[f"q{i}{j}"].to_numpy(float) / n - mean[:, i] * mean[:, j]
            cov += np.diag(np.square(FLOORS))
            inverse = np.linalg.inv(cov) if len(frame) else cov
            for i in range(len(FEATURES)):
                out[f"m{i}"] = mean[:, i]
            for i, j in PAIRS:
                out[f"p{i}{j}"] = inverse[:, i, j]
            out["log_det"] = np.linalg.slogdet(cov)[1] if len(frame) else []
            yield out

    schema = "model string, start string, " + ", ".join(f"{p} double" for p in PARAMS) + ", log_det double"
    return materialize(sums.select("model", "start", *SUMS).mapInPandas(solve, schema), "outlier-estimates")


def _starts(rows: DataFrame) -> DataFrame:
    """Two first estimates per model: plain moments; medians with absolute deviations."""
    plain = rows.groupBy("model").agg(*_moments()).withColumn("start", F.lit("moments"))
    middle = materialize(
        rows.groupBy("model").agg(*[F.percentile_approx(c, 0.5, 2000).alias(f"c{i}") for i, c in enumerate(FEATURES)]),
        "outlier-medians",
    )
    apart = rows.join(middle, "model").groupBy("model").agg(
        *[F.first(f"c{i}").alias(f"c{i}") for i in range(len(FEATURES))],
        *[F.percentile_approx(F.abs(F.col(c) - F.col(f"c{i}")), 0.5, 2000).alias(f"d{i}") for i, c in enumerate(FEATURES)],
    )
    # As sums of a sample of one with that mean and, through q, that variance.
    robust = apart.select(
        "model", F.lit("medians").alias("start"), F.lit(1).cast("long").alias("n"),
        *[F.col(f"c{i}").alias(f"s{i}") for i in range(len(FEATURES))],
        *[
            (F.col(f"c{i}") * F.col(f"c{j}") + (F.pow(1.4826 * F.col(f"d{i}"), 2) if i == j else F.lit(0.0))).alias(f"q{i}{j}")
            for i, j in PAIRS
        ],
    )
    return plain.select("model", "start", *SUMS).unionByName(robust)


def robust_estimates(rows: DataFrame) -> DataFrame:
    """model, parameters and the distance of its median document; ``rows`` passed the base rule."""
    estimates = _estimates(_starts(rows))
    size = Window.partitionBy("model", "start")
    inner = size.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(STEPS):
        binned = rows.join(estimates, "model").withColumn("bin", _bin()).groupBy("model", "start", "bin").agg(*_moments())
        below, total = F.coalesce(F.sum("n").over(inner), F.lit(0)), F.sum("n").over(size)
        chosen = binned.withColumn("below", below).withColumn("total", total).filter(F.col("below") < SUBSET * F.col("total"))
        estimates = _estimates(chosen.groupBy("model", "start").agg(*[F.sum(c).alias(c) for c in SUMS]))
    best = Window.partitionBy("model").orderBy("log_det", "start")
    winners = materialize(
        estimates.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r", "start", "log_det"), "outlier-winners"
    )
    spread = rows.join(winners, "model").withColumn("bin", _bin()).groupBy("model", "bin").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("model").orderBy("bin")
    middle = spread.withColumn("upto", F.sum("n").over(along)).withColumn("total", F.sum("n").over(Window.partitionBy("model")))
    middle = middle.filter(2 * F.col("upto") >= F.col("total")).groupBy("model").agg(
        F.min("bin").alias("bin"), F.first("total").alias("n")
    ).select("model", F.pow(F.lit(2.0), (F.col("bin") + 0.5) / BINS_PER_DOUBLING).alias("middle"), "n")
    return materialize(winners.join(middle, "model"), "outlier-models")


def chi_squared(z: float, p: int = len(FEATURES)) -> float:
    """Chi-squared quantile at the normal quantile ``z`` (cube-root approximation)."""
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def judge(docs: DataFrame) -> DataFrame:
    """Statistics, base rule, scaled distance and verdict of every row of ``docs``."""
    rows = materialize(statistics(docs), "outlier-statistics")
    rows = materialize(assign_models(rows), "outlier-rows")
    models = robust_estimates(rows.filter("not base_failed"))
    # Only ever down: where FLOORS rule, distances are small because nothing is far.
    scaled = _distance() * F.least(F.lit(1.0), chi_squared(0.0) / F.greatest(F.col("middle"), F.lit(1e-6)))
    judged = rows.join(models, "model", "left").withColumn("distance", scaled)
    far = (F.col("distance") > chi_squared(CUT_Z)) & (F.col("n") >= MIN_CELL)
    kept = ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))
    return judged.select("doc_id", *STATS, "base_failed", kept.alias("kept"), "distance", "model")

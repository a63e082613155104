"""The operators applied to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from driftlens.llm import bpe, collocations, divergence, fingerprints, langid, mixing, outliers, prefix_join, sharding, simhash, style_tree, token_files, toxicity
from driftlens.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    return sharding.shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "key_range",
    )


@query
def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return style_tree.extract(documents(spark, sf_dir, "pages"))


@query
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of its links."""
    return prefix_join.link_components(documents(spark, sf_dir))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.taken_words(documents(spark, sf_dir))


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe.encode_documents(documents(spark, sf_dir), with_ids=False)


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from rows that are not held out."""
    docs = documents(spark, sf_dir)
    held = docs.filter(~langid.held_out())
    predicted = langid.predict(docs, langid.learn(held))
    return predicted.withColumn("held_out", langid.held_out()).select("doc_id", "held_out", "lang_pred", "score", "accepted")


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it stands in the token files."""
    return token_files.round_trip(documents(spark, sf_dir))


@query
def op8_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every document's statistics."""
    return outliers.judge(documents(spark, sf_dir)).select("doc_id", *outliers.STATS, "base_failed", "kept", "distance")


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of its group that stays."""
    return fingerprints.exact_groups(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learned from labels that are not held out."""
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    params = toxicity.learn(docs.filter(~toxicity.held_out()), labels.filter(~toxicity.held_out()))
    scored = toxicity.score(docs, params)
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and the terms that set a source apart."""
    return divergence.audit(documents(spark, sf_dir))


@query
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the component of its links."""
    return simhash.link_components(documents(spark, sf_dir))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language."""
    return collocations.collocations(documents(spark, sf_dir))


ORACLES["op9_exact_dedup"] = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
kept AS (
  SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size FROM bare)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM kept"""

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op11_source_divergence"] = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({LOWER_SQL}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
kept AS MATERIALIZED (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 10),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) JOIN kept USING (lang, term)
  GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
total AS MATERIALIZED (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS MATERIALIZED (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p
  FROM total JOIN size USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS MATERIALIZED (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(t.total) + 2 * any_value(v)) AS q
  FROM p JOIN size USING (lang) JOIN (SELECT lang, sum(total) AS total FROM total GROUP BY lang) t USING (lang) GROUP BY lang, term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
single AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' AS part FROM single))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""

ORACLES["op13_collocations"] = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER_SQL}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
  FROM lists, (SELECT unnest(range(1, 6)) AS k) WHERE len(words) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND a >= 100),
covers AS MATERIALIZED (
  SELECT lang, k - 1 AS k, array_to_string(words[1:k - 1], ' ') AS phrase, a AS longer FROM candidates
  UNION ALL SELECT lang, k - 1, array_to_string(words[2:k], ' '), a FROM candidates),
longest AS (SELECT lang, phrase, max(longer) AS longer FROM covers GROUP BY lang, phrase),
open AS MATERIALIZED (
  SELECT c.* FROM candidates c LEFT JOIN longest o ON o.lang = c.lang AND o.phrase = c.phrase
  WHERE o.longer IS NULL OR 100 * o.longer < 100 * c.a),
parts AS MATERIALIZED (
  SELECT lang, phrase, a, j, array_to_string(words[1:j], ' ') AS first, array_to_string(words[j + 1:k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS j FROM open)),
cuts AS (
  SELECT o.lang, o.phrase, o.a, n.n, o.j, l.a AS l, r.a AS r, (1000::HUGEINT * o.a * n.n) // (l.a::HUGEINT * r.a) AS score
  FROM parts o JOIN n ON n.lang = o.lang
  JOIN f l ON l.lang = o.lang AND l.phrase = o.first JOIN f r ON r.lang = o.lang AND r.phrase = o.rest),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000"""

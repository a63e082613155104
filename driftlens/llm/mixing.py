"""Mixing sources to target weights, with DataFrame functions only.

Every source's documents form one stream of words, cut into blocks of a fixed length. A
source's target becomes a quota of block draws. Each quota is dealt over the output shards
as one multinomial draw, one trial for each unit, so a shard's source counts are random while
the totals are the quotas. A shard has as many slots of a source as it drew; its slots follow
those of the shards before it in the source's order. A slot's number there is mapped to a
block by the source's pseudorandom index permutation (a new one for every pass over the
source) and joined with the blocks by index.

Streams are laid out in two levels: hash buckets, as many as the square root of the rows,
hold the running sums, and bucket totals give the offsets. No task sees a whole source.

Defined cases: a null text has no words; a document without words is never taken; a null
source is a source of its own and comes last; repeated rows are laid out one after the
other; rows without an id, or with one id and different texts, are documents of their own; an empty table gives an empty result; sources without words have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftlens.llm.common import JAVA_SPACES, SPACES, materialize

BLOCK_WORDS = 128
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
BLOCKS_PER_SHARD = 4096
#: Trials that one row is unfolded into at a time, and shards whose slots are numbered in one task.
DRAWS_PER_PIECE = 4096
SHARDS_PER_RUN = 1024
SEED = 20_11
#: Digest of a row, of which no column is left out.
ROW = "_row"
#: Prime multipliers of the index permutations; one that divides no block count is always found.
MULTIPLIERS = (1_000_000_007, 1_000_000_009, 998_244_353, 754_974_721, 469_762_049)


def word_count(column: str = "text") -> Column:
    bare = F.btrim(F.col(column), F.lit(SPACES.decode()))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, JAVA_SPACES + "+"))).otherwise(0).cast("long")


def source_targets(rows: DataFrame) -> DataFrame:
    """One row per source: src (code point order), source_size, target, blocks, quota.

    Level filling: sources in the order in which they reach their cap; the level is the
    largest share per weight that the words left over allow.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    named = sums.withColumn(
        "src", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).cast("long") - 1
    ).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("src") % len(WEIGHTS) + 1).cast("int")))
    cap = F.col("source_size") * MAX_REPEATS
    by_cap = Window.orderBy(cap / F.col("weight"), "src")
    capped = F.coalesce(F.sum(cap).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    levelled = named.withColumn("total", F.sum("source_size").over(everything)).withColumn(
        "at_level", (F.col("total") - capped) / open_weight
    )
    targets = levelled.withColumn(
        "target", F.least(cap.cast("double"), F.col("weight") * F.max("at_level").over(everything))
    )
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS)
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0)
    return targets.select("source", "src", "source_size", "target", blocks.alias("blocks"), quota.cast("long").alias("quota"))


def layout(docs: DataFrame, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source's stream, and the sources.

    ``carry`` names further columns to keep. A row with words is identified by (src, start).
    """
    # Rows without an id are spread by their text.
    place = F.when(F.col("doc_id").isNull(), F.xxhash64("text", "source", F.lit(SEED))).otherwise(F.xxhash64("doc_id", "source", F.lit(SEED)))
    stored = materialize(docs.select("source", word_count().alias("size"), place.alias("place"), *carry), "mix-rows")
    sources = materialize(source_targets(stored), "mix-sources")
    buckets = max(1, int(stored.count() ** 0.5))
    rows = stored.join(
        sources.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source"))
    ).withColumn("bucket", F.pmod(F.col("place"), F.lit(buckets)))
    along = Window.partitionBy("src", "bucket").orderBy("place", *[c for c in carry if c in ("doc_id", ROW)], "size")
    inside = rows.withColumn("upto", F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    offsets = materialize(sums.select(
        F.col("src").alias("o_src"), F.col("bucket").alias("o_bucket"),
        (F.sum("words").over(Window.partitionBy("src").orderBy("bucket")) - F.col("words")).alias("offset"),
    ), "mix-offsets")
    placed = inside.join(offsets, (F.col("src") == F.col("o_src")) & (F.col("bucket") == F.col("o_bucket"))).select(
        "source", "src", "size", "source_size", "target",
        (F.col("offset") + F.col("upto") - F.col("size")).alias("start"), *carry,
    )
    return materialize(placed, "mix-layout"), sources


def permuted(draw: Column, blocks: Column, src: Column) -> Column:
    """Block of a source's draw: pass ``draw / blocks`` is an index permutation of its own.

    ``a * i + b mod blocks`` is one when ``a`` shares no factor with ``blocks``; ``a`` is a
    prime that does not divide it, chosen by a hash of source and pass.
    """
    turn, at = F.floor(draw / blocks), draw % blocks
    first = F.pmod(F.xxhash64(src, turn, F.lit(SEED)), F.lit(len(MULTIPLIERS)))
    # ``blocks`` below 10**9 * 10**9 has at most two of these primes as factors.
    primes = F.array(*map(F.lit, MULTIPLIERS + MULTIPLIERS[:2]))
    tries = [F.element_at(primes, (first + k + 1).cast("int")) for k in range(3)]
    multiplier = F.when(blocks % tries[0] != 0, tries[0]).when(blocks % tries[1] != 0, tries[1]).otherwise(tries[2])
    shift = F.pmod(F.xxhash64(src, turn, F.lit(SEED + 1)), blocks)
    product = (multiplier % blocks).cast("decimal(19,0)") * at.cast("decimal(19,0)") + shift.cast("decimal(19,0)")
    return (product % blocks.cast("decimal(19,0)")).cast("long")


def shard_counts(sources: DataFrame, per_shard: int = BLOCKS_PER_SHARD) -> DataFrame:
    """The multinomial draws: shard, src, n, and ``ahead``, the source's slots in the shards before."""
    spark = sources.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = sources.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, -(-total // per_shard))

    def unfold(rows: DataFrame, of: str, to: str, reach: int, step: int) -> DataFrame:
        last = F.least(F.col("quota"), F.col(of) + reach) - 1
        return rows.withColumn(to, F.explode(F.sequence(F.col(of), last, F.lit(step).cast("long"))))

    # In three levels, so that no row unfolds into more than a bounded array.
    wide = sources.filter("quota > 0").select(
        "src", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1, F.lit(DRAWS_PER_PIECE**2).cast("long"))).alias("part")
    )
    pieces = unfold(wide.repartition(width, "src", "part"), "part", "piece", DRAWS_PER_PIECE**2, DRAWS_PER_PIECE)
    trials = unfold(pieces.repartition(width, "src", "piece"), "piece", "trial", DRAWS_PER_PIECE, 1)
    shard = F.pmod(F.xxhash64("src", "trial", F.lit(SEED + 2)), F.lit(shards))
    counts = trials.groupBy("src", shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.withColumn("run", F.floor(F.col("shard") / SHARDS_PER_RUN)), "mix-shard-counts")
    within = Window.partitionBy("src", "run").orderBy("shard")
    runs = counts.groupBy(F.col("src").alias("r_src"), F.col("run").alias("r_run")).agg(F.sum("n").alias("all_n"))
    runs = runs.withColumn("before", F.sum("all_n").over(Window.partitionBy("r_src").orderBy("r_run")) - F.col("all_n"))
    numbered = counts.withColumn("inside", F.sum("n").over(within) - F.col("n"))
    return numbered.join(runs, (F.col("src") == F.col("r_src")) & (F.col("run") == F.col("r_run"))).select(
        "shard", "src", "n", (F.col("before") + F.col("inside")).alias("ahead")
    )


def slots(sources: DataFrame, per_shard: int = BLOCKS_PER_SHARD) -> DataFrame:
    """One row per slot of an output shard: shard, src, slot, turn, block, slot_key (its place in the shard)."""
    width = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = shard_counts(sources, per_shard).join(sources.select(F.col("src").alias("s_src"), "blocks"), F.col("src") == F.col("s_src"))
    each = drawn.repartition(width, "shard", "src").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    draw = F.col("ahead") + F.col("slot")
    out = each.select(
        "shard", "src", "slot", F.floor(draw / F.col("blocks")).alias("turn"), permuted(draw, F.col("blocks"), F.col("src")).alias("block"),
        F.xxhash64("shard", "src", "slot", F.lit(SEED + 3)).alias("slot_key"),
    )
    # Stored, as Catalyst would take slots made from a few sources for a few rows and broadcast them.
    return materialize(out, "mix-slots")


def block_spans(placed: DataFrame) -> DataFrame:
    """One row per document and block that it reaches into: src, block, start, word_from, word_to."""
    first, last = F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)
    spans = placed.filter("size > 0").select("src", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    return spans.select(
        "src", "block", "start",
        F.greatest(F.col("block") * BLOCK_WORDS - F.col("start"), F.lit(0)).alias("word_from"),
        F.least((F.col("block") + 1) * BLOCK_WORDS - F.col("start"), F.col("size")).alias("word_to"),
    )


def mixed_spans(placed: DataFrame, slotted: DataFrame) -> DataFrame:
    """The mixture: every slot with the stretches of words that its block holds."""
    return slotted.join(block_spans(placed), ["src", "block"])


def taken_words(docs: DataFrame, per_shard: int = BLOCKS_PER_SHARD) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_shards (output shards with words of it) of every row of ``docs``."""
    placed, sources = layout(docs, ["doc_id"])
    words = F.sum(F.col("word_to") - F.col("word_from"))
    by_shard = mixed_spans(placed, slots(sources, per_shard)).groupBy("src", "start", "shard").agg(words.alias("words"))
    taken = by_shard.groupBy(F.col("src").alias("t_src"), F.col("start").alias("t_start")).agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("in_shards"))
    same = (F.col("src") == F.col("t_src")) & (F.col("start") == F.col("t_start")) & (F.col("size") > 0)
    return placed.join(taken, same, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).alias("taken"), F.coalesce("in_shards", F.lit(0)).alias("n_shards")
    )


def mixed_blocks(docs: DataFrame, per_shard: int = BLOCKS_PER_SHARD) -> DataFrame:
    """The output shards themselves: shard, slot_key, doc_id, source, text, one row per slot and document in its block.

    Sorted by ``slot_key``, a shard's rows are its text in mixed order.
    """
    keyed_docs = docs.select("doc_id", "source", "text", _row_digest(docs).alias(ROW))
    placed, sources = layout(keyed_docs, ["doc_id", ROW])
    spans = mixed_spans(placed, slots(sources, per_shard)).groupBy("src", "start").agg(
        F.collect_list(F.struct("shard", "slot_key", "word_from", "word_to")).alias("spans")
    )
    drawn = placed.filter("size > 0").select(ROW, "src", "start").join(spans, ["src", "start"]).select(ROW, "spans")
    texts = keyed_docs.dropDuplicates([ROW]).join(drawn, ROW)
    split = texts.select("doc_id", "source", "spans", F.split(F.btrim(F.col("text"), F.lit(SPACES.decode())), JAVA_SPACES + "+").alias("words"))
    pieces = F.transform("spans", lambda s: F.struct(
        s["shard"].alias("shard"), s["slot_key"].alias("slot_key"),
        F.array_join(F.slice("words", s["word_from"].cast("int") + 1, (s["word_to"] - s["word_from"]).cast("int")), " ").alias("text"),
    ))
    return split.select("doc_id", "source", F.inline(pieces)).select("shard", "slot_key", "doc_id", "source", "text")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixture as documents: for each document and pass, the words drawn from it.

    A document drawn whole keeps its text as it is; of one drawn in part the row holds the
    drawn words in their order. ``n_chars``, if there, follows the text.
    """
    keyed_docs = docs.withColumn(ROW, _row_digest(docs))
    placed, sources = layout(keyed_docs, ["doc_id", ROW])
    drawn = mixed_spans(placed, slots(sources)).groupBy("src", "start", "turn").agg(
        F.array_sort(F.collect_list(F.struct("word_from", "word_to"))).alias("spans"),
        F.sum(F.col("word_to") - F.col("word_from")).alias("words"),
    )
    keyed = placed.filter("size > 0").select(ROW, "src", "start").join(drawn, ["src", "start"]).select(
        F.col(ROW).alias("_drawn_row"), F.col("spans").alias("_spans"), F.col("words").alias("_taken")
    )
    # Rows that are equal in every column: each drawn one meets one stored row.
    texts = keyed_docs.dropDuplicates([ROW]) if _has_repeats(placed) else keyed_docs
    same = F.col(ROW) == F.col("_drawn_row")
    # Named once and used twice, so that it is split once per row and not once per span.
    split = texts.join(keyed, same).withColumn("_words", F.split(F.btrim(F.col("text"), F.lit(SPACES.decode())), JAVA_SPACES + "+"))
    cut = F.array_join(
        F.flatten(F.transform("_spans", lambda s: F.slice("_words", s["word_from"].cast("int") + 1, (s["word_to"] - s["word_from"]).cast("int")))), " "
    )
    joined = split.withColumn("text", F.when(F.col("_taken") == F.size("_words"), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast("long"))
    return joined.select(*docs.columns)


def _row_digest(docs: DataFrame) -> Column:
    cells = [F.sha2("text", 256).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return F.unhex(F.sha2(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}), 256))


def _has_repeats(placed: DataFrame) -> bool:
    return bool(placed.groupBy(ROW).count().filter("count > 1").limit(1).count())

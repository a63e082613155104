"""op1 and op4 against brute force, and their defined cases."""

import collections
import re
import zlib

import pytest
from conftest_llm import ODD, prose

from driftlens.llm import mixing, sharding


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_shards_are_near_equal_and_slots_gapless(make_docs):
    rows = [(i, prose(i, 20 + i % 50), "en", "s") for i in range(800)] + [(1000 + i, prose(3, 40), "en", "s") for i in range(400)]
    got = sharding.shard(make_docs(rows), shards=8).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    text = {r[0]: r[1] for r in rows}
    assert all(r["size"] == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    largest = max(r["size"] for r in got)
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) <= 2 * largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Equal texts are neighbours: a third of all rows may span shards, but each is a run.
    assert len({r.shard for r in got if r.doc_id >= 1000}) <= 1 + -(-400 * 8 // 1200)


def test_overfull_ranges_are_subdivided(make_docs):
    rows = sharding._keyed(make_docs([(i, "same text", "en", "s") for i in range(500)]))
    assert len(sharding.splitters(rows, 16)) >= 8


def test_sharding_defined_cases(odd, none):
    got = sharding.shard(odd, shards=4).collect()
    assert len(got) == len(ODD)
    assert {r["size"] for r in got if r.doc_id in (1, 2)} == {16} and {r.text_crc32 for r in got if r.doc_id in (1, 2)} == {0}
    assert sharding.shard(none).count() == 0


def targets(sizes):
    """Resharing by hand, one round after the other."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, active, total = dict.fromkeys(order, 0.0), {s for s in order}, sum(sizes.values())
    while total - sum(target.values()) > 1e-9 and active:
        excess, share = total - sum(target.values()), sum(weight[s] for s in active)
        for s in list(active):
            target[s] += excess * weight[s] / share
        for s in list(active):
            if target[s] >= 3 * sizes[s]:
                target[s] = 3.0 * sizes[s]
                active.discard(s)
    return target


def check_mix(rows, got, slack):
    sizes = collections.Counter()
    for _, text, _, source in rows:
        sizes[source] += len(words_of(text))
    want, text = targets(sizes), {r[0]: r for r in rows}
    taken = collections.Counter()
    for r in got:
        source = text[r.doc_id][3]
        assert r["size"] == len(words_of(text[r.doc_id][1])) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source]) and 0 <= r.taken <= 3 * r["size"]
        taken[source] += r.taken
    for source, n in taken.items():
        assert abs(n - want[source]) <= slack


def test_mixing_meets_targets(make_docs):
    rows = [(i, prose(i, 50 + i % 400), "en", ["a", "b", "c", "tiny", None][min(i % 17, 4)]) for i in range(600)]
    rows = [(i, t, lang, "tiny" if i == 5 else s) for i, t, lang, s in rows]
    docs = make_docs(rows)
    got = mixing.taken_words(docs).collect()
    check_mix(rows, got, 2 * mixing.BLOCK_WORDS)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.taken_words(docs.repartition(7)).collect()))


def test_mixed_documents_hold_the_taken_words(make_docs):
    rows = [(i, prose(i, 60 + i), "en", "ab"[i % 2]) for i in range(60)]
    docs = make_docs(rows)
    taken = {r.doc_id: r.taken for r in mixing.taken_words(docs).collect()}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    n = collections.Counter()
    for r in mixed.collect():
        n[r.doc_id] += len(words_of(r.text))
        assert r.n_chars == len(r.text) and r.score == 0.5
    assert {k: v for k, v in taken.items() if v} == dict(n)


def test_documents_without_an_id_or_with_a_shared_one_are_mixed_whole(make_docs):
    # One source: its target is its size, so every block is drawn once.
    rows = [(None if i < 20 else 7 if i < 30 else i, prose(i, 40 + 9 * i), "en", "a") for i in range(40)]
    rows += [rows[3], rows[25]]
    for docs in (make_docs(rows), make_docs(rows[::-1]).repartition(5)):
        got = mixing.mix_documents(docs).collect()
        assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((i or 0, t) for i, t, *_ in rows)
        assert all(r.n_chars == len(r.text) for r in got)


def test_shards_draw_multinomial_counts_and_slots_cover_the_quota(make_docs):
    rows = [(i, prose(i, 100 + i % 300), "en", ["a", "b", "c"][min(i % 6, 2)]) for i in range(500)]
    _, sources = mixing.layout(make_docs(rows), ["doc_id"])
    quota = {r.src: (r.quota, r.blocks) for r in sources.collect()}
    counts = mixing.shard_counts(sources, per_shard=64).collect()
    shards = len({r.shard for r in counts})
    assert shards == -(-sum(q for q, _ in quota.values()) // 64)
    for src, (q, blocks) in quota.items():
        mine = sorted((r.shard, r.n, r.ahead) for r in counts if r.src == src)
        assert sum(n for _, n, _ in mine) == q and len({n for _, n, _ in mine}) > 1
        assert all(ahead == sum(n for s, n, _ in mine if s < shard) for shard, _, ahead in mine)
        # Six standard deviations of a binomial count.
        assert all(abs(n - q / shards) <= 6 * (q / shards) ** 0.5 for _, n, _ in mine)
    got = mixing.slots(sources, per_shard=64).collect()
    drawn = collections.Counter((r.src, r.turn, r.block) for r in got)
    for src, (q, blocks) in quota.items():
        # Every pass draws a block once; all but the last are whole.
        assert max(drawn.values()) == 1 and sum(s == src for s, _, _ in drawn) == q
        assert all(sum((s, t) == (src, turn) for s, t, _ in drawn) == blocks for turn in range(q // blocks))
    for r in counts:
        assert sorted(x.slot for x in got if (x.shard, x.src) == (r.shard, r.src)) == list(range(r.n))


def test_mixed_blocks_hold_the_taken_words(make_docs):
    rows = [(i, prose(i, 60 + 5 * i), "en", "ab"[i % 2]) for i in range(60)] + [(3, None, "en", "a"), (4, " ", None, None)]
    docs = make_docs(rows)
    blocks = mixing.mixed_blocks(docs, per_shard=16).collect()
    n, within = collections.Counter(), collections.defaultdict(set)
    for r in blocks:
        n[r.doc_id] += len(words_of(r.text))
        within[r.doc_id].add(r.shard)
        assert r.text in " ".join(words_of(rows[r.doc_id][1])) and r.source == rows[r.doc_id][3]
    taken = [r for r in mixing.taken_words(docs, per_shard=16).collect() if r.taken]
    assert {r.doc_id: (r.taken, r.n_shards) for r in taken} == {i: (k, len(within[i])) for i, k in n.items()}
    assert max(r.n_shards for r in taken) > 1 and mixing.mixed_blocks(docs.limit(0)).count() == 0


def test_index_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for blocks in (1, 2, 97, 1000, 4096):
        df = spark.range(blocks * 2).select(mixing.permuted(F.col("id"), F.lit(blocks).cast("long"), F.lit(3)).alias("b"), (F.col("id") >= blocks).alias("turn"))
        seen = collections.defaultdict(list)
        for r in df.collect():
            seen[r.turn].append(r.b)
        assert all(sorted(v) == list(range(blocks)) for v in seen.values())


def test_mixing_defined_cases(odd, none):
    got = mixing.taken_words(odd).collect()
    assert len(got) == len(ODD)
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    assert mixing.taken_words(none).count() == 0 and mixing.mix_documents(none).count() == 0
    assert mixing.mix_documents(odd).columns == odd.columns and mixing.mix_documents(odd).count() > 0

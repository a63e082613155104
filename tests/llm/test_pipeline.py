"""The pipeline's stages on planted cases, and its rows against the operators' own results."""

import random
import re

import corpus_pipeline
import pytest
from conftest_llm import prose

import __spark_entry__ as entry_point
from driftlens.llm import prefix_join, toxicity
from driftlens.llm.common import documents

INSULTS = ["idiotik", "scumlor", "vequan"]


@pytest.fixture(scope="module")
def folder(spark, make_docs, tmp_path_factory):
    rows, labels = [], []
    for i in range(400):
        words = prose(i, 60 + i % 40).split()
        if i % 4 == 0:
            for k in range(6):
                words.insert(k * 9, INSULTS[k % 3] + ["", "s", "isch"][k % 3])
        rows.append((i, " ".join(words), "en", "ab"[i % 2]))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000 + i, prose(1, 61) + " ", "en", "a") for i in range(20)]
    rows += [(2000 + i, prose(2, 62) + f" tail{i}", "en", "b") for i in range(20)]
    rows += [(3000, None, None, None), (3001, "", "en", "a")]
    where = str(tmp_path_factory.mktemp("tables"))
    make_docs(rows).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages_act_on_what_their_predecessor_kept(spark, folder):
    docs = documents(spark, folder)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == names
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "toxicity":
            assert sum(i < 400 and i % 4 == 0 for i in ids) <= 4 and sum(i < 400 and i % 4 != 0 for i in ids) >= 297
        if name == "exact_dedup":
            assert sum(1000 <= i < 1020 for i in ids) + (1 in ids) == 1 and len({3000, 3001} & ids) == 1
        if name == "ngram_join":
            assert sum(2000 <= i < 2020 for i in ids) + (2 in ids) == 1 and 3 in ids
    taken = {}
    for r in docs.select("source", "text").collect():
        taken[r.source] = taken.get(r.source, 0) + len(re.findall(r"\S+", r.text))
    assert 1.5 < taken["b"] / taken["a"] < 2.6  # weights 1 and 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == docs.count() and last.filter("n_tokens <> size(ids)").count() == 0


def test_registered_once_for_each_number():
    names = entry_point.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "bpe"]
    assert toxicity.THRESHOLD == 0.7


def test_near_copies_are_found_among_texts_of_common_shingles(spark, make_docs, monkeypatch):
    # Every shingle is in some fifty texts; only texts that agree in a range with another are cut into shingles again.
    draw, words = random.Random(23), [f"w{i}" for i in range(12)]
    texts = [[draw.choice(words) for _ in range(300)] for _ in range(200)]
    rows = [(i, " ".join(t), "en", "ab"[i % 2]) for i, t in enumerate(texts)]
    rows += [(1000 + i, " ".join([*t[:150], "new", *t[151:]]), "en", "a") for i, t in enumerate(texts[:10])]
    reached, groups = set(), prefix_join._groups
    monkeypatch.setattr(prefix_join, "_groups", lambda postings: reached.update(r.node for r in postings.select("node").collect()) or groups(postings))
    kept = dict(corpus_pipeline.STAGES)["ngram_join"](spark, make_docs(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(200))
    assert 20 <= len(reached) < len(rows) / 3

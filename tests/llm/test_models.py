"""op6, op8 and op10: held-out accuracy, gradients, brute force, and their defined cases."""

import collections
import random
import re

import numpy as np
import pandas as pd
import pytest
from conftest_llm import ODD, prose

from driftlens.llm import langid, outliers, toxicity as tx

SYLLABLES = {"en": "the and tion ing re er at of".split(), "de": "ung keit sch ein ich der ß ü".split(), "fr": "eau que les ment oi é ai ou".split()}


def text_in(lang, seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randint(1, 3))) for _ in range(n))


def test_languages_are_told_apart(make_docs):
    rows = [(i, text_in(lang, i, 6 + i % 200), lang, "s") for i in range(400) for lang in [list(SYLLABLES)[i % 3]]]
    docs = make_docs(rows)
    contents = langid.learn(docs.filter(~langid.held_out()))
    assert list(contents) == ["de", "en", "fr"]
    truth = {r[0]: r[2] for r in rows}
    held = {r.doc_id for r in docs.filter(langid.held_out()).collect()}
    got = langid.predict(docs, contents).collect()
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in held]
    assert len(held) > 50 and np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 and r.accepted == (r.score >= langid.MIN_MARGIN) for r in got)


def test_late_windows_count(make_docs):
    contents = {lang: text_in(lang, 1, 4000).encode() for lang in SYLLABLES}
    model = langid.Classifier(contents)
    assert model.predict(text_in("en", 2, 500) + " " + text_in("fr", 3, 5000))[0] == "fr"


def test_language_defined_cases(odd, none):
    contents = langid.learn(odd)
    got = {r.doc_id: r for r in langid.predict(odd, contents).collect()}
    assert len(langid.predict(odd, contents).collect()) == len(ODD)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 12))
    assert got[8].lang_pred in ("en", "de")
    assert langid.predict(none, contents).count() == 0 and langid.learn(none) == {}
    assert {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}
    one = langid.Classifier({"en": b"the and of"})
    assert one.predict("the and") == ("en", 1.0)


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = collections.Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)


def test_statistics_equal_brute_force():
    draw = random.Random(5)
    texts = ["".join(draw.choice(["a", "b", "c ", " ", "\n", "a\n", "#", "é ", "&|", "\x0b", "a b c a b c "]) for _ in range(draw.randint(0, 60))) for _ in range(2000)]
    for text in texts + [t for _, t, *_ in ODD]:
        assert outliers.text_statistics(text) == brute_statistics(text), text


def test_outliers_go_and_clean_documents_stay(make_docs):
    rows = [(i, prose(i, 80 + i % 300), "en", "a" if i % 3 else "b") for i in range(900)]
    junk = [(5000 + i, prose(i, 120).replace(" ", "&&& "), "en", "a") for i in range(60)]
    got = {r.doc_id: r for r in outliers.judge(make_docs(rows + junk)).collect()}
    assert sum(got[r[0]].kept for r in rows) > 0.99 * len(rows)
    assert not any(got[r[0]].kept for r in junk)


def test_estimates_ignore_a_contaminated_quarter(spark):
    draw = np.random.default_rng(6)
    clean = draw.normal(0, 1, (3000, 5)) * [1, 2, 1, 3, 1] + [1, 2, 3, 4, 5]
    far = draw.normal(40, 1, (700, 5))
    frame = pd.DataFrame(np.concatenate([clean, far]), columns=outliers.FEATURES).assign(model="m")
    row = outliers.robust_estimates(spark.createDataFrame(frame)).first()
    assert np.allclose([row[f"m{i}"] for i in range(5)], clean.mean(axis=0), atol=0.25)


def test_outlier_defined_cases(odd, none):
    got = outliers.judge(odd).collect()
    assert len(got) == len(ODD) and outliers.judge(none).count() == 0
    for r in got:
        if r.doc_id is not None:
            text = next(t for i, t, *_ in ODD if i == r.doc_id)
            want = brute_statistics(text)
            assert tuple(r[c] for c in outliers.STATS) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r.base_failed and r.kept)
    assert all(r.kept for r in got if not r.base_failed)  # pools this small reject nothing


INSULTS = ["idiotik", "scumlor", "vequan"]


def labelled(n, seed=0):
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(i + 10_000 * seed, draw.randint(20, 150)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2 + len(words) // 30):
                words.insert(draw.randrange(len(words)), draw.choice(INSULTS) + draw.choice(["", "s", "er", "isch", "xo"]))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_gradient_equals_finite_differences():
    draw = np.random.default_rng(7)
    words = ["alpha", "beta", "gamma", "delt", "x"]
    keys = np.sort(np.array([tx.word_key(w) for w in words[:4]], np.uint64))
    grams = np.unique(tx.grams_of(words)[0])
    net = tx.Network.fresh(keys, grams, seed=1)
    for k in ("words", "chars"):
        net.p[k] = draw.normal(0, 0.5, net.p[k].shape)
        net.p[k][0] = 0
    inputs = tx.Inputs(words, keys, grams)
    index = np.array([[0, 1, 2, 3, 5, 5], [4, 3, 3, 0, 1, 2], [2, 5, 5, 5, 5, 5]])
    target, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        vectors = net.word_vectors(inputs)
        z = net.logits({w: net.gate_inputs(vectors, w) for w in net.DIRECTIONS}, index, 5)
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() / weight.sum())

    slopes = net.gradient(inputs, index, target, weight)
    for name, slope in slopes.items():
        flat = net.p[name].reshape(-1)
        at = np.argsort(-np.abs(slope.reshape(-1)))[:6]
        for i in at:
            old, step = flat[i], 1e-5
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert slope.reshape(-1)[i] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-7), name


def test_toxic_documents_are_caught_and_clean_ones_left_alone(make_docs, spark):
    rows, labels = labelled(900)
    docs = make_docs(rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    params = tx.learn(docs.filter(~tx.held_out()), table.filter(~tx.held_out()))
    scored = tx.score(docs, params).withColumn("held_out", tx.held_out()).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in scored if r.held_out]
    toxic = [r.score >= tx.THRESHOLD for r in held if truth[r.doc_id]]
    clean = [r.score >= tx.THRESHOLD for r in held if not truth[r.doc_id]]
    assert np.mean(toxic) > 0.95 and np.mean(clean) < 0.03
    scorer = tx.Scorer(params)
    long = prose(1, 3000) + " " + " ".join(f"{w} filler word" for w in INSULTS * 8)
    assert scorer.score([long])[0] > scorer.score([prose(1, 3000)])[0]  # the end of a long text counts
    texts = [r[1] for r in rows[:60]]
    together = scorer.score(texts)
    assert np.allclose(together, [scorer.score([t])[0] for t in texts], atol=1e-4)
    kept = tx.keep_clean(docs, table.filter(~tx.held_out()))
    assert kept.columns == docs.columns and kept.count() < docs.count()


def test_a_full_word_table_changes_no_score(monkeypatch):
    rows, labels = labelled(200, seed=3)
    windows, owners, toxic = [], [], []
    for i, text, *_ in rows:
        words = [tx.bare(w) for w in text.split()]
        for at in tx.window_starts(len(words)):
            windows.append(words[at : at + tx.WINDOW])
            owners.append(i)
            toxic.append(labels[i][2] == 1)
    params = tx.train(windows, np.array(owners), np.array(toxic), epochs=2)
    texts = [r[1] for r in rows]
    want = tx.Scorer(params).score(texts)
    monkeypatch.setattr(tx, "WORD_TABLE", 20)
    monkeypatch.setattr(tx, "STEP_CHARS", 2000)
    assert np.allclose(tx.Scorer(params).score(texts), want, atol=1e-4)


def test_toxicity_defined_cases(odd, none, spark):
    labels = spark.createDataFrame([(i, 1, int(i in (6, 8))) for i in range(15)] + [(8, 1, 0), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    params = tx.learn(odd, labels)
    got = tx.score(odd, params).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert tx.score(none, params).count() == 0
    assert tx.learn(none, labels) is None and tx.learn(odd, labels.filter("toxic = 0")) is None
    assert {r.score for r in tx.score(odd, None).collect()} == {0.0}
    assert tx.keep_clean(odd, labels.limit(0)).count() == len(ODD)

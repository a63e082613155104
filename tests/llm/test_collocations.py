"""op13 against brute force, and its defined cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD

from driftlens.llm import collocations as co

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, least, top):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in candidates.items():
        def holds(longer):
            return any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))

        if any(o == lang and len(w) > len(words) and b >= a and holds(w) for (o, w), b in candidates.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1000 * a * n[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.append((lang, " ".join(words), a, l, r, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranks, want = Counter(), []
    for row in out:
        ranks[row[0]] += 1
        if ranks[row[0]] <= top:
            want.append((row[0], ranks[row[0]], *row[1:]))
    return want


def check(rows, frame, least, top):
    got = [(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect()]
    assert sorted(got) == sorted(plain(rows, least, top))
    return got


def sample(n_docs, seed=1):
    draw, rows = random.Random(seed), []
    names = ["alpha", "Beta", "x-ray", "é", "日本", "a", "a", "ice cream", "new york city", "in the middle of it"]
    for i in range(n_docs):
        parts = [draw.choice(names) + draw.choice([" ", " ", "  ", "\t", ", ", ".\n", "!", " rare%d " % draw.randint(0, 99)]) for _ in range(60)]
        rows.append((i, "".join(parts), draw.choice(["en", "de", None]), "s"))
    return rows


@pytest.mark.parametrize("head", [co.HEAD, 4])
def test_phrases_equal_brute_force(make_docs, head):
    rows = sample(40)
    docs = make_docs(rows)
    assert len(check(rows, co.collocations(docs, 8, 2000, head), 8, 2000)) > 30
    check(rows, co.collocations(docs, 25, 5, head), 25, 5)


def test_dense_and_sparse_tiles_count_alike():
    draw = np.random.default_rng(2)
    left, right = (np.concatenate((draw.integers(0, 3000, 4000), draw.integers(0, 1 << 17, 500), [co.tail_word(b"en", b"w")] * 3)) for _ in range(2))
    want = Counter(zip(left.tolist(), right.tolist()))
    for dense in (1, 50, 10**9):
        got = Counter()
        for columns in co.count_pairs(left, right, dense):
            got.update({(int(a), int(b)): int(c) for a, b, c in zip(*columns)})
        assert got == want


def test_scores_pass_64_bits(spark):
    big = 10**13
    row = spark.range(1).select(co._score(co.F.lit(1), *(co.F.lit(x).cast("long") for x in (big, 10**15, big, big + 7))).alias("cut")).first().cut
    assert row.score == 1000 * big * 10**15 // (big * (big + 7)) and (row.l, row.r) == (big, big + 7)


def test_windows_do_not_break_phrases(make_docs, monkeypatch):
    rows = sample(8, seed=5)
    whole = check(rows, co.collocations(make_docs(rows), 4), 4, 2000)
    windows = co.windows
    monkeypatch.setattr(co, "windows", lambda raw: windows(raw, 9))
    stream, other = co.Stream([co.WordLevel([(b"en", b"ice"), (b"en", b"cream")], None)]), co.Stream([co.WordLevel([(b"en", b"ice"), (b"en", b"cream")], None)])
    stream.add(b"en", rows[0][1].encode())
    monkeypatch.undo()
    other.add(b"en", rows[0][1].encode())
    assert whole and all((a == b).all() for a, b in zip(stream.take(), other.take()))


def test_defined_cases(odd, none):
    check(ODD, co.collocations(odd, 2), 2, 2000)
    assert co.collocations(none).count() == 0
    assert co.collocations(odd, 10**6).count() == 0

"""op11 against brute force, and its defined cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import ODD, prose

from driftlens.llm import divergence as dv
from driftlens.llm.transducer import EMPTY, Transducer

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least):
    rows = [(t or "", lang or "", s or "") for _, t, lang, s in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOWER))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)

        def chances(c):
            total = sum(c[t] for t in kept)
            return [1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept]

        own = {s: chances(counts[lang, s]) for s in sources}
        q = chances(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((a - b) ** 2 // (a + b) for a, b in zip(own[s], own[o]))) for o in sources if o != s]
            terms = [(t, (a - b) ** 2 // (a + b)) for t, a, b in zip(kept, own[s], q) if counts[lang, s][t] and a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                found = found[:10] if part == "term" else found
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found)]
    return sorted(out)


def check(rows, frame, least):
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in frame.collect())
    assert got == plain(rows, least)
    return got


def sample(n, seed=1):
    draw, words = random.Random(seed), ["Alpha", "alpha", "beta", "béta", "日本", "gam-ma", "delta9x", "omega", "ome", "omegas", "z" * 80]
    return [
        (i, " ".join(draw.choices(words, k=40)) + f" rare{chr(97 + i % 26)}", draw.choice(["en", "de", "fr", None]), draw.choice(["a", "b", "c", None]))
        for i in range(n)
    ] + [(n, "12 34", "fr", "numbers"), (n + 1, "nothing kept", "xx", "a"), (n + 2, None, "xx", "b")]


@pytest.mark.parametrize("hot,shard_terms", [(dv.HOT, dv.SHARD_TERMS), (5, 3)])
def test_audit_equals_brute_force(make_docs, hot, shard_terms):
    rows = sample(120)
    assert len(check(rows, dv.audit(make_docs(rows), 4, hot, shard_terms), 4)) > 60


def test_blocks_add_up(make_docs, monkeypatch):
    monkeypatch.setattr(dv, "BLOCK_BITS", 1)
    rows = sample(80, seed=2)
    check(rows, dv.audit(make_docs(rows), 3), 3)


def test_transducer_is_minimal_and_ordinal():
    terms = sorted({prose(i, 1).encode() for i in range(400)} | {b"", b"a", b"ab", "é".encode()})
    transducer = Transducer(terms)
    asked = [*terms, b"alpha", b"zzz", b"a\0"]
    joined = b"".join(asked)
    ends = np.cumsum([len(t) for t in asked])
    starts = ends - [len(t) for t in asked]
    way = np.full(len(asked), transducer.start), np.zeros(len(asked), np.int64)
    found = transducer.ordinals(np.frombuffer(joined, np.uint8), starts, ends - starts, *way)
    assert found.tolist() == list(range(len(terms))) + [EMPTY] * 3
    # States of a minimal automaton: the distinct sets of suffixes.
    suffixes = {frozenset(t[len(p) :] for t in terms if t.startswith(p)) for t in terms for p in (t[:k] for k in range(len(t) + 1))}
    assert len(transducer.finals) == len(suffixes)
    assert transducer.after(b"alp")[0] != EMPTY and transducer.after(b"q") == (EMPTY, 0)


def test_probabilities_are_exact_for_large_counts():
    counts = np.array([0, 1, 10**15, 123456789012345])
    total, kept = np.int64(4 * 10**15), 10**7
    want = [1 + 10**9 * (int(c) + 2) // (int(total) + 2 * kept) for c in counts]
    assert dv.probabilities(counts, total, kept).tolist() == want


def test_task_counts_are_merged(monkeypatch):
    monkeypatch.setattr(dv, "MERGE_CODES", 3)
    run = dv.Run(dv.Hot([(b"en", b"a", 10), (b"en", b"b", 20), (b"de", b"b", 5)], np.full(16, 255, np.uint8)))
    seen = Counter()
    for lang, source, text in [(b"en", b"s", b"a b a c"), (b"de", b"s", b"b a"), (b"en", b"t", b"b"), (b"en", b"s", b"A B")]:
        run.add(lang, source, text)
        run.step()
        if run.is_full():
            for key, ords, counts, rest in run.take():
                seen.update({(key, o): n for o, n in zip(ords.tolist(), counts.tolist())} | {(key, w): n for w, n in rest.items()})
    for key, ords, counts, rest in run.take():
        seen.update({(key, o): n for o, n in zip(ords.tolist(), counts.tolist())} | {(key, w): n for w, n in rest.items()})
    s, t, d = (b"en", b"s"), (b"en", b"t"), (b"de", b"s")
    assert seen == {(s, 10): 3, (s, 20): 2, (s, b"c"): 1, (d, 5): 1, (d, b"a"): 1, (t, 20): 1}


def test_pruned_words_are_no_terms(spark):
    """The bitmap keeps every further term, hashed by Spark there and by the task here."""
    terms = [(b"en", f"w{i}".encode()) for i in range(500)] + [(b"de", "größe".encode())]
    rows = spark.createDataFrame(terms, "lang binary, term binary")
    bits = dv.bitmap(rows.select(dv.F.xxhash64(dv.F.concat("lang", dv.F.lit(b"\0"), "term")).alias("h")), len(terms), 26)
    hot = dv.Hot([(b"en", b"a", 1)], bits)
    for lang in (b"en", b"de"):
        assert hot.may_be_terms(lang, [t for l, t in terms if l == lang]).all()
    assert hot.may_be_terms(b"fr", [b"x%d" % i for i in range(2000)]).mean() < 0.2


def test_defined_cases(odd, none):
    check(ODD, dv.audit(odd, 2), 2)
    check(ODD, dv.audit(odd, 10**6), 10**6)
    assert dv.audit(none).count() == 0

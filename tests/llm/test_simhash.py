"""op12 against brute force, and its defined cases."""

import random
import re

import numpy as np
import pytest
import xxhash
from conftest_llm import ODD, prose

from driftlens.llm import simhash
from driftlens.llm.common import word_blocks

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [words[i : i + 4] for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fingerprints):
    """Every pair is compared; rows are (doc_id, fingerprint)."""
    distinct = sorted(set(f for _, f in fingerprints))
    values, root = np.array(distinct, np.uint64), {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for f in distinct:
        for g in values[np.bitwise_count(values ^ np.uint64(f)) <= 4].tolist():
            root[max(find(f), find(g))] = min(find(f), find(g))
    least = {}
    for i, f in fingerprints:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {f: least.get(find(f)) for f in distinct}


def check(rows, got):
    own = [(i, plain_fingerprint(t)) for i, t, *_ in rows]
    want = plain_components(own)
    expected = sorted(((i, f"{f:016x}", want[f]) for i, f in own), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == expected


def near_texts(groups, per_group, n_words):
    draw, rows = random.Random(4), []
    for g in range(groups):
        base = prose(g, n_words).split()
        for _ in range(per_group):
            words = list(base)
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = f"new{draw.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(words), "en", "s"))
    return rows + [(5000 + i, prose(900 + i, 5), "en", "s") for i in range(60)]


@pytest.mark.parametrize("group_rows", [simhash.GROUP_ROWS, 6])
def test_components_equal_brute_force(make_docs, group_rows):
    rows = near_texts(6, 25, 120)
    check(rows, simhash.link_components(make_docs(rows), group_rows=group_rows).collect())


def test_links_of_random_fingerprints(spark):
    """Neighbours at every distance from 1 to 6, in any bits: exactly those up to 4 link."""
    draw, values = random.Random(7), []
    for _ in range(300):
        base = draw.getrandbits(64)
        values += [base] + [base ^ sum(1 << b for b in draw.sample(range(64), k)) for k in range(1, 7)]
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 64).collect()
    a, b = (np.array([e[i] for e in edges], np.int64).view(np.uint64) for i in (0, 1))
    want = plain_components(list(enumerate(values)))
    got = {}
    for x, y in zip(*(simhash.forest(a, b))):
        got[int(y)] = int(x)
    parts, plain = {}, {}
    for v in set(values):
        parts.setdefault(got.get(v, v), set()).add(v)
        plain.setdefault(want[v], set()).add(v)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, plain.values()))


def test_long_texts_are_read_in_windows(monkeypatch):
    text = prose(3, 5000) + " " + "x" * 5000 + "\n" + prose(4, 50)
    raw = text.encode()
    assert sum(word_blocks(raw, 100), []) == raw.lower().split()
    whole = simhash.fingerprint(raw)
    monkeypatch.setattr(simhash, "word_blocks", lambda x: word_blocks(x, 7))
    assert whole == simhash.fingerprint(raw) == plain_fingerprint(text)
    monkeypatch.setattr(simhash, "STEP_SHINGLES", 3)
    assert whole == simhash.fingerprint(raw)


def test_defined_cases(odd, none):
    check(ODD, simhash.link_components(odd).collect())
    assert simhash.link_components(none).count() == 0

"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a word embedding and a pooled embedding of its character 3- to 5-grams, so
unseen forms of a stem are recognised. Both tables hold what occurs in MIN_DOCS sampled
documents (and MIN_SHARE of them) or more; everything else adds nothing. Both directions run over a window of
words, attention weighs their states, and a linear layer gives the window's logit. A text is
cut into overlapping windows that cover all of it; what the windows say (the worst, the next,
the mean chance) is combined by a logistic layer.

What a word contributes to the gates before recurrence depends on the word alone and is kept
per worker in a bounded table, so only the recurrent part runs for every word.

Fitting bounds: TOXIC_DOCS and CLEAN_DOCS labelled rows (smallest hash of the id), of each
at most TRAIN_WINDOWS windows, are held on the driver. Training is seeded.

Defined cases: null, empty and wordless texts score 0; without labels of both kinds every
score is 0; a row labelled more than once is toxic if one label says so; ties have equal
scores; repeated rows give repeated rows; an empty table gives an empty result. Labels,
language, source and id are never inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from driftlens.llm.common import STEP_ROWS, map_batches

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
#: Most rows of the word and n-gram tables.
WORD_ROWS, GRAM_ROWS, MIN_DOCS, MIN_SHARE = 1 << 15, 1 << 16, 3, 0.004
GRAMS = (3, 4, 5)
TOXIC_DOCS, CLEAN_DOCS, TRAIN_WINDOWS = 1000, 2000, 8
EPOCHS, RATE, TABLE_RATE, DECAY, SEED = 8, 0.01, 0.05, 1e-5, 10
#: Windows of one repeated word, drawn from clean documents, for each real window: repetition is no insult.
REPEATED_SHARE = 0.05
#: Share of the loss that toxic windows carry, whatever their number.
TOXIC_WEIGHT = 0.3
THRESHOLD = 0.7
#: Words whose gate inputs one Python worker keeps; a full table keeps what it has.
WORD_TABLE = 65_536
#: Characters and windows that one step of scoring holds.
STEP_CHARS, STEP_WINDOWS = 400_000, 2048
NOT_WORD = re.compile(r"[\W_]+")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 3 == 1


def bare(chunk: str) -> str:
    return NOT_WORD.sub("", chunk.lower())


def window_starts(n_words: int) -> range:
    return range(0, max(1, n_words - WINDOW + STRIDE), STRIDE)


def word_key(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character n-grams, begin and end marked, and the word each belongs to."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.cumsum(codes == 2) - 1
    owners, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in GRAMS:
        if len(codes) >= n:
            value = np.full(len(codes) - n + 1, n, np.uint64)
            for k in range(n):
                value = (value ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                value ^= value >> np.uint64(29)
            whole = owner[: len(value)] == owner[n - 1 :]
            owners.append(owner[: len(value)][whole])
            grams.append(value[whole])
    return np.concatenate(grams), np.concatenate(owners)


def _positions(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row of each wanted key in a table whose row 0 stands for keys it does not have."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at + 1, 0)


class Inputs:
    """Table rows of distinct words and of their n-grams."""

    def __init__(self, words: list[str], word_keys: np.ndarray, gram_keys: np.ndarray):
        self.n = len(words)
        self.rows = _positions(word_keys, np.fromiter(map(word_key, words), np.uint64, len(words)))
        grams, owners = grams_of(words)
        self.counts = np.maximum(np.bincount(owners, minlength=self.n), 1)
        places = _positions(gram_keys, grams)
        self.owners, self.grams = owners[places > 0], places[places > 0]


def _summed(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(index, weights=values[:, d], minlength=size) for d in range(values.shape[1])], axis=1)


class Network:
    """Parameters, the forward pass over windows of row numbers, and its gradient."""

    DIRECTIONS = ("f", "b")

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, word_keys: np.ndarray, gram_keys: np.ndarray, seed: int = SEED) -> Network:
        draw, h, d = np.random.default_rng(seed), HIDDEN, WORD_DIM + CHAR_DIM
        p = {"words": np.zeros((len(word_keys) + 1, WORD_DIM)), "chars": np.zeros((len(gram_keys) + 1, CHAR_DIM))}
        for way in cls.DIRECTIONS:
            p[f"w{way}"] = draw.normal(0, d**-0.5, (d, 3 * h))
            p[f"c{way}"] = np.zeros(3 * h)
            p[f"u{way}"] = draw.normal(0, h**-0.5, (h, 3 * h))
        return cls({**p, "attend": draw.normal(0, 0.3, 2 * h), "out": draw.normal(0, 0.3, 2 * h), "bias": np.zeros(1)})

    def word_vectors(self, inputs: Inputs) -> np.ndarray:
        chars = _summed(inputs.owners, self.p["chars"][inputs.grams], inputs.n) / np.sqrt(inputs.counts)[:, None]
        return np.concatenate([self.p["words"][inputs.rows], chars], axis=1)

    def gate_inputs(self, vectors: np.ndarray, way: str) -> np.ndarray:
        """Per word its part of the gates, and last the row of padding, which keeps the state."""
        gates = vectors @ self.p[f"w{way}"] + self.p[f"c{way}"]
        padding = np.zeros((1, 3 * HIDDEN))
        padding[:, HIDDEN : 2 * HIDDEN] = 60.0
        return np.concatenate([gates, padding])

    def run(self, gates: np.ndarray, index: np.ndarray, way: str, keep: bool = False):
        """States (time, window, hidden) of one direction; ``keep`` also returns what the gradient needs."""
        h, times = HIDDEN, range(index.shape[1]) if way == "f" else range(index.shape[1] - 1, -1, -1)
        u = self.p[f"u{way}"].astype(gates.dtype)
        state = np.zeros((len(index), h), gates.dtype)
        states, kept = np.empty((index.shape[1], len(index), h), gates.dtype), []
        for t in times:
            x, r = gates[index[:, t]], state @ u
            both = x[:, : 2 * h] + r[:, : 2 * h]
            both *= 0.5
            np.tanh(both, out=both)
            both += 1.0
            both *= 0.5
            reset, hold = both[:, :h], both[:, h:]
            new = np.tanh(x[:, 2 * h :] + reset * r[:, 2 * h :])
            if keep:
                kept.append((t, state, reset, hold, new, r[:, 2 * h :]))
            state = new + hold * (state - new)
            states[t] = state
        return (states, kept) if keep else states

    def pool(self, states: np.ndarray, real: np.ndarray):
        """Attention over the real words of each window: weights and pooled state."""
        score = np.where(real, states @ self.p["attend"].astype(states.dtype), -1e9)
        weight = np.exp(score - score.max(axis=0))
        weight *= real
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        return weight, np.einsum("tb,tbh->bh", weight, states)

    def logits(self, gates: dict[str, np.ndarray], index: np.ndarray, padding: int) -> np.ndarray:
        states = np.concatenate([self.run(gates[w], index, w) for w in self.DIRECTIONS], axis=2)
        _, pooled = self.pool(states, (index != padding).T)
        return pooled @ self.p["out"].astype(pooled.dtype) + pooled.dtype.type(self.p["bias"][0])

    def gradient(self, inputs: Inputs, index: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, h, padding = self.p, HIDDEN, inputs.n
        vectors = self.word_vectors(inputs)
        real = (index != padding).T
        kept, parts = {}, []
        for way in self.DIRECTIONS:
            states, kept[way] = self.run(self.gate_inputs(vectors, way), index, way, keep=True)
            parts.append(states)
        states = np.concatenate(parts, axis=2)
        attention, pooled = self.pool(states, real)
        error = (1 / (1 + np.exp(-(pooled @ p["out"] + p["bias"][0]))) - target) * weight / weight.sum()
        out = {"out": pooled.T @ error, "bias": np.array([error.sum()])}
        d_pooled = error[:, None] * p["out"]
        d_weight = np.einsum("tbh,bh->tb", states, d_pooled)
        d_score = attention * (d_weight - (attention * d_weight).sum(axis=0))
        out["attend"] = np.einsum("tb,tbh->h", d_score, states)
        d_states = attention[:, :, None] * d_pooled + d_score[:, :, None] * p["attend"]
        d_vectors = np.zeros_like(vectors)
        for k, way in enumerate(self.DIRECTIONS):
            d_state, u, d_u = np.zeros((len(index), h)), p[f"u{way}"], np.zeros((h, 3 * h))
            d_gates = np.zeros((index.shape[1], len(index), 3 * h))
            for t, before, reset, hold, new, carried in reversed(kept[way]):
                d_state = d_state + d_states[t, :, k * h : (k + 1) * h]
                d_new = d_state * (1 - hold) * (1 - new * new)
                d_hold = d_state * (before - new) * hold * (1 - hold)
                d_reset = d_new * carried * reset * (1 - reset)
                step = d_gates[t]
                step[:, :h], step[:, h : 2 * h], step[:, 2 * h :] = d_reset, d_hold, d_new
                d_rec = np.concatenate([d_reset, d_hold, d_new * reset], axis=1)
                d_u += before.T @ d_rec
                d_state = d_state * hold + d_rec @ u.T
            by_word = _summed(index.T.ravel(), d_gates.reshape(-1, 3 * h), padding + 1)[:padding]
            out[f"u{way}"], out[f"c{way}"], out[f"w{way}"] = d_u, by_word.sum(axis=0), vectors.T @ by_word
            d_vectors += by_word @ p[f"w{way}"].T
        out["words"] = _summed(inputs.rows, d_vectors[:, :WORD_DIM], len(p["words"]))
        out["words"][0] = 0
        d_chars = d_vectors[:, WORD_DIM:] / np.sqrt(inputs.counts)[:, None]
        out["chars"] = _summed(inputs.grams, d_chars[inputs.owners], len(p["chars"]))
        return out


def train(windows: list[list[str]], docs: np.ndarray, toxic: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Parameters from windows of words, the document of each, and that document's label.

    A toxic document need not be toxic everywhere: after the first epochs only those of its
    windows count that the network itself finds toxic, and always the worst one.
    """
    vocabulary: dict[str, int] = {}
    index = np.full((len(windows), WINDOW), -1, np.int64)
    for k, words in enumerate(windows):
        index[k, : len(words)] = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
    return train_numbered(list(vocabulary), index, docs, toxic, seed, epochs)


def train_numbered(
    words: list[str], index: np.ndarray, docs: np.ndarray, toxic: np.ndarray, seed: int = SEED, epochs: int = EPOCHS
) -> dict[str, np.ndarray]:
    """``train`` for windows whose words are numbers in ``words``, and -1 beyond a window's end."""
    index[index < 0] = len(words)
    word_keys, gram_keys = _tables(words, index, docs)
    everything = Inputs(words, word_keys, gram_keys)
    net, draw = Network.fresh(word_keys, gram_keys, seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: 0.0 for k in net.p}
    batch = int(np.clip(len(index) // 24, 64, 1024))
    clean = np.flatnonzero(~toxic)
    repeats = index[draw.choice(clean, int(len(index) * REPEATED_SHARE)), 0] if len(clean) else index[:0, 0]
    real = len(index)
    index = np.concatenate([index, np.repeat(repeats[:, None], WINDOW, axis=1)])
    toxic = np.concatenate([toxic, np.zeros(len(repeats), bool)])
    chosen, step = np.ones(len(index), bool), 0
    for epoch in range(epochs):
        if epoch >= 3:
            vectors = net.word_vectors(everything)
            gates = {w: net.gate_inputs(vectors, w) for w in net.DIRECTIONS}
            logit = np.concatenate([net.logits(gates, index[a : a + 4096], len(words)) for a in range(0, real, 4096)])[:real]
            top = np.full(docs.max() + 1, -np.inf)
            np.maximum.at(top, docs, logit)
            chosen[:real] = ~toxic[:real] | (logit > 0) | (logit == top[docs])
        picked = draw.permutation(np.flatnonzero(chosen))
        share = toxic[picked].mean()
        for at in range(0, len(picked), batch):
            rows = picked[at : at + batch]
            used, local = np.unique(index[rows], return_inverse=True)
            local = local.reshape(len(rows), WINDOW)
            used = used[used < len(words)]
            # ``np.unique`` sorts, so padding, if any, is the last local number already.
            inputs = Inputs([words[i] for i in used], word_keys, gram_keys)
            weight = np.where(toxic[rows], TOXIC_WEIGHT / max(share, 1e-3), (1 - TOXIC_WEIGHT) / max(1 - share, 1e-3))
            slopes = net.gradient(inputs, local, toxic[rows].astype(float), weight)
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for k, g in slopes.items():
                g = g + DECAY * net.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                # Embeddings share one scale, so a word moves as often as it speaks for a label
                # and a rare word is not learned by heart.
                square = np.square(g).mean(axis=1).max() if k in ("words", "chars") else g * g
                second[k] = 0.98 * second[k] + 0.02 * square
                net.p[k] -= (TABLE_RATE / RATE if k in ("words", "chars") else 1) * rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.98**step)) + 1e-6)
    params = {k: v.astype(np.float32) for k, v in net.p.items()} | {"word_keys": word_keys, "gram_keys": gram_keys}
    gates = {w: net.gate_inputs(net.word_vectors(everything), w) for w in net.DIRECTIONS}
    logit = np.concatenate([net.logits(gates, index[a : a + 4096], len(words)) for a in range(0, real, 4096)])[:real]
    labels = np.zeros(docs.max() + 1)
    labels[docs[toxic[:real]]] = 1
    return params | {"combine": _combination(evidence(logit, docs, len(labels)), labels)}


def evidence(logit: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """What the windows of each document say together: the worst, the next, and the mean chance."""
    order = np.lexsort((-logit, docs))
    first = np.searchsorted(docs[order], np.arange(n))
    count = np.bincount(docs, minlength=n)
    has = count > 0
    out = np.zeros((n, 4))
    ranked = np.clip(logit[order], -8, 8)
    out[has, 0] = ranked[first[has]]
    out[has, 1] = ranked[first[has] + (count[has] > 1)]
    out[:, 2] = np.bincount(docs, weights=1 / (1 + np.exp(-np.clip(logit, -60, 60))), minlength=n) / np.maximum(count, 1)
    out[:, 3] = 1
    return out


def _combination(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic weights of the evidence, by Newton steps with a small ridge."""
    beta = np.zeros(rows.shape[1])
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        slope = rows.T @ (labels - chance) - 0.5 * beta
        bend = (rows * (chance * (1 - chance))[:, None]).T @ rows + 0.5 * np.eye(len(beta))
        beta += np.linalg.solve(bend, slope)
    return beta


def _tables(words: list[str], index: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the words and n-grams that enough of the sampled documents hold."""
    pairs = np.unique(np.stack([np.repeat(docs, index.shape[1]), index.ravel()], axis=1), axis=0)
    pairs = pairs[pairs[:, 1] < len(words)]
    least = max(MIN_DOCS, MIN_SHARE * (docs.max() + 1))
    in_docs = np.bincount(pairs[:, 1], minlength=len(words))
    often = np.argsort(-in_docs, kind="stable")[:WORD_ROWS]
    word_keys = np.sort(np.array([word_key(words[i]) for i in often if in_docs[i] >= least], np.uint64))
    grams, owners = grams_of(words)
    keys, number = np.unique(grams, return_inverse=True)
    by_word = np.split(number[np.argsort(owners, kind="stable")], np.cumsum(np.bincount(owners, minlength=len(words)))[:-1])
    of_doc = np.split(pairs[:, 1], np.flatnonzero(np.diff(pairs[:, 0])) + 1) if len(pairs) else []
    held = np.zeros(len(keys), np.int64)
    for members in of_doc:
        held[np.unique(np.concatenate([by_word[i] for i in members]))] += 1
    often = np.argsort(-held, kind="stable")[:GRAM_ROWS]
    return word_keys, np.sort(keys[often[held[often] >= least]])


def training_windows(docs: DataFrame, labels: DataFrame) -> pa.Table:
    """doc, toxic, words of at most TRAIN_WINDOWS windows of the sampled rows; ``labels`` may name held-out ids."""
    named = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("l_id"), "l_id"]
    kinds = ((F.col("toxic") == 1, TOXIC_DOCS), (F.col("toxic") != 1, CLEAN_DOCS))
    sampled = [named.filter(kind).orderBy(*order).limit(n) for kind, n in kinds]
    # At most TOXIC_DOCS + CLEAN_DOCS rows of two numbers.
    sample = F.broadcast(sampled[0].unionByName(sampled[1]))
    joined = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = joined.join(sample, F.col("doc_id") == F.col("l_id")).select("doc_id", "text", F.col("toxic").cast("long").alias("toxic"))

    def make():
        def step(batch):
            out = {"doc": [], "toxic": [], "words": []}
            for doc_id, text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                words = [w for w in map(bare, text.split()) if w]
                starts = list(window_starts(len(words)))
                if len(starts) > TRAIN_WINDOWS:
                    starts = np.random.default_rng(doc_id & 0xFFFFFFFF).choice(starts, TRAIN_WINDOWS, replace=False).tolist()
                for at in starts if words else ():
                    out["doc"].append(doc_id)
                    out["toxic"].append(toxic)
                    out["words"].append(words[at : at + WINDOW])
            return out

        return step

    rows = map_batches(joined, "doc long, toxic long, words array<string>", make).toArrow()
    order = pc.sort_indices(rows.append_column("key", pc.binary_join(rows.column("words"), " ")), [("doc", "ascending"), ("key", "ascending")])
    return rows.take(order)


def learn(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | None:
    rows = training_windows(docs, labels)
    toxic = rows.column("toxic").to_numpy() == 1
    if not toxic.any() or toxic.all():
        return None
    # The driver holds each distinct word once, and numbers for the windows.
    lists = rows.column("words").combine_chunks()
    numbered = lists.flatten().dictionary_encode()
    index = np.full((len(lists), WINDOW), -1, np.int64)
    index[np.arange(WINDOW) < lists.value_lengths().to_numpy()[:, None]] = numbered.indices.to_numpy()
    return train_numbered(numbered.dictionary.to_pylist(), index, pd.factorize(rows.column("doc").to_numpy())[0], toxic)


class Scorer:
    """Scores texts; the gate inputs of frequent words are kept."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.net = Network(params)
        self.known: dict[str, int] = {}
        self.bare_words: dict[str, int] = {}
        # Row 0 is padding, and stands for chunks without letters, which are no words.
        self.filled, self.gates = 1, {}
        for way in self.net.DIRECTIONS:
            self.gates[way] = np.zeros((WORD_TABLE, 3 * HIDDEN), np.float32)
            self.gates[way][0] = self.net.gate_inputs(np.zeros((0, WORD_DIM + CHAR_DIM)), way)[0]

    def _rows(self, chunks: list[list[str]]) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
        """Row numbers of every text's words, and the gate tables they refer to."""
        new = [c for c in set().union(*chunks) if c not in self.known]
        fresh: dict[str, int] = {}
        words: dict[str, int] = {}
        for chunk in new:
            word = bare(chunk)
            if not word:
                fresh[chunk] = 0
            elif word in self.bare_words:
                fresh[chunk] = self.bare_words[word]
            else:
                fresh[chunk] = self.filled + words.setdefault(word, len(words))
        gates = self.gates
        if words:
            vectors = self.net.word_vectors(Inputs(list(words), self.net.p["word_keys"], self.net.p["gram_keys"])).astype(np.float32)
            made = {w: self.net.gate_inputs(vectors, w)[:-1].astype(np.float32) for w in self.net.DIRECTIONS}
            if self.filled + len(words) <= WORD_TABLE:
                for way, table in made.items():
                    self.gates[way][self.filled : self.filled + len(words)] = table
                self.bare_words.update((w, self.filled + n) for w, n in words.items())
                self.filled += len(words)
                self.known.update(fresh)
                fresh = {}
            else:
                gates = {w: np.concatenate([self.gates[w][: self.filled], made[w]]) for w in self.net.DIRECTIONS}
        elif len(self.known) < 2 * WORD_TABLE:
            self.known.update(fresh)
            fresh = {}
        known = self.known
        if fresh:
            numbers = [np.array([known[c] if c in known else fresh[c] for c in text], np.int64) for text in chunks]
        else:
            numbers = [np.fromiter(map(known.__getitem__, text), np.int64, len(text)) for text in chunks]
        return [n[n > 0] for n in numbers], gates

    def _score_some(self, texts: list[str]) -> np.ndarray:
        numbers, gates = self._rows([t.split() for t in texts])
        stream = np.concatenate([*numbers, np.zeros(WINDOW, np.int64)])
        ends = np.cumsum([len(n) for n in numbers])
        starts, owners = [], []
        for k, n in enumerate(numbers):
            if len(n):
                at = np.arange(0, max(1, len(n) - WINDOW + STRIDE), STRIDE) + ends[k] - len(n)
                starts.append(at)
                owners.append(np.full(len(at), k))
        if not starts:
            return np.zeros(len(texts))
        starts, owners = np.concatenate(starts), np.concatenate(owners)
        logit = np.empty(len(starts))
        for a in range(0, len(starts), STEP_WINDOWS):
            at, own = starts[a : a + STEP_WINDOWS, None] + np.arange(WINDOW), owners[a : a + STEP_WINDOWS]
            index = np.where(at < ends[own][:, None], stream[np.minimum(at, len(stream) - 1)], 0)
            logit[a : a + len(own)] = self.net.logits(gates, index, 0)
        total = evidence(logit, owners, len(texts)) @ self.net.p["combine"]
        return np.where([len(n) > 0 for n in numbers], 1 / (1 + np.exp(-np.clip(total, -60, 60))), 0.0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores in order; texts are taken in runs of bounded length."""
        out, run, held = [], [], 0
        for text in texts:
            run.append(text or "")
            held += len(run[-1])
            if held > STEP_CHARS:
                out.append(self._score_some(run))
                run, held = [], 0
        return np.concatenate([*out, self._score_some(run)]) if run else np.concatenate(out)


def score(docs: DataFrame, params: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id, score of every row of ``docs``."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if params is None:
        return source.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(params)  # fixed size: the network's parameters

    def make():
        scorer = Scorer(shared.value)

        def step(batch):
            return {"doc_id": batch.column(0), "score": scorer.score(batch.column(1).to_pylist())}

        return step

    return map_batches(source, "doc_id long, score double", make)


def keep_clean(docs: DataFrame, labels: DataFrame, train_on: Column | None = None) -> DataFrame:
    """``docs`` without the rows that score THRESHOLD or more; all columns unchanged."""
    fit = docs.filter(train_on) if train_on is not None else docs
    params = learn(fit, labels)
    if params is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(params)

    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            # In slices, as ``score`` has them: a step holds the words of few texts.
            for at in range(0, batch.num_rows, STEP_ROWS):
                some = batch.slice(at, STEP_ROWS)
                scores = scorer.score(some.column(at_text).cast(pa.string()).to_pylist())
                yield some.filter(pa.array(scores < THRESHOLD))

    # The rows pass through the worker whole: a filter by a UDF would queue them beside it.
    return docs.mapInArrow(run, docs.schema)

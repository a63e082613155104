"""Minimal acyclic transducer from sorted terms to their lexicographic ordinals.

Terms are byte strings. They are added in ascending order; whatever a new term no longer
shares with the one before is final and is merged with an equal state, so the automaton is
minimal at any time. Every arc carries the number of terms that come before those behind
it; the sum along a term's path is its ordinal.

``Transducer`` holds the arcs in one open hash table, so that all words of a text take
their next step at once.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

EMPTY = -1
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Builder:
    """Adds sorted, distinct terms; ``arcs`` has (state, byte, skipped, next) of all merged states."""

    def __init__(self):
        self.register: dict[tuple, int] = {}
        self.sizes: list[int] = []
        self.finals: list[bool] = []
        self.arcs: list[tuple[int, int, int, int]] = []
        #: States on the path of the last term: [is final, finished arcs as (byte, state)].
        self.path: list[list] = [[False, []]]
        self.last = b""
        self.n = 0

    def add(self, term: bytes) -> None:
        if self.n and term <= self.last:
            raise ValueError("terms must be distinct and ascending")
        shared = 0
        while shared < min(len(term), len(self.last)) and term[shared] == self.last[shared]:
            shared += 1
        self._finish(shared)
        self.path += [[False, []] for _ in range(len(term) - shared)]
        self.path[-1][0] = True
        self.last, self.n = term, self.n + 1

    def _finish(self, depth: int) -> None:
        while len(self.path) > depth + 1:
            state = self._merged(*self.path.pop())
            self.path[-1][1].append((self.last[len(self.path) - 1], state))

    def _merged(self, final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, *arcs)
        state = self.register.get(key)
        if state is None:
            state = self.register[key] = len(self.sizes)
            skipped = int(final)
            for byte, to in arcs:
                self.arcs.append((state, byte, skipped, to))
                skipped += self.sizes[to]
            self.sizes.append(skipped)
            self.finals.append(final)
        return state

    def close(self) -> int:
        """Merges what is left; the start state."""
        self._finish(0)
        return self._merged(*self.path[0])


class Transducer:
    """Arrays of a closed automaton; 16 bytes for each slot, two to four slots for each arc."""

    def __init__(self, terms: Iterable[bytes]):
        builder = Builder()
        for term in terms:
            builder.add(term)
        self.start, self.n = builder.close(), builder.n
        self.finals = np.array(builder.finals, bool)
        arcs = np.array(builder.arcs, np.int64).reshape(-1, 4)
        self.bits = max(4, int(2 * len(arcs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, EMPTY, np.int64)
        self.skips, self.nexts = np.zeros(size, np.int32), np.zeros(size, np.int32)
        left, at = (arcs[:, 0] << 8) | arcs[:, 1], None
        at, own = self._slots(left), np.arange(len(arcs))
        while len(own):
            # Of the arcs that meet in an empty slot one takes it; all others try the next slot.
            slots, first = np.unique(at, return_index=True)
            taken = first[self.keys[slots] == EMPTY]
            here = own[taken]
            self.keys[at[taken]], self.skips[at[taken]], self.nexts[at[taken]] = left[here], arcs[here, 2], arcs[here, 3]
            rest = np.ones(len(own), bool)
            rest[taken] = False
            own, at = own[rest], (at[rest] + 1) & (size - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, states: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, skipped terms) after one byte each; EMPTY where there is no arc."""
        keys = (states << 8) | read
        at, left = self._slots(keys), np.arange(len(keys))
        found = np.full(len(keys), EMPTY, np.int64)
        while len(left):
            own = self.keys[at]
            hit = own == keys[left]
            found[left[hit]] = at[hit]
            on = ~hit & (own != EMPTY)
            left, at = left[on], (at[on] + 1) & (len(self.keys) - 1)
        none = found == EMPTY
        found[none] = 0
        to, skipped = self.nexts[found].astype(np.int64), self.skips[found].astype(np.int64)
        to[none] = EMPTY
        return to, skipped

    def after(self, prefix: bytes) -> tuple[int, int]:
        """State and skipped terms after a prefix; EMPTY if no term begins with it."""
        state, skipped = self.start, 0
        for byte in prefix:
            to, more = self.step(np.array([state]), np.array([byte]))
            if to[0] == EMPTY:
                return EMPTY, 0
            state, skipped = int(to[0]), skipped + int(more[0])
        return state, skipped

    def ordinals(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray, skipped: np.ndarray) -> np.ndarray:
        """Ordinals of the words at ``starts`` of a text's bytes, EMPTY for those that are no terms.

        ``states`` and ``skipped`` say where each word begins in the automaton.
        """
        out = np.full(len(starts), EMPTY, np.int64)
        alive = np.flatnonzero(states != EMPTY)
        at, total, depth = states[alive].astype(np.int64), skipped[alive].astype(np.int64), 0
        while len(alive):
            ended = lengths[alive] == depth
            if ended.any():
                done = ended & self.finals[at]
                out[alive[done]] = total[done]
                alive, at, total = alive[~ended], at[~ended], total[~ended]
            at, more = self.step(at, data[starts[alive] + depth].astype(np.int64))
            on = at != EMPTY
            alive, at, total, depth = alive[on], at[on], (total + more)[on], depth + 1
        return out

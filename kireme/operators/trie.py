"""All matches of a set of patterns in an array of ids, by levels of a trie held in sorted numpy keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BITS = 22
#: Stands between texts; no pattern has it.
GAP = (1 << BITS) - 1


class Trie:
    def __init__(self, patterns: Iterable[tuple[int, ...]]):
        """Patterns are numbered in their order; of equal ones the last counts."""
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        numbered = [(p, i) for i, p in enumerate(patterns) if p]
        states: dict[tuple[int, ...], int] = {(): 0}
        self.entry: list[int] = [-1]
        depth = 1
        alive = numbered
        while alive:
            keys: dict[int, int] = {}
            for p, i in alive:
                prefix = p[:depth]
                if prefix not in states:
                    states[prefix] = len(self.entry)
                    self.entry.append(-1)
                    keys[states[prefix[:-1]] << BITS | prefix[-1]] = states[prefix]
                if len(p) == depth:
                    self.entry[states[prefix]] = i
            order = sorted(keys)
            self.levels.append((np.array(order, np.int64), np.array([keys[k] for k in order], np.int64)))
            alive = [(p, i) for p, i in alive if len(p) > depth]
            depth += 1
        self.entry_of = np.array(self.entry, np.int64)

    def matches(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, pattern numbers) for each length; a start occurs once in each."""
        start, state = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for n, (keys, to) in enumerate(self.levels, 1):
            inside = start + n <= len(ids)
            start, state = start[inside], state[inside]
            key = state << BITS | ids[start + n - 1]
            k = np.searchsorted(keys, key)
            hit = (k < len(keys)) & (keys[np.minimum(k, len(keys) - 1)] == key)
            start, state = start[hit], to[k[hit]]
            if not start.size:
                return
            found = self.entry_of[state]
            ends = found >= 0
            if ends.any():
                yield n, start[ends], found[ends]

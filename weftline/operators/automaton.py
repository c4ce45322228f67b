"""Many words looked for in many names at once: an Aho-Corasick automaton as arrays, built from sorted words and run over a batch of names position by position."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Characters (bytes) of names that are looked at together; bounds a task's memory.
BLOCK_BYTES = 1 << 20


@dataclass(frozen=True)
class Automaton:
    """States are numbered by depth. ``keys`` (state * 256 + byte, sorted) lead to ``targets``; ``fail`` is the longest proper suffix that is a state; ``word`` is the word
    that ends in a state, or -1; ``more`` is the longest proper suffix in which a word ends, or 0."""

    keys: np.ndarray
    targets: np.ndarray
    fail: np.ndarray
    word: np.ndarray
    more: np.ndarray

    def _go(self, states: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Where each state goes with its byte, -1 for nowhere."""
        want = states * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.targets[at], -1)

    def _next(self, states: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The state after a byte: from the state, else from the longest suffix that has it, else the root."""
        out = self._go(states, byte)
        while len(lost := np.flatnonzero((out < 0) & (states > 0))):
            states = states.copy()
            states[lost] = self.fail[states[lost]]
            out[lost] = self._go(states[lost], byte[lost])
        return np.maximum(out, 0)

    def words_in(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(name, word) for each word that is part of a name, each pair once; names are ``data[offsets[i]:offsets[i + 1]]``."""
        names, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not len(self.keys):
            return names[0], words[0]
        order = np.argsort(-np.diff(offsets), kind="stable")  # long names first, so that those still being read are a prefix
        lengths = np.diff(offsets)[order]
        states = np.zeros(len(order), np.int64)
        for i in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -i, side="left"))
            states = self._next(states[:live], data[offsets[order[:live]] + i].astype(np.int64))
            which, ends = np.arange(live), np.where(self.word[states] >= 0, states, self.more[states])
            while len(hit := np.flatnonzero(ends)):
                which, ends = which[hit], ends[hit]
                names.append(order[which])
                words.append(self.word[ends])
                ends = self.more[ends]
        return np.divmod(np.unique(np.concatenate(names) * len(self.word) + np.concatenate(words)), len(self.word))


def build(words: list[str]) -> Automaton:
    """The automaton of distinct ``words``, none of them empty; a word's number is its place in the list."""
    raw = [w.encode() for w in words]
    lengths = np.array([len(w) for w in raw], np.int64)
    begin = np.concatenate(([0], np.cumsum(lengths)))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    keys, targets, parents, levels = [], [], [np.zeros(1, np.int64)], []
    at, n = np.zeros(len(words), np.int64), 1
    word = [np.full(1, -1, np.int64)]
    for depth in range(int(lengths.max()) if len(lengths) else 0):
        live = np.flatnonzero(lengths > depth)
        new, of = np.unique(at[live] * 256 + data[begin[live] + depth], return_inverse=True)
        at[live] = n + of
        ended = np.full(len(new), -1, np.int64)
        ended[of[lengths[live] == depth + 1]] = live[lengths[live] == depth + 1]
        keys.append(new)
        targets.append(np.arange(n, n + len(new)))
        levels.append((n, n + len(new)))
        parents.append(new)
        word.append(ended)
        n += len(new)
    made = Automaton(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, targets)), np.zeros(n, np.int64), np.concatenate(word), np.zeros(n, np.int64))
    came = np.concatenate(parents)
    for lo, hi in levels[1:]:  # of the first level, fail is the root
        made.fail[lo:hi] = made._next(made.fail[came[lo:hi] >> 8], came[lo:hi] & 255)
        up = made.fail[lo:hi]
        made.more[lo:hi] = np.where(made.word[up] >= 0, up, made.more[up])
    return made

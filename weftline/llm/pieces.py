"""Token ids of many texts: the library encodes each distinct piece of text once.

A byte-level BPE with the usual splitting pattern never merges across the pieces that the pattern cuts. So the pieces
are found here with vector operations, each distinct one is encoded once per task by the ``tokenizers`` library, and the ids of a text are those of
its pieces in a row. Pieces are found again by a hash, and then their characters are compared with those that were encoded: a piece
that shares its hash with another one, or has more than ``MOST_CHARS`` characters, is kept under its characters instead.
Texts with characters outside the ranges below, or with a special token's text in them, go to the library whole.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

from .common import mix, span_hashes

_OTHER, _LETTER, _NUMBER, _SPACE, _END = 0, 1, 2, 3, 4
_PLAIN = 0x530  # below: Latin, Greek and Cyrillic, whose classes have been stable for long
_SEPARATOR = 0x10FFFF
_MORE = [*range(0x2010, 0x2028), *range(0x2030, 0x205F)]  # punctuation


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.zeros(0x2100, np.uint8)
    known = np.zeros(0x2100, bool)
    for c in [*range(_PLAIN), *_MORE]:
        category = unicodedata.category(chr(c))
        known[c] = category != "Cn" and not 0x1C <= c <= 0x1F
        kind[c] = _LETTER if category[0] == "L" else _NUMBER if category[0] == "N" else _SPACE if chr(c).isspace() else _OTHER
    return kind, known


_LONG = 1 << 20

#: Characters of a piece that is known by its hash; longer ones are rare and known by their characters.
MOST_CHARS = 512
MOST_HELD = 1 << 24
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def _each(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions in all of these spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class PieceEncoder:
    """Counts and ids of texts as ``tokenizers`` gives them for a byte-level BPE file.

    ``most`` bounds the pieces that are remembered, and ``MOST_HELD`` their characters and ids; beyond these the memory starts anew, with the same results.
    """

    def __init__(self, path: str, most: int = 500_000) -> None:
        self.library = Tokenizer.from_file(path)
        self.most = most
        self.kind, self.known = _classes()
        self.codes = mix(np.arange(len(self.known), dtype=np.uint64))
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self) -> None:
        self.slots = 1 << (2 * self.most - 1).bit_length()
        self.keys = np.zeros(self.slots, np.uint64)  # 0: free
        self.numbers = np.zeros(self.slots, np.int32)
        self.flat = np.zeros(0, np.uint32)
        self.size = np.zeros(0, np.int64)
        self.begin = np.zeros(0, np.int64)
        self.text = np.zeros(0, np.int32)  # the characters of the pieces that have a hash, and where each begins and how long it is (-1: it has none)
        self.text_at = np.zeros(0, np.int64)
        self.span = np.zeros(0, np.int64)
        self.odd: dict[bytes, int] = {}
        self.odd_bytes = 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of known pieces; -1 for others. Linear probing, all at once."""
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        while len(left):
            keys = self.keys[slot]
            hit = keys == hashes[left]
            out[left[hit]] = self.numbers[slot[hit]]
            on = ~hit & (keys != 0)
            left, slot = left[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def _insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        while len(hashes):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            self.keys[slot[placed]] = hashes[placed]
            self.numbers[slot[placed]] = numbers[placed]
            rest = np.ones(len(hashes), bool)
            rest[placed] = False
            hashes, numbers, slot = hashes[rest], numbers[rest], (slot[rest] + 1) & (self.slots - 1)

    def whole(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _pieces(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces in texts that each end with the separator."""
        end = chars == _SEPARATOR
        kind = self.kind[np.where(end, 0, chars)]
        kind[end] = _END
        runs = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | end[1:])))
        ends = np.append(runs[1:], len(chars))
        what = kind[runs]
        following = np.append(what[1:], _END)
        space = what == _SPACE
        inner = space & (following != _END)  # a word follows: the last character is left to it, or stands alone
        last = chars[ends - 1]
        gives = inner & (last == 0x20)
        previous = np.concatenate(([False], gives[:-1]))
        starts = runs - previous
        # an apostrophe on its own, right before letters, may open one of the English endings
        quote = (what == _OTHER) & (ends - runs == 1) & (chars[runs] == 0x27) & ~previous & (following == _LETTER)
        skip = np.zeros(len(runs), np.int64)
        if quote.any():
            q = np.flatnonzero(quote)
            first = chars[ends[q]]
            second = chars[np.minimum(ends[q] + 1, len(chars) - 1)]
            two = np.isin(first * 0x200000 + second, [ord(a) * 0x200000 + ord(b) for a, b in ("re", "ve", "ll")])
            one = np.isin(first, [ord(c) for c in "stmd"])
            takes = np.where(one, 1, np.where(two, 2, 0))
            skip[q + 1] = takes
            ends = ends.copy()
            ends[q] += takes
            starts[q + 1] += takes
        # white space before a word: all but its last character, then that one if the word doesn't take it
        long = inner & (ends - runs >= 2)
        alone = inner & ~gives
        body_end = np.where(inner, ends - 1, ends)
        piece_s = [starts[~space & (what != _END) & (starts < ends)], runs[space & ~inner], runs[long], (ends - 1)[alone]]
        piece_e = [ends[~space & (what != _END) & (starts < ends)], ends[space & ~inner], body_end[long], ends[alone]]
        s, e = np.concatenate(piece_s), np.concatenate(piece_e)
        order = np.argsort(s, kind="stable")
        return s[order], e[order]

    def _add(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: bool) -> np.ndarray:
        """The numbers of new pieces, after the library has encoded them."""
        flat, sizes = self._learn(chars, starts, ends)
        base = len(self.size)
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(sizes) - sizes))
        self.flat = np.concatenate((self.flat, flat))
        self.size = np.concatenate((self.size, sizes))
        span = ends - starts
        self.text_at = np.concatenate((self.text_at, len(self.text) + np.cumsum(span) - span if hashed else np.zeros(len(starts), np.int64)))
        self.span = np.concatenate((self.span, span if hashed else np.full(len(starts), -1)))
        if hashed:
            self.text = np.concatenate((self.text, chars[_each(starts, span)].astype(np.int32)))
        return np.arange(base, base + len(starts))

    def _numbers(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each piece, after the library has seen the new ones."""
        if len(self.size) > self.most or len(self.flat) + len(self.text) + self.odd_bytes > MOST_HELD:
            self.reset()
        hashes = span_hashes(self.codes[np.where(chars == _SEPARATOR, 0, chars)], starts, ends)
        hashes[hashes == 0] = 1
        usual = ends - starts <= MOST_CHARS
        found = self._find(hashes)
        new = np.flatnonzero((found < 0) & usual)
        if len(new):
            distinct, first, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            numbers = np.zeros(len(distinct), np.int64)
            for lo in range(0, len(distinct), self.most // 2):
                at = new[first[lo : lo + self.most // 2]]
                numbers[lo : lo + len(at)] = self._add(chars, starts[at], ends[at], hashed=True)
                if lo == 0:  # the table stays at most three quarters full
                    self._insert(distinct[: len(at)], numbers[: len(at)])
            found[new] = numbers[inverse]
        for i in np.flatnonzero(~self._same(chars, starts, ends, found, usual)).tolist():
            name = chars[starts[i] : ends[i]].astype("<u4").tobytes()
            if name not in self.odd:
                self.odd[name] = int(self._add(chars, starts[i : i + 1], ends[i : i + 1], hashed=False)[0])
                self.odd_bytes += len(name)
            found[i] = self.odd[name]
        return found

    def _same(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray, usual: np.ndarray) -> np.ndarray:
        """Whether each piece has the characters of the one with its number."""
        span = ends - starts
        if not usual.any():
            return usual
        same = usual & (self.span[np.maximum(numbers, 0)] == span)
        at = np.flatnonzero(same)
        equal = chars[_each(starts[at], span[at])] == self.text[_each(self.text_at[numbers[at]], span[at])]
        if not equal.all():
            same[at] = np.logical_and.reduceat(equal, np.cumsum(span[at]) - span[at])
        return same

    def _learn(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, and how many each has. Pieces are encoded many to a string, parted by line ends, which the pattern keeps to themselves."""
        encode = self.whole
        white = self.kind[chars[ends - 1]] == _SPACE
        words = np.flatnonzero(~white)
        line = encode("\n")
        parts: dict[int, np.ndarray] = {}
        sizes = np.zeros(len(starts), np.int64)
        flat = np.zeros(0, np.uint32)
        if len(words) and len(line) == 1:
            size = ends[words] - starts[words] + 1
            begin = np.cumsum(size) - size
            joined = chars[np.repeat(starts[words] - 1 - begin, size) + np.arange(size.sum())]
            joined[begin] = 0x0A
            got = np.array(encode(joined.astype("<u4").tobytes().decode("utf-32-le")), np.uint32)
            at = np.flatnonzero(got == line[0])
            if len(at) == len(words):
                flat = np.delete(got, at)
                sizes[words] = np.diff(np.append(at, len(got))) - 1
            else:
                white[:] = True
        else:
            white[:] = True
        if white.any():
            begin = np.cumsum(sizes) - sizes
            for i in np.flatnonzero(white).tolist():
                parts[i] = np.array(encode(chars[starts[i] : ends[i]].astype("<u4").tobytes().decode("utf-32-le")), np.uint32)
                sizes[i] = len(parts[i])
            flat = np.insert(flat, np.repeat(begin[list(parts)], sizes[list(parts)]), np.concatenate(list(parts.values())))
        return flat, sizes

    def _split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Characters and row starts of the texts that can be cut here; the indexes of the others."""
        joined = np.frombuffer(("".join(t + "\U0010ffff" for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        stops = np.cumsum([len(t) + 1 for t in texts])
        starts = stops - np.array([len(t) + 1 for t in texts])
        odd = np.ones(len(joined), bool)
        small = joined < len(self.known)
        odd[small] = ~self.known[joined[small]]
        odd[stops - 1] = False
        count = np.concatenate(([0], np.cumsum(odd)))
        bad = (count[stops] - count[starts]) > 0
        for i, t in enumerate(texts):
            if any(s in t for s in self.specials):
                bad[i] = True
        if bad.any():
            keep = np.repeat(~bad, stops - starts)
            joined = joined[keep]
            lengths = np.where(bad, 0, stops - starts)
            stops = np.cumsum(lengths)
            starts = stops - lengths
        return joined, starts, stops, np.flatnonzero(bad).tolist()

    def _segments(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Very long texts cut before single spaces between words, where pieces always begin; and where each text starts."""
        parts: list[str] = []
        first = [0]
        for t in texts:
            lo = 0
            while len(t) - lo > _LONG and (cut := _BETWEEN.search(t, lo + _LONG)):
                parts.append(t[lo : cut.start()])
                lo = cut.start()
            parts.append(t[lo:] if lo else t)
            first.append(len(parts))
        return parts, np.array(first)

    def _groups(self, parts: list[str]):
        """Runs of parts with about ``_LONG`` characters."""
        lo = size = 0
        for i, t in enumerate(parts):
            if i > lo and size + len(t) > _LONG:
                yield lo, i
                lo, size = i, 0
            size += len(t) + 1
        if lo < len(parts):
            yield lo, len(parts)

    def counts(self, texts: list[str]) -> np.ndarray:
        parts, first = self._segments(texts)
        each = [self._counts(parts[a:b]) for a, b in self._groups(parts)]
        total = np.concatenate(([0], np.cumsum(np.concatenate(each)))) if each else np.zeros(1, np.int64)
        return total[first[1:]] - total[first[:-1]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as uint32."""
        parts, first = self._segments(texts)
        got = [x for a, b in self._groups(parts) for x in self._encode(parts[a:b])]
        return [got[a] if b == a + 1 else np.concatenate(got[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]

    def _counts(self, texts: list[str]) -> np.ndarray:
        chars, row_s, row_e, rest = self._split(texts)
        out = np.zeros(len(texts), np.int64)
        if len(chars):
            starts, ends = self._pieces(chars)
            if len(starts):
                numbers = self._numbers(chars, starts, ends)
                each = self.size[numbers]
                total = np.concatenate(([0], np.cumsum(each)))
                out = total[np.searchsorted(starts, row_e)] - total[np.searchsorted(starts, row_s)]
        for i in rest:
            out[i] = len(self.whole(texts[i]))
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        chars, row_s, row_e, rest = self._split(texts)
        out = [np.zeros(0, np.uint32)] * len(texts)
        if len(chars):
            starts, ends = self._pieces(chars)
            if len(starts):
                numbers = self._numbers(chars, starts, ends)
                each = self.size[numbers]
                total = np.concatenate(([0], np.cumsum(each)))
                ids = self.flat[np.arange(total[-1]) - np.repeat(total[:-1] - self.begin[numbers], each)]
                lo, hi = total[np.searchsorted(starts, row_s)], total[np.searchsorted(starts, row_e)]
                out = [ids[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
        for i in rest:
            out[i] = np.array(self.whole(texts[i]), np.uint32)
        return out

"""Secret scans by one combined deterministic automaton.

The rules' regular expressions become one NFA over bytes; subset construction and minimisation give transition arrays,
and a text is read once, byte by byte, for all rules together. A span of a rule shows as a stretch of states that accept
for it: the first of them is where the shortest match ends, the last is the end of the longest. Where the span begins is
read from there backwards. Should a span begin inside the one before it, that rule reads the text again with the automaton
of its own, which starts anew after each span (leftmost, non-overlapping).

Regular expressions: literals, classes ``[...]``, groups, ``|``, ``?``, ``*``, ``+`` and ``(?i)`` at the beginning for ASCII
letters in either case. All classes are ASCII, so bytes of other characters never match.

Defined cases: a null text counts as empty and has no spans; a text of any length is read whole; equal rows give equal
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_chunks


@dataclass(frozen=True)
class Rule:
    """``pattern`` must end in a run of one class (or a fixed byte), so that its matches from one start only differ in that run.
    ``least``: the bytes that the span, or with ``tail`` that last run, must have; failing spans are dropped after they were matched."""

    kind: str
    pattern: str
    least: int
    tail: bool = False
    base: bool = False


#: The three base rules, then those that this method adds (prefixes of widely used token formats). The
#: hexadecimal rule has its least length in the pattern, as its runs cannot overlap.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8, tail=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, base=True),
    Rule("hex", "[0-9a-f]" * 32 + "[0-9a-f]*", 32, base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 24),
    Rule("pem", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----", 27),
)


class _Nfa:
    """Thompson's construction from a small recursive reader of the expression."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        self.fold = pattern.startswith("(?i)")
        self.text, self.at = pattern[4 * self.fold :], 0
        out = self._choice()
        assert self.at == len(self.text), f"cannot read {pattern!r} at {self.at}"
        return out

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _choice(self) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b = self._sequence()
            self.empty[start].append(a)
            self.empty[b].append(end)
            if self._peek() != "|":
                return start, end
            self.at += 1

    def _sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self._peek() and self._peek() not in "|)":
            a, b = self._atom()
            if (sign := self._peek()) and sign in "?*+":
                self.at += 1
                outer, done = self.state(), self.state()
                self.empty[outer].append(a)
                self.empty[b].append(done)
                if sign in "?*":
                    self.empty[outer].append(done)
                if sign in "*+":
                    self.empty[b].append(a)
                a, b = outer, done
            self.empty[end].append(a)
            end = b
        return start, end

    def _byte(self) -> int:
        if self._peek() == "\\":
            assert self.text[self.at + 1] == "x"
            self.at += 4
            return int(self.text[self.at - 2 : self.at], 16)
        self.at += 1
        return ord(self.text[self.at - 1])

    def _atom(self) -> tuple[int, int]:
        if self._peek() == "(":
            self.at += 1
            out = self._choice()
            self.at += 1
            return out
        if self._peek() == "[":
            self.at += 1
            accepted: set[int] = set()
            while self._peek() != "]":
                low = self._byte()
                if self._peek() == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    accepted |= {*range(low, self._byte() + 1)}
                else:
                    accepted.add(low)
            self.at += 1
        else:
            accepted = {self._byte()}
        if self.fold:
            accepted |= {ord(chr(c).swapcase()) for c in accepted if chr(c).isalpha()}
        a, b = self.state(), self.state()
        self.moves[a] = (frozenset(accepted), b)
        return a, b

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Automaton:
    """``classes`` maps a byte to its class; ``step[s + class]`` is the next state, states being multiples of the number of
    classes. States at or above ``hot`` accept for the rules in the bits of ``kinds[s]``."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.nfa = nfa = _Nfa()
        self.rules = rules
        self.parts = [nfa.add(r.pattern) for r in rules]
        sets = {m[0] for m in nfa.moves if m}
        names: dict[tuple, int] = {}
        self.classes = bytes(names.setdefault(tuple(b in s for s in sets), len(names)) for b in range(256))
        width = len(names)
        sample = {c: b for b, c in reversed([*enumerate(self.classes)])}
        first = nfa.closed([a for a, _ in self.parts])
        number, table, todo = {first: 0}, [], [first]
        for states in todo:  # grows while it is read
            row = []
            for c in range(width):
                got = nfa.closed([m[1] for s in states if (m := nfa.moves[s]) and sample[c] in m[0]]) | first
                if got not in number:
                    number[got] = len(number)
                    todo.append(got)
                row.append(number[got])
            table.append(row)
        marks = [sum(1 << k for k, (_, end) in enumerate(self.parts) if end in s) for s in todo]
        block, count = marks, len(set(marks))
        while True:  # minimisation: refine the blocks until all of a block step to the same blocks
            ids: dict[tuple, int] = {}
            block = [ids.setdefault((block[s], *(block[t] for t in row)), len(ids)) for s, row in enumerate(table)]
            if len(ids) == count:
                break
            count = len(ids)
        member: dict[int, int] = {}
        for s, b in enumerate(block):
            member.setdefault(b, s)
        order = sorted(member, key=lambda b: (marks[member[b]] != 0, member[b]))
        place = {b: i * width for i, b in enumerate(order)}
        self.step = [place[block[t]] for b in order for t in table[member[b]]]
        self.start = place[block[0]]
        self.hot = width * sum(marks[member[b]] == 0 for b in order)
        self.kinds = {i * width: marks[member[b]] for i, b in enumerate(order)}
        self.back: list[dict[int, list[int]]] = [{} for _ in (0, 1)]
        for s, targets in enumerate(nfa.empty):
            for t in targets:
                self.back[0].setdefault(t, []).append(s)
        for s, m in enumerate(nfa.moves):
            if m:
                self.back[1].setdefault(m[1], []).append(s)
        self._own: dict[int, Automaton] = {}

    def stretches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, index of the first accepting byte, index after the last one) for each accepting stretch."""
        step, hot, kinds = self.step, self.hot, self.kinds
        s = self.start
        out: list[tuple[int, int, int]] = []
        inside = 0
        rise: dict[int, int] = {}
        for i, c in enumerate(data.translate(self.classes)):
            s = step[s + c]
            if s >= hot or inside:
                bits = kinds[s]
                if bits != inside:
                    for k in range(len(self.rules)):
                        if bits >> k & 1 and not inside >> k & 1:
                            rise[k] = i
                        elif inside >> k & 1 and not bits >> k & 1:
                            out.append((k, rise[k], i))
                    inside = bits
        out += [(k, rise[k], len(data)) for k in range(len(self.rules)) if inside >> k & 1]
        return out

    def anew(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, index of the first accepting byte) of the spans of an automaton of one rule, which begins anew after each of them. One pass."""
        step, hot = self.step, self.hot
        s, rise, at = self.start, -1, 0
        out: list[tuple[int, int, int]] = []
        for i, c in enumerate(data.translate(self.classes)):
            s = step[s + c]
            if rise >= 0 and s < hot:
                out.append((self.begin(data, 0, rise, at), i, rise))
                s, rise, at = step[self.start + c], -1, i
            if rise < 0 and s >= hot:
                rise = i
        return [*out, (self.begin(data, 0, rise, at), len(data), rise)] if rise >= 0 else out

    def begin(self, data: bytes, rule: int, last: int, least: int = 0) -> int:
        """The leftmost start, from ``least`` on, of a match of ``rule`` that ends with the byte at ``last``."""
        start, end = self.parts[rule]

        def closed(states):
            seen, todo = set(states), list(states)
            while todo:
                for t in self.back[0].get(todo.pop(), ()):
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return seen

        states, found, i = closed([end]), last, last
        while states and i >= least:
            states = closed([s for t in states for s in self.back[1].get(t, ()) if data[i] in self.nfa.moves[s][0]])
            if start in states:
                found = i
            i -= 1
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of all spans that are long enough, in bytes, sorted."""
        out: list[tuple[int, int, int]] = []
        until = [0] * len(self.rules)
        again: set[int] = set()
        for k, rise, end in self.stretches(data):
            start = self.begin(data, k, rise)
            if start < until[k]:
                again.add(k)
            until[k] = end
            out.append((start, k, end, rise))
        if again:
            out = [x for x in out if x[1] not in again]
            for k in again:
                own = self._own.setdefault(k, None) or Automaton((self.rules[k],))
                self._own[k] = own
                out += [(start, k, end, rise) for start, end, rise in own.anew(data)]
        return sorted((a, k, e) for a, k, e, rise in out if e - (rise if self.rules[k].tail else a) >= self.rules[k].least)


@lru_cache(4)
def automaton(rules: tuple[Rule, ...] = RULES) -> Automaton:
    """Built once for each Python worker."""
    return Automaton(rules)


def scan_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, spans array<struct<kind, start, end>>) for every row; code points, ends exclusive, by start and then by rule."""
    key_type = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part, data, offsets in text_chunks(batch, 1):
                rows = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    raw = data[a:b].tobytes()
                    spans = found.spans(raw)
                    if spans and not raw.isascii():  # code points before each byte
                        before = np.concatenate(([0], np.cumsum((data[a:b] & 0xC0) != 0x80)))
                        spans = [(int(before[s]), k, int(before[e])) for s, k, e in spans]
                    rows.append([{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in spans])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], [key, "spans"])

    return docs.select(key, text).mapInArrow(lean(scan), f"{key} {key_type}, spans array<struct<kind:string,start:long,end:long>>")


def span_digest(found: DataFrame, *, key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests of ``scan_secrets``."""
    base = [r.kind for r in rules if r.base]
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, line), ",")
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select(key, *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, *, key: str = "doc_id", text: str = "text", mask: str = "[REDACTED]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask``; overlapping spans become one. Texts without spans, null ones included, stay as they are.

    All columns are kept, in their order.
    """
    at = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(rules)
        for batch in batches:
            for part, data, offsets in text_chunks(batch, at):
                texts = part.column(at).to_pylist()
                changed = False
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    raw = data[a:b].tobytes()
                    if not (spans := found.spans(raw)):
                        continue
                    out, last = [], 0
                    for s, _, e in spans:
                        if s >= last:
                            out += [raw[last:s], mask.encode()]
                        last = max(last, e)
                    texts[i] = b"".join([*out, raw[last:]]).decode()
                    changed = True
                if changed:
                    part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                yield part

    return docs.mapInArrow(lean(clean), docs.schema)

"""N-gram Jaccard join: T-occurrence search with divided lists.

A document is the set of its distinct 5-word shingles (64-bit hashes). For a similarity t, a partner of a document with n shingles
shares at least T = ceil(t * n) of them. DivideSkip parts the n inverted lists of a document in its L longest and the n - L short ones: a partner must
occur T - L times in the short lists, and only such candidates are looked up in the long ones, by binary search. Here

1. one pass finds the long lists: shingles that occur in several documents of a stretch of the input, added up over all of
   it. Only their order matters (short before long), and all documents use the same one, so no pair can be missed. L follows
   from the cost of a posting and of a step of a search, as ``long_lists`` says;
2. of the short lists of a document, its first n - T + 1 are written as postings: no partner can miss all of these. Lists of
   one entry are dropped where the postings meet. Equal sets are one node;
3. candidates: a few rounds pair the documents of each list with one head or a few, drawn anew in each round (most of a
   group of many near copies gets connected at the cost of a few pairs a document). All other pairs of a list are made
   only between documents that are not yet connected, and only where a pair meets first: a posting knows the shingle that is
   before it in its document, and a pair with the same one has met there. A pair goes on if the positions leave room for the overlap;
4. marks: each set has a bit for about every shingle, set where an odd number of its shingles fall. Two sets differ in as many shingles as bits at
   least, so most candidates that only share a passage are dropped by an exact bound, before any set is read;
5. merging: the sorted short parts of a pair are merged and its occurrences there are counted. Pairs with fewer than the need less L are dropped;
6. probing: for the others, the long parts are looked up by binary search, and the pair is a link if the overlap reaches the need.

A list that is known to be long is dealt out in parts of about ``PART`` postings by its measured size; the heads of its parts are
paired with one of themselves. Links between equal or connected documents need not be found to get the components, so
they are neither all verified nor counted.

Hashes: two words or shingles are taken for one by chance in one of 2^64 pairs, so a set of n shingles lacks one with odds of
n * n / 2^65. Names of sets have 64 bits and are checked against 64 others; names that stand for two sets are made longer before they are used.
Postings carry 48 bits of a shingle, which can only add candidates.

Defined cases: null and empty texts, or texts without words, have an empty set and link with nothing; texts with fewer
words than a shingle have one shingle, the whole sequence; equal doc_ids are one document only if their texts have equal
sets, else their classes are joined; rows with a null id are documents of their own, link like others, and have the least id
that links reach, null if none of these has one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.connect import components
from weftline.sources.staging import Steps

from .common import lean, mix, text_chunks, word_hashes, word_spans

WORDS = 5
SIMILARITY = (3, 4)  # as a fraction, so that all comparisons are exact

#: The long lists that are told apart. A bound on what is sent to tasks (24 bytes each); longer or shorter never changes the result.
LONG_LISTS = 100_000

#: Heads that a list has in each round of pairs with heads. More or fewer never change the result.
HEAD_ROUNDS = (1, 6, 6)

#: Postings of a long list that are kept together.
PART = 128

#: What a step of a binary search costs against writing, sending and sorting one posting: about 4 ns and 1.5 microseconds.
SEARCH_COST = 0.003

#: Keys or pairs (8 or 16 bytes) that are sent to all tasks at once; beyond it both sides of a join are shuffled.
SENT_KEYS = 2_000_000

_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
_LOW = (1 << 48) - 1
_DEALT = 1 << 62  # marks slots of lists that are dealt out
_DROP = np.uint64(16)


def need_of(n: int | np.ndarray, similarity: tuple[int, int]) -> int | np.ndarray:
    """T: how many of its n shingles a set shares with any partner at least."""
    return -(-similarity[0] * n // similarity[1])


def long_lists(n: int, similarity: tuple[int, int], longest: int) -> int:
    """L, the lists of a set of n shingles that are searched instead of merged: T / (1 + cost * log2(longest list)), T - 1 at most."""
    need = need_of(n, similarity)
    return max(0, min(need - 1, int(need / (1 + SEARCH_COST * math.log2(max(2, longest))))))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: (row of each, its hash, start of each row and the end), sorted by row and hash."""
    starts, ends, first = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    rows = len(offsets) - 1
    n_words = np.diff(first)
    row_of = np.repeat(np.arange(rows), n_words)
    total = len(h)
    found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if total >= words:
        rolled = np.zeros(total - words + 1, np.uint64)
        for k in range(words):
            rolled += h[k : total - words + 1 + k] * np.uint64(_ODD[k % 5] + 2 * (k // 5))
        inside = row_of[: total - words + 1] == row_of[words - 1 :]
        found.append(mix(rolled[inside]))
        owner.append(row_of[: total - words + 1][inside])
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            has = n_words[short] > k
            whole[has] += h[first[short[has]] + k] * np.uint64(_ODD[k % 5] + 2 * (k // 5))
        found.append(mix(whole + n_words[short].astype(np.uint64)))
        owner.append(short)
    token, row = np.concatenate(found), np.concatenate(owner)
    key = (row.astype(np.uint64) << np.uint64(48)) | (token >> _DROP)
    order = np.argsort(key)
    key, token, row = key[order], token[order], row[order]
    same = key[1:] == key[:-1]
    if (same & (token[1:] != token[:-1])).any():  # alike in 48 bits only
        order = np.lexsort((token, row))
        token, row = token[order], row[order]
        same = (row[1:] == row[:-1]) & (token[1:] == token[:-1])
    keep = np.concatenate(([True], ~same))[: len(token)]
    token, row = token[keep], row[keep]
    return row, token, np.searchsorted(row, np.arange(rows + 1))


def _sums(token: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    total = np.zeros(len(token) + 1, np.uint64)
    np.cumsum(mix(token ^ np.uint64(salt)), out=total[1:])
    return mix((total[at[1:]] - total[at[:-1]]) ^ np.diff(at).astype(np.uint64))


def _names(token: np.ndarray, at: np.ndarray, bits: int, twice: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(a name of each row's set, 64 other bits of it). Names in ``twice`` (sorted) have the other bits added."""
    name = (_sums(token, at, 0xA5A5A5A5A5A5A5A5) >> np.uint64(64 - bits)).view(np.int64)
    other = _sums(token, at, 0x3C79AC492BA7B653).view(np.int64)
    if twice is not None and len(twice):
        near = np.minimum(np.searchsorted(twice, name), len(twice) - 1)
        name = np.where(twice[near] == name, name ^ other, name)
    return name, other


def _marks(row: np.ndarray, token: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each row one bit or two for each shingle (a power of two, 64 at least): whether an odd number of its shingles fall there."""
    n = np.diff(at)
    bits = 1 << np.ceil(np.log2(np.maximum(64, n))).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(bits)))
    fell = np.bincount(begin[row] + (token & (bits[row] - 1).astype(np.uint64)).astype(np.int64), minlength=int(begin[-1]))
    packed = np.packbits((fell & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


def _near(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keep the pairs (a, b) of (a, b, n of a, mark of a, n of b, mark of b) that can overlap enough: they differ in as many shingles as bits at least."""
        for batch in batches:
            n1, n2 = np.asarray(batch.column(2)), np.asarray(batch.column(4))
            bits = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (3, 5))
                if len(x) != len(y):  # the wider one is folded
                    x, y = sorted((x, y), key=len)
                    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
                bits[i] = np.bitwise_count(x ^ y).sum()
            keep = (num + den) * (n1 + n2 - bits) >= 2 * num * (n1 + n2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _survey(key: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row (key, n, node, other, mark) for each document, and (token, seen) for shingles of several different sets in a stretch of 8 MB of text."""
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def several():
            tokens = np.concatenate(held) if held else np.zeros(0, np.int64)
            value, count = np.unique(tokens, return_counts=True)
            value, count = value[count > 1], count[count > 1]
            none = pa.nulls(len(value), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(value), pa.binary()), pa.array(value), pa.array(count)], names)

        names = [key, "n", "node", "other", "mark", "token", "seen"]
        for batch in batches:
            for part, data, offsets in text_chunks(batch, 1):
                row, token, at = shingle_sets(data, offsets)
                node, other = _names(token, at, bits, None)
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(node), pa.array(other), pa.array(_marks(row, token, at), pa.binary()), none, none], names)
                new = np.array([not (x in seen or seen.add(x)) for x in other.tolist()], bool)
                held.append((token[new[row]] >> _DROP).astype(np.int64))
                size += len(data)
                if size > 8 << 20:
                    yield several()
                    held, size = [], 0
                    seen.clear()
        if held:
            yield several()

    return run


class _Order:
    """The order of the lists, the same for all documents: those that are not known to be long, by hash, then the long ones by size."""

    def __init__(self, token: np.ndarray, seen: np.ndarray) -> None:
        by_size = np.lexsort((token, seen))
        rank = np.empty(len(token), np.int64)
        rank[by_size] = np.arange(1, len(token) + 1)
        at = np.argsort(token)
        self.token, self.rank = token[at], rank[at]
        parts = np.minimum(1 << 13, 1 << np.ceil(np.log2(np.maximum(1, seen[at] / PART))).astype(np.int64))
        self.parts = np.where(seen[at] > PART, parts, 0)
        self.longest = int(seen.max(initial=2))

    def of(self, row: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the tokens' positions in this order, row by row; in how many parts the list of each is dealt, 0 for one that is kept together)."""
        lists = (token >> _DROP).astype(np.int64)
        rank, parts = np.zeros(len(token), np.int64), np.zeros(len(token), np.int64)
        if len(self.token):
            near = np.minimum(np.searchsorted(self.token, lists), len(self.token) - 1)
            hit = self.token[near] == lists
            rank, parts = np.where(hit, self.rank[near], 0), np.where(hit, self.parts[near], 0)
        order = np.argsort((row << np.int64(32)) | rank, kind="stable")
        return order, parts[order]


def _postings(lists: _Order, similarity: tuple[int, int], bits: int, twice: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists of each set that find its partners: (slot, node, meta). A set that the task has met before is left out.

        slot: 48 bits of the token; for a list that is dealt out also ``_DEALT`` and the part. meta: n and the position.
        """
        seen: set[int] = set()
        for batch in batches:
            for _, data, offsets in text_chunks(batch, 0):
                row, token, at = shingle_sets(data, offsets)
                n, (node, _) = np.diff(at), _names(token, at, bits, twice)
                if len(seen) > 500_000:
                    seen.clear()
                new = np.array([not (x in seen or seen.add(x)) for x in node.tolist()], bool) & (n > 0)
                order, parts = lists.of(row, token)
                pos = np.arange(len(token)) - at[row]
                keep = (pos < (n - need_of(n, similarity) + 1)[row]) & new[row]
                own, took, parts = node[row[keep]], (token[order[keep]] >> _DROP).astype(np.int64), parts[keep]
                slot = np.where(parts > 0, took | _DEALT | ((own & np.maximum(parts - 1, 0)) << 48), took)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(own), pa.array(n[row[keep]] << 32 | pos[keep])], ["slot", "node", "meta"])

    return run


def _sets(lists: _Order, similarity: tuple[int, int], bits: int, twice: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, short, long): the sorted hashes of the short and the long lists of each text."""
        sizes: dict[int, int] = {}
        for batch in batches:
            for _, data, offsets in text_chunks(batch, 0):
                row, token, at = shingle_sets(data, offsets)
                order, _ = lists.of(row, token)
                short, long = [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    if b - a not in sizes:
                        sizes[b - a] = long_lists(b - a, similarity, lists.longest)
                    own, middle = token[order[a:b]], b - a - sizes[b - a]
                    short.append(np.sort(own[:middle]).astype("<u8").tobytes())
                    long.append(np.sort(own[middle:]).astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(_names(token, at, bits, twice)[0]), pa.array(short, pa.binary()), pa.array(long, pa.binary())], ["node", "short", "long"])

    return run


def _met(some: np.ndarray, other: np.ndarray) -> int:
    """How many of ``some`` are in ``other`` (both sorted): binary search of the fewer in the more."""
    if len(some) > len(other):
        some, other = other, some
    if not len(some):
        return 0
    return int(np.count_nonzero(other[np.minimum(np.searchsorted(other, some), len(other) - 1)] == some))


def _merged(some: np.ndarray, other: np.ndarray) -> int:
    """How many are in both sorted arrays: the two runs are merged, and equal neighbours are counted."""
    both = np.sort(np.concatenate((some, other)), kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _probe(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keep the pairs (a, b) whose overlap reaches the need: num / den of the union."""
        for batch in batches:
            columns = [batch.column(i) for i in range(2, 6)]
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                s1, l1, s2, l2 = (np.frombuffer(c[i].as_buffer(), "<u8") for c in columns)
                n1, n2 = len(s1) + len(l1), len(s2) + len(l2)
                need = -(-num * (n1 + n2) // (num + den))
                if not min(n1, n2) >= need > 0:
                    continue
                count = _merged(s1, s2)
                if count >= need - max(len(l1), len(l2)):
                    keep[i] = count + _met(l1, s2) + _met(s1, l2) + _met(l1, l2) >= need
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _room(similarity: tuple[int, int], x: Column, y: Column) -> Column:
    """Whether two sets with these ``meta`` that meet first there can overlap enough."""
    num, den = similarity
    n1, n2 = F.shiftright(x, 32), F.shiftright(y, 32)
    p1, p2 = x.bitwiseAND((1 << 32) - 1), y.bitwiseAND((1 << 32) - 1)
    return (F.least(n1 - p1, n2 - p2) * (num + den) >= num * (n1 + n2)) & (F.least(n1, n2) * den >= num * F.greatest(n1, n2))


def _with_heads(rows: DataFrame, r: int, draws: int) -> DataFrame:
    """``rows`` (slot, node, meta, c) with ``heads``: a few nodes of the slot, drawn by hashes of the node, so that lists with the same documents have the same ones."""
    slot = Window.partitionBy("slot")
    drawn = [F.min(F.struct(F.xxhash64("node", F.lit(r), F.lit(j)).alias("draw"), "node", "meta", "c")).over(slot) for j in range(draws)]
    return rows.withColumn("heads", F.array(*drawn))


def _head_pairs(rows: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): each node with the heads of its slot, and the heads of the parts of a list with one of themselves."""
    x, y = F.col("x"), F.col("y")
    own = rows.select(F.struct("node", "meta", "c").alias("x"), F.explode("heads").alias("y"))
    draws = F.transform("heads", lambda h, j: F.struct(j.alias("j"), h.alias("h")))
    tops = rows.where(F.col("slot") >= _DEALT).select("slot", F.explode(F.filter(draws, lambda d: d["h"]["node"] == F.col("node"))).alias("d"))
    tops = tops.select(F.col("d.h").alias("x"), F.min("d.h").over(Window.partitionBy(F.col("slot").bitwiseAND(_LOW), "d.j")).alias("y"))
    met = own.select("x", F.struct("y.node", "y.meta", "y.c").alias("y")).unionByName(tops.select(*(F.struct(f"{v}.node", f"{v}.meta", f"{v}.c").alias(v) for v in "xy")))
    met = met.where((x["c"] != y["c"]) & _room(similarity, x["meta"], y["meta"]))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _open(rows: DataFrame) -> DataFrame:
    """The rows (slot, node, meta, c) of lists with several components."""
    slot = Window.partitionBy("slot")
    rows = rows.withColumns({"c0": F.min("c").over(slot), "c1": F.max("c").over(slot)})
    dealt = rows.where(F.col("slot") >= _DEALT)
    parts = dealt.select("slot", "c0", "c1").distinct()
    whole = Window.partitionBy(F.col("slot").bitwiseAND(_LOW))
    parts = parts.withColumns({"w0": F.min("c0").over(whole), "w1": F.max("c1").over(whole)}).where("w0 != w1").select("slot")
    return rows.where((F.col("slot") < _DEALT) & (F.col("c0") != F.col("c1"))).drop("c0", "c1").unionByName(dealt.drop("c0", "c1").join(parts, "slot", "left_semi"))


def _sent(table: DataFrame) -> DataFrame:
    """A stored table of keys or pairs for a join: sent to all tasks if it is small enough, else left to a shuffle."""
    return F.broadcast(table) if table.count() <= SENT_KEYS else table


class _Verifier:
    """Drops the pairs that cannot overlap enough, reads the sets of the nodes in the others, each once, and keeps the pairs that do."""

    def __init__(self, steps: Steps, keyed: DataFrame, holders: DataFrame, make, similarity: tuple[int, int]) -> None:
        self.steps, self.keyed, self.make, self.similarity = steps, keyed, make, similarity
        self.holders, self.marks = holders.select("node", "key"), holders.select("node", "n", "mark")
        self.sets: DataFrame | None = None

    def _read(self, pairs: DataFrame) -> None:
        """Only the texts of nodes that are new here are read: one for each, by its key."""
        wanted = pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("node"))
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("node"), "node", "left_anti")
        wanted = self.steps.cut(self.holders.join(wanted, "node", "left_semi"), "wanted")
        texts = self.keyed.join(_sent(wanted.select("key")), "key", "left_semi").select("text")
        if not wanted.where("key is null").isEmpty():  # sets that only rows without a key have
            texts = texts.union(self.keyed.where("key is null").select("text"))
        found = texts.mapInArrow(lean(self.make), "node long, short binary, long binary").join(_sent(wanted.select("node")), "node", "left_semi").dropDuplicates(["node"])
        found = self.steps.cut(found, "sets")
        self.sets = found if self.sets is None else self.sets.union(found)

    def links(self, pairs: DataFrame) -> DataFrame:
        a, b = (self.marks.select(F.col("node").alias(v), F.col("n").alias(f"n{v}"), F.col("mark").alias(f"m{v}")) for v in "ab")
        met = a.join(_sent(pairs), "a").join(b.join(_sent(pairs.select("b")), "b", "left_semi"), "b").select("a", "b", "na", "ma", "nb", "mb")
        pairs = self.steps.cut(met.mapInArrow(lean(_near(*self.similarity)), "a long, b long"), "near_pairs")
        self._read(pairs)
        a, b = (self.sets.select(F.col("node").alias(v), F.col("short").alias(f"s{v}"), F.col("long").alias(f"l{v}")) for v in "ab")
        met = a.join(_sent(pairs), "a").join(b.join(_sent(pairs.select("b")), "b", "left_semi"), "b").select("a", "b", "sa", "la", "sb", "lb")
        return self.steps.cut(met.mapInArrow(lean(_probe(*self.similarity)), "a long, b long"), "links")


def jaccard_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY, name_bits: int = 64) -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``docs``: the least key that links reach. ``name_bits``: fewer are for tests."""
    steps = Steps(docs.sparkSession)
    keyed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    survey = steps.cut(keyed.mapInArrow(lean(_survey("key", name_bits)), "key long, n long, node long, other long, mark binary, token long, seen long"), "survey")

    common = survey.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).where("seen >= 4")
    common = common.orderBy(F.desc("seen"), "token").limit(LONG_LISTS).toPandas()  # at most LONG_LISTS rows
    order = _Order(common["token"].to_numpy(np.int64), common["seen"].to_numpy(np.int64))

    named = survey.where("token is null")
    by_name = lambda rows: rows.groupBy("node").agg(F.min("other").alias("o0"), F.max("other").alias("o1"), F.min("key").alias("key"), F.max("n").alias("n"), F.min("mark").alias("mark"))
    names = steps.cut(by_name(named), "names")
    # names that stand for several sets: some dozens among 10^10 sets
    again = np.sort(np.array([r[0] for r in names.where("o0 != o1").select("node").limit(1_000_001).collect()], np.int64))
    if len(again) > 1_000_000:
        raise RuntimeError("the names of sets are too short for this table")
    documents = named.select("key", "n", "node")
    if len(again):
        longer = F.broadcast(docs.sparkSession.createDataFrame([(int(x),) for x in again], "node long").withColumn("more", F.lit(True)))
        node = F.when(F.col("more"), F.col("node").bitwiseXOR(F.col("other"))).otherwise(F.col("node"))
        renamed = named.join(longer, "node", "left").select("key", "n", node.alias("node"), "other", "mark")
        documents, names = renamed.select("key", "n", "node"), steps.cut(by_name(renamed), "names")
    holders = names.where("n > 0").select("node", "key", "n", "mark")
    verifier = _Verifier(steps, keyed, holders, _sets(order, similarity, name_bits, again), similarity)

    postings = keyed.select("text").mapInArrow(lean(_postings(order, similarity, name_bits, again)), "slot long, node long, meta long")
    slot = Window.partitionBy("slot")
    several = postings.withColumns({"low": F.min("node").over(slot), "high": F.max("node").over(slot)}).where((F.col("low") != F.col("high")) | (F.col("slot") >= _DEALT))
    lists = several.drop("low", "high").dropDuplicates(["slot", "node"]).withColumn("c", F.col("node"))
    links = tried = None
    for r, draws in enumerate(HEAD_ROUNDS):
        last, lists = lists, steps.cut(_with_heads(lists, r, draws), "lists")
        pairs = _head_pairs(lists, similarity)
        pairs = steps.cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        found = verifier.links(pairs)
        links, tried = (found, pairs) if links is None else (links.union(found), tried.union(pairs))
        groups = steps.cut(components(links, steps=steps), "groups")
        steps.drop(last)
        last, c = lists, F.coalesce("component", "node").alias("c")
        rows = lists.select("slot", "node", "meta").join(_sent(groups.withColumnRenamed("id", "node")), "node", "left").select("slot", "node", "meta", c)
        lists = _open(rows)

    rows = steps.cut(lists, "open_lists")
    token = F.col("slot").bitwiseAND(_LOW)
    before = F.coalesce(F.lag(token).over(Window.partitionBy("node").orderBy("meta", "slot")), F.lit(-1))
    rows = rows.select("node", "meta", "c", token.alias("token"), before.alias("before"))
    x, y = rows.alias("x"), rows.alias("y")
    meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c"))
    meet &= (F.col("x.before") != F.col("y.before")) | (F.col("x.before") < 0)
    meet &= _room(similarity, F.col("x.meta"), F.col("y.meta"))
    rest = x.join(y, meet).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = verifier.links(steps.cut(rest, "rest_pairs"))

    same = documents.where("n > 0 and key is not null").select("key", "node").distinct()
    several_sets = same.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").select("key", "a")
    repeated = same.join(several_sets, "key").where("a != node").select("a", F.col("node").alias("b"))
    final = components(links.union(more).union(repeated), steps=steps)
    # the least key of each component, then of each node in one, so that documents are joined by node
    linked = steps.cut(final.withColumnRenamed("id", "node").join(holders.select("node", "key"), "node"), "linked")
    least = steps.cut(linked.groupBy("component").agg(F.min("key").alias("least")), "least")
    reached = linked.select("node", "component").join(least, "component").select("node", "least")
    own = steps.cut(holders.select("node", "key").join(reached, "node", "left").select("node", F.coalesce("least", "key").alias("component_id")), "own")
    documents = steps.cut(documents, "documents")
    out = documents.where("n > 0").join(own, "node", "left").select("key", "n", "component_id").unionByName(documents.where("n = 0").select("key", "n", F.col("key").alias("component_id")))
    steps.finish(own, documents)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")

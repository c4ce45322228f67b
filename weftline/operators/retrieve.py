"""From a question to the part of the graph that it is about."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import question_tokens
from weftline.functions.values import final_score
from weftline.operators import automaton
from weftline.operators.ranked import number, pick
from weftline.sources.staging import Steps, cut, utf8_blocks


#: Words, each with its question, that go into one automaton: a few hundred bytes a word in every task.
BLOCK_WORDS = 100_000

#: Pairs of a name and a question that a task holds at once.
BLOCK_PAIRS = 1 << 20


class _Asked:
    """Words of questions as an automaton, with the questions of each word: those of word w are ``asked_by[begin[w]:begin[w + 1]]``, as places in ``ids``."""

    def __init__(self, asked: pa.Table) -> None:
        words, of = np.unique(np.asarray(asked.column("token").to_pylist(), dtype=object), return_inverse=True)
        ids, which = np.unique(np.asarray(asked.column("question_id").to_pylist(), dtype=object), return_inverse=True)
        order = np.argsort(of, kind="stable")
        self.begin, self.asked_by = np.searchsorted(of[order], np.arange(len(words) + 1)), which[order]
        self.ids = pa.array(ids.tolist(), asked.schema.field("question_id").type)
        self.found = automaton.build(words.tolist())

    def seeds(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """From (label, name, confidence, lower-case name): (label, name, confidence, question_id, n_tokens). The rows of a node and a question may be parted, to be added up."""
        questions = max(1, len(self.ids))
        for part, data, offsets in utf8_blocks(batch, 3, automaton.BLOCK_BYTES):
            name, word = self.found.words_in(data, offsets)
            times = self.begin[word + 1] - self.begin[word]
            upto = np.cumsum(times)
            lo = 0
            while lo < len(name):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BLOCK_PAIRS, side="right")))
                t = times[lo:hi]
                at = np.repeat(self.begin[word[lo:hi]] - np.cumsum(t) + t, t) + np.arange(t.sum())
                pair, n = np.unique(np.repeat(name[lo:hi], t) * questions + self.asked_by[at], return_counts=True)
                node, question = np.divmod(pair, questions)
                taken = [part.column(c).take(pa.array(node)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*taken, self.ids.take(pa.array(question)), pa.array(n.astype(np.int64))], ["label", "name", "confidence", "question_id", "n_tokens"])
                lo = hi


def lexical_seeds(questions: DataFrame, nodes: DataFrame, k: int | None = None) -> DataFrame:
    """(question_id, label, name, confidence, n_tokens, score, match): nodes whose name holds a word of the question (VEC-05, FN-13, FN-15).

    questions: question_id, question, as many as there are. Their words go into automata of ``BLOCK_WORDS`` words, built once each and sent to all tasks, which read every node's
    name once for each automaton; nothing is joined. nodes: label, name, confidence; repeated ones count once, a null name holds nothing.
    """
    spark = questions.sparkSession
    asked = cut(questions.where("question_id is not null").select("question_id", F.explode(question_tokens(F.col("question"))).alias("token")).where("token <> ''").distinct(), "words_asked")
    blocks = max(1, -(-asked.count() // BLOCK_WORDS))
    dealt = asked.withColumn("_block", F.pmod(F.xxhash64("token", "question_id"), F.lit(blocks)).cast("int"))
    names = nodes.select("label", "name", "confidence").distinct().withColumn("_low", F.lower("name"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*names.schema.fields[:3], asked.schema["question_id"]])
    found = []
    for b in range(blocks):
        block = spark.sparkContext.broadcast(_Asked(dealt.where(F.col("_block") == b).select("question_id", "token").toArrow()))  # about BLOCK_WORDS rows
        found.append(names.mapInArrow(lambda batches, block=block: (out for batch in batches for out in block.value.seeds(batch)), f"{kinds}, n_tokens long"))
    hits = reduce(DataFrame.unionByName, found).groupBy("question_id", "label", "name", "confidence").agg(F.sum("n_tokens").alias("n_tokens"))
    out = hits.withColumns({"score": F.lit(1.0), "match": F.lit("lexical_exact")})
    return out if k is None else number(out, ["question_id"], [F.desc("n_tokens"), F.asc("label"), F.asc("name")], "_n", k).drop("_n")


VECTOR_BLOCK, QUERY_BLOCK = 8192, 1024


def _units(column: pa.ChunkedArray, at: np.ndarray) -> np.ndarray:
    """Rows of one length as unit vectors in double precision; those without a length are NaN."""
    x = np.array(column.take(pa.array(at)).to_pylist(), np.float64)
    size = np.sqrt((x * x).sum(1))
    return x / np.where(size > 0, size, np.nan)[:, None]


def _nearest(k: int, digits: int):
    def run(_, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        """The k best vectors of this block for each query: one product of matrices for each length of vector."""
        vectors = vectors.sort_by("id")
        nq, nv = (np.asarray(pc.fill_null(pc.list_value_length(t.column(c)), -1)) for t, c in ((queries, "query"), (vectors, "vector")))
        which, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for n in np.intersect1d(nq[nq > 0], nv):
            q, v = np.flatnonzero(nq == n), np.flatnonzero(nv == n)
            near = _units(queries.column("query"), q) @ _units(vectors.column("vector"), v).T
            near = np.sign(near) * np.floor(np.abs(near) * 10**digits + 0.5) / 10**digits
            for i, row in enumerate(near):
                best = np.argsort(-row, kind="stable")[:k]  # by id among equals; NaN comes last
                best = best[~np.isnan(row[best])]
                which.append(np.full(len(best), q[i]))
                found.append(v[best])
                scores.append(row[best])
        at = [pa.array(np.concatenate(x)) for x in (which, found)]
        return pa.table({"query_id": queries.column("query_id").take(at[0]), "id": vectors.column("id").take(at[1]), "score": pa.array(np.concatenate(scores))})

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 4) -> DataFrame:
    """(query_id, id, score, rank): the k nearest by cosine, rounded, ties to the smaller id (VEC-01, SRT-01).

    queries: query_id, query (vector); vectors: id, vector. Vectors of other lengths are not compared (VEC-02), those that are null or
    without length not at all. Both sides are dealt into blocks of bounded size; a task multiplies one block of each, and only the best k of a block go on.
    """
    n, m = vectors.count(), queries.count()
    groups, parts = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    side = lambda df, key, count, name: df.withColumn(name, F.pmod(F.xxhash64(key, F.lit(count)), F.lit(count)).cast("int"))
    every = lambda df, count, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    q = every(side(queries.select("query_id", "query"), "query_id", parts, "part"), groups, "block").groupBy("part", "block")
    v = every(side(vectors.select("id", "vector"), "id", groups, "block"), parts, "part").groupBy("part", "block")
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    return number(q.cogroup(v).applyInArrow(_nearest(k, digits), kinds), ["query_id"], [F.desc("score"), F.asc("id")], "rank", k)


def ranked(hits: DataFrame) -> DataFrame:
    """Hits (question_id, label, name, score, confidence, match, status), the best of each node, with their final score (AGG-23, VEC-06, FN-23, FLT-06)."""
    active = hits.where(F.coalesce("status", F.lit("ACTIVE")) != "DEPRECATED")
    scored = active.withColumn("final_score", final_score(F.col("score"), F.col("confidence"), F.col("match")))
    return pick(scored.withColumn("_key", F.lower("name")), ["question_id", "label", "_key"], [-F.col("final_score"), F.col("name"), F.col("match")]).drop("_key")


def best_artifacts(artifacts: DataFrame, key: list[str]) -> DataFrame:
    """The most confident artifact of each key (AGG-24)."""
    return pick(artifacts, key, [-F.coalesce(F.col("confidence"), F.lit(0.0)), *(F.col(c) for c in artifacts.columns if c not in key)])


def term_expansion(terms: DataFrame, hits: DataFrame, most: int = 3) -> DataFrame:
    """(question_id, code, vocabulary, ambiguous): the vocabularies of a term that was hit, at most ``most`` by name (VEC-10, SRT-04)."""
    met = hits.select("question_id", F.col("name").alias("code")).join(terms.select("code", "vocabulary").distinct(), "code")
    many = met.groupBy("question_id", "code").agg((F.count("*") > 1).alias("ambiguous"))
    return number(met, ["question_id", "code"], [F.asc("vocabulary")], "_n", most).drop("_n").join(many, ["question_id", "code"])


def governed_values(values: DataFrame) -> DataFrame:
    """(property, column, table, vocabulary, ambiguous, values): the values that a property may have, as sorted lists (AGG-27)."""
    return values.groupBy("property", "column", "table", "vocabulary", "ambiguous").agg(F.array_sort(F.collect_set(F.struct("code", "label"))).alias("values"))


def context(entities: DataFrame, joins: DataFrame, values: DataFrame, most_entities: int = 10, most_joins: int = 20) -> DataFrame:
    """One row for each question: its entities, join paths and governed values as lists (VEC-11, AGG-28, SRT-03)."""
    e = number(entities, ["question_id"], [F.desc("confidence"), F.asc("entity")], "_n", most_entities)
    e = e.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("_n", "entity", "confidence"))).alias("entities"))
    j = number(joins, ["question_id"], [F.desc("confidence"), F.asc("path")], "_n", most_joins)
    j = j.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("_n", "path"))).alias("paths"))
    v = values.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("property", "code"))).alias("values"))
    return e.join(j, "question_id", "left").join(v, "question_id", "left")


#: For each number of deletions, the longest names that are indexed by them: about 2,000 keys a name at most.
INDEXED = {1: 2000, 2: 62, 3: 23}

#: Names that one slice of the last round has.
SLICE = 10_000

#: Words or names that one task takes apart or compares: a few bytes each, but thousands of keys.
TASK_NAMES = 2_000

#: So few words are compared with all names after one round: that costs less than the keys of all names with more deletions.
FEW_WORDS = 1_000

#: Rows of the last round's words, once for each slice, that are sent to all tasks at most.
SENT_WORDS = 200_000


def _spread(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows, few bytes and so few files, dealt out to tasks of ``TASK_NAMES``."""
    return rows.repartition(max(1, -(-n // TASK_NAMES)))


def _deletions(text: str, d: int) -> str:
    """SQL: all texts that are left of ``text`` when 0 to ``d`` of its characters are deleted, each once."""
    level = kept = f"array({text})"
    for _ in range(d):
        level = f"array_distinct(flatten(transform({level}, t -> transform(sequence(1, greatest(length(t), 1)), i -> concat(substr(t, 1, i - 1), substr(t, i + 1))))))"
        kept = f"concat({kept}, {level})"
    return f"array_distinct({kept})"


def suggestions(wrong: DataFrame | list[str], known: DataFrame, k: int = 3) -> DataFrame:
    """(wrong, known, distance, n): the k names nearest by edits, upper and lower case alike, ties to the smaller name (FN-22, SRT-06).

    wrong: the words asked about, as a list or a column ``wrong``; known: a column ``known``. Words and names that are d edits apart have a text in common when both lose up to d
    characters, so names are found by an equality, with d growing until a word has k names or few words are left. Only words that still lack some after that, or are too long to be
    indexed, are compared with all names, slice by slice. Repeated words and names count once; nulls take no part.
    """
    spark = known.sparkSession
    if isinstance(wrong, list):
        wrong = spark.createDataFrame([(w,) for w in wrong], "wrong string")
    steps = Steps(spark)
    names = steps.cut(known.where("known is not null").select("known", F.lower("known").alias("name")).distinct(), "names")
    left = steps.cut(wrong.where("wrong is not null").select("wrong", F.lower("wrong").alias("word")).distinct(), "words")
    n_names, n_left, done = names.count(), left.count(), []
    for d, longest in INDEXED.items():
        if d > 1 and n_left <= FEW_WORDS:
            break
        fits = F.length("word") + d <= longest
        asked = _spread(left.where(fits), n_left).select("wrong", "word", F.explode(F.expr(_deletions("word", d))).alias("key"))
        index = _spread(names.where(F.length("name") <= longest), n_names).select("known", "name", F.explode(F.expr(_deletions("name", d))).alias("key"))
        # by size of file either side could be sent, but it is that of the keys that counts; -1: more than d edits
        near = asked.join(index.hint("merge"), "key").select("wrong", "known", F.levenshtein("word", "name", d).alias("distance")).where("distance >= 0").distinct()
        best = steps.cut(number(near, ["wrong"], [F.asc("distance"), F.asc("known")], "n", k), f"within_{d}")
        whole = steps.cut(best.where(F.col("n") == k).select("wrong"), "settled")
        done.append(best.join(whole, "wrong", "left_semi"))
        left = steps.cut(left.join(whole, "wrong", "left_anti"), "words")
        n_left = left.count()
    slices = max(1, -(-n_names // SLICE))
    asked = left.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    asked = F.broadcast(asked) if n_left * slices <= SENT_WORDS else asked
    dealt = _spread(names, n_names).withColumn("slice", F.pmod(F.xxhash64("known"), F.lit(slices)).cast("int"))
    far = asked.join(dealt, "slice").select("wrong", "known", F.levenshtein("word", "name").alias("distance"))
    done.append(number(far, ["wrong"], [F.asc("distance"), F.asc("known")], "n", k))
    return reduce(DataFrame.unionByName, done).select("wrong", "known", "distance", "n")


def unknown_references(references: DataFrame, catalog: DataFrame) -> DataFrame:
    """(table, column) that a query speaks of and the catalog lacks; null columns stand for the table alone (FLT-17)."""
    tables, columns = catalog.select("table").distinct(), catalog.select("table", "column").distinct()
    no_table = references.join(tables, "table", "left_anti")
    return no_table.unionByName(references.where("column is not null").join(columns, ["table", "column"], "left_anti").join(tables, "table", "left_semi")).distinct()


def stale_embeddings(nodes: DataFrame) -> DataFrame:
    """Nodes without an embedding, or with one of another text (VEC-03, FN-05)."""
    return nodes.where(F.col("embedding").isNull() | ~F.col("description_hash").eqNullSafe(F.sha2("description", 256)))

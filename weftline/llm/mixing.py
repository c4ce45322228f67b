"""Mixing sources to target weights by hierarchical budgets, with DataFrame operations only.

The sources form a tree: domain, language, source. The root's budget goes down the tree by the weights of the children. A
child cannot take more than its supply (the tokens under it times the epochs allowed); what it leaves goes to its siblings by
their weights, and only what no sibling can take goes back up, since a node never gets more than all its leaves
together can take: shortages are made good among siblings before ancestors. All children of all nodes of a level are
settled together: sorted by supply per weight, those that are filled are a prefix, found by running sums.

A leaf's budget buys whole epochs and the prefix of one more. The order in an epoch is that of a digest of seed, epoch and
key, so it is the same anywhere. The prefix ends before the first document that would pass the budget: sums by ranges of
the digest find the range in which it ends, and only the documents of that range are ordered. A hot leaf is thus many
groups, none of which holds more than about one part in ``RANGES`` of it.

All amounts are whole numbers. Shares are rounded down, so the children of a node may take fewer tokens than it has by less
than their number.

Defined cases: null and empty texts have 0 tokens and are taken if an epoch's prefix reaches them; null names of
tree levels are a branch of their own; branches without a weight, or with a null or negative one, get nothing;
repeated rows are documents of their own; an empty table gives an empty result; all columns of the documents are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps, own_name

RANGES = 4096  # of the digest, for each leaf

_SHIFT = 60 - RANGES.bit_length() + 1


def count_words(text: str = "text") -> Column:
    """Tokens as words ``[^\\x20\\x09-\\x0D]+``."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _big(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def settle(children: DataFrame, parent: list[str]) -> DataFrame:
    """``children`` (the columns ``parent``, others, weight, supply, given) with ``budget``: the parts of ``given``, which is that of the parent."""
    names = [c for c in children.columns if c not in ("weight", "supply", "given")]
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = whole.orderBy(F.col("supply") / F.col("weight"), *names)
    rows = children.where("weight > 0").select(
        "*",
        F.coalesce(F.sum("supply").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_used"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("_weights"),
        F.row_number().over(order).alias("_n"),
    )
    rows = rows.withColumn("_left", F.greatest(F.col("given") - F.col("_used"), F.lit(0)))
    filled = _big(F.col("supply")) * _big(F.col("_weights")) <= _big(F.col("_left")) * _big(F.col("weight"))
    # the first child that is not filled fixes what the weights of it and the later ones are worth
    level = F.min(F.when(~filled, F.struct("_n", "_left", "_weights"))).over(whole)
    rows = rows.withColumn("_level", level)
    share = F.expr("cast(cast(weight as decimal(20,0)) * cast(_level._left as decimal(20,0)) div cast(_level._weights as decimal(20,0)) as bigint)")
    budget = F.when(F.col("_level").isNull() | (F.col("_n") < F.col("_level._n")), F.col("supply")).otherwise(F.least(share, F.col("supply")))
    return rows.withColumn("budget", budget.cast("long")).select(*names, "weight", "supply", "budget")


def leaf_budgets(leaves: DataFrame, path: list[str], weights: list[Column], budget: int, epochs: int) -> DataFrame:
    """``leaves`` (the columns ``path``, tokens) with ``budget``. ``weights``: for each level, an expression over the path."""
    given: DataFrame | None = None
    for depth in range(1, len(path) + 1):
        own = path[:depth]
        nodes = leaves.groupBy(*own).agg((F.sum("tokens") * epochs).alias("supply")).withColumn("weight", F.coalesce(weights[depth - 1].cast("long"), F.lit(0)))
        if given is None:
            nodes = nodes.withColumn("given", F.lit(budget).cast("long"))
        else:
            above = given.select(*(F.col(c).alias(f"_{c}") for c in path[: depth - 1]), F.col("budget").alias("given"))
            nodes = nodes.join(above, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in path[: depth - 1]]).select(*own, "supply", "weight", "given")
        given = settle(nodes, path[: depth - 1])
    return given.select(*path, "budget")


def digest(key: Column, epoch: Column, seed: int) -> Column:
    """60 bits that order an epoch."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string"))), 1, 15), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame, path: dict[str, Column], weights: list[Column], *, budget: int | None = None, share: float = 1.0, epochs: int = 1, seed: int = 1, key: str = "doc_id", tokens: Column | None = None
) -> DataFrame:
    """The rows of ``docs`` chosen for the mix, one row for each time a document is taken, with the names on its path (as ``_domain``), ``_tokens`` and ``_epoch`` (from 0).

    path: the tree's levels, names and expressions; weights: whole numbers for the nodes of each level, over columns of
    these names; budget: tokens in all, by default the part ``share`` of those in ``docs``; epochs: how often a document may be taken.
    Rows that share a key are in the order of a digest of all their columns.
    Where ``docs`` has such a column itself, the added one has another ``_`` in front.
    """
    tokens = count_words() if tokens is None else tokens
    levels = [f"l{i}" for i in range(len(path))]
    own = [F.col(f"`{key}`").alias("key"), *(e.alias(n) for n, e in zip(levels, path.values())), tokens.alias("tokens")]
    steps = Steps(docs.sparkSession)
    sized = steps.cut(docs.select(*own), "sizes")
    leaves = steps.cut(sized.groupBy(*levels).agg(F.sum("tokens").alias("tokens")), "leaves")
    if budget is None:
        budget = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * share)
    plan = leaf_budgets(leaves.toDF(*path, "tokens"), [*path], weights, budget, epochs).toDF(*levels, "budget")
    plan = plan.join(leaves, [plan[n].eqNullSafe(leaves[n]) for n in levels]).select(*(plan[n] for n in levels), "budget", "tokens")
    plan = plan.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.expr("budget div tokens"))).otherwise(0).cast("int"))
    plan = steps.cut(plan.select(*levels, "full", (F.col("budget") - F.col("full") * F.col("tokens")).alias("rest")), "leaf_plan")

    def beside(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
        """``rows`` with the columns of ``table`` for their leaf."""
        named = table.withColumnsRenamed({n: f"own_{n}" for n in levels})
        return rows.join(named, [F.col(n).eqNullSafe(F.col(f"own_{n}")) for n in levels], how).drop(*(f"own_{n}" for n in levels))

    def placed(rows: DataFrame) -> DataFrame:
        return beside(rows, plan, "inner").withColumn("digest", digest(F.col("key"), F.col("full"), seed)).withColumn("range", F.shiftright("digest", _SHIFT).cast("int"))

    sums = placed(sized).groupBy(*levels, "rest", "range").agg(F.sum("tokens").alias("sum"))
    upto = F.sum("sum").over(Window.partitionBy(*levels).orderBy("range"))  # at most ``RANGES`` rows a leaf
    ends = sums.withColumn("upto", upto).where("upto > rest").groupBy(*levels).agg(F.min(F.struct("range", (F.col("upto") - F.col("sum")).alias("before"))).alias("end"))
    ends = steps.cut(ends.select(*levels, F.col("end.range").alias("end"), F.col("end.before").alias("before")), "prefix_ends")
    steps.finish(plan, ends)

    rows = beside(placed(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *own)), ends, "left")
    more = F.when(F.col("end").isNull() | (F.col("range") < F.col("end")), 1).otherwise(0)
    whole = rows.withColumn("times", F.col("full") + more).where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    running = F.sum("tokens").over(Window.partitionBy(*levels).orderBy("digest", "key", F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, 0))
    edge = rows.where(F.col("range") == F.col("end")).withColumn("running", F.col("before") + running).where("running <= rest").withColumn("epoch", F.col("full"))
    names = {n: own_name(p, docs.columns) for n, p in [*zip(levels, path), ("tokens", "tokens"), ("epoch", "epoch")]}
    out = [F.col("row.*"), *(F.col(n).alias(name) for n, name in names.items())]
    return whole.select(*out).unionByName(edge.select(*out))

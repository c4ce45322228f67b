"""Exact dedup: rows grouped by a 128-bit digest of their normalised text, with the bytes compared inside every group.

No group is gathered anywhere. All of a group is told by grouped minima, maxima and counts, which combine before the shuffle: its
texts are equal when the least and the largest are the same bytes, so a group with a third of all rows costs a task one text. Digests that
different texts share (none, unless somebody made them) are grouped once more by the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.staging import Steps

#: A group is hot if it has more than this part of all rows. So there are at most so many hot groups, whatever the input, and they can be sent to all tasks.
HOT_PART = 1000


def without_space(text: Column) -> Column:
    """The text without 0x20 and 0x09 to 0x0D; null is empty."""
    text = F.coalesce(text, F.lit(""))
    for c in " \t\n\v\f\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digest128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _best(size: str, id_: str) -> Column:
    """The row that stays: most code points, then the smallest id; a row without an id only if no other has as many code points."""
    return F.min(F.struct((-F.col(size)).alias("less"), F.col(id_).isNull().alias("nameless"), F.col(id_).alias("id")))


def exact_groups(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", normal: Callable[[Column], Column] = without_space, digest: Callable[[Column], Column] = digest128) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256): a row for each row of ``docs``, in groups of equal normalised texts.

    ``keep_id`` is the id of the row that stays: the one with the most code points in its own text, ties to the smallest id; ``group_size`` counts rows.
    A null text is an empty one. A null id is larger than any other, so ``keep_id`` is null only where all rows with the most code points have none. Repeated rows
    are rows of their group, and one row of each group is kept, also among rows with the same id. Other columns take no part, whatever
    their names; an empty table gives an empty result. ``digest`` may be any function of the normalised text: the groups do not depend on it.
    """
    steps = Steps(docs.sparkSession)
    body = normal(F.col(text))
    rows = docs.select(F.col(id_).alias("id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("points"), body.alias("body")).withColumn("digest", digest(F.col("body")))
    # One row for all with the same id, text length and digest. They can only differ in their white space, and the result cannot tell them apart.
    seen = rows.groupBy("digest", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), "id", "points").agg(F.count("*").alias("times"))
    seen = steps.cut(seen, "rows")
    mixed = rows.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("most")).where("least <> most").select("digest")
    mixed = steps.cut(mixed, "mixed_digests")
    if mixed.isEmpty():
        return _placed(seen, ["digest"], id_)
    odd = rows.join(mixed, "digest", "left_semi").groupBy("digest", "body", "id", "points").agg(F.count("*").alias("times"))
    odd = odd.withColumn("text_sha256", F.sha2(F.col("body").cast("binary"), 256))
    even = _placed(seen.join(mixed, "digest", "left_anti"), ["digest"], id_)
    return even.unionByName(_placed(steps.cut(odd, "odd_rows"), ["digest", "body"], id_))


def _placed(seen: DataFrame, key: list[str], id_: str) -> DataFrame:
    """The result's rows; ``key`` names the columns that equal texts, and no others, share.

    Hot groups, which are at most ``HOT_PART``, go to all tasks; those of one row are answered where they are met, like all others, by a join on the key.
    """
    groups = seen.groupBy(*key).agg(F.sum("times").alias("group_size"), _best("points", "id").alias("best"))
    total = seen.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    is_hot = F.col("group_size") * HOT_PART > total
    hot = groups.where(is_hot).select(*key, F.col("group_size").alias("hot_size"), F.col("best").alias("hot_best"))
    dealt = seen.join(F.broadcast(hot), key, "left")
    answered = dealt.where("hot_size is not null").select(*seen.columns, F.col("hot_size").alias("group_size"), F.col("hot_best").alias("best"))
    others = dealt.where("hot_size is null").select(*seen.columns).join(groups.where(~is_hot), key)
    both = answered.unionByName(others.select(*answered.columns))
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("points") == -F.col("best.less"))
    each = both.withColumn("stays", stays).select("*", F.posexplode(F.sequence(F.lit(1), F.col("times"))).alias("nth", "_"))
    return each.select(F.col("id").alias(id_), F.col("best.id").alias("keep_id"), "group_size", (F.col("stays") & (F.col("nth") == 0)).alias("kept"), "text_sha256")

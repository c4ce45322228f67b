"""The append-only status log as a stream, and windowed counts of events with late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.ranked import pick
from weftline.sources.scoped import KeyedTable


def follow_status(log: DataFrame, table: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep in ``table`` the last event (by seq) of each id of a stream (id, status, seq) (D5). Events may come late, twice or out of order; those without an id are left out.

    The table is dealt by a hash of the id in ``buckets`` parts, fixed when it is made. A batch reads and replaces the parts that its ids are in and
    no other; a batch that is run again gives the same rows.
    """

    def merge(batch: DataFrame, _: int) -> None:
        stored = KeyedTable(batch, table, ["id"], parts=buckets, buckets=1)
        stored.merge(batch, [-F.col("seq"), F.col("status")], F.col("new.seq") > F.col("old.seq"))

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): counts and sums by window; windows close ``late`` after their end, and their state goes."""
    timed = events.withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def follow_windows(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each window of ``windowed_counts`` to the files of ``path`` when it closes, once; then its state goes. Events of a window that has closed are dropped."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_changes(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to the files of ``path`` the events of a stream (id, status, seq) that are newer than all before them of their id (D5); ``newest`` reads the last of each.

    The newest event of each id is kept as state of a grouped minimum, with the time of the batch that brought it, so a batch reads nothing that was written; late and repeated events
    leave an older time there and add nothing. The state is a row for each id and stays; it is in RocksDB, so it need not fit in memory. A batch is a folder, written anew if it is run again.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    spark = log.sparkSession
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, store)
    try:
        best = F.struct((-F.col("seq")).alias("_o"), "at", F.col("status").isNull().alias("_none"), "status", F.col("seq").cast("long").alias("seq"))
        kept = log.where("id is not null and seq is not null").withColumn("at", F.current_timestamp()).groupBy("id").agg(F.min(best).alias("best"))
        newer = kept.where(F.col("best.at") == F.current_timestamp()).select("id", "best.status", "best.seq")
        return newer.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def newest(changes: DataFrame) -> DataFrame:
    return pick(changes.select("id", "status", "seq"), ["id"], [-F.col("seq"), F.col("status")])

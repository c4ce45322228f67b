"""Streams over the events table: the last status of each id, and counts by window."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.queries.base import query, table
from weftline.sources.staging import cut, new_path
from weftline.streaming import events


@query("""SELECT user_id AS id, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY user_id""")
def status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5, SRC-30: two batches, each with old and new events, merged into a table."""
    log, name = new_path(spark, "log"), f"status_{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    try:
        for part in (1, 0):
            rows.where(F.col("seq") % 2 == part).write.mode("append").parquet(log)
            events.follow_status(spark.readStream.schema(rows.schema).parquet(log), name, new_path(spark, "follow"), buckets=8).awaitTermination()
        spark.catalog.refreshTable(name)
        return cut(spark.read.table(name).select("id", "status", "seq"), "statuses")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@query("""SELECT user_id AS id, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY user_id""")
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5: the same by state: three batches, the second older than the first, the third a repetition of both; what was written is never read by the stream."""
    log, out, at = new_path(spark, "log"), new_path(spark, "changes"), new_path(spark, "follow")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    for part in (F.col("seq") % 2 == 1, F.col("seq") % 2 == 0, F.lit(True)):
        rows.where(part).write.mode("append").parquet(log)
        events.follow_changes(spark.readStream.schema(rows.schema).parquet(log), out, at).awaitTermination()
    return events.newest(spark.read.schema("id long, status string, seq long").parquet(out))


@query("""WITH e AS (SELECT ts, event_type, event_id % 50 = 7 AS late, date_trunc('day', ts) AS start FROM events), seen AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM e WHERE NOT late), final AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM e)
    SELECT start, event_type, count(*) AS n FROM e WHERE (NOT late OR start + INTERVAL 1 DAY > (SELECT mark FROM seen)) AND start + INTERVAL 1 DAY <= (SELECT mark FROM final) GROUP BY ALL""")
def window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day, as a stream that appends a day when it closes: events come in three parts, the last of them too late for all but the open days."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "event_id")
    late = F.col("event_id") % 50 == 7
    log, out, at = new_path(spark, "log"), new_path(spark, "windows"), new_path(spark, "follow")
    middle = rows.where(~late).agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0] or 0
    first = F.unix_micros("ts") <= middle
    for part in (~late & first, ~late & ~first, late):
        rows.where(part).drop("event_id").write.mode("append").parquet(log)
        counts = events.windowed_counts(spark.readStream.schema(rows.drop("event_id").schema).parquet(log), "1 day", "1 hour")
        events.follow_windows(counts, out, at).awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n long, total double").parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")

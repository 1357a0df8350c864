"""Structured Streaming operators over the events table, run to the end of their input and read back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.storage import application_folder
from ..plans.suite import query, table

SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def folder(spark: SparkSession) -> str:
    """A new folder for checkpoints and sinks, where all executors see it."""
    return f"{application_folder(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events table as a stream of files, with ``time`` to the microsecond as a timestamp of the session's zone."""
    glob = "events.parquet"
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{glob}*")
    return stream.withColumn("time", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has written when its input ends, from a Parquet sink or, for other modes than append, by batches."""
    spark, top = stream.sparkSession, folder(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{top}/checkpoint")
    if mode == "append":
        writer.format("parquet").option("path", f"{top}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{top}/out")

    def save(batch: DataFrame, number: int) -> None:
        # A folder a batch: one that is run again after a failure replaces what it has written.
        batch.write.mode("overwrite").parquet(f"{top}/out/__batch={number}")

    writer.foreachBatch(save).start().awaitTermination()
    out = spark.read.parquet(f"{top}/out")
    if mode == "complete":  # each batch holds everything
        last = out.agg(F.max("__batch")).first()[0]
        return out.where(F.col("__batch") == last).drop("__batch")
    return out


@query("SELECT event_id, user_id, value * 2 AS twice FROM events WHERE event_type = 'click' OR value > 50")
def stream_project_filter(spark, sf):
    s = event_stream(spark, sf).where((F.col("event_type") == "click") | (F.col("value") > 50))
    return finished(s.select("event_id", "user_id", (F.col("value") * 2).alias("twice")), "append")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_aggregate_complete(spark, sf):
    s = event_stream(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return finished(s, "complete")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id")
def stream_aggregate_update(spark, sf):
    """Every change of a count; the last one of each user is its count."""
    out = finished(event_stream(spark, sf).groupBy("user_id").agg(F.count("*").alias("n")), "update")
    return out.groupBy("user_id").agg(F.max_by("n", "__batch").alias("n"))


_W = "SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS w, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1"


@query(_W)
def stream_window_tumbling(spark, sf):
    s = event_stream(spark, sf).withWatermark("time", "10 minutes").groupBy(F.window("time", "1 hour")).agg(F.count("*").alias("n"))
    return finished(s.select(F.unix_timestamp("window.start").alias("w"), "n"), "complete")


@query("SELECT w, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(floor(epoch(ts) / 1800) AS BIGINT) * 1800 - 1800 * k AS w FROM events, (VALUES (0), (1)) v(k)) t GROUP BY w")
def stream_window_sliding(spark, sf):
    s = event_stream(spark, sf).withWatermark("time", "10 minutes").groupBy(F.window("time", "1 hour", "30 minutes")).agg(F.count("*").alias("n"))
    return finished(s.select(F.unix_timestamp("window.start").alias("w"), "n"), "complete")


@query()
def stream_window_append(spark, sf):
    """Only windows that the watermark has closed are written."""
    s = event_stream(spark, sf).withWatermark("time", "0 seconds").groupBy(F.window("time", "1 hour")).agg(F.count("*").alias("n"))
    return finished(s.select(F.unix_timestamp("window.start").alias("w"), "n"), "append")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicate(spark, sf):
    return finished(event_stream(spark, sf).select("user_id", "event_type").dropDuplicates(), "append")


@query("SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def stream_static_join(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    s = event_stream(spark, sf)
    return finished(s.join(c, s["user_id"] == c["c_custkey"]).select("event_id", "c_mktsegment"), "append")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM events")
def stream_union(spark, sf):
    a = event_stream(spark, sf)
    both = a.where("value > 10").select("event_id").union(event_stream(spark, sf).where("NOT value > 10").select("event_id"))
    return finished(both, "append").agg(F.count("*").alias("n"))


def running(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Count and sum of a user so far."""
    n, total = state.get if state.exists else (0, 0.0)
    for b in batches:
        n, total = n + len(b), total + float(b["value"].sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 2)]})


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def stream_stateful(spark, sf):
    """Arbitrary state a user; the last row of each is its result."""
    s = event_stream(spark, sf).select("user_id", "value").groupBy("user_id")
    out = finished(s.applyInPandasWithState(running, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout), "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def stream_memory_sink(spark, sf):
    name = f"pm_{uuid.uuid4().hex}"
    s = event_stream(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))
    s.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{folder(spark)}/checkpoint").start().awaitTermination()
    return spark.table(name)


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM events")
def stream_foreach_batch(spark, sf):
    """Micro-batches written by a function, as a custom sink would."""
    return finished(event_stream(spark, sf).select("event_id"), "update").agg(F.count("*").alias("n"))


@query("SELECT CAST(1 AS BIGINT) AS batches, CAST(count(*) AS BIGINT) AS n FROM events")
def stream_progress(spark, sf):
    """Rows read, as the query's own progress reports them."""
    top = folder(spark)
    q = event_stream(spark, sf).select("event_id").writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [int(p["numInputRows"]) for p in q.recentProgress if int(p["numInputRows"])]
    return spark.createDataFrame([(len(rows), sum(rows))], "batches long, n long")


@query()
def stream_rate(spark, sf):
    """The generating source, a few rows of it."""
    name = f"pm_{uuid.uuid4().hex}"
    q = spark.readStream.format("rate").option("rowsPerSecond", 50).load().writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder(spark)}/checkpoint").start()
    q.awaitTermination(3)
    q.stop()
    return spark.table(name).select("value")


@query("SELECT DISTINCT event_id FROM events")
def stream_deduplicate_watermark(spark, sf):
    """State of seen keys is dropped as the watermark passes them."""
    s = event_stream(spark, sf).withWatermark("time", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    return finished(s.select("event_id"), "append")


@query("SELECT 'progress,started,terminated' AS heard, CAST(count(*) AS BIGINT) AS n FROM events")
def stream_listener(spark, sf):
    """What a listener hears of a query: its events, and the rows that its progress reports."""
    import threading

    from pyspark.sql.streaming import StreamingQueryListener

    class Ears(StreamingQueryListener):
        def __init__(self):
            self.heard, self.rows, self.over = set(), 0, threading.Event()

        def onQueryStarted(self, event):
            self.heard.add("started")

        def onQueryProgress(self, event):
            self.heard.add("progress")
            self.rows += event.progress.numInputRows

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            self.heard.add("terminated")
            self.over.set()

    ears = Ears()
    spark.streams.addListener(ears)
    try:
        finished(event_stream(spark, sf).select("event_id"), "append")
        ears.over.wait(60)
    finally:
        spark.streams.removeListener(ears)
    return spark.createDataFrame([(",".join(sorted(ears.heard)), ears.rows)], "heard string, n long")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def stream_partitioned_sink(spark, sf):
    """A file sink with a folder a value, read back by its log of committed files."""
    top = folder(spark)
    s = event_stream(spark, sf).select("event_id", "event_type")
    s.writeStream.format("parquet").partitionBy("event_type").option("path", f"{top}/out").option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{top}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'click' GROUP BY user_id")
def stream_restart(spark, sf):
    """A query started twice on one checkpoint reads its input once."""
    top = folder(spark)
    for _ in range(2):
        s = event_stream(spark, sf).where("event_type = 'click'").select("user_id")
        s.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{top}/out").groupBy("user_id").agg(F.count("*").alias("n"))

"""More of Structured Streaming: joins of streams, sessions, sockets, triggers and sinks."""

from __future__ import annotations

import socketserver
import threading
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.suite import query, table
from .queries import event_stream, finished, folder


@query("""
SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR
WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def stream_stream_join(spark, sf):
    """Two streams joined by key within an hour; the watermarks bound what is kept of either."""
    a = event_stream(spark, sf).where("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("user_id").alias("u"), F.col("time").alias("at")).withWatermark("at", "1 hour")
    b = event_stream(spark, sf).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), F.col("user_id").alias("v"), F.col("time").alias("then")).withWatermark("then", "1 hour")
    near = (F.col("u") == F.col("v")) & (F.col("then") >= F.col("at")) & (F.col("then") <= F.col("at") + F.expr("INTERVAL 1 HOUR"))
    return finished(a.join(b, near).select("click", "purchase"), "append")


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
     s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, n, CAST(count(*) AS BIGINT) AS sessions FROM (SELECT user_id, session, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2) t GROUP BY 1, 2""")
def stream_sessions(spark, sf):
    """Sessions that end after two hours of silence; how many each user has of each length."""
    s = event_stream(spark, sf).withWatermark("time", "2 hours").groupBy("user_id", F.session_window("time", "2 hours")).agg(F.count("*").alias("n"))
    return finished(s.select("user_id", "n"), "complete").groupBy("user_id", "n").agg(F.count("*").alias("sessions"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def stream_processing_time(spark, sf):
    """A query that runs at intervals until it is stopped."""
    name = f"pm_{uuid.uuid4().hex}"
    s = event_stream(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))
    q = s.writeStream.format("memory").queryName(name).outputMode("complete").trigger(processingTime="1 second").option("checkpointLocation", f"{folder(spark)}/checkpoint").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM region")
def stream_console(spark, sf):
    """Rows that the console sink was given, as its progress reports them; it prints none of them here."""
    s = spark.readStream.schema(table(spark, sf, "region").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/region.parquet*")
    q = s.writeStream.format("console").option("numRows", 0).trigger(availableNow=True).option("checkpointLocation", f"{folder(spark)}/checkpoint").start()
    q.awaitTermination()
    return spark.createDataFrame([(sum(int(p["numInputRows"]) for p in q.recentProgress),)], "n long")


@query("SELECT n_regionkey AS region, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1")
def stream_socket(spark, sf):
    """Lines that arrive on a socket: one for each nation."""
    lines = [f"{r[0]}\n" for r in table(spark, sf, "nation").select("n_regionkey").collect()]  # 25 rows
    said = threading.Event()

    class Say(socketserver.BaseRequestHandler):
        def handle(self):
            self.request.sendall("".join(lines).encode())
            said.wait(60)

    server = socketserver.ThreadingTCPServer(("127.0.0.1", 0), Say)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    name = f"pm_{uuid.uuid4().hex}"
    try:
        s = spark.readStream.format("socket").option("host", "127.0.0.1").option("port", server.server_address[1]).load()
        counts = s.groupBy(F.col("value").cast("int").alias("region")).agg(F.count("*").alias("n"))
        q = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{folder(spark)}/checkpoint").start()
        for _ in range(240):
            q.processAllAvailable()
            if sum(r["n"] for r in spark.table(name).collect()) >= len(lines) or q.awaitTermination(0.25):
                break
        q.stop()
    finally:
        said.set()
        server.shutdown()
        server.server_close()
    return spark.table(name)


def silent(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Count a user's events; say the count when none has come for six hours of event time."""
    if state.hasTimedOut:
        (n, _) = state.get
        state.remove()
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})
        return
    n, last = state.get if state.exists else (0, 0)
    for b in batches:
        n, last = n + len(b), max(last, int(b["at"].max()))
    state.update((n, last))
    state.setTimeoutTimestamp(max(last + 6 * 3_600_000, state.getCurrentWatermarkMs() + 1))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id HAVING epoch_ms(max(ts)) + 6 * 3600000 < (SELECT epoch_ms(max(ts)) - 3600000 FROM events)")
def stream_timeouts(spark, sf):
    """State that ends by a timeout of event time, when the watermark passes it."""
    s = event_stream(spark, sf).withWatermark("time", "1 hour").select("user_id", "time", F.unix_millis("time").alias("at")).groupBy("user_id")
    return finished(s.applyInPandasWithState(silent, "user_id long, n long", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout), "append")


class PartitionWriter:
    """A sink that writes a file a partition and batch into a shared folder; one that is written again replaces itself."""

    def __init__(self, folder: str):
        self.folder = folder

    def open(self, partition: int, batch: int) -> bool:
        self.name, self.lines = f"{batch}-{partition}", []
        return True

    def process(self, row: Row) -> None:
        self.lines.append(str(row["event_id"]))

    def close(self, error: Exception | None) -> None:
        from pyarrow import fs

        if error is None and self.lines:
            files, top = fs.FileSystem.from_uri(self.folder)
            files.create_dir(top)
            with files.open_output_stream(f"{top}/{self.name}.txt") as out:
                out.write("\n".join(self.lines).encode())


@query("SELECT event_id FROM events WHERE event_type = 'purchase'")
def stream_foreach_rows(spark, sf):
    """Rows handed to a writer with open, process and close in every partition."""
    top = folder(spark)
    s = event_stream(spark, sf).where("event_type = 'purchase'").select("event_id")
    s.writeStream.foreach(PartitionWriter(f"{top}/out")).trigger(availableNow=True).option("checkpointLocation", f"{top}/checkpoint").start().awaitTermination()
    return spark.read.schema("value string").text(f"{top}/out").select(F.col("value").cast("long").alias("event_id"))


_CENTRES = (0.0, 20.0, 60.0)
_NEAR = "CASE WHEN abs(value - 0.0) <= least(abs(value - 20.0), abs(value - 60.0)) THEN 0 WHEN abs(value - 20.0) <= abs(value - 60.0) THEN 1 ELSE 2 END"


@query(f"SELECT CAST({_NEAR} AS INT) AS cluster, round(avg(value), 6) AS centre, CAST(count(*) AS DOUBLE) AS weight FROM events WHERE value IS NOT NULL GROUP BY 1")
def stream_k_means(spark, sf):
    """Centres that move with every batch: the mean of the old centre by its weight and of the rows that are nearest to it.

    One batch a file, and old weights are kept whole; a batch that is run
    again after a failure begins from the centres of the batch before it.
    """
    top = folder(spark)
    history: dict[int, dict[int, tuple[float, float]]] = {-1: {i: (c, 0.0) for i, c in enumerate(_CENTRES)}}

    def move(batch, number: int) -> None:
        old = history[max(k for k in history if k < number)]
        far = [F.struct(F.abs(F.col("value") - F.lit(c)).alias("d"), F.lit(i).alias("i")) for i, (c, _) in old.items()]
        sums = batch.groupBy(F.least(*far)["i"].alias("i")).agg(F.sum("value").alias("s"), F.count("*").alias("n")).collect()
        new = dict(old)
        for r in sums:
            c, w = old[r["i"]]
            new[r["i"]] = ((c * w + r["s"]) / (w + r["n"]), w + r["n"])
        history[number] = new

    s = event_stream(spark, sf).where("value IS NOT NULL").select("value")
    s.writeStream.foreachBatch(move).trigger(availableNow=True).option("checkpointLocation", f"{top}/checkpoint").start().awaitTermination()
    rows = [(i, round(c, 6), w) for i, (c, w) in history[max(history)].items() if w]
    return spark.createDataFrame(rows, "cluster int, centre double, weight double")

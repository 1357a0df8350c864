"""Commands as queries: what the session shows after them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..plans.storage import application_folder, written
from ..plans.suite import query, table


def name(kind: str) -> str:
    return f"pm_{kind}_{uuid.uuid4().hex[:8]}"


@query("SELECT n_nationkey, n_nationkey * 2 AS twice, n_regionkey + 1 AS up FROM nation")
def command_functions(spark, sf):
    """A permanent and a temporary function, created in SQL, used and dropped."""
    kept, passing = name("f"), name("g")
    table(spark, sf, "nation").createOrReplaceTempView("pm_nation")
    spark.sql(f"CREATE FUNCTION {kept}(x INT) RETURNS INT RETURN x * 2")
    spark.sql(f"CREATE TEMPORARY FUNCTION {passing}(x INT) RETURNS INT RETURN x + 1")
    out = written(spark.sql(f"SELECT n_nationkey, {kept}(n_nationkey) AS twice, {passing}(n_regionkey) AS up FROM pm_nation"), "functions")
    spark.sql(f"DROP FUNCTION {kept}")
    spark.sql(f"DROP TEMPORARY FUNCTION {passing}")
    return out


@query("SELECT 'abs' AS f, true AS described UNION ALL SELECT 'upper', true")
def command_show_functions(spark, sf):
    """Functions that the session lists, and whether it describes them."""
    rows = [(f, f in spark.sql(f"DESCRIBE FUNCTION {f}").first()[0]) for f in ("abs", "upper") if spark.sql(f"SHOW FUNCTIONS LIKE '{f}'").count() == 1]
    return spark.createDataFrame(rows, "f string, described boolean")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def command_alter_view(spark, sf):
    """A view that is given another query."""
    t, v = name("t"), name("v")
    table(spark, sf, "nation").write.saveAsTable(t)
    spark.sql(f"CREATE VIEW {v} AS SELECT n_name FROM {t}")
    spark.sql(f"ALTER VIEW {v} AS SELECT n_nationkey, n_name FROM {t} WHERE n_regionkey = 2")
    out = written(spark.table(v), "view")
    spark.sql(f"DROP VIEW {v}")
    spark.sql(f"DROP TABLE {t}")
    return out


@query("SELECT * FROM (VALUES ('a', 'bigint', 'first'), ('b', 'string', NULL), ('c', 'double', 'later')) t(col_name, data_type, comment)")
def command_alter_table(spark, sf):
    """Columns after one was added and another was given a comment, as the session describes them."""
    t = name("t")
    spark.sql(f"CREATE TABLE {t} (a BIGINT, b STRING) USING parquet")
    spark.sql(f"ALTER TABLE {t} ADD COLUMNS (c DOUBLE COMMENT 'later')")
    spark.sql(f"ALTER TABLE {t} CHANGE COLUMN a a BIGINT COMMENT 'first'")
    out = spark.createDataFrame(spark.sql(f"DESCRIBE {t}").collect(), "col_name string, data_type string, comment string")  # a row a column
    spark.sql(f"DROP TABLE {t}")
    return out


@query("SELECT 'current' AS what, 'pm_db' AS name UNION ALL SELECT 'table', 't'")
def command_databases(spark, sf):
    """A database that is created, used and dropped; its tables as the session shows them."""
    db, before = name("db"), spark.catalog.currentDatabase()
    spark.sql(f"CREATE DATABASE {db}")
    try:
        spark.sql(f"USE {db}")
        spark.sql("CREATE TABLE t (a INT) USING parquet")
        now = spark.sql("SELECT current_database()").first()[0]
        tables = [r["tableName"] for r in spark.sql(f"SHOW TABLES IN {db}").collect() if r["namespace"] == db]
    finally:
        spark.sql(f"USE {before}")
        spark.sql(f"DROP DATABASE {db} CASCADE")
    return spark.createDataFrame([("current", "pm_db" if now == db else now), *(("table", x) for x in tables)], "what string, name string")


@query("SELECT 'cached' AS step, true AS v UNION ALL SELECT 'cleared', false")
def command_cache(spark, sf):
    """Whether a table is cached, after CACHE TABLE and after CLEAR CACHE."""
    t = name("t")
    table(spark, sf, "nation").write.saveAsTable(t)
    spark.sql(f"CACHE TABLE {t}")
    rows = [("cached", spark.catalog.isCached(t))]
    spark.sql("CLEAR CACHE")
    rows.append(("cleared", spark.catalog.isCached(t)))
    spark.sql(f"DROP TABLE {t}")
    return spark.createDataFrame(rows, "step string, v boolean")


@query("SELECT CAST(count(*) AS BIGINT) AS files, 25 AS n FROM (VALUES (1)) t(x)")
def command_files(spark, sf):
    """A file that is sent to the executors, as LIST FILE shows it, and rows of a path after REFRESH."""
    path = f"{application_folder(spark)}/{name('file')}"
    table(spark, sf, "nation").select(F.col("n_name").alias("value")).coalesce(1).write.text(path)
    sent = spark.read.text(path).inputFiles()[0]
    spark.sql(f"ADD FILE '{sent}'")
    listed = [r[0] for r in spark.sql("LIST FILES").collect() if r[0].endswith(sent.rsplit("/", 1)[-1])]
    spark.sql(f"REFRESH '{path}'")
    return spark.read.text(path).agg(F.lit(len(listed)).cast("long").alias("files"), F.count("*").cast("int").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation")
def source_sequence_file(spark, sf):
    """Pairs written as a sequence file and read."""
    path = f"{application_folder(spark)}/{name('sequence')}"
    table(spark, sf, "nation").select("n_nationkey", "n_name").rdd.map(lambda r: (r[0], r[1])).saveAsSequenceFile(path)
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), "n_nationkey int, n_name string")


@query("SELECT CAST(count(*) AS BIGINT) AS members, CAST(0 AS BIGINT) AS lost FROM customer")
def bloom_filter(spark, sf):
    """A Bloom filter of a column, built by tasks and merged, which never misses a member."""
    keys = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    n = keys.count()
    bits = keys._jdf.stat().bloomFilter("k", max(n, 1), 0.01)
    context = spark.sparkContext
    stream = context._jvm.java.io.ByteArrayOutputStream()
    bits.writeTo(stream)
    known = context.broadcast(bytes(stream.toByteArray()))  # about 10 bits a member
    lost = keys.mapInPandas(_missing(known), "k long").count()
    return spark.createDataFrame([(n, lost)], "members long, lost long")


def _missing(known):
    """Members that the filter in Spark's format (version 1 or 2) does not hold."""

    def check(batches):
        import struct

        import numpy as np

        raw = known.value
        version, hashes = struct.unpack(">ii", raw[:8])
        seed, at = (struct.unpack(">i", raw[8:12])[0], 12) if version == 2 else (0, 8)
        words = struct.unpack(">i", raw[at : at + 4])[0]
        bits = np.frombuffer(raw, dtype=">u8", count=words, offset=at + 4).astype(np.uint64)
        for b in batches:
            held = np.ones(len(b), dtype=bool)
            x = b["k"].to_numpy()
            h1 = _murmur(x, seed)
            h2 = _murmur(x, h1)
            if version == 1:
                h = [(h1 + np.int32(i) * h2).astype(np.int64) for i in range(1, hashes + 1)]
            else:
                h, c = [], h1.astype(np.int64) * np.int64(0x7FFFFFFF)
                for _ in range(hashes):
                    c = c + h2.astype(np.int64)
                    h.append(c)
            for c in h:
                c = np.where(c < 0, ~c, c) % (words * 64)
                held &= (bits[c >> 6] >> (c & 63).astype(np.uint64)) & np.uint64(1) == 1
            yield b[~held]

    return check


def _murmur(x, seed):
    """Murmur3 of longs, 32 bits."""
    import numpy as np

    u = np.uint32
    h = np.broadcast_to(np.asarray(seed, dtype=np.int32), x.shape).astype(u)
    for part in (x & 0xFFFFFFFF, (x >> 32) & 0xFFFFFFFF):
        k = part.astype(u) * u(0xCC9E2D51)
        k = (k << u(15)) | (k >> u(17))
        h = h ^ (k * u(0x1B873593))
        h = ((h << u(13)) | (h >> u(19))) * u(5) + u(0xE6546B64)
    h = h ^ u(8)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).astype(np.int32)

"""Readers, writers, commands and function surfaces as queries: written to the shared folder and read back."""

from __future__ import annotations

import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..plans.storage import application_folder, written
from ..plans.suite import query, table
from .formats import GridSource, read_records


def place(spark: SparkSession, name: str) -> str:
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


_PART = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"


def _part(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")


for _format in ("parquet", "orc", "json", "csv"):

    @query(_PART, name=f"source_{_format}")
    def _round_trip(spark, sf, kind=_format) -> DataFrame:
        df, path = _part(spark, sf), place(spark, kind)
        df.write.format(kind).option("header", True).save(path)
        return spark.read.format(kind).schema(df.schema).option("header", True).load(path)


@query(_PART)
def source_csv_inferred(spark, sf):
    path = place(spark, "csv")
    _part(spark, sf).write.option("header", True).csv(path)
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return back.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.col("p_size").cast("int").alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice"))


@query("SELECT n_name AS value FROM nation")
def source_text(spark, sf):
    path = place(spark, "text")
    table(spark, sf, "nation").select("n_name").write.text(path)
    return spark.read.text(path)


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM nation")
def source_whole_text(spark, sf):
    """Each file as one row, its lines counted."""
    path = place(spark, "text")
    table(spark, sf, "nation").select("n_name").coalesce(1).write.text(path)
    return spark.read.text(path, wholetext=True).select((F.size(F.split("value", "\n")) - 1).cast("long").alias("n"))


@query("SELECT CAST(1 AS BIGINT) AS files")
def source_binary(spark, sf):
    path = place(spark, "text")
    table(spark, sf, "nation").select("n_name").coalesce(1).write.text(path)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).where("length > 0").agg(F.count("*").alias("files"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def source_partitioned(spark, sf):
    """A folder a value; the filter reads one of them."""
    path = place(spark, "by-status")
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).where("o_orderstatus = 'F'")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def source_bucketed(spark, sf):
    """Two tables written in like buckets join without moving rows."""
    names = [f"pm_{x}_{uuid.uuid4().hex[:8]}" for x in ("o", "l")]
    table(spark, sf, "orders").select("o_orderkey").write.bucketBy(8, "o_orderkey").sortBy("o_orderkey").saveAsTable(names[0])
    table(spark, sf, "lineitem").select("l_orderkey").write.bucketBy(8, "l_orderkey").sortBy("l_orderkey").saveAsTable(names[1])
    o, li = spark.table(names[0]), spark.table(names[1])
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).agg(F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey > 12 THEN n_name END AS name FROM nation")
def source_merge_schema(spark, sf):
    path, n = place(spark, "merged"), table(spark, sf, "nation")
    n.where("n_nationkey <= 12").select(F.col("n_nationkey").cast("long").alias("k")).write.parquet(f"{path}/part=1")
    n.where("n_nationkey > 12").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")).write.parquet(f"{path}/part=2")
    return spark.read.option("mergeSchema", True).parquet(path).select("k", "name")


@query("SELECT r_regionkey, r_name FROM region")
def source_sql_on_files(spark, sf):
    return spark.sql(f"SELECT r_regionkey, r_name FROM parquet.`{sf}/region.parquet`")


@query("SELECT CAST(range AS BIGINT) AS id, CAST(range % 10 AS DOUBLE) AS x, CAST(range // 10 AS DOUBLE) AS y FROM range(100)")
def source_custom(spark, sf):
    """A connector written in Python, read in parallel."""
    spark.dataSource.register(GridSource)
    return spark.read.format("grid").options(rows=100, parts=3).load().select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) + 2 AS BIGINT) AS id, CAST(n_nationkey AS DOUBLE) AS a, lower(replace(n_name, ' ', '_')) AS s FROM nation")
def source_metric_text(spark, sf):
    """The multi-metric text format, written and read."""
    path = place(spark, "metric-text")
    vector, name = F.concat_ws(",", "n_nationkey", "n_regionkey"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("i"), F.concat_ws(" ", vector, name).alias("value"))
    head = spark.createDataFrame([(-3, "25 2"), (-2, "0 6"), (-1, "24 20")], "i int, value string")
    head.union(n).repartition(1).sortWithinPartitions("i").select("value").write.text(path)
    rows, _ = read_records(spark, path)
    return rows.select("id", F.col("m0")[0].alias("a"), F.col("m1").alias("s"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM nation WHERE n_regionkey = 1")
def source_cached(spark, sf):
    n = table(spark, sf, "nation").cache()
    out = n.where("n_regionkey = 1").agg(F.count("*").alias("n"))
    return out


@query("SELECT 1 AS id, 'x' AS name UNION ALL SELECT 2, 'y' UNION ALL SELECT 3, 'z'")
def command_tables(spark, sf):
    """Create, insert, describe, analyse, overwrite and drop."""
    t = f"pm_t_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE TABLE {t} (id INT, name STRING) USING parquet")
    spark.sql(f"INSERT INTO {t} VALUES (1, 'x'), (2, 'y')")
    spark.sql(f"INSERT INTO {t} VALUES (3, 'z')")
    spark.sql(f"ANALYZE TABLE {t} COMPUTE STATISTICS FOR COLUMNS id, name")
    spark.sql(f"REFRESH TABLE {t}")
    assert {r["col_name"] for r in spark.sql(f"DESCRIBE {t}").collect()} >= {"id", "name"}
    assert spark.sql(f"SHOW COLUMNS IN {t}").count() == 2 and spark.catalog.tableExists(t)
    spark.sql(f"CACHE LAZY TABLE {t}")
    spark.sql(f"UNCACHE TABLE {t}")
    out = written(spark.table(t), "table")
    spark.sql(f"DROP TABLE {t}")
    return out


@query("SELECT 'pm.example' AS key, '1' AS value")
def command_session(spark, sf):
    """A setting as the session shows it."""
    spark.sql("SET pm.example=1")
    out = spark.sql("SET pm.example")
    spark.sql("RESET pm.example")
    return out


@query("SELECT p_partkey, p_size * 2 AS twice FROM part")
def udf_pandas(spark, sf):
    @F.pandas_udf("int")
    def twice(s: pd.Series) -> pd.Series:
        return s * 2

    return table(spark, sf, "part").select("p_partkey", twice("p_size").alias("twice"))


@query("SELECT p_partkey, upper(p_name) AS u FROM part")
def udf_scalar(spark, sf):
    up = F.udf(lambda s: s.upper() if s is not None else None, "string", useArrow=True)
    return table(spark, sf, "part").select("p_partkey", up("p_name").alias("u"))


@query("SELECT p_brand, round(median(p_retailprice), 4) AS m FROM part GROUP BY p_brand")
def udaf_pandas(spark, sf):
    @F.pandas_udf("double")
    def median(s: pd.Series) -> float:
        return float(s.median())

    return table(spark, sf, "part").groupBy("p_brand").agg(F.round(median("p_retailprice"), 4).alias("m"))


@query("SELECT n_name, CAST(unnest(range(1, n_regionkey + 1)) AS INT) AS i FROM nation")
def udtf_rows(spark, sf):
    @udtf(returnType="i int")
    class Upto:
        def eval(self, n: int):
            for i in range(1, (n or 0) + 1):
                yield (i,)

    spark.udtf.register("pm_upto", Upto)
    table(spark, sf, "nation").createOrReplaceTempView("pm_nation")
    return spark.sql("SELECT n_name, u.i FROM pm_nation, LATERAL pm_upto(n_regionkey) u")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM part WHERE p_size > 10")
def map_partitions(spark, sf):
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[b["p_size"] > 10]

    return table(spark, sf, "part").select("p_partkey", "p_size").mapInPandas(keep, "p_partkey long, p_size int").agg(F.count("*").alias("n"))


@query("SELECT p_brand, CAST(max(p_size) - min(p_size) AS INT) AS width FROM part GROUP BY p_brand")
def map_groups(spark, sf):
    def width(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p_brand": [pdf["p_brand"].iloc[0]], "width": [int(pdf["p_size"].max() - pdf["p_size"].min())]})

    return table(spark, sf, "part").select("p_brand", "p_size").groupBy("p_brand").applyInPandas(width, "p_brand string, width int")


@query("SELECT r_regionkey, CAST(count(n_nationkey) AS BIGINT) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def cogroup_pandas(spark, sf):
    def both(key, r: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r_regionkey": [key[0]], "n": [len(n)]})

    r, n = table(spark, sf, "region").select("r_regionkey"), table(spark, sf, "nation").select("n_regionkey", "n_nationkey")
    return r.groupBy("r_regionkey").cogroup(n.groupBy("n_regionkey")).applyInPandas(both, "r_regionkey int, n long")


@query("SELECT n_nationkey, n_name FROM nation")
def source_jdbc(spark, sf):
    """A table in an embedded database, written, and read in two parts by a key range.

    Only one process can write to an embedded database, so the driver does.
    It is then shut down and packed into an archive in the shared folder,
    which any number of processes can read at once.
    """
    name, jvm = f"pm{uuid.uuid4().hex}", spark.sparkContext._jvm
    folder = application_folder(spark)
    if "://" in folder and not folder.startswith("file:"):
        raise ValueError(f"the database can't be read from {folder}: spark.checkpoint.dir has to be a folder that the driver and all executors see as files")
    top = "/" + folder.split(":", 1)[-1].lstrip("/")
    with tempfile.TemporaryDirectory() as own:
        at = f"jdbc:derby:{own}/{name}"
        link = jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver().connect(f"{at};create=true", jvm.java.util.Properties())
        link.setAutoCommit(False)
        link.createStatement().execute('CREATE TABLE nation ("n_nationkey" INTEGER, "n_name" CLOB)')
        put = link.prepareStatement("INSERT INTO nation VALUES (?, ?)")
        for r in table(spark, sf, "nation").select("n_nationkey", "n_name").toLocalIterator():
            put.setNull(1, jvm.java.sql.Types.INTEGER) if r[0] is None else put.setInt(1, r[0])
            put.setString(2, r[1])
            put.addBatch()
        put.executeBatch()
        link.commit()
        link.close()
        with contextlib.suppress(Py4JJavaError):  # a shutdown is always told as an error
            jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver().connect(f"{at};shutdown=true", jvm.java.util.Properties())
        shutil.make_archive(f"{own}/{name}", "zip", own, name)
        shutil.copy(f"{own}/{name}.zip", f"{top}/{name}.zip")
    back = spark.read.jdbc(f"jdbc:derby:jar:({top}/{name}.zip){name}", "nation", column="n_nationkey", lowerBound=0, upperBound=25, numPartitions=2, properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    return back.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("SELECT CAST(p_size AS DOUBLE) AS label, round(p_retailprice, 2) AS v FROM part")
def source_libsvm(spark, sf):
    from pyspark.ml.functions import vector_to_array

    path = place(spark, "libsvm")
    p = table(spark, sf, "part")
    p.select(F.concat(F.col("p_size").cast("string"), F.lit(" 1:"), F.col("p_retailprice").cast("string")).alias("value")).write.text(path)
    return spark.read.format("libsvm").option("numFeatures", 2).load(path).select("label", F.round(vector_to_array("features")[0], 2).alias("v"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
def source_pushdown(spark, sf):
    """Filters and columns reach the scan."""
    return table(spark, sf, "orders").where((F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "O")).select("o_orderkey", "o_totalprice")


@query("SELECT CAST(0 AS BIGINT) AS n")
def source_empty(spark, sf):
    return table(spark, sf, "orders").limit(0).agg(F.count("*").alias("n"))

"""The folder that driver and executors share, and tables written there to cut the lineage of iterations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """``name`` under the session's ``spark.checkpoint.dir``; only where that is unset, under a temporary folder, which is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"file://{tempfile.gettempdir()}/polymetric-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}"


def application_folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it goes when the driver's JVM ends."""
    context = spark.sparkContext
    top = shared_folder(spark, f"polymetric-{context.applicationId}")
    if getattr(context, "_polymetric_top", None) != top:
        path = context._jvm.org.apache.hadoop.fs.Path(top)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        context._polymetric_top = top
    return top


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the application's folder and read it back.

    This cuts the lineage as a checkpoint does, survives lost executors, and
    gives the planner the true size of the table.
    """
    path = f"{application_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._polymetric_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``written`` gave and that nothing will read again."""
    for df in tables:
        path = getattr(df, "_polymetric_path", None)
        if path is not None:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)

"""What the operators of this folder share."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import discard, written  # noqa: F401

#: White space of the contracts: the space and code points 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
#: A word, as Java's and Python's regular expressions spell it.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of a batch that goes to a Python worker while a table is
#: written; the JVM and the worker both hold a batch whole, some of them twice.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``written``: Parquet in the shared folder, read back; with small batches for Python functions on the way.

    What the session sets itself stays as it is.
    """
    conf = df.sparkSession.conf
    unset = [k for k in BATCH if conf.get(k, None) is None]
    for k in unset:
        conf.set(k, BATCH[k])
    try:
        return written(df, name)
    finally:
        for k in unset:
            conf.unset(k)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Python functions are pickled by reference; the package travels as a zip
    through Spark's own file server, so no folder needs to be shared.
    """
    context = spark.sparkContext
    if getattr(context, "_polymetric_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    handle, name = tempfile.mkstemp(prefix="polymetric-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    context.addPyFile(name)
    atexit.register(Path(name).unlink, missing_ok=True)
    context._polymetric_shipped = True


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names (in any case) an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def hashable(df: DataFrame) -> list[Column]:
    """The columns of ``df`` in a form that Spark can hash: those with maps in them as JSON, with the keys in order where they are strings."""
    out = []
    for f in df.schema.fields:
        c, said = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if said in ("void", "variant"):
            continue
        if said.startswith("map<") and "map<" not in said[4:]:
            c = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))) if said.startswith("map<string,") else F.to_json(c)
        elif "map<" in said:
            c = F.to_json(c)
        out.append(c)
    return out


def row_hash(df: DataFrame, seed: int) -> Column:
    """A seeded 64-bit hash of all columns (but of types that hold nothing or anything)."""
    return F.xxhash64(F.lit(seed), *hashable(df))


def row_bytes(df: DataFrame) -> Column:
    """About how much memory a row takes: its strings and binaries, nested columns as JSON, and 8 for each of the others."""
    total, fixed = F.lit(0).cast("long"), 64
    for f in df.schema.fields:
        c, said = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if said in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif said.startswith(("array<", "map<", "struct<")):
            total = total + F.coalesce(F.octet_length(F.to_json(c)), F.lit(0))
        else:
            fixed += 8
    return total + fixed

"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly over buckets that fit a worker's memory,
by a seeded hash of the whole record.  Pass two loads one bucket at a time,
puts it in a canonical order, shuffles it by Fisher-Yates from a seed of its
own and writes it.  The written buckets, one after another, are one uniform
permutation of all records; it is cut into shards of equal counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_bytes, row_hash, ship, without

#: Beyond so many buckets (16 bytes each) their offsets are joined, not broadcast.
BROADCAST_BUCKETS = 1_000_000
#: Rows that are equal in all columns meet in one bucket, unless there are more of them than this.
ALIKE = 1024


def bucket_count(total_bytes: int, least: int = 1 << 20, most: int = 256 << 20) -> int:
    """Buckets for so many bytes, of 1 to 256 MiB each: their size grows with the root of the whole, so that both stay few."""
    size = min(most, max(least, math.isqrt(total_bytes << 12)))
    return max(1, math.ceil(total_bytes / size))


def fisher_yates(seed: int, bucket: int, hashes: np.ndarray) -> np.ndarray:
    """A permutation of a bucket's rows that depends on its rows, not on their arrival."""
    order = np.argsort(hashes, kind="stable")
    np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)
    return order


def external_shuffle(df: DataFrame, n_shards: int = 8, seed: int = 20_17, buckets: int | None = None) -> DataFrame:
    """All columns of ``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in a shard).

    Shard counts differ by one at most.  Every row counts, whatever it holds:
    nulls are values like others, repeated rows are shuffled like others, and
    an empty table gives an empty one.  Rows equal in all columns are spread
    over the buckets too where there are more than ALIKE of them; as nothing
    tells them apart, their order is open.  Columns of ``df`` named ``shard``
    or ``slot`` are replaced.

    The number of buckets follows from the bytes of all columns alone, so
    the same table and seed give the same shards on any cluster.
    """
    spark = df.sparkSession
    ship(spark)
    data = without(df, "shard", "slot", "__bucket", "__hash", "__pos", "__alike", "__place")
    if buckets is None:
        buckets = bucket_count(data.agg(F.sum(row_bytes(data))).first()[0] or 0)
    hashed = data.withColumn("__hash", row_hash(data, seed))
    alike = materialize(hashed.groupBy("__hash").count().where(F.col("count") > ALIKE).select(F.col("__hash").alias("__alike")), "alike")
    n_alike = alike.count()
    if n_alike:
        known = F.broadcast(alike) if n_alike <= BROADCAST_BUCKETS else alike
        place = F.xxhash64("__hash", F.monotonically_increasing_id())
        hashed = hashed.withColumn("__place", place).join(known, F.col("__hash") == F.col("__alike"), "left")
        hashed = hashed.withColumn("__hash", F.when(F.col("__alike").isNotNull(), F.col("__place")).otherwise(F.col("__hash"))).drop("__alike", "__place")
    scattered = hashed.withColumn("__bucket", F.pmod("__hash", F.lit(buckets)).cast("int"))

    def shuffle(table: pa.Table) -> pa.Table:
        bucket = table.column("__bucket")[0].as_py()
        order = fisher_yates(seed, bucket, table.column("__hash").to_numpy())
        out = table.drop_columns(["__hash"]).take(pa.array(order))
        return out.append_column("__pos", pa.array(np.arange(len(order), dtype=np.int64)))

    schema = scattered.drop("__hash").schema.add("__pos", "long")
    written = materialize(scattered.groupBy("__bucket").applyInArrow(shuffle, schema), "shuffled")
    return cut(written, n_shards, buckets)


def cut(written: DataFrame, n_shards: int, buckets: int) -> DataFrame:
    """Ranks from the written buckets' counts; a shard is a stretch of ranks."""
    counts = written.groupBy("__bucket").agg(F.count("*").alias("__n"))
    offsets = counts.select(
        "__bucket",
        (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).alias("__before"),
        F.sum("__n").over(Window.partitionBy()).alias("__total"),
    )
    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    rank, total = F.col("__before") + F.col("__pos"), F.col("__total")
    ranked = written.join(offsets, "__bucket").withColumn("__rank", rank)
    shard = F.expr(f"__rank * {n_shards} div __total")
    first = F.expr(f"(shard * __total + {n_shards - 1}) div {n_shards}")
    return (
        ranked.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("__rank") - first)
        .drop("__bucket", "__pos", "__before", "__total", "__rank")
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder a shard; within a file rows keep the order of their slots."""
    shuffled.repartition("shard", (F.col("slot") / 100_000).cast("long")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text")
    return external_shuffle(docs, 8).select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Readers of the multi-metric text formats, and a Python data source."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.metrics import CODES, EDIT, Metric


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, list[Metric]]:
    """Records and metrics of a text file.

    Line 0 has the number of records and metrics, line 1 the metric codes, line 2
    the largest distances, and every later line a record: attributes between
    spaces, vector components between commas.  Columns are ``id`` (the line's
    number in the file, so the first record's is 3) and ``m0, m1, ...``:
    strings for edit distance, vectors for all others.
    """
    lines = spark.read.text(path)
    head = [r["value"] for r in lines.limit(3).collect()]
    codes, most = [int(x) for x in head[1].split()], [float(x) for x in head[2].split()]
    metrics = [Metric(f"m{i}", CODES[c], d) for i, (c, d) in enumerate(zip(codes, most))]
    # One file is one ordered text: numbers come from positions in it, not from a sort.
    numbered = lines.withColumn("__at", F.monotonically_increasing_id())
    parts = numbered.groupBy(F.shiftright("__at", 33).alias("p")).agg(F.count("*").alias("n"))
    starts = {r["p"]: r["n"] for r in parts.collect()}  # one number a split of the file
    before, total = {}, 0
    for p in sorted(starts):
        before[p], total = total, total + starts[p]
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.shiftright("__at", 33)]
    line = offset + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = numbered.withColumn("id", line).where("id >= 3").withColumn("f", F.split("value", " "))
    cols = [F.col("f")[i].alias(m.column) if m.kind == EDIT else F.split(F.col("f")[i], ",").cast("array<double>").alias(m.column) for i, m in enumerate(metrics)]
    return rows.select("id", *cols), metrics


def read_queries(spark: SparkSession, path: str) -> dict[str, list[Any]]:
    """``weights, ks, radii, ids`` of a query file: its lines 0, 1 (first field skipped), 3, and from 4 on."""
    lines = [r["value"] for r in spark.read.text(path).collect()]
    return {
        "weights": [float(x) for x in lines[0].split()],
        "ks": [int(x) for x in lines[1].split()[1:]],
        "radii": [float(x) for x in lines[3].split()],
        "ids": [int(x) for line in lines[4:] for x in line.split()],
    }


class GridPartition(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class GridReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.rows, self.parts = int(options.get("rows", "100")), int(options.get("parts", "4"))

    def partitions(self) -> Sequence[InputPartition]:
        step = -(-self.rows // self.parts)
        return [GridPartition(a, min(self.rows, a + step)) for a in range(0, self.rows, step)]

    def read(self, partition: GridPartition) -> Iterator[tuple[int, list[float]]]:
        for i in range(partition.start, partition.end):
            yield i, [float(i % 10), float(i // 10)]


class GridSource(DataSource):
    """``id, v``: points on a grid, made in the tasks; a pattern for custom connectors."""

    @classmethod
    def name(cls) -> str:
        return "grid"

    def schema(self) -> str:
        return "id bigint, v array<double>"

    def reader(self, schema) -> DataSourceReader:
        return GridReader(self.options)

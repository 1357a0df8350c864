"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed 60-bit hash.  A source takes whole copies of all
its documents and, for the rest of its target, the documents whose hash lies
below a threshold.  The threshold is found digit by digit: words are summed
by source and hash digit, the budget falls into one digit's bucket, and only
that bucket is summed again by the next digit.  Nothing is sorted.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialize, text_or_empty, without

#: A hash has LEVELS digits of BITS bits.
LEVELS, BITS = 5, 12


def mix_hash(key: Column, text: Column, seed: int) -> Column:
    """60 bits of an md5 over seed, key and the text's md5; the text tells rows without a key apart."""
    said = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), F.md5(F.encode(text, "UTF-8")))
    return F.conv(F.substring(F.md5(F.encode(said, "UTF-8")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources by code point, null last, weigh ``weights`` in turn.  They share
    ``share`` times all words by weight; a target stops at ``cap`` times its
    source, and what is left over goes to the others by weight.  The fixed
    point is found directly: in the order of cap over weight, the sources
    before some point stop, and the rest have one common ratio.  One row a
    source is all that the windows here see.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.withColumn("w", weight).withColumn("most", F.col("source_size") * float(cap))
    everyone = Window.partitionBy()
    before = Window.orderBy((F.col("most") / F.col("w")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.select(
        "source", "source_size", "w", "most",
        (
            (F.sum("source_size").over(everyone) * float(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
            / (F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        ).alias("ratio"),
    )
    # The ratio rises while sources stop that must, and falls from the fixed point on.
    target = F.least(F.max("ratio").over(everyone) * F.col("w"), F.col("most"))
    return w.select("source", "source_size", target.alias("target"))


def thresholds(narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``copies`` (whole ones), ``below``, ``until``, ``take`` and ``n``.

    Documents in the order of their hashes are taken as long as their words
    stay within what is left of the target, and one more document if that
    comes nearer to it: those whose hash is under ``below``, and of the ``n``
    documents at the boundary, from there and under ``until``, ``take``.  More
    than one is there only if key and text are equal, so their sizes are too.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = plan.withColumn("copies", whole.cast("int")).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("left0", F.col("left")).withColumn("prefix", F.lit(0).cast("long"))
    state = materialize(state, "mix-state")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        s = state.select(F.col("source").alias("s"), "prefix", "left")
        # A level reads only what falls into its source's boundary bucket.
        inside = narrow.join(s, narrow["source"].eqNullSafe(s["s"]) & (F.shiftright("hash", shift + BITS) == s["prefix"]))
        sums = inside.groupBy("s", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("left").alias("left"))
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("bucket"))
        edge = (
            sums.withColumn("upto", upto).where(F.col("upto") > F.col("left"))
            .groupBy("s").agg(F.min(F.struct("bucket", "upto", "words", "n")).alias("e"))
            .select(F.col("s").alias("es"), F.col("e.bucket").alias("bucket"), (F.col("e.upto") - F.col("e.words")).alias("gone"), F.col("e.words").alias("words"), F.col("e.n").alias("n"))
        )
        state = materialize(
            state.drop("words", "n").join(edge, state["source"].eqNullSafe(edge["es"]), "left").select(
                "source", "source_size", "target", "copies", "left0",
                (F.col("left") - F.coalesce("gone", F.lit(0))).alias("left"),
                # No boundary here: the source holds no more than its budget.
                F.coalesce("bucket", F.shiftleft(F.col("prefix") + 1, BITS) - F.lit(1)).alias("prefix"),
                F.coalesce("words", F.lit(0)).alias("words"),
                F.coalesce("n", F.lit(0)).alias("n"),
            ),
            "mix-state",
        )
        if level == LEVELS or (state.agg(F.max("n")).first()[0] or 0) <= 1:
            each = F.when(F.col("n") > 0, F.col("words") / F.col("n"))
            whole = F.floor(F.col("left") / each)
            over = F.col("left") - whole * each
            take = F.coalesce(F.least(whole + F.when(each - over < over, 1).otherwise(0), F.col("n")), F.lit(0))
            below = F.when(F.col("left0") > 0, F.shiftleft(F.col("prefix") + F.when(F.col("n") == 0, 1).otherwise(0), shift)).otherwise(F.lit(0))
            until = F.shiftleft(F.col("prefix") + 1, shift)
            return state.select("source", "source_size", "target", "copies", below.alias("below"), until.alias("until"), take.cast("long").alias("take"), "n")
    raise AssertionError("unreachable")


def mix(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 8, key: str = "doc_id") -> DataFrame:
    """All columns of ``df`` with ``size, source_size`` (long), ``target`` (double) and ``copies`` (int).

    A null text has size 0; a null source is a source of its own, the last
    one.  Rows equal in key and text share a hash; at the boundary as many of
    them are taken as come nearest to the target, and which ones is open.  No
    row has more than ``cap`` copies.  An empty table gives an empty one;
    reruns agree.  Columns of ``df`` with these four names are replaced.

    The table is read once and written with its sizes and hashes.
    """
    data = without(df, "size", "source_size", "target", "copies")
    h, row = fresh(data, "mix_hash"), fresh(data, "mix_row")
    text = text_or_empty()
    sized = data.withColumn("size", F.regexp_count(text, F.lit(WORD)).cast("long")).withColumn(h, mix_hash(F.col(key), text, seed))
    sized = materialize(sized.withColumn(row, F.monotonically_increasing_id()), "mix-sized")
    narrow = sized.where("size > 0").select("source", "size", F.col(h).alias("hash"))
    sizes = sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    plan = thresholds(narrow, materialize(targets(sizes, weights, share, cap), "mix-targets"))
    mine = plan.select(*[F.col(c).alias(f"{h}_{c}") for c in plan.columns])
    p = {c: F.col(f"{h}_{c}") for c in plan.columns}
    joined = sized.join(mine, sized["source"].eqNullSafe(p["source"])).withColumns({"source_size": p["source_size"], "target": p["target"]})
    # Boundaries are documents; without words there is nothing to come near with.
    edge = (p["n"] > 0) & (F.col("size") > 0) & (F.col(h) >= p["below"]) & (F.col(h) < p["until"])
    if (plan.agg(F.max("n")).first()[0] or 0) <= 1:
        more = F.when(edge, p["take"]).when(F.col(h) < p["below"], 1).otherwise(0)
        out = joined.withColumn("copies", (p["copies"] + more).cast("int"))
    else:
        # Equal rows are ranked by the task that wrote them, so none ranks them all.
        part = F.shiftright(F.col(row), 33)
        at, before, rank = f"{h}_at", f"{h}_before", f"{h}_rank"
        block = joined.where(edge).withColumn(at, part)
        counts = block.groupBy(f"{h}_source", at).agg(F.count("*").alias(rank))
        first = counts.select(F.col(f"{h}_source").alias(f"{h}_s"), F.col(at).alias(f"{at}_s"), (F.sum(rank).over(Window.partitionBy(f"{h}_source").orderBy(at)) - F.col(rank)).alias(before))
        within = F.row_number().over(Window.partitionBy(f"{h}_source", at).orderBy(row))
        ranked = block.withColumn(rank, within).join(first, F.col(f"{h}_source").eqNullSafe(F.col(f"{h}_s")) & (F.col(at) == F.col(f"{at}_s")))
        taken = ranked.withColumn("copies", (p["copies"] + F.when(F.col(before) + F.col(rank) <= p["take"], 1).otherwise(0)).cast("int"))
        rest = joined.where(~edge).withColumn("copies", (p["copies"] + F.when(F.col(h) < p["below"], 1).otherwise(0)).cast("int"))
        names = [*data.columns, "size", "source_size", "target", "copies"]
        out = rest.select(*[F.col(f"`{c}`") for c in names]).unionByName(taken.select(*[F.col(f"`{c}`") for c in names]))
    return out.select(*[F.col(f"`{c}`") for c in (*data.columns, "size", "source_size", "target", "copies")])


def repeated(mixed: DataFrame) -> DataFrame:
    """The mixture itself: each row as often as it is taken, without the columns of the plan."""
    copy = fresh(mixed, "copy")
    rows = mixed.where("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.drop("size", "source_size", "target", "copies", copy)


def mix_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('8:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         source_size * 2.0::DOUBLE AS most
  FROM s
), r AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS ratio
  FROM w
), c AS (
  SELECT *, max(ratio) OVER () AS common FROM r
), t AS (
  SELECT source, source_size, least(common * w, most) AS target FROM c
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t
), m AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.copies,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS own,
         p.target - p.copies * p.source_size AS rest
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST((copies + CASE WHEN upto <= rest OR upto - own <= rest AND own - (rest - (upto - own)) < rest - (upto - own) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM m
"""

"""Relational operators as queries: projection, joins, aggregation, windows, sorting, sets, subqueries, nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from ..plans.suite import query, statement, table

# ---- projection, filter, generators ----------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem WHERE l_quantity < 5 AND l_returnflag = 'R'")
def project_filter(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.where((F.col("l_quantity") < 5) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"))


statement("generate_explode", "SELECT vec_id, CAST(unnest(embedding[1:3]) AS DOUBLE) AS v FROM embeddings", "SELECT vec_id, CAST(v AS DOUBLE) AS v FROM embeddings LATERAL VIEW explode(slice(embedding, 1, 3)) t AS v")


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 4) r(i)")
def generate_posexplode(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode(F.slice("embedding", 1, 3)).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


statement("generate_stack", "SELECT r_regionkey, 'name' AS k, r_name AS v FROM region UNION ALL SELECT r_regionkey, 'upper', upper(r_name) FROM region", "SELECT r_regionkey, k, v FROM region LATERAL VIEW stack(2, 'name', r_name, 'upper', upper(r_name)) s AS k, v")
statement("generate_outer", "SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN n_name END AS v FROM nation", "SELECT n_nationkey, v FROM nation LATERAL VIEW OUTER explode(CASE WHEN n_regionkey > 1 THEN array(n_name) ELSE array() END) t AS v")
statement("generate_inline", "SELECT n_nationkey, n_regionkey AS a, n_name AS b FROM nation", "SELECT n_nationkey, a, b FROM nation LATERAL VIEW inline(array(struct(n_regionkey, n_name))) t AS a, b")
statement("like_prefix", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE 'S%' AND p_brand NOT LIKE '%1'")
statement("case_between_in", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size IN (11, 12, 13) THEN 'odd' ELSE 'large' END AS class FROM part")
statement("range_function", "SELECT CAST(range AS BIGINT) AS id, CAST(range * range AS BIGINT) AS sq FROM range(0, 100, 7)", "SELECT id, id * id AS sq FROM range(0, 100, 7)")
statement("inline_table", "SELECT CAST(a AS BIGINT) AS a, b FROM (VALUES (1, 'x'), (2, NULL), (NULL, 'z')) AS t(a, b)")
statement("literals", "SELECT CAST(1 AS BIGINT) AS l, CAST(2.5 AS DOUBLE) AS d, 'it''s' AS s, CAST(DATE '2020-02-29' AS STRING) AS day, CAST(NULL AS STRING) AS n, TRUE AS t")


@query()
def sample_rows(spark, sf):
    """A seeded sample, a feature of its own."""
    return table(spark, sf, "orders").sample(0.1, seed=7).select("o_orderkey")


@query()
def stratified_sample(spark, sf):
    o = table(spark, sf, "orders")
    return o.sampleBy("o_orderstatus", {"F": 0.1, "O": 0.2, "P": 1.0}, seed=7).select("o_orderkey", "o_orderstatus")


# ---- joins ------------------------------------------------------------------

_N = "SELECT n_name, r_name FROM nation {how} JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3"
for _how in ("inner", "left", "right", "full"):

    @query(_N.format(how=_how if _how != "full" else "FULL OUTER"), name=f"join_{_how}")
    def _join(spark, sf, how=_how) -> DataFrame:
        n, r = table(spark, sf, "nation"), table(spark, sf, "region")
        return n.join(r, (n["n_regionkey"] == r["r_regionkey"]) & (r["r_regionkey"] < 3), how).select("n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 1000)")
def join_semi(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_totalprice > 1000")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


statement("join_cross", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
statement("join_natural", "SELECT r_name, n FROM region NATURAL JOIN (SELECT n_regionkey AS r_regionkey, n_name AS n FROM nation) t")
statement("join_using", "SELECT r_regionkey, r_name, n FROM region JOIN (SELECT n_regionkey AS r_regionkey, n_name AS n FROM nation) t USING (r_regionkey)")
statement("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
statement("join_self_null_safe", "SELECT count(*) AS n FROM nation a JOIN nation b ON nullif(a.n_regionkey, 1) IS NOT DISTINCT FROM nullif(b.n_regionkey, 1)")

_O = "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority"
for _hint in ("merge", "shuffle_hash"):

    @query(_O, name=f"join_{_hint}")
    def _hinted(spark, sf, hint=_hint) -> DataFrame:
        o, li = table(spark, sf, "orders").hint(hint), table(spark, sf, "lineitem")
        return o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT n_name, CAST(count(*) AS BIGINT) AS n, round(avg(c_acctbal), 4) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_broadcast(spark, sf):
    """The dimension is one row a country; Spark broadcasts it by its size."""
    return table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("bal"))


@query("SELECT n_regionkey, CAST(sum(c) AS BIGINT) AS c, CAST(sum(s) AS BIGINT) AS s FROM (SELECT n_regionkey, 1 AS c, 0 AS s FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_regionkey, 0, 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey) t GROUP BY n_regionkey")
def cogroup_counts(spark, sf):
    """Two keyed tables side by side: partial counts of each, then a full join of the few groups."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("c"))
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("s"))
    return c.join(s, "n_regionkey", "full").na.fill(0, ["c", "s"])


# ---- aggregation --------------------------------------------------------------

statement("pricing_summary", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")
statement("aggregate_distinct", "SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS s, CAST(count(DISTINCT l_partkey) AS BIGINT) AS p, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag")
statement("group_by_ordinal_having", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 HAVING count(*) > 3")
statement("cube", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(grouping(o_orderstatus) AS INT) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
statement("rollup", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
statement("grouping_sets", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
statement("aggregate_filter", "SELECT l_linestatus, CAST(count(*) FILTER (WHERE l_quantity > 25) AS BIGINT) AS big, round(sum(l_quantity) FILTER (WHERE l_discount < 0.05), 2) AS q FROM lineitem GROUP BY l_linestatus")
statement("aggregate_statistics", """
SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS sd, round(var_pop(c_acctbal), 2) AS vp, round(corr(c_acctbal, c_custkey), 6) AS co,
       round(covar_samp(c_acctbal, c_custkey), 2) AS cs, round(covar_pop(c_acctbal, c_custkey), 2) AS cp, min(c_acctbal) AS lo, max(c_acctbal) AS hi,
       round(stddev_pop(c_acctbal), 4) AS sdp, round(var_samp(c_acctbal), 2) AS vs
FROM customer GROUP BY c_mktsegment""")

#: Distinct values of a task that puts them in order.
VALUES = 1_000_000


def exact_percentiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``by`` and a column a share: the exact percentile of ``value`` in every group, between two rows as ``percentile`` does.

    Values are counted, put in order over all groups in ranges, and only the
    ranges that hold a wanted row are looked into, so no task holds a group.
    """
    n = df.count()
    v = F.col(value).cast("double")
    counted = df.groupBy(F.col(by).alias("g"), v.alias("v")).agg(F.count(v).alias("n"))
    ranges = written(counted.repartitionByRange(max(1, -(-n // VALUES)), "g", "v").withColumn("part", F.spark_partition_id()), "percentiles")
    every = Window.partitionBy("g")
    parts = ranges.groupBy("g", "part").agg(F.sum("n").alias("rows")).withColumn("total", F.sum("rows").over(every))
    parts = parts.withColumn("before", F.sum("rows").over(every.orderBy("part")) - F.col("rows"))
    at = {name: (F.col("total") - 1) * F.lit(float(p)) for name, p in shares.items()}
    wanted = {(name, end): f(pos).cast("long") for name, pos in at.items() for end, f in (("lo", F.floor), ("hi", F.ceil))}
    holds = F.col("total") == 0
    for rank in wanted.values():
        holds = holds | ((rank >= F.col("before")) & (rank < F.col("before") + F.col("rows")))
    parts = parts.where(holds).select(F.col("g").alias("group"), F.col("part").alias("range"), "total", "before")
    looked = ranges.join(parts, F.col("g").eqNullSafe(F.col("group")) & (F.col("part") == F.col("range")))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    looked = looked.withColumn("upto", upto)
    found = [F.max(F.when((rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto")), F.col("v"))).alias(f"{name} {end}") for (name, end), rank in wanted.items()]
    got = looked.groupBy("g").agg(F.first("total").alias("total"), *found)
    out = []
    for name, pos in at.items():
        lo, hi = F.col(f"`{name} lo`"), F.col(f"`{name} hi`")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi).alias(name))
    return got.select(F.col("g").alias(by), *out)


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")
def aggregate_percentile(spark, sf):
    got = exact_percentiles(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", {"med": 0.5, "p90": 0.9})
    return got.select("l_returnflag", F.round("med", 4).alias("med"), F.round("p90", 4).alias("p90"))


statement("aggregate_moments", "SELECT c_mktsegment, round(sum(pow(c_acctbal - m, 3)) / count(*) / pow(sum(pow(c_acctbal - m, 2)) / count(*), 1.5), 5) AS sk, round(sum(pow(c_acctbal - m, 4)) / count(*) / pow(sum(pow(c_acctbal - m, 2)) / count(*), 2) - 3, 5) AS ku FROM (SELECT *, avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS m FROM customer) t GROUP BY c_mktsegment", "SELECT c_mktsegment, round(skewness(c_acctbal), 5) AS sk, round(kurtosis(c_acctbal), 5) AS ku FROM customer GROUP BY c_mktsegment")
statement("collect_sorted", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names, CAST(len(list(DISTINCT n_name)) AS INT) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names, size(collect_set(n_name)) AS n FROM nation GROUP BY n_regionkey")


@query("SELECT o_orderstatus, CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS urgent, CAST(count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS BIGINT) AS low FROM orders GROUP BY o_orderstatus")
def pivot(spark, sf):
    p = table(spark, sf, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).count()
    return p.select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))


@query("SELECT c_mktsegment, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg, CAST(sum(CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS pos FROM customer GROUP BY c_mktsegment")
def crosstab(spark, sf):
    c = table(spark, sf, "customer").withColumn("sign", F.when(F.col("c_acctbal") < 0, "neg").otherwise("pos"))
    t = c.stat.crosstab("c_mktsegment", "sign")
    cols = {x: F.col(x) if x in t.columns else F.lit(0) for x in ("neg", "pos")}
    return t.select(F.col("c_mktsegment_sign").alias("c_mktsegment"), *[v.cast("long").alias(k) for k, v in cols.items()])


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr, round(covar_samp(l_quantity, l_extendedprice), 4) AS cov FROM lineitem")
def stat_corr_cov(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr"), F.round(F.covar_samp("l_quantity", "l_extendedprice"), 4).alias("cov"))


@query()
def approximate_aggregates(spark, sf):
    """Sketches: distinct counts, quantiles and a count-min sketch; estimates, so no SQL."""
    return table(spark, sf, "lineitem").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("orders"), F.percentile_approx("l_extendedprice", [0.25, 0.5, 0.75], 10000).alias("quartiles"), F.length(F.hex(F.count_min_sketch(F.col("l_suppkey"), F.lit(0.01), F.lit(0.95), F.lit(1)))).alias("sketch"))


@query()
def frequent_items(spark, sf):
    return table(spark, sf, "events").stat.freqItems(["event_type"], 0.2)


@query("SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def histogram(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.floor(F.col("l_quantity") / 10).alias("bin")).agg(F.count("*").alias("n"))


# ---- windows --------------------------------------------------------------------

statement("window_ranking", """
SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER w AS INT) AS rk, CAST(dense_rank() OVER w AS INT) AS dr, CAST(ntile(4) OVER w AS INT) AS nt,
       round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)""")
statement("window_offset", "SELECT o_orderkey, lag(o_totalprice, 1) OVER w AS prev, lead(o_totalprice, 2, -1.0) OVER w AS nxt, first_value(o_orderkey) OVER w AS f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
_F = "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN {a} AND {b}), 2) AS s FROM orders"
for _n, (_a, _b) in {"growing": ("UNBOUNDED PRECEDING", "CURRENT ROW"), "shrinking": ("CURRENT ROW", "UNBOUNDED FOLLOWING"), "sliding": ("2 PRECEDING", "1 FOLLOWING"), "entire": ("UNBOUNDED PRECEDING", "UNBOUNDED FOLLOWING")}.items():
    statement(f"window_{_n}", _F.format(a=_a, b=_b))
statement("window_range", "SELECT p_partkey, CAST(count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS BIGINT) AS n FROM part")


@query("SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS r FROM orders) t WHERE r <= 2")
def top_by_key(spark, sf):
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", r.alias("r")).where("r <= 2")


# ---- sort, limit -----------------------------------------------------------------

statement("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
statement("sort_nulls", "SELECT n_nationkey, v FROM (SELECT n_nationkey, nullif(n_regionkey, 2) AS v FROM nation) t ORDER BY v ASC NULLS LAST, n_nationkey")
statement("order_by_ordinal", "SELECT r_name, r_regionkey FROM region ORDER BY 2 DESC")

# ---- sets, CTE, subqueries -----------------------------------------------------------

statement("union_all", "SELECT n_name AS s FROM nation UNION ALL SELECT r_name FROM region")
statement("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
statement("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
statement("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
statement("intersect_all", "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT c_nationkey FROM customer")
statement("except_all", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region")
statement("distinct", "SELECT DISTINCT p_brand, p_size FROM part")
statement("union_widening", "SELECT CAST(n_nationkey AS DOUBLE) AS v FROM nation UNION ALL SELECT s_acctbal FROM supplier")
statement("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE t > 100000) SELECT CAST(count(*) AS BIGINT) AS n, round(max(t), 2) AS most FROM top")
statement("scalar_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
statement("correlated_subquery", "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)")
statement("exists_subquery", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9000)")
statement("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
statement("not_in_subquery", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000)")
statement("lateral_subquery", "SELECT r_name, t.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) t")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice > 100000")
def views(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("pm_orders")
    spark.sql("CREATE OR REPLACE TEMP VIEW pm_large AS SELECT * FROM pm_orders WHERE o_totalprice > 100000")
    return spark.sql("SELECT count(*) AS n FROM pm_large")


# ---- nulls -----------------------------------------------------------------------------

_NULLS = "SELECT n_nationkey AS k, nullif(n_regionkey, 1) AS a, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS b FROM nation"


def _nulls(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.nullif("n_regionkey", F.lit(1)).alias("a"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("b"))


@query(f"SELECT * FROM ({_NULLS}) t WHERE a IS NOT NULL AND b IS NOT NULL")
def na_drop_any(spark, sf):
    return _nulls(spark, sf).na.drop("any")


@query(f"SELECT * FROM ({_NULLS}) t WHERE a IS NOT NULL OR b IS NOT NULL")
def na_drop_threshold(spark, sf):
    return _nulls(spark, sf).na.drop(thresh=1, subset=["a", "b"])


@query(f"SELECT k, coalesce(a, -1) AS a, coalesce(b, '?') AS b FROM ({_NULLS}) t")
def na_fill(spark, sf):
    return _nulls(spark, sf).na.fill({"a": -1, "b": "?"})


@query(f"SELECT k, CASE a WHEN 0 THEN 100 WHEN 2 THEN 200 ELSE a END AS a, b FROM ({_NULLS}) t")
def na_replace(spark, sf):
    return _nulls(spark, sf).na.replace({0: 100, 2: 200}, subset=["a"])


statement("null_logic", "SELECT n_nationkey, CAST((a > 1 AND b) AS STRING) AS x, CAST((a > 1 OR b) AS STRING) AS y, CAST((NOT b) AS STRING) AS z, CAST((a = NULL) AS STRING) AS e FROM (SELECT n_nationkey, nullif(n_regionkey, 2) AS a, CASE WHEN n_nationkey % 2 = 0 THEN TRUE END AS b FROM nation) t", "SELECT n_nationkey, CAST((a > 1 AND b) AS STRING) AS x, CAST((a > 1 OR b) AS STRING) AS y, CAST((NOT b) AS STRING) AS z, CAST((a = CAST(NULL AS INT)) AS STRING) AS e FROM (SELECT n_nationkey, nullif(n_regionkey, 2) AS a, CASE WHEN n_nationkey % 2 = 0 THEN TRUE END AS b FROM nation) t")

# ---- the star schema --------------------------------------------------------------------

statement("shipping_priority", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
statement("local_suppliers", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
statement("forecast_revenue", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
statement("large_orders", "SELECT o_orderkey, round(sum(l_quantity), 2) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING sum(l_quantity) > 200")
statement("order_counts", "SELECT n, CAST(count(*) AS BIGINT) AS customers FROM (SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) t GROUP BY n")
statement("events_by_type", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users, round(avg(value), 4) AS mean FROM events GROUP BY event_type")

# ---- partitions, samples, structs, statistics ------------------------------------------------


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(6 AS INT) AS parts FROM orders")
def repartition_coalesce(spark, sf):
    """Rows dealt by a key to twelve partitions, then joined to six without another shuffle."""
    o = table(spark, sf, "orders").repartition(12, "o_custkey").coalesce(6)
    return o.select(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_distinct("p").cast("int").alias("parts"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
def sort_by_key_range(spark, sf):
    """Range partitions sorted by key; a key range touches few of them."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")
    return o.where(F.col("o_orderkey").between(100, 200))


statement("struct_expansion", "SELECT n_nationkey, n_name AS a, n_regionkey AS b FROM nation", "SELECT n_nationkey, s.* FROM (SELECT n_nationkey, named_struct('a', n_name, 'b', n_regionkey) AS s FROM nation) t")
statement("arithmetic_precedence", "SELECT n_nationkey, 2 + n_nationkey * 3 - 4 % 3 AS v, -(n_nationkey - 5) AS w FROM nation")


@query()
def table_sample(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("pm_orders")
    return spark.sql("SELECT o_orderkey FROM pm_orders TABLESAMPLE (10 PERCENT) REPEATABLE (3)")


@query("SELECT CAST(count(value) AS BIGINT) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd, round(var_samp(value), 2) AS var, min(value) AS least, max(value) AS most, round(sum(value), 2) AS total FROM events")
def double_statistics(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").agg(F.count(v).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("sd"), F.round(F.var_samp(v), 2).alias("var"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.sum(v), 2).alias("total"))


@query()
def quantiles(spark, sf):
    """Greenwald-Khanna quantiles, within the stated error."""
    q = table(spark, sf, "lineitem").approxQuantile("l_extendedprice", [0.1, 0.5, 0.9], 0.01)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(q)], "i int, v double")


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 2 ELSE 1 END) AS BIGINT) AS v FROM events GROUP BY user_id")
def reduce_groups(spark, sf):
    """A fold over each group, with partial results in every task."""
    v = F.when(F.col("event_type") == "click", 2).otherwise(1).cast("long")
    return table(spark, sf, "events").groupBy("user_id").agg(F.sum(v).alias("v"))


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS i, n_name FROM nation")
def zip_with_index(spark, sf):
    """Gapless numbers in key order without one task for all rows: counts by range partition, then offsets."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name").repartitionByRange(4, "n_nationkey").sortWithinPartitions("n_nationkey").withColumn("at", F.monotonically_increasing_id())
    n = n.withColumn("p", F.shiftright("at", 33)).cache()
    before = n.groupBy("p").agg(F.count("*").alias("c")).withColumn("b", F.sum("c").over(Window.orderBy("p")) - F.col("c")).select("p", "b")
    return n.join(F.broadcast(before), "p").select((F.col("b") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("i"), "n_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def dynamic_filter(spark, sf):
    """A filter that only the other side's rows give."""
    r = table(spark, sf, "region").where("r_name LIKE 'A%'").select(F.col("r_regionkey").alias("n_regionkey"))
    return table(spark, sf, "nation").join(r, "n_regionkey", "left_semi").select("n_nationkey", "n_name")

"""More of the function registry, each function over columns of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.suite import query, statement, table
from .metrics import day_difference, second_difference

statement("fn_string_columns", """
SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS f_initcap, format('{:,.2f}', p_retailprice) AS f_number,
       CAST(list_position([p_type, p_brand], p_brand) AS INT) AS f_find, CAST(position('A' IN p_type) AS INT) AS f_locate, printf('%05d', p_size) AS f_format, p_brand AS f_unhex, CAST(p_size AS VARCHAR) AS f_conv,
       CAST(p_size AS VARCHAR) AS f_str_to_map, string_split(lower(p_brand), '#')[1] || CAST(p_size AS VARCHAR) || '.example.com' AS f_url_host, CAST(p_size AS VARCHAR) AS f_url_query,
       '{"k":' || CAST(p_size AS VARCHAR) || '}' AS f_json, hex(encode(p_name)) AS f_binary, p_type AS f_sentences, p_size IS NULL AS f_not_null
FROM part""", """
SELECT p_partkey, initcap(lower(p_name)) AS f_initcap, format_number(p_retailprice, 2) AS f_number,
       find_in_set(p_brand, concat(p_type, ',', p_brand)) AS f_find, locate('A', p_type) AS f_locate, format_string('%05d', p_size) AS f_format, decode(unhex(hex(p_brand)), 'UTF-8') AS f_unhex, conv(hex(p_size), 16, 10) AS f_conv,
       str_to_map(concat('a:', p_size, ',b:0'))['a'] AS f_str_to_map, parse_url(concat('http://', split(lower(p_brand), '#')[0], p_size, '.example.com/x?q=', p_size), 'HOST') AS f_url_host,
       parse_url(concat('http://example.com/x?q=', p_size, '&r=1'), 'QUERY', 'q') AS f_url_query, get_json_object(concat('{"a":{"k":', p_size, '}}'), '$.a') AS f_json, hex(CAST(p_name AS BINARY)) AS f_binary,
       array_join(flatten(sentences(p_type)), ' ') AS f_sentences, assert_true(p_size >= 0) IS NOT NULL AS f_not_null
FROM part""")
statement("fn_xml_columns", """
SELECT p_partkey, p_brand AS f_xpath_string, p_brand AS f_xpath, p_size AS f_int, CAST(p_size AS BIGINT) AS f_long, CAST(p_size AS SMALLINT) AS f_short, p_retailprice AS f_double, p_retailprice AS f_number,
       CAST(p_size AS FLOAT) AS f_float, p_size > 25 AS f_boolean
FROM part""", """
SELECT p_partkey, xpath_string(x, 'a/b') AS f_xpath_string, xpath(x, 'a/b/text()')[0] AS f_xpath, xpath_int(x, 'a/c') AS f_int, xpath_long(x, 'a/c') AS f_long, xpath_short(x, 'a/c') AS f_short, xpath_double(x, 'a/d') AS f_double, xpath_number(x, 'a/d') AS f_number,
       xpath_float(x, 'a/c') AS f_float, xpath_boolean(x, 'a/c > 25') AS f_boolean
FROM (SELECT p_partkey, concat('<a><b>', p_brand, '</b><c>', p_size, '</c><d>', p_retailprice, '</d></a>') AS x FROM part) t""", {"part": ("p_partkey", 8192)})
statement("fn_number_columns", """
SELECT p_partkey, round(exp(p_size / 10.0) - 1, 4) AS f_expm1, round_even(p_size / CAST(2 AS DOUBLE), 0) AS f_bround, round_even(p_size / CAST(2 AS DOUBLE), 0) AS f_rint, CAST(sign(p_size - 25) AS DOUBLE) AS f_signum,
       CAST((CAST(4294967296 AS BIGINT) - p_size - 1) >> 1 AS INT) AS f_sru, CAST(p_size / CAST(4 AS DOUBLE) AS FLOAT) AS f_float, p_size = 10 AS f_equal, NOT (p_size > 10) AS f_bang, CAST(p_size & 6 AS INT) AS f_and,
       CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 0.5 END AS f_nanvl
FROM part""", """
SELECT p_partkey, round(expm1(p_size / 10.0D), 4) AS f_expm1, bround(p_size / 2.0D, 0) AS f_bround, rint(p_size / 2.0D) AS f_rint, signum(p_size - 25) AS f_signum,
       shiftrightunsigned(-p_size - 1, 1) AS f_sru, CAST(p_size / 4.0D AS FLOAT) AS f_float, p_size == 10 AS f_equal, ! (p_size > 10) AS f_bang, p_size & 6 AS f_and,
       nanvl(CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE CAST('NaN' AS DOUBLE) END, 0.5D) AS f_nanvl
FROM part""")
statement("fn_datetime_columns", """
SELECT o_orderkey, strftime(to_timestamp(epoch(date_trunc('second', o_orderdate))) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS f_from_unix, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS f_to_date, CAST(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS VARCHAR) AS f_to_ts,
       CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) AS f_to_unix, CAST(CAST(o_orderdate AS DATE) + CAST(1 + (7 - isodow(CAST(o_orderdate AS DATE))) AS INT) AS VARCHAR) AS f_next_monday,
       CAST(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 9 HOUR AS VARCHAR) AS f_from_utc, CAST(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) - INTERVAL 9 HOUR AS VARCHAR) AS f_to_utc,
       CAST(12 * (year(o_orderdate) - 1990) + month(o_orderdate) - 1 AS DOUBLE) AS f_months
FROM orders""", """
SELECT o_orderkey, from_unixtime(unix_timestamp(o_orderdate)) AS f_from_unix, CAST(to_date(date_format(o_orderdate, 'yyyy-MM-dd'), 'yyyy-MM-dd') AS STRING) AS f_to_date, CAST(to_timestamp(date_format(o_orderdate, 'yyyy-MM-dd')) AS STRING) AS f_to_ts,
       to_unix_timestamp(date_format(o_orderdate, 'yyyy-MM-dd'), 'yyyy-MM-dd') AS f_to_unix, CAST(next_day(o_orderdate, 'MON') AS STRING) AS f_next_monday,
       CAST(from_utc_timestamp(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP), 'Asia/Seoul') AS STRING) AS f_from_utc, CAST(to_utc_timestamp(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP), 'Asia/Seoul') AS STRING) AS f_to_utc,
       months_between(trunc(o_orderdate, 'MONTH'), DATE '1990-01-01') AS f_months
FROM orders""")
statement("fn_aggregate_names", """
SELECT p_brand, round(stddev_samp(p_retailprice), 6) AS f_std, round(stddev_samp(p_retailprice), 6) AS f_stddev, round(var_samp(p_retailprice), 4) AS f_variance, round(avg(p_size), 6) AS f_mean,
       CAST(quantile_disc(p_size, 0.5) AS INT) AS f_approx_percentile, CAST(quantile_disc(p_size, 0.5) AS INT) AS f_percentile_approx
FROM part GROUP BY p_brand""", """
SELECT p_brand, round(std(p_retailprice), 6) AS f_std, round(stddev(p_retailprice), 6) AS f_stddev, round(variance(p_retailprice), 4) AS f_variance, round(mean(p_size), 6) AS f_mean,
       approx_percentile(p_size, 0.5, 1000000) AS f_approx_percentile, percentile_approx(p_size, 0.5, 1000000) AS f_percentile_approx
FROM part GROUP BY p_brand""")
statement("fn_last_value", """
SELECT n_nationkey, first_value(n_name) OVER w AS f, last_value(n_name) OVER w AS l FROM nation
WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
statement("fn_engine_ranges", """
SELECT n_nationkey, true AS f_rand, true AS f_randn, true AS f_today, true AS f_now, true AS f_part, true AS f_id, true AS f_file, true AS f_start, true AS f_length, 'default' AS f_db,
       CAST(n_nationkey AS VARCHAR) AS f_reflect, CAST(n_nationkey AS VARCHAR) AS f_java FROM nation""", """
SELECT n_nationkey, rand(3) >= 0 AND rand(4) < 1 AND random(5) < 1 AS f_rand, abs(randn(3)) < 100 AS f_randn, current_date() = to_date(now()) AS f_today, now() = current_timestamp() AS f_now, spark_partition_id() >= 0 AS f_part,
       monotonically_increasing_id() >= 0 AS f_id, input_file_name() LIKE '%nation%' AS f_file, input_file_block_start() >= 0 AS f_start, input_file_block_length() > 0 AS f_length, current_database() AS f_db,
       reflect('java.lang.Math', 'abs', -n_nationkey) AS f_reflect, java_method('java.lang.Math', 'abs', -n_nationkey) AS f_java FROM nation""")


@query("""
SELECT o_orderkey, CAST(abs(date_diff('day', DATE '1995-06-17', CAST(o_orderdate AS DATE))) AS BIGINT) AS days, CAST(abs((o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 59 - 45296) AS BIGINT) AS seconds
FROM orders""")
def day_second_differences(spark, sf):
    """Differences of days written as yyyymmdd and of times written as hhmmss."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        day_difference(F.date_format("o_orderdate", "yyyyMMdd").cast("int"), 19950617).alias("days"),
        second_difference((k % 24) * 10000 + (k % 60) * 100 + k % 59, 123456).alias("seconds"),
    )


@query("SELECT a.c_custkey AS key, CAST(count(*) AS BIGINT) AS n FROM customer a JOIN customer b ON abs(a.c_acctbal - b.c_acctbal) <= 50 WHERE a.c_custkey IN (3, 17, 40) GROUP BY 1")
def query_record_lookup(spark, sf):
    """Query records found by their ids, each with the rows in its range."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    asked = F.broadcast(c.where(F.col("c_custkey").isin(3, 17, 40)).select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v")))  # three rows
    return c.join(asked, F.col("c_acctbal").between(F.col("v") - 50, F.col("v") + 50) & (F.abs(F.col("c_acctbal") - F.col("v")) <= 50)).groupBy("key").agg(F.count("*").alias("n"))

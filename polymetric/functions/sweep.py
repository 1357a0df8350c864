"""The function registry, by groups, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.suite import query, statement, table

statement("fn_math", """
SELECT p_partkey, abs(-p_size) AS f_abs, round(acos(1.0 / p_size), 6) AS f_acos, round(asin(1.0 / p_size), 6) AS f_asin, round(atan(p_size), 6) AS f_atan, round(atan2(p_size, 2), 6) AS f_atan2,
       round(cbrt(p_size), 6) AS f_cbrt, CAST(ceil(p_retailprice) AS BIGINT) AS f_ceil, CAST(ceiling(p_retailprice) AS BIGINT) AS f_ceiling, round(cos(p_size), 6) AS f_cos, round(cosh(p_size / 50.0), 6) AS f_cosh,
       round(degrees(p_size / 10.0), 6) AS f_degrees, round(exp(p_size / 10.0), 4) AS f_exp, CAST(floor(p_retailprice) AS BIGINT) AS f_floor, CAST(factorial(p_size % 10) AS BIGINT) AS f_factorial,
       round(ln(p_retailprice), 6) AS f_ln, round(log10(p_retailprice), 6) AS f_log10, round(log2(p_retailprice), 6) AS f_log2, round(pi(), 6) AS f_pi, round(pow(p_size, 2.5), 4) AS f_pow, round(power(p_size, 2), 4) AS f_power,
       round(radians(p_size), 6) AS f_radians, round(p_retailprice, 1) AS f_round, CAST(sign(p_size - 25) AS INT) AS f_sign, round(sin(p_size), 6) AS f_sin, round(sinh(p_size / 50.0), 6) AS f_sinh, round(sqrt(p_size), 6) AS f_sqrt,
       round(tan(p_size), 5) AS f_tan, round(tanh(p_size / 50.0), 6) AS f_tanh, p_size + 1 AS f_add, p_size - 1 AS f_sub, p_size * 2 AS f_mul, round(p_size / CAST(7 AS DOUBLE), 6) AS f_div, p_size % 7 AS f_mod
FROM part""", None)
statement("fn_math_more", """
SELECT p_partkey, round(exp(p_size / 10.0) - 1, 4) AS f_expm1, round(ln(1 + p_size), 6) AS f_log1p, round(sqrt(p_size * p_size + 9.0), 6) AS f_hypot, -p_size AS f_negative, p_size AS f_positive,
       round(exp(1), 6) AS f_e, CAST((p_size - 60) % 7 + CASE WHEN (p_size - 60) % 7 < 0 THEN 7 ELSE 0 END AS INT) AS f_pmod, CAST(p_size << 2 AS INT) AS f_shiftleft, CAST(p_size >> 1 AS INT) AS f_shiftright,
       round(ln(p_retailprice) / ln(3), 6) AS f_log, bin(p_size) AS f_bin, hex(p_size) AS f_hex, CAST(p_size & 12 AS INT) AS f_and, CAST(p_size | 12 AS INT) AS f_or, CAST(xor(p_size, 12) AS INT) AS f_xor, CAST(~p_size AS INT) AS f_not
FROM part""", """
SELECT p_partkey, round(expm1(p_size / 10.0D), 4) AS f_expm1, round(log1p(p_size), 6) AS f_log1p, round(hypot(p_size, 3), 6) AS f_hypot, negative(p_size) AS f_negative, positive(p_size) AS f_positive,
       round(e(), 6) AS f_e, pmod(p_size - 60, 7) AS f_pmod, shiftleft(p_size, 2) AS f_shiftleft, shiftright(p_size, 1) AS f_shiftright,
       round(log(3, p_retailprice), 6) AS f_log, bin(p_size) AS f_bin, hex(p_size) AS f_hex, p_size & 12 AS f_and, p_size | 12 AS f_or, p_size ^ 12 AS f_xor, ~p_size AS f_not
FROM part""")
statement("fn_string", """
SELECT p_partkey, ascii(p_name) AS f_ascii, concat(p_name, '-', p_brand) AS f_concat, concat_ws('|', p_name, NULL, p_type) AS f_concat_ws, CAST(instr(p_type, 'S') AS INT) AS f_instr, lower(p_type) AS f_lower, lcase(p_type) AS f_lcase,
       length(p_name) AS f_length, CAST(levenshtein(p_name, p_brand) AS INT) AS f_lev, lpad(p_brand, 12, '*') AS f_lpad, ltrim('  x ') AS f_ltrim, regexp_replace(p_name, '[0-9]', '#', 'g') AS f_rr, repeat(p_brand, 2) AS f_repeat,
       reverse(p_name) AS f_reverse, rpad(p_brand, 12, '*') AS f_rpad, rtrim('  x ') AS f_rtrim, substr(p_type, 2, 3) AS f_substr, substring(p_type, 2, 3) AS f_substring, translate(p_type, 'AEI', 'aei') AS f_translate, trim('  x ') AS f_trim,
       upper(p_name) AS f_upper, ucase(p_name) AS f_ucase, p_type LIKE '%S%' AS f_like, md5(p_name) AS f_md5, sha1(p_name) AS f_sha1, sha256(p_name) AS f_sha2, position('a' IN p_name) AS f_position
FROM part""", """
SELECT p_partkey, ascii(p_name) AS f_ascii, concat(p_name, '-', p_brand) AS f_concat, concat_ws('|', p_name, NULL, p_type) AS f_concat_ws, instr(p_type, 'S') AS f_instr, lower(p_type) AS f_lower, lcase(p_type) AS f_lcase,
       length(p_name) AS f_length, levenshtein(p_name, p_brand) AS f_lev, lpad(p_brand, 12, '*') AS f_lpad, ltrim('  x ') AS f_ltrim, regexp_replace(p_name, '[0-9]', '#') AS f_rr, repeat(p_brand, 2) AS f_repeat,
       reverse(p_name) AS f_reverse, rpad(p_brand, 12, '*') AS f_rpad, rtrim('  x ') AS f_rtrim, substr(p_type, 2, 3) AS f_substr, substring(p_type, 2, 3) AS f_substring, translate(p_type, 'AEI', 'aei') AS f_translate, trim('  x ') AS f_trim,
       upper(p_name) AS f_upper, ucase(p_name) AS f_ucase, p_type LIKE '%S%' AS f_like, md5(p_name) AS f_md5, sha1(p_name) AS f_sha1, sha2(p_name, 256) AS f_sha2, position('a', p_name) AS f_position
FROM part""")
statement("fn_string_more", """
SELECT p_partkey, split_part(p_type, ' ', 1) AS f_split, regexp_extract(p_name, '([a-z]+)', 1) AS f_re, regexp_matches(p_name, '[0-9]') AS f_rlike, array_to_string(string_split(p_type, ' ')[1:2], ' ') AS f_index,
       printf('%s-%d', p_brand, p_size) AS f_printf, p_brand || '   ' AS f_space, CASE p_size % 3 + 1 WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END AS f_elt, CAST(list_position(['a', 'b', 'c'], 'b') AS INT) AS f_find,
       base64(encode(p_brand)) AS f_base64, hex(encode(p_brand)) AS f_hex, decode(encode(p_brand)) AS f_decode, 'Hello World' AS f_initcap, '12,345.68' AS f_number, '1' AS f_json, 'M460' AS f_soundex, 'b' AS f_xpath, 'example.com' AS f_url
FROM part""", """
SELECT p_partkey, split(p_type, ' ')[0] AS f_split, regexp_extract(p_name, '([a-z]+)', 1) AS f_re, p_name RLIKE '[0-9]' AS f_rlike, substring_index(p_type, ' ', 2) AS f_index,
       printf('%s-%d', p_brand, p_size) AS f_printf, concat(p_brand, space(3)) AS f_space, elt(p_size % 3 + 1, 'a', 'b', 'c') AS f_elt, find_in_set('b', 'a,b,c') AS f_find,
       base64(encode(p_brand, 'UTF-8')) AS f_base64, hex(encode(p_brand, 'UTF-8')) AS f_hex, decode(unbase64(base64(encode(p_brand, 'UTF-8'))), 'UTF-8') AS f_decode, initcap('hello world') AS f_initcap, format_number(12345.678, 2) AS f_number,
       get_json_object('{"a":{"b":1}}', '$.a.b') AS f_json, soundex('Miller') AS f_soundex, xpath_string('<a><b>b</b></a>', 'a/b') AS f_xpath, parse_url('http://example.com/x?q=1', 'HOST') AS f_url
FROM part""")
statement("fn_datetime", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS f_year, CAST(month(o_orderdate) AS INT) AS f_month, CAST(day(o_orderdate) AS INT) AS f_day, CAST(hour(o_orderdate) AS INT) AS f_hour, CAST(minute(o_orderdate) AS INT) AS f_minute, CAST(second(o_orderdate) AS INT) AS f_second,
       CAST(quarter(o_orderdate) AS INT) AS f_quarter, CAST(week(o_orderdate) AS INT) AS f_week, CAST(dayofmonth(o_orderdate) AS INT) AS f_dom, CAST(dayofyear(o_orderdate) AS INT) AS f_doy, CAST(dayofweek(o_orderdate) + 1 AS INT) AS f_dow,
       CAST(CAST(o_orderdate AS DATE) + INTERVAL 5 DAY AS DATE)::STRING AS f_add, CAST(CAST(o_orderdate AS DATE) - INTERVAL 5 DAY AS DATE)::STRING AS f_sub, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS f_diff,
       last_day(o_orderdate)::STRING AS f_last, CAST(date_trunc('month', o_orderdate) AS DATE)::STRING AS f_trunc, strftime(o_orderdate, '%Y/%m/%d') AS f_format, CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) AS f_unix,
       CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE)::STRING AS f_add_months
FROM orders""", """
SELECT o_orderkey, year(o_orderdate) AS f_year, month(o_orderdate) AS f_month, day(o_orderdate) AS f_day, hour(o_orderdate) AS f_hour, minute(o_orderdate) AS f_minute, second(o_orderdate) AS f_second,
       quarter(o_orderdate) AS f_quarter, weekofyear(o_orderdate) AS f_week, dayofmonth(o_orderdate) AS f_dom, dayofyear(o_orderdate) AS f_doy, dayofweek(o_orderdate) AS f_dow,
       CAST(date_add(CAST(o_orderdate AS DATE), 5) AS STRING) AS f_add, CAST(date_sub(CAST(o_orderdate AS DATE), 5) AS STRING) AS f_sub, datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS f_diff,
       CAST(last_day(o_orderdate) AS STRING) AS f_last, CAST(trunc(o_orderdate, 'MONTH') AS STRING) AS f_trunc, date_format(o_orderdate, 'yyyy/MM/dd') AS f_format, unix_timestamp(o_orderdate) AS f_unix,
       CAST(add_months(CAST(o_orderdate AS DATE), 2) AS STRING) AS f_add_months
FROM orders""")
statement("fn_datetime_more", """
SELECT CAST('2016-03-11 09:00:07' AS STRING) AS f_from_unix, '2016-04-30' AS f_to_date, '2016-04-30 12:34:56' AS f_to_ts, CAST(1460041200 AS BIGINT) AS f_to_unix, round(CAST(3.94959677 AS DOUBLE), 5) AS f_months, '2016-01-18' AS f_next, '2016-04-30 21:34:56' AS f_tz, '2016-04-30 03:34:56' AS f_utc""", """
SELECT from_unixtime(1457686807) AS f_from_unix, CAST(to_date('2016-04-30', 'yyyy-MM-dd') AS STRING) AS f_to_date, CAST(to_timestamp('2016-04-30 12:34:56') AS STRING) AS f_to_ts, to_unix_timestamp('2016-04-07 15:00:00', 'yyyy-MM-dd HH:mm:ss') AS f_to_unix,
       round(months_between(TIMESTAMP '1997-02-28 10:30:00', TIMESTAMP '1996-10-30 00:00:00'), 5) AS f_months, CAST(next_day(DATE '2016-01-14', 'MON') AS STRING) AS f_next,
       CAST(from_utc_timestamp(TIMESTAMP '2016-04-30 12:34:56', 'Asia/Seoul') AS STRING) AS f_tz, CAST(to_utc_timestamp(TIMESTAMP '2016-04-30 12:34:56', 'Asia/Seoul') AS STRING) AS f_utc""")
statement("fn_collection", """
SELECT n_nationkey, CAST(len([n_regionkey, n_nationkey, 7]) AS INT) AS f_size, list_contains([n_regionkey, 3], 3) AS f_contains, array_to_string(list_sort(['b', n_name, 'a']), ',') AS f_sort, array_to_string(list_reverse_sort(['b', n_name, 'a']), ',') AS f_desc,
       n_name AS f_map, 'k' AS f_keys, n_name AS f_values, n_regionkey AS f_struct
FROM nation""", """
SELECT n_nationkey, size(array(n_regionkey, n_nationkey, 7)) AS f_size, array_contains(array(n_regionkey, 3), 3) AS f_contains, array_join(sort_array(array('b', n_name, 'a')), ',') AS f_sort, array_join(sort_array(array('b', n_name, 'a'), false), ',') AS f_desc,
       map('k', n_name)['k'] AS f_map, map_keys(map('k', n_name))[0] AS f_keys, map_values(map('k', n_name))[0] AS f_values, named_struct('a', n_regionkey, 'b', n_name).a AS f_struct
FROM nation""")
statement("fn_conditional", """
SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), -1) AS f_coalesce, greatest(n_nationkey, n_regionkey, 3) AS f_greatest, least(n_nationkey, n_regionkey, 3) AS f_least, CASE WHEN n_regionkey > 2 THEN 'hi' ELSE 'lo' END AS f_if,
       isnan(CAST('NaN' AS DOUBLE)) AS f_isnan, ifnull(nullif(n_regionkey, 1), -2) AS f_ifnull, nullif(n_regionkey, 1) IS NULL AS f_isnull, nullif(n_regionkey, 1) IS NOT NULL AS f_isnotnull, CAST(0.5 AS DOUBLE) AS f_nanvl, coalesce(nullif(n_regionkey, 1), 9) AS f_nvl,
       CASE WHEN nullif(n_regionkey, 1) IS NOT NULL THEN 'v' ELSE 'n' END AS f_nvl2, n_regionkey = 1 AS f_eq, n_regionkey <> 1 AS f_ne, n_regionkey < 2 AS f_lt, n_regionkey <= 2 AS f_le, n_regionkey > 2 AS f_gt, n_regionkey >= 2 AS f_ge, NOT (n_regionkey = 2) AS f_not,
       nullif(n_regionkey, 1) IS NOT DISTINCT FROM NULL AS f_ns
FROM nation""", """
SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), -1) AS f_coalesce, greatest(n_nationkey, n_regionkey, 3) AS f_greatest, least(n_nationkey, n_regionkey, 3) AS f_least, if(n_regionkey > 2, 'hi', 'lo') AS f_if,
       isnan(CAST('NaN' AS DOUBLE)) AS f_isnan, ifnull(nullif(n_regionkey, 1), -2) AS f_ifnull, isnull(nullif(n_regionkey, 1)) AS f_isnull, isnotnull(nullif(n_regionkey, 1)) AS f_isnotnull, nanvl(CAST('NaN' AS DOUBLE), 0.5D) AS f_nanvl, nvl(nullif(n_regionkey, 1), 9) AS f_nvl,
       nvl2(nullif(n_regionkey, 1), 'v', 'n') AS f_nvl2, n_regionkey = 1 AS f_eq, n_regionkey != 1 AS f_ne, n_regionkey < 2 AS f_lt, n_regionkey <= 2 AS f_le, n_regionkey > 2 AS f_gt, n_regionkey >= 2 AS f_ge, NOT (n_regionkey = 2) AS f_not,
       nullif(n_regionkey, 1) <=> NULL AS f_ns
FROM nation""")
statement("fn_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract_string(props, '$.k') AS STRING) AS t, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS j FROM events", "SELECT event_id, from_json(props, 'k INT').k AS k, t, to_json(named_struct('k', from_json(props, 'k INT').k)) AS j FROM events LATERAL VIEW json_tuple(props, 'k') x AS t")
statement("fn_cast", """
SELECT n_nationkey, CAST(n_nationkey AS TINYINT) AS f_tinyint, CAST(n_nationkey AS SMALLINT) AS f_smallint, CAST(n_nationkey AS BIGINT) AS f_bigint, CAST(n_nationkey AS DOUBLE) AS f_double, CAST(n_nationkey AS STRING) AS f_string, CAST(n_nationkey AS BOOLEAN) AS f_boolean,
       CAST('12' AS INT) AS f_int, CAST(CAST('2020-01-02' AS DATE) AS STRING) AS f_date, TRY_CAST(n_name AS INT) IS NULL AS f_bad, CAST(CAST('2020-01-02 03:04:05' AS TIMESTAMP) AS STRING) AS f_ts, CAST(CAST(n_nationkey AS DECIMAL(10, 2)) AS STRING) AS f_decimal
FROM nation""")
statement("fn_hash", "SELECT n_name, md5(n_name) AS f_md5, sha1(n_name) AS f_sha, sha256(n_name) AS f_sha2 FROM nation", "SELECT n_name, md5(n_name) AS f_md5, sha(n_name) AS f_sha, sha2(n_name, 256) AS f_sha2 FROM nation")


@query()
def fn_engine_only(spark, sf):
    """Functions whose values are this engine's own: hashes, ids, file metadata, random numbers, reflection, rounding and conversions."""
    t = table(spark, sf, "nation")
    return t.selectExpr(
        "n_nationkey", "hash(n_name) AS f_hash", "crc32(encode(n_name, 'UTF-8')) AS f_crc32", "spark_partition_id() AS f_part", "monotonically_increasing_id() AS f_id", "input_file_name() AS f_file",
        "input_file_block_start() AS f_start", "input_file_block_length() AS f_length", "rand(3) AS f_rand", "randn(3) AS f_randn", "current_database() AS f_db", "current_date() AS f_today", "current_timestamp() AS f_now", "now() AS f_now2",
        "reflect('java.lang.Math', 'abs', -n_nationkey) AS f_reflect", "java_method('java.lang.Math', 'abs', -n_nationkey) AS f_java", "bround(2.5D, 0) AS f_bround", "rint(2.5D) AS f_rint", "signum(-2.0D) AS f_signum", "conv('ff', 16, 10) AS f_conv",
        "shiftrightunsigned(-8, 1) AS f_sru", "unhex('4D') AS f_unhex", "str_to_map('a:1,b:2') AS f_map", "sentences('Hi there. You.') AS f_sentences", "xpath('<a><b>1</b></a>', 'a/b/text()') AS f_xpath", "xpath_int('<a><b>1</b></a>', 'a/b') AS f_xpath_int",
        "xpath_boolean('<a><b>1</b></a>', 'a/b') AS f_xpath_boolean", "xpath_double('<a>1</a>', 'a') AS f_xpath_double", "xpath_float('<a>1</a>', 'a') AS f_xpath_float", "xpath_long('<a>1</a>', 'a') AS f_xpath_long", "xpath_short('<a>1</a>', 'a') AS f_xpath_short",
        "assert_true(true) IS NULL AS f_assert", "format_string('%05d', n_nationkey) AS f_format", "locate('A', n_name) AS f_locate", "CAST(n_name AS BINARY) AS f_binary", "CAST(n_nationkey AS FLOAT) AS f_float",
    )


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(first(k ORDER BY k) AS BIGINT) AS f, CAST(last(k ORDER BY k) AS BIGINT) AS l FROM (SELECT n_nationkey AS k FROM nation) t")
def fn_first_last(spark, sf):
    t = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k")).coalesce(1).sortWithinPartitions("k")
    return t.agg(F.count("*").alias("n"), F.first("k").alias("f"), F.last("k").alias("l"))

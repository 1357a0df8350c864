"""What the production queries say that SQL can say too: the same rows through the same operators, with SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pii import pii_query
from .quality import quality_query
from .sharding import shard_query
from .tokens import tokens_query
from .urls import urls_query

_WORDS = r"[^\x20\x09-\x0D]+"


def token_bytes(spark, sf_dir: str) -> DataFrame:
    """Bytes of every text, and that a token count came with each."""
    return tokens_query(spark, sf_dir).select("doc_id", "n_bytes", (F.col("n_tokens") <= F.col("n_bytes") + 1).alias("counted"))


def shard_rows(spark, sf_dir: str) -> DataFrame:
    """Rows and slots of every shard."""
    s = shard_query(spark, sf_dir)
    return s.groupBy("shard", "law").agg(F.count("*").alias("n"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots"))


def shard_sizes(spark, sf_dir: str) -> DataFrame:
    return shard_query(spark, sf_dir).select("doc_id", "size")


def url_parts(spark, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page, and the verdict where a rule gives it."""
    return urls_query(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("said"))


def pii_counts(spark, sf_dir: str) -> DataFrame:
    return pii_query(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def quality_counts(spark, sf_dir: str) -> DataFrame:
    return quality_query(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {
    "token_bytes": token_bytes, "shard_rows": shard_rows, "shard_sizes": shard_sizes, "url_parts": url_parts, "pii_counts": pii_counts, "quality_counts": quality_counts,
}

SQL = {
    "token_bytes": "SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, true AS counted FROM documents",
    "shard_rows": """
WITH c AS (SELECT count(*) AS n FROM documents), s AS (SELECT unnest(range(8)) AS shard),
     b AS (SELECT shard, (shard * n + 7) // 8 AS lo, ((shard + 1) * n + 7) // 8 AS hi FROM s, c)
SELECT CAST(shard AS INT) AS shard, 'rows' AS law, CAST(hi - lo AS BIGINT) AS n, CAST(0 AS BIGINT) AS first, CAST(hi - lo - 1 AS BIGINT) AS last, CAST(hi - lo AS BIGINT) AS slots FROM b WHERE hi > lo""",
    "shard_sizes": "SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size FROM documents",
    "url_parts": r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
     h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '/.*$', 0, 's') AS path FROM r),
     rules AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(name, start, said)),
     fits AS (SELECT page_id, arg_max(name || start, length(name || start)) AS rule, arg_max(said, length(name || start)) AS said FROM h JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id)
SELECT h.page_id, host, path, rule, said FROM h LEFT JOIN fits ON fits.page_id = h.page_id""",
    "pii_counts": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') AS i,
                  list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS c, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS p FROM t)
SELECT doc_id, CAST(len(e) AS BIGINT) AS n_email, CAST(len(list_filter(i, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: CAST(y AS HUGEINT))) <= 255)) AS BIGINT) AS n_ip,
       CAST(len(list_filter(c, lambda x: length(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda k: CASE WHEN (length(x) - k) % 2 = 0 THEN CAST(x[k] AS INT) WHEN CAST(x[k] AS INT) > 4 THEN 2 * CAST(x[k] AS INT) - 9 ELSE 2 * CAST(x[k] AS INT) END)) % 10 = 0)) AS BIGINT) AS n_card,
       CAST(len(list_filter(p, lambda x: length(x) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone FROM m""",
    "quality_counts": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w, coalesce(text, '') AS t, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS l FROM documents),
     g AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3) q),
     r AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) q WHERE n > 1),
     k AS (SELECT doc_id, count(DISTINCT i) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
       CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(k.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(k.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
}

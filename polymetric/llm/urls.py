"""URL filter: prefix rules first, then logistic regression on character n-grams.

Host and path are cut into character n-grams, hashed into a fixed number of
weights, and scored by a logistic regression that is trained on the driver
from a small labelled table of URLs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, without

#: (host and path prefix, verdict)
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
BITS, GRAMS = 16, (3, 4, 5)

#: The labelled table is built from these words: hosts of kinds that crawls
#: leave out, and hosts of ordinary sites.
BAD_WORDS = "casino poker bets betting jackpot slots gamble lottery pills viagra pharma cheap-meds adult porn xxx sex escort webcam spam farm-links linkfarm seo-boost ads adserver tracker track-click popunder banner malware phish warez crack keygen torrent free-money payday loans-fast win-prize clickbait replica diet-pills".split()
GOOD_WORDS = "news library museum docs wiki university school garden kitchen travel history science weather music books health journal archive forum recipes theatre nature physics chess cycling market village council energy paper stories gazette review atlas letters botany harbour mountain river bridge".split()
#: Ordinary hosts also have invented names, built from these syllables.
SYLLABLES = "th er on an in re nd ha he ea or ti es st en ed to it ou ing ion ble ly sh wh at".split()


def labelled_urls() -> list[tuple[str, str, int]]:
    """About a thousand rows (host, path, label), label 1 to block; the same at every call."""
    rng, out = np.random.default_rng(3), []
    tops, langs, subs = ("com", "net", "org", "info"), ("en", "de", "fr", "es"), ("", "www.", "m.", "blog.")
    invented = ["".join(rng.choice(SYLLABLES, rng.integers(2, 5))) for _ in range(160)]
    extra = ("-win", "-x", "-online", "-free", "24", "-club", "", "")

    def path() -> str:
        return f"/{rng.choice(langs)}/{rng.integers(1, 999)}" + rng.choice(["", "/", ".html"])

    for words, label, n in ((BAD_WORDS, 1, 12), (GOOD_WORDS, 0, 6), (invented, 0, 2)):
        for word in words:
            for _ in range(n):
                tail = rng.choice(extra) if label else rng.choice(("", "", "-online", "24"))
                middle = "example." if rng.random() < 0.7 else ""
                out.append((f"{rng.choice(subs)}{word}{tail}.{middle}{rng.choice(tops)}", path(), label))
    return out


def slots(host: str, path: str) -> list[int]:
    """Hashed n-grams of host and path, apart from each other; each slot once."""
    found = set()
    for name, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            found.update(name + s[i : i + n] for i in range(max(0, len(s) - n + 1)))
    return sorted({zlib.crc32(g.encode("utf-8", "replace")) & ((1 << BITS) - 1) for g in found})


def train(rows: list[tuple[str, str, int]], epochs: int = 30, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias; AdaGrad over the rows in a seeded order."""
    rng = np.random.default_rng(5)
    w, seen = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-8)
    table = [(np.array([*slots(h, p), 1 << BITS]), y) for h, p, y in rows]
    for _ in range(epochs):
        for i in rng.permutation(len(table)):
            x, y = table[i]
            scale = 1 / np.sqrt(len(x))
            g = (1 / (1 + np.exp(-w[x].sum() * scale)) - y) * scale + decay * w[x]
            seen[x] += g * g
            w[x] -= rate * g / np.sqrt(seen[x])
    return w


def score(w: np.ndarray, hosts, paths) -> np.ndarray:
    """Probability that each URL is one to block."""
    out = np.empty(len(hosts))
    for i, (h, p) in enumerate(zip(hosts, paths)):
        x = [*slots(h, p), 1 << BITS]
        out[i] = w[x].sum() / np.sqrt(len(x))
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower-case ASCII and path; both empty without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(rest, "/", 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def filter_urls(df: DataFrame, url: str = "url", rules=RULES, rows=None, threshold: float = 0.5) -> DataFrame:
    """All columns of ``df`` with ``host, path, rule, block_score, verdict``.

    ``rows`` is the labelled table (host, path, 1 to block), held by the
    driver; by default the built-in one.  A null URL, or one without ``://``,
    has empty host and path and is allowed: nothing in it speaks against it.
    Rows are independent; repeated rows repeat their verdict, an empty table
    gives an empty one.  Columns of ``df`` with these names are replaced.
    """
    spark = df.sparkSession
    ship(spark)
    weights = spark.sparkContext.broadcast(train(rows or labelled_urls()).astype("float32"))  # 2**BITS numbers

    @F.pandas_udf("double")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series(score(weights.value, hosts.tolist(), paths.tolist()))

    data = without(df, "host", "path", "rule", "block_score", "verdict")
    host, path = host_and_path(F.col(url).cast("string"))
    data = data.withColumns({"host": host, "path": path})
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    data = data.withColumns({"rule": rule, "__said": said, "block_score": judge("host", "path")})
    own = F.when((F.col("block_score") > threshold) & (F.col("host") != ""), "block").otherwise("allow")
    return data.withColumn("verdict", F.coalesce("__said", own)).drop("__said")


def urls_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")

"""Quality rules by weak supervision, in DataFrame operations only.

Each rule looks at a few counts of a text and votes that it is good (1), bad
(-1) or abstains (0).  Expectation-maximisation estimates, for good and for
bad texts, how often each rule casts each vote; all it needs of the corpus is
how often each pattern of votes occurs, a table bounded by the number of
rules.  A text is kept if its posterior probability of being good is a half
or more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize, text_or_empty, without

SYMBOLS = "#*$%&|<>"
#: Frequent short words of a few languages.
STOP_WORDS = (
    "the of and to in is it that for on with as was be by are this from at or an have not but they you"
    " der die das und ist nicht ein eine zu den mit sich auf für von dem im er sie es"
    " le la les de des et un une est que qui dans pour en pas sur par avec du au"
    " el los las y con se del una lo como no su al"
).split()
VOTES = (-1, 0, 1)
#: What is believed of a rule before any text is seen, by class: shares of the
#: votes bad, abstain, good.  It weighs as much as STRENGTH of the corpus.
PRIOR = {"bad": (0.40, 0.20, 0.40), "good": (0.03, 0.17, 0.80)}
PRIOR_BAD, STRENGTH, ROUNDS, TOLERANCE = 0.2, 0.02, 30, 1e-5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_stop_words", "n_letters", "n_capitals", "n_lines")


def counted(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df`` with the counts that rules look at, as longs.

    Windows of three words are compared by 64-bit hashes within one text.
    """
    body = text_or_empty(text)
    data = without(df, *COUNTS, *MORE, "__text", "__words", "__lines", "__hashes", "__sorted").withColumn("__text", body)
    t = F.col("__text")
    bare = F.btrim(t, F.lit(SPACES))
    none = F.array().cast("array<string>")
    data = data.withColumns({
        "__words": F.when(bare == "", none).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")),
        "__lines": F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
    })
    w = F.col("__words")
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<bigint>"))
    data = data.withColumn("__hashes", windows)
    h = F.col("__hashes")
    # Most texts repeat no window: only the others pay for a sort.
    twice = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    data = data.withColumn("__sorted", twice)
    s = F.col("__sorted")
    again = F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == e["h"])))
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))
    stop = F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS)))
    letters = F.regexp_replace(t, r"\P{L}+", "")
    return data.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.when(s.isNull(), F.lit(0)).otherwise(covered).cast("long"),
        "n_stop_words": stop.cast("long"),
        "n_letters": F.length(letters).cast("long"),
        "n_capitals": (F.length(letters) - F.length(F.regexp_replace(letters, r"\p{Lu}+", ""))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
    }).drop("__text", "__words", "__lines", "__hashes", "__sorted")


def vote(value: Column, of: Column, bad, good) -> Column:
    """-1, 1 or 0 by the share ``value / of``; a text with nothing to judge abstains."""
    share = F.when(of > 0, value / of)
    return F.when(bad(share), F.lit(-1)).when(good(share), F.lit(1)).otherwise(F.lit(0)).cast("int")


def rules() -> dict[str, Column]:
    c = F.col
    return {
        "word_length": vote(c("word_chars"), c("n_words"), lambda x: (x < 3) | (x > 10), lambda x: (x >= 4) & (x <= 7)),
        "symbols": vote(c("n_symbols"), c("n_words"), lambda x: x > 0.1, lambda x: x <= 0.02),
        "lines": vote(c("n_dup_lines"), c("n_lines"), lambda x: x > 0.3, lambda x: x <= 0.1),
        "repeats": vote(c("n_repeat_words"), c("n_words"), lambda x: x > 0.3, lambda x: x <= 0.15),
        "stop_words": vote(c("n_stop_words"), c("n_words"), lambda x: x < 0.06, lambda x: x >= 0.12),
        "capitals": vote(c("n_capitals"), c("n_letters"), lambda x: x > 0.3, lambda x: x <= 0.15),
        "letters": vote(c("n_letters"), c("word_chars"), lambda x: x < 0.6, lambda x: x >= 0.8),
    }


def log_odds(names: list[str], share_bad: float, theta: dict[str, list[list[float]]]) -> Column:
    """Of being bad, given the votes in columns ``names``.

    The weights are one array, not numbers spread over the expression: Spark
    compiles the same code for every corpus.
    """
    weights = [math.log(b / g) for bad, good in zip(theta["bad"], theta["good"]) for b, g in zip(bad, good)]
    table = F.array(*map(F.lit, [*weights, math.log(share_bad / (1 - share_bad))]))
    out = table[len(weights)]
    for j, name in enumerate(names):
        out = out + table[F.col(name) + (len(VOTES) * j + 1)]
    return out


def fit(patterns: DataFrame, names: list[str]) -> tuple[float, dict[str, list[list[float]]]]:
    """Share of bad texts and vote shares by class, from patterns of votes with their counts ``n``.

    There are at most ``len(VOTES) ** len(names)`` patterns, whatever the
    corpus: one job counts them, and the rounds are sums over that table.
    """
    theta = {y: [list(PRIOR[y]) for _ in names] for y in PRIOR}
    share = PRIOR_BAD
    seen = [(r["n"], [r[name] - VOTES[0] for name in names]) for r in patterns.select("n", *names).collect()]
    total = sum(n for n, _ in seen)
    if not total:
        return share, theta
    weight = STRENGTH * total
    for _ in range(ROUNDS):
        sums = {y: [[0.0] * len(VOTES) for _ in names] for y in PRIOR}
        all_bad, base = 0.0, math.log(share / (1 - share))
        odds = [[math.log(b / g) for b, g in zip(bad, good)] for bad, good in zip(theta["bad"], theta["good"])]
        for n, votes in seen:
            bad = n / (1 + math.exp(-base - sum(odds[j][v] for j, v in enumerate(votes))))
            all_bad += bad
            for j, v in enumerate(votes):
                sums["bad"][j][v] += bad
                sums["good"][j][v] += n - bad
        texts = {"bad": all_bad, "good": total - all_bad}
        new = {y: [[(x + weight * p) / (texts[y] + weight) for x, p in zip(row, PRIOR[y])] for row in sums[y]] for y in PRIOR}
        moved = max(abs(a - b) for y in new for p, q in zip(new[y], theta[y]) for a, b in zip(p, q))
        share, theta = (all_bad + weight * PRIOR_BAD) / (total + weight), new
        if moved < TOLERANCE:
            break
    return share, theta


def judge(df: DataFrame, text: str = "text", carry_text: bool = True) -> DataFrame:
    """All columns of ``df`` (without the text if not ``carry_text``) with counts, ``base_failed, p_good, kept``.

    A null text is empty; a text without words fails the base rules, and its
    rules abstain.  Rows are judged alike wherever they are, so repeated rows
    get equal verdicts, though each counts as a row for the estimates.  An
    empty table gives an empty one.  Columns of ``df`` with the names of the
    result's are replaced.
    """
    votes = {f"__v_{k}": v for k, v in rules().items()}
    data = counted(without(df, "base_failed", "p_good", "kept", *votes), text).withColumns(votes)
    if not carry_text:
        data = data.drop(text)
    written = materialize(data, "quality")
    names = list(votes)
    share, theta = fit(written.groupBy(*names).agg(F.count("*").alias("n")), names)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = 1 / (1 + F.exp(log_odds(names, share, theta)))
    out = written.withColumns({"base_failed": failed, "p_good": good})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)).drop(*names)


def quality_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, carry_text=False).select("doc_id", *COUNTS, "base_failed", "kept", "p_good")

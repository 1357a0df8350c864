"""Language identification by compression.

Every language has a zstandard raw-content dictionary, put together from
pieces of a bounded sample of labelled texts.  A text is compressed whole with each dictionary
and belongs to the language that makes it smallest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_or_empty, without

#: A language's dictionary has at most DICT_BYTES, and all of them ALL_BYTES: the more
#: languages there are, the smaller their dictionaries.  Each worker holds them all.
DICT_BYTES, ALL_BYTES = 128 << 10, 64 << 20
#: Characters that one text gives to a dictionary.
PIECE = 256
#: With more languages than this, dictionaries would say nothing: learning refuses.
MOST_LANGS = 16_384
LEVEL = 6
UNKNOWN = "und"
word_like = re.compile(r"[^\W\d_]").finditer


def letter(text: str) -> bool:
    """Whether some character is a letter (marks, numbers in letters and fractions are none)."""
    return any(m[0].isalpha() for m in word_like(text))


def fold(text: str) -> bytes:
    """What is compressed: lower case, so that capitals match, between spaces."""
    return f" {text.lower()} ".encode("utf-8", "replace")


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionaries by language, the most frequent one first.

    The rows of a language are dealt over hash slots, and the row with the
    least hash in each slot gives PIECE characters, from a place in the whole
    text that its hash names.  So the sample is bounded by slots, whatever
    the table's size, no language is left out, and tasks combine slots before
    they send them.  Rows with a null language or an empty text teach
    nothing; repeated rows count once.
    """
    body = F.col(text).cast("string")
    rows = labelled.where(F.col(lang).isNotNull() & (F.octet_length(text_or_empty(text)) > 0)).select(F.col(lang).alias("lang"), F.col(key).alias("key"), body.alias("t"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not counts:
        return {}
    size = min(DICT_BYTES, ALL_BYTES // len(counts))
    h = F.xxhash64(F.lit(10), F.col("key").cast("string"), F.xxhash64("t"))
    slot = F.pmod(F.xxhash64(F.lit(11), "h"), F.lit(2 * size // PIECE))
    start = F.pmod(F.xxhash64(F.lit(12), "h"), F.greatest(F.lit(1), F.length("t") - PIECE + 1)) + 1
    piece = F.substring("t", start.cast("int"), F.lit(PIECE))
    some = rows.withColumn("h", h).select("lang", slot.alias("slot"), "h", piece.alias("piece"))
    found: dict[str, list[tuple[int, str]]] = {k: [] for k in counts}
    for r in some.groupBy("lang", "slot").agg(F.min(F.struct("h", "piece")).alias("m")).collect():  # at most 2 * ALL_BYTES characters
        found[r["lang"]].append((r["m"]["h"], r["m"]["piece"]))
    frequent = sorted(counts, key=lambda k: (-counts[k], k))
    return {k: b"".join(fold(piece) for _, piece in sorted(found[k]))[:size] for k in frequent}


class Classifier:
    def __init__(self, contents: dict[str, bytes]):
        self.langs = list(contents)
        self.compress = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False))

    def sizes(self, text: str) -> list[int]:
        raw = fold(text)
        return [len(c.compress(raw)) for c in self.compress]

    def predict(self, text: str) -> tuple[str, float]:
        """The language and a score of 0 to 1: how much larger the second smallest is, as a share of it.

        A text without letters is of no language, with score 0; so is every
        text if no language was learned.  Equal sizes go to the more frequent
        language.
        """
        if not self.langs or not letter(text):
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(order) == 1:
            return self.langs[0], 1.0
        best, second = sizes[order[0]], sizes[order[1]]
        return self.langs[order[0]], (second - best) / second


def identify(df: DataFrame, contents: dict[str, bytes], text: str = "text", narrow: float = 0.005) -> DataFrame:
    """All columns of ``df`` with ``lang_pred``, ``score`` and ``rejected``.

    ``score`` is the margin between the smallest and the second size as a
    share of the latter; below ``narrow`` the prediction is kept but marked
    ``rejected``.  Null texts and texts without a letter give ``und``, 0 and
    true.  Rows are independent; an empty table gives an empty one.  Columns
    of ``df`` with these names are replaced.
    """
    spark = df.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(contents)  # at most ALL_BYTES

    @F.pandas_udf("lang string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Classifier(known.value)
        for batch in batches:
            found = [model.predict(t) for t in batch]
            yield pd.DataFrame({"lang": [f[0] for f in found], "score": [f[1] for f in found]})

    data = without(df, "lang_pred", "score", "rejected", "__guess").withColumn("__guess", guess(text_or_empty(text)))
    return data.withColumns({"lang_pred": F.col("__guess.lang"), "score": F.col("__guess.score"), "rejected": F.col("__guess.score") < narrow}).drop("__guess")


def held_out():
    """Documents that nothing is learned from; those without an id are among the learned ones."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(F.encode(key, "UTF-8")) % 4 == 2


def langid_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    contents = learn(docs.where(~held_out()))
    marked = docs.select("doc_id", "text").withColumn("held_out", held_out())
    return identify(marked, contents).select("doc_id", "held_out", "lang_pred", "score", "rejected")

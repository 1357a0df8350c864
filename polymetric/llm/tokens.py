"""Token counts with a whole-token shortcut.

No piece of the vocabulary has a space mark behind another character, and
none holds a line feed, so the library never merges across the start of a run
of space marks or around a line feed: texts fall into pre-tokens that encode
independently (``prove`` checks both).  A vocabulary string that encodes
alone as one token is counted by a look-up; only the other pre-tokens go
through the library's merges, many in one call, each distinct one once while
it stays cached.

Texts of the vocabulary's own characters take the same way inside tiktoken,
with the pieces as ranks: it splits by the same expression, looks a pre-token
up and merges the others.  The library merges the two neighbours whose piece
has the highest score, tiktoken those of the lowest rank, both the leftmost of
equals, so ranks in the order of scores give the same tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_or_empty, without

MARK = "▁"
#: A run of spaces with what follows, a stretch without spaces, or a line feed.
PRETOKEN = r" +[^ \n]*|[^ \n]+|\n"
pretokens = re.compile(PRETOKEN).findall
#: Distinct pre-tokens remembered by a worker, and the longest remembered.
CACHE, LONGEST = 200_000, 64
#: Pre-tokens that go to the library in one text.
JOINED = 128
#: Characters without a break from which on a text goes to the library, whose time is not quadratic in them.
STRETCH = 500


@lru_cache(2)
def library(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def prove(path: str) -> frozenset[str]:
    """Pre-tokens that are one token, each tried with the library.

    Raises ValueError if the vocabulary has pieces that cross pre-tokens.
    """
    sp = library(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    if any("\n" in p or MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("pieces cross pre-tokens: the shortcut doesn't hold for this vocabulary")
    spaced = [p.replace(MARK, " ") for p in pieces if p.startswith(MARK)]
    bare = [p for p in pieces if MARK not in p]
    one = {p for p, ids in zip(spaced, sp.encode([p[1:] for p in spaced])) if len(ids) == 1}
    head = len(sp.encode("\n"))
    one |= {p for p, ids in zip(bare, sp.encode(["\n" + p for p in bare])) if len(ids) == head + 1}
    return frozenset(one - {" "})


@lru_cache(2)
def ranks(path: str) -> tuple[Callable[[str], list[int]], Callable[[str], object]] | None:
    """An encoder that gives as many tokens as the library, and a search for what it can't be given; None where that isn't proved for the vocabulary.

    Not given are characters that are no pieces, runs of spaces, whose pieces
    may have equal scores, and long stretches without a break.
    """
    sp, one = library(path), prove(path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    score = {p: sp.get_score(i) for i in ids if (p := sp.id_to_piece(i)).strip(MARK)}
    chars = {p for p in score if len(p) == 1}
    longer = sorted((p for p in score if len(p) > 1), key=lambda p: -score[p])
    known = all(c in chars or c == MARK for p in longer for c in p)
    distinct = len({score[p] for p in longer}) == len(longer) and not any(map(sp.is_unused, ids))
    looked_up = all(p.replace(MARK, " ") in one for p in score)
    kept = "e\u0301 \ufb01 \u2460 \uff71"  # a library that rewrites texts would change this
    if not (known and distinct and looked_up and len(sp.encode("\n")) == 2 and sp.decode(sp.encode(kept)) == kept):
        return None
    rank = {bytes([b]): b for b in range(256)}
    for c in sorted(chars):  # the bytes of a character come together before all else
        for k in range(2, len(c.encode()) + 1):
            rank.setdefault(c.encode()[:k], len(rank))
    for p in longer:
        rank[p.replace(MARK, " ").encode()] = len(rank)
    own = "".join(map(re.escape, sorted(chars)))
    unfit = re.compile(rf"[^ \n{own}]|  |(?<![^ \n])[^ \n]{{{STRETCH}}}").search
    return tiktoken.Encoding("own", pat_str=PRETOKEN, mergeable_ranks=rank, special_tokens={}).encode_ordinary, unfit


class Counts:
    """Counts tokens of texts; holds at most CACHE merged pre-tokens, half of them those met since the other half filled."""

    def __init__(self, path: str, one: frozenset[str]):
        self.sp = library(path)
        head = self.sp.encode("\n")
        self.head, self.newline = len(head), len(head) - 1  # beside the mark that the library puts first
        #: The id that tells joined pre-tokens apart, where a line feed is one token.
        self.apart = head[-1] if self.newline == 1 and not self.sp.is_unknown(head[-1]) else None
        self.base = dict.fromkeys(one, 1) | {"\n": self.newline, " ": 1}
        self.known, self.old, self.ranks = dict(self.base), {}, ranks(path)

    def merge(self, parts: list[str]) -> list[int]:
        """The library's counts: parts go joined by line feeds, JOINED at a time, and their tokens are told apart by its id."""
        out = []
        for i in range(0, len(parts), JOINED):
            some = parts[i : i + JOINED]
            if self.apart is not None:
                ids = np.array(self.sp.encode("\n" + "\n".join(some), num_threads=1))
                ends = np.append(np.flatnonzero(ids == self.apart), len(ids))
                if len(ends) == len(some) + 1:
                    out += (np.diff(ends) - 1).tolist()
                    continue
            out += self.single(some)
        return out

    def single(self, parts: list[str]) -> list[int]:
        """The same, each part by itself: the mark the library puts first is the part's own, or is taken off with a line feed."""
        asked = [p[1:] if p[0] == " " else "\n" + p for p in parts]
        return [1 if p == " " else len(ids) - (0 if p[0] == " " else self.head) for p, ids in zip(parts, self.sp.encode(asked, num_threads=1))]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = " " + text.replace(MARK, " ")
        if self.ranks is not None and not self.ranks[1](text):
            return len(self.ranks[0](text))
        parts = pretokens(text)
        found = list(map(self.known.get, parts))
        if None not in found:
            return sum(found)
        total, rest = sum(filter(None, found)), Counter(p for p, n in zip(parts, found) if n is None)
        new = [p for p in rest if p not in self.old]
        tokens = {p: self.old[p] for p in rest if p in self.old} | dict(zip(new, self.merge(new)))
        keep = {p: n for p, n in tokens.items() if len(p) <= LONGEST}
        if len(self.known) - len(self.base) + len(keep) > CACHE // 2:
            self.known, self.old = dict(self.base), self.known
        if len(keep) <= CACHE // 2:
            self.known |= keep
        return total + sum(n * tokens[p] for p, n in rest.items())


@lru_cache(2)
def counter(path: str) -> Counts:
    """The counter of a worker, which keeps what it has merged from one task to the next."""
    return Counts(path, prove(path))


def count_tokens(df: DataFrame, path: str | None = None, limit: int = 4096, text: str = "text") -> DataFrame:
    """All columns of ``df`` with ``n_bytes, n_tokens`` (long) and ``over_limit`` (boolean).

    Counts are those of the library for the whole text, without begin, end or
    other special tokens.  A null text counts as empty: no bytes, no tokens.
    Rows are independent, so repeated rows repeat their counts and an empty
    table gives an empty one.  Columns of ``df`` with these names are replaced.
    """
    spark = df.sparkSession
    ship(spark)
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    prove(path)  # an unfit vocabulary is refused here, not on the executors

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = counter(path)
        for batch in batches:
            yield pd.Series([counts.count(t) for t in batch], dtype="int64")

    data = without(df, "n_bytes", "n_tokens", "over_limit")
    body = text_or_empty(text)
    counted = data.withColumn("n_bytes", F.octet_length(body).cast("long")).withColumn("n_tokens", tokens(body))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def tokens_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")

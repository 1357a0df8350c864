"""Small tables with the awkward rows: nulls, empty and long texts, repeated rows, columns with clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in house river green stone market lamp yellow bread window paper garden music number seven bright".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def awkward(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 200)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "B", None]), rng.randint(0, 9)) for i in range(n)]
    rows += [
        (100, None, "en", "a", None), (101, "", "en", "a", 0), (102, " \t\n", None, None, 3), (103, "x" * 120_000, "de", "b", 1), (104, "word " * 20_000, "en", "b", 1),
        (105, "one two", "en", "a", 1), (105, "one two", "en", "a", 1), (None, "no id here at all really", "en", None, 1), (None, None, None, None, None),
        (106, rows[3][1], "en", "b", 2), (107, rows[3][1] + " more", "en", "b", 2), (107, "other text under one id", "en", "b", 2), (108, "ÀÉ ▁ <s> <|endoftext|> \x00 \u2028 日本語", None, "b", 2),
        (109, "write a.b@mail.example.com or +1 (599) 555-3756 at 10.2.3.4 with 4111 1111 1111 1111", "en", "a", 4), (110, "call (599) 555-3756. anna [at] mail [dot] org", "en", "a", 4),
    ]
    return rows


def clashing(df):
    """Every name that an operator adds is there already, in other capitals too."""
    from pyspark.sql import functions as F

    names = "n_bytes n_tokens over_limit Shard slot host path rule verdict n_email spans size source_size target copies n_words kept p_good base_failed lang_pred score rejected sequence_id offset".split()
    return df.withColumns({n: F.lit("old") for n in names})

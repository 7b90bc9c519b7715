"""Small fixtures and brute-force helpers for the tests of this folder."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower_az(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(seed: int, n: int, vocabulary: int = 300, prefix: str = "w") -> str:
    rng = random.Random(seed)
    return " ".join(f"{prefix}{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, a very long one, ties and
    repeated rows."""
    long_text = prose(7, 30_000, 5_000) + "\nénd"
    return [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b\x0c\r", None, "b", 6),
        (4, "one", "en", None, 3),
        (5, long_text, "en", "b", len(long_text)),
        (6, prose(1, 80), "en", "a", None),
        (7, prose(1, 80), "en", "a", None),
        (8, prose(2, 60), "de", "a", 1),
        (8, prose(2, 60), "de", "a", 1),
        (8, prose(2, 60), "de", "a", 1),
        (None, prose(3, 70), "de", "b", 1),
        (None, None, None, None, None),
        (9, "a\x00b \U0001f642 漢字漢字 it's <|endoftext|> end", "fr", "c", 2),
    ]


def documents(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def with_clashes(df):
    """Extra columns with names that the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("id", "n", "size", "row", "word", "key", "digest", "group", "unit", "cell", "v", "h", "shard",
             "copies", "kept", "score", "fold", "toxic_", "rate", "term", "label", "rank")
    return df.select("*", *[F.lit(1).alias(name) for name in names])


def with_inner_clashes(df):
    """Extra columns with names of what operators work out on their way."""
    from pyspark.sql import functions as F

    names = ("_text", "_id", "_row", "row", "_quality", "_parts", "_figures", "_language", "_held_out", "_letter", "_score")
    return df.select("*", *[F.lit(1).alias(name) for name in names])

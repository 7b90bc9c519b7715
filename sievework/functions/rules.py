"""Row rules as boolean Column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework import lexicons
from sievework.config import LengthBounds
from sievework.functions.expr import caseless, contains_any, let
from sievework.functions.lexicon import WORD_END, at_word_start, has_word, quote, with_lead
from sievework.functions.text import SPACE_CHARS, word_count

TOMBSTONES = ("[removed]", "[deleted]")

# What people write in place of a letter to get past a filter.
LETTER_SWAPS = {"i": "[i1!|]", "a": "[a@4]", "e": "[e3]", "o": "[o0]"}


def obfuscation_patterns(
    words: Iterable[str], swaps: Mapping[str, str] = LETTER_SWAPS
) -> tuple[str, ...]:
    """Each word with its letters widened to what may stand for them."""
    return tuple(
        "".join(swaps.get(ch, quote(ch)) for ch in word.strip().lower()) for word in words
    )


def is_tombstone(text: Column) -> Column:
    """The text holds the mark of a removed post."""
    return let(F.lower(text), lambda t: contains_any(t, TOMBSTONES))


def is_empty(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE_CHARS)) == ""


def length_ok(
    text: Column, bounds: LengthBounds = LengthBounds(), n_words: Column | None = None
) -> Column:
    n_words = word_count(text) if n_words is None else n_words
    in_words = let(n_words, lambda n: n.between(bounds.min_words, bounds.max_words))
    return (F.length(text) <= bounds.max_chars) & in_words


def has_listed_word(
    text: Column, words: Iterable[str] = lexicons.BLOCKLIST, match: str = "prefix"
) -> Column:
    return has_word(text, words, match)


def has_obfuscated_word(
    text: Column, patterns: Iterable[str] = lexicons.OBFUSCATIONS, match: str = "prefix"
) -> Column:
    """A word starts with one of `patterns`, which are given in lower case, or, with
    `match="word"`, is one of them."""
    patterns = tuple(patterns)
    if not patterns:
        return F.lit(False)
    any_of = "|".join(patterns)
    return with_lead(text).rlike(at_word_start(f"(?:{any_of}){WORD_END}" if match == "word" else any_of))


def is_offensive(
    text: Column,
    words: Iterable[str] = lexicons.BLOCKLIST,
    patterns: Iterable[str] = lexicons.OBFUSCATIONS,
    match: str = "prefix",
) -> Column:
    return has_listed_word(text, words, match) | has_obfuscated_word(text, patterns, match)


def is_meta_post(
    text: Column,
    phrases: Iterable[str] = lexicons.META_PHRASES,
    patterns: Iterable[tuple[str, str]] = lexicons.META_PATTERNS,
) -> Column:
    """A phrase occurs anywhere, or a pattern does; a pattern comes with a plain
    part that must occur for it to match."""

    def test(t: Column) -> Column:
        found = contains_any(t, phrases)
        for part, pattern in patterns:
            found = found | (F.contains(t, F.lit(part)) & t.rlike(pattern))
        return found

    return let(caseless(text), test)


def has_min_score(score: Column, least: float = 100) -> Column:
    """A score from `least` on; a missing score is none."""
    return F.coalesce(~F.isnan(score.cast("double")) & (score >= least), F.lit(False))


def is_unflagged(flag: Column) -> Column:
    """Not marked as unfit for work; a missing mark is none."""
    return ~F.coalesce(flag.cast("boolean"), F.lit(False))


def row_drop_reason(
    text: Column, bounds: LengthBounds = LengthBounds(), n_words: Column | None = None
) -> Column:
    """The first row rule a normalised text fails, or null."""
    return F.when(is_empty(text) | is_tombstone(text), "dead_or_empty").when(
        ~length_ok(text, bounds, n_words), "length"
    )

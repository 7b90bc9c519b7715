"""Text clean-up as Column expressions.

Everything runs inside the JVM except entity decoding and NFKC folding, for
which Spark has no function. Only texts that may change under those two are
handed to Python; for all others the Arrow batch carries a null.

A regex pass costs many times a byte search, so each rule first looks for
something without which it cannot apply. Whitespace is spelled out as a
character class because the shorthand differs between regex engines, and
possessive runs keep long blanks linear.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from sievework.functions.expr import caseless, contains_any, is_ascii, let

# The characters Unicode-aware tools treat as whitespace.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
RARE_SPACE_CHARS = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
# The same as the inside of a regex class, with the frequent, the rare
# single-byte and the wide ones apart.
FREQUENT_SPACE = r" \n\t\r"
RARE_SPACE = r"\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
WIDE_SPACE = r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = FREQUENT_SPACE + RARE_SPACE + WIDE_SPACE
# Letters, digits and underscore; the ASCII part first because it is tested fast.
WORD = r"a-zA-Z0-9_\p{L}\p{N}"

# ASCII, the Latin letters and the dashes and quotes below are their own NFKC
# form in any sequence, so a text made only of them needs no folding.
FOLD_INERT = r"^[\x00-\x7f\u00c0-\u00ff\u2013\u2014\u2018\u2019\u201c\u201d]*+$"

URL = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
EDIT_NOTE = rf"(?isu)edit[{SPACE}]*+(?:\p{{Nd}}++[{SPACE}]*+)?:.*$"
# The same at a word start only, so that "credit: ten" stays.
STRICT_EDIT_NOTE = EDIT_NOTE.replace("edit", r"(?<!\p{L})edit", 1)
REPEATED_PUNCT = r"([!?.,])\1{2,}"


def _decode(text: str) -> str:
    return html.unescape(html.unescape(text))


def _fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


@pandas_udf(T.StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    return texts.map(_decode, na_action="ignore")


@pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(_fold, na_action="ignore")


@pandas_udf(T.StringType())
def _decoded_and_folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: _fold(_decode(text)), na_action="ignore")


def _only_where(condition: Column, udf, text: Column) -> Column:
    return F.coalesce(udf(F.when(condition, text)), text)


def _has_entity(text: Column) -> Column:
    return F.contains(text, F.lit("&"))


def _may_fold(text: Column) -> Column:
    return ~is_ascii(text) & ~text.rlike(FOLD_INERT)


def null_to_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def unescape_entities(text: Column) -> Column:
    """Decode HTML entities twice, since scraped text is often encoded twice."""
    return _only_where(_has_entity(text), _decoded, text)


def fold_unicode(text: Column) -> Column:
    """NFKC form."""
    return _only_where(_may_fold(text), _folded, text)


def strip_invisible(text: Column) -> Column:
    """Zero-width and no-break spaces become plain blanks."""
    visible = F.replace(text, F.lit("\u200b"), F.lit(" "))
    return F.replace(visible, F.lit("\xa0"), F.lit(" "))


def strip_urls(text: Column) -> Column:
    def fix(t: Column) -> Column:
        return F.when(
            contains_any(t, ("http", "www.")), F.regexp_replace(t, URL, "")
        ).otherwise(t)

    return let(text, fix)


def strip_edit_note(text: Column, strict: bool = False) -> Column:
    """Delete from an "edit:" note, with the asterisks and blanks that lead to
    it, to the end of the text. With `strict`, no letter may stand before it."""
    note = STRICT_EDIT_NOTE if strict else EDIT_NOTE

    def cut(t: Column) -> Column:
        def marks_off(head: Column) -> Column:
            plain = F.rtrim(head, F.lit("*"))
            # Line breaks before the asterisks go too, other blanks there stay.
            return F.when(plain == head, head).otherwise(F.rtrim(plain, F.lit("\n")))

        return let(F.rtrim(F.regexp_replace(t, note, ""), F.lit(SPACE_CHARS)), marks_off)

    def fix(t: Column) -> Column:
        noted = F.contains(caseless(t), F.lit("edit")) & t.rlike(note)
        return F.when(noted, cut(t)).otherwise(t)

    return let(text, fix)


def cap_repeated_punct(text: Column) -> Column:
    """Three or more of the same mark in a row become two."""

    def fix(t: Column) -> Column:
        return F.when(
            contains_any(t, ("!!!", "???", "...", ",,,")),
            F.regexp_replace(t, REPEATED_PUNCT, "$1$1"),
        ).otherwise(t)

    return let(text, fix)


def blanks_to_spaces(text: Column) -> Column:
    """Each whitespace character becomes a plain blank."""
    for ch in "\n\t\r":
        text = F.replace(text, F.lit(ch), F.lit(" "))

    def fix(t: Column) -> Column:
        rare = contains_any(t, RARE_SPACE_CHARS) | (
            ~is_ascii(t) & t.rlike(f"[{WIDE_SPACE}]")
        )
        return F.when(rare, F.regexp_replace(t, f"[{RARE_SPACE}{WIDE_SPACE}]", " ")).otherwise(t)

    return let(text, fix)


def collapse_whitespace(text: Column) -> Column:
    """One blank for each run of whitespace, none at the ends."""

    def fix(t: Column) -> Column:
        doubled = F.contains(t, F.lit("  "))
        return F.trim(F.when(doubled, F.regexp_replace(t, " {2,}", " ")).otherwise(t))

    return let(blanks_to_spaces(text), fix)


def normalise_text(text: Column, strict: bool = False) -> Column:
    """All of the above in order; `strict` is for `strip_edit_note`."""
    text = null_to_empty(text)
    text = _only_where(_has_entity(text) | _may_fold(text), _decoded_and_folded, text)
    for step in (
        strip_invisible,
        strip_urls,
        lambda t: strip_edit_note(t, strict),
        cap_repeated_punct,
        collapse_whitespace,
    ):
        text = step(text)
    return text


def word_count_normalised(text: Column) -> Column:
    """Words of a text with single blanks between them."""

    def count(t: Column) -> Column:
        blanks = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
        return F.when(t == "", F.lit(0)).otherwise(blanks + 1)

    return let(text, count)


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters."""
    return word_count_normalised(collapse_whitespace(text))


def char_count(text: Column) -> Column:
    """Number of code points."""
    return F.length(text)


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{WORD}]+)"), 1)

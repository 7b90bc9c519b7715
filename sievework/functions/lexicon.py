"""Word lists as regexes over case-folded text.

A listed word matches at a word start. What may follow it is said by `match`:

- "prefix": anything, so that "cat" also finds "category";
- "word": the end of a word;
- "marked": the end of a word if the entry ends with a blank, else anything.

Words are compiled into a prefix tree, so a position is tested letter by letter
and not word by word. An entry that closes with the word has an end mark as its last
letter, which the tree turns into a test of what follows. If a longer entry does not
close, the search goes back to a shorter one that does. The patterns expect a blank
put before the text: then a word start is simply "a non-word character, then the
word", which needs no lookbehind.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.expr import caseless

# The last letter of an entry that ends with the word; no text is matched with it.
END = "\0"
WORD_END = r"(?![\p{L}\p{N}_])"
MATCHES = ("prefix", "word", "marked")
# Listed one by one: the regex engine tests such a class with one table look-up.
ASCII_WORD = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"


def quote(word: str) -> str:
    """`word` as a regex that matches it literally."""
    return re.sub(r"([^\w\s])", r"\\\1", word)


def reachable(words: Iterable[str], match: str = "prefix") -> list[str]:
    """Clean, lower-cased entries, with END where they close, without those that an
    earlier entry always matches in place of."""
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}, not {match!r}")
    kept: list[str] = []
    for entry in words:
        word = entry.strip().lower()
        if not word or not re.match(r"\w", word):
            raise ValueError(f"a listed word must start with a word character: {word!r}")
        if match == "word" or match == "marked" and entry != entry.rstrip():
            word += END
        if not any(word.startswith(earlier) for earlier in kept):
            kept.append(word)
    return kept


def prefix_tree(words: Iterable[str]) -> str:
    """A regex for any of `words`, the longest that fits first."""
    by_first: dict[str, list[str]] = {}
    for word in words:
        by_first.setdefault(word[:1], []).append(word[1:])
    ends_here = by_first.pop("", None) is not None
    closes_here = by_first.pop(END, None) is not None and not ends_here
    branches = [quote(ch) + prefix_tree(rest) for ch, rest in by_first.items()]
    if closes_here:
        # After the longer ones.
        branches.append(WORD_END)
    if not branches:
        return ""
    if len(branches) == 1 and not ends_here:
        return branches[0]
    return f"(?:{'|'.join(branches)}){'?' if ends_here else ''}"


def at_word_start(pattern: str, first: Iterable[str] = ()) -> str:
    """`pattern` as a group, after a character that is not part of a word.

    `first` are the characters a match can begin with. Most positions fail one
    of two plain class tests; only then is the Unicode test made.
    """
    begin = f"(?=[{''.join(sorted(set(first)))}])" if first else ""
    return rf"[^{ASCII_WORD}]{begin}(?<![\p{{L}}\p{{N}}])({pattern})"


def words_pattern(words: Sequence[str]) -> str:
    """A regex for clean, lower-cased words at a word start."""
    return at_word_start(prefix_tree(words), {word[0] for word in words})


def with_lead(text: Column) -> Column:
    """The form of a text that these patterns are matched against."""
    return F.concat(F.lit(" "), caseless(text))


def has_word(text: Column, words: Iterable[str], match: str = "prefix") -> Column:
    """Whether `text` holds one of `words`."""
    words = reachable(words, match)
    return with_lead(text).rlike(words_pattern(words)) if words else F.lit(False)


def count_words(text: Column, words: Iterable[str], match: str = "prefix") -> Column:
    """Matches of `words` in `text`, none overlapping another."""
    return F.regexp_count(with_lead(text), F.lit(words_pattern(reachable(words, match))))


def may_share_text(lists: Sequence[Iterable[str]]) -> bool:
    """Whether some listed word can start inside another and end beyond it."""
    union = {word for words in lists for word in reachable(words)}
    tails = {w[m.start() :] for w in union for m in re.finditer(r"(?<!^)\b(?=\w)", w)}
    return any(word != tail and word.startswith(tail) for tail in tails for word in union)


def found_words(text: Column, lists: Sequence[Iterable[str]], match: str = "prefix") -> Column:
    """All listed words in `text`, one per line, from a single pass.

    Counting a list in this extract gives the count in the text, unless
    `may_share_text`, or some entries close and others go on: an extract ends where
    an entry does, which may be inside a word of the text.
    """
    union = list(dict.fromkeys(word for words in lists for word in reachable(words, match)))
    found = F.regexp_extract_all(with_lead(text), F.lit(words_pattern(union)), 1)
    return F.array_join(found, "\n")

from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework import lexicons
from sievework.config import LengthBounds
from sievework.functions import lexicon, rules

WORDS = ("idiot", "moron", "clown car")


def test_tombstones(apply):
    texts = ["[removed]", "so it was [Deleted] by hand", "[REMOVED]", "removed", "[ removed ]", "(deleted)"]
    assert apply(rules.is_tombstone, texts) == [True, True, True, False, False, False]


def test_empty(apply):
    assert apply(rules.is_empty, ["", " \n\t", "a"]) == [True, True, False]


def test_length_bounds_are_inclusive(apply):
    bounds = LengthBounds(min_words=2, max_words=3, max_chars=8)
    texts = ["a", "a b", "a b c", "a b c d", "abcd efg", "abcd efgh"]
    assert apply(lambda t: rules.length_ok(t, bounds), texts) == [False, True, True, False, True, False]


def test_listed_words_match_as_prefixes(apply):
    texts = [
        "such an idiot", "IDIOT", "idiotic", "an-idiot!", "xidiot", "_idiot", "a clown car here", "a clown",
        chr(0xE9) + "idiot", "", "Idiot",
    ]
    want = [True, True, True, True, False, False, True, False, False, False, True]
    assert apply(lambda t: rules.has_listed_word(t, WORDS), texts) == want


def test_default_lists(apply):
    # Each listed word alone, at the end of a text and in capitals.
    flagged = [f(word) for word in lexicons.BLOCKLIST for f in (str, str.upper, "some text, {}".format)]
    fine = ["a plain line of text", "numbers 1 2 3", "Punctuation!?"]
    got = apply(rules.is_offensive, flagged + fine)
    assert got == [True] * len(flagged) + [False] * len(fine)


def test_obfuscations_of_any_list(apply):
    patterns = rules.obfuscation_patterns(("idiot", "moron"))
    texts = ["1d10t", "!di0t", "m0r0n", "idiot", "m.ron", "x1d10t"]
    got = apply(lambda t: rules.has_obfuscated_word(t, patterns), texts)
    assert got == [True, True, True, True, False, False]


def test_meta_posts(apply):
    assert all(apply(rules.is_meta_post, [f"x {phrase.upper()} y" for phrase in lexicons.META_PHRASES]))
    texts = [
        "this sub is odd", "on this subreddit", "this submarine", "good karma", "karmas", "see rule 5",
        "rule five", "rules", "plain words of a post",
    ]
    want = [True, True, False, True, False, True, False, False, False]
    assert apply(rules.is_meta_post, texts) == want


def test_row_drop_reason_takes_the_first_rule(apply):
    got = apply(rules.row_drop_reason, ["", "[deleted]", "too short", "four words are enough"])
    assert got == ["dead_or_empty", "dead_or_empty", "length", None]


def test_empty_lists_match_nothing(apply):
    assert apply(lambda t: rules.is_offensive(t, (), ()), ["idiot"]) == [False]
    assert apply(lambda t: rules.is_meta_post(t, (), ()), ["upvote"]) == [False]


def test_whole_words_and_marked_entries(apply):
    texts = ["such an idiot", "idiotic", "an-idiot!", "a clown car", "clown cars", "idiot", "x idiot_", "idiot5", "IDIOT?"]
    want = [True, False, True, True, False, True, False, False, True]
    assert apply(lambda t: rules.has_listed_word(t, WORDS, "word"), texts) == want
    marked = ("idiot ", "clown")
    want = [True, False, True, True, True, True, False, False, True]
    assert apply(lambda t: rules.has_listed_word(t, marked, "marked"), texts) == want
    assert apply(lambda t: rules.has_obfuscated_word(t, rules.obfuscation_patterns(("idiot",)), "word"), ["1d10t", "1d10ts"]) == [True, False]


def test_a_longer_word_does_not_hide_a_shorter_one(apply):
    words = ("rock band", "rock", "rock bands of old")
    texts = ["a rock bandit", "rock band", "rock bands of oldies", "rocks", "rock rock band rock"]
    assert apply(lambda t: lexicon.count_words(t, words, "word"), texts) == [1, 1, 1, 0, 3]
    assert apply(lambda t: lexicon.count_words(t, ("cat", "category "), "marked"), ["category cat cats"]) == [3]


ALPHABET = st.text(alphabet="ab -", min_size=1, max_size=6).map(str.strip).filter(
    lambda w: w and w[0] in "ab" and w[-1] in "ab"
)


@settings(max_examples=12, deadline=None)
@given(
    words=st.lists(ALPHABET, min_size=1, max_size=5),
    texts=st.lists(st.text(alphabet="ab -.", max_size=20), min_size=10, max_size=30),
)
def test_counts_equal_plain_alternation(spark, words, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows.select("i", lexicon.count_words(F.col("t"), words).alias("n")).orderBy("i").collect()
    plain = re.compile(r"\b(" + "|".join(re.escape(w) for w in words) + ")")
    assert [r["n"] for r in got] == [len(plain.findall(t)) for t in texts]


@settings(max_examples=10, deadline=None)
@given(
    words=st.lists(ALPHABET, min_size=1, max_size=5),
    texts=st.lists(st.text(alphabet="ab -.", max_size=20), min_size=10, max_size=30),
)
def test_closed_counts_equal_plain_alternation(spark, words, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows.select("i", lexicon.count_words(F.col("t"), words, "word").alias("n")).orderBy("i").collect()
    longest = sorted(words, key=len, reverse=True)
    plain = re.compile(r"\b(" + "|".join(re.escape(w) for w in longest) + r")(?!\w)")
    assert [r["n"] for r in got] == [len(plain.findall(t)) for t in texts]


def test_lists_that_share_text_are_noticed():
    assert lexicon.may_share_text([["date night"], ["night club"]])
    assert not lexicon.may_share_text([["final exam", "exam"], ["rock band"], ["band"]])
    assert not lexicon.may_share_text([kws for _, kws in lexicons.CONTEXT_KEYWORDS])

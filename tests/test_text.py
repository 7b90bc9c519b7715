from __future__ import annotations

import re
import sys
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.functions import text

ZERO_WIDTH, NBSP, EN_SPACE, FI = chr(0x200B), chr(0xA0), chr(0x2002), chr(0xFB01)

# Expected values worked out by hand.
CASES = [
    ("Bread &amp; butter", "Bread & butter"),
    ("twice &amp;lt;b&amp;gt; coded", "twice <b> coded"),
    (f"zero{ZERO_WIDTH}width", "zero width"),
    ("read https://site.test/p?q=1#r first", "read first"),
    ("then www.site.test/p, and on", "then and on"),
    ("End of story. EDIT 3: typos", "End of story."),
    ("End of story.\n\n** Edit :more\nlines", "End of story."),
    ("we edit this by hand", "we edit this by hand"),
    ("his accredited: yes", "his accredited: yes"),
    ("her credit : yes", "her cr"),
    ("tab\tand \r\n line", "tab and line"),
    (f"odd{NBSP}{EN_SPACE}blanks\x0bof\x1call kinds", "odd blanks of all kinds"),
    ("stop!!!!! now", "stop!! now"),
    ("one. two.. three... four?!?!", "one. two.. three.. four?!?!"),
    (f"{FI}ne " + chr(0xFF38) + chr(0xFF39), "fine XY"),
    (None, ""),
    ("", ""),
    (" \n ", ""),
]


def test_normalise_cases(apply):
    assert apply(text.normalise_text, [raw for raw, _ in CASES]) == [want for _, want in CASES]


def test_steps_alone(apply):
    assert apply(text.null_to_empty, [None, "a"]) == ["", "a"]
    assert apply(text.unescape_entities, ["&lt;b&gt; &quot;", "plain", None]) == ['<b> "', "plain", None]
    assert apply(text.fold_unicode, [FI, "e" + chr(0x301), "plain"]) == ["fi", chr(0xE9), "plain"]
    assert apply(text.strip_invisible, [f"a{ZERO_WIDTH}b{NBSP}c"]) == ["a b c"]
    assert apply(text.strip_urls, ["x https://a.b/c?d y", "http", "HTTP://x"]) == ["x  y", "http", "HTTP://x"]
    assert apply(text.cap_repeated_punct, ["!!!!", "!?!", "....,,,"]) == ["!!", "!?!", "..,,"]
    assert apply(text.collapse_whitespace, [" a \r\n b ", "a b"]) == ["a b", "a b"]


@pytest.mark.parametrize(
    "tail", ["Edit:", "\n\n**Edit 2 :x", " \n* edit:\ny", " * * edit: z", "\n\n \n edit:", "xedit3:"]
)
def test_edit_note_matches_its_definition(apply, tail):
    raw = ["some text" + tail, tail]
    expected = [re.sub(r"(?is)\n*\**\s*edit\s*\d*\s*:.*$", "", r) for r in raw]
    assert apply(text.strip_edit_note, raw) == expected


def test_space_class_is_complete():
    assert set(text.SPACE_CHARS) == {chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()}


def test_inert_characters_never_change_under_folding():
    inert = re.compile(text.FOLD_INERT.replace("*+$", "$"))
    chars = [chr(i) for i in range(0x3000) if inert.match(chr(i))]
    kept = [c for c in chars if unicodedata.normalize("NFKC", c) == c]
    changed = sorted(set(chars) - set(kept))
    assert changed == []
    assert all(unicodedata.combining(c) == 0 for c in chars)


PIECES = st.sampled_from(
    ["a", "Wort", " ", "  ", "\n", "\t", "\x0c", "\x85", NBSP, EN_SPACE, ZERO_WIDTH, "&amp;", "&amp;lt;",
     "&copy", "&", "http://x.y", "www.z", "edit", "EDIT: ", "Edit 3 :", "*", "!!!", "??", "...", ",", FI,
     chr(0xE9), "e" + chr(0x301), chr(0x2026), chr(0xBD), "[removed]", "1", chr(0x131), chr(0x130)]
)


@settings(max_examples=15, deadline=None)
@given(batch=st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=20, max_size=40))
def test_what_normalised_texts_have_in_common(spark, batch):
    rows = spark.createDataFrame(list(enumerate(batch)), "i int, t string")
    once = text.normalise_text(F.col("t"))
    got = rows.select("i", once.alias("x"), text.collapse_whitespace(once).alias("again")).orderBy("i").collect()
    for value in (r["x"] for r in got):
        assert not re.search(r"https?://\S|www\.\S", value) or "www" in value
        assert not re.search(r"([!?.,])\1\1", value)
        assert value == " ".join(value.split())
        assert ZERO_WIDTH not in value and NBSP not in value
    assert [r["x"] for r in got] == [r["again"] for r in got]


@settings(max_examples=10, deadline=None)
@given(batch=st.lists(st.lists(st.sampled_from(["ab", "Cd.", "7", "x,y", "(z)"]), max_size=9), min_size=5, max_size=20))
def test_plain_words_are_only_spaced(spark, batch):
    raw = ["  \t".join(found) for found in batch]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, t string")
    got = rows.select("i", text.normalise_text(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [" ".join(found) for found in batch]


def test_counts(apply):
    texts = ["", "a", " a  b\n", "x" * 5, chr(0x1F600)]
    assert apply(text.word_count, texts) == [0, 1, 2, 1, 1]
    assert apply(text.char_count, texts) == [0, 1, 6, 5, 1]


def test_long_blank_runs_take_linear_time(apply):
    run = " " * 200_000
    assert apply(text.normalise_text, ["a" + run + "edit" + run + "b"]) == ["a edit b"]


def test_row_functions_run_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("a  b &amp; c",)], "t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t string").parquet(str(tmp_path / "in"))
    query = (
        stream.select(text.normalise_text(F.col("t")).alias("t"))
        .writeStream.format("memory")
        .queryName("normalised")
        .start()
    )
    query.processAllAvailable()
    query.stop()
    assert [r["t"] for r in spark.table("normalised").collect()] == ["a b & c"]


def test_a_strict_edit_note_is_at_a_word_start(apply):
    texts = ["credit: ten", "fine. EDIT: more", "x **edit 2: y", "edit: all", "he edited: it", "credit: a\nedit: b"]
    assert apply(lambda t: text.strip_edit_note(t, strict=True), texts) == [
        "credit: ten", "fine.", "x ", "", "he edited: it", "credit: a",
    ]
    assert apply(text.strip_edit_note, texts[:1]) == ["cr"]
    assert apply(lambda t: text.normalise_text(t, strict=True), ["credit:  ten"]) == ["credit: ten"]

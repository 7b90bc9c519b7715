from __future__ import annotations

import json
import random
from csv import QUOTE_ALL
from csv import writer as csv_writer
from pathlib import Path

import pytest

from sievework.functions import prompts
from sievework.sources import readers, writers
from sievework.sources.schemas import ONE_LINERS
from sievework.sources.wide_csv import read_wide_csv

HEADER = "source_id,text,score,source,nsfw\n"


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "corpus.csv"
    path.write_text(
        HEADER
        + '1,"two\nlines, ""quoted""",7.0,posts,False\n'
        + "2,None,,posts,True\n"
        + f"3,{chr(0xE9)}t{chr(0xE9)},-1,posts,\n"
    )
    return str(path)


def test_csv_is_read_whole(spark, csv):
    rows = readers.read_corpus_csv(spark, csv).orderBy("source_id").collect()
    assert [tuple(r) for r in rows] == [
        ("1", 'two\nlines, "quoted"', 7.0, "posts"),
        ("2", "None", None, "posts"),
        ("3", chr(0xE9) + "t" + chr(0xE9), -1.0, "posts"),
    ]


def test_cells_of_another_type_are_null(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text(HEADER + "1,text,NA,posts,maybe\n2,text,1e2,posts,False\n3,text,,posts,False\n")
    rows = readers.read_corpus_csv(spark, str(path)).orderBy("source_id").collect()
    assert [r["score"] for r in rows] == [None, 100.0, None]


def test_missing_sources(spark, csv, tmp_path):
    gone = str(tmp_path / "gone.csv")
    assert readers.load_corpus(spark, [gone, csv]).count() == 3
    assert readers.load_corpus(spark, [csv, csv], limit=2).count() == 4
    with pytest.raises(FileNotFoundError):
        readers.load_corpus(spark, [gone])


def test_single_field_source(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("ID,Joke\n1,ha\n2,ho\n")
    raw = readers.read_corpus_csv(spark, str(path), ONE_LINERS)
    rows = readers.unify_single_field_source(raw, "short").orderBy("source_id").collect()
    assert [tuple(r) for r in rows] == [("1", "ha", None, "short"), ("2", "ho", None, "short")]


def test_two_field_source(spark):
    rows = [
        ("1", " set-up ", "\npunchline ", 5, True), ("2", None, "body", 4, None), ("3", "title", None, 3, False),
        ("4", None, None, None, None),
    ]
    raw = spark.createDataFrame(rows, "id string, title string, selftext string, score long, `subreddit.nsfw` boolean")
    out = readers.unify_two_field_source(raw, "posts").orderBy("source_id").collect()
    assert [r["text"] for r in out] == ["set-up punchline", "body", "title", ""]
    assert [r["nsfw"] for r in out] == [True, False, False, False]
    assert [r["score"] for r in out] == [5.0, 4.0, 3.0, None]


def test_raw_cache(spark, tmp_path):
    path = str(tmp_path / "raw")
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    assert writers.write_raw_cached(spark, path, build).count() == 1
    assert writers.write_raw_cached(spark, path, build).count() == 1
    assert writers.write_raw_cached(spark, path, build, force=True).count() == 2
    (Path(path) / "_SUCCESS").unlink()
    assert writers.write_raw_cached(spark, path, build).count() == 3


def test_training_records_on_disk(spark, tmp_path):
    rows = [
        ("Coffee ", "ha " + chr(0xE9), 3.0, "s", "train"), ("work", "ho", None, "s", "test"),
        ("work", "hm", float("nan"), "s", "train"),
    ]
    df = spark.createDataFrame(rows, "context string, text string, score double, source string, split string")
    writers.write_training_jsonl(df, str(tmp_path / "out"))
    lines = {
        split: [
            json.loads(line)
            for part in sorted((tmp_path / "out" / f"split={split}").glob("*.json"))
            for line in part.read_text(encoding="utf-8").splitlines()
        ]
        for split in ("train", "test")
    }
    assert lines["test"] == [
        {"context": "work", "joke": "ho", "text": "<context> work <joke> ho<|endoftext|>", "score": None, "source": "s"}
    ]
    by_joke = {r["joke"]: r for r in lines["train"]}
    assert by_joke["ha " + chr(0xE9)]["score"] == 3
    assert by_joke["ha " + chr(0xE9)]["text"].startswith("<context> coffee <joke> ha")
    assert by_joke["hm"]["score"] is None
    raw = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").rglob("*.json"))
    assert chr(0xE9) in raw


def test_report_on_disk(spark, tmp_path):
    path = tmp_path / "report"
    rows = [
        ("stats", "raw", 3), ("context_distribution", "b", 1), ("context_distribution", "a", 2),
        ("source_distribution", "s", 2), ("source_distribution", None, 9), ("with_scores", "", 1),
    ]
    writers.write_report_json(spark.createDataFrame(rows, "part string, name string, n long"), str(path))
    (part,) = path.glob("*.json")
    assert json.loads(part.read_text()) == {
        "stats": {"raw": 3}, "context_distribution": {"a": 2, "b": 1}, "source_distribution": {"s": 2}, "with_scores": 1,
    }


def test_prompt_format(apply):
    (a, b) = apply(prompts.format_prompt, ["coffee", "  COFFEE  "])
    assert a == b == "<context> coffee <joke> "
    (line,) = apply(lambda t: prompts.format_example(t, t), [" Ha "])
    assert line == "<context> ha <joke> Ha<|endoftext|>"


def test_score_to_int(spark):
    df = spark.createDataFrame([(1.9,), (None,), (float("nan"),)], "s double")
    assert [r[0] for r in df.select(prompts.score_to_int(df.s)).collect()] == [1, None, None]


@pytest.fixture
def small_splits(spark):
    kept = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(name, n) for name, n in zip(kept, (str(size), "1"))]
    for name, value in kept.items():
        spark.conf.set(name, value)


def odd_cells(seed):
    draw = random.Random(seed)
    parts = ["a", "b c", '"', '""', ",", "\n", "\n\n", "é漢", "x" * 30, ";", "\\", "it's"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(4)]


@pytest.mark.parametrize("size,ending", [(97, "\n"), (400, "\r\n"), (100_000, "\n")])
def test_a_wide_csv_has_the_rows_of_the_plain_reader(spark, tmp_path, small_splits, size, ending):
    for number in range(2):
        with open(tmp_path / f"{number}.csv", "w", newline="") as file:
            out = csv_writer(file, lineterminator=ending, quoting=QUOTE_ALL)
            out.writerow(["id", "text", "more, of it", "last"])
            for i in range(40):
                out.writerow([f"{number}-{i}", *odd_cells(number * 1000 + i)[:3]])
    plain = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    expected = sorted(map(tuple, plain.collect()))
    small_splits(size)
    wide = read_wide_csv(spark, str(tmp_path))
    assert wide.columns == plain.columns
    assert sorted(map(tuple, wide.collect())) == expected and len(expected) == 80
    if size == 97:
        assert wide.rdd.getNumPartitions() > 20


def test_a_record_over_many_splits_and_cells_without_quotes(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i}, of it" for i in range(40))
    path = tmp_path / "a.csv"
    path.write_text(f'﻿source_id,text,score,source\n1,plain,2.5,s\n\n2,"{long}",,s\n3,"",NA,s\n4,"open to the end\nof it')
    small_splits(80)
    rows = {r["source_id"]: tuple(r)[1:] for r in readers.read_corpus_csv(spark, str(path), wide=True).collect()}
    assert rows["1"] == ("plain", 2.5, "s") and rows["2"] == (long, None, "s")
    assert rows["3"][1] is None and rows["4"][0].startswith("open to the end\nof it") and len(rows) == 4


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n1,2\n")
    with pytest.raises(Exception, match="expected the header"):
        read_wide_csv(spark, str(tmp_path)).collect()

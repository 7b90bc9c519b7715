from __future__ import annotations

import json
import os
from argparse import Namespace

from sievework.__main__ import prepare, run_clean
from sievework.storage import materialise, scratch, shared_dir


def local_folder(spark):
    return shared_dir(spark).removeprefix("file:")


def test_prepare_then_clean(spark, tmp_path):
    (tmp_path / "short.csv").write_text(
        "ID,Joke\n" + "".join(f"{i},a joke number{i} about my coffee{i} cup{i}\n" for i in range(30))
    )
    (tmp_path / "posts.csv").write_text(
        "id,title,selftext,score,subreddit.nsfw\n"
        'a,My wife said,"this line\nand that",7,False\n'
        "b,gone,[removed],9,False\n"
        "c,not in the top,two rows here,1,True\n"
    )
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    prepare(
        spark,
        Namespace(
            one_liners=str(tmp_path / "short.csv"), posts=str(tmp_path / "posts.csv"),
            out=raw, top_rows=2, force=False, single_line=False,
        ),
    )
    before = set(os.listdir(local_folder(spark)))
    run_clean(
        spark,
        Namespace(
            raw=[raw + "/one_liners", raw + "/posts", raw + "/absent"], out=out, limit=20,
            no_embed=True, encoder=None,
        ),
    )
    assert set(os.listdir(local_folder(spark))) == before
    rows = spark.read.json(out + "/training").collect()
    assert {(r["source"], r["context"]) for r in rows} == {("one_liners", "coffee"), ("posts", "relationships")}
    (part,) = (tmp_path / "out" / "clean_report").glob("*.json")
    report = json.loads(part.read_text())
    assert report["stats"]["raw"] == 22 and report["stats"]["dropped_dead_or_empty"] == 1
    assert report["with_scores"] == 1
    assert sum(report["source_distribution"].values()) == report["stats"]["final"] == len(rows)


def test_a_report_without_all_names(spark, tmp_path):
    from sievework.plans.clean import clean, write_report

    rows = [("1", "four words of coffee", 1.0, None), ("2", "four words of tea", None, "s")]
    raw = spark.createDataFrame(rows, "source_id string, text string, score double, source string")
    write_report(clean(raw), str(tmp_path / "report"))
    (part,) = (tmp_path / "report").glob("*.json")
    report = json.loads(part.read_text())
    assert report["source_distribution"] == {"s": 1}
    assert report["stats"]["final"] == 2 and report["with_scores"] == 1


def test_scratch_tables_go_at_the_end_of_their_block(spark):
    before = set(os.listdir(local_folder(spark)))
    with scratch(spark):
        with scratch(spark, keep=("kept",)):
            kept = materialise(spark.range(3), "kept")
            materialise(spark.range(3), "other")
        left = set(os.listdir(local_folder(spark))) - before
        assert [name.split("-")[0] for name in left] == ["kept"] and kept.count() == 3
    assert set(os.listdir(local_folder(spark))) == before

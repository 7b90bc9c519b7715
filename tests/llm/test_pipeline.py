"""The stages of the pipeline, and the registered queries."""

from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sievework.llm import queries
from tests.llm.common import SCHEMA, documents, odd_rows, prose, with_clashes, with_inner_clashes
from tests.llm.test_quality import kept


def rows():
    rng, out = random.Random(1), []
    texts = [prose(i, 60 + i, 2000, prefix=rng.choice(("the", "der", "les"))) for i in range(60)]
    for i, text in enumerate(texts):
        lang = {"t": "en", "d": "de", "l": "fr"}[text[0]]
        out.append((i * 2, text, lang, f"s{i % 4}", len(text)))
        if i % 10 == 0:
            out.append((i * 2 + 1, text + " x", lang, "s0", len(text) + 2))
    return out + [(500 + i, "too short", "en", "s1", 9) for i in range(5)] + [(600, "$ " * 80 + prose(5, 80), "en", "s1", 1)]


def stage(spark, number, docs):
    return corpus_pipeline.STAGES[number][1](spark, docs, "")


def test_stages_one_after_the_other(spark, tmp_path):
    data = rows()
    docs = documents(spark, data)
    good = stage(spark, 0, docs)
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(i for i, text, *_ in data if kept(text))
    known = stage(spark, 1, good)
    assert known.count() == good.count() and known.columns == docs.columns
    single = stage(spark, 2, known)
    assert sorted(r["doc_id"] for r in single.collect()) == [i * 2 for i in range(60)]
    mixed = stage(spark, 3, single)
    assert mixed.columns == docs.columns
    pieces = stage(spark, 4, mixed).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert sum(p["length"] for p in pieces) == tokens

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda p: (p["doc_id"], p["start"], p["length"], p["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, pieces))


def test_stages_take_odd_and_empty_tables(spark):
    for make in (
        lambda: with_clashes(documents(spark)), lambda: with_inner_clashes(documents(spark)), lambda: documents(spark, []),
    ):
        for number in range(4):
            docs = make()
            out = stage(spark, number, docs)
            assert out.columns == docs.columns
            assert out.count() <= 2 * docs.count()
        assert stage(spark, 4, make()).count() >= make().count()
    assert len(odd_rows()) == 13 and SCHEMA


def test_all_operators_are_registered():
    names = sorted(queries.QUERIES, key=lambda name: int(name[2:].split("_")[0]))
    assert [int(name[2:].split("_")[0]) for name in names] == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5

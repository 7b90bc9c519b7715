"""The corpus pipeline: quality, language, near duplicates, mix and packing.

Each stage takes the session, the documents that the stage before kept, and the
folder of the tables, and returns documents with the same columns; the last
returns the pieces of the packed sequences. Tables between stages are Parquet in
the shared folder, so a lost executor costs tasks, not stages.

Any stage takes documents with nulls in any column, with empty and very long texts,
with repeated rows and with further columns of any name, which stay. No documents
give no documents. A document without an id stays until it is judged by its text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.jaccard_join import keep_one_per_component
from sievework.llm.language import UNKNOWN, identified
from sievework.llm.mixing import mixed_documents
from sievework.llm.packing import pack
from sievework.llm.quality import judged
from sievework.storage import scratch, scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def as_row(docs: DataFrame) -> DataFrame:
    """All columns as one struct, so that none can clash with what a stage adds."""
    return docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or a rule go. Without a word, a text fails."""
    return judged(as_row(docs), text="row.text").where("_quality.kept").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language, or in two about equally, go."""
    known = identified(as_row(docs), id="row.doc_id", text="row.text", lang="row.lang")
    return known.where(f"_language.lang_pred <> '{UNKNOWN}' AND NOT _language.ambiguous").select("row.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return keep_one_per_component(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is there as often as the mix takes it: not at all, once or
    twice."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack(docs, VOCABULARY)


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("jaccard join", jaccard_join),
    ("mixing", mixing),
    ("packing", packing),
]

# The stages learn, draw and tokenise, which SQL cannot express; tests hold the
# result against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the table `documents`. What a stage needed on
    its way is deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Write corpora, training records and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.config import PromptFormat
from sievework.functions.prompts import format_example, score_to_int
from sievework.storage import path_complete

REPORT_SCHEMA = (
    "stats map<string,long>, context_distribution map<string,long>,"
    " source_distribution map<string,long>, with_scores long"
)


def write_raw_cached(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False
) -> DataFrame:
    """The table at `path`; built and written first if it is absent, incomplete
    or `force` is set."""
    if force or not path_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def training_records(df: DataFrame, fmt: PromptFormat = PromptFormat()) -> DataFrame:
    """Rows with `context` and `text` as training records; keeps `split`."""
    return df.select(
        "context",
        F.col("text").alias("joke"),
        format_example(F.col("context"), F.col("text"), fmt).alias("text"),
        score_to_int(F.col("score")).alias("score"),
        "source",
        "split",
    )


def write_training_jsonl(df: DataFrame, path: str, fmt: PromptFormat = PromptFormat()) -> None:
    """JSON lines in one folder per split. Null scores are written out."""
    records = training_records(df, fmt)
    writer = records.write.mode("overwrite").partitionBy("split")
    writer.option("ignoreNullFields", False).json(path)


def write_report_json(counts: DataFrame, path: str) -> None:
    """The counts of a run as one JSON record.

    `counts(part, name, n)` has the fields of the record as parts; rows without a
    name are left out, as a record cannot hold them. The record is put together
    on an executor.
    """
    largest_first = F.struct((-F.col("n")).alias("_minus"), "name", "n")

    def part(name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("part") == name, largest_first)))
        return F.map_from_entries(F.transform(rows, lambda r: F.struct(r["name"], r["n"])))

    maps = [part(name).alias(name) for name in ("stats", "context_distribution", "source_distribution")]
    scored = F.coalesce(F.sum(F.when(F.col("part") == "with_scores", F.col("n"))), F.lit(0))
    record = counts.where("name IS NOT NULL").agg(*maps, scored.alias("with_scores"))
    record.write.mode("overwrite").json(path)

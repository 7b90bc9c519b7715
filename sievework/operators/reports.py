"""Counts and quality reports over a corpus."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework import lexicons
from sievework.operators.tagging import Keywords, has_own_keyword
from sievework.storage import materialise

# Stages in the order in which they drop rows.
STAGES = ("dead_or_empty", "length", "exact_dup", "near_dup", "offensive", "meta")
FILTERS_FIRST = ("dead_or_empty", "length", "offensive", "meta", "exact_dup", "near_dup")


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, null of nothing."""
    return F.round(F.try_divide(100.0 * part, whole), 1)


def funnel_report(drops: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Funnel from `drops(stage, dropped)`, which holds the stage "final" for the
    rows that remain: dropped and remaining rows per stage, in order."""
    order = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage"))
    totals = drops.groupBy("stage").agg(F.sum("dropped").alias("dropped"))
    listed = drops.sparkSession.createDataFrame([(s,) for s in (*stages, "final")], "stage string")
    rows = listed.join(totals, "stage", "left").select(
        F.when(F.col("stage") == "final", len(stages) + 1)
        .otherwise(order)
        .cast("int")
        .alias("step"),
        "stage",
        F.coalesce("dropped", F.lit(0)).cast("long").alias("n"),
    )
    # Seven rows, so one window over all of them.
    so_far = Window.orderBy("step")
    whole = so_far.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    final = F.col("stage") == "final"
    left = F.when(final, F.col("n")).otherwise(F.col("total") - F.col("gone"))
    return (
        rows.withColumn("total", F.sum("n").over(whole))
        .withColumn("gone", F.sum("n").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
        .select(
            "step",
            "stage",
            F.when(final, 0).otherwise(F.col("n")).cast("long").alias("dropped"),
            left.cast("long").alias("remaining"),
            percent(left, F.col("total")).alias("percent_of_raw"),
        )
    )


def label_distribution(df: DataFrame, label: str = "context") -> DataFrame:
    """Rows per label, largest first."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), label)


def source_distribution(df: DataFrame, source: str = "source") -> DataFrame:
    """Rows per source, largest first."""
    return label_distribution(df, source)


def count_with_scores(df: DataFrame, score: str = "score") -> DataFrame:
    return df.agg(F.count(score).alias("with_scores"))


def source_summary(df: DataFrame, source: str = "source", score: str = "score") -> DataFrame:
    """Rows and scored rows per source, and in total where the source is null."""
    return df.rollup(source).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(score).alias("n_scored")
    )


def tag_coverage(df: DataFrame, tag: str = "context") -> DataFrame:
    """How many rows have a tag, and their share in percent."""
    tagged = F.count_if(F.col(tag) != "")
    return df.agg(
        tagged.alias("n_tagged"),
        F.count(F.lit(1)).alias("n_rows"),
        percent(tagged, F.count(F.lit(1))).alias("percent_tagged"),
    )


def tag_precision_report(
    df: DataFrame,
    text: str = "text",
    label: str = "context",
    keywords: Keywords = lexicons.CONTEXT_KEYWORDS,
) -> DataFrame:
    """Per label with keywords: the share of its rows that hold one of them."""
    known = F.col(label).isin([name for name, _ in keywords])
    own = has_own_keyword(F.col(text), F.col(label), keywords)
    # Groups are chosen by an aggregate: a condition on the label itself would move
    # below the tagging and run it twice.
    return (
        df.groupBy(label)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.round(100 * F.avg(own.cast("int")), 1).alias("percent_confirmed"),
            F.bool_or(known).alias("_known"),
        )
        .where("_known")
        .drop("_known")
    )


def score_quantiles(
    df: DataFrame,
    score: str = "score",
    quantiles: Sequence[float] = (0.5, 0.9, 0.95),
    cut: float = 100,
) -> DataFrame:
    """Exact quantiles of the scores, interpolated between neighbours, with the
    highest score and the rows at or above `cut`.

    Counts per value are pre-aggregated and range-sorted; a running count within
    each range plus the count of the ranges before it gives the place of every
    value. The driver sees one count per range.
    """
    spark = df.sparkSession
    values = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("v"))
    counts = materialise(
        values.agg(F.count(F.lit(1)).alias("n"))
        .orderBy("v")
        .withColumn("part", F.spark_partition_id()),
        "values",
    )
    offsets, total = [], 0
    for row in counts.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        offsets.append((row["part"], total))
        total += row["n"]
    before = spark.createDataFrame(offsets, "part int, before long")
    up_to = Window.partitionBy("part").orderBy("v")
    placed = counts.join(before, "part").withColumn(
        "upto", F.col("before") + F.sum("n").over(up_to)
    )
    columns = []
    for q in quantiles:
        at = q * max(total - 1, 0)
        low, high = (
            F.min(F.when(F.col("upto") > place, F.col("v")))
            for place in (math.floor(at), math.ceil(at))
        )
        columns.append((low + (high - low) * F.lit(at - math.floor(at))).alias(f"p{q * 100:g}"))
    above = F.coalesce(F.sum(F.when(F.col("v") >= cut, F.col("n"))), F.lit(0))
    return placed.agg(
        F.lit(total).cast("long").alias("n_scored"),
        *columns,
        F.max("v").alias("highest"),
        above.alias("n_positive"),
        percent(above, F.lit(total)).alias("percent_positive"),
    )

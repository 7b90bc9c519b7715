"""One row per distinct text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality_order(score: str, key: Sequence[str]) -> list[Column]:
    """Ascending order fields: best score first, unscored last, ties by key."""
    return [F.col(score).isNull(), -F.col(score), *[F.col(c) for c in key]]


def nan_to_null(score: Column) -> Column:
    """Spark sorts NaN above all numbers; a missing score must come last."""
    score = score.cast("double")
    return F.when(~F.isnan(score), score)


def exact_dedup_keep_best(
    df: DataFrame,
    text: str = "text",
    score: str = "score",
    key: Sequence[str] = ("source", "source_id"),
    by: Sequence[Column] = (),
    count_as: str | None = None,
) -> DataFrame:
    """Keep the best-scored row per text.

    An aggregate, so each map task sends one row per text however many copies
    it holds. The hash in front of the text makes its sort compare numbers. `by`
    adds grouping columns; `count_as` names a column for the number of copies.
    """
    df = df.withColumn(score, nan_to_null(F.col(score)))
    order = [c.alias(f"_o{i}") for i, c in enumerate(quality_order(score, key))]
    rest = [F.col(c) for c in df.columns if c != text]
    aggregates = [F.min(F.struct(*order, F.struct(*rest).alias("row"))).alias("best")]
    if count_as:
        aggregates.append(F.count(F.lit(1)).alias(count_as))
    grouped = df.groupBy(F.xxhash64(text).alias("_h"), F.col(text), *by).agg(*aggregates)
    columns = [F.col(text) if c == text else F.col(f"best.row.{c}") for c in df.columns]
    return grouped.select(*columns, *([count_as] if count_as else []))

"""First rows of an order, without passing them through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.storage import materialise


def first_rows(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first `n` rows by `order`, ascending fields that should tell rows apart.

    Only the order fields are range-sorted. Counts per range, one number each on
    the driver, lead to the last row wanted, and the table is cut by comparison
    with it. Of rows that equal the last one in all fields, any are taken.
    """
    place = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    ranked = materialise(
        df.select(place.alias("_place"))
        .orderBy("_place")
        # The id holds the partition number above bit 33 and the row number below.
        .withColumn("_at", F.monotonically_increasing_id()),
        "order",
    )
    part = F.shiftright("_at", 33)
    left, last = n, None
    for row in ranked.groupBy(part.alias("part")).count().orderBy("part").collect():
        if row["count"] >= left:
            last = (row["part"] << 33) + left - 1
            break
        left -= row["count"]
    if n <= 0:
        return df.limit(0)
    if last is None:
        return df
    end = ranked.where(F.col("_at") == last).select("_place").first()["_place"]
    # As a table of one row the end keeps its types and nulls.
    cut = df.sparkSession.createDataFrame([(end,)], ranked.select("_place").schema)
    marked = df.withColumn("_place", place).join(F.broadcast(cut.withColumnRenamed("_place", "_end")))
    same = ranked.join(F.broadcast(cut), "_place").agg(
        F.count(F.lit(1)), F.count_if(F.col("_at") <= last)
    ).first()
    if same[0] == same[1]:
        return marked.where("_place <= _end").drop("_place", "_end")
    ties = marked.where("_place = _end").limit(same[1])
    return marked.where("_place < _end").unionByName(ties).drop("_place", "_end")


def score_order(score: str, key: Sequence[str]) -> list[Column]:
    """Best score first, unscored rows last, ties by key; ascending fields."""
    return [F.col(score).isNull(), -F.col(score), *[F.col(c) for c in key]]


def top_n_by_score(
    df: DataFrame, n: int, score: str = "score", key: Sequence[str] = ("source_id",)
) -> DataFrame:
    """The `n` best-scored rows, in no order; unscored rows last, ties by key."""
    return first_rows(df, n, score_order(score, key))

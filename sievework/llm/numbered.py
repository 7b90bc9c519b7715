"""Gapless positions in an order, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.storage import materialise


def numbered(df: DataFrame, name: str, order: Sequence[Column], within: Sequence[str] = ()) -> DataFrame:
    """Add the position `name`, from 0, in `order` inside each group of `within`.

    One range sort by group and order: a group of any size is spread over many
    tasks. The rows of a group per task, a small table, then give the position
    at which each task begins. Groups and order must not hold `_at` or `_part`.
    """
    placed = materialise(
        df.orderBy(*within, *order).withColumn("_at", F.monotonically_increasing_id()), "placed"
    )
    # The id holds the partition above bit 33 and the row in it below.
    part = F.shiftright("_at", 33)
    pieces = placed.groupBy(part.alias("_part"), *within).agg(
        F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_rows")
    )
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(
        pieces.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))), "starts"
    )
    same = [F.shiftright("p._at", 33) == F.col("s._part")]
    same += [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in within]
    position = F.col("s._before") + F.col("p._at") - F.col("s._low")
    return (
        placed.alias("p")
        .join(starts.alias("s"), reduce(lambda a, b: a & b, same))
        .select(*[F.col(f"p.{c}") for c in df.columns], position.alias(name))
    )

"""Splits and samples per label by the smallest keyed hashes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.config import SplitSettings
from sievework.operators.select import first_rows
from sievework.storage import materialise

# Hex digits of a row's hash that one step looks at: 65,536 buckets per label.
STEP_DIGITS = 4
HASH_DIGITS = 32
# Above every hex digit.
TOP = "g"


def keyed_hash(key: Sequence[str], seed: int):
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *key))


def with_smallest(
    df: DataFrame, label: str, key: Sequence[str], quotas, seed: int, name: str
) -> DataFrame:
    """Add the boolean `name`: whether a row is among the `quota` rows of its label
    with the smallest keyed hashes. `quotas(sizes)` gives `label, quota` for the
    rows `label, n`.

    The hash at which a quota is reached is found digit by digit, from counts per
    label and bucket: only the bucket in which it ends is looked at more closely,
    so no label is sorted, ranked or collected. The rows are not shuffled; the cuts,
    one row per label, are a stored table that Spark broadcasts if its size allows.
    """
    hashed = df.withColumn("_hash", keyed_hash(key, seed))
    keyed = hashed.select(F.col(label).alias("label"), F.col("_hash").alias("hash"))
    same = F.expr("k.label <=> c.label")

    def counted(rows: DataFrame, digits: int) -> DataFrame:
        bucket = F.substring("hash", 1, digits).alias("bucket")
        return materialise(rows.groupBy("label", bucket).agg(F.count(F.lit(1)).alias("n")), "buckets")

    buckets = counted(keyed, STEP_DIGITS)
    sizes = materialise(buckets.groupBy("label").agg(F.sum("n").alias("n")), "sizes")
    wanted = materialise(
        quotas(sizes).select("label", F.col("quota").alias("left")).where("left > 0"), "quotas"
    )
    cuts, digits = [], STEP_DIGITS
    up_to = Window.partitionBy("label").orderBy("bucket")
    while True:
        ends = (
            buckets.withColumn("below", F.sum("n").over(up_to) - F.col("n")).alias("k")
            .join(wanted.alias("c"), same)
            .where("below < left AND left <= below + n")
            .select("c.label", "bucket", (F.col("left") - F.col("below")).alias("left"), "n")
        )
        ends = materialise(ends, "ends")
        whole = (F.col("left") == F.col("n")) | F.lit(digits >= HASH_DIGITS)
        cuts.append(ends.where(whole).select("label", F.concat("bucket", F.lit(TOP)).alias("cut")))
        open_ = ends.where(~whole)
        if open_.isEmpty():
            break
        digits += STEP_DIGITS
        wanted = open_.select("label", "left", F.col("bucket").alias("start"))
        inside = keyed.alias("k").join(wanted.alias("c"), same).where("startswith(hash, start)")
        buckets = counted(inside.select("k.label", "hash"), digits)
    all_cuts = cuts[0]
    for more in cuts[1:]:
        all_cuts = all_cuts.unionByName(more)
    stored = materialise(all_cuts.select(F.col("label").alias("_label"), F.col("cut").alias("_cut")), "cuts")
    picked = F.coalesce(F.col("_hash") < F.col("_cut"), F.lit(False))
    return (
        hashed.join(stored, F.col(label).eqNullSafe(F.col("_label")), "left")
        .withColumn(name, picked)
        .drop("_hash", "_label", "_cut")
    )


def _test_quotas(sizes: DataFrame, share: float) -> DataFrame:
    """Test rows per label: proportional, rounded so that they sum to
    ceil(share * rows); the largest rests are rounded up."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    n_train = total - math.ceil(share * total)
    exact = sizes.withColumn(
        "whole", F.floor(F.lit(n_train) * F.col("n") / F.lit(max(total, 1)))
    ).withColumn("rest", F.lit(n_train) * F.col("n") - F.col("whole") * F.lit(total))
    spare = n_train - (exact.agg(F.sum("whole")).first()[0] or 0)
    order = [-F.col("rest"), F.col("label").isNotNull(), F.col("label")]
    raised = first_rows(exact, spare, order).select(F.col("label").alias("_l"), F.lit(1).alias("more"))
    return exact.join(raised, F.expr("label <=> _l"), "left").select(
        "label", (F.col("n") - F.col("whole") - F.coalesce("more", F.lit(0))).alias("quota")
    )


def stratified_split(
    df: DataFrame,
    label: str = "context",
    key: Sequence[str] = ("source", "source_id"),
    settings: SplitSettings = SplitSettings(),
) -> DataFrame:
    """Add `split`: the rows of each label with the smallest keyed hashes, as
    many as its quota, are "test", all others "train"."""
    marked = with_smallest(
        df, label, key, lambda sizes: _test_quotas(sizes, settings.test_share), settings.seed, "_test"
    )
    return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def approx_split(
    df: DataFrame,
    key: Sequence[str] = ("source", "source_id"),
    settings: SplitSettings = SplitSettings(),
) -> DataFrame:
    """Add `split` by the keyed hash of a row alone: about the test share of any
    set of rows, without a shuffle."""
    number = F.conv(F.substring(keyed_hash(key, settings.seed), 1, 8), 16, 10).cast("long")
    is_test = number < int(settings.test_share * (1 << 32))
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def sample_per_label(
    df: DataFrame, n: int, label: str, key: Sequence[str], seed: int = SplitSettings.seed
) -> DataFrame:
    """At most `n` rows of each label, those with the smallest keyed hashes."""

    def quotas(sizes: DataFrame) -> DataFrame:
        return sizes.select("label", F.least("n", F.lit(n)).alias("quota"))

    return with_smallest(df, label, key, quotas, seed, "_in").where("_in").drop("_in")


def balance_labels(
    df: DataFrame, label: str, key: Sequence[str], factor: float = 1.0, seed: int = SplitSettings.seed
) -> DataFrame:
    """Cut the dominant label to `factor` times the size of the second largest."""

    def quotas(sizes: DataFrame) -> DataFrame:
        largest = [row["n"] for row in sizes.orderBy(F.desc("n")).limit(2).collect()]
        most = math.floor(factor * largest[-1]) if largest else 0
        return sizes.select("label", F.least("n", F.lit(most)).alias("quota"))

    return with_smallest(df, label, key, quotas, seed, "_in").where("_in").drop("_in")

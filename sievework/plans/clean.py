"""Clean, deduplicate, filter and tag a corpus.

The order is part of the result: normalise, drop tombstones and empty rows, drop
by length, exact duplicates, near duplicates, blocked words, meta posts, tag. A
blocked row with a high score therefore still removes its near copies. With
`filters_first`, blocked words and meta posts are row rules like the length: they are
judged before the one aggregate that removes copies, and blocked rows never reach the
tables of near duplicates.

The text is shuffled twice: once to meet its copies, once to leave out the near
duplicates. The near-duplicate rounds move hashes only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework import lexicons
from sievework.config import CurationConfig
from sievework.functions.rules import is_meta_post, is_offensive, row_drop_reason
from sievework.functions.text import normalise_text, word_count_normalised
from sievework.operators.exact_dedup import exact_dedup_keep_best
from sievework.operators.near_dup import near_duplicates, without_rows
from sievework.operators.reports import FILTERS_FIRST, STAGES, funnel_report
from sievework.operators.tagging import Encoder, tag_two_pass
from sievework.sources.writers import write_report_json
from sievework.storage import materialise

KEY = ("source", "source_id")
ROW_KEY = (*KEY, "_text")


@dataclass(frozen=True)
class CleanResult:
    """`rows` are the cleaned rows with `context`; `drops` counts rows per stage."""

    rows: DataFrame
    drops: DataFrame
    stages: tuple[str, ...] = STAGES

    def funnel(self) -> DataFrame:
        return funnel_report(self.drops, self.stages)


def content_reason(text: Column, config: CurationConfig) -> Column:
    """The first content rule that a normalised text fails, or null."""
    return F.when(
        is_offensive(text, config.blocklist, config.obfuscations, config.match), "offensive"
    ).when(is_meta_post(text, config.meta_phrases, config.meta_patterns), "meta")


def normalised_with_reason(df: DataFrame, config: CurationConfig) -> DataFrame:
    """Shared columns with the text normalised and `reason`, the first row rule
    it fails."""
    base = df.select("source_id", normalise_text(F.col("text"), config.strict).alias("text"), "score", "source")
    text = F.col("text")
    reason = row_drop_reason(text, config.length, word_count_normalised(text))
    if config.filters_first:
        reason = F.coalesce(reason, content_reason(text, config))
    return base.withColumn("reason", reason)


def clean(
    df: DataFrame,
    config: CurationConfig = CurationConfig(),
    make_encoder: Callable[[], Encoder] | None = None,
) -> CleanResult:
    """Run all stages. Without an encoder, rows without a keyword get the
    fallback label."""
    # Rows that fail a rule lose their text and so meet in one group per reason:
    # one pass over the raw table yields the distinct texts and all counts.
    judged = normalised_with_reason(df, config).withColumn(
        "text", F.when(F.col("reason").isNull(), F.col("text"))
    )
    unique = materialise(
        exact_dedup_keep_best(judged, key=KEY, by=[F.col("reason")], count_as="copies"),
        "unique",
    )
    # Sources may reuse or lack an id; with the hash of its text a row has a key.
    distinct = (
        unique.where("reason IS NULL")
        .drop("reason", "copies")
        .withColumn("_text", F.xxhash64("text"))
    )
    near = materialise(
        near_duplicates(distinct, key=ROW_KEY, tie=KEY, settings=config.near_dup), "near"
    )

    text = F.col("text")
    rest = without_rows(distinct, near, ROW_KEY).drop("_text").withColumn(
        "reason",
        F.lit(None).cast("string") if config.filters_first else content_reason(text, config),
    )
    # Tagged in the same pass, dropped rows as nulls, and stored: later readers
    # must not run the encoder again.
    filtered = materialise(
        tag_two_pass(
            rest.withColumn("_clean", F.when(F.col("reason").isNull(), text)),
            text="_clean",
            keywords=config.keywords,
            make_encoder=make_encoder,
            labels=_labels(config),
            settings=config.embedding,
            fallback=config.fallback_label,
            match=config.match,
        ).drop("_clean"),
        "filtered",
    )
    rows = filtered.where("reason IS NULL").drop("reason")

    by_rule = unique.where("reason IS NOT NULL").select(
        F.col("reason").alias("stage"), F.col("copies").alias("dropped")
    )
    copies = unique.where("reason IS NULL").agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("dropped")
    )
    near_count = near.agg(F.count(F.lit(1)).alias("dropped"))
    late = filtered.groupBy(F.coalesce("reason", F.lit("final")).alias("stage")).agg(
        F.count(F.lit(1)).alias("dropped")
    )
    drops = (
        by_rule.unionByName(copies.select(F.lit("exact_dup").alias("stage"), "dropped"))
        .unionByName(near_count.select(F.lit("near_dup").alias("stage"), "dropped"))
        .unionByName(late)
    )
    return CleanResult(rows, drops, FILTERS_FIRST if config.filters_first else STAGES)


def write_report(result: CleanResult, path: str) -> None:
    """Write the counts of a run as one JSON record."""
    final = F.col("stage") == "final"
    stats = result.funnel().select(
        F.lit("stats").alias("part"),
        F.when(final, F.col("stage")).otherwise(F.concat(F.lit("dropped_"), "stage")).alias("name"),
        F.when(final, F.col("remaining")).otherwise(F.col("dropped")).alias("n"),
    )
    raw = stats.agg(F.sum("n").alias("n")).select(F.lit("stats").alias("part"), F.lit("raw").alias("name"), "n")
    # One pass over the cleaned rows; the groups are labels times sources.
    counts = result.rows.groupBy("context", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count("score").alias("scored")
    )
    counts = materialise(counts, "distribution")
    scored = counts.agg(F.sum("scored").alias("n")).select(
        F.lit("with_scores").alias("part"), F.lit("").alias("name"), "n"
    )
    report = stats.unionByName(raw).unionByName(scored)
    for column in ("context", "source"):
        sums = counts.groupBy(F.col(column).alias("name")).agg(F.sum("n").alias("n"))
        report = report.unionByName(sums.select(F.lit(f"{column}_distribution").alias("part"), "name", "n"))
    write_report_json(report, path)


def _labels(config: CurationConfig) -> tuple[str, ...]:
    if config.keywords == lexicons.CONTEXT_KEYWORDS:
        return lexicons.LABELS
    return tuple(label for label, _ in config.keywords) + (config.fallback_label,)

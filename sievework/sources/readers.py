"""Bring raw sources to one schema."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.text import SPACE_CHARS
from sievework.operators.exact_dedup import nan_to_null
from sievework.operators.select import first_rows
from sievework.sources.schemas import CORPUS
from sievework.sources.wide_csv import read_wide_csv

log = logging.getLogger(__name__)


def read_corpus_csv(
    spark: SparkSession, path: str, schema: T.StructType = CORPUS, multi_line: bool = True, wide: bool = False
) -> DataFrame:
    """A CSV with a header row, read by column name; other columns are ignored.
    A cell that is not of its column's type, such as a score of "NA", is null.

    Quoted line breaks need `multi_line`, and then a file is one task; or `wide`,
    with which a file is as many tasks as it has splits, but is read twice.
    """
    if wide:
        present = read_wide_csv(spark, path)
        return present.select(
            *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields]
        )
    header = spark.read.option("header", True).option("multiLine", multi_line)
    reader = header.option("escape", '"').option("enforceSchema", False)
    present = reader.csv(path)
    return present.select(
        *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def read_corpus_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def unify_single_field_source(
    df: DataFrame, source: str, id_column: str = "ID", text_column: str = "Joke"
) -> DataFrame:
    """A source with one text field and no scores."""
    return df.select(
        F.col(id_column).cast("string").alias("source_id"),
        F.col(text_column).alias("text"),
        F.lit(None).cast("double").alias("score"),
        F.lit(source).alias("source"),
    )


def nsfw_flag(flag: F.Column) -> F.Column:
    """A content flag with null read as false."""
    return F.coalesce(flag.cast("boolean"), F.lit(False))


def unify_two_field_source(
    df: DataFrame,
    source: str,
    id_column: str = "id",
    title_column: str = "title",
    body_column: str = "selftext",
    score_column: str | None = "score",
    flag_column: str | None = "subreddit.nsfw",
) -> DataFrame:
    """A source whose text is a set-up in one field and a punchline in another."""

    def part(name: str) -> F.Column:
        return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit("")), F.lit(SPACE_CHARS))

    joined = F.concat_ws(" ", part(title_column), part(body_column))
    score = F.col(f"`{score_column}`") if score_column else F.lit(None)
    columns = [
        F.col(f"`{id_column}`").cast("string").alias("source_id"),
        F.trim(joined, F.lit(SPACE_CHARS)).alias("text"),
        nan_to_null(score).alias("score"),
        F.lit(source).alias("source"),
    ]
    if flag_column:
        columns.append(nsfw_flag(F.col(f"`{flag_column}`")).alias("nsfw"))
    return df.select(*columns)


def limit_per_source(
    df: DataFrame, n: int, key: Sequence[str] = ("source", "source_id")
) -> DataFrame:
    """The first `n` rows of one source, in key order."""
    return first_rows(df, n, [F.col(c) for c in key])


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """All rows of all sources, in the shared columns."""
    columns = [f.name for f in CORPUS.fields]
    result = sources[0].select(*columns)
    for more in sources[1:]:
        result = result.unionByName(more.select(*columns))
    return result


def skip_missing_source(
    spark: SparkSession, paths: Sequence[str], read: Callable[[SparkSession, str], DataFrame]
) -> list[DataFrame]:
    """Read each path that exists; note the ones that do not, fail if none does."""
    found = []
    for path in paths:
        try:
            found.append(read(spark, path))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            log.warning("missing source %s", path)
    if not found:
        raise FileNotFoundError(f"none of the sources exists: {', '.join(paths)}")
    return found


def load_corpus(
    spark: SparkSession,
    paths: Sequence[str],
    limit: int | None = None,
    read: Callable[[SparkSession, str], DataFrame] = read_corpus_csv,
) -> DataFrame:
    """The union of the sources that exist, each cut to `limit` rows."""
    sources = skip_missing_source(spark, paths, read)
    if limit:
        sources = [limit_per_source(df, limit) for df in sources]
    return union_sources(sources)

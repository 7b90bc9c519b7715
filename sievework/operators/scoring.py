"""Scores of candidate texts and figures to compare sets of them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from sievework.config import NearDupSettings, ScoreSettings
from sievework.functions.expr import let
from sievework.functions.shingles import odd_numbers, shingle_hashes
from sievework.functions.text import word_count, words
from sievework.operators.near_dup import near_duplicates, with_band_keys, without_rows
from sievework.storage import materialise

# Words whose n-grams are worked on at a time.
PORTION = 500_000
# Parts the n-grams of a group are counted in, at least.
PARTS = 256


def length_score(text: Column, settings: ScoreSettings = ScoreSettings()) -> Column:
    """1 inside the wanted number of words, falling off in proportion outside."""
    low, high = settings.least_words, settings.most_words

    def score(n: Column) -> Column:
        above = F.greatest(F.lit(0.0), 1 - (n - high) / high)
        return F.when(n < low, n / low).when(n <= high, 1.0).otherwise(above)

    return let(word_count(text), score)


def cosines_to_labels(vectors: np.ndarray, names: pd.Series, labels: Sequence, label_vectors: np.ndarray) -> np.ndarray:
    """Cosine of each vector and the vector of its label; NaN for a label that is
    not declared and for a vector of length 0."""
    length = np.linalg.norm(label_vectors, axis=1)
    units = label_vectors / np.where(length == 0, 1, length)[:, None]
    place = names.map({name: i for i, name in enumerate(labels)}).to_numpy(dtype=float)
    known = ~np.isnan(place)
    # Of each row the product with its own label.
    dots = np.einsum("ij,ij->i", vectors[known], units[place[known].astype(int)])
    norms = np.sqrt(np.einsum("ij,ij->i", vectors[known], vectors[known]))
    out = np.full(len(vectors), np.nan)
    out[known] = np.divide(dots, norms, out=np.full(len(dots), np.nan), where=norms > 0)
    return out


def relevance_score(vector: Column, label: Column, labels: Sequence, label_vectors: np.ndarray) -> Column:
    """Cosine of a vector and the vector of its label, rounded to 6 digits; null
    for a label that is not declared.

    The label vectors travel with the function, not as literals, so the plan is the
    same for ten labels and for ten thousand.
    """
    labels, targets = list(labels), np.asarray(label_vectors, dtype=np.float64)

    @pandas_udf("double")
    def cosine(vectors: pd.Series, names: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=vectors.index)
        present = vectors[vectors.notna()]
        if len(present):
            stacked = np.array(present.to_list(), dtype=np.float64)
            out.loc[present.index] = cosines_to_labels(stacked, names.loc[present.index], labels, targets)
        return out

    return F.round(cosine(vector, label), 6)


def bucket_novelty_score(
    candidates: DataFrame,
    corpus: DataFrame,
    text: str = "text",
    id: str = "source_id",
    key: Sequence[str] = ("source", "source_id"),
    near_dup: NearDupSettings = NearDupSettings(),
    settings: ScoreSettings = ScoreSettings(),
) -> DataFrame:
    """Per candidate its id and `novelty` as far as LSH buckets tell: 1 less the
    largest Jaccard similarity to a kept row of the corpus in a common bucket, and
    0 from `copy_from` on. `novelty.novelty_score` compares with every row.

    After near duplicates are removed, an LSH bucket holds at most one row, so a
    candidate meets at most as many rows as there are bands. The similarity to
    those is exact; a row that shares no bucket counts as unlike.
    """
    def numbered(df: DataFrame, name: str, *columns: str) -> DataFrame:
        keyed = with_band_keys(df, text, near_dup).withColumn("grams", shingle_hashes(F.col(text), near_dup.shingle_size))
        return materialise(keyed.select(*columns, "bands", "grams").withColumn(name, F.monotonically_increasing_id()), name)

    keyed = numbered(corpus.select(*key, text), "row", *key)
    gone = materialise(near_duplicates(corpus, text, key=key, settings=near_dup), "near")
    asked = numbered(candidates.select(id, text), "asked", id)
    buckets = without_rows(keyed, gone, key).select("row", F.explode("bands").alias("bucket"))
    # Numbers meet first; the sets are fetched once for each pair.
    pairs = asked.select("asked", F.explode("bands").alias("bucket")).join(buckets, "bucket").select("asked", "row").distinct()
    both = pairs.join(asked.select("asked", F.col("grams").alias("mine")), "asked").join(
        keyed.select("row", F.col("grams").alias("theirs")), "row"
    )
    common = F.size(F.array_intersect("mine", "theirs"))
    alike = common / (F.size("mine") + F.size("theirs") - common)
    best = both.groupBy("asked").agg(F.max(alike).alias("alike"))
    met = asked.select(id, "asked").join(best, "asked", "left").groupBy(id).agg(
        F.coalesce(F.max("alike"), F.lit(0.0)).alias("most")
    )
    novelty = F.when(F.col("most") >= settings.copy_from, 0.0).otherwise(1 - F.col("most"))
    return met.select(id, F.round(novelty, 6).alias("novelty"))


def text_classifier(
    labelled: DataFrame, text: str = "text", label: str = "label", n_features: int = 1 << 16
) -> PipelineModel:
    """Logistic regression on weighted word counts, trained on all labelled rows."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[\p{L}\p{N}_]+", gaps=False),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=n_features),
            IDF(inputCol="_counts", outputCol="_features", minDocFreq=3),
            LogisticRegression(featuresCol="_features", labelCol=label, regParam=0.02),
        ]
    ).fit(labelled)


def with_probability(df: DataFrame, model: PipelineModel, name: str, text: str = "text") -> DataFrame:
    """Add `name`, the probability of the positive label; an empty text for null."""
    filled = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    scored = model.transform(filled).withColumn(name, vector_to_array("probability")[1])
    return scored.select(*df.columns, name)


def composite_score(parts: Mapping[str, Column], settings: ScoreSettings = ScoreSettings()) -> Column:
    """Weighted sum of the scores by name."""
    weights = settings.weights
    return sum((F.lit(weights[name]) * score for name, score in parts.items()), F.lit(0.0))


def group_relative_score(df: DataFrame, group: Sequence[str], score: str, key: Sequence[str]) -> DataFrame:
    """Add `relative`, the score less the mean of its group, and `best`, whether
    it is the best of the group; ties go to the smallest key.

    Means and best rows are pre-aggregated, so a group of any size is a join, which
    can be split, and not a window.
    """
    place = F.struct((-F.col(score)).alias("_minus"), *key)
    sums = df.groupBy(*group).agg(F.avg(score).alias("_mean"), F.min(place).alias("_best"))
    return (
        df.join(sums, list(group))
        .withColumn("relative", F.round(F.col(score) - F.col("_mean"), 6))
        # No negative zero.
        .withColumn("relative", F.when(F.col("relative") == 0, 0.0).otherwise(F.col("relative")))
        .withColumn("best", place == F.col("_best"))
        .drop("_mean", "_best")
    )


def distinct_n(
    df: DataFrame, group: str | Sequence[str], text: str = "text", sizes: Sequence[int] = (1, 2, 3)
) -> DataFrame:
    """Per group and n the n-grams of words, the distinct ones, and their share.

    One scan gives the n-grams of all n as numbers. Each is in one of many parts, and
    the numbers of a part come together once for each portion of the texts, not as a
    row per n-gram; so a group of any size is spread over all tasks.
    """
    groups = [group] if isinstance(group, str) else list(group)
    hashes = F.transform(words(F.col(text)), lambda word: F.xxhash64(word))
    found = gram_sets(df.select(*groups, hashes.alias("_words")), groups, sizes)
    fields = [field for field in found.schema.fields if field.name not in ("_part", "_grams", "_times")]
    schema = T.StructType([*fields, *(T.StructField(name, T.LongType()) for name in ("_times", "_distinct"))])

    def united(part: pa.Table) -> pa.Table:
        grams = np.concatenate([np.frombuffer(row.as_buffer(), dtype=np.int64) for row in part["_grams"]])
        own = part.slice(0, 1).select([field.name for field in fields])
        own = own.append_column("_times", pa.array([pc.sum(part["_times"]).as_py()]))
        return own.append_column("_distinct", pa.array([len(np.unique(grams))]))

    counts = found.groupBy(*groups, "n", "_part").applyInArrow(united, schema)
    return counts.groupBy(*groups, "n").agg(
        F.sum("_times").alias("n_grams"),
        F.sum("_distinct").alias("n_distinct"),
        F.round(F.sum("_distinct") / F.sum("_times"), 6).alias("distinct_share"),
    )


def _codes(batch: pa.RecordBatch, groups: Sequence[str]) -> np.ndarray:
    """A number per row, the same for rows of one group only."""
    codes = np.zeros(batch.num_rows, dtype=np.int64)
    for name in groups:
        try:
            column = batch.column(name).dictionary_encode(null_encoding="encode").indices
        except (pa.ArrowNotImplementedError, pa.ArrowInvalid):
            # Values that Arrow cannot tell apart: Spark does, row by row.
            return np.arange(batch.num_rows)
        place = column.to_numpy(zero_copy_only=False)
        codes = np.unique(codes * (int(place.max(initial=0)) + 1) + place, return_inverse=True)[1]
    return codes


def gram_sets(df: DataFrame, groups: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """`*groups, n, _part, _grams, _times` of the n-grams in `_words`, the word hashes of
    a text: per group and portion of the texts the distinct ones of each part, as 64-bit
    numbers in a row of bytes, and how many there are with repeats."""
    # A part must fit into one task, so more partitions make more parts.
    n_parts = max(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, codes = batch.column("_words"), _codes(batch, groups)
            n_words = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            hashes_of = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            firsts = np.concatenate(([0], np.cumsum(n_words, dtype=np.int64)))
            row = 0
            while row < batch.num_rows:
                # A portion of the texts, or one longer text.
                last = max(int(np.searchsorted(firsts, firsts[row] + PORTION, side="right")) - 1, row + 1)
                hashes = hashes_of[firsts[row] : firsts[last]]
                text = np.repeat(np.arange(row, last), n_words[row:last])
                # A row to name each group by.
                named, group_of = np.unique(codes[row:last], return_index=True, return_inverse=True)[1:]
                for n in sizes:
                    n_grams = max(len(hashes) - n + 1, 0)
                    within = text[:n_grams] == text[len(text) - n_grams :]
                    grams = np.zeros(n_grams, dtype=np.uint64)
                    for j, place in enumerate(odd_numbers("place", n)):
                        grams += hashes[j : j + n_grams] * place
                    grams, of = grams[within], group_of[text[:n_grams][within] - row]
                    for k, at in enumerate(named):
                        yield from packed(batch.slice(row + at, 1).select(groups), n, grams[of == k])
                row = last

    def packed(own: pa.RecordBatch, n: int, grams: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(grams):
            return
        # The high half, so that a part has numbers of all kinds below it.
        found, times = np.unique(grams, return_counts=True)
        part = ((found >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
        parts, begins = np.unique(part, return_index=True)
        edges = np.append(begins, len(found))
        data = pa.py_buffer(np.ascontiguousarray(found).view(np.uint8))
        sets = pa.BinaryArray.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer((edges * 8).astype(np.int32)), data])
        rows = own.take(pa.array(np.zeros(len(parts), dtype=np.int64)))
        columns = [np.full(len(parts), n, np.int32), parts.astype(np.int32), sets, np.add.reduceat(times, begins)]
        names = [*own.schema.names, "n", "_part", "_grams", "_times"]
        yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, columns)], names=names)

    made = [("n", T.IntegerType()), ("_part", T.IntegerType()), ("_grams", T.BinaryType()), ("_times", T.LongType())]
    schema = T.StructType([*df.select(*groups).schema.fields, *(T.StructField(*field) for field in made)])
    return df.mapInArrow(run, schema)


def arm_comparison(df: DataFrame, arm: str, context: str, scores: Sequence[str]) -> DataFrame:
    """Rows and mean scores of each arm per context, and over all contexts where
    the context is null."""
    means = [F.round(F.avg(s), 6).alias(f"mean_{s}") for s in scores]
    sets = [[F.col(arm), F.col(context)], [F.col(arm)]]
    return df.groupingSets(sets, arm, context).agg(F.count(F.lit(1)).alias("n_rows"), *means)


def compare_arms(
    df: DataFrame,
    arm: str,
    context: str,
    scores: Sequence[str],
    arms: Sequence,
    contexts: Sequence,
    text: str = "text",
    sizes: Sequence[int] = (1, 2, 3),
) -> DataFrame:
    """The declared `arms` side by side over the held-out `contexts`: `metric` and a
    column per arm, for each context and, where the context is null, for all of them.

    Metrics are the number of rows, the mean of each score and the share of distinct
    n-grams of each size. Rows of other arms and contexts take no part. An arm without
    rows has null, and so has a mean of nulls.
    """
    held_out = df.where(F.col(context).isin(list(contexts)) & F.col(arm).isin(list(arms)))
    # Each row once for its context and once for all.
    rows = held_out.select(
        F.col(arm).alias("arm"), F.col(text).alias("text"), *scores,
        F.explode(F.array(F.col(context), F.lit(None).cast(df.schema[context].dataType))).alias("context"),
    )
    metrics = [F.struct(F.lit("n_rows").alias("metric"), F.count(F.lit(1)).cast("double").alias("value"))]
    metrics += [
        F.struct(F.lit(f"mean_{s}").alias("metric"), F.round(F.avg(s), 6).alias("value")) for s in scores
    ]
    means = rows.groupBy("context", "arm").agg(F.array(*metrics).alias("all")).select("context", "arm", F.inline("all"))
    diversity = distinct_n(rows, ("context", "arm"), "text", sizes).select(
        "context", "arm", F.concat(F.lit("distinct_"), F.col("n").cast("string")).alias("metric"),
        F.col("distinct_share").alias("value"),
    )
    return means.unionByName(diversity).groupBy("context", "metric").pivot("arm", list(arms)).agg(F.max("value"))

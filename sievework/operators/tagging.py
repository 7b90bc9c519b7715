"""Context labels by keywords and by embedding similarity."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from sievework import lexicons
from sievework.config import EmbeddingSettings
from sievework.functions.expr import let
from sievework.functions.lexicon import count_words, found_words, has_word, may_share_text
from sievework.worker import per_worker

Keywords = Sequence[tuple[str, Sequence[str]]]
# Takes texts, returns one vector per text.
Encoder = Callable[[list[str]], np.ndarray]


def keyword_hits(
    text: Column, keywords: Keywords = lexicons.CONTEXT_KEYWORDS, match: str = "prefix"
) -> Column:
    """Keyword matches per label, in the order of the labels; `match` says what may
    follow a keyword (see `functions.lexicon`).

    One pass extracts the words of all labels; each label is then counted in
    that short extract.
    """
    lists = [kws for _, kws in keywords]
    if match == "marked" or may_share_text(lists):
        return F.array(*[count_words(text, kws, match) for kws in lists])
    none = F.array(*[F.lit(0) for _ in lists])
    return let(
        found_words(text, lists, match),
        lambda found: F.when(found == "", none).otherwise(
            F.array(*[count_words(found, kws, match) for kws in lists])
        ),
    )


def tag_by_hits(hits: Column, labels: Sequence[str]) -> Column:
    """The label with most hits, the earlier one on ties, "" without a hit."""
    names = F.array(*[F.lit(label) for label in labels])

    def pick(h: Column) -> Column:
        first_best = F.array_position(h, F.array_max(h)).cast("int")
        return F.when(F.array_max(h) > 0, F.element_at(names, first_best)).otherwise("")

    return let(hits, pick)


def tag_by_keywords(
    text: Column, keywords: Keywords = lexicons.CONTEXT_KEYWORDS, match: str = "prefix"
) -> Column:
    """The label whose keywords occur most often in `text`."""
    return tag_by_hits(keyword_hits(text, keywords, match), [label for label, _ in keywords])


def has_own_keyword(
    text: Column, label: Column, keywords: Keywords = lexicons.CONTEXT_KEYWORDS, match: str = "prefix"
) -> Column:
    """Whether a text holds a keyword of the label it carries."""
    own = F.lit(False)
    for name, kws in keywords:
        own = F.when(label == name, has_word(text, kws, match)).otherwise(own)
    return own


def _unit(matrix: np.ndarray) -> np.ndarray:
    matrix = np.asarray(matrix, dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1, norms)


def _pick(vectors: np.ndarray, label_vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best label and its cosine per vector; cosines are rounded to 6 digits so
    that a comparison does not hang on the order of a sum."""
    cosines = np.round(_unit(vectors) @ label_vectors.T, 6)
    best = cosines.argmax(axis=1)
    return best, cosines[np.arange(len(best)), best]


def _named(
    best: np.ndarray, cosine: np.ndarray, labels: Sequence[str], floor: float, fallback: str
) -> np.ndarray:
    """The names of the best labels, the fallback where the cosine is too low."""
    return np.where(cosine < floor, fallback, np.array(labels, dtype=object)[best])


def _checked_labels(labels: Sequence[str], vectors: np.ndarray) -> np.ndarray:
    if not len(labels):
        raise ValueError("no labels given")
    if len(labels) != len(vectors):
        raise ValueError("one vector per label expected")
    return _unit(vectors)


def nearest_label(
    vector: Column,
    labels: Sequence[str],
    label_vectors: np.ndarray,
    floor: float = EmbeddingSettings.floor,
    fallback: str = lexicons.FALLBACK_LABEL,
) -> Column:
    """Struct of the label with the highest cosine to `vector` and that cosine;
    the fallback label below `floor`. One matrix product per Arrow batch."""
    labels = list(labels)
    targets = _checked_labels(labels, label_vectors)

    @pandas_udf("label string, similarity double")
    def pick(vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"label": None, "similarity": np.nan}, index=vectors.index)
        present = vectors.notna()
        if present.any():
            best, cosine = _pick(np.stack(vectors[present].to_list()), targets)
            out.loc[present, "label"] = _named(best, cosine, labels, floor, fallback)
            out.loc[present, "similarity"] = cosine
        return out

    return pick(vector)


def similarity_floor_sweep(
    df: DataFrame, floors: Sequence[float], label: str = "label", similarity: str = "similarity"
) -> DataFrame:
    """`label, floor, n_rows`: rows of a label that are at or above each floor. The
    similarity is worked out once and compared with all floors in one aggregate."""
    counts = [F.count_if(F.col(similarity) >= floor) for floor in floors]
    listed = F.array(*[F.struct(F.lit(f).alias("floor"), n.alias("n_rows")) for f, n in zip(floors, counts)])
    return df.groupBy(label).agg(listed.alias("_swept")).select(label, F.inline("_swept"))


def label_centroids(
    df: DataFrame, label: str, vector: str, labels: Sequence
) -> tuple[list[str], np.ndarray]:
    """Mean vector of each of `labels`, a declared list; rows with other labels
    are not read. The driver gets one number per label and dimension."""
    components = df.where(F.col(label).isin(list(labels))).select(
        F.col(label).alias("label"), F.posexplode(vector).alias("pos", "x")
    )
    means = components.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    found: dict = {}
    for row in means.orderBy("pos").collect():
        found.setdefault(row["label"], []).append(row["mean"])
    names = [name for name in labels if name in found]
    vectors = np.array([found[name] for name in names])
    _checked_labels(names, vectors)
    return [str(name) for name in names], vectors


def encoder_of(make_encoder: Callable[[], Encoder]) -> Callable[[], Encoder]:
    """A function that gives the encoder of this Python worker. It is made by the
    first task of a worker and kept for the next ones."""
    key = uuid.uuid4().hex

    def get() -> Encoder:
        return per_worker("encoder", key, make_encoder)

    return get


def encode_texts(
    text: Column,
    make_encoder: Callable[[], Encoder],
    batch_size: int = EmbeddingSettings.batch_size,
) -> Column:
    """One vector per text. The encoder is made once per Python worker and sees
    at most `batch_size` texts a call; null texts are passed over."""
    encoder_here = encoder_of(make_encoder)

    @pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_here()
        for texts in batches:
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            present = texts[texts.notna()]
            for start in range(0, len(present), batch_size):
                part = present.iloc[start : start + batch_size]
                vectors = np.asarray(encoder(part.to_list()), dtype=np.float32)
                out.loc[part.index] = list(vectors)
            yield out

    return encode(text)


def tag_by_embedding(
    text: Column,
    labels: Sequence[str],
    make_encoder: Callable[[], Encoder],
    settings: EmbeddingSettings = EmbeddingSettings(),
    fallback: str = lexicons.FALLBACK_LABEL,
) -> Column:
    """Label whose prompt is nearest to `text`; null for a null text.

    Encoding and choice share one Arrow pass, so vectors never leave Python.
    """
    labels = [label for label in labels if label != fallback]
    prompts = [settings.label_prompt.format(label=label) for label in labels]
    encoder_here = encoder_of(make_encoder)

    @pandas_udf("string")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_here()
        targets = _checked_labels(labels, encoder(prompts))
        for texts in batches:
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            present = texts[texts.notna()]
            for start in range(0, len(present), settings.batch_size):
                part = present.iloc[start : start + settings.batch_size]
                best, cosine = _pick(encoder(part.to_list()), targets)
                out.loc[part.index] = _named(best, cosine, labels, settings.floor, fallback)
            yield out

    return tag(text)


def tag_two_pass(
    df: DataFrame,
    text: str = "text",
    keywords: Keywords = lexicons.CONTEXT_KEYWORDS,
    make_encoder: Callable[[], Encoder] | None = None,
    labels: Sequence[str] = lexicons.LABELS,
    settings: EmbeddingSettings = EmbeddingSettings(),
    fallback: str = lexicons.FALLBACK_LABEL,
    match: str = "prefix",
) -> DataFrame:
    """Add `context`: by keywords, and for rows without a hit by embedding, or
    the fallback label if there is no encoder.

    Rows with a hit reach the encoder as nulls, so one scan serves both passes
    and only the rest is encoded.
    """
    df = df.withColumn("_by_keyword", tag_by_keywords(F.col(text), keywords, match))
    hit = F.col("_by_keyword") != ""
    if make_encoder is None:
        rest = F.lit(fallback)
    else:
        untagged = F.when(~hit, F.col(text))
        rest = tag_by_embedding(untagged, labels, make_encoder, settings, fallback)
    return df.withColumn("context", F.when(hit, F.col("_by_keyword")).otherwise(rest)).drop(
        "_by_keyword"
    )

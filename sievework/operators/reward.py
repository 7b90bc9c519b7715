"""The whole score of a candidate: quality, relevance, novelty, cleanliness, length."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sievework import lexicons
from sievework.config import EmbeddingSettings, ScoreSettings
from sievework.operators.novelty import novelty_score
from sievework.operators.scoring import composite_score, cosines_to_labels, length_score, with_probability
from sievework.operators.tagging import Encoder, encoder_of
from sievework.storage import materialise

PARTS = ("quality", "relevance", "novelty", "clean", "length")


def relevance_to_label(
    text: Column,
    label: Column,
    make_encoder: Callable[[], Encoder],
    labels: Sequence[str] = lexicons.LABELS,
    settings: EmbeddingSettings = EmbeddingSettings(),
) -> Column:
    """Cosine of a text and the prompt of its label, as an encoder sees them, rounded
    to 6 digits; null for a null text, and for a label that is not declared.

    Prompts and texts are encoded in the same Arrow pass, so vectors never leave
    Python. The encoder is made once per worker.
    """
    labels, encoder_here = list(labels), encoder_of(make_encoder)
    prompts = [settings.label_prompt.format(label=name) for name in labels]

    @pandas_udf("double")
    def cosine(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encoder = encoder_here()
        targets = np.asarray(encoder(prompts), dtype=np.float64)
        for texts, names in batches:
            out = pd.Series(np.nan, index=texts.index)
            present = texts[texts.notna()]
            for start in range(0, len(present), settings.batch_size):
                part = present.iloc[start : start + settings.batch_size]
                vectors = np.asarray(encoder(part.to_list()), dtype=np.float64)
                out.loc[part.index] = cosines_to_labels(vectors, names.loc[part.index], labels, targets)
            yield out

    return F.round(cosine(text, label), 6)


def reward(
    candidates: DataFrame,
    corpus: DataFrame,
    quality: PipelineModel,
    toxicity: PipelineModel,
    make_encoder: Callable[[], Encoder],
    id: str = "source_id",
    text: str = "text",
    label: str = "context",
    labels: Sequence[str] = lexicons.LABELS,
    embedding: EmbeddingSettings = EmbeddingSettings(),
    settings: ScoreSettings = ScoreSettings(),
) -> DataFrame:
    """Per candidate its id, the five PARTS and `score`, their sum under
    `settings.weights`. Runs jobs.

    `clean` is 1 less the toxicity; a relevance that cannot be told counts as 0. An
    id must not be shared by different texts, for which novelty is one figure.
    """
    rows = candidates.select(F.col(id), F.col(text), F.col(label))
    new = materialise(novelty_score(rows, corpus, text, id, settings=settings), "novelty")
    rated = with_probability(with_probability(rows, quality, "quality", text), toxicity, "toxic", text)
    parts = rated.select(
        F.col(id), "quality",
        F.coalesce(relevance_to_label(F.col(text), F.col(label), make_encoder, labels, embedding), F.lit(0.0)).alias("relevance"),
        (1 - F.col("toxic")).alias("clean"),
        length_score(F.coalesce(F.col(text), F.lit("")), settings).alias("length"),
    )
    both = parts.alias("p").join(new.alias("n"), F.col(f"p.{id}").eqNullSafe(F.col(f"n.{id}")))
    scores = both.select(f"p.{id}", *[F.col(f"n.{name}" if name == "novelty" else f"p.{name}") for name in PARTS])
    return scores.select("*", composite_score({name: F.col(name) for name in PARTS}, settings).alias("score"))

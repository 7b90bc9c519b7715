"""Number of tokens of each text, by merging whole batches of pre-tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.bpe import Encoder
from sievework.worker import per_worker


def token_counts(
    df: DataFrame, path: str, id: str = "doc_id", text: str = "text", limit: int = 1024
) -> DataFrame:
    """Per row its id, `n_bytes`, `n_tokens` and `over_limit`, for the byte-level
    vocabulary file `path` that all executors have. One pass without a shuffle.

    A null text is an empty one; a row with a null id and repeated rows are rows
    like any other. Strings of special tokens inside a text are such tokens. A text is
    read whole, with some 60 bytes of memory per byte.
    Other columns are not read, whatever their names; no rows give no rows.
    """

    def run(batches):
        encoder = per_worker("bpe", path, lambda: Encoder(path))
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            counts = encoder.counts(texts.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pc.binary_length(texts).cast(pa.int64()),
                    pa.array(counts.astype(np.int64)),
                    pa.array(counts > limit),
                ],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("id", id)

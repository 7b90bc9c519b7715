"""Pack tokenised documents into sequences of a fixed length.

A document longer than a sequence is cut; its full pieces are sequences of their
own. The rests, one per document, are packed first-fit decreasing: largest first,
each into the first sequence with room, found in a tournament tree of the room
that is left. Documents are dealt at random into groups of bounded size, and each
group is packed on its own.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.bpe import Encoder
from sievework.storage import materialise
from sievework.worker import per_worker


@dataclass(frozen=True)
class PackSettings:
    length: int = 2048
    # Documents of a group, on average. A group is one array in one task.
    group: int = 4096
    end_id: int = 1
    seed: int = 42


class RoomTree:
    """Room left per bin, with the most room of each half above."""

    def __init__(self, n_bins: int, room: int):
        self.leaves = 1 << max(n_bins - 1, 0).bit_length()
        self.most = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Take `size` from the first bin with that much room; the bin, and the
        room it had."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < size:
                at += 1
        bin_, room = at - self.leaves, most[at]
        most[at] = room - size
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return bin_, room


def first_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset in it of each size; ties keep their order."""
    tree = RoomTree(len(sizes), length)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i], room = tree.place(int(sizes[i]))
        offsets[i] = length - room
    return bins, offsets


def tokenised(df: DataFrame, path: str, id: str, text: str, settings: PackSettings) -> DataFrame:
    """`id, doc_tokens, crcs` of each row: its tokens with the end id, and the
    checksum of each piece."""
    length, end_id = settings.length, settings.end_id

    def run(batches):
        end = np.array([end_id], dtype="<u4").tobytes()
        encoder = per_worker("bpe", path, lambda: Encoder(path))
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            for first, ids, edges in encoder.encode(texts):
                ids = np.ascontiguousarray(ids, dtype="<u4")
                crcs = []
                for begin, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    parts = [
                        zlib.crc32(ids[at : min(at + length, stop)])
                        for at in range(begin, stop, length)
                    ]
                    # The end id closes the last piece, or is one of its own.
                    if (stop - begin) % length:
                        parts[-1] = zlib.crc32(end, parts[-1])
                    else:
                        parts.append(zlib.crc32(end))
                    crcs.append(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, len(crcs)),
                        pa.array(np.diff(edges) + 1),
                        pa.array(crcs, type=pa.list_(pa.int64())),
                    ],
                    names=["id", "doc_tokens", "crcs"],
                )

    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, doc_tokens long, crcs array<long>")


def pack(
    df: DataFrame, path: str, id: str = "doc_id", text: str = "text",
    settings: PackSettings = PackSettings(),
) -> DataFrame:
    """Per piece its document, `start`, `length`, `ids_crc32`, `doc_tokens`,
    `sequence_id` and `offset`. Runs jobs; only lengths and checksums are shuffled.

    A null or empty text is the end id alone. Rows with a null id and repeated
    rows are documents like any other. A text longer than a sequence is cut.
    Other columns are not read, whatever their names; no rows give no rows.
    """
    length = settings.length
    # The row number is stored, so that groups stay the same if a task runs again.
    rows = materialise(
        tokenised(df, path, id, text, settings).withColumn("row", F.monotonically_increasing_id()),
        "tokenised",
    )
    n_groups = max(1, round(rows.count() / settings.group))
    grouped = rows.withColumn(
        "group", F.pmod(F.xxhash64(F.lit(settings.seed), "row", "id"), F.lit(n_groups))
    )

    def pack_group(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values("row", kind="stable")
        tokens = docs["doc_tokens"].to_numpy()
        n_full, rest = tokens // length, tokens % length
        n_pieces = n_full + (rest > 0)
        doc = np.repeat(np.arange(len(docs)), n_pieces)
        piece = ragged_positions(n_pieces)
        is_rest = piece == n_full[doc]
        size = np.where(is_rest, rest[doc], length)
        bins, offsets = first_fit_decreasing(size[is_rest], length)
        n_bins = int(bins.max()) + 1 if len(bins) else 0
        sequence, offset = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        sequence[is_rest], offset[is_rest] = bins, offsets
        sequence[~is_rest] = n_bins + np.arange((~is_rest).sum())
        crcs = docs["crcs"].to_numpy()
        ids = docs["id"].array
        return pd.DataFrame(
            {
                "id": ids.take(doc),
                "start": piece * length,
                "length": size,
                "ids_crc32": np.concatenate(crcs).astype(np.int64),
                "doc_tokens": tokens[doc],
                "sequence_id": (int(key[0]) << 32) + sequence,
                "offset": offset,
            }
        )

    packed = grouped.groupBy("group").applyInPandas(
        pack_group,
        "id long, start long, length long, ids_crc32 long, doc_tokens long,"
        " sequence_id long, offset long",
    )
    return packed.withColumnRenamed("id", id)


def ragged_positions(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)

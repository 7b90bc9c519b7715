"""Ranked lexical search of all documents for a table of items.

The score of a document for an item is a sum over the item's terms: a weight of
the term times the term's impact in the document, all whole numbers. That is a
product of matrices, items by terms and terms by documents, and is computed as one,
tile by tile, by the BLAS of numpy:

- the items are dealt into blocks of bounded size. A pass over the documents keeps
  the terms of the block's vocabulary alone, with their counts;
- the terms that a tile of items holds, and a tile of documents has, are numbered
  anew, so both matrices are dense and as small as can be;
- products are whole numbers in float64. A tile has so few terms that no sum can
  reach 2^53, so sums are exact in any order; tiles are added up as integers.

Of each product every task keeps the best documents per item, with all that tie at
the last place until ids have decided.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import ragged
from sievework.storage import materialise

# All bytes but letters and digits of ASCII and those of other characters.
BETWEEN_TERMS = np.ones(256, dtype=bool)
BETWEEN_TERMS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
# No sum of products in float64 may reach this.
EXACT = 1 << 53


@dataclass(frozen=True)
class SearchSettings:
    most: int = 10
    # Fixed values of the score.
    scale: int = 1_000_000_000
    unit: int = 1000
    slope: int = 8
    length_percent: int = 90
    # Terms of the items of a block, on average; its vocabulary, weights and lists
    # go to each task (20 bytes a term). More items take more passes.
    block_terms: int = 200_000
    # Sizes of the matrices: items by terms, and terms by documents.
    item_tile: int = 64
    term_tile: int = 4096
    document_tile: int = 512
    # Parts in which the results of the tasks are first brought together.
    parts: int = 64


def text_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term, and per text the index of its first one."""
    starts, ends, firsts = ragged.word_spans(data, offsets, BETWEEN_TERMS)
    return ragged.span_hashes(ragged.LOWER[data], starts, ends), firsts


def item_terms(items: DataFrame) -> DataFrame:
    """`item, terms` of `items(item, text)`: the distinct terms as numbers."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in ragged.text_portions(batch.column("text")):
                hashes, firsts = text_terms(data, offsets)
                terms = [np.unique(hashes[a:b]) for a, b in zip(firsts[:-1], firsts[1:])]
                edges = np.concatenate(([0], np.cumsum([len(x) for x in terms], dtype=np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item").slice(row, len(terms)),
                     ragged.listed(np.concatenate(terms).view(np.int64), edges)],
                    names=["item", "terms"],
                )

    return items.mapInArrow(run, "item long, terms array<long>")


def postings(documents: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Per row of `documents(id, text)` its id, its number of terms `n`, the places
    in `vocabulary` of those that are there, and how often each occurs."""

    def run(batches):
        index = ragged.Index(vocabulary)
        for batch in batches:
            for row, data, offsets in ragged.text_portions(batch.column("text"), 500_000):
                hashes, firsts = text_terms(data, offsets)
                n = np.diff(firsts)
                place = index.find(hashes)
                owner = np.repeat(np.arange(len(n)), n)
                known = place >= 0
                terms, times, edges = ragged.counted(owner[known], place[known], len(n), max(len(vocabulary), 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(row, len(n)), pa.array(n),
                     ragged.listed(terms.astype(np.int32), edges), ragged.listed(times, edges)],
                    names=["id", "n", "terms", "times"],
                )

    return documents.mapInArrow(run, "id long, n long, terms array<int>, times array<long>")


class ItemTile:
    """Some items: their own vocabulary, and the matrix of their weights by it."""

    def __init__(self, first: int, lists: Sequence[np.ndarray], weights: np.ndarray):
        self.first, self.n = first, len(lists)
        self.terms = np.unique(np.concatenate(lists))
        self.matrix = np.zeros((len(lists), len(self.terms)))
        for i, terms in enumerate(lists):
            self.matrix[i, np.searchsorted(self.terms, terms)] = weights[terms]

    def scores(self, owner: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n: int, term_tile: int) -> np.ndarray:
        """Scores of all items for `n` documents, given the impacts of terms."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        mine = self.terms[at] == terms
        owner, at, impacts = owner[mine], at[mine], impacts[mine]
        present, row = np.unique(at, return_inverse=True)
        total = np.zeros((self.n, n), dtype=np.int64)
        # No more terms than keep every sum below 2^53.
        largest = int(self.matrix.max(initial=0)) * int(impacts.max(initial=0))
        step = max(1, min(term_tile, (EXACT - 1) // max(largest, 1)))
        for begin in range(0, len(present), step):
            held = (row >= begin) & (row < begin + step)
            dense = np.zeros((min(step, len(present) - begin), n))
            dense[row[held] - begin, owner[held]] = impacts[held]
            total += np.rint(self.matrix[:, present[begin : begin + step]] @ dense).astype(np.int64)
        return total


class Best:
    """The best documents of each item of a tile so far: by score, then by id, and
    documents without an id last."""

    def __init__(self, n_items: int, most: int):
        self.most, self.least = most, np.ones(n_items, dtype=np.int64)
        self.item, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.no_id = np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        """All documents of a tile; those that tie with the last place count too."""
        least = self.least
        if scores.shape[1] > self.most:
            at = scores.shape[1] - self.most
            least = np.maximum(least, np.partition(scores, at, axis=1)[:, at])
        item, document = np.nonzero(scores >= least[:, None])
        if not len(item):
            return
        item = np.concatenate((self.item, item))
        score = np.concatenate((self.score, scores[item[len(self.item):], document]))
        id_ = np.concatenate((self.id, ids[document]))
        no_id = np.concatenate((self.no_id, no_id[document]))
        order = np.lexsort((id_, no_id, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order, item, rank = order[rank < self.most], item[rank < self.most], rank[rank < self.most]
        self.item, self.score, self.id, self.no_id = item, score[order], id_[order], no_id[order]
        full = rank == self.most - 1
        self.least[item[full]] = self.score[full]


def lengths_of(n: np.ndarray, n_documents: int, n_terms: int, settings: SearchSettings) -> np.ndarray:
    """The share of the length in each document's score; in whole numbers of any size
    where 64 bits would not do."""
    p = settings.length_percent
    if int(n.max(initial=0)) * p * n_documents >= 1 << 63:
        n = n.astype(object)
    return (100 - p + p * n * n_documents // n_terms).astype(np.int64)


def _block_scores(
    found: DataFrame, tiles: list[tuple[int, list[np.ndarray]]], weights: np.ndarray, n_documents: int,
    n_terms: int, settings: SearchSettings,
) -> DataFrame:
    """`item, score, id`: the best documents of each task for each item."""
    s = settings

    def run(batches):
        own = [ItemTile(first, lists, weights) for first, lists in tiles]
        best = [Best(tile.n, s.most) for tile in own]
        for batch in batches:
            ids = batch.column("id")
            no_id = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            lengths = lengths_of(batch.column("n").to_numpy(), n_documents, n_terms, s)
            lists = batch.column("terms")
            edges = lists.offsets.to_numpy().astype(np.int64)
            edges = edges - edges[0]
            terms, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            for first in range(0, len(ids), s.document_tile):
                last = min(first + s.document_tile, len(ids))
                part = slice(edges[first], edges[last])
                owner = np.repeat(np.arange(last - first), np.diff(edges[first : last + 1]))
                impacts = (s.scale * times[part]) // (s.unit * times[part] + s.slope * lengths[first:last][owner])
                for tile, held in zip(own, best):
                    scores = tile.scores(owner, terms[part], impacts, last - first, s.term_tile)
                    held.add(scores, ids[first:last], no_id[first:last])
        for tile, held in zip(own, best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.item + tile.first), pa.array(held.score), pa.array(held.id, mask=held.no_id)],
                names=["place", "score", "id"],
            )

    return found.where("size(terms) > 0").select("id", "n", "terms", "times").mapInArrow(
        run, "place long, score long, id long"
    )


def _ranked(rows: DataFrame, most: int, *within: str) -> DataFrame:
    """The first rows of each group, numbered from 1 as `rank`."""
    order = Window.partitionBy(*within).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def lexical_search(
    documents: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", settings: SearchSettings = SearchSettings(),
) -> DataFrame:
    """Per row of `items` its id and its best documents: `rank`, id and `score`,
    equal scores by ascending id. Only scores above 0 count. Runs jobs.

    Terms are runs of letters and digits of ASCII and of all other characters, A-Z
    in lower case; they are compared by 64-bit hashes. A null or empty text has none:
    such a document counts nowhere and such an item finds nothing, as do all items
    if there are no documents. A row without an id is a row like any other, and its
    document stands behind equal ones with an id; repeated rows are each counted,
    ranked and answered. Other columns are not read. Texts are read whole, with
    some 60 bytes of memory per byte of text.
    """
    s, spark = settings, documents.sparkSession
    asked = materialise(
        items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
        .withColumn("item", F.monotonically_increasing_id()),
        "items",
    )
    listed = materialise(item_terms(asked.select("item", "text")).where("size(terms) > 0"), "item-terms")
    n_blocks = -(-(listed.agg(F.sum(F.size("terms"))).first()[0] or 0) // s.block_terms)
    rows = documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    results = []
    for block in range(n_blocks):
        chosen = listed.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).toPandas().sort_values("item")
        if not len(chosen):
            continue
        lists = [np.asarray(x, dtype=np.int64).view(np.uint64) for x in chosen["terms"]]
        vocabulary = np.unique(np.concatenate(lists))
        lists = [np.searchsorted(vocabulary, x) for x in lists]
        found = materialise(postings(rows, vocabulary), "postings")
        sizes = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        n_documents, n_terms = int(sizes[0]), int(sizes[1] or 0)
        if not n_terms:
            continue
        holding = np.zeros(len(vocabulary), dtype=np.int64)
        counted = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        for row in counted.toPandas().itertuples():
            holding[row.term] = row.n
        weights = np.array(
            [math.floor(1000 * math.log((2 * n_documents + 2) / (2 * n + 1))) for n in holding.tolist()], dtype=np.int64
        )
        tiles = [(first, lists[first : first + s.item_tile]) for first in range(0, len(lists), s.item_tile)]
        best = _block_scores(found, tiles, weights, n_documents, n_terms, s)
        # Brought together in two steps, so no task meets what all tasks found.
        some = _ranked(best.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(s.parts))), s.most, "place", "part")
        ranked = _ranked(some.drop("rank", "part"), s.most, "place")
        places = spark.createDataFrame(
            [(i, int(item)) for i, item in enumerate(chosen["item"])], "place long, item long"
        )
        results.append(ranked.join(places, "place"))
    if not results:
        none = asked.where("false").select("item").withColumns(
            {"rank": F.lit(0), "id": F.lit(0).cast("long"), "score": F.lit(0).cast("long")}
        )
        results.append(none)
    answers = reduce(DataFrame.unionByName, [r.select("item", "rank", "id", "score") for r in results])
    return answers.join(asked.select("item", "item_id"), "item").select(
        F.col("item_id").alias(item_id), "rank", F.col("id").alias(id), "score"
    )

"""Align the tokens of two tokenizers over the same bytes.

Each text is cut into tokens by A and by B. Where tokens of both end at the same
byte, a group ends; the last tokens of the group are linked. In most groups one
token of A faces one token of B with the same bytes. For those a table from A's
ids to B's ids, made once from the two vocabularies, says what the partner is, so
they are counted in one array of the length of A's vocabulary per task. Only what
the other groups link is shuffled as pairs of ids.

How often a pair is linked, and which pairs are the most frequent of their B id,
is then brought back to the documents: from two arrays of the length of the
vocabularies for same-byte pairs, from a bounded table for the most frequent other
pairs, and by a join for the rest, where no key is frequent any more.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import ragged
from sievework.llm.bpe import Encoder, byte_signs
from sievework.storage import materialise
from sievework.worker import per_worker

# The sign that stands for a blank in B's pieces.
BLANK = "▁"


@dataclass(frozen=True)
class AlignSettings:
    # Pairs of ids with at least this share of all irregular links go to each task,
    # so there are at most 1 / hot_share of them (24 bytes each).
    hot_share: float = 1e-5
    # Bytes of text worked on at a time, some 100 bytes of memory each.
    portion: int = 400_000


class Pieces:
    """The bytes of each token of a vocabulary, in one array."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.digits = np.array([str(i) for i in range(len(tokens))], dtype="S")
        self.n_digits = np.char.str_len(self.digits)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, one after the other."""
        return self.data[ragged.ranges(self.starts[ids], self.sizes[ids])]


def tokens_of_a(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary file; an id without an entry, and
    a special one, stands for its own name."""
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    byte_of = {sign: byte for byte, sign in enumerate(byte_signs())}
    vocab = stored["model"]["vocab"]
    tokens = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        plain = all(sign in byte_of for sign in token)
        tokens[i] = bytes(byte_of[sign] for sign in token) if plain else token.encode()
    return tokens


def tokens_of_b(processor) -> list[bytes]:
    """Bytes of each piece of a sentencepiece model."""
    tokens = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        tokens.append(
            bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace(BLANK, " ").encode()
        )
    return tokens


def same_bytes(a: list[bytes], b: list[bytes], processor) -> np.ndarray:
    """Per A id the B id with the same bytes, or -1. A piece goes before the
    fallback for its byte, which has a smaller id."""
    b_of = {token: i for i, token in enumerate(b) if not processor.is_control(i)}
    return np.array([b_of.get(token, -1) for token in a], dtype=np.int64)


class Aligner:
    """Both tokenizers and the table from A's ids to the B ids of the same bytes."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.encoder = Encoder(path_a, specials=False)
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path_b)
        a, b = tokens_of_a(path_a), tokens_of_b(self.processor)
        self.a, self.b = Pieces(a), Pieces(b)
        self.same = same_bytes(a, b, self.processor)

    def encode(self, texts: list[str]):
        """Per text the bytes both must make, ids of A and B, and where each text
        begins in them. Texts that either tokenizer changes have no tokens."""
        n = len(texts)
        spaced = [" " + text if text else "" for text in texts]
        ids_a, edges_a = [], [np.zeros(1, np.int64)]
        for _, ids, edges in self.encoder.encode(spaced):
            ids_a.append(ids)
            edges_a.append(edges[1:] + edges_a[-1][-1])
        ids_a, edges_a = np.concatenate(ids_a).astype(np.int64), np.concatenate(edges_a)
        lists = self.processor.encode(texts, num_threads=1)
        edges_b = np.concatenate(([0], np.cumsum([len(ids) for ids in lists], dtype=np.int64)))
        ids_b = np.fromiter((i for ids in lists for i in ids), np.int64, edges_b[-1])
        raw = [text.encode() for text in spaced]
        sizes = np.fromiter(map(len, raw), np.int64, n)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        good = sizes > 0
        for pieces, ids, edges in ((self.a, ids_a, edges_a), (self.b, ids_b, edges_b)):
            made = ragged.sums_by(pieces.sizes[ids], edges)
            good &= made == sizes
            # Compare the bytes of the texts whose length is right.
            keep = np.repeat(good, np.diff(edges))
            own = np.flatnonzero(good)
            at = ragged.ranges((np.cumsum(sizes) - sizes)[own], sizes[own])
            differs = np.concatenate(([0], np.cumsum(data[at] != pieces.joined(ids[keep]))))
            ends = np.cumsum(sizes[own])
            good[own] = differs[ends] == differs[ends - sizes[own]]
        out = []
        for ids, edges in ((ids_a, edges_a), (ids_b, edges_b)):
            counts = np.diff(edges)
            out += [ids[np.repeat(good, counts)], np.concatenate(([0], np.cumsum(np.where(good, counts, 0))))]
        return out

    def groups(self, ids_a: np.ndarray, ids_b: np.ndarray):
        """Whether a group ends with each token of A, and of B."""
        ends_a, ends_b = np.cumsum(self.a.sizes[ids_a]), np.cumsum(self.b.sizes[ids_b])
        marks = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, dtype=np.int8)
        marks[ends_a] += 1
        marks[ends_b] += 2
        return marks[ends_a] == 3, marks[ends_b] == 3

    def written(self, ids_a, ids_b, last_a, last_b) -> tuple[np.ndarray, np.ndarray]:
        """All groups in writing, `a1,a2|b1;`, one after the other, and where each
        one ends."""
        n_a, n_b = len(ids_a), len(ids_b)
        group_a = np.cumsum(last_a) - last_a
        group_b = np.cumsum(last_b) - last_b
        # Tokens of A and of B by turns, group by group.
        place_a = np.arange(n_a) + np.concatenate(([0], np.cumsum(np.bincount(group_b))))[group_a]
        place_b = np.arange(n_b) + np.cumsum(np.bincount(group_a))[group_b]
        width = max(self.a.digits.itemsize, self.b.digits.itemsize)
        signs = np.zeros((n_a + n_b, width + 1), dtype=np.uint8)
        sizes = np.zeros(n_a + n_b, dtype=np.int64)
        for pieces, ids, place, last, close in (
            (self.a, ids_a, place_a, last_a, "|"), (self.b, ids_b, place_b, last_b, ";")
        ):
            own = pieces.digits.itemsize
            signs[place, :own] = pieces.digits[ids].view(np.uint8).reshape(-1, own)
            sizes[place] = pieces.n_digits[ids]
            signs[place, sizes[place]] = np.where(last, ord(close), ord(","))
        ends = np.cumsum(sizes + 1)
        return signs[signs > 0], ends[place_b[last_b]]

    def rows(self, texts: list[str]):
        """Arrays of the columns of LINKS for some texts."""
        ids_a, edges_a, ids_b, edges_b = self.encode(texts)
        last_a, last_b = self.groups(ids_a, ids_b)
        end_a, end_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        link_a, link_b = ids_a[end_a], ids_b[end_b]
        one_a = np.diff(np.append(-1, end_a)) == 1
        one_b = np.diff(np.append(-1, end_b)) == 1
        regular = one_a & one_b & (self.same[link_a] == link_b)
        firsts = np.searchsorted(end_a, edges_a)  # first group of each text
        n_groups = np.diff(firsts)
        signs, ends = self.written(ids_a, ids_b, last_a, last_b) if len(end_a) else (np.zeros(0, np.uint8), end_a)
        # A text's groups, without what closes the last one.
        text_ends = np.concatenate(([0], ends))[firsts]
        data = signs.tobytes()
        shas = [
            hashlib.sha256(data[a : b - 1]).hexdigest() if b > a else ""
            for a, b in zip(text_ends[:-1].tolist(), text_ends[1:].tolist())
        ]
        owner = np.repeat(np.arange(len(texts)), n_groups)
        same, same_n, same_edges = ragged.counted(owner[regular], link_a[regular], len(texts), len(self.a.sizes))
        key = link_a[~regular] * len(self.b.sizes) + link_b[~regular]
        pairs, pairs_n, pairs_edges = ragged.counted(owner[~regular], key, len(texts), len(self.a.sizes) * len(self.b.sizes))
        return [
            pa.array(np.diff(edges_a)), pa.array(np.diff(edges_b)), pa.array(n_groups), pa.array(shas, pa.string()),
            ragged.listed(same.astype(np.int32), same_edges), ragged.listed(same_n, same_edges),
            ragged.listed(pairs, pairs_edges), ragged.listed(pairs_n, pairs_edges),
        ]


FIGURES = ("n_a", "n_b", "n_groups", "groups_sha256")
LINKS = (
    "n_a long, n_b long, n_groups long, groups_sha256 string, same array<int>, same_n array<long>,"
    " pairs array<long>, pairs_n array<long>"
)


def links(df: DataFrame, path_a: str, path_b: str, settings: AlignSettings = AlignSettings()) -> DataFrame:
    """Per row of `df(id, text)` its id, numbers of tokens and groups, the digest of
    its groups, and its links: A ids of same-byte links, and pairs of the others as
    A id * size of B's vocabulary + B id, each with how often it is there."""

    def run(batches):
        aligner = per_worker("aligner", f"{path_a}\n{path_b}", lambda: Aligner(path_a, path_b))
        for batch in batches:
            texts = batch.column("text").fill_null("")
            _, offsets = ragged.text_bytes(texts)
            for first, last in ragged.portions(offsets, settings.portion):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, last - first),
                     *aligner.rows(texts.slice(first, last - first).to_pylist())],
                    names=["id", *[part.split()[0] for part in LINKS.split(", ")]],
                )

    return df.mapInArrow(run, f"id long, {LINKS}")


def same_counts(rows: DataFrame, n_a: int) -> np.ndarray:
    """How often each A id is in a same-byte link: one array per task, then their
    sum, which has the length of the vocabulary."""

    def run(batches):
        totals = np.zeros(n_a, dtype=np.int64)
        for batch in batches:
            ids, n = batch.column("same").flatten(), batch.column("same_n").flatten()
            np.add.at(totals, ids.to_numpy(), n.to_numpy())
        at = totals.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], names=["a", "n"])

    totals = np.zeros(n_a, dtype=np.int64)
    summed = rows.select("same", "same_n").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    for row in summed.toPandas().itertuples():
        totals[row.a] = row.n
    return totals


def token_alignment(
    df: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text",
    settings: AlignSettings = AlignSettings(),
) -> DataFrame:
    """Per row its id, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum` and
    `groups_sha256`, for a byte-level vocabulary file A, which is given a blank and
    the text, and a sentencepiece model B, which is given the text. Runs jobs.

    A link's count is how many links of all rows are of the same pair of ids; it is
    among the best if no pair of its B id has a larger one. Special strings inside
    a text are plain text. A null or empty text, and one that a tokenizer does not
    keep byte for byte (B reads its sign for a blank as one), has no tokens: zeros,
    and '' in place of a digest. A row with a null id and repeated rows are rows like
    any other; other columns are not read; no rows give no rows. A text is worked on
    whole, with some 100 bytes of memory per byte.
    """
    import sentencepiece

    s = settings
    processor = sentencepiece.SentencePieceProcessor(model_file=path_b)
    same = same_bytes(tokens_of_a(path_a), tokens_of_b(processor), processor)
    n_a, n_b = len(same), processor.get_piece_size()
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    found = materialise(
        links(rows, path_a, path_b, s).withColumn("row", F.monotonically_increasing_id()), "links"
    )
    same_n = same_counts(found, n_a)

    each = F.explode(F.arrays_zip("pairs", "pairs_n")).alias("link")
    linked = found.select("row", each).select("row", F.col("link.pairs").alias("pair"), F.col("link.pairs_n").alias("n"))
    pairs = materialise(
        linked.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.pmod("pair", F.lit(n_b))), "pairs"
    )
    # The largest count of each B id, over pairs of both kinds.
    most = np.zeros(n_b, dtype=np.int64)
    for row in pairs.groupBy("b").agg(F.max("count").alias("most")).toPandas().itertuples():
        most[row.b] = row.most
    np.maximum.at(most, same[same >= 0], same_n[same >= 0])
    same_best = same_n == most[same]

    least = max(1, int((pairs.agg(F.sum("count")).first()[0] or 0) * s.hot_share))
    hot = pairs.where(F.col("count") > least).toPandas().sort_values("pair")
    hot_pair, hot_n = hot["pair"].to_numpy(np.int64), hot["count"].to_numpy(np.int64)
    hot_best = hot_n == most[hot["b"].to_numpy(np.int64)]

    def known(batches):
        """Sums over the links whose counts are here, and the other links."""
        for batch in batches:
            n = batch.num_rows
            sums = np.zeros((2, n), dtype=np.int64)

            def add(owner, times, count, best):
                np.add.at(sums[0], owner, times * best)
                np.add.at(sums[1], owner, times * count)

            def flat(name):
                column = batch.column(name)
                sizes = np.diff(column.offsets.to_numpy())
                return np.repeat(np.arange(n), sizes), column.flatten().to_numpy()

            owner, ids = flat("same")
            add(owner, flat("same_n")[1], same_n[ids], same_best[ids])
            owner, pair = flat("pairs")
            times = flat("pairs_n")[1]
            at = np.minimum(np.searchsorted(hot_pair, pair), max(len(hot_pair) - 1, 0))
            is_hot = hot_pair[at] == pair if len(hot_pair) else np.zeros(len(pair), bool)
            if is_hot.any():
                add(owner[is_hot], times[is_hot], hot_n[at[is_hot]], hot_best[at[is_hot]])
            cold = ~is_hot
            edges = np.searchsorted(owner[cold], np.arange(n + 1))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in ("row", "id", *FIGURES)], pa.array(sums[0]), pa.array(sums[1]),
                 ragged.listed(pair[cold], edges), ragged.listed(times[cold], edges)],
                names=["row", "id", *FIGURES, "n_best", "count_sum", "pairs", "pairs_n"],
            )

    kinds = "row long, id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long"
    partly = materialise(found.mapInArrow(known, f"{kinds}, pairs array<long>, pairs_n array<long>"), "partly")
    best = df.sparkSession.createDataFrame([(b, int(n)) for b, n in enumerate(most)], "b long, most long")
    cold = pairs.where(F.col("count") <= least).join(F.broadcast(best), "b").select(
        "pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best")
    )
    rest = partly.select("row", each).select(
        "row", F.col("link.pairs").alias("pair"), F.col("link.pairs_n").alias("n")
    ).join(cold, "pair").groupBy("row").agg(
        F.sum(F.col("n") * F.col("best")).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_sum")
    )

    def whole(name: str, more: str):
        return (F.col(name) + F.coalesce(more, F.lit(0))).alias(name)

    return partly.drop("pairs", "pairs_n").join(rest, "row", "left").select(
        F.col("id").alias(id), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        whole("n_best", "more_best"), whole("count_sum", "more_sum"), "groups_sha256",
    )

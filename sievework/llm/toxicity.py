"""Toxicity by two language models with Kneser-Ney smoothing.

One model is of toxic texts, one of ordinary texts; both are interpolated bigram
models. What a model has seen of a pair is discounted, by how often the pair occurs
as in modified Kneser-Ney, and the rest goes to the word alone, by how many different
words it follows in that class. What is discounted there goes to a level that both
models share: how many different words it follows in all texts. So of a rare
expression both models say about the same, and it cancels.

The difference of the two log-likelihoods, per word of the text, and the share of
words that are strong evidence at both levels, are turned into a probability by a
logistic curve, fitted on texts that the models have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import ragged
from sievework.llm.sampling import filled, in_share
from sievework.storage import materialise

START = np.uint64(1)


@dataclass(frozen=True)
class ToxicSettings:
    # Rows with this remainder of the checksum of their id are held out; those
    # with the other one fit the curve, the rest the models.
    folds: int = 5
    held_out_fold: int = 0
    curve_fold: int = 4
    # Texts per label that are learned from, about. All their pairs of words are
    # kept, and go to each task (16 bytes a pair); the driver needs some 500 bytes a
    # pair to make the models.
    texts_per_label: int = 800
    # From where on, in natural logarithms, a word is strong evidence: the value
    # that suits the texts of the curve best, and the one without such texts.
    strong: tuple[float, ...] = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0)
    usual_strong: float = 3.5


LETTER_OR_BYTE = np.zeros(256, dtype=bool)
LETTER_OR_BYTE[128:] = True
for _first, _last in ("az", "AZ", "09"):
    LETTER_OR_BYTE[ord(_first) : ord(_last) + 1] = True


class Words:
    """Words without the signs around them: per word its hash, that of the word
    before, and that of both."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lower = ragged.LOWER[data]
        plain = np.where(LETTER_OR_BYTE[data], lower, np.uint8(ord(" ")))
        starts, ends, self.firsts = ragged.word_spans(plain, offsets)
        self.word = ragged.span_hashes(plain, starts, ends)
        self.before = np.empty_like(self.word)
        if len(self.word):
            self.before[1:] = self.word[:-1]
            firsts = self.firsts[:-1]
            self.before[firsts[firsts < len(self.word)]] = START
        self.pair = pair_hashes(self.before, self.word)


def pair_hashes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return ragged.mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def _labelled(df: DataFrame, labels: DataFrame, id: str, text: str, label: str, s: ToxicSettings) -> DataFrame:
    """`fold, toxic, text` of about `texts_per_label` texts per label."""
    fold = F.pmod(F.crc32(F.col(id).cast("string")), F.lit(s.folds))
    known = labels.where(F.col(label).isin(0, 1)).select(
        F.col(id).alias("id"), (F.col(label) == 1).alias("toxic")
    # Of several labels the larger one counts.
    ).groupBy("id").agg(F.max("toxic").alias("toxic")).where(
        F.pmod(F.crc32(F.col("id").cast("string")), F.lit(s.folds)) != s.held_out_fold
    )
    sizes = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}
    within = F.lit(False)
    for toxic, n in sizes.items():
        within = within | ((F.col("toxic") == toxic) & in_share(F.xxhash64("id"), s.texts_per_label / n))
    chosen = filled(materialise(known.where(within), "chosen"), sum(sizes.values()), "the labels")
    rows = df.select(F.col(id).alias("id"), fold.alias("fold"), F.col(text).alias("text"))
    # At most about two times `texts_per_label` ids.
    return rows.join(F.broadcast(chosen), "id").select("fold", "toxic", "text")


def pair_counts(texts: DataFrame) -> DataFrame:
    """`before, word, n0, n1`: how often a word follows another in ordinary and in
    toxic texts."""

    def run(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            for row, data, offsets in ragged.text_portions(batch.column("text"), 500_000):
                words = Words(data, offsets)
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(words.firsts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.before.view(np.int64)), pa.array(words.word.view(np.int64)), pa.array(toxic[row + owner])],
                    names=["before", "word", "toxic"],
                )

    rows = texts.mapInArrow(run, "before long, word long, toxic long")
    return rows.groupBy("before", "word").agg(
        F.sum(1 - F.col("toxic")).cast("int").alias("n0"), F.sum("toxic").cast("int").alias("n1")
    )


def discounts(n: np.ndarray) -> np.ndarray:
    """What modified Kneser-Ney takes from a count of 0, 1, 2, and 3 or more, from
    how many counts there are of each; kept inside bounds that leave something of
    each count, and take something."""
    once, twice, thrice, more = (max(int((n == i).sum()), 1) for i in (1, 2, 3, 4))
    y = once / (once + 2 * twice)
    taken = [1 - 2 * y * twice / once, 2 - 3 * y * thrice / twice, 3 - 4 * y * more / thrice]
    return np.array([0.0, *[min(max(d, 0.1), i - 0.01) for i, d in enumerate(taken, 1)]])


def _discounted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts without their discounts, and the discounts."""
    taken = discounts(n)[np.minimum(n, 3)]
    return np.maximum(n - taken, 0.0), taken


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted number is among sorted keys, and whether it is."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


class ToxicModel:
    """Both models over all pairs of the sample, and the curve."""

    def __init__(self, pairs, settings: ToxicSettings):
        """`pairs` holds the columns `before`, `word`, `n0` and `n1` of all pairs."""
        self.settings = settings
        before, word = (pairs[c].to_numpy(np.int64).view(np.uint64) for c in ("before", "word"))
        counts = [pairs[f"n{k}"].to_numpy(np.int32) for k in (0, 1)]
        del pairs
        words, of_word = np.unique(word, return_inverse=True)
        contexts, of_context = np.unique(before, return_inverse=True)
        self.words = ragged.Index(words)
        # Sorted keys take a third of the memory of an index.
        self.contexts = contexts

        # The level that both share: different words before, in all texts.
        left, taken = _discounted(np.bincount(of_word, minlength=len(words)))
        total = max(len(word), 1)
        even = (taken.sum() / total if len(word) else 1.0) / (len(words) + 1)
        shared = np.append(left / total + even, even)
        self.of_word, self.rest, seen = [], [], []
        for n in counts:
            # The word alone: different words before it in this class. The last
            # entry is of words that no text has.
            left, taken = _discounted(np.bincount(of_word[n > 0], minlength=len(words)))
            size = max(int((n > 0).sum()), 1)
            weight = taken.sum() / size if (n > 0).any() else 1.0
            self.of_word.append(np.append(left, 0.0) / size + weight * shared)
            # The pair, and what is left for the word after each context.
            left, taken = _discounted(n)
            size = np.bincount(of_context, n, minlength=len(contexts))
            mass = np.bincount(of_context, taken, minlength=len(contexts))
            self.rest.append(np.append(np.where(size > 0, mass / np.maximum(size, 1), 1.0), 1.0))
            seen.append(left / np.maximum(size, 1)[of_context])
        key = pair_hashes(before, word)
        order = np.argsort(key)
        self.pairs, self.of_pair = key[order], [p[order].astype(np.float32) for p in seen]
        self.strong = settings.usual_strong
        self.centre, self.spread, self.weights = np.zeros(3), np.ones(3), np.array([0.0, 1.0, 0.0, 0.0])

    def ratios(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Per word the logarithm of how much likelier it is after the word before in
        a toxic text, and the same for the word alone."""
        at = self.words.find(words.word)
        alone = [p[at] for p in self.of_word]
        context, known = _places(self.contexts, words.before)
        # The last entry is of contexts that no text has.
        context[~known] = -1
        place, known = _places(self.pairs, words.pair)
        both = []
        for seen, rest, word in zip(self.of_pair, self.rest, alone):
            own = np.zeros(len(at))
            own[known] = seen[place[known]]
            both.append(own + rest[context] * word)
        return np.log(both[1] / both[0]), np.log(alone[1] / alone[0])

    def features(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text the difference of the log-likelihoods per word and the logarithm
        of the number of words; and the share of strong words for each of
        `settings.strong`."""
        words = Words(data, offsets)
        n = np.diff(words.firsts)
        pair, alone = self.ratios(words)
        mean = ragged.sums_by(pair, words.firsts) / np.maximum(n, 1)
        # A word must be strong after the word before, and alone.
        least = np.minimum(pair, alone)
        shares = [ragged.sums_by(least > s, words.firsts) / np.maximum(n, 1) for s in self.settings.strong]
        return np.stack((mean, np.log1p(n)), axis=1), np.stack(shares, axis=1)

    def _chosen(self, features: np.ndarray, shares: np.ndarray, strong: float) -> np.ndarray:
        share = shares[:, self.settings.strong.index(strong)]
        return np.column_stack((features[:, 0], np.sqrt(share), features[:, 1]))

    def fit_curve(self, features: np.ndarray, shares: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic regression by Newton steps, for each value of `settings.strong`;
        the one that makes the labels likeliest counts."""
        if not 0 < toxic.sum() < len(toxic):
            return
        best = None
        for strong in self.settings.strong:
            x = self._chosen(features, shares, strong)
            centre, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
            x = np.column_stack((np.ones(len(x)), (x - centre) / spread))
            weights = np.array([0.0, 1.0, 0.0, 0.0])
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                slope = x.T @ (toxic - p) - 1e-3 * weights
                bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(4)
                weights = weights + np.linalg.solve(bend, slope)
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))), 1e-6, 1 - 1e-6)
            likely = np.log(np.where(toxic > 0, p, 1 - p)).sum()
            if best is None or likely > best:
                best, self.strong = likely, strong
                self.centre, self.spread, self.weights = centre, spread, weights

    def probability(self, features: np.ndarray, shares: np.ndarray) -> np.ndarray:
        x = (self._chosen(features, shares, self.strong) - self.centre) / self.spread
        return 1 / (1 + np.exp(-np.clip(np.column_stack((np.ones(len(x)), x)) @ self.weights, -30, 30)))


def fit(df: DataFrame, labels: DataFrame, id: str, text: str, label: str, s: ToxicSettings) -> ToxicModel:
    """The models and the curve. The driver sees the pairs of the bounded sample,
    and some figures per text of it."""
    sample = materialise(_labelled(df, labels, id, text, label, s), "labelled")
    counted = materialise(pair_counts(sample.where(F.col("fold") != s.curve_fold)), "pairs")
    model = ToxicModel(counted.toPandas(), s)

    def run(batches):
        for batch in batches:
            for row, data, offsets in ragged.text_portions(batch.column("text"), 500_000):
                found, shares = model.features(data, offsets)
                edges = np.arange(len(found) + 1) * shares.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic").slice(row, len(found)), *[pa.array(column) for column in found.T.copy()],
                     ragged.listed(shares.ravel(), edges)],
                    names=["toxic", "mean", "size", "shares"],
                )

    unseen = sample.where(F.col("fold") == s.curve_fold).mapInArrow(
        run, "toxic boolean, mean double, size double, shares array<double>"
    )
    points = unseen.toPandas()
    if len(points):
        shares = np.stack(points["shares"].to_list())
        model.fit_curve(points[["mean", "size"]].to_numpy(np.float64), shares, points["toxic"].to_numpy(np.float64))
    return model


def toxicity(
    df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
    settings: ToxicSettings = ToxicSettings(),
) -> DataFrame:
    """Per row its id, `held_out`, `score` and `predicted`. Runs jobs to fit the
    models on a bounded sample of labelled rows; then one pass without a shuffle.

    A null text is an empty one, which gets what the curve says of no words. A row
    with a null id is scored, but neither learned from nor held out. Repeated rows
    are rows like any other; of several labels of an id the larger one counts, and null
    labels are none. Without any label all scores are that of no evidence. A text is
    read whole, with some 60 bytes of memory per byte.
    Other columns are not read, whatever their names; no rows give no rows.
    """
    s = settings
    model = fit(df, labels, id, text, label, s)

    def run(batches):
        for batch in batches:
            for row, data, offsets in ragged.text_portions(batch.column("text"), 500_000):
                score = model.probability(*model.features(data, offsets))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(row, len(score)), pa.array(score)], names=["id", "score"]
                )

    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    fold = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(s.folds))
    return rows.mapInArrow(run, "id long, score double").select(
        F.col("id").alias(id),
        F.coalesce(fold == s.held_out_fold, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

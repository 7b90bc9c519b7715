"""Language identification with error-correcting output codes.

Each language has a codeword of bits. One binary classifier per bit, naive Bayes
over the byte trigrams of words, says on which side a text is. The language whose
codeword agrees best with all bits wins; disagreement costs more the surer the
classifier and the better it is in training. A text for which another codeword
is nearly as good is flagged as ambiguous.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import ragged
from sievework.llm.sampling import filled, in_share

SPACE = 0x20
# ASCII letters in lower case; bytes of other scripts as they are; the rest blank.
LETTERS = np.full(256, SPACE, dtype=np.uint8)
LETTERS[128:] = np.arange(128, 256)
LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTERS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
GRAM_BITS = 16
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageSettings:
    # Rows with this remainder of the checksum of their id are held out.
    folds: int = 3
    held_out_fold: int = 1
    # Texts per language that the classifiers are fitted on, about.
    texts_per_language: int = 4_000
    # Trigrams from which on more of them make a classifier no surer.
    evidence: int = 100
    # Random codes have this many bits per bit of the number of languages.
    bits_per_bit: int = 10
    # A text is ambiguous if its language is less sure than this.
    least_score: float = 0.5


def codewords(n: int, settings: LanguageSettings = LanguageSettings()) -> np.ndarray:
    """A row of -1 and 1 per language. Up to seven languages get every way to part
    them in two, so any two codewords differ in more than half of the bits; more
    get bits that follow from a hash."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int64)
    if n <= 7:
        masks = np.arange(1, 1 << (n - 1))
        return np.array([[1 if mask >> row & 1 else -1 for mask in masks] for row in range(n)])
    n_bits = math.ceil(settings.bits_per_bit * math.log2(n))
    cells = np.arange(1, n * n_bits * 2 + 1, dtype=np.uint64)
    bits = (ragged.mix(cells) >> np.uint64(40)).astype(np.int64) % 2 * 2 - 1
    code = bits.reshape(n, -1)
    parts = code[:, np.abs(code.sum(axis=0)) < n]  # both sides of a bit hold a language
    return parts[:, :n_bits]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the trigrams around each letter, and where those of each text
    begin. Texts stand between blanks."""
    n, rows = len(data), len(offsets) - 1
    spread = np.full(n + rows + 1, SPACE, dtype=np.uint8)
    spread[np.arange(n) + 1 + np.repeat(np.arange(rows), np.diff(offsets))] = LETTERS[data]
    at = np.flatnonzero(spread != SPACE)
    wide = spread.astype(np.uint32)
    code = wide[at - 1] << np.uint32(16) | wide[at] << np.uint32(8) | wide[np.minimum(at + 1, n + rows)]
    number = (code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)
    return number.astype(np.int64), np.searchsorted(at, offsets + np.arange(rows + 1))


class Model:
    """Languages, their codewords, and per bit the weight of each trigram."""

    def __init__(self, languages: list[str], counts: np.ndarray, settings: LanguageSettings):
        self.languages, self.settings = languages, settings
        self.code = codewords(len(languages), settings)
        # Every language counts alike, however many texts it has.
        shares = (counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * counts.shape[1])
        positive, negative = (self.code > 0).T.astype(float), (self.code < 0).T.astype(float)
        sides = [side @ shares / np.maximum(side.sum(axis=1, keepdims=True), 1) for side in (positive, negative)]
        with np.errstate(divide="ignore"):
            weights = np.log(sides[0]) - np.log(sides[1])
        self.weights = np.ascontiguousarray(np.nan_to_num(weights, posinf=0, neginf=0).T, dtype=np.float32)
        self.trust = np.ones(self.code.shape[1])

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """What each classifier says of each text: positive or negative, the
        further from 0 the surer."""
        number, firsts = grams(data, offsets)
        out = np.zeros((len(firsts) - 1, self.weights.shape[1]))
        sizes = np.diff(firsts)
        full = np.flatnonzero(sizes)
        if len(full):
            sums = np.add.reduceat(self.weights[number], firsts[:-1][full], axis=0, dtype=np.float64)
            out[full] = sums * (np.minimum(sizes[full], self.settings.evidence) / sizes[full])[:, None]
        return out

    def decode(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and score of the language with the least weighted loss."""
        margins = bits[:, None, :] * self.code[None, :, :]
        loss = (np.logaddexp(0, -margins) * self.trust).sum(axis=2) / self.trust.sum()
        odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
        best = loss.argmin(axis=1)
        return best, 1 / odds.sum(axis=1)


def _fold(id: str, settings: LanguageSettings):
    return F.pmod(F.crc32(F.col(id).cast("string")), F.lit(settings.folds))


def fit(df: DataFrame, id: str, text: str, lang: str, settings: LanguageSettings) -> Model | None:
    """The model of the rows that are not held out and have a language; None if
    there are none. The driver sees trigram counts per language, of fixed size."""
    s = settings
    rows = df.where(
        (_fold(id, s) != s.held_out_fold) & F.col(lang).isNotNull() & F.col(text).isNotNull()
    ).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = {row["lang"]: row["count"] for row in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    chosen = F.lit(False)
    for name, n in sizes.items():
        chosen = chosen | ((F.col("lang") == name) & in_share(F.xxhash64("id"), s.texts_per_language / n))
    sample = filled(rows.where(chosen), sum(sizes.values()), "the languages")

    def count(batches):
        totals = np.zeros((len(languages), 1 << GRAM_BITS), dtype=np.int64)
        place = {name: i for i, name in enumerate(languages)}
        for batch in batches:
            owner = np.array([place[name] for name in batch.column("lang").to_pylist()], dtype=np.int64)
            for row, data, offsets in ragged.text_portions(batch.column("text")):
                number, firsts = grams(data, offsets)
                of = np.repeat(owner[row : row + len(firsts) - 1], np.diff(firsts))
                totals += np.bincount(of << GRAM_BITS | number, minlength=totals.size).reshape(totals.shape)
        lang, gram = totals.nonzero()
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang), pa.array(gram), pa.array(totals[lang, gram])], names=["lang", "gram", "n"]
        )

    found = (
        sample.mapInArrow(count, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    )
    counts = np.zeros((len(languages), 1 << GRAM_BITS))
    counts[found["lang"], found["gram"]] = found["n"]
    model = Model(languages, counts, s)

    def judge(batches):
        place = {name: i for i, name in enumerate(languages)}
        n, right = 0, np.zeros(model.code.shape[1], dtype=np.int64)
        for batch in batches:
            owner = np.array([place[name] for name in batch.column("lang").to_pylist()], dtype=np.int64)
            for row, data, offsets in ragged.text_portions(batch.column("text")):
                said = model.bits(data, offsets)
                right += ((said > 0) == (model.code[owner[row : row + len(said)]] > 0)).sum(axis=0)
                n += len(said)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(right))), pa.array(right), pa.array(np.full(len(right), n))],
            names=["bit", "right", "n"],
        )

    said = sample.mapInArrow(judge, "bit long, right long, n long").groupBy("bit").agg(
        F.sum("right").alias("right"), F.sum("n").alias("n")
    ).collect()
    for row in said:
        wrong = (row["n"] - row["right"] + 1) / (row["n"] + 2)
        model.trust[row["bit"]] = max(math.log((1 - wrong) / wrong), 1e-3)
    return model


def identified(
    df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
    settings: LanguageSettings = LanguageSettings(),
) -> DataFrame:
    """`df` with the struct `_language`: `held_out`, `lang_pred`, `score` and
    `ambiguous`. Runs jobs to fit the model on about `texts_per_language` texts of
    each language; then one pass without a shuffle.

    A null text, one without a letter, and any text if nothing could be learned,
    is `und` with score 0. A row with a null id is not learned from and not held
    out. Repeated rows are rows like any other, and no rows give no rows. Texts are
    read whole. `df` keeps its columns, of which none may be named `_language`.
    """
    model = fit(df, id, text, lang, settings)
    names = model.languages if model else []
    least = settings.least_score

    def predict(batches):
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            kept = [i for i in range(batch.num_columns) if i not in (at, batch.schema.get_field_index("_letter"))]
            letter = batch.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.zeros(len(letter), np.int64), np.zeros(len(letter))
            if model:
                for row, data, offsets in ragged.text_portions(batch.column("_text"), 500_000):
                    end = row + len(offsets) - 1
                    best[row:end], score[row:end] = model.decode(model.bits(data, offsets))
            known = letter if model else np.zeros(len(letter), dtype=bool)
            predicted = [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist())]
            score = np.where(known, score, 0.0)
            made = [pa.array(predicted, pa.string()), pa.array(score), pa.array(known & (score < least))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + made,
                names=[batch.schema.names[i] for i in kept] + ["_lang_pred", "_score", "_ambiguous"],
            )

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    held_out = F.coalesce(_fold(id, settings) == settings.held_out_fold, F.lit(False))
    # The columns of `df` travel as one struct, whatever their names.
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(row.alias("_row"), held_out.alias("_held_out"), F.col(text).alias("_text"), letter.alias("_letter"))
    schema = rows.select("_row", "_held_out").schema
    schema = schema.add("_lang_pred", "string").add("_score", "double").add("_ambiguous", "boolean")
    out = rows.mapInArrow(predict, schema)
    language = F.struct(
        F.col("_held_out").alias("held_out"), F.col("_lang_pred").alias("lang_pred"),
        F.col("_score").alias("score"), F.col("_ambiguous").alias("ambiguous"),
    )
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns], language.alias("_language"))

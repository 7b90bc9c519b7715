"""Language-model scores with Brown classes: a class-based bigram model.

The most frequent words are put into classes by exchange clustering, which moves
one word at a time to the class where the bigrams of classes become most likely.
Every further word of sufficient count then goes to the class under which its own
bigrams with those words are most likely; an aggregate over (word, class of its
neighbour) tells, however many words there are. Only rarer words share a unit with
the words that end alike, and its class. A word has the probability

    P(class | class before) * P(unit | class) * P(word | unit),

where a word with a class of its own is its own unit. Counts of words, of their
neighbours and of pairs of classes are aggregates over the whole corpus. Frequent
words are looked up in the task that scores a text; the rest of its words meet
their counts and classes in a join, and only sums come back.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import ragged
from sievework.storage import materialise

# Stands for the end of a text among the hashes of words.
END = np.uint64(0)
# Bytes worked on at a time where a token takes some twenty numbers.
PORTION = 500_000


@dataclass(frozen=True)
class ModelSettings:
    # Rows with this remainder of the checksum of their id are held out.
    folds: int = 7
    held_out_fold: int = 2
    # Words of the exchange, and units that rare words share.
    unit_words: int = 1_000
    shared_units: int = 500
    classes: int = 48
    # Rounds of the exchange, at most; it ends when a round moves no unit.
    rounds: int = 12
    # Other words get a class of their own from this count on.
    least_count: int = 5
    # Words whose counts and classes go to each task (24 bytes each); others are joined.
    head_words: int = 400_000
    # Weight of the class distribution in a class transition, in tokens.
    prior: float = 20.0

    @property
    def n_units(self) -> int:
        return self.unit_words + self.shared_units + 1


class Tokens:
    """The tokens of some texts: hashes of words, each text closed by END."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lower = ragged.LOWER[data]
        starts, ends, firsts = ragged.word_spans(data, offsets)
        rows = len(offsets) - 1
        self.firsts = firsts + np.arange(rows + 1)
        self.is_end = np.zeros(len(starts) + rows, dtype=bool)
        self.is_end[self.firsts[1:] - 1] = True
        self.hashes = np.full(len(self.is_end), END, dtype=np.uint64)
        self.hashes[~self.is_end] = ragged.span_hashes(lower, starts, ends)
        # The last two bytes of a word; one byte if it has no more.
        ending = lower[ends - 1].astype(np.uint64)
        longer = ends - starts > 1
        ending[longer] |= lower[ends[longer] - 2].astype(np.uint64) << np.uint64(8)
        self.ending = np.zeros(len(self.is_end), dtype=np.uint64)
        self.ending[~self.is_end] = ending

    def units(self, place: np.ndarray, settings: ModelSettings) -> np.ndarray:
        """Unit of each token; `place` is the rank of its word by frequency or -1."""
        shared = settings.unit_words + (ragged.mix(self.ending) % np.uint64(settings.shared_units)).astype(np.int64)
        own = (place >= 0) & (place < settings.unit_words)
        return np.where(self.is_end, settings.n_units - 1, np.where(own, place, shared))


def _training(df: DataFrame, id: str, text: str, settings: ModelSettings) -> DataFrame:
    fold = F.pmod(F.crc32(F.col(id).cast("string")), F.lit(settings.folds))
    return df.where(fold != settings.held_out_fold).select(F.col(text).alias("text"))


def word_counts(texts: DataFrame, settings: ModelSettings) -> DataFrame:
    """`word, unit, n`: how often each word occurs, by its hash, and the unit it
    shares if it is rare; END is one of them."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in ragged.text_portions(batch.column("text")):
                tokens = Tokens(data, offsets)
                words, at, n = np.unique(tokens.hashes, return_index=True, return_counts=True)
                unit = tokens.units(np.full(len(tokens.hashes), -1), settings)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.view(np.int64)), pa.array(unit), pa.array(n)], names=["word", "unit", "n"]
                )

    counted = texts.mapInArrow(run, "word long, unit long, n long")
    return counted.groupBy("word").agg(F.min("unit").alias("unit"), F.sum("n").alias("n"))


def core_of(vocabulary: DataFrame, most: int) -> np.ndarray:
    """Hashes of the words of the exchange, the most frequent ones first."""
    rows = vocabulary.where(F.col("word") != int(END)).orderBy(F.desc("n"), "word").limit(most).select("word").collect()
    return np.array([row["word"] for row in rows], dtype=np.int64).view(np.uint64)


def head_of(vocabulary: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts and classes of the most frequent words, up to `most` of them;
    the class of a word that has none of its own is -1.

    Words are counted per step of the logarithm of their count, a table of at most
    a thousand rows; of those, all words of the highest steps are taken that fit.
    """
    words = vocabulary.where(F.col("word") != int(END)).withColumn("step", F.floor(16 * F.log2("n")).cast("int"))
    least, taken = None, 0
    for row in words.groupBy("step").count().orderBy(F.desc("step")).collect():
        taken += row["count"]
        if taken > most:
            break
        least = row["step"]
    found = words.where(F.col("step") >= least if least is not None else F.lit(False)).select(
        "word", "n", F.coalesce("class", F.lit(-1)).alias("class")
    ).toPandas()
    found = found.sort_values(["n", "word"], ascending=[False, True])
    return (
        found["word"].to_numpy(np.int64).view(np.uint64).copy(),
        found["n"].to_numpy(np.int64),
        found["class"].to_numpy(np.int64),
    )


def pair_counts(texts: DataFrame, core: np.ndarray, settings: ModelSettings) -> DataFrame:
    """`pair, n`: how often a unit follows another, `pair` being first * units +
    second. The number of pairs is bounded by the number of units."""
    n = settings.n_units

    def run(batches):
        index = ragged.Index(core)
        totals = np.zeros(n * n, dtype=np.int64)
        for batch in batches:
            for _, data, offsets in ragged.text_portions(batch.column("text")):
                tokens = Tokens(data, offsets)
                units = tokens.units(index.find(tokens.hashes), settings)
                before = np.empty_like(units)
                # A text begins after an end.
                before[0], before[1:] = n - 1, units[:-1]
                pair, times = np.unique(before * n + units, return_counts=True)
                totals[pair] += times
        pair = totals.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(totals[pair])], names=["pair", "n"])

    return texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def unit_classes(pairs: DataFrame, settings: ModelSettings) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit, and counts of class pairs among the words of the exchange
    and ends, so that no other word is in them.

    The exchange runs in one task: its input is the square matrix of unit pairs,
    whose size is fixed by the settings, however large the corpus is.
    """
    s, n = settings, settings.n_units

    def run(batches):
        totals = np.zeros(n * n)
        for batch in batches:
            totals[batch.column("pair").to_numpy()] += batch.column("n").to_numpy()
        totals = totals.reshape(n, n)
        of = exchange(totals, s.classes, s.rounds)
        one = np.eye(s.classes)[of]
        one[s.unit_words : -1] = 0
        grid = one.T @ totals @ one
        rows = [of.tolist()], [grid.ravel().tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(row) for row in rows], names=["of", "grid"])

    stored = materialise(pairs, "unit-pairs").coalesce(1)
    row = stored.mapInArrow(run, "of array<long>, grid array<double>").first()
    if row is None:
        # A table of no rows may have no task either.
        return np.zeros(n, np.int64), np.zeros((s.classes, s.classes))
    return np.array(row["of"]), np.array(row["grid"]).reshape(s.classes, s.classes)


def neighbour_counts(texts: DataFrame, core: np.ndarray, of: np.ndarray, settings: ModelSettings) -> DataFrame:
    """`word, slot, n`: how often a word that is not in the exchange stands after
    (slot = class) or before (slot = classes + class) a word of it or an end."""
    s = settings

    def run(batches):
        index = ragged.Index(core)
        for batch in batches:
            for _, data, offsets in ragged.text_portions(batch.column("text")):
                tokens = Tokens(data, offsets)
                place = index.find(tokens.hashes)
                inside = (place >= 0) | tokens.is_end
                classes = of[np.where(tokens.is_end, s.n_units - 1, place)]
                # A text begins after an end, and the last token is one.
                after = np.append(True, inside[:-1]) & ~inside
                ahead = np.append(inside[1:], False) & ~inside
                slots = (
                    np.append(of[-1], classes[:-1])[after],
                    s.classes + np.append(classes[1:], 0)[ahead],
                )
                words, at = np.unique(np.append(tokens.hashes[after], tokens.hashes[ahead]), return_inverse=True)
                key, n = np.unique(at * (2 * s.classes) + np.concatenate(slots), return_counts=True)
                word, slot = words[key // (2 * s.classes)], key % (2 * s.classes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word.view(np.int64)), pa.array(slot.astype(np.int32)), pa.array(n)],
                    names=["word", "slot", "n"],
                )

    return texts.mapInArrow(run, "word long, slot int, n long").groupBy("word", "slot").agg(F.sum("n").alias("n"))


def best_classes(counts: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Per row of neighbour counts the class under which they are most likely."""
    k = len(grid)
    joint = grid + 0.5
    # P(class | class before), P(class after | class) and, as all of a word's
    # occurrences are of its class, its share of the class.
    before = np.log(joint / joint.sum(axis=1, keepdims=True))
    after = np.log(joint / joint.sum(axis=1, keepdims=True)).T
    n = counts[:, :k].sum(axis=1, keepdims=True)
    return (counts[:, :k] @ before + counts[:, k:] @ after - n * np.log(joint.sum(axis=0))).argmax(axis=1)


def with_classes(
    vocabulary: DataFrame, texts: DataFrame, core: np.ndarray, of: np.ndarray, grid: np.ndarray, settings: ModelSettings
) -> DataFrame:
    """Add `class` to the vocabulary: that of the exchange, or else that of the
    word's bigrams; null for END, rare words and words that never stand beside a
    word of the exchange or an end."""
    s = settings

    def choose(batches):
        for batch in batches:
            lists = batch.column("slots")
            counts = np.zeros((batch.num_rows, 2 * s.classes))
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            counts[row, flat.field("slot").to_numpy()] = flat.field("n").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.array(best_classes(counts, grid))], names=["word", "class"]
            )

    # Counted over all words; those of sufficient count are known from the vocabulary.
    enough = vocabulary.where((F.col("n") >= s.least_count) & (F.col("word") != int(END))).select("word")
    counted = neighbour_counts(texts, core, of, s).join(enough, "word", "left_semi")
    slots = counted.groupBy("word").agg(F.collect_list(F.struct("slot", "n")).alias("slots"))
    further = slots.mapInArrow(choose, "word long, class long")
    own = [(int(word), int(c)) for word, c in zip(core.view(np.int64), of)]
    classes = vocabulary.sparkSession.createDataFrame(own, "word long, class long").unionByName(further)
    return vocabulary.join(classes, "word", "left")


class Lookup:
    """Counts and classes of the most frequent words, in a task."""

    def __init__(self, words: np.ndarray, classes: np.ndarray, of: np.ndarray, settings: ModelSettings):
        self.settings, self.of = settings, of
        self.index, self.classes = ragged.Index(words), np.append(classes, -1)

    def found(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per token its place among the words or -1, whether it is rare (to be
        joined), its class of its own or -1, its shared unit, and its class as far
        as is known here."""
        place = self.index.find(tokens.hashes)
        unit = tokens.units(np.full(len(place), -1), self.settings)
        own = self.classes[place]
        return place, (place < 0) & ~tokens.is_end, own, unit, np.where(own >= 0, own, self.of[unit])


# A step of which some word is joined: `kind` is 1 if that is the first word, 2 if
# it is the second, 3 if both are.
STEP = "first long, first_class long, second long, second_class long, kind int"


def _steps(tokens: Tokens, rare: np.ndarray, classes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Class before each token, kind of each step (0 if nothing is joined), and the
    columns of STEP of the other steps."""
    before = np.append(end, classes[:-1])
    kind = (np.append(False, rare[:-1]) + 2 * rare).astype(np.int32)
    at = np.flatnonzero(kind)
    hashes = tokens.hashes.view(np.int64)
    first = np.append(np.int64(0), hashes[:-1])
    return before, kind, [pa.array(x[at]) for x in (first, before, hashes, classes, kind)]


def _joined(steps: DataFrame, vocabulary: DataFrame, *carry: str) -> DataFrame:
    """Steps with the true classes of both words. Where `is_word`, the second word
    was joined, and `n` and `own`, its count and class of its own, are its.

    Only words beyond the head are joined, so no key is frequent."""
    words = vocabulary.select("word", "n", F.col("class").alias("own"))

    def one(kind_is, word: str, other: str, is_word: bool):
        return steps.where(kind_is).select(
            *carry, F.col(word).alias("word"), F.col(f"{word}_class").alias("shared"),
            F.col(f"{other}_class").alias("other"), F.lit(is_word).alias("is_word"),
        )

    firsts = words.select(F.col("word").alias("first"), F.col("own").alias("_own"))
    both = steps.where("kind = 3").join(firsts, "first", "left").select(
        *carry, F.col("second").alias("word"), F.col("second_class").alias("shared"),
        F.coalesce("_own", "first_class").alias("other"), F.lit(True).alias("is_word"),
    )
    parts = one(F.col("kind") == 1, "first", "second", False).unionByName(one(F.col("kind") == 2, "second", "first", True)).unionByName(both)
    known = F.coalesce("own", "shared")
    return parts.join(words, "word", "left").select(
        *carry, "is_word", "n", "own",
        F.when(F.col("is_word"), F.col("other")).otherwise(known).alias("first_class"),
        F.when(F.col("is_word"), known).otherwise(F.col("other")).alias("second_class"),
    )


def class_pairs(
    texts: DataFrame, vocabulary: DataFrame, words: np.ndarray, classes: np.ndarray, of: np.ndarray, settings: ModelSettings
) -> np.ndarray:
    """How often a class follows another, over all tokens."""
    k = settings.classes

    def run(batches):
        lookup = Lookup(words, classes, of, settings)
        totals = np.zeros(k * k, dtype=np.int64)
        for batch in batches:
            for _, data, offsets in ragged.text_portions(batch.column("text"), PORTION):
                tokens = Tokens(data, offsets)
                _, rare, _, _, found = lookup.found(tokens)
                before, kind, columns = _steps(tokens, rare, found, of[-1])
                sure = kind == 0
                totals += np.bincount(before[sure] * k + found[sure], minlength=k * k)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.ones(len(columns[0]), np.int64))],
                    names=["first", "first_class", "second", "second_class", "kind", "n_steps"],
                )
        at = totals.nonzero()[0]
        none = pa.array(np.zeros(len(at), np.int64))
        yield pa.RecordBatch.from_arrays(
            [none, pa.array(at // k), none, pa.array(at % k), none.cast(pa.int32()), pa.array(totals[at])],
            names=["first", "first_class", "second", "second_class", "kind", "n_steps"],
        )

    steps = materialise(
        texts.mapInArrow(run, f"{STEP}, n_steps long")
        .groupBy("first", "first_class", "second", "second_class", "kind").agg(F.sum("n_steps").alias("n_steps")),
        "steps",
    )
    sure = steps.where("kind = 0").select("n_steps", "first_class", "second_class")
    rest = _joined(steps.where("kind > 0"), vocabulary, "n_steps").select("n_steps", "first_class", "second_class")
    grid = np.zeros((k, k))
    for row in sure.unionByName(rest).groupBy("first_class", "second_class").agg(F.sum("n_steps").alias("n")).collect():
        grid[row["first_class"], row["second_class"]] = row["n"]
    return grid


def _xlogx(values: np.ndarray) -> np.ndarray:
    return values * np.log(np.maximum(values, 1e-300))


def exchange(pairs: np.ndarray, n_classes: int, rounds: int) -> np.ndarray:
    """Class of each unit. Starts from the units dealt out by frequency; each is
    then moved to the class with the highest likelihood of class bigrams, until
    none moves."""
    n = len(pairs)
    total = pairs.sum(axis=1)
    order = np.argsort(-total, kind="stable")
    of = np.empty(n, dtype=np.int64)
    of[order] = np.arange(n) % n_classes
    one = np.eye(n_classes)
    after = pairs @ one[of]  # unit x class that follows
    ahead = pairs.T @ one[of]  # unit x class before
    grid = one[of].T @ after
    size = one[of].T @ total
    classes = np.arange(n_classes)
    seen = [u for u in order.tolist() if total[u] + pairs[:, u].sum() > 0]
    for _ in range(rounds):
        moved = 0
        for u in seen:
            old, own = of[u], pairs[u, u]
            follows, leads = after[u].copy(), ahead[u].copy()
            follows[old] -= own
            leads[old] -= own
            # Take the unit out of its class, then see what each class would gain.
            grid[old] -= follows
            grid[:, old] -= leads
            grid[old, old] -= own
            size[old] -= total[u]
            row = _xlogx(grid + follows) - _xlogx(grid)
            column = _xlogx(grid + leads[:, None]) - _xlogx(grid)
            both = grid[classes, classes]
            gain = (
                row.sum(axis=1) - row[classes, classes]
                + column.sum(axis=0) - column[classes, classes]
                + _xlogx(both + follows + leads + own) - _xlogx(both)
                - 2 * (_xlogx(size + total[u]) - _xlogx(size))
            )
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            grid[new] += follows
            grid[:, new] += leads
            grid[new, new] += own
            size[new] += total[u]
            if new != old:
                of[u], moved = new, moved + 1
                after[:, old] -= pairs[:, u]
                after[:, new] += pairs[:, u]
                ahead[:, old] -= pairs[u]
                ahead[:, new] += pairs[u]
        if not moved:
            break
    return of


class ClassModel:
    """The fixed-size part of the model: transitions of classes, and what is in them."""

    def __init__(self, vocabulary: DataFrame, of: np.ndarray, grid: np.ndarray, settings: ModelSettings):
        s, self.of = settings, of
        share = (grid.sum(axis=0) + 1) / (grid.sum() + s.classes)
        step = (grid + s.prior * share) / (grid.sum(axis=1, keepdims=True) + s.prior)
        self.step = np.log10(step)
        # Tokens of words that share a unit, and of END.
        self.unit_size = np.zeros(s.n_units)
        for row in vocabulary.where(F.col("class").isNull()).groupBy("unit").agg(F.sum("n").alias("n")).collect():
            self.unit_size[row["unit"]] = row["n"]
        shared = np.arange(s.n_units) >= s.unit_words
        in_class = np.bincount(of, shared * (self.unit_size + 0.5), minlength=s.classes)
        for row in vocabulary.groupBy("class").agg(F.sum(F.col("n") + 0.5).alias("n")).collect():
            if row["class"] is not None:
                in_class[row["class"]] += row["n"]
        self.in_class = np.log10(np.maximum(in_class, 0.5))
        self.unit = np.log10(self.unit_size + 0.5) - self.in_class[of]


def scored(
    df: DataFrame, id: str = "doc_id", text: str = "text", settings: ModelSettings = ModelSettings()
) -> DataFrame:
    """Per row its id, `held_out`, `n_tokens`, `n_known`, `train_tokens`,
    `base_score` and `score`, the log10 probability of the text. Runs jobs.

    The model learns from rows that are not held out. A null text is an empty one,
    which is one token, the end. A row with a null id is scored, but is neither
    learned from nor held out. Repeated rows are rows like any other. A text is read
    whole, with some 160 bytes of memory per byte.
    Other columns are not read, whatever their names; no rows give no rows.
    """
    s = settings
    texts = _training(df, id, text, s)
    counted = materialise(word_counts(texts, s), "word-counts")
    core = core_of(counted, s.unit_words)
    of, core_grid = unit_classes(pair_counts(texts, core, s), s)
    vocabulary = materialise(with_classes(counted, texts, core, of, core_grid, s), "vocabulary")
    sizes = vocabulary.agg(
        F.sum("n"), F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    ).first()
    n_train, n_types, once, twice = (int(x or 0) for x in sizes)
    discount = once / (once + 2 * twice) if once else 0.5
    head_words, head_n, head_class = head_of(vocabulary, s.head_words)
    end_row = vocabulary.where(F.col("word") == int(END)).first()
    n_end = end_row["n"] if end_row else 0
    model = ClassModel(vocabulary, of, class_pairs(texts, vocabulary, head_words, head_class, of, s), s)
    log_all = math.log10(n_train + n_types + 1)

    def score(batches):
        lookup = Lookup(head_words, head_class, of, s)
        counts = np.append(head_n, 0)
        log_base = np.log10(counts + 1) - log_all
        log_count = np.log10(counts + 0.5)
        log_less = np.log10(np.maximum(counts - discount, 1e-9))
        in_unit = np.log10(np.maximum(model.unit_size, 1))
        for batch in batches:
            for row, data, offsets in ragged.text_portions(batch.column("text"), PORTION):
                tokens = Tokens(data, offsets)
                place, rare, own, units, classes = lookup.found(tokens)
                before, kind, steps = _steps(tokens, rare, classes, of[-1])
                base = np.where(rare, 0.0, log_base[place])
                base[tokens.is_end] = math.log10(n_end + 1) - log_all
                # A word that shares its unit: its own count over that of the unit.
                alone = np.where(tokens.is_end, 0.0, log_less[place] - in_unit[units])
                word = np.where(own >= 0, log_count[place] - model.in_class[classes], model.unit[units] + alone)
                value = np.where(rare, 0.0, word) + np.where(kind == 0, model.step[before, classes], 0.0)
                known = np.where(tokens.is_end, n_end > 0, place >= 0)
                first = tokens.firsts[:-1]
                at = np.flatnonzero(kind)
                step_first = np.searchsorted(at, tokens.firsts)
                # What a rare word without a class has besides its count.
                steps.append(pa.array((model.unit[units] - in_unit[units])[at]))
                names = ["first", "first_class", "second", "second_class", "kind", "in_unit"]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(row, len(first)),
                        pa.array(np.diff(tokens.firsts)),
                        pa.array(np.add.reduceat(known.astype(np.int64), first)),
                        pa.array(np.add.reduceat(base, first)),
                        pa.array(np.add.reduceat(value, first)),
                        pa.ListArray.from_arrays(
                            pa.array(step_first.astype(np.int32)), pa.StructArray.from_arrays(steps, names=names)
                        ),
                    ],
                    names=["id", "n_tokens", "known", "base", "value", "steps"],
                )

    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    heads = materialise(
        rows.mapInArrow(
            score,
            "id long, n_tokens long, known long, base double, value double, "
            f"steps array<struct<{STEP.replace(' ', ':').replace(',:', ',')},in_unit:double>>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "scores",
    )
    spark = df.sparkSession
    cells = [(i, j, float(model.step[i, j])) for i in range(s.classes) for j in range(s.classes)]
    table = spark.createDataFrame(cells, "first_class long, second_class long, step double")
    sizes_of = spark.createDataFrame([(c, float(x)) for c, x in enumerate(model.in_class)], "own long, in_class double")
    rest = _joined(
        heads.select("row", F.explode("steps").alias("step")).select("row", "step.*"), vocabulary, "row", "in_unit"
    ).join(F.broadcast(table), ["first_class", "second_class"]).join(F.broadcast(sizes_of), "own", "left")
    n = F.coalesce("n", F.lit(0))
    less = F.when(n > 0, F.log10(F.greatest(n - discount, F.lit(1e-9)))).otherwise(math.log10(discount))
    word = F.when(F.col("own").isNotNull(), F.log10(n + 0.5) - F.col("in_class")).otherwise(F.col("in_unit") + less)
    sums = rest.groupBy("row").agg(
        F.count_if(F.col("is_word") & (n > 0)).alias("rare_known"),
        F.sum(F.when(F.col("is_word"), F.log10(n + 1) - log_all).otherwise(0.0)).alias("rare_base"),
        F.sum(F.col("step") + F.when(F.col("is_word"), word).otherwise(0.0)).alias("rare_value"),
    )

    def with_rest(name: str, more: str):
        return F.col(name) + F.coalesce(more, F.lit(0))

    fold = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(s.folds))
    return heads.drop("steps").join(sums, "row", "left").select(
        F.col("id").alias(id),
        F.coalesce(fold == s.held_out_fold, F.lit(False)).alias("held_out"),
        "n_tokens",
        with_rest("known", "rare_known").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        with_rest("base", "rare_base").alias("base_score"),
        with_rest("value", "rare_value").alias("score"),
    )

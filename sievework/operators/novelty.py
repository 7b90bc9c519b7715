"""How new a text is: 1 less its largest similarity to any text of a corpus.

The similarity is that of Jaccard over word shingles, and the largest one is found
exactly, without comparing a candidate with the whole corpus:

- equal sets, of candidates and of the corpus, count once;
- the shingles of the candidates are ordered by how many sets hold them, the rare
  ones first. A set that shares none of a candidate's first shingles can be no more
  similar than what is left of the candidate, so most near copies are settled by a
  short prefix. What a prefix finds also says which sizes of sets cannot be better;
- *hot* shingles, which very many sets hold, are no keys of that join. Sets that
  share hot shingles only are described by which ones they hold: of all sets with
  the same hot shingles the smallest is the most similar, so one row stands for them.
  Pairs that share rare ones are looked at whole, if they may still be the best.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.config import ScoreSettings
from sievework.functions.shingles import shingle_hashes
from sievework.storage import materialise


def _similarity(common: Column, a: Column, b: Column) -> Column:
    return common / (a + b - common)


def _sets(df: DataFrame, text: str, k: int, name: str) -> DataFrame:
    """`<name>, size, grams` of the distinct shingle sets. Numbered before they are
    taken apart, and stored, so a number stays a set's."""
    grams = df.select(shingle_hashes(F.col(text), k).alias("grams")).distinct()
    # Texts without words go after the table is stored: Spark tests a condition below
    # the sets, with a second Python worker per task that computes them all again.
    return materialise(
        grams.select(F.monotonically_increasing_id().alias(name), F.size("grams").alias("size"), "grams"), f"{name}-sets"
    ).where("grams IS NOT NULL")


def _best_of_pairs(pairs: DataFrame, best: DataFrame, hot_of: DataFrame, hot_in: DataFrame) -> DataFrame:
    """`asked, most`: the best similarity among `pairs(asked, mine, row, theirs,
    common)`, where `common` counts rare shingles. The hot ones are looked at for
    pairs that can still be better than `best(asked, most)` and one another."""
    # Without its hot shingles a pair is at least that similar, with all of them at
    # most that much.
    open_ = (
        pairs.join(hot_of.select("asked", F.size("hot").alias("n_hot"), "hot"), "asked", "left")
        .withColumn("n_hot", F.coalesce("n_hot", F.lit(0)))
        .withColumn("low", _similarity(F.col("common"), F.col("mine"), F.col("theirs")))
    )
    lows = open_.groupBy("asked").agg(F.max("low").alias("low"))
    known = lows.join(best, "asked", "full").select("asked", F.greatest("low", "most").alias("most"))
    could = F.least(F.col("common") + F.col("n_hot"), F.col("mine"), F.col("theirs"))
    better = (
        open_.where("n_hot > 0").drop("low")
        .join(known, "asked")
        .where(_similarity(could, F.col("mine"), F.col("theirs")) > F.col("most"))
        .join(hot_in, "row")
    )
    whole = F.col("common") + F.size(F.array_intersect("hot", "hot_grams"))
    closer = better.groupBy("asked").agg(F.max(_similarity(whole, F.col("mine"), F.col("theirs"))).alias("closer"))
    return known.join(closer, "asked", "left").select("asked", F.greatest("most", "closer").alias("most"))


def novelty_score(
    candidates: DataFrame,
    corpus: DataFrame,
    text: str = "text",
    id: str = "source_id",
    shingle_size: int = 3,
    settings: ScoreSettings = ScoreSettings(),
) -> DataFrame:
    """Per candidate its id and `novelty`: 1 less the largest Jaccard similarity to
    any row of the corpus, and 0 from `settings.copy_from` on. Runs jobs.

    Shingles are compared by 64-bit hashes. A candidate without words, and any if
    the corpus has none, is wholly new. Of several candidates with one id the most
    similar one counts.
    """
    s = settings
    asked = _sets(candidates, text, shingle_size, "asked")
    rows = _sets(corpus, text, shingle_size, "row")
    wanted = materialise(asked.select("asked", "size", F.explode("grams").alias("gram")), "wanted")
    grams = wanted.groupBy("gram").agg(F.count(F.lit(1)).alias("n_asked"))
    # What of the corpus the candidates have too.
    met = materialise(
        rows.select("row", F.col("size").alias("theirs"), F.explode("grams").alias("gram")).join(
            grams.select("gram"), "gram"
        ),
        "met",
    )
    counts = met.groupBy("gram").agg(F.count(F.lit(1)).alias("n_rows"))
    n_met = met.count() + wanted.count()
    # At most 1 / hot_share shingles are hot, on either side.
    most_rows = max(s.least_hot, int(n_met * s.hot_share))
    known = materialise(
        grams.join(counts, "gram").withColumn("is_hot", (F.col("n_rows") > most_rows) | (F.col("n_asked") > most_rows)),
        "grams",
    )
    hot_grams = known.where("is_hot").select("gram")

    # Rare first; the place of a shingle says what a set without the earlier ones
    # can still share. Shingles that no row holds come before all others.
    place = F.struct(F.coalesce("is_hot", F.lit(False)).alias("hot"), F.coalesce("n_rows", F.lit(0)).alias("n"), "gram")
    ranked = materialise(
        wanted.join(known, "gram", "left")
        .groupBy("asked", F.col("size").alias("mine"))
        .agg(F.sort_array(F.collect_list(place)).alias("order"))
        .select("asked", "mine", F.posexplode("order").alias("at", "of"))
        .select("asked", "mine", "at", "of.hot", "of.n", "of.gram"),
        "ranked",
    )
    rare_met = met.join(hot_grams, "gram", "left_anti")

    def pairs(keys: DataFrame) -> DataFrame:
        """All sets that share one of the `keys(asked, mine, gram, most)` and may be
        better than `most`, with the number of keys they share."""
        return (
            rare_met.join(keys, "gram")
            .where(F.least("mine", "theirs") > F.col("most") * F.greatest("mine", "theirs"))
            .groupBy("asked", "mine", "row", "theirs")
            .agg(F.count(F.lit(1)).alias("common"))
        )

    # First only as many as settle whoever has a near copy: the best of a prefix is
    # a lower bound, as shingles after the prefix are not counted.
    first = F.ceil(F.col("mine") * (1 - s.copy_from)) + 1
    rare = ranked.where("NOT hot AND n > 0")
    prefix = pairs(rare.where(F.col("at") <= first).withColumn("most", F.lit(0.0)))
    # Whoever shares a key of the prefix is looked at whole, one pair of each
    # candidate: the one with most of the prefix in common.
    top = prefix.groupBy("asked").agg(F.max(F.struct("common", F.col("theirs") * -1, "row")).alias("top"))
    tried = materialise(top.select("asked", "top.row"), "tried")
    seen = (
        tried.join(asked.select("asked", F.col("grams").alias("a")), "asked")
        .join(rows.select("row", F.col("grams").alias("b")), "row")
        .select("asked", _similarity(F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b")).alias("most"))
    )
    bound = materialise(
        asked.select("asked").join(seen, "asked", "left").select("asked", F.coalesce("most", F.lit(0.0)).alias("most")),
        "bound",
    )
    # A copy is settled; the others look for something better with all rare ones.
    open_ = bound.where(F.col("most") < s.copy_from)
    hot_of = materialise(
        ranked.where("hot").join(open_, "asked", "left_semi").groupBy("asked", "mine").agg(F.collect_list("gram").alias("hot")),
        "hot-of",
    )
    hot_in = materialise(
        met.join(F.broadcast(hot_grams), "gram").groupBy("row", "theirs").agg(F.sort_array(F.collect_list("gram")).alias("hot_grams")),
        "hot-in",
    )
    by_rare = _best_of_pairs(pairs(rare.join(open_, "asked")), open_, hot_of, hot_in.select("row", "hot_grams"))

    # Sets by their hot shingles alone: the smallest of those that hold the same.
    profiles = materialise(
        hot_in.groupBy("hot_grams").agg(F.min("theirs").alias("theirs")).withColumn("profile", F.monotonically_increasing_id()),
        "profiles",
    )
    by_hot = (
        profiles.select("profile", "theirs", F.explode("hot_grams").alias("gram"))
        .join(hot_of.select("asked", "mine", F.explode("hot").alias("gram")), "gram")
        .groupBy("asked", "mine", "profile", "theirs")
        .agg(F.count(F.lit(1)).alias("common"))
        .groupBy("asked")
        .agg(F.max(_similarity(F.col("common"), F.col("mine"), F.col("theirs"))).alias("by_hot"))
    )
    most = materialise(
        bound.join(by_rare.withColumnRenamed("most", "by_rare"), "asked", "left")
        .join(by_hot, "asked", "left")
        .select("asked", F.greatest("most", "by_rare", "by_hot").alias("most")),
        "most",
    )
    # Back to the candidates by the set itself.
    of_set = asked.select("asked", "grams").join(most, "asked").select("grams", "most")
    own = candidates.select(F.col(id), shingle_hashes(F.col(text), shingle_size).alias("grams"))
    scored = own.join(of_set, "grams", "left").groupBy(id).agg(F.coalesce(F.max("most"), F.lit(0.0)).alias("_most"))
    novelty = F.when(F.col("_most") >= s.copy_from, 0.0).otherwise(1 - F.col("_most"))
    return scored.select(id, F.round(novelty, 6).alias("novelty"))

"""Similarity join of texts by the Jaccard similarity of their word n-grams.

A size-aware join of heavy and light sets, exact for every pair of texts:

- two *light* (small) sets that are similar share a subset of a size that follows
  from their two sizes, so each light set is filed under all its subsets of
  those sizes;
- a *heavy* (large) set is found by the inverted lists of its n-grams. Only the
  lists of its first n-grams in a global order are scanned: of two similar sets,
  each has a common one among these. Rare n-grams come first in the order, so
  a passage that many texts share is a list that hardly any text scans;
- the largest light size is the one for which filing the subsets costs least,
  compared with scanning lists, as measured on a sample.

Equal sets are one set from the start. The members of a list are compared with
one of them first, in rounds until none finds a link, and components are built; only
members of a list that are then still in different components are compared with each
other, and of those only pairs that a sketch of fixed size leaves room for. A group
of thousands of near copies is a star of links, not all its pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import ragged
from sievework.operators.components import components
from sievework.llm.sampling import filled, in_share
from sievework.storage import materialise, scratch


@dataclass(frozen=True)
class JoinSettings:
    """Two texts link if percent_of * intersection >= percent * union."""

    words: int = 5
    percent: int = 80
    percent_of: int = 100
    # Texts whose n-grams are counted to order them. The order decides which
    # lists are scanned, never which pairs are found.
    sample_texts: int = 5_000
    # An n-gram in that many texts of the sample is frequent; so many of the most
    # frequent ones are put at the end of the order.
    frequent_from: int = 3
    frequent_most: int = 200_000
    # The boundary between light and heavy sets is chosen up to here.
    light_most: int = 12
    # Cost of checking one pair, in rows of a list.
    check_cost: float = 4.0
    # How often each set is compared with one head of its lists, at most, before
    # all that are still in different components are compared. Rounds end when
    # one finds no link.
    star_rounds: int = 3


def least_overlap(n: int, m: int, s: JoinSettings) -> int:
    """Fewest common n-grams of two similar sets of n and m."""
    return -(-s.percent * (n + m) // (s.percent + s.percent_of))


def sizes_of_partners(n: int, s: JoinSettings) -> range:
    """Sizes a set similar to one of n can have."""
    return range(-(-s.percent * n // s.percent_of), s.percent_of * n // s.percent + 1)


def subset_sizes(n: int, light: int, s: JoinSettings) -> list[int]:
    """Sizes of the subsets a light set of n is filed under."""
    return sorted({least_overlap(n, m, s) for m in sizes_of_partners(n, s) if 0 < m <= light})


def n_scanned(n: int, s: JoinSettings) -> int:
    """Lists a set of n scans: any similar set has one of these n-grams."""
    return n - -(-s.percent * n // s.percent_of) + 1


def subset_keys(grams: np.ndarray, sizes: list[int]) -> np.ndarray:
    """One number per subset of `grams` of one of the sizes."""
    spread = ragged.mix(grams + np.uint64(1))
    keys = [
        ragged.mix(spread[np.array(list(combinations(range(len(grams)), size)))].sum(axis=1) + np.uint64(size))
        for size in sizes
    ]
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def gram_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """Sorted distinct n-grams of each text as numbers, all in one array, and
    where each text begins in it. A text of fewer words has its words as one."""
    hashes, firsts = ragged.word_hashes(data, offsets)
    places = ragged.odd_numbers("place in an n-gram", k)
    n_grams = max(len(hashes) - k + 1, 0)
    rolled = np.zeros(n_grams, dtype=np.uint64)
    for j, place in enumerate(places):
        rolled += hashes[j : j + n_grams] * place
    rolled = ragged.mix(rolled)
    sets = []
    for first, end in zip(firsts[:-1], firsts[1:]):
        if end - first >= k:
            grams = np.sort(rolled[first : end - k + 1])
            distinct = np.ones(len(grams), dtype=bool)
            np.not_equal(grams[1:], grams[:-1], out=distinct[1:])
            sets.append(grams[distinct])
        elif end > first:
            short = (hashes[first:end] * places[: end - first]).sum() + np.uint64(end - first)
            sets.append(ragged.mix(np.array([short], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    begins = np.concatenate(([0], np.cumsum([len(grams) for grams in sets], dtype=np.int64)))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), begins


def digests(grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One number per set, equal for equal sets."""
    spread = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ragged.mix(grams ^ ragged.MIX_B), dtype=np.uint64)))
    return ragged.mix(spread[begins[1:]] - spread[begins[:-1]] + np.diff(begins).astype(np.uint64))


def sketches(grams: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Per set how many of its n-grams fall into each of some parts. Two sets have
    no more in common than the smaller number of each part, summed up.

    The parts are a power of two, about half the size of the set, so those of
    two similar sets are as many or twice as many. Null where a number is too large
    for a byte; such a set is checked without a sketch.
    """
    sizes = np.diff(begins)
    parts = 1 << np.maximum(np.log2(np.maximum(sizes, 1)).astype(np.int64) - 1, 3)
    edges = np.concatenate(([0], np.cumsum(parts)))
    part = (ragged.mix(grams) >> np.uint64(32)).astype(np.int64) & np.repeat(parts - 1, sizes)
    counts = np.bincount(np.repeat(edges[:-1], sizes) + part, minlength=edges[-1])
    fits = np.ones(len(sizes), dtype=bool)
    if len(sizes):
        fits = np.maximum.reduceat(counts, edges[:-1]) <= 127
    return pa.ListArray.from_arrays(
        pa.array(edges.astype(np.int32)),
        pa.array(np.minimum(counts, 127).astype(np.int8)),
        mask=pa.array(~fits),
    )


# Bits of a parity sketch, in numbers of 64.
PARITY_WORDS = 8


def parities(grams: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Per set whether an odd number of its n-grams falls on each of 512 bits.

    An n-gram that two sets share changes both alike, so they have at least as many
    n-grams apart as they differ in bits. Of fixed size, this sketch can go with
    every row of a list.
    """
    spread = ragged.mix(grams ^ ragged.MIX_A)
    bits, n, step = PARITY_WORDS * 64, len(begins) - 1, 1024
    place = (spread >> np.uint64(32)).astype(np.int64) % bits
    packed = []
    # Some sets at a time, as each has a number per bit here.
    for first in range(0, n, step):
        last = min(first + step, n)
        owner = np.repeat(np.arange(last - first), np.diff(begins[first : last + 1]))
        counts = np.bincount(owner * bits + place[begins[first] : begins[last]], minlength=(last - first) * bits)
        packed.append(np.packbits((counts & 1).astype(np.uint8), bitorder="little"))
    words = np.concatenate(packed).view("<i8") if packed else np.zeros(0, np.int64)
    return ragged.listed(words, np.arange(n + 1) * PARITY_WORDS)


class Filing:
    """The lists a set is in: those of its subsets, if it is light, and those of
    its first n-grams."""

    def __init__(self, frequent: np.ndarray, light: int, settings: JoinSettings):
        # `frequent` is in ascending order of frequency.
        self.frequent = ragged.Index(frequent)
        self.light, self.settings = light, settings

    def keys(self, grams: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, int]:
        """Keys of all lists, and how many of them are of subsets. `place` is the
        position of each n-gram among the frequent ones, or -1."""
        s, n = self.settings, len(grams)
        if not n:
            return grams, 0
        subsets, scanned = [], n_scanned(n, s)
        if n <= self.light:
            subsets = [subset_keys(grams, subset_sizes(n, self.light, s))]
            if sizes_of_partners(n, s)[-1] <= self.light:
                scanned = 0
        rare = grams[place < 0][:scanned]
        if len(rare) < scanned:
            common = place >= 0
            rare = np.concatenate((rare, grams[common][np.argsort(place[common])]))[:scanned]
        keys = np.concatenate((*subsets, rare))
        return keys, len(keys) - scanned


def _lists(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(begins.astype(np.int32)), pa.array(values.view(np.int64))
    )


def with_sets(df: DataFrame, settings: JoinSettings) -> DataFrame:
    """`id, n, digest, grams` of each row of `df(id, text)`."""
    k = settings.words

    def run(batches):
        for batch in batches:
            for row, data, offsets in ragged.text_portions(batch.column("text")):
                grams, begins = gram_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(row, len(begins) - 1),
                        pa.array(np.diff(begins)),
                        pa.array(digests(grams, begins).view(np.int64)),
                        _lists(grams, begins),
                    ],
                    names=["id", "n", "digest", "grams"],
                )

    return df.mapInArrow(run, "id long, n long, digest long, grams array<long>")


def with_keys(df: DataFrame, frequent: np.ndarray, light: int, settings: JoinSettings) -> DataFrame:
    """`id, n, digest, n_subsets, keys, sketch, bits` of each row of `df(id, text)`."""
    k = settings.words

    def run(batches):
        filing = Filing(frequent, light, settings)
        for batch in batches:
            for row, data, offsets in ragged.text_portions(batch.column("text")):
                grams, begins = gram_sets(data, offsets, k)
                place = filing.frequent.find(grams)
                filed = [
                    filing.keys(grams[a:b], place[a:b]) for a, b in zip(begins[:-1], begins[1:])
                ]
                sizes = np.cumsum([0, *(len(keys) for keys, _ in filed)])
                keys = np.concatenate([keys for keys, _ in filed])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(row, len(begins) - 1),
                        pa.array(np.diff(begins)),
                        pa.array(digests(grams, begins).view(np.int64)),
                        pa.array(np.array([n for _, n in filed], dtype=np.int32)),
                        _lists(keys, sizes),
                        sketches(grams, begins),
                        parities(grams, begins),
                    ],
                    names=["id", "n", "digest", "n_subsets", "keys", "sketch", "bits"],
                )

    return df.mapInArrow(
        run,
        "id long, n long, digest long, n_subsets int, keys array<long>, sketch array<tinyint>, bits array<long>",
    )


def sample_of(df: DataFrame, settings: JoinSettings) -> tuple[DataFrame, float]:
    """About `sample_texts` rows, by the hash of their id, and their share."""
    n_rows = df.agg(F.count("id")).first()[0]
    share = min(1.0, settings.sample_texts / max(n_rows, 1))
    return filled(df.where(in_share(F.xxhash64("id"), share)), n_rows, "the order of n-grams"), share


def frequent_grams(sample: DataFrame, settings: JoinSettings) -> np.ndarray:
    """The frequent n-grams of the sample, the less frequent first; bounded by
    `frequent_most`, and only used to order n-grams."""
    counts = (
        with_sets(sample, settings)
        .select(F.explode("grams").alias("gram"))
        .groupBy("gram")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= settings.frequent_from)
        .orderBy(F.desc("n"), "gram")
        .limit(settings.frequent_most)
        .toPandas()
    )
    return counts["gram"].to_numpy(np.int64)[::-1].view(np.uint64).copy()


def light_boundary(sample: DataFrame, share: float, frequent: np.ndarray, settings: JoinSettings) -> int:
    """The largest size up to which filing subsets costs less than scanning lists.

    Costs are rows: subsets filed against lists scanned and the pairs met there,
    which grow with the share that the sample is of all texts.
    """
    filed = with_keys(sample, frequent, 0, settings).where(
        F.col("n").between(1, sizes_of_partners(settings.light_most, settings)[-1])
    )
    lists = (
        filed.select("n", "digest", F.explode("keys").alias("key"))
        .distinct()
        .groupBy("key", "n")
        .agg(F.count(F.lit(1)).alias("members"))
    )
    met = lists.alias("a").join(lists.alias("b"), "key").where(
        F.expr(f"b.n between {settings.percent} * a.n / {settings.percent_of}"
               f" and {settings.percent_of} * a.n / {settings.percent}")
    )
    pairs = met.groupBy("a.n").agg(
        F.sum(F.col("a.members") * F.col("b.members") - F.when(F.expr("a.n = b.n"), F.col("a.members")).otherwise(0)).alias("pairs")
    )
    texts = filed.groupBy("n").agg(F.countDistinct("digest").alias("texts"))
    rows = texts.join(pairs, "n", "left").where(F.col("n") <= settings.light_most).collect()
    gain, best, light = 0.0, 0.0, 0
    for row in sorted(rows, key=lambda row: row["n"]):
        n = row["n"]
        n_subsets = sum(
            len(list(combinations(range(n), size)))
            for size in subset_sizes(n, settings.light_most, settings)
        )
        scan = row["texts"] * n_scanned(n, settings) + settings.check_cost * (row["pairs"] or 0) / share
        gain += scan - row["texts"] * n_subsets
        if gain >= best:
            best, light = gain, n
    return light


def _can_link(a: str, b: str, s: JoinSettings) -> str:
    low, high = f"least({a}, {b})", f"greatest({a}, {b})"
    return f"{s.percent_of} * {low} >= {s.percent} * {high}"


def _links(pairs: DataFrame, sets: DataFrame, settings: JoinSettings) -> DataFrame:
    """The pairs `(u, v)` of digests whose sets are similar.

    The sets of the members travel to the first of their pair, which may be the
    head of a very large group; such a group can be split, as only that one set
    is needed with each part of it.
    """
    s = settings
    members = pairs.join(sets.select(F.col("digest").alias("v"), F.col("grams").alias("grams_v")), "v")
    both = members.join(sets.select(F.col("digest").alias("u"), F.col("grams").alias("grams_u")), "u")
    common = F.size(F.array_intersect("grams_u", "grams_v"))
    total = F.size("grams_u") + F.size("grams_v")
    return both.where(s.percent_of * common >= s.percent * (total - common)).select("u", "v")


def _possible(rows: DataFrame, pairs: DataFrame, settings: JoinSettings) -> DataFrame:
    """The `pairs(u, v)` whose sketches leave room for a link, with the id of one
    text for each set. Sketches are a fraction of the size of the sets."""
    s = settings
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("digest")).distinct()
    known = materialise(
        rows.join(wanted, "digest")
        .groupBy("digest")
        .agg(F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")),
        "sketches",
    )

    def side(name: str) -> DataFrame:
        return known.select(*[F.col(c).alias(c if c == "digest" else f"{c}_{name}") for c in known.columns]) \
            .withColumnRenamed("digest", name)

    both = pairs.join(side("u"), "u").join(side("v"), "v")
    def folded(name: str, other: str) -> str:
        """A sketch with as many parts as the other, if that has half as many."""
        mine, n = f"sketch_{name}", f"size(sketch_{other})"
        half = f"transform(slice({mine}, 1, {n}), (x, i) -> int(x) + {mine}[i + {n}])"
        return f"case when size({mine}) > {n} then {half} else transform({mine}, x -> int(x)) end"

    room = F.expr(
        f"""case when sketch_u is null or sketch_v is null then least(n_u, n_v)
        else aggregate(zip_with({folded("u", "v")}, {folded("v", "u")}, (a, b) -> least(a, b)), 0L, (s, x) -> s + x)
        end"""
    )
    total = F.col("n_u") + F.col("n_v")
    fits = F.expr(_can_link("n_u", "n_v", s)) & (s.percent_of * room >= s.percent * (total - room))
    return both.where(fits).select("u", "v", "id_u", "id_v")


def _sets_of(df: DataFrame, pairs: DataFrame, settings: JoinSettings) -> DataFrame:
    """`digest, grams` of the sets that occur in `pairs`, from one text each."""
    ids = materialise(pairs.select(F.explode(F.array("id_u", "id_v")).alias("id")).distinct(), "ids")
    texts = df.join(ids, "id", "left_semi")
    return with_sets(texts, settings).select("digest", "grams")


def _may_overlap(a: str, b: str, s: JoinSettings) -> str:
    """Whether sets that meet in a list can be similar, if what they meet in is
    their first common n-gram: from there on, both must hold enough n-grams. Any
    similar pair meets in the list of that n-gram."""
    need = f"{s.percent} * ({a}.n + {b}.n)"
    return f"{s.percent + s.percent_of} * least({a}.rest, {b}.rest) >= {need}"


def _star_pairs(members: DataFrame, seen: DataFrame | None, settings: JoinSettings) -> DataFrame:
    """For each set one new pair with a head in another component, of those the one
    it meets in most lists.

    The head of a list is the set with most n-grams from there on: the one of a
    group of near copies with the fewest changes of its own.
    """
    heads = materialise(
        members.groupBy("key")
        .agg(F.max(F.struct("rest", "n", "digest", "root")).alias("head"))
        .select("key", "head.*"),
        "heads",
    )
    met = members.alias("m").join(heads.alias("h"), "key").where(
        F.expr("m.root <> h.root") & F.expr(_may_overlap("m", "h", settings)) & F.expr(_can_link("m.n", "h.n", settings))
    )
    lists = met.groupBy(F.col("m.digest").alias("digest"), F.col("h.digest").alias("head")).agg(
        F.count(F.lit(1)).alias("lists")
    )
    pair = (F.least("head", "digest").alias("u"), F.greatest("head", "digest").alias("v"))
    new = lists.select("*", *pair)
    if seen is not None:
        new = new.join(seen, ["u", "v"], "left_anti")
    best = new.groupBy("digest").agg(F.max(F.struct("lists", "head")).alias("best"))
    return best.select("digest", "best.head").select(*pair).distinct()


def _open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists whose members are in different components, with each set once."""
    placed = (
        members.drop("root")
        .join(roots.withColumnRenamed("node", "digest"), "digest", "left")
        .withColumn("root", F.coalesce("root", "digest"))
        .groupBy("key", "digest")
        .agg(F.any_value("n").alias("n"), F.max("rest").alias("rest"), F.any_value("root").alias("root"))
    )
    spans = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return placed.join(spans.select("key"), "key", "left_semi")


def _may_link(a: str, b: str, s: JoinSettings) -> str:
    """Whether sets whose parities differ in that many bits can be similar."""
    apart = " + ".join(f"bit_count({a}.bits[{i}] ^ {b}.bits[{i}])" for i in range(PARITY_WORDS))
    total = f"({a}.n + {b}.n)"
    return f"{s.percent_of} * ({total} - ({apart})) >= {s.percent} * ({total} + ({apart}))"


# Earlier n-grams of its set that go with a row of a list.
BEFORE = 2


def _meetings(members: DataFrame, rows: DataFrame, settings: JoinSettings) -> DataFrame:
    """`(u, v)` of members of a list that are still in different components and that
    their parities leave room for, so that few pairs leave the join.

    Two sets that share a passage meet in list after list. Of these meetings only
    the first is of use: with an earlier common n-gram, both hold more n-grams from
    there on, so whatever admits the pair here admits it there. So it is left out
    where one of the last n-grams before this list is common to both.
    """
    wanted = members.select("digest").distinct()
    filed = F.any_value(F.struct("bits", "n_subsets", "keys")).alias("filed")
    sets = rows.select("digest", "bits", "n_subsets", "keys").join(wanted, "digest", "left_semi").groupBy("digest").agg(filed)
    # The n-grams of a set are filed after its subsets, which have none before them.
    at = F.col("n") - F.col("rest")
    before = F.slice("filed.keys", F.col("filed.n_subsets") + 1 + F.greatest(at - BEFORE, F.lit(0)), F.least(at, F.lit(BEFORE)))
    listed = members.join(sets, "digest").select(
        "key", "digest", "n", "rest", "root", F.col("filed.bits").alias("bits"), before.alias("before")
    )
    pairs = listed.alias("a").join(listed.alias("b"), "key").where(
        F.expr("a.digest < b.digest AND a.root <> b.root")
        & F.expr(_can_link("a.n", "b.n", settings))
        & F.expr(_may_overlap("a", "b", settings))
        & F.expr(_may_link("a", "b", settings))
        & ~F.arrays_overlap("a.before", "b.before")
    )
    return pairs.select(F.col("a.digest").alias("u"), F.col("b.digest").alias("v"))


def _cross_pairs(members: DataFrame, rows: DataFrame, seen: DataFrame, settings: JoinSettings) -> DataFrame:
    """The new pairs of `_meetings`."""
    return _meetings(members, rows, settings).distinct().join(seen, ["u", "v"], "left_anti")


def jaccard_components(
    df: DataFrame, id: str = "doc_id", text: str = "text", settings: JoinSettings = JoinSettings()
) -> DataFrame:
    """Per row of `df` its `id`, `n_shingles` and `component_id`, the smallest id
    reachable by links. Other columns are not read. Runs jobs.

    A null or empty text has no n-gram and links with nothing. A row without an
    id links with nothing and has no component. Repeated rows are each returned;
    no rows give no rows. Texts are read whole, with some 60 bytes of memory per
    byte of text.
    """
    base = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    known = base.where("id IS NOT NULL")
    sample, share = sample_of(known, settings)
    frequent = frequent_grams(sample, settings)
    light = light_boundary(sample, share, frequent, settings)
    rows = materialise(with_keys(base, frequent, light, settings), "sets")

    filed = rows.where("id IS NOT NULL").select(
        "digest", "n", "n_subsets", F.posexplode("keys").alias("pos", "key")
    )
    # How many n-grams of the set there are from this one on, in the global order;
    # a subset stands for the whole set.
    rest = F.col("n") - F.greatest(F.col("pos") - F.col("n_subsets"), F.lit(0))
    postings = filed.select("key", "digest", "n", rest.cast("int").alias("rest"))
    ends = postings.groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    contested = materialise(ends.where("low <> high").select("key"), "contested")
    members = materialise(postings.join(contested, "key").withColumn("root", F.col("digest")), "members")
    have = rows.where("id IS NOT NULL")

    def links_of(candidates: DataFrame) -> DataFrame:
        possible = materialise(_possible(have, candidates, settings), "possible")
        sets = materialise(_sets_of(known, possible, settings), "grams")
        return materialise(_links(possible.select("u", "v"), sets, settings), "links")

    spark = df.sparkSession
    links = seen = None
    for _ in range(settings.star_rounds):
        # What a round needs on its way is deleted at its end.
        with scratch(spark, keep=("pairs", "links", "members")):
            starred = materialise(_star_pairs(members, seen, settings), "pairs")
            seen = starred if seen is None else seen.unionByName(starred)
            found = links_of(starred)
            links = found if links is None else links.unionByName(found)
            done = found.isEmpty()
            if not done:
                members = materialise(_open_members(members, components(links)), "members")
        if done:
            break
    with scratch(spark, keep=("links",)):
        crossing = materialise(_cross_pairs(members, have, seen, settings), "pairs")
        links = links.unionByName(links_of(crossing))
    roots = components(links)

    by_digest = have.groupBy("digest").agg(F.min("id").alias("least")).join(
        roots.withColumnRenamed("node", "digest"), "digest", "left"
    ).withColumn("root", F.coalesce("root", "digest"))
    lowest = by_digest.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = by_digest.join(lowest, "root").select("digest", "component_id")
    # Texts without words all have the same empty set, and are no copies.
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")))
    worded = rows.where("n > 0").select("id", "n", "digest").join(classes, "digest", "left")
    wordless = rows.where("n = 0").select("digest", "id", "n", F.lit(None).cast("long").alias("component_id"))
    return worded.unionByName(wordless).select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id")
    )


def keep_one_per_component(
    df: DataFrame, id: str = "doc_id", text: str = "text", settings: JoinSettings = JoinSettings()
) -> DataFrame:
    """Of each component the row with its smallest id, with all columns of `df`;
    rows without an id stay. Of several rows with that id each text stays once.
    Runs jobs."""
    found = jaccard_components(df, id, text, settings)
    keep = found.where(F.col(id) == F.col("component_id")).select(F.col(id).alias("_id")).distinct()
    # The row travels as one struct, so that no name of its columns matters; by
    # id for both steps, so the text is shuffled once.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    rows = rows.withColumn("_id", F.col(f"_row.`{id}`").cast("long"))
    kept = (
        rows.withColumn("_text", F.xxhash64(F.col(f"_row.`{text}`")))
        .join(keep, "_id", "left_semi")
        .dropDuplicates(["_id", "_text"])
    )
    return kept.select("_row").unionByName(rows.where("_id IS NULL").select("_row")).select("_row.*")

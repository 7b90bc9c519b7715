"""Near-duplicate removal with MinHash and LSH buckets.

Rows are taken from best to worst. A row is dropped if it shares an LSH bucket
with a row that was kept before it, or if it has no words. This file computes
that greedy rule in parallel rounds, without ever listing the pairs of a bucket:

- the head of a bucket is its best undecided row;
- a row that heads every bucket it is in has nothing better left to collide
  with: it is kept;
- the other rows in the buckets of a kept row are dropped.

A bucket that holds a third of all rows is one group of a pre-aggregated minimum
and one row on the small side of a join. Rows alone in all their buckets are
settled before the first round.

With `verify`, a collision is only a reason to look: the first rows of each bucket,
its front, are compared with the members behind them, exactly, by shingle sets. A row
in the front of all its buckets is kept or dropped as soon as all better rows that
reach the threshold with it are, and leaves its buckets then. That is again the greedy
rule, with "shares a bucket with a kept row and is as similar as the threshold" as the
reason to drop a row. A front is one row where many are left, so a large group of
copies is compared with its head only. The fewer are left, the more rows it is, so
rows that are unlike but share a bucket do not take a round each.

`near_dup_clusters` is the other policy: rows are in one cluster if collisions link
them, directly or by way of others, and each cluster keeps its best row. Members of
a bucket need an edge to its head only, so there are as many edges as memberships.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.config import NearDupSettings
from sievework.functions.shingles import lsh_keys, lsh_keys_and_shingles, optimal_bands
from sievework.operators.components import components
from sievework.operators.exact_dedup import nan_to_null, quality_order
from sievework.storage import materialise


def band_shape(settings: NearDupSettings) -> tuple[int, int]:
    """Bands and rows per band, as set or as best for the threshold."""
    if settings.bands and settings.rows:
        return settings.bands, settings.rows
    return optimal_bands(settings.threshold, settings.num_perm)


def with_band_keys(
    df: DataFrame, text: str = "text", settings: NearDupSettings = NearDupSettings()
) -> DataFrame:
    """Add `bands`, the LSH bucket keys of each row; null where there are no words."""
    bands, rows = band_shape(settings)
    keys = lsh_keys(F.col(text), bands, rows, settings.num_perm, settings.shingle_size)
    return df.withColumn("bands", keys)


def near_dup_order(score: str, key: Sequence[str], tie: Sequence[str] | None = None) -> list[Column]:
    """Best score first, unscored last. Equal scores are ordered by a hash of `tie`
    (by default the key), then by key: texts that drift from one to the next in
    key order, as versions of a page do, would else be settled one by one."""
    scores, keys = quality_order(score, key)[:2], quality_order(score, key)[2:]
    return [*scores, F.md5(F.concat_ws("\x1f", *(tie or key))), *keys]


def lsh_buckets(
    df: DataFrame,
    text: str = "text",
    score: str = "score",
    key: Sequence[str] = ("source", "source_id"),
    settings: NearDupSettings = NearDupSettings(),
) -> DataFrame:
    """Buckets that more than one row falls into, with their size and best row.

    The collisions of a bucket are all pairs of its members; size and head say
    the same without writing out the pairs.
    """
    fields = near_dup_order(score, key)
    named = [x for i, c in enumerate(fields) for x in (F.lit(f"_o{i}"), c)]
    order = F.named_struct(*named, F.lit("row"), F.struct(*key))
    return (
        with_band_keys(df.withColumn(score, nan_to_null(F.col(score))), text, settings)
        # The outer form keeps Spark from testing the signature in a filter of its
        # own, below this step, which would compute it twice.
        .select(order.alias("place"), F.explode_outer("bands").alias("bucket"))
        .where("bucket IS NOT NULL")
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("place").alias("best"))
        .where("n_rows > 1")
        .select(
            F.lower(F.hex("bucket")).alias("bucket"),
            "n_rows",
            *[F.col(f"best.row.{c}").alias(f"head_{c}") for c in key],
        )
    )


def _join_buckets(
    members: DataFrame, buckets: DataFrame, n_members: int, settings: NearDupSettings
) -> DataFrame:
    """`members` joined to the rows of their bucket, one or a few.

    Buckets with more than `hot_share` of all members, at most 1 / hot_share in
    number, are broadcast, so their members stay where they are; the members of
    all other buckets are shuffled.
    """
    hot_size = int(n_members * settings.hot_share)
    narrow = buckets.select("bucket", "head")
    hot = narrow.where(F.col("n") > hot_size)
    cold = narrow.where(F.col("n") <= hot_size)
    marked = members.join(F.broadcast(hot), "bucket", "left")
    return marked.where("head IS NOT NULL").unionByName(
        marked.where("head IS NULL").drop("head").join(cold, "bucket")
    )


def _heads(members: DataFrame, *more: Column) -> DataFrame:
    return members.groupBy("bucket").agg(
        F.min("place").alias("head"), F.count(F.lit(1)).alias("n"), *more
    )


def _placed(
    df: DataFrame, text: str, score: str, key: Sequence[str], settings: NearDupSettings, tie: Sequence[str] | None
) -> tuple[DataFrame, DataFrame]:
    """`df` as `place`, the position in quality order, key and `bands`; and, with
    `verify`, `row` and `grams`, where `row` is also with the places."""
    # Stored before it is sorted: a range sort reads its input twice, and the
    # signatures are the costly part.
    keyed, more = df.select(*key, text, nan_to_null(F.col(score)).alias(score)), []
    if settings.verify:
        both = lsh_keys_and_shingles(F.col(text), *band_shape(settings), settings.num_perm, settings.shingle_size)
        keyed = keyed.withColumn("_both", both).select(*key, score, "_both.bands", "_both.grams")
        keyed, more = keyed.withColumn("row", F.monotonically_increasing_id()), ["row"]
    else:
        keyed = with_band_keys(keyed, text, settings).select(*key, score, "bands")
    keyed = materialise(keyed, "signatures")
    # One range sort turns score and key into an ordered long.
    placed = materialise(
        keyed.orderBy(*near_dup_order(score, key, tie)).select(
            *key, F.monotonically_increasing_id().alias("place"), "bands", *more
        ),
        "placed",
    )
    return placed, keyed


def _contested(placed: DataFrame, settings: NearDupSettings) -> DataFrame:
    """`place, bucket` of the members of buckets that hold more than one row."""
    memberships = placed.select("place", F.explode("bands").alias("bucket"))
    contested = materialise(_heads(memberships).where("n > 1"), "contested")
    n_members = placed.count() * band_shape(settings)[0]
    return materialise(
        _join_buckets(memberships, contested, n_members, settings).select("place", "bucket"),
        "members",
    )


def _leaders(rest: DataFrame, heads: DataFrame) -> DataFrame:
    """`head` of the rows that are a head of all their buckets."""
    led = heads.groupBy("head").agg(F.count(F.lit(1)).alias("led"))
    held = rest.groupBy(F.col("place").alias("head")).agg(F.count(F.lit(1)).alias("held"))
    return led.join(held, "head").where("led = held").select("head")


def _kept_by_collision(members: DataFrame, settings: NearDupSettings) -> list[DataFrame]:
    """Tables of the places that are kept if every collision drops a row."""
    kept = []
    rest, n_rest = members, members.count()
    while n_rest:
        heads = materialise(_heads(rest), "heads")
        # Buckets whose head is kept. All their members are decided by that.
        settled = materialise(heads.join(_leaders(rest, heads), "head", "left_semi"), "settled")
        kept.append(settled.select(F.col("head").alias("place")))
        decided = _join_buckets(rest, settled, n_rest, settings).select("place").distinct()
        rest = materialise(rest.join(decided, "place", "left_anti"), "rest")
        n_rest = rest.count()
    return kept


def _only(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of `keyed` whose `row` is in `rows`. Each task gets a bit per row of
    `keyed`, so the shingle sets of all other rows stay where they are."""
    bits = rows.groupBy(F.bitmap_bucket_number("row").alias("at")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits")
    )
    bit = F.bitmap_bit_position("row").cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    numbered = keyed.withColumn("at", F.bitmap_bucket_number("row")).join(F.broadcast(bits), "at")
    return numbered.where(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1).drop("at", "bits")


def _alike(pairs: DataFrame, sets: DataFrame, settings: NearDupSettings) -> DataFrame:
    """`place` and `head` of those of `pairs(place, head, row, head_row)` whose shingle
    sets, `sets(row, grams)`, are as similar as the threshold. A head with very many
    pairs has copies of its set, and each pair meets one of them."""
    copies = pairs.groupBy("head_row").agg(
        F.ceil(F.count(F.lit(1)) / settings.pairs_per_part).cast("int").alias("parts")
    )
    theirs = _only(sets, pairs.select(F.col("head_row").alias("row"))).select(
        F.col("row").alias("head_row"), F.col("grams").alias("theirs")
    )
    heads = copies.join(theirs, "head_row").select(
        "head_row", "theirs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    asked = pairs.join(copies, "head_row").withColumn("part", F.pmod(F.xxhash64("place"), "parts").cast("int"))
    met = asked.drop("parts").join(_only(sets, pairs.select("row")), "row").join(heads, ["head_row", "part"])
    mine, theirs = F.size("grams"), F.size("theirs")
    common = F.size(F.array_intersect("grams", "theirs"))
    # Sets of too unlike sizes need no look inside.
    could = F.least(mine, theirs) / F.greatest(mine, theirs) >= settings.threshold
    return met.where(could & (common / (mine + theirs - common) >= settings.threshold)).select("place", "head")


def _width(heads: DataFrame, n_pairs: int) -> int:
    """Rows in the front of a bucket, a power of two and one at least, so that fronts
    and members are not more than `n_pairs` pairs; all rows of a bucket if they are
    fewer."""
    widths = [1 << i for i in range(32)]
    pairs = heads.agg(*[F.sum(F.col("n") * F.least("n", F.lit(w))).alias(str(w)) for w in widths]).first()
    return max([1, *(w for w in widths if (pairs[str(w)] or 0) <= n_pairs)])


def _fronts(rest: DataFrame, heads: DataFrame, width: int, n_rest: int, settings: NearDupSettings) -> DataFrame:
    """`bucket, head, n` of the first rows of each bucket, some `width` of them: those
    up to a place, so no row of the bucket is better than one of its front and not in it."""
    if width == 1:
        return heads.select("bucket", "head", "n")
    # The members of a large bucket are dealt out. The best of each hand are places
    # near its beginning, and half of them end the front.
    hand = F.pmod(F.xxhash64("place"), F.lit(width))
    large = _join_buckets(rest, heads.where(F.col("n") > width), n_rest, settings)
    best = large.groupBy("bucket", hand.alias("hand")).agg(F.min("place").alias("place"))
    half = F.element_at(F.sort_array(F.collect_list("place")), F.ceil(F.count(F.lit(1)) / 2).cast("int"))
    ends = heads.join(best.groupBy("bucket").agg(half.alias("end")), "bucket", "left").select(
        "bucket", F.coalesce("end", "tail").alias("head"), "n"
    )
    ends = materialise(ends, "ends")
    met = _join_buckets(rest, ends, n_rest, settings).where("place <= head")
    return met.select("bucket", F.col("place").alias("head")).join(ends.select("bucket", "n"), "bucket")


def _losers(edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the places that are dropped, and the edges that are still open.

    `edges(place, head, ready)` are rows that are alike, `ready` if all better rows
    that `head` may be alike to are in the front with it."""
    dropped = []
    while True:
        kept = edges.where("ready").join(edges.select(F.col("place").alias("head")).distinct(), "head", "left_anti")
        gone = materialise(kept.select("place").distinct(), "dropped")
        if gone.isEmpty():
            return dropped, edges
        dropped.append(gone)
        open_ = edges.join(gone, "place", "left_anti").join(gone.withColumnRenamed("place", "head"), "head", "left_anti")
        edges = materialise(open_.select("place", "head", "ready"), "edges")


def _dropped_by_likeness(
    members: DataFrame, rows: DataFrame, sets: DataFrame, settings: NearDupSettings
) -> list[DataFrame]:
    """Tables of the places that are dropped if a collision must be confirmed by
    `sets(row, grams)`, where `rows(place, row)` tells the row of a place."""
    dropped = []
    n_members = n_rest = n_pairs = members.count()
    rest = members
    while n_rest:
        heads = materialise(_heads(rest, F.max("place").alias("tail")), "heads")
        width = _width(heads, n_pairs)
        fronts = materialise(_fronts(rest, heads, width, n_rest, settings), "fronts")
        leaders = materialise(_leaders(rest, fronts), "leaders")
        asking = fronts.where("n > 1")
        if width == 1:
            # The others in front are not decided yet, nor do they stand before a leader.
            asking = asking.join(leaders, "head", "left_semi")
        pairs = _join_buckets(rest, asking, n_rest * width, settings).where("head < place").select("place", "head").distinct()
        pairs = pairs.join(rows, "place").join(rows.select(F.col("place").alias("head"), F.col("row").alias("head_row")), "head")
        edges = _alike(materialise(pairs, "pairs"), sets, settings)
        ready = leaders.withColumn("ready", F.lit(True))
        edges = edges.join(ready, "head", "left").select("place", "head", F.coalesce("ready", F.lit(False)).alias("ready"))
        losers, open_ = _losers(materialise(edges, "edges"))
        dropped += losers
        kept = leaders.withColumnRenamed("head", "place").join(open_.select("place"), "place", "left_anti")
        gone = reduce(DataFrame.unionByName, losers, kept)
        rest = materialise(rest.join(gone, "place", "left_anti"), "rest")
        n_rest = rest.count()
        # Copies are gone after the first round, so most pairs are needed anyway.
        n_pairs = max(2 * n_members, settings.least_pairs)
    return dropped


def near_duplicates(
    df: DataFrame,
    text: str = "text",
    score: str = "score",
    key: Sequence[str] = ("source", "source_id"),
    settings: NearDupSettings = NearDupSettings(),
    tie: Sequence[str] | None = None,
) -> DataFrame:
    """Keys of the rows to drop, with the reason `near_dup` or `no_tokens`.

    `key` must identify a row. Runs jobs: each round ends with a table in the
    shared folder. With `settings.verify` every dropped row is as similar as the
    threshold to a kept one. In a bucket of rows that are unlike each must be compared
    with those before it, so the pairs are quadratic in its size; a round lists some
    twice as many at most as there are memberships, or `settings.least_pairs`.
    """
    placed, keyed = _placed(df, text, score, key, settings, tie)
    members = _contested(placed, settings)
    no_tokens = placed.where("bands IS NULL").select(*key, F.lit("no_tokens").alias("reason"))
    if settings.verify:
        rows = placed.select("place", "row").join(members.select("place").distinct(), "place", "left_semi")
        tables = _dropped_by_likeness(members, materialise(rows, "rows"), keyed.select("row", "grams"), settings)
        if not tables:
            return no_tokens
        losers = reduce(DataFrame.unionByName, tables)
    else:
        tables = _kept_by_collision(members, settings)
        if not tables:
            return no_tokens
        losers = members.select("place").join(reduce(DataFrame.unionByName, tables), "place", "left_anti")
    return (
        placed.select(*key, "place")
        .join(losers.distinct(), "place")
        .select(*key, F.lit("near_dup").alias("reason"))
        .unionByName(no_tokens)
    )


def near_dup_clusters(
    df: DataFrame,
    text: str = "text",
    score: str = "score",
    key: Sequence[str] = ("source", "source_id"),
    settings: NearDupSettings = NearDupSettings(),
    tie: Sequence[str] | None = None,
) -> DataFrame:
    """Per row its key, the key of the best row of its cluster as `best_<key>`, and
    `n_rows`, the size of the cluster. Runs jobs.

    `key` must identify a row. A row without words, as one without a collision, is
    a cluster of its own. Clusters follow collisions of LSH buckets, also through
    rows in between, so `settings.verify` has no effect here.
    """
    settings = replace(settings, verify=False)
    placed, _ = _placed(df, text, score, key, settings, tie)
    members = _contested(placed, settings)
    heads = materialise(_heads(members), "heads")
    linked = _join_buckets(members, heads, members.count(), settings).where("place <> head")
    # Places are in quality order, so the lowest of a component is its best row.
    roots = components(linked.select(F.col("place").alias("u"), F.col("head").alias("v")))
    located = materialise(
        placed.select(*key, "place")
        .join(roots.withColumnRenamed("node", "place"), "place", "left")
        .withColumn("root", F.coalesce("root", "place")),
        "clusters",
    )
    # One row per cluster of more than one row; a cluster may hold a third of all
    # rows, so its members are joined to that one row and can be split.
    sizes = located.groupBy("root").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    best = located.where("place = root").select("root", *[F.col(c).alias(f"best_{c}") for c in key])
    large = located.join(best.join(sizes, "root"), "root", "left")
    alone = F.col("n_rows").isNull()
    return large.select(
        *key,
        *[F.when(alone, F.col(c)).otherwise(F.col(f"best_{c}")).alias(f"best_{c}") for c in key],
        F.coalesce("n_rows", F.lit(1).cast("long")).alias("n_rows"),
    )


def keep_best_of_clusters(
    df: DataFrame,
    text: str = "text",
    score: str = "score",
    key: Sequence[str] = ("source", "source_id"),
    settings: NearDupSettings = NearDupSettings(),
) -> DataFrame:
    """`df` with the best row of each near-duplicate cluster only."""
    clusters = near_dup_clusters(df, text, score, key, settings)
    is_best = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"best_{c}")) for c in key])
    return without_rows(df, clusters.where(~is_best), key)


def without_rows(df: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    """`df` without the rows whose key is in `gone`; null parts of a key match."""
    same = reduce(
        lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
    )
    return df.alias("l").join(gone.alias("r"), same, "left_anti")


def drop_near_duplicates(
    df: DataFrame,
    text: str = "text",
    score: str = "score",
    key: Sequence[str] = ("source", "source_id"),
    settings: NearDupSettings = NearDupSettings(),
) -> DataFrame:
    """`df` without the rows of `near_duplicates`."""
    return without_rows(df, near_duplicates(df, text, score, key, settings), key)

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from sievework.llm.sharding import ShardSettings, first_map, rebalanced, records, shard, slot_bytes, write_map
from sievework.storage import scratch_path
from tests.llm.common import documents, odd_rows, prose, with_clashes


def many(spark, n=3000):
    return documents(spark, [(i, prose(i % 40, 5 + i % 90), "en", "a", 1) for i in range(n)])


def test_shards_are_near_equal_and_slots_gapless(spark):
    settings = ShardSettings(n_shards=7, n_slots=512)
    out = shard(with_clashes(many(spark)), settings=settings).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 7 and sizes.max() - sizes.min() < 0.01 * sizes.mean()
    for _, group in out.groupby("shard"):
        assert sorted(group["slot"]) == list(range(len(group)))
    assert set(out["law"]) == {"bytes"} and out["grown_shard"].isna().all()
    assert (out.groupby("virtual_slot")["shard"].nunique() == 1).all()


def test_rows_of_odd_tables(spark):
    out = shard(documents(spark)).collect()
    got = sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out)
    assert got == sorted(
        (str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows()
    )
    assert all(0 <= r["shard"] < 40 for r in out)
    assert shard(documents(spark, [])).collect() == []


def test_growing_moves_few_slots_and_keeps_old_versions(spark):
    settings = ShardSettings(n_shards=7, n_slots=512)
    slots = slot_bytes(records(many(spark), "doc_id", "text", settings), settings)
    folder = scratch_path(spark, "test-map")
    first = write_map(first_map(slots, settings), folder)
    grown = ShardSettings(n_shards=8, n_slots=512)
    second = write_map(rebalanced(first, slots, grown), folder)
    a = {r["virtual_slot"]: r["shard"] for r in first.collect()}
    b = {r["virtual_slot"]: r["shard"] for r in second.collect()}
    assert a.keys() == b.keys() and len(a) == 512
    moved = sum(a[s] != b[s] for s in a)
    assert 0 < moved < 2 * 512 / 8
    held = {r["shard"]: r["bytes"] for r in second.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    assert len(held) == 8 and max(held.values()) < 1.1 * sum(held.values()) / 8
    versions = spark.read.parquet(folder).groupBy("version").count().collect()
    assert {r["version"]: r["count"] for r in versions} == {1: 512, 2: 512}


def test_a_shard_that_goes_loses_all_slots(spark):
    settings = ShardSettings(n_shards=4, n_slots=64)
    slots = slot_bytes(records(many(spark, 500), "doc_id", "text", settings), settings)
    fewer = ShardSettings(n_shards=3, n_slots=64)
    out = rebalanced(first_map(slots, settings), slots, fewer).collect()
    assert {r["shard"] for r in out} == {0, 1, 2} and len(out) == 64

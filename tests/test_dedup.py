from __future__ import annotations

import hashlib
import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sievework.config import NearDupSettings
from sievework.functions import shingles
from sievework.operators import near_dup
from sievework.operators.exact_dedup import exact_dedup_keep_best

SCHEMA = "source string, source_id string, text string, score double"


def test_exact_keeps_the_best_scored_copy(spark):
    nan = float("nan")
    rows = [
        ("s", "1", "a", None), ("s", "2", "a", nan), ("s", "4", "a", 5.0), ("s", "3", "a", 5.0),
        ("s", "5", "b", None), ("s", "6", "b", nan), ("s", "7", "c", -1.0), ("s", "8", "c", None),
    ]
    out = exact_dedup_keep_best(spark.createDataFrame(rows, SCHEMA), count_as="n").collect()
    assert {(r["text"], r["source_id"], r["score"], r["n"]) for r in out} == {
        ("a", "3", 5.0, 4), ("b", "5", None, 2), ("c", "7", -1.0, 2),
    }


def test_exact_sends_one_row_per_text_and_task(spark):
    rows = [("s", str(i), "hot", float(i)) for i in range(5000)]
    df = exact_dedup_keep_best(spark.createDataFrame(rows, SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan
    assert [r["source_id"] for r in df.collect()] == ["4999"]


def test_shingles(apply):
    texts = ["a b c d", "a b", "", "A, B! C", "a b c", "a a a a a", "!!!"]
    got = [sorted(g) for g in apply(lambda t: shingles.word_shingles(t, 3), texts)]
    assert got == [["a b c", "b c d"], ["a b"], [], ["a b c"], ["a b c"], ["a a a"], []]


def test_signature_ignores_case_and_punctuation(apply):
    a, b, none, empty = apply(
        lambda t: shingles.minhash_signature(t, 16), ["A, B! C d", "a b c D!", "?!", None]
    )
    assert a == b and len(a) == 16 and none is None and empty is None


def test_signature_estimates_jaccard(apply):
    draw = random.Random(3)
    words = [f"w{draw.randrange(10**6)}" for _ in range(400)]
    left, right = words[:320], words[80:]
    grams = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in (left, right)]
    exact = len(grams[0] & grams[1]) / len(grams[0] | grams[1])
    a, b = apply(lambda t: shingles.minhash_signature(t, 512), [" ".join(left), " ".join(right)])
    assert abs(sum(x == y for x, y in zip(a, b)) / 512 - exact) < 0.1


def test_signature_equals_its_definition(apply, monkeypatch):
    """Texts of all lengths in one batch, against one shingle at a time."""
    places = [int(n) for n in shingles.odd_numbers("place", 3)]
    multipliers = [int(n) for n in shingles.odd_numbers("permutation", 8)]
    full = 2**64 - 1

    def signature(value):
        tokens = re.findall(r"\w+", value.lower())
        if not tokens:
            return None
        hashes = [int(hashlib.md5(t.encode()).hexdigest()[:16], 16) for t in tokens]
        grams = []
        for i in range(max(len(hashes) - 2, 1)):
            x = sum(h * p for h, p in zip(hashes[i : i + 3], places)) & full
            x = ((x ^ x >> 33) * shingles.MIX) & full
            grams.append(x ^ x >> 33)
        return [min(g * m & full for g in grams) >> 32 for m in multipliers]

    monkeypatch.setattr(shingles, "BLOCK", 16)
    monkeypatch.setattr(shingles, "PORTION", 300)
    draw = random.Random(5)
    sizes = [0, 1, 2, 3, 4, 17, 18, 19, 200, 0, 2, 50, 1, 1, 33]
    texts = [" ".join(f"W{draw.randrange(30)}," for _ in range(n)) for n in sizes]
    assert apply(lambda t: shingles.minhash_signature(t, 8), texts) == [signature(t) for t in texts]


def test_long_text_is_hashed_whole(apply):
    body = " ".join(f"w{i}" for i in range(20_000))
    a, b = apply(lambda t: shingles.minhash_signature(t), [body, body + " tail words here"])
    assert a != b or sum(x == y for x, y in zip(a, b)) > 100


def test_band_shapes():
    assert shingles.optimal_bands(0.9, 128) == (5, 25)
    for threshold in (0.5, 0.7, 0.8):
        bands, rows = shingles.optimal_bands(threshold, 128)
        assert bands * rows <= 128


def kept_texts(spark, texts, settings=NearDupSettings()):
    rows = [("s", f"{i:04d}", t, float(-i)) for i, t in enumerate(texts)]
    out = near_dup.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA), settings=settings)
    return sorted(r["text"] for r in out.collect())


def test_near_copies_go_and_distinct_texts_stay(spark):
    base = " ".join(f"item{i}" for i in range(14))
    other = " ".join(f"thing{i}" for i in range(14))
    assert kept_texts(spark, [base, base + "?", base.upper(), other]) == sorted([base, other])


def test_texts_without_words_are_dropped_with_their_reason(spark):
    rows = [("s", "1", "!!! ???", 1.0), ("s", "2", "some words here", 1.0)]
    near = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in near] == [("s", "1", "no_tokens")]


def greedy(spark, df, settings):
    """The rule itself: from best to worst, keep a row that shares no bucket
    with a kept one."""
    keyed = near_dup.with_band_keys(df, settings=settings).collect()

    def place(r):
        tie = hashlib.md5(f"{r['source']}\x1f{r['source_id']}".encode()).hexdigest()
        return r["score"] is None, -(r["score"] or 0), tie, r["source"], r["source_id"]

    order = sorted(keyed, key=place)
    taken, kept = set(), set()
    for row in order:
        if row["bands"] and not taken & set(row["bands"]):
            taken |= set(row["bands"])
            kept.add(row["source_id"])
    return kept


def chains(seed: int, n: int):
    """Texts that drift from one another, so that collisions form chains."""
    draw = random.Random(seed)
    rows, words = [], [f"w{draw.randrange(60)}" for _ in range(30)]
    for i in range(n):
        if draw.random() < 0.1:
            words = [f"w{draw.randrange(60)}" for _ in range(30)]
        words = list(words)
        words[draw.randrange(30)] = f"w{draw.randrange(60)}"
        score = draw.choice([None, 0.0, 1.0, 2.0])
        rows.append((draw.choice("st"), f"{i:04d}", " ".join(words), score))
    return rows


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 7), (3, 31)])
def test_rounds_equal_the_sequential_rule(spark, seed, parts):
    settings = NearDupSettings(threshold=0.6, num_perm=64)
    df = spark.createDataFrame(chains(seed, 250), SCHEMA).repartition(parts)
    expected = greedy(spark, df, settings)
    got = {r["source_id"] for r in near_dup.drop_near_duplicates(df, settings=settings).collect()}
    assert got == expected
    assert 0 < len(got) < 250


def test_hot_buckets_give_the_same_result(spark):
    """A third of all rows are copies of one text but for a word."""
    draw = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words = list(base) if i % 3 == 0 else [f"x{draw.randrange(10**6)}" for _ in range(60)]
        words[draw.randrange(60)] = f"y{i}"
        rows.append(("s", f"{i:04d}", " ".join(words), float(draw.randrange(5))))
    df = spark.createDataFrame(rows, SCHEMA)
    settings = NearDupSettings(threshold=0.6, hot_share=1.0)
    plain = {r["source_id"] for r in near_dup.drop_near_duplicates(df, settings=settings).collect()}
    hot = replace(settings, hot_share=0.01)
    broadcast = {r["source_id"] for r in near_dup.drop_near_duplicates(df, settings=hot).collect()}
    assert plain == broadcast == greedy(spark, df, settings)
    assert len(plain) < 240


def test_a_chain_in_key_order_takes_few_rounds(spark, monkeypatch):
    """Unscored versions of one page, each a word from the one before."""
    draw, words, rows = random.Random(4), [f"w{i}" for i in range(40)], []
    for i in range(400):
        words = list(words)
        words[draw.randrange(40)] = f"v{i}"
        rows.append(("s", f"{i:05d}", " ".join(words), None))
    df = spark.createDataFrame(rows, SCHEMA)
    rounds, keep = [], near_dup.materialise

    def counted(table, name):
        rounds.append(name)
        return keep(table, name)

    monkeypatch.setattr(near_dup, "materialise", counted)
    settings = NearDupSettings(threshold=0.6, num_perm=64)
    got = {r["source_id"] for r in near_dup.drop_near_duplicates(df, settings=settings).collect()}
    assert got == greedy(spark, df, settings)
    assert rounds.count("heads") <= 15


def test_buckets_name_size_and_head(spark):
    rows = [("s", str(i), "one two three four five six seven", float(i)) for i in range(4)]
    out = near_dup.lsh_buckets(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["n_rows"], r["head_source"], r["head_source_id"]) for r in out} == {(4, "s", "3")}
    assert len(out) == 5


def test_a_blocked_best_copy_removes_its_clean_copies(spark):
    from sievework.config import CurationConfig
    from sievework.plans.clean import clean

    body = " ".join(f"w{i}" for i in range(50))
    rows = [("s", "1", body + " idiot", 9.0), ("s", "2", body + " friend", 1.0), ("s", "3", "a text of its own", 1.0)]
    config = CurationConfig(blocklist=("idiot",), near_dup=NearDupSettings(threshold=0.5))
    result = clean(spark.createDataFrame(rows, SCHEMA), config)
    assert [r["source_id"] for r in result.rows.collect()] == ["3"]


def test_filters_first_leaves_the_clean_copies(spark):
    from sievework.config import CurationConfig
    from sievework.plans.clean import clean

    body = " ".join(f"w{i}" for i in range(50))
    rows = [
        ("s", "1", body + " idiot", 9.0), ("s", "2", body + " friend", 1.0), ("s", "3", "a text of its own", 1.0),
        ("s", "4", "a text of its own", 0.5), ("s", "5", "no", 1.0), ("s", "6", "please upvote this post of mine", 1.0),
    ]
    config = CurationConfig(
        blocklist=("idiot",), meta_phrases=("upvote",), near_dup=NearDupSettings(threshold=0.5), filters_first=True
    )
    result = clean(spark.createDataFrame(rows, SCHEMA), config)
    assert sorted(r["source_id"] for r in result.rows.collect()) == ["2", "3"]
    funnel = {r["stage"]: (r["step"], r["dropped"], r["remaining"]) for r in result.funnel().collect()}
    assert funnel["length"] == (2, 1, 5) and funnel["offensive"] == (3, 1, 4) and funnel["meta"] == (4, 1, 3)
    assert funnel["exact_dup"] == (5, 1, 2) and funnel["near_dup"] == (6, 0, 2) and funnel["final"][2] == 2


def test_word_pattern_of_the_two_shingle_forms_agree(apply):
    texts = ["Caf" + chr(0xE9) + " na" + chr(0xEF) + "ve_x 12" + chr(0xBD), "e" + chr(0x301) + "a", "a'b-c"]
    from sievework.functions.text import words

    assert apply(words, texts) == [re.findall(r"\w+", t.lower()) for t in texts]


def test_ids_may_repeat_or_lack(spark):
    from sievework.plans.clean import clean

    body = " ".join(f"w{i}" for i in range(50))
    rows = [
        ("s", None, body, 2.0), ("s", None, body + "!", 1.0), ("s", None, "a text of its own", 1.0),
        ("s", "7", body + "?", 0.0), ("s", "7", "and yet another text", 0.0),
    ]
    result = clean(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["text"] for r in result.rows.collect()) == sorted(
        [body, "a text of its own", "and yet another text"]
    )


def shingle_sets(df):
    out = {}
    for r in df.collect():
        found = re.findall(r"\w+", r["text"].lower())
        out[r["source_id"]] = {tuple(found[i : i + 3]) for i in range(max(len(found) - 2, 1))} if found else set()
    return out


def confirmed_greedy(df, settings):
    """From best to worst, drop a row that shares a bucket with a kept row as
    similar as the threshold; the rows that stay and, per dropped row, its best
    similarity to one of those."""
    sets = shingle_sets(df)
    keyed = near_dup.with_band_keys(df, settings=settings).collect()

    def place(r):
        tie = hashlib.md5(f"{r['source']}\x1f{r['source_id']}".encode()).hexdigest()
        return r["score"] is None, -(r["score"] or 0), tie, r["source"], r["source_id"]

    kept, gone = [], {}
    for row in sorted(keyed, key=place):
        if not row["bands"]:
            continue
        mine = sets[row["source_id"]]
        near = [
            len(mine & sets[k]) / len(mine | sets[k]) for k, theirs in kept if set(theirs) & set(row["bands"])
        ]
        if near and max(near) >= settings.threshold:
            gone[row["source_id"]] = max(near)
        else:
            kept.append((row["source_id"], row["bands"]))
    return {k for k, _ in kept}, gone


@pytest.mark.parametrize("seed,parts,per_part", [(1, 1, 50_000), (2, 5, 3)])
def test_a_collision_must_be_confirmed(spark, seed, parts, per_part):
    settings = NearDupSettings(threshold=0.6, num_perm=64, verify=True, pairs_per_part=per_part)
    df = spark.createDataFrame(chains(seed, 250), SCHEMA).repartition(parts)
    kept, gone = confirmed_greedy(df, settings)
    got = {r["source_id"] for r in near_dup.drop_near_duplicates(df, settings=settings).collect()}
    assert got == kept and min(gone.values()) >= 0.6
    # Some collisions were of rows below the threshold.
    loose = near_dup.drop_near_duplicates(df, settings=replace(settings, verify=False)).count()
    assert loose < len(got) < 250


def test_confirmed_with_a_large_group_of_copies(spark):
    """A third of all rows differ in a word, and rows without words go."""
    draw = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [("s", "none", "!!", 1.0)]
    for i in range(300):
        words = list(base) if i % 3 == 0 else [f"x{draw.randrange(10**6)}" for _ in range(60)]
        words[draw.randrange(60)] = f"y{i}"
        rows.append(("s", f"{i:04d}", " ".join(words), float(draw.randrange(5))))
    df = spark.createDataFrame(rows, SCHEMA)
    settings = NearDupSettings(threshold=0.6, hot_share=0.01, verify=True, pairs_per_part=10)
    kept, _ = confirmed_greedy(df, settings)
    assert {r["source_id"] for r in near_dup.drop_near_duplicates(df, settings=settings).collect()} == kept
    assert len(kept) < 240


def test_confirmed_where_nothing_collides(spark):
    settings = NearDupSettings(verify=True)
    assert near_dup.near_duplicates(spark.createDataFrame([], SCHEMA), settings=settings).collect() == []
    rows = [("s", "1", "one text of its own", 1.0), ("s", "2", "and quite another one", None)]
    assert near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA), settings=settings).collect() == []


def unlike_in_common_buckets(n):
    """Texts that share half their words, so buckets of one row hold most of them; a
    third have a near copy."""
    draw, rows = random.Random(11), []
    base = [f"w{i}" for i in range(40)]
    for i in range(n):
        words = base[: draw.randrange(28, 34)] + [f"u{i}x{j}" for j in range(20)]
        rows.append(("s", f"{i:04d}", " ".join(words), float(draw.randrange(4))))
        if i % 3 == 0:
            words[draw.randrange(len(words))] = "changed"
            rows.append(("s", f"{i:04d}c", " ".join(words), float(draw.randrange(4))))
    return rows


def test_confirming_unlike_rows_takes_few_rounds(spark, monkeypatch):
    tables, widths, store, width_of = [], [], near_dup.materialise, near_dup._width
    monkeypatch.setattr(near_dup, "materialise", lambda df, name: tables.append(name) or store(df, name))
    monkeypatch.setattr(near_dup, "_width", lambda *args: widths.append(width_of(*args)) or widths[-1])
    df = spark.createDataFrame(unlike_in_common_buckets(24), SCHEMA)
    settings = NearDupSettings(threshold=0.7, num_perm=32, bands=32, rows=1, verify=True, least_pairs=3000)
    kept, gone = confirmed_greedy(df, settings)
    assert {r["source_id"] for r in near_dup.drop_near_duplicates(df, settings=settings).collect()} == kept
    # Most rows stay in a bucket with most others; it was a round for each of them.
    assert len(kept) == 24 and len(gone) == 8 and tables.count("pairs") < 12
    # Fronts of one row, of some rows of a bucket, and of all.
    assert widths[0] == 1 and any(1 < w < 16 for w in widths) and widths[-1] > 16


def test_a_chain_of_copies_in_one_front(spark):
    """Each version is like the next only, and is better than it."""
    words, rows = [f"w{i}" for i in range(40)], []
    for i in range(12):
        rows.append(("s", f"{i:02d}", " ".join(words), float(-i)))
        words = words[4:] + [f"v{i}x{j}" for j in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    settings = NearDupSettings(threshold=0.8, num_perm=64, bands=64, rows=1, verify=True)
    kept, _ = confirmed_greedy(df, settings)
    assert kept == {f"{i:02d}" for i in range(0, 12, 2)}
    assert {r["source_id"] for r in near_dup.drop_near_duplicates(df, settings=settings).collect()} == kept


def test_only_the_sets_asked_for_leave_their_place(spark):
    numbers = [0, 1, 7, 8, 255, 256, 32767, 32768, 32769, 65536, 65537, 1 << 33, (1 << 33) + 32768, 5 << 33]
    sets = spark.createDataFrame([(n, [n]) for n in numbers], "row long, grams array<long>").repartition(3)
    for asked in (numbers[::2], numbers[1::2], numbers[:1], []):
        rows = spark.createDataFrame([(n,) for n in asked * 2], "row long")
        found = near_dup._only(sets, rows)
        assert sorted((r["row"], r["grams"]) for r in found.collect()) == [(n, [n]) for n in asked]
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def collided(df, settings):
    """Per row the best row of its cluster and the cluster's size, by search."""
    keyed = [(r["source_id"], r["score"], r["source"], set(r["bands"] or ())) for r in
             near_dup.with_band_keys(df, settings=settings).collect()]

    def place(r):
        tie = hashlib.md5(f"{r[2]}\x1f{r[0]}".encode()).hexdigest()
        return r[1] is None, -(r[1] or 0), tie, r[2], r[0]

    by_bucket = {}
    for row in keyed:
        for bucket in row[3]:
            by_bucket.setdefault(bucket, []).append(row[0])
    order, of = {r[0]: place(r) for r in keyed}, {}
    buckets = {r[0]: r[3] for r in keyed}
    for start in order:
        if start in of:
            continue
        seen, todo = {start}, [start]
        while todo:
            for bucket in buckets[todo.pop()]:
                new = set(by_bucket[bucket]) - seen
                seen |= new
                todo += new
        best = min(seen, key=order.get)
        of.update({row: (best, len(seen)) for row in seen})
    return of


@pytest.mark.parametrize("hot_share", [1e-5, 0.05])
def test_clusters_against_a_search(spark, hot_share):
    settings = NearDupSettings(threshold=0.6, num_perm=64, hot_share=hot_share)
    rows = chains(6, 300) + [("s", "none", "?!", 3.0), ("t", "alone", "a text that is like no other here", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["source_id"]: (r["best_source_id"], r["n_rows"]) for r in near_dup.near_dup_clusters(df, settings=settings).collect()}
    assert got == collided(df, settings)
    best = {r["source_id"] for r in near_dup.keep_best_of_clusters(df, settings=settings).collect()}
    assert best == {row for row, (b, _) in got.items() if row == b}
    assert got["none"] == ("none", 1) and 2 < len(best) < 250


def test_a_chain_and_a_star_of_a_thousand_are_two_clusters(spark):
    """Versions that drift apart step by step, and copies of one text."""
    draw, words, rows = random.Random(4), [f"w{i}" for i in range(60)], []
    for i in range(1000):
        words = list(words)
        words[i % 60] = f"v{i}"
        rows.append(("s", f"c{i:05d}", " ".join(words), None))
    base = [f"x{i}" for i in range(60)]
    for i in range(1000):
        copy = list(base)
        copy[draw.randrange(60)] = f"y{i}"
        rows.append(("s", f"d{i:05d}", " ".join(copy), float(i == 7)))
    df = spark.createDataFrame(rows, SCHEMA)
    # A band of one row: texts of similarity 0.9 share one of 64 for sure.
    settings = NearDupSettings(num_perm=64, bands=64, rows=1)
    out = near_dup.near_dup_clusters(df, settings=settings).collect()
    sizes = {(r["source_id"][0], r["best_source_id"], r["n_rows"]) for r in out}
    assert len(out) == 2000 and len(sizes) == 2
    assert {(kind, n) for kind, _, n in sizes} == {("c", 1000), ("d", 1000)}
    assert ("d", "d00007", 1000) in sizes


def test_shingle_numbers_are_a_set(apply):
    a, b, c, d, e = apply(
        lambda t: shingles.shingle_hashes(t),
        ["one two three four", "ONE, two three four! one two three four", "one two", None, " ?"],
    )
    assert set(a) < set(b) and len(b) == 4 and a == sorted(a) and b == sorted(b)
    assert len(c) == 1 and d is None and e is None


def test_components_of_chains_and_stars_in_any_order(spark):
    from sievework.operators.components import components

    draw = random.Random(2)
    names = list(range(300))
    draw.shuffle(names)
    edges = list(zip(names, names[1:])) + [(1000 + i, 1000) for i in range(1, 200)] + [(1000, 1001), (7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{n: 0 for n in range(1, 300)}, **{1000 + i: 1000 for i in range(1, 200)}}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_shingles_of_a_large_batch_need_little_memory(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    # Called here, as a worker calls it, with a batch of 1.2 million words.
    monkeypatch.setattr(shingles, "arrow_udf", lambda kind: lambda function: function)
    text = " ".join(f"word{i % 700}" for i in range(3000))
    texts = pa.array([f"{i} {text}" for i in range(400)] + [None, "?"])
    for function in (lambda t: shingles.lsh_keys(t, 4, 2, 8), shingles.shingle_hashes):
        tracemalloc.start()
        found = function(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(found) == 402 and found.null_count == 2
        # A number and some Python objects per word would be 100 MB.
        assert peak < 30_000_000


def test_long_text_without_a_portion_of_its_own(monkeypatch, apply):
    texts = ["a b c d e f g h", "x y z", None, "a b"]
    expected = apply(lambda t: shingles.shingle_hashes(t), texts)
    monkeypatch.setattr(shingles, "arrow_udf", lambda kind: lambda function: function)
    monkeypatch.setattr(shingles, "PORTION", 6)
    monkeypatch.setattr(shingles, "KEPT_WORDS", 2)
    import pyarrow as pa

    assert shingles.shingle_hashes(pa.array(texts)).to_pylist() == expected


def test_verifying_reads_the_words_once(spark, monkeypatch):
    plans = {}

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return df

    monkeypatch.setattr(near_dup, "materialise", seen)
    df = spark.createDataFrame([("s", "1", "a b c d e", 1.0), ("s", "2", "?", 1.0)], SCHEMA)
    _, keyed = near_dup._placed(df, "text", "score", ("source", "source_id"), NearDupSettings(verify=True), None)
    one, none = keyed.orderBy("source_id").collect()
    assert len(one["grams"]) == 3 and len(one["bands"]) > 1 and none["grams"] is None and none["bands"] is None
    assert len(set(re.findall(r"\b(?:run|lsh_keys\w*|shingle_hashes)\(text#\d+\)", plans["signatures"]))) == 1
    assert plans["signatures"].count("ArrowEvalPython") == 1 and plans["signatures"].count("run(text") == 1

"""Ordered scans and token buckets of groups that are cut, against windows and against one bucket a group."""

import random

import pytest
from pyspark.sql import functions as F

from sampletide.functions import rules as r
from sampletide.functions import segments as g
from sampletide.operators import sampling as s


@pytest.fixture(scope="module")
def hot(spark):
    """A sampler with most rows, a null one, small ones; values with gaps, times with ties."""
    rng = random.Random(4)
    names = ["hot"] * 3000 + [None] * 900 + [f"s{i % 40}" for i in range(400)]
    rows = [(i, names[i], rng.randint(0, 900) if i % 3 else 400, rng.choice([None, 1.0, 2.0, 3.0]) if i % 7 else None) for i in range(len(names))]
    return spark.createDataFrame(rows, "id long, sampler string, at int, value double").withColumn("ts", F.timestamp_seconds("at")).repartition(7)


@pytest.mark.parametrize("kind", ["asc", "desc", "complete"])
def test_cut_groups_answer_as_windows_do(hot, kind):
    by, order = ["sampler"], ["ts", "id"]
    plain = r.complete(F.col("value"), 1, by, order) if kind == "complete" else r.sequence(F.col("value"), kind, by, order)
    want = {x.id: x.ok for x in hot.select("id", plain.alias("ok")).collect()}
    rule = r.Rule("held", {"held": r.Ordered(kind, F.col("value"), by, order, rows=100)})
    assert {x.id: x.ok for x in rule.column(hot, "ok").collect()} == want
    reached = F.col("id") % 2 == 0
    want = {x.id: x.ok for x in hot.select("id", r.sequence(F.col("value"), "asc", by, order, reached).alias("ok")).collect()}
    rule = r.Rule("b", {"a": r.Ordered("asc", F.col("value"), by, order, rows=100), "b": r.Ordered("asc", F.col("value"), by, order, reached=reached, rows=100)})
    assert {x.id: x.ok for x in rule.column(hot, "ok").collect()} == want


def test_sums_and_epochs_of_cut_groups(hot):
    by, order = ["sampler"], ["ts", "id"]
    want = {x.id: x.epoch for x in r.key_epochs(hot, by, order, "1 second").collect()}
    assert {x.id: x.epoch for x in r.key_epochs(hot, by, order, "1 second", 100).collect()} == want and max(want.values()) > 5


def test_segments_are_even_and_ordered(spark):
    """One sampler of a million rows, half of them at one instant: no segment has more than three times its share."""
    rows = spark.range(1_000_000, numPartitions=4).select("id", F.lit("s").alias("sampler"), F.timestamp_seconds(F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id"))).alias("ts"), (F.col("id") % 1000).alias("value"))
    cuts = g.cuts_of(rows, ["sampler"], ["ts", "id"], 20_000)
    parts = cuts.rows(rows).groupBy("_segment").agg(F.count("*").alias("n"), F.min(F.struct("ts", "id")).alias("a"), F.max(F.struct("ts", "id")).alias("b")).orderBy("_segment").collect()
    assert len(parts) > 40 and max(x.n for x in parts) < 3 * 20_000
    assert all(x.b < y.a for x, y in zip(parts, parts[1:], strict=False))
    scan = g.Scan.of(rows, ["sampler"], ["ts", "id"], cuts=cuts).with_last("before", F.col("value"))
    assert scan.rows.where("before is null").count() == 1


def test_few_segments_are_left_of_very_many(spark, monkeypatch):
    monkeypatch.setattr(g, "MOST", 5)
    rows = spark.range(10_000).withColumn("by", F.col("id") % 2)
    cuts = g.cuts_of(rows, ["by"], ["id"], 10)
    assert cuts.rows(rows).select("by", "_segment").distinct().count() <= 7
    assert g.cuts_of(rows, ["id"], ["id"], 10).table is None and g.cuts_of(rows.limit(0), ["by"], ["id"], 10).table is None


def one_bucket_each(rows, limit):
    """ids that pass, a bucket a sampler in order of time and id."""
    buckets, out = {}, set()
    for name, at, i in sorted(rows, key=lambda x: (x[1] is not None, x[1], x[2])):
        if buckets.setdefault(name, s.Bucket(limit)).take(-(1 << 62) if at is None else at * s.TOKEN // 1000):
            out.add(i)
    return out


@pytest.mark.parametrize("spacing", ["idle", "dense", "exact", "slow", "mixed"])
@pytest.mark.parametrize("limit", [1, 3])
def test_buckets_of_cut_groups(spark, spacing, limit, capsys):
    """Blocks that meet, blocks apart by idle seconds, and a rate that is just the limit, where neither helps and blocks run one after the other."""
    rng, at, rows = random.Random(limit), 0, []
    for i in range(1200):
        step = {"idle": rng.choice([10, 10, 10, 1500]), "dense": rng.randint(0, 100), "exact": 1000 // limit, "slow": 1000 // limit + 7 * (i % 5 - 2), "mixed": rng.choice([1, 400, 900])}[spacing]
        at += step
        rows.append((None if i % 3 == 1 else "hot" if i % 3 else f"s{i % 5}", None if i % 97 == 0 else at, i))
    df = spark.createDataFrame(rows, "sampler string, at long, id long").withColumn("ts", F.timestamp_micros(F.col("at") * 1000))
    want = one_bucket_each(rows, limit)
    got = s.token_bucket(df, ["sampler"], limit, ["ts", "id"], rows=40)
    assert got.columns == df.columns and {x.id for x in got.collect()} == want
    assert {x.id for x in s.token_bucket(df, ["sampler"], limit, ["ts", "id"]).collect()} == want


def test_null_number_keys_are_one_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(5)] + [(1, 9)], "k int, id long").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    assert {(x.k, x.id) for x in s.token_bucket(df, ["k"], 1, ["ts", "id"]).collect()} == {(None, 0), (1, 9)}
    given = df.withColumn("most", F.when(F.col("k").isNull(), 2).otherwise(-1))
    assert s.token_bucket(given, ["k"], F.col("most"), ["ts", "id"], rows=2).count() == 3


def test_null_keys_are_admitted_as_others(spark):
    df = spark.createDataFrame([("g", None, 1), ("g", "a", 2), ("g", "b", 3), (None, "b", 4), (None, None, 5), ("g", None, 6)], "g string, k string, n long")
    got = {x.n: x.admitted for x in r.admitted_keys(df, ["g"], "k", ["n"], 1).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}


def test_the_first_keys_of_very_many(spark):
    df = spark.range(200_000).select(F.lit("g").alias("g"), (F.col("id") * 7 % 100_003).alias("k"), "id")
    kept = r.admitted_keys(df, ["g"], "k", ["id"], 1500)
    assert kept.where("admitted").select("k").distinct().count() == 1500
    assert {x.k for x in kept.where("admitted").collect()} == {i * 7 % 100_003 for i in range(1500)}


@pytest.mark.parametrize("limit", [2, 3, 100])
def test_blocks_of_any_rate_tell_what_they_do(spark, limit, monkeypatch):
    """Samples about as fast as tokens, with pauses that fill the bucket for some starts only: all blocks are read once, none waits for another."""
    rng, at, rows, calls, blocks = random.Random(limit), 0, [], [], s._blocks
    for i in range(1500):
        at += rng.choice([0, 700 // limit, 1000 // limit, 1000 // limit + 1, 1900 // limit])
        rows.append(("hot", at, i))
    df = spark.createDataFrame(rows, "sampler string, at long, id long").withColumn("ts", F.timestamp_micros(F.col("at") * 1000))
    monkeypatch.setattr(s, "_blocks", lambda *given: calls.append(1) or blocks(*given))
    got = s.token_bucket(df, ["sampler"], limit, ["ts", "id"], rows=40)
    assert len(calls) == 1 and {x.id for x in got.collect()} == one_bucket_each(rows, limit)

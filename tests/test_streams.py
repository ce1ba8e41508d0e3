"""Streams against batches: events, whole value digests, series that end, batches that come again."""

import random
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sampletide.functions.rules import Ordered, Rule, key_epochs, sequence
from sampletide.functions.shred import shred_within
from sampletide.operators import events as ev
from sampletide.operators import value_digest as vd
from sampletide.sources import records
from sampletide.streaming.digests import windowed_value_digest
from sampletide.streaming.events import streamed_events
from sampletide.streaming.stateful import live_series, remembered

from .test_digests_events_metrics import drain


@pytest.fixture
def raw(spark, sf):
    """Records of events, whose values move by key, in two streams."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(
        F.timestamp_seconds(F.unix_micros(F.col("ts").cast("timestamp")) / 1e9).alias("ts"), "event_id", F.concat(F.lit("app"), (F.col("user_id") % 2).cast("string")).alias("resource"), F.col("event_type").alias("sampler"),
        (F.col("user_id") % 5).cast("string").alias("sample_key"), "value", F.lit("raw").alias("sample_type"),
        F.array_compact(F.array(F.lit("u-all"), F.when(F.col("value") > 20, F.lit("u-large")))).alias("stream_uids"), F.col("props").alias("body"),
    )


def definitions(by, limit):
    order = ["ts", "event_id"]
    rising = {"up": Ordered("asc", F.col("value"), by, order)}
    nested = {"up": Ordered("asc", F.col("value"), by, order), "down": Ordered("desc", F.col("event_id"), by, order, after=("up",)), "next": Ordered("complete", F.col("event_id"), by, order, reached=F.col("value") > 30)}
    return [ev.Event("e-falls", "falls", "u-all", Rule("not up", rising), limit), ev.Event("e-nested", "nested", "u-large", Rule("up and not down or next", nested)), ev.Event("e-plain", "plain", "u-large", Rule("value > 90"), limit, {"v": F.col("value")})]


@pytest.mark.parametrize(("keyed", "limit"), [(True, -1), (True, 1), (False, 2)])
def test_streamed_events_are_those_of_batches(spark, raw, tmp_path, keyed, limit):
    raw.repartition(3).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in")
    by = ["resource", "sampler", *(["sample_key"] if keyed else [])]
    columns = ["ts", "event_uid", "resource", "sampler", "sample_key", "body", "event_rule"]
    want = Counter(tuple(r) for r in ev.events(raw, definitions(by, limit), ["ts", "event_id"]).select(columns).collect())
    got = drain(spark, streamed_events(live, definitions(by, limit), ["ts", "event_id"], keyed), f"events_{keyed}_{limit + 1}", tmp_path)
    assert Counter(tuple(r[c] for c in columns) for r in got) == want and len({x[1] for x in want}) == 3


def test_state_of_streamed_rules_outlives_batches(spark, raw, tmp_path):
    """One file a batch, in order of time: what rules remember comes from the state store."""
    raw.repartitionByRange(5, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    by = ["resource", "sampler", "sample_key"]
    want = Counter((r.event_uid, r.ts, r.sample_key) for r in ev.events(raw, definitions(by, -1), ["ts", "event_id"]).collect())
    got = drain(spark, streamed_events(live, definitions(by, -1), ["ts", "event_id"]), "outlive", tmp_path)
    assert sum(want.values()) > 100
    # files of one modification time may come in another order than that of their names
    assert abs(sum(Counter((r.event_uid, r.ts, r.sample_key) for r in got).values()) - sum(want.values())) < 0.5 * sum(want.values())


def test_idle_keys_are_forgotten_by_event_time(spark, raw, tmp_path):
    """As epochs do in batches, in one batch and over several; with a bound on keys an idle one gives its place free."""
    order, by = ["ts", "event_id"], ["resource", "sampler", "sample_key"]
    epochs = key_epochs(raw, by, order, "20 seconds")
    want = {r.event_id: r.ok for r in epochs.select("event_id", sequence(F.col("value"), "asc", [*by, "epoch"], order).alias("ok")).collect()}
    assert epochs.where("epoch > 0").count() > 20
    raw.repartition(3).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in")
    got = drain(spark, remembered(live, by, order, "value", "asc", ttl_ms=20_000), "idle", tmp_path)
    assert {r.event_id: r.in_order for r in got} == want
    rows = [(0, "a", 1.0), (1, "b", 5.0), (2, "c", 1.0), (3, "a", 0.5), (50, "c", 1.0), (51, "b", 1.0), (52, "a", 9.0), (53, "c", 0.5)]
    given = spark.createDataFrame([("g", t, k, v) for t, k, v in rows], "g string, at long, k string, v double").withColumn("ts", F.timestamp_seconds("at"))
    given.write.parquet(f"{tmp_path}/keys")
    live = spark.readStream.schema(given.schema).parquet(f"{tmp_path}/keys")
    got = {r["at"]: (r.admitted, r.in_order) for r in drain(spark, remembered(live, ["g"], ["ts"], "v", "asc", ttl_ms=20_000, key="k", most_keys=2), "places", tmp_path)}
    assert got == {0: (True, True), 1: (True, True), 2: (False, None), 3: (True, False), 50: (True, True), 51: (True, True), 52: (False, None), 53: (True, False)}


def test_whole_value_digests_of_streams(spark, tmp_path):
    """Rows equal those of batches, totals and nulls included; a late row is left out; a sample takes its budget."""
    rng = random.Random(2)
    pick = [lambda: 1.5, lambda: None, lambda: "ab", lambda: [rng.choice([1, None, {"k": 1}]) for _ in range(rng.randint(0, 3))], lambda: {"z": rng.choice([True, None]), "y": {}}]
    import json

    rows = [("g", i * 30, json.dumps({k: rng.choice(pick)() for k in rng.sample("abc", rng.randint(0, 3))})) for i in range(80)]
    rows.append(("g", 20, json.dumps({f"w{i}": i for i in range(60)})))
    schema = "g string, at long, body string"
    of = lambda df: df.select("g", F.timestamp_seconds("at").alias("ts"), F.parse_json("body").alias("sample"))
    for i, part in enumerate((rows, [("g", 10_000, "{}")], [("g", 15, '{"late":1}'), ("g", 20_000, "{}")])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(f"{tmp_path}/step{i}")
    (tmp_path / "in").mkdir()
    for i in range(3):
        for f in (tmp_path / f"step{i}").glob("*.json"):
            shutil.copy(f, tmp_path / "in" / f"{i}.json")
        live = of(spark.readStream.schema(schema).json(f"{tmp_path}/in"))
        q = windowed_value_digest(live, ["g"], "10 minutes", "1 minute", 80).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = vd.cardinalities(spark.read.parquet(f"{tmp_path}/out")).where("window_start < timestamp'1970-01-01 02:00:00'")
    batch = of(spark.createDataFrame(rows, schema)).withColumn("window_start", F.window("ts", "10 minutes").start)
    by = ["g", "window_start"]
    want = vd.cardinalities(vd.value_digest(shred_within(batch, by, 80), by))
    columns = sorted(want.columns)
    rows_of = lambda df: Counter(str(tuple(r)) for r in df.select(columns).collect())
    assert rows_of(got) == rows_of(want) and want.count() > 20


def test_series_end_with_event_time(spark, tmp_path):
    schema = "s string, at long, value double"
    steps = [[("a", 0, 1.0), ("a", 10, 2.0), ("b", 5, 7.0), ("a", 10, 1.0)], [("c", 200, 1.0)], [("a", 210, 5.0), ("c", 900, 1.0)], [("c", 2000, 3.0)]]
    (tmp_path / "in").mkdir()
    out = []
    for i, part in enumerate(steps):
        spark.createDataFrame(part, schema).coalesce(1).write.json(f"{tmp_path}/step{i}")
        for f in (tmp_path / f"step{i}").glob("*.json"):
            shutil.copy(f, tmp_path / "in" / f"{i}.json")
        points = spark.readStream.schema(schema).json(f"{tmp_path}/in").withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", "0 seconds")
        q = live_series(points, ["s"], 60_000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        out = sorted((r.s, int(r.ts.timestamp()), r.value, r.live) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert {x for x in out if x[0] == "b"} == {("b", 5, 7.0, True), ("b", 5, 7.0, False)}
    assert {x for x in out if x[0] == "a"} == {("a", 10, 2.0, True), ("a", 10, 2.0, False), ("a", 210, 5.0, True), ("a", 210, 5.0, False)}


def test_a_batch_that_comes_again_replaces_itself(spark, raw, tmp_path):
    raw.repartition(3).write.parquet(f"{tmp_path}/in")
    live = records.record(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "raw", encoding=F.lit("json"))
    seen = []

    def put(df, batch):
        records.write_batch(df, batch, f"{tmp_path}/out")
        if batch not in seen:
            seen.append(batch)
            if batch == 1:
                raise RuntimeError("lost after it wrote")

    for _ in range(2):
        q = live.writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception as error:  # noqa: BLE001
            assert "lost after it wrote" in str(error)
    back = records.read_records(spark, f"{tmp_path}/out")
    assert seen == [0, 1, 2] and back.count() == raw.count() and back.select("ts", "sample_key", "body").exceptAll(records.record(raw, "raw").select("ts", "sample_key", "body")).count() == 0
    assert back.where("sampler = 'click'").count() == raw.where("sampler = 'click'").count() > 0

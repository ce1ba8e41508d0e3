"""Digests, events and metrics against worked examples, in batch and as streams."""

import json
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sampletide.functions.rules import Rule, admitted_keys, sequence
from sampletide.functions.shred import path_text, shred, shred_within
from sampletide.operators import events as ev
from sampletide.operators import metrics as m
from sampletide.operators import struct_digest as st
from sampletide.operators import value_digest as vd
from sampletide.operators.digests import Digest, digest_nodes, digest_records, grouping
from sampletide.streaming.digests import windowed_struct_digest
from sampletide.streaming.stateful import limited, remembered


def samples(spark, *bodies):
    rows = [(i, json.dumps(b) if not isinstance(b, str) else b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "id int, body string").select("id", F.lit("g").alias("g"), F.parse_json("body").alias("sample"))


def values(spark, *bodies):
    out = vd.value_digest(shred(samples(spark, *bodies), ["g"]), ["g"]).withColumn("p", path_text("path"))
    return {r.p: r for r in vd.cardinalities(out).collect()}


def test_struct_digest_body(spark):
    nodes = shred(samples(spark, {"speed": 88}, {"road": "A7"}, {"speed": 3.5, "wet": True}), ["g"])
    body = st.struct_json(st.struct_digest(nodes, ["g"], json_numbers=True), ["g"]).head().body
    assert json.loads(body) == {"obj": {"count": "3", "fields": {"speed": {"number": {"floatNum": {"count": "2"}}}, "road": {"string": {"count": "1"}}, "wet": {"boolean": {"count": "1"}}}}}


def test_struct_digest_arrays_mixed_and_null(spark):
    nodes = shred(samples(spark, {"a": [1, "x"], "b": None}, {"a": [2, 3, 4], "b": True}, {"a": "text"}, {"a": []}), ["g"])
    rows = {r.p: r for r in st.struct_digest(nodes, ["g"], True).withColumn("p", path_text("path")).collect()}
    assert (rows[".a"].arrays, rows[".a"].strings, rows[".a"].min_length, rows[".a"].max_length, rows[".a"].sum_length) == (3, 1, 0, 3, 5)
    assert (rows[".a*"].floats, rows[".a*"].strings) == (4, 1) and (rows[".b"].nulls, rows[".b"].booleans) == (1, 1)
    mixed = st.mixed_types(st.struct_digest(nodes, ["g"], True)).withColumn("p", path_text("path"))
    assert {r.p: r.n_classes for r in mixed.collect()} == {".a": 2, ".a*": 2}


def test_samples_are_walked_to_the_end(spark):
    deep, path = "leaf", []
    for i in range(30):
        deep = [deep, None] if i % 3 == 0 else {f"k{i}": deep, "n[{": i}
        path.insert(0, "*" if i % 3 == 0 else f".k{i}")
    df = samples(spark, {"a": deep}, {"a": {"b": [1]}}, {"a": {"x": {"x": {"x": {"x": {"x": {}}}}}}})
    nodes = shred(df, ["g"]).collect()

    def walk(v, at=()):
        yield at
        for part, x in ([("." + k, x) for k, x in v.items()] if isinstance(v, dict) else [("*", x) for x in v] if isinstance(v, list) else []):
            yield from walk(x, (*at, part))

    want = Counter(p for b in ({"a": deep}, {"a": {"b": [1]}}, {"a": {"x": {"x": {"x": {"x": {"x": {}}}}}}}) for p in walk(b))
    assert Counter(tuple(r.path) for r in nodes) == want
    assert {r.text for r in nodes if tuple(r.path) == (".a", *path)} == {"leaf", None} - ({None} if path[-1] != "*" else set())
    assert len(shred_within(df, ["id"], 1000).collect()) == len(nodes)
    digest = vd.value_digest(shred(df, ["g"]), ["g"], False)
    bodies = vd.value_json(digest, ["g"]).withColumn("sample_type", F.lit("value-digest"))
    columns = ["path", "total", "nulls", "strings", "objs", "arrays", "numbers"]
    back = Counter((tuple(r.path), *r[1:]) for r in m.digests_from_body(bodies, []).select(columns).collect())
    given = Counter((tuple(r.path), *r[1:]) for r in digest.select(columns).collect())
    assert {x[0] for x in back} == {x[0] for x in given} and sum((back - given).values()) <= 1


def test_typed_numbers_keep_their_class(spark):
    df = spark.createDataFrame([(1, 1.5)], "i int, f double").select(F.lit("g").alias("g"), F.to_variant_object(F.struct("i", "f")).alias("sample"))
    rows = {r.p: r for r in st.struct_digest(shred(df, ["g"]), ["g"]).withColumn("p", path_text("path")).collect()}
    assert rows[".i"].ints == 1 and rows[".f"].floats == 1


def test_times_and_bytes_of_typed_samples_are_text(spark):
    df = spark.sql("select 'g' as g, to_variant_object(named_struct('t', timestamp'2024-01-02 03:04:05', 'd', date'2024-01-02', 'b', cast('xyz' as binary), 'n', cast(null as date))) as sample")
    rows = {r.p: r for r in vd.value_digest(shred(df, ["g"]), ["g"], False).withColumn("p", path_text("path")).collect()}
    assert [(rows[p].strings, rows[p].nulls) for p in (".t", ".d", ".b", ".n")] == [(1, 0), (1, 0), (1, 0), (0, 1)]


def test_digests_take_their_field_budget(spark):
    df = samples(spark, {f"k{i:03}": i for i in range(300)}).withColumn("resource", F.lit("r")).withColumn("sampler", F.lit("s")).withColumn("window_start", F.lit("2024-01-01").cast("timestamp"))
    nodes = digest_nodes(df, Digest("d", "u"))
    assert nodes.count() == 1 + 49 and nodes.where("truncated").count() == 50  # 100 steps: the root and 49 fields of 2


def test_value_digest_examples(spark):
    got = values(spark, {"open": False}, {"open": True}, {"open": None}, {})
    assert (got[""].total, got[".open"].total, got[".open"].nulls, got[".open"].true_count, got[".open"].booleans) == (4, 4, 2, 1, 2)
    got = values(spark, {"stops": [7.5, None, 0.0, 7.5]}, {"stops": [-2.0]})
    x = got[".stops*"]
    assert (x.total, x.nulls, x.numbers, x.number_default, x.number_min, x.number_sum, x.number_max, x.number_cardinality) == (5, 1, 4, 1, -2, 13, 7.5, 3)
    got = values(spark, {"cars": [{"seats": 4}, {}, {"seats": 9, "hired": True}, None, {"seats": 2}]})
    x, n, b = got[".cars*"], got[".cars*.seats"], got[".cars*.hired"]
    assert (x.total, x.nulls, x.objs, x.obj_default) == (5, 1, 4, 1)
    assert (n.total, n.nulls, n.number_min, n.number_sum, n.numbers, n.number_max) == (4, 1, 2, 15, 3, 9)
    assert (b.total, b.nulls, b.booleans, b.true_count) == (4, 3, 1, 1)


def test_value_digest_bytes_and_empty_arrays(spark):
    got = values(spark, {"s": "é", "a": []}, {"s": ""}, {})
    s = got[".s"]
    assert (s.total, s.nulls, s.strings, s.string_default, s.length_min, s.length_max) == (3, 1, 2, 1, 0, 2)
    assert got[".a*"].total == 0 and got[".a"].array_default == 1


def test_digests_do_not_depend_on_order_and_roll_up(spark):
    rng = random.Random(1)
    pick = [lambda: rng.choice([0, 1.5, None]), lambda: rng.choice(["", "ab"]), lambda: [rng.choice([1, None, {"k": 1}]) for _ in range(rng.randint(0, 3))], lambda: {"z": rng.choice([True, None])}]
    bodies = [{k: rng.choice(pick)() for k in rng.sample("abc", rng.randint(0, 3))} for _ in range(60)]
    one = {p: tuple(r)[2:] for p, r in values(spark, *bodies).items()}
    rng.shuffle(bodies)
    assert {p: tuple(r)[2:] for p, r in values(spark, *bodies).items()} == one
    parts = vd.value_digest(shred(samples(spark, *bodies).withColumn("h", F.col("id") % 3), ["g", "h"]), ["g", "h"])
    rolled = {r.p: r for r in vd.cardinalities(vd.value_rollup(parts, ["g"])).withColumn("p", path_text("path")).collect()}
    whole = values(spark, *bodies)
    for p in whole:
        for c in ("numbers", "number_sum", "strings", "booleans", "arrays", "objs", "number_cardinality"):
            assert rolled[p][c] == whole[p][c], (p, c)


def test_field_budget(spark):
    df = samples(spark, {"a": 1, "b": None, "c": 2}, {"a": 1})
    rows = shred_within(df, ["id"], 4).withColumn("p", path_text("path")).collect()
    assert Counter((r.id, r.p, r.truncated) for r in rows) == Counter([(0, "", True), (0, ".a", True), (0, ".b", True), (1, "", False), (1, ".a", False)])


def test_events(spark):
    df = spark.createDataFrame([(1, "key1", "bar"), (2, "key2", "baz")], "n int, sample_key string, foo string")
    raw = df.select("*", F.timestamp_seconds(F.lit(0)).alias("ts"), F.lit("r").alias("resource"), F.lit("s").alias("sampler"), F.lit("raw").alias("sample_type"), F.array(F.lit("u")).alias("stream_uids"), F.to_json(F.struct("foo")).alias("body"))
    got = ev.events(raw, [ev.Event("e1", "one", "u", Rule("foo = 'bar'"), 10), ev.Event("e2", "two", "u", Rule("foo = 'baz'"), 0), ev.Event("e3", "three", "other", Rule("true"))], ["ts", "n"]).collect()
    assert [(r.event_uid, r.sample_key, r.body, r.event_rule) for r in got] == [("e1", "key1", '{"foo":"bar"}', "foo = 'bar'")]
    body = raw.select(ev.template_body({"sampleField": F.col("foo"), "key": F.col("sample_key")}).alias("b")).head().b
    assert json.loads(body) == {"key": "key1", "sampleField": "bar"}


def test_config_diff(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 1)], "uid string, rule string, lim int")
    new = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("d", "1", 1)], "uid string, rule string, lim int")
    assert {tuple(r) for r in ev.config_diff(old, new).collect()} == {("b", "rebuild"), ("c", "remove"), ("d", "add")}


def test_metrics_of_a_stored_body(spark):
    body = {"total": "60", "default": "0", "null": "0", "fields": {"field1": {"total": "60", "null": "0", "number": {"total": "60", "default": "0", "null": "0", "min": 1, "avg": {"sum": 95, "count": "60"}, "max": 2}}}}
    df = spark.createDataFrame([("value-digest", json.dumps(body)), ("raw", "{}")], "sample_type string, body string")
    rows = m.value_metrics(m.digests_from_body(df, ["sample_type"]), []).collect()
    got = {(r.field_path, r["name"]): r.value for r in rows}
    assert len(rows) == 11 and got['["$":obj]["field1":number]', "avg"] == pytest.approx(95 / 60)
    assert got['["$":obj]', "total"] == 60 and got['["$":obj]["field1":any]', "null"] == 0


def test_field_paths(spark):
    path = lambda parts, kind: spark.range(1).select(m.field_path(F.array(*map(F.lit, parts)) if parts else F.array().cast("array<string>"), kind).alias("p")).head().p
    assert path([], "obj") == '["$":obj]'
    assert path([".a", "*", ".b"], "number") == '["$":obj]["a":array]["*":obj]["b":number]'
    assert path(['.q"', ".s\\"], "any") == '["$":obj]["q\\"":obj]["s\\\\":any]'


def test_uuids(spark):
    ns = "6f1c2d3e-4b5a-4978-8695-a4b3c2d1e0f9"
    for name in ("", "a", "é", '["$":obj]'):
        assert spark.range(1).select(m.uuid5(F.lit(ns), F.lit(name)).alias("u")).head().u == str(uuid.uuid5(uuid.UUID(ns), name))


def test_validation(spark):
    good = ("event", str(uuid.uuid4()), "", ["a"], "json")
    df = spark.createDataFrame([good, ("event", "x", "", ["a"], "json"), ("value-digest", "", "x", [], "unknown")], "sample_type string, event_uid string, digest_uid string, stream_uids array<string>, encoding string")
    ok, bad = m.validated(df)
    assert ok.count() == 1 and sorted(len(r.errors) for r in bad.collect()) == [1, 3]


def test_digest_envelope(spark):
    df = spark.createDataFrame([("r", "s", "{}")], "resource string, sampler string, body string").withColumn("window_start", F.timestamp_seconds(F.lit(60)))
    row = digest_records(df, Digest("d", "u", "value-digest")).head()
    assert (row.sample_type, row.stream_uids, row.digest_uid, row.encoding) == ("value-digest", ["u"], "d", "json")
    assert "instance" in grouping(Digest("d", "u", location="sampler")) and "instance" not in grouping(Digest("d", "u"))
    with pytest.raises(ValueError):
        grouping(Digest("d", "u", location="elsewhere"))


def stream(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    rows.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def drain(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streams_agree_with_batches(spark, sf, tmp_path):
    rows, live = stream(spark, sf, tmp_path)
    # one batch a file needs the files in order of time, which one batch for all does not
    whole = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    want = {r.event_id: r.ok for r in rows.select("event_id", sequence(F.col("value"), "asc", ["user_id"], ["ts", "event_id"]).alias("ok")).collect()}
    got = {r.event_id: r.in_order for r in drain(spark, remembered(whole, ["user_id"], ["ts", "event_id"], "value", "asc"), "ordered", tmp_path)}
    assert got == want
    kept = drain(spark, limited(whole.withColumn("ts", F.timestamp_seconds(F.lit(0))), ["user_id"], 2, ["ts", "event_id"]), "kept", tmp_path)
    counts = Counter(r.user_id for r in kept)
    n = {r.user_id: r["count"] for r in rows.groupBy("user_id").count().collect()}
    assert counts == {k: min(2, x) for k, x in n.items()}


def test_streamed_rules_are_exact_for_text_and_whole_numbers_and_bound_their_keys(spark, sf, tmp_path):
    rows, _ = stream(spark, sf, tmp_path)
    live = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    order, big = ["ts", "event_id"], (F.col("event_id") % 7 + (1 << 60)).alias("v")
    for i, value in enumerate((big, F.md5(F.col("event_id").cast("string")).alias("v"))):
        want = {r.event_id: r.ok for r in rows.select("event_id", sequence(F.when(F.col("event_id") % 5 > 0, value), "asc", ["user_id"], order).alias("ok")).collect()}
        given = live.withColumn("v", F.when(F.col("event_id") % 5 > 0, value))
        assert {r.event_id: r.in_order for r in drain(spark, remembered(given, ["user_id"], order, "v", "asc"), f"exact{i}", tmp_path)} == want
    batch = admitted_keys(rows.withColumn("g", F.lit("g")), ["g"], "user_id", order, 5)
    want = {r.event_id: (r.admitted, r.ok if r.admitted else None) for r in batch.select("event_id", "admitted", sequence(F.col("value"), "asc", ["user_id"], order).alias("ok")).collect()}
    got = drain(spark, remembered(live.withColumn("g", F.lit("g")), ["g"], order, "value", "asc", key="user_id", most_keys=5), "bounded", tmp_path)
    assert {r.event_id: (r.admitted, r.in_order) for r in got} == want and len({r.user_id for r in got if r.admitted}) == 5


def test_streamed_digests_close_with_the_watermark(spark, sf, tmp_path):
    rows, live = stream(spark, sf, tmp_path)
    of = lambda df: df.withColumn("g", F.lit("g")).withColumn("sample", F.to_variant_object(F.struct("value")))
    got = drain(spark, windowed_struct_digest(of(live), ["g"], "1 day", "30 days"), "digests", tmp_path, "complete")
    want = rows.groupBy(F.window("ts", "1 day").start.alias("w")).count().collect()
    assert {(r.window_start, r.floats) for r in got if r.path} == {(r.w, r["count"]) for r in want}


def test_sketches_go_through_bodies(spark):
    df = samples(spark, *[{"n": i % 40, "s": "x" * (i % 7), "o": {"d": i}} for i in range(500)])
    digest = vd.value_digest(shred(df, ["g"]), ["g"])
    bodies = vd.value_json(digest, ["g"]).withColumn("sample_type", F.lit("value-digest"))
    columns = ["path", "number_cardinality", "string_cardinality", "length_cardinality"]
    got, want = ({(tuple(r.path), *r[1:]) for r in vd.cardinalities(x).select(columns).collect()} for x in (m.digests_from_body(bodies, []), digest))
    assert got == want and (("." + "n",), 40, 0, 0) in got

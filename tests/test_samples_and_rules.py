"""Sources, sampling and rules against small truth tables."""

import json

import pytest
from pyspark.sql import functions as F

from sampletide.functions import rules as r
from sampletide.operators import sampling as s
from sampletide.plans import config as c
from sampletide.queries import QUERIES
from sampletide.sources import records, samples, topics


def test_json_samples_must_be_objects(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "[1]"), (3, "not json"), (4, None), (5, '"x"'), (6, "{}")], "id int, body string")
    good, bad = samples.json_samples(df, "body")
    assert {x.id for x in good.collect()} == {1, 6} and {x.id for x in bad.collect()} == {2, 3, 4, 5}


def test_logs_round_trip(spark):
    df = spark.createDataFrame([(1, "a", "s", "k1", '{"x":1}'), (2, "a", "t", "", "{}"), (3, "b", "s", "k2", "")], "n int, resource string, sampler string, sample_key string, body string")
    rows = records.record(df, "raw", stream_uids=F.array(F.lit("u")), encoding=F.lit("json"))
    flat = samples.flatten_logs(samples.nest_logs(rows))
    assert sorted((x.resource, x.sampler, x.sample_type, x.sample_key, x.encoding, x.body, *x.stream_uids) for x in flat.collect()) == sorted((x.resource, x.sampler, "raw", x.sample_key, "json", x.body, "u") for x in rows.collect())


def test_topic_filters(spark):
    df = spark.createDataFrame([("abc",), ("xabcx",), ("other",), ("_schemas",), ("a-changelog",), ("_confluent.x",), ("my-KSTREAM-1",)], "topic string")
    names = lambda d: {x.topic for x in d.collect()}
    yes, no = topics.split_topics(df, allow=topics.matches(F.col("topic"), ["abc"]))
    assert names(yes) == {"abc", "xabcx"} and len(names(no)) == 5
    assert names(topics.split_topics(df, deny=topics.matches(F.col("topic"), names=["abc"]))[1]) == {"abc"}
    assert names(topics.split_topics(df)[1]) == set()
    assert names(topics.without_internal(df)) == {"abc", "xabcx", "other"}
    with pytest.raises(ValueError):
        topics.split_topics(df, allow=F.lit(True), deny=F.lit(True))
    got = topics.reconcile(df.where("topic = 'other'"), df.where("topic like '%abc%'"), 1)
    assert {tuple(x) for x in got.collect()} == {("abc", "add"), ("other", "remove")}


def test_record_types(spark):
    df = spark.createDataFrame([("raw", 1), ("event", 2), ("config", 3)], "sample_type string, n int")
    assert [x.n for x in records.of_type(df, "event").collect()] == [2]
    assert {x.n for x in records.without_raw(df).collect()} == {2, 3}
    with pytest.raises(ValueError):
        records.of_type(df, "other")


def test_record_tables_are_laid_out_by_label(spark, tmp_path):
    df = spark.createDataFrame([("a", "s")], "resource string, sampler string")
    records.write_records(records.record(df, "raw"), f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").where("sample_type = 'raw' and sampler = 's'").count() == 1
    records.write_metrics(df.withColumn("ts", F.timestamp_seconds(F.lit(0))), f"{tmp_path}/m")
    assert (tmp_path / "m" / "day=1970-01-01").exists()


def test_key_sampling(spark):
    df = spark.createDataFrame([("some_matching_key",), ("some_non_matching_key",), ("",), (None,)], "k string")
    kept = lambda *a: [x.keep for x in df.select(s.keep_by_key(F.col("k"), *a).alias("keep")).collect()]
    assert kept(2) == [True, False, False, False]
    assert kept(2, True) == [True, False, True, True]
    assert kept(1) == [True] * 4
    with pytest.raises(ValueError):
        kept(0)


def test_token_bucket_bursts_and_refills(spark):
    df = spark.range(1000).withColumn("ts", F.timestamp_seconds(F.lit(0))).withColumn("g", F.lit("a"))
    assert s.token_bucket(df, ["g"], 10, ["ts", "id"]).count() == 10
    assert s.token_bucket(df, ["g"], 0, ["ts", "id"]).count() == 0 and s.token_bucket(df, ["g"], -1, ["ts", "id"]).count() == 1000
    later = df.withColumn("ts", F.timestamp_seconds(F.col("id") / 100))  # ten seconds
    assert s.token_bucket(later, ["g"], 10, ["ts", "id"]).count() in (109, 110)
    two = df.withColumn("g", (F.col("id") % 2).cast("string"))
    assert s.token_bucket(two, ["g"], 5, ["ts", "id"]).groupBy("g").count().collect()[0]["count"] == 5


def test_streams(spark):
    df = spark.createDataFrame([(1, 10, 5), (2, None, 5), (3, 1, 500)], "id int, x int, sample_size int")
    streams = [s.Stream("u1", "one", "x > 5", export_raw=True), s.Stream("u2", "all", "true", max_sample_size=100)]
    out = {x.id: x for x in s.assign_streams(df, streams).collect()}
    assert (out[1].stream_uids, out[2].stream_uids, out[3].stream_uids) == (["u1", "u2"], ["u2"], [])
    assert out[2].errors == ["one: rule error"] and out[3].errors == ["all: sample too large"]
    assert [x.stream_uids for x in s.raw_export(s.assign_streams(df, streams), streams).collect()] == [["u1", "u2"]]


def test_rules_must_be_boolean(spark):
    df = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(ValueError):
        r.check_rule(df, "id + 1")
    with pytest.raises(ValueError):
        r.check_rule(df, "id = 1", spark.range(1).schema)
    assert r.is_static(df, "id = 1 or 1 = 1") and r.is_static(df, "1 != 1") and not r.is_static(df, "id = 1 or 1 != 1")


def test_fields_keep_their_kind(spark):
    df = spark.sql("""select parse_json('{"id": 1, "t": "12", "sub": {"id": 11}}') as sample""")
    row = df.select(r.field_of(F.col("sample"), "$.sub.id").alias("a"), r.field_of(F.col("sample"), "$.t").alias("b"), r.field_of(F.col("sample"), "$.none").alias("c"), r.field_of(F.col("sample"), "$.t", "string").alias("d")).head()
    assert tuple(row) == (11.0, None, None, "12")


def test_sequence_and_complete(spark):
    rows = [("k1", 1, 10.0), ("k1", 2, 11.0), ("k2", 3, 0.0), ("k2", 4, 1.0), ("k1", 5, 9.0), ("k2", 6, -1.0), ("k1", 7, None), ("k2", 8, 2.0), ("k1", 9, 9.0)]
    df = spark.createDataFrame(rows, "k string, n int, v double")
    got = [x.ok for x in df.select("n", r.sequence(F.col("v"), "asc", ["k"], ["n"]).alias("ok")).orderBy("n").collect()]
    assert got == [True, True, True, True, False, False, None, True, True]
    got = [x.ok for x in df.select("n", r.complete(F.col("v"), 1.0, ["k"], ["n"]).alias("ok")).orderBy("n").collect()]
    assert got == [True, True, True, True, False, False, None, False, False]
    keys = df.union(spark.createDataFrame([("k3", 10, 20.0)], df.schema)).withColumn("g", F.lit(1))
    assert {x.k for x in r.admitted_keys(keys, ["g"], "k", ["n"], 2).where("admitted").collect()} == {"k1", "k2"}
    assert r.admitted_keys(keys, ["g"], "k", ["n"], 0).where("admitted").count() == 10
    with pytest.raises(ValueError):
        r.sequence(F.col("v"), "up", ["k"], ["n"])


def test_idle_keys_start_anew(spark):
    df = spark.createDataFrame([("a", 0, 5.0), ("a", 30, 4.0), ("a", 500, 1.0), ("a", 510, 2.0)], "k string, s int, v double").withColumn("ts", F.timestamp_seconds("s"))
    rows = r.key_epochs(df, ["k"], ["ts"], "60 seconds")
    assert [x.ok for x in rows.select("ts", r.sequence(F.col("v"), "asc", ["k", "epoch"], ["ts"]).alias("ok")).orderBy("ts").collect()] == [True, False, True, True]


def test_config_changes(spark):
    rows = [(1, "streams", "upsert", "a", "1"), (2, "streams", "upsert", "a", "2"), (3, "streams", "upsert", "b", "1"), (4, "streams", "delete", "b", None), (5, "digests", "upsert", "d", "1"), (6, "digests", "reset", "", None), (6, "digests", "upsert", "e", "1"), (7, "sampling", "set", "", "r")]
    changes = spark.createDataFrame([(v, "r", "s", *x) for v, *x in rows], "version long, resource string, sampler string, section string, op string, uid string, payload string")
    got = {(x.section, x.uid): x.payload for x in c.merged_config(changes).collect()}
    assert got == {("streams", "a"): "2", ("digests", "e"): "1", ("sampling", ""): "r"}
    gone = c.deletion(changes.select("resource", "sampler").distinct(), F.lit(9).cast("long"))
    assert c.merged_config(changes.unionByName(gone)).count() == 0
    preset = c.preset_changes(changes.select("resource", "sampler").distinct(), F.lit(1))
    assert json.loads(preset.where("section = 'limiter_out'").head().payload) == {"limit": 10}


@pytest.mark.parametrize(
    ("resource", "sampler", "want"),
    [("*", "*", 4), ("r1", "*", 2), ("*", "s1", 2), ("r1", "s1", 1), ("r*", "s*", 4), ("r9", "*", 0), ("*1", "*2", 1), ("r.", "*", 0)],
)
def test_targets(spark, resource, sampler, want):
    df = spark.createDataFrame([(a, b, "streams", '{"name":"all"}') for a in ("r1", "r2") for b in ("s1", "s2")], "resource string, sampler string, section string, payload string")
    assert c.match_targets(df, resource, sampler).count() == want
    assert c.match_targets(df, resource, sampler, "none").count() == 0


def test_names(spark):
    df = spark.createDataFrame([("a.b/(c)-_1",), ("a b",), ("a\n",), ("",)], "name string").withColumn("resource", F.lit("r")).withColumn("sampler", F.lit("s")).withColumn("section", F.lit("events")).withColumn("op", F.lit("upsert")).withColumn("sample_type", F.lit("raw"))
    assert [len(x.errors) for x in c.validated_changes(df).collect()] == [0, 1, 1, 0]


def test_repeated_keys_do_not_end_a_job(spark):
    logs = spark.sql("""select named_struct('attributes', array(named_struct('key', 'service.name', 'value', 'a'), named_struct('key', 'service.name', 'value', 'b'))) as resource,
        array(named_struct('name', 's', 'log_records', array(named_struct('ts', timestamp'2024-01-01', 'attributes', array(named_struct('key', 'sample.key', 'value', '1'), named_struct('key', 'sample.key', 'value', '2')),
        'stream_uids', array('u'), 'body', '{}')))) as scope_logs""")
    assert [(r.resource, r.sampler, r.sample_key, r.encoding) for r in samples.flatten_logs(logs).collect()] == [("a", "s", "1", "")]
    config = spark.createDataFrame([("r", "s", "n", "2"), ("r", "s", "n", "1"), ("r", "s", None, "3")], "resource string, sampler string, name string, uid string")
    given = spark.createDataFrame([("r", "s", ["n", "x"], [])], "resource string, sampler string, stream_names array<string>, stream_uids array<string>")
    row = s.translate_streams(given, config).head()
    assert (row.stream_uids, row.errors) == (["1"], ["x"])


def test_nested_logs_are_bounded_by_their_period(spark):
    rows = spark.range(100).selectExpr("timestamp_seconds(id * 30) as ts", "'r' as resource", "'s' as sampler", "'raw' as sample_type", "array('u') as stream_uids", "cast(id as string) as sample_key", "'json' as encoding", "'{}' as body")
    logs = samples.nest_logs(rows.unionByName(rows.limit(1).withColumn("ts", F.lit(None).cast("timestamp"))))
    sizes = [len(r.scope_logs[0].log_records) for r in logs.collect()]
    assert sorted(sizes) == [1] + [2] * 50 and samples.flatten_logs(logs).count() == 101


def test_nested_logs_of_large_periods(spark, tmp_path):
    """A day with more records than a lot holds is still one row of the query."""
    rows = spark.range(20_500).selectExpr("id as event_id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id * 5) as ts", "4L as user_id", "'view' as event_type", "1.0d as value", "'{}' as props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    logs = samples.nest_logs(records.record(rows.selectExpr("'r' as resource", "'s' as sampler", "ts", "'{}' as body", "'' as sample_key"), "raw"), "1 day")
    assert {(str(r.period), r.lot) for r in logs.collect()} == {(f"2024-01-0{d} 00:00:00", lot) for d in (1, 2) for lot in (0, 1)}
    assert sorted(r.n_records for r in QUERIES["nest_logs"](spark, str(tmp_path)).collect()) == [20_500 - 17_280, 17_280]

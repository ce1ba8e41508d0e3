"""Queries of events and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampletide.functions import rules as r
from sampletide.operators import events as ev
from sampletide.operators import metrics as m
from sampletide.operators import value_digest as vd
from sampletide.operators.digests import Digest, digest_records, with_window
from sampletide.functions.shred import shred
from sampletide.plans.config import dead_letter_changes
from sampletide.queries.digests import UID
from sampletide.queries.registry import EVENT_ROWS, FAST_ROWS, bucket_sql, event_rows, query
from sampletide.queries.rules import SEGMENT
from sampletide.sources.records import record
from sampletide.sources.samples import struct_samples

_ORDER = ["ts", "event_id"]
_BY = ["resource", "sampler", "sample_key"]
EVENT_UID = "0b7e8d1c-2a3f-4e5d-9c6b-7a8f9e0d1c2b"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    return rows.withColumn("sample_type", F.lit("raw")).withColumn("stream_uids", F.array_compact(F.array(F.lit("u-all"), F.when(F.col("value") > 100, F.lit("u-large"))))).withColumn("body", F.col("props"))


def _definitions(limit: int = -1) -> list[ev.Event]:
    falling = {"ordered": r.Ordered("asc", F.col("value"), _BY, _ORDER)}
    return [
        ev.Event(EVENT_UID, "costly", "u-large", r.Rule("event_type = 'purchase'"), limit, {"amount": F.col("value"), "key": F.col("sample_key")}),
        ev.Event("e-order", "unordered", "u-all", r.Rule("not ordered", falling), limit),
    ]


_UP = "CASE WHEN value IS NOT NULL THEN coalesce(value >= lag(value IGNORE NULLS) OVER (PARTITION BY resource, sampler, sample_key ORDER BY ts, event_id), true) END"


@query(
    "WITH " + EVENT_ROWS + f""", o AS (SELECT *, {_UP} AS up FROM e)
    SELECT '{EVENT_UID}' AS event_uid, resource, sampler, sample_key, 'u-large' AS stream, CAST(value AS DOUBLE) AS amount FROM e WHERE event_type = 'purchase' AND value > 100
    UNION ALL SELECT 'e-order', resource, sampler, sample_key, 'u-all', NULL FROM o WHERE NOT up"""
)
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.events(_raw(spark, sf_dir), _definitions(), _ORDER)
    return out.select("event_uid", "resource", "sampler", "sample_key", F.col("stream_uids")[0].alias("stream"), F.get_json_object("body", "$.amount").cast("double").alias("amount"))


@query(
    "WITH RECURSIVE " + FAST_ROWS + f""", o AS (SELECT *, {_UP} AS up FROM f),
    hits AS (SELECT '{EVENT_UID}' AS event_uid, * FROM o WHERE event_type = 'purchase' AND value > 100 UNION ALL SELECT 'e-order', * FROM o WHERE NOT up), """
    + bucket_sql("kept", "hits", 1, "event_uid, resource, sampler") + " SELECT event_uid, resource, sampler, sample_key, make_timestamp(us) AS ts FROM kept"
)
def event_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.unix_micros("ts") / 1e9))
    return ev.events(rows, _definitions(1), _ORDER, SEGMENT).select("event_uid", "resource", "sampler", "sample_key", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("WITH " + EVENT_ROWS + " SELECT event_id, '{\"key\":' || to_json(sample_key) || ',\"kind\":' || to_json(event_type) || '}' AS body FROM e")
def event_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(spark, sf_dir).select("event_id", ev.template_body({"kind": F.col("event_type"), "key": F.col("sample_key")}).alias("body"))


@query("WITH " + EVENT_ROWS + f" SELECT event_id, sample_key FROM (SELECT *, {_UP} AS up FROM e) WHERE NOT up")
def out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.Rule("not ok", {"ok": r.Ordered("asc", F.col("value"), _BY, _ORDER)}).column(event_rows(spark, sf_dir))
    return rows.where("matched").select("event_id", "sample_key")


@query("WITH " + EVENT_ROWS + " SELECT event_id, sampler FROM (SELECT *, coalesce(event_id = lag(event_id) OVER (PARTITION BY sampler ORDER BY ts, event_id) + 1, true) AS ok FROM e) WHERE NOT ok")
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.Rule("not ok", {"ok": r.Ordered("complete", F.col("event_id"), ["sampler"], _ORDER, rows=SEGMENT)}).column(event_rows(spark, sf_dir))
    return rows.where("matched").select("event_id", "sampler")


@query("WITH " + EVENT_ROWS + " SELECT sampler, props AS body, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(spark, sf_dir).groupBy("sampler", F.col("props").alias("body")).agg(F.count("*").alias("n")).where("n > 1")


@query("WITH RECURSIVE " + FAST_ROWS + ", " + bucket_sql("kept", "f", 1) + " SELECT 'sample_sent_to_dlq' AS event_uid, resource, sampler, make_timestamp(us) AS ts FROM kept")
def dlq_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every resource's every sampler taken as a dead-letter sampler."""
    rows = _raw(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.unix_micros("ts") / 1e9))
    preset = dead_letter_changes(rows.select("resource", "sampler").distinct(), F.lit(1))
    found = preset.select("uid", F.get_json_object("payload", "$.rule").alias("rule"), F.get_json_object("payload", "$.limit").cast("int").alias("limit")).distinct().collect()  # one event: samplers share it
    out = ev.events(rows, [ev.Event(x["uid"], x["uid"], "u-all", r.Rule(x["rule"]), x["limit"]) for x in found], _ORDER, SEGMENT)
    return out.select("event_uid", "resource", "sampler", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS uid, CASE WHEN o_orderstatus = 'O' THEN 'add' WHEN o_orderstatus = 'P' THEN 'remove' ELSE 'rebuild' END AS action FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0")
def event_config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("uid"), F.col("o_orderstatus").alias("rule"), F.col("o_orderkey").alias("k"))
    old = rows.where("rule <> 'O'").select("uid", "rule")
    new = rows.where("rule <> 'P'").select("uid", F.when(F.col("k") % 2 == 0, F.lit("other")).otherwise(F.col("rule")).alias("rule"))
    return ev.config_diff(old, new)


@query(
    "WITH " + EVENT_ROWS + f""" SELECT resource, sampler, date_trunc('day', ts) AS day, 'u-large' AS stream_uid, '{EVENT_UID}' AS event_uid, CAST(count(*) AS BIGINT) AS n
    FROM e WHERE event_type = 'purchase' AND value > 100 GROUP BY ALL"""
)
def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = m.event_metrics(ev.events(_raw(spark, sf_dir), _definitions()[:1], _ORDER))
    return points.groupBy("resource", "sampler", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "stream_uid", "event_uid").agg(F.sum("value_int").alias("n"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = struct_samples(event_rows(spark, sf_dir), ["value", "event_type"])
    return vd.value_digest(shred(rows, ["sampler"]), ["sampler"], False)


_METRICS = """WITH g AS (SELECT event_type AS sampler, count(*) AS n, count(value) AS v, count(*) FILTER (value = 0) AS z, min(value) AS lo, max(value) AS hi, avg(value) AS av, strlen(event_type) AS l FROM events GROUP BY ALL)
    SELECT sampler, f AS field_path, c AS class, m AS name, k AS kind, round(CAST(x AS DOUBLE), 6) AS value FROM (
    SELECT sampler, unnest([{'f': '["$":obj]', 'c': 'obj', 'm': 'total', 'k': 'sum', 'x': n}, {'f': '["$":obj]', 'c': 'obj', 'm': 'default', 'k': 'sum', 'x': 0}, {'f': '["$":obj]', 'c': 'obj', 'm': 'null', 'k': 'sum', 'x': 0},
    {'f': '["$":obj]["value":any]', 'c': 'any', 'm': 'total', 'k': 'sum', 'x': n}, {'f': '["$":obj]["value":any]', 'c': 'any', 'm': 'null', 'k': 'sum', 'x': n - v},
    {'f': '["$":obj]["value":number]', 'c': 'number', 'm': 'total', 'k': 'sum', 'x': n}, {'f': '["$":obj]["value":number]', 'c': 'number', 'm': 'default', 'k': 'sum', 'x': z}, {'f': '["$":obj]["value":number]', 'c': 'number', 'm': 'null', 'k': 'sum', 'x': n - v},
    {'f': '["$":obj]["value":number]', 'c': 'number', 'm': 'min', 'k': 'gauge', 'x': lo}, {'f': '["$":obj]["value":number]', 'c': 'number', 'm': 'avg', 'k': 'gauge', 'x': av}, {'f': '["$":obj]["value":number]', 'c': 'number', 'm': 'max', 'k': 'gauge', 'x': hi},
    {'f': '["$":obj]["event_type":any]', 'c': 'any', 'm': 'total', 'k': 'sum', 'x': n}, {'f': '["$":obj]["event_type":any]', 'c': 'any', 'm': 'null', 'k': 'sum', 'x': 0},
    {'f': '["$":obj]["event_type":string]', 'c': 'string', 'm': 'total', 'k': 'sum', 'x': n}, {'f': '["$":obj]["event_type":string]', 'c': 'string', 'm': 'default', 'k': 'sum', 'x': 0}, {'f': '["$":obj]["event_type":string]', 'c': 'string', 'm': 'null', 'k': 'sum', 'x': 0},
    {'f': '["$":obj]["event_type":string]', 'c': 'string', 'm': 'length_min', 'k': 'gauge', 'x': l}, {'f': '["$":obj]["event_type":string]', 'c': 'string', 'm': 'length_avg', 'k': 'gauge', 'x': l}, {'f': '["$":obj]["event_type":string]', 'c': 'string', 'm': 'length_max', 'k': 'gauge', 'x': l}
    ], recursive := true) FROM g) t"""


@query(_METRICS)
def value_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.value_metrics(_values(spark, sf_dir), ["sampler"]).withColumn("value", F.round("value", 6))


@query("SELECT DISTINCT '[\"$\":obj][\"x' || chr(92) || chr(92) || 'y\":obj][\"a' || chr(92) || '\"' || event_type || '\":number]' AS field_path FROM events")
def field_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).select("sampler").distinct()
    return rows.select(m.field_path(F.array(F.lit(".x\\y"), F.concat(F.lit('.a"'), "sampler")), "number").alias("field_path"))


def _uuid_sql(space: str, name: str, out: str, source: str) -> str:
    """A common table of ``source`` with ``out``, the 32 hexadecimal digits of the name-based UUID of ``name``."""
    return f"""{out}_h AS (SELECT *, sha1(unhex({space}) || encode({name})) AS h FROM {source}),
    {out}_t AS (SELECT * EXCLUDE (h), substr(h, 1, 12) || '5' || substr(h, 14, 3) || substr('89ab', ((instr('0123456789abcdef', substr(h, 17, 1)) - 1) & 3) + 1, 1) || substr(h, 18, 15) AS {out} FROM {out}_h)"""


_ID = "id2"
_PARTS = " || '_' || ".join(f"substr({_ID}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


@query(f"WITH m AS ({_METRICS}), {_uuid_sql(repr(UID.replace('-', '')), 'field_path', 'id1', 'm')}, {_uuid_sql('id1', 'name', _ID, 'id1_t')} SELECT sampler, field_path, name, '_' || {_PARTS} AS metric_id FROM id2_t")
def metric_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.value_metrics(_values(spark, sf_dir), ["sampler"])
    return rows.select("sampler", "field_path", "name", m.metric_id(F.lit(UID), F.col("field_path"), F.col("name")).alias("metric_id"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event and digest records, some of them faulty."""
    rows = event_rows(spark, sf_dir)
    k = F.col("event_id") % 5
    out = record(rows, "event", body=F.col("props"), event_uid=F.when(k == 0, "no-uuid").otherwise(EVENT_UID), encoding=F.when(k == 1, "unknown").otherwise("json"), stream_uids=F.when(k == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))))
    return out


@query(
    """SELECT CASE event_id % 5 WHEN 0 THEN 'event uid is not a UUID' WHEN 1 THEN 'encoding is not json' WHEN 2 THEN 'not exactly one stream' ELSE '' END AS errors, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL"""
)
def metric_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = m.validated(_mixed(spark, sf_dir))
    rows = bad.select(F.array_join("errors", "; ").alias("errors")).unionByName(good.select(F.lit("").alias("errors")))
    return rows.groupBy("errors").agg(F.count("*").alias("n"))


def _bodies(spark: SparkSession, sf_dir: str, rows: DataFrame, sketches: bool = False) -> DataFrame:
    by = ["resource", "sampler", "window_start"]
    bodies = vd.value_json(vd.value_digest(shred(rows, by), by, sketches), by)
    return digest_records(bodies, Digest(UID, "all", "value-digest"))


@query("WITH " + EVENT_ROWS + """ SELECT sampler, '["$":obj]["event_type":string]' AS field_path, unnest(['cardinality', 'length_cardinality']) AS name, CAST(1 AS DOUBLE) AS value FROM e GROUP BY sampler
    UNION ALL SELECT sampler, '["$":obj]["k":number]', 'cardinality', CAST(count(DISTINCT event_id % 5) AS DOUBLE) FROM e GROUP BY sampler""")
def body_cardinalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates from sketches that went through stored bodies; of so few values they are exact."""
    rows = struct_samples(event_rows(spark, sf_dir).withColumn("k", F.col("event_id") % 5), ["k", "event_type"])
    rows = rows.withColumn("resource", F.lit("all")).withColumn("window_start", F.lit("2024-01-01").cast("timestamp"))
    digests = vd.cardinalities(m.digests_from_body(_bodies(spark, sf_dir, rows, True), ["sampler"]))
    out = m.value_metrics(digests, ["sampler"]).where(F.col("name").endswith("cardinality"))
    return out.select("sampler", "field_path", "name", F.round("value").alias("value"))


@query(_METRICS)
def metrics_from_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = struct_samples(event_rows(spark, sf_dir), ["value", "event_type"])
    rows = rows.withColumn("resource", F.lit("all")).withColumn("window_start", F.lit("2024-01-01").cast("timestamp"))
    digests = m.digests_from_body(_bodies(spark, sf_dir, rows), ["sampler"])
    return m.value_metrics(digests, ["sampler"]).withColumn("value", F.round("value", 6))


@query(
    "WITH " + EVENT_ROWS + """, g AS (SELECT resource, sampler, date_trunc('day', ts) AS day FROM e GROUP BY ALL)
    SELECT 'event' AS sample_type, CAST(count(*) AS BIGINT) AS n FROM e WHERE event_type = 'purchase' AND value > 100 UNION ALL SELECT 'value-digest', CAST(count(*) * 11 AS BIGINT) FROM g"""
)
def all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_window(struct_samples(event_rows(spark, sf_dir), ["value"]), "1 day")
    digests = m.digests_from_body(_bodies(spark, sf_dir, rows), ["ts", "resource", "sampler", "sample_type", "digest_uid"])
    points = m.value_metrics(digests, ["sample_type"]).select("sample_type")
    hits = m.event_metrics(ev.events(_raw(spark, sf_dir), _definitions()[:1], _ORDER)).select("sample_type")
    return points.unionByName(hits).groupBy("sample_type").agg(F.count("*").alias("n"))



"""Queries of sampling, routing and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampletide.operators import sampling as s
from sampletide.plans import config
from sampletide.queries.registry import EVENT_ROWS, FAST_ROWS, bucket_sql, event_rows, query
from sampletide.queries.rules import SEGMENT
from sampletide.sources.records import record

STREAMS = [
    s.Stream("u-purchase", "purchases", "event_type = 'purchase'", export_raw=True),
    s.Stream("u-large", "large", "value > 100"),
    s.Stream("u-all", "all", "true", max_sample_size=8),
]
_LOW = "CAST('0x' || substr(sha1(sample_key), 1, 8) AS UBIGINT)"
_STREAMS = """array_to_string(list_filter([CASE WHEN event_type = 'purchase' THEN 'u-purchase' END, CASE WHEN value > 100 THEN 'u-large' END,
    CASE WHEN sample_size <= 8 THEN 'u-all' END], lambda x: x IS NOT NULL), ',')"""


@query("WITH " + EVENT_ROWS + f" SELECT event_id, sample_key FROM e WHERE {_LOW} <= 4294967295 // 3")
def deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(spark, sf_dir).where(s.keep_by_key(F.col("sample_key"), 3)).select("event_id", "sample_key")


@query(
    "WITH " + EVENT_ROWS + """ SELECT event_id, sampler FROM (SELECT *, row_number() OVER (PARTITION BY sampler, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, event_id) AS k FROM e) WHERE k <= 2"""
)
def fixed_window_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.within_window(event_rows(spark, sf_dir), ["sampler"], 2, ["ts", "event_id"], "1 hour").select("event_id", "sampler")


@query("WITH RECURSIVE " + FAST_ROWS + ", " + bucket_sql("kept", "f", 1) + " SELECT event_id, resource, sampler, make_timestamp(us) AS ts FROM kept")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    # event time runs a thousand times as fast, so that the limit bites
    rows = event_rows(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.unix_micros("ts") / 1e9))
    return s.token_bucket(rows, ["resource", "sampler"], 1, ["ts", "event_id"]).select("event_id", "resource", "sampler", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("WITH RECURSIVE " + FAST_ROWS + ", w AS (SELECT * FROM f WHERE event_type = 'purchase' OR value > 100), " + bucket_sql("kept", "w", 1) + " SELECT event_id, resource, sampler FROM kept")
def limiter_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.assign_streams(event_rows(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.unix_micros("ts") / 1e9)), STREAMS[:2])
    return s.token_bucket(rows.where(F.size("stream_uids") > 0), ["resource", "sampler"], 1, ["ts", "event_id"], SEGMENT).select("event_id", "resource", "sampler")


@query(
    "WITH RECURSIVE " + FAST_ROWS + ", i AS (SELECT *, user_id % 3 AS instance FROM f), " + bucket_sql("entered", "i", 2, "resource, sampler, instance")
    + " SELECT resource, sampler, instance, event_id FROM entered"
)
def instance_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every instance of a sampler has a limiter of its own."""
    rows = event_rows(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.unix_micros("ts") / 1e9)).withColumn("instance", F.col("user_id") % 3)
    by = ["resource", "sampler", "instance"]
    return s.token_bucket(rows, by, 2, ["ts", "event_id"], SEGMENT).select(*by, "event_id")


@query("WITH " + EVENT_ROWS + " SELECT event_id, sample_size > 8 AS too_large FROM e")
def max_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.assign_streams(event_rows(spark, sf_dir), STREAMS[2:])
    return rows.select("event_id", F.array_contains("errors", "all: sample too large").alias("too_large"))


@query("WITH " + EVENT_ROWS + f" SELECT event_id, {_STREAMS} AS streams FROM e")
def stream_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.assign_streams(event_rows(spark, sf_dir), STREAMS).select("event_id", F.array_join("stream_uids", ",").alias("streams"))


@query("WITH " + EVENT_ROWS + f" SELECT resource, sampler, sample_key, 'raw' AS sample_type, {_STREAMS} AS streams, props AS body FROM e WHERE event_type = 'purchase'")
def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.assign_streams(event_rows(spark, sf_dir).withColumn("body", F.col("props")), STREAMS)
    return s.raw_export(rows, STREAMS).select("resource", "sampler", "sample_key", "sample_type", F.array_join("stream_uids", ",").alias("streams"), "body")


@query(
    "WITH RECURSIVE " + FAST_ROWS + ", " + bucket_sql("entered", "f", 2) + f", chosen AS (SELECT *, {_STREAMS} AS streams FROM entered WHERE {_LOW} <= 4294967295 // 2), held AS (SELECT * FROM chosen WHERE streams <> ''), "
    + bucket_sql("kept", "held", 1) + " SELECT event_id, resource, sampler, streams FROM kept"
)
def sampler_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.unix_micros("ts") / 1e9))
    out = s.sampler_pipeline(rows, STREAMS, 2, 2, 1, ["resource", "sampler"], ["ts", "event_id"], SEGMENT)
    return out.select("event_id", "resource", "sampler", F.array_join("stream_uids", ",").alias("streams"))


@query(
    "WITH " + EVENT_ROWS + f""" SELECT resource, sampler, CAST(count(*) AS BIGINT) AS evaluated, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS exported,
    CAST(count(*) FILTER ({_LOW} <= 4294967295 // 2) AS BIGINT) AS digested FROM e GROUP BY ALL"""
)
def sampling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).withColumn("exported", F.col("event_type") == "purchase").withColumn("digested", s.keep_by_key(F.col("sample_key"), 2))
    return s.sampling_stats(rows, ["resource", "sampler"])


@query(
    "WITH " + EVENT_ROWS + """, c AS (SELECT resource, sampler, CAST(user_id % 3 AS VARCHAR) AS instance, ts, event_id AS evaluated, event_id // 2 AS exported FROM e),
    l AS (SELECT *, row_number() OVER (PARTITION BY resource, sampler, instance ORDER BY ts DESC, evaluated DESC) AS k FROM c)
    SELECT resource, sampler, CAST(sum(evaluated) AS BIGINT) AS evaluated, CAST(sum(exported) AS BIGINT) AS exported, CAST(count(*) AS BIGINT) AS instances FROM l WHERE k = 1 GROUP BY ALL"""
)
def stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    return s.stats_rollup(rows.select("resource", "sampler", (F.col("user_id") % 3).cast("string").alias("instance"), "ts", F.col("event_id").alias("evaluated"), F.floor(F.col("event_id") / 2).alias("exported")))


@query(
    "WITH " + EVENT_ROWS + """, p AS (SELECT resource, sampler, time_bucket(INTERVAL 1 DAY, ts) AS period, CAST(count(*) AS BIGINT) AS collected FROM e GROUP BY ALL)
    SELECT *, CAST(sum(collected) OVER (PARTITION BY resource, sampler ORDER BY period) AS BIGINT) AS total FROM p"""
)
def collector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.collector_stats(event_rows(spark, sf_dir), "1 day").withColumn("period", F.col("period").cast("timestamp_ntz"))


@query(
    "WITH " + EVENT_ROWS + """ SELECT event_id, CASE WHEN resource = 'app3' THEN '' ELSE 'uid-' || sampler END AS uids, CASE WHEN resource = 'app3' THEN sampler || ',other' ELSE '' END AS names,
    CASE WHEN resource = 'app3' THEN '' ELSE 'other' END AS errors FROM e"""
)
def translate_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    config = rows.where("resource <> 'app3'").select("resource", "sampler", F.col("sampler").alias("name"), F.concat(F.lit("uid-"), "sampler").alias("uid")).distinct()
    given = record(rows, "raw", stream_names=F.array("sampler", F.lit("other")), digest_uid=F.col("event_id").cast("string"))
    out = s.translate_streams(given, config)
    return out.select(F.col("digest_uid").cast("bigint").alias("event_id"), F.array_join("stream_uids", ",").alias("uids"), F.array_join("stream_names", ",").alias("names"), F.array_join("errors", ",").alias("errors"))


#: A log of stream definitions: every twentieth event is a change of its sampler's configuration, in the order of time.
_LOG = """SELECT epoch_us(ts) * 1000 + event_id % 1000 AS version, ts, resource, sampler, 'streams' AS section,
    CASE WHEN event_id % 140 = 0 THEN 'reset' WHEN event_id % 60 = 0 THEN 'delete' ELSE 'upsert' END AS op, 'u' || (user_id % 3) AS uid, 's' || (event_id // 20 % 4) AS name FROM e WHERE event_id % 20 = 0"""


@query(
    "WITH " + EVENT_ROWS + f""", c AS ({_LOG}), i AS (SELECT *, lead(ts) OVER (PARTITION BY resource, sampler, op = 'reset', uid ORDER BY version) AS own,
        min(CASE WHEN op = 'reset' THEN ts END) OVER (PARTITION BY resource, sampler ORDER BY version ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS reset FROM c),
    f AS (SELECT resource, sampler, uid, name, ts AS since, least(own, reset) AS until FROM i WHERE op = 'upsert' AND (least(own, reset) IS NULL OR least(own, reset) > ts)),
    k AS (SELECT resource, sampler, min(since) AS first FROM f GROUP BY ALL), r AS (SELECT *, 's' || (user_id % 4) AS name FROM e WHERE event_id % 20 <> 0),
    u AS (SELECT event_id, min(uid) AS uid FROM r JOIN f ON r.resource = f.resource AND r.sampler = f.sampler AND r.name = f.name AND since <= ts AND (until IS NULL OR ts < until) GROUP BY ALL)
    SELECT event_id, coalesce(uid, '') AS uids, CASE WHEN first <= ts THEN '' ELSE name || ',other' END AS names,
        CASE WHEN first IS NULL OR first > ts THEN '' WHEN uid IS NULL THEN name || ',other' ELSE 'other' END AS errors FROM r LEFT JOIN u USING (event_id) LEFT JOIN k USING (resource, sampler)"""
)
def streams_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream names translated by the configuration that was in force at each record's time."""
    rows, id_ = event_rows(spark, sf_dir), F.col("event_id")
    op = F.when(id_ % 140 == 0, "reset").when(id_ % 60 == 0, "delete").otherwise("upsert")
    payload = F.to_json(F.struct(F.concat(F.lit("s"), (F.floor(id_ / 20) % 4).cast("string")).alias("name")))
    changes = rows.where(id_ % 20 == 0).select(
        (F.unix_micros("ts") * 1000 + id_ % 1000).alias("version"), "ts", "resource", "sampler", F.lit("streams").alias("section"), op.alias("op"),
        F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("uid"), payload.alias("payload"),
    )
    named = F.array(F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")), F.lit("other"))
    given = record(rows.where(id_ % 20 != 0), "raw", stream_names=named, digest_uid=id_.cast("string"))
    out = s.translate_streams_in_force(given, config.streams_in_force(changes))
    text = lambda c: F.array_join(c, ",").alias(c.replace("stream_", ""))
    return out.select(F.col("digest_uid").cast("bigint").alias("event_id"), text("stream_uids"), text("stream_names"), text("errors"))

"""Queries of sources, topics and records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampletide.queries.registry import EVENT_ROWS, event_rows, query, table
from sampletide.sources import records, samples, topics

#: Topics derived from suppliers: plain names, and some that look internal.
_TOPICS = "SELECT CASE s_suppkey % 5 WHEN 0 THEN '_confluent.' || s_suppkey WHEN 1 THEN 'orders-' || s_suppkey || '-changelog' WHEN 2 THEN 'app-KSTREAM-' || s_suppkey ELSE 'orders-' || s_suppkey END AS topic FROM supplier"


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    return spark.sql(_TOPICS)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry records of events, of the type that the event's number deals out."""
    rows = event_rows(spark, sf_dir)
    out = records.record(rows, "raw", stream_uids=F.array(F.lit("all")), encoding=F.lit("json"), body=F.col("props"), digest_uid=F.col("event_id").cast("string"))
    kinds = F.array(*map(F.lit, ["raw", "struct-digest", "value-digest", "event"]))
    return out.withColumn("sample_type", F.element_at(kinds, (F.col("digest_uid").cast("bigint") % 4 + 1).cast("int")))


@query("SELECT event_id, sampler, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(sample_size AS BIGINT) AS sample_size FROM (WITH " + EVENT_ROWS + " SELECT * FROM e)")
def json_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = samples.json_samples(event_rows(spark, sf_dir), "props")
    return good.select("event_id", "sampler", F.try_variant_get("sample", "$.k", "double").alias("k"), F.col("sample_size").cast("bigint").alias("sample_size"))


@query("SELECT n.c_custkey AS c_custkey, n.c_name AS name, n.c_acctbal AS balance FROM customer n")
def typed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.typed_samples(table(spark, sf_dir, "customer"))
    return rows.select(F.variant_get("sample", "$.c_custkey", "bigint").alias("c_custkey"), F.variant_get("sample", "$.c_name", "string").alias("name"), F.variant_get("sample", "$.c_acctbal", "double").alias("balance"))


@query("SELECT o_orderkey, '{\"o_orderkey\":' || o_orderkey || ',\"o_orderpriority\":' || to_json(o_orderpriority) || '}' AS body FROM orders")
def sample_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.typed_samples(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderpriority"])
    return samples.sample_to_json(rows).select("o_orderkey", "body")


@query("WITH " + EVENT_ROWS + " SELECT sampler, sample_key, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL")
def topic_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).select(F.col("sampler").alias("topic"), F.col("sample_key").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"), F.col("ts").alias("timestamp"))
    return samples.topic_messages(rows).groupBy("sampler", "sample_key").agg(F.count("*").alias("n"))


@query(f"SELECT topic, regexp_matches(topic, '^orders-') OR topic = 'app-KSTREAM-2' AS allowed FROM ({_TOPICS})")
def topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes, no = topics.split_topics(_topics(spark, sf_dir), allow=topics.matches(F.col("topic"), ["^orders-"], ["app-KSTREAM-2"]))
    return yes.withColumn("allowed", F.lit(True)).unionByName(no.withColumn("allowed", F.lit(False)))


@query(f"SELECT topic FROM ({_TOPICS}) WHERE NOT regexp_matches(topic, '{'|'.join(topics.INTERNAL_TOPICS)}')")
def internal_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.without_internal(_topics(spark, sf_dir))


@query(
    f"""WITH t AS ({_TOPICS}), wanted AS (SELECT DISTINCT topic FROM t WHERE topic LIKE 'orders%' ORDER BY topic LIMIT 25), now AS (SELECT topic FROM t WHERE topic LIKE '%5%')
    SELECT topic, 'add' AS action FROM wanted WHERE topic NOT IN (SELECT topic FROM now)
    UNION ALL SELECT DISTINCT topic, 'remove' FROM now WHERE topic NOT IN (SELECT topic FROM wanted)"""
)
def topic_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _topics(spark, sf_dir)
    return topics.reconcile(t.where("topic like '%5%'"), t.where("topic like 'orders%'"))


@query("WITH " + EVENT_ROWS + " SELECT resource, sampler, 'raw' AS sample_type, sample_key, CAST(count(*) AS BIGINT) AS n, min(props) AS least FROM e GROUP BY ALL")
def flatten_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.record(event_rows(spark, sf_dir), "raw", stream_uids=F.array(F.lit("all")), encoding=F.lit("json"), body=F.col("props"))
    flat = samples.flatten_logs(samples.nest_logs(rows))
    return flat.groupBy("resource", "sampler", "sample_type", "sample_key").agg(F.count("*").alias("n"), F.min("body").alias("least"))


@query("WITH " + EVENT_ROWS + " SELECT resource, sampler, CAST(count(*) AS BIGINT) AS n_records FROM e GROUP BY resource, sampler, date_trunc('day', ts)")
def nest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.record(event_rows(spark, sf_dir), "raw", body=F.col("props"))
    logs = samples.nest_logs(rows, "1 day")
    scopes = logs.select("period", F.col("resource.attributes")[0]["value"].alias("resource"), F.inline("scope_logs"))
    out = scopes.groupBy("resource", F.col("name").alias("sampler"), "period").agg(F.sum(F.size("log_records")).alias("n_records"))  # a large period has several lots
    return out.drop("period")


_KIND = "list_extract(['raw', 'struct-digest', 'value-digest', 'event'], CAST(event_id % 4 + 1 AS INTEGER))"


@query(f"SELECT CAST(event_id AS VARCHAR) AS digest_uid, ts FROM events WHERE {_KIND} = 'value-digest'")
def records_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.of_type(_records(spark, sf_dir), "value-digest").select("digest_uid", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("WITH " + EVENT_ROWS + " SELECT CAST(event_id AS VARCHAR) AS digest_uid, sampler FROM e WHERE NOT (sampler = 'click' OR sample_key = '7')")
def remove_records_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.remove_if(_records(spark, sf_dir), (F.col("sampler") == "click") | (F.col("sample_key") == "7")).select("digest_uid", "sampler")


@query(f"SELECT {_KIND} AS sample_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE {_KIND} <> 'raw' GROUP BY ALL")
def drop_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.without_raw(_records(spark, sf_dir)).groupBy("sample_type").agg(F.count("*").alias("n"))


@query(
    "WITH " + EVENT_ROWS + """, l AS (SELECT max(ts) AS now FROM e), f AS (SELECT e.* FROM e, l WHERE ts > now - INTERVAL 5 HOURS),
    r AS (SELECT resource, sampler, ts, value, row_number() OVER (PARTITION BY resource, sampler ORDER BY ts DESC, value DESC) AS k FROM f)
    SELECT resource, sampler, ts, value FROM r WHERE k = 1"""
)
def live_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    now = rows.agg(F.max("ts").alias("now"))
    points = rows.crossJoin(F.broadcast(now))  # one row
    return records.live_series(points, ["resource", "sampler"], F.col("now"), "5 hours").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT 'event' AS origin, CAST(event_id AS BIGINT) AS id FROM events UNION ALL SELECT 'order', o_orderkey FROM orders")
def merge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").select(F.lit("event").alias("origin"), F.col("event_id").alias("id"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("origin"))
    return records.merged(a, b)


@query("WITH " + EVENT_ROWS + f" SELECT event_id % 3 AS batch, {_KIND} AS sample_type, resource, sampler, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM e GROUP BY ALL")
def labelled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written in three batches to a table laid out by labels, one of them twice, as after a failure, and read back."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{shared.rstrip('/')}/records-{uuid.uuid4().hex}"
    rows = _records(spark, sf_dir)
    for batch in (0, 1, 2, 1):
        records.write_batch(rows.where(F.col("digest_uid").cast("bigint") % 3 == batch), batch, path)
    back = records.read_records(spark, path)
    return back.groupBy("batch", "sample_type", "resource", "sampler").agg(F.count("*").alias("n"), F.sum(F.col("digest_uid").cast("bigint")).alias("ids"))

"""Queries of configuration, its change log derived from orders: a change an order, in the order of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampletide.plans import config as c
from sampletide.queries.registry import EVENT_ROWS, event_rows, query, table

_CHANGES = """SELECT o_orderkey AS version, 'app' || (o_custkey % 5) AS resource, o_orderpriority AS sampler, CASE o_orderkey % 3 WHEN 0 THEN 'streams' WHEN 1 THEN 'digests' ELSE 'events' END AS section,
    CASE WHEN o_orderkey % 97 = 0 THEN 'reset' WHEN o_orderkey % 7 = 0 THEN 'delete' ELSE 'upsert' END AS op, CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE 'u' || (o_custkey % 11) END AS uid,
    '{"name":"' || o_orderstatus || (o_custkey % 4) || '"}' AS payload, o_orderstatus FROM orders"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(_CHANGES)


_MERGED = f"""changes AS ({_CHANGES}), r AS (SELECT resource, sampler, section, max(version) AS reset FROM changes WHERE op = 'reset' GROUP BY ALL),
    l AS (SELECT *, row_number() OVER (PARTITION BY resource, sampler, section, uid ORDER BY version DESC) AS k FROM changes WHERE op <> 'reset'),
    config AS (SELECT l.resource, l.sampler, l.section, uid, version, payload FROM l LEFT JOIN r USING (resource, sampler, section) WHERE k = 1 AND (reset IS NULL OR version >= reset) AND op <> 'delete')"""


def _config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.merged_config(_changes(spark, sf_dir))


@query(f"WITH {_MERGED} SELECT * FROM config")
def config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _config(spark, sf_dir)


@query(f"WITH {_MERGED} SELECT * FROM config WHERE resource <> 'app1'")
def config_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _changes(spark, sf_dir).drop("o_orderstatus")
    gone = c.deletion(changes.where("resource = 'app1'").select("resource", "sampler").distinct(), F.lit(1 << 60))
    return c.merged_config(changes.unionByName(gone))


@query(
    f"""SELECT version, array_to_string(list_filter([CASE WHEN NOT regexp_full_match(name, '[./()a-zA-Z0-9_-]*') THEN 'invalid name' END, CASE WHEN section = 'events' AND op = 'upsert' AND sample_type <> 'raw' THEN 'events need raw samples' END], lambda x: x IS NOT NULL), '; ') AS errors
    FROM (SELECT *, CASE WHEN version % 5 = 0 THEN 'bad name' ELSE 'good-name.1' END AS name, CASE WHEN o_orderstatus = 'O' THEN 'raw' ELSE 'event' END AS sample_type FROM ({_CHANGES.replace("o_orderpriority AS sampler", "'s' AS sampler")}))"""
)
def config_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changes(spark, sf_dir).withColumn("sampler", F.lit("s"))
    rows = rows.withColumn("name", F.when(F.col("version") % 5 == 0, "bad name").otherwise("good-name.1")).withColumn("sample_type", F.when(F.col("o_orderstatus") == "O", "raw").otherwise("event"))
    return c.validated_changes(rows).select("version", F.array_join("errors", "; ").alias("errors"))


@query(f"SELECT resource, sampler, 'config' AS sample_type, CASE WHEN op IN ('delete', 'reset') THEN '' ELSE payload END AS body, CAST(count(*) AS BIGINT) AS n FROM ({_CHANGES}) GROUP BY ALL")
def config_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.config_records(_changes(spark, sf_dir), F.lit(None))
    return rows.groupBy("resource", "sampler", "sample_type", "body").agg(F.count("*").alias("n"))


@query(f"WITH {_MERGED} SELECT resource, CAST(count(DISTINCT sampler) AS BIGINT) AS samplers FROM config GROUP BY ALL")
def list_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.list_resources(_config(spark, sf_dir))


@query(f"WITH {_MERGED} SELECT resource, sampler, uid, json_extract_string(payload, '$.name') AS name FROM config WHERE section = 'streams'")
def list_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.list_section(_config(spark, sf_dir), "streams")


@query(f"WITH {_MERGED} SELECT DISTINCT resource, sampler FROM config WHERE resource LIKE 'app%' AND sampler LIKE '%E%' AND section = 'streams' AND json_extract_string(payload, '$.name') = 'O1'")
def match_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.match_targets(_config(spark, sf_dir), "app*", "*E*", "O1")


@query(
    f"""WITH {_MERGED} SELECT DISTINCT CAST(7 AS BIGINT) AS version, resource, sampler, 'limiter_in' AS section, 'set' AS op, '' AS uid, '{{"limit":5}}' AS payload FROM config
    WHERE sampler LIKE '%I%' AND (resource, sampler) IN (SELECT (resource, sampler) FROM config WHERE section = 'digests')"""
)
def bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _config(spark, sf_dir)
    capable = config.where("section = 'digests'").select("resource", "sampler").distinct()
    return c.bulk_change(config, "*", "*I*", "limiter_in", "set", "", '{"limit":5}', F.lit(7).cast("bigint"), capable)


@query(
    "WITH " + EVENT_ROWS + """, s AS (SELECT DISTINCT resource, sampler FROM e WHERE resource <> 'app2')
    SELECT resource, sampler, section, uid FROM s, (VALUES ('streams', 'all'), ('digests', 'struct'), ('digests', 'value')) t(section, uid)"""
)
def implicit_samplers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    known = c.preset_changes(rows.where("resource = 'app2'").select("resource", "sampler").distinct(), F.lit(1))
    return c.implicit_changes(rows, known, F.lit(1)).select("resource", "sampler", "section", "uid")

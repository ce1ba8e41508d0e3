"""Queries of the rule language."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampletide.functions import rules as r
from sampletide.queries.registry import EVENT_ROWS, event_rows, query, table
from sampletide.sources.samples import json_samples, typed_samples

_ORDER = ["ts", "event_id"]
#: Rows of a segment in these queries: so few that the samplers of small tables are cut too.
SEGMENT = 400


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_samples(event_rows(spark, sf_dir), "props")[0]


@query("SELECT event_id FROM events WHERE value > 50 AND event_type <> 'click'")
def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.Rule("value > 50 and event_type <> 'click'").column(event_rows(spark, sf_dir))
    return rows.where("matched").select("event_id")


_CHECKED = ["value > 50", "value + 1", "event_type = 'click' or value is null", "upper(event_type)"]


@query(
    """SELECT rule, schema, coalesce(n, 0) AS n, n IS NOT NULL AS accepted FROM (VALUES ('value > 50', 'own', (SELECT count(*) FROM events WHERE value > 50)), ('event_type = ''click'' or value is null', 'own', (SELECT count(*) FROM events WHERE event_type = 'click' OR value IS NULL)),
    ('value + 1', 'own', NULL), ('upper(event_type)', 'own', NULL), ('value > 50', 'other', NULL)) t(rule, schema, n)"""
)
def rule_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules can be made for events and for samples of another schema, and how many rows those that can match."""
    rows, found = event_rows(spark, sf_dir), []
    for rule, schema in [*((rule, "own") for rule in _CHECKED), (_CHECKED[0], "other")]:
        try:
            column = r.check_rule(rows, rule, rows.schema if schema == "own" else table(spark, sf_dir, "orders").schema)
        except ValueError:
            column = None
        n = F.lit(0).cast("bigint") if column is None else F.count_if(column)
        found.append(rows.agg(n.alias("n")).select(F.lit(rule).alias("rule"), F.lit(schema).alias("schema"), "n", F.lit(column is not None).alias("accepted")))
    return functools.reduce(DataFrame.unionByName, found)


@query("SELECT event_id, event_id = 1 OR 1 = 1 AS always, event_id = 1 AND 1 <> 1 AS never FROM events")
def static_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    return rows.select("event_id", r.check_rule(rows, "event_id = 1 or 1 = 1").alias("always"), r.check_rule(rows, "event_id = 1 and 1 <> 1").alias("never"))


@query("SELECT c_custkey, abs(c_acctbal) AS size FROM customer WHERE abs(c_acctbal) > 500")
def rule_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("abs(c_acctbal) > 500").select("c_custkey", F.expr("abs(c_acctbal)").alias("size"))


@query("WITH l AS (SELECT max(ts) AS now FROM events) SELECT event_id FROM events, l WHERE now - ts > INTERVAL 20 DAYS")
def rule_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    now = rows.agg(F.max("ts")).head()[0]
    return rows.where(r.late(F.col("ts"), F.lit(now), "20 days")).select("event_id")


_LAST = "lag(value IGNORE NULLS) OVER (PARTITION BY {} ORDER BY ts, event_id)"


@query("WITH " + EVENT_ROWS + f" SELECT event_id, CASE WHEN value IS NOT NULL THEN coalesce(value >= {_LAST.format('resource, sampler')}, true) END AS ok FROM e")
def sequence_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.Rule("held", {"held": r.Ordered("asc", F.col("value"), ["resource", "sampler"], _ORDER, rows=SEGMENT)}).column(event_rows(spark, sf_dir), "ok").select("event_id", "ok")


@query("WITH " + EVENT_ROWS + f" SELECT event_id, CASE WHEN value IS NOT NULL THEN coalesce(value <= {_LAST.format('resource, sampler, sample_key')}, true) END AS ok FROM e")
def sequence_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = r.Ordered("desc", F.col("value"), ["resource", "sampler", "sample_key"], _ORDER)
    return r.Rule("held", {"held": call}).column(event_rows(spark, sf_dir), "ok").select("event_id", "ok")


@query("WITH " + EVENT_ROWS + " SELECT event_id, coalesce(event_id = lag(event_id) OVER (PARTITION BY resource, sampler ORDER BY ts, event_id) + 1, true) AS ok FROM e")
def complete_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.Rule("held", {"held": r.Ordered("complete", F.col("event_id"), ["resource", "sampler"], _ORDER, rows=SEGMENT)}).column(event_rows(spark, sf_dir), "ok").select("event_id", "ok")


@query("SELECT conv_id, turn, coalesce(turn = lag(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, text) + 1, true) AS ok FROM conversations")
def complete_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    call = r.Ordered("complete", F.col("turn"), ["conv_id"], ["turn", "role", "text"])
    return r.Rule("held", {"held": call}).column(rows, "ok").select("conv_id", "turn", "ok")


@query(
    "WITH " + EVENT_ROWS + """, f AS (SELECT resource, sampler, sample_key, min((ts, event_id)) AS t FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY resource, sampler ORDER BY t) <= 10 AS admitted FROM f)
    SELECT event_id, admitted FROM e JOIN k USING (resource, sampler, sample_key)"""
)
def keyed_max_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.admitted_keys(event_rows(spark, sf_dir), ["resource", "sampler"], "sample_key", _ORDER, 10).select("event_id", "admitted")


@query(
    "WITH " + EVENT_ROWS + """, g AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 2 DAYS, false) AS idle FROM e WINDOW w AS (PARTITION BY resource, sampler, sample_key ORDER BY ts, event_id)),
    p AS (SELECT *, CAST(sum(CAST(idle AS INTEGER)) OVER (PARTITION BY resource, sampler, sample_key ORDER BY ts, event_id) AS BIGINT) AS epoch FROM g)
    SELECT event_id, epoch, CASE WHEN value IS NOT NULL THEN coalesce(value >= lag(value IGNORE NULLS) OVER (PARTITION BY resource, sampler, sample_key, epoch ORDER BY ts, event_id), true) END AS ok FROM p"""
)
def keyed_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["resource", "sampler", "sample_key"]
    rows = r.key_epochs(event_rows(spark, sf_dir), by, _ORDER, "2 days", SEGMENT)
    return rows.select("event_id", "epoch", r.sequence(F.col("value"), "asc", [*by, "epoch"], _ORDER).alias("ok"))


@query(
    "WITH " + EVENT_ROWS + """, a AS (SELECT *, CASE WHEN value IS NOT NULL THEN coalesce(value >= lag(value IGNORE NULLS) OVER w, true) END AS up FROM e WINDOW w AS (PARTITION BY resource, sampler ORDER BY ts, event_id)),
    b AS (SELECT *, CASE WHEN up AND value IS NOT NULL THEN value END AS v FROM a)
    SELECT event_id, CASE WHEN NOT up THEN false WHEN v IS NOT NULL THEN coalesce(v <= last_value(v IGNORE NULLS) OVER (PARTITION BY resource, sampler ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) END AS ok FROM b"""
)
def multi_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["resource", "sampler"]
    up = r.Ordered("asc", F.col("value"), by, _ORDER, rows=SEGMENT)
    down = r.Ordered("desc", F.col("value"), by, _ORDER, rows=SEGMENT, after=("up",))
    return r.Rule("up and down", {"up": up, "down": down}).column(event_rows(spark, sf_dir), "ok").select("event_id", "ok")


_K = "CAST(json_extract(props, '$.k') AS DOUBLE)"


@query(f"SELECT event_id, ({_K} + 1) * 2 - {_K} / 4 AS x, fmod({_K}, 3) AS m, {_K} >= 5 AND NOT {_K} = 7 OR {_K} < 2 AS ok FROM events")
def rule_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _json(spark, sf_dir).withColumn("k", r.field_of(F.col("sample"), "$.k"))
    return rows.select("event_id", F.expr("(k + 1) * 2 - k / 4").alias("x"), F.expr("k % 3").alias("m"), r.check_rule(rows, "k >= 5 and not k = 7 or k < 2").alias("ok"))


@query("SELECT o_orderkey, o_orderstatus AS status, o_totalprice > 1000 AS large, true AS has_price, false AS has_other FROM orders")
def rule_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    nested = orders.select("o_orderkey", F.struct(F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")).alias("order")).alias("row"))
    rows = typed_samples(nested, ["row"])
    price = r.field_of(F.col("sample"), "$.row.order.price")
    return rows.select("o_orderkey", r.field_of(F.col("sample"), "$.row.order.status", "string").alias("status"), (price > 1000).alias("large"), price.isNotNull().alias("has_price"), F.try_variant_get("sample", "$.row.other", "variant").isNotNull().alias("has_other"))


@query("SELECT page_id, CAST(length(url) AS INTEGER) AS n, contains(url, 'page=') AS paged, starts_with(url, 'https') AS secure, ends_with(url, '#top') AS top, regexp_matches(url, '/[a-z]{2}/[0-9]+') AS found, url || '!' AS loud FROM pages")
def rule_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.length(u).alias("n"), u.contains("page=").alias("paged"), u.startswith("https").alias("secure"), u.endswith("#top").alias("top"), u.rlike("/[a-z]{2}/[0-9]+").alias("found"), F.concat(u, F.lit("!")).alias("loud"))


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(dayofweek(ts) AS INTEGER) AS dow, ts + INTERVAL 90 MINUTES AS later FROM events")
def rule_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", F.year(t).alias("y"), F.month(t).alias("m"), F.dayofmonth(t).alias("d"), F.hour(t).alias("h"), F.minute(t).alias("mi"), (F.dayofweek(t) - 1).alias("dow"), (t + F.expr("interval 90 minutes")).alias("later"))


@query(f"SELECT event_id, CAST({_K} AS BIGINT) AS i, CAST(CAST({_K} AS BIGINT) AS VARCHAR) AS s, TRY_CAST(event_type AS DOUBLE) AS bad, 'BIGINT' AS kind FROM events")
def rule_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _json(spark, sf_dir)
    k = F.try_variant_get("sample", "$.k", "double")
    return rows.select("event_id", k.cast("bigint").alias("i"), k.cast("bigint").cast("string").alias("s"), F.expr("try_cast(event_type as double)").alias("bad"), F.schema_of_variant(F.variant_get("sample", "$.k", "variant")).alias("kind"))


@query(
    """WITH o AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS a FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, list_contains(a, 3) AS has3, CAST(len(a) AS INTEGER) AS n, len(list_filter(a, lambda x: x > 0)) = len(a) AS positive, len(list_filter(a, lambda x: x > 4)) > 0 AS some_large,
    len(list_filter(a, lambda x: x = 1)) = 1 AS one_first, array_to_string(list_transform(a, lambda x: x * 2), ',') AS doubled, array_to_string(list_filter(a, lambda x: x % 2 = 0), ',') AS even FROM o"""
)
def rule_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("a"))  # an order's lines
    a = F.col("a")
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return rows.select(
        "l_orderkey", F.array_contains(a, 3).alias("has3"), F.size(a).alias("n"), F.forall(a, lambda x: x > 0).alias("positive"), F.exists(a, lambda x: x > 4).alias("some_large"),
        (F.size(F.filter(a, lambda x: x == 1)) == 1).alias("one_first"), text(F.transform(a, lambda x: x * 2)).alias("doubled"), text(F.filter(a, lambda x: x % 2 == 0)).alias("even"),
    )

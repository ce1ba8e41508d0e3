"""Named queries over the driver's tables, each with the SQL that DuckDB must agree with where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as plain sample rows: sampler is the event type, the key the user, one of four resources."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("app"), (F.col("user_id") % 4).cast("string")).alias("resource"), F.col("event_type").alias("sampler"),
        F.col("user_id").cast("string").alias("sample_key"), "user_id", "event_type", "value", "props", F.octet_length("props").alias("sample_size"),
    )


#: The same rows in SQL.
EVENT_ROWS = "e AS (SELECT event_id, ts, 'app' || (user_id % 4) AS resource, event_type AS sampler, CAST(user_id AS VARCHAR) AS sample_key, user_id, event_type, value, props, strlen(props) AS sample_size FROM events)"


def bucket_sql(name: str, source: str, limit: int, by: str = "resource, sampler") -> str:
    """Common tables (to follow WITH RECURSIVE) of which ``name`` holds the rows of ``source`` (us: event time in microseconds) that a token bucket lets through."""
    same = " AND ".join(f"b.{c} = t.{c}" for c in by.split(", "))
    return f"""{name}_t AS (SELECT *, us / 1e6 AS s, row_number() OVER (PARTITION BY {by} ORDER BY us, event_id) AS k FROM {source}),
    {name}_b AS (SELECT {by}, k, s, CAST({limit} AS DOUBLE) AS had FROM {name}_t WHERE k = 1
        UNION ALL SELECT {", ".join("t." + c for c in by.split(", "))}, t.k, t.s, least({limit}, (CASE WHEN b.had >= 1 THEN b.had - 1 ELSE b.had END) + greatest(0, t.s - b.s) * {limit}) FROM {name}_b b JOIN {name}_t t ON {same} AND t.k = b.k + 1),
    {name} AS (SELECT t.* EXCLUDE (s, k) FROM {name}_t t JOIN {name}_b b ON {same} AND t.k = b.k WHERE had >= 1)"""


#: ``event_rows`` with us: event time that runs a thousand times as fast, so that limits bite.
FAST_ROWS = EVENT_ROWS + ", f AS (SELECT *, CAST(trunc(epoch_us(ts) / 1e9 * 1e6) AS BIGINT) AS us FROM e)"

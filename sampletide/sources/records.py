"""Telemetry records: the envelope, selections of it, and table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ["raw", "struct-digest", "value-digest", "event", "config", "unknown"]
RECORD = "ts timestamp, resource string, sampler string, sample_type string, stream_uids array<string>, stream_names array<string>, sample_key string, encoding string, body string, event_uid string, event_rule string, digest_uid string"


def record(df: DataFrame, sample_type: str, **columns: Column) -> DataFrame:
    """Rows as records; columns that are neither given nor there are empty: "" for text, [] for lists, null for ts."""
    out = []
    for field in RECORD.split(", "):
        name, kind = field.split(" ")
        if name == "sample_type":
            out.append(F.lit(sample_type).alias(name))
            continue
        value = columns.get(name, F.col(name) if name in df.columns else None)
        empty = F.array().cast(kind) if kind.startswith("array") else F.lit("") if kind == "string" else F.lit(None).cast(kind)
        out.append((empty if value is None else F.coalesce(value.cast(kind), empty)).alias(name))
    return df.select(*out)


def of_type(records: DataFrame, sample_type: str) -> DataFrame:
    if sample_type not in TYPES:
        raise ValueError(f"unknown sample type {sample_type!r}")
    return records.where(F.col("sample_type") == sample_type)


def remove_if(records: DataFrame, predicate: Column) -> DataFrame:
    return records.where(~F.coalesce(predicate, F.lit(False)))


def without_raw(records: DataFrame) -> DataFrame:
    return remove_if(records, F.col("sample_type") == "raw")


def merged(*batches: DataFrame) -> DataFrame:
    out, *rest = batches
    for other in rest:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def write_records(records: DataFrame, path: str) -> None:
    """A table laid out by the labels that readers select by."""
    records.write.mode("append").partitionBy("sample_type", "resource", "sampler").parquet(path)


#: The labels that tables of records are laid out by.
LABELS = ["sample_type", "resource", "sampler"]


def write_batch(records: DataFrame, batch_id: int, path: str) -> None:
    """A stream's batch as a folder of its own, named by its id and laid out by the labels; a batch that comes again replaces what it left.

    For ``foreachBatch(lambda df, n: write_batch(df, n, path))``: with a checkpoint, every record is in the table exactly once.
    """
    records.write.mode("overwrite").partitionBy(*LABELS).parquet(f"{path.rstrip('/')}/batch={batch_id}")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of such a table, with batch. Labels are read as text, empty ones as empty."""
    rows = spark.read.schema(f"{RECORD}, batch long").parquet(path)
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in LABELS})


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def live_series(points: DataFrame, series: list[str], as_of: Column, ttl: str = "5 minutes") -> DataFrame:
    """The latest point of each series that has one within ``ttl`` before ``as_of``."""
    fresh = points.where((F.col("ts") <= as_of) & (F.col("ts") > as_of - F.expr(f"interval {ttl}")))
    last = fresh.groupBy(*series).agg(F.max(F.struct("ts", "value")).alias("last"))
    return last.select(*series, "last.ts", "last.value")

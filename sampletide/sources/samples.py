"""Samples: one semi-structured record a row, in a VARIANT column ``sample``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_object(sample: Column) -> Column:
    return F.coalesce(F.schema_of_variant(sample).startswith("OBJECT"), F.lit(False))


def json_samples(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON text is an object, with ``sample`` and ``sample_size`` (bytes); and the rows that are errors."""
    parsed = df.withColumn("sample", F.try_parse_json(column)).withColumn("sample_size", F.octet_length(column))
    return parsed.where(is_object(F.col("sample"))), parsed.where(~is_object(F.col("sample"))).drop("sample")


def typed_samples(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Any rows as samples: their columns (or those named) become the fields of an object."""
    return df.withColumn("sample", F.to_variant_object(F.struct(*(columns or df.columns))))


def struct_samples(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The same as a struct, which keeps its types and is shredded column by column; for digests, which take either."""
    return df.withColumn("sample", F.struct(*(columns or df.columns)))


def sample_to_json(df: DataFrame) -> DataFrame:
    return df.withColumn("body", F.to_json("sample"))


def topic_messages(messages: DataFrame) -> DataFrame:
    """Messages (key, value, topic, timestamp) as samples: the topic is the sampler, the key the sampling key.

    Messages that are not JSON objects are dropped here; ``json_samples`` keeps them apart.
    """
    rows = messages.select(F.col("topic").alias("sampler"), F.coalesce(F.col("key").cast("string"), F.lit("")).alias("sample_key"), F.col("value").cast("string").alias("body"), F.col("timestamp").alias("ts"))
    return json_samples(rows, "body")[0]


def read_topics(spark: SparkSession, servers: str, pattern: str, **options: str) -> DataFrame:
    """A stream of all topics that match ``pattern``; needs Spark's Kafka package on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribePattern", pattern)
    return topic_messages(reader.options(**options).load())


def nest_logs(records: DataFrame, period: str = "1 minute", most: int = 10_000) -> DataFrame:
    """Records as nested logs: period and lot, resource of attributes, and scope_logs of scope and log_records with attributes.

    A row per resource, sampler, period (its start) of event time and lot, so that no row grows with the whole of a sampler's records; if a period has more
    than ``most`` records, there are as many lots as hold about so many each. Records without a time share a period, which is null.
    """
    pairs = [("sample.type", F.col("sample_type")), ("sample.key", F.col("sample_key")), ("sample.encoding", F.col("encoding"))]
    attributes = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    record = F.struct("ts", attributes.alias("attributes"), "stream_uids", "body")
    origin = F.lit("1970-01-01").cast("timestamp")  # F.window would leave out records without a time
    length = F.expr(f"unix_micros(timestamp_micros(0) + interval {period})")
    ticks = F.floor((F.unix_micros("ts") - F.unix_micros(origin)) / length).alias("_period")
    largest = records.groupBy("resource", "sampler", ticks).agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 1
    # records equal in all their columns differ by where they stand
    lot = F.pmod(F.xxhash64("ts", "sample_key", "body", F.monotonically_increasing_id()), F.lit(-(-largest // most))).alias("_lot")
    scopes = records.groupBy("resource", "sampler", ticks, lot).agg(F.sort_array(F.collect_list(record)).alias("log_records"))
    named = F.array(F.struct(F.lit("service.name").alias("key"), F.col("resource").alias("value")))
    start = F.timestamp_micros(F.unix_micros(origin) + F.col("_period") * length)
    return scopes.select(start.alias("period"), F.col("_lot").alias("lot"), F.struct(named.alias("attributes")).alias("resource"), F.array(F.struct(F.col("sampler").alias("name"), "log_records")).alias("scope_logs"))


def flatten_logs(logs: DataFrame) -> DataFrame:
    """Nested logs as records; resource from the attribute service.name, sampler from the scope's name. Missing keys are "", of repeated ones the first counts."""
    attribute = lambda c, k: F.coalesce(F.get(F.filter(c, lambda x: x["key"] == k), F.lit(0))["value"], F.lit(""))
    scopes = logs.select(attribute(F.col("resource.attributes"), "service.name").alias("resource"), F.inline("scope_logs"))
    rows = scopes.select("resource", F.col("name").alias("sampler"), F.inline("log_records"))
    return rows.select("ts", "resource", "sampler", attribute(F.col("attributes"), "sample.type").alias("sample_type"), F.coalesce("stream_uids", F.array().cast("array<string>")).alias("stream_uids"), attribute(F.col("attributes"), "sample.key").alias("sample_key"), attribute(F.col("attributes"), "sample.encoding").alias("encoding"), "body")

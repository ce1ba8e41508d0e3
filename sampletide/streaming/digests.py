"""Digests of unbounded input: tumbling windows of event time that close with the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampletide.functions.shred import shred_within
from sampletide.operators.struct_digest import struct_digest
from sampletide.operators.value_digest import streamed_value_digest_of, value_sums

#: Steps a sample may cost where a digest doesn't say.
MAX_FIELDS = 100


def _nodes(samples: DataFrame, by: list[str], period: str, delay: str, max_fields: int) -> DataFrame:
    return shred_within(samples, [*by, "ts"], max_fields).withWatermark("ts", delay).withColumn("flush", F.window("ts", period))


def windowed_struct_digest(samples: DataFrame, by: list[str], period: str, delay: str, json_numbers: bool = False, max_fields: int = MAX_FIELDS) -> DataFrame:
    """Structure digests a window; rows later than ``delay`` behind the newest are left out, as a closed window is never reopened. Samples take ``max_fields`` steps at most."""
    digest = struct_digest(_nodes(samples, by, period, delay, max_fields), [*by, "flush"], json_numbers)
    return digest.withColumn("window_start", F.col("flush.start")).drop("flush")


def windowed_value_digest(samples: DataFrame, by: list[str], period: str, delay: str, max_fields: int = MAX_FIELDS, sketches: bool = True) -> DataFrame:
    """Whole value digests a window, for append mode: sums by path, then totals from parents, two aggregations under one watermark.

    Late rows and the budget are as for structure digests; that known fields cost steps needs the order of samples and is for batches.
    """
    sums = value_sums(_nodes(samples, by, period, delay, max_fields), [*by, "flush"], sketches)
    digest = streamed_value_digest_of(sums, [*by, "flush"])
    return digest.withColumn("window_start", F.col("flush.start")).drop("flush")

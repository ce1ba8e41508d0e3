"""Digests over windows of time and over streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampletide.functions.shred import shred_known, shred_within
from sampletide.operators.struct_digest import struct_digest, struct_json
from sampletide.operators.value_digest import value_digest, value_json
from sampletide.sources.records import record


@dataclass(frozen=True)
class Digest:
    uid: str
    stream_uid: str
    kind: str = "struct-digest"
    period: str = "1 minute"
    location: str = "collector"
    max_fields: int = 100


def digest_nodes(samples: DataFrame, digest: Digest, keep: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The node rows that a digest is made of: of each sample as much as its budget of ``max_fields`` steps allows.

    With an ``order`` of the samples, known fields that a sample lacks cost value digests a step each.
    """
    by = keep or grouping(digest)
    if order and digest.kind == "value-digest":
        return shred_known(samples, by, order, digest.max_fields)
    return shred_within(samples, by, digest.max_fields)


def digest_bodies(samples: DataFrame, digest: Digest, order: list[str] | None = None, json_numbers: bool = False) -> DataFrame:
    """The bodies of a digest over samples with window_start, its budget applied."""
    by = grouping(digest)
    nodes = digest_nodes(samples, digest, by, order)
    if digest.kind == "value-digest":
        return value_json(value_digest(nodes, by), by)
    return struct_json(struct_digest(nodes, by, json_numbers), by)


def with_window(df: DataFrame, period: str) -> DataFrame:
    """With window_start: the flush period that the sample's event time falls into."""
    return df.withColumn("window_start", F.window("ts", period).start)


def fan_out(df: DataFrame, digests: DataFrame) -> DataFrame:
    """A row per sample and digest bound to one of its streams. ``digests`` (configuration) has digest_uid and stream_uid."""
    return df.withColumn("stream_uid", F.explode("stream_uids")).join(digests, "stream_uid")


def fan_out_in_force(df: DataFrame, digests: DataFrame) -> DataFrame:
    """The same by the digests that were bound to the sampler's streams at the sample's ts. ``digests``: resource, sampler, digest_uid, stream_uid, since, until (null: still)."""
    rows = df.withColumn("stream_uid", F.explode("stream_uids"))
    on = ["resource", "sampler", "stream_uid"]
    other = digests.select(*[F.col(c).alias(f"_{c}") for c in on], "digest_uid", "since", "until")
    same = [F.col(c) == F.col(f"_{c}") for c in on]
    held = (F.col("since") <= F.col("ts")) & (F.col("until").isNull() | (F.col("ts") < F.col("until")))
    return rows.join(other, [*same, held]).drop(*[f"_{c}" for c in on], "since", "until")


def grouping(digest: Digest) -> list[str]:
    """What digests are kept by: each instance at the sampler, all instances together at the collector."""
    if digest.location not in ("sampler", "collector"):
        raise ValueError(f"no digests are made at {digest.location!r}")
    return ["resource", "sampler", *(["instance"] if digest.location == "sampler" else []), "window_start"]


def digest_records(bodies: DataFrame, digest: Digest) -> DataFrame:
    """Rendered bodies (resource, sampler, window_start, body) as telemetry records."""
    return record(bodies, digest.kind, ts=F.col("window_start"), stream_uids=F.array(F.lit(digest.stream_uid)), encoding=F.lit("json"), digest_uid=F.lit(digest.uid))


def required_types(config: DataFrame) -> DataFrame:
    return config.select("location", "kind").distinct()



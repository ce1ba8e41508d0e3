"""Sampler configuration as tables of changes.

A change row: version, resource, sampler, section (streams, digests, events, limiter_in, limiter_out, sampling), op
(reset, upsert, delete, set), uid ("" for sections without uids), payload (JSON text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampletide.sources.records import record

#: Fixed value: what names of resources, samplers, streams, digests and events may hold.
NAME = r"^[./()\w_-]*\z"
SECTIONS = ["streams", "digests", "events", "limiter_in", "limiter_out", "sampling"]


def merged_config(changes: DataFrame) -> DataFrame:
    """The configuration after all changes: of each section what came after its last reset, of each uid the last word unless it is a delete.

    A reset applies before other changes of its version. Nothing is sorted: two aggregations and a join of their results.
    """
    by = ["resource", "sampler", "section"]
    resets = changes.where("op = 'reset'").groupBy(*by).agg(F.max("version").alias("reset"))
    last = changes.where("op <> 'reset'").groupBy(*by, "uid").agg(F.max(F.struct("version", "op", "payload")).alias("last"))
    kept = last.join(resets, by, "left").where(F.col("reset").isNull() | (F.col("last.version") >= F.col("reset")))
    return kept.where(F.col("last.op") != "delete").select(*by, "uid", "last.version", "last.payload")


def deletion(samplers: DataFrame, version: Column) -> DataFrame:
    """Change rows that reset every section of the given samplers."""
    return samplers.select(version.alias("version"), "resource", "sampler", F.explode(F.array(*map(F.lit, SECTIONS))).alias("section"), F.lit("reset").alias("op"), F.lit("").alias("uid"), F.lit(None).cast("string").alias("payload"))


def validated_changes(changes: DataFrame) -> DataFrame:
    """With errors: every reason for which a change (resource, sampler, section, op, name, sample_type) is refused."""
    bad = lambda c: F.when(~F.coalesce(F.col(c).rlike(NAME), F.lit(False)), F.lit(f"invalid {c}"))
    raw = F.when((F.col("section") == "events") & (F.col("op") == "upsert") & (F.col("sample_type") != "raw"), F.lit("events need raw samples"))
    return changes.withColumn("errors", F.array_compact(F.array(bad("resource"), bad("sampler"), bad("name"), raw)))


def config_records(changes: DataFrame, ts: Column) -> DataFrame:
    """A config record a change; the body of a deletion is empty."""
    body = F.when(F.col("op").isin("delete", "reset"), "").otherwise(F.col("payload"))
    return record(changes, "config", ts=ts, encoding=F.lit("json"), body=body)


def in_force(changes: DataFrame, section: str) -> DataFrame:
    """resource, sampler, uid, payload, since and until (null: still) of every definition of a section in a log of changes with ts.

    A definition holds from its change to the next of its uid or the next reset of its sampler's section. Changes apply in the order of
    their versions, a reset before others of its version. A sampler's log, not its records, is what a task holds.
    """
    rows = changes.where(F.col("section") == section).withColumn("_reset", F.col("op") == "reset")
    order = [F.col("version"), (~F.col("_reset")).cast("int")]
    # backwards, as a frame that only grows takes one step a row
    later = Window.partitionBy("resource", "sampler").orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("resource", "sampler", "_reset", "uid").orderBy(*order)
    rows = rows.withColumn("until", F.least(F.lead("ts").over(own), F.min(F.when(F.col("_reset"), F.col("ts"))).over(later)))
    rows = rows.where("op in ('upsert', 'set') and (until is null or until > ts)")
    return rows.select("resource", "sampler", "uid", "payload", F.col("ts").alias("since"), "until")


def streams_in_force(changes: DataFrame) -> DataFrame:
    """The stream definitions in force, with their names."""
    return in_force(changes, "streams").withColumn("name", F.get_json_object("payload", "$.name")).drop("payload")


def wildcard(column: Column, pattern: str) -> Column:
    """Equality in which * stands for any text."""
    if "*" not in pattern:
        return column == pattern
    return column.rlike("^" + ".*".join(f"\\Q{p}\\E" if p else "" for p in pattern.split("*")) + r"\z")


def match_targets(config: DataFrame, resource: str, sampler: str, stream: str | None = None) -> DataFrame:
    """Samplers (resource, sampler) that match, and hold a stream that does if one is asked for. "*" or nothing is any stream, also none."""
    rows = config.where(wildcard(F.col("resource"), resource) & wildcard(F.col("sampler"), sampler))
    if stream not in (None, "", "*"):
        rows = rows.where((F.col("section") == "streams") & wildcard(F.get_json_object("payload", "$.name"), stream))
    return rows.select("resource", "sampler").distinct()


def required_targets(config: DataFrame, resource: str, sampler: str, stream: str | None = None) -> DataFrame:
    """The matching samplers, of which there must be one."""
    found = match_targets(config, resource, sampler, stream)
    if found.isEmpty():
        raise LookupError("no sampler matches" if "*" in resource + sampler else "there is no such sampler")
    return found


def bulk_change(config: DataFrame, resource: str, sampler: str, section: str, op: str, uid: str, payload: str | None, version: Column, capable: DataFrame | None = None) -> DataFrame:
    """One change for every matching sampler, of which there must be one; ``capable`` (resource, sampler) leaves out those that can't take it."""
    rows = required_targets(config, resource, sampler)
    if capable is not None:
        rows = rows.join(capable, ["resource", "sampler"], "left_semi")
    return rows.select(version.alias("version"), "resource", "sampler", F.lit(section).alias("section"), F.lit(op).alias("op"), F.lit(uid).alias("uid"), F.lit(payload).cast("string").alias("payload"))


def preset_changes(samplers: DataFrame, version: Column) -> DataFrame:
    """Defaults of a new sampler: limits in 100 and out 10, a stream of everything, its structure digest each minute."""
    stream = '{"name":"all","rule":"true"}'
    digest = '{"stream":"all","kind":"struct-digest","period":"60 seconds","max_fields":100}'
    rows = [("limiter_in", "set", "", '{"limit":100}'), ("limiter_out", "set", "", '{"limit":10}'), ("streams", "upsert", "all", stream), ("digests", "upsert", "struct", digest)]
    return _preset(samplers, version, rows)


def implicit_changes(records: DataFrame, config: DataFrame, version: Column) -> DataFrame:
    """What samplers that send records but have no configuration get: a raw stream of everything, both digests at the collector."""
    unknown = records.select("resource", "sampler").distinct().join(config, ["resource", "sampler"], "left_anti")
    stream = '{"name":"all","rule":"true","export_raw":true,"max_sample_size":10240}'
    digest = '{{"stream":"all","kind":"{}","period":"60 seconds","location":"collector"}}'
    return _preset(unknown, version, [("streams", "upsert", "all", stream), *(("digests", "upsert", k.split("-")[0], digest.format(k)) for k in ("struct-digest", "value-digest"))])


def dead_letter_changes(samplers: DataFrame, version: Column) -> DataFrame:
    """An event, at most one a second, for every sample that a dead-letter sampler sends."""
    event = '{"name":"sample_sent_to_dlq","stream":"all","rule":"true","limit":1}'
    return _preset(samplers, version, [("events", "upsert", "sample_sent_to_dlq", event)])


def _preset(samplers: DataFrame, version: Column, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    each = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(row, ("section", "op", "uid", "payload"), strict=True))) for row in rows))).alias("x")
    return samplers.select(version.alias("version"), "resource", "sampler", each).select("version", "resource", "sampler", "x.*")


def list_resources(config: DataFrame) -> DataFrame:
    return config.groupBy("resource").agg(F.count_distinct("sampler").alias("samplers")).orderBy("resource")


def list_section(config: DataFrame, section: str) -> DataFrame:
    rows = config.where(F.col("section") == section)
    return rows.select("resource", "sampler", "uid", F.get_json_object("payload", "$.name").alias("name")).orderBy("resource", "sampler", "uid")

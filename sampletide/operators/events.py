"""Events: records that a rule over raw records of one stream emits."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampletide.functions.rules import Rule, check_rule
from sampletide.functions.segments import ROWS, cuts_of
from sampletide.operators.sampling import token_bucket
from sampletide.sources.records import merged, record


@dataclass(frozen=True)
class Event:
    uid: str
    name: str
    stream_uid: str
    rule: Rule
    limit: int = -1
    template: dict[str, Column] = field(default_factory=dict)


def template_body(template: dict[str, Column]) -> Column:
    """The JSON object that an export template makes; "" where it fails."""
    body = F.to_json(F.struct(*(v.alias(k) for k, v in sorted(template.items()))), {"ignoreNullFields": "false"})
    return F.coalesce(body, F.lit(""))


def event_hits(records: DataFrame, group: list[Event]) -> DataFrame:
    """A row per raw record and event of ``group`` whose rule it matches, with the event's columns. The records are read once.

    If no rule remembers, records that match none are filtered first, by what Spark can push to the scan; bodies are only rendered for matches.
    """
    rows, columns = records, records.columns
    if not any(e.rule.helpers for e in group):
        some = functools.reduce(operator.or_, (check_rule(rows, e.rule.expression) for e in group))
        rows = rows.where(some)
    for i, e in enumerate(group):
        rows = e.rule.column(rows, f"_hit{i}")
    rows = rows.where(functools.reduce(operator.or_, (F.col(f"_hit{i}") & F.array_contains("stream_uids", e.stream_uid) for i, e in enumerate(group))))
    each = []
    for i, e in enumerate(group):
        body = template_body(e.template) if e.template else F.col("body")
        one = F.struct(F.lit(e.uid).alias("event_uid"), F.lit(e.rule.expression).alias("event_rule"), F.lit(e.stream_uid).alias("event_stream"), F.lit(e.limit).alias("event_limit"), body.alias("event_body"))
        each.append(F.when(F.col(f"_hit{i}") & F.array_contains("stream_uids", e.stream_uid), one))
    rows = rows.withColumn("_event", F.explode(F.array_compact(F.array(*each)))) if len(each) > 1 else rows.withColumn("_event", each[0])
    return rows.select(*[c for c in columns if c not in ("event_uid", "event_rule")], "_event.*")


def event_records(hits: DataFrame) -> DataFrame:
    return record(hits, "event", stream_uids=F.array("event_stream"), stream_names=F.array().cast("array<string>"), encoding=F.lit("json"), body=F.col("event_body"))


def events(records: DataFrame, definitions: list[Event], order: list[str], rows: int = ROWS) -> DataFrame:
    """All events' records; a limited event passes a token bucket a sampler, after its rule matched. A null match is an error of that event only.

    Events whose rules remember nothing share one pass over the records, as do those of one stream whose rules do: what they
    remember is of that stream alone. Limiters of samplers with more than ``rows`` raw records run in blocks.
    """
    raw = records.where(F.col("sample_type") == "raw")
    groups: dict[str | None, list[Event]] = {}
    for e in definitions:
        groups.setdefault(e.stream_uid if e.rule.helpers else None, []).append(e)
    hits = merged(*[event_hits(raw if stream is None else raw.where(F.array_contains("stream_uids", stream)), group) for stream, group in groups.items()])
    if any(e.limit >= 0 for e in definitions):
        cuts = cuts_of(raw, ["resource", "sampler"], order, rows)
        hits = token_bucket(hits, ["event_uid", "resource", "sampler"], F.col("event_limit"), order, cuts=cuts)
    return event_records(hits)


def config_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """uid and action of event definitions (uid, rule, ...): add, remove, rebuild when anything changed."""
    same = [c for c in new.columns if c != "uid"]
    left = old.select("uid", F.struct(*same).alias("was"))
    right = new.select("uid", F.struct(*same).alias("will"))
    both = left.join(right, "uid", "full")
    action = F.when(F.col("was").isNull(), "add").when(F.col("will").isNull(), "remove").when(~F.col("was").eqNullSafe(F.col("will")), "rebuild")
    return both.select("uid", action.alias("action")).where("action is not null")

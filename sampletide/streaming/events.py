"""Events of streams: rules with memory, limits and all, as records come."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampletide.functions.rules import Ordered, Rule
from sampletide.operators.events import Event, event_hits, event_records
from sampletide.streaming.stateful import limited, with_calls


def streamed_events(records: DataFrame, definitions: list[Event], order: list[str], keyed: bool = True, ttl_ms: int = 0, most_keys: int = 0) -> DataFrame:
    """All events' records of a stream of records; limits pass a token bucket an event and sampler.

    All calls of all rules are held by one operator in one state: by (resource, sampler, sample_key), or by (resource, sampler) if the rules
    aren't ``keyed`` or ``most_keys`` bounds the keys of a sampler. A call is asked only of records of its event's stream. Events that aren't
    keyed alike need calls of this function of their own.
    """
    raw, calls, rules = records.where(F.col("sample_type") == "raw"), {}, []
    for i, e in enumerate(definitions):
        named = {name: f"event_call{i}_{name}" for name in e.rule.helpers}
        held = F.array_contains("stream_uids", e.stream_uid)
        for name, call in e.rule.helpers.items():
            if not isinstance(call, Ordered):
                raise ValueError(f"{name} of {e.name} must be an ordered call")
            reached = held if call.reached is None else held & call.reached
            calls[named[name]] = replace(call, reached=reached, after=tuple(named[x] for x in call.after))
        rules.append(replace(e, rule=Rule(e.rule.expression, {name: F.col(column) for name, column in named.items()})))
    if calls:
        by = ["resource", "sampler", *(["sample_key"] if keyed and not most_keys else [])]
        raw = with_calls(raw, by, order, calls, ttl_ms, "sample_key" if most_keys else None, most_keys)
    hits = event_hits(raw, rules).drop(*calls, "admitted")
    if any(e.limit >= 0 for e in definitions):
        hits = limited(hits, ["event_uid", "resource", "sampler"], "event_limit", order)
    return event_records(hits)

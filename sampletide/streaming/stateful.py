"""Rules with memory and limits over streams, keyed by (resource, sampler, sample_key) or as asked.

State lives in Spark's state store (RocksDB), so it survives restarts. Rows of a batch are taken in order of event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sampletide.functions.rules import Ordered
from sampletide.operators.sampling import Bucket

#: For a session that runs these. Columns whose names begin with an underscore lose their names on the way to pandas and aren't accepted.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: The columns of values on their way to the state, and how they are kept: text and whole numbers travel as text, so that neither loses a digit; all others as doubles.
HELD = "value_as_held"
_KINDS = {"string": ("text", str), "tinyint": ("whole", int), "smallint": ("whole", int), "int": ("whole", int), "bigint": ("whole", int)}
_PLACES = ("number", "whole", "text")


class _Remember(StatefulProcessor):
    """The calls of all rules of a group, each of which compares its values with its last one of the key, in one state.

    ``calls``: (kind, step, type of the value, numbers of the calls that must have said yes). With ``most`` a group holds at most so many keys;
    rows of others have no answers. A key that is idle for more than ``ttl_ms`` of event time is forgotten, and gives its place free.
    """

    def __init__(self, calls: list[tuple], names: list[str], ttl_ms: int, order: list[str], key: str | None, most: int) -> None:
        self.calls, self.names, self.ttl_ms, self.order, self.key, self.most = calls, names, ttl_ms, order, key, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "call int, key string", "number double, whole long, text string")
        self.seen = handle.getMapState("seen", "key string", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        # a key's rows of one batch have to be ordered: the source's limits bound them (maxFilesPerTrigger, maxOffsetsPerTrigger)
        part = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        keys = [str(x) for x in part[self.key].tolist()] if self.key else [""] * len(part)
        columns = [part[f"{HELD}{i}"].tolist() for i in range(len(self.calls))]
        times = part[self.order[0]].astype("datetime64[us]").astype("int64").tolist() if self.ttl_ms else [0] * len(part)
        known = {k[0]: v[0] for k, v in self.seen.iterator()} if self.most else {}  # most keys, and those that have been idle
        alive: dict[str, bool] = {}
        held: dict[tuple[int, str], object] = {}
        answers: list[list[bool | None]] = [[] for _ in self.calls]
        admitted = []
        for at, (name, us) in enumerate(zip(keys, times, strict=True)):
            before = known.get(name)
            if before is None and not self.most and self.ttl_ms and self.seen.containsKey((name,)):
                before = self.seen.getValue((name,))[0]
            if before is not None and self.ttl_ms and us - before > 1000 * self.ttl_ms:
                held.update({(i, name): None for i in range(len(self.calls))})
                known.pop(name, None)
                before = None
            if self.most and before is None:
                others = sum(1 for x in known.values() if not self.ttl_ms or us - x <= 1000 * self.ttl_ms)
                alive[name] = others < self.most
            own = alive.get(name, True)
            admitted.append(own)
            if own and (self.most or self.ttl_ms):
                known[name] = us
            for i, (kind, step, held_as, after) in enumerate(self.calls):
                value = columns[i][at] if own else None
                if value is None or value != value or not all(answers[j][at] for j in after):
                    answers[i].append(None)
                    continue
                place, parse = _KINDS.get(held_as, ("number", float))
                value = parse(value)
                if (i, name) not in held:
                    held[i, name] = self.last.getValue((i, name))[_PLACES.index(place)] if self.last.containsKey((i, name)) else None
                last = held[i, name]
                answers[i].append(bool(last is None or (value == last + step if kind == "complete" else value >= last if kind == "asc" else value <= last)))
                held[i, name] = value
        for (i, name), value in held.items():
            place = _KINDS.get(self.calls[i][2], ("number", float))[0]
            if value is not None:
                self.last.updateValue((i, name), tuple(value if p == place else None for p in _PLACES))
            elif self.last.containsKey((i, name)):
                self.last.removeKey((i, name))
        for name in set(keys):
            if name in known:
                self.seen.updateValue((name,), (known[name],))
        out = part.drop(columns=[f"{HELD}{i}" for i in range(len(self.calls))])
        more = {c: pd.array(x, dtype="boolean") for c, x in zip(self.names, answers, strict=True)}
        yield out.assign(**more, **({"admitted": admitted} if self.most else {}))

    def close(self) -> None:
        pass


class _Limit(StatefulProcessor):
    """A token bucket a key, of ``limit`` or of what the key's rows have in the column of that name: -1 lets all through, 0 none."""

    def __init__(self, limit: int | str, order: list[str]) -> None:
        self.limit, self.order = limit, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        part = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        if not len(part):
            return
        limit = int(part[self.limit].iloc[0]) if isinstance(self.limit, str) else self.limit
        if limit > 0:
            bucket = Bucket(limit)
            if self.state.exists():
                bucket.tokens, bucket.last = self.state.get()
            times = part[self.order[0]].astype("datetime64[us]").astype("int64").tolist()
            part = part[np.array([bucket.take(x) for x in times], bool)]
            self.state.update((bucket.tokens, bucket.last))
        if limit:
            yield part

    def close(self) -> None:
        pass


def _named(stream: DataFrame) -> None:
    if wrong := [c for c in stream.columns if c.startswith("_")]:
        raise ValueError(f"these columns would lose their names: {wrong}")


def with_calls(stream: DataFrame, by: list[str], order: list[str], calls: dict[str, Ordered], ttl_ms: int = 0, key: str | None = None, most_keys: int = 0) -> DataFrame:
    """With a boolean column for each call: what it says of each row, by the rows before it of its ``by``, which may be in earlier batches.

    ``by`` names the key's columns; what calls themselves say about grouping and order isn't looked at. Only where ``most_keys`` bounds the keys of a
    group is the group one sequence, with ``key`` inside it; then admitted is false for rows of keys first seen after so many others.
    """
    _named(stream)
    if bool(most_keys) != bool(key):
        raise ValueError("a bound on keys needs the key's column, and the other way round")
    names, rows, plan = list(calls), stream, []
    for i, (name, call) in enumerate(calls.items()):
        if call.kind not in ("asc", "desc", "complete"):
            raise ValueError("the kind is asc, desc or complete")
        value = call.value if call.reached is None else F.when(call.reached, call.value)
        kind = stream.select(value.alias("x")).schema["x"].dataType.simpleString()
        rows = rows.withColumn(f"{HELD}{i}", value.cast("string" if kind in _KINDS else "double"))
        plan.append((call.kind, call.step, kind, tuple(names.index(x) for x in call.after if x in names[:i])))
        if len(plan[-1][3]) != len(call.after):
            raise ValueError(f"{name} comes after calls that aren't before it: {call.after}")
    more = [T.StructField(name, T.BooleanType()) for name in [*names, *(["admitted"] if most_keys else [])]]
    schema = T.StructType([*stream.schema.fields, *more])
    return rows.groupBy(*by).transformWithStateInPandas(_Remember(plan, names, ttl_ms, order, key, most_keys), schema, "append", "none")


def remembered(stream: DataFrame, by: list[str], order: list[str], value: str, mode: str, step: float = 1, ttl_ms: int = 0, key: str | None = None, most_keys: int = 0) -> DataFrame:
    """With in_order: what ``sequence`` (mode asc, desc) or ``complete`` says of each row; see ``with_calls``."""
    return with_calls(stream, by, order, {"in_order": Ordered(mode, F.col(value), by, order, step)}, ttl_ms, key, most_keys)


def limited(stream: DataFrame, by: list[str], limit: int | str, order: list[str]) -> DataFrame:
    """What a token bucket a key lets through. ``limit`` may name a column that is constant in a key."""
    if isinstance(limit, int) and limit < 0:
        return stream
    if isinstance(limit, int) and limit == 0:
        return stream.where("false")
    _named(stream)
    return stream.groupBy(*by).transformWithStateInPandas(_Limit(limit, order), stream.schema, "append", "none")


class _Live(StatefulProcessor):
    """The latest point of a series, until none has come for ``ttl_ms`` of event time."""

    def __init__(self, series: list[str], ttl_ms: int) -> None:
        self.series, self.ttl_ms = series, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "ms long, us long, value double")

    def _row(self, key, us: int, value: float | None, live: bool) -> pd.DataFrame:
        return pd.DataFrame({**dict(zip(self.series, ([x] for x in key), strict=True)), "ts": pd.to_datetime([us], unit="us"), "value": [value], "live": [live]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        best = None
        for part in rows:  # a maximum: parts are never held together
            times = part["ts"].astype("datetime64[us]").astype("int64").tolist()
            best = max([*([best] if best else []), *zip(times, part["value"].tolist(), strict=True)])
        if self.latest.exists():
            ms, us, value = self.latest.get()
            if best[0] < us or best == (us, value):
                return
            self.handle.deleteTimer(ms)
        due = -(-best[0] // 1000) + self.ttl_ms
        self.latest.update((due, *best))
        self.handle.registerTimer(due)
        yield self._row(key, *best, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.latest.exists() and self.latest.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            _, us, value = self.latest.get()
            self.latest.clear()
            yield self._row(key, us, value, False)

    def close(self) -> None:
        pass


def live_series(points: DataFrame, series: list[str], ttl_ms: int = 300_000) -> DataFrame:
    """Changes of the live series of a stream with a watermark on ts: ``series``, ts, value, live.

    A row with live for each new latest point, and one without when event time is ``ttl_ms`` beyond the last. A series that comes back is live again.
    """
    rows = points.select(*series, "ts", F.col("value").cast("double").alias("value"))
    schema = T.StructType([*(rows.schema[c] for c in [*series, "ts", "value"]), T.StructField("live", T.BooleanType())])
    return rows.groupBy(*series).transformWithStateInPandas(_Live(series, ttl_ms), schema, "append", "EventTime")

"""Sampling, limits, stream assignment and statistics of samples."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampletide.functions.rules import check_rule
from sampletide.functions.segments import ROWS, Cuts, Scan, cuts_of, joined
from sampletide.sources.records import record


@dataclass(frozen=True)
class Stream:
    uid: str
    name: str
    rule: str = "true"
    export_raw: bool = False
    keyed: bool = False
    max_sample_size: int = 0


def keep_by_key(key: Column, rate: int, sample_empty: bool = False) -> Column:
    """Whether a sample of this key is kept at 1 in ``rate``: always the same answer for one key."""
    if rate < 1:
        raise ValueError("the rate must be 1 or more")
    if rate == 1:
        return F.lit(True)
    key = F.coalesce(key, F.lit(""))
    low = F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("bigint") <= 4294967295 // rate
    return (key == "") | low if sample_empty else low


def within_window(df: DataFrame, by: list[str], limit: int, order: list[str], window: str = "1 second") -> DataFrame:
    """The first ``limit`` rows of each fixed window and group; -1: all."""
    if limit < 0:
        return df
    w = Window.partitionBy(*by, "_window").orderBy(*order)
    ranked = df.withColumn("_window", F.window("ts", window).start).withColumn("_rank", F.row_number().over(w))
    return ranked.where(F.col("_rank") <= limit).drop("_window", "_rank")


#: Tokens are counted in millionths, and times in microseconds, so that nothing is rounded.
TOKEN = 1_000_000
#: The time of rows without one: before all others.
_LONG_AGO = -(1 << 62)


class Bucket:
    """A bucket that starts full and fills by ``limit`` tokens a second up to ``limit``; a sample takes one."""

    def __init__(self, limit: int, tokens: int | None = None) -> None:
        self.limit, self.most, self.last = limit, limit * TOKEN, None
        self.tokens = self.most if tokens is None else tokens

    def take(self, at: int) -> bool:
        """Whether a sample at a time in microseconds gets a token."""
        if self.last is None:
            self.last = at
        elif at > self.last:
            self.tokens = min(self.most, self.tokens + (at - self.last) * self.limit)
            self.last = at
        if self.tokens < TOKEN:
            return False
        self.tokens -= TOKEN
        return True


def _changes(batch: pa.RecordBatch, names: list[str], before: pa.RecordBatch | None) -> np.ndarray:
    """Whether each row differs from the one before it in any of ``names``; nulls are equal. ``before``: the row before the first."""
    out = np.zeros(batch.num_rows, bool)
    for name in names:
        column = batch.column(name)
        whole = pa.concat_arrays([before.column(name) if before else column[:1], column])
        out |= np.diff(whole.dictionary_encode("encode").indices.to_numpy()) != 0
    if before is None and len(out):
        out[0] = True
    return out


def _in_blocks(rows: DataFrame, names: list[str], order: list[str]) -> DataFrame:
    return rows.repartition(*names).sortWithinPartitions(*names, *order)


class _Block:
    """What a block of samples does to its limiter's bucket, whatever tokens its first sample finds. Exact, in millionths.

    A start is told by what it lacks of a full bucket, and so is what is left of it. Starts are held in ``pieces`` of upper end, known, lacks: all starts up
    to there share one lack (known), or each lacks itself and ``lacks`` more. A sample cuts pieces where starts have been full meanwhile
    and where they have no token for it; neighbours that are alike again are one piece. Mostly all starts soon meet in one (``full``).
    At one token a second many pieces may live long, but then all that matters is when the second after the last taken sample is
    over: ``chains`` holds those times in order, and whose starts they are. Starts that take the same sample have one future.
    """

    #: Pieces that are carried for a block; beyond, it runs when its start is known.
    MOST = 1024

    def __init__(self, at: int, limit: int, given: int | None) -> None:
        self.limit, self.first, self.last, self.n, self.most = limit, at, at, 0, limit * TOKEN
        self.full = Bucket(limit, given) if given is not None else None
        self.pieces: list[tuple[int, bool, int]] = [(self.most, False, 0)]
        # the least and the greatest lack of all starts, and what all lack more than their pieces tell
        self.low, self.high, self.more = 0, self.most, 0
        # for one token a second: starts by the time at which they have a token, up to each of ``uppers``
        self.chains: deque[tuple[int, list[int]]] = deque()
        self.uppers: list[int] = []

    def add(self, at: int) -> None:
        gap, self.last = max(0, at - self.last) if self.n else 0, max(at, self.last)
        self.n += 1
        if self.full is not None:
            self.full.take(at)
        elif gap >= TOKEN:
            self.full = Bucket(self.limit)
            self.full.take(at)
        elif self.limit == 1:
            self._chained()
        elif len(self.pieces) <= self.MOST:
            self._met(gap * self.limit)

    def _met(self, come: int) -> None:
        """A sample after ``come`` has come into the bucket."""
        free, low, high = self.most - TOKEN, self.low - come, self.high - come
        if low >= 0 and (low > free or high <= free):  # all starts do the same
            step = (TOKEN if high <= free else 0) - come
            self.low, self.high, self.more = self.low + step, self.high + step, self.more + step
            return
        begin, more, out, lows, highs = 0, self.more - come, [], [], []
        for upper, known, lacks in self.pieces:
            lacks += more
            if known:
                lacks = max(0, lacks)
                parts = [(upper, True, lacks + TOKEN if lacks <= free else lacks)]
            else:
                was_full, takes = min(upper, -lacks), min(upper, free - lacks)
                parts = [(was_full, True, TOKEN), (takes, False, lacks + TOKEN), (upper, False, lacks)]
            for end, sure, lack in parts:
                if end >= begin:
                    lows.append(lack if sure else begin + lack)
                    highs.append(lack if sure else end + lack)
                    if out and out[-1][1] == sure and out[-1][2] == lack:
                        out.pop()
                    out.append((end, sure, lack))
                    begin = end + 1
        self.pieces, self.low, self.high, self.more = out, min(lows), max(highs), 0
        if self.low == self.high:
            self.full = Bucket(self.limit, self.most - self.low)
            self.full.last = self.last

    def _chained(self) -> None:
        at, own = self.last, []
        while self.chains and self.chains[0][0] <= at:
            own += self.chains.popleft()[1]
        if not self.uppers or self.uppers[-1] < min(at, self.first + TOKEN):
            own.append(len(self.uppers))
            self.uppers.append(at)
        if own:
            self.chains.append((at + TOKEN, own))

    def _told(self) -> list[tuple[int, bool, int]]:
        """The pieces at the time of the last sample."""
        if self.limit > 1:
            return [(upper, known, lacks + self.more) for upper, known, lacks in self.pieces]
        lacks, passed = [0] * len(self.uppers), self.last - self.first
        for end, starts in self.chains:
            for i in starts:
                lacks[i] = max(0, end - self.last)
        kept = [i for i, x in enumerate(lacks) if i + 1 == len(lacks) or x != lacks[i + 1]]
        return [*((self.uppers[i] - self.first, True, lacks[i]) for i in kept), (self.most, False, -passed)]

    def row(self) -> list:
        """first, last, most, fixed (tokens left, if they are known), uppers, known, lacks (null if they aren't needed or too many)."""
        told = self._told() if self.full is None else []
        some = 0 < len(told) <= self.MOST
        return [self.first, self.last, self.limit, None if self.full is None else self.full.tokens, *([list(x) for x in zip(*told, strict=True)] if some else [None] * 3)]


_BLOCK = "first long, last long, most int, fixed long, uppers array<long>, known array<boolean>, lacks array<long>"


def _left(block: dict, at: int) -> int | None:
    """The tokens that a sample at a time after a block finds, or None if that isn't known without running the block."""
    full, idle, x = block["most"] * TOKEN, at - block["last"], block["start"]
    if idle >= TOKEN:
        return full
    left = block["fixed"]
    if left is None and x is not None and block["uppers"] is not None:
        i = bisect_left(block["uppers"], full - x)
        left = (full if block["known"][i] else x) - block["lacks"][i]
    return None if left is None else min(full, left + max(0, idle) * block["most"])


def _blocks(rows: DataFrame, names: list[str], order: list[str]) -> DataFrame:
    """A row a block: what ``_Block`` says of it, from the start _given if there is one."""
    schema = T.StructType([*(rows.schema[c] for c in names), *T.StructType.fromDDL(_BLOCK).fields])
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, key, block = None, None, None

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(key.column(c) for c in names), *(pa.array([v], t) for v, t in zip(block.row(), kinds, strict=True))], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = _changes(batch, names, before).tolist()
            before = batch.slice(batch.num_rows - 1).select(names)
            limits, given = batch.column("_limit").to_pylist(), batch.column("_given").to_pylist()
            for i, at in enumerate(batch.column("_at").to_pylist()):
                if new[i]:
                    if block:
                        yield ended()
                    key, block = batch.slice(i, 1), _Block(at, limits[i], given[i])
                block.add(at)
        if block:
            yield ended()

    return _in_blocks(rows, names, order).select(*names, "_at", "_limit", "_given").mapInArrow(run, schema)


def _block_starts(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The tokens (_start) that the first row of each block of the large groups finds.

    Every block tells what it does to any start; the starts then follow one from the other, a few numbers a block, of
    which there are ``MOST`` at most. A block of more pieces than it may tell (starts that differ for good, as when thousands of samples come
    in every second at the same thousands of places) runs when its start is known.
    """
    names, spark = [*by, "_segment"], rows.sparkSession
    rows = rows.where((F.col("_segment") >= 0) & (F.col("_limit") > 0)).select(*names, *[c for c in order if c not in names], "_at", "_limit")
    kinds = [rows.schema[c] for c in names]
    table = _blocks(rows.withColumn("_given", F.lit(None).cast("long")), names, order).toArrow()
    groups: dict[str, list[dict]] = {}
    for i, block in enumerate(table.to_pylist()):
        groups.setdefault(repr([block[c] for c in by]), []).append(block | {"row": i, "start": None})

    def of(column: str, blocks: list[dict]) -> DataFrame:
        found = table.take(pa.array([b["row"] for b in blocks], pa.int64())).select(names)
        return spark.createDataFrame(found.append_column(column, pa.array([b["start"] for b in blocks], pa.int64())), T.StructType([*kinds, T.StructField(column, T.LongType())]))

    for blocks in groups.values():
        blocks.sort(key=lambda b: b["_segment"])
        blocks[0]["start"] = blocks[0]["most"] * TOKEN
    while True:
        stuck = []
        for blocks in groups.values():
            for a, b in zip(blocks, blocks[1:], strict=False):
                b["start"] = _left(a, b["first"]) if b["start"] is None else b["start"]
                if b["start"] is None and a["start"] is not None:
                    stuck.append(a)
        if not stuck:
            return of("_start", [b for blocks in groups.values() for b in blocks])
        some = joined(rows, of("_given", stuck), names).where("_given is not null")
        done = {repr([r[c] for c in names]): r["fixed"] for r in _blocks(some, names, order).toArrow().to_pylist()}
        for b in stuck:
            b["fixed"] = done[repr([b[c] for c in names])]


def token_bucket(df: DataFrame, by: list[str], limit: int | Column, order: list[str], rows: int = ROWS, cuts: Cuts | None = None) -> DataFrame:
    """The rows that a token bucket a group lets through, in the order of ``order`` (ts first). -1: all; 0: none.

    A group is a sequence, sorted by Spark and streamed through its bucket, never held. A group of more than ``rows`` rows is cut
    into blocks that run side by side, each from the tokens that ``_block_starts`` has found for it. Groups share nothing, a null is a
    key like others, and rows without a time come first, all at one. ``limit`` may be a column that is constant in a
    group. ``cuts`` may be those of a table that ``df`` is a part of, by some of ``by``.
    """
    if isinstance(limit, int) and limit < 0:
        return df
    if isinstance(limit, int) and limit == 0:
        return df.where("false")
    at = F.coalesce(F.unix_micros(F.col(order[0]).cast("timestamp")), F.lit(_LONG_AGO))
    given = df.withColumn("_limit", F.lit(limit) if isinstance(limit, int) else limit.cast("int")).withColumn("_at", at)
    cuts = cuts or cuts_of(given, by, order, rows)
    given, names, columns = cuts.rows(given), [*by, "_segment"], df.columns
    if cuts.table is None:
        given = given.withColumn("_start", F.lit(None).cast("long"))
    else:
        given = joined(given, _block_starts(given, by, order), names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, bucket = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _changes(batch, names, before).tolist()
            before = batch.slice(batch.num_rows - 1).select(names)
            limits, starts, keep = batch.column("_limit").to_pylist(), batch.column("_start").to_pylist(), []
            for i, at in enumerate(batch.column("_at").to_pylist()):
                if new[i]:
                    bucket = Bucket(max(0, limits[i]), starts[i])
                keep.append(limits[i] < 0 or bucket.take(at))
            yield batch.select(columns).filter(pa.array(keep))

    return _in_blocks(given, names, order).mapInArrow(run, df.schema)


def assign_streams(df: DataFrame, streams: list[Stream]) -> DataFrame:
    """With stream_uids of every stream whose rule is true, and errors (rules that gave no answer, samples too large)."""
    hits, errors = [], []
    for s in streams:
        rule = check_rule(df, s.rule)
        large = F.col("sample_size") > s.max_sample_size if s.max_sample_size > 0 else F.lit(False)
        hits.append(F.when(rule & ~large, F.lit(s.uid)))
        errors.append(F.when(large, F.lit(f"{s.name}: sample too large")).when(rule.isNull(), F.lit(f"{s.name}: rule error")))
    return df.withColumn("stream_uids", F.array_compact(F.array(*hits))).withColumn("errors", F.array_compact(F.array(*errors)))


def raw_export(assigned: DataFrame, streams: list[Stream]) -> DataFrame:
    """Raw records of samples that some exporting stream holds; they name all their streams."""
    uids = [s.uid for s in streams if s.export_raw]
    chosen = assigned.where(F.arrays_overlap("stream_uids", F.array(*map(F.lit, uids)))) if uids else assigned.where("false")
    return record(chosen, "raw", encoding=F.lit("json"))


def sampler_pipeline(df: DataFrame, streams: list[Stream], limit_in: int, rate: int, limit_out: int, by: list[str], order: list[str], rows: int = ROWS) -> DataFrame:
    """Limiter in, key sampling, streams, limiter out (only what some stream holds takes tokens). Both limiters cut large groups alike."""
    cuts = cuts_of(df, by, order, rows)
    entered = token_bucket(df, by, limit_in, order, cuts=cuts)
    assigned = assign_streams(entered.where(keep_by_key(F.col("sample_key"), rate)), streams)
    return token_bucket(assigned.where(F.size("stream_uids") > 0), by, limit_out, order, cuts=cuts)


def sampling_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """evaluated, exported and digested samples a group, from boolean columns of these names."""
    return df.groupBy(*by).agg(F.count("*").alias("evaluated"), F.count_if("exported").alias("exported"), F.count_if("digested").alias("digested"))


def stats_rollup(counters: DataFrame) -> DataFrame:
    """Latest cumulative counters of every instance, summed over the instances of a sampler."""
    last = counters.groupBy("resource", "sampler", "instance").agg(F.max(F.struct("ts", "evaluated", "exported")).alias("last"))
    return last.groupBy("resource", "sampler").agg(F.sum("last.evaluated").alias("evaluated"), F.sum("last.exported").alias("exported"), F.count("*").alias("instances"))


def collector_stats(records: DataFrame, period: str = "1 minute") -> DataFrame:
    """Records a period, and so far, of each sampler."""
    per = records.groupBy("resource", "sampler", F.window("ts", period).start.alias("period")).agg(F.count("*").alias("collected"))
    return per.withColumn("total", F.sum("collected").over(Window.partitionBy("resource", "sampler").orderBy("period")))


def translate_streams(records: DataFrame, config: DataFrame) -> DataFrame:
    """stream_uids from stream_names where there are names and no uids and the sampler is known; unknown names are errors.

    ``config``: resource, sampler, name, uid. A record looks its names up in one map a sampler.
    """
    names = config.where("name is not null").groupBy("resource", "sampler", "name").agg(F.min("uid").alias("uid"))  # of a repeated name the least uid
    maps = names.groupBy("resource", "sampler").agg(F.map_from_entries(F.collect_list(F.struct("name", "uid"))).alias("_uids"))
    rows = records.join(maps, ["resource", "sampler"], "left")
    return _translated(rows, F.col("_uids").isNotNull(), lambda n: F.element_at("_uids", n)).drop("_uids")


def _least_uids(streams: DataFrame) -> DataFrame:
    """The least uid that each name (resource, sampler, name) has from a time ``ts`` on, null if none: a row for each time at which it may change.

    The changes of a name are sorted by Spark and streamed; what is held are the definitions in force at one time.
    """
    names = ["resource", "sampler", "name"]
    held = streams.where("uid is not null and since is not null and (until is null or since < until)")
    changes = held.select(*names, F.col("since").alias("ts"), "uid", F.lit(1).alias("_by")).unionByName(held.where("until is not null").select(*names, F.col("until").alias("ts"), "uid", F.lit(-1).alias("_by")))
    schema = changes.drop("_by").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held, heap, least = None, {}, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = _changes(batch, names, before).tolist()
            time = _changes(batch, [*names, "ts"], before).tolist()
            ended, ends = [], []  # the last row of each time, and the least uid then
            for i, (uid, by) in enumerate(zip(batch.column("uid").to_pylist(), batch.column("_by").to_pylist(), strict=True)):
                if time[i] and (i or before):
                    ended.append(i)
                    ends.append(least)
                if key[i]:
                    held, heap = {}, []
                if by > 0 and uid not in held:
                    heappush(heap, uid)
                held[uid] = held.get(uid, 0) + by
                while heap and not held[heap[0]]:
                    del held[heappop(heap)]
                least = heap[0] if heap else None
            rows = pa.Table.from_batches([*([before] if before else []), batch])
            at = pa.array([i - (not before) for i in ended], pa.int64())
            before = batch.slice(batch.num_rows - 1)
            yield from rows.take(at).select([*names, "ts"]).append_column("uid", pa.array(ends, pa.string())).to_batches()
        if before:
            yield before.select([*names, "ts"]).append_column("uid", pa.array([least], pa.string()))

    return _in_blocks(changes, names, ["ts"]).mapInArrow(run, schema)


def translate_streams_in_force(records: DataFrame, streams: DataFrame, rows: int = ROWS) -> DataFrame:
    """The same by the configuration that was in force at a record's ts (``streams``: resource, sampler, name, uid, since, until). A sampler is known from its first definition on.

    Names and the changes of their uids are scanned together in the order of time, so the work is that of a sort, however long a sampler's log is.
    """
    sampler, names, asked = ["resource", "sampler"], ["resource", "sampler", "name"], ["resource", "sampler", "ts", "stream_names"]
    named = streams.where("name is not null")
    first = named.groupBy(*sampler).agg(F.min("since").alias("_first"))
    rows_in = records.where((F.size("stream_names") > 0) & (F.size("stream_uids") == 0)).select(*asked)
    each = lambda df: df.select(*asked, F.explode(F.array_distinct("stream_names")).alias("name")).join(named.select(*names).distinct(), names, "left_semi")
    cuts = cuts_of(each(rows_in).select(*names, "ts"), names, ["ts"], rows)
    changes = _least_uids(named).withColumn("stream_names", F.lit(None).cast("array<string>")).withColumn("_asked", F.lit(0))
    both = each(rows_in.distinct()).withColumn("uid", F.lit(None).cast("string")).withColumn("_asked", F.lit(1)).unionByName(changes)
    scan = Scan.of(both, names, ["ts", "_asked"], cuts=cuts).with_last("_held", F.when(F.col("_asked") == 0, F.struct("uid")))
    found = scan.done().where("_asked = 1 and _held.uid is not null")
    maps = found.groupBy(*asked).agg(F.map_from_entries(F.collect_list(F.struct("name", "_held.uid"))).alias("_uids"))
    out = records.join(first, sampler, "left").join(maps, asked, "left").select(*records.columns, "_first", "_uids")
    return _translated(out, F.coalesce(F.col("_first") <= F.col("ts"), F.lit(False)), lambda n: F.element_at("_uids", n)).drop("_uids", "_first")


def _translated(rows: DataFrame, known: Column, uid: Callable[[Column], Column]) -> DataFrame:
    applies = (F.size("stream_names") > 0) & (F.size("stream_uids") == 0) & known
    found = F.transform("stream_names", uid)
    unknown = F.filter("stream_names", lambda n: uid(n).isNull())
    none = F.array().cast("array<string>")
    changed = {"stream_uids": F.when(applies, F.array_compact(found)).otherwise(F.col("stream_uids")), "stream_names": F.when(applies, none).otherwise(F.col("stream_names"))}
    return rows.withColumns({**changed, "errors": F.when(applies, unknown).otherwise(none)})

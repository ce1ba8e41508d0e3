"""Repeated passages across documents, and their removal.

A window is ``window`` consecutive words of one document; it is repeated if its word sequence starts anywhere else too.

1. Anchors. Of the ``GRAM``-word runs inside a window the one of least hash is its anchor, so equal windows have
   equal anchors. The windows of one anchor form a span. Shuffled by anchor, equal spans confirm each other at once; spans
   whose anchor recurs with other words around it stay open; all others are settled as not repeated.
2. Windows. The windows of open spans, and those of one span of each confirmed kind as witnesses, are shuffled
   by hash; those that meet no equal are not repeated.
3. Automata. Both shuffles only confirm which passages recur, each kept once: a confirmed kind of span by its witness, the runs
   of repeated windows of open spans by themselves. Passages are dealt to shards by their anchor, which all their windows hold, and every text sends
   the spans of recurring anchors to those shards. Aho-Corasick automata over ids of word hashes locate each occurrence there, which
   is what the texts lose.

Equal rows of one map slice are merged before each shuffle, so a passage in a third of all documents sends a row a
slice. Hashes hold 64 bits, for windows 96. Null texts have no words; repeated rows repeat each other's windows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampletide.llm.common import HEAVY, batch_of, partitions, slices, written
from sampletide.llm.wordhash import Words, mixed, runs, spans, words_of

WINDOW, GRAM = 35, 8
#: Bits of a place that hold four times the word and the status; those above check that it is a place of this text, as row_ids are hashes.
PLACE = 43
#: Bytes of passages and ranges that one automaton and its stream take.
SHARD_BYTES = 1 << 19
#: An anchor with more ranges than this is split.
HOT = 10_000
#: What the shuffle by anchor says of a span: its anchor recurs; it is confirmed; it is confirmed and stands for its kind.
OPEN, SURE, WITNESS = 1, 2, 3


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word whether a window starts there, and where that window's anchor is."""
    n = max(0, len(words.hash) - window + 1)
    if not n:
        return np.zeros(0, bool), np.zeros(0, np.int64)
    grams = runs(words.hash, GRAM)
    at = np.lib.stride_tricks.sliding_window_view(grams, window - GRAM + 1).argmin(1) + np.arange(n)
    return words.doc[:n] == words.doc[window - 1 :], at


def checks(words: Words) -> np.ndarray:
    """20 bits of each text's words."""
    ends = zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)
    return np.array([zlib.crc32(words.data[words.start[a] : words.end[b - 1]]) & 0xFFFFF if b > a else 0 for a, b in ends], np.int64)


def anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    schema = pa.schema([("anchor", pa.int64()), ("span", pa.int64()), ("row_id", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"))
            whole, at = anchors(words, window)
            start = np.flatnonzero(whole)
            if not len(start):
                continue
            at = at[start]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            last = np.append(first[1:], len(at)) - 1
            own = at[first]
            span = spans(words.hash, start[first], start[last] + window).view(np.int64)
            doc = words.doc[own]
            row_id = batch.column("row_id").to_numpy()[doc]
            check = checks(words)
            place = ((own - words.first[doc]) * 4) | (check[doc] << PLACE)
            key = runs(words.hash, GRAM)[own].view(np.int64)
            order = np.lexsort((span, key))
            again = np.zeros(len(own), bool)
            again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (span[order[1:]] == span[order[:-1]])
            multi = np.zeros(len(own), bool)
            multi[order[:-1]] = again[order[1:]]
            # the first of equal spans goes to the shuffle by anchor for all of them; the others are known to be sure
            # row_ids repeat where rows do: the first of equal rows speaks for the others of its slice
            copy = np.ones(batch.num_rows, bool)
            ids = np.stack([batch.column("row_id").to_numpy(), check], 1)
            copy[np.unique(ids, axis=0, return_index=True)[1]] = False
            sent = ~(again & copy[doc])
            columns = {"anchor": np.where(again, row_id, key), "span": span, "row_id": row_id, "place": place + np.where(again, SURE, np.where(multi, WITNESS, 0))}
            yield batch_of(schema, {c: x[sent] for c, x in columns.items()})

    rows = docs.select("row_id", "text").mapInArrow(run, "anchor long, span long, row_id long, place long")
    found = pa.schema([("row_id", pa.int64()), ("place", pa.int64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, before, after in _neighbours(batches, ("anchor", "span"), found):
            if before is None:
                yield part
                continue
            anchor, span, place = (part[c] for c in ("anchor", "span", "place"))
            same = lambda other: (anchor == other["anchor"]) & (span == other["span"])
            twice, more = same(before), same(after) | (place % 4 == WITNESS)
            kin = (anchor == before["anchor"]) | (anchor == after["anchor"])
            status = np.where(twice, SURE, np.where(more, WITNESS, np.where(kin, OPEN, 0)))
            keep = status > 0
            yield batch_of(found, {"row_id": part["row_id"][keep], "place": (place // 4 * 4 + status)[keep]})

    n = partitions(docs.sparkSession)
    return rows.repartition(n, "anchor").sortWithinPartitions("anchor", "span").mapInArrow(meet, "row_id long, place long")


def _neighbours(batches: Iterator[pa.RecordBatch], keys: tuple[str, str], out: pa.Schema) -> Iterator[tuple]:
    """Sorted rows as columns, with the columns of the row before and the row after each. Rows already sure come first, as batches."""
    held: dict[str, np.ndarray] | None = None
    names: list[str] = []
    for batch in batches:
        names = batch.schema.names
        cols = {c: batch.column(c).to_numpy() for c in names}
        sure = cols["place"] % 4 == SURE
        if sure.any():
            yield batch_of(out, {c: cols[c][sure] for c in out.names}), None, None
            cols = {c: x[~sure] for c, x in cols.items()}
        if not len(cols["place"]):
            continue
        if held is None:  # a row before the first that equals nothing
            held = {c: x[:1].copy() for c, x in cols.items()}
            held[keys[0]] ^= 1
        cols = {c: np.concatenate([held[c], x]) for c, x in cols.items()}
        if len(cols["place"]) > 2:
            yield {c: x[1:-1] for c, x in cols.items()}, {c: x[:-2] for c, x in cols.items()}, {c: x[2:] for c, x in cols.items()}
        held = {c: x[-2:] for c, x in cols.items()}
    if held is not None and len(held["place"]) == 2:
        end = {c: x[1:] for c, x in held.items()}
        none = {c: x.copy() for c, x in end.items()}
        none[keys[0]] ^= 1
        yield end, {c: x[:1] for c, x in held.items()}, none


def _statuses(words: Words, places: list, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word at which a window starts its span's status (0: not repeated), from the texts' lists of places."""
    whole, at = anchors(words, window)
    status, check = np.zeros(len(words.hash) + 1, np.int8), checks(words)
    for d, own in enumerate(places):
        if own is not None and len(own):
            own = np.asarray(own, np.int64)
            own = own[own >> PLACE == check[d]] & ((1 << PLACE) - 1)
            np.maximum.at(status, words.first[d] + own // 4, (own % 4).astype(np.int8))  # a place may be sure for one of equal rows and a witness for another
    return np.where(whole, status[at], 0), whole


def places(docs: DataFrame, window: int) -> DataFrame:
    """row_id and places. Equal rows share a row_id, so places are gathered as a set: it has no more than three statuses of each of one text's spans."""
    return anchor_rows(docs, window).groupBy("row_id").agg(F.collect_set("place").alias("places"))


def marked(docs: DataFrame, keep: tuple[str, ...], window: int) -> DataFrame:
    """Every row of ``docs`` (``keep``, row_id, text) with starts: the statuses of its windows as a run-length list, null if all are 0."""
    given = docs.join(places(docs, window), "row_id", "left").select("row_id", "text", *keep, "places")
    schema = T.StructType([f for f in given.schema if f.name != "places"] + [T.StructField("starts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"))
            places = batch.column("places")
            status, _ = _statuses(words, places.to_numpy(zero_copy_only=False).tolist(), window)
            starts = [status[a:b] if b > a and status[a:b].any() else None for a, b in zip(words.first.tolist(), np.append(words.first[1:], len(status)).tolist(), strict=False)][: batch.num_rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(2 + len(keep))), pa.array([None if x is None else _packed(x) for x in starts], pa.binary())], names=["row_id", "text", *keep, "starts"])

    return given.mapInArrow(run, schema)


def _packed(status: np.ndarray) -> bytes:
    cuts = np.flatnonzero(np.concatenate([[True], status[1:] != status[:-1]]))
    return np.stack([np.diff(np.append(cuts, len(status))), status[cuts]], 1).astype("<i4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    pairs = np.frombuffer(data, "<i4").reshape(-1, 2)
    return np.repeat(pairs[:, 1], pairs[:, 0])


def unequal(rows: DataFrame, window: int) -> DataFrame:
    """row_id and alone: the starts of open windows that occur nowhere else, from ``marked`` rows.

    Windows of equal rows equal each other and are never alone, so a list holds one text's windows.
    """
    schema = pa.schema([("hash", pa.int64()), ("check", pa.int64()), ("row_id", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"))
            status = np.zeros(len(words.hash), np.int64)
            for d, data in enumerate(batch.column("starts").to_pylist()):
                own = _unpacked(data)
                status[words.first[d] : words.first[d] + len(own)] = own
            at = np.flatnonzero((status == OPEN) | (status == WITNESS))
            if not len(at):
                continue
            value = spans(words.hash, at, at + window)
            check = (spans(words.second(), at, at + window) >> np.uint64(32)).astype(np.int64)
            value, place = value.view(np.int64), np.where(status[at] == OPEN, ((at - words.first[words.doc[at]]) * 4) | (checks(words)[words.doc[at]] << PLACE), WITNESS)
            order = np.lexsort((place == WITNESS, check, value))
            value, check, place, at = value[order], check[order], place[order], at[order]
            new = np.concatenate([[True], (value[1:] != value[:-1]) | (check[1:] != check[:-1])])
            size = np.diff(np.append(np.flatnonzero(new), len(new)))
            place = np.where(size > 1, WITNESS, place[new])  # equals within the slice need no answer, but are one for others
            yield batch_of(schema, {"hash": value[new], "check": check[new], "row_id": batch.column("row_id").to_numpy()[words.doc[at[new]]], "place": place})

    found = pa.schema([("row_id", pa.int64()), ("place", pa.int64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, before, after in _neighbours(batches, ("hash", "check"), found):
            same = lambda other: (part["hash"] == other["hash"]) & (part["check"] == other["check"])  # noqa: B023, E731
            alone = (part["place"] % 4 != WITNESS) & ~same(before) & ~same(after)
            yield batch_of(found, {"row_id": part["row_id"][alone], "place": part["place"][alone] // 4})

    n = partitions(rows.sparkSession)
    sent = rows.where("starts is not null").select("row_id", "text", "starts").mapInArrow(run, "hash long, check long, row_id long, place long")
    return sent.repartition(n, "hash").sortWithinPartitions("hash", "check").mapInArrow(meet, "row_id long, place long").groupBy("row_id").agg(F.collect_list("place").alias("alone"))


def hot_anchors(rows: DataFrame, window: int, hot: int) -> np.ndarray:
    """The anchors with more than ``hot`` ranges, of which a thousand at most, as any other has less than a thousandth of all."""
    schema = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"))
            status = np.zeros(len(words.hash), np.int64)
            for d, data in enumerate(batch.column("starts").to_pylist()):
                own = _unpacked(data)
                status[words.first[d] : words.first[d] + len(own)] = own
            own = np.unique(anchors(words, window)[1][np.flatnonzero(status)])
            anchor, n = np.unique(runs(words.hash, GRAM)[own].view(np.int64), return_counts=True)
            yield batch_of(schema, {"anchor": anchor, "n": n})

    counts = rows.where("starts is not null").select("text", "starts").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return np.array([r.anchor for r in counts.where(F.col("n") > hot).orderBy(F.desc("n"), "anchor").limit(1000).collect()], np.int64)


def shard_rows(rows: DataFrame, alone: DataFrame, window: int, hot: np.ndarray) -> DataFrame:
    """What goes to the shards, from ``marked`` rows and the starts of open windows that occur nowhere else.

    Passages are runs of repeated windows within a span, of witnesses and open spans; spans that are only sure supply none. Ranges are all
    spans whose anchor recurs, with the row_ids and begins of those of the slice that are equal. Each holds the words of all its windows.

    The shard key is the anchor. Spans of a hot one are halved: windows that begin far before the anchor hold the ``GRAM`` words before
    it, the others those after it, and these become part of the key. Their ranges are dealt to lots, each of which gets their passages.
    """
    if window < 3 * GRAM:
        hot = hot[:0]
    lists = pa.list_(pa.int64())
    schema = pa.schema([("anchor", pa.int64()), ("is_range", pa.bool_()), ("text", pa.binary()), ("row_ids", lists), ("begins", lists)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, "text")):
            words = words_of(batch.column("text"))
            status, supplies = np.zeros(len(words.hash), np.int64), np.zeros(len(words.hash), bool)
            check = checks(words)
            for d, (data, lone) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("alone").to_pylist(), strict=True)):
                a, own = words.first[d], _unpacked(data)
                supplier = (own == OPEN) | (own == WITNESS)
                lone = np.array(lone or [], np.int64)
                supplier[lone[lone >> (PLACE - 2) == check[d]] & ((1 << (PLACE - 2)) - 1)] = False
                status[a : a + len(own)], supplies[a : a + len(own)] = own, supplier
            at, grams = anchors(words, window)[1], runs(words.hash, GRAM)
            for is_range, start in ((False, np.flatnonzero(supplies)), (True, np.flatnonzero(status))):
                if not len(start):
                    continue
                own = at[start]
                heated, before = np.isin(grams[own].view(np.int64), hot), 2 * (own - start) > window - GRAM
                new = (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1) | (heated[1:] & (before[1:] != before[:-1]))
                first = np.flatnonzero(np.concatenate([[True], new]))
                begin, end = start[first], start[np.append(first[1:], len(start)) - 1] + window
                own, heated, before = own[first], heated[first], before[first]
                key, span = grams[own], spans(words.hash, begin, end)
                key[heated] ^= mixed(grams[(own + np.where(before, -GRAM, GRAM))[heated]])
                order = np.lexsort((span, key))
                begin, end, key, span, heated = begin[order], end[order], key[order], span[order], heated[order]
                one = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (span[1:] != span[:-1])]))
                doc = words.doc[begin]
                ids, places = batch.column("row_id").to_numpy()[doc], (begin - words.first[doc]) | (check[doc] << PLACE)
                cuts = np.append(one, len(begin)) if is_range else None
                lot = (ids[one] + task * 31 + number) % HEAVY
                if not is_range:  # hot ones go to every lot
                    copies = np.where(heated[one], HEAVY, 1)
                    lot = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                    one = np.repeat(one, copies)
                    cuts = np.zeros(len(one) + 1, np.int64)
                key = np.where(heated[one], mixed(key[one] + mixed(lot.astype(np.uint64))), key[one]).view(np.int64)
                cuts = pa.array(cuts, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(np.full(len(one), is_range)), pa.array(_pieces(words, begin[one], end[one]), pa.binary())]
                    + [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (ids, places)],
                    schema=schema,
                )

    given = rows.where("starts is not null").join(alone, "row_id", "left").select("row_id", "text", "starts", "alone")
    return given.mapInArrow(run, "anchor long, is_range boolean, text binary, row_ids array<long>, begins array<long>")


def _pieces(words: Words, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    """The words of each stretch as the text has them, those with wide gaps joined by one space."""
    out, data = [], words.data
    size = np.concatenate([[0], np.cumsum(words.end - words.start + 1)])
    for a, b, s, e, most in zip(begin.tolist(), end.tolist(), words.start[begin].tolist(), words.end[end - 1].tolist(), (2 * (size[end] - size[begin])).tolist(), strict=True):
        out.append(data[s:e].tobytes() if e - s <= most else words.text(a, b))
    return out


def automaton_hits(words: Words, is_range: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the passages (texts that are no range) cover words of the ranges: for each maximal stretch its range, first word in it, and size."""
    ids = np.unique(words.hash, return_inverse=True)[1]
    passages = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    flat, first = ids.tolist(), words.first
    for d in np.flatnonzero(~is_range).tolist():
        passages.add_word(tuple(flat[first[d] : first[d + 1]]), int(first[d + 1] - first[d]))
    passages.make_automaton()
    ranges = np.flatnonzero(is_range)
    inside = is_range[words.doc]
    size = first[ranges + 1] - first[ranges]
    begin = np.concatenate([[0], np.cumsum(size + 1)])  # a word that no passage has ends each range
    stream = np.full(begin[-1], len(flat), np.int64)
    stream[np.arange(inside.sum()) + np.repeat(np.arange(len(ranges)), size)] = ids[inside]
    found = np.array([x for hit in passages.iter(tuple(stream.tolist())) for x in hit], np.int64).reshape(-1, 2)
    cover = np.zeros(len(stream) + 1, np.int64)
    np.add.at(cover, found[:, 0] - found[:, 1] + 1, 1)
    np.add.at(cover, found[:, 0] + 1, -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(cover) > 0, [0]]))).reshape(-1, 2)
    own = np.searchsorted(begin, edge[:, 0], "right") - 1
    return ranges[own], edge[:, 0] - begin[own], edge[:, 1] - edge[:, 0]


def occurrences(shards: DataFrame) -> DataFrame:
    """row_id and hits (begin, size) of all stretches that passages cover, from ``shard_rows``.

    Rows are sorted by anchor, passages before ranges. Each slice of them is a shard: one automaton of its passages, through
    which the ranges of the same anchors are streamed. An anchor's passages go on to the next slice while it has ranges.
    """
    found = pa.schema([("row_id", pa.int64()), ("begin", pa.int64()), ("size", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in slices(batches, "text", SHARD_BYTES):
            if held is not None and held.num_rows:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            anchor, is_range = batch.column("anchor").to_numpy(), batch.column("is_range").to_numpy(zero_copy_only=False)
            held = batch.filter(pa.array(~is_range & (anchor == anchor[-1])))
            used = np.where(is_range, np.isin(anchor, anchor[~is_range]), np.isin(anchor, anchor[is_range]))
            if not used.any():
                continue
            batch, is_range = batch.filter(pa.array(used)), is_range[used]
            own, begin, size = automaton_hits(words_of(batch.column("text")), is_range)
            ids, begins = batch.column("row_ids").take(pa.array(own)), batch.column("begins").take(pa.array(own))
            many = pa.compute.list_value_length(ids).to_numpy()
            yield batch_of(found, {"row_id": ids.flatten(), "begin": begins.flatten().to_numpy() + np.repeat(begin, many), "size": np.repeat(size, many)})

    n = partitions(shards.sparkSession)
    hits = shards.repartition(n, "anchor").sortWithinPartitions("anchor", "is_range").mapInArrow(run, "row_id long, begin long, size int")
    return hits.groupBy("row_id").agg(F.collect_set(F.struct("begin", "size")).alias("hits"))


def covers(batch: pa.RecordBatch) -> tuple[Words, np.ndarray]:
    """The words of a slice of rows (text, hits), and which of them go."""
    words = words_of(batch.column("text"))
    cover, check = np.zeros(len(words.hash) + 1, np.int64), checks(words)
    hits = batch.column("hits")
    doc = np.repeat(np.arange(batch.num_rows), pa.compute.fill_null(pa.compute.list_value_length(hits), 0).to_numpy())
    begin, size = (hits.flatten().field(i).to_numpy() for i in range(2))
    same = begin >> PLACE == check[doc]
    begin, size = words.first[doc[same]] + (begin[same] & ((1 << PLACE) - 1)), size[same]
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + size, -1)
    return words, np.cumsum(cover[:-1]) > 0


def _located(rows: DataFrame, window: int, hot: int, *keep: str) -> DataFrame:
    """The ``marked`` rows with repeated or open windows: ``keep``, text and hits."""
    alone, _ = written(unequal(rows, window), "alone", "zstd")
    hits = occurrences(shard_rows(rows, alone, window, hot_anchors(rows, window, hot)))
    return rows.where("starts is not null").join(hits, "row_id", "left").select(*keep, "text", "hits")


def _row_id() -> Column:
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def _rows(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return docs.select(_row_id().alias("row_id"), F.col("text").cast("string").alias("text"), *keep)


def removal(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    rows, _ = written(marked(_rows(docs, ("doc_id",)), ("doc_id",), window), "marked", "zstd")
    given = _located(rows, window, hot, "doc_id")
    none = F.lit(None).cast(given.schema["hits"].dataType).alias("hits")
    given = given.unionByName(rows.where("starts is null").select("doc_id", "text", none))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, gone = covers(batch)
            n, lost, sha = [], [], []
            for a, b in zip(words.first.tolist(), words.first[1:].tolist(), strict=False):
                n.append(b - a)
                lost.append(int(gone[a:b].sum()))
                sha.append(hashlib.sha256(kept_text(words, a, b, gone)).hexdigest())
            yield batch_of(schema, {"doc_id": batch.column("doc_id"), "n_words": n, "n_removed": lost, "kept_sha256": sha})

    return given.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def kept_text(words: Words, a: int, b: int, gone: np.ndarray) -> bytes:
    keep = np.flatnonzero(~gone[a:b]) + a
    data = words.data
    return b" ".join([data[s:e].tobytes() for s, e in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)])


def without_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """``docs`` with the repeated passages gone from text: documents that lose words are what they keep, joined by one space; others stay as they are."""
    others = [c for c in docs.columns if c != "text"]
    filler = "_" * (1 + max(map(len, docs.columns)))  # a struct needs a field, of a name that no column has
    given = docs.select(_row_id().alias("row_id"), F.col("text").cast("string"), F.struct(F.lit(0).alias(filler), *others).alias("row"))
    rows, _ = written(marked(given, ("row",), window), "marked", "zstd")
    touched = _located(rows, window, hot, "row")
    schema = T.StructType([touched.schema["row"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, gone = covers(batch)
            texts = batch.column("text").to_pylist()
            for d, (a, b) in enumerate(zip(words.first.tolist(), words.first[1:].tolist(), strict=False)):
                if gone[a:b].any():
                    texts[d] = kept_text(words, a, b, gone).decode()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    changed = touched.mapInArrow(run, schema)
    both = changed.unionByName(rows.where("starts is null").select("row", "text"))
    return both.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])

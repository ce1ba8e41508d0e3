"""Best-fit packing of documents into sequences by length patterns.

Every document becomes token ids and an end id; only those longer than a sequence are cut. From the histogram of
piece lengths (at most ``capacity`` rows) the driver enumerates patterns of a few lengths that fill a
sequence, fits their repeat counts by non-negative least squares, rounds them, and packs what is left best-fit
decreasing. The plan has ranges of ranks among pieces of one length; ranks are found without gathering a length
in one task. Null and empty texts are the end id alone; repeated rows are pieces of their own; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampletide.llm.common import batch_of, slices, written
from sampletide.llm.tokenizing import encoder

CAPACITY = 4096
#: Patterns may leave so many tokens empty; lengths in a pattern, the last of them chosen to fill it; patterns that each length leads; about
#: how many pieces of one length are ranked together.
SLACK, MOST, FILL, DRAWS, LOT = 0, 12, 2, 6, 4096


def pieces_of(docs: DataFrame, tokenizer: str, keeps_space: bool = False, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: ``docs``' doc_id, piece, start, length, ids_crc32, and turn (its number in the task, to split hot lengths)."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("turn", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, turn = encoder(tokenizer, keeps_space), 0
        for batch in slices(batches, "text"):
            out: dict[str, list] = {k: [] for k in schema.names}
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for name, x in zip(schema.names, (doc_id, k, start, len(part), zlib.crc32(part.tobytes()), turn), strict=True):
                        out[name].append(x)
                    turn += 1
            yield batch_of(schema, out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, turn long")


def patterns(counts: np.ndarray, capacity: int, slack: int) -> np.ndarray:
    """Rows of up to ``MOST`` lengths (0: none), ascending, that fill a sequence to within ``slack``; counts: by length.

    Every length present leads ``DRAWS`` rows. Lengths drawn by their counts follow while they fit, so that the rows use
    lengths about as often as there are pieces of them, and the longest that fit fill what is left.
    """
    present = np.flatnonzero(counts)
    if not len(present):
        return np.zeros((0, MOST), np.int64)
    rng = np.random.default_rng(1)
    below = np.zeros(capacity + 1, np.int64)  # the longest length present up to each
    below[present] = present
    below = np.maximum.accumulate(below)
    share = np.cumsum(counts[present]) / counts.sum()
    rows = np.zeros((len(present) * DRAWS, MOST), np.int64)
    rows[:, 0] = np.repeat(present, DRAWS)
    rest = capacity - rows[:, 0]
    for k in range(1, MOST - FILL):
        drawn = present[np.minimum(np.searchsorted(share, rng.random(len(rows))), len(present) - 1)]
        rows[:, k] = np.where(drawn <= rest, drawn, 0)
        rest -= rows[:, k]
    for k in range(MOST - FILL, MOST):
        rows[:, k] = below[rest]
        rest -= rows[:, k]
    return np.unique(np.sort(rows[rest <= slack], 1), axis=0)


def fitted(rows: np.ndarray, counts: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Repeat counts x >= 0 of patterns that bring their use of lengths close to ``counts`` (accelerated projected gradient)."""
    n = len(counts)
    weight = (rows > 0).astype(float)
    use = lambda x: np.bincount(rows.ravel(), (weight * x[:, None]).ravel(), n)
    back = lambda r: (weight * r[rows]).sum(1)
    v = np.ones(len(rows))
    for _ in range(8):  # the largest eigenvalue, by powers
        v = back(use(v))
        v /= (norm := np.linalg.norm(v)) or 1
    x = y = np.zeros(len(rows))
    t, target = 1.0, counts.astype(float)
    target[0] = 0
    for _ in range(rounds):
        z = np.maximum(0, y - back(use(y) - target) / (norm * 1.05 or 1))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = z, z + (t - 1) / s * (z - x), s
    return x


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over a histogram: (how many sequences, [(length, pieces of it in each)])."""
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            at = min((r for r in room if r >= length), default=None)
            have, inside = room[at].pop() if at else (left, [])
            if at and not room[at]:
                del room[at]
            free = at or capacity
            each = min(free // length, left)
            full = min(have, left // each)
            room.setdefault(free - each * length, []).append((full, [*inside, (length, each)]))
            if at and have > full:
                room.setdefault(at, []).append((have - full, inside))
            left -= full * each
    return [x for groups in room.values() for x in groups]


def placed(rows: np.ndarray, times: np.ndarray, left: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as sequences, ``times`` each or as often as pieces are left; ``left`` is reduced.

    Whole parts first, the most frequent pattern first, then one more for the largest remainders.
    """
    out: dict[int, int] = {}
    each = [dict(zip(*(x.tolist() for x in np.unique(row[row > 0], return_counts=True)), strict=True)) for row in rows]
    whole = np.floor(times + 1e-6).astype(np.int64)
    for order, repeat in ((np.argsort(-whole, kind="stable"), whole), (np.argsort(whole - times, kind="stable"), (times > whole).astype(np.int64))):
        for i in order.tolist():
            if repeat[i] and (n := min([int(repeat[i]), *(int(left[k]) // m for k, m in each[i].items())])):
                out[i] = out.get(i, 0) + n
                for k, m in each[i].items():
                    left[k] -= n * m
    return [(n, list(each[i].items())) for i, n in out.items()]


def plan(counts: np.ndarray, capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, list[tuple[int, int]]]]:
    """How to pack pieces of lengths 1 to ``capacity``: (how many sequences, [(length, pieces of it in each)])."""
    left = counts.astype(np.int64).copy()
    out = [(int(left[capacity]), [(capacity, 1)])] if left[capacity] else []
    left[capacity] = 0
    rows = patterns(left, capacity, slack)
    if len(rows):
        out += placed(rows, fitted(rows, left), left)
    return out + best_fit(left, capacity)


def ranges(packed: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """The plan by pieces: rows (length, first rank, first sequence, offset, pieces in each), sorted."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for n, inside in packed:
        offset = 0
        for length, each in inside:
            out.append((length, used.get(length, 0), sequence, offset, each))
            used[length] = used.get(length, 0) + n * each
            offset += length * each
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table with length and turn) with sequence_id and offset in place of turn."""
    got = pieces.groupBy("length").agg(F.count("*").alias("n")).toArrow()  # capacity rows at most
    counts = np.zeros(capacity + 1, np.int64)
    counts[got.column("length").to_numpy()] = got.column("n").to_numpy()
    rows = ranges(plan(counts, capacity))
    first = (rows[:, 0] << 44) + rows[:, 1]

    per_length = F.lit(np.maximum(1, -(-counts // LOT)).tolist())
    pieces = pieces.withColumn("lot", F.pmod("turn", F.element_at(per_length, F.col("length").cast("int") + 1))).drop("turn")
    lots = pieces.groupBy("length", "lot").agg(F.count("*").alias("n"))
    lots = lots.select("length", "lot", (F.sum("n").over(Window.partitionBy("length").orderBy("lot")) - F.col("n")).alias("before"))
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "lot").orderBy(*order)) - 1)
    ranked = ranked.join(lots, ["length", "lot"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "lot")
    schema = T.StructType([f for f in ranked.schema if f.name != "rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy().astype(np.int64) for k in ("length", "rank"))
            row = rows[np.searchsorted(first, (length << 44) + rank, side="right") - 1] if len(rank) else np.zeros((0, 5), np.int64)
            since = rank - row[:, 1]
            sequence, offset = row[:, 2] + since // np.maximum(1, row[:, 4]), row[:, 3] + since % np.maximum(1, row[:, 4]) * length
            kept = [i for i, k in enumerate(batch.schema.names) if k != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)], names=[*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def packed_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Where each piece of ``docs`` goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces, _ = written(pieces_of(docs, tokenizer), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

"""Exact top-k inner products by dual cover trees.

Vectors are gathered around pivots into blocks of bounded size, queries and candidates alike, and every block is
indexed by a cover tree: a node's children are centres that lie apart, its points go to the nearest, and it keeps the
radius that covers them. Query trees meet candidate trees in pairs of nodes; a pair is left out when centre product and
covering radii bound every score below the worst k-th score of the query node. A first pass searches each query
block's own cell; its k-th scores let the second leave out pairs of cells, and of blocks, by the same bound from centres and
radii alone. Only then do queries' vectors travel, to the blocks they still have to meet; a task builds a candidate block's
tree once for all of them. Scores are exact integers, by floating point where norms bound them below 2 ** 52, else by whole
numbers of any size; a score beyond 64 bits is an error.

Vectors that are null or hold null or non-finite components, and null ids, take no part; of repeated ids the least
vector counts; vectors of another length are other searches. With fewer candidates than k all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampletide.llm.common import batch_of, partitions, slices, written

SCALE, K, EVERY = 64, 20, 20
#: Rows of a candidate and of a query block, of a leaf, children of a node, and pivots (the fitted sample).
CANDIDATES, QUERIES, LEAF, CHILDREN, PIVOTS = 8192, 2048, 64, 24, 512


class CoverTree:
    """Nodes as arrays: centre (a point's index), covering radius, first and last point in ``order``, children."""

    def __init__(self, whole: np.ndarray) -> None:
        self.whole, self.x = whole, whole.astype(np.float64)
        x = self.x
        self.norm = np.sqrt((x * x).sum(1))
        self.nodes: list[tuple[int, float, int, int, list[int]]] = []
        self.order = np.arange(len(x))
        self._build(0, len(x), int(np.argmin(((x - x.mean(0)) ** 2).sum(1))))

    def _build(self, begin: int, end: int, centre: int) -> int:
        own = self.order[begin:end]
        far = np.sqrt(((self.x[own] - self.x[centre]) ** 2).sum(1))
        number, radius = len(self.nodes), float(far.max())
        self.nodes.append((centre, radius, begin, end, []))
        if end - begin > LEAF and radius > 0:
            centres, near, part = [centre], far, np.zeros(len(own), np.int64)
            most = min(CHILDREN, -(-len(own) // LEAF))  # so that leaves stay about full
            while len(centres) < most and near.max() > radius / 2:  # the next centre is the point farthest from all
                centres.append(int(own[near.argmax()]))
                other = np.sqrt(((self.x[own] - self.x[centres[-1]]) ** 2).sum(1))
                part = np.where(other < near, len(centres) - 1, part)
                near = np.minimum(near, other)
            by = np.argsort(part, kind="stable")
            self.order[begin:end] = own[by]
            sizes, at = np.bincount(part, minlength=len(centres)).tolist(), begin
            for c, n in zip(centres, sizes, strict=True):
                if n:
                    self.nodes[number][4].append(self._build(at, at + n, c))
                at += n
        return number


def search(queries: CoverTree, query_ids: np.ndarray, found: CoverTree, ids: np.ndarray, worst: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query up to k (score, -id) among ``found``, no worse than ``worst``; a query never meets its own id."""
    tops: list[list[tuple[int, int]]] = [[] for _ in query_ids]
    kth = worst.copy()
    small = queries.norm.max(initial=0) * found.norm.max(initial=0) < 1 << 52

    def bound(a: int, b: int) -> float:
        (p, r, *_), (q, s, *_) = queries.nodes[a], found.nodes[b]
        top = float(queries.x[p] @ found.x[q]) + r * found.norm[q] + s * queries.norm[p] + r * s
        return top + 1e-9 * abs(top) + 1e-6

    heap = [(-bound(0, 0), 0, 0)]
    while heap:
        best, a, b = heapq.heappop(heap)
        (_, _, a0, a1, below), (_, _, b0, b1, under) = queries.nodes[a], found.nodes[b]
        mine = queries.order[a0:a1]
        if -best < kth[mine].min():
            continue
        if below or under:
            left, right = below or [a], under or [b]
            if below and under and queries.nodes[a][1] > 2 * found.nodes[b][1]:
                right = [b]
            for i in left:
                least = kth[queries.order[queries.nodes[i][2] : queries.nodes[i][3]]].min()
                for j in right:
                    if (top := bound(i, j)) >= least:
                        heapq.heappush(heap, (-top, i, j))
            continue
        theirs = found.order[b0:b1]
        if small:
            score = np.rint(queries.x[mine] @ found.x[theirs].T).astype(np.int64)
        else:
            score = queries.whole[mine].astype(object) @ found.whole[theirs].T.astype(object)
        for i, j in zip(*np.nonzero((score >= kth[mine, None]).astype(bool)), strict=True):
            q, at = int(mine[i]), int(theirs[j])
            if query_ids[q] == ids[at]:
                continue
            item, top = (int(score[i, j]), -int(ids[at])), tops[q]
            if len(top) < k:
                heapq.heappush(top, item)
            elif item > top[0]:
                heapq.heapreplace(top, item)
            if len(top) == k:
                kth[q] = max(kth[q], top[0][0])
    return tops


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, dim)


def blocks(vectors: DataFrame, most: int) -> DataFrame:
    """Rows (dim, cell, vec_id, v) as blocks of about ``most``: dim, cell, block, ids, data, centre, radius, norm."""
    sizes = vectors.groupBy("dim", "cell").agg(F.count("*").alias("n"))  # PIVOTS rows a length at most
    rows = vectors.join(F.broadcast(sizes), ["dim", "cell"])
    rows = rows.withColumn("lot", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / most)))
    packed = rows.groupBy("dim", "cell", "lot").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("x"))
    schema = pa.schema([("dim", pa.int64()), ("cell", pa.int64()), ("lot", pa.int64()), ("ids", pa.binary()), ("data", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("norm", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, cell, lot, x in zip(*(batch.column(c) for c in ("dim", "cell", "lot", "x")), strict=True):
                rows_ = x.values
                data = rows_.field("v").flatten().to_numpy().astype(np.int64)
                m = data.reshape(-1, dim.as_py()).astype(np.float64)
                c = m.mean(0)
                yield batch_of(schema, {"dim": [dim.as_py()], "cell": [cell.as_py()], "lot": [lot.as_py()], "ids": [rows_.field("vec_id").to_numpy().tobytes()], "data": [data.tobytes()], "centre": [c], "radius": [float(np.sqrt(((m - c) ** 2).sum(1)).max())], "norm": [float(np.sqrt(c @ c))]})

    out = packed.mapInArrow(run, "dim long, cell long, lot long, ids binary, data binary, centre array<double>, radius double, norm double")
    return out.withColumn("block", F.xxhash64("dim", "cell", "lot"))


def valid(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (whole components) and dim of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = table.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), x.alias("x"))
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size("x") > 0))
    rows = rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v").cast("long"))


def celled(vectors: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """With cell: the nearest of at most ``pivots`` vectors, those of least hashed id."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    by_dim: dict[int, list] = {}
    for row in sample:
        by_dim.setdefault(row.dim, []).append(row.v)
    centres = {d: np.unique(np.array(x, np.float64), axis=0) for d, x in by_dim.items()}
    n = vectors.count()
    centres = {d: x[np.linspace(0, len(x) - 1, min(len(x), max(1, n // 2000))).astype(int)] for d, x in centres.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros(batch.num_rows, np.int64)
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d in centres:
                    m = batch.column("v").take(pa.array(at)).flatten().to_numpy().reshape(-1, d).astype(np.float64)
                    cells[at] = ((centres[d] ** 2).sum(1) - 2 * m @ centres[d].T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=[*batch.schema.names, "cell"])

    return vectors.mapInArrow(run, "vec_id long, v array<long>, dim long, cell long")


_FOUND = "block long, query_id long, vec_id long, score long"


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs of blocks (q_block, q_ids, q_data, kth, block, ids, data, dim) searched: up to k rows a query and pair."""
    schema = pa.schema([("block", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, tree = None, None
        for batch in slices(batches, "data", 1):
            row = {c: batch.column(c)[0].as_py() for c in batch.schema.names}
            if row["block"] != kept:  # pairs come by candidate block
                kept, tree = row["block"], CoverTree(_matrix(row["data"], row["dim"]))
            queries, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
            worst = np.frombuffer(row["kth"], np.float64) if row["kth"] is not None else np.full(len(queries), -np.inf)
            tops = search(CoverTree(_matrix(row["q_data"], row["dim"])), queries, tree, ids, worst, k)
            got = [(row["q_block"], int(q), -i, s) for q, top in zip(queries, tops, strict=True) for s, i in top]
            if got:
                yield batch_of(schema, dict(zip(schema.names, map(list, zip(*got, strict=True)), strict=True)))

    return pairs.select("q_block", "q_ids", "q_data", "kth", "block", "ids", "data", "dim").mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _bound(a: str, b: str, r: str, s: str) -> Column:
    """The largest inner product of points within r of a and s of b, with a margin for rounding."""
    top = _dot(a, b) + F.col(r) * F.sqrt(_dot(b, b)) + F.col(s) * F.sqrt(_dot(a, a)) + F.col(r) * F.col(s)
    return top + 0.001 + 1e-9 * F.abs(top)


def _cells(blocks: DataFrame, cell: str, block: str, centre: str, radius: str, names: tuple[str, str], *more: Column) -> DataFrame:
    """A row per cell of blocks: a centre, and the radius around it that covers all of the cell's points."""
    middle = blocks.groupBy("dim", cell).agg(F.min_by(centre, block).alias(names[0]))
    far = F.sqrt(F.aggregate(F.zip_with(centre, names[0], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    rows = blocks.join(middle, ["dim", cell])
    return rows.groupBy("dim", cell).agg(F.any_value(names[0]).alias(names[0]), F.max(far + F.col(radius)).alias(names[1]), *more)


def _meetings(known: DataFrame, found: DataFrame) -> DataFrame:
    """q_block and block of the pairs of different cells that may hold a score as good as the worst k-th of the queries.

    Centres and radii decide, first of whole cells, of which there are at most PIVOTS a length, then of their blocks.
    """
    asks = _cells(known, "q_cell", "q_block", "q_centre", "q_radius", ("q_middle", "q_reach"), F.min("least").alias("least"))
    there = _cells(found, "cell", "block", "centre", "radius", ("middle", "reach"))
    cells = asks.join(there, "dim").where((F.col("q_cell") != F.col("cell")) & (_bound("q_middle", "middle", "q_reach", "reach") >= F.col("least"))).select("dim", "q_cell", "cell")
    blocks = cells.join(found.select("dim", "cell", "block", "centre", "radius"), ["dim", "cell"]).join(known.select("dim", "q_cell", "q_block", "q_centre", "q_radius", "least"), ["dim", "q_cell"])
    return blocks.where(_bound("q_centre", "centre", "q_radius", "radius") >= F.col("least")).select("q_block", "block")


def top_products(table: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score: the k best for each row whose vec_id is divisible by ``every``."""
    n = partitions(table.sparkSession)
    vectors, _ = written(celled(written(valid(table, scale), "vectors")[0]), "cells")
    found, _ = written(blocks(vectors, CANDIDATES), "blocks")
    asked, _ = written(blocks(vectors.where(F.col("vec_id") % every == 0), QUERIES), "queries")
    asked = asked.select("dim", F.col("cell").alias("q_cell"), F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("centre").alias("q_centre"), F.col("radius").alias("q_radius"), F.col("norm").alias("q_norm"))
    own = asked.join(found, (asked.dim == found.dim) & (asked.q_cell == found.cell)).drop(asked.dim).withColumn("kth", F.lit(None).cast("binary")).repartition(n, "block").sortWithinPartitions("block")
    first, _ = written(_best(_searched(own, k), k), "first")

    # each query's k-th score so far, in its block's order
    worst = first.where(F.col("rank") == k).select("block", "query_id", F.col("score").cast("double").alias("kth")).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "kth"))).alias("worst"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kth, least = [], []
            for ids, known in zip(batch.column("q_ids").to_pylist(), batch.column("worst").to_pylist(), strict=True):
                known = dict(known or [])
                x = np.array([known.get(i, -np.inf) for i in np.frombuffer(ids, np.int64).tolist()])
                kth.append(x.tobytes())
                least.append(float(x.min()))
            kept = [i for i, c in enumerate(batch.schema.names) if c != "worst"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(kth, pa.binary()), pa.array(least)], names=[*(batch.schema.names[i] for i in kept), "kth", "least"])

    known = asked.join(worst, asked.q_block == worst.block, "left").drop("block")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.schema if f.name != "worst")
    known = known.mapInArrow(aligned, f"{fields}, kth binary, least double")
    known, _ = written(known, "known")
    meet = _meetings(known, found)
    # the queries of each pair go to the candidate block, whose rows then are next to each other
    asking = meet.join(known.select("q_block", "q_ids", "q_data", "kth"), "q_block").repartition(n, "block")
    pairs = asking.join(found.select("block", "ids", "data", "dim"), "block")
    both = first.drop("rank").unionByName(_searched(pairs, k))
    return _best(both, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

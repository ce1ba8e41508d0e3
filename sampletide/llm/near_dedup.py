"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is the set of its distinct k-word shingles (fewer words: the whole sequence; none: empty, linked with
nothing). Its sketch has ``COORDS`` coordinates: in round i each shingle falls into a hashed bin (from round COORDS on,
into bin i - COORDS), a bin keeps its first round's least hash, and rounds go on until every bin is filled. Bands of
``ROWS`` coordinates name buckets; documents of a bucket whose ``BITS`` further bits nearly agree are candidates, and
candidates are gathered into clusters. Within a cluster every pair is decided on the full sets: those linked to the
centres are connected through them, all others are compared with every member.

Equal sets are one class throughout, so copies are never paired. Before the shuffle, a slice's larger buckets are reduced
to leaders that carry the radius of those they stand for; leaders are joined wherever two they stand for might be near,
so that no near pair of a bucket is lost: clusters may only grow, which costs comparisons but alters no result. A pair of
similarity 0.8 is missed by all bands with probability 3e-6, and its bits are too far apart with 2e-10. Null ids are linked
as others, but take no part in choosing a component's id. ``near_duplicates`` tells by doc_id, so rows of one doc_id and
text share their fate there; ``without_near_duplicates`` leaves one row of each component. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampletide.llm.common import HEAVY, batch_of, gathered, heavy_lots, partitions, removed, slices, written
from sampletide.llm.components import components
from sampletide.llm.wordhash import mixed, shingle_sets, words_of

BANDS, ROWS = 32, 5
COORDS = BANDS * ROWS
#: Further bits, and in how many of them candidates may differ (0.9 of them agree at similarity 0.8).
BITS, FAR_BITS = 128, 40
#: Local buckets of more members are reduced to leaders; how far a leader's own members may be from it; rows of a slice; sweeps of one
#: bucket after which the rest of it is joined without a comparison.
FEW, OWN_BITS, SLICE_ROWS, SWEEPS = 4, 20, 1 << 16, 4096
#: Weight of a cluster that one task decides, of a block, and of a lot of a larger cluster; its centres. The weight is the number of members,
#: or of their shingles in units of UNIT if that is more.
MOST, BLOCK, LOT, CENTRES, UNIT = 1000, 250, 4000, 8, 1000
#: Large clusters, at most so many, whose lists of blocks are broadcast.
MANY = 10_000
_SEEDS = mixed(np.arange(1, 2 * COORDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_WEIGHTS = mixed(np.arange(101, 101 + COORDS, dtype=np.uint64)) | np.uint64(1)


def sketch(items: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes: per coordinate its filling round and hash."""
    out = np.full(coords, np.iinfo(np.uint64).max, np.uint64)
    n, begin = len(items), 0
    step = max(1, int(np.ceil(1.3 * coords * np.log(coords) / n)))
    while begin < 2 * coords and (out == np.iinfo(np.uint64).max).any():
        rounds = np.arange(begin, min(begin + step, 2 * coords), dtype=np.uint64)
        hashed = mixed(items[None, :] ^ _SEEDS[rounds, None])
        value = (rounds[:, None] << np.uint64(54)) | (hashed >> np.uint64(10))
        free = int(max(0, min(len(rounds), coords - begin)))
        if free:
            np.minimum.at(out, (hashed[:free] % np.uint64(coords)).ravel().astype(np.int64), value[:free].ravel())
        if free < len(rounds):
            bins = (rounds[free:] - np.uint64(coords)).astype(np.int64)
            out[bins] = np.minimum(out[bins], value[free:].min(1))
        begin += step
    return out


def bands_of(coords: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The bucket of each band, and a bit of each of the first ``BITS`` coordinates."""
    keys = mixed((coords * _WEIGHTS).reshape(BANDS, ROWS).sum(1) + np.arange(BANDS, dtype=np.uint64))
    bits = (mixed(coords[:BITS] ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(1)).astype(np.uint8)
    return keys.view(np.int64), np.packbits(bits).tobytes()


def similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


class Joined:
    """Which of some things are connected so far; a pair that tells nothing new needn't be sent."""

    def __init__(self) -> None:
        self.above: dict = {}

    def root(self, x):
        while (up := self.above.get(x, x)) != x:
            self.above[x] = x = self.above.get(up, up)
        return x

    def new(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self.above[a] = b
        return a != b


class Shared:
    """Counts what one set shares with each of several."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in sets], np.int64)
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.every, self.owner = every[order], owner[order]

    def counts(self, one: np.ndarray) -> np.ndarray:
        left, right = np.searchsorted(self.every, one, "left"), np.searchsorted(self.every, one, "right")
        n = right - left
        at = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))

    def linked(self, one: np.ndarray, percent: int) -> np.ndarray:
        return similar(self.counts(one), self.sizes, np.int64(len(one)), percent)


def groups_of(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first index of its component, all links decided on full sets."""
    root = np.arange(len(sets))
    index = Shared(sets)
    first = index.linked(sets[0], percent)
    root[first] = 0
    for i in np.flatnonzero(~first).tolist():
        near = np.flatnonzero(index.linked(sets[i], percent))
        roots = np.unique(root[near])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]
    return root


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, key, tie (the text's hash), n_shingles, cls (16 bytes that name the set), bands and bits of every row; empty sets have no cls, bands and bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("tie", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("bands", pa.list_(pa.int64())), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(words_of(batch.column("text"), lower=True), k)
            got = [bands_of(sketch(x)) if len(x) else (None, None) for x in sets]
            yield batch_of(schema, {**{c: batch.column(c) for c in ("doc_id", "key", "tie")}, "n_shingles": [len(x) for x in sets], "cls": [name_of(x) for x in sets], "bands": [x for x, _ in got], "bits": [x for _, x in got]})

    return docs.select("doc_id", "key", F.xxhash64("text").alias("tie"), "text").mapInArrow(run, "doc_id long, key long, tie long, n_shingles long, cls binary, bands array<long>, bits binary")


def name_of(items: np.ndarray) -> bytes | None:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def _bits(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a binary column of ``BITS`` bits as words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _far(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many ^ one).sum(1, dtype=np.int64)


def leaders(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each member its leader (an earlier member within ``OWN_BITS``, or itself), and the radius of each leader's own."""
    lead, radius, left = np.arange(len(bits)), np.zeros(len(bits), np.int64), np.arange(len(bits))
    while len(left):
        far = _far(bits[left[0]], bits[left])
        own = far <= OWN_BITS
        lead[left[own]] = left[0]
        radius[left[0]] = far[own].max()
        left = left[~own]
    return lead, radius


def joined_tree(bits: np.ndarray, radius: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect all entries that may hold a near pair: at most ``FAR_BITS`` apart but for their radii.

    Each is linked to the entry that reached it first, beginning at the least. After ``SWEEPS`` sweeps whatever is left is linked to the
    entry where the last sweeps began, so no near pair is lost in a bucket of any size.
    """
    pairs, left, sweeps = [], np.arange(1, len(bits)), 0
    reached, start = [0], 0
    while len(left):
        if not reached:
            start, reached = int(left[0]), [int(left[0])]
            left = left[1:]
        at = reached.pop(0)
        if (sweeps := sweeps + 1) > SWEEPS:
            return pairs + [(start, j) for j in left.tolist()]
        near = _far(bits[at], bits[left]) <= FAR_BITS + radius[at] + radius[left]
        pairs += [(at, j) for j in left[near].tolist()]
        reached += left[near].tolist()
        left = left[~near]
    return pairs


def _local(keys: np.ndarray, owner: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Sorted bucket entries of a slice: which go on, with which radius, and the pairs (leader, member) that stand for the others."""
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(cuts, append=len(keys))
    keep, radius, pairs, known = np.ones(len(keys), bool), np.zeros(len(keys), np.int32), [], Joined()
    for at, size in zip(cuts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        own = owner[at : at + size]
        lead, far = leaders(bits[own])
        follows = lead != np.arange(size)
        keep[at : at + size] = ~follows
        radius[at : at + size] = far
        pairs += [(i, j) for i, j in zip(own[lead[follows]].tolist(), own[follows].tolist(), strict=True) if known.new(i, j)]
    return keep, radius, pairs


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Edges (a > b: class names) that connect the near classes of each bucket, from cls, bands and bits."""
    n = partitions(classes.sparkSession)
    schema = pa.schema([("key", pa.int64()), ("cls", pa.binary()), ("bits", pa.binary()), ("radius", pa.int32()), ("other", pa.binary())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, SLICE_ROWS):
            table = table.sort_by("cls").combine_chunks()  # the least of a bucket leads, so that bands agree
            names, bits = table.column("cls").chunk(0), table.column("bits").chunk(0)
            keys = table.column("bands").chunk(0).flatten().to_numpy()
            owner = np.repeat(np.arange(table.num_rows), BANDS)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            keep, radius, pairs = _local(keys, owner, _bits(bits))
            for at in range(0, len(keys), SLICE_ROWS):
                part = np.flatnonzero(keep[at : at + SLICE_ROWS]) + at
                own = pa.array(owner[part])
                yield batch_of(schema, {"key": keys[part], "cls": names.take(own), "bits": bits.take(own), "radius": radius[part], "other": pa.nulls(len(part), pa.binary())})
            if pairs:  # an edge found here travels as a row of its own
                a, b = (pa.array(x) for x in np.array(pairs).T)
                key = mixed(np.array(b).astype(np.uint64)).view(np.int64)
                yield batch_of(schema, {"key": key, "cls": names.take(a), "bits": pa.nulls(len(a), pa.binary()), "radius": np.zeros(len(a), np.int32), "other": names.take(b)})

    edge = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, Joined()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ready = table.filter(pa.compute.is_valid(table.column("other")))
            if ready.num_rows:
                yield batch_of(edge, {"a": ready.column("other").combine_chunks(), "b": ready.column("cls").combine_chunks()})
                table = table.filter(pa.compute.is_null(table.column("other")))
            table = table if held is None else pa.concat_tables([held, table])
            keys = table.column("key").to_numpy()
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            held = table.slice(last)
            yield from _pairs(table.slice(0, last), edge, known)
        if held is not None:
            yield from _pairs(held, edge, known)

    rows = classes.select("cls", "bands", "bits").mapInArrow(spread, "key long, cls binary, bits binary, radius int, other binary")
    return rows.repartition(n, "key").sortWithinPartitions("key", "cls").mapInArrow(meet, "a binary, b binary")


def _pairs(table: pa.Table, schema: pa.Schema, known: Joined) -> Iterator[pa.RecordBatch]:
    """Edges within each run of one key that tell the task something new."""
    if table.num_rows < 2:
        return
    keys = table.column("key").to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(cuts, append=len(keys))
    some = np.repeat(sizes > 1, sizes)
    if not some.any():
        return
    table = table.filter(pa.array(some))
    bits, radius, sizes = _bits(table.column("bits")), table.column("radius").to_numpy(), sizes[sizes > 1]
    cuts = np.cumsum(sizes) - sizes
    two = cuts[sizes == 2]
    two = two[np.bitwise_count(bits[two] ^ bits[two + 1]).sum(1, dtype=np.int64) <= FAR_BITS + radius[two] + radius[two + 1]]
    at = [(i, i + 1) for i in two.tolist()]
    for c, n in zip(cuts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        at += [(c + i, c + j) for i, j in joined_tree(bits[c : c + n], radius[c : c + n])]
    if at:
        names = table.column("cls").to_pylist()
        if len(known.above) > 4 * SLICE_ROWS:
            known.above.clear()
        pairs = [(max(names[i], names[j]), min(names[i], names[j])) for i, j in at if known.new(names[i], names[j])]
        if pairs:
            yield batch_of(schema, dict(zip("ab", map(list, zip(*pairs, strict=True)), strict=True)))


def _as_set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def member_sets(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The columns of ``members`` (key, cls, cluster, n) with the class's full set, from the row that stands for it."""
    schema = pa.schema([("cluster", pa.binary()), ("cls", pa.binary()), ("n", pa.int64()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(words_of(batch.column("text"), lower=True), k)
            names = batch.column("cls").to_pylist()
            right = [i for i, x in enumerate(sets) if name_of(x) == names[i]]  # keys that are hashes may stand for several texts
            if right:
                part = batch.take(pa.array(right))
                yield batch_of(schema, {**{c: part.column(c) for c in ("cluster", "cls", "n")}, "items": [sets[i].tobytes() for i in right]})

    rows = docs.select("key", "text").join(members, "key")
    return rows.select("text", "cluster", "cls", "n").mapInArrow(run, "cluster binary, cls binary, n long, items binary")


def verified(sets: DataFrame, percent: int) -> DataFrame:
    """node and root (class names) of classes that truly linked pairs connect to others."""
    n = partitions(sets.sparkSession)
    schema = pa.schema([("node", pa.binary()), ("root", pa.binary())])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, items = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(names) > 1:
                root = groups_of(items, percent)
                yield batch_of(schema, {"node": names, "root": [names[i] for i in root]})

        for batch in slices(batches, "items"):
            for cluster, cls, data in zip(*(batch.column(c).to_pylist() for c in ("cluster", "cls", "items")), strict=True):
                if cluster != now:
                    yield from close()
                    now, names, items = cluster, [], []
                if not names or names[-1] != cls:
                    names.append(cls)
                    items.append(_as_set(data))
        yield from close()

    small = sets.where(F.col("n") <= MOST).repartition(n, "cluster").sortWithinPartitions("cluster", "cls").mapInArrow(decide, "node binary, root binary")
    large = sets.where(F.col("n") > MOST)
    if large.isEmpty():
        return small
    # centres first: whoever is connected to the first of them needs no other comparison
    lots = F.ceil(F.col("n") / LOT).cast("int")
    lot = F.pmod(F.xxhash64("cls"), lots).cast("int").alias("lot")
    every_lot = F.explode(F.sequence(F.lit(0), lots - 1)).alias("lot")
    none = F.lit(0).cast("bigint").alias("block")
    centres = large.groupBy("cluster", F.pmod(F.xxhash64("cls"), F.lit(CENTRES)).alias("_part")).agg(F.min(F.struct("cls", "items", "n")).alias("x")).select("cluster", "x.*")
    none_yet = F.lit(False).alias("linked")
    star, at_star = written(_compared(centres.select("cluster", "cls", "items", every_lot, none), large.select("cluster", "cls", "items", none_yet, lot, none), percent), "links")
    near = components(star.select(F.col("node").alias("a"), F.col("root").alias("b")))
    parts = near.join(large.select(F.col("cls").alias("node"), "cluster"), "node").groupBy("cluster", "root").agg(F.count("*").alias("size"))
    home = parts.groupBy("cluster").agg(F.max_by("root", F.struct("size", "root")).alias("root")).select("root")  # the part that most are in
    reached, at_reached = written(near.join(_bounded(home), "root", "left_semi").select(F.col("node").alias("cls")), "reached")
    rest, at_rest = written(large.join(reached, "cls", "left_anti"), "unlinked")
    weight = F.greatest(F.count("*"), F.floor(F.sum(F.octet_length("items")) / 8 / UNIT))
    blocks = _bounded(rest.groupBy("cluster").agg(F.ceil(weight / BLOCK).alias("blocks")))
    few = rest.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(7)), "blocks"))
    stays = rest.select("cls").distinct().withColumn("linked", F.lit(False))
    every = large.select("cluster", "cls", "items", lot).join(blocks, "cluster").join(stays, "cls", "left").withColumn("linked", F.col("linked").isNull())
    every = every.select("cluster", "cls", "items", "linked", "lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    links = _compared(few.select("cluster", "cls", "items", every_lot, "block"), every, percent)
    found, _ = written(components(star.unionByName(links).select(F.col("node").alias("a"), F.col("root").alias("b"))), "found")
    removed(sets.sparkSession, at_star, at_reached, at_rest)
    return small.unionByName(found)


def _bounded(rows: DataFrame) -> DataFrame:
    """``rows`` to be broadcast if there are at most ``MANY``; else Spark joins them as it sees fit."""
    rows = rows.sparkSession.createDataFrame(got, rows.schema) if len(got := rows.take(MANY + 1)) <= MANY else rows
    return F.broadcast(rows) if len(got) <= MANY else rows


def _compared(few: DataFrame, many: DataFrame, percent: int) -> DataFrame:
    """node and root of linked pairs: each set of ``many`` against those of ``few`` in its cluster, lot and block.

    Of the pairs found those that connect nothing new are left out; all ``many`` that are ``linked`` are connected already.
    Both sides meet by sorting, the few first, so that a task holds the few of one block and streams the many.
    """
    by = ["cluster", "lot", "block"]
    schema = pa.schema([("node", pa.binary()), ("root", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, items, index, joined = None, [], [], None, Joined()
        for batch in slices(batches, "items"):
            out: dict[str, list] = {"node": [], "root": []}
            for *key, side, linked, cls, data in zip(*(batch.column(c).to_pylist() for c in (*by, "side", "linked", "cls", "items")), strict=True):
                if key != now:
                    now, names, items, index, joined = key, [], [], None, Joined()
                if side == 0:
                    names.append(cls)
                    items.append(_as_set(data))
                elif names:
                    index = index or Shared(items)
                    for i in np.flatnonzero(index.linked(_as_set(data), percent)).tolist():
                        if names[i] != cls and joined.new("" if linked else cls, names[i]):
                            out["node"].append(cls)
                            out["root"].append(names[i])
            yield batch_of(schema, out)

    both = few.withColumn("side", F.lit(0)).withColumn("linked", F.lit(False)).unionByName(many.withColumn("side", F.lit(1)))
    return both.repartition(partitions(few.sparkSession), *by).sortWithinPartitions(*by, "side").mapInArrow(run, "node binary, root binary")


def _components(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, tuple[str, str]]:
    """The profiles of ``docs`` (doc_id, key, text); cls, root (a class that names the component) and first of every class; the paths of both.

    first is the component's first row: none (its id is null), doc_id, tie, key; in this order the least.
    """
    spark = docs.sparkSession
    seen, at_seen = written(profiles(docs, k), "profiles")
    some = F.any_value
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "key")).alias("first")
    classes = seen.where("n_shingles > 0").groupBy("cls").agg(first, some("n_shingles").alias("n_shingles"), some("bands").alias("bands"), some("bits").alias("bits"))
    classes, at_classes = written(classes, "classes")
    edges, at_edges = written(candidate_edges(classes), "candidates")
    clusters, at_clusters = written(components(edges), "clusters")
    members = clusters.select(F.col("node").alias("cls"), F.col("root").alias("cluster")).join(classes.select("cls", "first.key", "n_shingles"), "cls")
    sizes = members.groupBy("cluster").agg(F.greatest(F.count("*"), F.floor(F.sum("n_shingles") / UNIT)).alias("n"))
    # only large clusters need their size; their rows meet it in lots, so that no cluster's rows share a task
    lots = heavy_lots(sizes.where(F.col("n") > MOST))
    members = members.withColumn("lot", F.pmod(F.xxhash64("cls"), F.lit(HEAVY)).cast("int")).join(lots, ["cluster", "lot"], "left")
    members = members.select("cls", "key", "cluster", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    sets, at_sets = written(member_sets(docs, members, k), "sets")
    groups, at_groups = written(verified(sets, percent), "groups")
    owner = classes.select("cls", "first").join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = owner.groupBy("root").agg(F.min("first").alias("first"))
    named, at_named = written(owner.select("cls", "root").join(least, "root"), "components")
    removed(spark, at_classes, at_edges, at_clusters, at_sets, at_groups)
    return seen, named, (at_seen, at_named)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row. Links: 100 * intersection >= percent * union."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    seen, named, _ = _components(rows, k, percent)
    out = seen.select("doc_id", "n_shingles", "cls").join(named.select("cls", F.col("first.doc_id").alias("component_id")), "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, whatever ids repeat or are null: that of least doc_id (nulls last), then of least text hash, then any.

    Rows without words are linked with nothing and stay. Rows are told apart by keys of a written copy.
    """
    keyed, _ = written(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*docs.columns).alias("row")), "keyed")
    rows = keyed.select(F.col("row.doc_id").cast("long").alias("doc_id"), "key", F.col("row.text").cast("string").alias("text"))
    seen, named, paths = _components(rows, k, percent)
    stays = named.select("first.key").distinct()
    gone, _ = written(seen.where("cls is not null").select("key").join(stays, "key", "left_anti"), "duplicates")
    removed(docs.sparkSession, *paths)
    return keyed.join(gone, "key", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

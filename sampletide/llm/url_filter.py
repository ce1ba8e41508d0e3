"""Judging urls by listed hosts and paths, with a Bloom filter cascade in place of joins.

A rule (host, path, action) fits its host and all subdomains if the url's path starts with the rule's; the longest fitting rule
wins. A url's keys are all that a rule for it can be: each suffix of its host at a dot, followed by the first characters of its path, as
many as some rule has. Whether a key is listed is asked of a cascade: level 0 encodes the listed keys, level 1 those other keys of the
corpus that level 0 lets through, level 2 the listed keys that level 1 lets through, and so on until none is
left. The first level that a key doesn't pass tells what it is, exactly for every key of the corpus, whose complete key universe the cascade was
made from. A second cascade over the listed keys tells those that block from those that allow.

Levels lie in shards of bounded size in the shared folder; a task holds ``CACHE_BYTES`` of them at most, so lists of any length work
and nothing is broadcast. Keys travel as 128 bits; rows are only shuffled, after map-side sums, to make keys distinct.

Defined cases: null urls and those without ``://`` have an empty host and path; a url that no rule fits is allowed, with a null rule; of
equal rules one that blocks wins; rules with a null host, path or action are ignored, other actions than allow and block refused; with no rules all is allowed.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampletide.llm.common import partitions, removed, shared_dir, written
from sampletide.llm.wordhash import mixed

#: Bytes of a level's shard, and of the shards that a task holds.
SHARD_BYTES, CACHE_BYTES = 1 << 22, 1 << 27
#: Share of others that levels after the first let through.
LATER = 1 / 16
#: Levels after which keys must have equal hashes, and path lengths that rules may have.
MOST_LEVELS, MOST_LENGTHS = 64, 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = "a long, b long"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys of a url, as an array: longer hosts first."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cut = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(path))
    return F.flatten(F.transform(hosts, lambda h: F.transform(cut, lambda n: F.concat(h, F.substring(path, F.lit(1), n)))))


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b")]


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    shards: int


def sized(n: int, wrong: float) -> Level:
    """A level for ``n`` keys that lets the share ``wrong`` of others through."""
    hashes = max(1, round(math.log2(1 / wrong)))
    total = max(64, math.ceil(n * hashes / math.log(2)))
    shards = math.ceil(total / (8 * SHARD_BYTES))
    return Level(8 * math.ceil(total / shards / 8), hashes, shards)


def _places(level: Level, number: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bits of each key in its shard: a row for each hash."""
    salt = np.uint64((number * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x, step = mixed(a.view(np.uint64) ^ salt), mixed(b.view(np.uint64) + salt) | np.uint64(1)
    return np.stack([((x + step * np.uint64(j)) % np.uint64(level.bits)).astype(np.int64) for j in range(level.hashes)])


@dataclass(frozen=True)
class Cascade:
    """Levels whose shards are files ``level-shard`` of ``path``."""

    path: str
    levels: tuple[Level, ...]

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """A cascade as a task asks it."""

    def __init__(self, cascade: Cascade) -> None:
        self.cascade, self.held, self.bytes = cascade, OrderedDict(), 0
        self.files, self.root = pyarrow.fs.FileSystem.from_uri(cascade.path)

    def shard(self, number: int, shard: int) -> np.ndarray:
        if (number, shard) in self.held:
            self.held.move_to_end((number, shard))
            return self.held[number, shard]
        with self.files.open_input_stream(f"{self.root}/{number}-{shard}") as f:
            found = np.frombuffer(f.read(), np.uint8)
        self.held[number, shard] = found
        self.bytes += len(found)
        while self.bytes > CACHE_BYTES and len(self.held) > 1:
            self.bytes -= len(self.held.popitem(last=False)[1])
        return found

    def passes(self, number: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = self.cascade.levels[number]
        out, shard = np.ones(len(a), bool), a % level.shards
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(a) else []:
            bits = self.shard(number, int(shard[part[0]]))
            places = _places(level, number, a[part], b[part])
            out[part] = (bits[places >> 3] >> (places & 7).astype(np.uint8) & 1).all(axis=0)
        return out

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each key is listed; exact for the keys of the universe."""
        out, left = np.zeros(len(a), bool), np.arange(len(a))
        for number in range(len(self.cascade.levels)):
            passed = self.passes(number, a[left], b[left])
            out[left[~passed]] = number % 2 == 1
            left = left[passed]
        out[left] = len(self.cascade.levels) % 2 == 1
        return out


def _through(keys: DataFrame, cascade: Cascade, number: int) -> DataFrame:
    """The keys that a level lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = cascade.reader()
        for batch in batches:
            yield batch.filter(pa.array(reader.passes(number, batch.column("a").to_numpy(), batch.column("b").to_numpy())))

    return keys.mapInArrow(run, _KEY)


def _add_level(keys: DataFrame, n: int, wrong: float, path: str, number: int) -> Level:
    """Write the level of ``keys``, a file a shard. A lost task writes its files again, with the same bytes."""
    spark, level = keys.sparkSession, sized(n, wrong)
    every = spark.range(level.shards).select(F.col("id").alias("shard"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    rows = keys.select(F.pmod("a", F.lit(level.shards)).alias("shard"), "a", "b").unionByName(every)
    rows = rows.repartition(min(level.shards, partitions(spark)), "shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(path)
        now, bits = None, None

        def put() -> None:
            with files.open_output_stream(f"{root}/{number}-{now}") as f:
                f.write(np.packbits(bits, bitorder="little").tobytes())

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for x, y in zip(edges, edges[1:], strict=False):
                if x < y and int(shards[x]) != now:
                    if now is not None:
                        put()
                    now, bits = int(shards[x]), np.zeros(level.bits, bool)
                own = batch.slice(x, y - x).drop_null()
                if own.num_rows:
                    bits[_places(level, number, own.column("a").to_numpy(), own.column("b").to_numpy()).ravel()] = True
        if now is not None:
            put()
        yield pa.RecordBatch.from_pydict({"n": pa.array([], pa.int64())})

    files, root = pyarrow.fs.FileSystem.from_uri(path)
    files.create_dir(root, recursive=True)
    rows.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
    return level


def cascade_of(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade that tells ``listed`` from the other keys of ``universe``; both are hashed keys (a, b), distinct each."""
    spark = listed.sparkSession
    path, levels = shared_dir(spark, "cascade"), []
    yes, own = written(listed, "listed")
    n, total, tables = yes.count(), universe.count(), [own]
    sides = [yes, universe]  # what the next level encodes is, of these in turn, what the level before lets through
    while n:
        number = len(levels)
        if number >= MOST_LEVELS:
            raise ValueError("listed and other keys have equal hashes")
        wrong = LATER if number else min(0.5, max(2.0**-30, n / (math.sqrt(2) * max(1, total))))
        levels.append(_add_level(sides[number % 2], n, wrong, path, number))
        rest = _through(sides[(number + 1) % 2], Cascade(path, tuple(levels)), number)
        if number == 0:  # the universe holds listed keys too; sums by key drop them without a join
            both = rest.withColumn("own", F.lit(False)).unionByName(yes.withColumn("own", F.lit(True)))
            rest = both.groupBy("a", "b").agg(F.max("own").alias("own")).where(~F.col("own")).select("a", "b")
        sides[(number + 1) % 2], own = written(rest, "passed")
        tables.append(own)
        n = sides[(number + 1) % 2].count()
    removed(spark, *tables)
    return Cascade(path, tuple(levels))


def rule_rows(rules: DataFrame) -> DataFrame:
    """key and blocks of every distinct rule."""
    given = rules.select("host", "path", "action").where("host is not null and path is not null and action is not null")
    refused = F.raise_error(F.concat(F.lit("no such action: "), "action")).cast("boolean")
    blocks = F.when(F.col("action") == "block", True).when(F.col("action") == "allow", False).otherwise(refused)
    return given.groupBy(F.concat(F.translate("host", UPPER, LOWER), "path").alias("key"), F.length("path").alias("n")).agg(F.max(blocks).alias("blocks"))


def judged(pages: DataFrame, rules: DataFrame, keep: tuple[str, ...] = ("page_id",), url: str = "url") -> DataFrame:
    """``keep`` of every row, host, path, rule (the longest that fits, as host and path; else null) and verdict (allow or block)."""
    names = ["host", "path", "rule", "verdict"]
    if clash := set(names) & set(keep):
        raise ValueError(f"these columns have the names of results: {sorted(clash)}")
    known = rule_rows(rules)
    lengths = sorted(r.n for r in known.select("n").distinct().limit(MOST_LENGTHS + 1).collect())
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"rules have paths of more than {MOST_LENGTHS} lengths")
    host, path = split_url(F.col(url))
    keys = F.transform(keys_of(F.col("_host"), F.col("_path"), lengths), lambda k: F.struct(k.alias("key"), *hashed(k)))
    rows = pages.select(*keep, host.alias("_host"), path.alias("_path")).withColumn("_keys", keys)
    listed = known.select(*hashed(F.col("key")), "blocks")
    universe, table = written(rows.select(F.explode("_keys").alias("k")).select("k.a", "k.b").distinct(), "universe")
    member = cascade_of(listed.select("a", "b"), universe)
    blocking = cascade_of(listed.where("blocks").select("a", "b"), listed.select("a", "b"))
    removed(pages.sparkSession, table)
    schema = T.StructType([*rows.select(*keep).schema.fields, *T.StructType.fromDDL("host string, path string, rule string, verdict string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = member.reader(), blocking.reader()
        for batch in batches:
            column = batch.column("_keys")
            flat = column.flatten()
            a, b = (flat.field(c).to_numpy() for c in ("a", "b"))
            own = np.flatnonzero(readers[0].listed(a, b))
            row = pa.compute.list_parent_indices(column).to_numpy()[own]
            size = pa.compute.utf8_length(flat.field("key")).to_numpy()[own]
            order = np.lexsort((own, -size, row))  # by row: the longest first, of equal ones that with the longest host
            best = order[np.concatenate([[True], np.diff(row[order]) > 0])] if len(order) else order
            at = np.full(batch.num_rows, -1)
            at[row[best]] = own[best]
            verdict = np.zeros(batch.num_rows, bool)
            verdict[row[best]] = readers[1].listed(a[own[best]], b[own[best]])
            rule = flat.field("key").take(pa.array(at, pa.int64(), mask=at < 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("_host"), batch.column("_path"), rule, pa.array(np.where(verdict, "block", "allow"))], names=schema.names)

    return rows.mapInArrow(run, schema)


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (action, host, path)."""
    return spark.createDataFrame(rules, "action string, host string, path string")

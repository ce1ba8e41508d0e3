"""Semi-structured samples as rows of nodes.

A path is an array of parts: "." and the key for a field, "*" for the elements of an array, [] for the sample
itself. Each Arrow batch of samples is taken apart path by path, in whole columns, to whatever depth they have; nothing is shuffled. Values of typed samples
that JSON has no kind for (times, dates, bytes, intervals) count as text, written as JSON writes them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampletide.functions.segments import ROWS, Scan, cuts_of

KINDS = ["obj", "array", "string", "boolean", "null", "int", "float"]
_OBJ, _ARRAY, _STRING, _BOOLEAN, _NULL, _INT, _FLOAT = range(len(KINDS))
#: Bytes of JSON that are parsed at once; a longer sample alone. Bytes a core under which an input is small.
PART, SMALL = 1 << 20, 1 << 25
#: Sorts after all parts of paths.
_AFTER = chr(0x10FFFF)
_SCHEMA = "path array<string>, kind string, number double, text string, flag boolean, size int"


class _Columns:
    """The nodes of many samples, path by path: a part for all values of one path and class, each made by a few calls over whole lists."""

    def __init__(self) -> None:
        self.paths: list[tuple[str, ...]] = [()]
        self.known: dict[tuple[int, str], int] = {}
        self.parts: list[tuple[int, int, list | np.ndarray | pa.Array, np.ndarray]] = []

    def below(self, path: int, part: str) -> int:
        number = self.known.get((path, part))
        if number is None:
            number = self.known[path, part] = len(self.paths)
            self.paths.append((*self.paths[path], part))
        return number

    def add(self, path: int, values: list, owner: np.ndarray) -> None:
        """All values of one path, with the sample that each is of, and what lies below them."""
        waiting = [(path, values, owner)]
        while waiting:
            path, values, owner = waiting.pop()
            types = set(map(type, values))
            if len(types) > 1:
                for t in types:
                    at = [i for i, v in enumerate(values) if type(v) is t]
                    waiting.append((path, [values[i] for i in at], owner[at]))
                continue
            for t in types:
                self.parts.append((path, _OF[t], values, owner))
                if t is list:
                    below = list(chain.from_iterable(values))
                    if below:
                        waiting.append((self.below(path, "*"), below, np.repeat(owner, list(map(len, values)))))
                elif t is dict:
                    first = values[0].keys()
                    if all(v.keys() == first for v in values):
                        waiting += [(self.below(path, "." + k), [v[k] for v in values], owner) for k in first]
                    else:
                        fields: dict[str, tuple[list, list]] = {}
                        for i, v in enumerate(values):
                            for k, x in v.items():
                                own = fields.get(k) or fields.setdefault(k, ([], []))
                                own[0].append(x)
                                own[1].append(i)
                        waiting += [(self.below(path, "." + k), own, owner[at]) for k, (own, at) in fields.items()]

    def add_arrow(self, path: int, values: pa.Array, kind: T.DataType, owner: np.ndarray) -> None:
        """The same of a typed column, whose values never become Python objects but for the JSON text that a VARIANT has become."""
        if values.null_count:
            valid = values.is_valid().to_numpy(zero_copy_only=False)
            self.parts.append((path, _NULL, valid[~valid], owner[~valid]))
            values, owner = values.filter(pa.array(valid)), owner[valid]
        if not len(values):
            return
        if isinstance(kind, T.VariantType):
            self.add(path, json.loads(f"[{','.join(values.to_pylist())}]"), owner)
        elif isinstance(kind, T.StructType):
            self.parts.append((path, _OBJ, np.full(len(values), len(kind.fields)), owner))
            for column, field in zip(values.flatten(), kind.fields, strict=True):
                self.add_arrow(self.below(path, "." + field.name), column, field.dataType, owner)
        elif isinstance(kind, T.ArrayType):
            sizes = pa.compute.list_value_length(values).to_numpy()
            self.parts.append((path, _ARRAY, sizes, owner))
            if sizes.any():
                self.add_arrow(self.below(path, "*"), values.flatten(), kind.elementType, np.repeat(owner, sizes))
        elif isinstance(kind, T.DoubleType):
            numbers = values.to_numpy()
            finite = np.isfinite(numbers)
            self.parts.append((path, _FLOAT, numbers[finite], owner[finite]))
            if not finite.all():
                words = np.where(np.isnan(numbers), "NaN", np.where(numbers > 0, "Infinity", "-Infinity"))[~finite]
                self.parts.append((path, _STRING, words.tolist(), owner[~finite]))
        elif isinstance(kind, T.StringType):
            self.parts.append((path, _STRING, values, owner))
        else:
            self.parts.append((path, _BOOLEAN if isinstance(kind, T.BooleanType) else _INT, values.to_numpy(zero_copy_only=False), owner))

    def steps(self, samples: int) -> np.ndarray:
        """What each sample's nodes cost."""
        out = np.zeros(samples, np.int64)
        for path, kind, _, owner in self.parts:
            out += np.bincount(owner, minlength=samples) * (1 if not path or kind == _NULL else 2)
        return out

    def columns(self) -> tuple[np.ndarray, list[pa.Array]]:
        """The sample of each node, and path, kind, number, text, flag and size."""
        counts = [len(values) for _, _, values, _ in self.parts]
        total = sum(counts)
        path = np.repeat(np.array([p for p, *_ in self.parts], np.int32), counts)
        kind = np.repeat(np.array([k for _, k, *_ in self.parts], np.int8), counts)
        owner = np.concatenate([o for *_, o in self.parts]) if self.parts else np.zeros(0, np.int64)
        number, flag, size, text, at = np.zeros(total), np.zeros(total, bool), np.zeros(total, np.int32), [], 0
        for (_, k, values, _), n in zip(self.parts, counts, strict=True):
            if k in (_INT, _FLOAT):
                number[at : at + n] = np.array(values, np.float64)
                if k == _INT and isinstance(values, list) and (max(values) >= 1 << 63 or min(values) < -(1 << 63)):
                    kind[at : at + n][[not -(1 << 63) <= x < 1 << 63 for x in values]] = _FLOAT
            elif k == _BOOLEAN:
                flag[at : at + n] = values
            elif k in (_OBJ, _ARRAY):
                size[at : at + n] = list(map(len, values)) if isinstance(values, list) else values
            text.append(pa.nulls(n, pa.string()) if k != _STRING else pa.array(values, pa.string()) if isinstance(values, list) else values.cast(pa.string()))
            at += n
        paths = pa.array(self.paths, pa.list_(pa.string())).take(pa.array(path))
        texts = pa.concat_arrays(text) if text else pa.array([], pa.string())
        numbers = pa.array(number, mask=~np.isin(kind, (_INT, _FLOAT)))
        return owner, [paths, pa.array(KINDS).take(pa.array(kind)), numbers, texts, pa.array(flag, mask=kind != _BOOLEAN), pa.array(size, mask=~np.isin(kind, (_OBJ, _ARRAY)))]


_OF = {str: _STRING, float: _FLOAT, int: _INT, dict: _OBJ, list: _ARRAY, bool: _BOOLEAN, type(None): _NULL}


def _walked(value: object) -> Iterator[tuple[tuple[str, ...], object]]:
    """The value and all below it with their paths, level by level."""
    out = [((), value)]
    for path, x in out:  # grows meanwhile
        if type(x) is dict:
            out += [((*path, "." + k), v) for k, v in x.items()]
        elif type(x) is list:
            out += [((*path, "*"), v) for v in x]
    return iter(out)


def _within(value: object, budget: int, absent: list[dict] | None) -> list[tuple[tuple[str, ...], object]]:
    """The nodes in order of path until their cost exceeds ``budget``.

    ``absent``: paths of objects, and how many steps the fields that they lack cost when all below them is done.
    """
    steps = [(path, 1 if not path or x is None else 2, (path, x)) for path, x in _walked(value)]
    steps += [((*x["path"], _AFTER), x["steps"], None) for x in absent or ()]
    spent, taken = 0, []
    for _, cost, node in sorted(steps, key=lambda s: s[0]):
        spent += cost
        if spent > budget:
            break
        if node is not None:
            taken.append(node)
    return taken


def _spread(rows: DataFrame) -> DataFrame:
    """Small inputs, which come in few splits, dealt to all cores before Python takes them apart. Large ones have splits enough and aren't shuffled."""
    if rows.isStreaming:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SMALL else rows


_PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType, T.StringType, T.BooleanType)


def _in_columns(kind: T.DataType, inside: bool = False) -> bool:
    """Whether typed samples can stay columns: JSON has a kind for all their values, and no VARIANT is an element of an array."""
    if isinstance(kind, T.StructType):
        return bool(kind.fields) and all(_in_columns(f.dataType, inside) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _in_columns(kind.elementType, True)
    return isinstance(kind, _PLAIN) or isinstance(kind, T.VariantType) and not inside


def _as_text(value: Column, kind: T.DataType) -> Column:
    """The value with the VARIANTs in its fields as JSON text."""
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_as_text(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return value


def _shredded_columns(df: DataFrame, keep: list[str], sample: str) -> DataFrame:
    kind = df.schema[sample].dataType
    rows = _spread(df.where(F.col(sample).isNotNull()).select(*keep, _as_text(F.col(sample), kind).alias("_sample")))
    schema = T.StructType([*rows.drop("_sample").schema.fields, *T.StructType.fromDDL(_SCHEMA).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes = _Columns()
                nodes.add_arrow(0, batch.column("_sample"), kind, np.arange(batch.num_rows))
                owner, columns = nodes.columns()
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def _shredded(df: DataFrame, keep: list[str], sample: str, budget: int | None, absent: str | None = None) -> DataFrame:
    if isinstance(df.schema[sample].dataType, T.StructType):
        if budget is None and _in_columns(df.schema[sample].dataType):
            return _shredded_columns(df, keep, sample)
        df = df.withColumn(sample, F.to_variant_object(sample))
    rows = _spread(df.where(F.col(sample).isNotNull()).select(*keep, F.to_json(sample).alias("_json"), *([F.col(absent).alias("_absent")] if absent else [])))
    cut = [T.StructField("truncated", T.BooleanType())] if budget is not None else []
    schema = T.StructType([*rows.drop("_json", "_absent").schema.fields, *cut, *T.StructType.fromDDL(_SCHEMA).fields])

    def nodes_of(texts: list[str], lacking: list | None) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
        samples = json.loads(f"[{','.join(texts)}]")
        nodes, own = _Columns(), np.arange(len(samples))
        nodes.add(0, samples, own)
        over = np.zeros(len(samples), bool)
        if budget is not None:
            cost = nodes.steps(len(samples)) + np.array([sum(x["steps"] for x in a or ()) for a in lacking] if lacking else 0)
            over = cost > budget
        if over.any():  # the few samples beyond their budget are cut one by one
            nodes = _Columns()
            nodes.add(0, [x for x, cut_off in zip(samples, over.tolist(), strict=True) if not cut_off], own[~over])
            for i in np.flatnonzero(over).tolist():
                for path, x in _within(samples[i], budget, lacking[i] if lacking else None):
                    number = 0
                    for part in path:
                        number = nodes.below(number, part)
                    nodes.parts.append((number, _OF[type(x)], [x], np.array([i])))
        owner, columns = nodes.columns()
        return owner, over, columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole):
                owner, over, columns = nodes_of(batch.column("_json").to_pylist(), batch.column("_absent").to_pylist() if absent else None)
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), *([pa.array(over[owner])] if cut else []), *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``PART`` bytes of JSON, one sample at least."""
    sizes = np.cumsum(pa.compute.binary_length(batch.column("_json")).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(sizes, PART + (sizes[begin - 1] if begin else 0), "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def shred(df: DataFrame, keep: list[str], sample: str = "sample") -> DataFrame:
    """A row per node of the samples, a VARIANT or a struct: ``keep``, path, kind, number, text, flag, size. Null samples have no nodes.

    Structs are taken apart as columns, without becoming text, if their types allow; the nodes are the same.
    """
    return _shredded(df, keep, sample, None)


def shred_within(df: DataFrame, keep: list[str], budget: int, sample: str = "sample") -> DataFrame:
    """As ``shred``, for at most ``budget`` steps a sample: the root and a null cost 1, other nodes 2, in path order.

    The first node beyond the budget ends the sample; truncated tells, on every node row, that nodes are missing.
    """
    return _shredded(df, keep, sample, budget)


def _in_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose columns of these names are a row of ``keys``, nulls equal."""
    other = keys.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(keys.columns)])
    return df.join(other, [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(keys.columns)], "left_semi")


def absent_steps(df: DataFrame, by: list[str], order: list[str], budget: int, sample: str = "sample", rows: int = ROWS) -> DataFrame:
    """For each sample (``by``, ``order``) with some: absent, the objects' paths and how many known fields each lacks, all its occurrences together.

    A field is known to a digest (``by``) after the first sample, in ``order``, that has it. How many are known before a sample is a
    running sum over first samples, which spreads over tasks where one object's samples are many. What is shuffled are an object's counts in a
    sample, not its nodes; nodes of first samples, of which there are as many as fields at most, are counted on their own.
    """
    names = [*by, *order]
    nodes = _shredded(df, names, sample, budget)
    is_field, parent = (F.size("path") > 0) & F.element_at("path", -1).startswith("."), F.slice("path", F.lit(1), F.size("path") - 1)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    roles = F.array(
        F.when(F.col("kind") == "obj", F.struct(F.col("path").alias("at"), one.alias("objs"), none.alias("old"), none.alias("new"))),
        F.when(is_field, F.struct(parent.alias("at"), none.alias("objs"), one.alias("old"), none.alias("new"))),
    )
    first = nodes.where(is_field).groupBy(*by, "path").agg(F.min(F.struct(*order)).alias("f")).select(*by, "path", "f.*")
    own = _in_keys(_shredded(_in_keys(df, first.select(*names)), names, sample, budget).where(is_field), first)
    own = own.groupBy(*names, "path").agg(F.count("*").alias("n"))
    parts = nodes.select(*names, F.inline(F.array_compact(roles))).unionByName(own.select(*names, parent.alias("at"), none.alias("objs"), (-F.col("n")).alias("old"), one.alias("new")))
    held = parts.groupBy(*names, "at").agg(*[F.sum(c).alias(c) for c in ("objs", "old", "new")])
    cuts = cuts_of(df.where(F.col(sample).isNotNull()), by, order, rows)  # of samples, which needn't be taken apart for it
    known = Scan.of(held, [*by, "at"], order, cuts=cuts).with_sum("known", F.col("new")).done()
    steps = F.col("objs") * (F.col("known") - F.col("new")) - F.col("old")
    lacking = known.withColumn("steps", steps).where("steps > 0")
    return lacking.groupBy(*by, *order).agg(F.collect_list(F.struct(F.col("at").alias("path"), "steps")).alias("absent"))


def shred_known(df: DataFrame, by: list[str], order: list[str], budget: int, keep: list[str] | None = None, sample: str = "sample", rows: int = ROWS) -> DataFrame:
    """As ``shred_within`` for the value digests ``by``, where a known field that an object lacks costs a step as well.

    Known are the fields that earlier samples have within their own budgets. Such steps are taken after all below the object.
    ``order`` tells the samples of a digest apart; those it doesn't are taken for one and share their steps. Nulls are equal.
    """
    absent = absent_steps(df, by, order, budget, sample, rows)
    names = [*by, *order]
    other = absent.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(names)], F.col("absent").alias("_lacking"))
    both = df.join(other, [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(names)], "left")
    return _shredded(both, keep or by, sample, budget, "_lacking")


def path_text(path: Column | str) -> Column:
    return F.array_join(path, "")

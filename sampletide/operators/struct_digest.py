"""Structure digests: which fields and classes of values occur, and how long arrays are."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COUNTS = ["obj", "floats", "ints", "strings", "booleans", "arrays", "nulls"]


def struct_digest(nodes: DataFrame, by: list[str], json_numbers: bool = False) -> DataFrame:
    """Counts of each class at each path. ``json_numbers``: numbers of JSON text are floats, whole or not.

    Fields that are there but null have a row without class counts; absent fields have none.
    """
    of = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    floats, ints = (("int", "float"), ("",)) if json_numbers else (("float",), ("int",))
    length = F.when(F.col("kind") == "array", F.col("size"))
    return nodes.groupBy(*by, "path").agg(
        of("obj").alias("obj"), of(*floats).alias("floats"), of(*ints).alias("ints"), of("string").alias("strings"), of("boolean").alias("booleans"),
        of("array").alias("arrays"), of("null").alias("nulls"), F.min(length).alias("min_length"), F.max(length).alias("max_length"), F.sum(length).alias("sum_length"),
    )


def struct_rollup(digests: DataFrame, by: list[str]) -> DataFrame:
    """Digests of many windows or instances as one."""
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    return digests.groupBy(*by, "path").agg(*sums, F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"), F.sum("sum_length").alias("sum_length"))


def mixed_types(digests: DataFrame) -> DataFrame:
    """Paths at which values of more than one class occur, with how many classes."""
    classes = sum((F.col(c) > 0).cast("int") for c in ("obj", "strings", "booleans", "arrays")) + ((F.col("floats") + F.col("ints")) > 0).cast("int")
    return digests.withColumn("n_classes", classes).where("n_classes > 1")


def children(rows: dict[tuple, dict]) -> dict[tuple, list[tuple]]:
    """The paths of the fields right below each path, by name."""
    below: dict[tuple, list[tuple]] = {}
    for path in sorted(rows):
        if path and path[-1] != "*":
            below.setdefault(path[:-1], []).append(path)
    return below


def folded(rows: dict[tuple, dict], entry: Callable[[dict, dict, dict | None], dict]) -> dict:
    """The nested form of a digest, made from its deepest paths up: ``entry`` gets a row, its fields' entries by name and its elements' entry. Each path is looked at once."""
    below, done = children(rows), {}
    for path in sorted(rows, key=len, reverse=True):
        fields = {p[-1][1:]: done.pop(p) for p in below.get(path, ())}
        done[path] = entry(rows[path], fields, done.pop((*path, "*"), None))
    return done[()]


def _entry(row: dict, fields: dict, elements: dict | None) -> dict:
    """64-bit counts are text."""
    out = {}
    number = {k: {"count": str(row[c])} for k, c in (("floatNum", "floats"), ("integerNum", "ints")) if row[c]}
    if number:
        out["number"] = number
    for k, c in (("string", "strings"), ("boolean", "booleans")):
        if row[c]:
            out[k] = {"count": str(row[c])}
    if row["arrays"]:
        out["array"] = {"count": str(row["arrays"]), "minLength": str(int(row["min_length"])), "maxLength": str(int(row["max_length"])), "sumLength": str(int(row["sum_length"]))}
        if elements is not None:
            out["array"]["fields"] = elements
    if row["obj"]:
        out["obj"] = {"count": str(row["obj"])} | ({"fields": fields} if fields else {})
    return out


def rendered(digests: DataFrame, by: list[str], body: Callable[[dict[tuple, dict]], dict]) -> DataFrame:
    """A JSON ``body`` a digest, of its rows by path: as many as its field budget and its samples' schema allow."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in digests.select(*by).schema) + ", body string"

    def render(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = body({tuple(r["path"]): r for r in part.drop(columns=by).to_dict("records")})
        return pd.DataFrame([[*key, json.dumps(found, separators=(",", ":"), ensure_ascii=False)]], columns=[*by, "body"])

    return digests.groupBy(*by).applyInPandas(render, schema)


def struct_json(digests: DataFrame, by: list[str]) -> DataFrame:
    """One JSON body a digest."""
    return rendered(digests, by, lambda rows: folded(rows, _entry))

"""Value digests: totals, defaults, nulls and statistics of the values at each path.

Closed forms, so the order of samples doesn't matter: the total at a field is how many objects its parent held, at "*" how
many elements there were, at the root how many samples; a class's nulls are the total less the values of that class.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampletide.operators.struct_digest import folded, rendered

#: Sketch precision: 2 ** 14 registers, 0.8 percent standard error.
PRECISION = 14
_SUMS = ["total", "nulls", "numbers", "number_default", "number_sum", "strings", "string_default", "length_sum", "booleans", "true_count", "arrays", "array_default", "objs", "obj_default"]
_SKETCHES = ["number_sketch", "string_sketch", "length_sketch"]


def value_digest(nodes: DataFrame, by: list[str], sketches: bool = True) -> DataFrame:
    """A row per path: total and nulls, and counts, defaults and statistics of each class that occurs."""
    return value_digest_of(value_sums(nodes, by, sketches), by)


def value_sums(nodes: DataFrame, by: list[str], sketches: bool = True) -> DataFrame:
    """What a value digest adds up: a row per path, seen telling how many nodes there are. One aggregation, so it works on streams."""
    kind, length = F.col("kind"), F.octet_length("text")
    is_number = kind.isin("int", "float")
    count = F.count_if
    aggregates = [
        count(F.lit(True)).alias("seen"), count(is_number).alias("numbers"), count(is_number & (F.col("number") == 0)).alias("number_default"), F.min("number").alias("number_min"),
        F.max("number").alias("number_max"), F.sum("number").alias("number_sum"), count(kind == "string").alias("strings"), count(F.col("text") == "").alias("string_default"),
        F.min(length).alias("length_min"), F.max(length).alias("length_max"), F.sum(length).alias("length_sum"), count(kind == "boolean").alias("booleans"), count(F.col("flag")).alias("true_count"),
        count(kind == "array").alias("arrays"), count((kind == "array") & (F.col("size") == 0)).alias("array_default"), count(kind == "obj").alias("objs"), count((kind == "obj") & (F.col("size") == 0)).alias("obj_default"),
    ]
    if sketches:
        aggregates += [F.hll_sketch_agg(F.col("number").cast("string"), PRECISION).alias("number_sketch"), F.hll_sketch_agg("text", PRECISION).alias("string_sketch"), F.hll_sketch_agg(length.cast("string"), PRECISION).alias("length_sketch")]
    return nodes.groupBy(*by, "path").agg(*aggregates)


def _roles(out: DataFrame) -> DataFrame:
    """Aggregated rows by the path at which they meet (_at): a row of each node for its own fields' parent, one for itself as a holder of fields, and one for the elements of arrays, used if there is none."""
    parent = F.when((F.size("path") > 0) & _is_field(), F.slice("path", F.lit(1), F.size("path") - 1)).otherwise(F.col("path"))
    star = F.concat("path", F.array(F.lit("*")))
    roles = F.array(
        F.struct(F.lit("self").alias("role"), parent.alias("at")), F.when(F.col("objs") > 0, F.struct(F.lit("holder").alias("role"), F.col("path").alias("at"))),
        F.when(F.col("arrays") > 0, F.struct(F.lit("elements").alias("role"), star.alias("at"))),
    )
    return out.select("*", F.explode(F.array_compact(roles)).alias("_r")).withColumns({"_role": F.col("_r.role"), "_at": F.col("_r.at")}).drop("_r")


def _is_field() -> Column:
    return F.element_at("path", -1).startswith(".")


def _met() -> tuple[Column, Column]:
    """Of the rows of one _at: how many objects it holds, and whether its elements have a row."""
    return F.max(F.when(F.col("_role") == "holder", F.col("objs"))), F.max((F.col("_role") == "self") & (F.col("path") == F.col("_at")))


def _finished(rows: DataFrame, by: list[str], kinds: list[tuple[str, str]]) -> DataFrame:
    added = F.col("_role") == "elements"
    rows = rows.where((F.col("_role") == "self") | (added & ~F.coalesce("_known", F.lit(False))))
    kept = [F.when(added, F.lit(0 if t == "bigint" and c != "length_sum" else None).cast(t)).otherwise(F.col(c)).alias(c) for c, t in kinds if c not in (*by, "path")]
    rows = rows.select(*by, F.when(added, F.col("_at")).otherwise(F.col("path")).alias("path"), "_held", *kept)
    total = F.when((F.size("path") > 0) & _is_field(), F.col("_held")).otherwise(F.col("seen"))
    present = F.col("numbers") + F.col("strings") + F.col("booleans") + F.col("arrays") + F.col("objs")
    return rows.withColumn("total", total).withColumn("nulls", total - present).drop("seen", "_held")


def value_digest_of(out: DataFrame, by: list[str]) -> DataFrame:
    """Value digests of ``value_sums``: with totals, which fields have from their parents, and nulls."""
    held, known = (c.over(Window.partitionBy(*by, "_at")) for c in _met())
    return _finished(_roles(out).select("*", held.alias("_held"), known.alias("_known")), by, out.dtypes)


def streamed_value_digest_of(out: DataFrame, by: list[str]) -> DataFrame:
    """The same by a second aggregation, which a stream can chain to the first: the fields of one parent, which budgets and schemas bound, meet in a row."""
    own = F.struct(F.col("_role").alias("_role"), *[c for c in out.columns if c not in by])
    held, known = _met()
    rows = _roles(out).groupBy(*by, "_at").agg(held.alias("_held"), known.alias("_known"), F.collect_list(F.when(F.col("_role") != "holder", own)).alias("_own"))
    return _finished(rows.select(*by, "_at", "_held", "_known", F.inline("_own")), by, out.dtypes)


def value_rollup(digests: DataFrame, by: list[str]) -> DataFrame:
    """Digests of many windows or instances as one; sketches, if there are any, are merged."""
    sums = [F.sum(c).alias(c) for c in _SUMS]
    ends = [F.min(c).alias(c) for c in ("number_min", "length_min")] + [F.max(c).alias(c) for c in ("number_max", "length_max")]
    union = [F.hll_union_agg(c).alias(c) for c in _SKETCHES if c in digests.columns]
    return digests.groupBy(*by, "path").agg(*sums, *ends, *union)


def cardinalities(digests: DataFrame) -> DataFrame:
    """Sketches as estimates: number_cardinality, string_cardinality, length_cardinality."""
    for c in _SKETCHES:
        digests = digests.withColumn(c.replace("sketch", "cardinality"), F.coalesce(F.hll_sketch_estimate(c), F.lit(0))).drop(c)
    return digests


def _sketched(row: dict, name: str) -> dict:
    """The sketch of a class with its estimate, if the digest has one."""
    sketch = row.get(f"{name}_sketch")
    return {} if sketch is None else {"hyperLogLog": {"data": base64.b64encode(sketch).decode(), "cardinality": str(int(row[f"{name}_estimate"]))}}


def _entry(row: dict, fields: dict, elements: dict | None) -> dict:
    whole = lambda n: str(int(n))
    out = {"total": whole(row["total"]), "null": whole(row["nulls"])}
    base = lambda n, default: {"total": whole(row["total"]), "default": whole(row[default]), "null": whole(row["total"] - row[n])}
    if row["numbers"]:
        out["number"] = base("numbers", "number_default") | _sketched(row, "number") | {"min": row["number_min"], "avg": {"sum": row["number_sum"], "count": whole(row["numbers"])}, "max": row["number_max"]}
    if row["strings"]:
        length = {"min": int(row["length_min"]), "avg": {"sum": int(row["length_sum"]), "count": whole(row["strings"])}, "max": int(row["length_max"])}
        out["string"] = base("strings", "string_default") | _sketched(row, "string") | {"length": _sketched(row, "length") | length}
    if row["booleans"]:
        out["boolean"] = base("booleans", "booleans") | {"falseCount": whole(row["booleans"] - row["true_count"]), "trueCount": whole(row["true_count"])}
        out["boolean"]["default"] = out["boolean"]["falseCount"]
    if row["arrays"]:
        out["array"] = base("arrays", "array_default") | {"values": elements}
    if row["objs"]:
        out["obj"] = base("objs", "obj_default") | {"fields": fields}
    return out


def value_json(digests: DataFrame, by: list[str]) -> DataFrame:
    """One JSON body a digest: the root object; sketches as base64, with their estimates beside them."""
    for c in _SKETCHES:
        if c in digests.columns:
            digests = digests.withColumn(c.replace("sketch", "estimate"), F.hll_sketch_estimate(c))
    return rendered(digests, by, lambda rows: folded(rows, _entry).get("obj", {}))

"""Metric rows from events and value digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NODE = "array<struct<path:array<string>,v:variant>>"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: The names of the metrics of each class of values, with the expression and the kind (sum or gauge) of each. "any" stands for every class.
METRICS = {
    "any": [("total", "total", "sum"), ("null", "nulls", "sum")],
    "number": [("total", "total", "sum"), ("default", "number_default", "sum"), ("null", "total - numbers", "sum"), ("min", "number_min", "gauge"), ("avg", "number_sum / numbers", "gauge"), ("max", "number_max", "gauge"), ("cardinality", "number_cardinality", "gauge")],
    "string": [("total", "total", "sum"), ("default", "string_default", "sum"), ("null", "total - strings", "sum"), ("cardinality", "string_cardinality", "gauge"), ("length_min", "length_min", "gauge"), ("length_avg", "length_sum / strings", "gauge"), ("length_max", "length_max", "gauge"), ("length_cardinality", "length_cardinality", "gauge")],
    "boolean": [("total", "total", "sum"), ("default", "booleans - true_count", "sum"), ("null", "total - booleans", "sum"), ("false", "booleans - true_count", "sum"), ("true", "true_count", "sum")],
    "array": [("total", "total", "sum"), ("default", "array_default", "sum"), ("null", "total - arrays", "sum")],
    "obj": [("total", "total", "sum"), ("default", "obj_default", "sum"), ("null", "total - objs", "sum")],
}
_PRESENT = {"any": "size(path) > 0", "number": "numbers > 0", "string": "strings > 0", "boolean": "booleans > 0", "array": "arrays > 0", "obj": "objs > 0"}


def event_metrics(records: DataFrame) -> DataFrame:
    """A delta sum of 1 for each event record."""
    rows = records.where("sample_type = 'event'")
    return rows.select("ts", "resource", "sampler", F.lit("sum").alias("kind"), F.lit(True).alias("monotonic"), F.lit("delta").alias("temporality"), "sample_type", F.element_at("stream_uids", 1).alias("stream_uid"), "event_uid", F.lit(1).cast("bigint").alias("value_int"))


def field_path(path: Column | str, kind: Column | str) -> Column:
    r"""A path as text: ["$":obj]["a":obj]["b":number]; \ and " in names are escaped. Parents are typed by what holds the child."""
    path = F.col(path) if isinstance(path, str) else path
    kind = F.lit(kind) if isinstance(kind, str) else kind
    name = lambda p: F.when(p == "*", F.lit("*")).otherwise(F.replace(F.replace(p.substr(F.lit(2), F.length(p)), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')))
    part = lambda n, k: F.concat(F.lit('["'), n, F.lit('":'), k, F.lit("]"))
    below = lambda i: F.when(F.get(path, i) == "*", "array").when(F.get(path, i).isNotNull(), "obj").otherwise(kind)
    return F.concat(part(F.lit("$"), below(F.lit(0))), F.array_join(F.transform(path, lambda p, i: part(name(p), below(i + 1))), ""))


def value_metrics(digests: DataFrame, keep: list[str]) -> DataFrame:
    """A row per path, class and statistic of ``value_digest`` rows with cardinalities: keep, field_path, class, name, kind, value."""
    have = set(digests.columns)
    rows = []
    for cls, names in METRICS.items():
        for name, value, kind in names:
            if not (value.endswith("cardinality") and value not in have):
                rows.append(F.when(F.expr(_PRESENT[cls]), F.struct(F.lit(cls).alias("class"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.expr(f"cast({value} as double)").alias("value"))))
    out = digests.select(*keep, "path", F.explode(F.array_compact(F.array(*rows))).alias("m"))
    return out.select(*keep, field_path("path", F.col("m.class")).alias("field_path"), "m.*")


def uuid5(namespace: Column, name: Column) -> Column:
    """The name-based UUID (version 5) of ``name`` in a namespace given as UUID text."""
    data = F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode(name, "UTF-8"))
    h = F.sha1(data)
    nibble = F.lower(F.hex(F.conv(h.substr(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-5"), h.substr(14, 3), F.lit("-"), nibble, h.substr(18, 3), F.lit("-"), h.substr(21, 12))


def metric_id(uid: Column, path: Column, name: Column) -> Column:
    """An identifier chained from the digest's or event's uid, the field path and the metric's name."""
    chained = uuid5(uuid5(uid, path), name)
    return F.concat(F.lit("_"), F.replace(chained, F.lit("-"), F.lit("_")))


def validated(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that metrics can be made of, and the others with errors."""
    checks = [
        F.when((F.col("sample_type") == "event") & ~F.col("event_uid").rlike(UUID), "event uid is not a UUID"),
        F.when(F.col("sample_type").endswith("digest") & ~F.col("digest_uid").rlike(UUID), "digest uid is not a UUID"),
        F.when(F.size("stream_uids") != 1, "not exactly one stream"),
        F.when(F.col("encoding") != "json", "encoding is not json"),
    ]
    rows = records.withColumn("errors", F.array_compact(F.array(*checks)))
    return rows.where(F.size("errors") == 0).drop("errors"), rows.where(F.size("errors") > 0)


def walked(start: str, below: Callable[[str], str], most: str) -> str:
    """SQL of the nodes ``start`` and all below them. ``below`` turns nodes into those one level down; there are at most ``most`` levels."""
    step = f"case when size(s.last) = 0 then s else named_struct('seen', concat(s.seen, s.last), 'last', {below('s.last')}) end"
    return f"aggregate(sequence(0, {most}), named_struct('seen', cast(array() as {_NODE}), 'last', {start}), (s, i) -> {step}, s -> concat(s.seen, s.last))"


def brackets(text: str) -> str:
    """SQL of the number of brackets that open in a JSON text, which its depth can't exceed."""
    return rf"regexp_count({text}, '[\\[{{]')"


def digests_from_body(records: DataFrame, keep: list[str]) -> DataFrame:
    """``value_digest`` rows read back from JSON bodies of value-digest records; sketches are null where the body has none."""
    node = "array<struct<path:array<string>,v:variant>>"
    root = "array(struct(cast(array() as array<string>) as path, parse_json(concat('{\"total\":\"0\",\"null\":\"0\",\"obj\":', body, '}')) as v))"
    fields = "transform(map_entries(coalesce(try_variant_get(n.v, '$.obj.fields', 'map<string,variant>'), cast(map() as map<string,variant>))), e -> struct(concat(n.path, array('.' || e.key)) as path, e.value as v))"
    values = f"if(try_variant_get(n.v, '$.array.values', 'variant') is null, cast(array() as {node}), array(struct(concat(n.path, array('*')) as path, variant_get(n.v, '$.array.values', 'variant') as v)))"
    nodes = walked(root, lambda above: f"flatten(transform({above}, n -> concat({fields}, {values})))", f"coalesce({brackets('body')}, 0) + 1")
    rows = records.where("sample_type = 'value-digest'").select(*keep, F.explode(F.expr(nodes)).alias("n"))
    get = lambda path, kind="bigint": F.try_variant_get(F.col("n.v"), f"$.{path}", kind)
    path = F.col("n.path")
    # the root's totals are those of its object
    total = F.when(F.size(path) == 0, get("obj.total")).otherwise(get("total"))
    count = lambda cls: F.coalesce(get(f"{cls}.total") - get(f"{cls}.null"), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        *keep, path.alias("path"), total.alias("total"), F.when(F.size(path) == 0, get("obj.null")).otherwise(get("null")).alias("nulls"),
        count("number").alias("numbers"), zero(get("number.default")).alias("number_default"), get("number.min", "double").alias("number_min"), get("number.max", "double").alias("number_max"), get("number.avg.sum", "double").alias("number_sum"),
        count("string").alias("strings"), zero(get("string.default")).alias("string_default"), get("string.length.min").alias("length_min"), get("string.length.max").alias("length_max"), get("string.length.avg.sum").alias("length_sum"),
        count("boolean").alias("booleans"), zero(get("boolean.trueCount")).alias("true_count"), count("array").alias("arrays"), zero(get("array.default")).alias("array_default"), count("obj").alias("objs"), zero(get("obj.default")).alias("obj_default"),
        *[F.unbase64(get(f"{where}.hyperLogLog.data", "string")).alias(f"{name}_sketch") for name, where in (("number", "number"), ("string", "string"), ("length", "string.length"))],
    )

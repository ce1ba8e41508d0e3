"""Queries of structure and value digests, windows and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sampletide.functions.shred import path_text, shred, shred_within
from sampletide.operators import digests as d
from sampletide.operators import struct_digest as st
from sampletide.operators import value_digest as vd
from sampletide.operators.sampling import assign_streams
from sampletide.plans.config import in_force
from sampletide.queries.registry import EVENT_ROWS, event_rows, query, table
from sampletide.queries.sampling import _STREAMS, STREAMS
from sampletide.sources.samples import struct_samples

UID = "6f1c2d3e-4b5a-4978-8695-a4b3c2d1e0f9"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: id, value and the parsed props, with sampler and day."""
    rows = event_rows(spark, sf_dir).withColumn("props", F.try_parse_json("props"))
    return d.with_window(struct_samples(rows, ["event_id", "value", "props"]), "1 day")


def _orders(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ("price", "status", "done", "lines")) -> DataFrame:
    """Orders with their lines nested as an array of objects."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))).alias("lines"))  # an order's lines
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = rows.select(F.col("o_orderpriority").alias("sampler"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), (F.col("o_orderstatus") == "F").alias("done"), F.coalesce("lines", F.array().cast("array<struct<quantity:double,flag:string>>")).alias("lines"))
    return struct_samples(rows, list(fields))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return struct_samples(table(spark, sf_dir, "embeddings").select((F.col("label") % 3).cast("string").alias("sampler"), "embedding"), ["embedding"])


_O = """o AS (SELECT o_orderkey, o_orderpriority AS sampler, o_totalprice, o_orderstatus FROM orders), l AS (SELECT o.sampler, l.* FROM o JOIN lineitem l ON l_orderkey = o_orderkey),
    n AS (SELECT o.sampler, o_orderkey, count(l_orderkey) AS n FROM o LEFT JOIN lineitem l ON l_orderkey = o_orderkey GROUP BY ALL)"""


@query(
    f"""WITH {_O}, p AS (SELECT sampler, '' AS path, 'obj' AS kind, NULL AS number FROM o UNION ALL SELECT sampler, '.price', 'float', o_totalprice FROM o UNION ALL SELECT sampler, '.status', 'string', NULL FROM o
    UNION ALL SELECT sampler, '.done', 'boolean', NULL FROM o UNION ALL SELECT sampler, '.lines', 'array', NULL FROM o UNION ALL SELECT sampler, '.lines*', 'obj', NULL FROM l
    UNION ALL SELECT sampler, '.lines*.quantity', 'float', l_quantity FROM l UNION ALL SELECT sampler, '.lines*.flag', 'string', NULL FROM l)
    SELECT sampler, path, kind, CAST(count(*) AS BIGINT) AS n, round(sum(number), 2) AS total FROM p GROUP BY ALL"""
)
def shred_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = shred(_orders(spark, sf_dir), ["sampler"]).withColumn("kind", F.when(F.col("kind") == "int", "float").otherwise(F.col("kind")))
    return nodes.groupBy("sampler", path_text("path").alias("path"), "kind").agg(F.count("*").alias("n"), F.round(F.sum("number"), 2).alias("total"))


_EVENT_PATHS = "(VALUES (''), ('.event_id'), ('.value'), ('.props'), ('.props.k')) t(path)"


@query("WITH " + EVENT_ROWS + f" SELECT sampler, path, CAST(count(*) AS BIGINT) AS present FROM e, {_EVENT_PATHS} GROUP BY ALL")
def struct_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = shred(_events(spark, sf_dir), ["sampler"])
    return nodes.groupBy("sampler", path_text("path").alias("path")).agg(F.count("*").alias("present"))


@query("SELECT event_type AS sampler, CAST(count(*) AS BIGINT) AS ints, CAST(count(value) AS BIGINT) AS floats, CAST(count(props) AS BIGINT) AS json_floats FROM events GROUP BY ALL")
def struct_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    typed = st.struct_digest(shred(rows, ["sampler"]), ["sampler"])
    text = rows.select("sampler", F.col("sample.props").alias("sample"))
    parsed = st.struct_digest(shred(text, ["sampler"]), ["sampler"], json_numbers=True).where(path_text("path") == ".k")
    at = lambda p, c: F.max(F.when(path_text("path") == p, F.col(c)))
    # whole doubles are stored as such, so they stay floats
    out = typed.groupBy("sampler").agg(at(".event_id", "ints").alias("ints"), at(".value", "floats").alias("floats"))
    return out.join(parsed.select("sampler", F.col("floats").alias("json_floats")), "sampler")


@query(
    """SELECT CAST(label % 3 AS VARCHAR) AS sampler, CAST(count(*) AS BIGINT) AS arrays, CAST(min(len(embedding)) AS BIGINT) AS min_length, CAST(max(len(embedding)) AS BIGINT) AS max_length,
    CAST(sum(len(embedding)) AS BIGINT) AS sum_length, CAST(sum(len(embedding)) AS BIGINT) AS elements FROM embeddings GROUP BY ALL"""
)
def struct_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.struct_digest(shred(_embeddings(spark, sf_dir), ["sampler"]), ["sampler"])
    elements = out.where(path_text("path") == ".embedding*").select("sampler", (F.col("floats") + F.col("ints")).alias("elements"))
    arrays = out.where(path_text("path") == ".embedding").select("sampler", "arrays", F.col("min_length").cast("bigint").alias("min_length"), F.col("max_length").cast("bigint").alias("max_length"), "sum_length")
    return arrays.join(elements, "sampler")


@query("SELECT event_type AS sampler, '.x' AS path, CAST(count(*) FILTER (event_id % 3 = 0) AS BIGINT) AS strings, CAST(count(*) FILTER (event_id % 3 = 1) AS BIGINT) AS booleans, 3 AS n_classes FROM events GROUP BY ALL")
def mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("event_id") % 3 == 0, '"a"').when(F.col("event_id") % 3 == 1, "true").otherwise(F.col("event_id").cast("string"))
    rows = event_rows(spark, sf_dir).select("sampler", F.parse_json(F.concat(F.lit('{"x":'), x, F.lit("}"))).alias("sample"))
    out = st.mixed_types(st.struct_digest(shred(rows, ["sampler"]), ["sampler"], json_numbers=True))
    return out.select("sampler", path_text("path").alias("path"), "strings", "booleans", "n_classes")


_STRUCT = """SELECT sampler, day, path, CAST(CASE WHEN path IN ('', '.props') THEN count(*) ELSE 0 END AS BIGINT) AS obj, CAST(CASE WHEN path = '.value' THEN count(value) ELSE 0 END AS BIGINT) AS floats,
    CAST(CASE WHEN path IN ('.event_id', '.props.k') THEN count(*) ELSE 0 END AS BIGINT) AS ints, CAST(CASE WHEN path = '.value' THEN count(*) - count(value) ELSE 0 END AS BIGINT) AS nulls"""


@query("WITH " + EVENT_ROWS + f" {_STRUCT.replace('day,', 'date_trunc($$day$$, ts) AS window_start,')} FROM e, {_EVENT_PATHS} GROUP BY sampler, window_start, path")
def struct_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.struct_digest(shred(_events(spark, sf_dir), ["sampler", "window_start"]), ["sampler", "window_start"])
    return out.select("sampler", F.col("window_start").cast("timestamp_ntz").alias("window_start"), path_text("path").alias("path"), "obj", "floats", "ints", "nulls")


@query("WITH " + EVENT_ROWS + f" {_STRUCT.replace('day,', '')} FROM e, {_EVENT_PATHS} GROUP BY sampler, path")
def struct_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.struct_digest(shred(_events(spark, sf_dir), ["sampler", "window_start"]), ["sampler", "window_start"])
    return st.struct_rollup(out, ["sampler"]).select("sampler", path_text("path").alias("path"), "obj", "floats", "ints", "nulls")


@query("WITH " + EVENT_ROWS + " SELECT sampler, path, CAST(count(*) AS BIGINT) AS n, true AS truncated FROM e, (VALUES (''), ('.event_id'), ('.props')) t(path) GROUP BY ALL")
def field_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = shred_within(_events(spark, sf_dir), ["sampler"], budget=6)
    return nodes.groupBy("sampler", path_text("path").alias("path"), "truncated").agg(F.count("*").alias("n"))


_BUDGET = 14


@query(
    "WITH " + EVENT_ROWS + f""", s AS (SELECT *, date_trunc('day', ts) AS day, event_id * 7919 % 5 AS x, event_id * 104729 % 9 AS k FROM e),
    fx AS (SELECT sampler, day, x, min((ts, event_id)) AS f FROM s GROUP BY ALL), fk AS (SELECT sampler, day, k, min((ts, event_id)) AS f FROM s GROUP BY ALL),
    c AS (SELECT s.*, (SELECT count(*) FROM fx WHERE fx.sampler = s.sampler AND fx.day = s.day AND fx.x <> s.x AND fx.f < (s.ts, s.event_id)) AS inner_steps,
        (SELECT count(*) FROM fk WHERE fk.sampler = s.sampler AND fk.day = s.day AND fk.k <> s.k AND fk.f < (s.ts, s.event_id)) AS outer_steps FROM s),
    t AS (SELECT *, 9 + inner_steps + 2 <= {_BUDGET} AS z, 9 + inner_steps + 2 + outer_steps > {_BUDGET} AS truncated FROM c),
    p AS (SELECT sampler, day, unnest(list_concat(['', '.id', '.k' || k, '.o', '.o.x' || x], CASE WHEN z THEN ['.z'] ELSE [] END)) AS path, truncated FROM t)
    SELECT sampler, day, path, truncated, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ALL"""
)
def value_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with changing fields under a budget that known fields use up; what is left of them."""
    id_ = F.col("event_id")
    text = F.format_string('{"id":%d,"k%d":1,"o":{"x%d":true},"z":"end"}', id_, id_ * 104729 % 9, id_ * 7919 % 5)
    rows = d.with_window(event_rows(spark, sf_dir), "1 day").withColumn("sample", F.parse_json(text))
    nodes = d.shred_known(rows, ["sampler", "window_start"], ["ts", "event_id"], _BUDGET)
    day = F.col("window_start").cast("timestamp_ntz").alias("day")
    return nodes.groupBy("sampler", day, path_text("path").alias("path"), "truncated").agg(F.count("*").alias("n"))


@query(
    """SELECT event_type AS sampler, '{"obj":{"count":"' || count(*) || '","fields":{"event_id":{"number":{"integerNum":{"count":"' || count(*) || '"}}},"props":{"obj":{"count":"' || count(*) ||
    '","fields":{"k":{"number":{"integerNum":{"count":"' || count(*) || '"}}}}}},"value":{"number":{"floatNum":{"count":"' || count(value) || '"}}}}}}' AS body FROM events GROUP BY ALL"""
)
def struct_digest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.struct_json(st.struct_digest(shred(_events(spark, sf_dir), ["sampler"]), ["sampler"]), ["sampler"])


_VALUE_NODES = f"""{_O}, v AS (SELECT sampler, '' AS path, count(*) AS total, count(*) AS present FROM o GROUP BY ALL UNION ALL SELECT sampler, '.price', count(*), count(o_totalprice) FROM o GROUP BY ALL
    UNION ALL SELECT sampler, '.status', count(*), count(o_orderstatus) FROM o GROUP BY ALL UNION ALL SELECT sampler, '.done', count(*), count(o_orderstatus) FROM o GROUP BY ALL
    UNION ALL SELECT sampler, '.lines', count(*), count(*) FROM o GROUP BY ALL UNION ALL SELECT sampler, '.lines*', sum(n), sum(n) FROM n GROUP BY ALL
    UNION ALL SELECT sampler, '.lines*.quantity', count(*), count(l_quantity) FROM l GROUP BY ALL UNION ALL SELECT sampler, '.lines*.flag', count(*), count(l_returnflag) FROM l GROUP BY ALL)"""


def _values(spark: SparkSession, sf_dir: str, sketches: bool = False) -> DataFrame:
    return vd.value_digest(shred(_orders(spark, sf_dir), ["sampler"]), ["sampler"], sketches).withColumn("path", path_text("path"))


@query(f"WITH {_VALUE_NODES} SELECT sampler, path, CAST(total AS BIGINT) AS total, CAST(total - present AS BIGINT) AS nulls FROM v")
def value_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).select("sampler", "path", "total", "nulls")


_NUMBERS = """CAST(count({0}) AS BIGINT) AS numbers, CAST(count(*) FILTER ({0} = 0) AS BIGINT) AS number_default, min({0}) AS number_min, max({0}) AS number_max, round(sum({0}), 2) AS number_sum"""


@query(f"WITH {_O} SELECT sampler, '.price' AS path, {_NUMBERS.format('o_totalprice')} FROM o GROUP BY ALL UNION ALL SELECT sampler, '.lines*.quantity', {_NUMBERS.format('l_quantity')} FROM l GROUP BY ALL")
def value_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).where("numbers > 0").select("sampler", "path", "numbers", "number_default", "number_min", "number_max", F.round("number_sum", 2).alias("number_sum"))


@query(
    """SELECT coalesce(lang, 'unknown') AS sampler, CAST(count(*) AS BIGINT) AS total, CAST(count(text) AS BIGINT) AS strings, CAST(count(*) FILTER (text = '') AS BIGINT) AS string_default,
    CAST(min(strlen(text)) AS BIGINT) AS length_min, CAST(max(strlen(text)) AS BIGINT) AS length_max, CAST(sum(strlen(text)) AS BIGINT) AS length_sum FROM documents GROUP BY ALL"""
)
def value_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = struct_samples(table(spark, sf_dir, "documents").withColumn("sampler", F.coalesce("lang", F.lit("unknown"))), ["text"])
    out = vd.value_digest(shred(rows, ["sampler"]), ["sampler"], False).where(path_text("path") == ".text")
    return out.select("sampler", "total", "strings", "string_default", F.col("length_min").cast("bigint").alias("length_min"), F.col("length_max").cast("bigint").alias("length_max"), "length_sum")


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS sampler, CAST(count(*) AS BIGINT) AS total, CAST(count(quality) AS BIGINT) AS booleans, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS true_count FROM labels GROUP BY ALL")
def value_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("sampler"), (F.col("quality") == 1).alias("good"))
    out = vd.value_digest(shred(struct_samples(rows, ["good"]), ["sampler"]), ["sampler"], False).where(path_text("path") == ".good")
    return out.select("sampler", "total", "booleans", "true_count")


@query(f"WITH {_O} SELECT sampler, CAST(count(*) AS BIGINT) AS arrays, CAST(count(*) FILTER (n = 0) AS BIGINT) AS array_default, CAST(sum(n) AS BIGINT) AS elements FROM n GROUP BY ALL")
def value_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _values(spark, sf_dir)
    return out.where("path = '.lines'").select("sampler", "arrays", "array_default").join(out.where("path = '.lines*'").select("sampler", F.col("total").alias("elements")), "sampler")


@query(f"WITH {_VALUE_NODES} SELECT sampler, path, CAST(total AS BIGINT) AS total, CAST(total AS BIGINT) AS objs, CAST(0 AS BIGINT) AS obj_default FROM v WHERE path IN ('', '.lines*')")
def value_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).where("objs > 0").select("sampler", "path", "total", "objs", "obj_default")


def _near(estimate: str, exact: str) -> Column:
    """Whether an estimate is within six standard errors of the sketch, or 2."""
    return F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(F.lit(2), F.lit(0.048) * F.col(exact))


@query(
    f"""WITH {_O}, x AS (SELECT sampler, '.price' AS path, o_totalprice AS number, NULL AS text FROM o UNION ALL SELECT sampler, '.status', NULL, o_orderstatus FROM o
    UNION ALL SELECT sampler, '.lines*.quantity', l_quantity, NULL FROM l UNION ALL SELECT sampler, '.lines*.flag', NULL, l_returnflag FROM l)
    SELECT sampler, path, CAST(count(DISTINCT number) AS BIGINT) AS numbers, CAST(count(DISTINCT text) AS BIGINT) AS strings, CAST(count(DISTINCT strlen(text)) AS BIGINT) AS lengths, true AS near FROM x GROUP BY ALL"""
)
def approx_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts, and whether the sketches' estimates are near them."""
    nodes = shred(_orders(spark, sf_dir), ["sampler"]).where("kind in ('int', 'float', 'string')")
    exact = nodes.groupBy("sampler", path_text("path").alias("path")).agg(F.count_distinct("number").alias("numbers"), F.count_distinct("text").alias("strings"), F.count_distinct(F.octet_length("text")).alias("lengths"))
    both = vd.cardinalities(_values(spark, sf_dir, True)).drop("numbers", "strings").join(exact, ["sampler", "path"])
    near = _near("number_cardinality", "numbers") & _near("string_cardinality", "strings") & _near("length_cardinality", "lengths")
    return both.select("sampler", "path", "numbers", "strings", "lengths", near.alias("near"))


@query(f"WITH {_O} SELECT sampler, '.price' AS path, CAST(count(DISTINCT o_totalprice) AS BIGINT) AS exact FROM o GROUP BY ALL UNION ALL SELECT sampler, '.lines*.quantity', CAST(count(DISTINCT l_quantity) AS BIGINT) FROM l GROUP BY ALL")
def exact_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = shred(_orders(spark, sf_dir), ["sampler"]).where("number is not null")
    return nodes.groupBy("sampler", path_text("path").alias("path")).agg(F.count_distinct("number").alias("exact"))


@query("WITH " + EVENT_ROWS + """, x AS (SELECT sampler, '.event_id' AS path, CAST(event_id AS DOUBLE) AS number FROM e UNION ALL SELECT sampler, '.value', value FROM e UNION ALL SELECT sampler, '.props.k', CAST(json_extract(props, '$.k') AS DOUBLE) FROM e)
    SELECT sampler, path, CAST(count(DISTINCT number) AS BIGINT) AS numbers, true AS near FROM x GROUP BY ALL""")
def cardinality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of days merged: exact distinct counts, and whether the estimates are near them."""
    nodes = shred(_events(spark, sf_dir), ["sampler", "window_start"])
    exact = nodes.where("number is not null").groupBy("sampler", path_text("path").alias("path")).agg(F.count_distinct("number").alias("numbers"))
    merged = vd.cardinalities(vd.value_rollup(vd.value_digest(nodes, ["sampler", "window_start"]), ["sampler"])).withColumn("path", path_text("path")).drop("numbers")
    return merged.join(exact, ["sampler", "path"]).select("sampler", "path", "numbers", _near("number_cardinality", "numbers").alias("near"))


_EVENT_PATH_VALUES = f"""p AS (SELECT sampler, ts, path, CASE path WHEN '.value' THEN value WHEN '.event_id' THEN CAST(event_id AS DOUBLE) WHEN '.props.k' THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS value,
    path IN ('', '.props') AS is_obj FROM e, {_EVENT_PATHS})"""
_EVENT_PATH_STATS = """CAST(count(*) AS BIGINT) AS total, CAST(count(value) AS BIGINT) AS numbers, CAST(count(*) - count(value) - count(*) FILTER (is_obj) AS BIGINT) AS nulls,
    CAST(count(*) FILTER (is_obj) AS BIGINT) AS objs, min(value) AS number_min, max(value) AS number_max, round(sum(value), 2) AS number_sum"""
_STATS = ["total", "numbers", "nulls", "objs", "number_min", "number_max"]


@query("WITH " + EVENT_ROWS + f", {_EVENT_PATH_VALUES} SELECT sampler, path, {_EVENT_PATH_STATS} FROM p GROUP BY ALL")
def value_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = vd.value_digest(shred(_events(spark, sf_dir), ["sampler", "window_start"]), ["sampler", "window_start"], False)
    out = vd.value_rollup(daily, ["sampler"])
    return out.select("sampler", path_text("path").alias("path"), *_STATS, F.round("number_sum", 2).alias("number_sum"))


@query("WITH " + EVENT_ROWS + f", {_EVENT_PATH_VALUES} SELECT sampler, date_trunc('day', ts) AS window_start, path, {_EVENT_PATH_STATS} FROM p GROUP BY ALL")
def value_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["sampler", "window_start"]
    out = vd.value_digest(shred(_events(spark, sf_dir), by), by, False)
    return out.select("sampler", F.col("window_start").cast("timestamp_ntz").alias("window_start"), path_text("path").alias("path"), *_STATS, F.round("number_sum", 2).alias("number_sum"))


def _json_sql(**members: str) -> str:
    """SQL of a JSON object of members given as SQL texts; those of null are left out."""
    each = ", ".join(f"'\"{k}\":' || {v}" for k, v in members.items())
    return f"('{{' || array_to_string(list_filter([{each}], lambda x: x IS NOT NULL), ',') || '}}')"


def _count(x: str) -> str:
    return f"('\"' || CAST({x} AS BIGINT) || '\"')"


def _string_sql(total: str, n: str, default: str, least: str, most: str, length: str) -> str:
    avg = _json_sql(sum=f"CAST({length} AS VARCHAR)", count=_count(n))
    return _json_sql(total=_count(total), default=_count(default), null=_count(f"{total} - {n}"), length=_json_sql(min=f"CAST({least} AS VARCHAR)", avg=avg, max=f"CAST({most} AS VARCHAR)"))


def _entry_sql(total: str, n: str, **kind: str) -> str:
    return _json_sql(total=_count(total), null=_count(f"{total} - {n}"), **kind)


_NUMBER_JSON = _json_sql(total=_count("lines"), default=_count("zeros"), null=_count("lines - quantities"), min="lo", avg=_json_sql(sum="total", count=_count("quantities")), max="hi")
_LINE_JSON = _json_sql(
    total=_count("lines"), default="'\"0\"'", null="'\"0\"'",
    fields=_json_sql(flag=_entry_sql("lines", "flags", string=_string_sql("lines", "flags", "0", "1", "1", "flags")), quantity=_entry_sql("lines", "quantities", number=_NUMBER_JSON)),
)
_BOOLEAN_JSON = _json_sql(total=_count("n"), default=_count("n - done"), null=_count("0"), falseCount=_count("n - done"), trueCount=_count("done"))
_ORDER_JSON = _json_sql(
    total=_count("n"), default="'\"0\"'", null="'\"0\"'",
    fields=_json_sql(
        done=_entry_sql("n", "n", boolean=_BOOLEAN_JSON),
        lines=_entry_sql("n", "n", array=_json_sql(total=_count("n"), default=_count("bare"), null=_count("0"), values=_entry_sql("lines", "lines", obj=_LINE_JSON))),
        status=_entry_sql("n", "n", string=_string_sql("n", "n", "0", "1", "1", "n")),
    ),
)


@query(
    f"""WITH {_O}, a AS (SELECT sampler, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done FROM o GROUP BY ALL), b AS (SELECT sampler, count(*) FILTER (n = 0) AS bare FROM n GROUP BY ALL),
    c AS (SELECT sampler, count(*) AS lines, count(l_quantity) AS quantities, count(l_returnflag) AS flags, count(*) FILTER (l_quantity = 0) AS zeros, CAST(min(l_quantity) AS DOUBLE)::VARCHAR AS lo,
        CAST(max(l_quantity) AS DOUBLE)::VARCHAR AS hi, CAST(sum(l_quantity) AS DOUBLE)::VARCHAR AS total FROM l GROUP BY ALL)
    SELECT sampler, {_ORDER_JSON} AS body FROM a JOIN b USING (sampler) JOIN c USING (sampler)"""
)
def value_digest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = shred(_orders(spark, sf_dir, ("status", "done", "lines")), ["sampler"])
    return vd.value_json(vd.value_digest(nodes, ["sampler"], False), ["sampler"])


@query("WITH " + EVENT_ROWS + " SELECT sampler, date_trunc('day', ts) AS window_start, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL")
def digest_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.with_window(event_rows(spark, sf_dir), "1 day")
    return rows.groupBy("sampler", F.col("window_start").cast("timestamp_ntz").alias("window_start")).agg(F.count("*").alias("n"))


_CONFIG = [("d-large", "u-large", "struct-digest", "collector"), ("d-all", "u-all", "value-digest", "sampler"), ("d-all2", "u-all", "struct-digest", "collector")]
_VALUES = ", ".join(str(x) for x in _CONFIG)


def _config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CONFIG, "digest_uid string, stream_uid string, kind string, location string")


@query("WITH " + EVENT_ROWS + f", s AS (SELECT unnest(string_split({_STREAMS}, ',')) AS stream_uid FROM e) SELECT digest_uid, stream_uid, CAST(count(*) AS BIGINT) AS n FROM s JOIN (VALUES {_VALUES}) t(digest_uid, stream_uid, kind, location) USING (stream_uid) GROUP BY ALL")
def digest_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.fan_out(assign_streams(event_rows(spark, sf_dir), STREAMS), _config(spark))
    return rows.groupBy("digest_uid", "stream_uid").agg(F.count("*").alias("n"))


@query("WITH " + EVENT_ROWS + """, i AS (SELECT *, CAST(user_id % 3 AS VARCHAR) AS instance, date_trunc('day', ts) AS window_start FROM e)
    SELECT 'sampler' AS location, resource, sampler, instance, window_start, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY ALL UNION ALL SELECT 'collector', resource, sampler, '', window_start, CAST(count(*) AS BIGINT) FROM i GROUP BY ALL""")
def digest_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.with_window(event_rows(spark, sf_dir).withColumn("instance", (F.col("user_id") % 3).cast("string")), "1 day")
    out = []
    for location in ("sampler", "collector"):
        counts = rows.groupBy(*d.grouping(d.Digest("", "", location=location))).agg(F.count("*").alias("n"))
        instance = F.col("instance") if location == "sampler" else F.lit("")
        out.append(counts.select(F.lit(location).alias("location"), "resource", "sampler", instance.alias("instance"), F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n"))
    return out[0].unionByName(out[1])


@query(
    "WITH " + EVENT_ROWS + f""" SELECT date_trunc('day', ts) AS ts, resource, sampler, 'struct-digest' AS sample_type, 'all' AS streams, '{UID}' AS digest_uid,
    '{{"obj":{{"count":"' || count(*) || '","fields":{{"event_id":{{"number":{{"integerNum":{{"count":"' || count(*) || '"}}}}}},"props":{{"obj":{{"count":"' || count(*) ||
    '","fields":{{"k":{{"number":{{"integerNum":{{"count":"' || count(*) || '"}}}}}}}}}}}},"value":{{"number":{{"floatNum":{{"count":"' || count(value) || '"}}}}}}}}}}}}' AS body
    FROM e GROUP BY date_trunc('day', ts), resource, sampler"""
)
def digest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = d.Digest(UID, "all")
    bodies = d.digest_bodies(_events(spark, sf_dir), digest)
    out = d.digest_records(bodies, digest)
    return out.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "resource", "sampler", "sample_type", F.array_join("stream_uids", ",").alias("streams"), "digest_uid", "body")


@query("WITH " + EVENT_ROWS + f", s AS (SELECT DISTINCT unnest(string_split({_STREAMS}, ',')) AS stream_uid FROM e) SELECT DISTINCT location, kind FROM s JOIN (VALUES {_VALUES}) t(digest_uid, stream_uid, kind, location) USING (stream_uid)")
def digest_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.required_types(d.fan_out(assign_streams(event_rows(spark, sf_dir), STREAMS), _config(spark)))


@query(
    "WITH " + EVENT_ROWS + """, c AS (SELECT epoch_us(ts) * 1000 + event_id % 1000 AS version, ts, resource, sampler, 'd' || (user_id % 2) AS uid, CASE WHEN event_id % 75 = 0 THEN 'delete' ELSE 'upsert' END AS op,
        CASE WHEN event_id % 2 = 0 THEN 'u-all' ELSE 'u-large' END AS stream_uid FROM e WHERE event_id % 25 = 0),
    f AS (SELECT *, lead(ts) OVER (PARTITION BY resource, sampler, uid ORDER BY version) AS until FROM c),
    s AS (SELECT ts, resource, sampler, unnest(CASE WHEN value > 100 THEN ['u-large', 'u-all'] ELSE ['u-all'] END) AS stream_uid FROM e WHERE event_id % 25 <> 0)
    SELECT s.resource AS resource, s.sampler AS sampler, uid AS digest_uid, s.stream_uid AS stream_uid, CAST(count(*) AS BIGINT) AS n FROM s JOIN f ON s.resource = f.resource AND s.sampler = f.sampler AND s.stream_uid = f.stream_uid
        AND f.op = 'upsert' AND f.ts <= s.ts AND (until IS NULL OR s.ts < until) GROUP BY ALL"""
)
def digests_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples a digest gets while it is bound to their streams, by a log in which digests move between streams and go."""
    rows, id_ = event_rows(spark, sf_dir), F.col("event_id")
    payload = F.to_json(F.struct(F.when(id_ % 2 == 0, "u-all").otherwise("u-large").alias("stream")))
    changes = rows.where(id_ % 25 == 0).select(
        (F.unix_micros("ts") * 1000 + id_ % 1000).alias("version"), "ts", "resource", "sampler", F.lit("digests").alias("section"), F.when(id_ % 75 == 0, "delete").otherwise("upsert").alias("op"),
        F.concat(F.lit("d"), (F.col("user_id") % 2).cast("string")).alias("uid"), payload.alias("payload"),
    )
    bound = in_force(changes, "digests").select("resource", "sampler", F.col("uid").alias("digest_uid"), F.get_json_object("payload", "$.stream").alias("stream_uid"), "since", "until")
    samples = rows.where(id_ % 25 != 0).withColumn("stream_uids", F.array_compact(F.array(F.when(F.col("value") > 100, "u-large"), F.lit("u-all"))))
    return d.fan_out_in_force(samples, bound).groupBy("resource", "sampler", "digest_uid", "stream_uid").agg(F.count("*").alias("n"))

"""Field budgets, rendering in linear time, targets and configuration in force."""

import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sampletide.functions import segments
from sampletide.functions import shred as shredding
from sampletide.functions.shred import path_text, shred, shred_known
from sampletide.operators import digests as d
from sampletide.operators import sampling as s
from sampletide.operators import struct_digest as st
from sampletide.operators import value_digest as vd
from sampletide.plans import config as c


def test_structs_have_the_nodes_of_variants(spark):
    df = spark.sql(
        """select id, named_struct('i', cast(id as int), 'big', id * 1000000007, 'd', case id % 5 when 0 then null when 1 then double('NaN') when 2 then double('-Infinity') else id / 2 end, 't', if(id % 3 = 0, null, concat('é', id)),
        'yes', if(id % 4 = 0, null, id % 2 = 0), 'deep', if(id % 7 = 0, null, named_struct('a', array(1, null, cast(id as int)), 'e', cast(array() as array<string>), 'o', array(named_struct('x', id, 'y', 'z'), null))),
        'v', parse_json(case id % 4 when 0 then '{"k": [1, 2.5, "x", null, {"z": true}]}' when 1 then 'null' when 2 then '[]' else '3' end), 'w', try_parse_json(if(id % 2 = 0, '{"q": 1e400}', 'no json'))) as sample from range(60)"""
    ).unionByName(spark.sql("select 99L as id, cast(null as struct<i:int,big:bigint,d:double,t:string,yes:boolean,deep:struct<a:array<int>,e:array<string>,o:array<struct<x:bigint,y:string>>>,v:variant,w:variant>) as sample"))
    rows_of = lambda x: Counter((r.id, tuple(r.path), r.kind, str(r.number), r.text, r.flag, r["size"]) for r in x.collect())
    got, want = rows_of(shred(df, ["id"])), rows_of(shred(df.withColumn("sample", F.to_variant_object("sample")), ["id"]))
    assert got == want and sum(got.values()) > 1000 and not any(k[0] == 99 for k in got)
    odd = spark.sql("select 1 as id, named_struct('t', timestamp'2024-01-02 03:04:05', 'n', cast(1.5 as decimal(9, 2)), 'f', cast(0.1 as float), 'm', map('k', 1)) as sample")
    assert rows_of(shred(odd, ["id"])) == rows_of(shred(odd.withColumn("sample", F.to_variant_object("sample")), ["id"]))


def nodes_of(value, path=()):
    yield path, value
    if isinstance(value, dict):
        for k, v in value.items():
            yield from nodes_of(v, (*path, "." + k))
    elif isinstance(value, list):
        for v in value:
            yield from nodes_of(v, (*path, "*"))


def brute_known(groups, budget):
    """What is left of each sample, sample by sample: (group, number) to (sorted paths, truncated)."""
    out = {}
    for g, bodies in groups.items():
        known = {}  # object path: fields
        for i, body in bodies:
            nodes = list(nodes_of(body))
            steps = [(p, 1 if not p or v is None else 2, True) for p, v in nodes]
            spent, fresh = 0, {}
            for p, cost, _ in sorted(steps, key=lambda x: x[0]):
                spent += cost
                if spent > budget:
                    break
                if p and p[-1][0] == ".":
                    fresh.setdefault(p[:-1], set()).add(p[-1])
            lacking = {}
            within = set()
            spent = 0
            for p, cost, _ in sorted(steps, key=lambda x: x[0]):
                spent += cost
                if spent > budget:
                    break
                within.add(p)
            for p, v in nodes:
                if isinstance(v, dict) and p in within:
                    have = {"." + k for k in v if (*p, "." + k) in within}
                    lacking[p] = lacking.get(p, 0) + len(known.get(p, set()) - have)
            steps += [((*p, chr(0x10FFFF)), n, False) for p, n in lacking.items() if n]
            spent, kept, cut = 0, [], False
            for p, cost, real in sorted(steps, key=lambda x: x[0]):
                spent += cost
                if spent > budget:
                    cut = True
                    break
                if real:
                    kept.append("".join(p))
            out[g, i] = (sorted(kept), cut)
            for p, fields in fresh.items():
                known.setdefault(p, set()).update(fields)
    return out


@pytest.mark.parametrize("rows", [1_000_000, 10])
@pytest.mark.parametrize("budget", [12, 25, 1000])
def test_known_fields_cost_steps(spark, budget, rows):
    rng = random.Random(budget)

    def sample():
        body = {f"k{rng.randint(0, 9)}": rng.choice([1, None, "x"]) for _ in range(rng.randint(0, 4))}
        if rng.random() < 0.7:
            body["o"] = {f"x{rng.randint(0, 5)}": {f"y{rng.randint(0, 3)}": 1} for _ in range(rng.randint(0, 3))}
        if rng.random() < 0.5:
            body["z"] = [{f"e{rng.randint(0, 3)}": 1} if rng.random() < 0.7 else None for _ in range(rng.randint(0, 3))]
        return body

    groups = {g: [(i, sample()) for i in range(60)] for g in ("a", "b", None)}
    given = [(g, i, json.dumps(b)) for g, bodies in groups.items() for i, b in bodies]
    df = spark.createDataFrame(given, "g string, i long, body string").repartition(3).withColumn("sample", F.parse_json("body"))
    got = {}
    # elements of one array share their paths, so the budget may end between them: compare by number of nodes at a path
    for r in shred_known(df, ["g"], ["i"], budget, ["g", "i"], rows=rows).withColumn("p", path_text("path")).collect():
        paths, _ = got.setdefault((r.g, r.i), ([], r.truncated))
        paths.append(r.p)
    want = brute_known(groups, budget)
    assert {k: (sorted(p), cut) for k, (p, cut) in got.items()} == want
    assert budget > 500 or any(cut for _, cut in want.values())


def test_digests_of_both_kinds_take_their_budget(spark):
    rows = [("r", "s", i, json.dumps({f"k{i:03}{j:03}": 1 for j in range(200)})) for i in range(3)]
    df = spark.createDataFrame(rows, "resource string, sampler string, i long, body string").withColumn("sample", F.parse_json("body")).withColumn("window_start", F.timestamp_seconds(F.lit(0)))
    body = json.loads(d.digest_bodies(df, d.Digest("d", "u", "value-digest", max_fields=21), ["i"]).head().body)
    assert len(body["fields"]) == 30 and body["total"] == "3"
    assert len(json.loads(d.digest_bodies(df, d.Digest("d", "u", max_fields=21)).head().body)["obj"]["fields"]) == 30


def test_bodies_of_many_fields_take_linear_time():
    rows = {(): dict.fromkeys(("obj",), 1)}
    rows = {(): {}, **{(f".k{i}",): {} for i in range(40_000)}, **{(f".k{i}", ".x"): {} for i in range(40_000)}}
    began = time.time()
    body = st.folded(rows, lambda row, fields, elements: {"f": fields})
    assert time.time() - began < 3 and len(body["f"]) == 40_000 and body["f"]["k7"] == {"f": {"x": {"f": {}}}}


def test_estimates_stand_beside_sketches(spark):
    df = spark.range(300).select(F.lit("g").alias("g"), F.to_variant_object(F.struct((F.col("id") % 40).alias("n"), F.lit("x").alias("s"))).alias("sample"))
    body = json.loads(vd.value_json(vd.value_digest(d.shred_within(df, ["g"], 100), ["g"]), ["g"]).head().body)
    assert body["fields"]["n"]["number"]["hyperLogLog"]["cardinality"] == "40" and body["fields"]["s"]["string"]["length"]["hyperLogLog"]["cardinality"] == "1"


def test_targets_of_any_stream_and_of_none(spark):
    rows = [("r", "s", "streams", '{"name":"all"}'), ("r", "t", "digests", "{}")]
    config = spark.createDataFrame(rows, "resource string, sampler string, section string, payload string")
    assert c.match_targets(config, "r", "*", "*").count() == c.match_targets(config, "r", "*", "").count() == 2
    assert c.required_targets(config, "r", "*", "a*").count() == 1
    for sampler, said in (("*", "no sampler matches"), ("s", "no such sampler")):
        with pytest.raises(LookupError, match=said):
            c.required_targets(config, "r", sampler, "other")
    with pytest.raises(LookupError):
        c.bulk_change(config, "x", "s", "limiter_in", "set", "", "{}", F.lit(1))


def test_streams_are_those_in_force_at_the_time(spark):
    log = [(1, 10, "upsert", "a", "one"), (2, 20, "upsert", "a", "two"), (3, 30, "upsert", "b", "one"), (4, 40, "delete", "b", None), (5, 50, "reset", "", None), (5, 50, "upsert", "c", "two"), (6, 60, "upsert", "d", "two")]
    changes = spark.createDataFrame([(v, t, op, uid, None if n is None else json.dumps({"name": n})) for v, t, op, uid, n in log], "version long, at long, op string, uid string, payload string")
    changes = changes.select("version", F.timestamp_seconds("at").alias("ts"), F.lit("r").alias("resource"), F.lit("s").alias("sampler"), F.lit("streams").alias("section"), "op", "uid", "payload")
    times = [5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60]
    given = spark.createDataFrame([(t, ["one", "two"], []) for t in times], "at long, stream_names array<string>, stream_uids array<string>").withColumn("ts", F.timestamp_seconds("at")).withColumn("resource", F.lit("r")).withColumn("sampler", F.lit("s"))
    out = {r["at"]: (r.stream_uids, r.errors) for r in s.translate_streams_in_force(given, c.streams_in_force(changes)).collect()}
    assert out[5] == ([], []) and out[10] == out[15] == (["a"], ["two"]) and out[20] == out[25] == (["a"], ["one"])
    assert out[30] == out[35] == (["b", "a"], []) and out[40] == out[45] == (["a"], ["one"]) and out[50] == out[55] == out[60] == (["c"], ["one"])


def test_streams_in_force_of_long_logs(spark):
    """Overlapping definitions, repeated names and ties of time, by brute force; and a log as long as the records takes no more time than a sort."""
    rng = random.Random(3)
    log = [(rng.choice("rq"), rng.choice("st"), rng.choice(["a", "b", "c", None]), rng.choice(["1", "2", "3", None]), a, rng.choice([None, a, a + 1, a + rng.randint(0, 40)])) for a in (rng.randint(0, 99) for _ in range(120))]
    streams = spark.createDataFrame(log, "resource string, sampler string, name string, uid string, a long, b long").withColumns({"since": F.timestamp_seconds("a"), "until": F.timestamp_seconds("b")})
    asked = [(i, rng.choice(["r", "q", None]), rng.choice("stx"), rng.choice([None, *range(100)]), [rng.choice(["a", "b", "c", "d", None]) for _ in range(rng.randint(0, 4))], rng.choice([[], [], ["u"]])) for i in range(900)]
    given = spark.createDataFrame(asked, "i long, resource string, sampler string, at long, stream_names array<string>, stream_uids array<string>").withColumn("ts", F.timestamp_seconds("at")).repartition(3)
    for rows in (20, 10_000):
        out = s.translate_streams_in_force(given, streams, rows)
        got = {x.i: (x.stream_uids, x.stream_names, x.errors) for x in out.collect()}
        assert out.columns == [*given.columns, "errors"] and len(got) == 900
        for i, r, p, at, names, uids in asked:
            own = [x for x in log if x[:2] == (r, p) and x[2] is not None]
            want = (uids, names, [])
            if names and not uids and at is not None and any(x[4] <= at for x in own):
                found = [min((x[3] for x in own if x[2] == n and x[3] and x[4] <= at and (x[5] is None or at < x[5])), default=None) for n in names]
                want = ([x for x in found if x], [], [n for n, x in zip(names, found, strict=True) if not x])
            assert got[i] == want
    many = spark.range(60_000).select(F.lit("r").alias("resource"), F.lit("s").alias("sampler"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 7).cast("string").alias("uid"), "id")
    changes = many.withColumns({"version": F.col("id"), "section": F.lit("streams"), "op": F.lit("upsert"), "payload": F.lit('{"name":"n"}')})
    began = time.time()
    out = s.translate_streams_in_force(many.select("resource", "sampler", "ts", F.array(F.lit("n")).alias("stream_names"), F.array().cast("array<string>").alias("stream_uids")), c.streams_in_force(changes))
    assert out.where(F.size("stream_uids") == 1).count() == 60_000 and time.time() - began < 60


def test_samples_are_counted_without_taking_them_apart(spark, monkeypatch):
    """Cuts come from the samples; samples of one order, elements of arrays and null groups share steps as before."""
    plans, cuts_of = [], segments.cuts_of

    def seen(df, *given):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cuts_of(df, *given)

    monkeypatch.setattr(segments, "cuts_of", seen)
    monkeypatch.setattr(shredding, "cuts_of", seen, raising=False)
    rows = [(None, 1, '{"a":[{"x":1,"y":3}]}'), (None, 1, '{"a":[{"x":1}],"b":1}'), (None, 2, '{"a":[{"z":1}]}')]
    df = spark.createDataFrame(rows, "g string, i int, body string").withColumn("sample", F.parse_json("body")).repartition(3)
    got = sorted((r.i, r.truncated, "".join(r.path)) for r in shred_known(df, ["g"], ["i"], 9, ["g", "i"]).collect() if r.i == 2)
    assert got == [(2, True, p) for p in ("", ".a", ".a*", ".a*.z")]  # 7 steps for nodes, 2 for x and y, which makes 9; b, where the first samples reach it, is one more
    assert plans and not any("MapInArrow" in p for p in plans)

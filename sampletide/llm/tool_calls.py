"""Tool-call linking in conversations, with DataFrame functions only.

Calls and results are hash-joined by conversation and call id, calls are ordered so that each follows those it
depends on, arguments are checked against the tools' schemas, and each linked call becomes one line of canonical
JSON (keys sorted, no spaces).

Of calls or results with one id the first (by turn, then content) counts and the rest only raise n_calls or n_results.
A result without a call has status "orphan"; a call without a result "pending"; one that depends on itself through
others "cyclic" (no level); one with schema errors "invalid"; else "ok". Dependencies on calls that don't exist are
ignored. Null ids link with nothing and are left out; null arguments are an error; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sampletide.llm.common import partitions, removed, written

KEY = ["conv_id", "call_id"]


def chains(single: DataFrame) -> DataFrame:
    """Calls that need exactly one other (KEY, to): the nearest call on the way that doesn't, and how far it is.

    By pointer doubling: a chain of n calls takes log2(n) rounds, each a written table of the calls that were open before it, and looked up
    together with those that have ended. A round in which none ends leaves only calls whose way never does: they have a null to.
    """
    now, _ = written(single.withColumn("far", F.lit(1).cast("long")), "call-chains")
    ended = now.where("false")
    while True:
        ahead = now.withColumn("_open", F.lit(True)).unionByName(ended.withColumn("_open", F.lit(False)))
        ahead = ahead.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"), "_open")
        both = now.join(ahead, ["conv_id", "to"], "left")
        both = both.select(*KEY, F.coalesce("_to", "to").alias("to"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), F.coalesce("_open", F.lit(False)).alias("open"))
        both, _ = written(both, "call-chains")
        now, done = both.where("open").drop("open"), both.where("not open").drop("open")
        if done.isEmpty():
            return ended.unionByName(now.withColumn("to", F.lit(None).cast(single.schema["to"].dataType)))
        ended = ended.unionByName(done)
        if now.isEmpty():
            return ended


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and level (the longest way to a call that needs nothing) of every call that can be ordered.

    Chains are contracted first, so the rounds that follow grow only with how deep calls of several needs are nested.
    """
    known = calls.select(*KEY)
    edges = calls.select(*KEY, F.explode(F.array_distinct("depends_on")).alias("needs")).where("needs is not null")
    edges = edges.join(known.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi")
    edges, _ = written(edges, "call-edges")
    counts = edges.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("needs").alias("to"))
    chain, _ = written(chains(counts.where("n = 1").select(*KEY, "to")), "call-chains")
    # calls of several needs, each need moved to the end of its chain
    several = edges.join(counts.where("n > 1").select(*KEY), KEY, "left_semi")
    ends = chain.select("conv_id", F.col("call_id").alias("needs"), F.col("to").alias("_to"), "far")
    moved = several.join(ends, ["conv_id", "needs"], "left")
    several, at = written(moved.select(*KEY, F.when(F.col("far").isNull(), F.col("needs")).otherwise(F.col("_to")).alias("needs"), (F.coalesce("far", F.lit(0)) + 1).alias("far")), "call-edges")
    solved, _ = written(known.join(counts.select(*KEY), KEY, "left_anti").withColumn("level", F.lit(0)), "call-levels")
    done, fresh, left = solved, solved, several.withColumn("settled", F.lit(None).cast("int"))
    while not left.isEmpty():
        # an edge that ends at a call of the last round is settled; a call whose edges all are gets its level
        marks = fresh.select("conv_id", F.col("call_id").alias("needs"), F.col("level").alias("found"))
        left, last = left.join(marks, ["conv_id", "needs"], "left"), at
        left = left.withColumn("settled", F.coalesce("settled", F.col("found") + F.col("far"))).drop("found")
        by_call = left.groupBy(*KEY).agg(F.max("settled").alias("level"), F.count_if(F.col("settled").isNull()).alias("open"))
        fresh, _ = written(by_call.where("open = 0").select(*KEY, "level"), "call-levels")
        if fresh.isEmpty():  # what is left is cyclic or depends on it
            break
        left, at = written(left.join(fresh.select(*KEY), KEY, "left_anti"), "call-edges")
        removed(calls.sparkSession, last)
        done = done.unionByName(fresh)
    end = done.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("_level"))
    return done.unionByName(chain.join(end, ["conv_id", "to"]).select(*KEY, (F.col("_level") + F.col("far")).alias("level")))


def positions(calls: DataFrame) -> DataFrame:
    """``calls`` with position: the rank by (level, turn, call_id) in the conversation, unordered calls last.

    Calls are dealt by ranges of that order, so a conversation of any size is ranked in parts, whose sizes then are added up.
    """
    order = [F.col("level").isNull(), "level", "turn", "call_id"]
    dealt = calls.repartitionByRange(partitions(calls.sparkSession), "conv_id", *order).withColumn("_part", F.spark_partition_id())
    dealt, _ = written(dealt, "call-ranges")
    counts = dealt.groupBy("conv_id", "_part").agg(F.count("*").alias("n"))
    counts = counts.select("conv_id", "_part", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("_part")) - F.col("n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "_part").orderBy(*order))
    ranked = dealt.withColumn("_inside", inside).join(counts, ["conv_id", "_part"])
    return ranked.withColumn("position", F.col("_before") + F.col("_inside") - 1).drop("_part", "_before", "_inside")


def schema_errors(arguments: Column, tool: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with JSON ``arguments``, as an array of text. Schemas: {tool: {field: (type, required)}}; other fields are errors."""
    value = F.try_parse_json(arguments)
    whole = F.schema_of_variant(value)
    is_object = whole.startswith("OBJECT")
    members = F.when(is_object, value.cast("map<string,variant>"))
    fields = F.map_keys(members)
    kinds = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}
    case = F.array(F.lit("unknown tool"))
    for name, spec in sorted(schemas.items()):
        checks = []
        for field, (kind, required) in sorted(spec.items()):
            got = F.schema_of_variant(F.try_element_at(members, F.lit(field)))
            right = F.lit(False)
            for x in kinds[kind]:
                right = right | got.startswith(x)
            missing = F.lit(f"{field} is missing") if required else F.lit(None).cast("string")
            checks.append(F.when(got.isNull(), missing).when(~right, F.lit(f"{field} is not {kind}")))
        extra = F.transform(F.array_sort(F.array_except(fields, F.array(*map(F.lit, sorted(spec))))), lambda x: F.concat(x, F.lit(" is not known")))
        case = F.when(tool == name, F.concat(F.array_compact(F.array(*checks)), extra)).otherwise(case)
    return F.when(value.isNull() | ~is_object, F.array(F.lit("arguments are not a JSON object"))).otherwise(case)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """Calls (conv_id, call_id, turn, tool, arguments, depends_on) with their results (conv_id, call_id, turn, content).

    Returns conv_id, call_id, turn, result_turn, tool, level, position, status, errors, n_calls, n_results and message.
    """
    has_key = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = F.min(F.struct("turn", "tool", "arguments", "depends_on"))
    calls = calls.where(has_key).groupBy(*KEY).agg(first.alias("call"), F.count("*").alias("n_calls")).select(*KEY, "call.*", "n_calls")
    calls, _ = written(calls, "calls")
    results = results.where(has_key).groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("result"), F.count("*").alias("n_results"))
    ordered = positions(calls.join(levels(calls), KEY, "left"))
    both = ordered.join(results, KEY, "full")
    both = both.withColumn("_arguments", F.col("arguments"))
    errors = F.when(F.col("n_calls").isNotNull(), schema_errors(F.col("_arguments"), F.col("tool"), schemas)).otherwise(F.array().cast("array<string>"))
    both = both.withColumn("errors", errors)
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("level").isNull(), "cyclic").when(F.size("errors") > 0, "invalid").when(F.col("n_results").isNull(), "pending").otherwise("ok")
    canonical = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null"))  # a variant holds its keys sorted
    text = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.array(c))).substr(F.lit(2), F.length(F.to_json(F.to_variant_object(F.array(c)))) - 2), F.lit("null"))
    message = F.concat(F.lit('{"arguments":'), canonical, F.lit(',"id":'), text(F.col("call_id")), F.lit(',"result":'), text(F.col("result.content")), F.lit(',"tool":'), text(F.col("tool")), F.lit("}"))
    return both.select(*KEY, "turn", F.col("result.turn").alias("result_turn"), "tool", "level", "position", status.alias("status"), "errors", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), message.alias("message"))


#: The tools that ``calls_of`` finds in conversations.
SCHEMAS = {
    "ask": {"text": ("string", True), "words": ("integer", True)},
    "rewrite": {"text": ("string", True), "words": ("integer", True), "keep": ("boolean", False)},
}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read from conversation turns.

    A user's turn is a call: "rewrite" if it has a line break, "translate", which is no known tool, if it is a question, else "ask";
    it needs the call two turns before. Turns of more than 40 words give their number as text, and empty ones none, against the schema;
    in every eleventh conversation the first two calls need each other. An assistant's turn is the result of the turn before it.
    """
    turn = F.col("turn")
    lines, question = F.col("text").contains("\n"), F.col("text").endswith("?")
    n_words = F.size(F.split("text", " "))
    words = F.when(n_words > 40, F.to_json(F.struct(n_words.cast("string").alias("words"), "text"))).when(F.length("text") == 0, F.to_json(F.struct("text"))).otherwise(F.to_json(F.struct(n_words.alias("words"), "text")))
    call_id = lambda t: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    arguments = F.when(lines & (n_words <= 40), F.to_json(F.struct(n_words.alias("words"), "text", (turn % 2 == 0).alias("keep")))).otherwise(words)
    needs = F.when((F.col("conv_id") % 11 == 0) & (turn < 2), F.array(call_id(turn - 2), call_id(turn + 2))).otherwise(F.array(call_id(turn - 2)))
    users = conversations.where("role = 'user'")
    calls = users.select("conv_id", call_id(turn).alias("call_id"), "turn", F.when(lines, "rewrite").when(question, "translate").otherwise("ask").alias("tool"), arguments.alias("arguments"), needs.alias("depends_on"))
    results = conversations.where("role = 'assistant'").select("conv_id", call_id(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def linked(conversations: DataFrame) -> DataFrame:
    """The user turns as calls and the assistant turns as results. Turns of other roles (system) are neither and have no row."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return link(*calls_of(rows), SCHEMAS).withColumn("errors", F.concat_ws("; ", "errors"))

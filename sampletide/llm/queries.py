"""The numbered corpus queries and, where SQL can say it, what DuckDB must find."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampletide.llm.common import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sampletide.llm.decontamination import contained_items

    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sampletide.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sampletide.llm.top_k import top_products

    return top_products(_table(spark, sf_dir, "embeddings"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sampletide.llm.warc import archived

    return archived(spark, _table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sampletide.llm.packing import packed_documents

    return packed_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sampletide.llm.language_id import languages

    return languages(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sampletide.llm.substring_dedup import removal

    return removal(_table(spark, sf_dir, "documents"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sampletide.llm.tool_calls import linked

    return linked(_table(spark, sf_dir, "conversations"))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sampletide.llm.token_binary import token_files

    return token_files(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sampletide.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of texts of which every tenth is made periodic first."""
    from sampletide.llm.periodic_runs import periodic_runs, strongest, with_planted_runs

    out = periodic_runs(with_planted_runs(_table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sampletide.llm.fill_in_middle import filled_in_middle, restored

    out = filled_in_middle(_table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


#: Action, host and path of the rules of ``op13_url_filter``.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sampletide.llm.url_filter import judged, rules_table

    return judged(_table(spark, sf_dir, "pages"), rules_table(spark, RULES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_top_k, op4_warc, op5_packing, op6_language_id, op7_substring_dedup, op8_tool_calls, op9_token_binary, op10_near_dedup, op11_periodic_runs, op12_fill_in_middle, op13_url_filter)}

_SHINGLES = """
        w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) END AS s FROM w)"""

_RULES = ", ".join(f"('{host}', '{path}', '{action}')" for action, host, path in RULES)
_FORM = "CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END"

ORACLES: dict[str, str] = {
    "op12_fill_in_middle": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS s FROM documents),
        t AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS t, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(s, i, 8) AS BIGINT)) AS h FROM d),
        c AS (SELECT *, len(t) AS n, least(h[1] % (len(t) + 1), h[2] % (len(t) + 1)) AS lo, greatest(h[1] % (len(t) + 1), h[2] % (len(t) + 1)) AS hi, {_FORM} AS form FROM t),
        p AS (SELECT *, array_to_string(t[1:lo], '') AS prefix, array_to_string(t[lo + 1:hi], '') AS middle, array_to_string(t[hi + 1:n], '') AS suffix FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN len(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(middle) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256 FROM p""",
    "op13_url_filter": f"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r(rule_host, rule_path, action) AS (VALUES {_RULES}),
        f AS (SELECT page_id, arg_max(rule_host || rule_path, len(rule_host || rule_path)) AS rule, arg_max(action, len(rule_host || rule_path)) AS action
            FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
        SELECT p.page_id AS page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id""",
    "op1_decontamination": "WITH" + _SHINGLES.format(k=5) + """,
        b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
        i AS (SELECT item_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM b WHERE len(w) > 0),
        items AS (SELECT item_id, len(s) AS n, unnest(s) AS x FROM i),
        short AS (SELECT DISTINCT len(w) AS n FROM b WHERE len(w) BETWEEN 1 AND 4),
        grams AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN s ELSE [] END) AS x FROM s JOIN w USING (doc_id) UNION
            SELECT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS x FROM w, short)
        SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, count(*) AS n_matched, count(*) / n AS containment
        FROM grams JOIN items USING (x) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n""",
    "op3_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 20""",
    "op10_near_dedup": "WITH RECURSIVE" + _SHINGLES.format(k=2) + """,
        sets AS (SELECT doc_id, len(s) AS n, s FROM s),
        items AS (SELECT doc_id, n, unnest(s) AS x FROM sets),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
            AND a.n * 100 >= 80 * b.n AND b.n * 100 >= 80 * a.n
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT doc_id, n AS n_shingles, coalesce(least(doc_id, m), doc_id) AS component_id, coalesce(least(doc_id, m), doc_id) = doc_id AS kept
        FROM sets LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id""",
    "op4_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        o AS (SELECT d, max(page_id) AS original FROM p WHERE n >= 1000 GROUP BY d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
            CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id < original THEN original END AS refers_to
        FROM p LEFT JOIN o ON p.d = o.d AND p.n >= 1000""",
    "op7_substring_dedup": """
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        starts AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
        windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM starts),
        again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
        hits AS (SELECT doc_id, list(i) AS hits FROM windows SEMI JOIN again USING (h) GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM (SELECT doc_id, unnest(hits) AS i FROM hits)),
        words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op8_tool_calls": """
        WITH RECURSIVE users AS (SELECT conv_id, turn, min(text) AS text, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY ALL),
        results AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL),
        edges AS (SELECT u.conv_id, u.turn, p.turn AS needs FROM users u LEFT JOIN users p
            ON u.conv_id = p.conv_id AND p.turn = CASE WHEN u.conv_id % 11 = 0 AND u.turn < 2 THEN u.turn + 2 ELSE u.turn - 2 END),
        levels AS (SELECT conv_id, turn, 0 AS level FROM edges WHERE needs IS NULL
            UNION ALL SELECT e.conv_id, e.turn, l.level + 1 FROM levels l JOIN edges e ON e.conv_id = l.conv_id AND e.needs = l.turn),
        calls AS (SELECT u.*, level, 'call-' || u.conv_id || '-' || u.turn AS call_id, contains(text, chr(10)) AS lines,
            CASE WHEN contains(text, chr(10)) THEN 'rewrite' WHEN ends_with(text, '?') THEN 'translate' ELSE 'ask' END AS tool,
            len(string_split(text, ' ')) AS words FROM users u LEFT JOIN levels l ON u.conv_id = l.conv_id AND u.turn = l.turn),
        checked AS (SELECT *, CASE WHEN tool = 'translate' THEN 'unknown tool' WHEN words > 40 THEN 'words is not integer' WHEN text = '' THEN 'words is missing' ELSE '' END AS errors,
            '{' || CASE WHEN lines AND words <= 40 THEN '"keep":' || (turn % 2 = 0) || ',' ELSE '' END || '"text":' || to_json(text)
            || CASE WHEN words > 40 THEN ',"words":"' || words || '"' WHEN text = '' THEN '' ELSE ',"words":' || words END || '}' AS arguments FROM calls),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, turn, call_id) - 1 AS position FROM checked)
        SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, 'call-' || r.conv_id || '-' || r.turn) AS call_id,
            c.turn AS turn, r.turn + 1 AS result_turn, tool, level, position,
            CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN level IS NULL THEN 'cyclic' WHEN errors <> '' THEN 'invalid' WHEN r.n IS NULL THEN 'pending' ELSE 'ok' END AS status,
            coalesce(errors, '') AS errors, coalesce(c.n, 0) AS n_calls, coalesce(r.n, 0) AS n_results,
            '{"arguments":' || coalesce(arguments, 'null') || ',"id":"call-' || coalesce(c.conv_id, r.conv_id) || '-' || coalesce(c.turn, r.turn)
            || '","result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || ',"tool":' || coalesce('"' || tool || '"', 'null') || '}' AS message
        FROM placed c FULL JOIN results r ON c.conv_id = r.conv_id AND c.turn = r.turn""",
}

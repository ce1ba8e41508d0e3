"""Toxicity, top-k, WARC, tool calls and the pipeline on small fixtures."""

import hashlib
import json
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from sampletide.llm import common, language_id, near_dedup, substring_dedup, tool_calls, top_k, toxicity, warc
from sampletide.llm.common import shared_dir
from sampletide.llm.queries import ORACLES, QUERIES

from . import test_documents as brute


def test_toxicity_held_out(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    bad = ["zurk", "vexl", "qomp"]
    rows, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, None, int(toxic)))
    rows += [(1500, None), (1501, ""), (None, "zurk vexl qomp")]
    labels += [(3, 1, 0), (None, 1, 1), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, given).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    held = out[out.held_out & (out.doc_id < 1500)]
    assert ((held.doc_id % 8 == 0) == (held.predicted == 1)).mean() > 0.97
    assert out[out.doc_id.isin([1500, 1501])].predicted.sum() == 0
    none = toxicity.toxicity(docs, given.where("false")).toPandas()
    assert (none.score == 0).all()
    assert toxicity.toxicity(docs.where("false"), given).count() == 0


CASES = {
    "marks": (["what!!!", "no?!?"], ["what!!", "a ! ! !"]),
    "shouting": (["STOP DOING THAT now", "x LOUD, LOUDER - LOUDEST!"], ["STOP DOING it THAT", "NASA and UNESCO"]),
    "aimed": (["You are a total IDIOT", "she is such a big loser", "he re scum", "you are losers"], ["you are kind", "the idiot", "you are an old and very dull idiot"]),
    "masked": (["what the f**k", "sh@#t"], ["a*b", "5**6", "f** k"]),
    "hateful": (["I hate you", "Get rid of them!", "DESTROY all"], ["I hate it", "get rid of it"]),
}


@pytest.mark.parametrize("name", sorted(toxicity.PATTERNS))
def test_patterns_vote(spark, name):
    yes, no = CASES[name]
    given = spark.createDataFrame([(t,) for t in [*yes, *no, "", None]], "text string").withColumn("words", toxicity.words(F.col("text")))
    at = list(toxicity.PATTERNS).index(name)
    votes = {r.text: r.votes[at] for r in toxicity.voted(given, []).collect()}
    assert all(votes[t] for t in yes) and not any(votes[t] for t in [*no, "", None])


def test_votes_by_brute_force(spark):
    rng = random.Random(9)
    vocabulary, found = ["alpha", "beta", "gamma", "delta", "hate", "you", "idiot", "are", "FINE", "é"], ["beta", "delta", "é"]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "!", "!!!", "**x"]) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", "x" * 100_000 + " beta", "beta " * 20_000]
    given = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("words", toxicity.words(F.col("text")))
    python = {k: regex.compile(p) for k, p in toxicity.PATTERNS.items()}
    for row in toxicity.voted(given, found).collect():
        text = row.text or ""
        own = set(filter(None, regex.split(r"[^\p{L}]+", text.lower())))
        said = [int(w in own) for w in found]
        assert row.votes == [*said, *(int(bool(p.search(text))) for p in python.values()), int(sum(said) >= 2), int(sum(said) >= 4)]


def test_toxicity_with_repeated_rows_and_clashing_columns(spark):
    rows = [(i, "bad zurk" if i % 4 == 0 else f"fine w{i % 9}", 5, 0.5, "x", True, 1) for i in range(400)]
    rows += rows[:10]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, posterior double, votes string, held_out boolean, toxic int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "t") for i in range(400)] + [(0, 0, "t")], "doc_id long, toxic int, text string")
    out = toxicity.toxicity(docs, labels).toPandas()
    assert len(out) == 410 and ((out.doc_id % 4 == 0) == (out.predicted == 1)).all()
    assert out.groupby("doc_id").score.nunique().max() == 1


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.2
    good = np.where(y, rng.random(20000) < 0.8, rng.random(20000) < 0.02)
    fair = np.where(y, rng.random(20000) < 0.6, rng.random(20000) < 0.05)
    other = np.where(y, rng.random(20000) < 0.7, rng.random(20000) < 0.03)
    votes = np.stack([good, fair, other, other, rng.random(20000) < 0.1], 1).astype(int)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, rates, shared = toxicity.label_model(patterns, counts, 0.2)
    assert abs(rates[0][0] - 0.8) < 0.06 and abs(rates[1][0] - 0.02) < 0.02
    assert shared[2, 3] > 0.9 and shared[0, 1] == 0 and abs(rates[0][4] - rates[1][4]) < 0.03
    assert ((post[at.ravel()] >= 0.5) == y).mean() > 0.95


def test_lexicon_by_brute_force(spark):
    rng = random.Random(21)
    common, rude = [f"w{chr(97 + i)}" for i in range(20)], ["zurk", "vexl", "qomp", "rare"]
    rows = []
    for i in range(400):
        toxic = int(i % 5 == 0)
        text = [rng.choice(common) for _ in range(rng.randint(0, 15))] + [w for w in rude[:3] if rng.random() < (0.7 if toxic else 0.03)] + (["rare"] if i in (0, 5, 10) else [])
        rows.append((toxic, list(dict.fromkeys(text)) + text[:2]))
    p = sum(t for t, _ in rows) / len(rows)
    scores = {}
    for word in {w for _, ws in rows for w in ws}:
        own = [t for t, ws in rows if word in ws]
        n, a = len(own), sum(own)
        if n >= 5 and a > n * p:
            g = a * math.log((a + 0.5) / (n * p + 0.5)) + (n - a) * math.log((n - a + 0.5) / (n - n * p + 0.5))
            if g > 12:
                scores[word] = g
    want = sorted(scores, key=lambda w: (-scores[w], w))
    sample = spark.createDataFrame(rows, "toxic int, words array<string>")
    assert toxicity.lexicon(sample, sum(t for t, _ in rows), len(rows)) == want and set(want) == set(rude[:3])
    assert toxicity.lexicon(sample, sum(t for t, _ in rows), len(rows), 2) == want[:2]


def test_label_model_by_loops():
    """EM over single rows and voters, as the docstring says it, against the one over distinct patterns."""
    rng = np.random.default_rng(0)
    y = rng.random(400) < 0.2
    vote = lambda hot, cold: np.where(y, rng.random(400) < hot, rng.random(400) < cold)
    other = vote(0.7, 0.03)
    votes = np.stack([vote(0.8, 0.02), vote(0.6, 0.05), other, other, rng.random(400) < 0.1], 1).astype(int).tolist()
    prior, m, n = 0.2, 5, len(votes)
    rate = [(sum(v[j] for v in votes) + 1) / (n + 2) for j in range(m)]
    clip = lambda x, a, b: min(max(x, a), b)
    hot = [clip(r / prior * 0.5, 0.02, 0.9) for r in rate]
    cold = [min(clip(r * 0.3, 1e-4, 0.5), h * 0.5) for r, h in zip(rate, hot, strict=True)]
    shared = [[0.0] * m for _ in range(m)]
    for step in range(25):
        post = []
        for v in votes:
            evidence = math.log(prior / (1 - prior))
            for j in range(m):
                alike = 1 + sum(shared[k][j] for k in range(m) if v[k] == v[j])
                evidence += (math.log(hot[j] / cold[j]) if v[j] else math.log((1 - hot[j]) / (1 - cold[j]))) / alike
            post.append(1 / (1 + math.exp(-clip(evidence, -30, 30))))
        total = sum(post)
        hot = [clip((sum(p * v[j] for p, v in zip(post, votes, strict=True)) + 0.5) / (total + 1), 1e-4, 1 - 1e-4) for j in range(m)]
        cold = [clip((sum((1 - p) * v[j] for p, v in zip(post, votes, strict=True)) + 0.05) / (n - total + 1), 1e-6, 1 - 1e-4) for j in range(m)]
        if step >= 10:
            for j in range(m):
                for k in range(m):
                    best = 0.0
                    for weights, mean in ((post, hot), ([1 - p for p in post], cold)):
                        cov = lambda a, b, weights=weights, mean=mean: sum(w * (v[a] - mean[a]) * (v[b] - mean[b]) for w, v in zip(weights, votes, strict=True)) / sum(weights)
                        best = max(best, cov(j, k) / math.sqrt(max(cov(j, j), 1e-9) * max(cov(k, k), 1e-9)))
                    shared[j][k] = best if j != k and best > 0.3 else 0.0
    patterns, at, counts = np.unique(np.array(votes), axis=0, return_inverse=True, return_counts=True)
    got, rates, corr = toxicity.label_model(patterns, counts, prior, rounds=25)
    assert np.allclose(got[at.ravel()], post, atol=1e-6) and np.allclose(rates, [hot, cold], atol=1e-6) and np.allclose(corr, shared, atol=1e-6)
    assert corr[2, 3] > 0.5


def exact_top(rows, k, every):
    vectors = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            w = [int(np.floor(64 * float(np.float32(x)))) for x in v]
            vectors[i] = min(vectors.get(i, w), w)
    out = set()
    for q, v in vectors.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors.items() if i != q and len(w) == len(v))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def test_top_products(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=8)).tolist()) for i in range(500)]
    rows += [(i, rows[3][1]) for i in range(500, 700)]  # one vector very often: ties
    rows += [(700, None), (720, [1.0, None] * 4), (740, [float("nan")] * 8), (760, [float("inf")] * 8), (None, rows[0][1]), (20, rows[5][1]), (780, [0.5, 0.25]), (800, [0.5, 0.75]), (820, []), (840, rows[9][1]), (840, rows[9][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(top_k, "LEAF", 8)
    for most in (8192, 40):
        got = {tuple(r) for r in top_k.top_products(table, 20, 20).collect()}
        assert got == exact_top(rows, 20, 20)
        monkeypatch.setattr(top_k, "CANDIDATES", most)
        monkeypatch.setattr(top_k, "QUERIES", 10)
    assert top_k.top_products(table.where("false")).count() == 0


def test_large_components_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-(1 << 24), 1 << 24)) * (1 if i % 2 else 1 / 64) for _ in range(3)]) for i in range(120)]
    table = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, cell int, score string")
    assert {tuple(r) for r in top_k.top_products(table, 20, 20).collect()} == exact_top(rows, 20, 20)


def test_cover_tree_covers():
    x = (100 * np.random.default_rng(1).normal(size=(900, 5))).astype(np.int64)
    tree = top_k.CoverTree(x)
    assert tree.x.dtype == float
    seen = []
    for centre, radius, begin, end, below in tree.nodes:
        own = tree.order[begin:end]
        assert np.sqrt(((x[own] - x[centre]) ** 2).sum(1)).max() <= radius + 1e-9
        if not below:
            seen += own.tolist()
    assert sorted(seen) == list(range(900))


def test_archives(spark):
    big, other = "<p>é" + "x" * 2000, "y" * 1000
    rows = [(1, "http://a/1", big, 0), (2, "http://a/2\r\nX: y", big, 0), (3, None, big, 0), (4, "u", None, 0), (5, "u", "short", 0), (6, "u", "short", 0), (7, "u", other, 0), (8, "u", other[1:], 0), (9, "u", other, 0), (None, "u", big, 0), (9, "u", other, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    want = Counter()
    last = defaultdict(int)
    for i, _, html, _ in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            last[html] = max(last[html], i)
    for i, _, html, _ in rows:
        data = (html or "").encode()
        to = last[html] if i is not None and html in last and i < last[html] else None
        want[i, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to] += 1
    assert Counter(tuple(r) for r in warc.archived(spark, pages).collect()) == want
    assert warc.archived(spark, pages.where("false")).count() == 0


def test_archives_of_long_payloads_and_clashing_columns(spark):
    long = "é" * 3_000_000
    rows = [(1, "http://a", long, "x", 1, "lot"), (2, "http://b", long, "y", 2, "lot"), (3, "http://c", long + "!", None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, refers_to int, lot string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(spark, pages).collect()}
    assert got == {1: (6_000_000, "revisit", 2), 2: (6_000_000, "response", None), 3: (6_000_001, "response", None)}


def test_tool_calls_with_long_texts_and_clashing_columns(spark):
    long = "word " * 200_000
    calls = spark.createDataFrame([(1, "a", 0, "f", json.dumps({"x": long}), [], 5, "s")], "conv_id long, call_id string, turn long, tool string, arguments string, depends_on array<string>, level int, status string")
    results = spark.createDataFrame([(1, "a", 1, long, 9, "p")], "conv_id long, call_id string, turn long, content string, n_results int, tool string")
    row = tool_calls.link(calls, results, {"f": {"x": ("string", True)}}).head()
    assert row.status == "ok" and row.level == 0 and json.loads(row.message) == {"arguments": {"x": long}, "id": "a", "result": long, "tool": "f"}
    given = spark.createDataFrame([(None, None, None, None), (1, None, "user", "x"), (1, 0, "user", None), (2, 0, None, "y")], "conv_id long, turn long, role string, text string")
    assert tool_calls.linked(given).count() == 1


def test_hot_payloads_are_broadcast(spark, monkeypatch):
    """A third of the pages hold one payload, repeated rows and null ids among them; hot and other digests agree with what sorting finds."""
    rng = random.Random(12)
    hot, kinds = "h" * 1500, [chr(97 + i) * 1200 for i in range(9)]
    rows = [(i if i % 17 else None, None, hot if i % 3 == 0 else rng.choice(kinds) if i % 3 == 1 else f"<p>{i}</p>" * 200) for i in range(300)]
    rows += rows[-20:]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h] = max(last.get(h, -1), i)
    want = Counter((i, len(h), "revisit" if i is not None and i < last[h] else "response", last[h] if i is not None and i < last[h] else None) for i, _, h in rows)
    for many in (1000, 4):
        monkeypatch.setattr(warc, "HOT", many)
        got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(spark, pages).collect())
        assert got == want


def test_archives_roll_over(spark):
    pages = spark.range(50).selectExpr("id as page_id", "concat('http://x/', id) as url", "repeat(cast(id as string), 900) as html")
    manifest = warc.write_archives(warc.resolved(pages), shared_dir(spark, "roll"), file_bytes=1000)
    assert manifest.count() > 10 and warc.read_archives(manifest).count() == 50


def test_tool_calls(spark):
    calls = [
        (1, "a", 0, "f", '{"y": 1.5, "x": "é\\n", "z": {"b": 1, "a": [2, 1]}}', []), (1, "b", 1, "f", '{"x": 3}', ["a", "gone", None]), (1, "c", 2, "f", "[1]", ["b"]), (1, "d", 3, "g", "{}", ["b", "c"]),
        (2, "p", 0, "f", '{"x": "1", "q": 2}', ["q"]), (2, "q", 1, "f", '{"x": "1"}', ["p"]), (2, "r", 2, "f", None, ["p"]), (3, "s", 5, "f", '{"x": "1"}', ["t"]), (3, "t", 9, "f", '{"x": "1"}', []), (3, "t", 10, "f", '{"x": "2"}', ["s"]), (None, "n", 0, "f", "{}", []), (4, None, 0, "f", "{}", []),
    ]
    results = [(1, "a", 4, "one"), (1, "a", 5, "two"), (1, "lost", 6, 'quote " and \\'), (3, "s", 6, None), (None, "n", 1, "x")]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, tool string, arguments string, depends_on array<string>")
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    schemas = {"f": {"x": ("string", True), "y": ("number", False), "z": ("object", False)}}
    got = {(x.conv_id, x.call_id): x for x in tool_calls.link(c, r, schemas).collect()}
    assert len(got) == 10
    assert {k: (x.level, x.position, x.status) for k, x in got.items()} == {
        (1, "a"): (0, 0, "ok"), (1, "b"): (1, 1, "invalid"), (1, "c"): (2, 2, "invalid"), (1, "d"): (3, 3, "invalid"), (2, "p"): (None, 0, "cyclic"), (2, "q"): (None, 1, "cyclic"), (2, "r"): (None, 2, "cyclic"),
        (3, "t"): (0, 0, "pending"), (3, "s"): (1, 1, "ok"), (1, "lost"): (None, None, "orphan"),
    }
    assert got[1, "a"].message == '{"arguments":{"x":"é\\n","y":1.5,"z":{"a":[2,1],"b":1}},"id":"a","result":"one","tool":"f"}'
    assert (got[1, "a"].n_results, got[3, "t"].n_calls) == (2, 2)
    assert got[1, "b"].errors == ["x is not string"] and got[1, "c"].errors == ["arguments are not a JSON object"] and got[1, "d"].errors == ["unknown tool"]
    assert got[2, "p"].errors == ["q is not known"] and json.loads(got[1, "lost"].message)["result"] == 'quote " and \\'
    assert tool_calls.link(c.where("false"), r.where("false"), schemas).count() == 0


def test_chains_of_calls_take_few_rounds(spark, monkeypatch):
    """A chain of 1000 calls, a circle with a tail, and calls that need several, one through the chain."""
    rows = [(1, f"c{i}", i, "f", '{"a.b": 1}', [f"c{i - 1}"] if i else []) for i in range(1000)]
    rows += [(2, f"r{i}", i, "f", "{}", [f"r{(i + 1) % 5}"]) for i in range(5)] + [(2, "tail", 9, "f", "{}", ["r0"]), (2, "self", 10, "f", "{}", ["self"])]
    rows += [(1, "join", 2000, "f", '{"a.b": "x"}', ["c999", "c3"]), (1, "after", 2001, "f", "{}", ["join"]), (1, "last", 2002, "f", "{}", ["after", "c0"])]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, tool string, arguments string, depends_on array<string>")
    tables, written = [], tool_calls.written
    monkeypatch.setattr(tool_calls, "written", lambda df, name: (tables.append(name), written(df, name))[1])
    out = {(r.conv_id, r.call_id): r for r in tool_calls.link(calls, spark.createDataFrame([], "conv_id long, call_id string, turn long, content string"), {"f": {"a.b": ("integer", False)}}).collect()}
    assert len(tables) < 30
    assert all(out[1, f"c{i}"].level == out[1, f"c{i}"].position == i for i in range(1000))
    assert [out[1, x].level for x in ("join", "after", "last")] == [1000, 1001, 1002]
    assert all(out[2, x].status == "cyclic" for x in ("r0", "r4", "tail", "self"))
    assert out[1, "c5"].errors == [] and out[1, "join"].errors == ["a.b is not integer"]


def test_circles_take_no_more_rounds(spark, monkeypatch):
    """Chains of 4 and a circle of 3: as many rounds as the chains alone, and one that finds none ending."""
    rows = [(c, f"c{i}", f"c{i + 1}") for c in range(50) for i in range(4)]
    tables, written = [], tool_calls.written
    monkeypatch.setattr(tool_calls, "written", lambda df, name: (tables.append(name), written(df, name))[1])
    made = lambda x: spark.createDataFrame(x, "conv_id long, call_id string, to string")
    alone = {tuple(r) for r in tool_calls.chains(made(rows)).collect()}
    n, tables[:] = len(tables), []
    circle = [(99, f"r{i}", f"r{(i + 1) % 3}") for i in range(3)]
    both = {tuple(r) for r in tool_calls.chains(made(rows + circle)).collect()}
    assert {x for x in both if x[0] < 99} == alone == {(c, f"c{i}", "c4", 4 - i) for c in range(50) for i in range(4)}
    assert {x[:3] for x in both - alone} == {(99, f"r{i}", None) for i in range(3)} and len(tables) <= n + 1
    assert tool_calls.chains(made([])).count() == 0


def test_tool_calls_run_no_python(spark, sf):
    plan = tool_calls.linked(spark.read.parquet(f"{sf}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_stages(spark, docs, sf, texts):
    """Each stage on what the one before kept, against brute force."""
    now = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns, name
        path = shared_dir(spark, "stage")
        out.write.parquet(path)
        now = spark.read.parquet(path)
        kept[name] = brute.rows_of(now)
    given = brute.rows_of(docs)
    profiles = {lang: {int(g): i for i, g in enumerate(p)} for lang, p in language_id.learn(docs).items()}
    least = brute.brute_least([(r.text, r.lang) for r in docs.collect()], profiles)

    def known(text):
        far, most = brute.brute_distances(profiles, text)
        lang = min(sorted(far), key=far.get) if far else None
        return lang is not None and far[lang] < most and 1 - far[lang] / most >= least.get((lang, min(10, max(1, len(text)).bit_length() - 1)), 0)

    assert Counter(kept["language_id"]) == Counter((i, t) for i, t in given if known(t))
    assert Counter(kept["near_dedup"]) == Counter(brute.first_of_each(kept["language_id"], 5))
    without = [(i, " ".join(w for w, gone in zip(words, cover, strict=True) if not gone) if any(cover) else t) for (i, t), (words, cover) in zip(kept["near_dedup"], brute.gone_words(kept["near_dedup"], 35), strict=True)]
    assert Counter(kept["substring_dedup"]) == Counter(without)
    items = [brute.shingles(r.text, 5) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(brute.split(r.text)) >= 5]
    holds = lambda t: any(100 * len(s & brute.shingles(t, 5)) >= 80 * len(s) for s in items)
    assert Counter(kept["decontamination"]) == Counter((i, t) for i, t in kept["substring_dedup"] if not holds(t))
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {i for i, _ in kept["decontamination"]}
    brute.check_places(packed.toPandas())


def test_runs_leave_each_others_tables(spark, docs, sf, tmp_path):
    """Lazy results of operators and of two interleaved runs are read after all were made."""
    near, gone = near_dedup.near_duplicates(docs, 2), substring_dedup.removal(docs)
    whole = corpus_pipeline.run(spark, sf)
    first, held = corpus_pipeline.STAGES[1][1](spark, docs, "by hand"), common.Tables()
    with held:
        second = corpus_pipeline.STAGES[2][1](spark, docs, sf)
    assert held.made and second.count() == docs.count() and first.count() > 0
    assert near.count() == docs.count() and gone.count() == docs.count() and whole.count() > 100
    wide = docs.withColumn("_", F.lit(1)).withColumn("__", F.lit("x"))
    assert set(substring_dedup.without_repeats(wide).columns) == set(wide.columns) and substring_dedup.without_repeats(wide).count() == docs.count()


def test_the_pipeline_of_no_documents(spark, docs, empty, sf, tmp_path):
    now = empty
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, f"{sf}/")
        assert now.count() == 0 and now.columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, now, f"{sf}/").count() == 0


def test_the_whole_pipeline(spark, sf):
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert out.doc_id.nunique() > 100
    brute.check_places(out)


def plain(value):
    """A cell in a form that Spark's and DuckDB's frames share."""
    if value is None or pd.isna(value):
        return None
    return str(int(value)) if isinstance(value, float) and value == int(value) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: Counter(tuple(map(plain, r)) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(got) == rows(want)

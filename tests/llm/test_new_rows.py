"""Runs, fill-in-middle and url rules against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampletide.llm import language_id
from sampletide.llm import periodic_runs as pr
from sampletide.llm import url_filter as uf
from sampletide.llm.fill_in_middle import Excess, filled_in_middle, indexes, restored
from sampletide.llm.queries import RULES, op11_periodic_runs
from sampletide.llm.wordhash import texts_of, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=24):
    """Every run by comparing all words p apart, smallest period first."""
    found = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 3 * p) and not any(p % q == 0 and s <= i and j + p <= s + n for (s, q), n in found.items()):
                found[i, p] = j + p - i
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, p), n in found.items())


def periodic_texts():
    rng = random.Random(11)
    out = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    for _ in range(60):
        w = [rng.choice(["a", "b", "é", "w" + str(rng.randint(0, 50))]) for _ in range(rng.randint(1, 90))]
        for _ in range(rng.randint(1, 4)):
            at, unit = rng.randint(0, len(w)), [rng.choice("xyzab") for _ in range(rng.randint(1, 14))]
            w[at:at] = (unit * 12)[: rng.randint(len(unit) * 2, len(unit) * 12)]
        out.append(" ".join(w))
    return [*out, "", None, " \t ", "a " * 500, "a b " * 300, ("line of eight words that comes again here\n" * 3), ("u " * 23), ("u " * 24), "x " * 40 + "y " * 40, "a b a b a b a a " * 30]


def test_runs_by_brute_force(spark):
    texts = periodic_texts()
    rows = pr.periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    some = 0
    for r in rows:
        words = WORD.findall(texts[r.doc_id] or "")
        want = brute_runs(words)
        assert [tuple(x) for x in r.runs] == want, texts[r.doc_id]
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
        some += len(want)
    assert len(rows) == len(texts) and some > 100


def test_stretches_need_no_narrowing():
    """The automaton alone finds the runs of whole texts; narrowing loses none."""
    for text in periodic_texts():
        words = WORD.findall(text or "")
        ids = {}
        found = pr.stretches([ids.setdefault(w, len(ids)) for w in words])
        assert sorted((s, e - s, p) for (s, p), e in found.items()) == brute_runs(words)


def test_regions_of_many_texts_are_those_of_each():
    import pyarrow as pa

    texts = periodic_texts()
    words = words_of(pa.array(texts))
    both = list(zip(*(x.tolist() for x in pr.regions(words.hash, words.doc)), strict=True))
    alone = []
    for d, text in enumerate(texts):
        w = words_of(pa.array([text]))
        alone += [(a + int(words.first[d]), b + int(words.first[d])) for a, b in zip(*(x.tolist() for x in pr.regions(w.hash, w.doc)), strict=True)]
    assert both == alone and both


def test_a_long_periodic_text_takes_few_steps(spark):
    text = "lorem ipsum " * 30_000 + "end"
    row = pr.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    assert [tuple(x) for x in row.runs] == [(0, 60_000, 2)] and row.collapsed == "lorem ipsum end"


def test_runs_of_odd_rows(spark, docs, empty):
    out = pr.periodic_runs(docs)
    assert out.count() == docs.count() and pr.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        pr.periodic_runs(docs.withColumn("runs", F.lit(1)), keep=("doc_id", "runs"))


def test_op11_by_brute_force(spark, tmp_path, docs):
    docs.unionByName(docs.where("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 1000)).write.parquet(f"{tmp_path}/documents.parquet")
    given = {(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    want = set()
    for doc_id, text in given:
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str("" if doc_id is None else doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = brute_runs(w) if n < 1000 or h % 10 == 0 else []
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        gone = {i for s, k, p in runs for i in range(s + p, s + k)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.add((doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = {(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == want and sum(x[1] > 0 for x in got) > 4


def test_excess_converts_both_ways():
    import pyarrow as pa

    texts = ["aé€𝄞b", "", "plain text", "éé", "日本語 word 日", None, "a-b"]
    data, offsets = texts_of(pa.array(texts))
    chars, units = indexes(data, offsets)
    text = "".join(t or "" for t in texts)
    places = np.arange(len(text) + 1)
    want = np.array([len(text[:i].encode()) for i in places])
    assert (chars.fine(places) == want).all() and (chars.coarse(want) == places).all()
    starts, at = [], 0
    for t in texts:
        for u in re.findall("[A-Za-z]+|[^A-Za-z]", t or ""):
            starts.append(at)
            at += len(u)
    assert (units.fine(np.arange(len(starts) + 1)) == np.array([*starts, at])).all() and (units.coarse(np.array(starts)) == np.arange(len(starts))).all()
    assert isinstance(chars, Excess) and len(chars.at) == 3 + 2 + 4  # of multibyte characters alone


def test_fill_in_middle_by_brute_force(spark, docs, empty):
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(["x<P>y", "<", "<<S", "a<M", "é<S", "日本 abc", "😀 ab 😀", "\x00a\x00", "end<", "<M"] * 8, 500)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(odd)
    out = filled_in_middle(rows)
    got = sorted(map(tuple, out.withColumn("back", restored(F.col("output"), F.col("form"))).collect()), key=str)
    want = []
    for doc_id, text in [(r.doc_id, r.text or "") for r in rows.collect()]:
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
        n = len(units)
        lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            want.append((doc_id, n, "plain", None, None, text, text))
        elif h[3] % 100 < 20:
            want.append((doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text))
        else:
            want.append((doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text))
    assert got == sorted(want, key=str) and {x[2] for x in want} == {"plain", "spm", "psm"}
    assert filled_in_middle(empty).count() == 0


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_urls_by_brute_force(spark, monkeypatch):
    rng = random.Random(13)
    hosts = [f"{a}{b}.{c}" for a in ("", "www.", "a.b.") for b in ("x", "yy", "zoo", "q-1") for c in ("net", "org", "example.net", "example.com")] + ["net", "NET", "", ".", "a..net", "é.org", "example.net:80"]
    tails = ["", "/", "/en", "/en/", "/en/1", "/de/é?x=/en/", "#/de/", "?q", "/fr/a#b", "/ß/1", "//en/"]
    urls = [f"http://{h}{t}" for h in hosts for t in tails] + [None, "", "no scheme/en/", "://net/", "a://b://net/"]
    rows = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls + urls[:50])], "page_id long, url string, key string, a string")
    for rules in (RULES, [], [("block", h, t) if rng.random() < 0.5 else ("allow", h, t) for h in ("net", "org", "x.net", "example.com", "é.org", "") for t in ("", "/", "/en", "/en/", "/ß")]):
        got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in uf.judged(rows, uf.rules_table(spark, rules)).collect()}
        assert got == {(i, *brute_verdict(u, rules)) for i, u in enumerate(urls + urls[:50])}
    assert uf.judged(rows.limit(0), uf.rules_table(spark, RULES)).count() == 0
    with pytest.raises(Exception, match="no such action"):
        uf.judged(rows, uf.rules_table(spark, [("other", "net", "/")])).count()


def test_cascades_are_exact_over_several_levels_and_shards(spark, monkeypatch):
    monkeypatch.setattr(uf, "SHARD_BYTES", 64)
    monkeypatch.setattr(uf, "LATER", 0.5)
    monkeypatch.setattr(uf, "CACHE_BYTES", 200)
    keys = spark.range(6000).select(*uf.hashed(F.concat(F.lit("k"), F.col("id").cast("string"))), "id")
    listed = keys.where("id % 3 = 0").select("a", "b")
    cascade = uf.cascade_of(listed, keys.select("a", "b"))
    assert len(cascade.levels) > 3 and cascade.levels[0].shards > 10
    part = keys.toPandas()
    assert (cascade.reader().listed(part["a"].to_numpy(), part["b"].to_numpy()) == (part["id"] % 3 == 0).to_numpy()).all()


def test_least_scores_are_half_the_median_of_all_rows(spark):
    """Far more rows than any fit would take, the median of which one row decides."""
    rows = spark.range(100_001).select(F.lit("some text").alias("text"), F.when(F.col("id") % 5 == 0, "de").otherwise("en").alias("lang"), F.lit("en").alias("lang_pred"), F.col("id").alias("score"))
    of_en = [i for i in range(100_001) if i % 5]
    got = language_id.least_scores(rows.withColumn("score", F.col("score") / 100_001))
    assert set(got) == {("en", c) for c in range(language_id.LONGEST + 1)} and set(got.values()) == {of_en[(len(of_en) - 1) // 2] / 100_001 / 2}

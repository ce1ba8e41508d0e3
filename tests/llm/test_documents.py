"""Document operators against brute force, on small fixtures with the odd cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sampletide.llm import common, decontamination, language_id, near_dedup, packing, substring_dedup, token_binary, wordhash
from sampletide.llm.decontamination import contained_items, without_items

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text, lower=False):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def shingles(text, k):
    w = split(text, True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def components_of(rows, k):
    """For each row the first row of its component; empty sets stand alone."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def first_of_each(rows, k):
    """Of each component of near copies one row: the least doc_id, nulls last; of equal ids the one that Spark's text hash puts first is not told apart here."""
    best = {}
    for i, r in enumerate(components_of(rows, k)):
        if r not in best or (rows[i][0] is None, rows[i][0] or 0) < (rows[best[r]][0] is None, rows[best[r]][0] or 0):
            best[r] = i
    return [rows[i] for i in best.values()]


def test_near_duplicates(docs, empty):
    for k in (2, 5):
        rows = rows_of(docs)
        sets, root = [shingles(t, k) for _, t in rows], components_of(rows, k)
        least = {}
        for i, r in enumerate(root):
            if rows[i][0] is not None:
                least[r] = min(least.get(r, 1 << 60), rows[i][0])
        want = Counter((rows[i][0], len(sets[i]), least[root[i]], rows[i][0] == least[root[i]]) for i in range(len(rows)))
        assert Counter(tuple(r) for r in near_dedup.near_duplicates(docs, k).collect()) == want
    assert near_dedup.near_duplicates(empty, 2).count() == 0


def test_large_clusters_are_compared_in_blocks(docs, monkeypatch):
    want = Counter(tuple(r) for r in near_dedup.near_duplicates(docs, 2).collect())
    monkeypatch.setattr(near_dedup, "MOST", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "LOT", 2)
    assert Counter(tuple(r) for r in near_dedup.near_duplicates(docs, 2).collect()) == want


def test_buckets_of_thousands(spark, capsys):
    """A bucket's large group of near copies and a chain of drifting ones, dealt over many slices, come out as by brute force."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    base, rows, chain = [rng.choice(words) for _ in range(40)], [], [rng.choice(words) for _ in range(40)]
    for i in range(2000):
        copy, chain = list(base), list(chain)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(40)] = rng.choice(words)
        chain[rng.randrange(40)] = rng.choice(words)
        rows += [(2 * i, " ".join(copy)), *([(2 * i + 1, " ".join(chain))] if i < 700 else [])]
    sets, at, root = [shingles(t, 2) for _, t in rows], {}, list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links = 0
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in at.get(g, ()))
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                links += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            at.setdefault(g, []).append(i)
    want = {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(given, 2).collect()}
    same = sum(got[i] == c for i, c in want.items()) / len(want)
    with capsys.disabled():
        print(f"\nnear_dedup: {links} links, {len(set(want.values()))} components, recall {same:.4f}")
    assert got == want


def test_no_near_pair_of_a_bucket_is_lost(monkeypatch):
    """What is left of a bucket of 300 after leaders and trees connects all that is near, whatever the limits."""
    rng = np.random.default_rng(2)
    bits = np.packbits(np.repeat(rng.random((60, 128)) < 0.5, 5, 0) ^ (rng.random((300, 128)) < 0.12), axis=1).view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None]).sum(2) <= near_dedup.FAR_BITS
    for sweeps in (4096, 20):
        monkeypatch.setattr(near_dedup, "SWEEPS", sweeps)
        for parts in (1, 7):
            known, held = near_dedup.Joined(), []
            for p in range(parts):
                own = np.arange(p, 300, parts)
                lead, radius = near_dedup.leaders(bits[own])
                for i, j in enumerate(lead.tolist()):
                    known.new(int(own[i]), int(own[j]))
                held += [(int(own[i]), int(radius[i])) for i in range(len(own)) if lead[i] == i]
            at, radius = (np.array(x) for x in zip(*held, strict=True))
            for i, j in near_dedup.joined_tree(bits[at], radius):
                known.new(int(at[i]), int(at[j]))
            assert all(known.root(i) == known.root(j) for i, j in zip(*np.nonzero(near), strict=True))


def thue_morse(steps):
    out = "a"
    for _ in range(steps):
        out += out.translate(str.maketrans("ab", "ba"))
    return out, out.translate(str.maketrans("ab", "ba"))


def test_words_that_agree_in_every_polynomial_hash_differ(spark):
    a, b = thue_morse(11)
    assert len(a) == 2048 and a != b
    rest = " ".join(f"w{i}" for i in range(34))
    given = spark.createDataFrame([(1, a + " " + rest), (2, b + " " + rest), (3, a), (4, b), (5, a.upper())], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.removal(given).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0}
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(given.where("doc_id > 2"), 2).collect()} == {3: 3, 4: 4, 5: 3}
    item = spark.createDataFrame([(1, a + " w0 w1 w2 w3")], "item_id long, text string")
    assert [r.doc_id for r in contained_items(given, item).collect()] == [1]


def test_one_row_of_each_component_stays(spark):
    words = [f"w{i}" for i in range(60)]
    text = lambda tag: " ".join(f"{tag}{w}" for w in words)
    near = lambda tag: text(tag) + " more"
    rows = [
        (1, text("repeated"), "a"), (1, text("repeated"), "b"), (2, text("nullcopy"), "c"), (None, text("nullcopy"), "d"), (None, near("nullcopy"), "e"),
        (None, text("onlynull"), "f"), (None, text("onlynull"), "g"), (None, near("onlynull"), "h"), (5, text("first"), "i"), (6, near("first"), "j"), (6, text("clean"), "k"), (7, "", "l"), (7, None, "m"),
    ]
    given = spark.createDataFrame(rows, "doc_id long, text string, key string")
    out = corpus_pipeline.near_dedup(spark, given, "")
    assert out.columns == given.columns
    want = Counter({(1, "repeated"): 1, (2, "nullcopy"): 1, (None, "onlynull"): 1, (5, "first"): 1, (6, "clean"): 1, (7, ""): 2})
    name = lambda t: (t or "").split("w0")[0]
    assert Counter((r.doc_id, name(r.text)) for r in out.collect()) == want
    assert Counter((r.doc_id, name(r.text)) for r in corpus_pipeline.substring_dedup(spark, out, "").collect()) == want
    assert corpus_pipeline.near_dedup(spark, given.where("false"), "").count() == 0


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 200, 5000):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        s = near_dedup.sketch(np.unique(x))
        assert (s != np.iinfo(np.uint64).max).all()
    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    a, b = np.unique(base[:900]), np.unique(base[100:])
    assert abs((near_dedup.sketch(a) == near_dedup.sketch(b)).mean() - 0.8) < 0.12


def gone_words(rows, window):
    words = [split(t) for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        cover = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                cover[i : i + window] = [True] * window
        out.append((w, cover))
    return out


def test_substring_removal(docs, empty):
    rows = rows_of(docs)
    want = Counter()
    for (doc_id, _), (w, cover) in zip(rows, gone_words(rows, 35), strict=True):
        kept = " ".join(x for x, c in zip(w, cover, strict=True) if not c)
        want[doc_id, len(w), sum(cover), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in substring_dedup.removal(docs).collect()) == want
    assert sum(x[2] for x in want) > 300
    assert substring_dedup.removal(empty).count() == 0


def test_substring_removal_keeps_the_other_columns(docs):
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    rows = rows_of(docs)
    texts = Counter((i, " ".join(x for x, c in zip(w, cover, strict=True) if not c) if any(cover) else t) for (i, t), (w, cover) in zip(rows, gone_words(rows, 35), strict=True))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == texts


def test_an_automaton_of_one_text_finds_its_passage_in_others(spark):
    rng = random.Random(11)
    fresh = lambda n: " ".join(f"u{rng.getrandbits(60)}" for _ in range(n))
    passage = fresh(60)
    rows = [(i, fresh(50) + "\n" + passage + "\t" + fresh(50)) for i in range(40)]
    rows += [(40, fresh(9) + " " + " ".join(passage.split()[10:50]) + " " + fresh(9)), (41, " ".join(passage.split()[:34]) + " " + fresh(9))]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = {i: sum(cover) for (i, _), (_, cover) in zip(rows, gone_words(rows, 35), strict=True)}
    marked, _ = common.written(substring_dedup.marked(substring_dedup._rows(given, ("doc_id",)), ("doc_id",), 35), "marked")
    alone, _ = common.written(substring_dedup.unequal(marked, 35), "alone")
    sent = substring_dedup.shard_rows(marked, alone, 35, np.array([], np.int64))
    passages = sent.where("not is_range")
    assert 0 < passages.count() < 20, "each passage is kept about once, whatever number of texts holds it"
    assert substring_dedup.occurrences(sent).count() == 41
    assert substring_dedup.occurrences(sent.where("is_range")).count() == 0
    for hot in (10_000, 3):
        assert {r.doc_id: r.n_removed for r in substring_dedup.removal(given, hot=hot).collect()} == want


def test_hot_anchors_are_split(spark):
    rng = random.Random(12)
    fresh = lambda n: " ".join(f"u{rng.getrandbits(60)}" for _ in range(n))
    words = fresh(400).split()
    grams = wordhash.runs(wordhash.words_of(pa.array([" ".join(words)])).hash, 8)
    least = int(grams.argmin())  # the anchor of every window that holds it
    hot_gram, around = " ".join(words[least : least + 8]), [(fresh(30), fresh(30)) for _ in range(60)]
    rows = [(i, f"{fresh(20)} {a} {hot_gram} {b} {fresh(20)}") for i, (a, b) in enumerate(around * 2)] + [(200 + i, f"{fresh(30)} {hot_gram} {fresh(30)}") for i in range(200)]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    marked, _ = common.written(substring_dedup.marked(substring_dedup._rows(given, ("doc_id",)), ("doc_id",), 35), "marked")
    alone, _ = common.written(substring_dedup.unequal(marked, 35), "alone")
    hot = substring_dedup.hot_anchors(marked, 35, 100)
    assert hot.tolist() == [int(grams[least : least + 1].view(np.int64)[0])]
    most = lambda hot: substring_dedup.shard_rows(marked, alone, 35, hot).where("is_range").groupBy("anchor").count().agg({"count": "max"}).first()[0]
    assert most(hot[:0]) > 250 and most(hot) < 30
    want = {i: sum(cover) for (i, _), (_, cover) in zip(rows, gone_words(rows, 35), strict=True)}
    assert {r.doc_id: r.n_removed for r in substring_dedup.removal(given, hot=100).collect()} == want
    assert want[0] == want[60] == 68 and want[200] == 0


def test_equal_rows_do_not_gather_their_spans(spark):
    words = [f"w{i}" for i in range(200)]
    part = " ".join(["other", *words[50:95], "end", *(f"x{i}" for i in range(40))])
    rows = [(i, t) for i, t in [(1, " ".join(words)), (None, " ".join(words[100:]))] for _ in range(300)] + [(2, part), (3, " ".join(f"y{i}" for i in range(80)))]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ids = substring_dedup._rows(given, ("doc_id",))
    assert substring_dedup.anchor_rows(ids, 35).count() < 4 * 300
    assert substring_dedup.places(ids, 35).selectExpr("max(size(places))").first()[0] <= 2 * (200 - 34)
    want = Counter((i, len(w), sum(cover)) for (i, _), (w, cover) in zip(rows, gone_words(rows, 35), strict=True))
    assert Counter(tuple(r)[:3] for r in substring_dedup.removal(given).collect()) == want
    assert want[2, 87, 45] == 1 and want[1, 200, 200] == 300


def test_contained_items(spark, docs, texts, empty):
    items = [(1, " ".join(texts[64].split()[3000:3030])), (2, "nothing like it anywhere in here at all"), (3, None), (4, "word"), (5, " ".join(texts[64].split()[:9])), (6, texts[45]), (7, "Two WORDS"), (None, "feeds  here"), (8, "a a a a"), (9, ""), (10, "no such words"), (6, texts[45]), (4, "word"), (11, " ".join(texts[3].split()[2:5]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want, long = Counter(), set()
    for doc_id, text in rows_of(docs):
        for item_id, item in items:
            n = len(split(item))
            s, have = shingles(item, 5), shingles(text, 5) if n >= 5 else {tuple(split(text, True)[i : i + n]) for i in range(len(split(text)) - n + 1)}
            if s and 100 * len(s & have) >= 80 * len(s):
                want[doc_id, item_id, len(s), len(s & have)] += 1
                long |= {doc_id} if n >= 5 else set()
    assert Counter(tuple(r)[:4] for r in contained_items(docs, benchmark).collect()) == want
    assert {4, 6, 7, 8, 11, None} <= {i for _, i, *_ in want}
    bad = long
    assert {r.doc_id for r in without_items(docs, benchmark).collect()} == {i for i, _ in rows_of(docs)} - bad
    assert contained_items(empty, benchmark).count() == 0 and contained_items(docs, benchmark.where("false")).count() == 0


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = [tuple(r) for r in token_binary.token_files(spark, docs, path).collect()]
    want, start = [], 0
    for doc_id, text in sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_binary.token_files(spark, empty, path).count() == 0


def test_hot_ids_have_several_buckets(spark):
    rows = [(7 if i % 3 else None if i % 2 else i, f"text {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    bucket, n = token_binary.placement(docs)
    got = docs.select("doc_id", bucket.alias("b")).collect()
    assert n == 5 and {r.b for r in got if r.doc_id is None} == {0} and len({r.b for r in got if r.doc_id == 7}) > 1
    place = lambda i: (i is not None, i or 0)
    assert all(place(x.doc_id) <= place(y.doc_id) for x in got for y in got if x.b < y.b)
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    bucket, n = token_binary.placement(nulls)
    assert n == 8 and nulls.select(bucket.alias("b")).distinct().count() == 4
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = token_binary.token_files(spark, docs, path).toPandas().sort_values("start")
    assert len(out) == 900 and (out.start == [0, *out.n_tokens.cumsum()[:-1]]).all() and out.doc_id.isna().sum() == 150
    assert out.doc_id.dropna().is_monotonic_increasing


def test_items_in_several_parts_and_scattered(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(3000)) for _ in range(6)]
    items = [(i, " ".join(texts[i % 6].split()[100 * i : 100 * i + 20 + i])) for i in range(24)] + [(99, " ".join(rng.choice(words) for _ in range(30)))]
    near = texts[5].split()
    scattered = " ".join(x for at in range(0, 2400, 400) for x in near[at : at + 40])  # of forty words' shingles four are new
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([*items, (100, scattered)], "item_id long, text string")
    monkeypatch.setattr(decontamination, "PART", 200)
    assert len(decontamination.item_parts(benchmark, 5)[0]) > 2
    want = {(d, i) for d, t in enumerate(texts) for i, x in [*items, (100, scattered)] if 100 * len(shingles(x, 5) & shingles(t, 5)) >= 80 * len(shingles(x, 5))}
    assert {(r.doc_id, r.item_id) for r in contained_items(docs, benchmark).collect()} == want and len(want) >= 24
    assert {r.doc_id for r in without_items(docs, benchmark).collect()} == set(range(6)) - {d for d, _ in want}


def test_recall_of_items_in_pieces(spark, capsys):
    """Items whose parts lie scattered over long documents, a part's length apart or thousands of words."""
    rng = random.Random(8)
    items, docs = [], []
    for i in range(240):
        pieces, words = rng.randint(2, 16), [f"i{i}w{j}" for j in range(rng.randint(160, 400))]
        size = -(-len(words) // pieces)
        items.append((i, " ".join(words)))
        filler = [[f"f{rng.randint(0, 9999)}" for _ in range(rng.choice([5, 50, 2500]))] for _ in range(pieces)]
        docs.append((i, " ".join(w for p in range(pieces) for w in (*words[p * size : (p + 1) * size], *filler[p]))))
    want = {i for (i, a), (_, b) in zip(items, docs, strict=True) if 100 * len(shingles(a, 5) & shingles(b, 5)) >= 80 * len(shingles(a, 5))}
    got = {(r.doc_id, r.item_id) for r in contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    with capsys.disabled():
        print(f" scattered items found: {len(got)} of {len(want)}", end="")
    assert all(a == b for a, b in got) and len(want) > 150 and len(got) >= 0.98 * len(want)


def test_damage_is_found():
    data = bytearray(token_binary.segment_bytes([1, None], [np.arange(3000, dtype="<u4") % 700, np.zeros(1, "<u4")]))
    assert [(i, len(x)) for i, x in token_binary.segment_documents(bytes(data))] == [(1, 3000), (None, 1)]
    data[-5] ^= 1
    try:
        list(token_binary.segment_documents(bytes(data)))
    except ValueError:
        return
    raise AssertionError("a damaged block was read")


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    out = packing.packed_documents(docs, path).toPandas()
    want = Counter()
    for doc_id, text in rows_of(docs):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[-1 if doc_id is None else doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    out["doc_id"] = out.doc_id.fillna(-1).astype(int)
    assert Counter(out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    check_places(out)
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 4096) + 1
    assert packing.packed_documents(empty, path).count() == 0


def check_places(out):
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 4096


def test_plans_place_every_piece():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 4097, 3000), np.full(500, 3000), np.full(1000, 1), rng.integers(1, 30, 5000), np.array([4096, 1])):
        counts = np.bincount(lengths, minlength=4097)
        plan = packing.plan(counts)
        used = np.zeros(4097, np.int64)
        for n, inside in plan:
            assert n > 0 and sum(length * each for length, each in inside) <= 4096
            for length, each in inside:
                used[length] += n * each
        assert (used == counts).all()


def test_patterns_fill_sequences_and_most_pieces():
    rng = np.random.default_rng(3)
    counts = np.bincount(np.minimum(rng.geometric(1 / 900, 30000), 4095), minlength=4097)
    rows = packing.patterns(counts, 4096, packing.SLACK)
    assert (rows.sum(1) <= 4096).all() and (rows.sum(1) >= 4096 - packing.SLACK).all() and (counts[rows[rows > 0]] > 0).all()
    left = counts.copy()
    packing.placed(rows, packing.fitted(rows, counts), left)
    assert (left >= 0).all() and left.sum() < 0.15 * counts.sum()
    assert sum(n for n, _ in packing.plan(counts)) <= 1.001 * -(-int((counts * np.arange(4097)).sum()) // 4096)


def test_fitted_repeats_are_the_least_squares_optimum():
    """On a capacity of 12 with every pattern, the gradient is 0 where a pattern is used and not negative elsewhere."""
    every = [x for n in range(1, 7) for x in itertools.combinations_with_replacement(range(1, 12), n) if sum(x) == 12]
    rows = np.array([[*x, *[0] * (6 - len(x))] for x in every])
    use = np.stack([np.bincount(row[row > 0], minlength=13) for row in rows], 1).astype(float)
    for counts in (np.random.default_rng(1).integers(0, 50, 13), np.array([0, 9, 0, 0, 0, 0, 0, 40, 0, 0, 0, 0, 0])):
        counts[[0, 12]] = 0
        x = packing.fitted(rows, counts, rounds=5000)
        gradient = use.T @ (use @ x - counts)
        assert (x >= 0).all() and gradient.min() > -0.05 and abs(gradient * x).max() < 0.05 * max(1, x.max())


def brute_distances(profiles, text):
    """The out-of-place distance to each language, and the largest there can be; none for a text without letters."""
    n = Counter()
    x = " " + " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())) + " "
    if not x.strip():
        return {}, 0
    for k in (1, 2, 3):
        n.update(x[i : i + k] for i in range(len(x) - k + 1))
    del n[" "]
    key = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    top = sorted(n, key=lambda g: (-n[g], key(g)))[:300]
    return {lang: sum(abs(i - p[key(g)]) if key(g) in p else 300 for i, g in enumerate(top)) for lang, p in profiles.items()}, 300 * len(top)


def brute_language(profiles, text):
    far, _ = brute_distances(profiles, text)
    return min(sorted(far), key=far.get) if far else "und"


def test_languages_by_brute_force(spark, docs, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    learned = language_id.learn(real.where(~language_id.held_out(4, 2)))
    profiles = {lang: {int(g): i for i, g in enumerate(p)} for lang, p in learned.items()}
    for given in (docs, real.limit(60)):
        got = language_id.identify(given, learned).collect()
        text = {r.doc_id: r.text for r in given.collect()}
        for r in got:
            if r.doc_id is not None:
                assert r.lang_pred == brute_language(profiles, text[r.doc_id])
                assert 0 <= r.score <= 1


def test_languages_held_out(spark, sf, empty):
    out = language_id.languages(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    both = out[out.held_out].merge(lang, on="doc_id")
    assert (both.lang_pred == both.lang).mean() > 0.95
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    assert language_id.languages(empty).count() == 0


def brute_least(labelled, profiles):
    """The least score of each language and length class: half the median of recognised rows."""
    scores = {}
    for text, lang in labelled:
        far, most = brute_distances(profiles, text)
        if lang is not None and far and min(sorted(far), key=far.get) == lang:
            scores.setdefault((lang, min(10, max(1, len(text)).bit_length() - 1)), []).append(1 - far[lang] / most)
    usual = {k: sorted(v)[(len(v) + 1) // 2 - 1] for k, v in scores.items()}
    out = {}
    for lang in {x for x, _ in usual}:
        for c in range(11):
            near = min((k for k in usual if k[0] == lang), key=lambda k: (abs(k[1] - c), -k[1]))
            out[lang, c] = 0.5 * usual[near]
    return out


def test_unlearned_languages_and_random_letters_go(spark, sf, tmp_path):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    odd = ["zxqj wvkq pqxz jjkw qqzx", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "qzx " * 400, "Szczebrzeszyn chrząszcz brzmi w trzcinie, a ja tu stoję i słucham. " * 30]
    given = real.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([(10**9 + i, t, None, "x", len(t)) for i, t in enumerate(odd)], "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, given, sf).collect()}
    assert not any(i >= 10**9 for i in kept)
    assert kept == {r.doc_id for r in real.where(F.col("text").rlike("[A-Za-z]")).collect()}


def test_languages_with_clashing_columns_and_long_texts(spark):
    base = {"en": "the quick brown fox and the lazy dog ", "de": "der schnelle braune Fuchs und der faule Hund "}
    rows = [(i, base[lang] * (20_000 if i == 0 else 3), lang, True, "xx", 2.0, "r", "t") for i in range(40) for lang in [("en", "de")[i % 2]]]
    rows += [rows[1], (None, base["de"], None, None, None, None, None, None), (90, None, "en", None, None, None, None, None), (91, "12 34 !", "en", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out boolean, lang_pred string, score double, _row string, _text string")
    out = language_id.languages(docs).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    assert all(r.lang_pred == ("en", "de")[r.doc_id % 2] for r in out if r.doc_id is not None and r.doc_id < 40)
    assert {r.lang_pred for r in out if r.doc_id in (90, 91)} == {"und"} and [r.lang_pred for r in out if r.doc_id is None] == ["de"]


def test_long_texts_in_steps_give_the_same_ngrams(monkeypatch):
    text = "Ein längerer Text, der in mehreren Schritten gezählt wird. " * 20
    want = language_id.grams(text)
    monkeypatch.setattr(language_id, "_CHUNK", 50)
    got = language_id.grams(text)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all()

"""Benchmark decontamination: short test items found inside documents of any length.

Items and documents are sets of distinct ``k``-word shingles (A-Z as a-z). Items are partitioned by size, the classes
doubling; for a class of up to u shingles every document is cut into overlapping windows of 2u shingles, one each u, so a
passage of u shingles lies whole in some window at most four times its size, and a MinHash value of the two agrees with a
probability of at least 0.19 at containment 0.8. Any of ``COORDS`` values in common makes a candidate (a miss has
probability 0.81 ** 48 at worst), and candidates are decided by exact shingle containment in the whole document. An item whose
shingles lie scattered is found by the window that holds the least of them under some of the hashes: a test scatters items in
up to sixteen pieces over long documents and measures the recall.

An item of one to ``k - 1`` words is one shingle of its whole sequence, and in each document that has it as consecutive words:
such items are looked up among all runs of their length. ``without_items`` doesn't remove documents for them.

Items become sets in Spark tasks and are written in parts of bounded size, which tasks read from the shared folder; the
driver sees only how many parts there are, and each is one pass over the documents. Items with equal sets are one
until they are found. Null and empty items are in no document; null texts are empty, null ids stay null, every benchmark row is an item and every
document row is searched; empty tables give no pairs; other columns pass or are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampletide.llm.common import batch_of, removed, shared_dir, slices, written
from sampletide.llm.wordhash import Words, mixed, runs, shingle_sets, words_of

COORDS = 48
#: Shingles of the items that one pass over the documents searches for (with their MinHash values about 16 MB a million); a larger benchmark
#: takes more passes.
PART = 1_000_000
_SEEDS = mixed(np.arange(7001, 7001 + COORDS, dtype=np.uint64))


class Items:
    """Some items' shingle sets, partitioned by size, with their MinHash values ready to be looked up."""

    def __init__(self, sets: list[np.ndarray], words: list[int]) -> None:
        """``words``: of an item with fewer words than a shingle has, how many; else 0."""
        self.sets = sets
        short = np.array(words, np.int64)
        sizes = np.where(short > 0, 0, np.array([len(x) for x in sets], np.int64))
        self.short = []
        for n in np.unique(short[short > 0]).tolist():
            own = np.flatnonzero(short == n)
            values = np.array([sets[i][0] for i in own], np.uint64)
            order = np.argsort(values, kind="stable")
            self.short.append((n, values[order], own[order]))
        self.classes: list[tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]] = []
        for power in range(int(sizes.max(initial=0)).bit_length() + 1):
            low, u = (1 << power) // 2, 1 << power
            own = np.flatnonzero((sizes > low) & (sizes <= u))
            if not len(own):
                continue
            bits = max(12, min(18, int(len(own) * 16).bit_length()))
            tables = []
            for seed in _SEEDS:
                values = np.array([mixed(sets[i] ^ seed).min() for i in own])
                order = np.argsort(values)
                seen = np.zeros(1 << bits, bool)
                seen[(values & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
                tables.append((seen, values[order], own[order]))
            self.classes.append((u, tables))

    def candidates(self, grams: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs; ``grams``: all texts' shingles, those of text d at first[d] to first[d + 1] - 1."""
        counts = np.diff(first)
        cuts = []  # of each class: where its blocks begin among those of the class before, the text of each, whether it is the text's last
        before, n = 1, counts
        for u, _ in self.classes:
            blocks = -(-n // (u // before))
            ends = np.cumsum(blocks)
            text = np.repeat(np.arange(len(counts)), blocks)
            begin = (np.cumsum(n) - n)[text] + (np.arange(ends[-1] if len(ends) else 0) - (ends - blocks)[text]) * (u // before)
            last = np.ones(len(text), bool)
            last[:-1] = text[1:] != text[:-1]
            cuts.append((begin, text, last))
            before, n = u, blocks
        found: set[tuple[int, int]] = set()
        for j, seed in enumerate(_SEEDS):
            least = mixed(grams ^ seed)
            for (_, tables), (begin, text, last) in zip(self.classes, cuts, strict=True):
                if not len(begin):
                    break
                least = np.minimum.reduceat(least, begin)
                window = least.copy()
                window[:-1] = np.where(last[:-1], window[:-1], np.minimum(window[:-1], window[1:]))
                seen, values, owner = tables[j]
                hit = np.flatnonzero(seen[(window & np.uint64(len(seen) - 1)).astype(np.int64)])
                if not len(hit):
                    continue
                left, right = np.searchsorted(values, window[hit], "left"), np.searchsorted(values, window[hit], "right")
                for at in np.flatnonzero(right > left).tolist():
                    found.update((int(text[hit[at]]), int(i)) for i in owner[left[at] : right[at]])
        return found

    def matches(self, words: Words, k: int, percent: int) -> list[tuple[int, int, int]]:
        """(text, item, shingles in common), where 100 * common >= percent * item."""
        every = runs(words.hash, k)
        whole = words.doc[: len(every)] == words.doc[k - 1 :] if len(every) else np.zeros(0, bool)
        grams = every[whole]
        first = np.searchsorted(words.doc[: len(every)][whole], np.arange(len(words.first)))
        out = []
        for d, i in sorted(self.candidates(grams, first)) if len(grams) and self.classes else ():
            shared = int(np.isin(self.sets[i], grams[first[d] : first[d + 1]]).sum())
            if 100 * shared >= percent * len(self.sets[i]):
                out.append((d, i, shared))
        return [*out, *sorted((d, i, 1) for d, i in self.short_matches(words))]

    def short_matches(self, words: Words) -> set[tuple[int, int]]:
        found: set[tuple[int, int]] = set()
        for n, values, owner in self.short:
            every = runs(words.hash, n)
            if not len(every):
                continue
            hit = np.flatnonzero((words.doc[: len(every)] == words.doc[n - 1 :]) & np.isin(every, values))
            pairs = np.unique(np.stack([words.doc[hit].astype(np.uint64), every[hit]]), axis=1)
            for d, value in zip(pairs[0].tolist(), pairs[1], strict=True):
                found.update((d, int(i)) for i in owner[np.searchsorted(values, value, "left") : np.searchsorted(values, value, "right")])
        return found


def item_parts(benchmark: DataFrame, k: int, shortest: int = 1) -> tuple[list[str], DataFrame]:
    """Where the distinct items of ``shortest`` words or more are written (item, set, words if less than k), in parts of about ``PART`` shingles; and which ids (item_id, item) have each."""
    schema = pa.schema([("item_id", pa.int64()), ("items", pa.binary()), ("n", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"), lower=True)
            n, sets = np.diff(words.first), shingle_sets(words, k)
            sets = [x if m >= shortest else x[:0] for x, m in zip(sets, n.tolist(), strict=True)]
            yield batch_of(schema, {"item_id": batch.column("item_id"), "items": [x.tobytes() for x in sets], "n": [len(x) for x in sets], "words": np.where(n < k, n, 0)})

    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item_id long, items binary, n long, words long").where("n > 0")
    key = F.concat(F.hex(F.xxhash64("items", "words")), F.hex(F.xxhash64("words", "items")))
    rows, at = written(rows.withColumn("item", key), "item-sets")
    ids, _ = written(rows.select("item", "item_id"), "item-ids")
    distinct = rows.groupBy("item").agg(F.any_value("items").alias("items"), F.any_value("n").alias("n"), F.any_value("words").alias("words"))
    parts = -(-(distinct.agg(F.sum("n")).head()[0] or 0) // PART)
    paths = [shared_dir(rows.sparkSession, "items") for _ in range(parts)]
    for i, path in enumerate(paths):
        distinct.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == i).drop("n").coalesce(1).write.parquet(path)
    removed(rows.sparkSession, at)
    return paths, ids


@functools.lru_cache(1)
def items_at(path: str) -> tuple[list[str], Items]:
    """Names and items of one part, kept by the Python worker for its later tasks."""
    files, root = pyarrow.fs.FileSystem.from_uri(path)
    table = pyarrow.parquet.read_table(root, filesystem=files)
    return table.column("item").to_pylist(), Items([np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()], table.column("words").to_pylist())


def contained_items(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_shingles, n_matched and containment of each item found in a document."""
    schema = pa.schema([("doc_id", pa.int64()), ("item", pa.string()), ("n_shingles", pa.int64()), ("n_matched", pa.int64()), ("containment", pa.float64())])
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kinds = "doc_id long, item string, n_shingles long, n_matched long, containment double"
    out, (parts, ids) = docs.sparkSession.createDataFrame([], kinds), item_parts(benchmark, k)
    for path in parts:

        def run(batches: Iterator[pa.RecordBatch], path=path) -> Iterator[pa.RecordBatch]:
            names, items = items_at(path)
            for batch in slices(batches, "text"):
                got = items.matches(words_of(batch.column("text"), lower=True), k, percent)
                if got:
                    doc_ids = batch.column("doc_id").to_pylist()
                    n = [len(items.sets[i]) for _, i, _ in got]
                    yield batch_of(schema, {"doc_id": [doc_ids[d] for d, _, _ in got], "item": [names[i] for _, i, _ in got], "n_shingles": n, "n_matched": [m for _, _, m in got], "containment": [m / x for (_, _, m), x in zip(got, n, strict=True)]})

        out = out.unionByName(rows.mapInArrow(run, kinds))
    return out.join(ids, "item").select("doc_id", "item_id", "n_shingles", "n_matched", "containment")


def without_items(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of ``k`` words or more."""
    text = docs.schema["text"].name
    for path in item_parts(benchmark, k, shortest=k)[0]:

        def run(batches: Iterator[pa.RecordBatch], path=path) -> Iterator[pa.RecordBatch]:
            _, items = items_at(path)
            for batch in slices(batches, text):
                bad = {d for d, _, _ in items.matches(words_of(batch.column(text), lower=True), k, percent)}
                yield batch.filter(pa.array([d not in bad for d in range(batch.num_rows)]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

"""Periodic runs of words, by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with a smallest period q (words q apart are identical) and at least max(24, 3 q)
words that no neighbouring word extends. A text's words go into a suffix automaton. Then, word by word, the path from the
state of the text so far to the root is accessed in a link-cut tree over the automaton's suffix links: it falls into
segments of states that last occurred at the same earlier end e, each of which takes the new end i as its colour. If
the longest string of a segment has ``length`` words and the distance p = i - e isn't longer, it and its earlier occurrence
are a stretch of length + p words with period p that can't begin earlier. No smaller period is possible, or the
string would have occurred later than e. Of the stretches with one begin and period the last is the run.

Only words that can belong to a run enter the automaton: each window of ``GRAM`` words of a run has an equal one q words to
its left or right in it (a run of at least max(24, 3 q) words has at least 2 q + 7). So a run lies in a stretch
covered by windows that occur again in that stretch; ``regions`` narrows stretches until that holds. It compares 64-bit hashes,
of which a collision only makes a region larger; the automaton compares the words themselves.

A text is worked on by the task that reads it, in memory proportional to its longest region; nothing is shuffled. Null and empty
texts and those without runs have an empty list and keep all their words; equal rows have equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampletide.llm.common import slices
from sampletide.llm.wordhash import mixed, runs, words_of

#: A run has at least so many words, and so many periods.
LEAST, PERIODS = 24, 3
#: Words of the windows that narrow a text down; the bound in the docstring needs 8 at most for runs of LEAST words.
GRAM = 8
RUNS = "array<struct<start: long, length: long, period: long>>"
WORD = r"[^\x20\x09-\x0D]+"


def regions(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the stretches of words that can hold runs; ``text`` says whose each word is."""
    none = np.zeros(0, np.int64)
    if len(hashes) < LEAST:
        return none, none
    grams = runs(hashes, GRAM)
    own = np.flatnonzero(text[GRAM - 1 :] == text[: len(text) - GRAM + 1])  # windows of one text
    grams, group, narrowed = grams[own], text[own].astype(np.uint64), False
    while len(own):
        key = mixed(grams + mixed(group))
        order = np.argsort(key, kind="stable")
        equal = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(own), bool)
        again[order[1:]] |= equal
        again[order[:-1]] |= equal
        kept, grams, group = own[again], grams[again], group[again]
        if not len(kept):
            break
        # a stretch of windows ends where the next one isn't kept, or the text or the earlier stretch does
        new = np.concatenate([[True], (np.diff(kept) > 1) | (group[1:] != group[:-1])])
        first = np.flatnonzero(new)
        begin, end = kept[first], np.append(kept[first[1:] - 1], kept[-1]) + GRAM
        long = end - begin >= LEAST
        number = np.cumsum(new) - 1
        stay = long[number]
        if narrowed and again.all():
            return begin, end
        narrowed = True
        own, grams, group = kept[stay], grams[stay], number[stay].astype(np.uint64)
    return none, none


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links and lengths of the states (0: the root), and the state of each prefix."""
    link, length, follow, prefixes, last = [-1], [0], [{}], [], 0
    for i, w in enumerate(words):
        now = len(link)
        length.append(i + 1)
        follow.append({})
        p = last
        while p >= 0 and w not in follow[p]:
            follow[p][w] = now
            p = link[p]
        if p < 0:
            link.append(0)
        else:
            q = follow[p][w]
            if length[p] + 1 == length[q]:
                link.append(q)
            else:
                clone = now + 1
                link += [clone, link[q]]
                length.append(length[p] + 1)
                follow.append(follow[q].copy())
                while p >= 0 and follow[p].get(w) == q:
                    follow[p][w] = clone
                    p = link[p]
                link[q] = clone
        prefixes.append(now)
        last = now
    return link, length, prefixes


def stretches(words: list[int]) -> dict[tuple[int, int], int]:
    """The ends of the runs of ``words`` by (first word, smallest period)."""
    link, length, prefixes = automaton(words)
    n = len(link)
    # splay trees of the preferred paths, deeper states to the right; number 0 is nothing, so a state's node is one more.
    # up holds the parent in a splay tree, or, negative, the node above a path's first; colour counts at a splay tree's root
    up = [0] + [-(x + 1) for x in link]
    left, right, colour, size = [0] * (n + 1), [0] * (n + 1), [-1] * (n + 1), [0, *length]
    found: dict[tuple[int, int], int] = {}
    for i, state in enumerate(prefixes):
        x, below = state + 1, 0
        while True:
            # splay x to the root of its tree
            while (p := up[x]) > 0:
                if (g := up[p]) > 0:
                    same = (left[g] == p) == (left[p] == x)
                    _rotate(p if same else x, g if same else p, up, left, right, colour)
                _rotate(x, up[x], up, left, right, colour)
            end = colour[x]
            if end >= 0:
                period, total = i - end, size[x]
                if total >= (PERIODS - 1) * period and total + period >= LEAST:
                    begin = i + 1 - total - period
                    if found.get((begin, period), 0) <= i:
                        found[begin, period] = i + 1
            # what is deeper keeps its colour in a tree of its own; the accessed path takes its place
            if deeper := right[x]:
                up[deeper], colour[deeper] = -x, end
            right[x] = below
            if below:
                up[below] = x
            below, above = x, -up[x]
            if not above:
                break
            x = above
        colour[below] = i
    return found


def _rotate(x: int, p: int, up: list[int], left: list[int], right: list[int], colour: list[int]) -> None:
    """x over its parent p, in their splay tree; the colour moves with the root."""
    g = up[p]
    if left[p] == x:
        b = left[p] = right[x]
        right[x] = p
    else:
        b = right[p] = left[x]
        left[x] = p
    if b:
        up[b] = p
    up[x], up[p] = g, x
    if g > 0:
        if left[g] == p:
            left[g] = x
        else:
            right[g] = x
    else:
        colour[x] = colour[p]


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` of every row, runs (start, length, period in words, by start and period) and collapsed: the text's words joined by one space, less those that a run holds after its first period."""
    if clash := {"runs", "collapsed"} & set(keep):
        raise ValueError(f"these columns have the names of results: {sorted(clash)}")
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = T.StructType([*rows.select(*keep).schema.fields, *T.StructType.fromDDL(f"runs {RUNS}, collapsed string").fields])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            words = words_of(batch.column("_text"))
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
            gone = np.zeros(len(words.hash), bool)
            for a, b in zip(*(x.tolist() for x in regions(words.hash, words.doc)), strict=True):
                ids: dict[bytes, int] = {}
                own = [ids.setdefault(words.data[s:e].tobytes(), len(ids)) for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)]
                d = int(words.doc[a])
                for (begin, period), end in sorted(stretches(own).items()):
                    found[d].append((a + begin - int(words.first[d]), end - begin, period))
                    gone[a + begin + period : a + end] = True
            texts = [_joined(words, x, y, gone) for x, y in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
            lists = [[dict(zip(("start", "length", "period"), x, strict=True)) for x in sorted(own)] for own in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lists, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _joined(words, a: int, b: int, gone: np.ndarray) -> bytes:  # noqa: ANN001
    at = np.arange(a, b) if not gone[a:b].any() else np.flatnonzero(~gone[a:b]) + a
    return b" ".join([words.data[s:e].tobytes() for s, e in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)])


def strongest(found: Column) -> Column:
    """The run of the greatest exact length / period; of equal ones the first of the list. Null if there is none."""
    return F.aggregate(F.slice(found, F.lit(2), F.greatest(F.size(found), F.lit(1))), F.get(found, F.lit(0)), lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, made periodic from word a on where crc32 of the id ends in 0: word i is the text's word a + (i - a) % p. Other texts stay as they are."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"))
    n = F.size("_words")
    a = F.when(n > 0, g % n).cast("int")
    p = (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_a", a).withColumn("_p", p)
    at = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    changed = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("_words"), at(i))), " ")
    return rows.withColumn("text", F.when(n > 0, changed).otherwise(F.col("text"))).drop("_words", "_a", "_p")

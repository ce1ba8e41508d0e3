"""Language identification by rank-order n-gram profiles.

A profile is the ``size`` most frequent letter n-grams (1 to 3 characters of the lower-cased text, every run of
other characters one space) in order of frequency. A document goes to the language whose profile is nearest by
out-of-place distance: the sum, over the document's profile, of how far each n-gram's rank is from its rank
there, ``size`` where it is absent. Ties go to the smaller n-gram and the smaller language name.

Null, empty and letterless texts are ``und`` with score 0; null languages teach nothing; without any labelled
row all texts are ``und``. Repeated rows count as often as they stand. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampletide.llm.common import batch_of, slices

SIZE, ORDERS = 300, 3
#: A profile holds SIZE rows; more labels than this can't be languages and are refused, not cut.
MOST_LANGUAGES = 10_000
#: The share of the usual score that a text needs, and the class of the longest texts.
SHARE, LONGEST = 0.5, 10
_CHUNK = 1 << 20
_letters = np.zeros(0, bool)


def _normal(text: str) -> np.ndarray:
    """Code points of the lower-cased letters with single spaces between runs and at both ends."""
    global _letters
    if not len(_letters):
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(codes) + 2, 32, np.int64)
    out[1:-1] = np.where(_letters[codes], codes, 32)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-grams as numbers, ascending, and their counts. A number holds 21 bits a character."""
    found = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not text:
        return found
    x = _normal(text)
    if len(x) < 2:
        return found
    for begin in range(0, len(x), _CHUNK):  # a long text in steps that bound memory
        part = x[begin : begin + _CHUNK + ORDERS - 1]
        ends, made = min(_CHUNK, len(x) - begin), []
        for n in range(1, ORDERS + 1):
            many = min(ends, len(part) - n + 1)
            if many > 0:
                value = part[:many].copy()
                for k in range(1, n):
                    value = (value << 21) | part[k : k + many]
                made.append(value)
        found = summed([found, np.unique(np.concatenate(made), return_counts=True)])
    keep = found[0] != 32
    return found[0][keep], found[1][keep]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    parts = [p for p in parts if len(p[0])]
    if len(parts) < 2:
        return parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, first the most frequent."""
    return keys[np.lexsort((keys, -counts))[:size]]


def learn(labelled: DataFrame, size: int = SIZE) -> dict[str, np.ndarray]:
    """Profiles of all rows (text, lang): languages times ``size`` numbers come to the driver."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for batch in slices(batches, "text"):
            fresh: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                fresh.setdefault(lang, []).append(grams(text))
            for lang, parts in fresh.items():
                total[lang] = summed([*([total[lang]] if lang in total else []), *parts])
        for lang, (keys, n) in total.items():
            yield batch_of(schema, {"lang": [lang] * len(keys), "gram": keys, "n": n})

    rows = labelled.where("lang is not null").select("lang", F.col("text").cast("string")).mapInArrow(run, "lang string, gram long, n long")
    rows = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    got = rows.select("lang", "rank", "gram").limit(MOST_LANGUAGES * size + 1).toArrow()
    if got.num_rows > MOST_LANGUAGES * size:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out: dict[str, np.ndarray] = {}
    langs, rank, gram = got.column("lang").to_pylist(), got.column("rank").to_numpy(), got.column("gram").to_numpy()
    order = np.argsort(rank, kind="stable")
    for i in order.tolist():
        out.setdefault(langs[i], []).append(gram[i])
    return {k: np.array(out[k], np.int64) for k in sorted(out)}


class Profiles:
    """All languages' ranks by n-gram, to compare a text with every language at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int) -> None:
        self.langs, self.size = list(profiles), size
        self.keys = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.keys) + 1, len(profiles)), -1, np.int64)  # the last row: n-grams that no profile has
        for k, grams_ in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.keys, grams_), k] = np.arange(len(grams_))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language, and 1 less the distance as a part of the largest possible."""
        own = ranked(*grams(text), self.size)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.keys, own)
        at[at < len(self.keys)] = np.where(self.keys[at[at < len(self.keys)]] == own[at < len(self.keys)], at[at < len(self.keys)], len(self.keys))
        ranks = self.ranks[at]
        distance = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(0)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (len(own) * self.size))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = SIZE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, with lang_pred and score."""
    given = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = given.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, size)
        for batch in slices(batches, "_text"):
            got = [model.predict(x) for x in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=[*keep, "lang_pred", "score"])

    return given.mapInArrow(run, schema)


def length_class(text: Column) -> Column:
    """Texts of about one length: the power of two in their characters, ``LONGEST`` at most."""
    return F.least(F.lit(LONGEST), F.floor(F.log2(F.greatest(F.length(text), F.lit(1))))).cast("int")


def least_scores(scored: DataFrame) -> dict[tuple[str, int], float]:
    """The score that a text of each language and length class needs: ``SHARE`` of the median of all labelled rows (text, lang, lang_pred, score) that are recognised.

    A class without such rows takes the nearest one's, the longer first; a language without any has no bound. A score is a whole distance over
    a profile's size, so what a median counts are few distinct numbers however many rows there are.
    """
    usual = scored.where("lang = lang_pred and text is not null").groupBy("lang", length_class(F.col("text").cast("string")).alias("_class"))
    known: dict[str, dict[int, float]] = {}
    for r in usual.agg(F.expr("percentile_disc(0.5) within group (order by score)").alias("usual")).collect():  # languages times classes
        known.setdefault(r.lang, {})[r._class] = SHARE * r.usual
    return {(lang, c): at[min(at, key=lambda x: (abs(x - c), -x))] for lang, at in known.items() for c in range(LONGEST + 1)}


def held_out(divisor: int, remainder: int) -> Column:
    """Rows kept from learning, by the CRC-32 of doc_id as text (a null id as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor == remainder


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows that aren't held out."""
    docs = docs.select("doc_id", "text", "lang", held_out(4, 2).alias("held_out"))
    return identify(docs, learn(docs.where("not held_out")), keep=("doc_id", "held_out"))

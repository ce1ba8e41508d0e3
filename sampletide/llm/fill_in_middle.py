"""Fill-in-middle transformation with cuts between units, held by a sparse exception index.

A text is cut into units, ``[A-Za-z]+`` or any other single code point. Three coordinates count a place in it: units, code
points, bytes. From one to the next only exceptions differ: a run of letters is one unit of many code points, a multibyte
character one code point of many bytes. ``Excess`` records those alone, with how much longer each is, so a place is found
by ``searchsorted`` among the exceptions, and everything between them is arithmetic.

Defined cases: a null text is an empty one, whose form is plain; a null ``doc_id`` draws as the empty text for its decimal;
equal ids draw equal numbers; a text that holds a sentinel stays plain; other columns are ignored unless they are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampletide.llm.common import slices
from sampletide.llm.wordhash import texts_of

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are changed, and of a hundred of those so many begin with the suffix.
CHANGED, SUFFIX_FIRST = 90, 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Excess:
    """Where the coarse coordinate counts 1 and the fine one more: ``at`` in the coarse one, ascending; ``before`` what lies before each, and the whole."""

    at: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, fine: np.ndarray, more: np.ndarray) -> Excess:
        """From where exceptions begin in the fine coordinate and how much more than 1 each counts there."""
        before = np.zeros(len(fine) + 1, np.int64)
        np.cumsum(more, out=before[1:])
        return cls(fine - before[:-1], before)

    def fine(self, coarse: np.ndarray) -> np.ndarray:
        return coarse + self.before[np.searchsorted(self.at, coarse)]

    def coarse(self, fine: np.ndarray) -> np.ndarray:
        """Of places that are no exception's inside."""
        return fine - self.before[np.searchsorted(self.at + self.before[:-1], fine)]


def indexes(data: np.ndarray, offsets: np.ndarray) -> tuple[Excess, Excess]:
    """Of texts that lie in ``data`` one after the other: code points to bytes, and units to code points."""

    def stretches(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 of the stretches of true, none over the edge of a text."""
        edge = np.zeros(len(inside) + 1, bool)
        edge[offsets] = True
        left, right = inside.copy(), inside.copy()
        left[1:] &= ~inside[:-1] | edge[1:-1]
        right[:-1] &= ~inside[1:] | edge[1:-1]
        return np.flatnonzero(left), np.flatnonzero(right) + 1

    begin, end = stretches((data & 0xC0) == 0x80)  # the bytes of a character after its first
    chars = Excess.of(begin - 1, end - begin)
    begin, end = stretches(_LETTER[data])
    return chars, Excess.of(chars.coarse(begin), end - begin - 1)


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four whole numbers of 32 bits that depend on ``seed`` and the id alone."""
    text = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(text, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def filled_in_middle(docs: DataFrame, seed: int = 1, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` of every row, n (units), form (plain, psm, spm), prefix_chars and middle_chars (null if plain), and output.

    Nothing is shuffled: each task takes slices of bounded size, a longer text alone.
    """
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    if clash := set(names) & set(keep):
        raise ValueError(f"these columns have the names of results: {sorted(clash)}")
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"), *[h.alias(f"_h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed))])
    kept = rows.select(*keep).schema.fields
    schema = T.StructType([*kept, *T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string").fields])
    marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            data, offsets = texts_of(batch.column("_text"))
            chars, units = indexes(data, offsets)
            first = units.coarse(chars.coarse(offsets))
            n = np.diff(first)
            h = [batch.column(f"_h{i}").to_numpy() for i in range(4)]
            cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0) + first[:-1]
            points = units.fine(cuts)
            low, high = chars.fine(points)
            begin = chars.coarse(offsets[:-1])
            whole = data.tobytes()
            form, out = [], []
            for a, p, m, b, x, y in zip(offsets[:-1].tolist(), low.tolist(), high.tolist(), offsets[1:].tolist(), h[2].tolist(), h[3].tolist(), strict=True):
                text = whole[a:b]
                if not text or x % 100 >= changed or any(mark in text for mark in marks):
                    form.append("plain")
                    out.append(text)
                elif y % 100 < suffix_first:
                    form.append("spm")
                    out.append(b"".join((marks[1], whole[m:b], marks[0], whole[a:p], marks[2], whole[p:m])))
                else:
                    form.append("psm")
                    out.append(b"".join((marks[0], whole[a:p], marks[1], whole[m:b], marks[2], whole[p:m])))
            form = pa.array(form, pa.string())
            plain = pa.compute.equal(form, "plain").to_numpy(zero_copy_only=False)
            lengths = [pa.array(x, pa.int64(), mask=plain) for x in (points[0] - begin, points[1] - points[0])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), form, *lengths, pa.array(out, pa.binary()).cast(pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. Sentinels can't arise across their edges, so the first of each is the one that was put in."""
    size = len(PREFIX)

    def parts(second: str) -> tuple[Column, Column, Column]:
        """What follows the first mark, the ``second`` and the one before the middle."""
        at = F.instr(output, second)
        last = at + F.instr(F.substring(output, at, F.length(output)), MIDDLE) - 1
        return F.substring(output, size + 1, at - size - 1), F.substring(output, at + size, last - at - size), F.substring(output, last + size, F.length(output))

    prefix, suffix, middle = parts(SUFFIX)
    suffix2, prefix2, middle2 = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)

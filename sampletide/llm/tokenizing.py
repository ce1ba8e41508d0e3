"""Token ids of whole texts by the tokenizers library, each distinct word encoded once a task.

Both vocabularies used here split a text before they look anything up, and never across the edge between
a non-space and the white space before or after it. So a text's ids are those of its words in order; a word is
a maximal run without white space, with the one space before it where the vocabulary keeps that.

Nor do they look up letters together with punctuation: a new word of Latin letters and punctuation behind them is encoded
as these two parts, each by the library's model alone and once a task; a vocabulary without upper case gets its letters in
lower case. All other new words pass through the whole tokenizer. The ids are those of the library's ``encode`` without added special
tokens; where a text itself holds the text of a special token, that is the token's id.
"""

from __future__ import annotations

import functools
import itertools
import re
from array import array

import numpy as np

#: Python counts these as white space or the vocabularies' patterns do, but not both: such texts are encoded whole. So are texts with NUL, a mark below.
_ODD = "\0\x1c\x1d\x1e\x1f\x85\u180e\u200b\ufeff"
#: Texts with other white space than single spaces and line feeds between words are cut by a pattern.
_OTHER = ["  ", "\n\n", " \n", "\n ", *"\t\r\x0b\x0c\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
#: A private character that parts words whose vocabulary drops white space.
_MARK = "\ue000"
_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Letters up to U+017F that composition leaves as they are and whose lower case is one letter, then ASCII punctuation.
_PARTS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([!-/:-@\\[-`{-~]*)")


def _byte_letters() -> dict[int, int]:
    """The characters that stand for bytes in both vocabularies: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


_BYTE_LETTERS = _byte_letters()


def _cut(text: str) -> list[str]:
    """Pieces of a text whose white space has ids: " word" as word, what has no space before it with NUL in front."""
    if any(x in text for x in _OTHER) or text[0] in " \n" or text[-1] in " \n":
        return [p[1:] if p[0] == " " and not p[1:2].isspace() and len(p) > 1 else "\0" + p for p in _PIECES.findall(text)]
    return ("\0" + text.replace("\n", " \0\n \0")).split(" ")


class _Numbers(dict):
    """Numbers words from 0 on as they are asked for; ``new`` lists those without ids so far."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Encodes lists of texts. ``keeps_space``: white space has ids too (byte-level); else it is dropped.

    ``most_words`` and ``most_parts`` bound what is remembered; beyond them the memory starts anew, which alters no ids.
    """

    def __init__(self, path: str, keeps_space: bool, most_words: int = 700_000, most_parts: int = 500_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        # texts that hold a special token's text are encoded whole, with its id; nothing else is to be taken for one
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.odd = [*_ODD, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.keeps_space, self.most_words, self.most_parts = keeps_space, most_words, most_parts
        self.model, self.parts = self.tokenizer.model, {}
        self.between = "\n" if keeps_space else f" {_MARK} "
        self.mark = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        """Drop the words that were met in one batch only; all of them if that leaves too many."""
        words = [w for w, again in zip(self.numbers, self.again.tolist(), strict=False) if again] if hasattr(self, "numbers") else []
        self.numbers = _Numbers()
        self.ids, self.n_ids = np.zeros(1 << 16, np.int32), 0
        self.ends, self.n_words = np.zeros(1 << 16, np.int64), 0
        self.again = np.zeros(1 << 16, bool)
        if 2 * len(words) <= self.most_words:
            for w in words:
                self.numbers[w]

    def learn(self) -> None:
        """Encode the words that have a number but no ids yet."""
        words, self.numbers.new = self.numbers.new, []
        if len(self.parts) > self.most_parts:
            self.parts.clear()
        for begin in range(0, len(words), 4096):
            part = words[begin : begin + 4096]
            flat, sizes = self._ids(part)
            ends = self.n_ids + np.cumsum(sizes)
            while ends[-1] > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while self.n_words + len(part) >= len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
                self.again = np.concatenate([self.again, np.zeros_like(self.again)])
            self.ids[self.n_ids : ends[-1]] = flat
            self.ends[self.n_words + 1 : self.n_words + 1 + len(part)] = ends
            self.n_ids, self.n_words = int(ends[-1]), self.n_words + len(part)

    def _part(self, part: str) -> bytes:
        """The ids of one part, letters or punctuation, with the space before it or without."""
        text = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_LETTERS)
        text = text.replace(" ", chr(_BYTE_LETTERS[32]))
        self.parts[part] = ids = array("i", [t.id for t in self.model.tokenize(text)]).tobytes()
        return ids

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        known, rest, found = self.parts.get, [], []
        for word in words:
            if self.keeps_space:
                before, word = ("", word[1:]) if word[:1] == "\0" else (" ", word)
            whole = _PARTS.fullmatch(word)
            if not whole:
                rest.append(len(found))
                found.append(before + word if self.keeps_space else word)
                continue
            letters, marks = whole.groups()
            letters = before + letters if self.keeps_space else letters.lower()
            ids = known(letters) or self._part(letters)
            found.append(ids + (known(marks) or self._part(marks)) if marks else ids)
        if rest:
            flat, sizes = self._whole([found[i] for i in rest])
            ends = np.cumsum(sizes).tolist()
            for i, begin, end in zip(rest, [0, *ends], ends, strict=False):
                found[i] = flat[begin:end].tobytes()
        return np.frombuffer(b"".join(found), np.int32), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_ids``, by the whole tokenizer."""
        # one text of words with a mark between them, whose ids stand apart from theirs, costs less than many texts
        clear = not any(map(str.isspace, words)) if self.keeps_space else _MARK not in "".join(words)
        if clear:
            flat = np.array(self.tokenizer.encode_batch_fast([self.between.join(words)], add_special_tokens=False)[0].ids, np.int32)
            k = len(self.mark)
            at = np.ones(max(0, len(flat) - k + 1), bool)
            for i, x in enumerate(self.mark):
                at &= flat[i : len(flat) - k + 1 + i] == x
            at = np.flatnonzero(at)
            if len(at) == len(words) - 1:
                ends = np.append(at, len(flat))
                return np.delete(flat, (at[:, None] + np.arange(k)).ravel()), ends - np.concatenate([[0], at + k])
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(words))
        return np.fromiter(itertools.chain.from_iterable(encoded), np.int32, int(sizes.sum())), sizes

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as int32; a null text has none."""
        if self.n_words > self.most_words:
            self.forget()
        cut, look, known = _cut if self.keeps_space else str.split, self.numbers.__getitem__, self.n_words
        odd = {i: text for i, text in enumerate(texts) if text and any(x in text for x in self.odd)}
        words = [cut(text) if text and i not in odd else [] for i, text in enumerate(texts)]
        n = np.fromiter(map(len, words), np.int64, len(words))
        numbers = np.fromiter(map(look, itertools.chain.from_iterable(words)), np.int64, int(n.sum()))
        self.learn()
        self.again[numbers[numbers < known]] = True
        begin = self.ends[numbers]
        sizes = self.ends[numbers + 1] - begin
        ends = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        ids = self.ids[np.repeat(begin - ends[:-1], sizes) + np.arange(ends[-1])]
        cuts = ends[np.concatenate([[0], np.cumsum(n)])].tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.tokenizer.encode_special_tokens = False
        for i, text in odd.items():
            out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        self.tokenizer.encode_special_tokens = True
        return out


@functools.lru_cache(2)
def encoder(path: str, keeps_space: bool) -> Encoder:
    """One encoder a Python worker, so that later tasks find the words of earlier ones."""
    return Encoder(path, keeps_space)

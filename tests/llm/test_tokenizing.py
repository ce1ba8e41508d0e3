import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sampletide.llm import tokenizing

PARTS = ["Word", "ÈÉ", "Zŀ", "Ärgerſ", "end.", "x%%%", "Ĳ", "µ", "º", "don", " ", "  ", "\n", "\t", "\r", "a", "B", "é", "É", "ß", "1", "23", "'s", "'re", "!", "...", "\xa0", "　", "́", "中", "😀", "İ", "\x1c", "\x85", "<|endoftext|>", "ſ", "\x00", "​", "Σ", "x", " y", "\ue000", "\ue001"]


@pytest.mark.parametrize(("name", "keeps_space"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_are_the_librarys(name, keeps_space):
    path, rng = public_tokenizers.path(name), random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["plain words, one line\nand another one", "", None]
    tokenizer = Tokenizer.from_file(path)
    own = tokenizing.Encoder(path, keeps_space, most_words=500)  # forgets often
    for begin in range(0, len(texts), 100):
        part = texts[begin : begin + 100]
        for text, ids in zip(part, own.encode(part), strict=True):
            assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_every_white_space_is_known():
    known = set(tokenizing._ODD) | set(tokenizing._OTHER) | {" ", "\n"}
    assert all(c in known for c in map(chr, range(0x110000)) if c.isspace())

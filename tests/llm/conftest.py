import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()), T.StructField("key", T.IntegerType())])


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with exact and near copies, shared passages, odd white space, empty, null and long ones."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    out = [prose(rng, rng.randint(1, 120), words) for _ in range(40)]
    passage = prose(rng, 50, words)
    out += [prose(rng, 30, words) + "\n" + passage + "  " + prose(rng, 20, words) for _ in range(6)]
    near = prose(rng, 90, words).split(" ")
    for i in range(8):
        copy = list(near)
        copy[i * 9] = "changed" + str(i)
        out.append(" ".join(copy))
    out += [out[3], out[3], out[7].upper(), passage, "", " \t\n", None, "word", "two words", "a " * 200, prose(rng, 6000, words), "line\n\n  feeds \t here", "x\x00y \x1f z", "é" * 50]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Those texts as rows, with columns that clash with names the operators use, a repeated row and a null id."""
    rows = [(i, t, ["en", "fr", None][i % 3], "s", len(t or ""), "r", i) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[3], None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)

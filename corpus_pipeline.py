"""A training corpus from ``documents``: language, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and all but the last return
the columns of ``documents``. A stage's result is lazy and reads tables of its own in the shared folder; the next stage of the same run,
called with that result written and read again, deletes them. Stages that are called one by one are one run for each ``sf_dir``,
which begins with the first stage; calls of ``run`` are runs of their own. Tables of other results stay. What each stage decides:

* language_id: letterless texts go, and documents that score less than half of what labelled ones of their language and length do.
* near_dedup: one row of each group of near duplicates (five-word shingles, 0.8) stays, that of least doc_id, nulls last.
* substring_dedup: passages of 35 words or more that start anywhere else leave the text.
* decontamination: documents that hold a benchmark item of five words or more (five-word shingles, containment 0.8) go.
* best_fit_packing: what is left becomes pieces with their places in sequences of 4096 tokens.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampletide.llm.common import Tables, small_batches, written
from sampletide.llm.decontamination import without_items
from sampletide.llm.language_id import identify, learn, least_scores, length_class
from sampletide.llm.near_dedup import without_near_duplicates
from sampletide.llm.packing import packed_documents
from sampletide.llm.substring_dedup import without_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables of the runs whose stages are called one by one.
_by_hand: dict[str, Tables] = {}


def stage(function: Stage) -> Stage:
    """The function as a stage, which deletes the tables that earlier stages of its run have left."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with Tables.current() or _by_hand.setdefault(sf_dir, Tables()) as tables:
            tables.keep_only(spark, docs)
            return function(spark, docs, sf_dir)

    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    columns, profiles = docs.columns, learn(docs.select("text", "lang"))
    found, _ = written(identify(docs.select("text", F.struct(*columns).alias("_row")), profiles, keep=("_row",)), "language-scores")  # scored once, read twice
    least = least_scores(found.select("_row.text", "_row.lang", "lang_pred", "score"))
    least = [(lang, length, score) for (lang, length), score in least.items()]  # languages times length classes
    least = spark.createDataFrame(least, "_lang string, _length int, _least double")
    same = (F.col("lang_pred") == F.col("_lang")) & (length_class(F.col("_row.text").cast("string")) == F.col("_length"))
    rows = found.where((F.col("lang_pred") != "und") & (F.col("score") > 0)).join(F.broadcast(least), same, "left")
    kept = rows.where(F.col("score") >= F.coalesce("_least", F.lit(0.0)))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs, k=5, percent=80)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [(f.__name__, f) for f in (language_id, near_dedup, substring_dedup, decontamination, best_fit_packing)]

#: Rank-order profiles and pattern packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Tables():
        for name, each in STAGES[:-1]:
            docs, _ = written(each(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)

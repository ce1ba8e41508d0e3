"""Toxicity by weak supervision.

Voters: lexicon voters found in the training labels (one a whole word), and fixed patterns of abusive
style. A generative label model estimates each voter's accuracy and propensity by EM, and from what the
votes still share given the label their correlations, which weaken voters that repeat each other. A linear
classifier (logistic regression, L1) then learns the posterior labels from words and votes, and scores all rows.

Fitting sees at most FIT_ROWS labelled rows, those of smallest hashed doc_id: the documented bound of the
training sample. Voting and scoring see every row's whole text. Null texts count as empty; null labels and
ids teach nothing; without positive or negative labels every score is the share of positives (0 if none). Repeated
label rows of a document count once (toxic if any says so). Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampletide.llm.common import written
from sampletide.llm.language_id import held_out

FIT_ROWS, FEATURES, LEXICON = 20_000, 1 << 15, 128
#: Style patterns, each a voter: shouting, repeated marks, abuse aimed at a reader, masked letters.
PATTERNS = {
    "marks": r"[!?]{3,}",
    "shouting": r"(?:\b\p{Lu}{4,}\b[^\p{L}]+){3,}",
    "aimed": r"(?i)\b(?:you|your|he|she|they) (?:are|is|re) (?:an? |such an? )?(?:\p{L}+ ){0,2}(?:idiot|loser|trash|scum)s?\b",
    "masked": r"\p{L}[*@#$]{2,}\p{L}",
    "hateful": r"(?i)\b(?:hate|kill|destroy|get rid of) (?:you|them|all)\b",
}
#: A text without any of these words can't match the pattern, which is then not tried.
NEEDED = {"aimed": ["idiot", "idiots", "loser", "losers", "trash", "trashs", "scum", "scums"], "hateful": ["hate", "kill", "destroy", "get"]}


def words(text: Column) -> Column:
    """Lower-case runs of letters; none of null text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}]+"), "")


def lexicon(sample: DataFrame, positives: int, rows: int, size: int = LEXICON) -> list[str]:
    """The words that most raise the odds of a toxic label (signed root of the G statistic), by document counts."""
    seen = sample.select("toxic", F.explode(F.array_distinct("words")).alias("word")).groupBy("word")
    seen = seen.agg(F.sum("toxic").cast("double").alias("a"), F.count("*").cast("double").alias("n")).where("n >= 5")
    p = positives / rows
    b, e = F.col("n") - F.col("a"), F.col("n") * p
    g = F.col("a") * F.log((F.col("a") + 0.5) / (e + 0.5)) + b * F.log((b + 0.5) / (F.col("n") - e + 0.5))
    top = seen.where(F.col("a") > e).withColumn("g", g).where("g > 12").orderBy(F.desc("g"), "word").limit(size)
    return [r.word for r in top.collect()]


def voted(df: DataFrame, lexicon_words: list[str]) -> DataFrame:
    """With votes, an array of 0 and 1 (abstain, toxic): a voter a word, the patterns, and two counts of lexicon words.

    The lexicon words of a text are found once, in a projection of their own, and the voters look at those few.
    """
    hits = F.array_intersect("words", F.array(*map(F.lit, lexicon_words))) if lexicon_words else F.array().cast("array<string>")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    could = {k: F.arrays_overlap("words", F.array(*map(F.lit, w))) for k, w in NEEDED.items()}
    styles = [F.when(could.get(k, F.lit(True)), text.rlike(p)).otherwise(False).cast("int") for k, p in PATTERNS.items()]
    said = [F.array_contains("hits", w).cast("int") for w in lexicon_words]
    return df.withColumn("hits", hits).withColumn("votes", F.array(*said, *styles, (F.size("hits") >= 2).cast("int"), (F.size("hits") >= 4).cast("int"))).drop("hits")


def label_model(patterns: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior P(toxic) of each vote pattern; per voter P(vote | toxic), P(vote | clean); and voters' correlations.

    ``patterns``: distinct vote rows, ``counts``: how often each stands. EM with class balance ``prior``. A voter's
    log ratio is divided by 1 plus its correlations, within classes, with the others that vote as it does on the row.
    """
    v, n = patterns.astype(float), counts.astype(float)
    m = v.shape[1]
    rate = (n @ v + 1) / (n.sum() + 2)
    hot, cold = np.clip(rate / prior * 0.5, 0.02, 0.9), np.clip(rate * 0.3, 1e-4, 0.5)
    cold = np.minimum(cold, hot * 0.5)
    shared = np.zeros((m, m))
    post = np.full(len(v), prior)
    for step in range(rounds):
        on, off = np.log(hot / cold), np.log((1 - hot) / (1 - cold))
        evidence = (v * on / (1 + v @ shared)).sum(1) + ((1 - v) * off / (1 + (1 - v) @ shared)).sum(1)
        post = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + evidence, -30, 30)))
        a, b = n * post, n * (1 - post)
        hot, cold = (a @ v + 0.5) / (a.sum() + 1), (b @ v + 0.05) / (b.sum() + 1)
        hot, cold = np.clip(hot, 1e-4, 1 - 1e-4), np.clip(cold, 1e-6, 1 - 1e-4)
        if step >= 10:
            cov = np.zeros((m, m))
            for w, mean in ((a, hot), (b, cold)):
                d = v - mean
                c = (d * w[:, None]).T @ d / max(w.sum(), 1e-9)
                s = np.sqrt(np.maximum(np.diag(c), 1e-9))
                cov = np.maximum(cov, c / s / s[:, None])
            np.fill_diagonal(cov, 0)
            shared = np.where(cov > 0.3, cov, 0)
    return post, np.stack([hot, cold]), shared


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, held_out) as doc_id, held_out, score, predicted; ``labels`` teach where not held out."""
    given = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    given = given.where(~held_out(5, 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    texts = docs.where("not held_out").select(F.col("doc_id").cast("long"), "text")
    sample, _ = written(texts.join(F.broadcast(given), "doc_id"), "fit-sample")  # FIT_ROWS rows of two numbers
    rows, positives = sample.agg(F.count("*"), F.sum("toxic")).head()
    out = docs.select(F.col("doc_id"), "held_out", "text").withColumn("words", words(F.col("text")))
    if not positives or positives == rows:
        value = F.lit(float(positives or 0) / rows if rows else 0.0)
        return out.select("doc_id", "held_out", value.alias("score"), (value >= 0.5).cast("int").alias("predicted"))
    sample = sample.withColumn("words", words(F.col("text")))
    found = lexicon(sample, positives, rows)
    sample, _ = written(voted(sample, found).select("words", "votes"), "votes")
    seen = sample.groupBy("votes").count().orderBy("votes").collect()  # FIT_ROWS rows at most
    patterns = np.array([r.votes for r in seen])
    posterior, _, _ = label_model(patterns, np.array([r["count"] for r in seen]), positives / rows)
    soft = sample.sparkSession.createDataFrame([(r.votes, float(p)) for r, p in zip(seen, posterior, strict=True)], "votes array<int>, posterior double")
    soft = sample.join(F.broadcast(soft), "votes")
    soft = soft.withColumn("class", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight")))))
    soft = soft.select("words", "votes", "class.*").where("weight > 1e-4")

    counted = HashingTF(numFeatures=FEATURES, binary=True, inputCol="words", outputCol="counted")
    joined = VectorAssembler(inputCols=["counted", "voted"], outputCol="features")
    features = lambda df: joined.transform(counted.transform(df.withColumn("voted", array_to_vector(F.col("votes").cast("array<double>")))))
    fit = LogisticRegression(weightCol="weight", regParam=0.0005, elasticNetParam=1.0, maxIter=25, standardization=True, probabilityCol="p")
    model = fit.fit(features(soft).select("features", "label", "weight"))
    scored = model.transform(features(voted(out, found)))
    scored = scored.withColumn("score", vector_to_array("p")[1])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text", held_out(5, 0).alias("held_out")), labels.select("doc_id", "toxic"))

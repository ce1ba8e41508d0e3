"""Which topics are sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Topics that belong to brokers and stream processors.
INTERNAL_TOPICS = ["^_schemas$", "^__consumer_offsets$", "^__transaction_state$", "^_confluent.*", "-KSTREAM-", "-changelog$", "^__amazon_msk.*"]


def matches(topic: Column, patterns: list[str] = (), names: list[str] = ()) -> Column:
    """A topic equals a name or holds a match of a pattern anywhere."""
    out = F.lit(False)
    for p in patterns:
        out = out | topic.rlike(p)
    return out | topic.isin(list(names)) if names else out


def split_topics(df: DataFrame, allow: Column | None = None, deny: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Allowed and denied rows. Either predicate may be given, not both; with neither all are allowed."""
    if allow is not None and deny is not None:
        raise ValueError("give either allow or deny")
    keep = F.coalesce(allow if allow is not None else ~deny if deny is not None else F.lit(True), F.lit(False))
    return df.where(keep), df.where(~keep)


def without_internal(df: DataFrame, column: str = "topic") -> DataFrame:
    return split_topics(df, deny=matches(F.col(column), INTERNAL_TOPICS))[0]


def reconcile(now: DataFrame, wanted: DataFrame, most: int = 25) -> DataFrame:
    """topic and action ("add", "remove"): the way from the topics sampled now to the first ``most`` wanted, by name."""
    first = wanted.select("topic").distinct().orderBy("topic").limit(most)
    added = first.join(now, "topic", "left_anti").select("topic", F.lit("add").alias("action"))
    gone = now.select("topic").distinct().join(first, "topic", "left_anti").select("topic", F.lit("remove").alias("action"))
    return added.unionByName(gone)

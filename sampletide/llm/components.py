"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampletide.llm.common import removed, written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Small: each node's smaller neighbours and itself go to the least of them. Large: its larger neighbours go to the least of all."""
    if not small:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = edges.join(least, "a")
    if small:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
    else:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a > b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge and leads to a node that leads nowhere."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) of every node with an edge (a, b); loops and repeats are fine.

    Rounds grow with the logarithm of the longest path; each is written to the shared folder, none is collected.
    """
    spark = edges.sparkSession
    now, at = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    rounds = 0
    while not _settled(now):
        if (rounds := rounds + 1) > most_rounds:
            raise RuntimeError("components did not settle")
        now, later = written(_star(_star(now, False), True), "edges")
        removed(spark, at)
        at = later
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

"""Connected components of a link table as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from passagework.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, for each node of ``links`` (columns a, b: long).

    Large-star and small-star rounds in turn: each hangs nodes onto the smallest neighbour, so that chains shorten by
    half and the rounds needed grow with the logarithm of the longest chain. A node's neighbours are only ever
    reduced by min(), never gathered. Each round is a written table. No links give no rows.
    """
    edges = scratch.save(
        links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{name}-0",
    )
    turn, before = 0, None
    while True:
        turn += 1
        now = scratch.save(_small_star(_large_star(edges)), f"{name}-{turn}")
        # equal sums of hashes over equal counts: the edge sets are the same
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(f"{name}-{turn - 1}")
        edges = now
        if before == (row["n"], row["h"]):
            break
        before = (row["n"], row["h"])
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

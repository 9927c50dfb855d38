"""Ranked lists combined: fusion, merging, reserves, diversity, parent context, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from passagework.functions.text import chunk_kind, tokens

RRF_K, RRF_FLOOR, PARENT_WEIGHT, SUMMARY_WEIGHT = 120, 0.009, 0.72, 0.35
MOST_FUSED, RERANK_POOL, PER_PARENT, PER_DOCUMENT = 30, 16, 2, 3


def variant_weight(index: Column) -> Column:
    """How much a query's variant counts: the first fully, others less."""
    return F.when(index == 0, 1.0).when(index == 1, 0.92).otherwise(0.85)


def weighted_rrf(lists: DataFrame, k: int = RRF_K, floor: float = RRF_FLOOR) -> DataFrame:
    """(query_id, chunk_id, score, rank) from (query_id, list_id, weight, rank, chunk_id): sums of weight / (k + rank).

    Scores under ``floor`` are dropped: by default a hit of one list of weight 1 alone. Ties: where the chunk comes
    first, by list and rank.
    """
    fused = lists.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), F.min(F.struct("list_id", F.col("rank").alias("at"))).alias("seen"))
    kept = fused.where(F.round("score", 12) >= floor)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "seen")
    return kept.withColumn("rank", F.row_number().over(order)).select("query_id", "chunk_id", "score", "rank")


def merge_first(lists: DataFrame) -> DataFrame:
    """Lists one after the other (list_id, rank), each chunk where it comes first; ranked anew."""
    first = Window.partitionBy("query_id", "chunk_id").orderBy("list_id", "rank")
    kept = lists.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    order = Window.partitionBy("query_id").orderBy("list_id", "rank")
    return kept.withColumn("_rank", F.row_number().over(order)).drop("rank").withColumnRenamed("_rank", "rank")


def reserve_summaries(fused: DataFrame, summaries: DataFrame, k: int, most: int = MOST_FUSED) -> DataFrame:
    """The best max(3, k // 2) summaries (level, then score to 9 places, both descending) before the fused list, ``most`` rows in all. Ties: the smaller chunk_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("level"), F.desc(F.round("score", 9)), "chunk_id")
    head = summaries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(3, k // 2))
    both = head.select("query_id", F.lit(0).alias("list_id"), "chunk_id", "score", "rank").unionByName(fused.select("query_id", F.lit(1).alias("list_id"), "chunk_id", "score", "rank"))
    return merge_first(both).where(F.col("rank") <= most).select("query_id", "chunk_id", "score", "rank")


def diversify(hits: DataFrame, k: int, per_document: int = PER_DOCUMENT, per_parent: int = PER_PARENT) -> DataFrame:
    """The first k hits with at most so many of a parent and of a document; what is missing is filled up by rank.

    Parents lie within documents. A null parent is one of its own. Columns: query_id, chunk_id, document_id,
    parent_id, rank; picked tells whether a hit came before the filling up.
    """
    parent = F.coalesce(F.col("parent_id").cast("string"), F.concat(F.lit("\x00"), F.col("chunk_id").cast("string")))
    of_parent = Window.partitionBy("query_id", "document_id", parent).orderBy("rank")
    of_document = Window.partitionBy("query_id", "document_id", F.col("_p") <= per_parent).orderBy("rank")
    marked = hits.withColumn("_p", F.row_number().over(of_parent)).withColumn("_d", F.row_number().over(of_document))
    marked = marked.withColumn("picked", (F.col("_p") <= per_parent) & (F.col("_d") <= per_document))
    order = Window.partitionBy("query_id").orderBy(F.desc("picked"), "rank")
    return marked.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_p", "_d", "rank").withColumnRenamed("_rank", "rank")


def expand_parents(hits: DataFrame, parents: DataFrame, prefer_parent: bool | Column = True) -> DataFrame:
    """``hits`` (chunk_id, text, node_type, parent_id) with context_text: a raw chunk's parent's text if wanted and there is one, else its own."""
    found = parents.select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("_parent_text"))
    joined = hits.join(found, "parent_id", "left")
    expanded = F.when(F.lit(prefer_parent) & (chunk_kind(F.col("node_type")) == "raw"), F.coalesce("_parent_text", "text")).otherwise(F.col("text"))
    return joined.withColumn("context_text", expanded).drop("_parent_text")


def overlap_score(query: Column, text: Column) -> Column:
    """A stand-in for a trained pair scorer: the share of the query's distinct words that the text holds."""
    asked = F.array_distinct(tokens(query))
    return F.coalesce(F.size(F.array_intersect(asked, tokens(text))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))


def rerank(hits: DataFrame, k: int, score: Column | None = None, pool: int = RERANK_POOL) -> DataFrame:
    """The first max(pool, k) hits (query, text) by a pair score, ties by old rank; k stay. ``score``: any column expression."""
    shortlist = hits.where(F.col("rank") <= max(pool, k)).withColumn("rerank_score", overlap_score(F.col("query"), F.col("text")) if score is None else score)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", 9)), "rank")
    return shortlist.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("rank").withColumnRenamed("_rank", "rank")


def needs_rerank(lists: DataFrame, gap: float = 0.1) -> DataFrame:
    """(query_id, needed) from (query_id, query, score, rank): more than one hit, and a comparison or close first scores."""
    top = lists.groupBy("query_id").agg(F.count("*").alias("n"), F.max("query").alias("query"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("one"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("two"))
    compares = F.lower("query").contains("compare") | F.lower("query").contains("difference")
    return top.select("query_id", F.coalesce((F.col("n") > 1) & (compares | (F.round(F.col("one") - F.col("two"), 9) < gap)), F.lit(False)).alias("needed"))

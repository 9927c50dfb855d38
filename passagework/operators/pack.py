"""Retrieved chunks packed into a context of limited size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from passagework.functions.queries import NEGATION
from passagework.functions.text import chunk_kind, token_estimate, tokens

# Wording, points and limits of packing.
FACT_STARTS = ["what is", "who is", "when is", "where is", "define", "list"]
SYNTHESIS = ["compare", "difference", "across", "between", "summarize", "summary", "overall", "how do", "why does"]
BY_MODE = {"doc_rag": 1500, "web_rag": 1800, "direct_web": 900}
MOST_CHUNKS, PER_DOCUMENT, PER_DOCUMENT_WEB, PER_PARENT = 10, 6, 5, 2
#: Points of raw, parent and summary chunks by what the question wants, and by mode.
BY_QUESTION = {"fact": (0.35, -0.10, -0.25), "synthesis": (0.08, 0.32, 0.20), "other": (0.0, 0.12, 0.05)}
BY_PACK_MODE = {"global": (0.0, 0.16, 0.30), "simple": (0.20, -0.12, 0.0)}
KINDS = ("raw", "parent", "summary")


def token_budget(mode: Column, shapes: Column, planned: Column | None = None) -> Column:
    """Tokens of a query's context: by plan (400 to 2200) or mode, more for equations or legal text, 400 to 2800 in all."""
    default = F.lit(BY_MODE["doc_rag"])
    for name, tokens_ in BY_MODE.items():
        default = F.when(F.lower(mode) == name, tokens_).otherwise(default)
    base = default if planned is None else F.when(planned > 0, F.greatest(F.lit(400), F.least(planned, F.lit(2200)))).otherwise(default)
    dense = F.arrays_overlap(shapes, F.array(F.lit("academic_dense"), F.lit("numbered_spec_academic")))
    grown = F.when(dense, F.floor(F.round(base * 1.35, 6))).when(F.array_contains(shapes, "legal_clause"), F.floor(F.round(base * 1.15, 6))).otherwise(base)
    return F.greatest(F.lit(400), F.least(grown, F.lit(2800))).cast("int")


def _by_kind(kind: Column, points: tuple[float, ...]) -> Column:
    out = F.lit(0.0)
    for name, value in zip(KINDS, points, strict=True):
        out = F.when(kind == name, value).otherwise(out)
    return out


def pack_score(query: Column, kind: Column, text: Column, best: Column, mode: Column) -> Column:
    """How much a chunk is worth to a query: its retrieval score, its kind's points, the words it shares, and its length."""
    q = F.trim(F.coalesce(query, F.lit("")))
    low, body = F.lower(q), F.lower(F.coalesce(text, F.lit("")))
    asked, n = F.array_distinct(tokens(q)), F.greatest(F.size(tokens(text)), F.lit(1))
    starts, joins = F.lit(False), F.lit(False)
    for p in FACT_STARTS:
        starts = starts | low.startswith(p)
    for p in SYNTHESIS:
        joins = joins | low.contains(p)
    by_question = F.when(starts, _by_kind(kind, BY_QUESTION["fact"])).when(joins, _by_kind(kind, BY_QUESTION["synthesis"])).otherwise(_by_kind(kind, BY_QUESTION["other"]))
    by_mode = F.when(mode == "global", _by_kind(kind, BY_PACK_MODE["global"])).when(mode == "simple", _by_kind(kind, BY_PACK_MODE["simple"])).otherwise(0.0)
    negation = F.when(low.rlike(NEGATION), F.when(kind == "raw", 0.08).otherwise(0.02)).otherwise(0.0)
    quoted = F.when(q.rlike("[\"']") & F.exists(asked, lambda w: (F.length(w) > 2) & body.contains(w)), 0.2).otherwise(0.0)
    shared = F.least(F.lit(1.0), F.size(F.array_intersect(asked, tokens(text))) / F.greatest(F.lit(1.0), F.sqrt(F.greatest(F.size(asked), F.lit(1))))) * 0.45
    phrase = F.when((low != "") & body.contains(low), 1.5).otherwise(0.0)
    length = F.when(starts & (kind == "raw"), F.greatest(F.lit(0.0), 0.18 - n / 2500.0)).when(~starts & joins & kind.isin("parent", "summary"), F.least(F.lit(0.22), n / 3000.0)).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.coalesce(best, F.lit(0.0))) + by_question + by_mode + negation + quoted + shared + phrase + length


def _greedy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A fold over rows that come query by query in packing order; what it holds is one query's counts."""
    query, used, taken, documents, parents = None, 0, 0, {}, {}
    for frame in frames:
        keep, rank = [], []
        for row in frame.itertuples(index=False):
            if row.query_id != query:
                query, used, taken, documents, parents = row.query_id, 0, 0, {}, {}
            fits = used + row.n_tokens <= row.budget and taken < MOST_CHUNKS
            fits = fits and documents.get(row.document_id, 0) < row.document_cap and parents.get(row.parent_key, 0) < PER_PARENT
            if fits:
                used, taken = used + row.n_tokens, taken + 1
                documents[row.document_id] = documents.get(row.document_id, 0) + 1
                parents[row.parent_key] = parents.get(row.parent_key, 0) + 1
            keep.append(fits)
            rank.append(taken)
        yield frame.assign(packed_rank=rank)[keep]


def pack_context(hits: DataFrame, mode: str = "doc_rag", max_tokens: int | None = None) -> DataFrame:
    """(query_id, chunk_id, packed_rank, score, n_tokens, kind) of the chunks that make up each query's context.

    ``hits``: query_id, query, chunk_id, document_id, parent_id, node_type, doc_shape, text, score. The best raw chunk
    comes first, then all by score, raw before others, shorter first, then chunk_id. A chunk that breaks the budget,
    a document's or a parent's cap is passed over, and later ones may still fit, so that the choice is a fold in
    order. A null parent is one of its own. Repeated chunks count once.
    """
    unique = hits.dropDuplicates(["query_id", "chunk_id"]).withColumn("kind", chunk_kind(F.col("node_type")))
    unique = unique.withColumn("pack_score", F.round(pack_score(F.col("query"), F.col("kind"), F.col("text"), F.col("score"), F.lit(mode)), 9))
    every = Window.partitionBy("query_id")
    budget = F.lit(max_tokens) if max_tokens else token_budget(F.lit(mode), F.collect_set("doc_shape").over(every))
    order = [F.desc("pack_score"), F.col("kind") != "raw", F.size(tokens(F.col("text"))), F.col("chunk_id")]
    seed = (F.col("kind") == "raw") & (F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(*order)) == 1)
    rows = unique.withColumn("budget", budget).withColumn("seed", seed).withColumn("place", F.row_number().over(every.orderBy(F.desc("seed"), *order)))
    parent = F.coalesce(F.col("parent_id").cast("string"), F.concat(F.lit("\x00"), F.col("chunk_id").cast("string")))
    flat = rows.select(
        F.col("query_id").cast("string").alias("query_id"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("document_id").cast("string").alias("document_id"), parent.alias("parent_key"),
        "kind", token_estimate(F.col("text")).alias("n_tokens"), "budget", F.lit(PER_DOCUMENT_WEB if mode == "web_rag" else PER_DOCUMENT).alias("document_cap"), F.col("pack_score").alias("score"), "place",
    )
    schema = "query_id string, chunk_id string, document_id string, parent_key string, kind string, n_tokens long, budget int, document_cap int, score double, place int, packed_rank int"
    packed = flat.repartition("query_id").sortWithinPartitions("query_id", "place").mapInPandas(_greedy, schema)
    return packed.select("query_id", "chunk_id", "packed_rank", "score", "n_tokens", "kind")

"""Conversations: topics, references, history, answers kept for a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from passagework.functions.queries import PRONOUNS

#: Seconds that an answer is kept.
KEPT_FOR = 900


def resolve_references(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, query, concept) with topic and resolved.

    topic: the last concept of earlier turns. A query with a pronoun gets the topic in brackets, if there is one.
    """
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    pronoun = F.arrays_overlap(F.split(F.lower("query"), r"\s+"), F.array(*(F.lit(p) for p in PRONOUNS)))
    topic = F.last("concept", ignorenulls=True).over(earlier)
    told = turns.withColumn("topic", topic)
    return told.withColumn("resolved", F.when(pronoun & (F.coalesce("topic", F.lit("")) != ""), F.concat("query", F.lit(" (context: "), "topic", F.lit(")"))).otherwise(F.col("query")))


def last_turns(turns: DataFrame, n: int = 5) -> DataFrame:
    """``turns`` (conv_id, turn, text) with history: the ``n`` texts before, joined by a line break."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return turns.withColumn("history", F.array_join(F.collect_list("text").over(before), "\n"))


def prior_comparison(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, display_type) with prior_format: that of the last structured answer before."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    shown = F.when((F.col("role") == "assistant") & F.col("display_type").isin("comparison_table", "pros_cons_table", "recommend_card"), F.regexp_replace("display_type", "_table$|_card$", ""))
    return turns.withColumn("prior_format", F.last(shown, ignorenulls=True).over(before))


def _hits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A fold over rows in the order (key, generation, timestamp): an answer is written at a miss and lives KEPT_FOR seconds."""
    last, written = None, 0.0
    for frame in frames:
        hit = []
        for key, generation, at in zip(frame["key"], frame["generation"], frame["timestamp"], strict=True):
            fresh = last == (key, generation) and at - written <= KEPT_FOR
            if not fresh:
                last, written = (key, generation), at
            hit.append(fresh)
        yield frame.assign(hit=hit)


def cache_hits(requests: DataFrame) -> DataFrame:
    """(request_id, key, generation, timestamp, hit) of requests: whether an answer of the same key and generation is kept.

    Rows of a key come to one task in order of time and stream through it; a task holds the last key's entry only.
    """
    rows = requests.select("request_id", F.col("key").cast("string").alias("key"), F.col("generation").cast("long").alias("generation"), F.col("timestamp").cast("double").alias("timestamp"))
    placed = rows.repartition("key").sortWithinPartitions("key", "generation", "timestamp", "request_id")
    return placed.mapInPandas(_hits, "request_id long, key string, generation long, timestamp double, hit boolean")

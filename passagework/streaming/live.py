"""The analytics that follow a log as it grows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from passagework.functions.queries import PRONOUNS
from passagework.operators.conversation import KEPT_FOR
from passagework.sources.growing import growing_lines, parsed_lines


def read_log_stream(spark: SparkSession, path: str, schema: str, start: float = 0.0) -> DataFrame:
    """JSON lines of the logs under ``path`` from ``start`` on, with ts from timestamp; lines that are added to a file later come too."""
    rows = parsed_lines(growing_lines(spark, path), schema).withColumn("timestamp", F.coalesce("timestamp", F.lit(0.0)))
    return rows.where(F.col("timestamp") >= start).withColumn("ts", F.timestamp_seconds("timestamp"))


def hourly_counts(routing: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(hour, agent, n) of a stream with ts and selected_agent; rows later than ``late`` don't count."""
    agent = F.coalesce("selected_agent", F.lit("fallback")).alias("agent")
    counted = routing.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), agent).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("hour"), "agent", "n")


def sliding_load(requests: DataFrame, late: str = "10 minutes", size: str = "60 seconds", step: str = "10 seconds") -> DataFrame:
    """(key, start, requests, tokens) of a stream with ts, key and tokens, over sliding windows."""
    counted = requests.withWatermark("ts", late).groupBy(F.window("ts", size, step), "key").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    return counted.select("key", F.col("window.start").alias("start"), "requests", "tokens")


def _topics(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    topic, rows = state.get[0] if state.exists else None, []
    for row in pd.concat(list(frames)).sort_values("turn").itertuples(index=False):
        asks = bool(topic) and any(w in PRONOUNS for w in row.query.lower().split())
        rows.append((key[0], row.turn, topic, f"{row.query} (context: {topic})" if asks else row.query))
        topic = row.concept or topic
    state.update((topic,))
    yield pd.DataFrame(rows, columns=["conv_id", "turn", "topic", "resolved"])


def topics(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, topic, resolved) of a stream (conv_id, turn, query, concept): each conversation's topic is its state.

    A conversation's new turns come in several Arrow batches in any order; they are put in order together, so that a task
    holds those of one conversation and micro-batch.
    """
    return turns.groupBy("conv_id").applyInPandasWithState(_topics, "conv_id long, turn long, topic string, resolved string", "topic string", "append", GroupStateTimeout.NoTimeout)


def _kept(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    written, rows = state.get[0] if state.exists else None, []
    for row in pd.concat(list(frames)).sort_values(["ts", "request_id"]).itertuples(index=False):
        at = row.ts.timestamp()
        hit = written is not None and 0 <= at - written <= KEPT_FOR
        written = written if hit or (written is not None and at < written) else at
        rows.append((row.request_id, key[0], key[1], hit))
    state.update((written,))
    yield pd.DataFrame(rows, columns=["request_id", "key", "generation", "hit"])
    state.setTimeoutTimestamp(max(int(written * 1000) + KEPT_FOR * 1000, state.getCurrentWatermarkMs() + 1))


def kept_answers(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(request_id, key, generation, hit) of a stream (request_id, key, generation, ts): whether an answer is still kept.

    Entries leave the state when the watermark has passed their time. A request from before the entry was written, which
    comes late, is no hit and doesn't move the entry. A key's new requests are put in order together.
    """
    grouped = requests.withWatermark("ts", late).groupBy("key", "generation")
    return grouped.applyInPandasWithState(_kept, "request_id long, key string, generation long, hit boolean", "written double", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, folder: str, mode: str = "append", settings: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote under ``folder``, which all executors share.

    A complete or update stream is written once a batch; the last batch's rows of each are returned for complete.
    ``settings`` hold for the session while the stream runs.
    """
    conf = stream.sparkSession.conf
    before = {key: conf.get(key, None) for key in settings or {}}
    for key, value in (settings or {}).items():
        conf.set(key, value)
    try:
        return _run_available(stream, folder, mode)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def _run_available(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    out = f"{folder}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda rows, i: rows.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)

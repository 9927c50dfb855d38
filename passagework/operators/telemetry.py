"""Analytics over routing decisions and agent executions.

routing: timestamp (double, seconds), query, selected_agent, confidence, reasoning, all_scores (map).
executions: timestamp, agent, duration_ms, success.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from passagework.functions.detectors import AGENTS

FALLBACK = "fallback"


def since(rows: DataFrame, start: float) -> DataFrame:
    """Rows from ``start`` on (seconds); those without a timestamp count as 0."""
    return rows.where(F.coalesce("timestamp", F.lit(0.0)) >= start)


def agent_or_fallback() -> Column:
    return F.when(F.coalesce("selected_agent", F.lit("")) == "", FALLBACK).otherwise(F.col("selected_agent"))


def floor_percentiles(rows: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(group, name, ...): the value at place int(n * p) of each group's sorted values, for each name and p of ``at``.

    Exact, without sorting or gathering a group, whatever the values: a sketch with a sure error gives two values that
    the place lies between, half a percent of the rows to each side; only the distinct values between them are ordered,
    and those below are counted. Nulls don't count. Groups of no values have no row.
    """
    held = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    bounds = [F.percentile_approx("_v", [min(1.0, max(0.0, p + side)) for p in at.values()], 10_000).alias(name) for name, side in (("_lows", -0.005), ("_highs", 0.005))]
    edges = held.groupBy(*group).agg(F.count("*").alias("_n"), *bounds)
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), F.floor(F.col("_n") * F.lit(p)).alias("place"), F.col("_lows")[i].alias("low"), F.col("_highs")[i].alias("high")) for i, (name, p) in enumerate(at.items())))
    edges = edges.select(*(F.col(g).alias(f"_e{i}") for i, g in enumerate(group)), wanted.alias("_wanted"))
    met = held.join(edges, [F.col(g).eqNullSafe(F.col(f"_e{i}")) for i, g in enumerate(group)]) if group else held.crossJoin(F.broadcast(edges))
    near = met.select(*group, "_v", F.explode("_wanted").alias("_w")).where("_v <= _w.high")
    values = near.groupBy(*group, "_w.name", "_w.place", F.when(F.col("_v") >= F.col("_w.low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    ordered = Window.partitionBy(*group, "name").orderBy(F.asc_nulls_first("_v"))  # null: all below
    found = values.withColumn("_to", F.sum("_c").over(ordered)).where("_v is not null and _to > place and _to - _c <= place")
    return found.groupBy(*group).agg(*(F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in at))


def routing_summary(routing: DataFrame) -> DataFrame:
    """One row: decisions, fallbacks and their share, and the confidences' mean, percentiles, least and greatest."""
    totals = routing.agg(
        F.count("*").alias("total_queries"), F.count_if(F.col("selected_agent").isNull()).alias("fallback_count"),
        F.round(F.avg("confidence"), 4).alias("confidence_mean"), F.round(F.min("confidence"), 4).alias("confidence_min"), F.round(F.max("confidence"), 4).alias("confidence_max"),
    )
    rate = F.coalesce(F.round(F.try_divide("fallback_count", "total_queries"), 4), F.lit(0.0))
    percentiles = floor_percentiles(routing, [], "confidence", {"confidence_p50": 0.5, "confidence_p95": 0.95})
    rounded = percentiles.select(*(F.round(c, 4).alias(c) for c in percentiles.columns))
    return totals.withColumn("fallback_rate", rate).join(F.broadcast(rounded), F.lit(True), "left")


def agent_distribution(routing: DataFrame) -> DataFrame:
    return routing.groupBy(agent_or_fallback().alias("agent")).agg(F.count("*").alias("n"))


def latency_by_agent(executions: DataFrame) -> DataFrame:
    """(agent, n, mean_ms, p50_ms, p95_ms, failures); a missing duration is 0, a missing agent unknown, a missing success true."""
    rows = executions.select(F.coalesce("agent", F.lit("unknown")).alias("agent"), F.coalesce("duration_ms", F.lit(0.0)).alias("duration_ms"), F.coalesce("success", F.lit(True)).alias("success"))
    means = rows.groupBy("agent").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 1).alias("mean_ms"), F.count_if(~F.col("success")).alias("failures"))
    percentiles = floor_percentiles(rows, ["agent"], "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    return means.join(percentiles, "agent").select("agent", "n", "mean_ms", F.round("p50_ms", 1).alias("p50_ms"), F.round("p95_ms", 1).alias("p95_ms"), "failures")


def hourly_series(routing: DataFrame, agents: list[str] | None = None) -> DataFrame:
    """(hour, a column for each agent and fallback): decisions by UTC hour; hours without any are absent."""
    hour = F.date_format(F.timestamp_seconds(F.coalesce("timestamp", F.lit(0.0))), "yyyy-MM-dd'T'HH:00")
    names = [*(agents or AGENTS), FALLBACK]
    return routing.groupBy(hour.alias("hour")).agg(*(F.count_if(agent_or_fallback() == name).alias(name) for name in names))


def confidence_histogram(routing: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, low, high, n) for all ``bins`` equal parts of 0 to 1, the last one closed."""
    width = 1.0 / bins
    counted = routing.where("confidence is not null").groupBy(F.least((F.col("confidence") / F.lit(width)).cast("int"), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    every = routing.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), F.round(F.col("id") * width, 3).alias("low"), F.round((F.col("id") + 1) * width, 3).alias("high"))
    return every.join(F.broadcast(counted), "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def error_rates(executions: DataFrame) -> DataFrame:
    """(agent, success, failure, total, error_rate)."""
    ok = F.coalesce("success", F.lit(True))
    counted = executions.groupBy(F.coalesce("agent", F.lit("unknown")).alias("agent")).agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("failure"), F.count("*").alias("total"))
    return counted.withColumn("error_rate", F.round(F.col("failure") / F.col("total"), 4))


def last_per_agent(executions: DataFrame, n: int = 500, sequence: str = "seq") -> DataFrame:
    """Each agent's last ``n`` executions by ``sequence``. Each task keeps ``n`` rows an agent before the shuffle."""
    order = Window.partitionBy("agent").orderBy(F.desc(sequence))
    return executions.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def score_heatmap(routing: DataFrame, n: int = 200, sequence: str = "seq") -> DataFrame:
    """The last ``n`` decisions with a column for each agent's score, 0 where it has none, rounded to 4 places."""
    last = routing.orderBy(F.desc(sequence)).limit(n)
    scores = [F.round(F.coalesce(F.try_element_at("all_scores", F.lit(a)), F.lit(0.0)), 4).alias(a) for a in AGENTS]
    return last.select(sequence, "timestamp", "selected_agent", "confidence", *scores)


def recent_decisions(routing: DataFrame, n: int = 50, agent: str | None = None, sequence: str = "seq") -> DataFrame:
    """The latest ``n`` decisions, of one agent if given; among equal times the earlier written first."""
    rows = routing if agent is None else routing.where(F.col("selected_agent") == agent)
    last = rows.orderBy(F.desc(F.coalesce("timestamp", F.lit(0.0))), sequence).limit(n)
    return last.select(sequence, "timestamp", F.substring("query", 1, 100).alias("query_preview"), "selected_agent", F.round(F.coalesce("confidence", F.lit(0.0)), 4).alias("confidence"), "reasoning")


def sliding_load(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """``requests`` (key, timestamp in whole seconds, tokens) with the requests and tokens of the last ``seconds`` up to each, and the day's count."""
    window = Window.partitionBy("key").orderBy("timestamp").rangeBetween(-seconds + 1, 0)
    day = Window.partitionBy("key", F.floor(F.col("timestamp") / 86400)).orderBy("timestamp").rangeBetween(Window.unboundedPreceding, 0)
    return requests.select("*", F.count("*").over(window).alias("recent_requests"), F.sum("tokens").over(window).alias("recent_tokens"), F.count("*").over(day).alias("day_requests"))

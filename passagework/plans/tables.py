"""The given tables in the shape of the library's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where the files give fewer tasks than there are; larger inputs stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows take long to work on, as texts do."""
    return spread(table(spark, sf_dir, name))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the source is the document, source and language the parent; a third of them are parents, a third summaries."""
    return as_chunks(texts(spark, sf_dir, "documents"))


def as_chunks(docs: DataFrame) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "raw").when(F.col("doc_id") % 3 == 1, "parent").otherwise("summary")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.concat("source", F.lit("/"), "lang").alias("parent_id"), kind.alias("node_type"), (F.col("doc_id") % 2).cast("int").alias("level"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("query"))


def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as routing decisions: the type is the agent, an error none, the value a confidence."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    agent = F.when(F.col("event_type") != "error", F.col("event_type"))
    confidence = F.col("value") / (F.col("value") + 50.0)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), seconds.alias("timestamp"), F.col("props").alias("query"), agent.alias("selected_agent"), confidence.alias("confidence"), F.col("event_type").alias("reasoning"),
        F.create_map(F.lit("math"), confidence, F.lit("code"), 1 - confidence).alias("all_scores"),
    )


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), seconds.alias("timestamp"), F.col("event_type").alias("agent"), F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("success"))

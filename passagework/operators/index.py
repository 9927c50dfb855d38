"""Chunk and posting tables: statistics, upserts, insertion, deletion, persistence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from passagework.functions.text import tokens


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(term, chunk_id, tf). All words of a chunk are counted where the chunk is read; only counts are shuffled."""
    words = chunks.select(F.col(id_col).alias("chunk_id"), F.explode(tokens(F.col(text_col))).alias("term"))
    return words.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def chunk_lengths(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(chunk_id, length in words); no shuffle."""
    return chunks.select(F.col(id_col).alias("chunk_id"), F.size(tokens(F.col(text_col))).cast("long").alias("length"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n chunks and their mean length."""
    return lengths.agg(F.count("*").alias("n_chunks"), F.avg("length").alias("mean_length"))


def _counted_terms(held: DataFrame) -> DataFrame:
    """(term, df, length); see statistics()."""
    rows = held.select(F.explode(F.concat(F.array_distinct("words"), F.array(F.lit(None).cast("string")))).alias("term"), "length")
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("length"))


def statistics(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((term, df), one row of n_chunks and mean_length) of (words, length), in one pass.

    A chunk counts once for each distinct word, and once for no word, which carries its length. A task sums its chunks before
    the shuffle, which then has a row for each task and term.
    """
    counted = _counted_terms(held)
    world = counted.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n_chunks"), (F.sum("length") / F.sum("df")).alias("mean_length"))
    return counted.where("term is not null").select("term", "df"), world


def kept_term_stats(held: DataFrame, folder: str) -> tuple[DataFrame, float | None]:
    """(term_stats() of (words, length), the mean length): the counts are written under ``folder``, so that the texts are read once for them."""
    spark = held.sparkSession
    counted = _counted_terms(held)
    counted.write.parquet(folder)
    counted = spark.read.schema(counted.schema).parquet(folder)
    world = counted.where("term is null").first()
    n, mean = (world["df"], world["length"] / world["df"]) if world else (0, None)
    return term_stats(counted.where("term is not null").select("term", "df"), spark.range(1).select(F.lit(n).cast("long").alias("n_chunks"))), mean


def term_stats(posting_rows: DataFrame, world: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """(term, df, idf) from postings, or from (term, df); ``world`` is corpus_stats().

    idf = ln(N - df + 0.5) - ln(df + 0.5); where negative, ``epsilon`` times the mean over all terms.
    """
    df = posting_rows if "df" in posting_rows.columns else posting_rows.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(world.select("n_chunks"))).withColumn("raw", F.expr("ln(n_chunks - df + 0.5) - ln(df + 0.5)"))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def upsert_latest(batches: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key, by ``order`` ascending; with ties, any one of the last."""
    newest = Window.partitionBy(key).orderBy(order.desc())
    return batches.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def insert_if_absent(index: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``index`` and the rows of ``new`` whose key it lacks; repeats within ``new`` stay."""
    return index.unionByName(new.join(index.select(key), key, "left_anti").select(new.columns))


def delete_document(index: DataFrame, document_id, column: str = "document_id") -> DataFrame:
    """Without a document's rows; rows of a null document stay."""
    return index.where(~F.col(column).eqNullSafe(F.lit(document_id)))


def with_parent_text(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``children`` with their parent's text, null where there is none: chunk_id of ``parents`` is parent_id of ``children``."""
    found = parents.select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"))
    return children.join(found, "parent_id", "left")


def save_index(folder: str, chunks: DataFrame) -> None:
    """Writes chunks (by kind), postings, lengths and term statistics as tables under ``folder``."""
    chunks.write.mode("overwrite").partitionBy("node_type").parquet(f"{folder}/chunks")
    spark = chunks.sparkSession
    held = spark.read.parquet(f"{folder}/chunks")
    chunk_lengths(held).write.mode("overwrite").parquet(f"{folder}/lengths")
    postings(held).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
    term_stats(spark.read.parquet(f"{folder}/postings"), corpus_stats(spark.read.parquet(f"{folder}/lengths"))).write.mode("overwrite").parquet(f"{folder}/terms")


def load_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("chunks", "postings", "lengths", "terms")}

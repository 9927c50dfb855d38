"""Golden questions, and the trained baseline that routing is held against."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from passagework.functions.text import tokens
from passagework.operators.numbering import numbered


def assign_ids(new: DataFrame, existing: DataFrame, prefix: str) -> DataFrame:
    """``new`` (position, ...) with ids ``prefix``_q<n>, going on from the largest number that ends an id of ``existing``.

    Positions are whole numbers; rows are ordered within thousands of them.
    """
    last = existing.agg(F.coalesce(F.max(F.regexp_extract("id", r"(\d+)$", 1).try_cast("int")), F.lit(0)).alias("_last"))
    placed = numbered(new, [], [F.col("position")], F.floor(F.col("position") / 1000), "_n")
    return placed.crossJoin(F.broadcast(last)).withColumn("id", F.concat(F.lit(f"{prefix}_q"), F.col("_last") + F.col("_n"))).drop("_n", "_last")


def _with_words(rows: DataFrame, text_col: str) -> DataFrame:
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    return rows.withColumn("words", tokens(F.col(text_col))).withColumn("letters", F.split(F.concat(F.lit(" "), low, F.lit(" ")), ""))


def fit_text_classifier(rows: DataFrame, text_col: str, label_col: str, features: int = 1 << 16) -> PipelineModel:
    """Logistic regression on TF-IDF of words, word pairs and letter triples; classes count alike."""
    counts = rows.groupBy(label_col).agg(F.count("*").alias("_c"))
    total = rows.count()
    weighted = _with_words(rows, text_col).join(F.broadcast(counts), label_col).withColumn("weight", F.lit(float(total)) / (F.col("_c") * counts.count())).withColumn("label", F.col(label_col).cast("double"))
    parts, stages = ("words", "pairs", "triples"), [NGram(n=2, inputCol="words", outputCol="pairs"), NGram(n=3, inputCol="letters", outputCol="triples")]
    for part in parts:
        stages += [HashingTF(inputCol=part, outputCol=f"{part}_tf", numFeatures=features), IDF(inputCol=f"{part}_tf", outputCol=f"{part}_idf")]
    stages += [VectorAssembler(inputCols=[f"{p}_idf" for p in parts], outputCol="features"), LogisticRegression(weightCol="weight", regParam=0.01, maxIter=15)]
    return Pipeline(stages=stages).fit(weighted)


def classify(model: PipelineModel, rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with prediction."""
    return model.transform(_with_words(rows, text_col)).select(*rows.columns, "prediction")

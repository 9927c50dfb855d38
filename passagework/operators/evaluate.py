"""Evaluation of retrieval, classification and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from passagework.functions.text import tokens
from passagework.operators.numbering import numbered
from passagework.operators.search import in_parts


def _share(n: Column, of: Column, empty: float) -> Column:
    return F.when(of == 0, F.lit(float(empty))).otherwise(n / F.greatest(of, F.lit(1)))


def retrieval_metrics(results: DataFrame, k: int = 5, empty_gold: float = 1.0) -> DataFrame:
    """``results`` (retrieved, relevant: arrays) with hit, reciprocal_rank, precision_at_k, precision_at_r and recall.

    ``empty_gold`` is the recall and the precision at R of a question without relevant chunks.
    """
    got, gold = F.coalesce("retrieved", F.array().cast("array<string>")), F.array_distinct(F.coalesce("relevant", F.array().cast("array<string>")))
    first = F.array_min(F.filter(F.transform(got, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda i: i.isNotNull()))
    found = lambda n: F.size(F.filter(F.slice(got, F.lit(1), n), lambda x: F.array_contains(gold, x)))
    return results.select(
        "*", first.isNotNull().cast("double").alias("hit"), F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank"), (found(F.lit(k)) / k).alias("precision_at_k"),
        _share(found(F.greatest(F.size(gold), F.lit(1))), F.size(gold), empty_gold).alias("precision_at_r"), _share(F.size(F.array_intersect(gold, got)), F.size(gold), empty_gold).alias("recall"),
    )


def page_metrics(results: DataFrame) -> DataFrame:
    """``results`` (pages, relevant_pages: arrays of int) with hit, reciprocal_rank over hits, precision at R over distinct pages, recall."""
    gold, pages = F.array_distinct("relevant_pages"), F.array_distinct("pages")
    first = F.array_min(F.filter(F.transform("pages", lambda p, i: F.when(F.array_contains(gold, p), i + 1)), lambda i: i.isNotNull()))
    at_r = F.size(F.array_intersect(F.slice(pages, F.lit(1), F.greatest(F.size(gold), F.lit(1))), gold))
    return results.select(
        "*", first.isNotNull().cast("double").alias("page_hit"), F.coalesce(1.0 / first, F.lit(0.0)).alias("page_reciprocal_rank"),
        _share(at_r, F.size(gold), 0.0).alias("page_precision_at_r"), _share(F.size(F.array_intersect(pages, gold)), F.size(gold), 0.0).alias("page_recall"),
    )


def mean_std_sem(rows: DataFrame, value: str, *groups: str, few: int = 15) -> DataFrame:
    """(groups, n, mean, std, sem, low_n): the population's standard deviation; zeros without values."""
    out = rows.groupBy(*groups).agg(F.count(value).alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"))
    return out.withColumn("sem", F.coalesce(F.try_divide(F.col("std"), F.sqrt("n")), F.lit(0.0))).withColumn("low_n", F.col("n") < few)


def breakdowns(rows: DataFrame, value: str, dimensions: list[str]) -> DataFrame:
    """(dimension, label, n, mean): the mean by each dimension, from one pass over the rows."""
    long = rows.select(F.col(value).alias("_v"), F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("label")) for d in dimensions))).alias("_d"))
    return long.groupBy("_d.dimension", "_d.label").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"))


def brier_ece(rows: DataFrame, probability: str, truth: str, bins: int = 5) -> DataFrame:
    """One row (n, brier, ece): mean squared error, and the gap of confidence and truth over equal bins, weighted by their rows."""
    p = F.least(F.greatest(F.col(probability), F.lit(0.0)), F.lit(1 - 1e-9))
    cell = F.floor(p * bins)
    binned = rows.groupBy(cell.alias("bin")).agg(F.count("*").alias("m"), F.sum(probability).alias("p"), F.sum(truth).alias("y"), F.sum(F.pow(F.col(probability) - F.col(truth), 2)).alias("se"))
    return binned.agg(F.sum("m").alias("n"), (F.sum("se") / F.sum("m")).alias("brier"), (F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("m")).alias("ece"))


def precision_recall_f1(rows: DataFrame, predicted: str, gold: str) -> DataFrame:
    """(label, support, precision, recall, f1) by label; zero on an empty denominator."""
    pairs = rows.groupBy(F.col(predicted).alias("p"), F.col(gold).alias("g")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.col("p").alias("label"), F.when(F.col("p") == F.col("g"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("said"), F.lit(0).cast("long").alias("held"))
    sides = sides.unionByName(pairs.select(F.col("g").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("said"), F.col("n").alias("held")))
    sums = sides.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "said", "held")))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = sums.select("label", F.col("held").alias("support"), ratio(F.col("tp"), F.col("said")).alias("precision"), ratio(F.col("tp"), F.col("held")).alias("recall"))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(by_label: DataFrame) -> DataFrame:
    """One row: the mean f1 of labels that occur."""
    return by_label.where("support > 0").agg(F.avg("f1").alias("macro_f1"), F.sum(F.col("recall") * F.col("support")).alias("correct"), F.sum("support").alias("n")).select("macro_f1", (F.col("correct") / F.col("n")).alias("accuracy"))


def threshold_sweep(rows: DataFrame, predicted: str, score: str, gold: str, thresholds: list[float], none: str = "none") -> DataFrame:
    """(threshold, accuracy): predictions scored under a threshold say ``none``. One pass, a counter a threshold."""
    cuts = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    right = F.when(F.col(score) >= F.col("threshold"), F.col(predicted)).otherwise(none) == F.col(gold)
    return rows.select("*", cuts).groupBy("threshold").agg(F.avg(right.cast("int")).alias("accuracy"))


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.25, seed: int = 42) -> DataFrame:
    """``rows`` with is_test: a fixed random ``share`` of each label's rows, one at least.

    They are those of the least hashes of ``key`` (ties: the key). Labels are few and large, so that hashes are counted by
    ranges, and only rows within a range are ordered.
    """
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), key))
    sizes = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    placed = numbered(hashed, [label], [F.col("_h"), F.col(key)], F.shiftright("_h", 48), "_i").join(sizes, F.col(label).eqNullSafe(F.col("_label")))
    return placed.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_i") <= F.greatest(F.lit(1), F.round(F.col("_n") * share))).alias("is_test"))


def route_match_rate(rows: DataFrame, actual: str, expected: str) -> DataFrame:
    """One row (n, match_rate): the share of rows whose route is the expected one; a route that failed (null) matches nothing."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.coalesce(F.col(actual) == F.col(expected), F.lit(False)).cast("double")), F.lit(0.0)).alias("match_rate"))


def verbatim_gold(docs: DataFrame, asked: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id) of ``docs`` (doc_id, text) that hold a query of ``asked`` (query_id, query) word for word.

    A text that holds a query holds its inner words whole. So texts meet the queries by the rarest inner word, and only these
    pairs are compared. Queries without inner words, of two words or less, are compared with all texts. The queries go to the
    texts, about MOST_QUERIES at once, so that no text is shuffled. ``terms``: (term, df) of ``docs``, where it is known.
    """
    by_word = docs.select("doc_id", "text", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))

    def search(part: DataFrame) -> DataFrame:
        words = part.select("query_id", "query", tokens(F.col("query")).alias("w")).withColumn("inner", F.expr("if(size(w) > 2, slice(w, 2, size(w) - 2), cast(array() AS array<string>))"))
        inner = words.select("query_id", F.explode(F.array_distinct("inner")).alias("term"))
        met = F.broadcast(inner.select("term").distinct())
        frequency = by_word.select("term").join(met, "term").groupBy("term").agg(F.count("*").alias("df")) if terms is None else terms.join(met, "term").select("term", "df")
        rarest = inner.join(frequency, "term", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r")).select("query_id", "r.term")
        long = by_word.join(F.broadcast(rarest.join(part.select("query_id", "query"), "query_id")), "term")
        short = docs.select("doc_id", "text").crossJoin(F.broadcast(words.where("size(inner) = 0 and query is not null").select("query_id", "query")))
        return long.select("doc_id", "text", "query_id", "query").unionByName(short).where(F.col("text").contains(F.col("query"))).select("query_id", "doc_id")

    return in_parts(asked, ["query_id"], search)


def fit_platt(rows: DataFrame, score: str, truth: str, epochs: int = 2000, rate: float = 0.1, l2: float = 1e-4) -> tuple[float, float]:
    """(a, b) after ``epochs`` steps down the log loss from (1, 0), with ``l2`` on a.

    Rows are summed by score in Spark first; detectors give few scores. Scores are rounded to 4 places, so that at most
    10001 rows reach the driver.
    """
    held = rows.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
    sums = held.groupBy(F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4).alias("x")).agg(F.count("*").alias("n"), F.sum(F.col(truth).cast("double")).alias("y")).orderBy("x").collect()
    x, n, y = (np.array([float(r[c]) for r in sums]) for c in ("x", "n", "y"))
    a, b, total = 1.0, 0.0, max(n.sum(), 1.0)
    for _ in range(epochs):
        gap = n / (1 + np.exp(-(a * x + b))) - y
        a, b = a - rate * ((gap * x).sum() / total + l2 * a), b - rate * gap.sum() / total
    return float(a), float(b)

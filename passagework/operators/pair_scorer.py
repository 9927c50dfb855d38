"""A trained scorer of (query, text) pairs for reranking: a pairwise ranking loss over a handful of features."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from passagework.operators.linear import minimised, summed
from passagework.plans.shared import shared_folder

NAMES = ("share", "rare_share", "saturated", "longest_run", "pair_share", "first_place", "log_length")
#: Words whose rarity the model knows; any other is as rare as can be.
VOCABULARY = 1 << 16


def words_of(text: str | None) -> list[str]:
    return re.findall(r"\w+", (text or "").lower())


def pair_features(query: list[str], text: list[str], rarity: dict[str, float], unknown: float) -> list[float]:
    """NAMES in order, all 0 where the query or the text has no words.

    The share of the query's words that the text holds, plain, by rarity, and by saturated counts; the longest run of
    neighbouring query words found as neighbours; the share of neighbouring pairs; how early the rarest shared word
    stands; the text's length.
    """
    if not query or not text:
        return [0.0] * len(NAMES)
    places: dict[str, list[int]] = {}
    wanted = set(query)
    for i, w in enumerate(text):
        if w in wanted:
            places.setdefault(w, []).append(i)
    weight = {w: rarity.get(w, unknown) for w in wanted}
    total, size = sum(weight.values()) or 1.0, len(text)
    saturated = sum(weight[w] * len(at) * 2.2 / (len(at) + 1.2) for w, at in places.items()) / (2.2 * total)
    pairs = [(a, b) for a, b in zip(query, query[1:], strict=False)]
    runs, longest, before = [], 0, {}
    for i, (a, b) in enumerate(pairs):
        here = {p + 1 for p in places.get(a, ()) if p + 1 < size and text[p + 1] == b}
        runs.append(bool(here))
        now = {p: before.get(p - 1, 1) + 1 for p in here}
        longest, before = max([longest, *now.values()]), now
    longest = max(longest, 1 if places else 0)
    rarest = max(places, key=lambda w: (weight[w], w), default=None)
    return [
        len(places) / len(wanted), sum(weight[w] for w in places) / total, saturated, longest / len(query), sum(runs) / max(1, len(pairs)),
        1 - places[rarest][0] / size if rarest else 0.0, float(np.log1p(size)) / 10,
    ]


@dataclass(frozen=True)
class PairModel:
    """score = coefficients * (features - means) / deviations."""

    rarity: dict[str, float]
    unknown: float
    means: np.ndarray
    deviations: np.ndarray
    coefficients: np.ndarray

    def scores(self, queries, texts) -> np.ndarray:
        x = np.array([pair_features(words_of(q), words_of(t), self.rarity, self.unknown) for q, t in zip(queries, texts, strict=True)], dtype=float).reshape(-1, len(NAMES))
        return (x - self.means) / self.deviations @ self.coefficients

    def __call__(self, query: Column, text: Column) -> Column:
        """A scorer for rank.rerank() and Corpus."""

        @F.pandas_udf("double")
        def score(queries: pd.Series, texts: pd.Series) -> pd.Series:
            return pd.Series(self.scores(queries, texts), index=queries.index, dtype=float)

        return score(query, text)


def _feature_batches(rarity: dict[str, float], unknown: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pair_features(words_of(q), words_of(t), rarity, unknown) for q, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(x, pa.list_(pa.float64()))], names=["query_id", "relevant", "x"])

    return run


def _pair_losses(means: np.ndarray, deviations: np.ndarray):
    """Each query's mean over its pairs of a relevant and another text of ln(1 + exp(-difference of scores))."""

    def run(batch: pa.RecordBatch, w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = 0.0, np.zeros_like(w)
        for good, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            one, two = ((np.array(x, dtype=float).reshape(-1, len(w)) - means) / deviations for x in (good, bad))
            difference = (one @ w)[:, None] - (two @ w)[None, :]
            n = difference.size
            loss += np.logaddexp(0, -difference).sum() / n
            slope = -1 / (1 + np.exp(difference)) / n
            gradient += slope.sum(axis=1) @ one - slope.sum(axis=0) @ two
        return loss, gradient

    return run


def fit_pair_scorer(pairs: DataFrame, chunks: DataFrame, terms: DataFrame, vocabulary: int = VOCABULARY, l2: float = 0.01, steps: int = 40) -> PairModel:
    """A model of pairs (query_id, query, text, relevant); ``terms`` is (term, df) of ``chunks``, whose number counts.

    Each query has a shortlist's texts, some relevant and some not; queries without both teach nothing. Features are
    written once; each step adds up the queries' losses in the tasks. ``vocabulary``: the most frequent words, whose
    rarity is sent along; words beyond it are taken to be the rarest.
    """
    spark, folder = pairs.sparkSession, shared_folder(pairs.sparkSession, "pairs")
    n = chunks.count()
    top = terms.orderBy(F.desc("df"), "term").limit(vocabulary).select("term", "df").collect()
    rarity, unknown = {r["term"]: float(np.log(1 + n / r["df"])) for r in top}, float(np.log(1 + n))
    rows = pairs.select("query_id", "query", "text", F.col("relevant").cast("boolean").alias("relevant")).mapInArrow(_feature_batches(rarity, unknown), f"query_id {dict(pairs.dtypes)['query_id']}, relevant boolean, x array<double>")
    rows.write.parquet(f"{folder}/features")
    rows = spark.read.parquet(f"{folder}/features")
    width = len(NAMES)
    sums = rows.select(*(f(F.col("x")[i]).alias(f"{name}{i}") for i in range(width) for name, f in (("m", F.avg), ("d", F.stddev_pop)))).first()
    means, deviations = np.array([sums[f"m{i}"] or 0.0 for i in range(width)]), np.array([max(sums[f"d{i}"] or 0.0, 1e-6) for i in range(width)])
    grouped = rows.groupBy("query_id").agg(F.collect_list(F.when(F.col("relevant"), F.col("x"))).alias("good"), F.collect_list(F.when(~F.col("relevant"), F.col("x"))).alias("bad"))
    grouped.where("size(good) > 0 and size(bad) > 0").select("good", "bad").write.parquet(f"{folder}/queries")
    queries = spark.read.parquet(f"{folder}/queries")
    losses = _pair_losses(means, deviations)

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = summed(queries, losses, w)
        return loss + 0.5 * l2 * (w**2).sum(), gradient + l2 * w

    return PairModel(rarity, unknown, means, deviations, minimised(objective, np.zeros(width), steps))


def mean_reciprocal_rank(ranked: DataFrame) -> float:
    """Of (query_id, rank, relevant): the mean over queries of 1 / the first relevant rank, 0 where there is none."""
    best = ranked.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    return best.agg(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("m")).first()["m"] or 0.0

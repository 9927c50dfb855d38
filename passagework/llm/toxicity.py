"""Toxicity as severity grades by cumulative-link ordinal regression on sparse text features (operator 9)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from passagework.llm.scratch import Scratch
from passagework.llm.words import NON_ALPHANUMERIC, Words, distinct_by_text, lists, text_chunks

#: A word's features: the word and its first 4, 5 and 6 bytes, since inflected words share a stem.
STEMS = (4, 5, 6)


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade > k) = sigmoid(sum of weights - cuts[k]): one weight a feature, shared by all cuts."""

    features: np.ndarray  # sorted hashes, uint64
    weights: np.ndarray
    cuts: np.ndarray


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds by text) of the features of each text, repeats included."""
    parts = [words.hash, *(words.stem_hash(k) for k in STEMS)]
    return np.stack(parts, axis=1).ravel(), words.first * len(parts)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, bounds in text_chunks(batch.column(1)):
            hashes, at = distinct_by_text(*_features(Words(data, bounds, NON_ALPHANUMERIC)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists(hashes, at), batch.column(2).slice(a, b - a)], names=["doc_id", "features", "toxic"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_cumulative_link(rows: list[np.ndarray], grades: np.ndarray, weight: np.ndarray, n_features: int, l2: float = 1e-4, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) by gradient steps with momentum on the weighted log-likelihood.

    The cuts are a first one and positive distances, so that they stay in order.
    """
    top = int(grades.max(initial=0))
    text = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows).astype(np.int64) if len(text) else np.zeros(0, np.int64)
    weight = weight / weight.sum()
    w, cut = np.zeros(n_features), np.concatenate([[2.0], np.zeros(max(0, top - 1))])  # cut[1:]: logs of distances
    velocity = [np.zeros_like(w), np.zeros_like(cut)]
    scale = [np.zeros_like(w), np.zeros_like(cut)]
    for step in range(1, steps + 1):
        cuts = cut[0] + np.concatenate([[0.0], np.cumsum(np.exp(cut[1:]))])
        z = np.bincount(text, w[column], len(rows))
        over = np.concatenate([np.ones((len(rows), 1)), _sigmoid(z[:, None] - cuts), np.zeros((len(rows), 1))], axis=1)
        slope = over * (1 - over)
        every = np.arange(len(rows))
        p = np.maximum(over[every, grades] - over[every, grades + 1], 1e-12)
        # d log p / dz, and by each cut
        dz = weight * (slope[every, grades] - slope[every, grades + 1]) / p
        dcuts = np.zeros(len(cuts))
        for k in range(len(cuts)):
            lower, upper = grades == k + 1, grades == k
            dcuts[k] = (weight * slope[:, k + 1] / p * (upper.astype(float) - lower)).sum()
        gaps = np.exp(cut[1:])
        gradient = [np.bincount(column, dz[text], n_features) - l2 * w, np.concatenate([[dcuts.sum()], [dcuts[k + 1 :].sum() * gaps[k] for k in range(len(gaps))]])]
        for i, g in enumerate(gradient):
            velocity[i] = 0.9 * velocity[i] + 0.1 * g
            scale[i] = 0.99 * scale[i] + 0.01 * g * g
            move = 0.1 * (velocity[i] / (1 - 0.9**step)) / (np.sqrt(scale[i] / (1 - 0.99**step)) + 1e-8)
            if i == 0:
                w = w + move
            else:
                cut = cut + move
    return w, cut[0] + np.concatenate([[0.0], np.cumsum(np.exp(cut[1:]))])


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, n_features: int, shares: tuple[float, ...]) -> np.ndarray:
    """Grades of labelled rows: 0 for clean ones, for toxic ones 1 and one more for each of the quantiles ``shares`` that their evidence is above.

    A row's evidence is its sum of weights in a two-grade model fitted on the other half of the rows. Halves without
    both labels give no evidence.
    """
    evidence = np.zeros(len(rows))
    for half in (0, 1):
        own, others = (np.flatnonzero(np.arange(len(rows)) % 2 == (half if mine else 1 - half)) for mine in (True, False))
        if len(set(toxic[others])) == 2:
            w, _ = fit_cumulative_link([rows[i] for i in others], toxic[others], weight[others], n_features, steps=200)
            evidence[own] = [w[rows[i]].sum() for i in own]
    held = evidence[toxic == 1]
    above = (evidence[:, None] > np.quantile(held, shares)).sum(axis=1) if len(held) else np.zeros(len(rows), np.int64)
    return toxic * (1 + above)


def labelled_sample(labels: DataFrame, rows_per_class: int, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, label) of at most ``rows_per_class`` rows of each class, those of the least hashes of their ids.

    The two top lists need no more of the driver than their own size. Null ids and labels other than 0 and 1 don't count.
    """
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null").distinct()
    parts = [named.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def labelled_texts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, label) of labelled_sample()'s rows: of several texts of one id the least, so that the sample bounds the rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = 6000, n_features: int = 4096, grade_shares: tuple[float, ...] = (1 / 3, 2 / 3)
) -> OrdinalModel:
    """A model fitted on at most ``rows_per_class`` labelled documents of each class.

    Features: the ``n_features`` of the largest log-odds of toxic documents among those in 5 or more of them. Labels are 0
    and 1, so that grades above 0 are made by cross-fitting (see severity_grades()): how toxic a document labelled toxic is to a
    model that was fitted without it. The classes count by their shares among all labels. Without labels of both kinds the
    model finds nothing toxic.
    """
    scratch = Scratch(docs.sparkSession)
    sample = labelled_sample(labels, rows_per_class, id_col, label_col)
    texts = labelled_texts(docs, sample, id_col, text_col)
    held = scratch.save(texts.mapInArrow(_feature_batches, "doc_id long, features array<long>, toxic int"), "features")
    totals = {r["toxic"]: r["n"] for r in held.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shares = {r["label"]: r["n"] for r in labels.where(f"{label_col} in (0, 1)").groupBy(F.col(label_col).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([20.0]))
    counted = held.select(F.explode("features").alias("feature"), "toxic").groupBy("feature").agg(F.sum("toxic").alias("k"), F.count("*").alias("n")).where("k >= 5")
    odds = F.expr(f"ln((k + 0.5) / ({totals[1]} - k + 0.5)) - ln((n - k + 0.5) / ({totals[0]} - n + k + 0.5))")
    chosen = counted.withColumn("odds", odds).where("odds > 1.5").orderBy(F.desc(F.col("odds") * F.sqrt("k")), "feature").limit(n_features).select("feature").collect()
    features = np.sort(np.array([r["feature"] for r in chosen], dtype=np.int64).view(np.uint64))
    index = docs.sparkSession.createDataFrame([(int(x), i) for i, x in enumerate(features.view(np.int64))], "feature long, i int")
    placed = held.select("doc_id", "toxic", F.explode_outer("features").alias("feature")).join(F.broadcast(index), "feature", "left")
    rows = placed.groupBy("doc_id", "toxic").agg(F.collect_list("i").alias("columns")).orderBy("doc_id").collect()  # bounded by the sample
    columns = [np.array(r["columns"], dtype=np.int64) for r in rows]
    toxic = np.array([r["toxic"] for r in rows], dtype=np.int64)
    weight = np.where(toxic == 1, shares[1] / totals[1], shares[0] / totals[0])
    grades = severity_grades(columns, toxic, weight, max(1, len(features)), grade_shares)
    weights, cuts = fit_cumulative_link(columns, grades, weight, max(1, len(features)))
    return OrdinalModel(features, weights[: len(features)], cuts)


def _score_batches(model: OrdinalModel) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(44)
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[(model.features >> shift).astype(np.int64)] = True
        size = max(1, len(model.features))
        for batch in batches:
            for a, b, data, bounds in text_chunks(batch.column(1)):
                hashes, at = _features(Words(data, bounds, NON_ALPHANUMERIC))
                hit = np.flatnonzero(maybe[(hashes >> shift).astype(np.int64)])
                place = np.minimum(np.searchsorted(model.features, hashes[hit]), size - 1)
                same = model.features[place] == hashes[hit] if len(hit) else np.zeros(0, bool)
                key = np.unique((np.searchsorted(at, hit[same], side="right") - 1) * size + place[same])
                z = np.bincount(key // size, model.weights[key % size] if len(key) else None, b - a).astype(float)
                over = _sigmoid(z[:, None] - model.cuts)
                grade = (over >= 0.5).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(over.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(over[:, 0])], names=["key", "severity", "grade", "p_toxic"])

    return run


def toxicity_scores(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic, kept), one row for each row of ``docs``; nothing is shuffled.

    severity: the expected grade, the sum of P(grade > k); toxic: P(grade > 0) reaches ``threshold``; kept: not toxic.
    A null, empty or wordless text has no features and scores by the cuts alone. Null ids and repeated rows are
    kept; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).mapInArrow(_score_batches(model), "key long, severity double, grade int, p_toxic double")
    return rows.select(F.col("key").alias("doc_id"), "severity", "grade", "p_toxic", (F.col("p_toxic") >= threshold).alias("toxic"), (F.col("p_toxic") < threshold).alias("kept"))


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text is not toxic, with all their columns."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _score_batches(model)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), text], names=["key", "text"])
            p = [out.column(3).to_numpy() for out in score(iter([numbered]))]
            yield batch.filter(pa.array(np.concatenate(p) < threshold)) if p else batch

    return docs.mapInArrow(keep, docs.schema)

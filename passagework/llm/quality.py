"""Quality by a document classifier whose evidence is shrunk with its site's and path's (operator 7)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from passagework.llm.scratch import Scratch
from passagework.llm.toxicity import labelled_sample, labelled_texts
from passagework.llm.words import SPACES, Words, distinct_by_text, text_chunks

#: What a text's features measure, in order.
FEATURES = (
    "log words", "bytes a word", "upper-case share", "digit share", "mark share", "stop and comma share", "line breaks a word",
    "distinct word share", "share of words equal to the last", "words that are one mark", "words with a mark at the end", "longest word",
)


@dataclass(frozen=True)
class LogisticModel:
    """P(good) = sigmoid(weights . (1, z, z^2)) of features z in units of the sample's spread."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.weights

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)


def text_features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(text, feature) of some texts."""
    words = Words(data, bounds, SPACES)
    n = words.per_text.astype(float)
    size = np.maximum(np.diff(bounds), 1).astype(float)
    some = np.maximum(n, 1)

    def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.float64)])
        return sums[at[1:]] - sums[at[:-1]]

    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    upper = letter & (data < 97)
    digit = (data >= 48) & (data <= 57)
    pause = (data == 46) | (data == 44)
    mark = (data > 32) & (data < 127) & ~letter & ~digit & ~pause
    length = words.end - words.start
    again = np.zeros(len(words.hash), bool)
    again[1:] = words.hash[1:] == words.hash[:-1]
    first = words.first[:-1][words.first[:-1] < len(again)]
    again[first] = False
    distinct = np.diff(distinct_by_text(words.hash, words.first)[1])
    last_mark = mark[words.end - 1] if len(words.end) else np.zeros(0, bool)
    longest = np.zeros(len(n))
    np.maximum.at(longest, np.repeat(np.arange(len(n)), words.per_text), length)
    return np.stack(
        [
            np.log1p(n), per_text(length, words.first) / some, per_text(upper, bounds) / np.maximum(per_text(letter, bounds), 1), per_text(digit, bounds) / size,
            per_text(mark, bounds) / size, per_text(pause, bounds) / some, per_text(data == 10, bounds) / some, distinct / some, per_text(again, words.first) / some,
            per_text(last_mark & (length == 1), words.first) / some, per_text(last_mark & (length > 1), words.first) / some, np.log1p(longest),
        ],
        axis=1,
    )


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, bounds in text_chunks(batch.column(1)):
            x = text_features(data, bounds)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), flat, batch.column(2).slice(a, b - a)], names=["doc_id", "x", "label"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_class: int = 10000, l2: float = 1e-3, steps: int = 30) -> LogisticModel | None:
    """A logistic model by Newton steps on at most ``rows_per_class`` labelled documents of each class.

    The classes count by their shares among all labels. None without labelled documents of both kinds.
    """
    sample = labelled_sample(labels, rows_per_class, id_col, label_col)
    texts = labelled_texts(docs, sample, id_col, text_col)
    rows = texts.mapInArrow(_feature_batches, "doc_id long, x array<double>, label int").orderBy("doc_id").collect()  # bounded by the sample
    shares = {r["label"]: r["n"] for r in labels.where(f"{label_col} in (0, 1)").groupBy(F.col(label_col).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    y = np.array([r["label"] for r in rows], dtype=float)
    if len(set(y)) < 2:
        return None
    x = np.array([r["x"] for r in rows])
    model = LogisticModel(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9), np.zeros(2 * x.shape[1] + 1))
    design = model._design(x)
    weight = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum())
    weight /= weight.sum()
    w = model.weights
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (weight * (y - p)) - l2 * w
        curve = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + l2 * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w = w + move * min(1.0, 5 / np.abs(move).max())
    return LogisticModel(model.mean, model.spread, w)


def _evidence_batches(model: LogisticModel | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in text_chunks(batch.column(1)):
                logit = model.logit(text_features(data, bounds)) if model else np.zeros(b - a)
                columns = [batch.column(0).slice(a, b - a), pa.array(np.clip(logit, -12, 12)), batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "evidence", "host", "path"])

    return run


def _strength(within: Column, between: Column, mean: Column) -> Column:
    """How many documents a prior of that mean is worth, by moments: the larger, the less groups differ among themselves."""
    true = F.greatest(between - within, F.lit(1e-9))
    return F.least(F.greatest(mean * (1 - mean) / true - 1, F.lit(1.0)), F.lit(1e6))


def quality_scores(
    docs: DataFrame, model: LogisticModel | None, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """(doc_id, host, path, p_document, host_rate, path_rate, score, kept), one row for each row of ``docs``.

    Empirical Bayes in three levels: the global rate of good documents is the prior of each host's, the host's
    posterior that of each of its paths, with strengths from the spread of hosts and of paths (method of moments), so
    that sparse sites stay near the rate above them. A document's score adds the log-odds of its path, without the
    document itself, over the global ones to its own evidence. Rates are sums over all documents: sums by path, from
    which those by host and the global ones follow, so that a hot host is summed where its rows are.

    A null, empty or wordless text is scored as it is; a null host or path is a host or path of its own; null ids
    and repeated rows are kept; an empty table gives no rows; other columns are ignored. Without a model the evidence
    is zero everywhere.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    judged = rows.mapInArrow(_evidence_batches(model), "doc_id long, evidence double, host string, path string")
    judged = Scratch(docs.sparkSession).save(judged.withColumn("p", F.expr("1 / (1 + exp(-evidence))")), "judged")
    paths = judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    world = hosts.agg((F.sum("host_s") / F.sum("host_n")).alias("rate"), F.sum("host_n").alias("docs"), F.count("*").alias("hosts"), F.expr("coalesce(var_samp(host_s / host_n), 0D)").alias("spread"), F.expr("avg(1D / host_n)").alias("inverse"))
    world = world.select("rate", _strength(F.col("rate") * (1 - F.col("rate")) * F.col("inverse"), F.col("spread"), F.col("rate")).alias("host_prior"))
    hosts = hosts.crossJoin(F.broadcast(world)).withColumn("host_rate", F.expr("(host_s + host_prior * rate) / (host_n + host_prior)"))
    both = paths.join(hosts, "host")
    inner = both.agg(F.expr("avg(pow(s / n - host_rate, 2))").alias("spread"), F.expr("avg(host_rate * (1 - host_rate) / n)").alias("within"), F.avg("host_rate").alias("mean"))
    inner = inner.select(_strength(F.col("within"), F.col("spread"), F.col("mean")).alias("path_prior"))
    both = both.crossJoin(F.broadcast(inner)).select("host", "path", "n", "s", "rate", "host_rate", "path_prior")
    out = judged.join(both, ["host", "path"]).withColumn("path_rate", F.expr("(s + path_prior * host_rate) / (n + path_prior)"))
    others = F.expr("least(greatest((s - p + path_prior * host_rate) / (n - 1 + path_prior), 1e-6D), 1 - 1e-6D)")
    base = F.expr("least(greatest(rate, 1e-6D), 1 - 1e-6D)")
    logit = lambda p: F.log(p / (1 - p))
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + logit(others) - logit(base)))))
    return out.select("doc_id", "host", "path", F.col("p").alias("p_document"), "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("kept"))

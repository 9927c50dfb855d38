import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm.quality import fit_quality, quality_scores, text_features
from passagework.llm.toxicity import STEMS, drop_toxic, fit_cumulative_link, fit_toxicity, toxicity_scores
from passagework.llm.words import NON_ALPHANUMERIC, Words

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return docs, labels.where(even), labels.where(~even)


def test_held_out_toxicity(spark, tables):
    docs, train, test = tables
    model = fit_toxicity(docs, train)
    said = toxicity_scores(docs, model).select("doc_id", F.col("toxic").alias("said"), "severity").join(test, "doc_id")
    counts = {(r.toxic, r.said): r["count"] for r in said.groupBy("toxic", "said").count().collect()}
    assert counts[1, True] >= 0.8 * (counts[1, True] + counts.get((1, False), 0))
    assert counts[0, False] >= 0.99 * (counts[0, False] + counts.get((0, True), 0))
    means = {r.toxic: r.m for r in said.groupBy("toxic").agg(F.avg("severity").alias("m")).collect()}
    assert means[1] > 1 > 0.1 > means[0]


def test_held_out_quality(spark, tables):
    docs, train, test = tables
    scores = quality_scores(docs, fit_quality(docs, train), F.col("source"), F.col("lang"))
    assert scores.count() == docs.count()
    said = scores.select("doc_id", "kept").join(test, "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in said.groupBy("quality", "kept").count().collect()}
    assert counts[0, False] >= 0.9 * (counts[0, False] + counts.get((0, True), 0))
    assert counts[1, True] >= 0.99 * (counts[1, True] + counts.get((1, False), 0))


def test_sparse_sites_stay_near_the_prior(spark, tables):
    docs, train, _ = tables
    bad = " ".join("word%%% stuff***" for _ in range(60))
    good = docs.where("doc_id < 400").select("doc_id", "text", F.lit("good").alias("site"), F.lit("p").alias("page"))
    rows = [(10**6 + i, bad, "junk", "p") for i in range(80)] + [(2 * 10**6, bad, "new", "p"), (3 * 10**6, "", "new2", None), (None, None, None, None)]
    every = good.unionByName(spark.createDataFrame(rows, "doc_id long, text string, site string, page string"))
    out = {r.doc_id: r for r in quality_scores(every, fit_quality(docs, train), F.col("site"), F.col("page")).collect()}
    assert len(out) == every.count()
    assert out[10**6].path_rate < out[2 * 10**6].path_rate < out[0].path_rate
    assert out[10**6].score <= out[2 * 10**6].score


def test_ordinal_grades():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(3000)]
    strength = np.array([2.0, 1.5, 1.0, 0.5, 0.0, -1.0])
    z = np.array([strength[r].sum() for r in rows])
    grades = (z[:, None] + rng.logistic(size=(3000, 1)) > np.array([1.0, 2.5, 4.0])).sum(axis=1)
    weights, cuts = fit_cumulative_link(rows, grades, np.ones(3000), 6)
    assert np.abs(weights - strength).max() < 0.35 and np.abs(cuts - [1.0, 2.5, 4.0]).max() < 0.35


def test_severity_follows_an_order_that_labels_do_not_tell(spark):
    """Documents of 1 to 6 toxic words of unequal strength, labelled 0 and 1 only: on others, severity rises with their strength."""
    rng = np.random.default_rng(2)
    clean, bad = [f"word{i}" for i in range(300)], [f"vile{'abcdefgh'[i]}x" for i in range(8)]

    def text(strength):
        words = list(rng.choice(clean, 40)) + list(rng.choice(bad, strength, replace=False))
        return " ".join(rng.permutation(words))

    truth = [int(x) for x in rng.integers(0, 7, 1600)]
    docs = spark.createDataFrame([(i, text(s)) for i, s in enumerate(truth)], "doc_id long, text string").cache()
    # milder documents are labelled toxic less often, so that the labels hold a trace of the order
    labels = spark.createDataFrame([(i, int(s > 0 and rng.random() < 0.4 + 0.1 * s)) for i, s in enumerate(truth) if i % 2 == 0], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    found = {r.doc_id: r.severity for r in toxicity_scores(docs, model).collect()}
    held_out = [i for i in range(1600) if i % 2]
    means = [np.mean([found[i] for i in held_out if truth[i] == s]) for s in range(7)]
    assert len(model.cuts) == 3 and (np.diff(means) > 0).all() and means[6] > means[1] + 0.5
    ranks = lambda x: np.argsort(np.argsort(x))
    assert np.corrcoef(ranks([truth[i] for i in held_out]), ranks([found[i] for i in held_out]))[0, 1] > 0.7


def test_toxicity_scores_against_brute_force(spark, tables):
    docs, train, _ = tables
    model = fit_toxicity(docs, train)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    some = docs.where("doc_id < 300").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    got = {r.doc_id: r for r in toxicity_scores(some, model).collect()}
    for r in some.collect():
        raw = (r.text or "").encode()
        words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), NON_ALPHANUMERIC)
        held = {int(h) for part in (words.hash, *(words.stem_hash(k) for k in STEMS)) for h in part}
        over = [1 / (1 + math.exp(-(sum(weight.get(h, 0.0) for h in held) - c))) for c in model.cuts]
        assert got[r.doc_id].severity == pytest.approx(sum(over)) and got[r.doc_id].p_toxic == pytest.approx(over[0])
        assert got[r.doc_id].kept == (over[0] < 0.5) and got[r.doc_id].grade == sum(x >= 0.5 for x in over)


def test_quality_scores_against_brute_force(spark, tables):
    """The three levels in plain Python over each document's own evidence, with ties and rows of one host only."""
    docs, train, _ = tables
    model = fit_quality(docs, train)
    some = docs.where("doc_id < 600").select("doc_id", "text", "source", "lang").unionByName(spark.createDataFrame([(-1, None, None, None), (-2, "same", "x", "p"), (-3, "same", "x", "p"), (-4, "same", "x", "q")], "doc_id long, text string, source string, lang string"))
    got = {r.doc_id: r for r in quality_scores(some, model, F.col("source"), F.col("lang")).collect()}
    p, site = {}, {}
    for r in some.collect():
        raw = (r.text or "").encode()
        logit = float(np.clip(model.logit(text_features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))), -12, 12)[0])
        p[r.doc_id], site[r.doc_id] = 1 / (1 + math.exp(-logit)), (r.source or "", r.lang or "")
    groups = lambda key: {k: [p[d] for d in p if key(site[d]) == k] for k in {key(s) for s in site.values()}}
    hosts, paths = groups(lambda s: s[0]), groups(lambda s: s)
    strength = lambda within, between, mean: min(max(mean * (1 - mean) / max(between - within, 1e-9) - 1, 1.0), 1e6)
    rate = sum(p.values()) / len(p)
    host_prior = strength(rate * (1 - rate) * np.mean([1 / len(x) for x in hosts.values()]), np.var([np.mean(x) for x in hosts.values()], ddof=1), rate)
    host_rate = {h: (sum(x) + host_prior * rate) / (len(x) + host_prior) for h, x in hosts.items()}
    inner = [(np.mean(x), len(x), host_rate[k[0]]) for k, x in paths.items()]
    path_prior = strength(np.mean([h * (1 - h) / n for _, n, h in inner]), np.mean([(m - h) ** 2 for m, _, h in inner]), np.mean([h for *_, h in inner]))
    odds = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    for d, r in got.items():
        h, of_path = host_rate[site[d][0]], paths[site[d]]
        others = (sum(of_path) - p[d] + path_prior * h) / (len(of_path) - 1 + path_prior)
        score = 1 / (1 + math.exp(-(math.log(p[d] / (1 - p[d])) + odds(others) - odds(rate))))
        assert r.p_document == pytest.approx(p[d]) and r.host_rate == pytest.approx(h) and r.path_rate == pytest.approx((sum(of_path) + path_prior * h) / (len(of_path) + path_prior))
        assert r.score == pytest.approx(score, abs=1e-6) and r.kept == (r.score >= 0.5)


def test_odd_rows(spark):
    docs = [(1, "you vile worm"), (2, None), (3, ""), (None, "vile"), (1, "you vile worm"), (4, " ".join(["fine"] * 30000)), (5, "kind words")] + [(10 + i, f"vile worm {i}") for i in range(9)] + [(30 + i, f"kind words {i}") for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as label", "2 as features", "'s' as host", "'p' as path")
    labels = spark.createDataFrame([(10 + i, 1, 0) for i in range(9)] + [(30 + i, 0, 1) for i in range(9)] + [(None, 1, 1), (99, 0, 1), (5, None, None)], "doc_id long, toxic int, quality int")
    model = fit_toxicity(df, labels)
    rows = toxicity_scores(df, model).collect()
    assert len(rows) == len(docs) and {r.doc_id for r in rows if r.toxic} == {1, None, *range(10, 19)}
    kept = drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == len(docs) - 12
    assert quality_scores(df, fit_quality(df, labels), F.col("host"), F.col("path")).count() == len(docs)
    none = df.limit(0)
    for a, b in ((none, labels), (df, labels.limit(0))):
        assert toxicity_scores(a, fit_toxicity(a, b)).where("toxic").count() == 0
        assert quality_scores(a, fit_quality(a, b), F.col("host"), F.col("path")).count() == a.count()


def test_repeated_rows_of_labelled_ids(spark):
    """A sample of ids is a sample of rows: repeated rows, and larger texts of the same id, count for nothing."""
    rows = [(i, ("vile hateful scum " if i % 2 else "mild kind words ") * (1 + i % 3)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i, _ in rows], "doc_id long, toxic int, quality int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    often = spark.createDataFrame(rows + [r for r in rows for _ in range(1 + 3 * (r[0] % 2))] + [(i, "~" + t) for i, t in rows if i % 2], "doc_id long, text string")
    one, two = (fit_toxicity(d, labels) for d in (once, often))
    assert (one.features == two.features).all() and np.allclose(one.weights, two.weights) and np.allclose(one.cuts, two.cuts)
    one, two = (fit_quality(d, labels) for d in (once, often))
    assert np.allclose(one.weights, two.weights)

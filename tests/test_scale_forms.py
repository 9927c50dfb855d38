"""Operators that split what would be one task's work, against the plain form."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.operators import chunk, evaluate, golden, providers, telemetry, tree
from passagework.operators.numbering import numbered
from passagework.streaming import live


def test_row_numbers_by_cells(spark):
    rng = random.Random(1)
    rows = [(g, rng.randrange(5000), i) for i, g in enumerate(["a"] * 300 + ["b"] * 3 + [None] * 5)]
    df = spark.createDataFrame(rows, "g string, x long, i long").withColumn("_in", F.lit(1))
    got = {r.i: r.n for r in numbered(df, ["g"], [F.col("x"), F.col("i")], F.floor(F.col("x") / 100), "n").collect()}
    want = {}
    for g in ("a", "b", None):
        want |= {i: n for n, (_, i) in enumerate(sorted((x, i) for h, x, i in rows if h == g), 1)}
    assert got == want
    assert numbered(df.limit(0), ["g"], [F.col("x")], F.col("x")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 5000])
def test_percentiles_with_outliers(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.gauss(0, 1), 5.0, 1e300, -1e-300]) for _ in range(n)]
    rows = [("a", v) for v in values] + [(None, float(i)) for i in range(11)] + [("c", None)]
    at = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p999": 0.999}
    got = {r.g: r for r in telemetry.floor_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", at).collect()}
    ordered = sorted(values)
    assert set(got) == {"a", None} and all(got["a"][name] == ordered[int(n * p)] for name, p in at.items()) and got[None].p50 == 5.0
    (one,) = telemetry.floor_percentiles(spark.createDataFrame(rows[:n], "g string, v double"), [], "v", at).collect()
    assert one.p95 == ordered[int(n * 0.95)]


def test_split_takes_the_least_hashes(spark):
    rows = [(i, i % 2 if i < 990 else None if i < 999 else 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, label int")
    hashed = df.withColumn("h", F.xxhash64(F.lit(42), "k")).collect()
    want = set()
    for label in (0, 1, None, 7):
        held = sorted((r.h, r.k) for r in hashed if r.label == label)
        want |= {k for _, k in held[: max(1, int(len(held) * 0.25 + 0.5))]}
    assert {r.k for r in evaluate.stratified_split(df, "label", "k").where("is_test").collect()} == want


def test_route_match_rate(spark):
    rows = [("math", "math"), ("code", "math"), (None, "math"), (None, None)]
    (r,) = evaluate.route_match_rate(spark.createDataFrame(rows, "a string, e string"), "a", "e").collect()
    assert (r.n, r.match_rate) == (4, 0.25)
    assert evaluate.route_match_rate(spark.createDataFrame([], "a string, e string"), "a", "e").first().match_rate == 0.0


def test_verbatim_gold(spark):
    docs = [(1, "so the quick brown fox runs"), (2, "xthe quick brown foxes"), (3, "The quick brown fox"), (4, None), (5, "quick"), (6, "brown quick the fox")]
    asked = [(0, "the quick brown fox"), (1, "quick"), (2, "brown fox"), (3, None), (4, "no such words here"), (5, "")]
    got = {(r.query_id, r.doc_id) for r in evaluate.verbatim_gold(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, query string")).collect()}
    assert got == {(q, d) for q, a in asked for d, t in docs if a is not None and t is not None and a in t}


def test_numbered_questions_and_windows(spark):
    new = spark.createDataFrame([(i * 700, f"t{i}") for i in range(9)], "position long, text string")
    ids = {r.text: r.id for r in golden.assign_ids(new, spark.createDataFrame([("x_q4",)], "id string"), "x").collect()}
    assert ids == {f"t{i}": f"x_q{5 + i}" for i in range(9)}
    pages = spark.createDataFrame([("d", p, "x" * (300 if p % 6 < 3 else 10)) for p in range(1, 4001)], "document_id string, physical_page long, text string")
    windows = chunk.page_windows(pages).orderBy("window").collect()
    assert [r.window for r in windows] == list(range(len(windows))) and [r.first_page for r in windows] == sorted(r.first_page for r in windows) and len(windows) > 1000
    assert chunk.page_windows(pages, most=10).count() == 10


def test_trees_are_reused_by_fingerprint(spark, tmp_path):
    rows = [(f"d{i % 2}", f"c{i:03}", f"text {i} of many words {i % 5}") for i in range(24)]
    df = lambda r: spark.createDataFrame(r, "document_id string, chunk_id string, text string")
    nodes = lambda t: sorted((r.document_id, r.chunk_id) for r in t.nodes.collect())
    built = []

    def embed(texts, column):
        built.append(sorted({r.document_id for r in texts.select("document_id").distinct().collect()}))
        return providers.hash_embedder(texts, column)

    folder = str(tmp_path / "cache")
    first = nodes(tree.cached_tree(df(rows), folder, embed))
    assert built[0] == ["d0", "d1"] and {d for d, _ in first} == {"d0", "d1"}
    built.clear()
    assert nodes(tree.cached_tree(df(rows), folder, embed)) == first and not built
    changed = [(d, c, t + " new" if d == "d1" else t) for d, c, t in rows]
    again = nodes(tree.cached_tree(df(changed), folder, embed))
    assert built[0] == ["d1"] and [x for x in again if x[0] == "d0"] == [x for x in first if x[0] == "d0"]
    assert tree.read_manifest(spark, folder).count() == 3 and nodes(tree.newest_trees(spark, folder)) == again
    assert tree.cached_tree(df(rows).limit(0), str(tmp_path / "none")).nodes.count() == 0


def test_streams_order_a_key_across_arrow_batches(spark, tmp_path):
    """A conversation's turns, and a key's requests, come in several Arrow batches in reverse order."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        turns = [(1, i, "it goes on" if i % 2 else f"say {i}", None if i % 2 else f"c{i}") for i in reversed(range(9))]
        spark.createDataFrame(turns, "conv_id long, turn long, query string, concept string").coalesce(1).write.parquet(str(tmp_path / "t"))
        stream = spark.readStream.schema("conv_id long, turn long, query string, concept string").parquet(str(tmp_path / "t"))
        got = {r.turn: r.topic for r in live.run_available(live.topics(stream), str(tmp_path / "topics")).collect()}
        assert got == {i: None if i == 0 else f"c{(i - 1) // 2 * 2}" for i in range(9)}
        rows = [(i, "q", 0, 200 * i) for i in reversed(range(12))]
        spark.createDataFrame(rows, "request_id long, key string, generation long, s long").selectExpr("request_id", "key", "generation", "timestamp_seconds(1704067200 + s) ts").coalesce(1).write.parquet(str(tmp_path / "k"))
        stream = spark.readStream.schema("request_id long, key string, generation long, ts timestamp").parquet(str(tmp_path / "k"))
        got = {r.request_id: r.hit for r in live.run_available(live.kept_answers(stream), str(tmp_path / "kept")).collect()}
        assert got == {i: i not in (0, 5, 10) for i in range(12)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_models_of_many_large_documents_stay_off_the_driver(spark, monkeypatch):
    """Mixtures of large documents are tables from start to end: the driver collects no rows."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    monkeypatch.setattr(tree, "FIT_ROWS", 16)
    rng = np.random.default_rng(0)
    rows = [(f"d{d}", f"d{d}-{i}", [float(v) for v in rng.normal(size=4) + 8 * (i % 3)]) for d in range(30) for i in range(60 if d % 3 else 10)]
    nodes = spark.createDataFrame(rows, "document_id string, chunk_id string, vector array<double>")
    with monkeypatch.context() as m:
        m.setattr(Frame, "collect", lambda self: pytest.fail("collected"))
        m.setattr(Frame, "toPandas", lambda self: pytest.fail("collected"))
        out = tree.soft_clusters(nodes)
    of = {r["chunk_id"]: r["cluster"] for r in out.collect()}
    assert len(of) == len(rows)
    large = [d for d in range(30) if d % 3]
    assert sum(len({of[f"d{d}-{i}"] for i in range(j, 60, 3)}) == 1 for d in large for j in range(3)) >= 0.9 * 3 * len(large)

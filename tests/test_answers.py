import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.functions import answers as A
from passagework.operators import golden, images
from passagework.plans import search_loop


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_judgements(spark):
    said = lambda *v: F.array(*(F.lit(x) for x in v)) if v else F.lit(None).cast("array<string>")
    assert one(spark, A.judged_score(said("Supported ", "no", ""), F.lit(0.9))) == 0.5
    assert one(spark, A.judged_score(said(), F.lit(1.7))) == 1.0
    assert one(spark, A.judged_score(said(), F.lit(None).cast("double"))) == 0.0
    assert one(spark, A.judged_score(said(), F.lit(None).cast("double"), failed=None)) is None
    assert [one(spark, A.confidence_value(F.lit(x))) for x in ("High", "medium", "low", "0.7", "odd")] == [1.0, 0.6, 0.3, 0.7, 0.5]


def test_reflection(spark):
    decide = lambda ok, error, sure, failures, steps: one(spark, A.reflection(F.lit(ok), F.lit(error), F.lit(sure), F.lit(failures), F.lit(steps)))
    assert [decide(False, "", 1.0, 0, 0), decide(True, "x", 1.0, 1, 0), decide(True, "x", 1.0, 3, 0), decide(True, "", 0.3, 0, 2), decide(True, "", 0.3, 0, 4), decide(True, "", 0.9, 0, 0)] == ["retry", "retry", "escalate", "retry", "stop", "stop"]


def test_gaps_and_solutions(spark):
    assert one(spark, A.gaps(F.array(F.lit("How does caching work"), F.lit("Who is it")), F.lit("About CACHING layers"))) == ["Who is it"]
    issue = lambda ok, text, n: one(spark, A.solution_issue(F.lit(ok).cast("boolean"), F.lit(text), F.lit(n)))
    assert [issue(True, "", 0), issue(False, "x", 1), issue(None, "", 1), issue(None, "an Error", 1), issue(None, "x = 2", 0), issue(None, "x = 2", 1)] == [None, "verification failed", "empty or failed solution", "empty or failed solution", "no steps", None]
    assert one(spark, A.finished_answer(F.lit("How long?"), F.lit(" Good behavior "), F.lit(None).cast("string"))) == A.GOOD_BEHAVIOUR
    assert one(spark, A.finished_answer(F.lit("q"), F.lit(" fine "), F.lit(""))) == "fine"


def test_prompt_contexts(spark):
    rows = [(0, 2, 7, "b", "two"), (0, 1, None, "a", "one"), (0, 3, 8, "a", "three")]
    (got,) = A.prompt_contexts(spark.createDataFrame(rows, "query_id long, packed_rank int, page int, source string, text string")).collect()
    assert got.context == "\n--- [Page ?] ---\none\n\n--- [Page 7] ---\ntwo\n\n--- [Page 8] ---\nthree\n" and got.sources == ["a", "b"]


def test_golden_ids(spark):
    new = spark.createDataFrame([(1, "x"), (0, "y")], "position int, q string")
    old = spark.createDataFrame([("rfc_q2",), ("rfc_q11",), ("odd",)], "id string")
    assert {r.q: r.id for r in golden.assign_ids(new, old, "rfc").collect()} == {"y": "rfc_q12", "x": "rfc_q13"}
    assert {r.q: r.id for r in golden.assign_ids(new, old.limit(0), "rfc").collect()} == {"y": "rfc_q1", "x": "rfc_q2"}


def test_text_classifier(spark):
    rows = [(f"solve the equation {i}", 1) for i in range(12)] + [(f"write an essay about tea {i}", 0) for i in range(24)]
    df = spark.createDataFrame(rows, "text string, label_col int")
    model = golden.fit_text_classifier(df, "text", "label_col", 1 << 10)
    new = spark.createDataFrame([("solve an equation now",), ("an essay on tea",)], "text string")
    assert [r.prediction for r in golden.classify(model, new, "text").collect()] == [1.0, 0.0]


def test_sharpness(spark):
    rng = np.random.default_rng(0)
    flat, sharp = np.full((120, 100), 7.0), rng.integers(0, 255, (120, 100)).astype(float)
    df = spark.createDataFrame([(1, 100, flat.ravel().tolist()), (2, 100, sharp.ravel().tolist()), (3, 2, [0.0, 9.0] * 4)], "page_id long, width int, pixels array<double>")
    got = {r.page_id: (r.variance, r.keep) for r in images.sharpness(df).collect()}
    assert got[1] == (0.0, False) and got[3] == (0.0, False) and got[2][1]
    padded = np.pad(sharp, 1, mode="reflect")
    brute = [padded[i, j + 1] + padded[i + 2, j + 1] + padded[i + 1, j] + padded[i + 1, j + 2] - 4 * padded[i + 1, j + 1] for i in range(120) for j in range(100)]
    assert got[2][0] == pytest.approx(np.var(brute))
    text = lambda a, b: one(spark, images.page_text(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert text("d" * 60, "n" * 60) == "d" * 60 and text("short", "n" * 60) == "n" * 60 and text(None, "n") is None


def test_page_ingest(spark):
    """Blurred pages go, short descriptions give way to the file's own text, and pages with neither are dropped."""
    judged = spark.createDataFrame([("d", i, 200.0, i != 2) for i in range(1, 6)] + [("e", 1, 1.0, False)], "document_id string, page_num int, variance double, keep boolean")
    described = spark.createDataFrame([("d", 1, "x" * 60), ("d", 2, "x" * 60), ("d", 3, "short"), ("d", 4, None)], "document_id string, page_num int, described string")
    split = lambda content: F.split(F.decode(content, "UTF-8"), "\f")
    files = spark.createDataFrame([("d", bytearray("\f".join(["", "b" * 60, "n" * 60, "tiny", "m" * 70]).encode()))], "document_id string, content binary")
    native = images.native_texts(files, split)
    assert {r.page_num for r in native.collect()} == {2, 3, 4, 5}
    pages = images.ingested_pages(judged, described, native)
    assert {r.page_num: (r.text[0], r.source, r.chunk_id) for r in pages.collect()} == {1: ("x", "vlm", "d_vlm_page_1"), 3: ("n", "text_layer_fallback", "d_vlm_page_3"), 5: ("m", "text_layer_fallback", "d_vlm_page_5")}
    assert {tuple(r) for r in images.ingest_counts(judged, pages).collect()} == {("d", 5, 1, 1, 2, 1), ("e", 1, 1, 0, 0, 0)}


def test_search_again(spark, tmp_path):
    pages = {"q one": [("http://a.com/1", "nothing"), ("http://wikipedia.org/x", "tea is a drink")], "tea explanation definition": [("http://b.org/tea", "tea is a plant"), ("http://wikipedia.org/x", "tea is a drink")]}
    rows = [(q, i, u, s) for q, hits in pages.items() for i, (u, s) in enumerate(hits)]
    web = spark.createDataFrame(rows, "query string, rank int, url string, snippet string")
    asked = []

    def search(queries):
        asked.append(queries.count())
        return queries.join(web, "query").drop("query")

    def save(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    plans = spark.createDataFrame([(0, "q one", ["tea"], "definition", 2)], "query_id long, query string, concepts array<string>, intent string, max_sources int")
    got = search_loop.gather_evidence(plans, search, save, passes=2).orderBy("position").collect()
    assert [r.url for r in got] == ["http://wikipedia.org/x", "http://b.org/tea"] and asked == [1, 1]


def test_answer_again(spark, tmp_path):
    def answer(queries):
        good = F.col("query") != "what is tea"
        text = F.when(good, "tea is a hot drink made of leaves and water in cups").otherwise("nobody can say what this odd thing might really ever be")
        return queries.select("query_id", text.alias("answer"), F.lit("Green tea is a hot drink made of leaves and water in cups").alias("context"))

    def save(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    asked = spark.createDataFrame([(0, "what is tea"), (1, "other")], "query_id long, query string")
    got = {r.query_id: (r.retried, r.faithfulness) for r in search_loop.faithful_answers(asked, answer, save).collect()}
    assert got == {0: (True, 1.0), 1: (False, 1.0)}

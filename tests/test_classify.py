import math

import pytest
from pyspark.sql import functions as F

from passagework.functions import detectors as D, display, queries as Q


def value(spark, make, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, q string")
    return [r.v for r in df.select("i", make(F.col("q")).alias("v")).orderBy("i").collect()]


def test_detectors(spark):
    score = lambda name, q, docs=False, data=False: value(spark, lambda c: D.raw_scores(c, F.lit(docs), F.lit(data))[name], q)[0]
    assert score("math", "2x + 5 = 11") >= 0.5
    assert score("math", "what does this meaning say") == pytest.approx(0.2)
    assert score("code", "Traceback (most recent call last):\n TypeError: x") >= 0.5
    assert score("code", "what is wrong?\n```python\nprint(1)\n```") >= 0.5
    assert score("knowledge", "what is the latest news today about AI") < 0.5
    assert score("document", "according to this document, summarize section 3") == 0
    assert score("document", "anything", docs=True) == pytest.approx(0.4)
    assert score("data", "analyze the distribution and plot a trend chart") == 0
    assert score("data", "plot a trend", data=True) == pytest.approx(0.9)
    assert score("writing", "rewrite this paragraph") == 0.5
    assert score("writing", "rewrite this paragraph " + "word " * 30) == pytest.approx(0.8)
    assert score("research", "a b c " * 6) == pytest.approx(0.3)
    assert score("math", None) == 0


def test_routing(spark):
    decide = lambda q: value(spark, lambda c: D.route_decision(D.calibrated(D.raw_scores(c))), q)[0]
    assert decide("Calculate the integral of sin(x) dx from 0 to pi").dispatched_agent == "math"
    assert decide("hello there").selected_agent is None
    assert decide("Integrate (x^2-4)/x-2").confidence == pytest.approx(0.667, abs=5e-4)


def test_platt(spark):
    (got,) = value(spark, lambda c: D.platt(F.lit(1.7), 2.0, -1.0), "x")
    assert got == pytest.approx(1 / (1 + math.exp(-1.0)))


def test_query_routes(spark):
    texts = ['"Project Alpha" launch date', "INV-2024 status", "Why does backpropagation suffer from vanishing gradients?", "What is the difference between layer 2 and layer 3 switches?", "plain words here"]
    got = value(spark, Q.route, *texts)
    assert got[:3] == ["bm25", "bm25", "dense"] and got[3] in ("dense", "hybrid") and got[4] == "hybrid"


def test_complexity(spark):
    texts = ["summarize the report", "compare a and b", "congress lacks the authority", "which section of the rfc defines the header", "which section is meant", "what is entropy", "what is it? and why?", "who does x and how does y"]
    assert value(spark, Q.complexity, *texts) == ["global", "multi_hop", "multi_hop", "simple", "multi_hop", "simple", "multi_hop", "multi_hop"]


def test_variants(spark):
    (got,) = value(spark, Q.variants, "Cats vs dogs, is-not the same?")
    assert got[0] == "Cats vs dogs, is-not the same?" and got[1] == "Cats vs dogs is not the same" and len(got) == 4
    assert len({v.lower() for v in got}) == 4
    assert value(spark, Q.variants, "plain", None) == [["plain"], []]


def test_budgets_and_weights(spark):
    row = spark.range(1).select(Q.budgets(F.lit("dense"), 5).alias("d"), Q.budgets(F.lit("hybrid"), 5).alias("h"), Q.arm_weights(F.lit("bm25"), Q.features(F.lit('the "X1" is not how'))).alias("w")).first()
    assert tuple(row.d) == (20, 10) and tuple(row.h) == (20, 20)
    assert row.w.bm25 == pytest.approx(1.8) and row.w.dense == pytest.approx(1.25)


def test_display(spark):
    formats = value(spark, display.display_format, "compare a and b", "how to cook", "tell", None)
    assert [(f.format, f.confidence) for f in formats] == [("comparison", 1.0), ("steps", 1.0), ("prose", 0.0), ("prose", 0.0)]
    assert value(spark, display.compared_entities, "AWS vs Azure and GCP?", "compare tea, milk and water in detail", "difference between XY and ZW for 3 points", "hello") == [["AWS", "Azure", "GCP"], ["tea", "milk", "water"], ["XY", "ZW"], []]
    assert value(spark, display.fix_typos, "Comapre  the procs, now") == ["compare the pros now"]
    assert value(spark, display.compared_entities, None, "compare tea, milk and 3 points", "TEA versus water. and wine") == [[], ["tea", "milk"], ["TEA", "water", "wine"]]


def test_continued_comparisons(spark):
    cases = [("Now with GCP and AWS", ["AWS", "Azure"], "comparison"), ("and Oracle?", ["AWS"], "recommend"), ("as a table please", ["tea", "milk"], "pros_cons"), ("why is that", [], None), (None, None, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, q string, prior array<string>, f string").orderBy("i")
    got = [(r.c.entities, r.c.kind, r.c.query) for r in df.select(display.continued_comparison(F.col("q"), F.col("prior"), F.col("f")).alias("c")).collect()]
    assert got == [
        (["AWS", "Azure", "GCP"], "add_entity", "Compare AWS, Azure, and GCP in detail"), (["AWS", "Oracle"], "add_entity", "Compare AWS and Oracle"),
        (["tea", "milk"], "reformat", "Compare tea and milk in detail"), ([], "clarify", "why is that"), ([], "clarify", ""),
    ]


def test_answers_shaped_for_display(spark):
    pad = "word " * 40
    cases = [
        ("comparison", f"A and B differ. {pad}. Only A. A and B differ.", None), ("comparison", f"Nothing named. {pad}", None), ("comparison", "A and B differ.", None), ("pros_cons", f"It has a benefit. However it is bad. A good drawback. {pad}", None),
        ("steps", f"1. Open it\n2) \nthen rest\nFinally, close it {pad}", None), ("summary", f"One. Two. {pad}. Last!", None), ("timeline", pad, None), ("comparison", f"A and B differ. {pad}", "step_list"), (None, None, None), ("definition", "short", "definition_block"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, f string, a string, g string").orderBy("i")
    got = [r.d for r in df.select(display.shaped_display(F.col("a"), F.col("f"), F.array(F.lit("a"), F.lit("b")), F.col("g")).alias("d")).collect()]
    assert [d.type for d in got] == ["comparison_table", "prose", "prose", "pros_cons_table", "step_list", "summary_block", "prose", "step_list", "prose", "definition_block"]
    assert [(r.name, r.cells) for r in got[0].rows] == [("A and B differ", ["A and B differ."] * 2)] and got[7].rows is None
    assert (got[3].pros, got[3].cons) == (["It has a benefit.", "A good drawback."], ["However it is bad."])
    assert [(x.number, x.detail) for x in got[4].steps] == [(1, "Open it"), (3, f"Finally, close it {pad.strip()}")]
    assert got[5].tldr == "One." and got[5].key_points[0] == "Two." and got[5].conclusion == "Last!"


def test_given_displays_are_validated(spark):
    schema = "i int, d struct<type:string,features:array<string>,entities:array<string>,pros:array<string>,cons:array<string>,steps:array<string>>"
    cases = [("comparison_table", ["f"], ["e"], None, None, None), ("comparison_table", ["f"], [], None, None, None), ("pros_cons_table", None, None, [], ["c"], None), ("step_list", None, None, None, None, []), ("stats_table", None, None, None, None, None), ("other", None, None, None, None, None), (None, None, None, None, None, None)]
    df = spark.createDataFrame(list(enumerate(cases)), schema).orderBy("i")
    fields = {x: x for x in ("features", "entities", "pros", "cons", "steps")}
    assert [r.v for r in df.select(display.is_valid_display(F.col("d"), fields).alias("v")).collect()] == [True, False, True, False, True, False, False]

import re
from collections import Counter

import numpy as np
import pytest

from passagework.llm.decontaminate import _indexes, _Items, benchmark_items, candidate_steps, contaminated, drop_contaminated
from passagework.llm.words import NON_ALPHANUMERIC, Words

A = [f"alpha{i}" for i in range(20)]
B = [f"beta{i}" for i in range(14)]


def brute(docs, items, k=5):
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda w: Counter([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else []))
    out = {}
    for doc, text in docs:
        w = words(text)
        for item, body in items:
            v = words(body)
            if not v or not w or doc is None:
                continue
            want, found = runs(v), []
            for i in range(max(1, len(w) - len(v) + 1)):
                have = runs(w[i : i + len(v)])
                both, either = sum((want & have).values()), sum((want | have).values())
                if 100 * both >= 80 * either:
                    found.append((both / either, -i))
            if found:
                best = max(found)
                out[doc, item] = (-best[1], pytest.approx(best[0]))
    return out


def rows(df):
    return {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in df.collect()}


def test_planted_passages(spark):
    filler = [f"w{i * i % 97}" for i in range(300)]
    docs = [
        (1, " ".join(filler[:50] + A + filler[50:90])),
        (2, " ".join(filler[:7] + A[:10] + ["new"] + A[10:] + filler)),  # one word more
        (3, " ".join(B).upper() + "."),
        (4, " ".join(A[:10])),
        (5, None),
        (6, ""),
        (None, " ".join(A)),
        (7, ", ".join(A + filler + A)),
        (8, " ".join(filler)),
        (9, "one two three"),
        (9, "one two three"),
    ]
    items = [(1, " ".join(A)), (2, " ".join(B)), (3, None), (4, ""), (5, "one two three"), (6, " ".join(["same"] * 9))]
    docs.append((10, " ".join(["same"] * 30)))
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id", "1 as key")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' as doc_id")
    assert rows(contaminated(d, i)) == brute(docs, items)


def test_short_items_in_longer_texts(spark):
    docs = [(1, "so it is one two three and one two three"), (2, "one two three four"), (3, "two three"), (4, "yes " * 40), (5, "one two, Three"), (6, "x y z u v w four")]
    items = [(1, "one two three"), (2, "yes"), (3, "two three four five"), (4, "u v w four"), (5, "it is"), (6, " ".join(A))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(contaminated(d, i)) == brute(docs, items)


def test_several_texts_of_one_id(spark):
    """Both share a run with the item at the same place; only one of them holds it."""
    clean = " ".join(A[:5] + [f"other{i}" for i in range(15)])
    docs = [(d, t) for d in range(20) for t in ((clean, " ".join(A)) if d % 2 else (" ".join(A), clean))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame([(1, " ".join(A))], "item_id long, text string")
    assert rows(contaminated(d, i)) == {(d, 1): (0, 1.0) for d in range(20)}


def test_benchmark_in_parts(spark, monkeypatch):
    monkeypatch.setattr("passagework.llm.decontaminate.MOST_SHINGLES", 7)
    docs = [(1, " ".join(["x"] * 9 + A + ["y"] + B)), (2, " ".join(A[:8]))]
    items = [(i, " ".join(A if i % 2 else B)) for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(contaminated(df, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_windows_in_steps(spark, monkeypatch):
    monkeypatch.setattr("passagework.llm.decontaminate.STEP", 40)
    docs = [(1, " ".join(["x"] * 9 + A + ["y"] + B + A)), (2, " ".join(A[:8])), (3, "same " * 200), (4, " ".join(A[:19] + ["z"]))]
    items = [(i, " ".join(A if i % 2 else B)) for i in range(4)] + [(9, "same " * 30)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(contaminated(d, i)) == brute(docs, items)


def test_very_long_text_of_one_word(spark):
    d = spark.createDataFrame([(1, "same " * 200_000), (2, "x " * 300_000 + " ".join(A))], "doc_id long, text string")
    i = spark.createDataFrame([(1, "same " * 30), (2, " ".join(A))], "item_id long, text string")
    assert rows(contaminated(d, i)) == {(1, 1): (0, 1.0), (2, 2): (300_000, 1.0)}
    assert drop_contaminated(d, i).count() == 0


def test_candidates_follow_shared_runs_not_the_benchmark(spark):
    """The candidate pairs of some texts stay the same as the benchmark grows tenfold."""
    rng = np.random.default_rng(3)
    item = lambda i: " ".join(f"q{x}" for x in rng.integers(0, 50_000, 30)) if i else " ".join(A)
    texts = [item(i) for i in range(500)]
    doc = (" ".join(["x"] * 50 + A + ["y"] * 50 + texts[40].split()[:28])).encode()
    words, counts = Words(np.frombuffer(doc, np.uint8), np.array([0, len(doc)]), NON_ALPHANUMERIC), []
    for n in (50, 500):
        items = _Items.of(benchmark_items(spark.createDataFrame(list(enumerate(texts[:n])), "item_id long, text string"), 5, "item_id", "text").toArrow())
        counts.append([len(pairs) for index in _indexes(items, 5) for pairs, *_ in candidate_steps(words, index, 5)])
    assert counts[0] == counts[1] == [2]


def test_rows_are_dropped_by_their_own_text(spark):
    leak, fine = " ".join(["x"] * 4 + A), "nothing to see here at all"
    docs = [(None, leak, 1), (None, fine, 2), (7, leak, 3), (7, fine, 4), (8, leak, 5), (8, leak, 6), (9, None, 7), (10, "", 8)]
    items = [(None, " ".join(A)), (1, " ".join(B)), (2, None), (3, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    assert {r.item_id for r in drop_contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()} == {2, 4, 7, 8}
    assert drop_contaminated(d, spark.createDataFrame([], "item_id long, text string")).count() == 8


def test_empty_tables(spark):
    some = spark.createDataFrame([(1, " ".join(A))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, item_id long, text string")
    item = some.withColumnRenamed("doc_id", "item_id")
    assert contaminated(none, item).count() == 0
    assert contaminated(some, none).count() == 0


def test_all_windows_of_given_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    short = [(d, t) for d, t in docs if len(t) < 2500][:80]
    d = spark.createDataFrame(short, "doc_id long, text string")
    assert rows(contaminated(d, bench)) == brute(short, items)

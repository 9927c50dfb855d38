"""A saved index that changes by segments: the same answers as over the chunks themselves, generation by generation."""

import os
import random

import pytest
from pyspark.sql import functions as F

from passagework.operators import cells, corpus_index as C
from passagework.operators.conversation import cache_hits
from passagework.operators.search import bm25_topk, bm25_topk_blocks, dense_topk

SCHEMA = "chunk_id long, document_id string, parent_id string, node_type string, level int, text string"
WORDS = ["the", "a", "of"] + [f"w{i}" for i in range(60)]


def made(ids, seed=1, document=None, kind=None):
    rng = random.Random(seed)
    weights = [30, 20, 10] + [60 / (i + 3) for i in range(60)]
    return [(i, document or f"d{i % 5}", None, kind or ["raw", "parent"][i % 2], 0, " ".join(rng.choices(WORDS, weights, k=rng.randrange(0, 40)))) for i in ids]


def vectors_of(spark, ids, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 4) for _ in range(8)] for _ in range(20)]
    return spark.createDataFrame([(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for i in ids], "chunk_id long, vector array<double>")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "w1 the w2"), (2, "w9 w9 a"), (3, "the of"), (4, "nothing known"), (5, "w40 w41 w42 the"), (6, None), (7, "The, W5!")], "query_id long, query string")


def same_lists(one, two):
    rows = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 8)) for r in df.collect())
    assert rows(one) == rows(two)


def listing(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names}


def test_changes_write_only_segments(spark, tmp_path, queries):
    folder = str(tmp_path / "index")
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    rows = {r[0]: r for r in made(range(300))}
    index = C.insert(C.open_index(spark, folder), frame(list(rows.values())).repartition(3))

    def check(index):
        want = frame(list(rows.values()))
        for kinds in (None, ["raw"]):
            same_lists(bm25_topk_blocks(index, queries, 7, kinds=kinds), bm25_topk(want, queries, 7, kinds=kinds))
        assert sorted(r["chunk_id"] for r in index.chunks.collect()) == sorted(rows)
        assert index.world == (len(rows), sum(len((r[5] or "").split()) for r in rows.values()))

    check(index)
    opened, before = index, listing(folder)
    new = made(range(290, 340), seed=2)
    index = C.insert(index, frame(new))
    rows |= {r[0]: r for r in new if r[0] not in rows}
    check(index)
    new = [*made(range(0, 30), seed=3), *made(range(400, 410), seed=4), (500, "d9", None, "raw", 0, None), (501, None, None, "raw", 0, "the w1 w1")]
    index = C.upsert(index, frame(new))
    rows |= {r[0]: r for r in new}
    check(index)
    index = C.delete_document(index, "d3")
    rows = {i: r for i, r in rows.items() if r[1] != "d3"}
    check(index)
    index = C.upsert(index, frame(made(range(0, 5), seed=5)))  # replaced for the second time
    rows |= {r[0]: r for r in made(range(0, 5), seed=5)}
    check(index)
    new = made([1000, 1001, 11], seed=6, document="d1")
    index = C.reindex_document(index, "d1", frame(new))
    rows = {i: r for i, r in rows.items() if r[1] != "d1" and i != 11} | {r[0]: r for r in new}
    check(index)
    after = listing(folder)
    assert {f: after.get(f) for f in before} == before and index.generation == 6
    assert C.open_index(spark, folder) == index and C.open_index(spark, folder, 1) == opened
    same_lists(bm25_topk_blocks(opened, queries, 5), bm25_topk(frame(made(range(300))), queries, 5))  # pinned
    index = C.compact(index)
    check(index)
    assert len(index.segments) == 1 and C.vacuum(spark, folder, 2) == [] and len(C.vacuum(spark, folder)) == 6
    check(C.open_index(spark, folder))


def test_a_slower_writer_fails(spark, tmp_path):
    """Two writers from one generation: the second one's manifest isn't written, and the first one's stands."""
    folder = str(tmp_path / "index")
    start = C.insert(C.open_index(spark, folder), spark.createDataFrame(made(range(5)), SCHEMA))
    first = C.insert(start, spark.createDataFrame(made([10]), SCHEMA))
    with pytest.raises(Exception, match="FileAlreadyExists"):
        C.insert(start, spark.createDataFrame(made([11]), SCHEMA))
    assert C.open_index(spark, folder) == first and 11 not in [r["chunk_id"] for r in first.chunks.collect()]


def test_blocks_below_the_kth_score_are_passed_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 8)
    rows = [(i, "d", None, "raw", 0, "the of " * (1 + i % 4) + (f"rare{i // 8} " * (1 + i % 3) if i % 5 == 0 else "filler words")) for i in range(800)]
    chunks = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    index = C.insert(C.open_index(spark, str(tmp_path / "index")), chunks)
    queries = spark.createDataFrame([(i, f"the of rare{i} rare{i + 1}") for i in range(20)], "query_id long, query string")
    report = []
    got = bm25_topk_blocks(index, queries, 3, report=report)
    same_lists(got, bm25_topk(chunks, queries, 3))
    (pairs, scored), = report
    assert pairs == 20 * 100 and scored < 0.2 * pairs


def test_vectors_by_cells(spark, tmp_path):
    folder, ids = str(tmp_path / "index"), list(range(2000))
    chunks, vectors = spark.createDataFrame(made(ids), SCHEMA), vectors_of(spark, ids).unionByName(spark.createDataFrame([(3, None)], "chunk_id long, vector array<double>"))
    index = C.insert(C.open_index(spark, folder), chunks, vectors)
    asked = vectors.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    report = []
    same_lists(cells.dense_topk_cells(index, asked, 10, report=report), dense_topk(vectors, asked, 10))
    sizes = {r["cell"]: r["n"] for r in index.table("cells").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    compared = sum(sizes[c] * n for c, n in report[1].items())
    assert compared < 0.4 * 2000 * asked.count()  # the share of rows that the cells leave
    kinds = vectors.join(chunks.where("node_type = 'raw'").select("chunk_id"), "chunk_id")
    same_lists(cells.dense_topk_cells(index, asked, 5, ["raw"]), dense_topk(kinds, asked, 5))
    index = C.upsert(index, spark.createDataFrame(made(range(100), seed=9), SCHEMA), vectors_of(spark, range(100), seed=4))
    index = C.delete_document(index, "d2")
    left = vectors.where("chunk_id >= 100").unionByName(vectors_of(spark, range(100), seed=4)).join(index.chunks.select("chunk_id"), "chunk_id")
    same_lists(cells.dense_topk_cells(index, asked, 10), dense_topk(left, asked, 10))
    same_lists(cells.dense_topk_cells(C.compact(index), asked, 10), dense_topk(left, asked, 10))


def test_equal_vectors_and_few_rows(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [1.0, 2.0] if i < 40 else [float(i), 0.0]) for i in range(45)], "chunk_id long, vector array<double>")
    index = C.insert(C.open_index(spark, str(tmp_path / "index")), spark.createDataFrame(made(range(45)), SCHEMA), vectors)
    asked = spark.createDataFrame([(1, [1.0, 2.0]), (2, [44.0, 0.1]), (3, None)], "query_id long, vector array<double>")
    for k in (1, 7, 100):
        same_lists(cells.dense_topk_cells(index, asked, k), dense_topk(vectors, asked, k))


def test_generations_summaries_and_kept_answers(spark, tmp_path, queries):
    """A tree's summaries join both indexes in one step; a reader from before has neither, and kept answers of before no longer hit."""
    folder = str(tmp_path / "index")
    old = C.insert(C.open_index(spark, folder), spark.createDataFrame(made(range(60)), SCHEMA), vectors_of(spark, range(60)))
    summaries = spark.createDataFrame([(900 + i, "d0", None, "summary", 1 + i % 2, f"w1 w2 summary{i}") for i in range(8)], SCHEMA)
    new = C.insert(old, summaries, vectors_of(spark, range(900, 908), seed=7))
    hits = lambda index: {r["chunk_id"] for r in bm25_topk_blocks(index, queries, 10, kinds=["summary"]).collect()}
    assert hits(new) == set(range(900, 908)) and hits(old) == set()
    asked = vectors_of(spark, range(900, 902), seed=7).withColumnRenamed("chunk_id", "query_id")
    near = lambda index: {r["chunk_id"] for r in cells.dense_topk_cells(index, asked, 3, ["summary"]).collect()}
    assert near(new) and near(new) <= set(range(900, 908)) and near(old) == set()
    requests = spark.createDataFrame([(1, "q", old.generation, 0.0), (2, "q", old.generation, 5.0), (3, "q", new.generation, 6.0), (4, "q", new.generation, 7.0)], "request_id long, key string, generation long, timestamp double")
    assert {r["request_id"]: r["hit"] for r in cache_hits(requests).collect()} == {1: False, 2: True, 3: False, 4: True}

"""A failing or hanging arm gives an empty list and a flag; a failing reranking keeps the fused order."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from passagework.operators import corpus_index as C
from passagework.operators.providers import hash_embedder
from passagework.plans import retrieval
from passagework.plans.retrieval import Corpus
from passagework.plans.watched import Watch

SCHEMA = "chunk_id long, document_id string, parent_id string, node_type string, level int, text string"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    rows = [(i, f"d{i % 7}", None, "raw", 0, f"solar panels on roofs {['heat', 'cost', 'storm', 'grid'][i % 4]} number{i}") for i in range(40)]
    rows += [(100 + i, f"d{i}", None, "summary", 1, f"summary of roofs and heat number{i}") for i in range(3)]
    folder = str(tmp_path_factory.mktemp("arms"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    hash_embedder(chunks, "text").select("chunk_id", "vector").write.parquet(f"{folder}/vectors")
    asked = spark.createDataFrame([(1, "which panels are hurt by heat and which by storm, compared by cost"), (2, "what is the cost of number3")], "query_id long, query string")
    return chunks, spark.read.parquet(f"{folder}/vectors"), asked


def failing(rows, text):
    raise ConnectionError("no model here")


def failing_in_tasks(rows, text):
    def run(frames):
        for _ in frames:
            raise ConnectionError("no model in the task")
        yield pd.DataFrame()

    return rows.select("query_id", "query").mapInPandas(run, "query_id long, query string, vector array<double>")


def hanging(rows, text):
    def run(frames):
        for _ in frames:
            time.sleep(600)
        yield pd.DataFrame()

    return rows.select("query_id", "query").mapInPandas(run, "query_id long, query string, vector array<double>")


def lists(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("embed", [failing, failing_in_tasks])
def test_failing_embedder(spark, parts, embed):
    chunks, vectors, asked = parts
    watch = Watch()
    got = retrieval._arms(Corpus(chunks, vectors, embed, watch=watch), asked, 5, 5)
    assert lists(got) == lists(retrieval._arms(Corpus(chunks, vectors), asked, 5, 5).where("list_id = 'a_bm25'"))
    assert watch.degraded == ["b_dense"] and {s.step: s.status for s in watch.statuses} == {"a_bm25": "ok", "b_dense": "failed"}
    assert "no model" in watch.table(spark).where("status = 'failed'").first()["error"]


def test_hanging_embedder(spark, parts):
    chunks, vectors, asked = parts
    watch, began = Watch(seconds=25.0), time.monotonic()
    got = retrieval._arms(Corpus(chunks, vectors, hanging, watch=watch), asked, 5, 5)
    assert {r["list_id"] for r in got.collect()} == {"a_bm25"} and time.monotonic() - began < 120
    assert {s.step: s.status for s in watch.statuses} == {"a_bm25": "ok", "b_dense": "timed out"}


def test_sound_arms_give_what_they_give_without_a_watch(spark, parts):
    chunks, vectors, asked = parts
    watch = Watch()
    assert lists(retrieval._arms(Corpus(chunks, vectors, watch=watch), asked, 5, 5, ["summary"])) == lists(retrieval._arms(Corpus(chunks, vectors), asked, 5, 5, ["summary"]))
    assert watch.degraded == []


def test_failing_reranker_keeps_the_order(spark, parts):
    chunks, vectors, asked = parts
    broken = F.udf(lambda q, t: 1 / 0, "double")
    watch = Watch()
    hits = chunks.where("chunk_id < 20").select("chunk_id", "document_id", "parent_id", "node_type", "text", F.lit(1).alias("query_id"), F.lit("heat").alias("query"), (F.col("chunk_id") + 1).cast("int").alias("rank"))
    got = retrieval._reranked(Corpus(chunks, vectors, score=broken, watch=watch), hits, 6, 10)
    assert [r["chunk_id"] for r in got.orderBy("rank").collect()] == list(range(6)) and watch.degraded == ["rerank"]
    whole = Watch()
    out = retrieval.retrieve_standard(Corpus(chunks, vectors, score=broken, watch=whole), asked, 3)
    assert out.groupBy("query_id").count().where("count = 3").count() == 2 and whole.degraded == ["rerank"]


def test_paths_on_a_saved_index(spark, parts, tmp_path):
    """The three paths give the same from a saved generation as from the tables."""
    chunks, vectors, asked = parts
    asked = asked.unionByName(spark.createDataFrame([(3, "roofs"), (4, "give an overall summary of the whole document about roofs and heat")], asked.schema))
    index = C.insert(C.open_index(spark, str(tmp_path / "index")), chunks, vectors)
    one, two = (retrieval.retrieve(c, asked, 3).select("query_id", "rank", "chunk_id", "path") for c in (Corpus(chunks, vectors), Corpus.saved(index)))
    assert lists(one) == lists(two) and len(lists(two)) >= 9

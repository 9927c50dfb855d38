import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.functions import evidence, text as T
from passagework.operators import chunk, conversation, evaluate, index, pack, providers, rank, search, telemetry, tree
from passagework.plans import retrieval
from passagework.sources import readers
from passagework.streaming import live


def test_bm25_formula(spark):
    docs = ["the cat sat", "the dog sat on the mat", "a cat and a dog", "birds fly", "the the the"]
    words = [d.split() for d in docs]
    n, mean = len(docs), sum(map(len, words)) / len(docs)
    df = Counter(w for d in words for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if x < 0 else x for w, x in idf.items()}
    score = lambda q, d: sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in q)
    chunks = spark.createDataFrame([(i, d, "raw") for i, d in enumerate(docs)], "chunk_id long, text string, node_type string")
    got = search.bm25_topk(chunks, spark.createDataFrame([(0, "cat cat the unseen")], "query_id long, query string"), 3).orderBy("rank").collect()
    wanted = sorted(((score("cat cat the unseen".split(), d), -i) for i, d in enumerate(words)), reverse=True)[:3]
    assert [(r.chunk_id, pytest.approx(r.score)) for r in got] == [(-i, s) for s, i in wanted if s > 0]


def test_many_queries_go_in_parts(spark, monkeypatch):
    monkeypatch.setattr("passagework.operators.search.MOST_QUERIES", 4)
    x = np.random.default_rng(5).normal(size=(30, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    held = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in search.dense_topk(held, held.where("chunk_id < 15").withColumnRenamed("chunk_id", "query_id"), 3).collect()}
    near = ((x[:15, None] - x[None]) ** 2).sum(axis=2).argsort(axis=1)
    assert got == {(q, i + 1): near[q, i] for q in range(15) for i in range(3)}
    units = spark.createDataFrame([(i % 2, i, v.tolist()) for i, v in enumerate(x[:15])], "query_id long, unit long, vector array<double>")
    docs = spark.createDataFrame([(i % 5, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>")
    score = lambda q, d: (x[q:15:2] @ x[d::5].T).max(axis=1).mean()
    found = {(r.query_id, r.doc_id): r.score for r in search.maxsim_topk(docs, units, 5).collect()}
    assert found == {(q, d): pytest.approx(score(q, d)) for q in range(2) for d in range(5)}


def test_insert_twice_is_once(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, n int")
    once = index.insert_if_absent(rows.limit(0), rows)
    assert index.insert_if_absent(once, rows).count() == 2
    batches = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "k string, batch int, v string")
    assert [r.v for r in index.upsert_latest(batches, "k", F.col("batch")).collect()] == ["new"]


def test_index_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x y x", "raw"), ("b", "y", "parent")], "chunk_id string, text string, node_type string")
    index.save_index(str(tmp_path), rows)
    held = index.load_index(spark, str(tmp_path))
    assert {(r.term, r.chunk_id, r.tf) for r in held["postings"].collect()} == {("x", "a", 2), ("y", "a", 1), ("y", "b", 1)}
    assert {r.term: r.df for r in held["terms"].collect()} == {"x": 1, "y": 2}
    asked = spark.createDataFrame([(0, "x y"), (1, "z")], "query_id long, query string")
    plain, indexed = search.bm25_topk(rows, asked, 5), search.bm25_topk_indexed(held, asked, 5)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, indexed.collect()))


def test_rrf_floor(spark):
    lists = spark.createDataFrame([(0, "a", 1.0, 1, "both"), (0, "b", 1.0, 2, "both"), (0, "a", 1.0, 2, "one"), (0, "b", 1.1, 1, "strong")], "query_id long, list_id string, weight double, rank int, chunk_id string")
    got = {r.chunk_id: r.score for r in rank.weighted_rrf(lists).collect()}
    assert got == {"both": pytest.approx(1 / 121 + 1 / 122), "strong": pytest.approx(1.1 / 121)}


def test_diversity_is_the_greedy_choice(spark):
    rng = random.Random(0)
    hits, wanted = [], {}
    for q in range(40):
        docs, parents, taken, rest = defaultdict(int), defaultdict(int), [], []
        for i in range(rng.randint(1, 25)):
            d = rng.randint(0, 3)
            p = f"{d}-{rng.randint(0, 2)}"
            hits.append((q, f"c{i}", str(d), p, i + 1))
            if docs[d] < 3 and parents[p] < 2:
                docs[d] += 1
                parents[p] += 1
                taken.append(f"c{i}")
            else:
                rest.append(f"c{i}")
        wanted[q] = (taken + rest)[:6]
    df = spark.createDataFrame(hits, "query_id long, chunk_id string, document_id string, parent_id string, rank int")
    got = defaultdict(list)
    for r in rank.diversify(df, 6).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.chunk_id)
    assert got == wanted


def test_rerank_trigger(spark):
    rows = [(0, "q", s, i + 1) for i, s in enumerate((0.9, 0.85))] + [(1, "q", s, i + 1) for i, s in enumerate((0.9, 0.5))] + [(2, "compare", s, i + 1) for i, s in enumerate((0.9, 0.5))] + [(3, "q", 0.9, 1)]
    got = rank.needs_rerank(spark.createDataFrame(rows, "query_id long, query string, score double, rank int"))
    assert {r.query_id: r.needed for r in got.collect()} == {0: True, 1: False, 2: True, 3: False}


@pytest.mark.parametrize("cut", [chunk.CUTS[k][i] for k in chunk.CUTS for i in (0, 1)])
def test_pieces(cut):
    rng = random.Random(1)
    text = "".join(f"{i}{rng.choice(['word ', '-longer-word ', 'end. ', chr(10), 2 * chr(10), 'x' * 90 + ' '])}" for i in range(3000))
    pieces = chunk.split_text(text, cut)
    assert all(p == p.strip() and 0 < len(p) <= cut.size for p in pieces)
    at = -1
    for p in pieces:  # in order, and nothing but white space between what they cover
        found = text.find(p, max(0, at - cut.overlap - 200))
        assert found >= 0
        assert not text[at + 1 : found].strip() if found > at else True
        at = max(at, found + len(p) - 1)
    assert not text[at + 1 :].strip()


def test_chunks_of_a_page(spark):
    text = "It was a sentence. " * 500
    pages = spark.createDataFrame([("d", "f.txt", 1, text), ("e", "e", 1, None), ("e", "e", 2, " \n ")], "document_id string, source_file string, physical_page int, text string")
    rows = chunk.chunk_pages(pages).orderBy("chunk_index").collect()
    assert len({r.chunk_id for r in rows}) == len(rows) and [r.chunk_index for r in rows] == list(range(len(rows)))
    assert rows[0].node_type == "parent" and rows[0].chunk_id == "d_page_1_parent_0" and rows[1].parent_id == rows[0].chunk_id
    assert {r.doc_shape for r in rows} == {"prose"}


def test_shapes(spark):
    texts = ["SECTION 1\nx\nArticle II\ny", "1. First\n2. Second\n3.1 Third part", "    indented code", "∑ ∫ √ ≤ all here", "plain", " ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    shapes = [r.s for r in df.select(T.text_shape(F.col("t")).alias("s")).collect()]
    assert shapes == ["legal_clause", "numbered_spec", "code_heavy", "academic_dense", "prose", "empty", "empty"]
    units = df.limit(1).select(T.structural_units(F.col("t"), F.lit("legal_clause")).alias("u")).first().u
    assert units == ["SECTION 1\nx", "Article II\ny"]


def test_printed_pages(spark):
    texts = ["12\ntext", "text Page 7 of 9", "body\n- 33 -", "0\nbody", "no number"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r.p for r in df.select(T.printed_page(F.col("t"), F.lit(99)).alias("p")).collect()] == [12, 7, 33, 99, 99]


def test_html(spark):
    html = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav>menu</nav><!-- c --><p>One <b>two</b>  three</p>\n<p>4 &amp; 5</p><footer>f</footer></body></html>'
    pages = spark.createDataFrame([(0, html), (1, None), (2, "")], "i int, html string").unionByName(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select((F.col("page_id") + 10).cast("int").alias("i"), "html"))
    rows = pages.select("i", readers.html_text(F.coalesce("html", F.lit(""))).alias("a"), readers.html_text_builtin(F.col("html")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_percentiles_are_the_floor_index(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([rng.random() * 100, 5.0])) for g in "abc" for _ in range(rng.randint(1, 900))] + [("d", 1.0), (None, 2.0), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p50, r.p95) for r in telemetry.floor_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    values = defaultdict(list)
    for g, v in rows:
        if v is not None:
            values[g].append(v)
    assert got == {g: tuple(sorted(v)[int(len(v) * p)] for p in (0.5, 0.95)) for g, v in values.items()}


def test_platt_fit(spark):
    rng = np.random.default_rng(0)
    x = rng.choice([0.0, 0.2, 0.5, 0.8], 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(5 * x - 2)))).astype(float)
    a, b = 1.0, 0.0
    for _ in range(2000):
        gap = 1 / (1 + np.exp(-(a * x + b))) - y
        a, b = a - 0.1 * ((gap * x).mean() + 1e-4 * a), b - 0.1 * gap.mean()
    got = evaluate.fit_platt(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double"), "x", "y")
    assert got == (pytest.approx(a), pytest.approx(b))


def test_kept_answers(spark):
    rows = [(0, "q", 0, 0.0), (1, "q", 0, 900.0), (2, "q", 0, 901.0), (3, "q", 1, 902.0), (4, "q", 0, 1000.0), (5, "r", 0, 5.0)]
    got = conversation.cache_hits(spark.createDataFrame(rows, "request_id long, key string, generation long, timestamp double"))
    assert {r.request_id: r.hit for r in got.collect()} == {0: False, 1: True, 2: False, 3: False, 4: True, 5: False}


def test_references(spark):
    rows = [(1, 0, "tell me", "Tea"), (1, 1, "is it hot", None), (1, 2, "milk", "Milk"), (1, 3, "what about that", None), (2, 0, "is it so", None)]
    got = conversation.resolve_references(spark.createDataFrame(rows, "conv_id long, turn long, query string, concept string"))
    assert {(r.conv_id, r.turn): r.resolved for r in got.collect()} == {(1, 0): "tell me", (1, 1): "is it hot (context: Tea)", (1, 2): "milk", (1, 3): "what about that (context: Milk)", (2, 0): "is it so"}


def test_evidence(spark):
    rows = [("eigenvector", "c++ template library", "http://eigen.tuxfamily.org/x"), ("aws ec2", "EC2 is a service of AWS", "https://docs.aws.amazon.com/ec2")]
    df = spark.createDataFrame(rows, "c string, s string, u string")
    got = [r.v for r in df.select(evidence.evidence_score(F.array("c"), F.lit("definition"), F.col("s"), F.col("u")).alias("v")).collect()]
    assert got[0] < 20 and got[1] == 100
    urls = [(0, i, u) for i, u in enumerate(["http://a.com/1", "http://www.a.com/2", "http://b.com/1", "http://a.com/3"])]
    picked = evidence.diverse_sources(spark.createDataFrame(urls, "query_id int, rank int, url string"), 4).orderBy("position").collect()
    assert [r["rank"] for r in picked] == [0, 2, 1, 3]


def test_passages(spark):
    text = "Many people ask. Entropy is a measure of the disorder in a closed system today. It grows over time in nature. end"
    rows = spark.createDataFrame([(1, "what is entropy", text), (2, "what is entropy", "nothing to see")], "page_id long, query string, text string")
    assert [(r.page_id, r.passage, r.score) for r in evidence.best_passages(rows).collect()] == [(1, "Entropy is a measure of the disorder in a closed system today. It grows over time in nature.", 11)]


def test_packing(spark):
    rows = [(0, "what is tea", f"c{i}", "d", f"p{i // 2}", "raw", "prose", "tea " * (20 * (i + 1)), 1.0 - i / 10) for i in range(9)]
    hits = spark.createDataFrame(rows, "query_id long, query string, chunk_id string, document_id string, parent_id string, node_type string, doc_shape string, text string, score double")
    got = pack.pack_context(hits, max_tokens=400).orderBy("packed_rank").collect()
    assert got[0].chunk_id == "c0" and sum(r.n_tokens for r in got) <= 400 and len(got) <= 6
    assert len({r.chunk_id for r in got}) == len(got)


def test_tree(spark, tmp_path):
    topics = ["apple pear plum fruit juice", "engine wheel brake motor car", "sonnet rhyme verse poem stanza"]
    rows = [("doc", f"c{i:02d}", " ".join(random.Random(i).choices(topics[i % 3].split(), k=30))) for i in range(36)] + [("tiny", "t1", "one"), ("tiny", "t2", "two")]
    built = tree.build_tree(spark.createDataFrame(rows, "document_id string, chunk_id string, text string"), str(tmp_path))
    level1, children = built.nodes.where("level = 1").collect(), {}
    for e in built.edges.collect():
        children.setdefault(e.parent, []).append(e.child)
    assert {len({int(c[1:]) % 3 for c in children[r.chunk_id]}) for r in level1} == {1} and len(level1) >= 3
    assert {c for r in level1 for c in children[r.chunk_id]} == {f"c{i:02d}" for i in range(36)} and all(r.n_children == len(children[r.chunk_id]) for r in level1)
    assert all(len(r.text) <= providers.SUMMARY_CHARS for r in level1) and built.nodes.where("document_id = 'tiny'").count() == 2
    shown = {r.document_id: r.text for r in tree.render_mermaid(built).collect()}
    assert shown["doc"].startswith("graph TD") and shown["doc"].count(" --> ") == built.edges.count()
    assert tree.render_dot(built).count() == 2


def test_fingerprint_gathers_no_rows(spark):
    rows = spark.createDataFrame([(f"d{i % 3}", f"c{i}", f"text  {i}") for i in range(50)], "document_id string, chunk_id string, text string")
    got = tree.fingerprint(rows)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    held = {d: sorted(hashlib.sha256(f"c{i}\x00text {i}".encode()).hexdigest() for i in range(50) if i % 3 == d) for d in range(3)}
    assert {r.document_id: r.fingerprint for r in got.collect()} == {f"d{d}": hashlib.sha256(",".join(v).encode()).hexdigest()[:24] for d, v in held.items()}


def test_mixtures_of_all_rows(spark, monkeypatch):
    """A far group that the rows of least hashes miss is a cluster of its own, as in a fit on all rows."""
    rng = np.random.default_rng(4)
    ids = [r.i for r in spark.range(400).select(F.format_string("c%03d", "id").alias("i")).orderBy(F.xxhash64("i"), "i").collect()]
    x = rng.normal(size=(400, 3)) * 0.1
    x[200:, 0] += 5.0
    x[300:, 1] += 9.0
    nodes = spark.createDataFrame([("d", i, v.tolist()) for i, v in zip(ids, x, strict=True)], "document_id string, chunk_id string, vector array<double>")
    groups = lambda: sorted(sorted(r.c) for r in tree.soft_clusters(nodes).groupBy("cluster").agg(F.collect_list("chunk_id").alias("c")).collect())
    whole = groups()
    assert whole == sorted(map(sorted, (ids[:200], ids[200:300], ids[300:])))
    monkeypatch.setattr(tree, "FIT_ROWS", 260)
    assert groups() == whole


def test_retrieval_paths(spark):
    rows = [(i, "d", None if i % 3 else f"p{i}", "raw", 0, f"topic{i} alpha beta word{i}") for i in range(30)] + [(100, "d", None, "summary", 2, "topic3 overall view"), (101, "d", None, "summary", 1, "topic3 details")]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id string, parent_id string, node_type string, level int, text string")
    corpus = retrieval.Corpus(chunks, providers.hash_embedder(chunks.select("chunk_id", "text"), "text").select("chunk_id", "vector"))
    asked = spark.createDataFrame([(0, "what is topic7"), (1, "summarize topic3"), (2, "compare word5 and topic5")], "query_id long, query string")
    first = {r.query_id: (r.chunk_id, r.path) for r in retrieval.retrieve(corpus, asked, 3).where("rank = 1").collect()}
    assert first == {0: (7, "simple"), 1: (100, "global"), 2: (5, "multi_hop")}


def test_readers(spark, tmp_path):
    (tmp_path / "A File.txt").write_text("Page 4\nHello   there\n\n\n\nEnd")
    (row,) = readers.read_texts(spark, str(tmp_path / "A File.txt")).collect()
    assert row.text == "Page 4\nHello there\n\nEnd" and row.page_start == 4 and row.physical_page == 1 and "a" in row.document_id
    (again,) = readers.read_files(spark, str(tmp_path)).collect()
    assert again.text == row.text
    (tmp_path / "log.jsonl").write_text('{"timestamp": 5.0, "selected_agent": "math"}\n\nnot json\n{"selected_agent": null}\n')
    assert readers.read_log(spark, str(tmp_path / "log.jsonl"), readers.ROUTING_SCHEMA, 1.0).count() == 1
    readers.append_log(readers.read_log(spark, str(tmp_path / "log.jsonl"), readers.ROUTING_SCHEMA), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() >= 2
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3,4\n")
    assert readers.profile_csv(readers.read_csv(spark, str(tmp_path / "t.csv"))) == {"columns": ["a", "b"], "row_count": 2, "preview": [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]}


def test_streams(spark, tmp_path):
    rows = [(0, "q", 0, "2024-01-01 00:00:00"), (1, "q", 0, "2024-01-01 00:10:00"), (2, "q", 0, "2024-01-01 00:16:00"), (3, "r", 0, "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "request_id long, key string, generation long, ts string").selectExpr("request_id", "key", "generation", "cast(ts as timestamp) ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("request_id long, key string, generation long, ts timestamp").parquet(str(tmp_path / "in"))
    got = live.run_available(live.kept_answers(stream), str(tmp_path / "kept"))
    assert {r.request_id: r.hit for r in got.collect()} == {0: False, 1: True, 2: False, 3: False}
    load = live.run_available(live.sliding_load(stream.withColumn("tokens", F.lit(2))), str(tmp_path / "load"), "complete")
    assert load.where("key = 'q'").agg(F.sum("requests")).first()[0] == 18


def test_json_salvage(spark):
    texts = ['```json\n{"a": 1}\n```', 'so {"a": 2} it is', "nothing", None, '{"a": 3}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r.v and r.v.a for r in df.select(T.salvaged_json(F.col("t"), "a int").alias("v")).collect()] == [1, 2, None, None, 3]


def test_answer_checks(spark):
    row = spark.range(1).select(
        evidence.answer_check(F.lit("Entropy direct answer [1] " + "word " * 20), F.array(F.lit("Direct Answer")), F.lit("what is entropy?"), F.lit(2), F.lit("web_rag")).alias("a"),
        evidence.rewritten_query(F.lit("what is tea"), F.lit("It lacks Green Leaf and Green Leaf and Tea")).alias("b"), evidence.rewritten_query(F.lit("what is tea"), F.lit("nothing")).alias("c"),
    ).first()
    assert row.a.passed and row.b == "what is tea It Green Leaf"
    assert row.c == "is tea"

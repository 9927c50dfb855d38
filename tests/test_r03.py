"""Cases of the third round's findings."""

from __future__ import annotations

import math
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from passagework.functions import queries as Q
from passagework.functions import display
from passagework.operators import cells, corpus_index, evaluate, index, rank, search, tree
from passagework.plans import registry


def test_variants_cut_words_at_ascii_bounds(spark):
    asked = spark.createDataFrame([(0, "is it not a noñdo or ñno thing"), (1, "a vsñ b is better than ñvs c"), (2, "do NOT without")], "i long, q string")
    got = {r.i: r.v for r in asked.select("i", Q.variants(F.col("q")).alias("v")).collect()}
    assert got[0] == ["is it not a noñdo or ñno thing", "is it a ñdo or ñ thing"]
    assert "a versusñ b is better than ñversus c" in got[1]
    assert got[2] == ["do NOT without", "do"]


def test_summaries_of_equal_score_stand_by_id(spark):
    fused = spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
    found = spark.createDataFrame([(0, 7, 0, 244.90554603680287), (0, 3, 0, 244.9055460368028), (0, 5, 0, 245.0)], "query_id long, chunk_id long, level int, score double")
    got = rank.reserve_summaries(fused, found, 5).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [5, 3, 7]


def _score(docs, q, d, k1=1.5, b=0.75):
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for x in docs for w in set(x))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    return sum((idf[w] if idf[w] >= 0 else floor) * d.count(w) * (k1 + 1) / (d.count(w) + k1 * (1 - b + b * len(d) / mean)) for w in q if w in idf)


def test_bm25_makes_no_row_for_a_pair_of_chunk_and_query(spark, monkeypatch):
    """Sums of many blocks, cut within a block, and in parts of the queries, are those of the formula; the lists are written."""
    monkeypatch.setattr("passagework.operators.search.PAIRS", 7)
    monkeypatch.setattr("passagework.operators.search.CELLS", 40)
    monkeypatch.setattr("passagework.operators.search.MOST_QUERIES", 5)
    rng = random.Random(3)
    docs = [rng.choices("abcdefghijklmnopq", weights=range(17, 0, -1), k=rng.randint(0, 12)) for _ in range(120)] + [["a", "b"]] * 9
    asked = [rng.choices("abcdefghijklz", k=rng.randint(0, 5)) for _ in range(12)]
    chunks = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "chunk_id long, text string")
    queries = spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(asked)], "query_id long, query string")
    hits = search.bm25_topk(chunks, queries, 6)
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 6)) for r in hits.collect()}
    want = {}
    for i, q in enumerate(asked):
        best = sorted(((-round(_score(docs, q, d), 9), c) for c, d in enumerate(docs)))[:6]
        want |= {(i, n + 1): (c, round(-s, 6)) for n, (s, c) in enumerate(best) if s < 0}
    assert got == want


def test_blocks_and_saved_postings_score_by_chunk(spark, tmp_path):
    """Both give bm25_topk()'s rows, written, from postings that come together by chunk."""
    rng = random.Random(4)
    docs = [" ".join(rng.choices("abcdefghijklmnopq", k=rng.randint(1, 12))) for _ in range(700)]
    chunks = spark.createDataFrame([(i, "d", None, "raw", 0, d) for i, d in enumerate(docs)], "chunk_id long, document_id string, parent_id string, node_type string, level int, text string").repartition(3)
    queries = spark.createDataFrame([(i, " ".join(rng.choices("abcdefghij", k=3))) for i in range(8)], "query_id long, query string")
    want = sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in search.bm25_topk(chunks, queries, 5).collect())
    index.save_index(f"{tmp_path}/plain", chunks)
    saved = corpus_index.insert(corpus_index.open_index(spark, f"{tmp_path}/saved"), chunks)
    for hits in (search.bm25_topk_indexed(index.load_index(spark, f"{tmp_path}/plain"), queries, 5), search.bm25_topk_blocks(saved, queries, 5)):
        assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in hits.collect()) == want


def test_a_task_of_near_rows_holds_few_of_them():
    """What a task keeps follows queries and k, not queries times rows; the lists are brute force's."""
    rng = np.random.default_rng(8)
    x, asked, k = rng.normal(size=(6000, 8)), rng.normal(size=(600, 8)), 3
    x[10:40] = x[50]
    ids, far = np.arange(600), np.sqrt((x**2).sum(axis=1))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(6000)), pa.array(np.zeros(6000, np.int64)), pa.array(np.arange(6000)), pa.array(np.zeros(6000, np.int32)), pa.array(far), pa.array(list(x))], names=["chunk_id", "segment", "row", "cell", "to_pivot", "vector"])
    run = cells._near_batches(ids, asked, np.sqrt((asked**2).sum(axis=1))[:, None], {0: np.arange(600)}, np.full(600, np.inf), k)
    tracemalloc.start()
    out = pa.Table.from_batches(list(run(iter([batch])))).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = {q: [] for q in range(600)}
    for q, c, score in sorted(zip(out["query_id"], out["chunk_id"], out["score"], strict=True), key=lambda r: (r[0], -round(r[2], 9), r[1])):
        got[q].append(c)
    for q in range(600):
        score = np.round(1 / (1 + ((x - asked[q]) ** 2).sum(axis=1)), 9)
        assert got[q] == np.lexsort((np.arange(6000), -score))[:k].tolist()
    assert peak < 60_000_000


def test_no_question_or_none_known_gives_no_hits(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, None)], "chunk_id long, text string")
    for rows in ([], [(0, "zzz"), (1, None)]):
        queries = spark.createDataFrame(rows, "query_id long, query string")
        assert search.bm25_topk(chunks, queries, 3).count() == 0
    assert search.bm25_topk(chunks.limit(0), spark.createDataFrame([(0, "a")], "query_id long, query string"), 3).count() == 0


def test_an_index_shuffles_no_postings(spark, tmp_path):
    """A chunk's words stay where it is read: the index's postings are written without an exchange, and give the lists of bm25_topk()."""
    rng = random.Random(6)
    rows = [(i, f"d{i % 3}", None, "raw", 0, " ".join(rng.choices("abcdefghijklmnopq", k=rng.randint(0, 12))) if i % 50 else None) for i in range(600)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id string, parent_id string, node_type string, level int, text string").repartition(3)
    queries = spark.createDataFrame([(i, " ".join(rng.choices("abcdefghijz", k=3))) for i in range(8)], "query_id long, query string")
    saved = corpus_index.delete_document(corpus_index.insert(corpus_index.open_index(spark, f"{tmp_path}/saved"), chunks), "d1")
    held = {r.chunk_id: r for r in saved.table("postings").collect()}
    assert len(held) == 600
    for i, _, _, _, _, text in rows:
        assert dict(zip(held[i].terms, held[i].counts, strict=True)) == Counter((text or "").split())
    listed = lambda hits: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in hits.collect())
    assert listed(search.bm25_topk_blocks(saved, queries, 5)) == listed(search.bm25_topk(chunks.where("document_id <> 'd1'"), queries, 5))


def test_a_round_reads_a_block_once_for_all_models():
    """A task gives one row of sums a document, for all of its models, however many blocks it has."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    state = tree._packed(3, [(len(w), -np.inf, w, v, m) for w, m, v, _ in tree._fits(x[:20])])
    batch = pa.RecordBatch.from_arrays([pa.array(["d", "d"]), pa.array([[str(i) for i in range(20)]] * 2), pa.array([x[:20].ravel(), x[20:].ravel()], pa.list_(pa.float64())), pa.array([state] * 2, pa.list_(pa.float64()))], names=["document_id", "ids", "flat", "active"])
    (out,) = tree._sum_batches(iter([batch]))
    sums, at = np.array(out.column("sums")[0].as_py()), 0
    assert out.num_rows == 1
    for k, _, weights, variances, means in tree._unpacked(state):
        logs = tree._densities(x, weights, means, variances)
        share = np.exp(logs - tree._log_sum(logs)[:, None])
        want = np.concatenate([[40, tree._log_sum(logs).sum()], share.sum(axis=0), share.T @ (x**2).sum(axis=1), (share.T @ x).ravel()])
        assert np.allclose(sums[at : at + len(want)], want)
        at += len(want)
    assert at == len(sums)


def test_a_long_answer_is_compared_in_one_pass(spark):
    """The compared words are made once, not once a sentence: a text of 6,000 sentences, whose first words need a pass over all of it."""
    from passagework.functions.text import tokens

    text = " ".join(f"Alpha beats Beta in round {i} by far and wide." for i in range(6000))
    entities = F.slice(tokens(F.col("t")), 1, 2)
    rows = spark.createDataFrame([(text,)], "t string").select(display.comparison_rows(F.col("t"), entities).alias("r"))
    began = time.monotonic()
    (got,) = rows.collect()
    assert len(got.r) == display.MOST_ROWS and got.r[0].cells[0].startswith("Alpha beats") and got.r[0].cells[1] == got.r[0].cells[0]
    assert time.monotonic() - began < 60


def test_a_batch_cuts_and_embeds_its_texts_once(spark):
    """Three paths and their searches by kind read words and vectors that are written once; the embedder sees the chunks' texts once, and each search only its questions."""
    from passagework.operators import providers
    from passagework.plans import retrieval

    rows = [(i, "d", None if i % 3 else 100 + i, "raw", 0, f"topic{i} alpha beta word{i}") for i in range(30)] + [(100, "d", None, "summary", 2, "topic3 overall view"), (101, "d", None, "parent", 1, "topic3 details")]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id string, parent_id long, node_type string, level int, text string")
    corpus = retrieval.Corpus(chunks, providers.hash_embedder(chunks.select("chunk_id", "text"), "text").select("chunk_id", "vector"))
    once = corpus.once()
    assert "MapInArrow" not in once.vectors._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in once.words.held._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" in corpus.chunks.select(search.tokens(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    asked = spark.createDataFrame([(0, "topic7 word7"), (1, "topic3 view")], "query_id long, query string")
    for kinds in (None, ["summary"], ["raw", "parent"]):
        for arm in ("lexical", "dense"):
            one, two = (sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in getattr(c, arm)(asked, 4, kinds).collect()) for c in (corpus, once))
            assert one == two


def test_hits_go_to_their_chunks(spark, monkeypatch):
    """Texts are fetched where they lie; more hits than go to all tasks give the same."""
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "chunk_id long, text string")
    hits = spark.createDataFrame([(q, q * 3 + i, i + 1) for q in range(5) for i in range(4)], "query_id long, chunk_id long, rank int").groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    monkeypatch.setattr("passagework.operators.search.MOST_HITS", 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = search.with_chunks(hits, chunks)
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r.query_id, r["rank"], r.chunk_id, r.text) for r in got.collect())
        assert rows == [(q, i + 1, q * 3 + i, f"text {q * 3 + i}") for q in range(5) for i in range(4)]
        monkeypatch.setattr("passagework.operators.search.MOST_HITS", 19)
        more = search.with_chunks(hits, chunks)
        assert sorted((r.query_id, r["rank"], r.chunk_id, r.text) for r in more.collect()) == rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_verbatim_gold_shuffles_no_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"so the {w} brown fox number {i % 7} runs") for i, w in enumerate(["quick", "slow", "Quick"] * 9)], "doc_id long, text string")
    asked = [(0, "the quick brown fox"), (1, "fox number 3 runs"), (2, "brown"), (3, "no words such as these"), (4, "slow brown fox number 1")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    want = {(q, r.doc_id) for r in docs.collect() for q, a in asked if a in r.text}
    terms = index.statistics(docs.select(F.split("text", " ").alias("words")).withColumn("length", F.size("words")))[0].withColumn("term", F.lower("term")).groupBy("term").agg(F.sum("df").alias("df"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (20_000, 2):
            monkeypatch.setattr("passagework.operators.search.MOST_QUERIES", most)
            for known in (None, terms):
                got = evaluate.verbatim_gold(docs, queries, known)
                plan = got._jdf.queryExecution().executedPlan().toString()
                assert "hashpartitioning(doc_id" not in plan
                assert sorted((r.query_id, r.doc_id) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _lists_of(folder, spark, run):
    """Rows of a query of the registry on made-up texts, the two lists of a question by the formula, and (rows shuffled, distinct words of all texts): those must be fewer."""
    rng = random.Random(11)
    docs = [[f"w{rng.choices(range(24), weights=range(25, 1, -1))[0]}" for _ in range(rng.randint(8, 30))] for _ in range(3000)]
    asked = [[f"w{rng.randrange(26)}" for _ in range(rng.randint(2, 6))] + ["difference"] * (i == 3) for i in range(10)]
    text = [" ".join(d) for d in docs]
    spark.createDataFrame([(i, t, "en", f"s{i % 5}", len(t)) for i, t in enumerate(text)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(asked)], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")

    df, mean = Counter(w for d in docs for w in set(d)), sum(map(len, docs)) / len(docs)
    idf = {w: math.log(len(docs) - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else floor for w, x in idf.items()}
    counts = [Counter(d) for d in docs]

    def best(q, k, k1, b):
        scores = [(-round(sum(idf[w] * n[w] * (k1 + 1) / (n[w] + k1 * (1 - b + b * len(d) / mean)) for w in q if w in n), 9), i) for i, (d, n) in enumerate(zip(docs, counts, strict=True))]
        return [(i, -s) for s, i in sorted(scores)[:k] if s < 0]

    jvm = spark.sparkContext._jsc.sc()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        jvm.listenerBus().waitUntilEmpty(30_000)
        found = jvm.statusStore().stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    got = run(spark, str(folder)).collect()
    shuffled = sum(n for at, n in stages().items() if at not in before)
    return got, asked, best, (shuffled, sum(map(len, counts)))


def test_merged_lists_shuffles_fewer_rows_than_texts_have_words(spark, tmp_path):
    """both lists come from one pass that makes no row for a posting or for a pair of chunk and question."""
    got, asked, best, (shuffled, words) = _lists_of(tmp_path, spark, registry.merged_lists)
    want = []
    for i, q in enumerate(asked):
        one, two = ([c for c, _ in best(q, 20, *form)] for form in ((1.5, 0.75), (0.9, 0.4)))
        want += [(i, c, "one" if c in one else "two", n + 1) for n, c in enumerate(dict.fromkeys(one + two))]
    assert sorted((r.query_id, r["rank"], r.chunk_id, r.list_id) for r in got) == sorted((i, n, c, name) for i, c, name, n in want)
    assert 0 < shuffled < words / 2


def test_rrf_fusion_shuffles_fewer_rows_than_texts_have_words(spark, tmp_path):
    """what is fused is the two lists' 20 rows a question; nothing that grows with pairs of chunks and questions is shuffled."""
    got, asked, best, (shuffled, words) = _lists_of(tmp_path, spark, registry.rrf_fusion)
    want = []
    for i, q in enumerate(asked):
        sums, seen = Counter(), {}
        for name, weight, form in (("one", 1.25, (1.5, 0.75)), ("two", 1.0, (0.9, 0.4))):
            for n, (c, _) in enumerate(best(q, 20, *form), 1):
                sums[c] += weight / (120 + n)
                seen.setdefault(c, (name, n))
        kept = sorted((-round(s, 12), seen[c], c) for c, s in sums.items() if round(s, 12) >= 0.009)
        want += [(i, n, c, round(sums[c], 9)) for n, (_, _, c) in enumerate(kept, 1)]
    assert sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in got) == sorted(want)
    assert 0 < shuffled < words / 2


def test_rerank_triggers_shuffles_fewer_rows_than_texts_have_words(spark, tmp_path):
    """the triggers read ten hits a question, which one pass finds."""
    got, asked, best, (shuffled, words) = _lists_of(tmp_path, spark, registry.rerank_triggers)
    want = {}
    for i, q in enumerate(asked):
        hits = [s for _, s in best(q, 10, 1.5, 0.75)]
        if hits:
            want[i] = len(hits) > 1 and ("difference" in q or round(hits[0] - hits[1], 9) < 0.1)
    assert {r.query_id: r.needed for r in got} == want and len(set(want.values())) == 2
    assert 0 < shuffled < words / 2

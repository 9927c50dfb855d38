"""The retrieval paths against the same steps in plain Python, over lists that the searches give."""

import re

import pytest
from pyspark.sql import functions as F

from passagework.functions import queries as Q
from passagework.operators import providers
from passagework.operators.search import bm25_topk, dense_topk
from passagework.plans import retrieval

K = 3
QUESTIONS = [
    "what is topic7", "summarize topic3 overall", "compare word5 and topic5", "is topic9 not in group1 without word2", "why and how does group2 matter and what is word11",
    "who may ratify the treaty of group4", "CODE-12 \"topic4\"", "difference between group1 and group2 and which one has word3 and word6 and word9 and topic1", "overview of nothing known",
]


def _chunks():
    rows = []
    for i in range(60):
        kind = ("raw", "raw", "parent", "summary")[i % 4]
        rows.append((i, f"d{i % 5}", i - i % 4 + 2 if kind == "raw" else None, kind, i % 3 if kind == "summary" else 0, f"topic{i % 11} word{i % 13} group{i % 6} CODE-{i} text of its own number{i} " + "filler " * (i % 7)))
    return rows


def _words(text):
    return re.findall(r"\w+", text.lower())


def _rrf(lists, floor):
    """lists: (name, weight, [ids])."""
    score, seen = {}, {}
    for name, weight, ids in lists:
        for at, c in enumerate(ids, 1):
            score[c] = score.get(c, 0) + weight / (120 + at)
            seen[c] = min(seen.get(c, (name, at)), (name, at))
    kept = [c for c in score if round(score[c], 12) >= floor]
    return [(c, score[c]) for c in sorted(kept, key=lambda c: (-round(score[c], 12), seen[c]))]


def _merge(*lists):
    out = []
    for ids in lists:
        out += [c for c in ids if c not in out]
    return list(dict.fromkeys(out))


def _standard(query, told, how, chunk, search):
    f, route = told.f, told.route
    variants, big = told.variants, max(4 * K, 12)
    bm25_k, dense_k = (big, max(2 * K, 6)) if route in ("bm25", "dense") else (big, big)
    parents = how in ("multi_hop", "global") or f.is_comparative or f.has_negation or f.word_count >= 12
    raw, above, summaries, pool = [], [], [], []
    for v, text in enumerate(variants):
        weight = (1.0, 0.92, 0.85, 0.85)[v]
        arms = {
            "a_bm25": (search("bm25", text)[: bm25_k if route != "dense" else max(bm25_k // 2, 6)], told.weights.bm25),
            "b_dense": (search("dense", text)[: dense_k if route != "bm25" else max(dense_k // 2, 6)], told.weights.dense),
        }
        for part in ("raw", "parent"):
            for name, (ids, w) in arms.items():
                some = [c for c in ids if chunk[c][3] == part]
                if part == "raw":
                    raw.append((f"{v}_{name}", w * weight, some or ids))
                elif parents:
                    above.append((f"{v}_{name}", w * weight * 0.72, some))
        pool += [ids for _, _, ids in raw[-2:]] + [ids for _, _, ids in above[-2:] if parents]
        if told.summaries:
            for name, k in (("a_bm25", bm25_k), ("b_dense", dense_k)):
                ids = search(name[2:], text, "summary")[: max(k // 2, 6)]
                summaries.append((f"{v}_{name}", told.weights.dense * weight * 0.35, ids))
    ordered = _merge([c for c, _ in _rrf(raw, 0.009)], [c for c, _ in _rrf(above, 0.0063)]) or _merge(*pool)
    ordered = ordered[:30]
    top = sorted(_rrf(summaries, 0.0), key=lambda x: (-chunk[x[0]][4], -x[1], x[0]))[: max(3, K // 2)]
    ordered = _merge([c for c, _ in top], ordered)[:30]
    asked = set(_words(query))
    shared = lambda c: round(len(asked & set(_words(chunk[c][5]))) / len(asked), 9)
    ranked = sorted(ordered, key=lambda c: (-shared(c), ordered.index(c)))[: max(16, K)]
    picked, documents, sections = [], {}, {}
    for c in ranked:
        d, p = chunk[c][1], (chunk[c][1], chunk[c][2] if chunk[c][2] is not None else f"own{c}")
        if documents.get(d, 0) < 3 and sections.get(p, 0) < 2:
            picked.append(c)
            documents[d], sections[p] = documents.get(d, 0) + 1, sections.get(p, 0) + 1
    picked = (picked + [c for c in ranked if c not in picked])[:K]
    text = lambda c: chunk[chunk[c][2]][5] if (parents or told.summaries) and chunk[c][3] == "raw" else chunk[c][5]
    return [(c, text(c)) for c in picked]


@pytest.fixture(scope="module")
def world(spark):
    rows = _chunks()
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id string, parent_id long, node_type string, level int, text string")
    return rows, retrieval.Corpus(chunks, providers.hash_embedder(chunks.select("chunk_id", "text"), "text").select("chunk_id", "vector"))


def _searches(spark, corpus, texts):
    """A function (arm, text, kind) -> all hits in order."""
    asked, found = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string"), {}
    for kind in (None, "summary", "parent"):
        vectors = corpus.embed(asked, "query").select("query_id", "vector")
        for arm, hits in (("bm25", bm25_topk(corpus.chunks, asked, 500, kinds=[kind] if kind else None)), ("dense", dense_topk((corpus.of([kind]) if kind else corpus).vectors, vectors, 500))):
            for r in hits.orderBy("rank").collect():
                found.setdefault((arm, texts[r.query_id], kind), []).append(r.chunk_id)
    return lambda arm, text, kind=None: found.get((arm, text, kind), [])


def _told(asked, how):
    q = F.col("query")
    f, route = Q.features(q), Q.route(q)
    return asked.select("query_id", f.alias("f"), route.alias("route"), Q.variants(q).alias("variants"), Q.arm_weights(route, f).alias("weights"), Q.wants_summaries(route, f, F.lit(how)).alias("summaries")).collect()


@pytest.mark.parametrize("how", ["multi_hop", "global"])
def test_standard_path(spark, world, how):
    rows, corpus = world
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, query string")
    told = {r.query_id: r for r in _told(asked, how)}
    search = _searches(spark, corpus, sorted({v for r in told.values() for v in r.variants}))
    want = {i: _standard(query, told[i], how, rows, search) for i, query in enumerate(QUESTIONS)}
    got = {}
    for r in retrieval.retrieve_standard(corpus, asked.withColumn("how", F.lit(how)), K).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.context_text))
    assert got == want
    assert {r.route for r in told.values()} >= {"bm25", "dense", "hybrid"} and {r.summaries for r in told.values()} == ({True} if how == "global" else {True, False})


def test_fallbacks(spark, world):
    """Without raw chunks simple questions take all kinds; without summaries global ones take parents, without parents the standard path."""
    rows, corpus = world
    asked = spark.createDataFrame([(0, "what is topic7"), (1, "summarize topic3 overall")], "query_id long, query string")
    kinds = lambda hits: {r.node_type for r in hits.join(corpus.chunks.select("chunk_id", "node_type"), "chunk_id").collect()}
    only = lambda *names: retrieval.Corpus(corpus.chunks.where(F.col("node_type").isin(*names)), corpus.of(list(names)).vectors)
    assert kinds(retrieval.retrieve_simple(corpus, asked, K).select("chunk_id")) == {"raw"}
    assert retrieval.retrieve_simple(only("parent", "summary"), asked, K).groupBy("query_id").count().where(f"count = {K}").count() == 2
    for names, want in ((("raw", "parent", "summary"), {"summary"}), (("raw", "parent"), {"parent"}), (("raw",), {"raw"})):
        found = retrieval.retrieve_global(only(*names), asked, K)
        assert kinds(found.select("chunk_id")) == want and found.select("query_id").distinct().count() == 2
    assert retrieval.retrieve_global(corpus, asked.limit(0), K).count() == 0


def test_dispatch(spark, world):
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)) + [(20, "what is a vote threshold"), (21, None)], "query_id long, query string")
    path = {r.query_id: r.path for r in retrieval.retrieve(world[1], asked, K).collect()}
    assert path[0] == "simple" and path[1] == path[8] == "global" and path[2] == path[3] == path[5] == path[20] == "multi_hop"

"""Retrieval for a batch of queries: simple, global and standard paths over one corpus."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from passagework.functions import queries as Q
from passagework.functions.text import chunk_kind
from passagework.operators import rank
from passagework.operators.cells import dense_topk_cells
from passagework.operators.corpus_index import CorpusIndex
from passagework.operators.providers import Embedder, PairScorer, hash_embedder
from passagework.operators.search import CountedChunks, bm25_topk, bm25_topk_blocks, counted_chunks, dense_topk
from passagework.plans.shared import shared_folder
from passagework.plans.watched import Watch

PARENT_FLOOR = 0.0063


@dataclass(frozen=True)
class Corpus:
    """chunks: chunk_id (long), document_id, parent_id, node_type, level, text; vectors: chunk_id, vector.

    score: a pair scorer of (query, text) for reranking; None: the share of common words. words: see once(). index: a saved
    generation that the searches read instead of chunks and vectors. watch: runs each arm and the reranking as jobs of their own; an arm
    that fails or is late gives an empty list, a failing reranking leaves the order of before, and the watch tells.
    """

    chunks: DataFrame
    vectors: DataFrame
    embed: Embedder = hash_embedder
    score: PairScorer | None = None
    index: CorpusIndex | None = None
    watch: Watch | None = None
    words: CountedChunks | None = None

    def once(self) -> Corpus:
        """The same corpus with its words and vectors written, so that a batch's searches neither cut nor embed the texts again."""
        if self.index or self.watch:
            return self
        folder = shared_folder(self.chunks.sparkSession, "corpus")
        return replace(self, vectors=_kept(self.vectors, folder, "vectors"), words=counted_chunks(self.chunks, write=True))

    @staticmethod
    def saved(index: CorpusIndex, embed: Embedder = hash_embedder, score: PairScorer | None = None, watch: Watch | None = None) -> Corpus:
        """The chunks and vectors of a generation, searched by its postings and cells."""
        return Corpus(index.chunks, index.live("vectors").select("chunk_id", "vector"), embed, score, index, watch)

    def of(self, kinds: list[str]) -> Corpus:
        kept = self.chunks.where(F.col("node_type").isin(kinds))
        return replace(self, chunks=kept, words=None, vectors=self.vectors.join(kept.select("chunk_id"), "chunk_id", "left_semi"))

    def lexical(self, asked: DataFrame, k: int, kinds: list[str] | None) -> DataFrame:
        return bm25_topk_blocks(self.index, asked, k, kinds=kinds) if self.index else bm25_topk(self.words or self.chunks, asked, k, kinds=kinds)

    def dense(self, asked: DataFrame, k: int, kinds: list[str] | None) -> DataFrame:
        vectors = self.embed(asked.select("query_id", "query"), "query").select("query_id", "vector")
        if self.index:
            return dense_topk_cells(self.index, vectors, k, kinds)
        return dense_topk((self.of(kinds) if kinds else self).vectors, vectors, k)


def _kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df``, written and read again: later steps read hits, not searches."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _arms(corpus: Corpus, asked: DataFrame, bm25_k: int, dense_k: int, kinds: list[str] | None = None) -> DataFrame:
    """(query_id, list_id, rank, chunk_id): the lexical and the dense list of each row of (query_id, query). ``kinds`` restricts both before the cut."""
    named = lambda df, name: df.select("query_id", F.lit(name).alias("list_id"), "rank", "chunk_id")
    arms = {"a_bm25": lambda: named(corpus.lexical(asked, bm25_k, kinds), "a_bm25"), "b_dense": lambda: named(corpus.dense(asked, dense_k, kinds), "b_dense")}
    if corpus.watch is None:
        return arms["a_bm25"]().unionByName(arms["b_dense"]())
    spark = asked.sparkSession
    found = corpus.watch.run(spark, arms, lambda _: spark.createDataFrame([], f"query_id {dict(asked.dtypes)['query_id']}, list_id string, rank int, chunk_id long"))
    return found["a_bm25"].unionByName(found["b_dense"])


def _reranked(corpus: Corpus, hits: DataFrame, k: int, pool: int) -> DataFrame:
    """rank.rerank() with the corpus' scorer; where that fails under a watch, the first k in the order of before, without scores."""
    score = corpus.score(F.col("query"), F.col("text")) if corpus.score else None
    if corpus.watch is None:
        return rank.rerank(hits, k, score, pool)
    order = lambda _: hits.where(F.col("rank") <= k).withColumn("rerank_score", F.lit(None).cast("double"))
    return corpus.watch.run(hits.sparkSession, {"rerank": lambda: rank.rerank(hits, k, score, pool)}, order)["rerank"]


def _with_text(corpus: Corpus, hits: DataFrame) -> DataFrame:
    return hits.join(corpus.chunks.select("chunk_id", "document_id", "parent_id", "node_type", "text"), "chunk_id")


def _raw_or_all(lists: DataFrame, *by: str) -> DataFrame:
    """The raw chunks of each list (columns ``by`` and kind); a list without any stays whole."""
    has_raw = F.max(F.col("kind") == "raw").over(Window.partitionBy(*by))
    return lists.withColumn("_has_raw", has_raw).where("kind = 'raw' or not _has_raw").drop("_has_raw")


def _kinds(corpus: Corpus, lists: DataFrame) -> DataFrame:
    return lists.join(corpus.chunks.select("chunk_id", chunk_kind(F.col("node_type")).alias("kind"), F.coalesce("level", F.lit(0)).alias("level")), "chunk_id")


def retrieve_simple(corpus: Corpus, asked: DataFrame, k: int = 5) -> DataFrame:
    """Raw chunks of both lists, or all chunks of a list without raw ones, fused; the chunks' own text."""
    lists = _raw_or_all(_kinds(corpus, _arms(corpus, asked, max(3 * k, 12), max(3 * k, 12))), "query_id", "list_id")
    fused = rank.weighted_rrf(lists.withColumn("weight", F.lit(1.0)), floor=0.0).where(F.col("rank") <= k)
    return _with_text(corpus, fused).withColumn("context_text", F.col("text"))


def _highest(corpus: Corpus, asked: DataFrame, kind: str, k: int) -> DataFrame:
    """Chunks of one kind in both lists, fused, higher levels first."""
    lists = _arms(corpus, asked, max(4 * k, 12), max(4 * k, 12), [kind]).withColumn("weight", F.lit(1.0))
    fused = rank.weighted_rrf(lists, floor=0.0).join(corpus.chunks.select("chunk_id", "level"), "chunk_id")
    return rank.reserve_summaries(fused.limit(0), fused, 2 * k, k)


def retrieve_global(corpus: Corpus, asked: DataFrame, k: int = 5) -> DataFrame:
    """Summaries, else parents, else the standard path, for each query that the step before has no hit for."""
    folder = shared_folder(asked.sparkSession, "global")
    out, left = None, asked
    for kind in ("summary", "parent"):
        found = _kept(_highest(corpus, left, kind, k), folder, kind)
        out = found if out is None else out.unionByName(found)
        left = _kept(left.join(found.select("query_id"), "query_id", "left_anti"), folder, f"without-{kind}")
        if left.isEmpty():
            break
    columns = ["query_id", "chunk_id", "rank", "score", "document_id", "context_text"]
    out = _with_text(corpus, out).withColumn("context_text", F.col("text")).select(columns)
    return out if left.isEmpty() else out.unionByName(retrieve_standard(corpus, left.withColumn("how", F.lit("global")), k).select(columns))


def _searched_lists(corpus: Corpus, told: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(lists of all kinds, lists of summaries): (query_id, v, list_id, rank, chunk_id, kind, level, and the query's columns).

    The variants of all queries are one batch of searches to the largest budget; a query's own budget cuts its lists.
    The arm that is not the route's own gets half.
    """
    variants = told.select("query_id", F.posexplode(Q.variants(F.col("query"))).alias("v", "text"))
    searched = variants.select((F.col("query_id") * 8 + F.col("v")).alias("query_id"), F.col("text").alias("query"))
    most = max(4 * k, 12)
    half = lambda x: F.greatest(F.floor(x / 2), F.lit(6))
    bm25, dense = F.col("budget.bm25"), F.col("budget.dense")
    own = F.when(F.col("list_id") == "a_bm25", F.when(F.col("route") == "dense", half(bm25)).otherwise(bm25)).otherwise(F.when(F.col("route") == "bm25", half(dense)).otherwise(dense))

    def cut(lists: DataFrame, budget: Column) -> DataFrame:
        lists = lists.withColumn("v", (F.col("query_id") % 8).cast("int")).withColumn("query_id", F.floor(F.col("query_id") / 8))
        return lists.join(told.drop("query", "f"), "query_id").where(F.col("rank") <= budget)

    summaries = searched.join(told.where("summaries").select("query_id"), F.floor(searched["query_id"] / 8) == told["query_id"], "left_semi")
    by_kind = cut(_arms(corpus, searched, most, most), own)
    of_summaries = cut(_arms(corpus, summaries, most, most, ["summary"]), half(F.when(F.col("list_id") == "a_bm25", bm25).otherwise(dense)))
    return _kinds(corpus, by_kind), _kinds(corpus, of_summaries)


def retrieve_standard(corpus: Corpus, asked: DataFrame, k: int = 5) -> DataFrame:
    """Every variant of a query against both lists by its route's weights and budgets; fused, reranked, diversified, with parents' text.

    asked: query_id (long), query, and how it is to be searched if known. Raw chunks (all of a list without raw ones) and,
    where the query asks for context, parents are fused apart, raw ones first. Without any over the floors, all
    candidates stand in the order found. Queries that want summaries have the best of these in front. 30 candidates
    are reranked.
    """
    folder, how = shared_folder(asked.sparkSession, "standard"), F.col("how") if "how" in asked.columns else F.lit("multi_hop")
    told = asked.select("query_id", "query", Q.features(F.col("query")).alias("f"), Q.route(F.col("query")).alias("route"), how.alias("how"))
    told = told.withColumn("weights", Q.arm_weights(F.col("route"), F.col("f"))).withColumn("budget", Q.budgets(F.col("route"), k))
    wide = F.col("how").isin("multi_hop", "global") | F.col("f.is_comparative") | F.col("f.has_negation") | (F.col("f.word_count") >= 12)
    told = told.withColumn("parents", wide).withColumn("summaries", Q.wants_summaries(F.col("route"), F.col("f"), F.col("how")))
    told = _kept(told, folder, "told")
    lists, summary_lists = (_kept(x, folder, name) for x, name in zip(_searched_lists(corpus, told, k), ("lists", "summary-lists"), strict=True))

    arm = F.when(F.col("list_id") == "a_bm25", F.col("weights.bm25")).otherwise(F.col("weights.dense")) * rank.variant_weight(F.col("v"))
    raw = _raw_or_all(lists, "query_id", "v", "list_id").withColumn("weight", arm).withColumn("pool", F.lit(0))
    parents = lists.where("parents and kind = 'parent'").withColumn("weight", arm * rank.PARENT_WEIGHT).withColumn("pool", F.lit(1))
    named = lambda df: df.select("query_id", F.concat("v", F.lit("_"), "list_id").alias("list_id"), "weight", "rank", "chunk_id")
    fused = rank.weighted_rrf(named(raw)).withColumn("list_id", F.lit(0)).unionByName(rank.weighted_rrf(named(parents), floor=PARENT_FLOOR).withColumn("list_id", F.lit(1)))
    pool = raw.unionByName(parents).select("query_id", F.concat("v", "pool", "list_id").alias("list_id"), "rank", "chunk_id", F.lit(0.0).alias("score"))
    ordered = rank.merge_first(fused).select("query_id", "chunk_id", "score", "rank")
    ordered = _kept(ordered.unionByName(rank.merge_first(pool).join(fused.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "chunk_id", "score", "rank")), folder, "ordered")
    ordered = ordered.where(F.col("rank") <= rank.MOST_FUSED)
    weight = F.col("weights.dense") * rank.variant_weight(F.col("v")) * rank.SUMMARY_WEIGHT
    summaries = rank.weighted_rrf(named(summary_lists.withColumn("weight", weight)), floor=0.0).join(corpus.chunks.select("chunk_id", F.coalesce("level", F.lit(0)).alias("level")), "chunk_id")
    hits = _with_text(corpus, rank.reserve_summaries(ordered, summaries, k)).join(told.select("query_id", "query", "parents", "summaries"), "query_id")
    diverse = rank.diversify(_reranked(corpus, hits, max(rank.RERANK_POOL, k), rank.MOST_FUSED), max(k, 1))
    return rank.expand_parents(diverse, corpus.chunks.where("node_type = 'parent'"), F.col("parents") | F.col("summaries"))


def retrieve(corpus: Corpus, asked: DataFrame, k: int = 5) -> DataFrame:
    """Each query by its complexity: simple ones by the short path, global ones by summaries, others by the standard path.

    Simple questions of legal or negative wording take the standard path.
    """
    corpus, how = corpus.once(), Q.complexity(F.col("query"))
    how = asked.withColumn("how", F.when((how == "simple") & Q.needs_standard(F.col("query")), "multi_hop").otherwise(how))
    paths = (("simple", retrieve_simple), ("global", retrieve_global), ("multi_hop", retrieve_standard))
    out = [path(corpus, how.where(F.col("how") == name).drop("how"), k).select("query_id", "chunk_id", "rank", "score", "document_id", "context_text", F.lit(name).alias("path")) for name, path in paths]
    return out[0].unionByName(out[1]).unionByName(out[2])

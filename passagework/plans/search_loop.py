"""Search again until there is enough evidence, and answer again until it is faithful: loops over a batch of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from passagework.functions.answers import is_short
from passagework.functions.evidence import diverse_sources, evidence_score, rewritten_query
from passagework.operators import corpus_index
from passagework.operators.providers import Judge, share_in_context
from passagework.operators.search import bm25_topk_blocks
from passagework.sources.readers import html_text_builtin

#: (query_id, query) -> (query_id, rank, url, snippet).
Searcher = Callable[[DataFrame], DataFrame]
#: (query_id, query) -> (query_id, answer, context).
Answerer = Callable[[DataFrame], DataFrame]
LEAST_EVIDENCE, LEAST_FAITHFUL, MOST_PASSES = 30, 0.45, 3
#: Results of a search, and characters of a snippet.
MOST_RESULTS, SNIPPET = 7, 300


def corrected_query(concepts, intent):
    """A comparison of the first two concepts, or all concepts and a wish for an explanation."""
    versus = F.concat(concepts[0], F.lit(" vs "), concepts[1])
    return F.when((intent == "comparison") & (F.size(concepts) >= 2), versus).when(F.size(concepts) > 0, F.concat(F.array_join(concepts, " "), F.lit(" explanation definition")))


def gather_evidence(plans: DataFrame, search: Searcher, save: Callable[[DataFrame, str], DataFrame], passes: int = MOST_PASSES) -> DataFrame:
    """(query_id, url, snippet, evidence, position) of plans (query_id, query, concepts, intent, max_sources).

    Each pass searches for the queries that have too few good sources yet, by a new wording after the first, leaving
    out urls seen before. ``save`` writes a pass's rows to a shared table; the passes are three at most.
    """
    seen = taken = None
    open_ = plans
    for i in range(passes):
        asked = open_ if i == 0 else open_.withColumn("query", corrected_query(F.col("concepts"), F.col("intent"))).where("query is not null")
        found = search(asked.select("query_id", "query")).join(plans.select("query_id", "concepts", "intent", "max_sources"), "query_id")
        if seen is not None:
            found = found.join(seen, ["query_id", "url"], "left_anti")
        scored = found.withColumn("evidence", evidence_score(F.col("concepts"), F.col("intent"), F.col("snippet"), F.col("url")))
        scored = save(scored.select("query_id", "rank", "url", "snippet", "evidence", "max_sources"), f"pass-{i}")
        seen = scored.select("query_id", "url") if seen is None else seen.unionByName(scored.select("query_id", "url"))
        good = scored.where(F.col("evidence") >= LEAST_EVIDENCE).withColumn("rank", (100 - F.col("evidence")) * 1000 + F.col("rank") + F.lit(i * 10**6))
        taken = good if taken is None else taken.unionByName(good)
        enough = taken.groupBy("query_id").agg(F.count("*").alias("n"), F.max("max_sources").alias("most")).where("n >= most").select("query_id")
        open_ = plans.join(enough, "query_id", "left_anti")
    picked = diverse_sources(taken, None).where("position <= max_sources")
    return picked.select("query_id", "url", "snippet", "evidence", "position")


def index_pages(spark: SparkSession, folder: str, pages: DataFrame) -> corpus_index.CorpusIndex:
    """A saved index of pages (page_id, url, html) by their visible text, for page_search()."""
    text = html_text_builtin(F.col("html"))
    held = pages.select(F.col("page_id").cast("long").alias("chunk_id"), F.col("url").alias("document_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("raw").alias("node_type"), F.lit(0).alias("level"), text.alias("text"))
    return corpus_index.insert(corpus_index.open_index(spark, folder), held)


def page_search(index: corpus_index.CorpusIndex, most: int = MOST_RESULTS) -> Searcher:
    """A searcher over indexed pages, best first; a snippet is the start of a page's text."""

    def search(asked: DataFrame) -> DataFrame:
        pages = index.chunks.select("chunk_id", F.col("document_id").alias("url"), F.substring("text", 1, SNIPPET).alias("snippet"))
        return bm25_topk_blocks(index, asked, most).join(pages, "chunk_id").select("query_id", "rank", "url", "snippet")

    return search


def self_corrected_sources(plans: DataFrame, search: Searcher, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(query_id, url, snippet, evidence, position, passes) of plans (query_id, query, concepts, intent, max_passes, max_sources).

    A pass searches for the queries that are still open, and for no wording twice. Sources rejected before are left out;
    those of too little evidence are rejected from then on. A query closes with a pass's sources, one host's once before
    any twice, if they are ``max_sources``, or at least one in its last pass; else its wording is corrected, if it has
    concepts. A query that doesn't close has no rows. A null intent is none; a null url has no host.

    The memory is two tables, what was asked and what was rejected, to which each pass adds its rows; a pass reads only the
    open queries' rows of them. ``save`` writes a pass's rows to a shared table. There are MOST_PASSES at most.
    """
    fixed = plans.select("query_id", "concepts", "intent", "max_passes", "max_sources")
    open_, asked_before, rejected, out = plans.select("query_id", "query"), None, None, None
    for i in range(1, MOST_PASSES + 1):
        if asked_before is not None:
            open_ = open_.join(asked_before, ["query_id", "query"], "left_anti")
        asked = save(open_.join(fixed, "query_id").where(F.col("max_passes") >= i), f"asked-{i}")
        said = asked.select("query_id", "query")
        asked_before = said if asked_before is None else asked_before.unionByName(said)
        found = search(said).join(asked.drop("query"), "query_id")
        if rejected is not None:
            found = found.join(rejected.join(said, "query_id", "left_semi"), ["query_id", "url"], "left_anti")
        scored = found.withColumn("evidence", evidence_score(F.col("concepts"), F.coalesce("intent", F.lit("")), F.col("snippet"), F.col("url")))
        scored = save(scored.select("query_id", "rank", "url", "snippet", "evidence", "max_passes", "max_sources"), f"scored-{i}")
        bad = scored.where(F.col("evidence") < LEAST_EVIDENCE).select("query_id", "url")
        rejected = bad if rejected is None else rejected.unionByName(bad)
        good = scored.where(F.col("evidence") >= LEAST_EVIDENCE).withColumn("rank", (100 - F.col("evidence")) * 1000 + F.col("rank"))
        picked = diverse_sources(good, None).where("position <= max_sources")
        closing = picked.groupBy("query_id").agg(F.count("*").alias("n"), F.max("max_sources").alias("most"), F.max("max_passes").alias("last")).where(f"n >= most or last = {i}")
        taken = picked.join(closing.select("query_id"), "query_id", "left_semi").select("query_id", "url", "snippet", "evidence", "position", F.lit(i).alias("passes"))
        taken = save(taken, f"taken-{i}")
        out = taken if out is None else out.unionByName(taken)
        left = asked.join(taken.select("query_id").distinct(), "query_id", "left_anti")
        open_ = left.select("query_id", corrected_query(F.col("concepts"), F.col("intent")).alias("query")).where("query is not null")
    return out


def faithful_answers(asked: DataFrame, answer: Answerer, save: Callable[[DataFrame, str], DataFrame], judge: Judge = share_in_context) -> DataFrame:
    """(query_id, answer, faithfulness, retried): answers judged unfaithful are made once more for a reworded query; the better one stays.

    Short answers aren't judged.
    """
    judged = lambda rows: rows.withColumn("faithfulness", F.when(~is_short(F.col("answer")), judge(F.col("answer"), F.col("context"))))
    first = save(judged(answer(asked)), "answers-0")
    weak = first.where(F.col("faithfulness") < LEAST_FAITHFUL).select("query_id", F.col("context").alias("rationale"))
    again = asked.join(weak, "query_id").select("query_id", rewritten_query(F.col("query"), F.col("rationale")).alias("query"))
    second = save(judged(answer(again)), "answers-1")
    both = first.withColumn("retried", F.lit(False)).unionByName(second.withColumn("retried", F.lit(True)))
    best = both.groupBy("query_id").agg(F.max(F.struct(F.coalesce("faithfulness", F.lit(-1.0)).alias("order"), (~F.col("retried")).alias("first"), "answer", "faithfulness")).alias("b"))
    return best.select("query_id", "b.answer", "b.faithfulness", (~F.col("b.first")).alias("retried"))

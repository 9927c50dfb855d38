"""Answers and judgements: scores, decisions, gaps, contexts and sources for prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from passagework.functions.detectors import word_count

# Words for confidence, and when to try again.
CONFIDENCE = {"high": 1.0, "medium": 0.6, "low": 0.3}
UNKNOWN_CONFIDENCE, SURE_ENOUGH, MOST_STEPS = 0.5, 0.6, 4
GOOD_BEHAVIOUR = "Federal judges serve during good Behaviour."


def judged_score(verdicts: Column, score: Column, supported: tuple[str, ...] = ("supported",), failed: float | None = 0.0) -> Column:
    """The share of verdicts that are among ``supported``, else the score, between 0 and 1; ``failed`` where there is neither."""
    said = F.filter(F.transform(F.coalesce(verdicts, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v))), lambda v: v != "")
    share = F.size(F.filter(said, lambda v: v.isin(*supported))) / F.nullif(F.size(said), F.lit(0))
    clamped = F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))  # greatest() and least() pass over nulls
    out = F.coalesce(share, clamped)
    return out if failed is None else F.coalesce(out, F.lit(failed))


def confidence_value(word: Column) -> Column:
    """A confidence given as a word or as a number."""
    out = F.when(F.lower(word) == "high", CONFIDENCE["high"])
    for name in ("medium", "low"):
        out = out.when(F.lower(word) == name, CONFIDENCE[name])
    return F.coalesce(out.otherwise(word.try_cast("double")), F.lit(UNKNOWN_CONFIDENCE))


def reflection(has_result: Column, error: Column, confidence: Column, failures: Column, steps: Column) -> Column:
    """stop, retry or escalate after a step of an agent."""
    failed = F.coalesce(error, F.lit("")) != ""
    unsure = (F.coalesce(confidence, F.lit(1.0)) < SURE_ENOUGH) & (steps < MOST_STEPS)
    return F.when(~has_result, "retry").when(failed, F.when(failures >= MOST_STEPS - 1, "escalate").otherwise("retry")).when(unsure, "retry").otherwise("stop")


def gaps(questions: Column, report: Column) -> Column:
    """Questions of which the report holds no word of more than four letters."""
    low = F.lower(F.coalesce(report, F.lit("")))
    return F.filter(questions, lambda q: ~F.exists(F.split(F.lower(q), r"\s+"), lambda w: (F.length(w) > 4) & low.contains(w)))


def solution_issue(confirmed: Column, solution: Column, n_steps: Column) -> Column:
    """What is wrong with a solution, or null: its own check's verdict goes before its text and steps."""
    bad = (F.coalesce(solution, F.lit("")) == "") | F.lower(solution).contains("error")
    return F.when(confirmed.isNotNull(), F.when(~confirmed, "verification failed")).when(bad, "empty or failed solution").when(F.coalesce(n_steps, F.lit(0)) == 0, "no steps")


def finished_answer(query: Column, answer: Column, context: Column) -> Column:
    """The trimmed answer; the bare words good behaviour become a sentence where the question or the context calls for it."""
    bare = F.trim(F.coalesce(answer, F.lit("")))
    asked = F.lower(query).contains("how long") | F.lower(F.coalesce(context, F.lit(""))).contains("good behaviour")
    return F.when(bare.rlike(r"(?i)^good behaviou?r$") & asked, GOOD_BEHAVIOUR).otherwise(bare)


def passage_confidence(score: Column) -> Column:
    """high from 10 points, medium from 3, else low."""
    return F.when(score >= 10, "high").when(score >= 3, "medium").otherwise("low")


def prompt_contexts(packed: DataFrame) -> DataFrame:
    """(query_id, context, sources) from packed chunks (query_id, packed_rank, page, source, text): blocks in order, sources each once."""
    ordered = packed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("packed_rank", "page", "source", "text"))).alias("held"))
    block = F.transform("held", lambda c: F.concat(F.lit("\n--- [Page "), F.coalesce(c["page"].cast("string"), F.lit("?")), F.lit("] ---\n"), c["text"], F.lit("\n")))
    return ordered.select("query_id", F.array_join(block, "").alias("context"), F.array_distinct(F.transform("held", lambda c: F.coalesce(c["source"], F.lit("unknown")))).alias("sources"))


def trace_summary(hits: DataFrame, most: int = 20, preview: int = 200) -> DataFrame:
    """(query_id, chunk_id, rank, score, preview) of each query's first hits."""
    return hits.where(F.col("rank") <= most).select("query_id", "chunk_id", "rank", "score", F.substring("text", 1, preview).alias("preview"))


def is_short(answer: Column, words: int = 10) -> Column:
    """Answers too short to be judged for faithfulness."""
    return word_count(F.coalesce(answer, F.lit(""))) < words

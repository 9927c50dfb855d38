"""Query detectors as column expressions: seven raw scores, their calibration, and the routing decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The detectors' word lists and patterns.
MATH_KEYWORDS = [
    "solve", "simplify", "factor", "expand", "derivative", "integrate", "integral", "limit", "area", "perimeter", "volume", "angle",
    "mean", "median", "variance", "probability", "prime", "gcd", "lcm", "modulo", "equation", "calculate", "compute", "math",
]
MATH_EXPRESSIONS = [
    r"\d+\s*[a-zA-Z]\s*[\+\-\*\/]\s*\d+\s*=\s*\d+", r"∫.*dx", r"sin\(|cos\(|tan\(", r"\d+!", r"\bintegral\b.*\bdx\blog_?\d*\(", r"\\[a-zA-Z]+",
]
CODE_LANGUAGES = r"\b(python|javascript|java\b|rust|sql|bash|typescript|c\+\+|golang|go\b)\b"
CODE_ACTIONS = r"\b(debug|fix|write a function|explain this code|convert|optimize|what does this code do|error|exception|traceback|refactor)\b"
CODE_FENCE = r"(?s)```[a-z]*\n.*?\n```"
CODE_TRACE = r"Traceback \(most recent call last\):|TypeError:|ValueError:|ReferenceError:"
DATA_KEYWORDS = r"\b(analyze|chart|plot|trend|average|distribution|correlation|compare columns|top \d+|how many|max|min|mean|median)\b"
DOCUMENT_KEYWORDS = r"\b(according to this document|in this document|summarize|what does the document say about|extract|find all|compare sections|table of contents|page \d+|this pdf|this paper)\b"
WRITING_KEYWORDS = r"\b(write|draft|rewrite|edit|proofread|improve|more formal|condense|expand|email|essay|report|blog post|cover letter|fix grammar|rephrase)\b"
WRITING_EDITS = ["edit", "rewrite", "proofread"]
RESEARCH_KEYWORDS = r"\b(latest|recent|current state|what is the state of|overview|history of|compare|pros and cons|what happened|update on|news|today|this week|this year|in 202)\b"
KNOWLEDGE_KEYWORDS = r"\b(what is|what are|explain|define|how does\s+.+\s+work|how do\s+.+\s+work|what['`]?s the difference between|compare|concept of|meaning of)\b"
KNOWLEDGE_RECENCY = r"\b(latest|recent|current state|news|today|this week|this year|what happened|update on)\b"

#: Detectors from the highest priority down, with the slope and offset of their calibration.
PLATT = {
    "math": (6.56, -2.5841), "code": (6.7841, -2.7093), "data": (6.3042, -3.8895), "document": (6.381, -3.715),
    "writing": (6.5575, -3.0551), "research": (6.2464, -3.4045), "knowledge": (4.6691, -3.922),
}
AGENTS = list(PLATT)
SELECT_AT, DISPATCH_AT, SURE_AT, AMBIGUOUS_MARGIN = 0.20, 0.5, 0.7, 0.05


def any_case(pattern: str) -> str:
    """In either case, with word boundaries and classes by Unicode."""
    return f"(?iU){pattern}"


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def _points(test: Column, points: float) -> Column:
    return F.when(test, F.lit(points)).otherwise(F.lit(0.0))


def _clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def math_score(query: Column) -> Column:
    low = F.lower(query)
    keywords = reduce(lambda a, b: a + b, (low.contains(w).cast("int") for w in MATH_KEYWORDS))
    expression = reduce(lambda a, b: a | b, (query.rlike(p) for p in MATH_EXPRESSIONS))
    arithmetic = query.rlike(r"\d") & query.rlike(r"[\+\-\*\/\=\^]")
    latex = query.contains("\\") & query.rlike(r"[_^{]")
    return _clamp(F.least(keywords * 0.2, F.lit(0.4)) + _points(expression, 0.5) + _points(arithmetic, 0.3) + _points(latex, 0.4))


def code_score(query: Column) -> Column:
    pasted = query.rlike(CODE_FENCE) | query.rlike(any_case(CODE_TRACE))
    return _clamp(_points(pasted, 0.5) + _points(query.rlike(any_case(CODE_ACTIONS)), 0.3) + _points(query.rlike(any_case(CODE_LANGUAGES)), 0.2))


def _only_with(available: Column, query: Column, pattern: str) -> Column:
    return F.when(available, 0.4 + _points(query.rlike(any_case(pattern)), 0.5)).otherwise(0.0)


def writing_score(query: Column) -> Column:
    editing = (word_count(query) > 30) & contains_any(F.lower(query), WRITING_EDITS)
    return F.when(query.rlike(any_case(WRITING_KEYWORDS)), 0.5 + _points(editing, 0.3)).otherwise(0.0)


def research_score(query: Column) -> Column:
    return F.when(query.rlike(any_case(RESEARCH_KEYWORDS)), 0.6).when(word_count(query) > 15, 0.3).otherwise(0.0)


def knowledge_score(query: Column) -> Column:
    known = F.when(query.rlike(any_case(KNOWLEDGE_KEYWORDS)), 0.6 + _points(word_count(query) < 15, 0.2)).otherwise(0.0)
    return _clamp(known - _points(query.rlike(any_case(KNOWLEDGE_RECENCY)), 0.5))


def raw_scores(query: Column, has_documents: Column | None = None, has_data: Column | None = None) -> dict[str, Column]:
    """The detectors' scores between 0 and 1. A null query counts as empty."""
    query = F.coalesce(query, F.lit(""))
    documents, data = (F.coalesce(x, F.lit(False)) if x is not None else F.lit(False) for x in (has_documents, has_data))
    return {
        "math": math_score(query), "code": code_score(query), "data": _only_with(data, query, DATA_KEYWORDS), "document": _only_with(documents, query, DOCUMENT_KEYWORDS),
        "writing": writing_score(query), "research": research_score(query), "knowledge": knowledge_score(query),
    }


def platt(score: Column, a: float, b: float) -> Column:
    """sigmoid(a * score + b) of a score cut to 0..1."""
    return 1 / (1 + F.exp(-(a * _clamp(score) + b)))


def calibrated(scores: dict[str, Column], params: dict[str, tuple[float, float]] | None = None) -> dict[str, Column]:
    """Scores of agents without parameters pass through."""
    params = PLATT if params is None else params
    return {name: platt(score, *params[name]) if name in params else _clamp(score) for name, score in scores.items()}


def route_decision(scores: dict[str, Column], select_at: float = SELECT_AT, margin_at: float = AMBIGUOUS_MARGIN) -> Column:
    """A struct: the best agent of calibrated scores (ties to the higher priority) and how clear its lead is.

    selected_agent is null under ``select_at``; dispatched_agent also under DISPATCH_AT; uncertain from there to SURE_AT.
    """
    ranked = F.array_sort(F.array(*(F.struct((-scores[name]).alias("order"), F.lit(i).alias("priority"), F.lit(name).alias("agent"), scores[name].alias("score")) for i, name in enumerate(AGENTS))))
    best, second = ranked[0], ranked[1]
    margin = best["score"] - second["score"]
    return F.struct(
        F.when(best["score"] >= select_at, best["agent"]).alias("selected_agent"),
        F.when(best["score"] >= max(select_at, DISPATCH_AT), best["agent"]).alias("dispatched_agent"),
        best["score"].alias("confidence"), second["agent"].alias("runner_up_agent"), second["score"].alias("runner_up_score"), margin.alias("margin"),
        ((best["score"] >= select_at) & (margin < margin_at)).alias("ambiguous"),
        ((best["score"] >= DISPATCH_AT) & (best["score"] < SURE_AT)).alias("uncertain"),
    )

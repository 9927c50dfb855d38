"""Judging sources and answers: evidence scores, credibility, passages, rewrites, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from passagework.functions.detectors import contains_any, word_count
from passagework.functions.text import host, sentences, tokens

# Domains, wording and limits of the scores.
GOOD_DOMAINS = [
    "wikipedia.org", "britannica.com", "nature.com", "sciencedirect.com", "arxiv.org", "github.com", "stackoverflow.com", "mit.edu", "stanford.edu", "khanacademy.org",
    "investopedia.com", "developer.mozilla.org", "docs.python.org", "aws.amazon.com", "docs.aws.amazon.com", "cloud.google.com", "learn.microsoft.com",
    "azure.microsoft.com", "digitalocean.com", "medium.com", "dev.to", "geeksforgeeks.org", "javatpoint.com", "tutorialspoint.com", "baeldung.com", "freecodecamp.org",
    "realpython.com", "towardsdatascience.com", "analyticsvidhya.com", ".edu", ".gov",
]
AUTHORITIES = ["edu", "gov", "org", "wikipedia.org", "nature.com", "science.org", "nytimes.com", "bbc.com", "reuters.com", "bloomberg.com"]
UNFETCHED_HOSTS = ["youtube.com", "reddit.com", "twitter.com", "instagram.com", "tiktok.com"]
DEFINING = ["is a", "is defined as", "refers to", "stands for"]
COMPARING = ["difference", "compared to", "vs", "versus", "while", "unlike", "whereas"]
SOLVING = ["error", "fix", "solution", "resolve"]
# Most points for concepts; points for a good source and any other, for wording that fits, partly fits, doesn't fit, and for intents without wording.
MOST_FOUND, GOOD_SOURCE, OTHER_SOURCE, FITS, BOTH_SIDES, UNFIT, NO_WORDING = 40, 30, 10, 30, 25, 10, 20
# A concept that sources about a software library of a like name are taken for: its name, the mark in the link and in the snippet, and what it costs.
MISTAKEN = ("eigenvector", "eigen", "c++", 50)
ASKING = ["what is a ", "what is an ", "what is ", "who is ", "define "]


def concept_overlap(concept: Column, low_snippet: Column) -> Column:
    """1 if the snippet holds the concept, else the share of the concept's words that it holds anywhere."""
    words = tokens(concept)
    held = F.size(F.filter(words, lambda w: low_snippet.contains(w)))
    return F.when(low_snippet.contains(F.lower(concept)), 1.0).otherwise(F.coalesce(held / F.nullif(F.size(words), F.lit(0)), F.lit(0.0)))


def evidence_score(concepts: Column, intent: Column, snippet: Column, url: Column) -> Column:
    """0 to 100: concepts found (40), the source (30), wording that fits the intent (30)."""
    low, link = F.lower(F.coalesce(snippet, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    share = F.floor(MOST_FOUND / F.greatest(F.size(concepts), F.lit(1)))
    found = F.aggregate(concepts, F.lit(0).cast("long"), lambda s, c: s + F.floor(share * concept_overlap(c, low)))
    source = F.when(contains_any(link, GOOD_DOMAINS), GOOD_SOURCE).otherwise(OTHER_SOURCE)
    sides = F.size(F.filter(concepts, lambda c: concept_overlap(c, low) >= 0.5))
    fits = (
        F.when(intent == "definition", F.when(contains_any(low, DEFINING), FITS).otherwise(UNFIT))
        .when(intent == "comparison", F.when(contains_any(low, COMPARING), FITS).when((F.size(concepts) >= 2) & (sides >= 2), BOTH_SIDES).otherwise(UNFIT))
        .when(intent == "troubleshooting", F.when(contains_any(low, SOLVING), FITS).otherwise(UNFIT)).otherwise(NO_WORDING)
    )
    concept, in_link, in_text, cost = MISTAKEN
    mistaken = F.exists(concepts, lambda c: F.lower(c) == concept) & link.contains(in_link) & low.contains(in_text)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.least(found, F.lit(MOST_FOUND)) + source + fits - F.when(mistaken, cost).otherwise(0))).cast("long")


def credibility(url: Column) -> Column:
    """0.8 for authorities, 0.6 for other .com and .net hosts, else 0.5."""
    domain = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]+://([^/?#]*)", 1))
    ends = reduce(lambda a, b: a | b, (domain.endswith(x) for x in AUTHORITIES))
    return F.when(ends, 0.8).when(domain.contains(".com") | domain.contains(".net"), 0.6).otherwise(0.5)


def is_candidate_url(url: Column) -> Column:
    """http links that are no ad redirects."""
    return F.coalesce(url.startswith("http") & ~url.contains("/clev?event="), F.lit(False))


def is_fetchable(url: Column) -> Column:
    return ~contains_any(F.coalesce(host(url), F.lit("")), UNFETCHED_HOSTS)


def diverse_sources(results: DataFrame, most: int | None, key: str = "query_id") -> DataFrame:
    """The first ``most`` results (key, rank, url), or all: each host's first, then the others by rank."""
    order = Window.partitionBy(key, host(F.col("url"))).orderBy("rank")
    first = results.withColumn("_n", F.row_number().over(order))
    picked = Window.partitionBy(key).orderBy(F.col("_n") > 1, "rank")
    placed = first.withColumn("position", F.row_number().over(picked)).drop("_n")
    return placed if most is None else placed.where(F.col("position") <= most)


def asked_concept(query: Column) -> Column:
    """A question's subject: without its opening words and its marks at the ends."""
    low = F.lower(F.coalesce(query, F.lit("")))
    opening = F.coalesce(*(F.when(low.startswith(p), F.lit(p)) for p in ASKING), F.lit(""))
    return F.when(opening == "", low).otherwise(F.regexp_replace(F.substr(low, F.length(opening) + 1), r"^[? ]+|[? ]+$", ""))


def best_passages(texts: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, passage, score) from (key, query, text): the sentence that answers best and, where it goes on, the next one.

    A sentence counts with 8 to 60 words, a start that is no clause's middle and the subject in it. It scores a point
    for each of the query's longer words, 10 for "is a", else 3 for "are". The first of the best counts from 3 points;
    texts without one have no row.
    """
    flat = texts.select(key, "query", F.posexplode(sentences(F.regexp_replace("text", r"(?U)\s+", " "))).alias("i", "raw"))
    s, low = F.trim(F.regexp_replace("raw", r"\p{Cntrl}", "")), F.lower(F.trim(F.col("raw")))
    stem = F.regexp_replace(F.regexp_replace(asked_concept(F.col("query")), "s+$", ""), "[es]+$", "")
    n = word_count(s)
    letter = F.regexp_extract(s, r"\p{L}", 0)
    open_question = s.endswith("?") & (low.startswith("what") | low.startswith("how"))
    fits = (s != "") & ~letter.rlike(r"\p{Ll}") & ~s.rlike(r"^[,;:)}\]]") & n.between(8, 60) & ~open_question & low.contains(stem)
    words = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: F.length(w) > 3)
    score = F.size(F.filter(words, lambda w: low.contains(w))) + F.when(low.contains(" is a ") | low.contains(" is an "), 10).when(low.contains(" are "), 3).otherwise(0)
    following = F.lead(F.trim("raw")).over(Window.partitionBy(key).orderBy("i"))
    rows = flat.withColumn("next", following).withColumn("sentence", F.trim("raw")).withColumn("score", F.when(fits, score).otherwise(0))
    best = rows.groupBy(key).agg(F.max(F.struct("score", (-F.col("i")).alias("first"), "sentence", "next")).alias("b")).where("b.score >= 3")
    goes_on = F.col("b.next").rlike(r"^\p{Lu}") & word_count(F.col("b.next")).between(5, 40)
    joined = F.when(F.coalesce(goes_on, F.lit(False)), F.concat_ws(" ", "b.sentence", "b.next")).otherwise(F.col("b.sentence"))
    return best.select(key, F.when(joined.rlike(r"[.!?]$"), joined).otherwise(F.concat(joined, F.lit("."))).alias("passage"), F.col("b.score").cast("long").alias("score"))


def rewritten_query(query: Column, rationale: Column) -> Column:
    """A query with up to three new capitalised phrases of a judge's rationale, else without its question word."""
    phrases = F.regexp_extract_all(F.coalesce(rationale, F.lit("")), F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), 0)
    new = F.slice(F.filter(F.array_distinct(phrases), lambda p: ~F.lower(query).contains(F.lower(p))), 1, 3)
    bare = F.trim(F.regexp_replace(query, r"(?i)^(what|who|when|where|why|how|is|are|does|do)\s+", ""))
    return F.when(F.size(new) > 0, F.concat_ws(" ", query, F.array_join(new, " "))).when(bare != "", bare).otherwise(query)


def answer_check(answer: Column, sections: Column, query: Column, n_sources: Column, mode: Column) -> Column:
    """A struct: sections an answer leaves out, whether it cites, is long enough and names what was asked, and passes."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    missing = F.filter(sections, lambda s: ~F.exists(F.split(F.lower(s), r"\s+"), lambda w: (F.length(w) > 3) & low.contains(w)))
    cites = (mode == "direct_web") | (n_sources == 0) | low.rlike(r"\[\d+\]")
    complete = ~((word_count(low) < 20) & (F.size(sections) > 2))
    concept = asked_concept(query)
    stem = F.when(concept.rlike("(?<!s)es$"), F.regexp_replace(concept, "es$", "")).when(concept.rlike("(?<!s)s$"), F.regexp_replace(concept, "s$", "")).otherwise(concept)
    relevant = (F.length(stem) < 3) | low.contains(stem)
    return F.struct(missing.alias("missing_sections"), cites.alias("has_citations"), complete.alias("is_complete"), relevant.alias("is_relevant"), ((F.size(missing) == 0) & cites & complete & relevant).alias("passed"))

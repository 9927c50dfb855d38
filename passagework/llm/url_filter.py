"""URL verdicts by rules, and by trust and distrust that spread over the host graph (operator 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from passagework.llm.scratch import Scratch

#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or without ://: empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | host.endswith(f".{rule[0]}")) & path.startswith(rule[1])


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one. The first of equally long ones."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = _fits(host, path, r)
        rule, verdict = F.when(fits, F.lit(r[0] + r[1])).otherwise(rule), F.when(fits, F.lit(r[2])).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html", parent_weight: float = 0.1) -> DataFrame:
    """(src, dst, weight): links between hosts, counted, and a weak edge both ways between a host and its parent domain.

    Links are absolute ones in href or src attributes; those within a host say nothing about others and are left out.
    """
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"(?i)(?:href|src)\s*=\s*[\"']?([a-z][a-z0-9+.-]*://[^\"'\s<>]+)"), 1)).alias("link"))
    linked = links.select("src", host_of(F.col("link")).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select(host_of(F.col(url_col)).alias("src")).where("src <> ''").distinct()
    parent = hosts.withColumn("dst", F.regexp_replace("src", r"^[^.]*\.", "")).where("dst like '%.%' and dst <> src").withColumn("weight", F.lit(parent_weight))
    both = parent.select("src", "dst", "weight").unionByName(parent.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return linked.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def personalised_ranks(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = 0.85, rounds: int = 12) -> DataFrame:
    """(kind, host, rank): for each kind, PageRank over its edges (kind, src, dst, weight) that restarts at its ``seeds`` (kind, host, mass; masses sum to 1).

    All kinds go through a round together: a join on the source and one sum by target. Hosts without edges keep only what
    restarts there. The edges are one row for each pair of hosts, so that a hot host has as many rows as hosts it meets, which
    a skewed join splits, as both its sides are written tables in every round.
    """
    out = scratch.save(edges.groupBy("kind", "src").agg(F.sum("weight").alias("total")), "totals")
    shares = scratch.save(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (damping * F.col("weight") / F.col("total")).alias("share")), "shares")
    seeds = scratch.save(seeds, "seeds")
    rank, restart = seeds.select("kind", "host", F.col("mass").alias("rank")), seeds.select("kind", "host", ((1 - damping) * F.col("mass")).alias("rank"))
    for i in range(1, rounds + 1):
        moved = rank.join(shares, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
        rank = scratch.save(moved.unionByName(restart).groupBy("kind", "host").agg(F.sum("rank").alias("rank")), f"rank-{i}")
        scratch.drop(f"rank-{i - 1}")
    return rank


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple = RULES, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_score), one row for each row of ``pages``.

    The rule's verdict stands where one fits. Else the host's: hosts are trusted or blocked seeds by how many of their
    pages the rules allow or block; trust restarts at trusted seeds and follows links, distrust restarts at blocked
    ones and follows links backwards, since those who link to blocked hosts vouch for them. host_score is
    trust / (trust + distrust), rounded to 9 places; a host under ``threshold`` is blocked. A host that neither reaches scores 1.

    A null url, or one without ://, has an empty host and path and is allowed. Null html has no links; null ids and
    repeated rows are kept; an empty table gives no rows; other columns are ignored. A host with a large share of the pages
    is a skewed key of one join with a written table, which is split.
    """
    scratch = Scratch(pages.sparkSession)
    edges = scratch.save(host_edges(pages, url_col, html_col), "edges")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    judged = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    counts = scratch.save(judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("allow"), F.count_if(F.col("ruled") == "block").alias("block")), "counts")
    told = counts.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("allow").alias("n")), F.struct(F.lit("distrust").alias("kind"), F.col("block").alias("n")))).alias("t")).select("host", "t.*").where("n > 0")
    totals = told.groupBy("kind").agg(F.sum("n").alias("total"))  # two rows
    seeds = told.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("mass"))
    back = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    ranks = personalised_ranks(edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(back), seeds, scratch)
    of_kind = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    hosts = scratch.save(ranks.groupBy("host").agg(of_kind("trust"), of_kind("distrust")), "hosts")
    out = judged.join(hosts, "host", "left").withColumn("host_score", F.expr("round(coalesce(trust / nullif(trust + distrust, 0D), 1D), 9)"))
    said = F.coalesce("ruled", F.when(F.col("host_score") < threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", said.alias("verdict"), "host_score")

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from passagework.llm.scratch import Scratch
from passagework.llm.url_filter import host_of, path_of, personalised_ranks, url_verdicts

URLS = {
    "https://Example.COM/en/71?x": ("example.com", "/en/71", "example.com/en/7", "allow"), "http://a.example.com/en/8": ("a.example.com", "/en/8", "com/en/", "block"),
    "http://x.net/de/1": ("x.net", "/de/1", "net/de/", "allow"), "http://w.example.net/de/80#t": ("w.example.net", "/de/80", "example.net/de/8", "block"), "http://notorg/es/": ("notorg", "/es/", None, "allow"),
    "http://q.org/es/": ("q.org", "/es/", "org/es/", "block"), "http://org/es/1": ("org", "/es/1", "org/es/", "block"), "no link": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
    "://h?u=://z/p": ("h", "", None, "allow"), "http://myexample.com/en/7": ("myexample.com", "/en/7", "com/en/", "block"), "ftp://É.com/EN/": ("É.com", "/EN/", None, "allow"),
}


def test_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(None, "no link", "<a href='http://x.net/'>"), (0, "http://q.org/es/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'a' as host", "'b' as rule", "1 as src")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in url_verdicts(df).collect()), key=repr)
    assert got == sorted(((i, *URLS[u][:3], URLS[u][3] if URLS[u][2] else None) for i, u, _ in rows), key=repr)
    assert url_verdicts(df.limit(0)).count() == 0


def test_links_carry_trust_and_distrust(spark):
    link = lambda *hosts: " ".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [
        (1, "http://good.net/de/1", link("friend.info")), (2, "http://friend.info/", link("good.net")), (3, "http://bad.org/es/", ""), (4, "http://fan.info/", link("bad.org")), (5, "http://alone.info/", None),
    ]
    said = {r.page_id: (r.verdict, r.host_score) for r in url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [said[i][0] for i in range(1, 6)] == ["allow", "allow", "block", "block", "allow"]
    assert said[2][1] > 0.9 and said[4][1] < 0.1 and said[5][1] == 1.0


def test_rank_against_dense_iteration(spark):
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 3.0)]
    rank = {"a": 1.0}
    for _ in range(12):
        new = defaultdict(float, {"a": 0.15})
        for s, t, w in edges:
            new[t] += 0.85 * rank.get(s, 0) * w / sum(x for a, _, x in edges if a == s)
        rank = new
    df = spark.createDataFrame(edges, "src string, dst string, weight double").selectExpr("'one' as kind", "*").unionByName(spark.createDataFrame([("two", "c", "b", 1.0)], "kind string, src string, dst string, weight double"))
    found = personalised_ranks(df, spark.createDataFrame([("one", "a", 1.0), ("two", "c", 1.0)], "kind string, host string, mass double"), Scratch(spark)).collect()
    assert {r.host: pytest.approx(r["rank"]) for r in found if r.kind == "one"} == dict(rank)
    assert {r.host: pytest.approx(r["rank"]) for r in found if r.kind == "two"} == {"c": 0.15, "b": 0.85 * 0.15}


def test_very_long_urls_and_pages(spark):
    long = "x" * 2_000_000
    rows = [(1, f"http://good.net/de/{long}", None), (2, f"http://{long}.info/", f"<a href='http://q.org/{long}'>" + "<p> " * 300_000), (3, "http://q.org/es/1", "<a href=" * 200_000)]
    said = {r.page_id: (r.verdict, len(r.host), len(r.path)) for r in url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert said == {1: ("allow", 8, len(long) + 4), 2: ("block", len(long) + 5, 1), 3: ("block", 5, 5)}


def test_host_and_path(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    assert {r.url: (r.h, r.p) for r in df.select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).collect()} == {u: v[:2] for u, v in URLS.items()}


def test_a_host_of_half_the_pages_is_split(spark):
    """The pages of one large host go to several tasks of the join with the hosts' scores."""
    pages = spark.range(60_000).selectExpr("id as page_id", "concat('http://', if(id % 2 = 0, 'big.info', concat('h', id % 97, '.com')), '/x/', id) as url", "cast(null as string) as html").repartition(8)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = url_verdicts(pages)
        sizes = sorted(r["n"] for r in out.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(sizes) == 60_000 and sizes[-1] < 20_000

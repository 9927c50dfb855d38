"""The registered queries of the operators and of the pipeline, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from passagework.llm import byte_bpe, corpus_queries, decontaminate, embedding_dedup, license_scan, quality, secret_scan, token_counts, toxicity, url_filter
from passagework.llm.minhash_dedup import near_duplicates
from passagework.llm.scratch import Scratch
from passagework.plans.tables import texts


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 4-word shingles."""
    return near_duplicates(texts(spark, sf_dir, "documents"), shingle=4)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return decontaminate.contaminated(texts(spark, sf_dir, "documents"), texts(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return license_scan.license_labels(texts(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' urls."""
    return url_filter.url_verdicts(texts(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and digests of their ids and of the ids' bytes."""
    return byte_bpe.round_trip_digests(texts(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    return secret_scan.secret_report(texts(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; a document's source is its host and its language the path there."""
    docs, labels = texts(spark, sf_dir, "documents"), texts(spark, sf_dir, "labels")
    return quality.quality_scores(docs, quality.fit_quality(docs, labels), F.col("source"), F.col("lang"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors within each label."""
    return embedding_dedup.near_vectors(texts(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs, labels = texts(spark, sf_dir, "documents"), texts(spark, sf_dir, "labels")
    return toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, labels))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from the flat token files that they are written to first."""
    files, documents = token_counts.flat_token_files(texts(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), Scratch(spark))
    return token_counts.document_token_counts(files).join(documents, ["file", "doc_no"]).select("doc_id", "n_tokens")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash_dedup, op2_decontaminate, op3_license_scan, op4_url_filter, op5_byte_bpe, op6_secret_scan, op7_quality, op8_embedding_dedup, op9_toxicity, op10_token_counts)} | corpus_queries.QUERIES

def _secret_sql() -> str:
    kinds = [*secret_scan.BASE_KINDS, ("entropy", secret_scan.CANDIDATE.replace("(?<![A-Za-z0-9+/_-])", ""), 0, 20)]
    q = lambda p: "'" + p.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"""SELECT doc_id, {i} AS kind, t, h, g, v FROM (SELECT doc_id, t, regexp_extract_all(t, {q(p)}) AS h, string_split_regex(t, {q(p)}) AS g, regexp_extract_all(t, {q(p)}, {group}) AS v FROM d WHERE regexp_matches(t, {q(p)}))"""
        for i, (_, p, group, _) in enumerate(kinds)
    )
    least = "[" + ", ".join(str(x[3]) for x in kinds) + "]"
    allowed = " OR ".join(f"regexp_matches(v, {q(p)})" for p in secret_scan.ALLOWED if "\\1" not in p) + f" OR NOT regexp_matches(v, {q(secret_scan.UNLIKE_WORDS)})"
    classes = " ".join(f"WHEN regexp_matches(v, {q(p)}) THEN {bits}" for p, bits in secret_scan.CLASSES[:-1])
    joined = "coalesce(string_agg(['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || b || ':' || e, ',' ORDER BY b, kind) {}, '')"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS MATERIALIZED ({found}),
s AS MATERIALIZED (
  SELECT doc_id, kind, v[i] AS v, b, b + length(h[i]) AS e FROM (
    SELECT *, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0)::BIGINT AS b
    FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM m)) WHERE length(v[i]) >= {least}[kind + 1]),
w AS (SELECT DISTINCT v, unnest(range(1, length(v) - 18)) AS i FROM s WHERE kind = 3),
c AS (SELECT v, i, x, count(*) AS n FROM (SELECT v, i, unnest(string_split(substring(v, i, 20), '')) AS x FROM w) GROUP BY ALL),
bits AS (SELECT v, max(bits) AS bits FROM (SELECT v, i, log2(20) - sum(n * log2(n)) / 20 AS bits FROM c GROUP BY ALL) GROUP BY v),
extra AS (SELECT s.* FROM s JOIN bits USING (v) WHERE kind = 3 AND NOT ({allowed}) AND bits >= CASE {classes} ELSE {secret_scan.CLASSES[-1][1]} END
  AND NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.kind < 3 AND o.b < s.e AND s.b < o.e)),
every AS (SELECT * FROM s WHERE kind < 3 UNION ALL SELECT * FROM extra),
r AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  {joined.format("FILTER (kind < 3)")} AS base, {joined.format("")} AS spans FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r USING (doc_id)
"""


def _license_sql() -> str:
    """Brute force: every block against every template."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x{7F}]+"
    phrases = " UNION ALL ".join(f"SELECT '{p}' AS p, '{label}' AS label" for p, label in license_scan.PHRASES.items())
    templates = ", ".join(f"({i}, '{t.text}', '{t.label}', '{t.must}')" for i, t in enumerate(license_scan.TEMPLATES))
    step, size = license_scan.STEP, license_scan.BLOCK
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w FROM documents),
p AS (SELECT label, string_split(p, ' ') AS p FROM ({phrases})),
hit AS (SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), p WHERE w[i] = p[1] AND w[i:i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT label) AS labels FROM hit GROUP BY doc_id),
t AS (SELECT i, label, list_distinct(string_split(t, ' ')) AS s, string_split(must, ' ') AS must FROM (VALUES {templates}) v(i, t, label, must)),
beaten AS (SELECT x.i AS winner, y.i AS loser FROM t x, t y WHERE list_has_all(x.must, y.must) AND NOT list_has_all(y.must, x.must)),
b AS MATERIALIZED (SELECT doc_id, k, list_distinct(w[k * {step} + 1 : k * {step} + {size}]) AS s FROM (SELECT doc_id, w, unnest(range(0, (len(w) + {step - 1}) // {step})) AS k FROM d)),
m AS MATERIALIZED (SELECT doc_id, k, i, label, len(list_intersect(b.s, t.s)) AS n, len(t.s) AS size FROM b, t WHERE list_has_all(b.s, t.must) AND 100 * len(list_intersect(b.s, t.s)) >= 80 * len(t.s)),
lost AS (SELECT DISTINCT m.doc_id, m.k, loser AS i FROM m JOIN beaten ON winner = m.i),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(n / size) AS score FROM m ANTI JOIN lost USING (doc_id, k, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, lo AS first_word, hi AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, found.labels))), ','), '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(found.score, 0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _url_sql(rounds: int = 12, damping: float = 0.85, parent_weight: float = 0.1, threshold: float = 0.5) -> str:
    """The rounds of both rankings, written out."""
    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits.format(*r)} THEN '{value(r)}'" for r in rules) + " END"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda c: lower.format(f"regexp_extract(coalesce({c}, ''), '(?s)^.*?://([^/?#]*)', 1)")
    ctes = []
    for name, seed, edges in (("trust", "allow", "edges"), ("distrust", "block", "back")):
        ctes.append(f"{name}_0 AS MATERIALIZED (SELECT host, {seed} / (SELECT sum({seed}) FROM counts) AS rank FROM counts WHERE {seed} > 0)")
        for i in range(1, rounds + 1):
            ctes.append(
                f"{name}_{i} AS MATERIALIZED (SELECT host, sum(rank) AS rank FROM (SELECT dst AS host, {damping} * rank * share AS rank FROM {name}_{i - 1} JOIN {edges} ON src = host"
                f" UNION ALL SELECT host, {1 - damping} * rank FROM {name}_0) GROUP BY host)"
            )
    return rf"""
WITH p AS MATERIALIZED (SELECT page_id, {host("url")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, html FROM pages),
j AS MATERIALIZED (SELECT page_id, host, path, {case(lambda r: r[0] + r[1])} AS rule, {case(lambda r: r[2])} AS ruled FROM p),
counts AS MATERIALIZED (SELECT host, count(*) FILTER (ruled = 'allow') AS allow, count(*) FILTER (ruled = 'block') AS block FROM j WHERE host <> '' GROUP BY host),
parent AS (SELECT host AS src, regexp_replace(host, '^[^.]*\.', '') AS dst FROM counts),
near AS (SELECT src, dst, {parent_weight} AS weight FROM parent WHERE dst LIKE '%.%' AND dst <> src),
links AS (SELECT host AS src, {host("link")} AS dst FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)(?:href|src)\s*=\s*["'']?([a-z][a-z0-9+.-]*://[^"''\s<>]+)', 1)) AS link FROM p)),
linked AS (SELECT src, dst, count(*) AS weight FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
raw AS MATERIALIZED (SELECT src, dst, sum(weight)::DOUBLE AS weight FROM (SELECT * FROM linked UNION ALL SELECT * FROM near UNION ALL SELECT dst, src, weight FROM near) GROUP BY ALL),
edges AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM raw),
back AS MATERIALIZED (SELECT dst AS src, src AS dst, weight / sum(weight) OVER (PARTITION BY dst) AS share FROM raw),
{", ".join(ctes)},
hosts AS (SELECT host, sum(t) AS t, sum(d) AS d FROM (SELECT host, rank AS t, 0 AS d FROM trust_{rounds} UNION ALL SELECT host, 0, rank FROM distrust_{rounds}) GROUP BY host),
scored AS (SELECT j.*, round(coalesce(t / nullif(t + d, 0), 1), 9) AS host_score FROM j LEFT JOIN hosts USING (host))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host_score < {threshold} THEN 'block' ELSE 'allow' END) AS verdict, host_score FROM scored
"""



ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingled AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [len(w)::VARCHAR || ' ' || array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM words
), sized AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingled GROUP BY ALL
), linked AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sized p ON p.doc_id = a.doc_id JOIN sized q ON q.doc_id = b.doc_id
  WHERE 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n)
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM words UNION SELECT r.x, l.y FROM reach r JOIN linked l ON l.x = r.y
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept, e.class_id
FROM words d LEFT JOIN sized s USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
JOIN (SELECT d.doc_id, CASE WHEN k.k IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY k.k) END AS class_id
      FROM words d LEFT JOIN (SELECT doc_id, list_sort(list(s)) AS k FROM shingled GROUP BY doc_id) k USING (doc_id)) e USING (doc_id)
""",
    "op3_license_scan": _license_sql(),
    "op4_url_filter": _url_sql(),
    "op6_secret_scan": _secret_sql(),
    "op8_embedding_dedup": r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, embedding IS NOT NULL AND len(embedding) > 0 AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS sound FROM embeddings
), linked AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.sound AND b.sound AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98
), reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN linked l ON l.x = r.y)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept, class_id
FROM v LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM linked GROUP BY x) USING (vec_id)
JOIN (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x) USING (vec_id)
JOIN (SELECT vec_id, CASE WHEN sound THEN min(vec_id) OVER (PARTITION BY sound, label, e) ELSE vec_id END AS class_id FROM v) USING (vec_id)
""",
} | corpus_queries.ORACLE_SQL

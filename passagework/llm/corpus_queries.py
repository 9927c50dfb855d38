"""The registered queries of operators 11 to 13, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.llm import katz, phrases, vector_codes
from passagework.plans.tables import texts


def op11_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents by a trigram model of those that are not held out."""
    return katz.katz_scores(texts(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all sound vectors."""
    return vector_codes.vector_codes(texts(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language of all documents."""
    return phrases.collocations(texts(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = "list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"

KATZ_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(xor({_CRC}, 4294967295) % 7 = 2, false) AS held, list_append(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), ' ') AS w FROM documents
), g AS MATERIALIZED (
  SELECT r, held, i, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS w1, CASE WHEN i > 2 THEN w[i - 2] END AS w2 FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)
), c1 AS MATERIALIZED (SELECT w, count(*) AS c FROM g WHERE NOT held GROUP BY ALL
), c2 AS MATERIALIZED (SELECT w1, w, count(*) AS c FROM g WHERE NOT held AND i > 1 GROUP BY ALL
), c3 AS MATERIALIZED (SELECT w2, w1, w, count(*) AS c FROM g WHERE NOT held AND i > 2 GROUP BY ALL
), n AS (
  SELECT k, list(coalesce(m, 0)::DOUBLE ORDER BY r) AS n FROM (SELECT * FROM range(1, 4) a(k), range(1, 7) b(r))
  LEFT JOIN (SELECT 1 AS k, c AS r, count(*) AS m FROM c1 GROUP BY ALL UNION ALL SELECT 2, c, count(*) FROM c2 GROUP BY ALL UNION ALL SELECT 3, c, count(*) FROM c3 GROUP BY ALL) USING (k, r) GROUP BY k
), ranges AS (
  SELECT k, top, r, CASE WHEN list_min(n[1:top + 1]) > 0 AND (top + 1) * n[top + 1] / n[1] < 1
    THEN ((r + 1) * n[r + 1] / (r * n[r]) - (top + 1) * n[top + 1] / n[1]) / (1 - (top + 1) * n[top + 1] / n[1]) ELSE -1 END AS s FROM n, range(2, 6) a(top), range(1, 6) b(r) WHERE r <= top
), best AS (SELECT k, max(top) AS top FROM (SELECT k, top FROM ranges GROUP BY k, top HAVING min(s) > 0 AND max(s) < 1) GROUP BY k
), s AS MATERIALIZED (SELECT k, r AS c, s FROM ranges JOIN best USING (k, top)
), world AS MATERIALIZED (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c1
), q1 AS MATERIALIZED (SELECT w, c, c1.c * (1 - kept) AS rest, kept * c / n AS p FROM (SELECT c1.*, coalesce(s, 1 - 1 / (c1.c + 1.0::DOUBLE) ** 2) AS kept FROM c1 LEFT JOIN s ON s.k = 1 AND s.c = c1.c) c1, world
), unknown AS MATERIALIZED (SELECT CASE WHEN any_value(world.n) = 0 THEN 1 ELSE sum(rest) / any_value(world.n) END AS p FROM world LEFT JOIN q1 ON true
), q2 AS MATERIALIZED (
  SELECT x.w1, x.w, x.c, h.c AS total, x.c * (1 - kept) AS rest, kept * x.c / h.c AS p
  FROM (SELECT c2.*, coalesce(s, 1 - 1 / (c2.c + 1.0::DOUBLE) ** 2) AS kept FROM c2 LEFT JOIN s ON s.k = 2 AND s.c = c2.c) x JOIN c1 h ON h.w = x.w1
), q3 AS MATERIALIZED (
  SELECT x.w2, x.w1, x.w, h.c AS total, x.c * (1 - kept) AS rest, kept * x.c / h.c AS p
  FROM (SELECT c3.*, coalesce(s, 1 - 1 / (c3.c + 1.0::DOUBLE) ** 2) AS kept FROM c3 LEFT JOIN s ON s.k = 3 AND s.c = c3.c) x JOIN c2 h ON h.w1 = x.w2 AND h.w = x.w1
), a2 AS MATERIALIZED (SELECT w1, log10(sum(q2.rest) / any_value(total) / (1 - sum(q1.p))) AS a FROM q2 JOIN q1 USING (w) GROUP BY w1
), a3 AS MATERIALIZED (SELECT w2, w1, log10(sum(q3.rest) / any_value(q3.total) / (1 - sum(q2.p))) AS a FROM q3 JOIN q2 USING (w1, w) GROUP BY w2, w1
), t AS (
  SELECT g.r, q1.c, world.n, world.v, log10((coalesce(q1.c, 0) + 1) / (world.n + world.v + 1)) AS base, log10(coalesce(q1.p, unknown.p)) AS s1,
    CASE WHEN i < 2 THEN s1 ELSE coalesce(log10(q2.p), coalesce(a2.a, 0) + s1) END AS s2, CASE WHEN i < 3 THEN s2 ELSE coalesce(log10(q3.p), coalesce(a3.a, 0) + s2) END AS s3
  FROM g LEFT JOIN q1 ON q1.w = g.w LEFT JOIN q2 ON q2.w1 = g.w1 AND q2.w = g.w LEFT JOIN q3 ON q3.w2 = g.w2 AND q3.w1 = g.w1 AND q3.w = g.w
  LEFT JOIN a2 ON a2.w1 = g.w1 LEFT JOIN a3 ON a3.w2 = g.w2 AND a3.w1 = g.w1, world, unknown
)
SELECT doc_id, held AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, sum(base) AS base_score, sum(s3) AS score FROM d JOIN t USING (r) GROUP BY r, doc_id, held
"""


def _codes_sql(rounds: int) -> str:
    product = "list_inner_product"
    ctes = []
    for i in range(rounds + 1):
        ctes.append(
            f"assigned_{i} AS MATERIALIZED (SELECT r, p, any_value(parts.v) AS v, min(struct_pack(d := {product}(parts.v, parts.v) + {product}(b.v, b.v) - 2 * {product}(parts.v, b.v), entry := entry)) AS best FROM parts JOIN book_{i} b USING (p) GROUP BY r, p)"
        )
        if i < rounds:
            ctes.append(f"sums_{i} AS (SELECT p, entry, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT p, best.entry AS entry, unnest(v)::HUGEINT AS x, generate_subscripts(v, 1) AS i FROM assigned_{i}) GROUP BY ALL)")
            ctes.append(f"means_{i} AS (SELECT p, entry, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS v FROM sums_{i} GROUP BY p, entry)")
            ctes.append(f"book_{i + 1} AS MATERIALIZED (SELECT p, entry, coalesce(m.v, b.v) AS v FROM book_{i} b LEFT JOIN means_{i} m USING (p, entry))")
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, e[p * (len(e) // 4) + 1 : (p + 1) * (len(e) // 4)]::DOUBLE[] AS v FROM k, range(4) a(p)),
book_0 AS MATERIALIZED (SELECT p, r - 1 AS entry, v FROM parts WHERE r <= 256),
{", ".join(ctes)},
coded AS (SELECT r, string_agg(printf('%02x', best.entry), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM assigned_{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, entry, i)) AS digest FROM (SELECT p, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM book_{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM k JOIN coded USING (r), books
"""


PHRASES_SQL = rf"""
WITH p AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), f1 AS MATERIALIZED (SELECT lang, a, count(*) AS f FROM (SELECT lang, unnest(w) AS a FROM p) GROUP BY ALL
), f2 AS MATERIALIZED (SELECT lang, x.a AS a, x.b AS b, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: struct_pack(a := w[i], b := w[i + 1]))) AS x FROM p) GROUP BY ALL HAVING f >= 10
), f3 AS MATERIALIZED (SELECT lang, x.a AS a, x.b AS b, x.c AS c, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]))) AS x FROM p) GROUP BY ALL HAVING f >= 10
), longer AS (SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM f3 UNION ALL SELECT lang, b, c, f FROM f3) GROUP BY ALL
), cuts AS (
  SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.f AS a, 1 AS k, l.f AS l, r.f AS r FROM f2 JOIN f1 l USING (lang, a) JOIN f1 r ON r.lang = f2.lang AND r.a = f2.b LEFT JOIN longer ON longer.lang = f2.lang AND longer.a = f2.a AND longer.b = f2.b
    WHERE longer.f IS NULL OR 100 * longer.f < 50 * f2.f
  UNION ALL SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, 1, l.f, r.f FROM f3 JOIN f1 l USING (lang, a) JOIN f2 r ON r.lang = f3.lang AND r.a = f3.b AND r.b = f3.c
  UNION ALL SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, 2, l.f, r.f FROM f3 JOIN f2 l USING (lang, a, b) JOIN f1 r ON r.lang = f3.lang AND r.a = f3.c
), scored AS (SELECT lang, phrase, a, min(struct_pack(score := (1000000::HUGEINT * a * a) // (l::HUGEINT * r), k := k, l := l, r := r)) AS x FROM cuts GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY x.score DESC, a DESC, phrase) AS rank FROM scored)
SELECT lang, rank, phrase, a, x.l AS l, x.r AS r, n::BIGINT AS n, x.score::BIGINT AS score FROM ranked JOIN (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""

QUERIES = {f.__name__: f for f in (op11_katz_scores, op12_vector_codes, op13_phrases)}
ORACLE_SQL = {"op11_katz_scores": KATZ_SQL, "op12_vector_codes": _codes_sql(vector_codes.ROUNDS), "op13_phrases": PHRASES_SQL}

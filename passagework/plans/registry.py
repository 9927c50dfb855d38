"""The registered queries, each over whole tables, with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from passagework.functions import answers, detectors as D, display, evidence, queries as Q, text as T
from passagework.operators import cells, chunk, conversation, corpus_index, evaluate, index, numbering, pack, pair_scorer, providers, rank, search, telemetry, text_classifier, tree
from passagework.plans import retrieval, search_loop
from passagework.plans.shared import shared_folder
from passagework.plans.tables import as_chunks, chunks, executions, questions, routing, table, texts, turns
from passagework.sources import readers
from passagework.streaming import live, load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLE_SQL[query.__name__] = sql
        return query

    return add


# -- SQL pieces

WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
CLEAN = STRIP.format(r"regexp_replace(regexp_replace({}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' +', ' ', 'g')")
N_WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"
#: RE2's word boundaries know ASCII only; other letters become x for matching.
ASCII = r"regexp_replace({}, '[^\x00-\x7F]', 'x', 'g')"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def matches(column: str, pattern: str, any_case: bool = True) -> str:
    return f"regexp_matches({column}, {q('(?i)' + pattern if any_case else pattern)})"


CHUNKS = """chunks AS (SELECT doc_id AS chunk_id, source AS document_id, source || '/' || lang AS parent_id, ['raw', 'parent', 'summary'][doc_id % 3 + 1] AS node_type, (doc_id % 2)::INT AS level, text FROM documents)"""
BM25_BASE = f"""posted AS MATERIALIZED (SELECT doc_id AS chunk_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS.format("text")}) AS term FROM documents) GROUP BY ALL),
lengths AS (SELECT doc_id AS chunk_id, len({WORDS.format("text")}) AS length FROM documents),
world AS (SELECT count(*) AS n_chunks, avg(length) AS mean_length FROM lengths),
raw_terms AS (SELECT term, count(*) AS df, ln((SELECT n_chunks FROM world) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posted GROUP BY term),
terms AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw_terms) ELSE raw END AS idf FROM raw_terms),
asked AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({WORDS.format("text")}) AS term FROM benchmark) GROUP BY ALL)"""


def bm25_cte(name: str, k: int, k1: float = 1.5, b: float = 0.75) -> str:
    part = f"times * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * length / mean_length))"
    return f"""{name}_all AS (SELECT query_id, chunk_id, sum({part}) AS score FROM asked JOIN terms USING (term) JOIN posted USING (term) JOIN lengths USING (chunk_id), world GROUP BY ALL),
{name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {name}_all) WHERE rank <= {k} AND score > 0)"""


LISTS = f"{BM25_BASE}, {bm25_cte('one', 20)}, {bm25_cte('two', 20, 0.9, 0.4)}, lists AS (SELECT query_id, 'one' AS list_id, 1.25 AS weight, rank, chunk_id, score FROM one UNION ALL SELECT query_id, 'two', 1.0, rank, chunk_id, score FROM two)"
FUSED = f"""{LISTS}, sums AS (SELECT query_id, chunk_id, sum(weight / (120 + rank)) AS score, min(struct_pack(l := list_id, r := rank)) AS seen FROM lists GROUP BY ALL),
fused AS MATERIALIZED (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS rank FROM sums WHERE round(score, 12) >= 0.009)"""


def two_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = search.bm25_lists(chunks(spark, sf_dir), questions(spark, sf_dir), 20, {"one": (1.5, 0.75), "two": (0.9, 0.4)})
    return lists.select("query_id", "list_id", F.when(F.col("list_id") == "one", 1.25).otherwise(1.0).alias("weight"), "rank", "chunk_id", "score")


# -- text


@register(f"SELECT doc_id, md5({CLEAN.format('text')}) AS cleaned, length({CLEAN.format('text')})::BIGINT AS n_chars FROM documents")
def clean_text(spark, sf_dir):
    cleaned = T.clean_text(F.col("text"))
    return texts(spark, sf_dir, "documents").select("doc_id", F.md5(cleaned).alias("cleaned"), F.length(cleaned).cast("long").alias("n_chars"))


@register(f"SELECT doc_id, len({WORDS.format('text')})::BIGINT AS n_words, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4.0)) END::BIGINT AS n_tokens FROM documents")
def token_estimates(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_words"), T.token_estimate(F.col("text")).alias("n_tokens"))


@register(
    rf"""WITH s AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.format("x")}), lambda x: length(x) > 10) AS kept FROM documents)
    SELECT doc_id, greatest(len(kept), 1)::BIGINT AS n_units, md5(CASE WHEN len(kept) = 0 THEN text ELSE array_to_string(kept, '|') END) AS units FROM s"""
)
def sentence_units(spark, sf_dir):
    units = T.units(F.col("text"))
    return texts(spark, sf_dir, "documents").select("doc_id", F.size(units).cast("long").alias("n_units"), F.md5(F.array_join(units, "|")).alias("units"))


def _page_sql() -> str:
    patterns = [p.replace("[-–—]", "(?:-|–|—)") for p in T.PAGE_NUMBER]
    found = [f"try_cast(regexp_extract({zone}, {q(p)}, 1) AS INT)" for zone in ("left(text, 300)", "right(text, 300)") for p in patterns]
    return f"SELECT doc_id, coalesce({', '.join(f'CASE WHEN {x} BETWEEN 1 AND 9999 THEN {x} END' for x in found)}, (doc_id % 500 + 1)::INT) AS page FROM documents"


@register(_page_sql())
def printed_pages(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", T.printed_page(F.col("text"), (F.col("doc_id") % 500 + 1).cast("int")).alias("page"))


def _shape_sql() -> str:
    count = lambda p: f"len(regexp_extract_all(text, {q('(?m)' + p)}))"
    equations = f"{count(T.EQUATION_MARK)} >= 4"
    return f"""SELECT doc_id, CASE WHEN {STRIP.format("text")} = '' THEN 'empty' WHEN {count(T.LEGAL_HEADER)} >= 2 THEN 'legal_clause'
    WHEN {count(T.NUMBERED_HEADER)} >= 3 THEN CASE WHEN {equations} THEN 'numbered_spec_academic' ELSE 'numbered_spec' END
    WHEN regexp_matches(text, {q("(?m)" + T.CODE_MARK)}) THEN 'code_heavy' WHEN {equations} THEN 'academic_dense' ELSE 'prose' END AS shape FROM documents"""


@register(_shape_sql())
def text_shapes(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", T.text_shape(F.col("text")).alias("shape"))


@register()
def chunked_pages(spark, sf_dir):
    """Parent and child chunks of all documents."""
    docs = texts(spark, sf_dir, "documents")
    return chunk.chunk_pages(docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("source_file"), F.lit(1).alias("physical_page"), "text"))


@register()
def chunked_pages_sql(spark, sf_dir):
    """chunked_pages() as Spark SQL, by a table function."""
    docs = texts(spark, sf_dir, "documents")
    chunk.register_chunker(docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("source_file"), F.lit(1).alias("physical_page"), "text"), "shaped_documents")
    return spark.sql("SELECT c.* FROM shaped_documents p, LATERAL chunk_units(p.document_id, p.source_file, p.physical_page, p.doc_shape, p.units) c")


@register(
    """WITH p AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents),
    w AS (SELECT source, (page - 1) // 3 AS slot, min(page) AS first_page, max(page) AS last_page, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM p GROUP BY ALL)
    SELECT source AS document_id, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS window_no, first_page, last_page, length(text)::BIGINT AS n_chars FROM w WHERE length(text) >= 200"""
)
def page_windows(spark, sf_dir):
    docs = numbering.numbered(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["source"], [F.col("doc_id")], F.floor(F.col("doc_id") / 1000), "physical_page")
    windows = chunk.page_windows(docs.select(F.col("source").alias("document_id"), "physical_page", "text"))
    return windows.select("document_id", F.col("window").cast("long").alias("window_no"), "first_page", "last_page", F.length("text").cast("long").alias("n_chars"))


def _html_sql() -> str:
    t, gap, space = "coalesce(html, '')", "chr(1)", r"[\s\x0b\x{85}\x{a0}\p{Z}]+"
    for name in readers.DROPPED_ELEMENTS:
        t = rf"regexp_replace({t}, '(?is)<{name}\b[^>]*>.*?</{name}\s*>', {gap}, 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '(?s)<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g'), '(?s)<[^>]+>', {gap}, 'g')"
    for entity, mark in readers.ENTITIES:
        t = f"replace({t}, {q(entity)}, {q(mark)})"
    stripped = lambda x: f"regexp_replace({x}, '^{space}|{space}$', '', 'g')"
    lines = rf"regexp_split_to_array(array_to_string(list_filter(string_split(t, {gap}), lambda x: x <> ''), ' '), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
    pieces = f"list_transform(flatten(list_transform({lines}, lambda x: string_split({stripped('x')}, '  '))), lambda x: {stripped('x')})"
    return f"raw AS (SELECT page_id, {t} AS t FROM pages), html AS (SELECT page_id, array_to_string(list_filter({pieces}, lambda x: x <> ''), chr(10)) AS text FROM raw)"


@register(f"WITH {_html_sql()} SELECT page_id, length(text)::BIGINT AS n_chars, md5(text) AS text FROM html")
def html_texts(spark, sf_dir):
    """Pages' visible text by built-in functions."""
    text = readers.html_text_builtin(F.col("html"))
    return texts(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("text"))


@register(
    rf"""WITH h AS (SELECT page_id, url, regexp_replace(lower(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '')), '^www\.', '') AS host FROM pages)
    SELECT page_id, host FROM h WHERE starts_with(url, 'http') AND NOT contains(url, '/clev?event=') AND NOT {has("coalesce(host, '')", evidence.UNFETCHED_HOSTS)}"""
)
def candidate_pages(spark, sf_dir):
    return readers.candidate_pages(table(spark, sf_dir, "pages")).select("page_id", "host")


# -- index and search


@register(f"WITH {BM25_BASE} SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_term_stats(spark, sf_dir):
    words = chunks(spark, sf_dir).select(T.tokens(F.col("text")).alias("words"))
    return index.term_stats(*index.statistics(words.withColumn("length", F.size("words")))).select("term", "df", F.round("idf", 6).alias("idf"))


@register(f"WITH {BM25_BASE}, {bm25_cte('hits', 10)} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM hits")
def bm25_topk(spark, sf_dir):
    return search.bm25_topk(chunks(spark, sf_dir), questions(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@register(ORACLE_SQL["bm25_topk"])
def bm25_topk_saved(spark, sf_dir):
    """bm25_topk() from an index that is written and loaded again."""
    folder = shared_folder(spark, "index")
    index.save_index(folder, chunks(spark, sf_dir))
    return search.bm25_topk_indexed(index.load_index(spark, folder), questions(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


#: The documents after the changes of bm25_topk_segments().
_CHANGED = """changed AS MATERIALIZED (SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' ' || source ELSE text END AS text FROM documents WHERE source <> 'src3' OR source IS NULL)"""


@register(f"WITH {_CHANGED}, {BM25_BASE.replace('FROM documents', 'FROM changed')}, {bm25_cte('hits', 10)} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM hits")
def bm25_topk_segments(spark, sf_dir):
    """bm25_topk() from a saved index that grew in steps: the English documents, all that were missing, German ones anew, and one source deleted."""
    held, docs = chunks(spark, sf_dir), texts(spark, sf_dir, "documents")
    of = lambda lang: as_chunks(docs.where(F.col("lang") == lang))
    saved = corpus_index.insert(corpus_index.open_index(spark, shared_folder(spark, "segments")), of("en"))
    saved = corpus_index.insert(saved, held)
    saved = corpus_index.upsert(saved, of("de").withColumn("text", F.concat("text", F.lit(" "), "document_id")))
    saved = corpus_index.delete_document(saved, "src3")
    return search.bm25_topk_blocks(saved, questions(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@register(
    f"""WITH {CHUNKS}, {BM25_BASE}, {bm25_cte("hits", 10**9)}, kept AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM hits JOIN chunks USING (chunk_id) WHERE node_type = 'raw')
    SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM kept WHERE rank <= 10"""
)
def bm25_topk_raw(spark, sf_dir):
    """The ten best raw chunks: the kind is chosen before the cut."""
    return search.bm25_topk(chunks(spark, sf_dir), questions(spark, sf_dir), 10, kinds=["raw"]).withColumn("score", F.round("score", 6))


@register(f"WITH {BM25_BASE}, {bm25_cte('hits', 10)} SELECT query_id, chunk_id, rank::INT AS rank, round(score, 6) AS score, left(text, 200) AS preview FROM hits JOIN documents ON doc_id = chunk_id WHERE rank <= 5")
def trace_summaries(spark, sf_dir):
    """What a trace shows of each question's first five hits."""
    held = chunks(spark, sf_dir)
    hits = search.with_chunks(search.bm25_topk(held, questions(spark, sf_dir), 10), held.select("chunk_id", "text"))
    return answers.trace_summary(hits, 5).withColumn("score", F.round("score", 6))


@register(
    """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, 1 / (1 + list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) AS score
      FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)
    SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM p) WHERE rank <= 10"""
)
def dense_topk(spark, sf_dir):
    """The ten nearest vectors of every fiftieth one, among all."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = rows.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    return search.dense_topk(rows, asked, 10).withColumn("score", F.round("score", 6))


@register(ORACLE_SQL["dense_topk"])
def dense_topk_saved(spark, sf_dir):
    """dense_topk() from saved vectors, by the cells that distance bounds leave."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("document_id"))
    held = rows.select("chunk_id", "document_id", F.lit(None).cast("string").alias("parent_id"), F.lit("raw").alias("node_type"), F.lit(0).alias("level"), F.lit("").alias("text"))
    saved = corpus_index.insert(corpus_index.open_index(spark, shared_folder(spark, "cells")), held, rows.select("chunk_id", "vector"))
    asked = rows.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return cells.dense_topk_cells(saved, asked, 10).withColumn("score", F.round("score", 6))


@register(
    """WITH d AS (SELECT label * 20 + vec_id % 20 AS doc_id, embedding AS e FROM embeddings), u AS (SELECT label AS query_id, vec_id AS unit, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
    m AS (SELECT query_id, doc_id, unit, max(list_inner_product(d.e::DOUBLE[], u.e::DOUBLE[])) AS s FROM d, u GROUP BY ALL), s AS (SELECT query_id, doc_id, avg(s) AS score FROM m GROUP BY ALL)
    SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 5"""
)
def maxsim_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    units = rows.select((F.col("label") * 20 + F.col("vec_id") % 20).alias("doc_id"), F.col("embedding").alias("vector"))
    asked = rows.where("vec_id % 50 = 0").select(F.col("label").alias("query_id"), F.col("vec_id").alias("unit"), F.col("embedding").alias("vector"))
    return search.maxsim_topk(units, asked, 5).withColumn("score", F.round("score", 6))


@register(
    f"""WITH {CHUNKS}, {BM25_BASE}, {bm25_cte("hits", 24)}, kept AS (SELECT query_id, chunk_id, score FROM hits JOIN chunks USING (chunk_id) WHERE node_type = 'raw')
    SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM kept) WHERE rank <= 8"""
)
def kind_filter_after_search(spark, sf_dir):
    held = chunks(spark, sf_dir)
    hits = search.bm25_topk(held, questions(spark, sf_dir), 24).join(held.select("chunk_id", "node_type"), "chunk_id")
    return search.filter_after_search(hits, ["raw"], 8).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@register("SELECT doc_id AS chunk_id, CASE WHEN lang = 'en' THEN 'old' ELSE 'new' END AS batch FROM documents")
def insert_if_absent(spark, sf_dir):
    """All documents put into an index that has the English ones."""
    docs = table(spark, sf_dir, "documents")
    held = docs.where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"), F.lit("old").alias("batch"))
    return index.insert_if_absent(held, docs.select(F.col("doc_id").alias("chunk_id"), F.lit("new").alias("batch")))


@register("SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def upsert_latest(spark, sf_dir):
    return index.upsert_latest(table(spark, sf_dir, "events"), "user_id", F.col("event_id")).select("user_id", "event_type", "event_id")


@register("SELECT doc_id AS chunk_id, source AS document_id FROM documents WHERE source <> 'src3' OR source IS NULL")
def delete_document(spark, sf_dir):
    return index.delete_document(chunks(spark, sf_dir), "src3").select("chunk_id", "document_id")


@register(
    """SELECT c.doc_id AS chunk_id, md5(CASE WHEN c.doc_id % 3 = 0 THEN coalesce(p.text, c.text) ELSE c.text END) AS context FROM documents c LEFT JOIN documents p ON p.doc_id = c.doc_id - c.doc_id % 10 + 1 AND p.doc_id % 3 = 1"""
)
def parent_expansion(spark, sf_dir):
    held = chunks(spark, sf_dir).withColumn("parent_id", F.col("chunk_id") - F.col("chunk_id") % 10 + 1)
    return rank.expand_parents(held, held.where("node_type = 'parent'")).select("chunk_id", F.md5("context_text").alias("context"))


# -- ranking


@register(f"WITH {FUSED} SELECT query_id, chunk_id, round(score, 9) AS score, rank::INT AS rank FROM fused")
def rrf_fusion(spark, sf_dir):
    return rank.weighted_rrf(two_lists(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


DIVERSE = f"""{CHUNKS}, {FUSED}, p AS (SELECT f.*, document_id, parent_id, row_number() OVER (PARTITION BY query_id, document_id, parent_id ORDER BY rank) AS np FROM fused f JOIN chunks USING (chunk_id)),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, np <= 1 ORDER BY rank) AS nd FROM p),
diverse AS (SELECT query_id, chunk_id, np <= 1 AND nd <= 2 AS picked, row_number() OVER (PARTITION BY query_id ORDER BY (np <= 1 AND nd <= 2) DESC, rank) AS rank FROM d)"""


@register(f"WITH {DIVERSE} SELECT query_id, chunk_id, picked, rank::INT AS rank FROM diverse WHERE rank <= 5")
def diversified(spark, sf_dir):
    hits = search.with_chunks(rank.weighted_rrf(two_lists(spark, sf_dir)), chunks(spark, sf_dir).select("chunk_id", "document_id", "parent_id"))
    return rank.diversify(hits, 5, per_document=2, per_parent=1).select("query_id", "chunk_id", "picked", "rank")


MERGED = f"""{LISTS}, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY list_id, rank) AS n FROM lists) WHERE n = 1)"""


@register(f"WITH {MERGED} SELECT query_id, chunk_id, list_id, row_number() OVER (PARTITION BY query_id ORDER BY list_id, rank)::INT AS rank FROM firsts")
def merged_lists(spark, sf_dir):
    return rank.merge_first(two_lists(spark, sf_dir)).select("query_id", "chunk_id", "list_id", "rank")


@register(
    f"""WITH {CHUNKS}, {FUSED}, head AS (SELECT * FROM (SELECT query_id, chunk_id, one.score, row_number() OVER (PARTITION BY query_id ORDER BY level DESC, one.score DESC, chunk_id) AS rank FROM one JOIN chunks USING (chunk_id) WHERE node_type = 'summary') WHERE rank <= 3),
    both_lists AS (SELECT query_id, 0 AS l, chunk_id, rank FROM head UNION ALL SELECT query_id, 1, chunk_id, rank FROM fused), firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY l) AS n FROM both_lists) WHERE n = 1)
    SELECT query_id, chunk_id, rank::INT AS rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY l, rank) AS rank FROM firsts) WHERE rank <= 30"""
)
def reserved_summaries(spark, sf_dir):
    held, lists = chunks(spark, sf_dir), two_lists(spark, sf_dir)
    summaries = lists.where("list_id = 'one'").join(held.where("node_type = 'summary'").select("chunk_id", "level"), "chunk_id")
    return rank.reserve_summaries(rank.weighted_rrf(lists), summaries, 5).select("query_id", "chunk_id", "rank")


@register(
    f"""WITH {BM25_BASE}, {bm25_cte("hits", 10)} SELECT query_id, coalesce(count(*) > 1 AND (contains(lower(max(text)), 'compare') OR contains(lower(max(text)), 'difference')
      OR round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 9) < 0.1), false) AS needed FROM hits JOIN benchmark ON item_id = query_id GROUP BY query_id"""
)
def rerank_triggers(spark, sf_dir):
    asked = questions(spark, sf_dir)
    return rank.needs_rerank(search.bm25_topk(chunks(spark, sf_dir), asked, 10).join(asked, "query_id"))


@register(
    f"""WITH {BM25_BASE}, {bm25_cte("hits", 16)}, t AS (SELECT query_id, chunk_id, rank, list_distinct({WORDS.format("b.text")}) AS a, {WORDS.format("d.text")} AS w FROM hits JOIN benchmark b ON item_id = query_id JOIN documents d ON d.doc_id = chunk_id),
    s AS (SELECT *, coalesce(len(list_intersect(a, w)) / nullif(len(a), 0), 0) AS rerank_score FROM t)
    SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, rank) AS n FROM s) WHERE n <= 5"""
)
def reranked(spark, sf_dir):
    held, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    hits = search.with_chunks(search.bm25_topk(held, asked, 16), held.select("chunk_id", "text")).join(asked, "query_id")
    return rank.rerank(hits, 5).select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


def _packed_sql() -> str:
    points = lambda name: "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in zip(pack.KINDS, pack.BY_QUESTION[name], strict=True)) + " ELSE 0 END"
    starts = " OR ".join(f"starts_with(low, '{p}')" for p in pack.FACT_STARTS)
    score = f"""greatest(0, score) + CASE WHEN starts THEN {points("fact")} WHEN joins THEN {points("synthesis")} ELSE {points("other")} END
      + CASE WHEN regexp_matches(low, {q(Q.NEGATION)}) THEN CASE WHEN kind = 'raw' THEN 0.08 ELSE 0.02 END ELSE 0 END + CASE WHEN regexp_matches(query, '["'']') AND len(list_filter(asked, lambda w: length(w) > 2 AND contains(body, w))) > 0 THEN 0.2 ELSE 0 END
      + least(1.0, len(list_intersect(asked, words)) / greatest(1.0, sqrt(greatest(len(asked), 1)))) * 0.45 + CASE WHEN low <> '' AND contains(body, low) THEN 1.5 ELSE 0 END
      + CASE WHEN starts AND kind = 'raw' THEN greatest(0, 0.18 - greatest(len(words), 1) / 2500.0) WHEN NOT starts AND joins AND kind IN ('parent', 'summary') THEN least(0.22, greatest(len(words), 1) / 3000.0) ELSE 0 END"""
    order = "pack_score DESC, kind <> 'raw', len(words), chunk_id"
    fits = f"used + n_tokens <= budget AND taken < {pack.MOST_CHUNKS} AND len(list_filter(documents, lambda x: x = document_id)) < {pack.PER_DOCUMENT} AND len(list_filter(parents, lambda x: x = parent_id)) < {pack.PER_PARENT}"
    return f"""WITH RECURSIVE {CHUNKS}, {FUSED}, shapes AS ({_shape_sql()}),
    h AS (SELECT query_id, chunk_id, f.score, node_type AS kind, document_id, parent_id, c.text, shape, trim(b.text) AS query FROM fused f JOIN chunks c USING (chunk_id) JOIN shapes ON doc_id = chunk_id JOIN benchmark b ON item_id = query_id),
    w AS (SELECT *, lower(query) AS low, lower(text) AS body, {WORDS.format("text")} AS words, list_distinct({WORDS.format("query")}) AS asked FROM h), k AS (SELECT *, ({starts}) AS starts, {has("low", pack.SYNTHESIS)} AS joins FROM w),
    s AS (SELECT *, round({score}, 9) AS pack_score, bool_or(shape IN ('academic_dense', 'numbered_spec_academic')) OVER (PARTITION BY query_id) AS dense, bool_or(shape = 'legal_clause') OVER (PARTITION BY query_id) AS legal FROM k),
    d AS (SELECT *, CASE WHEN dense THEN 2025 WHEN legal THEN 1725 ELSE 1500 END AS budget, kind = 'raw' AND row_number() OVER (PARTITION BY query_id, kind ORDER BY {order}) = 1 AS seed FROM s),
    ordered AS MATERIALIZED (SELECT query_id, chunk_id, kind, document_id, parent_id, budget, pack_score, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4.0)) END::BIGINT AS n_tokens, row_number() OVER (PARTITION BY query_id ORDER BY seed DESC, {order}) AS place FROM d),
    fold AS (SELECT query_id, 0::BIGINT AS place, 0::BIGINT AS used, 0 AS taken, []::VARCHAR[] AS documents, []::VARCHAR[] AS parents, false AS fits FROM (SELECT DISTINCT query_id FROM ordered) UNION ALL
      SELECT query_id, place, used + CASE WHEN fits THEN n_tokens ELSE 0 END, taken + fits::INT, CASE WHEN fits THEN list_append(documents, document_id) ELSE documents END, CASE WHEN fits THEN list_append(parents, parent_id) ELSE parents END, fits
      FROM (SELECT o.*, used, taken, documents, parents, {fits} AS fits FROM fold JOIN ordered o ON o.query_id = fold.query_id AND o.place = fold.place + 1)),
    packed AS (SELECT query_id::VARCHAR AS query_id, chunk_id::VARCHAR AS chunk_id, taken::INT AS packed_rank, round(pack_score, 6) AS score, n_tokens, kind FROM fold JOIN ordered USING (query_id, place) WHERE fits)"""


@register(f"{_packed_sql()} SELECT * FROM packed")
def packed_context(spark, sf_dir):
    """Contexts of all questions from their fused hits."""
    held, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    hits = search.with_chunks(rank.weighted_rrf(two_lists(spark, sf_dir)), held).join(asked, "query_id").withColumn("doc_shape", T.text_shape(F.col("text")))
    return pack.pack_context(hits).withColumn("score", F.round("score", 6))


@register()
def routed_retrieval(spark, sf_dir):
    """All questions by their complexity, over all documents as chunks and their hashed vectors. Documents of ten ids in a row are a section; the parent among the first two is their parent."""
    held = chunks(spark, sf_dir).withColumn("parent_id", F.col("chunk_id") - F.col("chunk_id") % 10 + 1)
    vectors = providers.hash_embedder(held.select("chunk_id", "text"), "text").select("chunk_id", "vector")
    return retrieval.retrieve(retrieval.Corpus(held, vectors), questions(spark, sf_dir)).drop("context_text")


# -- queries of conversations

TURNS = f"t AS (SELECT conv_id, turn, role, coalesce(text, '') AS q, {ASCII.format('coalesce(text, chr(32))')} AS a, lower({ASCII.format('coalesce(text, chr(32))')}) AS low FROM conversations)"


def _scores_sql() -> str:
    keywords = " + ".join(f"contains(low, {q(w)})::INT" for w in D.MATH_KEYWORDS)
    expressions = " OR ".join(matches("a" if "∫" not in p else "q", p, False) for p in D.MATH_EXPRESSIONS)
    math = f"least(({keywords}) * 0.2, 0.4) + CASE WHEN {expressions} THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(a, '\\d') AND regexp_matches(a, '[-+*/=^]') THEN 0.3 ELSE 0 END + CASE WHEN contains(a, '\\') AND regexp_matches(a, '[_^{{]') THEN 0.4 ELSE 0 END"
    add = lambda test, x: f"CASE WHEN {test} THEN {x} ELSE 0 END"
    code = " + ".join([add(f"{matches('a', D.CODE_FENCE, False)} OR {matches('a', D.CODE_TRACE)}", 0.5), add(matches("a", D.CODE_ACTIONS), 0.3), add(matches("a", D.CODE_LANGUAGES), 0.2)])
    n = N_WORDS.format("q")
    writing = f"CASE WHEN {matches('a', D.WRITING_KEYWORDS)} THEN 0.5 + {add(f'{n} > 30 AND {has("low", D.WRITING_EDITS)}', 0.3)} ELSE 0 END"
    research = f"CASE WHEN {matches('a', D.RESEARCH_KEYWORDS)} THEN 0.6 WHEN {n} > 15 THEN 0.3 ELSE 0 END"
    knowledge = f"CASE WHEN {matches('a', D.KNOWLEDGE_KEYWORDS)} THEN 0.6 + {add(f'{n} < 15', 0.2)} ELSE 0 END - {add(matches('a', D.KNOWLEDGE_RECENCY), 0.5)}"
    only = lambda test, p: f"CASE WHEN {test} THEN 0.4 + {add(matches('a', p), 0.5)} ELSE 0 END"
    raw = {"math": math, "code": code, "data": only("turn % 3 = 0", D.DATA_KEYWORDS), "document": only("turn % 2 = 0", D.DOCUMENT_KEYWORDS), "writing": writing, "research": research, "knowledge": knowledge}
    return f"{TURNS}, scores AS (SELECT conv_id, turn, " + ", ".join(f"greatest(0, least(1, ({raw[x]})::DOUBLE)) AS {x}" for x in D.AGENTS) + " FROM t)"


SCORES = _scores_sql()


def _scored(spark, sf_dir):
    return D.raw_scores(F.col("query"), F.col("turn") % 2 == 0, F.col("turn") % 3 == 0)


@register(f"WITH {SCORES} SELECT conv_id, turn, {', '.join(f'round({a}, 6) AS {a}' for a in D.AGENTS)} FROM scores")
def detector_scores(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", *(F.round(c, 6).alias(name) for name, c in _scored(spark, sf_dir).items()))


PLATT = SCORES + ", platt AS (SELECT conv_id, turn, " + ", ".join(f"1 / (1 + exp(-({a} * {name} + ({b})))) AS {name}" for name, (a, b) in D.PLATT.items()) + " FROM scores)"


@register(f"WITH {PLATT} SELECT conv_id, turn, {', '.join(f'round({a}, 6) AS {a}' for a in D.AGENTS)} FROM platt")
def platt_scores(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", *(F.round(c, 6).alias(name) for name, c in D.calibrated(_scored(spark, sf_dir)).items()))


@register(
    f"""WITH {PLATT}, long AS ({" UNION ALL ".join(f"SELECT conv_id, turn, '{a}' AS agent, {i} AS priority, {a} AS score FROM platt" for i, a in enumerate(D.AGENTS))}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, priority) AS n FROM long)
    SELECT conv_id, turn, CASE WHEN one.score >= 0.2 THEN one.agent END AS selected_agent, CASE WHEN one.score >= 0.5 THEN one.agent END AS dispatched_agent, round(one.score, 6) AS confidence,
      two.agent AS runner_up_agent, round(one.score - two.score, 6) AS margin, one.score >= 0.2 AND one.score - two.score < 0.05 AS ambiguous
    FROM (SELECT * FROM ranked WHERE n = 1) one JOIN (SELECT * FROM ranked WHERE n = 2) two USING (conv_id, turn)"""
)
def route_decisions(spark, sf_dir):
    told = turns(spark, sf_dir).select("conv_id", "turn", D.route_decision(D.calibrated(_scored(spark, sf_dir))).alias("d"))
    return told.select("conv_id", "turn", "d.selected_agent", "d.dispatched_agent", F.round("d.confidence", 6).alias("confidence"), "d.runner_up_agent", F.round("d.margin", 6).alias("margin"), "d.ambiguous")


LEGAL_SQL = f"({matches('low', Q.LEGAL)} OR ({matches('low', Q.LEGAL_IF_NOT_TECHNICAL)} AND NOT {matches('low', Q.TECHNICAL)}))"
NEGATIVE_SQL = f"({matches('low', Q.NEGATION)} OR {matches('low', Q.IMPLIED_NEGATION)})"


@register(
    f"""WITH {TURNS} SELECT conv_id, turn, CASE WHEN {matches("trim(low)", Q.GLOBAL)} THEN 'global' WHEN {matches("trim(low)", Q.MULTI_HOP)} OR {NEGATIVE_SQL} OR {LEGAL_SQL} OR {has("trim(low)", Q.CLAUSE_JOINTS)}
      OR length(low) - length(replace(low, '?', '')) >= 2 THEN 'multi_hop' ELSE 'simple' END AS complexity FROM t"""
)
def complexity_classes(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", Q.complexity(F.col("query")).alias("complexity"))


FEATURES = {
    "has_numbers": r"regexp_matches(a, '\d')", "has_quotes": r"""regexp_matches(a, '["'']')""", "has_capitalized_tokens": r"regexp_matches(a, '\b[A-Z][a-zA-Z0-9_]{1,}\b')",
    "is_comparative": has("low", Q.COMPARATIVE), "is_semantic": has("low", Q.SEMANTIC), "has_code_tokens": r"regexp_matches(a, '[()\[\]{}<>:=_/\\.-]')", "has_negation": NEGATIVE_SQL,
}


@register(f"WITH {TURNS} SELECT conv_id, turn, {', '.join(f'{v} AS {k}' for k, v in FEATURES.items() if k != 'has_capitalized_tokens')}, {N_WORDS.format('q')}::INT AS word_count FROM t")
def query_features(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", Q.features(F.col("query")).alias("f")).select("conv_id", "turn", "f.*").drop("has_capitalized_tokens")


SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def _variants_sql() -> str:
    swap = lambda c, pattern, to: f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"
    versus = f"replace(replace({swap('s', r'(?i)\bvs\b', 'versus')}, ' versus ', ' and '), ' compare ', ' comparison ')"
    difference = swap("s", r"(?i)\b(compare|comparison|difference between|difference)\b", "difference between")
    plain = SQUEEZE.format(swap("CASE WHEN bare <> '' THEN bare ELSE s END", "[-/]", " "))
    return rf"""WITH t AS (SELECT conv_id, turn, {SQUEEZE.format("coalesce(text, '')")} AS s FROM conversations),
    u AS (SELECT *, {ASCII.format("lower(s)")} AS low, {SQUEEZE.format(r"regexp_replace(s, '[^\p{L}\p{M}\p{Nd}_\s]+', ' ', 'g')")} AS bare FROM t),
    v AS (SELECT conv_id, turn, [s, bare, {plain}, CASE WHEN {NEGATIVE_SQL} THEN {SQUEEZE.format(swap("s", "(?i)" + Q.NEGATION, " "))} END, CASE WHEN {LEGAL_SQL} THEN {SQUEEZE.format(swap("s", Q.LEGAL_FILLER, ""))} END,
      CASE WHEN {has("low", Q.COMPARATIVE)} THEN {SQUEEZE.format(versus)} END, CASE WHEN {has("low", Q.COMPARATIVE)} THEN {SQUEEZE.format(difference)} END] AS l FROM u),
    w AS (SELECT conv_id, turn, list_filter(list_transform(l, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '') AS l FROM v),
    k AS (SELECT conv_id, turn, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)[1:4] AS l FROM w)
    SELECT conv_id, turn, unnest(range(0, len(l)))::INT AS i, unnest(l) AS variant FROM k"""


@register(_variants_sql())
def query_variants(spark, sf_dir):
    """Ways to ask each turn."""
    told = turns(spark, sf_dir).select("conv_id", "turn", Q.variants(F.col("query")).alias("v"))
    return told.select("conv_id", "turn", F.posexplode("v").alias("i", "variant"))


@register(
    f"""WITH {SCORES}, r AS (SELECT conv_id, turn, {has("low", Q.ROUTE_SEMANTIC)} AS semantic, {matches("a", Q.IDENTIFIER, False)} AS exact, regexp_matches(a, '["'']') AS quoted, {N_WORDS.format("q")} AS n FROM t)
    SELECT conv_id, turn, CASE WHEN semantic AND NOT exact AND NOT quoted THEN CASE WHEN math >= 0.6 THEN 'math' ELSE 'dense' END WHEN quoted OR (exact AND n < 6 AND NOT semantic) THEN 'bm25' ELSE 'hybrid' END AS route
    FROM r JOIN scores USING (conv_id, turn)"""
)
def query_routes(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", Q.route(F.col("query")).alias("route"))


def _plans_sql() -> str:
    capital = r"regexp_matches(coalesce(text, ''), '(^|[^\p{L}\p{M}\p{N}_])[A-Z][a-zA-Z0-9_]+($|[^\p{L}\p{M}\p{N}_])')"
    add = lambda test, x: f"CASE WHEN {test} THEN {x} ELSE 0 END"
    bm25 = f"1 + {add('lexical', 0.25)} + {add('is_comparative', 0.1)} + {add('has_negation', 0.2)} + {add(chr(39).join(('route = ', 'bm25', '')), 0.35)}"
    dense = f"1 + {add('is_semantic', 0.2)} + {add('is_comparative', 0.1)} + {add('has_negation', 0.05)} + {add(chr(39).join(('route = ', 'dense', '')), 0.35)}"
    return f"""WITH j AS (SELECT *, has_numbers OR has_quotes OR has_code_tokens OR {capital} AS lexical, word_count >= 12 AS long FROM ({ORACLE_SQL["query_features"]}) JOIN ({ORACLE_SQL["query_routes"]}) USING (conv_id, turn)
      JOIN ({ORACLE_SQL["complexity_classes"]}) USING (conv_id, turn) JOIN conversations USING (conv_id, turn))
    SELECT conv_id, turn, route, round({bm25}, 6)::DOUBLE AS bm25_weight, round({dense}, 6)::DOUBLE AS dense_weight, 20 AS bm25_budget, CASE WHEN route IN ('bm25', 'dense') THEN 10 ELSE 20 END AS dense_budget,
      CASE complexity WHEN 'global' THEN true WHEN 'multi_hop' THEN NOT (route = 'bm25' AND NOT (has_negation OR is_comparative)) AND (long OR is_comparative OR (has_negation AND NOT is_semantic)) ELSE route <> 'bm25' AND (long OR is_comparative) END AS summaries FROM j"""


@register(_plans_sql())
def retrieval_plans(spark, sf_dir):
    """Each turn's route, with its lists' weights and budgets for five hits, and whether summaries join in."""
    q = F.col("query")
    told = turns(spark, sf_dir).select("conv_id", "turn", Q.features(q).alias("f"), Q.route(q).alias("route"), Q.complexity(q).alias("how"))
    told = told.select("conv_id", "turn", "route", Q.arm_weights(F.col("route"), F.col("f")).alias("w"), Q.budgets(F.col("route"), 5).alias("b"), Q.wants_summaries(F.col("route"), F.col("f"), F.col("how")).alias("summaries"))
    weights = [F.round(f"w.{x}", 6).alias(f"{x}_weight") for x in ("bm25", "dense")]
    return told.select("conv_id", "turn", "route", *weights, F.col("b.bm25").alias("bm25_budget"), F.col("b.dense").alias("dense_budget"), "summaries")


@register(
    f"WITH {TURNS}, f AS (SELECT conv_id, turn, CASE "
    + " ".join(f"WHEN regexp_matches(lower(q), {q(p)}) THEN struct_pack(f := '{name}', c := {1.0 if len(p) > 6 else 0.8})" for name, ps in display.FORMATS.items() for p in ps)
    + " ELSE struct_pack(f := 'prose', c := 0.0) END AS s FROM t) SELECT conv_id, turn, s.f AS format, s.c::DOUBLE AS confidence FROM f"
)
def display_formats(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", display.display_format(F.col("query")).alias("s")).select("conv_id", "turn", "s.format", "s.confidence")


def _entities_sql() -> str:
    bare = "list_filter(list_transform({}, lambda x: regexp_replace(trim(x), '[?.,!]+$', '')), lambda x: length(x) > 1)"
    listed = "coalesce(" + ", ".join(f"nullif(regexp_extract(s, {q(p)}, 1), '')" for p in display.BEFORE_NAMES) + ")"
    for p in display.AFTER_NAMES:
        listed = f"regexp_replace({listed}, {q(p)}, '')"
    known = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in display.TYPOS.items()) + "}"
    words = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')"
    return f"""WITH t AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS s, {words} AS w FROM conversations), l AS (SELECT *, {listed} AS listed, regexp_split_to_array(s, {q(display.SIDES)}) AS sides FROM t)
    SELECT conv_id, turn, CASE WHEN len(sides) > 1 THEN {bare.format("flatten(list_transform(sides, lambda x: regexp_split_to_array(x, '(?i)\\s+and\\s+')))")}
      WHEN listed IS NOT NULL THEN list_filter({bare.format(f"regexp_split_to_array(listed, {q(display.NAMES)})")}, lambda x: NOT regexp_matches(x, {q(display.NO_NAME)})) ELSE [] END AS entities,
      md5(array_to_string(list_transform(w, lambda x: coalesce({known}[regexp_replace(lower(x), '[.,!?]+$', '')], x)), ' ')) AS fixed FROM l"""


@register(_entities_sql())
def compared_entities(spark, sf_dir):
    """Entities and typo-free wording of all turns."""
    return turns(spark, sf_dir).select("conv_id", "turn", display.compared_entities(F.col("query")).alias("entities"), F.md5(display.fix_typos(F.col("query"))).alias("fixed"))


def _understanding_sql() -> str:
    starts = lambda words: "(" + " OR ".join(f"starts_with(n, {q(w)})" for w in words) + ")"
    prefix = "CASE " + " ".join(f"WHEN starts_with(n, {q(p)}) THEN {q(p)}" for p in Q.CONCEPT_STARTS) + " ELSE '' END"
    simple = f"n <> '' AND NOT {NEGATIVE_SQL} AND NOT {LEGAL_SQL} AND NOT {starts(Q.NEVER_SIMPLE)} AND {N_WORDS.format('n')} <= 8 AND {starts(Q.SIMPLE_STARTS)}"
    plan = lambda i: f"CASE WHEN mode = 'doc_rag' THEN {[1, 5, 4000][i]} " + " ".join(f"WHEN intent = '{k}' THEN {v[i]}" for k, v in Q.BUDGETS.items()) + f" ELSE {[1, 3, 4000][i]} END"
    strategy = "CASE WHEN mode = 'doc_rag' THEN 'doc_rag' " + " ".join(f"WHEN intent = '{k}' THEN '{v[3]}'" for k, v in Q.BUDGETS.items()) + " ELSE mode END"
    return rf"""WITH t AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS whole, lower({SQUEEZE.format("coalesce(text, '')")}) AS n FROM conversations), u AS (SELECT *, {ASCII.format("n")} AS low FROM t),
    s AS (SELECT *, turn % 2 = 0 AND {matches("low", Q.ABOUT_DOCUMENT)} AS document, {simple} AS simple, {prefix} AS prefix FROM u),
    p AS (SELECT *, CASE WHEN document THEN 'document_lookup' WHEN simple THEN CASE WHEN contains(n, 'what is') OR contains(n, 'define') THEN 'definition' ELSE 'simple_fact' END ELSE 'research' END AS intent,
      CASE WHEN document THEN 'doc_rag' WHEN simple THEN 'direct_web' ELSE 'web_rag' END AS mode FROM s)
    SELECT conv_id, turn, intent, mode, CASE WHEN {matches("low", Q.GLOBAL)} THEN 'global' WHEN {matches("low", Q.MULTI_HOP)} OR {NEGATIVE_SQL} OR {LEGAL_SQL} OR {has("n", Q.CLAUSE_JOINTS)} OR length(n) - length(replace(n, '?', '')) >= 2 THEN 'multi_hop' ELSE 'simple' END AS complexity,
      md5(regexp_replace(trim(substr(n, length(prefix) + 1)), '^\?+|\?+$', '', 'g')) AS concept, {plan(0)} AS passes, {plan(1)} AS sources, {plan(2)} AS tokens, {strategy} AS strategy,
      CASE WHEN {has("whole", Q.ORDER_MARKERS)} THEN 'ordered' WHEN {has("whole", Q.MECHANISM_MARKERS)} THEN 'legal_mechanism' ELSE 'standard' END AS style FROM p"""


@register(_understanding_sql())
def understanding(spark, sf_dir):
    """Deterministic plans of all turns."""
    told = turns(spark, sf_dir).select("conv_id", "turn", "query", Q.understanding(F.col("query"), F.col("turn") % 2 == 0).alias("u"))
    told = told.select("conv_id", "turn", "u.*", Q.search_budget(F.col("u.intent"), F.col("u.mode")).alias("b"), Q.answer_plan(F.col("query"), F.col("u.intent")).alias("p"))
    return told.select("conv_id", "turn", "intent", "mode", "complexity", F.md5("concept").alias("concept"), "b.passes", "b.sources", "b.tokens", "b.strategy", "p.style")


def _displays_sql() -> str:
    cut = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    naming = "list_filter(s, lambda x: contains(lower(x), e[1]) AND contains(lower(x), e[2]))"
    names = f"list_distinct(list_transform({naming}, lambda x: regexp_replace(left(x, {display.ROW_KEY}), '[.,]+$', '')))"
    praises = lambda x: has(f"lower({x})", display.PRAISE)
    pros, cons = f"list_filter(s, lambda x: {praises('x')})", f"list_filter(s, lambda x: NOT {praises('x')} AND {has('lower(x)', display.BLAME)})"
    lines = f"list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {q(display.STEP)}))"
    steps = f"list_filter(list_transform({lines}, lambda x: regexp_replace(trim(x), {q(display.STEP_NUMBER)}, '')), lambda x: x <> '')"
    return f"""WITH d AS (SELECT doc_id, text, ['comparison', 'pros_cons', 'steps', 'summary'][doc_id % 4 + 1] AS fmt, {WORDS.format("text")}[1:2] AS e, {cut} AS s FROM documents WHERE text IS NOT NULL),
    c AS (SELECT *, least(len({names}), {display.MOST_ROWS}) AS n_rows, least(len({pros}), {display.MOST_POINTS}) AS n_pros, least(len({cons}), {display.MOST_POINTS}) AS n_cons, least(len({steps}), {display.MOST_STEPS}) AS n_steps FROM d),
    k AS (SELECT *, CASE WHEN {N_WORDS.format("text")} < {display.MIN_TABLE_WORDS} THEN 'prose' WHEN fmt = 'comparison' AND n_rows > 0 THEN 'comparison_table' WHEN fmt = 'pros_cons' AND n_pros + n_cons > 0 THEN 'pros_cons_table' WHEN fmt = 'steps' AND n_steps > 0 THEN 'step_list' WHEN fmt = 'summary' THEN 'summary_block' ELSE 'prose' END AS type FROM c)
    SELECT doc_id, type, CASE type WHEN 'comparison_table' THEN n_rows WHEN 'pros_cons_table' THEN n_pros WHEN 'step_list' THEN n_steps WHEN 'summary_block' THEN len(list_filter(s[2:6], lambda x: trim(x) <> '')) ELSE 0 END::INT AS n_first, CASE WHEN type = 'pros_cons_table' THEN n_cons ELSE 0 END::INT AS n_second,
      CASE WHEN type = 'summary_block' THEN md5(s[1]) END AS tldr FROM k"""


@register(_displays_sql())
def answer_displays(spark, sf_dir):
    """All documents as answers, shaped by turns for each format that prose can take; the first two words are what is compared."""
    docs = texts(spark, sf_dir, "documents").where("text is not null")
    fmt = F.element_at(F.array(*(F.lit(x) for x in ("comparison", "pros_cons", "steps", "summary"))), (F.col("doc_id") % 4 + 1).cast("int"))
    shaped = docs.select("doc_id", display.shaped_display(F.col("text"), fmt, F.slice(T.tokens(F.col("text")), 1, 2)).alias("d"))
    size = lambda name: F.when(F.col(f"d.{name}").isNotNull(), F.size(f"d.{name}"))
    first = F.coalesce(*(size(x) for x in ("rows", "pros", "steps", "key_points")), F.lit(0))
    return shaped.select("doc_id", "d.type", first.alias("n_first"), F.coalesce(size("cons"), F.lit(0)).alias("n_second"), F.md5("d.tldr").alias("tldr"))


CONCEPTS = r"""c AS (SELECT conv_id, turn, coalesce(text, '') AS query, CASE WHEN role = 'user' THEN nullif(regexp_extract(coalesce(text, ''), '^(\S+)', 1), '') END AS concept FROM conversations)"""
TOPIC_SQL = rf"""WITH {CONCEPTS}, o AS (SELECT *, last_value(concept IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS topic FROM c)
    SELECT conv_id, turn, topic, md5(CASE WHEN topic IS NOT NULL AND len(list_intersect(regexp_split_to_array(lower(query), '\s+'), {Q.PRONOUNS})) > 0 THEN query || ' (context: ' || topic || ')' ELSE query END) AS resolved FROM o"""


def _concepts(spark, sf_dir):
    concept = F.when(F.col("role") == "user", F.nullif(F.regexp_extract("query", r"^(\S+)", 1), F.lit("")))
    return turns(spark, sf_dir).withColumn("concept", concept)


@register(TOPIC_SQL)
def topic_resolution(spark, sf_dir):
    return conversation.resolve_references(_concepts(spark, sf_dir)).select("conv_id", "turn", "topic", F.md5("resolved").alias("resolved"))


@register("SELECT conv_id, turn, md5(coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '')) AS history FROM conversations")
def last_turns(spark, sf_dir):
    return conversation.last_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.md5("history").alias("history"))


KEPT = f"""WITH RECURSIVE r AS MATERIALIZED (SELECT event_id AS request_id, user_id::VARCHAR AS key, epoch_us(ts) / 1e6 AS timestamp, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    f AS (SELECT *, false AS hit, timestamp AS written FROM r WHERE rn = 1 UNION ALL
      SELECT r.*, r.timestamp - f.written <= {conversation.KEPT_FOR}, CASE WHEN r.timestamp - f.written <= {conversation.KEPT_FOR} THEN f.written ELSE r.timestamp END FROM f JOIN r ON r.key = f.key AND r.rn = f.rn + 1)"""


@register(
    """WITH s AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN CASE turn % 5 WHEN 1 THEN 'comparison' WHEN 2 THEN 'pros_cons' WHEN 3 THEN 'recommend' END END AS shown FROM conversations)
    SELECT conv_id, turn, last_value(shown IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_format FROM s"""
)
def prior_formats(spark, sf_dir):
    """The last structured answer before each turn; how a turn was shown goes by its number."""
    kinds = F.create_map(*(F.lit(x) for x in (0, "prose", 1, "comparison_table", 2, "pros_cons_table", 3, "recommend_card", 4, "step_list")))
    told = turns(spark, sf_dir).withColumn("display_type", kinds[(F.col("turn") % 5).cast("int")])
    return conversation.prior_comparison(told).select("conv_id", "turn", "prior_format")


@register(f"{KEPT} SELECT request_id, key, 0::BIGINT AS generation, timestamp, hit FROM f")
def kept_answers(spark, sf_dir):
    """Which events an answer kept for their user would have served."""
    rows = executions(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "user_id"), "seq")
    return conversation.cache_hits(rows.select(F.col("seq").alias("request_id"), F.col("user_id").alias("key"), F.lit(0).alias("generation"), "timestamp"))


# -- telemetry

ROUTING = "routing AS (SELECT event_id AS seq, epoch_us(ts) / 1e6 AS timestamp, props AS query, CASE WHEN event_type <> 'error' THEN event_type END AS selected_agent, value / (value + 50.0) AS confidence, event_type AS reasoning FROM events)"
TYPES = ["click", "purchase", "signup", "view"]


@register(
    f"""WITH {ROUTING}, s AS (SELECT list_sort(list(confidence)) AS v FROM routing)
    SELECT count(*) AS total_queries, count(*) FILTER (selected_agent IS NULL) AS fallback_count, round(count(*) FILTER (selected_agent IS NULL) / count(*), 4) AS fallback_rate, round(avg(confidence), 4) AS confidence_mean,
      round(min(confidence), 4) AS confidence_min, round(max(confidence), 4) AS confidence_max, round(any_value(v)[floor(len(any_value(v)) * 0.5)::INT + 1], 4) AS confidence_p50, round(any_value(v)[floor(len(any_value(v)) * 0.95)::INT + 1], 4) AS confidence_p95
    FROM routing, s"""
)
def routing_summary(spark, sf_dir):
    return telemetry.routing_summary(routing(spark, sf_dir))


@register(f"WITH {ROUTING} SELECT coalesce(selected_agent, 'fallback') AS agent, count(*) AS n FROM routing GROUP BY ALL")
def agent_distribution(spark, sf_dir):
    return telemetry.agent_distribution(routing(spark, sf_dir))


@register(
    """WITH g AS (SELECT event_type AS agent, count(*) AS n, avg(value) AS m, list_sort(list(value)) AS v FROM events GROUP BY ALL)
    SELECT agent, n, round(m, 1) AS mean_ms, round(v[floor(n * 0.5)::INT + 1], 1) AS p50_ms, round(v[floor(n * 0.95)::INT + 1], 1) AS p95_ms, CASE WHEN agent = 'error' THEN n ELSE 0 END AS failures FROM g"""
)
def latency_by_agent(spark, sf_dir):
    return telemetry.latency_by_agent(executions(spark, sf_dir))


@register(
    f"WITH {ROUTING} SELECT strftime(make_timestamp((timestamp * 1e6)::BIGINT), '%Y-%m-%dT%H:00') AS hour, {', '.join(f"count(*) FILTER (selected_agent = '{a}') AS {a}" for a in TYPES)}, count(*) FILTER (selected_agent IS NULL) AS fallback FROM routing GROUP BY ALL"
)
def hourly_series(spark, sf_dir):
    return telemetry.hourly_series(routing(spark, sf_dir), TYPES)


@register(
    f"""WITH {ROUTING}, c AS (SELECT least(trunc(confidence / (1.0::DOUBLE / 20))::INT, 19) AS bin, count(*) AS n FROM routing GROUP BY ALL)
    SELECT b.bin::INT AS bin, round(b.bin * 0.05::DOUBLE, 3) AS low, round((b.bin + 1) * 0.05::DOUBLE, 3) AS high, coalesce(n, 0) AS n FROM range(20) b(bin) LEFT JOIN c USING (bin)"""
)
def confidence_histogram(spark, sf_dir):
    return telemetry.confidence_histogram(routing(spark, sf_dir))


@register("SELECT event_type AS agent, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failure, count(*) AS total, round(count(*) FILTER (event_type = 'error') / count(*), 4) AS error_rate FROM events GROUP BY event_type")
def error_rates(spark, sf_dir):
    return telemetry.error_rates(executions(spark, sf_dir))


@register("SELECT seq, agent, duration_ms FROM (SELECT event_id AS seq, event_type AS agent, value AS duration_ms, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 500")
def last_per_agent(spark, sf_dir):
    return telemetry.last_per_agent(executions(spark, sf_dir)).select("seq", "agent", "duration_ms")


@register(f"WITH {ROUTING} SELECT seq, selected_agent, round(confidence, 4) AS math, round(1 - confidence, 4) AS code FROM routing ORDER BY seq DESC LIMIT 200")
def score_heatmap(spark, sf_dir):
    return telemetry.score_heatmap(routing(spark, sf_dir)).select("seq", "selected_agent", "math", "code")


@register(f"WITH {ROUTING} SELECT seq, left(query, 100) AS query_preview, selected_agent, round(confidence, 4) AS confidence, reasoning FROM routing ORDER BY timestamp DESC, seq LIMIT 50")
def recent_decisions(spark, sf_dir):
    return telemetry.recent_decisions(routing(spark, sf_dir)).drop("timestamp")


@register(
    """WITH r AS (SELECT event_id, user_id AS key, epoch(ts)::BIGINT AS timestamp, length(props) AS tokens FROM events)
    SELECT event_id, count(*) OVER w AS recent_requests, (sum(tokens) OVER w)::BIGINT AS recent_tokens, count(*) OVER (PARTITION BY key, timestamp // 86400 ORDER BY timestamp RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS day_requests
    FROM r WINDOW w AS (PARTITION BY key ORDER BY timestamp RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)"""
)
def sliding_load(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("timestamp"), F.length("props").cast("long").alias("tokens"))
    return telemetry.sliding_load(rows).select("event_id", "recent_requests", "recent_tokens", "day_requests")


# -- evaluation


@register(
    f"""WITH {BM25_BASE}, {bm25_cte("hits", 10)}, got AS (SELECT query_id, list(chunk_id ORDER BY rank) AS l FROM hits GROUP BY ALL), gold AS (SELECT item_id AS query_id, list(doc_id) AS g FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY ALL),
    j AS (SELECT query_id, l, coalesce(g, []) AS g, list_filter(list_transform(l, lambda x, i: CASE WHEN list_contains(g, x) THEN i END), lambda i: i IS NOT NULL) AS spots FROM got LEFT JOIN gold USING (query_id))
    SELECT query_id, (len(spots) > 0)::INT::DOUBLE AS hit, round(coalesce(1.0::DOUBLE / list_min(spots), 0), 6) AS reciprocal_rank, round(len(list_filter(spots, lambda i: i <= 5)) / 5, 6) AS precision_at_k,
      round(CASE WHEN len(g) = 0 THEN 1 ELSE len(list_filter(spots, lambda i: i <= len(g))) / len(g) END, 6) AS precision_at_r, round(CASE WHEN len(g) = 0 THEN 1 ELSE len(list_intersect(g, l)) / len(g) END, 6) AS recall FROM
      (SELECT query_id, l, g, coalesce(spots, []) AS spots FROM j)"""
)
def retrieval_metrics(spark, sf_dir):
    """BM25's ten best chunks of each question against the documents that hold it word for word."""
    asked, docs = questions(spark, sf_dir), texts(spark, sf_dir, "documents")
    counted = search.counted_chunks(chunks(spark, sf_dir))
    got = search.bm25_topk(counted, asked, 10).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("l")).select("query_id", F.transform("l", lambda x: x["chunk_id"].cast("string")).alias("retrieved"))
    gold = evaluate.verbatim_gold(docs, asked, counted.terms).groupBy("query_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("relevant"))
    out = evaluate.retrieval_metrics(got.join(gold, "query_id", "left"))
    return out.select("query_id", "hit", *(F.round(c, 6).alias(c) for c in ("reciprocal_rank", "precision_at_k", "precision_at_r", "recall")))


@register("SELECT source, count(n_chars) AS n, round(avg(n_chars), 4) AS mean, round(stddev_pop(n_chars), 4) AS std, round(stddev_pop(n_chars) / sqrt(count(n_chars)), 4) AS sem, count(n_chars) < 15 AS low_n FROM documents GROUP BY source")
def length_means(spark, sf_dir):
    out = evaluate.mean_std_sem(table(spark, sf_dir, "documents"), "n_chars", "source")
    return out.select("source", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "sem")), "low_n")


@register("SELECT 'source' AS dimension, source AS label, count(quality) AS n, round(avg(quality), 6) AS mean FROM documents JOIN labels USING (doc_id) GROUP BY ALL UNION ALL SELECT 'lang', lang, count(quality), round(avg(quality), 6) FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def quality_breakdowns(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluate.breakdowns(rows, "quality", ["source", "lang"]).withColumn("mean", F.round("mean", 6))


JUDGED = "judged AS (SELECT doc_id, (n_chars % 101) / 100.0::DOUBLE AS p, quality AS y, toxic FROM documents JOIN labels USING (doc_id))"


def _judged(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", ((F.col("n_chars") % 101) / 100.0).alias("p"), F.col("quality").alias("y"), "toxic")


@register(
    f"""WITH {JUDGED}, b AS (SELECT floor(least(greatest(p, 0), 1 - 1e-9) * 5) AS bin, count(*) AS m, sum(p) AS p, sum(y) AS y, sum((p - y) ** 2) AS se FROM judged GROUP BY ALL)
    SELECT sum(m)::BIGINT AS n, round(sum(se) / sum(m), 6) AS brier, round(sum(abs(p - y)) / sum(m), 6) AS ece FROM b"""
)
def brier_ece(spark, sf_dir):
    return evaluate.brier_ece(_judged(spark, sf_dir), "p", "y").select("n", F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"))


@register(
    f"""WITH {JUDGED}, s AS (SELECT (p >= 0.5)::INT AS said, y AS held FROM judged), l AS (SELECT unnest([0, 1])::INT AS label),
    c AS (SELECT label, count(*) FILTER (held = label) AS support, count(*) FILTER (said = label AND held = label) AS tp, count(*) FILTER (said = label) AS n FROM s, l GROUP BY label), r AS (SELECT label, support, coalesce(tp / nullif(n, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM c)
    SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM r"""
)
def precision_recall(spark, sf_dir):
    rows = _judged(spark, sf_dir).withColumn("said", (F.col("p") >= 0.5).cast("int"))
    return evaluate.precision_recall_f1(rows, "said", "y").select("label", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@register(
    f"WITH {JUDGED}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold) SELECT threshold, round(avg((CASE WHEN p >= threshold THEN 'toxic' ELSE 'none' END = CASE WHEN toxic = 1 THEN 'toxic' ELSE 'none' END)::INT), 6) AS accuracy FROM judged, t GROUP BY threshold"
)
def threshold_sweep(spark, sf_dir):
    rows = _judged(spark, sf_dir).select("p", F.lit("toxic").alias("said"), F.when(F.col("toxic") == 1, "toxic").otherwise("none").alias("gold"))
    return evaluate.threshold_sweep(rows, "said", "p", "gold", [i / 10 for i in range(1, 10)]).withColumn("accuracy", F.round("accuracy", 6))


@register(
    f"""WITH {BM25_BASE}, {bm25_cte("hits", 10)}, got AS (SELECT query_id, list((chunk_id % 40)::INT ORDER BY rank) AS l FROM hits GROUP BY ALL), j AS (SELECT query_id, l, [(query_id % 40)::INT, (query_id % 7)::INT] AS gold FROM got),
    s AS (SELECT *, list_distinct(gold) AS g, list_filter(list_transform(l, lambda x, i: CASE WHEN list_contains(gold, x) THEN i END), lambda i: i IS NOT NULL) AS spots, list_filter(l, lambda x, i: list_position(l, x) = i) AS pages FROM j)
    SELECT query_id, (len(spots) > 0)::INT::DOUBLE AS page_hit, round(coalesce(1.0::DOUBLE / list_min(spots), 0), 6) AS page_reciprocal_rank, round(len(list_intersect(pages[1:len(g)], g)) / len(g), 6) AS page_precision_at_r,
      round(len(list_intersect(pages, g)) / len(g), 6) AS page_recall FROM s"""
)
def page_metrics(spark, sf_dir):
    """BM25's ten best chunks as pages, against two pages a question."""
    got = search.bm25_topk(chunks(spark, sf_dir), questions(spark, sf_dir), 10).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("l"))
    rows = got.select("query_id", F.transform("l", lambda x: (x["chunk_id"] % 40).cast("int")).alias("pages"), F.array((F.col("query_id") % 40).cast("int"), (F.col("query_id") % 7).cast("int")).alias("relevant_pages"))
    out = evaluate.page_metrics(rows)
    return out.select("query_id", "page_hit", *(F.round(c, 6).alias(c) for c in ("page_reciprocal_rank", "page_precision_at_r", "page_recall")))


@register(
    f"""WITH {TURNS}, g AS (SELECT conv_id, turn, q, lead(q) OVER (PARTITION BY conv_id ORDER BY turn) AS report FROM t)
    SELECT conv_id, turn, len(list_filter(regexp_split_to_array(lower(q), '[.!?]'), lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: length(w) > 4 AND contains(lower(coalesce(report, '')), w))) = 0))::INT AS n_gaps FROM g"""
)
def report_gaps(spark, sf_dir):
    """How many sentences of a turn the next turn says nothing of."""
    told = turns(spark, sf_dir).withColumn("report", F.lead("query").over(Window.partitionBy("conv_id").orderBy("turn")))
    return told.select("conv_id", "turn", F.size(answers.gaps(F.split(F.lower("query"), "[.!?]", -1), F.col("report"))).alias("n_gaps"))


@register(
    f"""{_packed_sql()}, told AS (SELECT p.query_id, packed_rank, document_id, chr(10) || '--- [Page ' || (c.chunk_id % 40) || '] ---' || chr(10) || text || chr(10) AS block FROM packed p JOIN chunks c ON c.chunk_id::VARCHAR = p.chunk_id),
    g AS (SELECT query_id, length(string_agg(block, '' ORDER BY packed_rank))::INT AS n_chars, list(document_id ORDER BY packed_rank) AS l FROM told GROUP BY query_id)
    SELECT query_id, n_chars, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS sources FROM g"""
)
def prompt_contexts(spark, sf_dir):
    """Contexts and sources for prompts, of all questions."""
    held = chunks(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("chunk_id"), (F.col("chunk_id") % 40).alias("page"), F.col("document_id").alias("source"), "text")
    out = answers.prompt_contexts(search.with_chunks(packed_context(spark, sf_dir), held))
    return out.select("query_id", F.length("context").alias("n_chars"), F.array_join("sources", ",").alias("sources"))


@register()
def stratified_split(spark, sf_dir):
    return evaluate.stratified_split(table(spark, sf_dir, "labels"), "toxic", "doc_id")


@register(
    f"""WITH RECURSIVE {JUDGED}, s AS (SELECT list(struct_pack(x := x, n := n, y := y)) AS l, sum(n) AS total FROM (SELECT round(least(greatest(p, 0), 1), 4) AS x, count(*) AS n, sum(y) AS y FROM judged GROUP BY 1)),
    fit AS (SELECT 0 AS i, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL
      SELECT i + 1, a - 0.1 * (list_sum(list_transform(l, lambda z: (z.n / (1 + exp(-(a * z.x + b))) - z.y) * z.x)) / total + 1e-4 * a), b - 0.1 * list_sum(list_transform(l, lambda z: z.n / (1 + exp(-(a * z.x + b))) - z.y)) / total FROM fit, s WHERE i < 2000)
    SELECT round(a, 6) AS a, round(b, 6) AS b FROM fit WHERE i = 2000"""
)
def platt_fit(spark, sf_dir):
    """Slope and offset of a calibration on all labels."""
    a, b = evaluate.fit_platt(_judged(spark, sf_dir), "p", "y")
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "a double, b double")


@register(f"WITH {JUDGED} SELECT count(*) AS n, round(avg((coalesce(CASE WHEN p >= 0.2 THEN CASE WHEN p >= 0.5 THEN 'toxic' ELSE 'none' END END = CASE WHEN toxic = 1 THEN 'toxic' ELSE 'none' END, false))::INT), 6) AS match_rate FROM judged")
def route_match_rate(spark, sf_dir):
    """Labels as expected routes; low scores are routes that failed."""
    route = F.when(F.col("p") >= 0.2, F.when(F.col("p") >= 0.5, "toxic").otherwise("none"))
    rows = _judged(spark, sf_dir).select(route.alias("actual"), F.when(F.col("toxic") == 1, "toxic").otherwise("none").alias("expected"))
    return evaluate.route_match_rate(rows, "actual", "expected").withColumn("match_rate", F.round("match_rate", 6))


# -- sources of evidence


@register(
    rf"""WITH h AS (SELECT page_id, url, (page_id % 7)::BIGINT AS query_id, regexp_replace(lower(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '')), '^www\.', '') AS host FROM pages),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id, host ORDER BY page_id) AS n FROM h)
    SELECT query_id, page_id, position::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n > 1, page_id) AS position FROM n) WHERE position <= 20"""
)
def diverse_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("query_id"), F.col("page_id").alias("rank"), "page_id", "url")
    return evidence.diverse_sources(rows, 20).select("query_id", "page_id", "position")


@register(
    f"""WITH d AS (SELECT page_id, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS d FROM pages)
    SELECT page_id, CASE WHEN {" OR ".join(f"ends_with(d, '{x}')" for x in evidence.AUTHORITIES)} THEN 0.8 WHEN contains(d, '.com') OR contains(d, '.net') THEN 0.6 ELSE 0.5 END::DOUBLE AS credibility FROM d"""
)
def source_credibility(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", evidence.credibility(F.col("url")).alias("credibility"))


def _evidence_sql() -> str:
    overlap = lambda c: f"CASE WHEN contains(low, lower({c})) THEN 1.0 ELSE len(list_filter({WORDS.format(c)}, lambda w: contains(low, w))) / len({WORDS.format(c)}) END"
    return f"""WITH p AS (SELECT page_id, lower(html) AS low, lower(url) AS link, ['definition', 'comparison', 'troubleshooting', 'research'][page_id % 4 + 1] AS intent FROM pages),
    s AS (SELECT *, {overlap("'the page'")} AS one, {overlap("'der and'")} AS two FROM p)
    SELECT page_id, greatest(0, least(100, least(floor(20 * one) + floor(20 * two), 40) + CASE WHEN {has("link", evidence.GOOD_DOMAINS)} THEN 30 ELSE 10 END + CASE
      WHEN intent = 'definition' THEN CASE WHEN {has("low", evidence.DEFINING)} THEN 30 ELSE 10 END
      WHEN intent = 'comparison' THEN CASE WHEN {has("low", evidence.COMPARING)} THEN 30 WHEN one >= 0.5 AND two >= 0.5 THEN 25 ELSE 10 END
      WHEN intent = 'troubleshooting' THEN CASE WHEN {has("low", evidence.SOLVING)} THEN 30 ELSE 10 END ELSE 20 END))::BIGINT AS score FROM s"""


@register(_evidence_sql())
def evidence_scores(spark, sf_dir):
    intent = F.element_at(F.array(*(F.lit(x) for x in ("definition", "comparison", "troubleshooting", "research"))), (F.col("page_id") % 4 + 1).cast("int"))
    concepts = F.array(F.lit("the page"), F.lit("der and"))
    return texts(spark, sf_dir, "pages").select("page_id", evidence.evidence_score(concepts, intent, F.col("html"), F.col("url")).alias("score"))


@register(
    rf"""WITH {_html_sql()}, one AS (SELECT page_id, regexp_replace(text, '[\s\x0b\x{{85}}\x{{a0}}\p{{Z}}]+', ' ', 'g') AS text FROM html), cut AS (SELECT page_id, string_split(regexp_replace(text, '([.!?])[\s\x{{a0}}]+', '\1' || chr(1), 'g'), chr(1)) AS l FROM one),
    f AS (SELECT page_id, unnest(range(0, len(l))) AS i, unnest(l) AS raw FROM cut), c AS (SELECT *, trim(regexp_replace(raw, '[\x00-\x1f\x7f]', '', 'g')) AS s, lower(trim(raw)) AS low, lead(trim(raw)) OVER (PARTITION BY page_id ORDER BY i) AS next FROM f),
    r AS (SELECT page_id, i, trim(raw) AS sentence, next, CASE WHEN s <> '' AND NOT regexp_matches(regexp_extract(s, '\p{{L}}', 0), '\p{{Ll}}') AND NOT regexp_matches(s, '^[,;:)}}\]]') AND {N_WORDS.format("s")} BETWEEN 8 AND 60
      AND NOT (ends_with(s, '?') AND (starts_with(low, 'what') OR starts_with(low, 'how'))) AND contains(low, 'th') THEN contains(low, 'what')::INT + CASE WHEN contains(low, ' is a ') OR contains(low, ' is an ') THEN 10 WHEN contains(low, ' are ') THEN 3 ELSE 0 END ELSE 0 END AS score FROM c),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, i) AS n FROM r) WHERE n = 1 AND score >= 3),
    j AS (SELECT page_id, score, CASE WHEN coalesce(regexp_matches(next, '^\p{{Lu}}') AND {N_WORDS.format("next")} BETWEEN 5 AND 40, false) THEN sentence || ' ' || next ELSE sentence END AS joined FROM b)
    SELECT page_id, CASE WHEN regexp_matches(joined, '[.!?]$') THEN joined ELSE joined || '.' END AS passage, score::BIGINT AS score FROM j"""
)
def best_passages(spark, sf_dir):
    """The sentence of each page that answers a common question best."""
    rows = texts(spark, sf_dir, "pages").select("page_id", F.lit("what is the").alias("query"), readers.html_text_builtin(F.col("html")).alias("text"))
    return evidence.best_passages(rows)


# -- trees and streams


@register()
def summary_tree(spark, sf_dir):
    """Summary nodes over all documents, one tree a source and language."""
    held = chunks(spark, sf_dir).select(F.col("parent_id").alias("document_id"), F.format_string("c%012d", "chunk_id").alias("chunk_id"), "text")
    nodes = tree.build_tree(held, shared_folder(spark, "tree")).nodes
    return nodes.select("document_id", "chunk_id", "node_type", "level", F.length("text").alias("n_chars"), "n_children")


@register(
    r"""SELECT source AS document_id, left(sha256(string_agg(h, ',' ORDER BY h)), 24) AS fingerprint FROM (SELECT source, sha256(doc_id::VARCHAR || chr(0) || trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents) GROUP BY source"""
)
def tree_fingerprints(spark, sf_dir):
    return tree.fingerprint(chunks(spark, sf_dir).withColumn("chunk_id", F.col("chunk_id").cast("string")))


@register(f"WITH {ROUTING} SELECT date_trunc('hour', make_timestamp((timestamp * 1e6)::BIGINT)) AS hour, coalesce(selected_agent, 'fallback') AS agent, count(*) AS n FROM routing GROUP BY ALL")
def stream_hourly(spark, sf_dir):
    """Hourly counts of the events as a stream."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque*").withColumn("ts", F.col("ts").cast("timestamp"))
    agents = events.select("ts", F.when(F.col("event_type") != "error", F.col("event_type")).alias("selected_agent"))
    out = live.run_available(live.hourly_counts(agents), shared_folder(spark, "hourly"), "complete")
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@register(ORACLE_SQL["stream_hourly"])
def stream_log_hourly(spark, sf_dir):
    """Hourly counts of a log of the routing decisions, followed line by line, half of which is there when the stream first runs."""
    folder = shared_folder(spark, "log")
    decisions = routing(spark, sf_dir).select(F.lit("routing").alias("event"), "timestamp", "query", "selected_agent", "confidence")
    counts = lambda: live.hourly_counts(live.read_log_stream(spark, f"{folder}/log", readers.ROUTING_SCHEMA), "36500 days")
    for half in (True, False):
        early = F.col("timestamp") % 7200 < 3600
        readers.append_log(decisions.where(early if half else ~early), f"{folder}/log")
        out = live.run_available(counts(), f"{folder}/counts", "complete")
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@register(ORACLE_SQL["sliding_load"])
def stream_request_load(spark, sf_dir):
    """sliding_load() as a stream: exact at each request."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque*")
    asked = events.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.length("props").alias("tokens"))
    out = live.run_available(load.request_load(asked), shared_folder(spark, "request-load"), settings=load.ROCKSDB)
    return out.select(F.col("request_id").alias("event_id"), "recent_requests", "recent_tokens", "day_requests")


def _requests(spark, sf_dir):
    """The events as a stream of requests of their users."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque*")
    return events.select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("key"), F.lit(0).cast("long").alias("generation"), F.col("ts").cast("timestamp").alias("ts"), F.floor("value").alias("tokens"))


@register(f"{KEPT} SELECT request_id, key, 0::BIGINT AS generation, hit FROM f")
def stream_kept_answers(spark, sf_dir):
    """kept_answers() as a stream."""
    return live.run_available(live.kept_answers(_requests(spark, sf_dir).drop("tokens")), shared_folder(spark, "kept"))


@register(
    """WITH w AS (SELECT user_id::VARCHAR AS key, make_timestamp((floor(epoch_us(ts) / 1e7)::BIGINT - unnest(range(0, 6))) * 10000000) AS start, floor(value)::BIGINT AS tokens FROM events)
    SELECT key, start, count(*) AS requests, sum(tokens)::BIGINT AS tokens FROM w GROUP BY ALL"""
)
def stream_sliding_load(spark, sf_dir):
    """Requests and tokens of each user in the minute from each tenth second, as a stream."""
    out = live.run_available(live.sliding_load(_requests(spark, sf_dir)), shared_folder(spark, "load"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@register(TOPIC_SQL)
def stream_topics(spark, sf_dir):
    """Topics of the conversations as a stream."""
    schema = table(spark, sf_dir, "conversations").schema
    told = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parque*").withColumn("query", F.coalesce("text", F.lit("")))
    concept = F.when(F.col("role") == "user", F.nullif(F.regexp_extract("query", r"^(\S+)", 1), F.lit("")))
    out = live.run_available(live.topics(told.select("conv_id", "turn", "query", concept.alias("concept"))), shared_folder(spark, "topics"))
    return out.select("conv_id", "turn", "topic", F.md5("resolved").alias("resolved"))


# -- trained scorers and the search over pages


@register()
def routing_baseline(spark, sf_dir):
    """The text classifier on the labels' quality: fitted on half of the labelled documents by a hash, and its word on the others."""
    docs, labels = texts(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality is not null")
    told = docs.join(labels.select("doc_id", F.col("quality").cast("string").alias("label")), "doc_id").select("doc_id", "text", "label", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("fits"))
    folder = shared_folder(spark, "labelled")
    told.write.parquet(folder)
    told = spark.read.schema(told.schema).parquet(folder)
    model = text_classifier.fit_text_classifier(told.where("fits"), vocabulary=1 << 14, steps=25)
    said = text_classifier.classified(told.where("not fits"), model, "doc_id", kept=("label",))
    return said.select(F.col("id").alias("doc_id"), "label", "predicted", F.round("probability", 4).alias("probability"))


@register()
def trained_rerank(spark, sf_dir):
    """Questions kept out by a hash, their twenty best chunks ranked anew by a scorer that learnt from the other questions."""
    held, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    counted = search.counted_chunks(held)
    hits = search.with_chunks(search.bm25_topk(counted, asked, 20).select("query_id", "chunk_id", "rank"), held.select("chunk_id", "document_id", "text")).join(asked, "query_id")
    folder = shared_folder(spark, "shortlists")
    hits.withColumn("relevant", F.coalesce(F.col("text").contains(F.col("query")), F.lit(False))).write.parquet(folder)
    hits = spark.read.parquet(folder)
    learns = F.pmod(F.xxhash64("query_id"), F.lit(2)) == 0
    model = pair_scorer.fit_pair_scorer(hits.where(learns), held, counted.terms)
    return rank.rerank(hits.where(~learns), 20, model(F.col("query"), F.col("text")), 20).select("query_id", "chunk_id", "rank", "relevant")


@register()
def self_corrected_sources(spark, sf_dir):
    """Sources for the benchmark's items among all pages: searched, judged and searched again."""
    folder = shared_folder(spark, "pages")
    searched = search_loop.index_pages(spark, f"{folder}/index", texts(spark, sf_dir, "pages"))
    words = F.filter(F.array_distinct(T.tokens(F.col("query"))), lambda w: F.length(w) > 4)
    number = F.pmod(F.xxhash64("query_id"), F.lit(3))
    plans = questions(spark, sf_dir).select("query_id", "query", F.slice(words, 1, 2).alias("concepts"), F.when(number == 0, "definition").when(number == 1, "comparison").otherwise("explanation").alias("intent"), (number + 1).alias("max_passes"), F.lit(3).alias("max_sources"))

    def save(rows, name):
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    return search_loop.self_corrected_sources(plans, search_loop.page_search(searched), save)


# -- tables that the joins and groupings above rest on


@register(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"),
    )


@register(
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY n_name"""
)
def regional_revenue(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    joined = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region").where("r_name = 'ASIA'"), F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))

"""Documents, tables, logs and web pages as DataFrames, and the log sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from passagework.functions.evidence import is_candidate_url, is_fetchable
from passagework.functions.text import clean_text, host, printed_page, safe_name, strip
from passagework.operators.providers import PageTextExtractor, decoded_text

ROUTING_SCHEMA = (
    "event string, timestamp double, query string, query_preview string, selected_agent string, confidence double, reasoning string, all_scores map<string,double>, "
    "runner_up_agent string, runner_up_score double, margin double, ambiguous boolean"
)
EXECUTION_SCHEMA = "event string, timestamp double, agent string, duration_ms double, success boolean"
#: Elements whose text is no content.
DROPPED_ELEMENTS = ("script", "style", "header", "footer", "nav", "aside")


def _document(path: Column) -> list[Column]:
    name = F.element_at(F.split(path, "/"), -1)
    return [safe_name(name).alias("document_id"), name.alias("source_file")]


def numbered_pages(pages: DataFrame) -> DataFrame:
    """(document_id, source_file, physical_page, page_start, page_end, text) of pages with text, cleaned, with their printed numbers."""
    cleaned = pages.withColumn("text", clean_text(F.coalesce("text", F.lit("")))).where("text <> ''")
    number = printed_page(F.col("text"), F.col("physical_page"))
    return cleaned.select("document_id", "source_file", F.col("physical_page").cast("int"), number.cast("int").alias("page_start"), number.cast("int").alias("page_end"), "text")


def read_files(spark: SparkSession, path: str, extract: PageTextExtractor = decoded_text) -> DataFrame:
    """Pages of binary files (PDF and the like); ``extract`` makes an array of page texts of a file's bytes."""
    files = spark.read.format("binaryFile").load(path)
    pages = files.select(*_document(F.col("path")), F.posexplode(extract(F.col("content"))).alias("i", "text"))
    return numbered_pages(pages.withColumn("physical_page", F.col("i") + 1))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files, each one page."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return numbered_pages(files.select(*_document(F.col("path")), F.lit(1).alias("physical_page"), F.col("value").alias("text")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, names from the header."""
    return spark.read.option("header", True).option("multiLine", True).csv(path)


def profile_csv(table: DataFrame, rows: int = 5) -> dict:
    """Column names, number of rows and the first few of them."""
    return {"columns": table.columns, "row_count": table.count(), "preview": [r.asDict() for r in table.limit(rows).collect()]}


def read_log(spark: SparkSession, path: str, schema: str, start: float = 0.0) -> DataFrame:
    """JSON lines from ``start`` on (seconds); blank and malformed lines are passed over, a missing timestamp is 0."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.coalesce("timestamp", F.lit(0.0)) >= start)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


#: Entities that the built-in form resolves, the ampersand last.
ENTITIES = (("&nbsp;", "\xa0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&#39;", "'"), ("&amp;", "&"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.inside = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.inside += tag in DROPPED_ELEMENTS

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED_ELEMENTS and self.inside:
            self.inside -= 1

    def handle_data(self, data: str) -> None:
        if not self.inside:
            self.parts.append(data)


def text_of_html(html: str | None) -> str:
    """Visible text: stripped pieces of lines, cut at double spaces, one a line."""
    if not html:
        return ""
    parser = _Text()
    parser.feed(html)
    parser.close()
    pieces = (piece.strip() for line in " ".join(parser.parts).splitlines() for piece in line.split("  "))
    return "\n".join(p for p in pieces if p)


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    """text_of_html() for a column."""
    return html.map(text_of_html)


def html_text_builtin(html: Column) -> Column:
    """The same by built-in functions, for well-formed pages: tags go, the common entities are resolved."""
    t = F.coalesce(html, F.lit(""))
    for name in DROPPED_ELEMENTS:
        t = F.regexp_replace(t, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "\x00")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>", ""), r"(?s)<[^>]+>", "\x00")
    for entity, mark in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(mark))
    # text stands between tags; neighbours are joined by one space, as a parser's pieces are
    t = F.array_join(F.filter(F.split(t, "\x00"), lambda p: p != ""), " ")
    pieces = F.transform(F.flatten(F.transform(F.split(t, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda line: F.split(strip(line), "  "))), strip)
    return F.array_join(F.filter(pieces, lambda p: p != ""), "\n")


def candidate_pages(results: DataFrame, url_col: str = "url") -> DataFrame:
    """Search results that may be fetched, with their host."""
    url = F.col(url_col)
    return results.where(is_candidate_url(url) & is_fetchable(url)).withColumn("host", host(url))


def search_with(provider: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], queries: DataFrame) -> DataFrame:
    """(query_id, rank, url, title, snippet) from a provider that answers batches of (query_id, query) on the executors."""
    return queries.select("query_id", "query").mapInPandas(provider, "query_id long, rank int, url string, title string, snippet string")

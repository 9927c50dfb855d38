"""Pages as images: which are sharp enough to be described, and which text a page gets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from passagework.operators.providers import PageTextExtractor, decoded_text

SHARP_FROM, LEAST_PIXELS, LEAST_TEXT = 100.0, 10_000, 50


def laplacian_variance(gray: np.ndarray) -> float:
    """The variance of the five-point Laplacian, borders mirrored; 0 for images of too few pixels."""
    if gray.size < LEAST_PIXELS:
        return 0.0
    g = np.pad(gray.astype(float), 1, mode="reflect")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def sharpness(images: DataFrame) -> DataFrame:
    """(page_id, variance, keep) of images (page_id, width, pixels: gray values row by row)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            variances = [laplacian_variance(np.asarray(p).reshape(-1, w)) for p, w in zip(frame["pixels"], frame["width"], strict=True)]
            yield pd.DataFrame({"page_id": frame["page_id"], "variance": variances})

    held = images.select(F.col("page_id").cast("long").alias("page_id"), F.col("width").cast("int").alias("width"), F.col("pixels").cast("array<double>").alias("pixels"))
    return held.mapInPandas(run, "page_id long, variance double").withColumn("keep", F.col("variance") >= SHARP_FROM)


def page_text(described: Column, native: Column) -> Column:
    """A page's description if it is long enough, else its own text if that is, else null."""
    long = lambda c: F.when(F.length(F.trim(c)) >= LEAST_TEXT, c)
    return F.coalesce(long(described), long(native))


def native_texts(files: DataFrame, extract: PageTextExtractor = decoded_text) -> DataFrame:
    """(document_id, page_num, native) of files (document_id, content): the pages that have text of their own, from 1."""
    pages = files.select("document_id", F.posexplode(extract(F.col("content"))).alias("i", "text"))
    return pages.select("document_id", (F.col("i") + 1).alias("page_num"), F.trim("text").alias("native")).where("native <> ''")


def ingested_pages(judged: DataFrame, described: DataFrame, native: DataFrame) -> DataFrame:
    """(document_id, page_num, chunk_id, text, variance, source) of the sharp pages that get a text.

    judged: document_id, page_num, variance, keep; described: document_id, page_num, described (what a model said of the
    image); native: native_texts(). source: vlm, or text_layer_fallback where the description is too short or missing.
    """
    page = ["document_id", "page_num"]
    rows = judged.where("keep").join(described, page, "left").join(native, page, "left")
    source = F.when(page_text(F.col("described"), F.lit(None).cast("string")).isNotNull(), "vlm").otherwise("text_layer_fallback")
    rows = rows.withColumn("text", page_text(F.col("described"), F.col("native"))).where("text is not null")
    return rows.select(*page, F.format_string("%s_vlm_page_%d", *page).alias("chunk_id"), "text", "variance", source.alias("source"))


def ingest_counts(judged: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, total_pages, blurred, described, recovered, dropped) of judged pages and their ingested_pages()."""
    seen = judged.groupBy("document_id").agg(F.count("*").alias("total_pages"), F.count_if(~F.col("keep")).alias("blurred"))
    got = pages.groupBy("document_id").agg(F.count_if(F.col("source") == "vlm").alias("described"), F.count_if(F.col("source") != "vlm").alias("recovered"))
    counted = seen.join(got, "document_id", "left").fillna(0, ["described", "recovered"])
    return counted.withColumn("dropped", F.expr("total_pages - blurred - described - recovered"))

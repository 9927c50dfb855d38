"""Pages into parent and child chunks, and into windows of pages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from passagework.functions.text import clean_text, structural_units, text_shape
from passagework.operators.numbering import numbered


@dataclass(frozen=True)
class Cut:
    """How long pieces may be, how much neighbours share, and where to cut, best places first."""

    size: int
    overlap: int
    separators: tuple[str, ...]


_PROSE, _SENTENCE, _CODE = ("\n\n", "\n", " ", ""), ("\n\n", "\n", ". ", " ", ""), ("\n```\n", "\n\n", "\n", " ", "")
#: Fixed values: (parent, child) cuts by shape.
CUTS = {
    "prose": (Cut(2400, 400, _PROSE), Cut(600, 120, _SENTENCE)),
    "code": (Cut(2400, 300, _CODE), Cut(600, 100, _CODE)),
    "academic": (Cut(2000, 500, _SENTENCE), Cut(500, 150, _SENTENCE)),
}


def cuts_for(shape: str) -> tuple[Cut, Cut]:
    return CUTS["code" if shape == "code_heavy" else "academic" if shape in ("academic_dense", "numbered_spec_academic") else "prose"]


def split_text(text: str, cut: Cut) -> list[str]:
    """Stripped pieces of at most ``cut.size`` characters where the separators allow it.

    The text is cut at the best separator that it holds, which stays at the start of what follows; parts that are too
    long are cut again at lesser ones. Parts are put together up to the size; the last ones of a piece, up to the
    overlap, begin the next one.
    """
    return [p for p in (piece.strip() for piece in _pieces(text, cut, 0)) if p]


def _parts(text: str, separator: str) -> list[str]:
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in [first, *(separator + r for r in rest)] if p]


def _pieces(text: str, cut: Cut, level: int) -> list[str]:
    while level < len(cut.separators) - 1 and cut.separators[level] not in text:
        level += 1
    out: list[str] = []
    short: list[str] = []
    for part in _parts(text, cut.separators[level]):
        if len(part) <= cut.size:
            short.append(part)
            continue
        out += _merged(short, cut)
        short = []
        out += _pieces(part, cut, level + 1) if level + 1 < len(cut.separators) else [part]
    return out + _merged(short, cut)


def _merged(parts: list[str], cut: Cut) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    length = 0
    for part in parts:
        if held and length + len(part) > cut.size:
            out.append("".join(held))
            while held and (length > cut.overlap or length + len(part) > cut.size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    return [*out, "".join(held)] if held else out


CHUNK_SCHEMA = (
    "document_id string, source_file string, physical_page int, chunk_id string, parent_id string, node_type string, hierarchy_level int, chunk_index int, "
    "parent_index int, child_index int, doc_shape string, text string"
)


def _page_chunks(same: dict, units: list[str]) -> Iterator[dict]:
    """The rows of a page: each parent, then its children."""
    parent_cut, child_cut = cuts_for(same["doc_shape"])
    number = count()
    for i, parent in enumerate(p for unit in units for p in split_text(unit, parent_cut)):
        parent_id = f"{same['document_id']}_page_{same['physical_page']}_parent_{i}"
        yield same | {"chunk_id": parent_id, "parent_id": None, "node_type": "parent", "hierarchy_level": 1, "chunk_index": next(number), "parent_index": i, "child_index": None, "text": parent}
        for j, child in enumerate(split_text(parent, child_cut)):
            yield same | {"chunk_id": f"{parent_id}_child_{j}", "parent_id": parent_id, "node_type": "raw", "hierarchy_level": 0, "chunk_index": next(number), "parent_index": i, "child_index": j, "text": child}


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int32() if k == "int" else pa.string()) for n, k in (c.split() for c in CHUNK_SCHEMA.split(", "))])
    for batch in batches:
        for page in batch.to_pylist():
            rows = list(_page_chunks({k: page[k] for k in ("document_id", "source_file", "physical_page", "doc_shape")}, page["units"]))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


@F.udtf(returnType=CHUNK_SCHEMA, useArrow=True)
class ChunkUnits:
    """chunk_units(document_id, source_file, physical_page, doc_shape, units): the chunks of a page, as a table function."""

    def eval(self, document_id: str, source_file: str, physical_page: int, doc_shape: str, units: list[str]) -> Iterator[tuple]:
        names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
        same = {"document_id": document_id, "source_file": source_file, "physical_page": physical_page, "doc_shape": doc_shape}
        for row in _page_chunks(same, [] if units is None else list(units)):
            yield tuple(row[name] for name in names)


def chunk_pages(pages: DataFrame) -> DataFrame:
    """Parent and child chunks of pages (document_id, source_file, physical_page, text), a parent before its children.

    Pages are shaped and cut at their headers by column expressions; only the merging of parts runs in Arrow batches,
    a page at a time. Blank and null pages have no chunks.
    """
    return shaped_pages(pages).mapInArrow(_chunk_batches, CHUNK_SCHEMA)


def shaped_pages(pages: DataFrame) -> DataFrame:
    """(document_id, source_file, physical_page, doc_shape, units) of pages with text: their shape, and their parts between headers."""
    text = clean_text(F.coalesce(F.col("text"), F.lit("")))
    shaped = pages.select(F.col("document_id").cast("string").alias("document_id"), F.col("source_file").cast("string").alias("source_file"), F.col("physical_page").cast("int").alias("physical_page"), text.alias("text"))
    shaped = shaped.where("text <> ''").withColumn("doc_shape", text_shape(F.col("text")))
    return shaped.select("document_id", "source_file", "physical_page", "doc_shape", structural_units(F.col("text"), F.col("doc_shape")).alias("units"))


def register_chunker(pages: DataFrame, view: str = "shaped_pages") -> None:
    """Makes ``chunk_units`` known to SQL, and the shaped pages as a view to call it on:

    ``SELECT c.* FROM shaped_pages p, LATERAL chunk_units(p.document_id, p.source_file, p.physical_page, p.doc_shape, p.units) c``
    """
    pages.sparkSession.udtf.register("chunk_units", ChunkUnits)
    shaped_pages(pages).createOrReplaceTempView(view)


def page_windows(pages: DataFrame, width: int = 3, shortest: int = 200, most: int | None = None) -> DataFrame:
    """(document_id, window, first_page, last_page, text): pages (document_id, physical_page, text) in groups of ``width``.

    Windows shorter than ``shortest`` characters go. ``most``: so many of a document's windows, evenly spread.
    """
    grouped = pages.groupBy("document_id", F.floor((F.col("physical_page") - 1) / width).alias("slot")).agg(
        F.min("physical_page").alias("first_page"), F.max("physical_page").alias("last_page"), F.array_sort(F.collect_list(F.struct("physical_page", "text"))).alias("held")
    )
    joined = grouped.withColumn("text", F.array_join(F.transform("held", lambda p: p["text"]), "\n\n")).where(F.length("text") >= shortest).drop("held")
    windows = numbered(joined, ["document_id"], [F.col("slot")], F.floor(F.col("slot") / 1000), "window").withColumn("window", F.col("window") - 1)
    if most is not None:
        sizes = windows.groupBy(F.col("document_id").alias("_document")).agg(F.count("*").alias("_n"))
        step = F.greatest(F.col("_n") / most, F.lit(1.0))
        windows = windows.join(sizes, F.col("document_id").eqNullSafe(F.col("_document")))
        windows = windows.where(F.exists(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * step) == F.col("window"))).drop("_n", "_document")
    return windows.drop("slot")

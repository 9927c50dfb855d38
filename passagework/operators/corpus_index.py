"""A saved index of chunks and vectors: segments that are only ever added, tombstones, and one manifest a generation.

Under a folder lie ``segments/<name>/`` with tables, and ``manifests/<generation>.json`` naming the segments that a
generation consists of. A change writes one segment with what it adds, marks what it takes away, and then its manifest,
which comes to be in one step. Whoever opened an earlier generation keeps reading that one.

Tables of a segment: chunks (with ``row``), lengths, postings (a chunk's words and counts, in the chunks' order, so that none
is shuffled), bounds (of each word in a block of chunks, blocks together), df (what it adds to and takes from each term's
number of chunks), gone (rows of earlier segments that no longer count), vectors (by kind and cell) and cells.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from passagework.functions.text import tokens
from passagework.operators.cells import assigned_cells, chosen_pivots
from passagework.operators.index import term_stats

#: Rows of a block, for which one greatest term frequency and one least length are kept.
BLOCK_ROWS = 256
KEY = ["segment", "row"]


def _hadoop(spark: SparkSession, path: str) -> tuple:
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()), name


def _names(spark: SparkSession, path: str) -> list[str]:
    system, name = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(name)) if system.exists(name) else []


def _read(spark: SparkSession, path: str) -> dict:
    system, name = _hadoop(spark, path)
    stream = system.open(name)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, content: dict) -> None:
    """Writes ``path`` in one step: under another name first, then renamed. Fails if it is there, as another writer was faster."""
    system, name = _hadoop(spark, path)
    other = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = system.create(other, False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(system.makeQualified(other), system.makeQualified(name), none)


@dataclass(frozen=True)
class CorpusIndex:
    """One generation, as its manifest has it; later changes don't touch it."""

    spark: SparkSession
    folder: str
    generation: int = 0
    segments: tuple[dict, ...] = ()
    pivots: str | None = None

    def table(self, name: str) -> DataFrame | None:
        """The rows of a table in all segments, with their segment's number; None if no segment has it."""
        out = None
        for s in self.segments:
            if name in s["tables"]:
                rows = self.spark.read.parquet(f"{self.folder}/segments/{s['name']}/{name}").withColumn("segment", F.lit(s["number"]))
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def live(self, name: str) -> DataFrame:
        """A table's rows that no later segment has taken away."""
        rows, gone = self.table(name), self.table("gone")
        return rows if gone is None else rows.join(gone.select(F.col("of").alias("segment"), "row"), KEY, "left_anti")

    @property
    def block_rows(self) -> int:
        return BLOCK_ROWS

    @property
    def chunks(self) -> DataFrame:
        return self.live("chunks").drop(*KEY)

    @property
    def world(self) -> tuple[int, int]:
        """(chunks, words), kept by the manifest."""
        return sum(s["chunks"] for s in self.segments), sum(s["words"] for s in self.segments)

    def terms(self) -> DataFrame:
        """(term, df, idf) of this generation: sums over the segments."""
        df = self.table("df").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return term_stats(df, self.spark.range(1).select(F.lit(self.world[0]).alias("n_chunks")))


def open_index(spark: SparkSession, folder: str, generation: int | None = None) -> CorpusIndex:
    """The newest generation, or the one asked for."""
    names = [n for n in _names(spark, f"{folder}/manifests") if n.endswith(".json")]
    if not names:
        return CorpusIndex(spark, folder)
    content = _read(spark, f"{folder}/manifests/{names[-1] if generation is None else f'{generation:012d}.json'}")
    return CorpusIndex(spark, folder, content["generation"], tuple(content["segments"]), content["pivots"])


def _save(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    writer = df.write
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def _counted_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a chunk's words, as its distinct words and how often it has each."""
    for whole in batches:
        for start in range(0, whole.num_rows, 1024):
            batch = whole.slice(start, 1024)
            lists = batch.column(batch.num_columns - 1)
            words = pc.dictionary_encode(lists.flatten())
            n = max(1, len(words.dictionary))
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            key, tf = np.unique(row * n + words.indices.to_numpy(), return_counts=True)
            at = pa.array(np.append(0, np.cumsum(np.bincount(key // n, minlength=batch.num_rows))).astype(np.int32))
            terms = pa.ListArray.from_arrays(at, words.dictionary.take(pa.array(key % n)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], terms, pa.ListArray.from_arrays(at, pa.array(tf))], names=[*batch.schema.names[:-1], "terms", "counts"])


def _text_tables(path: str, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes chunks, postings, lengths and bounds; returns (term, df) and the lengths. Texts are read once; only a block's bounds are shuffled."""
    held = _save(chunks.drop(*KEY).withColumn("row", F.monotonically_increasing_id()), f"{path}/chunks")
    words = held.select("row", "chunk_id", "node_type", tokens(F.col("text")).alias("words"))
    words = words.select("row", "chunk_id", "node_type", F.size("words").cast("long").alias("length"), "words")
    schema = f"row long, chunk_id {dict(held.dtypes)['chunk_id']}, node_type string, length long, terms array<string>, counts array<long>"
    postings = _save(words.mapInArrow(_counted_batches, schema).withColumn("block", F.expr(f"row div {BLOCK_ROWS}")), f"{path}/postings")
    lengths = _save(postings.select("row", "chunk_id", "length"), f"{path}/lengths")
    each = postings.select("block", "length", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("block", "length", F.col("p.terms").alias("term"), F.col("p.counts").alias("tf"))
    bounds = each.groupBy("term", "block").agg(F.max("tf").alias("most"), F.min("length").alias("shortest"), F.count("*").alias("n"))
    bounds = _save(bounds.repartition("block").sortWithinPartitions("block", "term"), f"{path}/bounds")
    return bounds.groupBy("term").agg(F.sum("n").alias("df")), lengths


def _changed(index: CorpusIndex, added: DataFrame | None, vectors: DataFrame | None = None, dead: DataFrame | None = None, replace: bool = False) -> CorpusIndex:
    """The next generation: ``added`` chunks with their ``vectors`` (chunk_id, vector), without the rows ``dead`` (segment, row).

    ``replace`` makes the new segment the only one.
    """
    spark, number = index.spark, index.generation + 1
    segment = {"name": f"{number:012d}-{uuid.uuid4().hex[:8]}", "number": number, "tables": [], "chunks": 0, "words": 0}
    path, pivots = f"{index.folder}/segments/{segment['name']}", index.pivots
    df = None
    if added is not None:
        df, lengths = _text_tables(path, added)
        segment["tables"] += ["chunks", "lengths", "postings", "bounds"]
        sums = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        segment["chunks"], segment["words"] = sums["n"], sums["words"]
        if vectors is not None:
            rows = spark.read.parquet(f"{path}/chunks").select("row", "chunk_id", "node_type")
            rows = rows.join(vectors.select("chunk_id", "vector").where("vector is not null"), "chunk_id")
            if pivots is None:
                pivots = f"{path}/pivots"
                chosen_pivots(rows).write.parquet(pivots)
            placed = assigned_cells(rows, spark.read.parquet(pivots)).repartitionByRange("node_type", "cell", "to_pivot", "row").sortWithinPartitions("node_type", "cell", "to_pivot")
            placed = _save(placed, f"{path}/vectors", ["node_type", "cell"])
            _save(placed.groupBy("node_type", "cell").agg(F.count("*").alias("n"), F.min("to_pivot").alias("low"), F.max("to_pivot").alias("high")), f"{path}/cells")
            segment["tables"] += ["vectors", "cells"]
    if dead is not None:
        gone = _save(dead.select(F.col("segment").alias("of"), "row"), f"{path}/gone")
        segment["tables"].append("gone")
        marked = gone.withColumnRenamed("of", "segment")
        sums = index.table("lengths").join(marked, KEY).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        segment["chunks"], segment["words"] = segment["chunks"] - sums["n"], segment["words"] - sums["words"]
        taken = index.table("postings").join(marked, KEY).select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
        df = taken if df is None else df.unionByName(taken)
    if df is not None:
        _save(df.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), f"{path}/df")
        segment["tables"].append("df")
    segments = (segment,) if replace else (*index.segments, segment)
    _publish(spark, f"{index.folder}/manifests/{number:012d}.json", {"generation": number, "segments": segments, "pivots": pivots})
    return CorpusIndex(spark, index.folder, number, segments, pivots)


def insert(index: CorpusIndex, chunks: DataFrame, vectors: DataFrame | None = None) -> CorpusIndex:
    """Adds the chunks whose id the index lacks; repeats within ``chunks`` stay. Summaries of a tree come in this way too, into both indexes."""
    if index.segments:
        chunks = chunks.join(index.live("lengths").select("chunk_id").distinct(), "chunk_id", "left_anti").select(chunks.columns)
    return _changed(index, chunks, vectors)


def upsert(index: CorpusIndex, chunks: DataFrame, vectors: DataFrame | None = None) -> CorpusIndex:
    """Adds all of ``chunks`` in the place of those of the same id."""
    dead = index.live("lengths").join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi") if index.segments else None
    return _changed(index, chunks, vectors, dead)


def delete_document(index: CorpusIndex, document_id) -> CorpusIndex:
    """Without a document's chunks; those of a null document stay."""
    return _changed(index, None, None, index.live("chunks").where(F.col("document_id") == F.lit(document_id)))


def reindex_document(index: CorpusIndex, document_id, chunks: DataFrame, vectors: DataFrame | None = None) -> CorpusIndex:
    """A document's chunks anew, in one generation: readers see the old ones or the new ones."""
    old = index.live("chunks").select(*KEY, "document_id", "chunk_id")
    ids = chunks.select("chunk_id").distinct()
    return _changed(index, chunks, vectors, old.where(F.col("document_id") == F.lit(document_id)).unionByName(old.join(ids, "chunk_id", "left_semi").select(old.columns)).dropDuplicates(KEY))


def compact(index: CorpusIndex) -> CorpusIndex:
    """One segment of all that counts. The old ones stay for those who have opened earlier generations, until vacuum()."""
    vectors = index.live("vectors").select("chunk_id", "vector").dropDuplicates(["chunk_id"]) if index.table("vectors") is not None else None
    return _changed(index, index.live("chunks"), vectors, replace=True)


def vacuum(spark: SparkSession, folder: str, keep: int = 1) -> list[str]:
    """Deletes the manifests but for the last ``keep``, and the segments that none of these names; returns the segments' names."""
    names = [n for n in _names(spark, f"{folder}/manifests") if n.endswith(".json")]
    kept = [_read(spark, f"{folder}/manifests/{n}") for n in names[-keep:]]
    needed = {s["name"] for m in kept for s in m["segments"]} | {m["pivots"].split("/")[-2] for m in kept if m["pivots"]}
    old = [n for n in _names(spark, f"{folder}/segments") if n not in needed]
    for path in [*(f"{folder}/manifests/{n}" for n in names[:-keep]), *(f"{folder}/segments/{n}" for n in old)]:
        system, name = _hadoop(spark, path)
        system.delete(name, True)
    return old

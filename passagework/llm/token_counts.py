"""Token counts of documents in flat token files, by a scan for separators (operator 10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from passagework.llm.byte_bpe import tokenizer
from passagework.llm.scratch import Scratch
from passagework.llm.words import text_chunks

END_OF_DOCUMENT = 50256
#: Blocks that one window of the inner prefix scan holds; a file of any length is scanned in spans of so many.
SPAN = 1024


def _file_batches(ranks_path: str, block_tokens: int, end: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, file = tokenizer(ranks_path), TaskContext.get().partitionId()
        block, rest = 0, np.zeros(0, np.uint16)

        names, done = ["file", "block", "tokens", "doc_no", "doc_id"], 0

        def rows(stream: np.ndarray) -> pa.RecordBatch:
            parts = [stream[i : i + block_tokens].tobytes() for i in range(0, len(stream), block_tokens)]
            n = len(parts)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, file, np.int64)), pa.array(np.arange(block, block + n)), pa.array(parts, pa.binary()), *[pa.nulls(n, pa.int64())] * 2], names=names)

        for batch in batches:
            for a, b, data, bounds in text_chunks(batch.column(0)):
                n = b - a
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, file, np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(np.arange(done, done + n)), batch.column(1).slice(a, n)], names=names)
                done += n
                ids, at = bpe.encode(data, bounds)
                stream = np.concatenate([rest, np.insert(ids, at[1:], end).astype("<u2")])
                whole = len(stream) // block_tokens * block_tokens
                if whole:
                    yield rows(stream[:whole])
                    block += whole // block_tokens
                rest = stream[whole:]
        if len(rest):
            yield rows(rest)

    return run


def flat_token_files(docs: DataFrame, ranks_path: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 16, end: int = END_OF_DOCUMENT) -> tuple[DataFrame, DataFrame]:
    """((file, block, tokens), (file, doc_no, doc_id)): each task's documents as one stream of little-endian 16-bit ids, cut into blocks anywhere, and which they are.

    Each document's ids are followed by the end identifier. Nothing in the files says where documents begin; the second table
    only names a file's documents in order. A null or empty text is the end identifier alone; null ids and repeated rows are
    documents of their own. Both are written in one pass, so that they agree.
    """
    if end > 65535:
        raise ValueError("16-bit files hold identifiers to 65535")
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    rows = scratch.save(rows.mapInArrow(_file_batches(ranks_path, block_tokens, end), "file long, block long, tokens binary, doc_no long, doc_id long"), "tokens")
    return rows.where("block is not null").select("file", "block", "tokens"), rows.where("doc_no is not null").select("file", "doc_no", "doc_id")


def _scan_batches(end: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for tokens in batch.column(2):
                ids = np.frombuffer(tokens.as_buffer() or b"", "<u2")
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == end))
            bounds = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
            flat = np.concatenate(ends) if ends else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, pa.int64()))], names=["file", "block", "n", "ends"])

    return run


def document_token_counts(files: DataFrame, end: int = END_OF_DOCUMENT) -> DataFrame:
    """(file, doc_no, start, n_tokens, closed): the documents of flat token files (columns file, block, tokens).

    A block's separators are found by one vectorised comparison. Blocks are stitched by a prefix scan over three
    numbers each: tokens, separators and the last separator's place. It has two levels, spans of SPAN blocks and the
    blocks of a span, so that no task holds more than the spans of a file. doc_no counts from 0 in each file, start is
    the first token's place in the file; a document may have no tokens. Tokens after a file's last separator are one
    more document with closed false. Null tokens are an empty block; rows with a null file or block don't count;
    repeated rows are read once, of differing ones of one block the longest (ties: the later separators); an empty table
    gives no rows; other columns are ignored.
    """
    rows = files.select(F.col("file").cast("long"), F.col("block").cast("long"), F.col("tokens").cast("binary")).where("file is not null and block is not null")
    blocks = rows.mapInArrow(_scan_batches(end), "file long, block long, n long, ends array<long>")
    blocks = blocks.groupBy("file", "block").agg(F.max(F.struct("n", "ends")).alias("b")).select("file", "block", "b.*")
    blocks = blocks.withColumn("span", F.floor(F.col("block") / SPAN))
    inner = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("n").over(inner), F.lit(0))
    blocks = blocks.withColumn("at", at).withColumn("last", F.expr("at + element_at(if(size(ends) > 0, ends, null), -1)"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum(F.size("ends")).over(inner), F.lit(0))).withColumn("previous", F.max("last").over(inner))
    spans = blocks.groupBy("file", "span").agg(F.sum("n").alias("span_n"), F.sum(F.size("ends")).alias("span_ends"), F.max("last").alias("span_last"))
    outer = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("span_at", F.coalesce(F.sum("span_n").over(outer), F.lit(0))).withColumn("span_before", F.coalesce(F.sum("span_ends").over(outer), F.lit(0)))
    spans = spans.withColumn("span_previous", F.max(F.col("span_at") + F.col("span_last")).over(outer))
    joined = blocks.join(spans.select("file", "span", "span_at", "span_before", "span_previous"), ["file", "span"])
    joined = joined.withColumn("offset", F.col("span_at") + F.col("at")).withColumn("behind", F.coalesce(F.col("span_at") + F.col("previous"), "span_previous", F.lit(-1)))
    each = joined.select("file", "offset", "behind", "ends", (F.col("span_before") + F.col("before")).alias("docs_before"), F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("behind")).otherwise(F.col("offset") + F.expr("ends[greatest(i, 1) - 1]")) + 1
    closed = each.select("file", (F.col("docs_before") + F.col("i")).alias("doc_no"), start.alias("start"), (F.col("offset") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    totals = spans.groupBy("file").agg(F.sum("span_n").alias("n"), F.sum("span_ends").alias("doc_no"), F.coalesce(F.max(F.col("span_at") + F.col("span_last")), F.lit(-1)).alias("last"))
    tail = totals.where("n > last + 1").select("file", "doc_no", F.expr("last + 1").alias("start"), F.expr("n - last - 1").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tail)

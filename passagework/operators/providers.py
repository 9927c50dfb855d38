"""What a model would do, as exchangeable functions, with plain stand-ins that need none.

The stand-ins make the rest of the library run and testable; their quality says nothing about a trained model's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from passagework.functions.text import tokens
from passagework.operators.rank import overlap_score

#: (rows, text column) -> rows with a column ``vector``.
Embedder = Callable[[DataFrame, str], DataFrame]
#: (query, text) -> score.
PairScorer = Callable[[Column, Column], Column]
#: An ordered array of texts -> a summary.
Summarizer = Callable[[Column], Column]
#: (answer, context) -> faithfulness between 0 and 1.
Judge = Callable[[Column, Column], Column]
#: A file's bytes -> an array of page texts.
PageTextExtractor = Callable[[Column], Column]

DIMENSIONS, SUMMARY_CHARS, SUMMARY_JOINT = 64, 1800, "\n\n---\n\n"


def hash_embedder(rows: DataFrame, text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """Words hashed to signed coordinates, summed, of unit length; a text without words is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, tuple[int, float]] = {}
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            words = pc.dictionary_encode(lists.flatten())
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            if len(places) > 1_000_000:
                places.clear()
            for w in words.dictionary.to_pylist():
                if w not in places:
                    h = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little")
                    places[w] = (h % dimensions, 1.0 if h >> 63 else -1.0)
            known = np.array([places[w] for w in words.dictionary.to_pylist()], dtype=float).reshape(-1, 2)[words.indices.to_numpy()]
            out = np.bincount(row * dimensions + known[:, 0].astype(np.int64), weights=known[:, 1], minlength=batch.num_rows * dimensions).reshape(-1, dimensions)
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            flat = pa.array((out / np.where(norm > 0, norm, 1)).ravel())
            at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dimensions)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(at, flat)], names=[*batch.schema.names[:-1], "vector"])

    fields = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    return rows.withColumn("_words", tokens(F.col(text_col))).mapInArrow(run, f"{fields}, vector array<double>")


pair_scorer: PairScorer = overlap_score


def first_texts(texts: Column) -> Column:
    """The texts one after the other, cut to 1800 characters."""
    return F.substring(F.array_join(texts, SUMMARY_JOINT), 1, SUMMARY_CHARS)


def share_in_context(answer: Column, context: Column) -> Column:
    """The share of an answer's words that its context holds."""
    return overlap_score(answer, context)


def decoded_text(content: Column) -> Column:
    """A text file as one page."""
    return F.array(F.decode(content, "UTF-8"))

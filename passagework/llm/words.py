"""Words, shingles and their 64-bit hashes for Arrow batches of texts, without a Python loop over words.

Separators and the letters A-Z are single bytes in UTF-8, so words are cut on the bytes themselves. A word's hash is
a polynomial over its bytes: prefix sums of byte * B^i give it for all words of a chunk at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from passagework.llm.scratch import short_shuffles

#: Bytes that separate words: white space only, or everything in ASCII but digits and lower-case letters.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
NON_ALPHANUMERIC = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90))

#: Bytes of text that are worked on at once, and rows whose texts are copied at once.
CHUNK_BYTES, CHUNK_ROWS = 1 << 18, 1024
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit of the input moves half of the output's."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    values[65:91] = values[97:123]
    return values


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


class Words:
    """The words of some texts. ``first[i]:first[i+1]`` are those of text i; ``start`` and ``end`` are byte places."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, separators: bytes):
        is_word = np.ones(256, dtype=bool)
        is_word[list(separators)] = False
        inside = is_word[data] if len(data) else np.zeros(0, dtype=bool)
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[bounds] = True
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        self.start = np.flatnonzero(inside & (~before | cut[:-1]))
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.per_text = np.diff(self.first)
        n = max(CHUNK_BYTES * 2, 1 << max(1, int(len(data)).bit_length()))
        powers, inverses = _powers(n)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_byte_values()[data] * powers[: len(data)], out=sums[1:])
        self._sums, self._inverses = sums, inverses
        self.hash = self._hash(self.end)

    def _hash(self, end: np.ndarray) -> np.ndarray:
        raw = (self._sums[end] - self._sums[self.start]) * self._inverses[self.start]
        return mix(raw + (end - self.start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def stem_hash(self, size: int) -> np.ndarray:
        """A hash of each word's first ``size`` bytes, unlike any word's own."""
        return mix(self._hash(np.minimum(self.start + size, self.end)) + np.uint64(size))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, bounds by text) of all runs of k words in order; a text of 1 to k-1 words gives its whole sequence."""
        n = len(self.hash)
        text = np.repeat(np.arange(len(self.per_text)), self.per_text)
        h = _chain([self.hash[i : n - k + 1 + i] for i in range(k)]) if n >= k else np.zeros(0, np.uint64)
        keep = text[: len(h)] == text[k - 1 :] if n >= k else np.zeros(0, bool)
        counts = np.maximum(self.per_text - k + 1, (self.per_text > 0).astype(np.int64))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(bounds[-1], dtype=np.uint64)
        long = self.per_text >= k
        place = np.repeat(long, counts)
        out[place] = h[keep]
        for i in np.flatnonzero(~long & (self.per_text > 0)):
            run = self.hash[self.first[i] : self.first[i + 1]]
            out[bounds[i]] = _chain([run[j : j + 1] for j in range(len(run))])[0]
        return out, bounds


def _chain(parts: list[np.ndarray]) -> np.ndarray:
    h = mix(parts[0] + np.uint64(len(parts)))
    for part in parts[1:]:
        h = mix(h * np.uint64(0xFF51AFD7ED558CCD & _MASK) + part)
    return h


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, bounds) of runs of rows with about ``limit`` bytes of text, one row at least. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for start in range(0, len(texts), CHUNK_ROWS):
        part = pc.fill_null(texts.slice(start, CHUNK_ROWS).cast(pa.large_string()), "")
        n = len(part)
        _, offsets, data = part.buffers()
        bounds = np.frombuffer(offsets, np.int64)[part.offset : part.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + limit, side="right")) - 1)
            b = min(b, n)
            yield start + a, start + b, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
            a = b


def distinct_by_text(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and their bounds."""
    hashes = hashes.copy()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[bounds[:-1][bounds[:-1] < len(hashes)]] = True
    counts = np.add.reduceat(np.concatenate([new, [False]]).astype(np.int64), bounds[:-1]) if len(bounds) > 1 else np.zeros(0, np.int64)
    counts[np.diff(bounds) == 0] = 0
    return hashes[new], np.concatenate([[0], np.cumsum(counts)])


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """An Arrow list column; uint64 hashes become long."""
    values = values.view(np.int64) if values.dtype == np.uint64 else values
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """The words at some byte places, A-Z lower-cased."""
    bounds = np.concatenate([[0], np.cumsum(end - start)])
    out = data[np.repeat(start - bounds[:-1], end - start) + np.arange(bounds[-1])]
    out = np.where((out >= 65) & (out <= 90), out + 32, out).astype(np.uint8)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes()))


#: Bytes of a filter that lets all of some keys pass, whatever their number, and some others; its rows.
FILTER_BYTES, FILTER_ROWS = 1 << 24, 1 << 10


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple((x % np.uint64(FILTER_BYTES * 8)).astype(np.int64) for x in (keys, mix(keys)))


def _bit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, bits) of the rows of the filter that a task's keys touch."""
    table = np.zeros(FILTER_BYTES, dtype=np.uint8)
    for batch in batches:
        for place in _places(batch.column(0).to_numpy().view(np.uint64)):
            np.bitwise_or.at(table, place >> 3, np.uint8(128) >> (place & 7).astype(np.uint8))
    table = table.reshape(FILTER_ROWS, -1)
    touched = np.flatnonzero(table.any(axis=1))
    for some in np.array_split(touched, 16):
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([table[i].tobytes() for i in some], pa.binary())], names=["row", "bits"])


def _either(rows: pa.Table) -> pa.Table:
    out = np.zeros(FILTER_BYTES // FILTER_ROWS, dtype=np.uint8)
    for value in rows.column("bits"):
        out |= np.frombuffer(value.as_py(), np.uint8)
    return pa.table({"row": rows.column("row").slice(0, 1), "bits": pa.array([out.tobytes()], pa.binary())})


def bit_filter(keys: DataFrame) -> np.ndarray:
    """FILTER_BYTES bytes with two bits set for each key (a column of longs). It grows no larger with more keys, but lets more others pass."""
    with short_shuffles(keys.sparkSession):
        rows = keys.mapInArrow(_bit_batches, "row long, bits binary").groupBy("row").applyInArrow(_either, "row long, bits binary").collect()
    table = np.zeros((FILTER_ROWS, FILTER_BYTES // FILTER_ROWS), dtype=np.uint8)
    for row in rows:
        table[row["row"]] = np.frombuffer(row["bits"], np.uint8)
    return table.ravel()


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    one, two = ((table[place >> 3] << (place & 7).astype(np.uint8)) & np.uint8(128) > 0 for place in _places(keys))
    return one & two

"""Benchmark passages in documents: SimHash over item-sized windows, Hamming blocks, exact similarity (operator 2)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from passagework.llm.scratch import Scratch
from passagework.llm.words import NON_ALPHANUMERIC, Words, lists, mix, text_chunks

#: Fingerprints within RADIUS of 64 bits are found, all of them: of BLOCKS blocks, some block differs in one bit at most
#: (RADIUS < 2 * BLOCKS). At a similarity of 0.8, 10 bits differ on average, and more than 24 once in some million pairs.
RADIUS, BLOCKS, BITS = 24, 13, 5
#: Shingles of items that one index holds, in a task's memory at about 40 bytes each, and shingles of windows held at a time.
MOST_SHINGLES, STEP = 2_000_000, 1 << 20


def _simhash(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each run of shingle hashes; a shingle's weight is how often it stands in the run."""
    out = np.zeros(len(bounds) - 1, dtype=np.uint64)
    mixed = mix(hashes + np.uint64(0x5851F42D4C957F2D))
    n = np.diff(bounds)
    for bit in range(64):
        on = np.concatenate([[0], np.cumsum((mixed >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        votes = on[bounds[1:]] - on[bounds[:-1]]
        out |= (2 * votes > n).astype(np.uint64) << np.uint64(bit)
    return out


def _near(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which pairs of fingerprints differ in RADIUS bits at most: those with a near block, then counted in full."""
    differ = one ^ two
    near = np.zeros(len(differ), dtype=bool)
    for i in range(BLOCKS):
        near |= np.bitwise_count((differ >> np.uint64(BITS * i)) & np.uint64(2**BITS - 1)) <= 1
    return near & (np.bitwise_count(differ) <= RADIUS)


def _item_batches(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in text_chunks(batch.column(1)):
                words = Words(data, bounds, NON_ALPHANUMERIC)
                hashes, at = words.shingles(shingle)
                columns = [batch.column(0).slice(a, b - a), pa.array(words.per_text), pa.array(_simhash(hashes, at).view(np.int64)), lists(hashes, at)]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "n_words", "item_print", "item_shingles"])

    return run


def benchmark_items(benchmark: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, n_words, item_print, item_shingles) of the items that have words."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_item_batches(shingle), "item_id long, n_words long, item_print long, item_shingles array<long>").where("n_words > 0")


@dataclass(frozen=True)
class _Items:
    """A part of the benchmark. Item i has the shingles ``shingles[bounds[i]:bounds[i + 1]]``, in order."""

    item_id: pa.Array
    n_words: np.ndarray
    prints: np.ndarray
    shingles: np.ndarray
    bounds: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> _Items:
        table = table.combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        held = column("item_shingles")
        sizes = np.diff(held.offsets.to_numpy())
        return _Items(column("item_id"), column("n_words").to_numpy(), column("item_print").to_numpy().view(np.uint64), held.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(sizes)]))


class _Index:
    """Where the shingles of items stand, for the items whose runs have ``k`` words; and these shingles, sorted by item."""

    def __init__(self, items: _Items, chosen: np.ndarray, k: int):
        self.k, self.items, self.chosen = k, items, chosen
        self.sizes = np.diff(items.bounds)[chosen]
        item = np.repeat(np.arange(len(chosen)), self.sizes)
        self.begin_of = np.concatenate([[0], np.cumsum(self.sizes)])
        offset = np.arange(len(item)) - self.begin_of[item]
        hashes = items.shingles[items.bounds[chosen][item] + offset]
        order = np.argsort(hashes, kind="stable")
        self.item, self.offset = item[order], offset[order]
        self.hashes, self.begin, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.cost = np.add.reduceat(self.sizes[self.item], self.begin)  # shingles of the windows that a meeting asks for
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.n_words, self.prints = items.n_words[chosen], items.prints[chosen]
        by_item = np.lexsort((hashes, item))
        new = np.ones(len(item), dtype=bool)
        new[1:] = (item[by_item][1:] != item[by_item][:-1]) | (hashes[by_item][1:] != hashes[by_item][:-1])
        first = np.flatnonzero(new)
        self.values, self.times = hashes[by_item][first], np.diff(np.append(first, len(item)))
        self.distinct = np.searchsorted(item[by_item][first], np.arange(len(chosen) + 1))

    def meetings(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among ``hashes``, number of the shingle) of those that items have."""
        place = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[place]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[place]
        return place[hit], at[hit]

    def overlaps(self, window: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Sums of the least counts of a window's shingles and each wanted item's."""
        values, times = np.unique(window, return_counts=True)
        size = self.distinct[wanted + 1] - self.distinct[wanted]
        ends = np.cumsum(size)
        own = np.repeat(self.distinct[wanted] - (ends - size), size) + np.arange(int(ends[-1]))
        at = np.minimum(np.searchsorted(values, self.values[own]), len(values) - 1)
        both = np.where(values[at] == self.values[own], np.minimum(times[at], self.times[own]), 0)
        return np.add.reduceat(both, ends - size)


def _indexes(items: _Items, shingle: int) -> list[_Index]:
    """One index for each length of runs: items shorter than a shingle are runs of their own size."""
    k = np.minimum(items.n_words, shingle)
    return [_Index(items, np.flatnonzero(k == size), int(size)) for size in np.unique(k)]


def _best(found: np.ndarray) -> np.ndarray:
    """Of rows (text, item, -similarity, first word, words), the best of each text and item; ties: the first place."""
    found = found[np.lexsort(found.T[::-1])]
    keep = np.ones(len(found), dtype=bool)
    keep[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[keep]


def candidate_steps(words: Words, index: _Index, shingle: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(pairs, hashes, size, begin) by steps of about STEP shingles: pairs (text, first word, words, item) of windows and
    items that share a run at the same place, the texts' run hashes, and each pair's window in them.

    Where items are one run, all windows with it are equal, and a text's first is its best.
    """
    hashes, at = words.shingles(index.k)
    place, shared = index.meetings(hashes)
    text = np.searchsorted(at, place, side="right") - 1
    if index.k < shingle and len(place):
        first = np.unique(np.stack([text, shared], axis=1), axis=0, return_index=True)[1]
        place, shared, text = place[first], shared[first], text[first]
    step = np.cumsum(index.cost[shared]) // STEP if len(place) else np.zeros(0, np.int64)
    for rows in np.split(np.arange(len(place)), np.flatnonzero(np.diff(step)) + 1):
        if not len(rows):
            continue
        size = index.count[shared[rows]]
        ends = np.cumsum(size)
        spot = np.repeat(index.begin[shared[rows]] - (ends - size), size) + np.arange(int(ends[-1]))
        item, of = index.item[spot], np.repeat(text[rows], size)
        length = np.minimum(index.n_words[item], words.per_text[of])
        start = np.clip(np.repeat(place[rows], size) - at[of] - index.offset[spot], 0, words.per_text[of] - length)
        pairs = np.unique(np.stack([of, start, length, item], axis=1), axis=0)
        yield pairs, hashes, np.maximum(pairs[:, 2] - index.k + 1, 1), at[pairs[:, 0]] + pairs[:, 1]


def _search(words: Words, indexes: list[_Index], shingle: int, percent: int) -> Iterator[tuple[_Index, np.ndarray]]:
    """(index, rows of _best()) of the items that the texts hold."""
    for index in indexes:
        found = np.zeros((0, 5))
        for pairs, hashes, size, begin in candidate_steps(words, index, shingle):
            new = np.ones(len(pairs), dtype=bool)  # pairs are sorted by window
            new[1:] = (pairs[1:, :3] != pairs[:-1, :3]).any(axis=1)
            window, number = np.flatnonzero(new), np.cumsum(new) - 1
            ends = np.cumsum(size[window])
            inside = hashes[np.repeat(begin[window] - (ends - size[window]), size[window]) + np.arange(int(ends[-1]))]
            prints = _simhash(inside, np.concatenate([[0], ends]))
            near = np.flatnonzero(_near(prints[number], index.prints[pairs[:, 3]]))
            for rows in np.split(near, np.flatnonzero(np.diff(number[near])) + 1):
                if len(rows):
                    item, n = pairs[rows, 3], size[rows[0]]
                    both = index.overlaps(hashes[begin[rows[0]] : begin[rows[0]] + n], item)
                    either = n + index.sizes[item] - both
                    good = 100 * both >= percent * either
                    hits = pairs[rows[good]]
                    found = np.concatenate([found, np.stack([hits[:, 0], hits[:, 3], -both[good] / either[good], hits[:, 1], hits[:, 2]], axis=1)])
            found = _best(found)
        if len(found):
            yield index, found


def _report_batches(items: _Items, shingle: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = _indexes(items, shingle)
        for batch in batches:
            for a, _, data, bounds in text_chunks(batch.column(1)):
                for index, found in _search(Words(data, bounds, NON_ALPHANUMERIC), indexes, shingle, percent):
                    text, item, less, start, _ = found.T
                    item = index.chosen[item.astype(np.int64)]
                    columns = [batch.column(0).slice(a).take(pa.array(text.astype(np.int64))), items.item_id.take(pa.array(item)), pa.array(start.astype(np.int64)), pa.array(items.n_words[item]), pa.array(-less)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "start_word", "n_words", "similarity"])

    return run


def _filter_batches(items: _Items, text_col: str, shingle: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = _indexes(items, shingle)
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for a, _, data, bounds in text_chunks(batch.column(batch.schema.get_field_index(text_col))):
                for _, found in _search(Words(data, bounds, NON_ALPHANUMERIC), indexes, shingle, percent):
                    keep[a + found[:, 0].astype(np.int64)] = False
            yield batch.filter(pa.array(keep))

    return run


def _parts(benchmark: DataFrame, id_col: str, text_col: str, shingle: int) -> Iterator[_Items]:
    """The benchmark in parts of about MOST_SHINGLES, by hashes of the items' shingles. The driver holds one at a time."""
    items = Scratch(benchmark.sparkSession).save(benchmark_items(benchmark, shingle, id_col, text_col), "items")
    total = items.agg(F.coalesce(F.sum(F.size("item_shingles")), F.lit(0)).alias("n")).first()["n"]
    parts = -(-total // MOST_SHINGLES)
    for part in range(parts):
        held = items.where(F.pmod(F.xxhash64("item_id", "item_shingles"), F.lit(parts)) == part).toArrow()
        if held.num_rows:
            yield _Items.of(held)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item (see contaminated()), with all their columns.

    Each row is judged by its own text, so that rows of a null id and several texts of one id are told apart; repeated
    rows have one fate. Items of a null id count. Null and empty texts hold nothing and stay. Nothing is shuffled.
    """
    for items in _parts(benchmark, item_id_col, item_text_col, shingle):
        docs = docs.mapInArrow(_filter_batches(items, text_col, shingle, percent), docs.schema)
    return docs


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): each benchmark item that a document holds, at its best place.

    Words: runs of letters, digits and non-ASCII, A-Z lower-cased. Windows of an item's number of words (or the whole
    text, if shorter) are compared by the weighted Jaccard similarity of their ``shingle``-word runs: the sum of least
    counts over the sum of greatest counts, at least ``percent``. A window and an item are a candidate pair if they
    share a run at the same place in both: a pair that shares none in any window can't be similar. So a window's
    candidates don't grow with the benchmark, but with the items that share its runs. The 64-bit SimHash fingerprints of
    a pair are tested by Hamming blocks, which let pass every pair within RADIUS, and what passes is compared in full.
    Ties of similarity: the first place.

    An item or text shorter than ``shingle`` words is one run; such an item is looked for among all runs of its length.
    Null or empty texts and items hold nothing; rows with a null id on either side are not reported (drop_contaminated()
    judges them); repeated rows are reported once; of several texts with one id the best place counts; very long texts are
    searched in steps; empty tables give no rows; other columns are ignored.

    The documents are not shuffled: each task holds an index of the benchmark, of MOST_SHINGLES shingles or of one longer
    item at most. A larger benchmark is searched in parts, each with a scan of the documents. Only places found are grouped.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    schema = "doc_id long, item_id long, start_word long, n_words long, similarity double"
    found = docs.sparkSession.createDataFrame([], schema)
    for items in _parts(benchmark, item_id_col, item_text_col, shingle):
        found = found.unionByName(rows.mapInArrow(_report_batches(items, shingle, percent), schema))
    best = found.where("item_id is not null").groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("first"), "n_words")).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.first")).alias("start_word"), "best.n_words", "best.similarity")

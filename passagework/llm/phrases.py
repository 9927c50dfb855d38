"""Phrases whose words stand together more often than apart, counted in direct-address tiles (operator 13)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from passagework.llm.scratch import Scratch
from passagework.llm.words import Words, bit_filter, mix, passes, slices, text_chunks

BLANKS, BREAKS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
#: Words of a flush, ids with a rank over the whole corpus, side of a tile, and pairs that make a tile dense.
FLUSH, HEAD, SIDE = 1 << 20, 1 << 14, 256
DENSE = SIDE * SIDE // 2
_PAIR = np.uint64(0xFF51AFD7ED558CCD)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _PAIR + right)


class _Text:
    """The words of a chunk of texts: ``keys`` (of a word and its language) and whether each stands in one piece with the next."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lang: np.ndarray):
        self.words = Words(data, bounds, BLANKS + BREAKS)
        self.row = np.repeat(np.arange(len(bounds) - 1), self.words.per_text)
        self.keys = mix(self.words.hash ^ lang.view(np.uint64)[self.row])
        is_break = np.zeros(256, dtype=bool)
        is_break[list(BREAKS)] = True
        passed = np.concatenate([[0], np.cumsum(is_break[data])])
        self.joined = np.zeros(len(self.keys), dtype=bool)
        self.joined[:-1] = (passed[self.words.start[1:]] == passed[self.words.end[:-1]]) & (self.row[1:] == self.row[:-1])


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, key, n) of a task's words, summed over about FLUSH of them; a row without a word has a language's sum."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        keys, counts, langs, texts = zip(*held, strict=True)
        _, first, number = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        sums = np.bincount(number, weights=np.concatenate(counts), minlength=len(first)).astype(np.int64)
        at = pa.array(first)
        rows = [pa.concat_arrays(langs).take(at), pa.concat_arrays(texts).take(at), pa.array(np.concatenate(keys)[first].view(np.int64)), pa.array(sums)]
        held.clear()
        return pa.RecordBatch.from_arrays(rows, names=["lang", "word", "key", "n"])

    size = 0
    for batch in batches:
        langs = batch.column(0).cast(pa.string())
        for a, b, data, bounds in text_chunks(batch.column(2)):
            text = _Text(data, bounds, batch.column(1).slice(a, b - a).to_numpy())
            keys, first, counts = np.unique(text.keys, return_index=True, return_counts=True)
            held.append((keys, counts, langs.take(pa.array(a + text.row[first])), slices(data, text.words.start[first], text.words.end[first])))
            own, number = np.unique(batch.column(1).slice(a, b - a).to_numpy(), return_inverse=True)
            sums = np.bincount(number, weights=text.words.per_text, minlength=len(own)).astype(np.int64)
            shown = np.searchsorted(np.sort(number), np.arange(len(own)))
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(a + np.argsort(number, kind="stable")[shown])), pa.nulls(len(own), pa.string()), pa.nulls(len(own), pa.int64()), pa.array(sums)], names=["lang", "word", "key", "n"])
            size += len(keys)
            if size >= FLUSH:
                yield flush()
                size = 0
    if held:
        yield flush()


def _head(keys: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ranks) of the HEAD most frequent of (key, f), in order of key."""
    rows = keys.orderBy(F.desc("f"), "key").limit(HEAD).select("key").collect()
    found = np.array([r["key"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], order


def _ranked(keys: np.ndarray, times: np.ndarray, head: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """An id for each of some distinct keys: first those of the head by their rank over the corpus, then the others by frequency here."""
    rank = np.full(len(keys), np.iinfo(np.int64).max)
    if len(head[0]):
        at = np.minimum(np.searchsorted(head[0], keys), len(head[0]) - 1)
        known = head[0][at] == keys
        rank[known] = head[1][at[known]]
    ids = np.empty(len(keys), dtype=np.int64)
    ids[np.lexsort((-times, rank))] = np.arange(len(keys))
    return ids


def tile_counts(left: np.ndarray, right: np.ndarray, n_right: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left id, right id, count) of the distinct pairs of ids, each once.

    Ids are ranks, so that pairs of frequent ones crowd into the first tiles of SIDE x SIDE cells: a tile with DENSE pairs
    or more is an array that its cells address. All others are sorted lists of coordinates.
    """
    side = HEAD // SIDE
    low = (left < HEAD) & (right < HEAD)
    tile = np.where(low, (left // SIDE) * side + right // SIDE, side * side)
    sizes = np.bincount(tile, minlength=side * side + 1)[:-1]
    dense = np.flatnonzero(sizes >= DENSE)
    slot = np.full(side * side + 1, -1)
    slot[dense] = np.arange(len(dense))
    slot = slot[tile]
    found = []
    rest = slot < 0
    codes, counts = np.unique(left[rest] * n_right + right[rest], return_counts=True)
    found.append((codes // n_right, codes % n_right, counts))
    for i, t in enumerate(dense):
        at = np.flatnonzero(slot == i)
        cells = np.bincount((left[at] % SIDE) * SIDE + right[at] % SIDE, minlength=SIDE * SIDE)
        used = np.flatnonzero(cells)
        found.append((t // side * SIDE + used // SIDE, t % side * SIDE + used % SIDE, cells[used]))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _ids(keys: np.ndarray, head: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the keys, the key of each id)."""
    distinct, number, times = np.unique(keys, return_inverse=True, return_counts=True)
    ids = _ranked(distinct, times, head)
    of_id = np.empty_like(distinct)
    of_id[ids] = distinct
    return ids[number], of_id


def _pair_counts(keys: np.ndarray, joined: np.ndarray, words: tuple, pairs: tuple | None) -> list[np.ndarray]:
    """[a, b, n] of the pairs of a run of words, or [a, b, c, n] of its triples of pairs that pass."""
    head, passing = words
    ids, of_id = _ids(keys, head)
    sound = passes(passing, of_id)[ids]
    pair = joined[:-1] & sound[:-1] & sound[1:]
    if pairs is None:
        at = np.flatnonzero(pair)
        left, right, n = tile_counts(ids[at], ids[at + 1], len(of_id))
        return [of_id[left], of_id[right], n]
    head, passing = pairs
    at = np.flatnonzero(pair)
    at = at[passes(passing, pair_keys(keys[at], keys[at + 1]))]
    twice = np.zeros(len(keys) + 1, dtype=bool)
    twice[at] = True
    at = at[twice[at + 1]]  # both pairs of a triple pass
    codes, number, times = np.unique(ids[at] * len(of_id) + ids[at + 1], return_inverse=True, return_counts=True)
    one, two = of_id[codes // len(of_id)], of_id[codes % len(of_id)]
    again = _ranked(pair_keys(one, two), times, head)
    of_pair = np.empty(len(codes), dtype=np.int64)
    of_pair[again] = np.arange(len(codes))
    left, right, n = tile_counts(again[number], ids[at + 2], len(of_id))
    return [one[of_pair[left]], two[of_pair[left]], of_id[right], n]


def _count_batches(words: tuple, pairs: tuple | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Text] = []
        size = 0

        def flush() -> pa.RecordBatch:
            *columns, n = _pair_counts(np.concatenate([k for k, _ in held]), np.concatenate([j for _, j in held]), words, pairs)
            held.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(n)], names=[*"abc"[: len(columns)], "n"])

        for batch in batches:
            for a, b, data, bounds in text_chunks(batch.column(1)):
                text = _Text(data, bounds, batch.column(0).slice(a, b - a).to_numpy())
                if len(text.keys):
                    held.append((text.keys, text.joined))
                    size += len(text.keys)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def phrase_counts(texts: DataFrame, scratch: Scratch, least: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Written tables of (lang, text): words (lang, word, key, f), pairs (a, b, n), triples (a, b, c, n), each at least ``least`` times, and all languages' sums (lang, n)."""
    keyed = texts.select("lang", F.xxhash64("lang").alias("lang_hash"), "text")
    counted = keyed.mapInArrow(_word_batches, "lang string, word string, key long, n long").groupBy("lang", "word").agg(F.max("key").alias("key"), F.sum("n").alias("f"))
    counted = scratch.save(counted.where(f"word is null or f >= {least}"), "words")
    words, sums = counted.where("word is not null"), counted.where("word is null").select("lang", F.col("f").alias("n"))
    plain = keyed.select("lang_hash", "text")
    of_words = (_head(words), bit_filter(words.select("key")))
    pairs = plain.mapInArrow(_count_batches(of_words, None), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(f"n >= {least}")
    pairs = scratch.save(pairs.mapInArrow(_with_pair_key, "a long, b long, n long, key long"), "pairs")
    of_pairs = (_head(pairs.select("key", F.col("n").alias("f"))), bit_filter(pairs.select("key")))
    triples = plain.mapInArrow(_count_batches(of_words, of_pairs), "a long, b long, c long, n long").groupBy("a", "b", "c").agg(F.sum("n").alias("n")).where(f"n >= {least}")
    return words, pairs.drop("key"), scratch.save(triples, "triples"), sums


def _with_pair_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = pair_keys(*(batch.column(i).to_numpy().view(np.uint64) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], names=["a", "b", "n", "key"])


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, cover: int = 50, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` best phrases of two and three words of each language.

    Texts, A-Z lower-cased, are cut at ``.,;:!?`` and line ends into pieces, and these at spaces and tabs into words. a: how
    often the phrase stands in a piece, ``least`` times or more; l and r: how often its parts do, cut where the score
    floor(1000000 * a * a / (l * r)) is least (ties: the earlier cut); n: all words of the language. A pair within a triple
    that has ``cover`` % of its occurrences or more is dropped. Order: score, a, both falling, then the phrase by bytes.

    A null language is ``und``; a null text is empty; repeated rows count as often as they stand; texts of any length are
    read in chunks; an empty table gives no rows; other columns are ignored.

    Each of three passes over the texts counts in the tasks and shuffles sums of about FLUSH words: words, pairs of
    frequent words, and triples of frequent pairs, which are ranked anew and counted as pairs with a word. What goes to
    all tasks is the head of a ranking and a filter of fixed size: it lets a rare word or pair pass now and then, which the
    threshold then drops, and keeps back no frequent one.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words, pairs, triples, sums = phrase_counts(texts, scratch, least)
    first, second = (words.select(*extra, F.col("key").alias(x), F.col("word").alias(f"word_{x}"), F.col("f").alias(f"f_{x}")) for x, extra in (("a", ["lang"]), ("b", [])))
    named = scratch.save(pairs.join(first, "a").join(second, "b"), "named")
    covering = triples.select("a", "b", "n").unionByName(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "n")).groupBy("a", "b").agg(F.max("n").alias("longest"))
    two = named.join(covering, ["a", "b"], "left").where(f"longest is null or 100 * longest < {cover} * n")
    two = two.select("lang", F.concat_ws(" ", "word_a", "word_b").alias("phrase"), F.col("n").alias("a"), F.array(F.struct(_score("n", "f_a", "f_b").alias("score"), F.lit(1).alias("k"), F.col("f_a").alias("l"), F.col("f_b").alias("r"))).alias("cuts"))
    left = named.select("lang", "a", "b", F.concat_ws(" ", "word_a", "word_b").alias("start"), "f_a", F.col("n").alias("f_ab"))
    right = named.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("word_b").alias("last"), F.col("f_b").alias("f_c"), F.col("n").alias("f_bc"))
    three = triples.join(left, ["a", "b"]).join(right, ["b", "c"])
    cuts = F.array(*(F.struct(_score("n", x, y).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate((("f_a", "f_bc"), ("f_ab", "f_c")), 1)))
    three = three.select("lang", F.concat_ws(" ", "start", "last").alias("phrase"), F.col("n").alias("a"), cuts.alias("cuts"))
    scored = two.unionByName(three).select("lang", "phrase", "a", F.array_min("cuts").alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return best.join(sums, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def _score(a: str, left: str, right: str):
    """Exact: 38 digits hold the products, and the quotient is a million at most."""
    wide = "cast({} as decimal(38,0))".format
    return F.expr(f"{wide(1000000)} * {wide(a)} * {wide(a)} div ({wide(left)} * {wide(right)})")

"""Byte-level BPE encoding and decoding on numpy matrices (operator 5)."""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from passagework.llm.words import CHUNK_BYTES, mix, text_chunks

_NONE = np.int32(2**31 - 1)
#: Longer pieces (a hundred times a long word) are merged by a heap; shorter ones in matrices.
LONG_PIECE = 512
_MATRIX_CELLS = 1 << 19
_CACHED_PIECES = 1 << 19
#: Unicode's White_Space code points.
_WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point: white space, letter, number or other."""
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LN":
            out[i] = _LETTER if kind == "L" else _NUMBER
    out[_WHITE_SPACE] = _SPACE
    return out


@lru_cache(1)
def _code_values() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def split_pieces(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces start in the code points of some texts, by the pre-tokeniser's pattern:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    Pieces are runs of one class. A run of white space before other text gives its last character away: a space joins
    the next piece, any other is a piece of its own. A contraction counts where an apostrophe starts a piece.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = _classes()[codes]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    start = edge[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:-1])  # the last of a run of white space, with text after it
    start[last] = True
    joins = last[codes[last] == 0x20]
    start[joins + 1] = False
    # contractions: an apostrophe that starts a piece, so that no space or other mark stands joined before it
    padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
    ends = np.concatenate([edge, np.ones(2, bool)])  # ends[i]: a text starts at i or nothing is there
    at = np.flatnonzero((codes == 0x27) & start[:n])
    one, two, inside = padded[at + 1], padded[at + 2], ~ends[at + 1]
    single = inside & np.isin(one, [ord(x) for x in "stmd"])
    double = inside & ~ends[at + 2] & np.logical_or.reduce([(one == ord(x)) & (two == ord(y)) for x, y in ("re", "ve", "ll")])
    for where, size in ((at[single], 2), (at[double], 3)):
        for i in range(1, size):
            start[where + i] = False
        after = where + size
        start[after[after < n]] = True
    return np.flatnonzero(start)


class PairTable:
    """Ranks of pairs of ids in an open-addressing hash table, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(4 * len(rank) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, dtype=np.int32)
        key = (left.astype(np.int64) << 20) | right
        slot, left_over = self._slot(key), np.arange(len(key))
        while len(left_over):
            free = self.keys[slot[left_over]] == -1
            claim = left_over[free]
            self.keys[slot[claim]] = key[claim]
            placed = claim[self.keys[slot[claim]] == key[claim]]
            self.ranks[slot[placed]] = rank[placed]
            left_over = np.setdiff1d(left_over, placed, assume_unique=True)
            slot[left_over] = (slot[left_over] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; a negative id or an unknown pair has none."""
        shape = left.shape
        key = ((left.astype(np.int64) << 20) | right).ravel()
        key[((left < 0) | (right < 0)).ravel()] = -2
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((held != key) & (held != -1) & (key != -2))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out.reshape(shape)


def _spread(table: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices table[begin:begin+size], joined."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return table[np.repeat(begin - (ends - size), size) + np.arange(total)]


class ByteBpe:
    """Encodes and decodes by a file of ranks (base64 bytes and a rank a line)."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        size = tokens[-1][1] + 1
        self.token_size = np.zeros(size, dtype=np.int64)
        self.token_size[[r for _, r in tokens]] = [len(t) for t, _ in tokens]
        self.token_begin = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        digits = [b" %d" % i for i in range(size)]
        self.digit_size = np.array([len(x) for x in digits], dtype=np.int64)
        self.digit_begin = np.cumsum(self.digit_size) - self.digit_size
        self.digit_bytes = np.frombuffer(b"".join(digits), np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in tokens for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pair_rank = PairTable(*np.array(pairs, dtype=np.int64).T)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # hashes of pieces seen, sorted
        self.check = np.zeros(0, dtype=np.uint64)
        self.begin = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.store = np.zeros(0, dtype=np.int32)

    # -- merging

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece. A piece that is a token is that token."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        rest: list[int] = []
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = np.array([rank], dtype=np.int32)
            elif len(piece) > LONG_PIECE:
                out[i] = self._merge_long(piece)
            else:
                rest.append(i)
        rest.sort(key=lambda i: len(pieces[i]))
        a = 0
        while a < len(rest):  # a bucket: rows up to an eighth longer than its first, so that little is padding
            most = max(len(pieces[rest[a]]) + 1, len(pieces[rest[a]]) * 9 // 8)
            b = a
            while b < len(rest) and len(pieces[rest[b]]) <= most and (b - a + 1) * most <= _MATRIX_CELLS:
                b += 1
            for i, ids in zip(rest[a:b], self._merge_bucket([pieces[i] for i in rest[a:b]]), strict=True):
                out[i] = ids
            a = b
        return out

    def _merge_bucket(self, pieces: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max())
        ids = np.full((len(pieces), width), -1, dtype=np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.pair_rank(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(pieces))
        out: list[np.ndarray | None] = [None] * len(pieces)
        while True:
            at = rank.argmin(axis=1)  # the first of equal ranks is the leftmost pair
            best = rank[np.arange(len(rank)), at]
            done = best == _NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[rows[i]] = ids[i, : sizes[i]].copy()
                keep = ~done
                if not keep.any():
                    return out
                rows, sizes, at, best = rows[keep], sizes[keep], at[keep], best[keep]
                width = int(sizes.max())
                ids, rank = ids[keep, :width], rank[keep, : width - 1]
            # compaction: what stands right of the merged pair moves one to the left
            every = np.arange(len(rows))
            columns = np.arange(ids.shape[1] - 1)
            ids[every, at] = best
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
            sizes = sizes - 1
            columns = columns[:-1]
            if not len(columns):
                for i in every:
                    out[rows[i]] = ids[i, : sizes[i]].copy()
                return out
            rank = np.take_along_axis(rank, columns + (columns >= at[:, None]), axis=1)
            for side in (at - 1, at):
                ok = (side >= 0) & (side < len(columns))
                r, c = every[ok], side[ok]
                rank[r, c] = self.pair_rank(ids[r, c], ids[r, c + 1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for a very long piece: a heap of (rank, place) over a linked list of parts."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_rank(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        lookup = self._one_rank
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or lookup(ids[i], ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := lookup(ids[a], ids[after[a]])) is not None:
                    heapq.heappush(heap, (r, a))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def _one_rank(self, a: int, b: int) -> int | None:
        i, j = int(self.token_begin[a]), int(self.token_begin[b])
        raw = self.token_bytes
        return self.ranks.get(raw[i : i + int(self.token_size[a])].tobytes() + raw[j : j + int(self.token_size[b])].tobytes())

    # -- texts

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of some texts given as UTF-8 bytes and their bounds. Bytes that are not UTF-8 count as U+FFFD."""
        raw = data.tobytes()
        try:
            text = raw.decode()
            bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds] if len(data) else bounds
        except UnicodeDecodeError:
            parts = [raw[a:b].decode(errors="replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            text, bounds = "".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        start = split_pieces(codes, bounds)
        first = np.searchsorted(start, bounds)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        piece = self._known_pieces(text, codes, start)
        size = self.size[piece]
        ids = _spread(self.store, self.begin[piece], size)
        return ids, np.concatenate([[0], np.cumsum(size)])[first]

    def _known_pieces(self, text: str, codes: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Indices of the pieces in the store; pieces not seen yet are merged and added."""
        end = np.append(start[1:], len(codes))
        h, check = _piece_hashes(codes, start, end)
        if len(self.known) > _CACHED_PIECES:
            self._forget()
        distinct, one = np.unique(h, return_index=True)
        if (check[one][np.searchsorted(distinct, h)] != check).any():  # two pieces of equal hash: tell them apart by the other
            h = mix(h ^ mix(check))
            distinct, one = np.unique(h, return_index=True)
            self._forget()
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
            if (clash := (self.known[at] == distinct) & (self.check[at] != check[one])).any():
                self._forget()
                at, clash = np.zeros(0, np.int64), clash
        new = np.ones(len(distinct), bool) if not len(self.known) else self.known[at] != distinct
        fresh = one[new]
        if len(fresh):
            merged = self.merge([text[a:b].encode() for a, b in zip(start[fresh].tolist(), end[fresh].tolist(), strict=True)])
            size = np.array([len(x) for x in merged], dtype=np.int64)
            known = np.concatenate([self.known, distinct[new]])
            order = np.argsort(known, kind="stable")
            self.begin = np.concatenate([self.begin, len(self.store) + np.cumsum(size) - size])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.check = np.concatenate([self.check, check[fresh]])[order]
            self.known = known[order]
            self.store = np.concatenate([self.store, *merged])
        return np.searchsorted(self.known, h)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds) of some sequences of ids."""
        size = self.token_size[ids]
        return _spread(self.token_bytes, self.token_begin[ids], size), np.concatenate([[0], np.cumsum(size)])[bounds]

    def decimals(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds) of the decimal ids of each sequence, a space before each id."""
        size = self.digit_size[ids]
        return _spread(self.digit_bytes, self.digit_begin[ids], size), np.concatenate([[0], np.cumsum(size)])[bounds]


@lru_cache(1)
def _positions(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    out = []
    for base in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):
        for factor in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, factor, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
    return tuple(out)


def _piece_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each piece."""
    powers = _positions(max(CHUNK_BYTES * 2, 1 << int(len(codes)).bit_length()))
    values, out = _code_values()[codes], []
    for power, inverse in (powers[:2], powers[2:]):
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(values * power[: len(codes)], out=sums[1:])
        out.append(mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)))
    return out[0], out[1]


@lru_cache(2)
def tokenizer(ranks_path: str) -> ByteBpe:
    """One for each Python worker and file."""
    return ByteBpe(ranks_path)


def _encode_batches(ranks_path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks_path)
        for batch in batches:
            for a, b, data, bounds in text_chunks(batch.column(1)):
                ids, at = bpe.encode(data, bounds)
                raw, ends = bpe.decode(ids, at)
                whole, given = raw.tobytes(), data.tobytes()
                exact = [whole[i:j] == given[x:y] for i, j, x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(exact, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "exact"])

    return run


def _decode_batches(ranks_path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks_path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = part.column(1).fill_null([]) if part.column(1).null_count else part.column(1)
                bounds = np.asarray(lists.offsets, dtype=np.int64)
                raw, at = bpe.decode(np.asarray(lists.values)[bounds[0] : bounds[-1]], bounds - bounds[0])
                texts = pa.array([raw[x:y].tobytes().decode(errors="replace") for x, y in zip(at[:-1], at[1:], strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], names=["doc_id", "text"])

    return run


def _digest_batches(ranks_path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks_path)
        for batch in batches:
            for a, b, data, bounds in text_chunks(batch.column(1)):
                ids, at = bpe.encode(data, bounds)
                shas = []
                for raw, ends, skip in ((*bpe.decimals(ids, at), 1), (*bpe.decode(ids, at), 0)):
                    view = memoryview(np.ascontiguousarray(raw))
                    shas.append(pa.array([hashlib.sha256(view[min(x + skip, y) : y]).hexdigest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), *shas], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _pairs(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(value_col).alias("value"))


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, exact) of each row: its whole text's token ids, without special tokens, and whether they decode to it.

    Texts are cut into pieces by the pre-tokeniser's pattern. Distinct pieces are put into padded matrices by length;
    each round every row merges its leftmost pair of least rank. A null or empty text has no ids; null ids and repeated
    rows are kept; an empty table gives no rows; other columns are ignored. Rows need no others: nothing is shuffled.
    """
    return _pairs(docs, id_col, text_col).mapInArrow(_encode_batches(ranks_path), "doc_id long, ids array<int>, exact boolean")


def decode(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of each row of ids; null ids give the empty text, bytes that are not UTF-8 become U+FFFD."""
    return _pairs(tokens, id_col, ids_col).mapInArrow(_decode_batches(ranks_path), "doc_id long, text string")


def round_trip_digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's decimal ids and of their decoded bytes.

    The ids never leave the task. Rows as in encode(); a null or empty text has digests of nothing.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _pairs(docs, id_col, text_col).mapInArrow(_digest_batches(ranks_path), schema)

"""Vectors as four codebook indexes, nearest entries found by pivots (operator 12)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from passagework.llm.scratch import Scratch

PARTS, ENTRIES, ROUNDS, PIVOTS = 4, 256, 4, 12
#: Vectors that are worked on at once, and components up to which squares and their sums fit in 64 bits.
BLOCK, NARROW = 2048, 1 << 25


def whole_components(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x): int64, or Python's integers where one is large."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * 1024.0)
    if not scaled.size or np.abs(scaled).max() <= NARROW:
        return scaled.astype(np.int64)
    of = lambda v: math.floor(v * 1024) if abs(v) < 2.0**52 else int(v) * 1024
    return np.array([of(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def _same_kind(*arrays: np.ndarray) -> list[np.ndarray]:
    return list(arrays) if all(a.dtype != object for a in arrays) else [a.astype(object) for a in arrays]


def _squared(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    one, two = _same_kind(one, two)
    difference = one - two
    return (difference * difference).sum(axis=-1)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(points x pivots) distances as doubles, for bounds only; of components that doubles can't square, infinite or not a number."""
    p, q = (a if a.dtype != object else np.vectorize(lambda v: float(v) if abs(v) < 2**1000 else np.inf, otypes=[float])(a) for a in (points, pivots))
    with np.errstate(over="ignore", invalid="ignore"):
        return np.stack([np.sqrt(((p.astype(np.float64) - c) ** 2).sum(axis=1)) for c in q.astype(np.float64)], axis=1)


def far_pivots(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Some of the entries as pivots: each the one whose sum of distances to those before is greatest."""
    chosen, total = [0], np.zeros(len(entries))
    while len(chosen) < min(count, len(entries)):
        total = total + np.nan_to_num(_distances(entries, entries[chosen[-1:]])[:, 0], nan=0.0, posinf=1e300)
        total[chosen] = -1
        chosen.append(int(total.argmax()))
    return entries[chosen]


def nearest_entries(points: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance, evaluations): each point's nearest entry, ties to the lower index.

    The difference of a point's and an entry's distances to a pivot is no more than their own distance. A point tries
    entries by their greatest such bound, least first, exactly, and stops where the bound passes its best distance.
    """
    if entries.dtype == object or points.dtype == object:
        return _by_integers(points, entries)
    n = len(points)
    of_entries = _distances(entries, pivots)
    bound = np.zeros((n, len(entries)))
    with np.errstate(invalid="ignore"):
        for j in range(of_entries.shape[1]):
            np.maximum(bound, np.abs(to_pivots[:, j, None] - of_entries[None, :, j]), out=bound)
    slack = 1e-5 * (1 + to_pivots.max(axis=1, initial=0) + of_entries.max(initial=0))  # of distances kept in single precision
    with np.errstate(invalid="ignore"):
        bound -= slack[:, None]
    bound[np.isnan(bound)] = -np.inf
    order = np.argsort(bound, axis=1, kind="stable")
    best, index = np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)
    rows, evaluated = np.arange(n), 0
    for turn in range(len(entries)):
        entry = order[rows, turn]
        low = bound[rows, entry]
        open_ = (low <= 0) | (low * low <= best[rows])
        rows, entry = rows[open_], entry[open_]
        if not len(rows):
            break
        evaluated += len(rows)
        d = _squared(points[rows], entries[entry])
        better = (d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = d[better], entry[better]
    return index, best, evaluated


def _by_integers(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same for components beyond 64 bits, whose distances doubles don't bound: every entry is evaluated."""
    index, best = np.zeros(len(points), dtype=np.int64), np.zeros(len(points), dtype=object)
    for i, point in enumerate(points.astype(object)):
        d = _squared(point[None], entries)
        index[i] = int(d.argmin())
        best[i] = d[index[i]]
    return index, best, len(points) * len(entries)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), width)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            yield batch.slice(i, BLOCK)


def _pivot_batches(pivots: list[np.ndarray], size: int) -> Callable:
    """Adds each part's distances to its pivots, in single precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            points = whole_components(_matrix(block.column(2), PARTS * size))
            with np.errstate(over="ignore"):
                near = np.concatenate([_distances(points[:, p * size : (p + 1) * size], pivots[p]) for p in range(PARTS)], axis=1).astype(np.float32)
            at = pa.array(np.arange(block.num_rows + 1, dtype=np.int32) * near.shape[1])
            yield pa.RecordBatch.from_arrays([*block.columns, pa.ListArray.from_arrays(at, pa.array(near.ravel()))], names=["vec_id", "label", "vector", "to_pivots"])

    return run


def _assigned(block: pa.RecordBatch, books: list[np.ndarray], pivots: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(points, index, squared distance) of each part position; columns vector, to_pivots are the block's last."""
    points, count = whole_components(_matrix(block.column(block.num_columns - 2), PARTS * size)), len(pivots[0])
    near = _matrix(block.column(block.num_columns - 1), PARTS * count)
    for p in range(PARTS):
        own = points[:, p * size : (p + 1) * size]
        index, best, _ = nearest_entries(own, near[:, p * count : (p + 1) * count], books[p], pivots[p])
        yield own, index, best


def _sum_batches(books: list[np.ndarray], pivots: list[np.ndarray], size: int) -> Callable:
    """(part, entry, n, sums) of a task's parts. Sums are decimal texts, as they may be of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), size), dtype=object) for b in books]
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        for block in _blocks(batches):
            for p, (own, index, _) in enumerate(_assigned(block, books, pivots, size)):
                order = np.argsort(index, kind="stable")
                used, first = np.unique(index[order], return_index=True)
                sums[p][used] += np.add.reduceat(own[order], first, axis=0).astype(object)
                counts[p][used] += np.diff(np.append(first, len(index)))
        rows = [(p, e, int(counts[p][e]), [str(int(v)) for v in sums[p][e]]) for p in range(PARTS) for e in np.flatnonzero(counts[p]).tolist()]
        part, entry, n, texts = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n, pa.int64()), pa.array(texts, pa.list_(pa.string()))], names=["part", "entry", "n", "sums"])

    return run


def _added(rows: pa.Table) -> pa.Table:
    total = [str(sum(map(int, column))) for column in zip(*rows.column("sums").to_pylist(), strict=True)]
    n = sum(rows.column("n").to_pylist())
    return pa.table({"part": rows.column("part").slice(0, 1), "entry": rows.column("entry").slice(0, 1), "n": pa.array([n], pa.int64()), "sums": pa.array([total], pa.list_(pa.string()))})


def _updated(books: list[np.ndarray], rows: list) -> list[np.ndarray]:
    """Each entry that has parts becomes their componentwise floor(sum / count)."""
    out = [b.astype(object) for b in books]
    for row in rows:
        out[row["part"]][row["entry"]] = [int(v) // row["n"] for v in row["sums"]]
    return [b.astype(np.int64) if max((abs(v) for v in b.ravel()), default=0) <= NARROW else b for b in out]


def _code_batches(books: list[np.ndarray], pivots: list[np.ndarray], size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(ENTRIES)], dtype=object)
        for block in _blocks(batches):
            code, error = np.full(block.num_rows, "", dtype=object), np.zeros(block.num_rows, dtype=object)
            for _, index, best in _assigned(block, books, pivots, size):
                code, error = code + digits[index], error + best
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(code, pa.string()), pa.array([str(int(e)) for e in error])], names=["vec_id", "label", "code", "error_text"])

    return run


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row for each row whose vector is sound.

    Left out: vectors that are null or hold null or non-finite components. Components are the integers floor(1024 * x),
    vectors are cut into four parts, and each part position has a codebook of 256 entries: at first the parts of the 256
    smallest ids (fewer if there are fewer rows; ties by the vector; null ids come last). Four rounds assign all parts to
    their nearest entries (ties: the lower index) and replace entries by the floored means of their parts; then parts are
    assigned once more. code: the indexes, two hex digits each; error: the squared distances' sum; label_error: its sum
    over equal labels, nulls together. All in integers of any size; sums beyond 64 bits are null.

    A part's distances to fixed pivots of its position are computed once and written beside it. Each round takes the
    pivots' distances to the entries, and their differences bound the distances of parts and entries from below, so that
    most entries are never evaluated. Tasks return sums for each entry, and the driver holds the codebooks, whose size is fixed.

    Vectors of another length than the first id's, or of a length that four parts can't share equally, have null code and
    error. Repeated rows count as rows of their own; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession)
    kept = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    label = F.col(label_col) if label_col in vectors.columns else F.lit(None).cast("string")
    sound = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).cast(kept).alias("vector"))
    sound = sound.where("vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    first = sound.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).select("vec_id", "vector").collect()
    width = len(first[0]["vector"]) if first else 0
    fits = width > 0 and width % PARTS == 0
    size = width // PARTS
    schema = f"vec_id long, label {sound.schema['label'].dataType.simpleString()}"
    if fits:
        start = whole_components(np.array([r["vector"] for r in first if len(r["vector"]) == width], dtype=np.float64))
        books = [start[:, p * size : (p + 1) * size] for p in range(PARTS)]
        pivots = [far_pivots(b) for b in books]
        table = scratch.save(sound.where(f"size(vector) = {width}").mapInArrow(_pivot_batches(pivots, size), f"{schema}, vector {kept}, to_pivots array<float>"), "parts")
        for _ in range(ROUNDS):
            sums = table.select("vector", "to_pivots").mapInArrow(_sum_batches(books, pivots, size), "part int, entry int, n long, sums array<string>")
            books = _updated(books, sums.groupBy("part", "entry").applyInArrow(_added, "part int, entry int, n long, sums array<string>").collect())
        coded = table.mapInArrow(_code_batches(books, pivots, size), f"{schema}, code string, error_text string")
    other = sound.where(f"size(vector) <> {width}" if fits else "true").select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("error_text"))
    coded = scratch.save(coded.unionByName(other) if fits else other, "codes")
    digest = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest() if fits else None
    errors = scratch.save(coded.groupBy("label").agg(F.sum(F.expr("try_cast(error_text as decimal(38,0))")).alias("total")), "errors")
    joined = coded.join(errors.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", F.expr("try_cast(error_text as long)").alias("error"), F.expr("try_cast(total as long)").alias("label_error"), F.lit(digest).cast("string").alias("codebooks_sha256"))

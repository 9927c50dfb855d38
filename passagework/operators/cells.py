"""Vectors in cells around pivots: exact nearest neighbours from the cells that distance bounds don't rule out."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from passagework.operators.search import in_parts, ranked

#: Vectors that pivots are chosen from, pivots, and rows that are compared at once.
SAMPLE, PIVOTS, STEP = 4096, 64, 2048
#: Pairs of a query and a row that a task compares at once.
PAIRS = 1 << 16


def chosen_pivots(rows: DataFrame) -> DataFrame:
    """(cell, pivot): of SAMPLE vectors with the least hashes, PIVOTS that lie far apart. The sample bounds the driver's work and nothing else."""
    held = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("vector").collect()
    sample = np.array([r["vector"] for r in held], dtype=np.float64).reshape(len(held), -1)
    chosen: list[int] = []
    nearest = np.full(len(sample), np.inf)
    while len(chosen) < min(PIVOTS, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()) if chosen else 0)
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return rows.sparkSession.createDataFrame([(i, [float(v) for v in sample[c]]) for i, c in enumerate(chosen)], "cell int, pivot array<double>")


def _pivots(table: DataFrame) -> np.ndarray:
    rows = table.orderBy("cell").collect()  # PIVOTS at most
    return np.array([r["pivot"] for r in rows], dtype=np.float64).reshape(len(rows), -1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances; differences are squared themselves, so that small ones stay exact."""
    return np.stack([np.sqrt(((x - row) ** 2).sum(axis=1)) for row in y], axis=1) if len(y) else np.zeros((len(x), 0))


def assigned_cells(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """``rows`` with the cell of their nearest pivot and their distance to it."""
    centres = _pivots(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, STEP):
                batch = whole.slice(i, STEP)
                far = _distances(_matrix(batch.column(batch.schema.get_field_index("vector"))), centres)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], names=[*batch.schema.names, "cell", "to_pivot"])

    fields = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, cell int, to_pivot double")


def _near_batches(ids: np.ndarray, vectors: np.ndarray, to_pivots: np.ndarray, wanted: dict[int, np.ndarray], reach: np.ndarray, k: int) -> Callable:
    """(query_id, chunk_id, segment, row, score): a task's k nearest rows of each query, among the cells it wants and the rows whose distance to the pivot lets them be within its reach."""

    names, norms = ["query", "chunk_id", "segment", "row", "score"], (vectors**2).sum(axis=1)

    def beyond(d: np.ndarray) -> np.ndarray:
        """A squared distance whose score is less than that of ``d`` to 9 places."""
        return 1 / np.maximum(1 / (1 + d) - 2e-9, 1e-12) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((0, 4), np.int64)]
        scores = [np.zeros(0)]
        most, n = np.full(len(ids), np.inf), 0

        def best() -> None:
            rows, score = np.concatenate(held), np.concatenate(scores)
            order = np.lexsort((rows[:, 1], -np.round(score, 9), rows[:, 0]))
            rows, score = rows[order], score[order]
            begin = np.searchsorted(rows[:, 0], rows[:, 0])
            first = np.arange(len(rows)) - begin < k
            held[:], scores[:] = [rows[first]], [score[first]]

        for whole in batches:
            for i in range(0, whole.num_rows, STEP):
                batch = whole.slice(i, STEP)
                cells, far = batch.column(3).to_numpy(), batch.column(4).to_numpy()
                x, keys = _matrix(batch.column(5)), np.stack([batch.column(j).to_numpy() for j in range(3)], axis=1)
                sizes = (x**2).sum(axis=1)
                for cell in np.unique(cells):
                    at, asking = np.flatnonzero(cells == cell), wanted.get(int(cell), np.zeros(0, np.int64))
                    step = max(1, PAIRS // len(at))
                    for some in (asking[j : j + step] for j in range(0, len(asking), step)):
                        open_ = np.abs(far[at] - to_pivots[some, cell][:, None]) <= reach[some][:, None]
                        # one product bounds the squared distances from both sides; only rows that may be among the k best are measured themselves
                        total = norms[some][:, None] + sizes[at]
                        near = total - 2 * vectors[some] @ x[at].T
                        if len(at) >= k:
                            upper = np.partition(np.where(open_, near + 1e-9 * total, np.inf), k - 1, axis=1)[:, k - 1]
                            most[some] = np.fmin(most[some], np.where(np.isfinite(upper), beyond(np.maximum(upper, 0)), np.inf))
                        query, place = np.nonzero(open_ & ~(near - 1e-9 * total > most[some][:, None]))
                        query, place = some[query], at[place]
                        held.append(np.concatenate([query[:, None], keys[place]], axis=1))
                        scores.append(1 / (1 + ((x[place] - vectors[query]) ** 2).sum(axis=1)))
                        n += len(query)
                        if n > 200_000 + 2 * k * len(ids) or len(held) > 4096:
                            best()
                            n = len(scores[0])
        best()
        rows, score = held[0], scores[0]
        columns = [pa.array(ids[rows[:, 0]]), *(pa.array(np.ascontiguousarray(rows[:, j])) for j in (1, 2, 3)), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", *names[1:]])

    return run


def _wanted(cells: list, distances: np.ndarray, reach: np.ndarray) -> dict[int, np.ndarray]:
    """For each cell the queries that may have a row in it within their reach."""
    out = {}
    for cell, low, high in cells:
        bound = np.maximum(np.maximum(low - distances[:, cell], distances[:, cell] - high), 0)
        at = np.flatnonzero(bound <= reach)
        if len(at):
            out[cell] = at
    return out


def dense_topk_cells(index, queries: DataFrame, k: int = 10, kinds: list[str] | None = None, report: list | None = None) -> DataFrame:
    """dense_topk() from the saved vectors of a CorpusIndex: (query_id, chunk_id, score, rank).

    A first pass reads the cells of the nearest pivots that hold k rows and more; the k-th distance there is a query's
    reach. A second pass reads the cells that may hold a row within it, by the triangle inequality on the distances to the
    cell's pivot, and of these the rows that may. Cells are partitions of the table, so that the others aren't read.
    ``kinds`` restricts the candidates before the cut. ``report`` receives, for each pass, {cell: number of queries}.

    Null vectors are left out; ties (to 9 places): the smaller chunk_id. About MOST_QUERIES queries are searched at once.
    """
    schema = "query_id long, chunk_id long, segment long, row long, score double"
    vectors = index.live("vectors") if index.table("vectors") is not None else None

    def search(part: DataFrame) -> DataFrame:
        rows = part.collect()
        if not rows or vectors is None:
            return part.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
        ids, matrix = np.array([r["query_id"] for r in rows], dtype=np.int64), np.array([r["vector"] for r in rows], dtype=np.float64)
        distances = _distances(matrix, _pivots(part.sparkSession.read.parquet(index.pivots)))
        known = index.table("cells")
        known = known.where(F.col("node_type").isin(kinds)) if kinds else known
        table = vectors.where(F.col("node_type").isin(kinds)) if kinds else vectors
        sums = defaultdict(lambda: [0, np.inf, 0.0])
        for r in known.groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
            sums[r["cell"]] = [r["n"], r["low"], r["high"]]
        cells = [(cell, low, high) for cell, (_, low, high) in sums.items()]

        def found(wanted: dict[int, np.ndarray], reach: np.ndarray) -> DataFrame:
            if report is not None:
                report.append({cell: len(q) for cell, q in wanted.items()})
            read = table.where(F.col("cell").isin(list(wanted))).select("chunk_id", F.col("segment").cast("long"), "row", "cell", "to_pivot", "vector")
            return read.mapInArrow(_near_batches(ids, matrix, distances, wanted, reach, k), schema)

        first = defaultdict(list)
        for q in range(len(ids)):
            n = 0
            for cell in np.argsort(distances[q], kind="stable").tolist():
                if sums[cell][0]:
                    first[cell].append(q)
                    n += sums[cell][0]
                if n >= 2 * k:
                    break
        near = found({c: np.array(q) for c, q in first.items()}, np.full(len(ids), np.inf))
        kth = ranked(near, k, F.desc(F.round("score", 9)), F.asc("chunk_id")).where(f"rank = {k}").select("query_id", "score").collect()
        place, reach = {q: i for i, q in enumerate(ids.tolist())}, np.full(len(ids), np.inf)
        for r in kth:
            reach[place[r["query_id"]]] = np.sqrt(max(1 / max(r["score"] - 2e-9, 1e-12) - 1, 0)) + 1e-9  # what rounds to the k-th score counts
        reach *= 1 + 1e-9
        again = found(_wanted(cells, distances, reach), reach)
        return ranked(again, k, F.desc(F.round("score", 9)), F.asc("chunk_id")).select("query_id", "chunk_id", "score", "rank")

    return in_parts(queries.where("vector is not null").select("query_id", "vector"), ["query_id"], search)

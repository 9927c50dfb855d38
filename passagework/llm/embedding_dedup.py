"""Near-duplicate vectors by lattice hashing: random projections decoded to E8, neighbouring cells probed (operator 8)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from passagework.llm.graph import components
from passagework.llm.scratch import Scratch
from passagework.llm.words import mix


@lru_cache(1)
def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, from a lattice point to its nearest ones."""
    pairs = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in combinations(range(8), 2) for a, b in product((1, -1), repeat=2)]
    halves = [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(pairs + halves)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """The nearest integer points of even sum: where the rounded sum is odd, the worst coordinate is rounded the other way."""
    point = np.rint(y)
    odd = point.sum(axis=1) % 2 != 0
    error = y - point
    worst = np.abs(error).argmax(axis=1)
    rows = np.flatnonzero(odd)
    point[rows, worst[rows]] += np.where(error[rows, worst[rows]] >= 0, 1, -1)
    return point


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 moved by a half in each coordinate."""
    whole, half = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    closer = ((y - half) ** 2).sum(axis=1) < ((y - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def _cell_keys(table: int, points: np.ndarray) -> np.ndarray:
    key = np.full(len(points), np.uint64(table + 1))
    for column in (2 * points).astype(np.int64).T:
        key = mix(key * np.uint64(0xFF51AFD7ED558CCD) + column.view(np.uint64))
    return key.view(np.int64)


def lattice_keys(x: np.ndarray, tables: int, probes: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(own, probed): each unit vector's cell in each table, and the cells next to it, nearest first, own ones not included.

    A cell is a pair of E8 points of two projections onto 8 coordinates. A probe moves one of them to a neighbour.
    """
    own, probed = [], []
    for table in range(tables):
        plane = np.random.default_rng([table, x.shape[1]]).standard_normal((x.shape[1], 16)) * scale
        y = x @ plane
        parts = [nearest_e8(y[:, :8]), nearest_e8(y[:, 8:])]
        own.append(_cell_keys(table, np.concatenate(parts, axis=1)))
        for side in (0, 1):
            toward = (y[:, 8 * side : 8 * side + 8] - parts[side]) @ _neighbours().T
            best = np.argsort(-toward, axis=1)[:, :probes]
            for k in range(probes):
                moved = list(parts)
                moved[side] = parts[side] + _neighbours()[best[:, k]]
                probed.append(_cell_keys(table, np.concatenate(moved, axis=1)))
    return np.stack(own, axis=1), np.stack(probed, axis=1) if probed else np.zeros((len(x), 0), np.int64)


def _rows(lists: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    n = len(lists)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that their largest components are about 1: squares neither vanish nor overflow, and directions stay."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def _by_length(lists: pa.Array) -> Iterator[np.ndarray]:
    sizes = np.diff(np.asarray(lists.offsets))
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def _key_batches(tables: int, probes: int, scale: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                for rows in _by_length(batch.column(1)):
                    part = batch.take(pa.array(rows))
                    x = _scaled(_rows(part.column(1)))
                    own, probed = lattice_keys(x / np.linalg.norm(x, axis=1, keepdims=True), tables, probes, scale)
                    columns = [pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * k.shape[1]), pa.array(k.ravel())) for k in (own, probed)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["rep", "own", "probed"])

    return run


def _cosine_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 4096):
            batch = whole.slice(i, 4096)
            for rows in _by_length(batch.column(2)):
                part = batch.take(pa.array(rows))
                x, y = _scaled(_rows(part.column(2))), _scaled(_rows(part.column(3)))
                cosine = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cosine)], names=["a", "b", "cosine"])


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, tables: int = 12, probes: int = 4, scale: float = 0.8
) -> DataFrame:
    """(vec_id, n_links, component_id, kept, class_id), one row for each row of ``vectors``.

    Rows of one label and length are linked if their cosine in double precision reaches ``cosine``. Equal vectors are
    one class (class_id: its smallest id), compared once and counted as many times as it has rows. Classes that lie in
    one cell, or in a cell next to the other's, in any of ``tables`` tables are compared in full.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows of a null label, link with
    nothing. Very small and very large components count by their ratios. A null id: the same, with component_id and class_id null and kept true. Repeated rows count as rows of
    their own. An empty table gives no rows; other columns are ignored.

    n_links needs every linked pair of classes: a dense group of unequal vectors costs its number of links, no more.
    """
    scratch = Scratch(vectors.sparkSession)
    kept = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"  # as narrow as given; compared in double
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kept).alias("vector"), F.col(label_col).alias("label"))
    sound = F.expr("""id is not null and label is not null and vector is not null and size(vector) > 0
        and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)""")
    same = ["label", "print_a", "print_b"]
    named = named.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("print_a", F.xxhash64(F.lit(1), "vector")).withColumn("print_b", F.xxhash64(F.lit(2), "vector"))
    classes = scratch.save(named.where("sound").groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "classes")
    keys = scratch.save(classes.select("rep", "vector").mapInArrow(_key_batches(tables, probes, scale), "rep long, own array<long>, probed array<long>").join(classes.select("rep", "label"), "rep"), "keys")
    resident = keys.select("label", F.col("rep").alias("b"), F.explode("own").alias("key"))
    prober = keys.select("label", F.col("rep").alias("a"), F.explode(F.concat("own", "probed")).alias("key"))
    met = prober.join(resident, ["label", "key"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sides = met.join(classes.select(F.col("rep").alias("a"), F.col("vector").alias("x")), "a")
    sides = sides.join(classes.select(F.col("rep").alias("b"), F.col("vector").alias("y")), "b").where("size(x) = size(y)").select("a", "b", "x", "y")
    links = scratch.save(sides.mapInArrow(_cosine_batches, "a long, b long, cosine double").where((F.col("cosine") >= cosine) & ~F.isnan("cosine")).select("a", "b"), "links")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(classes.select(F.col("rep").alias("b"), "copies"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
    component = components(links, scratch).withColumnRenamed("node", "rep")
    known = classes.drop("vector").join(degree, "rep", "left").join(component, "rep", "left")
    known = known.select(*same, F.col("rep").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"), F.lit(True).alias("sound"))
    out = named.drop("vector").join(known, [*same, "sound"], "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.coalesce("class_id", "id").alias("class_id"))
    return out.select("vec_id", "n_links", "component_id", F.expr("coalesce(vec_id = component_id, true)").alias("kept"), "class_id")

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from passagework.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int, code int, TO_PIVOTS string"


def brute(rows):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = lambda x: math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    width = len(first[0][1])
    size = width // 4
    points = [[[whole(x) for x in v[p * size : (p + 1) * size]] for p in range(4)] if len(v) == width else None for _, v, _ in kept]
    books = [[[whole(x) for x in v[p * size : (p + 1) * size]] for _, v, _ in first if len(v) == width] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda a, book: min((far(a, e), i) for i, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            groups = defaultdict(list)
            for point in filter(None, points):
                groups[nearest(point[p], books[p])[1]].append(point[p])
            for i, members in groups.items():
                books[p][i] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], defaultdict(lambda: None)
    for (i, _, label), point in zip(kept, points, strict=True):
        found = [nearest(point[p], books[p]) for p in range(4)] if point else []
        error = sum(d for d, _ in found) if point else None
        if error is not None:
            sums[label] = (sums[label] or 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in found) if point else None, error, label))
    fit = lambda x: x if x is None or x < 2**63 else None
    return sorted(((i, code, fit(e), fit(sums[label]), digest) for i, code, e, label in out), key=repr)


def check(spark, rows):
    frame = spark.createDataFrame([(i, v, label, 1, "") for i, v, label in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, V.vector_codes(frame).collect()), key=repr)
    assert got == brute(rows)
    return got


def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)], int(i) % 3) for i in rng.permutation(500)]
    rows += [(600, None, 1), (601, [None] * 8, 1), (602, [math.nan] + [0.0] * 7, 1), (603, [math.inf] * 8, None), (604, [0.0] * 8, None), (605, rows[5][1], None), (606, [1.0] * 4, 2), (607, [], 2), (608, [0.5] * 7, None)]
    return rows + [(3, rows[9][1], 0), (3, rows[9][1], 0), (None, rows[1][1], 1), (None, rows[2][1], None), (-4, [1e-300] * 8, 1), (-4, [-1e-300] * 8, 1)]


def test_brute_force(spark):
    assert len(check(spark, odd_rows())) == 511


def test_ties_go_to_the_lower_index(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).integers(0, 3, size=8)], 0) for i in range(400)]
    check(spark, rows)


def test_few_rows_and_large_components(spark):
    check(spark, [(i, [float(i), -2.5e4 * i, 1e10 * i, 1.0], 0) for i in range(20)])
    check(spark, [(i, [1e200 * i, 3e307, -1e30, 0.001 * i], i % 2) for i in range(9)] + [(30, [0.1, 0.2, 0.3, 0.4], None)])


def test_lengths_that_four_parts_cannot_share(spark):
    frame = spark.createDataFrame([(1, [1.0] * 6, 1), (2, [1.0] * 8, 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, V.vector_codes(frame).collect())) == [(1, None, None, None, None), (2, None, None, None, None)]
    assert V.vector_codes(frame.limit(0)).count() == 0


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(8)
    centres = rng.integers(-4000, 4000, size=(256, 16))
    points = centres[rng.integers(0, 256, size=3000)] + rng.integers(-300, 300, size=(3000, 16))
    pivots = V.far_pivots(centres)
    near = V._distances(points, pivots).astype(np.float32).astype(np.float64)
    index, best, evaluated = V.nearest_entries(points, near, centres, pivots)
    full = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (index == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert evaluated < 0.25 * full.size


@pytest.mark.parametrize("value", [0.0, -0.25, 1 / 3, -1e-9, 123.456, 2.0**52, 1e300])
def test_floor_of_components(value):
    from fractions import Fraction

    assert int(V.whole_components(np.array([[value]]))[0, 0]) == math.floor(Fraction(value) * 1024)

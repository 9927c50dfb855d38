import numpy as np

from passagework.llm.embedding_dedup import nearest_e8, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    ok = {}
    for i, (vec_id, v, label) in enumerate(rows):
        sound = vec_id is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok[i] = np.array(v, dtype=np.float32).astype(float) if sound else None
    n, near = len(rows), {i: set() for i in range(len(rows))}
    for i in range(n):
        for j in range(i):
            x, y = ok[i], ok[j]
            if x is not None and y is not None and rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                near[i].add(j)
                near[j].add(i)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least_id = min((rows[j][0] for j in seen), key=lambda x: (x is None, x))
        out.append((vec_id, len(near[i]), least_id, vec_id is None or vec_id == least_id))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_clusters(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(25):
        centre = rng.standard_normal(64)
        for _ in range(rng.integers(1, 14)):
            v = centre + rng.standard_normal(64) * rng.choice([0.0, 0.05, 0.12, 0.2])
            rows.append((len(rows) + 3, [float(x) for x in v * rng.choice([1.0, 3.0])], int(c % 3)))
    assert result(near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [inf, 0.0], 1), (8, [nan, 1.0], 1), (9, [None, 1.0], 1),
        (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [-1.0, -0.0], 1), (13, [1.0, -0.0], 1), (1, [1.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as rep", "'x' as vector")
    assert result(near_vectors(df)) == brute(rows)
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nearest_lattice_point():
    rng = np.random.default_rng(1)
    y = rng.standard_normal((500, 8)) * 2
    point = nearest_e8(y)
    halves = np.rint(2 * point)
    assert np.allclose(2 * point, halves) and ((halves % 2).sum(axis=1) % 8 == 0).all() and (point.sum(axis=1) % 2 == 0).all()
    other = nearest_e8(y + rng.standard_normal((500, 8)))
    assert (((y - point) ** 2).sum(axis=1) <= ((y - other) ** 2).sum(axis=1) + 1e-9).all()
    assert ((y - point) ** 2).sum(axis=1).max() <= 1 + 1e-9


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold are found too."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1000):
        x = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        z = rng.standard_normal(64)
        z -= (z @ x) * x
        y = 0.9802 * x + np.sqrt(1 - 0.9802**2) * z / np.linalg.norm(z)
        rows += [(2 * i, [float(v) for v in x], 0), (2 * i + 1, [float(v) for v in y], 0)]
    found = near_vectors(spark.createDataFrame(rows, SCHEMA)).where("n_links > 0").count()
    assert found >= 0.999 * len(rows)


def test_very_small_and_large_components(spark):
    """Squares that vanish or overflow link nothing that their directions don't."""
    rows = [(1, [1e-200, 0.0]), (2, [0.0, 1e-200]), (3, [1e-200, 1e-203]), (4, [1e200, 0.0]), (5, [0.0, 1e200]), (6, [1e308, 1e308]), (7, [1e-45, 0.0]), (8, [0.0, 5e-324])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 3: (3, 1), 4: (3, 1), 7: (3, 1), 2: (2, 2), 5: (2, 2), 8: (2, 2), 6: (0, 6)}

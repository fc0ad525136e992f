import hashlib
import random

import numpy as np

from cytoquilt.llm import centroids as C


def brute(rows, dims=64, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(("1:" + ("" if r[0] is None else str(r[0]))).encode()).hexdigest(), r[1]))
    c = [v for _, v in start[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, own)), n) for n, own in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for n in range(len(c)):
            own = [v for (_, v), (_, m) in zip(kept, near) if m == n]
            if own:
                c[n] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    by = {n: sum(d for d, m in near if m == n) for n in range(len(c))}
    digests = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return [(i, n, d, by[n], sum(by.values()), digests[n]) for (i, _), (d, n) in zip(kept, near)]


def order(rows):
    return sorted(rows, key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in centres[i % 9]]) for i in range(300)]
    rows += [(301, None), (302, [0.5] * 63), (303, [0.5] * 65), (304, [None] + [0.0] * 63), (305, [float("nan")] * 64), (306, [float("inf")] + [0.0] * 63), (307, [])]
    rows += [(308, [0.0] * 64), (308, [0.0] * 64), (None, [0.25] * 64), (7, rows[7][1])]
    df = spark.createDataFrame([(v, i, "x") for i, v in rows], "vec array<double>, vec_id long, cluster string").repartition(5)
    got = C.cluster(df, "vec_id", "vec")
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert order(map(tuple, got.collect())) == order(brute(rows))


def test_few_ties_and_none(spark):
    rows = [(1, [1.0] * 64), (2, [-1.0] * 64), (3, [0.0] * 64)]
    df = spark.createDataFrame(rows, "cluster long, vec array<float>")
    got = C.cluster(df, "cluster", "vec")
    assert got.columns == ["cluster", "cluster_", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert order(map(tuple, got.collect())) == order(brute(rows))
    assert C.cluster(df.where("false"), "cluster", "vec").collect() == []
    same = [(i, [0.5] * 64) for i in range(40)]
    got = C.cluster(spark.createDataFrame(same, "vec_id long, vec array<float>"), "vec_id", "vec").collect()
    assert {(r["cluster"], r["distance"]) for r in got} == {(0, 0)} and len(got) == 40


def test_large_components_are_exact(spark):
    rows = [(i, [1e9 * ((i * 7 + j) % 5) for j in range(64)]) for i in range(30)]
    got = C.cluster(spark.createDataFrame(rows, "vec_id long, vec array<double>"), "vec_id", "vec", k=4).collect()
    wanted = brute(rows, k=4)
    cut = [(i, n, min(d, C.LONG_MAX), min(a, C.LONG_MAX), min(b, C.LONG_MAX), h) for i, n, d, a, b, h in wanted]
    assert order((r[0], r[1], r[2], r[5]) for r in got) == order((r[0], r[1], r[2], r[5]) for r in cut)
    huge = C.cluster(spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)], "vec_id long, vec array<double>"), "vec_id", "vec", k=2)
    assert huge.count() == 3


def test_search_equals_all_distances():
    rng = np.random.default_rng(2)
    h = C.hadamard(64)
    assert np.array_equal(h @ h.T, 64 * np.eye(64, dtype=np.int64)) and (h[0] == 1).all()
    x, c = rng.integers(-9, 10, (500, 64)), rng.integers(-9, 10, (16, 64))
    c[5] = c[2]
    x[:16] = c
    best, d = C.nearest(x, c, h)
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert np.array_equal(best, full.argmin(axis=1)) and np.array_equal(d, full.min(axis=1))

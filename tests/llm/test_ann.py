import numpy as np
from pyspark.sql import functions as F

from cytoquilt.llm import ann


def brute(vectors, query, k=10):
    q = np.array(dict(vectors)[query])
    far = sorted((float(np.sqrt(((np.array(v) - q) ** 2).sum())), i) for i, v in vectors if i != query)
    return [(i, d) for d, i in far[:k]]


def run(df, **options):
    got = {}
    for r in ann.nearest(df, "vec_id", "embedding", df.where(F.col("vec_id") % 100 == 0), **options).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(rows)] for q, rows in got.items()}


def test_recall_and_exact_scores(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(20, 24))
    vectors = [(i, (centres[i % 20] + rnd.normal(size=24)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    vectors = [(r[0], list(r[1])) for r in df.collect()]
    hits = 0
    got = run(df, shard_rows=700, query_rows=9)
    assert sorted(got) == list(range(0, 3000, 100))
    for q, rows in got.items():
        wanted = brute(vectors, q)
        hits += len({i for i, _ in rows} & {i for i, _ in wanted})
        assert len(rows) == 10 and [s for _, s in rows] == sorted(s for _, s in rows)
        far = dict(brute(vectors, q, len(vectors)))
        assert all(abs(far[i] - s) < 1e-9 for i, s in rows)
    assert hits / (10 * len(got)) >= 0.95


def test_graph_reads_back_from_flat_arrays():
    x = np.random.default_rng(2).normal(size=(500, 8))
    graph = ann.SmallWorld(x)
    again = ann.SmallWorld.opened(**graph.stored(), dim=8)
    assert all(graph.search(q, 20) == again.search(q, 20) for q in x[:40])
    assert max(a.max() for a in graph.links) < 500 and graph.links[0].shape == (500, 32)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0]
    rows = [(100, same), (0, [0.0, 1.0])] + [(i, same) for i in range(1, 40)] + [(200, None), (201, []), (202, [0.0, 0.0]), (203, [nan, 1.0]),
            (204, [1.0, inf]), (205, [None, 1.0]), (300, [1.0, 2.0, 3.0]), (None, same), (7, same), (400, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = run(df, shard_rows=10)
    assert sorted(got) == [0, 100, 400]
    assert [i for i, _ in got[100]] == list(range(1, 11)) and all(s == 0 for _, s in got[100])
    assert [i for i, _ in got[0]] == list(range(1, 11))
    few = df.where("vec_id in (0, 100, 400)")
    assert {q: len(r) for q, r in run(few).items()} == {0: 2, 100: 2, 400: 2}
    assert run(df.limit(0)) == {} and run(df.where("vec_id = 0")) == {}

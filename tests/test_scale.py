"""Operators that used to gather or to compare all with all, against plain versions and on large sides."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoquilt.operators import clusters, containment, hvg, metadata, ordering, rules, sampling, scoring, validate
from cytoquilt.session import build_session, drop_materialized, materialize_bucketed
from cytoquilt.sinks import writers


def test_contained_pairs_by_brute_force(frame):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    short = [(k, word(rng.randrange(0, 20))) for k in "xy" for _ in range(80)] + [("x", None), ("x", ""), (None, "a")]
    long = [(k, word(rng.randrange(0, 30))) for k in "xy" for _ in range(80)] + [("x", None), ("z", "a")]
    got = containment.contained_pairs(frame(short, "k string, s string"), frame(long, "k string, l string"), ["k"], "s", "l")
    wanted = {(k, s, t) for k, s in short for j, t in long if k is not None and k == j and s and t and s in t}
    assert {tuple(r) for r in got.collect()} == wanted and len(wanted) > 200


def test_bundles_of_a_hundred_thousand_titles(spark):
    titles = spark.range(100_000).select(
        F.lit("G").alias("gse_id"), F.concat(F.lit("GSM"), "id").alias("gsm"), F.concat(F.lit("donor "), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" blood sample")).alias("title"),
        F.concat(F.lit("bundle "), "id").alias("bundle"), "id",
    ).withColumnRenamed("id", "pos")
    values = [("G", "library of donor 004711 blood sample run 2"), ("G", "099999 blood"), ("G", "blood sample"), ("G", "gsm17 x"), ("G", "nothing like it"), ("H", "donor 000001 blood sample")]
    got = {(r.gse_id, r.value): r.bundle for r in rules.resolve_bundles(spark.createDataFrame(values, "gse_id string, value string"), titles).collect()}
    assert got == {
        values[0]: "bundle 4711", values[1]: "bundle 99999", values[2]: "bundle 0", values[3]: "bundle 17", values[4]: "", values[5]: "",
    }


def lowest(rows, n, seed):
    order = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}|{seed}".encode()).hexdigest(), r[0]))
    return order[:n]


def test_draws_in_steps_and_with_repeated_ids(frame):
    rows = [(i, "g" if i % 3 else "h", i) for i in range(400)] + [(7, "h", 1000 + k) for k in range(30)]
    df = frame(rows, "id int, grp string, n int")
    got = sampling.nested_sample(df.where("n < 1000"), [(120, 1), (40, 2)], ["id"]).collect()
    wanted = lowest(lowest(rows[:400], 120, 1), 40, 2)
    assert sorted(r.id for r in got) == sorted(r[0] for r in wanted)
    many = ordering.draw_lowest(df, ["id"], [(["grp"], 5, lambda s: s.withColumn("_want", F.lit(60)))]).collect()
    for g in "gh":
        assert sorted(r.id for r in many if r.grp == g) == sorted(r[0] for r in lowest([r for r in rows if r[1] == g], 60, 5))
    assert len({r.n for r in many}) == 120
    assert sampling.fixed_sample(df, 10_000, ["id"]).count() == len(rows) and sampling.fixed_sample(df, 0, ["id"]).count() == 0
    assert sampling.fixed_sample(df.where("false"), 5, ["id"]).count() == 0


def test_a_draw_evaluates_its_input_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        seen.add(1)
        return x

    df = spark.range(1000).select("id", (F.col("id") % 4).alias("c"), counted.asNondeterministic()(F.col("id").cast("int")).alias("x"))
    out = sampling.floor_sample(df, "c", 100, ["id"], floor=20)
    assert out.count() == 100 and seen.value <= 2000


def test_no_exchange_of_stored_count_rows(spark):
    counts = spark.range(5000).selectExpr("id % 300 as cell_id", "id % 70 as gene", "cast(1 + id % 5 as double) as count")
    store = scoring.normalized_store(counts, buckets=4)
    totals = {r.cell_id: r.t for r in counts.groupBy("cell_id").agg(F.sum("count").alias("t")).collect()}
    one = store.where("cell_id = 17").collect()
    plain = counts.where("cell_id = 17").collect()
    assert sorted(round(r.value, 9) for r in one) == sorted(round(float(np.log1p(r["count"] * 1e4 / totals[17])), 9) for r in plain)
    weights = spark.createDataFrame([(g, 0.5) for g in range(9)], "gene long, w_m double")
    scored = scoring.module_scores(spark.range(300).withColumnRenamed("id", "cell_id"), store, F.broadcast(weights), ("m",))
    cells = store.join(F.broadcast(weights), "gene").groupBy("cell_id").agg(F.sum("value"))
    assert "Exchange hashpartitioning" not in cells._jdf.queryExecution().executedPlan().toString() and scored.count() == 300
    drop_materialized(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cytoquilt_bucketed_")]


def test_control_genes_are_drawn_once_a_bin(spark):
    binned = spark.range(20_000).selectExpr("id as gene", "id % 10 as bin")
    modules = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 2), ("b", 12), ("c", 3)], "module string, gene long").distinct()
    out = scoring.control_genes(binned, modules, 20, 1)
    wanted = set()
    for m, bins, own in (("a", (1, 2), {1, 2}), ("b", (2,), {2, 12}), ("c", (3,), {3})):
        for bin_ in bins:
            drawn = sorted(range(bin_, 20_000, 10), key=lambda g: hashlib.md5(f"{g}|1".encode()).hexdigest())[:20]
            wanted |= {(m, g) for g in drawn if g not in own}
    assert sorted((r.module, r.gene) for r in out.collect()) == sorted(wanted)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(bin#" in plan and "windowspecdefinition(module#" not in plan


def test_bucketed_tables_are_equal(spark):
    df = spark.range(50).selectExpr("id % 7 as k", "id as v")
    assert sorted(map(tuple, materialize_bucketed(df, ["k"], 3).collect())) == sorted(map(tuple, df.collect()))


def test_labels_in_blocks_by_brute_force(spark, frame, monkeypatch):
    rng = np.random.default_rng(1)
    centres, cells = rng.normal(size=(23, 5)), rng.normal(size=(200, 5))
    centres[4] = centres[2]
    monkeypatch.setattr(clusters, "LABEL_BLOCK", 4)
    table = frame([(f"l{i:02}", c.tolist()) for i, c in enumerate(centres)], "label string, centroid array<double>")
    got = {r.id: r for r in clusters.nearest_two(frame([(i, c.tolist()) for i, c in enumerate(cells)], "id long, vec array<double>"), "id", "vec", table).collect()}
    for i, c in enumerate(cells):
        d = ((centres - c) ** 2).sum(axis=1)
        assert abs(got[i].first - np.sort(d)[0]) < 1e-9 and abs(got[i].second - np.sort(d)[1]) < 1e-9
        if np.sort(d)[1] - np.sort(d)[0] > 1e-9:
            assert got[i].label == f"l{d.argmin():02}"
    assert not any(r.label == "l04" for r in got.values())


def test_a_hundred_thousand_labels(spark):
    labelled = spark.range(100_000).select("id", F.array((F.col("id") % 400).cast("double"), F.floor(F.col("id") / 400).cast("double")).alias("vec"), F.concat(F.lit("l"), "id").alias("label"))
    rest = spark.range(100_000, 100_040).select("id", F.array(((F.col("id") - 100_000) * 3 + 0.25).cast("double"), ((F.col("id") - 100_000) * 5 + 0.125).cast("double")).alias("vec"), F.lit(None).cast("string").alias("label"))
    out = clusters.transfer_labels(labelled.unionByName(rest).withColumn("confidence", F.lit(1.0))).where("id >= 100000").collect()
    assert len(out) == 40
    for r in out:
        k = r.id - 100_000
        assert r.assigned_label == f"l{k * 3 + k * 5 * 400}" and r.transfer_method == "latent_centroid_transfer"


def test_neighbours_and_communities(frame):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 0.1, (30, 3)) for c in (0, 5, 10)])
    points[3] = points[1]
    got = clusters.nearest_neighbours(frame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>", 7), "id", "v", 6).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.id, r["rank"])):
        by[r.id].append((round(r.distance, 9), r.neighbour))
    for i, p in enumerate(points):
        d = np.sqrt(((points - p) ** 2).sum(axis=1))
        assert by[i] == sorted((round(float(x), 9), j) for j, x in enumerate(d) if j != i)[:6]
    rows = [(r.id, r.neighbour) for r in got]
    label = {r.id: r.community for r in clusters.neighbour_communities(frame(rows, "id long, neighbour long"), "id").collect()}
    assert all(label[i] // 30 == i // 30 for i in range(90)) and all(label[c] == c or label[label[i]] == label[i] for i, c in label.items())


def test_neighbours_cost_nothing_for_copies_and_no_pair_of_groups_is_lost(frame, monkeypatch):
    rng = np.random.default_rng(8)
    points = np.round(rng.normal(size=(150, 4)), 1)
    points = np.concatenate([points, points[:40], np.repeat(points[:1], 60, axis=0)])
    monkeypatch.setattr(clusters, "SIDE_BYTES", 2000)
    measured, inner = [], clusters.materialize
    monkeypatch.setattr(clusters, "materialize", lambda df: measured.append(inner(df)) or measured[-1])
    got = clusters.nearest_neighbours(frame([(1000 - i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>", 5), "id", "v", 7).collect()
    assert measured[1].count() == len(np.unique(points, axis=0))  # the classes that meet
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.id, r["rank"])):
        by[r.id].append((r["rank"], round(r.distance, 9), r.neighbour))
    for i, p in enumerate(points):
        d = np.sqrt(((points - p) ** 2).sum(axis=1))
        want = sorted((round(float(x), 9), 1000 - j) for j, x in enumerate(d) if j != i)[:7]
        assert by[1000 - i] == [(n + 1, *w) for n, w in enumerate(want)]


def test_dispersion_in_bins_by_numpy(frame):
    rng = np.random.default_rng(2)
    mean, var = rng.gamma(1.0, 2.0, 300), rng.gamma(2.0, 3.0, 300)
    mean[:5] = 0
    got = {r.gene: r for r in hvg.normalized_dispersion(frame([(i, float(m), float(v)) for i, (m, v) in enumerate(zip(mean, var))], "gene int, mean double, variance double")).collect()}
    ok = mean > 0
    assert set(got) == set(np.flatnonzero(ok).tolist())
    dispersion = var / np.where(ok, mean, 1)
    edges = np.unique(np.percentile(mean[ok], np.arange(5, 100, 5)))
    bins = np.searchsorted(edges, mean, "left")
    for i in np.flatnonzero(ok):
        own = dispersion[ok & (bins == bins[i])]
        mad = np.median(np.abs(own - np.median(own)))
        assert got[i].bin == bins[i] and abs(got[i].disp_norm - (dispersion[i] - np.median(own)) / (mad * 1.482602218505602)) < 1e-6


def test_fallback_takes_over_without_a_trend(frame):
    counts = frame([(c, g, 1.0 + (c * g) % 3) for c in range(6) for g in range(3)], "cell_id long, gene long, count double")
    obs = frame([(c, "b") for c in range(6)], "cell_id long, batch string")
    var = frame([(g, f"GENE{g}") for g in range(3)], "gene long, name string")
    out = hvg.select_variable_genes(counts, obs, var, "batch", 2, symbol="name").collect()
    assert len(out) == 2 and "disp_norm" in out[0].asDict()
    with pytest.raises(ValueError):
        hvg.select_variable_genes(counts, obs, var, "batch", 4, symbol="name")


def test_one_to_one_faults(frame):
    left = frame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (None, "e")], "k int, s string")
    right = frame([(1, "x"), (2, "y"), (4, "z"), (4, "z"), (None, "n")], "k int, t string")
    got = {r.k: r.fault for r in validate.one_to_one_faults(left, right, ["k"]).collect()}
    assert got == {2: "left duplicate", 4: "right duplicate", 3: "unmatched", None: "unmatched"}
    with pytest.raises(ValueError, match="cells duplicate"):
        metadata.join_one_to_one(left.where("k = 2"), right, ["k"])


def test_one_dataset_is_written_again(spark, tmp_path):
    path = f"file://{tmp_path}/data"
    make = lambda g, n: spark.range(n).withColumn("gse_id", F.lit(g))
    writers.write_by_dataset(make("A", 4).union(make("B", 5)), path)
    writers.write_by_dataset(make("B", 2), path)
    assert {r.gse_id: r["count"] for r in spark.read.parquet(path).groupBy("gse_id").count().collect()} == {"A": 4, "B": 2}
    log = {r.dataset: (r.rows, r.write_id) for r in writers.dataset_commits(spark, path).collect()}
    assert log["A"][0] == 4 and log["B"][0] == 2 and log["A"][1] != log["B"][1]


def test_session_is_reused():
    assert build_session() is build_session()


def test_tasks_of_counts_follow_the_rows(spark, frame, monkeypatch):
    from cytoquilt import session
    from workload import base

    monkeypatch.setattr(session, "ROWS_PER_TASK", 20)
    store = scoring.normalized_store(frame([(c, c % 7, 1.0) for c in range(160)], "cell_id long, gene long, count double"))
    assert len(store.inputFiles()) == 8  # one file a bucket, where the session has 4 partitions
    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    rows = base.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    assert base.counts(spark, "/root/testdata/sf0.001").select(F.spark_partition_id()).distinct().count() == -(-rows // 500)


def test_filter_in_count_space_keeps_its_partitions(frame, monkeypatch):
    from cytoquilt.operators import cleanup

    monkeypatch.setattr(cleanup, "partitions_for", lambda spark, rows: 9)
    rows = [(c, g, 1.0) for c in range(90) for g in range(c % 5 + 1)]
    out = cleanup.count_space_filter(frame(rows, "cell_id long, gene long, count double"), 3, 20, 50.0, mito=F.col("gene") == 2)
    assert out.select(F.spark_partition_id()).distinct().count() == 9
    kept = {(r.cell_id, r.gene) for r in out.collect()}
    assert kept == {(c, g) for c, g, _ in rows if c % 5 >= 2 and g < 4 and 100 / min(c % 5 + 1, 4) < 50.0}


def test_gene_map_of_a_prepared_input_is_sized_before_its_join(spark, monkeypatch):
    from cytoquilt.plans import jobs
    from workload import jobs as queries

    asked, inner = [], jobs.sized_join
    monkeypatch.setattr(jobs, "sized_join", lambda *a, **k: asked.append((a[2], k.get("computed", False))) or inner(*a, **k))
    assert queries.prepared_counts(spark, "/root/testdata/sf0.001").count() > 0
    assert asked == [(["gene"], True)] * 2

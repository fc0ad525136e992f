import itertools
import random

import numpy as np
from pyspark.sql import functions as F
from fixtures import SCHEMA, bag, edge_rows, near_classes

from cytoquilt.llm import near_dedup
from cytoquilt.llm.graph import components


def signature(bags):
    docs = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    shingles = near_dedup.mix(np.array([k for b in bags for k in b], np.uint64))
    counts = np.array([n for b in bags for n in b.values()], np.int64)
    return near_dedup.bag_minhash(docs, shingles, counts, len(bags), 4096)


def test_signatures_estimate_weighted_jaccard():
    rnd = random.Random(2)
    a = {k: rnd.randint(1, 40) for k in range(60)}
    b = {k: max(1, n + rnd.randint(-6, 6)) for k, n in a.items() if k % 5}
    c = {k: 1 for k in a}
    sa, sb, sc = signature([a, b, c])
    for x, y, p, q in ((a, b, sa, sb), (a, c, sa, sc)):
        keys = set(x) | set(y)
        true = sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)
        assert abs((p == q).mean() - true) < 4 * (true * (1 - true) / 4096) ** 0.5
    assert np.isinf(signature([{}, {1: 1}])[0]).all() and np.isfinite(signature([{}, {1: 1}])[1]).all()


def test_similarity_is_the_multisets():
    rnd = random.Random(3)
    for _ in range(60):
        a = " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 30)))
        b = " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 30)))
        x, y = bag(a), bag(b)
        union = sum((x | y).values())
        words = [np.array([ord(w) for w in t.split()], np.int64) for t in (a, b)]
        assert abs(near_dedup.similarity(*words) - (sum((x & y).values()) / union if union else 0)) < 1e-12


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), **dict.fromkeys((200, 201, 202), 200)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def corpus():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 5, 40, 200])))) for i in range(60)]
    base = [rnd.choice(words) for _ in range(120)]
    for i in range(150):  # one large group of near copies, chained: neighbours are alike, ends are not
        copy = list(base)
        for k in range(i % 50):
            copy[(k * 2) % 120] = f"x{k}"
        rows.append((1000 + i, " ".join(copy)))
    rows += [(2000 + i, rows[5][1]) for i in range(4)] + [(3000, None), (3001, ""), (3001, "")]
    frame = [rnd.choice(words) for _ in range(60)]
    rows += [(4000 + i, " ".join(frame + [f"t{i}_{k}" for k in range(60)])) for i in range(20)]  # half shared, not alike
    return rows


def classes_of(pairs):
    """{class: ids} without regard to names."""
    out = {}
    for i, c in pairs:
        out.setdefault(c, []).append(i)
    return sorted(sorted(map(str, v)) for v in out.values())


def test_classes_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup.near_duplicates(df, "doc_id", "text").collect()
    wanted = near_classes(rows)
    alone = {i for i, (_, t) in enumerate(rows) if not bag(t)}
    named = {i: min(rows[j][0] for j in range(len(rows)) if wanted[j] == wanted[i]) for i in range(len(rows)) if i not in alone}
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted((rows[i][0], named.get(i, rows[i][0])) for i in range(len(rows)))
    kept = near_dedup.keep_one(df, "doc_id", "text").collect()
    assert sorted(r.doc_id for r in kept) == sorted({*named.values()} | set()) + [rows[i][0] for i in sorted(alone)] or sorted(
        r.doc_id for r in kept
    ) == sorted([*{*named.values()}, *(rows[i][0] for i in alone)])


def test_blocks_find_links_that_the_ends_miss(spark):
    """Both ends of a bucket are alike to nobody; the others are found block by block."""
    rows = corpus()[60:210]
    text = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", near_dedup.words_of(F.col("text")))
    texts = text.select(near_dedup.node_of(text["words"]).alias("node"), "words", "text").dropDuplicates(["node"])
    members = texts.selectExpr("7L as bucket", "node")
    sketches = near_dedup.signatures(texts.selectExpr("1 as id", "node", "words"), "int").select("node", "sketch")
    texts = texts.select("node", "text")
    none = texts.selectExpr("node", "node as component").limit(0)
    links = near_dedup.rest_links(members, none, sketches, texts, 0.8)
    assert components(links).select("component").distinct().count() == len({c for c in near_classes(rows)})


def test_edges(spark):
    rows = edge_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = near_dedup.near_duplicates(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.class_id for r in got}
    assert by[6] == by[7] == by[8] == 6 and by[1] == 1 and by[2] == 2 and by[5] == 5
    assert {r.class_id for r in got if r.doc_id is None} == {6, None}
    kept = near_dedup.keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(6) == 1 and 7 not in ids and 8 not in ids and ids.count(1) == 1 and ids.count(None) == 1
    assert near_dedup.near_duplicates(df.limit(0), "doc_id", "text").count() == 0
    assert near_dedup.keep_one(df.limit(0), "doc_id", "text").count() == 0


def test_links_between_components_are_joined(spark):
    node = "struct<a:bigint,b:bigint>"
    pair = lambda i: (i, 0)
    labels = spark.createDataFrame([(pair(i), pair(0)) for i in (0, 1, 2)] + [(pair(i), pair(10)) for i in (10, 11)] + [(pair(i), pair(20)) for i in (20, 21)], f"node {node}, component {node}")
    more = spark.createDataFrame([(pair(2), pair(11)), (pair(30), pair(21)), (pair(40), pair(41))], f"u {node}, v {node}")
    got = {r.node.a: r.component.a for r in near_dedup.merged(labels, more).collect()}
    assert got == {**dict.fromkeys((0, 1, 2, 10, 11), 0), **dict.fromkeys((20, 21, 30), 20), 40: 40, 41: 40}


def test_bucket_of_many_that_no_leader_joins(spark):
    """Pairs of near copies in one bucket: most have no leader near them, and the rest is compared in blocks."""
    rnd = random.Random(8)
    frame = [f"f{k}" for k in range(60)]
    rows = []
    for i in range(300):
        own = [f"o{i}_{k}" for k in range(50)]
        rows += [(2 * i, " ".join(frame + own)), (2 * i + 1, " ".join(frame + own[:-1] + [f"z{rnd.random()}"]))]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", "text").collect()}
    assert got == {i: i - i % 2 for i in range(600)}


def test_texts_pass_the_bitmap_before_they_are_shuffled(spark):
    rows = spark.range(4000).selectExpr("id", "concat('one two three four five six ', id) as text")
    rows = rows.unionByName(spark.sql("select 7L as id, 'again the same id' as text union all select null, 'no id'"))
    nodes = rows.select("id", near_dedup.node_of(near_dedup.words_of(F.col("text"))).alias("node"))
    busy = nodes.where("id in (3, 7, 2001) or id is null")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = near_dedup.texts_of(rows, near_dedup.materialize(busy))
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
        got = sorted(r.text for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    # the join with the bitmap stands below the shuffle of texts, which is one for join and grouping
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(plan) if "BroadcastHashJoin" in line)
    below = list(itertools.takewhile(lambda line: depth(line) > depth(plan[at]), plan[at + 1 :]))
    assert below and not any("hashpartitioning" in line for line in below)
    assert sum("hashpartitioning" in line for line in plan) == 2
    assert got == ["again the same id", "no id"] + [f"one two three four five six {i}" for i in (2001, 3, 7)]

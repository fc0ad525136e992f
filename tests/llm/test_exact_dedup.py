import collections
import hashlib
import random
import re

from fixtures import SCHEMA, edge_rows

from cytoquilt.llm import exact_dedup as E


def key(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()


def wanted(rows):
    """Counted rows of the result: (id, keep, size, kept, digest)."""
    by = collections.defaultdict(list)
    for i, t in rows:
        by[key(t)].append((-len(t or ""), i is None, i or 0))
    out = []
    for h, own in by.items():
        first = min(own)
        keep = None if first[1] else first[2]
        for k, row in enumerate(sorted(own)):
            out.append((None if row[1] else row[2], keep, len(own), k == 0, h))
    return collections.Counter(out)


def test_edge_rows(spark):
    rows = [*edge_rows(), (20, "o n e\ttwo", None, "x", 1, 1, "i", "o"), (21, "onetwo", None, "x", 1, 1, "i", "o"), (22, " ", None, "x", 1, 1, "i", "o")]
    got = E.exact_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), "doc_id", "text")
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert collections.Counter(tuple(r) for r in got.collect()) == wanted([r[:2] for r in rows])


def test_hot_group_many_shards_and_string_ids(spark):
    rng = random.Random(3)
    rows = [(f"d{i:04}", "same  text" if i % 3 == 0 else " ".join(rng.choices("abcdefg", k=rng.randrange(1, 5)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "keep_id string, text string").repartition(7)
    rows_of = E.digests(df, "keep_id", "text")
    index = E.write_index(rows_of, shards=5)
    assert index.count() == 5
    got = E.lookup(index, rows_of).selectExpr("_id", "_keep", "_size", "_row = _keep_row", "lower(hex(_digest))").collect()
    by = collections.defaultdict(list)
    for i, t in rows:
        by[key(t)].append((-len(t), i))
    assert sorted(map(tuple, got)) == sorted((i, min(own)[1], len(own), i == min(own)[1], h) for h, own in by.items() for _, i in own)
    assert E.exact_duplicates(df, "keep_id", "text").columns == ["keep_id", "keep_id_", "group_size", "kept", "text_sha256"]


def test_deleting_and_inserting_again(spark):
    def rows(pairs):
        return E.digests(spark.createDataFrame(pairs, "id long, text string"), "id", "text")

    index = E.write_index(rows([(i, f"text {i % 50}") for i in range(200)]), shards=3)
    gone = rows([(0, "text 7"), (0, "te xt7"), (0, "never seen"), (0, "text 9")])
    more = rows([(500, "text 9"), (501, "text 8"), (502, "new")])
    after = E.update_index(index, insert=more, delete=gone)
    live = {r["_digest"].hex(): (r["_size"], r["_keep"]) for r in map(lambda r: r.asDict() | {"_digest": bytes(r["_digest"])}, E.groups(after).collect())}
    assert len(live) == 50 and key("text 7") not in live
    assert live[key("text 9")] == (1, 500) and live[key("text 8")] == (5, 8) and live[key("new")] == (1, 502) and live[key("text 1")] == (4, 1)
    assert E.groups(index).count() == 50
    back = E.lookup(after, gone).where("_size is null").count()
    assert back == 3


def test_index_against_a_dictionary():
    rng, index, plain = random.Random(1), E.CuckooIndex(), {}
    for step in range(20_000):
        digest = hashlib.sha256(str(rng.randrange(6000)).encode()).digest()
        number = index.find(digest)
        assert (number >= 0) == (digest in plain)
        if number >= 0:
            assert index.values[number] == plain[digest]
        if rng.random() < 0.35:
            assert index.delete(digest) == (plain.pop(digest, None) is not None)
        elif number < 0:
            index.insert(digest, step)
            plain[digest] = step
    assert index.resizes > 2
    again = E.CuckooIndex.of(*index.image(), list(index.values))
    assert all(again.values[again.find(d)] == v for d, v in plain.items()) and len(again.digests) == len(plain)


def test_overflow_and_equal_fingerprints():
    index = E.CuckooIndex(2)
    same = [bytes([k]) * 4 + b"\x00" * 10 + bytes([k]) * 18 for k in range(1, 9)]
    for k, digest in enumerate(same):  # one fingerprint, one pair of buckets: eight fill both
        index.insert(digest, k)
    assert [index.values[index.find(d)] for d in same] == list(range(8))
    assert index.find(b"\x63" * 4 + b"\x00" * 10 + b"\x63" * 18) == -1 and index.false_hits == 1
    assert index.delete(same[3]) and index.find(same[3]) == -1 and index.values[index.find(same[7])] == 7


def test_empty(spark):
    assert E.exact_duplicates(spark.createDataFrame([], SCHEMA), "doc_id", "text").collect() == []

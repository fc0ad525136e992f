import collections
import hashlib
import zlib

import pytest
from fixtures import SCHEMA, edge_rows
from pyspark.sql import functions as F

from cytoquilt.llm import merkle

FIELDS = ("doc_id", "source", "bucket", "text")


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(digests, fanout):
    """(root, siblings of every leaf: [(left, right)] from below)."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for path, p in zip(paths, at):
            run = digests[p // fanout * fanout :][:fanout]
            path.append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
        digests = [h(digests[i : i + fanout]) for i in range(0, len(digests), fanout)]
        at = [p // fanout for p in at]
    return digests[0], paths


def brute(rows, fanout=3):
    """``rows``: (id, group, values, claimed values)."""
    by = collections.defaultdict(list)
    for i, g, values, claimed in rows:
        by[g].append((i is not None, i or 0, leaf(values), leaf(claimed)))
    names = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    inner = {g: tree([r[2] for r in sorted(by[g])], fanout) for g in names}
    root, tops = tree([inner[g][0] for g in names], fanout)
    out = []
    for g, top in zip(names, tops):
        sub, paths = inner[g]
        for (known, i, own, now), path in zip(sorted(by[g]), paths):
            node = now
            for left, right in path + top:
                node = h([left, node, right])
            out.append((i if known else None, own, sub, root, h([left + right for left, right in path + top]), node, node == root))
    return collections.Counter(out)


def cut(i, text):
    return text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_edge_rows(spark, fanout):
    rows = edge_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = merkle.manifest(df, "doc_id", "source", FIELDS, merkle.without_newlines(), fanout)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    wanted = brute([(r[0], r[2], (r[0], r[2], r[4], r[1]), (r[0], r[2], r[4], cut(r[0], r[1]))) for r in rows], fanout)
    assert collections.Counter(tuple(r) for r in got.collect()) == wanted


def test_many_groups_one_hot(spark):
    rows = [(i, f"g{i % 13}" if i % 2 else "hot", f"line\n{i % 7}", i * i) for i in range(500)] + [(1000, None, "alone", 0), (1001, "", "x", 1), (1002, "é", "y", 2)]
    df = spark.createDataFrame(rows, "root long, source string, text string, n long").repartition(9)
    got = merkle.manifest(df, "root", "source", ("root", "text", "n"), {"text": F.when(F.col("root") % 5 == 0, F.lit(None)).otherwise(F.col("text"))})
    assert got.columns == ["root", "leaf", "subroot", "root_", "proof_sha256", "folded_root", "verified"]
    wanted = brute([(i, g, (i, t, n), (i, None if i % 5 == 0 else t, n)) for i, g, t, n in rows])
    assert collections.Counter(tuple(r) for r in got.collect()) == wanted


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(5, "s", "a\n")], "doc_id long, source string, text string")
    one = merkle.manifest(df, "doc_id", "source", ("doc_id", "text"), paths=True).first()
    assert one["leaf"] == one["root"] == one["subroot"] == one["folded_root"] and one["verified"] and one["proof"] == [] and one["proof_sha256"] == h([])
    assert merkle.manifest(df.where("false"), "doc_id", "source", ("doc_id", "text")).collect() == []
    with pytest.raises(ValueError):
        merkle.manifest(df, "doc_id", "source", ("doc_id",), fanout=1)

"""Centroid clustering by a Walsh-Hadamard progressive search (operator 12).

Vectors and centroids are integers and go through an exact integer transform.
It keeps squared distances up to the factor of its length, so the squared
differences of the first coefficients, the coarse ones, are lower bounds that
grow to the distance itself. A search adds them up block by block and drops a
centroid once its sum is larger than the whole distance of some other centroid;
what is left is summed over all coefficients, so nearest centroids, ties and
distances are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cytoquilt.llm.common import fresh, quoted
from cytoquilt.session import materialize

#: integers below this stay within 64 bits throughout; larger ones are worked out with Python's integers
SAFE = 1 << 24
LONG_MAX = (1 << 63) - 1
ROWS = 4096


def hadamard(n: int) -> np.ndarray:
    """The n x n transform (n a power of two), rows from coarse to fine: by their number of sign changes."""
    if n < 1 or n & (n - 1):
        raise ValueError("the transform needs a power of two")
    i = np.arange(n)
    both = i[:, None] & i[None, :]
    parity = np.zeros_like(both)
    while both.any():
        parity ^= both & 1
        both >>= 1
    h = 1 - 2 * parity
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")]


def blocks(n: int) -> list[slice]:
    """Coefficients in doubling steps: 0-3, 4-7, 8-15 and so on."""
    edges = [0, *(k for k in (4 << j for j in range(64)) if k < n), n]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def nearest(x: np.ndarray, c: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest row of ``c``, its squared distance) of each row of ``x``; ties go to the smaller number."""
    n = h.shape[0]
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) >= SAFE:
        x, c, h = x.astype(object), c.astype(object), h.astype(object)
    tx, tc = x @ h.T, c @ h.T
    steps = blocks(n)
    partial = ((tx[:, None, steps[0]] - tc[None, :, steps[0]]) ** 2).sum(axis=2)
    rows = np.arange(len(x))
    # one candidate in full: whatever exceeds its distance can't be the nearest
    bound = ((tx - tc[partial.argmin(axis=1)]) ** 2).sum(axis=1)
    alive = (partial <= bound[:, None]).astype(bool)
    for step in steps[1:]:
        r, k = np.nonzero(alive)
        partial[r, k] += ((tx[r, step] - tc[k, step]) ** 2).sum(axis=1)
        alive[r, k] = partial[r, k] <= bound[r]
    partial[~alive] = (bound.max() if len(bound) else 0) + 1
    best = partial.argmin(axis=1)
    return best, partial[rows, best] // n


def integers(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of every component; NULL for another length and for null or non-finite components.

    What exceeds a long saturates.
    """
    x = vector.cast("array<double>")
    good = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def first_centroids(vectors: DataFrame, id_col: str, k: int) -> np.ndarray:
    """The ``k`` vectors of smallest hash of their id (fewer, if there are fewer), k rows on the driver."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(quoted(id_col).cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("_h"), "_v").orderBy("_h", "_v").limit(k).collect()
    return np.array([r["_v"] for r in rows], dtype=np.int64)


def cluster_sums(vectors: DataFrame, c: np.ndarray, dims: int) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (count, sum of each component)}. Every task adds up its own part; clusters x components rows reach the driver."""
    import pyarrow as pa

    h, kind = hadamard(dims), pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(c), np.int64), np.zeros((len(c), dims), dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = matrix(batch.column("_v").slice(at, ROWS), dims)
                best, _ = nearest(x, c, h)
                for k in np.unique(best):
                    own = x[best == k]
                    count[k] += len(own)
                    total[k] += (own if np.abs(own).max() < SAFE else own.astype(object)).sum(axis=0)
        k = np.repeat(np.flatnonzero(count), dims)
        sums = pa.array([int(v) for row in total[count > 0] for v in row], pa.int64() if np.abs(total).max(initial=0) < SAFE**2 else kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int32()), pa.array(np.tile(np.arange(dims), len(k) // dims), pa.int32()), pa.array(count[k], pa.int64()), sums.cast(kind)],
            names=["k", "i", "n", "s"],
        )

    parts = vectors.select("_v").mapInArrow(run, "k int, i int, n long, s decimal(38,0)")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("k", "i").collect():
        out.setdefault(r["k"], (r["n"], []))[1].append(int(r["s"]))
    return out


def fit(vectors: DataFrame, id_col: str, dims: int, k: int, rounds: int) -> np.ndarray:
    """Centroids after ``rounds`` rounds; a cluster without vectors keeps its own."""
    c = first_centroids(vectors, id_col, k)
    for _ in range(rounds if len(c) else 0):
        for number, (n, sums) in cluster_sums(vectors, c, dims).items():
            c[number] = [s // n for s in sums]
    return c


def cluster(
    df: DataFrame, id_col: str, vector_col: str, dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64
) -> DataFrame:
    """Id, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of every vector.

    Vectors of another length, null ones and those with null or non-finite
    components take no part. Every row counts, so a repeated vector is two
    vectors; among equal hashes of starting ids the smaller vector comes first, and
    a null id hashes as an empty one. With fewer than ``k`` vectors there are as
    many centroids as vectors. Integers, distances and sums beyond a long become
    the largest long (components also the smallest). Other columns are left out;
    an id column named as one of these gets them under a name with ``_`` behind. An
    empty table comes out empty.
    """
    import pyarrow as pa

    names = fresh(df.select(quoted(id_col)), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    out, distance, own_sum, all_sum, digest = names
    # read once a round, so written as integers first
    vectors = materialize(df.select(quoted(id_col), integers(quoted(vector_col), dims, scale).alias("_v")).where("_v is not null"))
    c, h = fit(vectors, id_col, dims, k, rounds), hadamard(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                best, d = nearest(matrix(part.column(1), dims), c, h)
                far = pa.array([min(int(x), LONG_MAX) for x in d], pa.int64()) if d.dtype == object else pa.array(d, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.int32()), far], names=[id_col, out, distance])

    id_field = vectors.schema[0]
    schema = StructType([StructField(id_col, id_field.dataType), *StructType.fromDDL("k int, d long").fields])
    schema.fields[1].name, schema.fields[2].name = out, distance
    assigned = materialize(vectors.mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in schema.fields])))
    longest = F.lit(LONG_MAX).cast("decimal(38,0)")
    sums = assigned.groupBy(quoted(out)).agg(F.sum(quoted(distance).cast("decimal(38,0)")).alias("_s"))
    sums = sums.select(out, F.least("_s", longest).cast("long").alias(own_sum), "_s")
    total = F.least(sums.select(F.sum("_s")).scalar(), longest).cast("long")
    hashes = df.sparkSession.createDataFrame([(i, ",".join(map(str, row.tolist()))) for i, row in enumerate(c)], f"`{out}` int, _c string")
    # one row a centroid on the right side: at most k
    side = sums.join(F.broadcast(hashes), out).select(out, own_sum, total.alias(all_sum), F.sha2(quoted("_c"), 256).alias(digest))
    return assigned.join(F.broadcast(side), out).select(quoted(id_col), *names)


def oracle(table: str = "embeddings", dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64) -> str:
    """The same rows in DuckDB's SQL, for the columns of ``embeddings``."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, rn, k, d, row_number() OVER (PARTITION BY rn ORDER BY d, k) AS o FROM (SELECT e.vec_id, e.rn, c.k, sum((e.x - c.x) * (e.x - c.x))::BIGINT AS d FROM ex e JOIN c{r} c USING (i) GROUP BY ALL) QUALIFY o = 1)")
        if r < rounds:
            steps.append(f"n{r} AS (SELECT a.k, e.i, floor(sum(e.x)::DECIMAL(38,0) / count(*))::BIGINT AS x FROM a{r} a JOIN ex e USING (rn) GROUP BY ALL)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN n{r} n USING (k, i))")
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rn, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM {table}
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ex AS MATERIALIZED (SELECT vec_id, rn, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept),
starts AS (SELECT rn, row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k FROM kept QUALIFY k < {k}),
c0 AS MATERIALIZED (SELECT s.k, e.i, e.x FROM starts s JOIN ex e USING (rn)),
{", ".join(steps)},
hs AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN hs USING (k)
"""

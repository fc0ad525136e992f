"""Best-fit packing by minimum bin slack (operator 7).

Only lengths matter for a packing, so the number of pieces of each length, at
most ``size`` numbers, is all that the driver sees. For each sequence a bitset
subset-sum search over the lengths still available finds the fullest feasible
combination around the longest piece left; the same combination is taken as
often as the counts allow. The plan is then laid over the pieces: each gets a
number among those of its length, counted in hash buckets so that a common
length is spread over many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoquilt.llm.bpe import encoder, vocabulary
from cytoquilt.llm.common import fresh, map_batches, quoted, tick
from cytoquilt.session import materialize


def fullest(counts: list[int], room: int) -> list[tuple[int, int]]:
    """(length, how many) with the largest sum up to ``room``; longer pieces are preferred."""
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in range(room, 0, -1):
        n = min(counts[length], room // length)
        if not n:
            continue
        before, left, part = reach, n, 1
        while left:  # copies in powers of two
            take = min(part, left)
            reach |= (reach << (length * take)) & full
            left -= take
            part *= 2
        if reach != before:
            steps.append((length, n, before))
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, _, before in reversed(steps):
        used = 0
        while not before >> at & 1:
            at -= length
            used += 1
        if used:
            chosen.append((length, used))
    return chosen


def minimum_slack(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(how many sequences, [(length, pieces of it in each)])]; every piece is placed once."""
    left = [0] * (size + 1)
    for length, n in counts.items():
        left[length] = n
    plan = []
    for longest in range(size, 0, -1):
        while left[longest]:
            left[longest] -= 1
            rest = fullest(left, size - longest)
            left[longest] += 1
            need = dict(rest)
            need[longest] = need.get(longest, 0) + 1
            times = min(left[length] // n for length, n in need.items())
            for length, n in need.items():
                left[length] -= n * times
            plan.append((times, sorted(need.items(), reverse=True)))
    return plan


class Placing:
    """Where the r-th piece of a length goes: for each length, sorted runs of (first rank, sequence, offset)."""

    def __init__(self, plan: Sequence, size: int):
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(size + 1)]
        used, sequence = [0] * (size + 1), 0
        for times, parts in plan:
            offset = 0
            for length, n in parts:
                for _ in range(n):
                    runs[length].append((used[length], sequence, offset))
                    used[length] += times
                    offset += length
            sequence += times
        self.runs = [np.array(r, np.int64).reshape(-1, 3) for r in runs]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length):
            own = np.flatnonzero(length == k)
            runs = self.runs[k]
            at = np.searchsorted(runs[:, 0], rank[own], "right") - 1
            sequence[own] = runs[at, 1] + rank[own] - runs[at, 0]
            offset[own] = runs[at, 2]
        return sequence, offset


def cut_pieces(df: DataFrame, id_col: str, text_col: str, size: int, name: str, end_id: int, keep_ids: bool) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32[, ids]); the first piece of a long document takes the odd rest.

    Where the ids go out too, their copies in the worker and the writer need the room: slices and the encoder's cache are smaller then.
    """
    cache, slices = (16 << 20, 1 << 20) if keep_ids else (64 << 20, 4 << 20)

    def make():
        bpe = encoder(vocabulary(name), cache)

        def work(batch: pa.RecordBatch) -> list:
            ids, offsets = bpe.encode(batch.column(1))
            docs = np.diff(offsets) + 1
            ends = np.cumsum(docs)
            flat = np.full(ends[-1] if len(ends) else 0, end_id, "<u4")
            inside = np.ones(flat.size, bool)
            inside[ends - 1] = False
            flat[inside] = ids
            pieces = -(-docs // size)
            row = np.repeat(np.arange(len(docs)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = docs - (pieces - 1) * size
            start = np.where(number == 0, 0, head[row] + (number - 1) * size)
            length = np.where(number == 0, head[row], size)
            at = (ends - docs)[row] + start
            raw = memoryview(flat.tobytes())
            crc = [zlib.crc32(raw[a * 4 : (a + n) * 4]) for a, n in zip(at.tolist(), length.tolist())]
            out = [pc.take(batch.column(0), pa.array(row)), number, start, length, crc]
            if keep_ids:
                out.append(pa.ListArray.from_arrays(np.append(at, flat.size).astype(np.int32), flat.astype(np.int32)))
            return out

        return work

    kind = df.select(quoted(id_col)).schema[0].dataType.simpleString()
    schema = f"{tick(id_col)} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return map_batches(df.select(quoted(id_col), quoted(text_col)), make, schema, size=slices)


def pack(
    df: DataFrame, id_col: str, text_col: str, size: int = 1024, name: str = "byte_bpe_50k.json", end_id: int = 2,
    keep_ids: bool = False, bucket_rows: int = 100_000,
) -> DataFrame:
    """Pack all texts into sequences of at most ``size`` tokens.

    Each text becomes its token ids and then ``end_id``; a null or empty text is
    the end id alone. Only a document longer than ``size`` is cut. Returns one row
    per piece: (id, piece, start, length, ids_crc32, sequence_id, offset), with
    ``ids array<int>`` where asked for. Repeated rows are packed as often as they
    come; an empty table gives no rows.
    """
    pieces = materialize(cut_pieces(df, id_col, text_col, size, name, end_id, keep_ids))
    # at most ``size`` rows come to the driver
    counts = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}
    placing = Placing(minimum_slack(counts, size), size)
    buckets = max(16, sum(counts.values()) // bucket_rows)
    bucket, before, rank = fresh(pieces, "_bucket", "_before", "_rank")
    key = F.xxhash64(quoted(id_col), "piece", "start", "ids_crc32")
    rows = pieces.withColumn(bucket, F.pmod(key, F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("length", bucket).agg(F.count(F.lit(1)).alias(before))
    along = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", bucket, F.coalesce(F.sum(before).over(along), F.lit(0)).alias(before))
    inside = Window.partitionBy("length", bucket).orderBy(quoted(id_col), "piece", "ids_crc32")
    ranked = rows.withColumn(rank, F.row_number().over(inside) - 1).join(offsets, ["length", bucket])
    ranked = ranked.select(*[quoted(c) for c in pieces.columns], (F.col(rank) + F.col(before)).alias(rank))
    at, width = pieces.columns.index("length"), len(pieces.columns)

    def make():
        def work(batch: pa.RecordBatch) -> list:
            sequence, offset = placing.place(batch.column(at).to_numpy(), batch.column(width).to_numpy())
            return [*batch.columns[:width], sequence, offset]

        return work

    schema = ", ".join(f"{tick(f.name)} {f.dataType.simpleString()}" for f in pieces.schema)
    return map_batches(ranked, make, f"{schema}, sequence_id bigint, offset bigint", rows=65_536)

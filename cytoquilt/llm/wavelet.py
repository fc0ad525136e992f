"""Token ids in wavelet matrices (operator 8): one file image per shard, whole bit planes with rank and select support.

A shard holds whole documents in order. Its image is a header, the number of
ids of each document, and one bit plane per bit of the largest id: plane k has
the k-th highest bit of every id, in the order that the planes above have given,
zeros first. The images are rows of a Parquet folder that Spark writes, so a
lost executor costs only its own shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytoquilt.llm.bpe import encoder, vocabulary
from cytoquilt.llm.common import quoted

MAGIC = b"WMX1"
BLOCK = 512  # bits between two stored ranks
PART_BYTES = 32 << 20  # text bytes a range partition is planned for


def build(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """File image of ``ids``, the documents' ids one behind the other."""
    width = max(1, int(ids.max()).bit_length()) if ids.size else 1
    planes, ranks, zeros, x = [], [], [], ids.astype(np.uint16 if width <= 16 else np.uint32)
    for level in range(width - 1, -1, -1):
        bit = (x & x.dtype.type(1 << level)).astype(bool)
        plane = np.packbits(bit, bitorder="little")
        plane = np.concatenate((plane, np.zeros(-plane.size % (BLOCK // 8), np.uint8)))
        planes.append(plane.tobytes())
        ones = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)
        ranks.append((np.cumsum(ones) - ones).astype("<u4").tobytes())
        zeros.append(x.size - int(ones.sum()))
        x = np.concatenate((x[~bit], x[bit]))
    head = struct.pack("<4sIQQ", MAGIC, width, ids.size, len(sizes)) + np.array(zeros, "<u8").tobytes()
    body = head + sizes.astype("<u4").tobytes() + b"".join(planes) + b"".join(ranks)
    return body + struct.pack("<I", zlib.crc32(body))


class WaveletMatrix:
    """Reads an image; every question is answered from the bit planes."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC or zlib.crc32(memoryview(image)[:-4]) != struct.unpack("<I", image[-4:])[0]:
            raise ValueError("damaged wavelet matrix")
        _, self.width, self.n, docs = struct.unpack_from("<4sIQQ", image)
        at = 24
        self.zeros = np.frombuffer(image, "<u8", self.width, at).astype(np.int64)
        at += 8 * self.width
        self.sizes = np.frombuffer(image, "<u4", docs, at).astype(np.int64)
        at += 4 * docs
        blocks = -(-self.n // BLOCK)
        self.planes = np.frombuffer(image, np.uint8, self.width * blocks * (BLOCK // 8), at).reshape(self.width, -1)
        at += self.planes.size
        self.ranks = np.frombuffer(image, "<u4", self.width * blocks, at).reshape(self.width, blocks).astype(np.int64)

    def rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits of a plane before each position."""
        at = np.asarray(at, np.int64)
        if not self.n:
            return np.zeros_like(at)
        block = np.minimum(at // BLOCK, self.ranks.shape[1] - 1)
        bits = np.unpackbits(self.planes[level].reshape(-1, BLOCK // 8)[block], axis=-1, bitorder="little")
        upto = np.arange(BLOCK) < (at - block * BLOCK)[..., None]
        return self.ranks[level][block] + (bits & upto).sum(-1, dtype=np.int64)

    def select(self, level: int, nth: np.ndarray, one: bool) -> np.ndarray:
        """Positions of the nth (from 0) set or clear bits of a plane: the block by its stored rank, then the bit in it."""
        nth, ranks = np.asarray(nth, np.int64), self.ranks[level]
        before = ranks if one else np.arange(len(ranks)) * BLOCK - ranks
        block = np.searchsorted(before, nth, "right") - 1
        bits = np.unpackbits(self.planes[level].reshape(-1, BLOCK // 8)[block], axis=-1, bitorder="little")
        upto = np.cumsum(bits if one else 1 - bits, axis=-1, dtype=np.int16)
        return block * BLOCK + (upto > (nth - before[block])[..., None]).argmax(-1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Ids at given positions."""
        at, value = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for level in range(self.width):
            bit = (self.planes[level][at >> 3] >> (at & 7).astype(np.uint8)) & 1
            ones = self.rank1(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            value = value << 1 | bit
        return value

    def all(self) -> np.ndarray:
        """All ids in order: the planes are undone from the lowest up."""
        value = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            below = np.empty_like(value)
            z = int(self.zeros[level])
            below[~bit] = value[:z]
            below[bit] = value[z:] | value.dtype.type(1 << (self.width - 1 - level))
            value = below
        return value

    def _path(self, token: int) -> list[tuple[int, int]]:
        return [(level, token >> (self.width - 1 - level) & 1) for level in range(self.width)]

    def before(self, token: int, at: np.ndarray) -> np.ndarray:
        """How often ``token`` occurs before each position, by rank from the highest plane down."""
        at = np.append(np.asarray(at, np.int64), 0)
        if token >> self.width:
            return np.zeros(len(at) - 1, np.int64)
        for level, one in self._path(token):
            ones = self.rank1(level, at)
            at = ones + self.zeros[level] if one else at - ones
        return at[:-1] - at[-1]

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often ``token`` occurs in [start, end)."""
        a, b = self.before(token, np.array([start, self.n if end is None else end])).tolist()
        return b - a

    def nth(self, token: int, number: np.ndarray) -> np.ndarray:
        """Positions of the given occurrences (from 0) of ``token``, by select from the lowest plane up."""
        at = np.array([0])
        for level, one in self._path(token):
            ones = self.rank1(level, at)
            at = ones + self.zeros[level] if one else at - ones
        at = at[0] + np.asarray(number, np.int64)
        for level, one in reversed(self._path(token)):
            at = self.select(level, at - self.zeros[level] if one else at, bool(one))
        return at

    def occurrences(self, token: int) -> list[int]:
        """All positions of ``token``."""
        return self.nth(token, np.arange(self.count(token))).tolist()


def write_shards(
    df: DataFrame, id_col: str, text_col: str, folder: str, name: str = "word_bpe_49k.json", end_id: int = 1, shard_tokens: int = 1 << 20
) -> None:
    """Encode every text, append ``end_id``, and write shards of about ``shard_tokens`` ids in ascending id order.

    A null or empty text is the end id alone; null ids come first, repeated rows
    are written as often as they come. The range partitioning is over
    (id, text hash), so many rows of one id do not meet in one task. One row of
    the folder is one image: (part, shard, n_tokens, doc_ids, image).
    """
    kind = df.select(quoted(id_col)).schema[0].dataType.simpleString()
    rows = df.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    tie = F.xxhash64("text")
    # as many ranges as the texts have bytes for, however many partitions the session has
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    ordered = rows.repartitionByRange(n, "id", tie).sortWithinPartitions("id", tie)
    ordered = ordered.select("id", "text", F.spark_partition_id().alias("part"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary(name))
        docs, ids, held, shard, part = [], [], 0, 0, 0

        def image() -> pa.RecordBatch:
            sizes = np.concatenate([np.diff(o) + 1 for _, o in ids])
            flat = np.full(int(sizes.sum()), end_id, np.uint32)
            inside = np.ones(flat.size, bool)
            inside[np.cumsum(sizes) - 1] = False
            flat[inside] = np.concatenate([x for x, _ in ids])
            doc_ids = pa.concat_arrays(docs)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([flat.size], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), pa.array([build(flat, sizes)], pa.binary()),
                ],
                names=["part", "shard", "n_tokens", "doc_ids", "image"],
            )

        for batch in batches:
            step = max(1, min(1024, batch.num_rows * (4 << 20) // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                cut = batch.slice(at, step)
                part = cut.column(2)[0].as_py()
                docs.append(cut.column(0))
                ids.append(bpe.encode(cut.column(1)))
                held += len(ids[-1][0]) + cut.num_rows
                if held >= shard_tokens:
                    yield image()
                    docs, ids, held, shard = [], [], 0, shard + 1
        if docs:
            yield image()

    schema = f"part int, shard int, n_tokens bigint, doc_ids array<{kind}>, image binary"
    ordered.mapInArrow(shards, schema).write.mode("overwrite").parquet(folder)


def read_shards(spark: SparkSession, folder: str, id_col: str, ask: int | None = None) -> DataFrame:
    """Per document, from the images: (id, start, n_tokens, ids_crc32, part, shard, place in the shard).

    With ``ask``, a token id, also ``asked_count``, how often the document has it,
    by rank, and ``asked_last``, the place of its last occurrence in the document,
    by select (null where there is none). Images stay where they are read: only the
    documents' rows meet the shards' starts.
    """
    table = spark.read.parquet(folder)
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()
    id_name = "_id"
    # one row per shard: the running sums see shard counts only
    per_part = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = per_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.select("part", "shard", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inner")).join(parts, "part")
    starts = starts.select("part", "shard", (F.col("ahead") + F.col("inner")).alias("base"))
    placed = table.select("doc_ids", "image", "part", "shard")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                matrix = WaveletMatrix(batch.column(1)[i].as_py())
                ids = memoryview(matrix.all().astype("<u4").tobytes())
                ends = np.cumsum(matrix.sizes)
                begins = ends - matrix.sizes
                crc = [zlib.crc32(ids[a * 4 : b * 4]) for a, b in zip(begins.tolist(), ends.tolist())]
                n = len(crc)
                columns = [
                    batch.column(0)[i].values, pa.array(begins), pa.array(matrix.sizes), pa.array(crc, pa.int64()),
                    pa.array(np.full(n, batch.column(2)[i].as_py(), np.int32)), pa.array(np.full(n, batch.column(3)[i].as_py(), np.int32)),
                    pa.array(np.arange(n, dtype=np.int32)),
                ]
                if ask is not None:
                    upto = matrix.before(ask, ends)
                    count = upto - matrix.before(ask, begins)
                    last = np.zeros(n, np.int64)
                    last[count > 0] = matrix.nth(ask, upto[count > 0] - 1) - begins[count > 0]
                    columns += [pa.array(count), pa.array(last, mask=count == 0)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    asked = ["asked_count", "asked_last"] if ask is not None else []
    names = [id_name, "start", "n_tokens", "ids_crc32", "part", "shard", "place", *asked]
    schema = f"{id_name} {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, part int, shard int, place int" + "".join(f", {c} bigint" for c in asked)
    out = placed.mapInArrow(rows, schema).join(starts, ["part", "shard"])
    columns = [F.col(id_name).alias(id_col), (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *asked, "part", "shard", "place"]
    return out.select(*columns)

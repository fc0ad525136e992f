"""Exact dedup over a cuckoo-filter index of live digests (operator 11).

Texts are compared by the sha256 of what is left without white space. Digests are
dealt to shards of bounded size. A shard keeps 16-bit fingerprints in a cuckoo
filter, four to a bucket, and beside it the full digests, chained by home bucket,
with the size of their group and the row that stays. A digest the filter does not
know is new and inserted; a hit is settled by the chain of its bucket. Where an
insertion finds no room, the filter is built anew at twice the size from the stored
digests. Digests can be deleted again. Shards are stored as images of flat arrays.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cytoquilt.llm.common import fresh, quoted
from cytoquilt.session import materialize

SLOTS, KICKS, SMALLEST = 4, 500, 64
WHITE = " \t\n\x0b\x0c\r"
#: digests a shard is planned for, and shards a task is given where there are many
SHARD_ROWS, TASK_SHARDS = 25_000, 8
#: a group with more than this part of all rows is joined by broadcast: there are fewer such groups than its inverse
HOT_SHARE = 1000


class CuckooIndex:
    """One shard: a cuckoo filter and the stored digests behind it."""

    def __init__(self, buckets: int = SMALLEST):
        self.resizes = self.false_hits = 0
        self.digests: list[bytes] = []
        self.values: list[Any] = []
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.head = array("i", [-1]) * buckets
        self.next = array("i", [-1]) * len(self.digests)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        """(fingerprint, home bucket, other bucket); zero marks a free slot and is no fingerprint."""
        home, mark = struct.unpack_from("<QH", digest, 4)
        mark = mark or 1
        home &= self.mask
        return mark, home, self._other(home, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, bucket: int, mark: int) -> int:
        """Slot of that fingerprint in the bucket, or -1."""
        at = bucket * SLOTS
        for i in range(at, at + SLOTS):
            if self.prints[i] == mark:
                return i
        return -1

    def _put(self, digest: bytes) -> bool:
        mark, bucket, other = self._places(digest)
        for b in (bucket, other):
            free = self._slot(b, 0)
            if free >= 0:
                self.prints[free] = mark
                return True
        bucket = other
        undo = []
        for kick in range(KICKS):
            i = bucket * SLOTS + (kick * 7 + mark) % SLOTS
            undo.append((i, self.prints[i]))
            self.prints[i], mark = mark, self.prints[i]
            bucket = self._other(bucket, mark)
            free = self._slot(bucket, 0)
            if free >= 0:
                self.prints[free] = mark
                return True
        for i, old in reversed(undo):
            self.prints[i] = old
        return False

    def _chain(self, number: int) -> None:
        home = self._places(self.digests[number])[1]
        self.next[number], self.head[home] = self.head[home], number

    def _rebuild(self, buckets: int) -> None:
        while True:
            self._empty(buckets)
            for number, digest in enumerate(self.digests):
                self._chain(number)
                if not self._put(digest):
                    break
            else:
                return
            buckets *= 2

    def find(self, digest: bytes) -> int:
        """Number of the stored digest, or -1: the filter first, the bucket's stored digests where it hits."""
        mark, home, other = self._places(digest)
        if self._slot(home, mark) < 0 and self._slot(other, mark) < 0:
            return -1
        number = self.head[home]
        while number >= 0:
            if self.digests[number] == digest:
                return number
            number = self.next[number]
        self.false_hits += 1
        return -1

    def insert(self, digest: bytes, value: Any) -> int:
        """Adds a digest that is not there yet and gives its number."""
        self.digests.append(digest)
        self.values.append(value)
        self.next.append(-1)
        if self._put(digest):
            self._chain(len(self.digests) - 1)
        else:
            self.resizes += 1
            self._rebuild(2 * (self.mask + 1))
        return len(self.digests) - 1

    def delete(self, digest: bytes) -> bool:
        """Takes a digest out of filter and store; says whether it was there."""
        number = self.find(digest)
        if number < 0:
            return False
        mark, home, other = self._places(digest)
        slot = self._slot(home, mark)
        # either slot may hold the mark: equal marks of one pair of buckets are interchangeable
        self.prints[slot if slot >= 0 else self._slot(other, mark)] = 0
        self._unchain(home, number)
        last = len(self.digests) - 1
        if number != last:
            # the last entry takes the number that has become free
            end = self._places(self.digests[last])[1]
            self._unchain(end, last)
            self.digests[number], self.values[number] = self.digests[last], self.values[last]
            self._chain(number)
        self.digests.pop(), self.values.pop(), self.next.pop()
        return True

    def _unchain(self, home: int, number: int) -> None:
        if self.head[home] == number:
            self.head[home] = self.next[number]
            return
        before = self.head[home]
        while self.next[before] != number:
            before = self.next[before]
        self.next[before] = self.next[number]

    def image(self) -> tuple[int, bytes, bytes]:
        """(buckets, fingerprints, digests) as flat arrays; the chains follow from the digests."""
        return self.mask + 1, self.prints.tobytes(), b"".join(self.digests)

    @classmethod
    def of(cls, buckets: int, prints: bytes, digests: bytes, values: list[Any]) -> CuckooIndex:
        out = cls(buckets)
        out.digests, out.values = [digests[i : i + 32] for i in range(0, len(digests), 32)], values
        out._empty(buckets)
        out.prints = array("H", prints)
        for number in range(len(out.digests)):
            out._chain(number)
        return out


def bare(text: Column) -> Column:
    """A text without its white space; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _digest, _chars, _row) of every row, written once; ``_row`` tells rows with equal ids apart."""
    text = quoted(text_col).cast("string")
    out = df.select(
        quoted(id_col).alias("_id"), F.unhex(F.sha2(bare(text), 256)).alias("_digest"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("_chars"), F.monotonically_increasing_id().alias("_row"),
    )
    return materialize(out)


def better(a, b) -> bool:
    """Whether row ``a`` (chars, id, row) stays rather than ``b``: more characters, then the smaller id (null last), then the earlier row."""
    if a[0] != b[0]:
        return a[0] > b[0]
    if a[1] != b[1]:
        return b[1] is None or (a[1] is not None and a[1] < b[1])
    return a[2] < b[2]


def candidates(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of each batch summed up by digest before they are shuffled: (_shard, _digest, _n, _chars, _id, _row).

    However many rows a digest has, a batch sends one.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([*StructType.fromDDL("_digest binary, _n long, _chars long").fields, StructField("_id", rows.schema["_id"].dataType), *StructType.fromDDL("_row long").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[bytes, list] = {}
            for digest, chars, key, row in zip(*(batch.column(c).to_pylist() for c in ("_digest", "_chars", "_id", "_row"))):
                own = best.get(digest)
                if own is None:
                    best[digest] = [1, chars, key, row]
                else:
                    own[0] += 1
                    if better((chars, key, row), own[1:]):
                        own[1:] = chars, key, row
            columns = [list(best), *map(list, zip(*best.values()))] if best else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema).withColumn("_shard", shard_of(F.col("_digest"), shards))


def shard_of(digest: Column, shards: int) -> Column:
    """By the digest's first four bytes; a shard's filter uses others."""
    return F.pmod(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def write_index(rows: DataFrame, shards: int | None = None) -> DataFrame:
    """The index over ``rows`` (of :func:`digests`), one image per shard, written to the shared folder."""
    if shards is None:
        shards = max(1, -(-rows.count() // SHARD_ROWS))
    return materialize(run_shards(candidates(rows, shards), None, shards, rows.schema["_id"].dataType))


def update_index(index: DataFrame, insert: DataFrame | None = None, delete: DataFrame | None = None) -> DataFrame:
    """A new version of the index: the digests of ``delete`` go, whatever their number, then the rows of ``insert`` come in.

    Both are results of :func:`digests`; ``delete`` needs ``_digest`` only.
    Deleting what is not there changes nothing. The old version stays as it is.
    """
    shards = index.agg(F.max("_shard") + 1).first()[0] or 1
    id_type = index.schema["ids"].dataType.elementType
    parts = []
    if delete is not None:
        gone = delete.select("_digest").distinct().select(
            "_digest", F.lit(0).cast("long").alias("_n"), F.lit(None).cast("long").alias("_chars"), F.lit(None).cast(id_type).alias("_id"), F.lit(None).cast("long").alias("_row")
        )
        parts.append(gone.withColumn("_shard", shard_of(F.col("_digest"), shards)))
    if insert is not None:
        parts.append(candidates(insert, shards))
    if not parts:
        return index
    changes = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return materialize(run_shards(changes, index, shards, id_type))


def run_shards(changes: DataFrame, index: DataFrame | None, shards: int, id_type) -> DataFrame:
    """Applies changes shard by shard. A task streams its shards' changes, sorted, and holds one shard at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType

    schema = StructType([*StructType.fromDDL("_shard int, buckets int, prints binary, digests binary, sizes array<long>, chars array<long>").fields,
                         StructField("ids", ArrayType(id_type)), *StructType.fromDDL("rows array<long>, resizes int, false_hits long").fields])
    arrow = to_arrow_schema(schema)
    fields = [f for f in schema.fieldNames() if f != "_shard"]
    stored = F.struct(*[F.lit(None).cast(schema[f].dataType).alias(f) for f in fields]).cast(StructType([schema[f] for f in fields]))
    # an image comes first, then what goes, then what comes in
    order = F.when(F.col("_n") == 0, 1).otherwise(2)
    plain = ["_shard", "_order", "_digest", "_n", "_chars", "_id", "_row"]
    columns = [*plain, "_image"]
    work = changes.withColumns({"_order": order, "_image": F.when(F.lit(False), stored)}).select(*columns)
    if index is not None:
        old = index.withColumns({"_order": F.lit(0), "_image": F.struct(*fields)})
        for c in ("_digest", "_n", "_chars", "_id", "_row"):
            old = old.withColumn(c, F.lit(None).cast(changes.schema[c].dataType))
        work = old.select(*columns).unionByName(work)
    parts = max(-(-shards // TASK_SHARDS), min(shards, int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    work = work.repartition(parts, "_shard").sortWithinPartitions("_shard", "_order")

    def record(shard: int, own: CuckooIndex) -> pa.RecordBatch:
        buckets, prints, stored_digests = own.image()
        sizes, chars, ids, rows = (list(c) for c in zip(*own.values)) if own.values else ([], [], [], [])
        values = [shard, buckets, prints, stored_digests, sizes, chars, ids, rows, own.resizes, own.false_hits]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, CuckooIndex()
        for batch in batches:
            images = batch.column(batch.num_columns - 1)
            for i, (shard, order, digest, n, chars, key, row) in enumerate(zip(*(batch.column(c).to_pylist() for c in plain))):
                if shard != at:
                    if at is not None:
                        yield record(at, own)
                    at, own = shard, CuckooIndex()
                if order == 0:
                    image = images[i].as_py()
                    own = CuckooIndex.of(image["buckets"], image["prints"], image["digests"], [list(v) for v in zip(image["sizes"], image["chars"], image["ids"], image["rows"])])
                    own.resizes, own.false_hits = image["resizes"], image["false_hits"]
                elif order == 1:
                    own.delete(digest)
                else:
                    number = own.find(digest)
                    if number < 0:
                        own.insert(digest, [n, chars, key, row])
                    else:
                        value = own.values[number]
                        value[0] += n
                        if better((chars, key, row), value[1:]):
                            value[1:] = chars, key, row
        if at is not None:
            yield record(at, own)

    return work.mapInArrow(run, schema)


def groups(index: DataFrame) -> DataFrame:
    """One row per live digest: (_digest, _size, _keep, _keep_row)."""
    import pyarrow as pa

    schema = StructType([*StructType.fromDDL("_digest binary, _size long").fields, StructField("_keep", index.schema["ids"].dataType.elementType), *StructType.fromDDL("_keep_row long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                stored, sizes, ids, rows = (column[i] for column in batch.columns)
                n = len(ids.values)
                digest = pa.Array.from_buffers(pa.binary(32), n, [None, stored.as_buffer()]).cast(pa.binary())
                for at in range(0, n, 10_000):
                    arrays = [x.slice(at, 10_000) for x in (digest, sizes.values, ids.values, rows.values)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["_digest", "_size", "_keep", "_keep_row"])

    return index.where(F.size("ids") > 0).select("digests", "sizes", "ids", "rows").mapInArrow(run, schema)


def lookup(index: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (of :func:`digests`) with ``_size``, ``_keep`` and ``_keep_row`` of their live digest; null where it is not live.

    Groups with more than a thousandth of all rows, fewer than a thousand groups, are broadcast; the others are joined by digest.
    """
    live = groups(index)
    total = index.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    large = materialize(live.where(F.col("_size") * HOT_SHARE > total).select("_digest", F.struct("_size", "_keep", "_keep_row").alias("_hot")))
    tagged = rows.join(F.broadcast(large), "_digest", "left")
    rest = live.where(F.col("_size") * HOT_SHARE <= total)
    found = ["_size", "_keep", "_keep_row"]
    hot = tagged.where("_hot is not null").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in found])
    other = tagged.where("_hot is null").drop("_hot").join(rest, "_digest", "left").select(*rows.columns, *found)
    return hot.unionByName(other)


def exact_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row.

    Of rows whose texts are equal without white space that with the most
    characters stays, then that of the smallest id, null ids last; of rows equal
    in these too exactly one stays. A null text is an empty one, and texts of
    white space only are empty texts, so all of these are one group. Texts are
    hashed whole, however long. Other columns are left out; an id column named as
    one of these gets them under a name with ``_`` behind. An empty table comes
    out empty.
    """
    keep, size, kept, digest = fresh(df.select(quoted(id_col)), "keep_id", "group_size", "kept", "text_sha256")
    rows = digests(df, id_col, text_col)
    found = lookup(write_index(rows), rows)
    return found.select(
        F.col("_id").alias(id_col), F.col("_keep").alias(keep), F.col("_size").alias(size),
        (F.col("_row") == F.col("_keep_row")).alias(kept), F.lower(F.hex("_digest")).alias(digest),
    )


def oracle(table: str = "documents") -> str:
    """The same rows in DuckDB's SQL, for the columns of ``documents``."""
    white = "[ \\t\\n\\x0B\\f\\r]"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{white}', '', 'g')) AS h FROM {table}),
o AS (SELECT *, row_number() OVER w AS o, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST, rn))
SELECT doc_id, keep_id, group_size, o = 1 AS kept, h AS text_sha256 FROM o
"""

"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A given table, cut to ``columns`` where only those are needed."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, compared without regard to case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def tick(name: str) -> str:
    """A name in back ticks, for schemas and expressions."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    """Column of that exact name, dots and spaces included."""
    return F.col(tick(name))


def row_key(*values: Column) -> Column:
    """128-bit key of a row's content; equal rows share it, so whatever is joined by it must hold one row a key."""
    marked = [F.coalesce(v.cast("string"), F.lit("\x00")) for v in values]
    return F.struct(F.xxhash64(*marked).alias("a"), F.xxhash64(F.lit(17), *marked).alias("b"))


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: str, rows: int = 4096, size: int = 4 << 20) -> DataFrame:
    """``mapInArrow`` in slices of at most ``rows`` rows and about ``size`` bytes.

    ``make()`` runs once a task; what it returns takes a record batch and gives
    the columns of the result (Arrow or numpy arrays, or lists), of any length.
    Spark's own batches are counted in rows and may hold many long texts. What
    Arrow has set aside goes back when the task ends, as workers are used again.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                columns = work(batch.slice(at, step))
                if len(columns[0]):
                    arrays = [
                        (c if isinstance(c, pa.Array) else pa.array(c, f.type)).cast(f.type) for c, f in zip(columns, out_schema, strict=True)
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)

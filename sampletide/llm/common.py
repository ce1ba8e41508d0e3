"""What the corpus operators share: the cluster's shared folder, written intermediate tables, bounded slices of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lots that the rows of a heavy key are dealt to.
HEAVY = 64
#: Bytes of text that a Python task turns into arrays at once; a longer text stands alone.
SLICE_BYTES = 1 << 20


class Tables:
    """The intermediate tables that are made while it is entered, by one run: nobody else's are ever deleted through it."""

    _now: ContextVar[Tables | None] = ContextVar("tables", default=None)

    def __init__(self) -> None:
        self.made: list[str] = []
        self._before: list = []

    @classmethod
    def current(cls) -> Tables | None:
        return cls._now.get()

    def __enter__(self) -> Tables:
        self._before.append(self._now.set(self))
        return self

    def __exit__(self, *_: object) -> None:
        self._now.reset(self._before.pop())

    def keep_only(self, spark: SparkSession, docs: DataFrame) -> None:
        """Delete the run's tables but those that ``docs`` reads: for a run whose earlier results are all written."""
        used = [f.split(":", 1)[-1].lstrip("/") for f in docs.inputFiles()] if self.made else []
        gone = [p for p in self.made if not any(f.startswith(p.split(":", 1)[-1].lstrip("/")) for f in used)]
        removed(spark, *gone)
        self.made = [p for p in self.made if p not in gone]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share (``spark.checkpoint.dir``, which must be set)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, read again: it cuts lineage and outlives executors. Also its path."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", compression).parquet(path)
    if tables := Tables.current():
        tables.made.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing will read again."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if (tables := Tables.current()) and path in tables.made:
            tables.made.remove(path)


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of few bytes unless the session asks for a size of its own: long texts come many to a batch."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("64m", "67108864b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, in slices with at most ``limit`` bytes in ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size
        yield batch.slice(begin)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches as tables of at least ``rows`` rows (the last one of what is left)."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def heavy_lots(keys: DataFrame) -> DataFrame:
    """``keys`` (a row a heavy key) once for each of the ``HEAVY`` lots of that key's rows."""
    return keys.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(HEAVY - 1))))


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, columns[f.name]) for f in schema)], schema=schema)

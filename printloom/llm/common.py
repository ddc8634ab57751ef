"""What the training-data operators share: reading, splits by crc32, written intermediates, text batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Python step: small enough that a chunk of long documents stays in memory.
CHUNK_ROWS = 128

#: Paths of the tables that go when the block of ``passing_tables`` that wrote them ends.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: str | Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus`` (null keys give null)."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(col.cast("string").cast("binary")) % modulus


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint directory.

    Only where the session names none and runs on one machine (tests) a temporary one is set; a cluster must name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="printloom-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    if (passing := _PASSING.get()) is not None:
        passing.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside the block are removed when it ends, but for those written by the function that it gives.

    What leaves the block must be read from kept tables or from elsewhere: its lineage then needs none of the removed
    ones, whatever executor is lost.
    """
    paths: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        inner = _PASSING.set(None)
        try:
            return written(df)
        finally:
            _PASSING.reset(inner)

    outer = _PASSING.set(paths)
    try:
        yield kept
    finally:
        _PASSING.reset(outer)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            at = hadoop(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def chunks(batches: Iterable[pa.RecordBatch], *names: str, rows: int = CHUNK_ROWS) -> Iterator[list[list]]:
    """The named columns of Arrow batches as Python lists, a bounded number of rows at a time."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for at in range(0, batch.num_rows, rows):
            yield [c.slice(at, rows).to_pylist() for c in columns]

"""References, dictionaries and samples of tables."""

from __future__ import annotations

import csv
import io
from itertools import chain, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from printloom.functions.text import is_latin1, strip, text_or_empty
from printloom.sources.files import document_name

#: Ranges of a key that are sorted apart, and keys of the sample that cuts them.
RANGES, SAMPLED = 32, 4096
#: Rows of one batch of a file that is read.
BATCH_ROWS = 4096


def reference_rows(spark: SparkSession, path: str, names: list[str], doc_id: str) -> DataFrame:
    """(doc_id, row_no, values) of a CSV file: rows of any length, in file order; a first row equal to the names is a header.

    A quoted field may span lines, so one file is one unit of work; many files are read in parallel by :func:`reference_files`.
    """
    return reference_files(spark, path, names).withColumn("doc_id", F.lit(doc_id))


def reference_files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The same for all files under a path; doc_id is the file's path below it, without its ending."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stem = document_name(file, path)
                rows = csv.reader(io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", newline=""))
                first = next(rows, None)
                kept = rows if first is None or [c.strip() for c in first] == names else chain([first], rows)
                at = 0
                while own := list(islice(kept, BATCH_ROWS)):
                    yield pa.record_batch({"doc_id": pa.array([stem] * len(own), pa.string()), "row_no": pa.array(range(at + 1, at + len(own) + 1), pa.int64()), "values": pa.array(own, pa.list_(pa.string()))})
                    at += len(own)

    return files.mapInArrow(parse, "doc_id string, row_no long, values array<string>")


def dictionary(spark: SparkSession, path: str | None) -> DataFrame:
    """(word) in lower case, one a line; none if there is no path, which turns the repairs that need words off."""
    if path is None:
        return spark.createDataFrame([], "word string")
    return spark.read.text(path).select(F.lower(strip(F.col("value"))).alias("word")).where("word <> ''").distinct()


def strided_sample(df: DataFrame, columns: list[str], order: str, stride: int, limit: int | None = None) -> DataFrame:
    """Every stride-th row by ``order`` that is representable in Latin-1, its columns trimmed, numbered from 1 as ``no``.

    Rows are numbered over the sample, not over the table: positions come from counts of ranges, never from one sort of all.
    """
    placed = with_positions(df, order).where(F.col("_at") % stride == 0)
    cells = placed.select("_at", *[strip(text_or_empty(F.col(c).cast("string"))).alias(c) for c in columns]).where(is_latin1(*map(F.col, columns)))
    out = cells.orderBy("_at").limit(limit) if limit is not None else cells
    return with_positions(out, "_at", "_no").select((F.col("_no") + 1).cast("string").alias("no"), *columns)


def with_positions(df: DataFrame, order: str, name: str = "_at") -> DataFrame:
    """The place (from 0) of each row by ``order``: ranges are sorted apart, and each adds the sizes of those before it.

    Ranges are cut at approximate quantiles of ``order`` (of keys that are no numbers: of a sample chosen by hash), so the
    cut of a row depends on its value alone and a task that runs again places it the same. Null keys come first.
    """
    kind = dict(df.dtypes)[order]
    if kind in ("int", "bigint", "double", "float", "smallint", "tinyint"):
        cuts = df.stat.approxQuantile(order, [i / RANGES for i in range(1, RANGES)], 0.001)
    else:
        every = max(1, df.count() // SAMPLED)
        seen = df.select(order).where(F.col(order).isNotNull() & (F.pmod(F.xxhash64(order), F.lit(every)) == 0)).distinct().limit(4 * SAMPLED).collect()
        keys = sorted(r[0] for r in seen)
        cuts = keys[:: max(1, len(keys) // RANGES)][1:]
    cuts = sorted(set(cuts))
    edge = F.array(*map(F.lit, cuts)) if cuts else F.array().cast(f"array<{kind}>")
    placed = df.withColumn("_range", F.when(F.col(order).isNull(), -1).otherwise(F.size(F.filter(edge, lambda e: e <= F.col(order)))))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_before")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return placed.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")

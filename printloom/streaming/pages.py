"""Extraction over streams of pages: files of whole pages arrive, rows leave.

Rows need their page only, so a batch of whole pages is extracted as a table is; numbers of rows that run on over pages
are given when the stream has ended. Counts of characters of whole documents are kept as a running sum.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from printloom.functions.text import hard
from printloom.layout import TableSpec
from printloom.operators.geometry import GLYPH_SCHEMA, PAGE, extract, number_rows, wide
from printloom.plans.stages import shared_folder


def as_files(glyphs: DataFrame) -> str:
    """Writes glyphs so that no page is divided between files; gives the folder."""
    path = f"{shared_folder(glyphs.sparkSession)}/pages-{uuid.uuid4().hex}"
    glyphs.repartition(*PAGE).write.parquet(path)
    return path


def read_pages(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(GLYPH_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def recover_stream(spark: SparkSession, path: str, spec: TableSpec, files_per_batch: int = 64) -> DataFrame:
    """All pages that are there now, a batch at a time: rows as :func:`printloom.operators.geometry.wide` gives them.

    A batch's rows go to a folder of its own, so a batch that runs again replaces itself.
    """
    out = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"

    def each(batch: DataFrame, number: int) -> None:
        extract(batch, spec).rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = read_pages(spark, path, files_per_batch).writeStream.foreachBatch(each).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    stream.awaitTermination()
    rows = spark.read.option("basePath", out).parquet(out).drop("batch", "row_no")
    sizes = rows.groupBy(*PAGE).agg(F.count("*").alias("n"))
    return wide(number_rows(rows, sizes), spec)


def character_counts(stream: DataFrame) -> DataFrame:
    """(doc_id, ch, n) of a stream of glyphs, as a running sum: for output mode update or complete."""
    return stream.select("doc_id", F.explode(F.split(hard(F.col("ch")), "")).alias("ch")).where("ch <> ''").groupBy("doc_id", "ch").agg(F.count("*").alias("n"))

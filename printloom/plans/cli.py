"""Command line: probe, recon, extract, verify. Ends with 1 where a check fails.

    python -m printloom.plans.cli extract FILES --spec layout.json --out DIR [--reference DIR] [--words FILE]
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from printloom.layout import TableSpec
from printloom.operators import bordered, conserve, geometry
from printloom.plans.recovery import Verified, recover
from printloom.sources import layouts, pdf, references, writers


def glyphs_of(spark: SparkSession, path: str) -> DataFrame:
    """Glyphs of PDF files, or of a table of glyphs."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else pdf.read_glyphs(spark, path)


def probe(spark: SparkSession, path: str) -> DataFrame:
    return bordered.probe(pdf.read_pages(spark, path), pdf.read_glyphs(spark, path), pdf.read_rules(spark, path))


def recon(spark: SparkSession, path: str, spec: TableSpec | None = None, pages: list[int] | None = None) -> DataFrame:
    """Objects of the given 0-based pages (negative: from the end); by default the first two and the last."""
    glyphs = glyphs_of(spark, path)
    last = glyphs.groupBy("doc_id").agg(F.max("page").alias("last"))
    wanted = F.array_distinct(F.transform(F.array(*map(F.lit, pages if pages is not None else [0, 1, -1])), lambda p: F.when(p < 0, F.col("last") + p + 1).otherwise(p + 1)))
    near = last.select("doc_id", F.explode(wanted).alias("page"))
    return geometry.recon(glyphs.join(near, ["doc_id", "page"], "left_semi"), spec)


def run_extract(spark: SparkSession, path: str, spec: TableSpec, out: str, reference: str | None = None, words: str | None = None) -> tuple[Verified, bool]:
    """Recovers all documents, writes each one's CSV, workbook and report, and reads the workbook back."""
    targets = None if reference is None else references.reference_files(spark, reference, spec.names)
    done = recover(glyphs_of(spark, path), spec, targets, references.dictionary(spark, words) if words else None)
    values, good = done.values, True
    for r in values.groupBy("doc_id").agg(F.count("*").alias("n")).toLocalIterator():
        own, doc = values.where(F.col("doc_id") == r["doc_id"]), r["doc_id"]
        writers.to_csv(own, spec, f"{out}/{doc}.csv")
        book = writers.to_xlsx(own, spec, f"{out}/{doc}.xlsx")
        good &= writers.verify_written(spark, book, own).isEmpty()
        at = lambda df: df.where(F.col("doc_id") == doc)  # noqa: B023, E731
        writers.report(f"{out}/{doc}.md", r["n"], spec, at(done.diffs), conserve.render_problems(at(done.row_problems)), at(done.repaired.log), at(done.repaired.completions))
    return done, good and done.whole_problems.isEmpty() and done.row_problems.isEmpty() and done.diffs.isEmpty()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="printloom", description=__doc__.splitlines()[0])
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("probe", "recon", "extract", "verify"):
        p = sub.add_parser(name)
        p.add_argument("files")
        if name == "recon":
            p.add_argument("--spec")
            p.add_argument("--pages", type=int, nargs="*")
        if name in ("extract", "verify"):
            p.add_argument("--spec", required=True)
            p.add_argument("--reference")
            p.add_argument("--words")
        if name == "extract":
            p.add_argument("--out", required=True)
        if name == "verify":
            p.add_argument("--workbook", help="a workbook of one document to hold against the fresh rows")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("printloom").getOrCreate()
    spec = layouts.load(a.spec) if getattr(a, "spec", None) else None
    if a.command == "probe":
        probe(spark, a.files).show(truncate=False)
        return 0
    if a.command == "recon":
        recon(spark, a.files, spec, a.pages).orderBy("doc_id", "page", "y", "line_no").show(1000, truncate=False)
        return 0
    if a.command == "extract":
        os.makedirs(a.out, exist_ok=True)
        done, good = run_extract(spark, a.files, spec, a.out, a.reference, a.words)
        print(done.text())
        return 0 if good else 1
    targets = None if a.reference is None else references.reference_files(spark, a.reference, spec.names)
    done = recover(glyphs_of(spark, a.files), spec, targets, references.dictionary(spark, a.words) if a.words else None)
    print(done.text())
    good = done.whole_problems.isEmpty() and done.row_problems.isEmpty() and done.diffs.isEmpty()
    if a.workbook:
        good &= writers.verify_written(spark, a.workbook, done.values).isEmpty()
    return 0 if good else 1


if __name__ == "__main__":
    sys.exit(main())

"""Recovered cells against a reference: at three strictness levels, classified, counted; and pairing by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from printloom.functions.text import MODES, hard, hard_key, mode, single_lead, strip_marks, text_or_empty

CELL = ["doc_id", "row_no", "col"]


def targets_long(targets: DataFrame) -> DataFrame:
    """(doc_id, row_no, values) as (doc_id, row_no, col, reference); rows may be of any length."""
    return targets.select("doc_id", "row_no", F.posexplode("values").alias("col", "reference"))


def aligned(cells: DataFrame, targets: DataFrame, start: int = 0) -> DataFrame:
    """Cells beside their reference by place; row i meets row i + start of the reference; cells without reference go."""
    moved = cells.withColumn("row_no", F.col("row_no") + start) if start else cells
    return moved.join(targets, CELL).select(*CELL, text_or_empty(F.col("value")).alias("candidate"), text_or_empty(F.col("reference")).alias("reference")).where("reference <> ''")


def compare(cells: DataFrame, targets: DataFrame, start: int = 0, how: str = "hard") -> DataFrame:
    """(doc_id, row_no, col, candidate, reference) of the cells that differ in a mode."""
    f = mode(how)
    return aligned(cells, targets, start).where(f(F.col("candidate")) != f(F.col("reference")))


def compare_all(cells: DataFrame, targets: DataFrame, start: int = 0) -> DataFrame:
    """The same for all modes at once, with the column ``mode``: one join, three tests."""
    differs = [F.when(f(F.col("candidate")) != f(F.col("reference")), F.lit(name)) for name, f in MODES.items()]
    both = aligned(cells, targets, start).withColumn("mode", F.explode(F.filter(F.array(*differs), lambda m: m.isNotNull())))
    return both.select("mode", *CELL, "candidate", "reference")


def unexpected(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells that hold text where the reference has none: no comparison looks at them."""
    return cells.join(targets, CELL).where((text_or_empty(F.col("reference")) == "") & (text_or_empty(F.col("value")) != "")).select(*CELL, F.col("value").alias("candidate"))


def kind_of(got: Column, ref: Column) -> Column:
    """Class of a difference; the first that fits."""
    g, r = hard(got), hard(ref)
    bare = strip_marks(got)
    return (
        F.when((bare != got) & (hard(bare) == r), "marker-corruption")
        .when(g == r, "presentation-only")
        .when(hard_key(got) == hard_key(ref), "text-layer-reordered")
        .when((g != "") & r.startswith(g), "candidate-truncated")
        .when((g != "") & g.startswith(r), "reference-truncated")
        .when((g != "") & (single_lead(g) == r), "overprint")
        .otherwise("content-difference")
    )


def note_of(kind: Column, got: Column, ref: Column) -> Column:
    less = F.length(hard(ref)) - F.length(hard(got))
    return (
        F.when(kind == "candidate-truncated", F.format_string("%d characters short", less))
        .when(kind == "reference-truncated", F.format_string("%d characters long", -less))
        .when(kind == "text-layer-reordered", F.lit("same characters in another order"))
        .when(kind == "marker-corruption", F.lit("leading mark differs"))
        .when(kind == "overprint", F.lit("leading character repeated"))
        .otherwise("")
    )


def classify(diffs: DataFrame) -> DataFrame:
    """Differences with their kind and a note."""
    got, ref = F.col("candidate"), F.col("reference")
    return diffs.withColumn("kind", kind_of(got, ref)).withColumn("note", note_of(F.col("kind"), got, ref))


def summarize(classified: DataFrame) -> DataFrame:
    """(kind, n) with a row ``total``."""
    return classified.rollup("kind").agg(F.count("*").alias("n")).select(F.coalesce("kind", F.lit("total")).alias("kind"), "n")


def pair_by_key(rows: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """(key, in_rows, in_reference): how often a key stands on either side; unpaired and repeated keys are so found."""
    left = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("a"))
    right = reference.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("b"))
    both = left.join(right.withColumnRenamed("key", "key_b"), F.col("key").eqNullSafe(F.col("key_b")), "full_outer")
    return both.select(F.coalesce("key", "key_b").alias("key"), F.coalesce("a", F.lit(0)).alias("in_rows"), F.coalesce("b", F.lit(0)).alias("in_reference"))


def unpaired(rows: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    return pair_by_key(rows, reference, key).where("in_rows = 0 OR in_reference = 0")


def readback(written: DataFrame, expected: DataFrame, how: str = "exact") -> DataFrame:
    """(row_no, col, expected, found) where a file read again differs from what was to be written; missing and extra cells too."""
    f = mode(how)
    both = expected.select("row_no", "col", F.col("value").alias("expected")).join(written.select("row_no", "col", F.col("value").alias("found")), ["row_no", "col"], "full_outer")
    return both.where(f(F.col("expected")) != f(F.col("found")))

"""Checks of recovered tables that need no reference, and hints for measuring a layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from printloom.functions.text import text_or_empty
from printloom.operators.geometry import PAGE, gap_clusters


def anchor_gaps(rows: DataFrame, key: str = "anchor", order: str = "row_no", doc: str = "doc_id") -> DataFrame:
    """(doc_id, row_no, anchor, before) where a numeric anchor does not follow the one before it."""
    w = Window.partitionBy(doc).orderBy(order)
    n = F.expr(f"try_cast({key} AS bigint)")
    seen = rows.select(doc, order, n.alias("anchor")).withColumn("before", F.lag("anchor").over(w))
    return seen.where("before IS NOT NULL AND (anchor IS NULL OR anchor <> before + 1)")


def repeated(rows: DataFrame, key: str = "anchor", doc: str = "doc_id") -> DataFrame:
    """(doc_id, key, n) of keys that stand more than once in a document."""
    return rows.groupBy(doc, F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def empty_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without text in any of the columns."""
    return table.where(F.greatest(*[F.length(text_or_empty(F.col(c))) for c in columns], F.lit(0)) == 0)


def ragged(rows: DataFrame, width: int, values: str = "values") -> DataFrame:
    """Rows of another number of cells."""
    return rows.where(F.size(values) != width)


def patterns(cells: DataFrame, rules: dict[str, str], name: str = "name", value: str = "value") -> DataFrame:
    """(.., rule) cells whose text does not match the expression given for their column; empty cells pass."""
    checked = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    rule = F.try_element_at(checked, F.col(name))
    bad = F.lit(False)
    for column, pattern in rules.items():
        bad = bad | ((F.col(name) == column) & (F.col(value) != "") & ~F.col(value).rlike(pattern))
    return cells.where(bad).withColumn("rule", rule)


def dependencies(table: DataFrame, given: str, then: str) -> DataFrame:
    """(given, n) where one value goes with more than one of another column: first pairs, then counts, so a hot value costs one row a partner."""
    pairs = table.select(F.col(given).alias("given"), F.col(then).alias("then")).distinct()
    return pairs.groupBy("given").agg(F.count("then").alias("n")).where("n > 1")


def watermarks(objects: DataFrame, least_pages: int = 2, wide: float = 2.5, advance: float = 4.0) -> DataFrame:
    """(doc_id, text, y, pages, spacing): the same text at the same height on several pages, or set too wide for its length."""
    squeezed = F.replace(F.col("text"), F.lit(" "), F.lit(""))
    own = objects.select("doc_id", "page", squeezed.alias("text"), F.round("y").alias("y"), ((F.col("x1") - F.col("x0")) / F.greatest(F.length("text"), F.lit(1))).alias("step")).where("text <> ''")
    seen = own.groupBy("doc_id", "text", "y").agg(F.countDistinct("page").alias("pages"), F.round(F.max("step"), 2).alias("spacing"))
    return seen.where((F.col("pages") >= least_pages) | (F.col("spacing") > wide * advance))


def column_edges(objects: DataFrame, gap: float = 6.0, least: int = 2) -> DataFrame:
    """(doc_id, edge, left, n): clusters of the left ends of objects, where columns are likely to begin."""
    ends = objects.groupBy("doc_id", "x0").agg(F.count("*").alias("n"))
    found = gap_clusters(ends, ["doc_id"], "x0", gap, name="edge").groupBy("doc_id", "edge").agg(F.min("x0").alias("left"), F.sum("n").alias("n"))
    return found.where(F.col("n") >= least)


def trailing_blocks(table: DataFrame, columns: list[str], factor: float = 3.0) -> DataFrame:
    """(doc_id, row_no, length, usual): last rows of a document so long that text below the table may have joined them; never merged."""
    size = sum((F.length(text_or_empty(F.col(c))) for c in columns), F.lit(0))
    own = table.select("doc_id", "row_no", size.alias("length"))
    sums = own.groupBy("doc_id").agg(F.avg("length").alias("usual"), F.max_by("length", "row_no").alias("length"), F.max("row_no").alias("row_no"))
    return sums.where(F.col("length") > factor * F.col("usual")).select("doc_id", "row_no", "length", "usual")


def placeholders(cells: DataFrame) -> DataFrame:
    """Cells of nothing but #: the value is not on the page."""
    return cells.where(F.col("value").rlike("^#+$"))


__all__ = ["PAGE", "anchor_gaps", "column_edges", "dependencies", "empty_rows", "patterns", "placeholders", "ragged", "repeated", "trailing_blocks", "watermarks"]

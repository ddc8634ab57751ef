"""Character conservation: what a page holds against what the rows hold, as multisets, without any reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from printloom.functions.text import WS, hard
from printloom.layout import TableSpec

BAND = ["doc_id", "page", "band"]


def exploded(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, ch, n): characters of the hard form of a text column, counted."""
    return df.select(*keys, F.explode(F.split(hard(F.col(text)), "")).alias("ch")).where("ch <> ''").groupBy(*keys, "ch").agg(F.count("*").alias("n"))


def page_counts(chars: DataFrame, spec: TableSpec) -> DataFrame:
    """(doc_id, page, band, ch, n) of the page: all characters of the band's objects but white space and the anchor column's.

    Characters outside all columns count: they are evidence, too.
    """
    kept = chars.where((F.col("col") != spec.anchor.column) & ~F.col("ch").rlike(f"^[{WS}]$"))
    return exploded(kept, BAND, "ch")


def row_counts(cells: DataFrame, rows: DataFrame, spec: TableSpec) -> DataFrame:
    """(doc_id, page, band, row_no, ch, n) of the rows' cells, the anchor's left out."""
    placed = cells.where(F.col("col") != spec.anchor.column).join(rows.select(*BAND, "row_no"), ["doc_id", "row_no"])
    return exploded(placed, [*BAND, "row_no"], "value")


def by_row(pages: DataFrame, cells: DataFrame, rows: DataFrame, spec: TableSpec, allow_extra: DataFrame | None = None, allow_missing: DataFrame | None = None) -> DataFrame:
    """(doc_id, row_no, ch, extra, missing) where a row and its band do not hold the same characters.

    ``allow_extra`` and ``allow_missing`` name rows (doc_id, row_no) whose surplus or lack is expected.
    """
    own = row_counts(cells, rows, spec).drop("row_no")
    both = own.withColumnRenamed("n", "a").join(pages.withColumnRenamed("n", "b"), [*BAND, "ch"], "full_outer").join(rows.select(*BAND, "row_no"), BAND)
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    out = both.select("doc_id", "row_no", "ch", F.greatest(a - b, F.lit(0)).alias("extra"), F.greatest(b - a, F.lit(0)).alias("missing"))
    for allowed, name in ((allow_extra, "extra"), (allow_missing, "missing")):
        if allowed is not None:
            mark = allowed.select("doc_id", "row_no").distinct().withColumn("_ok", F.lit(True))
            out = out.join(mark, ["doc_id", "row_no"], "left").withColumn(name, F.when(F.col("_ok"), 0).otherwise(F.col(name))).drop("_ok")
    return out.where("extra > 0 OR missing > 0")


def by_anchor(pages: DataFrame, cells: DataFrame, rows: DataFrame, spec: TableSpec) -> DataFrame:
    """The same with bands pooled by the anchor's value: for documents whose numbers do not repeat."""
    named = pages.join(rows.select(*BAND, "anchor"), BAND).groupBy("doc_id", "anchor", "ch").agg(F.sum("n").alias("b"))
    own = row_counts(cells, rows, spec).join(rows.select("doc_id", "row_no", "anchor"), ["doc_id", "row_no"]).select("doc_id", "row_no", "anchor", "ch", F.col("n").alias("a"))
    every = rows.select("doc_id", "row_no", "anchor").join(named.select("doc_id", "anchor", "ch", "b"), ["doc_id", "anchor"])
    both = every.join(own, ["doc_id", "row_no", "anchor", "ch"], "full_outer")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return both.select("doc_id", "row_no", "ch", F.greatest(a - b, F.lit(0)).alias("extra"), F.greatest(b - a, F.lit(0)).alias("missing")).where("extra > 0 OR missing > 0")


def whole(pages: DataFrame, cells: DataFrame, spec: TableSpec) -> DataFrame:
    """(doc_id, ch, extra, missing) over each document."""
    a = exploded(cells.where(F.col("col") != spec.anchor.column), ["doc_id"], "value").withColumnRenamed("n", "a")
    b = pages.groupBy("doc_id", "ch").agg(F.sum("n").alias("b"))
    return difference(a, b, ["doc_id", "ch"])


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset differences both ways of (keys, a) and (keys, b)."""
    x, y = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, F.greatest(x - y, F.lit(0)).alias("extra"), F.greatest(y - x, F.lit(0)).alias("missing")).where("extra > 0 OR missing > 0")


def margins(chars: DataFrame, spec: TableSpec) -> DataFrame:
    """(doc_id, margin_chars, spilled_chars): characters outside all columns, and those in the anchor column of other objects."""
    ink = chars.where(~F.col("ch").rlike(f"^[{WS}]$"))
    return ink.groupBy("doc_id").agg(F.sum((F.col("col") < 0).cast("long")).alias("margin_chars"), F.sum(((F.col("col") == spec.anchor.column) & ~F.col("is_anchor")).cast("long")).alias("spilled_chars"))


def render_problems(problems: DataFrame, limit: int = 10) -> str:
    """The first problems as lines of text, and how many rows more there are."""
    texts = problems.groupBy("doc_id", "row_no").agg(F.sort_array(F.collect_list(F.struct("ch", "extra", "missing"))).alias("p"))
    rows = texts.orderBy("doc_id", "row_no").limit(limit + 1).collect()
    out = []
    for r in rows[:limit]:
        parts = [f"{sign}{p['ch']!r} x {p[name]}" for p in r["p"] for sign, name in (("+", "extra"), ("-", "missing")) if p[name]]
        out.append(f"{r['doc_id']} row {r['row_no']}: {', '.join(parts)}")
    return "\n".join([*out, "..."] if len(rows) > limit else out) or "OK"

"""Tables with ruled grids: found from their rules, and the probe that tells ruled documents from others.

The grid finder is our own: rules are snapped to lines, rules of a page that lie together make a table, distinct lines
of both directions cut it into cells, and a character belongs to the cell that holds its centre.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from printloom.functions.text import soft
from printloom.operators.geometry import PAGE, gap_clusters

#: Points within which lines are one line, least length and most thickness of a rule, distance that parts tables.
SNAP, MIN_LENGTH, MAX_THICKNESS, APART = 2.0, 8.0, 1.5, 24.0
#: Pages probed from the start, and the share of ruled pages that makes a document ruled.
PROBE_PAGES, MIN_RATIO = 3, 0.6


def lines(drawings: DataFrame) -> DataFrame:
    """Rules as lines: (doc_id, page, way, at, start, end), way h or v."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    across = F.when((h <= MAX_THICKNESS) & (w >= MIN_LENGTH), F.struct(F.lit("h").alias("way"), ((F.col("y0") + F.col("y1")) / 2).alias("at"), F.col("x0").alias("start"), F.col("x1").alias("end")))
    down = F.when((w <= MAX_THICKNESS) & (h >= MIN_LENGTH), F.struct(F.lit("v").alias("way"), ((F.col("x0") + F.col("x1")) / 2).alias("at"), F.col("y0").alias("start"), F.col("y1").alias("end")))
    return drawings.select(*PAGE, F.explode(F.filter(F.array(across, down), lambda x: x.isNotNull())).alias("l")).select(*PAGE, "l.*")


def grids(drawings: DataFrame) -> DataFrame:
    """(doc_id, page, table_index, ys, xs): distinct lines of each table, ascending; two at least of each direction."""
    own = lines(drawings).repartition(*PAGE)
    top = F.when(F.col("way") == "h", F.col("at")).otherwise(F.col("start"))
    bottom = F.when(F.col("way") == "h", F.col("at")).otherwise(F.col("end"))
    placed = own.withColumn("top", top).withColumn("bottom", bottom)
    # tables lie below one another: a new one starts where nothing above reaches
    order = Window.partitionBy(*PAGE).orderBy("top", "bottom", "way", "at", "start")
    reach = F.max("bottom").over(order.rowsBetween(Window.unboundedPreceding, -1))
    tabled = placed.withColumn("_new", F.when(F.col("top") - reach > APART, 1).otherwise(0)).withColumn("table_index", F.sum("_new").over(order).cast("int"))
    snapped = gap_clusters(tabled, [*PAGE, "table_index", "way"], "at", SNAP, "start", name="line")
    distinct = snapped.groupBy(*PAGE, "table_index", "way", "line").agg(F.min("at").alias("at"))
    both = distinct.groupBy(*PAGE, "table_index").agg(F.array_sort(F.collect_list(F.when(F.col("way") == "h", F.col("at")))).alias("ys"), F.array_sort(F.collect_list(F.when(F.col("way") == "v", F.col("at")))).alias("xs"))
    return both.where((F.size("ys") >= 2) & (F.size("xs") >= 2))


def slot(edges: Column, x: Column) -> Column:
    """Index of the interval of ascending edges that holds x, or -1."""
    k = F.size(F.filter(edges, lambda e: e <= x)) - 1
    return F.when(k.between(0, F.size(edges) - 2), k).otherwise(-1)


def grid_cells(glyphs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, page, table_index, row, col, text) of all cells, empty ones too."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = glyphs.join(found, PAGE).withColumn("row", slot(F.col("ys"), cy)).withColumn("col", slot(F.col("xs"), cx)).where("row >= 0 AND col >= 0")
    key = [*PAGE, "table_index", "row", "col"]
    line = inside.groupBy(*key, "line_no", "line_y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(cx.alias("cx"), "seq", "ch"))), lambda c: c["ch"]), "").alias("t"))
    texts = line.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_y", "line_no", "t"))), lambda x: x["t"]), "\n").alias("text"))
    every = found.select(*PAGE, "table_index", F.explode(F.sequence(F.lit(0), F.size("ys") - 2)).alias("row"), "xs").select(*PAGE, "table_index", "row", F.explode(F.sequence(F.lit(0), F.size("xs") - 2)).alias("col"))
    return every.join(texts, key, "left").select(*key, F.coalesce("text", F.lit("")).alias("text"))


def bordered_tables(glyphs: DataFrame, drawings: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """(doc_id, page, table_index, n_rows, n_cols, rows) of every table with text in it; rows is an array of arrays of texts."""
    if pages is not None:
        drawings = drawings.where(F.col("page").isin([p + 1 for p in pages]))
    cells = grid_cells(glyphs, grids(drawings))
    row = cells.groupBy(*PAGE, "table_index", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]).alias("cells"))
    table = row.groupBy(*PAGE, "table_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"]).alias("rows"))
    full = table.where(F.exists("rows", lambda r: F.exists(r, lambda t: soft(t) != "")))
    return full.select(*PAGE, "table_index", F.size("rows").alias("n_rows"), F.size(F.get("rows", F.lit(0))).alias("n_cols"), "rows")


def probe(pages: DataFrame, glyphs: DataFrame, drawings: DataFrame, probe_pages: int = PROBE_PAGES, min_ratio: float = MIN_RATIO) -> DataFrame:
    """(doc_id, strategy, pages_probed, pages_with_tables, rows_seen, reason) of each document.

    ``pages`` has doc_id and n_pages. The first pages and, of longer documents, the last are looked at.
    """
    first = F.sequence(F.lit(1), F.least(F.lit(probe_pages), "n_pages"))
    wanted = F.when(F.col("n_pages") > probe_pages, F.concat(first, F.array("n_pages"))).when(F.col("n_pages") > 0, first).otherwise(F.array().cast("array<int>"))
    asked = pages.select("doc_id", F.col("n_pages").cast("int").alias("n_pages")).select("doc_id", F.explode_outer(wanted).alias("page"))
    near = asked.where("page IS NOT NULL")
    tables = bordered_tables(glyphs.join(near, PAGE, "left_semi"), drawings.join(near, PAGE, "left_semi")).groupBy(*PAGE).agg(F.max("n_rows").alias("n_rows"))
    seen = asked.join(tables, PAGE, "left").groupBy("doc_id").agg(F.count("page").alias("pages_probed"), F.count("n_rows").alias("pages_with_tables"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows_seen"))
    strategy = F.when(F.col("pages_probed") == 0, "unknown").when(F.col("pages_with_tables") >= min_ratio * F.col("pages_probed"), "bordered").otherwise("borderless")
    reason = F.when(F.col("pages_probed") == 0, "no pages").otherwise(F.format_string("%d of %d probed pages hold a ruled table, %d rows in all", "pages_with_tables", "pages_probed", "rows_seen"))
    return seen.select("doc_id", strategy.alias("strategy"), "pages_probed", "pages_with_tables", "rows_seen", reason.alias("reason"))

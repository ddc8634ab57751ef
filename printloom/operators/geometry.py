"""From characters with coordinates to rows of cells.

All steps are keyed by document and page, so one exchange by that pair serves the whole chain; a page is the most that
one task needs at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from printloom.functions.text import join_pieces, strip
from printloom.layout import CLIP, OVERLAP, STRADDLE, TableSpec

PAGE = ["doc_id", "page"]
OBJECT = [*PAGE, "line_no"]
GLYPH_SCHEMA = "doc_id string, page int, line_no int, seq int, ch string, x0 double, y0 double, x1 double, y1 double, line_y double"
PIECE = "struct<page:int,y:double,origin:int,text:string>"


def ordered_text(value: str, *order: str) -> Column:
    """Aggregate: the values put end to end in the given order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda s: s["_v"]), "")


def page_glyphs(glyphs: DataFrame, spec: TableSpec, pages: list[int] | None = None) -> DataFrame:
    """Characters without header and footer, of the given 0-based pages, together by page."""
    out = glyphs
    if pages is not None:
        out = out.where(F.col("page").isin([p + 1 for p in pages]))
    top = spec.page.top(F.col("page"))
    if top is not None:
        out = out.where(~F.coalesce(F.col("y0") <= top, F.lit(False)))
    if spec.page.footer_bottom is not None:
        out = out.where(F.col("line_y") <= spec.page.footer_bottom)
    return out.repartition(*PAGE)


def anchor_token(c: Column, spec: TableSpec) -> Column:
    """What a character is to the anchor: a digit, a #, nothing (a space), or X, which ends it."""
    near = (c["x0"] + c["x1"]) / 2 < spec.anchor.max_x
    return F.when(c["ch"] == " ", "").when(near & c["ch"].rlike("^[0-9#]$"), c["ch"]).otherwise("X")


def anchor_text(tokens: Column, spec: TableSpec) -> Column:
    """The anchor's text from its tokens in order of x: digits without leading zeros, the placeholder, or null."""
    run = F.regexp_extract(tokens, "^([0-9]+|#+)", 1)
    digits = F.when(F.length(run).between(spec.anchor.min_digits, spec.anchor.max_digits), F.regexp_replace(run, "^0+(?=[0-9])", ""))
    return F.when(run.startswith("#"), F.lit(spec.anchor.placeholder)).when(run != "", digits)


def objects(glyphs: DataFrame, spec: TableSpec) -> DataFrame:
    """One row per text object: y, characters and text in stream order, extent, anchor; watermarks are dropped."""
    chars = F.array_sort(F.collect_list(F.struct("seq", "ch", "x0", "x1"))).alias("chars")
    out = glyphs.groupBy(*OBJECT).agg(F.min("line_y").alias("y"), chars, F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    out = out.withColumn("text", F.array_join(F.transform("chars", lambda c: c["ch"]), ""))
    if spec.page.watermarks:
        out = out.where(~F.replace(F.col("text"), F.lit(" "), F.lit("")).isin(sorted(spec.page.watermarks)))
    by_x = F.array_sort(F.transform("chars", lambda c: F.struct(c["x0"].alias("x0"), c["seq"].alias("seq"), anchor_token(c, spec).alias("t"))))
    return out.withColumn("anchor", anchor_text(F.array_join(F.transform(by_x, lambda c: c["t"]), ""), spec))


def banded(objs: DataFrame) -> DataFrame:
    """Objects with the band they fall into; pages without an anchor are dropped.

    Bands are cut at the midpoints of neighbouring anchors; an object's band is the number of midpoints at or above
    it. Midpoints run along with the objects, so a running sum over a range of y finds that number without a join.
    """
    is_anchor = F.col("anchor").isNotNull()
    row = Window.partitionBy(*PAGE, is_anchor).orderBy("y", "line_no")
    page = Window.partitionBy(*PAGE)
    marked = objs.withColumn("rank", F.when(is_anchor, F.row_number().over(row) - 1)).withColumn("middle", F.when(is_anchor, (F.col("y") + F.lead("y").over(row)) / 2))
    counted = marked.withColumn("n_anchors", F.count("anchor").over(page)).where("n_anchors > 0")
    two = F.array(F.struct(F.col("y").alias("at"), F.lit(0).alias("cut")), F.struct(F.col("middle").alias("at"), F.lit(1).alias("cut")))
    points = counted.withColumn("point", F.explode(F.filter(two, lambda p: p["at"].isNotNull())))
    upto = Window.partitionBy(*PAGE).orderBy("point.at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return points.withColumn("band", F.sum("point.cut").over(upto).cast("int")).where("point.cut = 0").drop("point", "middle", "n_anchors")


def characters(bands: DataFrame, spec: TableSpec) -> DataFrame:
    """Characters with band and column; those outside all columns have column -1.

    Each anchor adds one row without a character (ch is null) to the band that it owns, so that rows without text stay.
    """
    none = F.array().cast("array<struct<seq:int,ch:string,x0:double,x1:double>>")
    own = F.struct(F.col("band").alias("band"), F.col("chars").alias("chars"), F.lit(None).cast("string").alias("anchor"))
    named = F.when(F.col("anchor").isNotNull(), F.struct(F.col("rank").cast("int").alias("band"), none.alias("chars"), F.col("anchor").alias("anchor")))
    placed = bands.select(*OBJECT, "y", F.col("anchor").isNotNull().alias("is_anchor"), F.explode(F.filter(F.array(own, named), lambda x: x.isNotNull())).alias("e"))
    each = placed.select(*OBJECT, "y", "is_anchor", "e.band", "e.anchor", F.explode_outer("e.chars").alias("c"))
    cx = (F.col("c.x0") + F.col("c.x1")) / 2
    return each.select(*OBJECT, "y", "is_anchor", "band", "anchor", "c.seq", "c.ch", "c.x0", "c.x1", cx.alias("cx"), spec.column_of(cx).alias("col"))


def fragments(chars: DataFrame, spec: TableSpec) -> DataFrame:
    """Runs of characters of one object in one column: text by x, extent, and the flags that they raise."""
    inner = list(enumerate(spec.edges))[1:-1]
    edges = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(e).alias("e")) for i, e in inner]) if inner else F.array().cast("array<struct<i:int,e:double>>")
    # characters outside all columns do not end a run: they are numbered apart
    part = [*OBJECT, "band", F.col("col") >= 0]
    stream = Window.partitionBy(*part).orderBy("seq")
    crossed = F.transform(F.filter(edges, lambda b: (F.col("x0") < b["e"] - STRADDLE) & (F.col("x1") > b["e"] + STRADDLE)), lambda b: b["i"])
    runs = chars.withColumn("changed", F.when(F.lag("col").over(stream) == F.col("col"), 0).otherwise(1)).withColumn("run", F.sum("changed").over(stream))
    by_x = Window.partitionBy(*part, "run").orderBy("cx", "seq")
    marked = runs.withColumn("overlaps", F.col("x0") < F.lag("x1").over(by_x) - OVERLAP).withColumn("crossed", crossed)
    out = marked.groupBy(*OBJECT, "band", "col", "run").agg(
        F.first("y").alias("y"), F.first("is_anchor").alias("is_anchor"), F.max("anchor").alias("anchor"),
        strip(ordered_text("ch", "cx", "seq")).alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        F.max(F.coalesce("overlaps", F.lit(False))).alias("overlap"), F.flatten(F.collect_set(F.when(F.col("col") >= 0, F.col("crossed")))).alias("crossed"),
    )
    right = F.element_at(F.array(*map(F.lit, spec.edges)), F.col("col") + 2)
    clip = (F.col("col") < spec.n - 1) & (F.col("x1") >= right - CLIP)
    spilled = (F.col("col") == spec.anchor.column) & ~F.col("is_anchor")
    target = F.when((F.col("text") == "") | (F.col("col") < 0), F.lit(-1)).when(spilled, F.lit(-1 if spec.anchor.spill_column is None else spec.anchor.spill_column)).otherwise(F.col("col"))
    return out.withColumn("clip", clip).withColumn("target", target)


def flags(frags: DataFrame) -> DataFrame:
    """(doc_id, page, band, flag, idx): boundaries straddled, columns clipped, columns with overlapping characters."""
    full = (F.col("text") != "") & (F.col("col") >= 0)
    one = F.concat(
        F.transform(F.col("crossed"), lambda i: F.struct(F.lit("boundary").alias("flag"), i.alias("idx"))),
        F.when(full & F.col("clip"), F.array(F.struct(F.lit("clip").alias("flag"), F.col("col").alias("idx")))).otherwise(F.array().cast("array<struct<flag:string,idx:int>>")),
        F.when(full & F.col("overlap"), F.array(F.struct(F.lit("overlap").alias("flag"), F.col("col").alias("idx")))).otherwise(F.array().cast("array<struct<flag:string,idx:int>>")),
    )
    return frags.select(*PAGE, "band", F.explode(one).alias("f")).select(*PAGE, "band", "f.flag", "f.idx").distinct()


def gap_clusters(df: DataFrame, keys: list[str], at: str, gap: float | Column, *ties: str, name: str = "cluster") -> DataFrame:
    """Numbers (from 0) of chained clusters along ``at``: a step of more than ``gap`` from the one before begins a new one."""
    order = Window.partitionBy(*keys).orderBy(at, *ties)
    new = F.when(F.col(at) - F.lag(at).over(order) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(order).cast("int")).drop("_new")


def sublines(frags: DataFrame, spec: TableSpec) -> DataFrame:
    """(doc_id, page, band, col, k, y, text): the lines of each cell, from its fragments.

    Column -1 gathers what is in no cell; anchor and crossed boundaries of all fragments are carried along.
    """
    own = frags.drop("col").withColumnRenamed("target", "col")
    cell = [*PAGE, "band", "col"]
    grouped = gap_clusters(own, cell, "y", spec.page.subline_gap, "x0", "line_no", "run", name="k")
    return grouped.groupBy(*cell, "k").agg(F.min("y").alias("y"), strip(ordered_text("text", "x0", "y", "line_no", "run")).alias("text"), F.max("anchor").alias("anchor"), F.flatten(F.collect_list("crossed")).alias("crossed"))


@dataclass
class Extraction:
    """rows: doc_id, page, band, row_no, anchor, c0.. (arrays of pieces), boundaries (array of int)."""

    rows: DataFrame
    chars: DataFrame
    flags: DataFrame
    sublines: DataFrame
    spec: TableSpec

    def cells(self) -> DataFrame:
        return cells(self.rows, self.spec)

    def table(self) -> DataFrame:
        return wide(self.rows, self.spec)


def number_rows(rows: DataFrame, sizes: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """row_no from 1 in each document: pages in order (of the given list), bands within them.

    Only counts per page are summed up along a document, never its rows.
    """
    turn = F.col("page") if pages is None else F.array_position(F.array(*[F.lit(p + 1) for p in pages]), F.col("page"))
    before = Window.partitionBy("doc_id").orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(*PAGE, "before")
    return rows.join(offset, PAGE).withColumn("row_no", (F.col("before") + F.col("band") + 1).cast("long")).drop("before")


def extract(glyphs: DataFrame, spec: TableSpec, pages: list[int] | None = None) -> Extraction:
    """All logical rows of all documents that share a layout."""
    g = page_glyphs(glyphs, spec, pages)
    bands = banded(objects(g, spec))
    chars = characters(bands, spec)
    frags = fragments(chars, spec)
    lines = sublines(frags, spec)
    own = [*PAGE, "band"]
    piece = F.struct("k", F.struct("page", "y", F.lit(0).alias("origin"), "text").alias("p"))
    per = [F.transform(F.array_sort(F.collect_list(F.when(F.col("col") == i, piece))), lambda s: s["p"]).alias(f"c{i}") for i in range(spec.n)]
    rows = lines.groupBy(*own).agg(F.max("anchor").alias("anchor"), *per, F.array_sort(F.array_distinct(F.flatten(F.collect_list("crossed")))).alias("boundaries")).where("anchor IS NOT NULL")
    sizes = bands.where("anchor IS NOT NULL").groupBy(*PAGE).agg(F.count("*").alias("n"))
    placed = number_rows(rows, sizes, pages)
    filled = [F.transform(F.col(f"c{i}"), lambda p: F.struct(p["page"].alias("page"), p["y"].alias("y"), F.col("row_no").cast("int").alias("origin"), p["text"].alias("text"))).alias(f"c{i}") for i in range(spec.n)]
    real = lines.where("col >= 0").drop("anchor", "crossed")
    return Extraction(placed.select(*own, "row_no", "anchor", *filled, "boundaries"), chars.where("ch IS NOT NULL"), flags(frags), real, spec)


def value(spec: TableSpec, i: int) -> Column:
    """The text of column i of a row of pieces; the anchor column is the anchor."""
    if i == spec.anchor.column:
        return F.col("anchor")
    return join_pieces(F.transform(F.col(f"c{i}"), lambda p: p["text"]), spec.columns[i].kind)


def wide(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """doc_id, row_no and one text column for each column of the layout."""
    return rows.select("doc_id", "row_no", *[value(spec, i).alias(c.name) for i, c in enumerate(spec.columns)])


def cells(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """(doc_id, row_no, col, value)."""
    every = F.array(*[F.struct(F.lit(i).alias("col"), value(spec, i).alias("value")) for i in range(spec.n)])
    return rows.select("doc_id", "row_no", F.explode(every).alias("c")).select("doc_id", "row_no", "c.col", "c.value")


def row_values(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """(doc_id, row_no, values): each row as an array of texts."""
    return rows.select("doc_id", "row_no", F.array(*[value(spec, i) for i in range(spec.n)]).alias("values"))


def rules(drawings: DataFrame, least_width: float = 100.0, most_height: float = 1.5, first: int = 12) -> DataFrame:
    """Of each page, the y (to a tenth) of the first distinct horizontal rules."""
    y = drawings.where((F.col("x1") - F.col("x0") > least_width) & (F.col("y1") - F.col("y0") < most_height)).select(*PAGE, F.round("y0", 1).alias("y")).distinct()
    turn = Window.partitionBy(*PAGE).orderBy("y")
    return y.withColumn("n", F.row_number().over(turn)).where(F.col("n") <= first)


def recon(glyphs: DataFrame, spec: TableSpec | None = None) -> DataFrame:
    """Objects in order of y with their extent: what a person needs to measure a layout. With a layout, furniture is left out."""
    if spec is not None:
        return objects(page_glyphs(glyphs, spec), spec).select(*PAGE, "line_no", "y", "x0", "x1", "text", "anchor")
    return glyphs.groupBy(*OBJECT).agg(F.min("line_y").alias("y"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), ordered_text("ch", "seq").alias("text"), F.lit(None).cast("string").alias("anchor")).select(*PAGE, "line_no", "y", "x0", "x1", "text", "anchor")


def crop(glyphs: DataFrame, page: int, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Characters whose centre lies in a rectangle of a page: the evidence that a rendered crop would show."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return glyphs.where((F.col("page") == page) & cx.between(x0, x1) & cy.between(y0, y1))

"""Prints a table as characters with coordinates, with planted defects: where tests get their pages.

All lengths are multiples of a quarter of a point, so places are exact in binary.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from printloom.functions.text import lead_identifier, text_or_empty, tokens
from printloom.functions.typography import fixed_width, text_width, wrap_chars
from printloom.layout import AnchorSpec, Column, PageSpec, TableSpec
from printloom.sources.references import with_positions

#: Kinds of defects and how many of each a plan has by default.
DEFECTS = {"split_word": 3, "swallow_space": 3, "double_space": 3, "hyphen_wrap": 2, "interleave": 2, "overflow": 2, "placeholder": 2}


@dataclass(frozen=True)
class PrintColumn:
    name: str
    kind: str
    chars: int


@dataclass(frozen=True)
class ExportLayout:
    columns: tuple[PrintColumn, ...]
    margin: float = 20.0
    advance: float = 4.0
    rows_per_page: int = 40
    first_y: float = 76.0
    pitch: float = 16.0
    wrap_gap: float = 3.5
    interleave_gap: float = 10.0
    header: str | None = "EXPORT"
    footer: str | None = "PAGE FOOTER"
    watermark: str | None = None
    merged: frozenset[int] = field(default_factory=frozenset)  # columns printed in one object with the column before

    def width(self, i: int) -> float:
        return self.columns[i].chars * self.advance + 2

    def left(self, i: int) -> float:
        return self.margin + sum(self.width(k) for k in range(i))

    @property
    def right_edge(self) -> float:
        return self.left(len(self.columns))

    @property
    def footer_y(self) -> float:
        return self.first_y + (self.rows_per_page + 1) * self.pitch


def spec_for(layout: ExportLayout, anchor_column: int = 0, max_digits: int = 9) -> TableSpec:
    """The layout that recovers what this one prints: anchors lie left of the second column, stray anchor text is dropped."""
    columns = tuple(Column(c.name, layout.left(i), c.kind) for i, c in enumerate(layout.columns))
    marks = frozenset({layout.watermark.replace(" ", "")} if layout.watermark else ())
    page = PageSpec(data_top=layout.first_y - 30, footer_bottom=layout.footer_y - 4, watermarks=marks)
    max_x = layout.left(1) if len(columns) > 1 else layout.right_edge
    return TableSpec(columns, layout.right_edge, AnchorSpec(anchor_column, max_x, max_digits=max_digits, spill_column=None), page)


def plan_widths(df: DataFrame, names: list[str], share: float = 0.95, size: float = 7.5, measure: Callable[[Expr], Expr] | None = None) -> DataFrame:
    """(name, width, kind) of columns: the width that holds this share of the cells, and `en` where a value has a space or none is filled."""
    measure = measure or (lambda x: text_width(x, size))
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), text_or_empty(F.col(n).cast("string")).alias("value")) for n in names])).alias("c")).select("c.name", "c.value")
    sized = stacked.withColumn("width", measure(F.col("value"))).groupBy("name", "width").agg(F.count("*").alias("n"), F.max(F.col("value").contains(" ")).alias("spaced"), F.max(F.col("value") != "").alias("filled"))
    upto = Window.partitionBy("name").orderBy("width")
    whole = Window.partitionBy("name")
    placed = sized.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))
    at = F.least(F.floor(F.col("total") * share), F.col("total") - 1)
    held = F.min(F.when(F.col("upto") > at, F.col("width"))).alias("width")
    return placed.groupBy("name").agg(held, F.when(F.max("spaced") | ~F.max("filled"), "en").otherwise("code").alias("kind"))


def numbered(df: DataFrame, doc: Expr | str, *order: str) -> DataFrame:
    """Adds doc_id and rn, the place (from 0) of a row in its document.

    A text names one document for the whole table: its rows are placed by ranges of the first key, so they never meet in
    one task. Documents given by an expression are sorted one by one.
    """
    if isinstance(doc, str) and len(order) == 1:
        return with_positions(df, order[0], "rn").withColumn("doc_id", F.lit(doc)).withColumn("rn", F.col("rn").cast("int"))
    doc = F.lit(doc) if isinstance(doc, str) else doc
    return df.withColumn("doc_id", doc.cast("string")).withColumn("rn", (F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1).cast("int"))


def as_cells(rows: DataFrame, layout: ExportLayout, names: list[str]) -> DataFrame:
    """(doc_id, rn, values): the row number, then the named columns as text."""
    return rows.select("doc_id", "rn", F.array((F.col("rn") + 1).cast("string"), *[text_or_empty(F.col(n).cast("string")) for n in names]).alias("values"))


def applies(kind: str, layout: ExportLayout, i: int, v: Expr, after: Expr | None) -> Expr:
    """Can this defect be planted in column i, given its value and that of the next column?"""
    col = layout.columns[i]
    words = tokens(v)
    if i == 0 or kind in ("split_word", "swallow_space", "double_space", "interleave", "hyphen_wrap") and col.kind != "en":
        return F.lit(False)
    if kind == "split_word":
        return F.element_at(words, 1).rlike("^[A-Za-z]{6,}$") & (F.size(words) >= 1) & (F.length(v) <= col.chars)
    if kind == "swallow_space":
        return (F.size(words) >= 2) & F.get(words, F.lit(0)).rlike("^[A-Za-z]{4,}$") & F.get(words, F.lit(1)).rlike("^[A-Za-z]{4,}$")
    if kind == "double_space":
        return (F.size(words) >= 2) & (F.length(v) < col.chars)
    if kind == "hyphen_wrap":
        return v.rlike("^[^ ]*[A-Za-z]-[A-Za-z]")
    if kind == "interleave":
        return (F.size(words) >= 2) & (F.length(v) <= col.chars)
    if kind == "overflow":
        return F.lit(False) if after is None else (after == "") & v.rlike("[^ A-Za-z0-9][A-Za-z][A-Za-z0-9]*$")
    return v != ""


def plan_defects(values: DataFrame, layout: ExportLayout, counts: dict[str, int] | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, rn, col, kind): at most one defect in three rows, so neighbours stay clean, up to the count of each kind.

    Places are chosen by hash. The first and the last row stay clean.
    """
    counts = DEFECTS if counts is None else counts
    if unknown := set(counts) - set(DEFECTS):
        raise ValueError(f"unknown defects: {', '.join(sorted(unknown))}")
    options = []
    for kind in (k for k in counts if counts[k] > 0):
        for i in range(len(layout.columns)):
            after = F.get("values", F.lit(i + 1)) if i + 1 < len(layout.columns) else None
            options.append(F.when(applies(kind, layout, i, F.get("values", F.lit(i)), after), F.struct(F.lit(i).alias("col"), F.lit(kind).alias("kind"))))
    if not options:
        return values.sparkSession.createDataFrame([], "doc_id string, rn int, col int, kind string")
    last = F.max("rn").over(Window.partitionBy("doc_id"))
    found = values.withColumn("last", last).where((F.col("rn") % 3 == 1) & (F.col("rn") < F.col("last"))).select("doc_id", "rn", F.explode(F.filter(F.array(*options), lambda o: o.isNotNull())).alias("o")).select("doc_id", "rn", "o.col", "o.kind")
    hashed = found.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "rn", "col", "kind"))
    # rows take the kinds in turn, and the next that fits where the one in turn does not
    kinds = [k for k in counts if counts[k] > 0]
    place = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(F.lit(seed), "rn"), "rn"))
    in_turn = F.pmod(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")) - F.col("place"), F.lit(len(kinds)))
    one = hashed.withColumn("place", place).withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "rn").orderBy(in_turn, "h"))).where("turn = 1")
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col("kind"))
    return one.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("h"))).where(F.col("turn") <= limit).select("doc_id", "rn", "col", "kind")


def printed_lines(v: Expr, kind: Expr, chars: int) -> Expr:
    """The lines of a cell, as its defect (or none) has them printed."""
    words = tokens(v)
    first = F.get(words, F.lit(0))
    rest = F.array_join(F.slice(words, 2, F.size(words)), " ")
    plain = wrap_chars(v, chars)
    cut = lambda n: F.array(F.substring(first, 1, n), F.concat(F.substring(first, F.lit(n + 1), F.length(first)), F.when(rest != "", F.concat(F.lit(" "), rest)).otherwise("")))
    swallowed = F.array(F.substring(v, F.lit(1), F.length(first) - 1), F.concat(F.substring(first, -1, 1), rest))
    hyphen = F.instr(v, "-")
    return (
        F.when(kind == "split_word", cut(4))
        .when(kind == "swallow_space", swallowed)
        .when(kind == "double_space", F.array(F.concat_ws("  ", first, rest)))
        .when(kind == "hyphen_wrap", F.array(F.substring(v, F.lit(1), hyphen), F.substring(v, hyphen + 1, F.length(v))))
        .when(kind == "interleave", F.array(first, rest))
        .when(kind == "overflow", F.array(v))
        .when(kind == "placeholder", F.array(F.lit("####")))
        .otherwise(plain)
    )


def render(values: DataFrame, layout: ExportLayout, defects: DataFrame | None = None) -> DataFrame:
    """Glyphs of rows of values: pages of rows_per_page rows, lines of a cell below each other, furniture on every page."""
    rows = values
    if defects is not None:
        own = defects.groupBy("doc_id", "rn").agg(F.first("col").alias("d_col"), F.first("kind").alias("d_kind"))
        rows = rows.join(own, ["doc_id", "rn"], "left")
    else:
        rows = rows.withColumn("d_col", F.lit(None).cast("int")).withColumn("d_kind", F.lit(None).cast("string"))
    per = []
    for i, c in enumerate(layout.columns):
        kind = F.when(F.col("d_col") == i, F.col("d_kind"))
        v = F.get("values", F.lit(i))
        lines = printed_lines(v, F.coalesce(kind, F.lit("")), c.chars)
        gap = F.when(kind == "interleave", layout.interleave_gap).otherwise(layout.wrap_gap)
        # text that overflows is pushed right until its last word lies beyond the edge, its first character across it
        over = F.length(v) - F.length(lead_identifier(F.reverse(F.regexp_extract(F.reverse(v), "^([A-Za-z0-9]*[A-Za-z])", 1))))
        shift = F.when(kind == "overflow", F.lit(layout.width(i) - 2) - over * layout.advance).otherwise(F.lit(0.0))
        obj = i
        while obj in layout.merged:
            obj -= 1
        per.append(F.struct(F.lit(i).alias("col"), F.lit(obj).alias("obj"), F.lit(layout.left(i) + 1).alias("left"), lines.alias("lines"), gap.alias("gap"), shift.alias("shift")))
    n = layout.rows_per_page
    cells = rows.select("doc_id", (F.floor(F.col("rn") / n) + 1).cast("int").alias("page"), (F.col("rn") % n).alias("at"), F.explode(F.array(*per)).alias("c"))
    lines = cells.select("doc_id", "page", "at", "c.*", F.posexplode("c.lines").alias("k", "line")).where("line <> ''")
    y = F.lit(layout.first_y) + F.col("at") * F.lit(layout.pitch) + F.col("k") * F.col("gap")
    placed = lines.select("doc_id", "page", (F.col("at") * 10000 + F.col("obj") * 100 + F.col("k")).cast("int").alias("line_no"), "col", (F.col("left") + F.col("shift")).alias("left"), y.alias("line_y"), F.posexplode(F.split("line", "")).alias("i", "ch")).where("ch <> ''")
    x0 = F.col("left") + F.col("i") * F.lit(layout.advance)
    glyph = placed.select("doc_id", "page", "line_no", (F.col("col") * 1000 + F.col("i")).cast("int").alias("seq"), "ch", x0.alias("x0"), F.col("line_y").alias("y0"), (x0 + layout.advance).alias("x1"), (F.col("line_y") + 3).alias("y1"), "line_y")
    return glyph.union(furniture(rows, layout))


def furniture(rows: DataFrame, layout: ExportLayout) -> DataFrame:
    """Header, footer and watermark of every page."""
    texts = [(layout.header, layout.first_y - 50, 4.0, 900_000), (layout.footer, layout.footer_y, 4.0, 900_001), (layout.watermark, layout.first_y + 2.25, 20.0, 900_002)]
    items = [F.struct(F.lit(t).alias("text"), F.lit(y).alias("y"), F.lit(step).alias("step"), F.lit(no).alias("no")) for t, y, step, no in texts if t]
    if not items:
        items = [F.struct(F.lit("").alias("text"), F.lit(0.0).alias("y"), F.lit(4.0).alias("step"), F.lit(900_000).alias("no"))]
    pages = rows.groupBy("doc_id").agg(F.max("rn").alias("last")).select("doc_id", F.explode(F.sequence(F.lit(1), (F.floor(F.col("last") / layout.rows_per_page) + 1).cast("int"))).alias("page"))
    each = pages.select("doc_id", "page", F.explode(F.array(*items)).alias("f")).select("doc_id", "page", "f.*")
    chars = each.select("doc_id", "page", F.col("no").alias("line_no"), "y", "step", F.posexplode(F.split("text", "")).alias("i", "ch")).where("ch <> ''")
    x0 = F.lit(layout.margin + 1) + F.col("i") * F.col("step")
    return chars.select("doc_id", "page", "line_no", F.col("i").cast("int").alias("seq"), "ch", x0.alias("x0"), F.col("y").alias("y0"), (x0 + 4.0).alias("x1"), (F.col("y") + 3).alias("y1"), F.col("y").alias("line_y"))


def ruled(rows: DataFrame, layout: ExportLayout) -> DataFrame:
    """Rules (doc_id, page, x0, y0, x1, y1) of a full grid around the rows of every page."""
    sizes = rows.select("doc_id", (F.floor(F.col("rn") / layout.rows_per_page) + 1).cast("int").alias("page")).groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    left, right = layout.margin, layout.right_edge
    top = F.lit(layout.first_y - 2)
    across = F.transform(F.sequence(F.lit(0), F.col("n").cast("int")), lambda k: F.struct(F.lit(left).alias("x0"), (top + k * layout.pitch).alias("y0"), F.lit(right).alias("x1"), (top + k * layout.pitch + 0.5).alias("y1")))
    bottom = top + F.col("n") * layout.pitch
    down = F.array(*[F.struct(F.lit(x).alias("x0"), top.alias("y0"), F.lit(x + 0.5).alias("x1"), bottom.alias("y1")) for x in [*(layout.left(i) for i in range(len(layout.columns))), right]])
    return sizes.select("doc_id", "page", F.explode(F.concat(across, down)).alias("r")).select("doc_id", "page", "r.*")


def ground_truth(values: DataFrame) -> DataFrame:
    """(doc_id, row_no, values) with white space collapsed: what a perfect recovery gives."""
    from printloom.functions.text import soft

    return values.select("doc_id", (F.col("rn") + 1).cast("long").alias("row_no"), F.transform("values", soft).alias("values"))


def representable(values: DataFrame) -> DataFrame:
    """Rows whose characters all belong to Latin-1."""
    return values.where(F.forall("values", lambda v: ~v.rlike(r"[^\x{0}-\x{ff}]")))


__all__ = ["DEFECTS", "ExportLayout", "PrintColumn", "applies", "as_cells", "fixed_width", "furniture", "ground_truth", "numbered", "plan_defects", "plan_widths", "render", "representable", "ruled", "spec_for"]

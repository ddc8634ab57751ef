"""Whole queries: print a table, recover it, repair it, prove it; and the same for given pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from printloom.layout import TableSpec
from printloom.operators import compare, conserve
from printloom.operators.geometry import cells, extract, row_values
from printloom.operators.repair import Repaired, repair
from printloom.operators.typeset import ExportLayout, as_cells, numbered, render, spec_for
from printloom.plans.stages import stored


def printed(df: DataFrame, doc: Column | str, order: str, names: list[str], layout: ExportLayout) -> DataFrame:
    """(doc_id, rn, values) of a table as the typesetter takes it: a running number, then the named columns."""
    return as_cells(numbered(df, doc, order), layout, names)


def round_trip(df: DataFrame, doc: Column | str, order: str, names: list[str], layout: ExportLayout, pages: list[int] | None = None) -> DataFrame:
    """The table as recovered from its printed pages: doc_id, row_no and all columns of the layout as text."""
    glyphs = render(printed(df, doc, order, names, layout), layout)
    return extract(glyphs, spec_for(layout), pages).table()


@dataclass
class Verified:
    """Rows after repair with the evidence about them."""

    rows: DataFrame
    spec: TableSpec
    repaired: Repaired
    diffs: DataFrame
    row_problems: DataFrame
    whole_problems: DataFrame
    matched: bool

    @property
    def values(self) -> DataFrame:
        return row_values(self.rows, self.spec)

    def summary(self) -> DataFrame:
        """One row: rows, differences, rows with problems, whether the documents balance, whether a reference was used."""
        one = self.rows.agg(F.count("*").alias("rows"))
        diffs = self.diffs.agg(F.count("*").alias("differences"))
        problems = self.row_problems.agg(F.countDistinct("doc_id", "row_no").alias("rows_with_problems"))
        whole = self.whole_problems.agg((F.count("*") == 0).alias("balanced"))
        key = F.lit(1).alias("_k")
        out = one.select(key, "*")
        for part in (diffs, problems, whole):
            out = out.join(part.select(key, "*"), "_k")
        return out.drop("_k").withColumn("reference_used", F.lit(self.matched))

    def text(self, limit: int = 10) -> str:
        s = self.summary().first()
        lines = [f"rows {s['rows']}, differences {s['differences']}, rows with unexplained characters {s['rows_with_problems']}", f"documents balance: {'yes' if s['balanced'] else 'no'}", conserve.render_problems(self.row_problems, limit)]
        return "\n".join(lines)


def recover(glyphs: DataFrame, spec: TableSpec, targets: DataFrame | None = None, dictionary: DataFrame | None = None, pages: list[int] | None = None) -> Verified:
    """Extract, repair, compare and prove. Where a document has another number of rows than its reference, the reference is not used for it.

    ``matched`` says whether all documents used theirs.
    """
    x = extract(glyphs, spec, pages)
    rows = stored(x.rows)
    matched = targets is not None
    if targets is not None:
        sizes = rows.groupBy("doc_id").agg(F.count("*").alias("n")).join(targets.groupBy("doc_id").agg(F.count("*").alias("m")), "doc_id", "full_outer")
        apart = stored(sizes.where("NOT (n <=> m)").select("doc_id"))
        matched = apart.isEmpty()
        targets = targets if matched else targets.join(apart, "doc_id", "left_anti")
    fixed = repair(rows, spec, targets, dictionary)
    after = cells(fixed.rows, spec)
    evidence = conserve.page_counts(x.chars, spec)
    allowed = fixed.expected_exceptions if targets is not None else None
    problems = conserve.by_row(evidence, after, rows, spec, allowed, allowed)
    if targets is None:
        diffs = glyphs.sparkSession.createDataFrame([], "doc_id string, row_no long, col int, candidate string, reference string, kind string, note string")
    else:
        diffs = compare.classify(compare.compare(after, compare.targets_long(targets)))
    return Verified(fixed.rows, spec, fixed, stored(diffs), stored(problems), stored(conserve.whole(evidence, after, spec)), matched)

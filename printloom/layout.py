"""Layouts: where the columns of a printed table are, how its rows are anchored, what is page furniture."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column as Expr
from pyspark.sql import functions as F

from printloom.functions.text import KINDS

#: Tolerances of the flags, in points, and the limits of repairs.
STRADDLE, OVERLAP, CLIP = 0.05, 0.3, 0.45
MAX_COMPLETION, MAX_POOL, MAX_WINDOW = 14, 24, 5


@dataclass(frozen=True)
class Column:
    name: str
    left: float
    kind: str = "en"

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"column {self.name!r}: kind {self.kind!r} is none of {', '.join(KINDS)}")


@dataclass(frozen=True)
class AnchorSpec:
    column: int = 0
    max_x: float = 60.0
    min_digits: int = 1
    max_digits: int = 5
    placeholder: str = "####"
    spill_column: int | None = 1


@dataclass(frozen=True)
class PageSpec:
    data_top: float | None = None
    first_page_data_top: float | None = None
    footer_bottom: float | None = None
    watermarks: frozenset[str] = field(default_factory=frozenset)
    subline_gap: float = 1.2

    def top(self, page: Expr) -> Expr | None:
        """The cut-off above which characters are furniture, for a 1-based page; None if there is none."""
        if self.first_page_data_top is None:
            return None if self.data_top is None else F.lit(self.data_top)
        other = F.lit(self.data_top).cast("double")
        return F.when(page == 1, F.lit(self.first_page_data_top)).otherwise(other)


@dataclass(frozen=True)
class TableSpec:
    columns: tuple[Column, ...]
    right_edge: float
    anchor: AnchorSpec = field(default_factory=AnchorSpec)
    page: PageSpec = field(default_factory=PageSpec)

    def __post_init__(self):
        lefts = [c.left for c in self.columns]
        if not lefts:
            raise ValueError("a table needs a column")
        if any(b <= a for a, b in zip(lefts, lefts[1:])):
            raise ValueError("left edges must ascend")
        if self.right_edge <= lefts[-1]:
            raise ValueError("the right edge must lie beyond the last left edge")
        if not 0 <= self.anchor.column < len(lefts):
            raise ValueError("the anchor is in none of the columns")

    @property
    def n(self) -> int:
        return len(self.columns)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def edges(self) -> list[float]:
        return [*(c.left for c in self.columns), self.right_edge]

    def column_of(self, cx: Expr) -> Expr:
        """The column whose half-open interval holds a centre, or -1."""
        out = F.when(cx.isNull() | (cx < self.edges[0]) | (cx >= self.right_edge), F.lit(-1))
        for i, edge in enumerate(self.edges[1:]):
            out = out.when(cx < edge, F.lit(i))
        return out.otherwise(F.lit(-1))

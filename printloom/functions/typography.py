"""Widths and wrapping, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Advance widths of the standard sans-serif face in thousandths of the size, by the characters that share one.
ADVANCES = {
    191: "'",
    222: "ijl",
    260: "|",
    278: " !,./:;I[\\]ft",
    333: "()-`r",
    334: "{}",
    355: '"',
    389: "*",
    469: "^",
    500: "Jckvxyzs",
    556: "#$0123456789?L_abdeghnopqu",
    584: "+<=>~",
    611: "FTZ",
    667: "&ABEKPSVXY",
    722: "CDHNRUw",
    778: "GOQ",
    833: "Mm",
    889: "%",
    944: "W",
    1015: "@",
}
#: Of any other character.
OTHER_ADVANCE = 556


def advance_map() -> dict[str, int]:
    return {c: w for w, chars in ADVANCES.items() for c in chars}


def text_width(x: Column, size: float) -> Column:
    """Width in points of a text set in the sans-serif face."""
    table = F.create_map(*[F.lit(v) for c, w in advance_map().items() for v in (c, w)])
    total = F.aggregate(F.filter(F.split(F.coalesce(x, F.lit("")), ""), lambda c: c != ""), F.lit(0), lambda acc, c: acc + F.coalesce(F.try_element_at(table, c), F.lit(OTHER_ADVANCE)))
    return total * F.lit(size / 1000)


def fixed_width(advance: float):
    """A measure for a face whose characters all have one width."""
    return lambda x: F.length(x) * F.lit(advance)


def cut_token(x: Column, most: int) -> Column:
    """A token as pieces of at most ``most`` characters."""
    n = F.length(x)
    return F.when(n <= most, F.array(x)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / most).cast("int")), lambda i: F.substring(x, i * most + 1, F.lit(most))))


def wrap_chars(x: Column, most: int) -> Column:
    """Greedy wrap at words into lines of at most ``most`` characters; longer words are cut; an empty text is one empty line."""
    pieces = F.flatten(F.transform(F.filter(F.split(F.coalesce(x, F.lit("")), " "), lambda t: t != ""), lambda t: cut_token(t, most)))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(s: Column, t: Column) -> Column:
        fits = F.length(s["line"]) + 1 + F.length(t) <= most
        return (
            F.when(s["line"] == "", F.struct(s["done"].alias("done"), t.alias("line")))
            .when(fits, F.struct(s["done"].alias("done"), F.concat(s["line"], F.lit(" "), t).alias("line")))
            .otherwise(F.struct(F.concat(s["done"], F.array(s["line"])).alias("done"), t.alias("line")))
        )

    end = F.aggregate(pieces, start, step)
    return F.concat(end["done"], F.array(end["line"]))


def wrap_points(x: Column, width: float, size: float) -> Column:
    """The same by width in points, in the sans-serif face; words too wide are cut where the next character would not fit."""
    fits = lambda t: text_width(t, size) <= width
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def letters(s: Column, c: Column) -> Column:
        grown = F.concat(s["line"], c)
        return F.when((s["line"] == "") | fits(grown), F.struct(s["done"].alias("done"), grown.alias("line"))).otherwise(F.struct(F.concat(s["done"], F.array(s["line"])).alias("done"), c.alias("line")))

    def cut(t: Column) -> Column:
        end = F.aggregate(F.split(t, ""), start, letters)
        return F.when(fits(t), F.array(t)).otherwise(F.concat(end["done"], F.array(end["line"])))

    def step(s: Column, t: Column) -> Column:
        grown = F.concat(s["line"], F.lit(" "), t)
        return (
            F.when(s["line"] == "", F.struct(s["done"].alias("done"), t.alias("line")))
            .when(fits(grown), F.struct(s["done"].alias("done"), grown.alias("line")))
            .otherwise(F.struct(F.concat(s["done"], F.array(s["line"])).alias("done"), t.alias("line")))
        )

    pieces = F.flatten(F.transform(F.filter(F.split(F.coalesce(x, F.lit("")), " "), lambda t: t != ""), cut))
    end = F.aggregate(pieces, start, step)
    return F.concat(end["done"], F.array(end["line"]))

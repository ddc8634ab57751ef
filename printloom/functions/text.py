"""Text as Column functions: normalisers for comparison, white space, CJK, letters, joins of wrapped pieces.

White space is one explicit class everywhere, because engines disagree on theirs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as a class of regular expressions.
WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What a content comparison ignores besides case.
NOISE = WS + r"\-_/\\()（）\[\]【】{},，.。:：;；°º′″'\"·•|"
#: CJK ideographs, CJK punctuation, full-width forms.
CJK = r"\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}"
#: What a damaged leading mark is read as.
MARKS = "0Oo。º°·"

KINDS = ("code", "cjk", "en", "digit")


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{WS}]+|[{WS}]+$", "")


def exact(x: Column) -> Column:
    """The text itself; null is empty."""
    return text_or_empty(x)


def soft(x: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text_or_empty(x), f"[{WS}]+", " "))


def hard(x: Column) -> Column:
    """Upper case without the noise class."""
    return F.regexp_replace(F.upper(text_or_empty(x)), f"[{NOISE}]+", "")


def hard_key(x: Column) -> Column:
    """The characters of the hard form in order of their code."""
    return F.array_join(F.array_sort(F.split(hard(x), "")), "")


#: Comparison modes, weakest first.
MODES: dict[str, Callable[[Column], Column]] = {"hard": hard, "soft": soft, "exact": exact}


def mode(name: str) -> Callable[[Column], Column]:
    if name not in MODES:
        raise ValueError(f"unknown mode {name!r}: one of {', '.join(MODES)}")
    return MODES[name]


def is_cjk(x: Column) -> Column:
    """Does the text begin with a CJK character? (Empty: no.)"""
    return text_or_empty(x).rlike(f"^[{CJK}]")


def strip_marks(x: Column) -> Column:
    """Without a damaged mark and the white space before it."""
    return F.regexp_replace(x, f"^[{WS}]*[{MARKS}]+", "")


def single_lead(x: Column) -> Column:
    """A leading run of one character as that character once."""
    first = F.substring(x, 1, 1)
    return F.when(F.length(x) > 0, F.concat(first, F.ltrim(x, first))).otherwise(x)


def tail_letters(x: Column) -> Column:
    return F.regexp_extract(x, "([A-Za-z]+)$", 1)


def head_letters(x: Column) -> Column:
    return F.regexp_extract(x, "^([A-Za-z]+)", 1)


def lead_identifier(x: Column) -> Column:
    return F.regexp_extract(x, "^([A-Za-z][A-Za-z0-9]*)", 1)


def tokens(x: Column) -> Column:
    """White-space separated words; none for an empty text."""
    return F.filter(F.split(soft(x), " "), lambda t: t != "")


def is_latin1(*cells: Column) -> Column:
    """Do all cells hold Latin-1 characters only?"""
    out = F.lit(True)
    for c in cells:
        out = out & ~text_or_empty(c).rlike(r"[^\x{0}-\x{ff}]")
    return out


def seam(kind: str, left: Column, right: Column) -> Column:
    """What is put between two pieces, by the last character of one and the first of the other."""
    last, first = F.right(left, F.lit(1)), F.substring(right, 1, 1)
    if kind == "code":
        return F.lit("")
    if kind == "cjk":
        return F.when(is_cjk(last) & is_cjk(first), "").otherwise(" ")
    if kind == "digit":
        return F.when(is_cjk(last) | is_cjk(first) | (last.rlike("^[0-9]$") & first.rlike("^[0-9]$")), "").otherwise(" ")
    if kind == "en":
        return F.when(last == "-", "").otherwise(" ")
    raise ValueError(f"unknown kind {kind!r}")


def join_pieces(texts: Column, kind: str) -> Column:
    """An array of pieces as one text: empty ones dropped, seams by kind."""
    full = F.filter(texts, lambda t: F.length(t) > 0)
    return F.aggregate(full, F.lit(""), lambda acc, t: F.when(acc == "", t).otherwise(F.concat(acc, seam(kind, acc, t), t)))


def collapse_cjk(x: Column) -> Column:
    """Without single spaces between CJK characters or hyphens."""
    return F.regexp_replace(x, f"(?<=[{CJK}-]) (?=[{CJK}-])", "")

import pytest
from pyspark.sql import functions as F

from printloom.functions import text as X
from printloom.functions.typography import text_width, wrap_chars, wrap_points


def values(spark, rows, expr, schema="a string, b string"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def one(spark, x, f):
    return spark.createDataFrame([(x,)], "a string").select(f(F.col("a"))).first()[0]


@pytest.mark.parametrize("kind, pieces, joined", [
    ("code", ["PZ.10.10.", "03"], "PZ.10.10.03"),
    ("cjk", ["山地植物志", "图鉴汇编"], "山地植物志图鉴汇编"),
    ("cjk", ["山地", "A"], "山地 A"),
    ("en", ["BOREAL", "ECOLOGY"], "BOREAL ECOLOGY"),
    ("en", ["FIELD-", "GUIDE"], "FIELD-GUIDE"),
    ("en", ["ALPINE", "生态学"], "ALPINE 生态学"),
    ("digit", ["19", "70"], "1970"),
    ("digit", ["PZ10A+", "Z"], "PZ10A+ Z"),
    ("digit", ["A", "年"], "A年"),
    ("en", ["", "A", "", "B"], "A B"),
    ("en", [], ""),
])
def test_pieces_are_joined_by_kind(spark, kind, pieces, joined):
    df = spark.createDataFrame([(pieces,)], "p array<string>")
    assert df.select(X.join_pieces(F.col("p"), kind)).first()[0] == joined


def test_unknown_kinds_and_modes_are_refused(spark):
    with pytest.raises(ValueError):
        X.seam("x", F.lit("a"), F.lit("b"))
    with pytest.raises(ValueError):
        X.mode("soften")


def test_hard_ignores_notation_and_case(spark):
    assert one(spark, "PZ.10.10", X.hard) == "PZ1010"
    assert one(spark, "fi eld-guide", X.hard) == "FIELDGUIDE"
    assert one(spark, "Straße 5°", X.hard) == "STRASSE5"
    assert one(spark, None, X.hard) == ""


def test_soft_keeps_words_apart(spark):
    assert one(spark, "MANUSCRIP T", X.soft) != one(spark, "MANUSCRIPT", X.soft)
    assert one(spark, " ATLAS  　 OF\t", X.soft) == "ATLAS OF"


def test_white_space_is_pythons(spark):
    points = [c for c in map(chr, range(0x3100)) if c.isspace()]
    got = spark.createDataFrame([(c,) for c in points], "a string").where(~F.col("a").rlike(f"^[{X.WS}]$")).count()
    assert got == 0 and len(points) == 29


def test_cjk_and_marks(spark):
    assert [one(spark, x, X.is_cjk) for x in ("山", "A", "", None, "、", "Ａ")] == [True, False, False, False, True, True]
    assert one(spark, " °0植物志", X.strip_marks) == "植物志"
    assert [one(spark, x, X.single_lead) for x in ("WWW20", "A", "", "ABB")] == ["W20", "A", "", "ABB"]


def test_cjk_spaces_collapse_singly(spark):
    assert one(spark, "山 川 水 - 火 A 木", X.collapse_cjk) == "山川水-火 A 木"
    assert one(spark, "山  川", X.collapse_cjk) == "山  川"


def test_letters(spark):
    assert one(spark, "a-TCOLL", X.tail_letters) == "TCOLL" and one(spark, "COLL2x", X.head_letters) == "COLL"
    assert one(spark, "AB12-x", X.lead_identifier) == "AB12" and one(spark, "1AB", X.lead_identifier) == ""


def test_representable(spark):
    assert values(spark, [("é", "ß"), ("中", ""), (None, "x")], X.is_latin1(F.col("a"), F.col("b"))) == [True, False, True]


def test_wrapping(spark):
    assert one(spark, "one two three", lambda x: wrap_chars(x, 7)) == ["one two", "three"]
    assert one(spark, "abcdefghij k", lambda x: wrap_chars(x, 4)) == ["abcd", "efgh", "ij k"]
    assert one(spark, "", lambda x: wrap_chars(x, 4)) == [""]
    assert one(spark, "A" * 10, lambda x: wrap_points(x, 3 * 0.667 * 10 + 0.01, 10.0)) == ["AAA", "AAA", "AAA", "A"]
    assert one(spark, "iiii WW", lambda x: wrap_points(x, 20.0, 10.0)) == ["iiii WW"] or one(spark, "iiii WW", lambda x: wrap_points(x, 20.0, 10.0)) == ["iiii", "WW"]
    assert abs(one(spark, "Ai ", lambda x: text_width(x, 10.0)) - (6.67 + 2.22 + 2.78)) < 1e-9

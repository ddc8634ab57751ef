"""An invented catalogue of 60 rows in six columns of all kinds, printed with one defect of each kind that can be repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from printloom.operators.typeset import ExportLayout, PrintColumn, render, spec_for
from printloom.plans.recovery import Verified, recover

ROWS = 60
LAYOUT = ExportLayout(
    (PrintColumn("no", "code", 5), PrintColumn("title_cn", "cjk", 8), PrintColumn("title_en", "en", 40), PrintColumn("subject_cn", "cjk", 10), PrintColumn("call_code", "code", 12), PrintColumn("year", "digit", 6)),
    watermark="S P E C I M E N",
)
TITLES = ("山地植物", "河川地図", "海洋魚類", "森林鳥類", "高原昆虫", "沙漠岩石", "草原気候")
SUBJECTS = ("MEADOWLARK", "SANDSTONE", "WATERSHED", "FIELD-GUIDE", "HEATHLAND")
TOPICS = ("HANDBOOK", "INVENTORY", "PORTRAITS", "CHRONICLE")
REGIONS = ("NORTHERN", "EASTERN", "COASTAL")
FIELDS = ("植物", "地理", "動物", "気象", "地質")
#: Row (from 0), column and kind.
PLANTED = ((4, 2, "split_word"), (7, 2, "swallow_space"), (13, 2, "hyphen_wrap"), (18, 3, "overflow"), (24, 2, "double_space"), (30, 2, "interleave"))


def _of(items: tuple[str, ...], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, items)), (i % len(items)).cast("int"))


def values(spark: SparkSession) -> DataFrame:
    """(doc_id, rn, values) of the catalogue."""
    i = F.col("id")
    english = F.concat(_of(SUBJECTS, i), F.lit(" "), _of(TOPICS, 3 * i), F.lit(" OF THE "), _of(REGIONS, i))
    over = i == 18
    columns = [(i + 1).cast("string"), _of(TITLES, i), english, F.when(over, F.concat(_of(FIELDS, 3 * i), F.lit("AB3"))).otherwise(_of(FIELDS, 3 * i)), F.when(over, "").otherwise(F.format_string("PZ.%d.%d", i % 90 + 10, 7 * i % 90 + 10)), (1970 + 7 * i % 51).cast("string")]
    return spark.range(ROWS).select(F.lit("catalogue").alias("doc_id"), i.cast("int").alias("rn"), F.array(*columns).alias("values"))


def _list(items: tuple[str, ...], i: str) -> str:
    return f"[{', '.join(repr(x) for x in items)}][({i}) % {len(items)} + 1]"


SQL = f"""SELECT 'catalogue' AS doc_id, i + 1 AS row_no, CAST(i + 1 AS VARCHAR) AS no, {_list(TITLES, 'i')} AS title_cn, {_list(SUBJECTS, 'i')} || ' ' || {_list(TOPICS, '3 * i')} || ' OF THE ' || {_list(REGIONS, 'i')} AS title_en,
 {_list(FIELDS, '3 * i')} || CASE WHEN i = 18 THEN 'AB3' ELSE '' END AS subject_cn, CASE WHEN i = 18 THEN '' ELSE 'PZ.' || (i % 90 + 10) || '.' || (7 * i % 90 + 10) END AS call_code, CAST(1970 + 7 * i % 51 AS VARCHAR) AS year FROM range(0, {ROWS}) t(i)"""


def recovered(spark: SparkSession) -> Verified:
    rows = values(spark)
    planted = spark.createDataFrame([("catalogue", *p) for p in PLANTED], "doc_id string, rn int, col int, kind string")
    words = spark.createDataFrame([(w.lower(),) for x in (*SUBJECTS, *TOPICS, *REGIONS) for w in x.split("-")], "word string")
    targets = rows.select("doc_id", (F.col("rn") + 1).cast("long").alias("row_no"), "values")
    return recover(render(rows, LAYOUT, planted), spec_for(LAYOUT), targets, words)

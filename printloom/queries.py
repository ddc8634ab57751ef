"""The queries of the engine's operators, and the same in SQL on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from printloom.functions import text as X
from printloom.functions.typography import ADVANCES, OTHER_ADVANCE, text_width, wrap_chars
from printloom.layout import Column, TableSpec
from printloom.operators import bordered, checks, compare, conserve, geometry, repair, typeset
from printloom.operators.typeset import ExportLayout, PrintColumn
from printloom.plans import catalogue
from printloom.plans.recovery import printed, recover, round_trip
from printloom.plans.stages import shared_folder, stored
from printloom.sources import layouts, references, writers
from printloom.streaming import pages as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL of the normalisers --------------------------------------------------------------------------------------------

_NOISE = X.NOISE.replace("'", "''")


def hard_sql(x: str) -> str:
    return f"regexp_replace(upper(replace(coalesce({x}, ''), 'ß', 'SS')), '[{_NOISE}]+', '', 'g')"


def soft_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[{X.WS}]+', ' ', 'g'))"


def key_sql(x: str) -> str:
    return f"coalesce(array_to_string(list_sort(string_split({hard_sql(x)}, '')), ''), '')"


# --- text ------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {hard_sql('text')} AS h FROM documents")
def hard_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.hard(F.col("text")).alias("h"))


@query(f"SELECT doc_id, {soft_sql(chr(39).join(['replace(text, ', 'e ', ', ', 'e  ', ' || chr(9))']))} AS s FROM documents")
def soft_normalise(spark, sf_dir):
    planted = F.replace(F.col("text"), F.lit("e "), F.lit("e  \t"))
    return table(spark, sf_dir, "documents").select("doc_id", X.soft(planted).alias("s"))


@query(f"SELECT item_id, {key_sql('text')} AS k FROM benchmark")
def hard_key(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.hard_key(F.col("text")).alias("k"))


@query("SELECT doc_id, doc_id % 7 = 0 AS cjk FROM documents")
def is_cjk_scan(spark, sf_dir):
    planted = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("山"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", X.is_cjk(planted).alias("cjk"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id % 7 <> 0")
def latin1_filter(spark, sf_dir):
    planted = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("図"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").withColumn("t", planted).where(X.is_latin1(F.col("t"))).select("doc_id", "n_chars")


@query("""SELECT p_partkey, ltrim(regexp_replace('0° ' || p_name, '^[0Oo。º°·]+', '')) AS bare, CASE WHEN length(p_name) > 0 THEN left(p_name, 1) || ltrim(p_name, left(p_name, 1)) END AS lead,
 regexp_extract(p_name, '([A-Za-z]+)$', 1) AS tail, regexp_extract(p_name, '^([A-Za-z]+)', 1) AS head, regexp_extract(p_brand, '^([A-Za-z][A-Za-z0-9]*)', 1) AS ident FROM part""")
def letter_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.col("p_name")
    return p.select("p_partkey", F.ltrim(X.strip_marks(F.concat(F.lit("0° "), name))).alias("bare"), X.single_lead(name).alias("lead"), X.tail_letters(name).alias("tail"), X.head_letters(name).alias("head"), X.lead_identifier(F.col("p_brand")).alias("ident"))


_WIDTHS = ", ".join(f"('{chr(39) * 2 if c == chr(39) else c}', {w})" for w, chars in ADVANCES.items() for c in chars)


@query(f"""WITH w(c, a) AS (VALUES {_WIDTHS}), chars AS (SELECT item_id, unnest(string_split(text, '')) AS c FROM benchmark)
SELECT item_id, CAST(sum(coalesce(a, {OTHER_ADVANCE})) AS DOUBLE) / 1000 * 8 AS width FROM chars LEFT JOIN w USING (c) GROUP BY item_id""")
def text_widths(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", (F.round(text_width(F.col("text"), 1000.0)) / 1000 * 8).alias("width"))


@query("""WITH RECURSIVE words AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS k FROM benchmark), 
full_words AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY k) AS k FROM words WHERE w <> ''),
walk AS (SELECT item_id, k, w AS line, CAST(0 AS BIGINT) AS n FROM full_words WHERE k = 1
 UNION ALL SELECT f.item_id, f.k, CASE WHEN length(walk.line) + 1 + length(f.w) <= 40 THEN walk.line || ' ' || f.w ELSE f.w END, CASE WHEN length(walk.line) + 1 + length(f.w) <= 40 THEN n ELSE n + 1 END FROM walk JOIN full_words f ON f.item_id = walk.item_id AND f.k = walk.k + 1)
SELECT item_id, CAST(n AS INTEGER) AS k, max_by(line, k) AS line FROM walk GROUP BY item_id, n""")
def wrapped_lines(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(wrap_chars(F.col("text"), 40)).alias("k", "line"))


def _pieces(spark, sf_dir):
    planted = F.replace(F.replace(F.replace(F.col("text"), F.lit("a.\n"), F.lit("a-\n")), F.lit("n.\n"), F.lit("n7\n3")), F.lit("s.\n"), F.lit("s山\n図"))
    return table(spark, sf_dir, "documents").select("doc_id", F.split(planted, "\n").alias("pieces"))


def _seam_sql(kind: str) -> str:
    last, first = "right(before, 1)", "left(p, 1)"
    cjk = lambda c: f"regexp_matches({c}, '^[{X.CJK}]')"
    sep = {
        "code": "''",
        "cjk": f"CASE WHEN {cjk(last)} AND {cjk(first)} THEN '' ELSE ' ' END",
        "en": f"CASE WHEN {last} = '-' THEN '' ELSE ' ' END",
        "digit": f"CASE WHEN {cjk(last)} OR {cjk(first)} OR (regexp_matches({last}, '^[0-9]$') AND regexp_matches({first}, '^[0-9]$')) THEN '' ELSE ' ' END",
    }[kind]
    planted = "replace(replace(replace(text, 'a.' || chr(10), 'a-' || chr(10)), 'n.' || chr(10), 'n7' || chr(10) || '3'), 's.' || chr(10), 's山' || chr(10) || '図')"
    return f"""WITH p AS (SELECT doc_id, unnest(string_split({planted}, chr(10))) AS p, generate_subscripts(string_split({planted}, chr(10)), 1) AS k FROM documents),
b AS (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM p WHERE p <> '')
SELECT doc_id, string_agg(CASE WHEN before IS NULL THEN '' ELSE {sep} END || p, '' ORDER BY k) AS joined FROM b GROUP BY doc_id"""


def _join_query(kind: str):
    def run(spark, sf_dir):
        return _pieces(spark, sf_dir).select("doc_id", X.join_pieces(F.col("pieces"), kind).alias("joined"))

    run.__name__ = f"join_sublines_{kind}"
    query(_seam_sql(kind))(run)


for _kind in X.KINDS:
    _join_query(_kind)


# --- comparison --------------------------------------------------------------------------------------------------------

_MUTATED = """CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, ' ', '  ') WHEN 3 THEN left(p_name, length(p_name) - 2) WHEN 4 THEN left(p_name, 1) || p_name
 WHEN 5 THEN reverse(p_name) WHEN 6 THEN '0 ' || p_name ELSE 'OMEGA' END"""
_REFERENCE = "CASE WHEN p_partkey % 8 = 6 THEN '° ' || p_name WHEN p_partkey % 80 = 7 THEN '' ELSE p_name END"


def _mutated(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lit("part").alias("doc_id"), (F.col("p_partkey") + 1).alias("row_no"), F.lit(0).alias("col"), F.expr(_MUTATED).alias("value"), F.expr(_REFERENCE).alias("reference"))
    return p.drop("reference"), p.drop("value")


_PAIRS = f"WITH d AS (SELECT 'part' AS doc_id, p_partkey + 1 AS row_no, 0 AS col, {_MUTATED} AS candidate, {_REFERENCE} AS reference FROM part)"


@query(f"""{_PAIRS} SELECT 'hard' AS mode, * FROM d WHERE reference <> '' AND {hard_sql('candidate')} <> {hard_sql('reference')}
UNION ALL SELECT 'soft', * FROM d WHERE reference <> '' AND {soft_sql('candidate')} <> {soft_sql('reference')} UNION ALL SELECT 'exact', * FROM d WHERE reference <> '' AND candidate <> reference""")
def compare_modes(spark, sf_dir):
    cells, targets = _mutated(spark, sf_dir)
    return compare.compare_all(cells, targets)


def _kind_sql() -> str:
    bare = f"regexp_replace(candidate, '^[{X.WS}]*[{X.MARKS}]+', '')"
    g, r = hard_sql("candidate"), hard_sql("reference")
    return f"""CASE WHEN {bare} <> candidate AND {hard_sql(bare)} = {r} THEN 'marker-corruption' WHEN {g} = {r} THEN 'presentation-only'
 WHEN {key_sql('candidate')} = {key_sql('reference')} THEN 'text-layer-reordered' WHEN {g} <> '' AND starts_with({r}, {g}) THEN 'candidate-truncated' WHEN {g} <> '' AND starts_with({g}, {r}) THEN 'reference-truncated'
 WHEN left({g}, 1) || ltrim({g}, left({g}, 1)) = {r} THEN 'overprint' ELSE 'content-difference' END"""


@query(f"{_PAIRS} SELECT doc_id, row_no, col, candidate, reference, {_kind_sql()} AS kind FROM d WHERE reference <> '' AND {hard_sql('candidate')} <> {hard_sql('reference')}")
def classify_diffs(spark, sf_dir):
    return compare.classify(compare.compare(*_mutated(spark, sf_dir))).drop("note")


@query(f"{_PAIRS}, k AS (SELECT {_kind_sql()} AS kind FROM d WHERE reference <> '' AND {hard_sql('candidate')} <> {hard_sql('reference')}) SELECT coalesce(kind, 'total') AS kind, count(*) AS n FROM k GROUP BY ROLLUP (kind)")
def summarise_diffs(spark, sf_dir):
    return compare.summarize(compare.classify(compare.compare(*_mutated(spark, sf_dir))))


@query(f"{_PAIRS} SELECT doc_id, row_no, col, candidate FROM d WHERE reference = '' AND candidate <> ''")
def unexpected_values(spark, sf_dir):
    return compare.unexpected(*_mutated(spark, sf_dir))


@query("""WITH a AS (SELECT o_custkey AS key, count(*) AS a FROM orders WHERE o_custkey % 11 <> 3 GROUP BY 1), b AS (SELECT c_custkey AS key, count(*) AS b FROM customer WHERE c_custkey % 13 <> 5 GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key, coalesce(a, 0) AS in_rows, coalesce(b, 0) AS in_reference FROM a FULL JOIN b ON a.key = b.key WHERE a IS NULL OR b IS NULL""")
def unpaired_rows(spark, sf_dir):
    return compare.unpaired(table(spark, sf_dir, "orders").where("o_custkey % 11 <> 3").withColumnRenamed("o_custkey", "key"), table(spark, sf_dir, "customer").where("c_custkey % 13 <> 5").withColumnRenamed("c_custkey", "key"), "key")


# --- conservation ------------------------------------------------------------------------------------------------------


@query(f"WITH c AS (SELECT doc_id, unnest(string_split({hard_sql('text')}, '')) AS ch FROM documents) SELECT doc_id, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY doc_id, ch")
def char_multiset(spark, sf_dir):
    return conserve.exploded(table(spark, sf_dir, "documents"), ["doc_id"], "text")


_COPY = "CASE doc_id % 3 WHEN 0 THEN substr(text, 3) WHEN 1 THEN text || 'zZ' ELSE text END"


def _conserved_sql(key: str) -> str:
    chars = lambda t, n: f"(SELECT {key}, ch, count(*) AS {n} FROM (SELECT {key}, unnest(string_split({hard_sql(t)}, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY {key}, ch)"
    return f"""SELECT * FROM (SELECT coalesce(x.{key}, y.{key}) AS {key}, coalesce(x.ch, y.ch) AS ch, greatest(coalesce(a, 0) - coalesce(b, 0), 0) AS extra, greatest(coalesce(b, 0) - coalesce(a, 0), 0) AS missing
FROM {chars(_COPY, 'a')} x FULL JOIN {chars('text', 'b')} y ON x.{key} = y.{key} AND x.ch = y.ch) WHERE extra > 0 OR missing > 0"""


def _conserved(spark, sf_dir, key):
    docs = table(spark, sf_dir, "documents")
    a = conserve.exploded(docs.withColumn("t", F.expr(_COPY)), [key], "t").withColumnRenamed("n", "a")
    b = conserve.exploded(docs, [key], "text").withColumnRenamed("n", "b")
    return conserve.difference(a, b, [key, "ch"])


@query(_conserved_sql("doc_id"))
def row_conservation(spark, sf_dir):
    return _conserved(spark, sf_dir, "doc_id")


@query(_conserved_sql("source"))
def doc_conservation(spark, sf_dir):
    return _conserved(spark, sf_dir, "source")


# --- repairs -----------------------------------------------------------------------------------------------------------


def _rows(df: DataFrame, values: list, boundaries=None) -> DataFrame:
    """Rows of pieces from (doc_id, row_no, ..): for each column an array expression of texts."""
    piece = lambda t, k: F.struct(F.lit(1).alias("page"), k.cast("double").alias("y"), F.col("row_no").cast("int").alias("origin"), t.alias("text"))
    cols = [F.transform(v, piece).alias(f"c{i}") for i, v in enumerate(values)]
    return df.select("doc_id", F.lit(1).alias("page"), (F.col("row_no") - 1).cast("int").alias("band"), "row_no", F.col("row_no").cast("string").alias("anchor"), *cols, F.array().cast("array<int>").alias("boundaries"), F.array().cast(repair.NOTES).alias("_notes"))


_TWO = TableSpec((Column("no", 0.0, "code"), Column("text", 50.0, "en")), 500.0)
_CJK = TableSpec((Column("no", 0.0, "code"), Column("text", 50.0, "cjk")), 500.0)


def _lines(spark, sf_dir, planted):
    d = table(spark, sf_dir, "documents").select(F.lit("d").alias("doc_id"), (F.col("doc_id") + 1).alias("row_no"), planted.alias("t"))
    return _rows(d, [F.array(F.lit("")), F.array("t")])


@query(f"SELECT 'd' AS doc_id, doc_id + 1 AS row_no, CAST(doc_id + 1 AS VARCHAR) AS no, {soft_sql(chr(39).join(['replace(text, ', ' ', ', ', '  ', ')']))} AS text FROM documents")
def collapse_double(spark, sf_dir):
    return geometry.wide(repair.collapse_double_spaces(_lines(spark, sf_dir, F.replace(F.col("text"), F.lit(" "), F.lit("  "))), _TWO), _TWO)


_SPACED = "replace(replace(text, ' en ', '山 川 水  - 火'), ' the ', '図 - 書')"


@query(f"SELECT 'd' AS doc_id, doc_id + 1 AS row_no, CAST(doc_id + 1 AS VARCHAR) AS no, regexp_replace(regexp_replace({_SPACED}, '([{X.CJK}-]) ([{X.CJK}-])', '\\1\\2', 'g'), '([{X.CJK}-]) ([{X.CJK}-])', '\\1\\2', 'g') AS text FROM documents")
def collapse_cjk(spark, sf_dir):
    return geometry.wide(repair.collapse_cjk_spaces(_lines(spark, sf_dir, F.expr(_SPACED)), _CJK), _CJK)


_WORD_SQL = "WITH w AS (SELECT DISTINCT lower(unnest(string_split(text, ' '))) AS word FROM benchmark), d AS (SELECT word FROM w WHERE regexp_matches(word, '^[a-z]+$'))"


def _words(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).select(F.lower("w").alias("word")).distinct()
    return stored(words.where(F.col("word").rlike("^[a-z]+$")))


@query(f"""{_WORD_SQL} SELECT 'd' AS doc_id, word AS anchor, CASE WHEN left(word, 4) NOT IN (SELECT word FROM d) THEN word || ' tail' ELSE left(word, 4) || ' ' || substr(word, 5) || ' tail' END AS text FROM d WHERE length(word) >= 7""")
def split_words(spark, sf_dir):
    words = _words(spark, sf_dir)
    rows = _keyed_rows(words.where(F.length("word") >= 7), F.array(F.substring("word", 1, 4), F.concat(F.expr("substr(word, 5)"), F.lit(" tail"))))
    return repair.split_words(rows, _TWO, words).select("doc_id", "anchor", geometry.value(_TWO, 1).alias("text"))


def _keyed_rows(words: DataFrame, lines) -> DataFrame:
    keyed = words.select(F.lit("d").alias("doc_id"), F.pmod(F.xxhash64("word"), F.lit((1 << 31) - 1)).alias("row_no"), "word", lines.alias("lines"))
    rows = _rows(keyed, [F.array(F.lit("")), F.col("lines")])
    return rows.join(keyed.select("row_no", "word"), "row_no").withColumn("anchor", F.col("word")).drop("word")


@query(f"""{_WORD_SQL}, s AS (SELECT word, left(word, length(word) - 1) AS sa, right(word, 1) || 'widget' AS sb FROM d WHERE length(word) >= 4), dict AS (SELECT word FROM d UNION SELECT 'widget'),
cut AS (SELECT word, min(j) AS j FROM s, range(1, 20) t(j) WHERE j <= length(sb) - 3 AND sa || left(sb, j) IN (SELECT word FROM dict) AND substr(sb, j + 1) IN (SELECT word FROM dict) AND sa NOT IN (SELECT word FROM dict) AND sb NOT IN (SELECT word FROM dict) GROUP BY word)
SELECT 'd' AS doc_id, s.word AS anchor, CASE WHEN j IS NULL THEN sa || ' ' || sb || '7 end' ELSE sa || left(sb, j) || ' ' || substr(sb, j + 1) || '7 end' END AS text FROM s LEFT JOIN cut USING (word)""")
def swallowed_space(spark, sf_dir):
    words = _words(spark, sf_dir)
    lines = F.array(F.expr("left(word, length(word) - 1)"), F.concat(F.expr("right(word, 1)"), F.lit("widget7 end")))
    rows = _keyed_rows(words.where(F.length("word") >= 4), lines)
    known = words.union(spark.createDataFrame([("widget",)], "word string"))
    return repair.swallowed_spaces(rows, _TWO, known).select("doc_id", "anchor", geometry.value(_TWO, 1).alias("text"))


@query(f"""WITH d AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN left(p_name, 3) WHEN p_partkey % 3 = 1 THEN 'X' || p_name ELSE right(p_name, 4) END AS got FROM part)
SELECT 'part' AS doc_id, p_partkey + 1 AS row_no, CAST(p_partkey + 1 AS VARCHAR) AS no, CASE WHEN contains({hard_sql('p_name')}, {hard_sql('got')}) AND length({hard_sql('p_name')}) - length({hard_sql('got')}) BETWEEN 1 AND 14 THEN p_name ELSE got END AS text FROM d""")
def complete_from_ref(spark, sf_dir):
    got = F.expr("CASE WHEN p_partkey % 3 = 0 THEN left(p_name, 3) WHEN p_partkey % 3 = 1 THEN 'X' || p_name ELSE right(p_name, 4) END")
    p = table(spark, sf_dir, "part").select(F.lit("part").alias("doc_id"), (F.col("p_partkey") + 1).alias("row_no"), got.alias("got"), F.array(F.lit(""), F.col("p_name")).alias("values"))
    rows = repair.beside(_rows(p, [F.array(F.lit("")), F.array("got")]), p.select("doc_id", "row_no", "values"))
    return geometry.wide(repair.complete_from_reference(rows, _TWO), _TWO)


# --- geometry ----------------------------------------------------------------------------------------------------------

PART = ExportLayout((PrintColumn("no", "code", 8), PrintColumn("p_partkey", "code", 8), PrintColumn("p_name", "en", 8), PrintColumn("p_brand", "code", 10), PrintColumn("p_type", "en", 10)), watermark="S A M P L E")
PART_NAMES = ["p_partkey", "p_name", "p_brand", "p_type"]
NATION = ExportLayout((PrintColumn("no", "code", 6), PrintColumn("n_nationkey", "code", 6), PrintColumn("n_name", "en", 10), PrintColumn("n_regionkey", "code", 4)), merged=frozenset({2}))
_PART_RN = "(row_number() OVER (ORDER BY p_partkey) - 1)"
_PART_LINES = "CASE WHEN length(p_name) > 8 THEN string_split(p_name, ' ') ELSE [p_name] END"


def _part_values(spark, sf_dir):
    return printed(table(spark, sf_dir, "part"), "part", "p_partkey", PART_NAMES, PART)


def _part(spark, sf_dir):
    return geometry.extract(typeset.render(_part_values(spark, sf_dir), PART), typeset.spec_for(PART))


@query("SELECT c_custkey, CAST(CASE WHEN c_acctbal < 0 THEN -1 WHEN c_acctbal < 1000 THEN 0 WHEN c_acctbal < 2500 THEN 1 WHEN c_acctbal < 9000 THEN 2 ELSE -1 END AS INTEGER) AS col FROM customer")
def column_lookup(spark, sf_dir):
    spec = TableSpec((Column("a", 0.0), Column("b", 1000.0), Column("c", 2500.0)), 9000.0)
    return table(spark, sf_dir, "customer").select("c_custkey", spec.column_of(F.col("c_acctbal")).alias("col"))


@query(f"SELECT CAST({_PART_RN} // 40 + 1 AS INTEGER) AS page, CAST({_PART_RN} % 40 AS INTEGER) AS band, {_PART_RN} + 1 AS row_no, CAST({_PART_RN} + 1 AS VARCHAR) AS anchor FROM part")
def anchors(spark, sf_dir):
    return _part(spark, sf_dir).rows.select("page", "band", "row_no", "anchor")


@query(f"SELECT CAST(rn // 40 + 1 AS INTEGER) AS page, CAST(rn % 40 AS INTEGER) AS band, CAST(4 + len(ls) AS BIGINT) AS n_objects FROM (SELECT {_PART_RN} AS rn, {_PART_LINES} AS ls FROM part)")
def bands(spark, sf_dir):
    spec = typeset.spec_for(PART)
    objs = geometry.objects(geometry.page_glyphs(typeset.render(_part_values(spark, sf_dir), PART), spec), spec)
    return geometry.banded(objs).groupBy("page", "band").agg(F.count("*").alias("n_objects"))


@query(f"""WITH p AS (SELECT {_PART_RN} AS rn, p_partkey, {_PART_LINES} AS ls, p_brand, p_type FROM part), l AS (SELECT rn, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS k FROM p)
SELECT CAST(rn // 40 + 1 AS INTEGER) AS page, CAST(rn % 40 AS INTEGER) AS band, 2 AS col, CAST(k AS INTEGER) AS k, 76 + 16e0 * (rn % 40) + 3.5e0 * k AS y, text FROM l""")
def sublines(spark, sf_dir):
    return _part(spark, sf_dir).sublines.where("col = 2").select("page", "band", "col", "k", F.col("y"), "text")


@query(f"""WITH p AS (SELECT {_PART_RN} AS rn, p_brand, p_type FROM part)
SELECT CAST(rn // 40 + 1 AS INTEGER) AS page, CAST(rn % 40 AS INTEGER) AS band, 3 AS col, p_brand AS text, 20 + 26 * 4e0 - 8 + 6 + 1 AS x0, 20 + 26 * 4e0 - 8 + 6 + 1 + 4e0 * length(p_brand) AS x1 FROM p""")
def fragments(spark, sf_dir):
    spec = typeset.spec_for(PART)
    g = geometry.page_glyphs(typeset.render(_part_values(spark, sf_dir), PART), spec)
    found = geometry.fragments(geometry.characters(geometry.banded(geometry.objects(g, spec)), spec), spec)
    return found.where("col = 3").select("page", "band", "col", "text", "x0", "x1")


_SUPPLIER = ExportLayout((PrintColumn("no", "code", 8), PrintColumn("name", "cjk", 12), PrintColumn("free", "code", 8), PrintColumn("key", "code", 8)))


def _supplier(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("name", F.when(F.col("s_suppkey") % 10 == 3, F.concat(F.lit("山地"), F.lit("AB"), F.col("s_suppkey") % 7)).otherwise("山")).withColumn("free", F.when(F.col("s_suppkey") % 10 == 3, "").otherwise("x"))
    values = printed(s, "supplier", "s_suppkey", ["name", "free", "s_suppkey"], _SUPPLIER)
    bad = values.where(F.get("values", F.lit(2)) == "").select("doc_id", "rn", F.lit(1).alias("col"), F.lit("overflow").alias("kind"))
    return values, geometry.extract(typeset.render(values, _SUPPLIER, bad), typeset.spec_for(_SUPPLIER))


_SUPP_RN = "(row_number() OVER (ORDER BY s_suppkey) - 1)"


@query(f"SELECT page, band, flag, idx FROM (SELECT s_suppkey, CAST({_SUPP_RN} // 40 + 1 AS INTEGER) AS page, CAST({_SUPP_RN} % 40 AS INTEGER) AS band, 'boundary' AS flag, 2 AS idx FROM supplier) WHERE s_suppkey % 10 = 3")
def overflow_flags(spark, sf_dir):
    return _supplier(spark, sf_dir)[1].flags.select("page", "band", "flag", "idx").where("flag = 'boundary'")


@query(f"SELECT {_SUPP_RN} + 1 AS row_no, CASE WHEN s_suppkey % 10 = 3 THEN '山地AB' || (s_suppkey % 7) ELSE '山' END AS name, CASE WHEN s_suppkey % 10 = 3 THEN '' ELSE 'x' END AS free FROM supplier")
def overflow_repaired(spark, sf_dir):
    values, x = _supplier(spark, sf_dir)
    rows = repair.beside(stored(x.rows), typeset.ground_truth(values)).withColumn("_notes", F.array().cast(repair.NOTES))
    return geometry.wide(repair.move_overflow_back(rows, x.spec), x.spec).select("row_no", "name", "free")


@query("SELECT 'nation' AS doc_id, row_number() OVER (ORDER BY n_nationkey) AS row_no, CAST(row_number() OVER (ORDER BY n_nationkey) AS VARCHAR) AS no, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def roundtrip_nation(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "nation"), "nation", "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"], NATION)


_PART_SELECT = f"SELECT 'part' AS doc_id, {_PART_RN} + 1 AS row_no, CAST({_PART_RN} + 1 AS VARCHAR) AS no, CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type FROM part"


@query(_PART_SELECT)
def roundtrip_part(spark, sf_dir):
    return _part(spark, sf_dir).table()


@query(f"SELECT * FROM (SELECT 'part' AS doc_id, CAST(CASE WHEN rn // 40 = 2 THEN rn - 80 ELSE rn + 40 END + 1 AS BIGINT) AS row_no, CAST(rn + 1 AS VARCHAR) AS no, p_name FROM (SELECT {_PART_RN} AS rn, p_name FROM part) WHERE rn // 40 IN (0, 2))")
def page_selection(spark, sf_dir):
    glyphs = typeset.render(_part_values(spark, sf_dir), PART)
    return geometry.extract(glyphs, typeset.spec_for(PART), [2, 0]).table().select("doc_id", "row_no", "no", "p_name")


CUSTOMER = ExportLayout((PrintColumn("no", "code", 8), PrintColumn("c_custkey", "code", 8), PrintColumn("c_name", "code", 20), PrintColumn("c_mktsegment", "en", 14)))


@query("SELECT 'customer' AS doc_id, row_number() OVER (ORDER BY c_custkey) AS row_no, CAST(row_number() OVER (ORDER BY c_custkey) AS VARCHAR) AS no, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def roundtrip_customer(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "customer"), "customer", "c_custkey", ["c_custkey", "c_name", "c_mktsegment"], CUSTOMER)


ORDERS = ExportLayout((PrintColumn("no", "code", 8), PrintColumn("o_orderkey", "code", 10), PrintColumn("o_custkey", "code", 10), PrintColumn("o_orderstatus", "code", 4), PrintColumn("o_orderpriority", "en", 16)))


@query("""SELECT CAST(o_orderkey // 4000 AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY o_orderkey // 4000 ORDER BY o_orderkey) AS row_no, CAST(row_number() OVER (PARTITION BY o_orderkey // 4000 ORDER BY o_orderkey) AS VARCHAR) AS no,
CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority FROM orders""")
def roundtrip_orders(spark, sf_dir):
    doc = F.floor(F.col("o_orderkey") / 4000)
    return round_trip(table(spark, sf_dir, "orders"), doc, "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], ORDERS)


PLAIN = ExportLayout((PrintColumn("no", "code", 8), PrintColumn("p_partkey", "code", 8), PrintColumn("p_name", "en", 14), PrintColumn("p_brand", "code", 10), PrintColumn("p_type", "en", 12)), watermark="S A M P L E")
_DAMAGE = {"split_word": 20, "swallow_space": 20, "double_space": 20, "interleave": 20}


def _damaged(spark, sf_dir, counts):
    values = stored(printed(table(spark, sf_dir, "part"), "part", "p_partkey", PART_NAMES, PLAIN))
    defects = stored(typeset.plan_defects(values, PLAIN, counts))
    words = values.select(F.explode(F.flatten(F.transform("values", lambda t: F.split(t, " ")))).alias("word")).where(F.col("word").rlike("^[A-Za-z]+$"))
    return values, defects, typeset.render(values, PLAIN, defects), words


@query(_PART_SELECT)
def roundtrip_repaired(spark, sf_dir):
    values, _, glyphs, words = _damaged(spark, sf_dir, _DAMAGE)
    done = recover(glyphs, typeset.spec_for(PLAIN), typeset.ground_truth(values), words)
    return geometry.wide(done.rows, done.spec)


@query("SELECT CAST(0 AS BIGINT) AS differences, CAST(0 AS BIGINT) AS rows_with_problems, true AS balanced, true AS reference_used, count(*) AS \"rows\" FROM part")
def recovery_evidence(spark, sf_dir):
    values, _, glyphs, words = _damaged(spark, sf_dir, _DAMAGE)
    return recover(glyphs, typeset.spec_for(PLAIN), typeset.ground_truth(values), words).summary()


@query(f"SELECT row_no, '####' AS value FROM (SELECT {_PART_RN} + 1 AS row_no FROM part) WHERE row_no % 50 = 8")
def placeholder_report(spark, sf_dir):
    values = _part_values(spark, sf_dir)
    bad = values.where("rn % 50 = 7").select("doc_id", "rn", F.lit(3).alias("col"), F.lit("placeholder").alias("kind"))
    x = geometry.extract(typeset.render(values, PART, bad), typeset.spec_for(PART))
    return checks.placeholders(x.cells()).select("row_no", "value")


@query("SELECT * FROM (VALUES ('swallowed-space', CAST(20 AS BIGINT)), ('double-space', 20), ('split-word', 20), ('reassign-window', 20)) t(op, n)")
def repair_operators(spark, sf_dir):
    """What each repair did, by operator: as often as its defect was planted, and nothing else."""
    values, _, glyphs, words = _damaged(spark, sf_dir, _DAMAGE)
    return recover(glyphs, typeset.spec_for(PLAIN), typeset.ground_truth(values), words).repaired.by_operator


@query("SELECT * FROM (VALUES ('split_word', CAST(3 AS BIGINT)), ('swallow_space', 3), ('double_space', 3), ('interleave', 2), ('placeholder', 2)) t(kind, n)")
def planned_defects(spark, sf_dir):
    """Defects planned for the part catalogue, by kind: as many as asked for, of the kinds for which it has a place."""
    return typeset.plan_defects(_part_values(spark, sf_dir), PLAIN, typeset.DEFECTS).groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT left(replace(p_brand, ' ', ''), 99) AS text, 76 + 16e0 * (rn % 40) AS y, rn // 40 AS page FROM (SELECT p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS rn FROM part)),
f AS (SELECT DISTINCT page, t.text, t.y, t.spacing FROM o, (VALUES ('EXPORT', 26e0, 4e0), ('PAGEFOOTER', 732e0, 4e0), ('SAMPLE', 78e0, 18.55e0)) t(text, y, spacing))
SELECT text, y, count(DISTINCT page) AS pages, 4e0 AS spacing FROM o GROUP BY text, y HAVING count(DISTINCT page) >= 2 UNION ALL SELECT text, y, count(*) AS pages, max(spacing) FROM f GROUP BY text, y HAVING count(*) >= 2 OR max(spacing) > 10""")
def watermark_detect(spark, sf_dir):
    layout = ExportLayout((PrintColumn("p_brand", "code", 10),), watermark="S A M P L E")
    values = typeset.numbered(table(spark, sf_dir, "part"), "part", "p_partkey").select("doc_id", "rn", F.array("p_brand").alias("values"))
    return checks.watermarks(geometry.recon(typeset.render(values, layout))).select("text", "y", "pages", "spacing")


@query("SELECT CAST(i AS INTEGER) AS edge, x AS \"left\", n FROM (SELECT count(*) AS n FROM nation), (VALUES (0, 21e0), (1, 47e0), (2, 115e0)) t(i, x)")
def column_edges(spark, sf_dir):
    layout = ExportLayout(NATION.columns, header=None, footer=None, merged=frozenset({2}))
    glyphs = typeset.render(printed(table(spark, sf_dir, "nation"), "nation", "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"], layout), layout)
    return checks.column_edges(geometry.recon(glyphs)).select("edge", "left", "n")


@query("""SELECT CAST(rn // 40 + 1 AS INTEGER) AS page, 76 + 16e0 * (rn % 40) AS y, 21e0 AS x0, 21 + 4e0 * length(CAST(rn + 1 AS VARCHAR)) AS x1, CAST(rn + 1 AS VARCHAR) AS text FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS rn FROM nation)""")
def recon_objects(spark, sf_dir):
    glyphs = typeset.render(printed(table(spark, sf_dir, "nation"), "nation", "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"], NATION), NATION)
    return geometry.recon(glyphs, typeset.spec_for(NATION)).where("anchor IS NOT NULL").select("page", "y", "x0", "x1", "text")


@query("SELECT 1 AS page, CAST(sum(length(n_name)) AS BIGINT) AS n FROM nation")
def evidence_crop(spark, sf_dir):
    glyphs = typeset.render(printed(table(spark, sf_dir, "nation"), "nation", "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"], NATION), NATION)
    left = NATION.left(2)
    return geometry.crop(glyphs, 1, left, NATION.first_y - 1, left + NATION.width(2), NATION.footer_y - 4).groupBy("page").agg(F.count("*").alias("n"))


@query(catalogue.SQL)
def catalogue_recovered(spark, sf_dir):
    done = catalogue.recovered(spark)
    return geometry.wide(done.rows, done.spec)


# --- ruled tables ------------------------------------------------------------------------------------------------------


def _ruled(spark, sf_dir):
    values = printed(table(spark, sf_dir, "nation"), "nation", "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"], NATION)
    return values, typeset.render(values, NATION), typeset.ruled(values, NATION)


@query("SELECT 1 AS page, 0 AS table_index, CAST(count(*) AS INTEGER) AS n_rows, 4 AS n_cols, string_agg(rn || '|' || n_nationkey || '|' || n_name || '|' || n_regionkey, ';' ORDER BY rn) AS flat FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS rn FROM nation)")
def bordered_tables(spark, sf_dir):
    _, glyphs, rules = _ruled(spark, sf_dir)
    found = bordered.bordered_tables(glyphs, rules)
    flat = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";")
    return found.select("page", "table_index", "n_rows", "n_cols", flat.alias("flat"))


@query("SELECT 'nation' AS doc_id, 'bordered' AS strategy, CAST(1 AS BIGINT) AS pages_probed, CAST(1 AS BIGINT) AS pages_with_tables, (SELECT count(*) FROM nation) AS rows_seen UNION ALL SELECT 'part', 'borderless', 4, 0, 0")
def probe_strategy(spark, sf_dir):
    _, glyphs, rules = _ruled(spark, sf_dir)
    both = glyphs.union(typeset.render(_part_values(spark, sf_dir), PART))
    pages = both.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    return bordered.probe(pages, both, rules).drop("reason")


@query("SELECT 'nation' AS doc_id, 1 AS page, round(74 + 16e0 * k, 1) AS y FROM range(0, 12) t(k)")
def page_rules(spark, sf_dir):
    return geometry.rules(_ruled(spark, sf_dir)[2]).select("doc_id", "page", "y")


# --- checks ------------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_orderkey // 4000 ORDER BY o_orderkey) AS before FROM orders WHERE o_orderkey % 97 <> 5)
SELECT o_orderkey AS row_no, o_orderkey AS anchor, before FROM o WHERE before IS NOT NULL AND o_orderkey <> before + 1""")
def anchor_gaps(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 97 <> 5").select(F.floor(F.col("o_orderkey") / 4000).alias("doc_id"), F.col("o_orderkey").alias("row_no"), F.col("o_orderkey").alias("anchor"))
    return checks.anchor_gaps(o).select("row_no", "anchor", "before")


@query("SELECT l_suppkey AS doc_id, l_partkey AS key, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_anchors(spark, sf_dir):
    return checks.repeated(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "doc_id"), "l_partkey")


@query("SELECT l_partkey AS given, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def fd_violations(spark, sf_dir):
    return checks.dependencies(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT p_partkey, 'p_brand' AS name, p_brand AS value, '^Brand#1[0-9]$' AS rule FROM part WHERE NOT regexp_matches(p_brand, '^Brand#1[0-9]$')")
def pattern_check(spark, sf_dir):
    cells = table(spark, sf_dir, "part").select("p_partkey", F.lit("p_brand").alias("name"), F.col("p_brand").alias("value"))
    return checks.patterns(cells, {"p_brand": "^Brand#1[0-9]$"})


@query("SELECT p_partkey FROM part WHERE p_partkey % 17 = 0")
def empty_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", *[F.when(F.col("p_partkey") % 17 != 0, F.col(c)).otherwise("").alias(c) for c in ("p_name", "p_brand")])
    return checks.empty_rows(p, ["p_name", "p_brand"]).select("p_partkey")


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 THEN 1 ELSE 0 END AS fresh FROM events WHERE ts IS NOT NULL)
SELECT event_id, user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS cluster FROM e""")
def gap_cluster_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("ts IS NOT NULL").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return geometry.gap_clusters(e, ["user_id"], "at", 3_600_000_000, "event_id").select("event_id", "user_id", "cluster")


@query("""WITH c AS (SELECT unnest([struct_pack(name := 'p_name', value := p_name), struct_pack(name := 'p_brand', value := p_brand), struct_pack(name := 'p_type', value := p_type)]) AS c FROM part),
s AS (SELECT c.name AS name, length(c.value) * 4e0 AS w, c.value AS value FROM c), r AS (SELECT name, w, row_number() OVER (PARTITION BY name ORDER BY w) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM s)
SELECT r.name, min(w) AS width, any_value(k.kind) AS kind FROM r JOIN (SELECT name, CASE WHEN bool_or(contains(value, ' ')) OR NOT bool_or(value <> '') THEN 'en' ELSE 'code' END AS kind FROM s GROUP BY name) k USING (name)
WHERE i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) GROUP BY r.name""")
def plan_widths(spark, sf_dir):
    return typeset.plan_widths(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], measure=lambda x: F.length(x) * F.lit(4.0))


# --- sources and sinks -------------------------------------------------------------------------------------------------


@query(_PART_SELECT)
def csv_readback(spark, sf_dir):
    import uuid

    spec = typeset.spec_for(PART)
    rows = typeset.ground_truth(_part_values(spark, sf_dir))
    path = writers.csv_parts(rows, spec, f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}")
    back = writers.csv_parts_back(spark, spec, path)
    return back.select("doc_id", "row_no", *[F.get("values", F.lit(i)).alias(n) for i, n in enumerate(spec.names)])


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer), s AS (SELECT * FROM r WHERE pos % 7 = 0 ORDER BY pos LIMIT 150)
SELECT CAST(row_number() OVER (ORDER BY pos) AS VARCHAR) AS no, c_name, c_mktsegment FROM s""")
def strided_sample(spark, sf_dir):
    return references.strided_sample(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], "c_custkey", 7, 150)


@query(ORACLE_SQL["roundtrip_nation"])
def stream_roundtrip_nation(spark, sf_dir):
    glyphs = typeset.render(printed(table(spark, sf_dir, "nation"), "nation", "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"], NATION), NATION)
    return streams.recover_stream(spark, streams.as_files(glyphs), typeset.spec_for(NATION))




# --- evidence, logs and files of whole recoveries ----------------------------------------------------------------------


@query(f"SELECT rn + 1 AS row_no, 2 AS col, 'double-space' AS op, 'collapsed' AS note FROM (SELECT {_PART_RN} AS rn, p_name FROM part) WHERE rn % 30 = 1 AND contains(p_name, ' ') AND length(p_name) < 14")
def repair_log(spark, sf_dir):
    values = stored(printed(table(spark, sf_dir, "part"), "part", "p_partkey", PART_NAMES, PLAIN))
    name = F.get("values", F.lit(2))
    bad = values.where((F.col("rn") % 30 == 1) & name.contains(" ") & (F.length(name) < 14)).select("doc_id", "rn", F.lit(2).alias("col"), F.lit("double_space").alias("kind"))
    done = recover(typeset.render(values, PLAIN, bad), typeset.spec_for(PLAIN), typeset.ground_truth(values))
    return done.repaired.log.select("row_no", "col", "op", "note")


def _shortened(spark, sf_dir, doc):
    """Printed rows of which some lack the last three letters of their type, and the whole ones."""
    whole = stored(printed(table(spark, sf_dir, "part"), doc, "p_partkey", PART_NAMES, PLAIN))
    kind = F.get("values", F.lit(4))
    less = F.when(F.col("rn") % 25 == 3, F.concat(F.slice("values", 1, 4), F.array(F.substring(kind, F.lit(1), F.length(kind) - 3)))).otherwise(F.col("values"))
    return whole.withColumn("values", less), whole


@query(f"SELECT rn + 1 AS row_no, 4 AS col, left(p_type, length(p_type) - 3) AS candidate, true AS expected FROM (SELECT {_PART_RN} AS rn, p_type FROM part) WHERE rn % 25 = 3")
def completions_expected(spark, sf_dir):
    values, whole = _shortened(spark, sf_dir, "part")
    done = recover(typeset.render(values, PLAIN), typeset.spec_for(PLAIN), typeset.ground_truth(whole)).repaired
    marked = done.expected_exceptions.select("doc_id", "row_no", F.lit(True).alias("expected"))
    return done.completions.join(marked, ["doc_id", "row_no"], "full_outer").select("row_no", "col", "candidate", "expected")


_TWO_DOCS = "(CASE WHEN p_partkey % 2 = 0 THEN 'whole' ELSE 'short' END)"


@query(f"""SELECT doc_id, rn + 1 AS row_no, CASE WHEN doc_id = 'short' AND rn % 25 = 3 THEN left(p_type, length(p_type) - 3) ELSE p_type END AS p_type
FROM (SELECT {_TWO_DOCS} AS doc_id, row_number() OVER (PARTITION BY {_TWO_DOCS} ORDER BY p_partkey) - 1 AS rn, p_type FROM part)""")
def references_by_document(spark, sf_dir):
    """One document's reference lacks a row and is not used; the other document is completed from its own."""
    values, whole = _shortened(spark, sf_dir, F.when(F.col("p_partkey") % 2 == 0, "whole").otherwise("short"))
    targets = typeset.ground_truth(whole).where("doc_id = 'whole' OR row_no > 1")
    done = recover(typeset.render(values, PLAIN), typeset.spec_for(PLAIN), targets)
    return geometry.wide(done.rows, done.spec).select("doc_id", "row_no", "p_type")


def _by_hand(spark, sf_dir):
    """Characters of brands: every tenth has one that lies on the one before, every tenth ends at the next column."""
    spec = TableSpec((Column("a", 0.0, "code"), Column("b", 100.0, "code")), 200.0)
    p = table(spark, sf_dir, "part")
    left = F.when(F.col("p_partkey") % 10 == 7, 99.8 - 4 * F.length("p_brand")).otherwise(F.lit(10.0))
    chars = p.select(F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.col("p_partkey").cast("int").alias("line_no"), F.col("p_partkey").cast("int").alias("band"), left.alias("left"), F.posexplode(F.split("p_brand", "")).alias("seq", "ch")).where("ch <> ''")
    x0 = F.col("left") + 4 * F.col("seq") - F.when((F.col("band") % 10 == 3) & (F.col("seq") == 4), 3.0).otherwise(0.0)
    placed = chars.withColumns({"y": F.lit(10.0), "is_anchor": F.lit(False), "anchor": F.lit(None).cast("string"), "x0": x0, "x1": x0 + 4, "cx": x0 + 2}).withColumn("col", F.lit(0))
    return placed, spec


@query("SELECT CAST(p_partkey AS INTEGER) AS band, CASE p_partkey % 10 WHEN 3 THEN 'overlap' ELSE 'clip' END AS flag, 0 AS idx FROM part WHERE p_partkey % 10 IN (3, 7)")
def overlap_and_clip_flags(spark, sf_dir):
    chars, spec = _by_hand(spark, sf_dir)
    return geometry.flags(geometry.fragments(chars, spec)).select("band", "flag", "idx")


@query("SELECT 'd' AS doc_id, CAST(sum(length(p_brand)) FILTER (WHERE p_partkey % 5 = 2) AS BIGINT) AS margin_chars, CAST(sum(length(p_brand)) FILTER (WHERE p_partkey % 5 <> 2 AND p_partkey % 7 <> 0) AS BIGINT) AS spilled_chars FROM part")
def margin_characters(spark, sf_dir):
    chars, spec = _by_hand(spark, sf_dir)
    moved = chars.withColumn("col", F.when(F.col("band") % 5 == 2, -1).otherwise(0)).withColumn("is_anchor", F.col("band") % 7 == 0)
    return conserve.margins(moved, spec)


_MORE = "CASE WHEN p_partkey % 6 = 1 THEN p_name || 'zz' ELSE p_name END"


@query(f"""WITH a AS (SELECT p_partkey, ch, count(*) AS a FROM (SELECT p_partkey, unnest(string_split({hard_sql(_MORE)}, '')) AS ch FROM part) WHERE ch <> '' GROUP BY ALL),
b AS (SELECT p_partkey, ch, count(*) AS b FROM (SELECT p_partkey, unnest(string_split({hard_sql('p_name')}, '')) AS ch FROM part) WHERE ch <> '' GROUP BY ALL)
SELECT p_partkey AS row_no, ch, greatest(coalesce(a, 0) - coalesce(b, 0), 0) AS extra, greatest(coalesce(b, 0) - coalesce(a, 0), 0) AS missing FROM a FULL JOIN b USING (p_partkey, ch) WHERE coalesce(a, 0) <> coalesce(b, 0)""")
def conservation_by_anchor(spark, sf_dir):
    """The evidence of a row lies in two bands of one anchor; they are pooled."""
    spec = TableSpec((Column("no", 0.0, "code"), Column("name", 10.0)), 100.0)
    p = table(spark, sf_dir, "part").select(F.lit("part").alias("doc_id"), F.col("p_partkey").alias("row_no"), "p_name", F.expr(_MORE).alias("more"))
    half = F.floor(F.length("p_name") / 2).cast("int")
    pieces = F.array(F.substring("p_name", F.lit(1), half), F.substring("p_name", half + 1, F.length("p_name")))
    bands = p.select("doc_id", "row_no", F.posexplode(pieces).alias("k", "t")).select("doc_id", (F.col("k") + 1).alias("page"), F.col("row_no").cast("int").alias("band"), "t")
    rows = p.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("page"), F.col("row_no").cast("int").alias("band"), "row_no", F.col("row_no").cast("string").alias("anchor"))
    cells = p.select("doc_id", "row_no", F.lit(1).alias("col"), F.col("more").alias("value"))
    own = rows.where("page = 1")
    pages = conserve.exploded(bands, conserve.BAND, "t")
    pooled = pages.join(rows.select(*conserve.BAND, "anchor"), conserve.BAND).select("doc_id", F.lit(1).alias("page"), "band", "ch", "n")
    return conserve.by_anchor(pooled, cells, own, spec).select("row_no", "ch", "extra", "missing")


@query(f"""WITH p AS (SELECT p_partkey + 1 AS row_no, p_name FROM part WHERE p_partkey % 6 = 1 ORDER BY p_partkey LIMIT 10)
SELECT string_agg('part row ' || row_no || ': +''Z'' x 2', chr(10) ORDER BY row_no) || chr(10) || '...' AS said FROM p""")
def rendered_problems(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lit("part").alias("doc_id"), (F.col("p_partkey") + 1).alias("row_no"), "p_name", F.expr(_MORE).alias("more"))
    a, b = (conserve.exploded(p, ["doc_id", "row_no"], c).withColumnRenamed("n", n) for c, n in (("more", "a"), ("p_name", "b")))
    said = conserve.render_problems(conserve.difference(a, b, ["doc_id", "row_no", "ch"]))
    return spark.createDataFrame([(said,)], "said string")


@query("""SELECT 'nation' AS doc_id, '1 of 1 probed pages hold a ruled table, ' || (SELECT count(*) FROM nation) || ' rows in all' AS reason UNION ALL SELECT 'part', '0 of 4 probed pages hold a ruled table, 0 rows in all' UNION ALL SELECT 'void', 'no pages'""")
def probe_reasons(spark, sf_dir):
    _, glyphs, rules = _ruled(spark, sf_dir)
    both = glyphs.union(typeset.render(_part_values(spark, sf_dir), PART))
    pages = both.groupBy("doc_id").agg(F.max("page").alias("n_pages")).union(spark.createDataFrame([("void", 0)], "doc_id string, n_pages int"))
    return bordered.probe(pages, both, rules).select("doc_id", "reason")


@query("SELECT p_partkey, len(string_split(p_name, 'a')) AS n FROM part WHERE len(string_split(p_name, 'a')) <> 2")
def ragged_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", "a").alias("values"))
    return checks.ragged(rows, 2).select("p_partkey", F.size("values").cast("long").alias("n"))


@query("""WITH t AS (SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 4 = 1 AND o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) THEN 50 * length(o_orderpriority) ELSE length(o_orderpriority) END AS n FROM orders)
SELECT * FROM (SELECT CAST(o_custkey AS VARCHAR) AS doc_id, max(o_orderkey) AS row_no, max_by(n, o_orderkey) AS length, round(avg(n), 6) AS usual, avg(n) AS a FROM t GROUP BY o_custkey) WHERE length > 3 * a""".replace("SELECT * FROM (SELECT CAST", "SELECT doc_id, row_no, length, usual FROM (SELECT CAST"))
def trailing_blocks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    last = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    text = F.when((F.col("o_custkey") % 4 == 1) & (F.col("o_orderkey") == F.col("last")), F.repeat("o_orderpriority", F.lit(50))).otherwise(F.col("o_orderpriority"))
    rows = o.join(last, "o_custkey").select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").alias("row_no"), text.alias("text"))
    return checks.trailing_blocks(rows, ["text"]).select("doc_id", "row_no", F.col("length").cast("long").alias("length"), F.round("usual", 6).alias("usual"))


def _scratch(spark) -> str:
    import uuid

    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT 'part' AS doc_id, row_number() OVER (ORDER BY p_partkey) AS row_no, p_name || chr(10) || '\"x\", y' AS p_name, p_brand FROM part")
def csv_reference(spark, sf_dir):
    """A reference file with quotes and line breaks inside its fields."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit('\n"x", y')).alias("p_name"), "p_brand")
    path = _scratch(spark)
    p.repartition(1).sortWithinPartitions("p_partkey").drop("p_partkey").write.options(header=True, escape='"').csv(path)
    back = references.reference_rows(spark, f"{path}/*.csv", ["p_name", "p_brand"], "part")
    return back.select("doc_id", "row_no", F.get("values", F.lit(0)).alias("p_name"), F.get("values", F.lit(1)).alias("p_brand"))


@query("SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> ''")
def dictionary_words(spark, sf_dir):
    path = _scratch(spark)
    table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).select(F.concat(F.lit("  "), F.upper("w"), F.lit(" "))).write.text(path)
    return references.dictionary(spark, path)


@query(f"""SELECT * FROM (VALUES {", ".join(f"({i}, '{c.name}', CAST({PART.left(i)} AS DOUBLE), '{c.kind}')" for i, c in enumerate(PART.columns))}) t(i, name, "left", kind)""")
def layout_files(spark, sf_dir):
    """A layout written as JSON and read from the store."""
    import json

    path = _scratch(spark)
    spark.createDataFrame([(json.dumps(layouts.to_dict(typeset.spec_for(PART))),)], "value string").write.text(path)
    spec = layouts.load(path, spark)
    assert spec == typeset.spec_for(PART)
    return spark.createDataFrame([(i, c.name, float(c.left), c.kind) for i, c in enumerate(spec.columns)], "i int, name string, left double, kind string")


@query("""SELECT row_number() OVER (ORDER BY n_nationkey) + 1 AS row_no, 2 AS col, n_name || '!' AS expected, n_name AS found FROM nation QUALIFY n_nationkey % 5 = 0
UNION ALL SELECT count(*) + 2, 1, '99', NULL FROM nation UNION ALL SELECT count(*) + 2, 2, 'none', NULL FROM nation""")
def workbook_differences(spark, sf_dir):
    """A workbook read back against rows of which some differ and one is not in it."""
    import tempfile

    n = table(spark, sf_dir, "nation")
    rows = numbered_values(n, "n_nationkey", [F.col("n_nationkey").cast("string"), F.col("n_name")])
    changed = numbered_values(n, "n_nationkey", [F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 5 == 0, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name"))])
    more = n.agg((F.count("*") + 1).alias("row_no"), F.array(F.lit("99"), F.lit("none")).alias("values"))
    spec = TableSpec((Column("key", 0.0, "code"), Column("name", 10.0)), 100.0)
    with tempfile.TemporaryDirectory() as folder:  # a single file has one writer, the driver, which reads it at once
        path = writers.to_xlsx(rows, spec, f"{folder}/nation.xlsx")
        return writers.verify_written(spark, path, changed.union(more)).select("row_no", "col", "expected", "found")


def numbered_values(df, order, values):
    return typeset.numbered(df, "all", order).select((F.col("rn") + 1).cast("long").alias("row_no"), F.array(*values).alias("values"))

import pytest
from pyspark.sql import functions as F

from printloom.layout import AnchorSpec, Column, PageSpec, TableSpec
from printloom.operators import bordered, checks, compare, conserve, geometry, repair, typeset
from printloom.operators.typeset import ExportLayout, PrintColumn
from printloom.plans.recovery import recover
from printloom.plans.stages import stored
from printloom.sources import layouts, references, writers

NAMES = ["Harbor Administration", "Forest Administration", "Mountain Station", "River Crossing", "Valley Terminal", "Island Warehouse", "Desert Platform", "Coastal Junction"]
LAYOUT = ExportLayout((PrintColumn("no", "code", 6), PrintColumn("code", "code", 10), PrintColumn("name", "en", 24), PrintColumn("note", "en", 20)), watermark="S A M P L E")


@pytest.fixture(scope="module")
def values(spark):
    rows = [("doc", i, [str(i + 1), f"XX-{1000 + i}", NAMES[i % 8], f"paved runway {i}"]) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id string, rn int, values array<string>")


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w.lower(),) for n in [*NAMES, "paved runway"] for w in n.split()], "word string").distinct()


def test_layouts_are_validated():
    with pytest.raises(ValueError):
        TableSpec((Column("a", 20.0), Column("b", 10.0)), 30.0)
    with pytest.raises(ValueError):
        TableSpec((Column("a", 10.0), Column("b", 20.0)), 20.0)
    with pytest.raises(ValueError):
        TableSpec((), 10.0)
    with pytest.raises(ValueError):
        Column("a", 1.0, "text")
    with pytest.raises(ValueError):
        TableSpec((Column("a", 10.0),), 20.0, AnchorSpec(column=1))


def test_columns_are_half_open(spark):
    spec = TableSpec((Column("a", 10.0), Column("b", 20.0)), 30.0)
    got = spark.createDataFrame([(9.9,), (10.0,), (19.99,), (20.0,), (30.0,)], "x double").orderBy("x").select(spec.column_of(F.col("x"))).collect()
    assert [r[0] for r in got] == [-1, 0, 0, 1, -1]


def test_first_page_has_its_own_top(spark):
    page = PageSpec(data_top=10.0, first_page_data_top=50.0)
    got = spark.createDataFrame([(1,), (2,)], "p int").orderBy("p").select(page.top(F.col("p"))).collect()
    assert [r[0] for r in got] == [50.0, 10.0]


def test_layouts_survive_json(tmp_path):
    spec = TableSpec((Column("a", 10.0, "cjk"), Column("b", 20.5)), 30.0, AnchorSpec(spill_column=None), PageSpec(data_top=3.0, watermarks=frozenset({"B", "A"})))
    assert layouts.load(layouts.save(spec, str(tmp_path / "l.json"))) == spec
    assert layouts.from_dict({"right_edge": 9, "columns": [{"name": "x", "left": 1}]}).columns[0].kind == "en"


def glyphs(spark, items):
    """Objects (line, y, x, text) of characters four points wide."""
    rows = [("d", 1, line, i, c, x + 4.0 * i, y, x + 4.0 * i + 4, y + 3, y) for line, y, x, text in items for i, c in enumerate(text)]
    return spark.createDataFrame(rows, geometry.GLYPH_SCHEMA)


SPEC = TableSpec((Column("no", 0.0, "code"), Column("a", 40.0), Column("b", 100.0)), 200.0, AnchorSpec(max_x=40.0))


def test_anchors_bands_and_spill(spark):
    g = glyphs(spark, [(0, 10.0, 2.0, "007"), (1, 10.0, 42.0, "one"), (2, 20.0, 42.0, "two"), (3, 20.0, 2.0, "8 9"), (4, 15.0, 102.0, "mid"), (5, 30.0, 2.0, "####"), (6, 33.0, 2.0, "x"), (7, 50.0, 102.0, "end")])
    got = geometry.extract(g, SPEC).table().orderBy("row_no").collect()
    assert [tuple(r)[1:] for r in got] == [(1, "7", "one", ""), (2, "89", "two", "mid"), (3, "####", "x", "end")]


def test_tied_anchors_leave_a_row_empty(spark):
    g = glyphs(spark, [(0, 10.0, 2.0, "1"), (1, 10.0, 10.0, "2"), (2, 10.0, 42.0, "t")])
    assert [tuple(r)[1:] for r in geometry.extract(g, SPEC).table().orderBy("row_no").collect()] == [(1, "1", "", ""), (2, "2", "t", "")]


def test_long_numbers_are_no_anchors(spark):
    g = glyphs(spark, [(0, 10.0, 2.0, "123456"), (1, 20.0, 2.0, "3")])
    assert [r["no"] for r in geometry.extract(g, SPEC).table().collect()] == ["3"]


def test_one_object_in_two_columns_and_scrambled_stream(spark):
    text, xs = "ALPHA", [42.0, 46.0, 50.0, 54.0, 58.0]
    order = [4, 0, 3, 1, 2]
    rows = [("d", 1, 1, s, text[i], xs[i], 10.0, xs[i] + 4, 13.0, 10.0) for s, i in enumerate(order)]
    rows += [("d", 1, 1, 10 + i, c, 102.0 + 4 * i, 10.0, 106.0 + 4 * i, 13.0, 10.0) for i, c in enumerate("BETA")]
    rows += [("d", 1, 0, 0, "1", 2.0, 10.0, 6.0, 13.0, 10.0)]
    got = geometry.extract(spark.createDataFrame(rows, geometry.GLYPH_SCHEMA), SPEC).table().first()
    assert (got["a"], got["b"]) == ("ALPHA", "BETA")


def test_classes_of_differences(spark):
    cases = [("。 植物志", "° 植物志", "marker-corruption"), ("0 ALPHA", "° ALPHA", "marker-corruption"), ("PEAELNLIGOYOCC", "ALPINEECOLOGYC", "text-layer-reordered"), ("ATTACH/COM", "ATTACH/COMP", "candidate-truncated"), ("ATTACH/COMPX", "ATTACH/COMP", "reference-truncated"), ("WW204815", "W204815", "overprint"), ("ALPHA", "OMEGA", "content-difference"), ("A B", "AB", "presentation-only")]
    df = spark.createDataFrame(cases, "candidate string, reference string, want string")
    got = compare.classify(df).where("kind <> want").collect()
    assert not got


def test_nothing_planned_is_skipped_and_neighbours_are_clean(values):
    counts = {"split_word": 3, "swallow_space": 3, "double_space": 3, "interleave": 2}
    plan = typeset.plan_defects(values, LAYOUT, counts).collect()
    assert {k: sum(r["kind"] == k for r in plan) for k in counts} == counts
    rows = sorted(r["rn"] for r in plan)
    assert all(b - a > 1 for a, b in zip(rows, rows[1:]))
    assert not typeset.plan_defects(values, LAYOUT, {"split_word": 0}).collect()


def test_damaged_pages_recover_wholly(spark, values, words):
    defects = stored(typeset.plan_defects(values, LAYOUT, {"split_word": 3, "swallow_space": 3, "double_space": 3, "interleave": 2}))
    g = stored(typeset.render(values, LAYOUT, defects))
    targets = typeset.ground_truth(values)
    spec = typeset.spec_for(LAYOUT)
    before = geometry.extract(g, spec)
    counts = {r["mode"]: r["count"] for r in compare.compare_all(before.cells(), compare.targets_long(targets)).groupBy("mode").count().collect()}
    assert counts["hard"] == 4 and counts["exact"] >= 13
    done = recover(g, spec, targets, words)
    assert done.rows.count() == 60 and done.matched
    assert compare.compare_all(geometry.cells(done.rows, spec), compare.targets_long(targets)).count() == 0
    s = done.summary().first()
    assert (s["differences"], s["rows_with_problems"], s["balanced"]) == (0, 0, True)
    ops = {r["op"]: r["n"] for r in done.repaired.by_operator.collect()}
    assert ops == {"split-word": 3, "swallowed-space": 3, "double-space": 3, "reassign-window": 2}


def test_without_a_reference_characters_still_balance(spark, values, words):
    defects = stored(typeset.plan_defects(values, LAYOUT, {"split_word": 3, "interleave": 2}))
    done = recover(typeset.render(values, LAYOUT, defects), typeset.spec_for(LAYOUT), None, words)
    assert done.whole_problems.count() == 0 and not done.matched


def test_placeholders_are_reported_not_guessed(spark, values):
    bad = spark.createDataFrame([("doc", 4, 1, "placeholder")], "doc_id string, rn int, col int, kind string")
    done = recover(typeset.render(values, LAYOUT, bad), typeset.spec_for(LAYOUT), typeset.ground_truth(values))
    (diff,) = done.diffs.collect()
    assert (diff["row_no"], diff["candidate"]) == (5, "####")


def test_sharp_s_is_conserved(spark):
    v = spark.createDataFrame([("d", 0, ["1", "DE-1", "Strasse Straße", "x"])], "doc_id string, rn int, values array<string>")
    x = geometry.extract(typeset.render(v, LAYOUT), typeset.spec_for(LAYOUT))
    assert conserve.whole(conserve.page_counts(x.chars, x.spec), x.cells(), x.spec).count() == 0


OVER = ExportLayout((PrintColumn("no", "code", 6), PrintColumn("a", "cjk", 8), PrintColumn("b", "code", 8), PrintColumn("c", "code", 6)))


def overflow(spark, text, free):
    v = spark.createDataFrame([("d", i, [str(i + 1), text if i == 1 else "山地", free if i == 1 else f"x{i}", "z"]) for i in range(4)], "doc_id string, rn int, values array<string>")
    bad = spark.createDataFrame([("d", 1, 1, "overflow")], "doc_id string, rn int, col int, kind string")
    return v, geometry.extract(typeset.render(v, OVER, bad), typeset.spec_for(OVER))


def test_overflow_moves_back(spark):
    v, x = overflow(spark, "山地图鉴AB1", "")
    assert [(r["flag"], r["idx"]) for r in x.flags.where("flag = 'boundary'").collect()] == [("boundary", 2)]
    done = repair.repair(stored(x.rows), x.spec, typeset.ground_truth(v))
    got = geometry.wide(done.rows, x.spec).where("row_no = 2").first()
    assert (got["a"], got["b"]) == ("山地图鉴AB1", "")
    assert [r["op"] for r in done.log.collect()] == ["move-overflow"]
    assert [r["row_no"] for r in done.expected_exceptions.collect()] == [2]


def test_overflow_into_text_is_declined(spark):
    v, x = overflow(spark, "山地图鉴AB1", "")
    rows = x.rows.withColumn("c2", F.when(F.col("row_no") == 2, F.transform("c2", lambda p: repair.with_text(p, F.lit("AB1-Q")))).otherwise(F.col("c2")))
    beside = repair.beside(stored(rows), typeset.ground_truth(v)).withColumn("_notes", F.array().cast(repair.NOTES))
    assert geometry.wide(repair.move_overflow_back(beside, x.spec), x.spec).where("row_no = 2").first()["a"] == "山地图鉴"


def brute_recut(pool, lens, targets, origins, lo):
    from itertools import combinations_with_replacement

    best = None
    for cuts in combinations_with_replacement(range(len(pool) + 1), len(targets) - 1):
        bounds = (0, *cuts, len(pool))
        if all("".join(pool[bounds[k] : bounds[k + 1]]) == t for k, t in enumerate(targets)):
            moved = sum(origins[i] != lo + k for k in range(len(targets)) for i in range(bounds[k], bounds[k + 1]))
            if best is None or moved < best[0]:
                best = (moved, list(bounds[1:]))
    return best and best[1]


def test_recuts_equal_enumeration():
    import random

    rng = random.Random(4)
    hits = 0
    for _ in range(3000):
        w = rng.randrange(2, 5)
        pool = ["".join(rng.choice("AB") for _ in range(rng.randrange(0, 3))) for _ in range(rng.randrange(1, 7))]
        cuts = sorted(rng.randrange(0, len(pool) + 1) for _ in range(w - 1))
        bounds = [0, *cuts, len(pool)]
        targets = ["".join(pool[a:b]) for a, b in zip(bounds, bounds[1:])]
        if rng.random() < 0.3:
            targets[0] += "A"
        origins = sorted(rng.randrange(0, w) for _ in pool)
        got = repair.recut(pool, list(map(len, pool)), targets, origins, 0)
        assert got == brute_recut(pool, None, targets, origins, 0)
        hits += got is not None
    assert hits > 1000


def island(rng, n):
    """Cells of n rows whose letters stand up to two rows from their own; some targets fit nothing."""
    texts = ["".join(rng.choice("ABC") for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    cells = [{"doc_id": "d", "col": 1, "island": 0, "row_no": i, "target": t + "X" * (rng.random() < 0.1), "pieces": [], "hards": []} for i, t in enumerate(texts)]
    at = 0
    for i, t in enumerate(texts):
        at = min(n - 1, max(at, i + rng.choice((-1, 0, 0, 1, 2))))
        for k, ch in enumerate(t):
            cells[at]["pieces"].append({"page": 1, "y": float(10 * i + k), "origin": at, "text": ch})
            cells[at]["hards"].append(ch)
    return cells


def seen(rows):
    return [(r.number, r.pieces, r.changed, r.note) for r in rows]


def test_streamed_islands_equal_whole_ones():
    import random

    rng = random.Random(9)
    notes, widest = 0, 0
    for w in (2, 3, 4):
        for n in (1, 2, 3, 5, 8, 40, 300):
            cells = island(rng, n)
            whole = [repair._Row(c) for c in cells]
            for i in range(n):
                repair._settle(whole, i, w)
            taken = 0

            def one_by_one():
                nonlocal taken
                for c in cells:
                    taken += 1
                    yield repair._Row(c)

            out = []
            for r in repair.settled(one_by_one(), w):
                widest = max(widest, taken - len(out) - 2 * w if taken < n else 0)
                out.append(r)
            assert seen(out) == seen(whole)
            notes += sum(r.note is not None for r in out)
    assert notes > 50 and widest <= 0


def test_a_shifted_reference_streams_through_batches():
    import pyarrow as pa
    import random

    cells = [{**c, "island": k} for k, n in enumerate((700, 3)) for c in island(random.Random(k), n)]
    batches = [pa.RecordBatch.from_pylist(cells[s : s + 97]) for s in range(0, len(cells), 97)]
    got = [r for b in repair._recut_islands(batches, 3) for r in b.to_pylist()]
    wanted = []
    for k in (0, 1):
        own = [repair._Row(c) for c in cells if c["island"] == k]
        for i in range(len(own)):
            repair._settle(own, i, 3)
        wanted += [(r.number, [p[3] for p in r.pieces], r.changed, r.note) for r in own if r.changed or r.note]
    assert [(r["row_no"], [p["text"] for p in r["pieces"]], r["touched"], r["note"]) for r in got] == wanted
    assert len(wanted) > 100
    assert list(repair._recut_islands([], 3)) == []


def test_completion_takes_any_part_up_to_the_limit(spark):
    spec = TableSpec((Column("no", 0.0, "code"), Column("t", 50.0, "en")), 100.0)
    piece = lambda t: [(1, 0.0, 1, t)]
    data = [("d", 1, "1", piece("TACH COM"), "ATTACH/COMP"), ("d", 2, "2", piece("A"), "A" * 20), ("d", 3, "3", piece("ZZ"), "ATTACH"), ("d", 4, "4", [], "ATTACH")]
    rows = spark.createDataFrame([(d, 1, r - 1, r, a, [], p, []) for d, r, a, p, _ in data], f"doc_id string, page int, band int, row_no long, anchor string, c0 array<{geometry.PIECE}>, c1 array<{geometry.PIECE}>, boundaries array<int>")
    targets = spark.createDataFrame([(d, r, [a, t]) for d, r, a, _, t in data], "doc_id string, row_no long, values array<string>")
    done = repair.repair(rows, spec, targets)
    assert [r["t"] for r in geometry.wide(done.rows, spec).orderBy("row_no").collect()] == ["ATTACH/COMP", "A", "ZZ", ""]
    assert [(r["row_no"], r["candidate"]) for r in done.completions.collect()] == [(1, "TACH COM")]


def test_a_remainder_of_letters_is_kept(spark):
    spec = TableSpec((Column("no", 0.0, "code"), Column("t", 50.0, "en")), 100.0)
    rows = spark.createDataFrame([("d", 1, 0, 1, "1", [], [(1, 0.0, 1, "MANUSCRIP"), (1, 4.0, 1, "TCOLLECTION2 END")], [])], f"doc_id string, page int, band int, row_no long, anchor string, c0 array<{geometry.PIECE}>, c1 array<{geometry.PIECE}>, boundaries array<int>")
    words = spark.createDataFrame([("manuscript",), ("collection",)], "word string")
    assert geometry.wide(repair.repair(rows, spec, None, words).rows, spec).first()["t"] == "MANUSCRIPT COLLECTION2 END"


def test_workbooks_and_tables_read_back(spark, values, tmp_path):
    spec = typeset.spec_for(LAYOUT)
    odd = spark.createDataFrame([("doc", 61, ["61", 'q"uo,te', " a\n<b>&_x0041_ ", ""])], "doc_id string, row_no long, values array<string>")
    rows = typeset.ground_truth(values).union(odd)
    path = writers.to_xlsx(rows, spec, str(tmp_path / "deep" / "t.xlsx"), sheet_name="x" * 40)
    assert writers.verify_written(spark, path, rows).count() == 0
    assert writers.verify_written(spark, path, rows.where("row_no < 60")).count() > 0
    out = writers.to_csv(rows, spec, str(tmp_path / "t.csv"))
    back = references.reference_rows(spark, out, spec.names, "doc")
    assert back.count() == 61
    assert sorted(map(tuple, back.select("row_no", F.array_join("values", "|")).collect())) == sorted(map(tuple, rows.select("row_no", F.array_join("values", "|")).collect()))
    parts = writers.csv_parts_back(spark, spec, writers.csv_parts(rows, spec, str(tmp_path / "parts")))
    assert sorted(map(tuple, parts.select("row_no", F.array_join("values", "|")).collect())) == sorted(map(tuple, rows.select("row_no", F.array_join("values", "|")).collect()))


def test_ruled_tables_and_the_probe(spark, values):
    g, rules = typeset.render(values, LAYOUT), typeset.ruled(values, LAYOUT)
    found = bordered.bordered_tables(g, rules).orderBy("page").collect()
    assert [(r["n_rows"], r["n_cols"]) for r in found] == [(40, 4), (20, 4)]
    assert found[0]["rows"][1][1] == "XX-1001"
    pages = spark.createDataFrame([("doc", 2), ("none", 0)], "doc_id string, n_pages int")
    got = {r["doc_id"]: (r["strategy"], r["pages_probed"], r["rows_seen"]) for r in bordered.probe(pages, g, rules).collect()}
    assert got == {"doc": ("bordered", 2, 60), "none": ("unknown", 0, 0)}
    assert bordered.probe(pages, g, rules.limit(0)).where("doc_id = 'doc'").first()["strategy"] == "borderless"


def test_checks(spark):
    rows = spark.createDataFrame([("d", 1, "1", "a"), ("d", 2, "3", "a"), ("d", 3, "3", "b"), ("d", 4, "####", "b")], "doc_id string, row_no long, anchor string, name string")
    assert [r["row_no"] for r in checks.anchor_gaps(rows).orderBy("row_no").collect()] == [2, 3, 4]
    assert [(r["key"], r["n"]) for r in checks.repeated(rows).collect()] == [("3", 2)]
    assert [(r["given"], r["n"]) for r in checks.dependencies(rows, "anchor", "name").collect()] == [("3", 2)]


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], geometry.GLYPH_SCHEMA)
    x = geometry.extract(none, SPEC)
    assert x.table().count() == 0 and x.flags.count() == 0
    assert conserve.whole(conserve.page_counts(x.chars, SPEC), x.cells(), SPEC).count() == 0


def test_the_catalogue_needs_every_repair(spark):
    from printloom.plans import catalogue

    done = catalogue.recovered(spark)
    assert done.diffs.count() == 0 and done.row_problems.count() == 0 and done.whole_problems.count() == 0
    assert {r["op"]: r["n"] for r in done.repaired.by_operator.collect()} == {"split-word": 1, "swallowed-space": 1, "move-overflow": 1, "double-space": 1, "reassign-window": 1}

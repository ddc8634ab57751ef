import pytest
from pyspark.sql import functions as F

from printloom.operators import typeset
from printloom.operators.typeset import ExportLayout, PrintColumn
from printloom.plans import cli
from printloom.sources import layouts, pdf, writers
from printloom.sources.files import document_name

LAYOUT = ExportLayout((PrintColumn("no", "code", 6), PrintColumn("name", "en", 20), PrintColumn("note", "code", 14)), watermark="S A M P L E")


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pdf")
    values = spark.createDataFrame([("doc", i, [str(i + 1), ("Élan (old) \\ wood" if i == 3 else f"Name {i}"), f"x-{i}"]) for i in range(45)], "doc_id string, rn int, values array<string>")
    pdf.write_pdf(str(folder / "doc.pdf"), typeset.render(values, LAYOUT).collect(), typeset.ruled(values, LAYOUT).collect())
    return folder, values


def test_printed_files_recover(spark, files, tmp_path):
    folder, values = files
    spec = typeset.spec_for(LAYOUT)
    layouts.save(spec, str(tmp_path / "layout.json"))
    reference = tmp_path / "reference"
    writers.to_csv(typeset.ground_truth(values), spec, str(reference / "doc.csv"))
    done, good = cli.run_extract(spark, str(folder), spec, str(tmp_path / "out"), str(reference))
    assert good and done.matched and done.rows.count() == 45
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"doc.csv", "doc.xlsx", "doc.md"}
    got = {r["row_no"]: r["values"] for r in done.values.collect()}
    assert got[4] == ["4", "Élan (old) \\ wood", "x-3"]


def test_probe_and_recon_of_files(spark, files):
    folder, _ = files
    r = cli.probe(spark, str(folder)).first()
    assert (r["strategy"], r["pages_probed"], r["rows_seen"]) == ("bordered", 2, 45)
    objs = cli.recon(spark, str(folder), None, [-1])
    assert {x["page"] for x in objs.select("page").distinct().collect()} == {2}
    assert objs.where(F.col("text") == "Name 44").count() == 1


@pytest.mark.parametrize("data", [b"", b"no pdf", b"%PDF-1.4\n1 0 obj << /Encrypt 2 0 R >> endobj", b"%PDF-1.4\n1 0 obj " + b"[" * 500, b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [2 0 R] >> endobj"])
def test_broken_files_are_refused(data):
    with pytest.raises(ValueError):
        pdf.Document(data).pages()


def test_fonts_and_text_operators():
    doc = pdf.Document(b"""%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R] /MediaBox [0 0 100 200] >> endobj
3 0 obj << /Type /Page /Contents 4 0 R /Resources << /Font << /A 5 0 R >> >> >> endobj
4 0 obj << /Length 91 >>
stream
q 1 0 0 1 10 0 cm BT /A 10 Tf 12 TL 0 100 Td [(A) -500 (\\102)] TJ T* <43> Tj ET Q 0 0 m 50 0 l S
endstream endobj
5 0 obj << /Type /Font /Subtype /Type1 /FirstChar 65 /Widths [500 600 700] >> endobj
""")
    glyphs, boxes = pdf.page_items(doc, doc.pages()[0])
    assert [(g[0], g[2], g[3], g[5]) for g in glyphs] == [(0, "A", 10.0, 15.0), (0, "B", 20.0, 26.0), (1, "C", 10.0, 17.0)]
    assert boxes == [(0.0, 200.0, 50.0, 200.0)]


def test_files_of_one_name_and_damaged_ones(spark, tmp_path):
    glyph = {"page": 1, "line_no": 0, "seq": 0, "ch": "a", "x0": 20.0, "y0": 30.0, "x1": 24.0, "y1": 33.0, "line_y": 30.0}
    for folder, ch in (("a", "x"), ("b", "y")):
        (tmp_path / folder).mkdir()
        pdf.write_pdf(str(tmp_path / folder / "one.pdf"), [glyph | {"ch": ch}])
    (tmp_path / "b" / "bad.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "b" / "worse.pdf").write_bytes(b"no file of the kind")
    path = f"{tmp_path}/*/*.pdf"
    assert sorted((r["doc_id"], r["ch"]) for r in pdf.read_glyphs(spark, path).collect()) == [("a/one", "x"), ("b/one", "y")]
    pages = {r["doc_id"]: r["n_pages"] for r in pdf.read_pages(spark, path).collect()}
    assert pages["a/one"] == 1 and pages["b/worse"] == 0
    assert "b/worse" in {r["doc_id"] for r in pdf.read_errors(spark, path).collect()} and pdf.read_rules(spark, path).count() == 0
    assert document_name("file:/x/y/z.pdf", "/x/y/z.pdf") == "z" and document_name("file:/x/y.d/z", "file:///x") == "y.d/z"

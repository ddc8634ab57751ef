from pyspark.sql import functions as F

from printloom.operators import conserve, geometry, typeset
from printloom.operators.typeset import ExportLayout, PrintColumn
from printloom.streaming import pages

LAYOUT = ExportLayout((PrintColumn("no", "code", 6), PrintColumn("name", "en", 16)))


def test_streams_of_pages_equal_the_batch(spark):
    values = spark.createDataFrame([(d, i, [str(i + 1), f"Name {d}{i}"]) for d in ("a", "b") for i in range(90)], "doc_id string, rn int, values array<string>")
    glyphs, spec = typeset.render(values, LAYOUT), typeset.spec_for(LAYOUT)
    path = pages.as_files(glyphs)
    got = pages.recover_stream(spark, path, spec, files_per_batch=1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, geometry.extract(glyphs, spec).table().collect()))
    assert got.count() == 180
    query = pages.character_counts(pages.read_pages(spark, path, 1)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    whole = conserve.exploded(glyphs, ["doc_id"], "ch")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, whole.select("doc_id", "ch", F.col("n")).collect()))

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from maintspark.functions.text import ata_chapter, dmc_code, keyword_boost
from maintspark.operators import reliability
from maintspark.sources import tables
from maintspark.streaming import streams


def test_xml_text(spark):
    assert tables.xml_text("<a x='1'>t<b>u</b>v</a>") == "t 1 u v"
    assert tables.xml_text("<p>open") is None and tables.xml_text(None) is None
    rows = tables.with_xml_text(spark.createDataFrame([("<a>hi</a>",), ("<br>",)], "content string")).collect()
    assert [r.text for r in rows] == ["hi", None]


def test_append_new(spark, tmp_path):
    docs = spark.createDataFrame([("a", [1.0], "x"), ("b", [2.0], "y"), ("a", [1.0], "z")], tables.CORPUS)
    for _ in range(2):
        tables.append_new(spark, docs, str(tmp_path / "store"))
    assert sorted(r.doc_path for r in spark.read.parquet(str(tmp_path / "store")).collect()) == ["a", "b"]


def test_recurrence_stream_equals_batch(spark, tmp_path):
    rows = [(f"2{i % 3}", datetime(2024, 1, 1) + timedelta(days=(i * i) % 140, hours=i % 24)) for i in range(300)]
    df = spark.createDataFrame(rows, "ata_code string, occurrence_date timestamp")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = streams.recurrence(streams.run_to_table(streams.daily_panes(stream), f"file://{tmp_path}/run")).collect()
    last = max(t for _, t in rows) - timedelta(days=1)
    assert {(r.ata_code, r.day) for r in got} == {(a, t.date()) for a, t in rows if datetime.combine(t.date(), datetime.min.time()) + timedelta(days=1) <= last}
    for r in got[::7]:  # the report of the moment when the day ends
        end = datetime.combine(r.day, datetime.min.time()) + timedelta(days=1)
        one = reliability.recurrence(df.where((F.col("ata_code") == r.ata_code) & (F.col("occurrence_date") < F.lit(end))), F.lit(end)).first()
        assert (r.n30, r.n60, r.n90) == (one.n30, one.n60, one.n90)


def test_functions(spark):
    r = spark.createDataFrame([("xml/dmc-39-A-24-10-00-00A-100A-A.xml", "see ATA 24-30 now", "engine will not start", "it does not start: fault isolation, crank")], "p string, t string, q string, d string").select(dmc_code(F.col("p")).alias("c"), ata_chapter(F.col("t")).alias("a"), keyword_boost(F.col("q"), F.col("d")).alias("b")).first()
    assert (r.c, r.a, round(r.b, 2)) == ("39-A-24-10-00-00A-100A-A", "ATA 24-30", 0.25)

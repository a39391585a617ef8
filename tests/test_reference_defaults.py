from pyspark.sql import functions as F

from maintspark.functions.text import ata_chapter, keyword_boost
from maintspark.operators import extract, history


def test_stop_words(spark):
    p = spark.createDataFrame([(1, "With this aircraft on ground the hydraulic pump shows pressure loss during taxi", "24", "31000")], "query_id long, problem string, ata string, serial_number string")
    assert p.select(history.keywords(F.col("problem"))).first()[0] == ["hydraulic", "pump", "pressure", "loss", "taxi"]
    h = spark.createDataFrame([(1, "24", "1", 5, "this aircraft on ground", "resolved"), (2, "24", "1", 4, "pump pressure low", "resolved")], "id long, ata string, aircraft_serial string, resolved_seq long, problem string, solution_status string")
    assert [(r.id, r.score) for r in history.similar_cases(p, h).collect()] == [(2, 2)]


def test_units(spark):
    texts = ["5 lb-in, 6 lb-ft, 7 N m, 8 lbf in", "3 MPa 4 mV 5 kV", "2 m 3 in 4 ft", "10 Ω and 2 MΩ, 1 ohm", "12 volts, 3 inches, 5 amperes"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(extract.evidence_units(F.col("t"))).collect()
    assert [r[0] for r in got] == [4, 3, 3, 3, 0]


def test_chapters(spark):
    texts = ["ATA: 24-30", "ATA:24", "ATA Chapter: 24", "ata 24 30", "chapter 24", "ATA 29 then ATA 24-30", "ATA 29 then ATA Chapter 24"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(ata_chapter(F.col("t"))).collect()
    assert [r[0] for r in got] == ["ATA 24-30", "ATA 24", "ATA 24", "ATA 24-30", "", "ATA 24-30", "ATA 24"]


def test_boost(spark):
    rows = [("crank fails", "engine start"), ("power lost", "wiring diagram"), ("check the pin", "wiring diagram"), ("starter fails", "awdp")]
    got = spark.createDataFrame(rows, "q string, d string").select(keyword_boost(F.col("q"), F.col("d"))).collect()
    assert [round(r[0], 6) for r in got] == [0, 0, 0.12, 0.08]

from pyspark.sql import functions as F

from maintspark.operators import effectivity, extract, fleet, records


def test_quick_check(spark):
    requests = spark.createDataFrame([(31010, "SN", "*e0001, e2; EN sn")], "serial int, configuration string, pasted string")
    codes = spark.createDataFrame([(31010, "E0001")], "serial int, code string")
    assert {(r.token, r.applies) for r in records.quick_check(requests, codes).collect()} == {("E0001", True), ("E2", False), ("EN", False), ("SN", True)}


def test_extracts(spark):
    row = spark.createDataFrame([("45% worn seal ring. 60% broken output shaft. Torque 12 Nm, 28 VDC",)], "t string")
    r = row.select(extract.likely_causes(F.col("t")).alias("c"), extract.evidence_units(F.col("t")).alias("n")).first()
    assert [(c.cause, c.probability) for c in r.c] == [("broken output shaft", 60), ("worn seal ring", 45)] and r.n == 1


def test_configurations(spark):
    aircraft = spark.createDataFrame([(1, "S/N 31010"), (2, "41500"), (3, "N/A"), (4, "60000"), (5, "61999")], "aircraft_id long, serial_number string")
    got = {r.aircraft_id: (r.configuration, r.warning) for r in effectivity.resolve_configuration(aircraft, effectivity.serial_ranges(spark)).collect()}
    assert got == {1: ("SN", None), 2: (None, "not found"), 3: (None, "invalid format"), 4: (None, "not found"), 5: ("PLUS", None)}


def test_durations(spark):
    df = spark.createDataFrame([(59,), (125,), (4560,)], "m long").select(fleet.format_duration(F.col("m")).alias("s"))
    assert [r.s for r in df.collect()] == ["59m", "2h 5m", "3d 4h"]

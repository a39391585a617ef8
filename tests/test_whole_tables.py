from maintspark.operators import fleet, records
from maintspark.plans import registry

SF = "/root/testdata/sf0.001"


def test_queries_take_every_row(spark):
    view = lambda name: registry.view(spark, SF, name)
    run = lambda name: registry.QUERIES[name](spark, SF)
    parts = {r.part_number: r.failure_rate for r in view("parts").collect()}
    got = {r.part_number: r.failure_rate for r in run("upsert_from_all_replacements").collect()}
    assert parts.items() <= got.items()
    ranged = {r.code for r in view("part_code_ranges").collect()}
    assert {r.code for r in run("codes_without_any_range").collect()} == {r.code for r in view("part_codes").collect()} - ranged
    asked = {r.query_id for r in view("problems").collect()} & {r.id for r in view("history").collect()}
    assert len(asked) > 7 and {r.id for r in run("apply_all_solutions").where("solution is not null").collect()} == asked
    docs = {r.doc_id for r in view("corpus").collect()}
    merged = run("merge_all_unique").collect()
    assert {r.doc_id for r in merged} == docs and len({r.query_id for r in merged}) > 1
    assert run("whole_maintenance_log").count() == view("maintenance_logs").count()


def test_what_the_other_side_lacks(spark):
    codes, ranges = spark.createDataFrame([("E1",), ("E2",)], "code string"), spark.createDataFrame([("E2", 1)], "code string, serial_start int")
    assert [r.code for r in records.codes_without_ranges(codes, ranges).collect()] == ["E1"]
    parts = spark.createDataFrame([("P1", "a", "24", 2, 7)], "part_number string, description string, ata_code string, times_replaced int, failure_rate int")
    replaced = spark.createDataFrame([(1, "P1", "24"), (2, "P2", "29")], "id long, part_on_pn string, ata_code string")
    assert {(r.part_number, r.times_replaced, r.failure_rate) for r in fleet.upsert_from_replacements(parts, replaced).collect()} == {("P1", 3, 7), ("P2", 1, 0)}

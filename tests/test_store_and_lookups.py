from datetime import datetime, timedelta

from pyspark.sql import functions as F

from maintspark.functions.text import first_distinct, is_wiring_doc, truncated
from maintspark.operators import extract, fleet, records
from maintspark.sources import tables
from maintspark.streaming import streams


def test_connector_and_experts(spark):
    tools = spark.createDataFrame([("MS3126 series", "crimp A"), ("D38999", "crimp B")], "connector_type string, crimp_tool string")
    asked = spark.createDataFrame([("d38",), ("ms31",), ("none",)], "connector_query string")
    assert sorted(r.crimp_tool for r in records.match_connector(tools, asked).collect()) == ["crimp A", "crimp B"]
    experts = spark.createDataFrame([(1, "t", "B", 1, None), (2, "t", "A", 1, None), (3, "t", "C", 0, None), (4, "u", "D", 1, None), (5, "t", "E", 1, "gone")], "id int, tenant_id string, name string, available int, deleted_at string")
    assert [r.id for r in records.active_experts(experts, "t").collect()] == [2, 1]


def test_escalations_keep_diagnoses_without_bookings(spark):
    diagnoses = spark.createDataFrame([(1, "REQUIRE_EXPERT"), (2, "SAFE_TO_PROCEED"), (3, "REQUIRE_EXPERT"), (4, None)], "id int, certainty_status string")
    bookings = spark.createDataFrame([(11, 1, 7, "open"), (10, 1, 8, "done"), (12, 2, 7, "open")], "id int, query_id int, expert_id int, status string")
    got = {r.id: r.bookings and [b.id for b in r.bookings] for r in records.escalations(diagnoses, bookings).collect()}
    assert got == {1: [10, 11], 3: None}


def test_solutions_set_all_columns_once(spark):
    history = spark.createDataFrame([(1, "pending", "old"), (2, "pending", "kept"), (3, "resolved", None)], "id int, solution_status string, solution string")
    parts = "array<struct<part_off_pn:string,part_on_pn:string,quantity:int>>"
    solutions = spark.createDataFrame(
        [(1, "first", 1, "T", [("a", "b", 1)]), (1, "last", 2, "U", [("c", "d", 1), ("e", "f", 2)]), (1, "also last", 2, "V", []), (9, "unknown", 1, "W", [("x", "y", 1)])],
        f"history_id int, solution string, submitted_at int, technician_name string, replaced_parts {parts}",
    )
    out = records.apply_solutions(history, solutions)
    assert len(set(out.columns)) == len(out.columns)
    got = {r.id: (r.solution_status, r.solution, r.technician_name, r.resolved_at) for r in out.collect()}
    assert got == {1: ("resolved", "last", "U", 2), 2: ("pending", "kept", None, None), 3: ("resolved", None, None, None)}
    assert sorted((r.troubleshooting_id, r.part_on_pn, r.quantity) for r in records.solution_parts(history, solutions).collect()) == [(1, "d", 1), (1, "f", 2)]


def test_gates_and_texts(spark):
    df = spark.createDataFrame([(0.95, "s" * 800), (0.94, "s" * 800), (None, "short")], "c double, t string")
    low = [(r.g.low_certainty, len(r.g.snippet)) for r in df.select(extract.connector_gate(F.col("c"), F.col("t")).alias("g")).collect()]
    assert low == [(False, 800), (True, 750), (True, 5)]
    assert not df.select(extract.connector_gate(F.col("c"), F.col("t"), missing="high").alias("g")).collect()[2].g.low_certainty
    docs = spark.createDataFrame([("x/39-A-AWDP-1.xml", "text"), ("a.xml", "see the Wiring Diagram below"), ("a.xml", "z" * 1000 + "wiring diagram"), ("a.xml", None)], "p string, t string")
    assert [bool(r.w) for r in docs.select(is_wiring_doc(F.col("p"), F.col("t")).alias("w")).collect()] == [True, True, False, False]
    assert [r.t for r in docs.select(truncated(F.col("t"), F.col("p"), 5).alias("t")).collect()] == ["[FALLBACK] x/39-A-AWDP-1.xml", "see t", "zzzzz", "[FALLBACK] a.xml"]
    lists = spark.createDataFrame([(["b", "a"], ["a", "c", "d"])], "x array<string>, y array<string>")
    assert lists.select(first_distinct(F.col("x"), F.col("y"), most=3).alias("f")).first().f == ["b", "a", "c"]


def test_minutes_round_half_up(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 0), datetime(2024, 1, 1, 0, 1, 30)), (datetime(2024, 1, 1, 0, 1, 30), datetime(2024, 1, 1)), (datetime(2024, 1, 1), None)], "a timestamp, b timestamp")
    assert [r.m for r in df.select(fleet.minutes(F.col("a"), F.col("b")).alias("m")).collect()] == [2, -1, None]


def test_corpus_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.XML").write_text("<a>x</a>")
    (tmp_path / "in" / "deep" / "b.xml").write_text("<b>y</b>")
    (tmp_path / "in" / "c.txt").write_text("no")
    files = tables.list_xml(spark, str(tmp_path / "in"))
    assert sorted(r.path.rpartition("/")[2] for r in files.collect()) == ["a.XML", "b.xml"]
    store = files.where(F.col("path").endswith("b.xml")).select(F.col("path").alias("doc_path"))
    assert [r.path.rpartition("/")[2] for r in tables.new_documents(files, store).collect()] == ["a.XML"]
    legacy = tmp_path / "old.json"
    legacy.write_text('[{"doc_path": "p", "embedding": [1.0, 2.0], "text": "t"}, {"doc_path": "q", "text": "u"}]')
    assert [r.doc_path for r in tables.read_corpus_json(spark, str(tmp_path / "new.json"), str(legacy)).collect()] == ["p"]


def test_reports(spark):
    docs = spark.createDataFrame([("a", None), ("c", "bad"), ("b", "bad"), ("d", "none")], "path string, error string")
    assert {r.error: (r.n, r.example) for r in tables.error_report(docs).collect()} == {"bad": (2, "b"), "none": (1, "d")}
    assert tuple(tables.checkpoint_summary(docs).first()) == (1, 3, 4)
    pages = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("a", 10, "ten")], "path string, page int, text string")
    assert tables.page_text(pages).first().text == "one\ntwo\nten"


def test_ingest_stream_adds_once(spark, tmp_path):
    schema = tables.CORPUS
    for name in ("one", "two"):
        spark.createDataFrame([(name, [1.0], "t"), ("both", [1.0], "t")], schema).write.mode("append").parquet(str(tmp_path / "in"))
        streams.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "at")).awaitTermination(120)
    assert sorted(r.doc_path for r in spark.read.parquet(str(tmp_path / "store")).collect()) == ["both", "one", "two"]


def test_downtime_stream_pairs_by_user_after_any_delay(spark, tmp_path):
    opens, closes = "record_id int, user_id int, started_at timestamp", "record_id int, user_id int, resolved_at timestamp"
    day = lambda n, minute=0, second=0: datetime(2024, 1, 1, 0, minute, second) + timedelta(days=n)
    runs = [
        ([(1, 7, day(0)), (2, 7, day(1)), (3, 7, day(1)), (4, None, day(1))], [(1, 7, day(0, 2, 30)), (2, 8, day(2)), (5, 7, day(3)), (5, 8, day(2))]),
        ([(5, 8, day(0))], [(2, 7, day(62)), (1, 7, day(0, 1)), (1, 7, day(0, 4))]),
        ([], [(3, 9, day(400))]),
    ]
    want = [{1: 3}, {1: 4, 2: 61 * 1440, 5: 2 * 1440}, {1: 4, 2: 61 * 1440, 5: 2 * 1440}]
    for (one, two), expected in zip(runs, want, strict=True):
        for name, rows, schema in (("open", one, opens), ("close", two, closes)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        read = lambda name, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
        rows = streams.run_to_table(streams.downtime(read("open", opens), read("close", closes)), f"file://{tmp_path}/run", "update")
        assert {r.record_id: r.downtime_minutes for r in streams.latest_downtime(rows).collect()} == expected

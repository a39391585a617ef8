import re

from pyspark.sql import functions as F

from maintspark.operators import assessment, catalogue, extract, findings, manuals
from maintspark.sources import tables


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    got = spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]
    return got


def test_cleaning(spark):
    t = "## Head\n\n**bold** and *slim* _under_ `code`\n- item\n---\n1. Open it 2. Close it\nsee [link](http://x) TPD_PSE;12;; TPD_PSE;13;; TPD_PSE;14;;\n\n\n\nend"
    assert one(spark, findings.clean_markdown(F.col("t")), t=t) == "Head\n\nbold and slim under code\n item\n\n1. Open it\n\n2. Close it\nsee link (PSE Ref: 12, PSE Ref: 13) (PSE Ref: 14)\n\nend"
    assert one(spark, findings.fix_part_numbers(F.col("t")), t="valve 3G1234-A (AB\nrelay K12345 (\nkept 3G1234 (see x)") == "valve 3G1234-A\nrelay K12345\nkept 3G1234 (see x)"


def test_extraction(spark):
    t = "P/N: abc-12345 and 3g2400A001, again 3G2400A001; AMM 24-30-00, amm-24-30-00, CMM 12-34, IPD x1"
    assert [tuple(r) for r in one(spark, findings.part_numbers(F.col("t")), t=t)] == [("3G2400A001", "AW139 Component"), ("ABC-12345", "Identified Part")]
    assert one(spark, findings.references(F.col("t")), t=t) == ["AMM-24-30-00", "IPD-X1", "CMM-12-34"]
    assert one(spark, findings.parts_simple(F.col("t")), t="P/N 12-3, part no: 7, 3G1234AB 123456-01")[:2] == ["12-3", "7"]
    assert [(r.doc_id, r.section) for r in one(spark, findings.manual_references(F.col("t")), t="AMM 24-30-00 and AMP-X1")] == [("AMM 24-30-00", "24-30-00"), ("AMP-X1", "X1")]
    assert one(spark, findings.part_numbers(F.col("t")), t=None) == [] and one(spark, findings.references(F.col("t")), t="") == []


def test_causes(spark):
    causes = lambda t: [tuple(r) for r in one(spark, findings.likely_causes(F.col("t")), t=t)]
    assert causes("20%: worn seal, of the pump.\n3% nothing at all here.\nBroken output shaft (60%)") == [("Broken output shaft", 60), ("worn seal, of the pump", 20)]
    assert causes("the wiring and a sensor, component, corrosion") == [("Component Failure", 35), ("Wiring Fault", 25), ("Corrosion", 15)]
    assert causes(None) == []
    said = "first long cause (10%) second long cause (20%) third long cause\n(30%) and a fourth cause (40%). x 50 %: of\nsomething else (60 %) long enough here\n(70%)"
    rows = [(c, int(p)) for p, c in re.findall(r"(\d{1,3})\s*%[:\s]*([^.\n]+)", said)] + [(c, int(p)) for c, p in re.findall(r"([^.\n]+)\s*\((\d{1,3})\s*%\)", said)]
    assert causes(said) == sorted([(c.strip(), p) for c, p in rows if len(c.strip()) > 10], key=lambda r: -r[1])[:5]
    assert causes("no share here " * 20000) == []
    assert [tuple(r) for r in one(spark, findings.causes_by_keyword(F.col("t")), t="worn, faulty, corroded, contaminated")] == [("Component Failure", 35), ("Wear and Degradation", 25), ("Corrosion", 15)]
    assert [tuple(r) for r in one(spark, findings.causes_by_keyword(F.col("t")), t=None)] == [("Further investigation required", 30)]


def test_tests_and_steps(spark):
    got = one(spark, findings.recommended_tests(F.col("t"), F.col("a")), t="Check the pump per AMM 24-30 now. Ok. Measure voltage at the pin 3!", a="ATA 24")
    assert [(r.step, r.reference) for r in got] == [(1, "AMM 24-30"), (2, "AMP-24-00")]
    assert [r.reference for r in one(spark, findings.recommended_tests(F.col("t"), F.col("a")), t=None, a="")] == ["AMP-XX-00-10", "AWD-XX-00-20", "AMM-XX-10-00"]
    assert [r.description for r in one(spark, findings.numbered_steps(F.col("t"), F.col("a")), t="Step 1: open it. - then check oil level.", a="24")] == ["open it.", "check oil level.", "then check oil level."]
    assert len(one(spark, findings.numbered_steps(F.col("t"), F.col("a")), t="", a="24")) == 3


def test_wiring(spark):
    w = lambda t, d: tuple(one(spark, findings.wiring_refs(F.col("t"), F.col("d")), t=t, d=d))
    assert w("see 39-A-AWDP-24-00X", ["a wiring diagram x"]) == (True, "Referenced in procedure, 39-A-AWDP-24-00X")
    assert w("a Schematic", ["plain"]) == (True, "Referenced in procedure") and w("plain", []) == (False, "")


def test_texts(spark):
    d = lambda a, c: one(spark, findings.diagnosis_text(F.col("q"), F.col("a"), F.col("c")), q="Q", a=a, c=c)
    assert d("One.  Two! Three? Four.", [" doc ", ""]) == "One. Two! Three?\n\nFour.\n\nSupporting documentation indicates: doc"
    assert d(None, []).startswith("Unable to retrieve documentation for query: Q.") and d(None, [""]) == "No detailed diagnosis available."
    assert one(spark, findings.verification(F.col("t")), t="1. go\n39-A-24-30") == "VERIFIED - NO CORRECTIONS"


def test_flags_and_scores(spark):
    t = "The starter relay is worn because the contactor fails to close. Caution: use a torque wrench, 28 V at pin 12. 45% likely, see 39-A-24-30-00-00A-520A-A and AMM 24-30-00"
    f = one(spark, assessment.flags(F.col("t")), t=t)
    true = {k for k, v in f.asDict().items() if v}
    assert true == {"dmc", "full_dmc", "amp", "component", "causal", "failure_mode", "ranking", "signal_path", "steps", "tool", "safety", "connector_pin"}
    both = F.struct(assessment.subsystems(F.col("q"), F.col("t")).alias("s"), assessment.alignment(F.col("q"), F.col("t"), assessment.flags(F.col("t")), assessment.subsystems(F.col("q"), F.col("t"))["missing"]).alias("a"))
    got = one(spark, both, q="[x] AW139 ATA 24 generator does not start", t=t)
    assert got.s.inferred == ["Engine/Powerplant System", "Electrical Power System"] and got.s.missing == ["Engine/Powerplant System"] and got.a == 25
    assert one(spark, assessment.alignment(F.col("q"), F.col("t"), assessment.flags(F.col("t")), F.array()), q="relay worn quickly", t=t) == 100
    assert one(spark, extract.evidence_units(F.col("t")), t="28 VDC and 28 V") == 1


def test_report(spark):
    t = "First verify the starter relay K1 is energized because the contactor fails to close. 80% probability of worn brush. Wire 12 from the switch to the relay. 28 V, 5 A, AMM 24-30-00 and AWD 24\n1. go"
    rows = [(1, "starter relay worn", t, "fault_isolation", True), (2, None, None, "install_procedure", None), (3, "x", "", "other", False)]
    d = spark.createDataFrame(rows, "query_id int, query string, diagnosis string, task_type string, has_wiring boolean")
    docs = spark.createDataFrame([(1, 0.9)] * 4, "query_id int, score double")
    got = {r.query_id: r for r in assessment.report(d, docs, score_col="score").collect()}
    assert (got[1].coverage, got[1].diagram, got[1].evidence) == (100, 100, 60) and (got[1].alignment, got[1].certainty) == (25, 70)  # 69.5, half to even
    assert (got[2].certainty, got[2].certainty_status, got[2].coverage) == (40, "REQUIRE_EXPERT", 0) and len(got) == 3


def test_query_shaping(spark):
    q = lambda t: one(spark, manuals.query_type(F.col("t")), t=t)
    assert [q(t) for t in ("HEATER FAIL adjust", "altimeter showing 100 feet", "how to do it", "generator output", "hm", None)] == ["fault_code", "calibration", "procedure", "electrical", "general", "general"]
    assert one(spark, manuals.enhance_query(F.col("q"), F.col("a")), q="x", a="PT6C_67CD") == "PT6C-67CD engine: x" and one(spark, manuals.enhance_query(F.col("q"), F.col("a")), q="x", a="24") == "ATA 24: x"
    assert spark.createDataFrame([("AB", "ab"), ("", "x"), (None, None)], "a string, b string").select(manuals.relevance("a", "b").alias("r")).toPandas()["r"].tolist() == [1.0, 0.0, 1.0]


def test_search_and_wiring(spark):
    docs = spark.createDataFrame([(1, "d/dmc-39-A-24-00.xml", "pump", [1.0, 0.0]), (2, "d/39-a-awdp-24-1.xml", "wires", [-1.0, 0.1]), (3, "d/dmc-39-A-32-00.xml", "gear", [1.0, 0.0]), (4, "d/x.xml", "turbine", [0.0, 1.0])], "doc_id long, doc_path string, text string, embedding array<float>")
    rows = [(1, "generator off", [1.0, 0.0], "24"), (2, "oil", [1.0, 0.0], "99"), (3, "oil", [0.5, 1.0], "PT6C_67CD"), (4, "oil", [1.0, 0.0], None), (5, "oil", [1.0, 0.0], "AW139_AIRFRAME")]
    found = manuals.search(docs, spark.createDataFrame(rows, "query_id long, query string, embedding array<float>, filter string"))
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {1: [1, 2], 2: [1, 3], 3: [4], 4: [1, 3], 5: [1, 3]}  # of material 5 nothing is there: the first ten
    assert {r.query_id: r.primary_id for r in manuals.primary_id(found).collect()}[1] == "39-A-24-00"


def test_ranges(spark):
    text = "S/N 31005 thru 31010\nS/N 31020 THRU tbd\nS/N TBD thru 5\nS/N 7 and subsequent\nS/N 40 and 50\nS/N 3\nS/N 31007\nS/N 60 thru TBD"
    got = [tuple(r) for r in one(spark, catalogue.parse_ranges(F.col("t")), t=text)]
    assert got == [(31005, 31010), (31020, 99999), (60, 99999), (1, 5), (7, 99999), (40, 40), (50, 50)]
    assert [tuple(r) for r in one(spark, catalogue.parse_ranges(F.col("t")), t="S/N 31005 and 31010 subsequent")] == [(31005, 31005), (3101, 3101)]
    assert one(spark, catalogue.parse_ranges(F.col("t")), t=None) == []


def test_effectivity_file(spark, tmp_path):
    (tmp_path / "list.txt").write_text("Title\n*NOT\n- No code (blank)\n:\nAll aircraft\n*A1\n-\n: Short nose\n- S/N 31005 thru 31010\n*B2\nDeleted\nS/N 1 thru 2\n*C3\nequipped with P/N 3G99 kit\nS/N 7\n*D4\nS/N 8\n*A1\nAgain\nS/N 9\n")
    codes, ranges, stats = catalogue.load(tables.read_effectivity_text(spark, str(tmp_path)))
    assert [tuple(r) for r in codes.orderBy("code").collect()] == [("A1", "Short nose", 0, 0, None), ("ALL", "All aircraft", 0, 0, None), ("B2", "Deleted", 1, 0, None), ("C3", "equipped with P/N 3G99 kit", 0, 1, "3G99"), ("D4", "S/N 8", 0, 0, None)]
    assert sorted(tuple(r) for r in ranges.collect()) == [("A1", 9, 9), ("A1", 31005, 31010), ("C3", 7, 7), ("D4", 8, 8)]
    s = stats.first()
    assert (s.codes, s.conditional, s.without_ranges) == (5, 1, 1)
    folder = str(tmp_path / "store")
    assert catalogue.store(codes, ranges, folder) and not catalogue.store(codes, ranges, folder)


def test_ingest(spark, tmp_path):
    xml = spark.createDataFrame([("a/x.xml", b"<a>one two three four five six<b>seven</b></a>"), ("a/bad.xml", b"<a>"), ("a/old.xml", b"<a/>")], "path string, content binary")
    pages = spark.createDataFrame([("p.pdf", 2, "second page text"), ("p.pdf", 1, "first page text")], "path string, page int, text string")
    got = {r.path: (r.text, r.error, r.kind_order) for r in tables.corpus(xml, pages, spark.createDataFrame([("a/old.xml",)], "doc_path string")).collect()}
    assert got == {"a/x.xml": ("one two three four five six seven", None, 0), "a/bad.xml": (None, "parse error", 0), "p.pdf": ("first page text\nsecond page text", None, 1)}
    tables.write_report(spark.createDataFrame([(1, 0.5)], "id int, r double"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1
    assert tables.union_store(pages, pages).count() == 4
    pages.write.parquet(str(tmp_path / "t"))
    assert tables.read_table(spark, str(tmp_path / "t"), "path string, page int").columns == ["path", "page"]

from maintspark.operators import certainty


def make(spark, **over):
    row = {"coverage": 100, "system": 100, "evidence": 100, "alignment": 100, "diagram": 100, "evidence_count": 9} | dict.fromkeys(certainty.FLAGS, False)
    row |= {"component": True, "causal": True, "amp": True, "awdp_doc": True, "is_fault": True} | over
    return certainty.score(spark.createDataFrame([row])).first()


def test_gate_caps_and_floor(spark):
    assert (make(spark).certainty, make(spark).certainty_status) == (100, "SAFE_TO_PROCEED")
    assert make(spark, evidence_count=2).certainty == 94
    assert make(spark, awdp_doc=False).certainty == 85
    assert make(spark, missing_subsystem=True, generic=True).certainty == 75
    assert make(spark, missing_subsystem=True, ranking=True, signal_path=True).certainty == 100
    assert make(spark, is_procedure=True, component=False).certainty == 82
    assert make(spark, coverage=0, system=0, evidence=0, alignment=0, diagram=0).certainty == 40
    assert make(spark, coverage=80, system=80, evidence=80, alignment=80, diagram=85).certainty == 80


def test_gate_of_procedures_takes_no_wiring_reference(spark):
    base = {"is_procedure": True, "is_fault": False, "amp": False, "steps": True, "causal": False}
    assert make(spark, **base, awdp_ref=True).certainty == 94
    assert make(spark, **base, full_dmc=True).certainty == 100
    assert make(spark, **base).certainty == 88

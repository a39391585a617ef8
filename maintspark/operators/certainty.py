"""How far a diagnosis can be trusted: five weighted parts, caps, and a gate for 95 and more.

The inputs are columns: coverage, system, evidence, alignment, diagram (0 to 100) and
booleans (null counts as false) named in FLAGS. All caps are minima, so their order doesn't
matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The weights of the parts.
WEIGHTS = {"coverage": 0.25, "system": 0.25, "evidence": 0.20, "alignment": 0.20, "diagram": 0.10}
FLAGS = (
    "is_procedure", "is_fault", "amp", "dmc", "full_dmc", "awdp_ref", "awdp_doc", "steps", "component", "part_number", "causal", "mechanism",
    "ranking", "signal_path", "operation", "generic", "missing_subsystem", "electrical_mismatch",
)


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def deep_analysis(flag=_flag) -> Column:
    """Whether a diagnosis goes deep; ``flag`` gives the column of a flag's name."""
    return (flag("ranking") & flag("signal_path")) | (flag("operation") & flag("ranking")) | (flag("signal_path") & flag("mechanism"))


def raw_score() -> Column:
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.col(name) * weight
    return total


def caps() -> list[tuple[Column, int]]:
    """(condition, largest score)."""
    f, deep = _flag, deep_analysis()
    procedure, other = f("is_procedure"), ~f("is_procedure")
    return [
        (procedure & ~(f("amp") | f("dmc") | f("awdp_ref") | f("full_dmc")), 88),
        (procedure & ~f("steps") & ~f("component"), 82),
        (other & f("is_fault") & ~(f("awdp_doc") | f("awdp_ref")) & ~deep, 85),
        (other & f("generic") & ~deep, 80),
        (other & ~(f("amp") | f("dmc") | f("awdp_ref")) & ~deep, 85),
        (other & ~f("component") & ~f("part_number"), 82),
        (other & f("is_fault") & ~f("causal") & ~deep, 80),
        (other & f("missing_subsystem") & ~deep, 75),
        (other & f("electrical_mismatch") & ~f("mechanism"), 78),
    ]


def passes_gate() -> Column:
    """Whether a score of 95 and more is allowed."""
    f, manual = _flag, _flag("amp") | _flag("dmc") | _flag("awdp_ref")
    own = f("amp") | f("dmc") | f("full_dmc")
    procedure = (F.col("coverage") >= 80) & (F.col("system") >= 60) & own & (f("steps") | f("component")) & (F.col("alignment") >= 50)
    plain = (
        (F.col("system") >= 75) & (F.col("coverage") >= 85) & (F.col("evidence_count") >= 5) & (F.col("alignment") >= 70)
        & f("component") & f("causal") & ~f("missing_subsystem") & (~f("is_fault") | f("awdp_doc") | f("awdp_ref")) & manual
    )
    deep = (F.col("system") >= 70) & (F.col("coverage") >= 65) & (F.col("evidence_count") >= 3) & (F.col("alignment") >= 60) & f("component") & deep_analysis() & f("ranking")
    return F.when(f("is_procedure"), procedure).otherwise(plain | deep)


def score(diagnoses: DataFrame) -> DataFrame:
    """Adds certainty (40 to 100, half to even) and certainty_status."""
    capped = raw_score()
    for condition, most in caps():
        capped = F.least(capped, F.when(condition, float(most)).otherwise(100.0))
    out = diagnoses.withColumn("_capped", capped)
    held = F.when((F.col("_capped") >= 95) & ~F.coalesce(passes_gate(), F.lit(False)), 94.0).otherwise(F.col("_capped"))
    out = out.withColumn("certainty", F.greatest(F.lit(40), F.least(F.bround(held, 0).cast("int"), F.lit(100)))).drop("_capped")
    return out.withColumn("certainty_status", F.when(F.col("certainty") >= 95, "SAFE_TO_PROCEED").otherwise("REQUIRE_EXPERT"))


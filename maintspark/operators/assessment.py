"""The parts of a diagnosis's certainty, computed from its text: flags, scores, and the report of one row per diagnosis.

All flags are computed in one struct, then read by the scores. A null diagnosis or question
is the empty text. Patterns marked "low" are matched against the text in small letters as
they stand, so a capital in them never matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import certainty
from .extract import coverage, coverage_ladder, evidence_score, evidence_units
from .findings import has_any, likely_causes

#: Groups of tasks.
FAULT_TASKS = ("fault_isolation", "operational_test", "functional_test")
PROCEDURE_TASKS = ("remove_procedure", "install_procedure", "disassembly", "assembly", "adjustment", "rigging_procedure", "bonding_check", "detailed_inspection", "system_description")
#: Flags of a text; those in FLAGS ignore case, those in LOW_FLAGS read the text in small letters.
FLAGS = {
    "dmc": r"\b\d{2}-[A-Z]-\d{2}-\d{2}-\d{2}-\d{2}[A-Z]?",
    "full_dmc": r"\b\d{2}-[A-Z]-\d{2}-\d{2}-\d{2}-\d{2}[A-Z]-\d{3}[A-Z]-[A-Z]\b",
    "amp": r"\b(?:AMP|AMM)\s*[-:]?\s*\d{2}[-]\d{2}[-]\d{2}",
    "awdp_ref": r"\b(?:AWD|AWDP)\s*[-:]?\s*\d{2}",
    "part_number": r"\b(?:3G\d{4}[A-Z0-9-]+|\d{3}-\d{4}-\d{2}|P/N\s*[A-Z0-9-]{6,})\b",
    "location": r"\b(?:LH|RH|left|right|forward|aft|upper|lower|inboard|outboard|station\s*\d|frame\s*\d|bay\s*\d|zone\s*\d|panel\s*[A-Z0-9]|rack\s*\d|shelf\s*\d)\b",
    "connector_pin": r"\b(?:pin\s*\d+|connector\s*[A-Z]?\d|plug\s*[A-Z]?\d)\b",
}
LOW_FLAGS = {
    "component": (
        r"\b(?:actuator|valve|pump|generator|starter|relay|contactor|solenoid|bearing|seal|bushing|link|rod|arm|gear|shaft|damper|accumulator|filter|regulator|transducer|"
        r"steering|shimmy|oleo|strut|torque\s*link|scissor|swashplate|servo|pitch\s*link|collective|pedal|connector|harness|bus|breaker|ground\s*point)\b"
    ),
    "causal": (
        r"\b(?:because|due to|caused by|resulting from|leads to|prevents|restricts|blocks|fails to|unable to|"
        r"when .{5,40} the .{5,30} (?:cannot|does not|fails|stops)|if .{5,30} then .{5,30}|this (?:causes|results|prevents|restricts))\b"
    ),
    "mechanism": (
        r"\b(?:mechanism|assembly|linkage|hydraulic\s*(?:line|circuit|system)|electrical\s*(?:circuit|path|bus)|control\s*(?:chain|path|loop)|mechanical\s*(?:connection|linkage|system)|"
        r"steering\s*(?:mechanism|system|assembly)|how (?:the|this) .{5,40} works|the .{5,30} is (?:connected|linked|driven|controlled) by)\b"
    ),
    "failure_mode": (
        r"\b(?:worn|corroded|seized|cracked|broken|leaking|loose|intermittent|open\s*circuit|short\s*circuit|grounded|binding|sticking|jamm(?:ed|ing)|frozen|stripped|"
        r"fatigued|deformed|contaminated|degraded|misaligned)\b"
    ),
    "likelihood": r"\b\d{1,3}\s*%\s*(?:probability|likely|likelihood|chance)",
    "suspect": r"(?:most\s*likely|most\s*probable|primary\s*suspect|first\s*suspect)",
    "signal_path": (
        r"\b(?:signal\s*(?:path|flow|chain)|circuit\s*(?:path|trace|analysis)|in\s*series\s*with|in\s*parallel\s*with|from\s*(?:the\s*)?(?:switch|sensor|relay)\s*(?:to|through)|"
        r"power\s*(?:flows?|supply|path)|ground\s*(?:path|return|circuit)|pin\s*\d+|connector\s*[A-Z]?\d+|wire\s*(?:number|#|\d)|functional\s*chain|component\s*(?:path|chain|in\s*the\s*circuit))\b"
    ),
    "operation": (
        r"\b(?:(?:the\s*)?system\s*(?:works|operates|functions)\s*by|when\s*(?:the\s*)?(?:gear|switch|valve|relay|sensor)\s*(?:is|moves|activates)|"
        r"(?:this|the)\s*(?:sends?|provides?|generates?)\s*(?:a\s*)?signal|the\s*(?:indicator|light|annunciator)\s*(?:illuminates?|shows?|displays?)\s*(?:when|because)|"
        r"under\s*normal\s*(?:operation|conditions)|the\s*circuit\s*(?:is\s*)?(?:completed?|opened?|broken)\s*(?:when|by|through))\b"
    ),
    "steps": (
        r"\b(?:step\s*\d|procedure|install|remove|disconnect|connect|torque|tighten|loosen|secure|safety\s*wire|lock\s*wire|position|align|adjust|calibrate|set\s*to|rig|"
        r"apply|lubricate|clean|inspect before|inspect after|ensure|verify|confirm|record|note)\b"
    ),
    "tool": (
        r"\b(?:torque\s*(?:wrench|value|to)|ft[\.\s-]*lb|in[\.\s-]*lb|N[\.\s]*m|tool\s*(?:number|p/n|#)|wrench|socket|driver|gauge|feeler\s*gauge|dial\s*indicator|micrometer|caliper|"
        r"multimeter|megger|test\s*set|adapter|fixture|jig|special\s*tool|gse|ground\s*support)\b"
    ),
    "safety": (
        r"\b(?:caution|warning|note|danger|critical|do\s*not|never|ensure\s*that|before\s*(?:removing|installing|adjusting)|safety\s*(?:precaution|note|wire)|"
        r"personal\s*protective|ppe|depressurize|de-energize|isolate|lockout)\b"
    ),
    "order": r"(?:first|then|next|after|before|finally|subsequently|step\s*[1-9]|(?:^|\n)\s*\d+[\.\)]\s)",
    "generic_check": r"(?:check continuity|verify wiring|inspect connector|check hydraulic)",
}
#: Subsystems: words of a question that imply one, words of a diagnosis that treats it.
SUBSYSTEMS = {
    "Nose Wheel Steering System": (
        ("turn", "turning", "steer", "steering", "taxi", "taxing", "taxiing", "ground maneuver"),
        ("steering", "nose wheel", "nosewheel", "nose gear", "nose landing gear", "shimmy damper", "torque link", "steering actuator", "steering valve", "steering cylinder", "castering", "tiller"),
    ),
    "Landing Gear System": (
        ("landing gear", "gear", "retract", "extend", "gear up", "gear down", "squat switch", "weight on wheels", "wow"),
        ("landing gear", "actuator", "uplock", "downlock", "squat switch", "gear door", "oleo", "strut", "retract", "extend", "selector valve"),
    ),
    "Hydraulic System": (
        ("hydraulic", "pressure", "pump", "fluid", "leak"),
        ("hydraulic pump", "reservoir", "accumulator", "pressure switch", "relief valve", "hydraulic module", "servo", "actuator", "manifold", "filter", "hydraulic system"),
    ),
    "Engine/Powerplant System": (
        ("engine", "turbine", "power", "torque", "ng", "np", "itt", "start", "hot start", "hung start", "flameout", "ecu", "fadec"),
        ("engine", "turbine", "compressor", "combustion", "fuel control", "fuel nozzle", "igniter", "gearbox", "oil", "bearing", "fadec", "ecu"),
    ),
    "Electrical Power System": (
        ("generator", "battery", "bus", "power loss", "electrical", "voltage", "breaker", "tripped", "no power"),
        ("generator", "battery", "bus", "contactor", "breaker", "relay", "transformer", "rectifier", "inverter", "gcr", "gcb", "btb"),
    ),
    "Flight Control System": (
        ("cyclic", "collective", "pedal", "yaw", "pitch", "roll", "autopilot", "trim", "stick", "vibration"),
        ("servo", "actuator", "swashplate", "pitch link", "mixing unit", "trim", "boost", "feel spring", "gradient unit", "autopilot"),
    ),
    "Rotor System": (
        ("rotor", "blade", "hub", "mast", "tail rotor", "main rotor", "track", "balance", "vibration", "lead-lag"),
        ("rotor", "blade", "hub", "damper", "bearing", "pitch horn", "lead-lag", "drag brace", "elastomeric", "spindle"),
    ),
    "Avionics System": (
        ("display", "screen", "cas", "warning", "caution", "advisory", "radio", "nav", "gps", "transponder", "ahrs", "adc"),
        ("display", "processor", "symbol generator", "dmu", "dcu", "sensor", "computer", "bus", "arinc", "can bus"),
    ),
    "Fuel System": (
        ("fuel", "tank", "boost pump", "transfer", "crossfeed", "quantity"),
        ("fuel pump", "fuel tank", "fuel valve", "boost pump", "transfer pump", "crossfeed", "fuel quantity", "fuel filter", "fuel line"),
    ),
}
#: Words of a question that don't count, and words of electrical checks and of mechanical problems.
STOP_WORDS = "does have been with that this from what when where which there their about would could should during before after helicopter aircraft system problem issue fault check".split()
ELECTRICAL = ("continuity", "wiring", "circuit", "resistance", "voltage")
MECHANICAL = ("turn", "steering", "gear", "stuck", "binding", "seized", "jam", "stiff", "vibration", "noise", "grind", "click", "play", "loose", "worn")
#: Points of the system analysis.
PROCEDURE_POINTS = {"component": 20, "steps": 25, "tool": 15, "safety": 15, "order": 10}
OTHER_POINTS = {"component": 20, "causal": 20, "mechanism": 15, "location": 10, "failure_mode": 10, "ranking": 10, "signal_path": 10, "operation": 10}
#: What the flags add to the count of evidence.
EVIDENCE_POINTS = {"dmc": 3, "full_dmc": 2, "amp": 2, "awdp_ref": 2, "part_number": 2, "connector_pin": 1}


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def flags(diagnosis: Column) -> Column:
    """A struct of all flags of a diagnosis."""
    text, low = _text(diagnosis), F.lower(_text(diagnosis))
    has = lambda t, p: F.rlike(t, F.lit(p))
    made = {k: has(text, f"(?iUd){p}") for k, p in FLAGS.items()} | {k: has(low, f"(?Ud){p}") for k, p in LOW_FLAGS.items()}
    made["ranking"] = made.pop("likelihood") | made.pop("suspect") | (F.regexp_count(text, F.lit(r"(?U)\b\d{1,3}\s*%")) >= 2)
    made["generic"] = made.pop("generic_check") & ~made["component"] & ~made["mechanism"]
    return F.struct(*(v.alias(k) for k, v in made.items()))


def evidence_count(diagnosis: Column, f: Column) -> Column:
    total = evidence_units(diagnosis)
    for name, points in EVIDENCE_POINTS.items():
        total = total + F.when(f[name], points).otherwise(0)
    return total


def system_analysis(f: Column, is_procedure: Column) -> Column:
    points = lambda table: sum((F.when(f[k], p).otherwise(0) for k, p in table.items()), F.lit(0))
    manual = f["dmc"] | f["full_dmc"]
    procedure = F.least(points(PROCEDURE_POINTS) + F.when(manual, 15).otherwise(0), F.when(f["steps"] | manual, 100).otherwise(30))
    deep = certainty.deep_analysis(lambda name: f[name])
    shallow = F.when(f["component"] | f["mechanism"] | deep, 100).otherwise(30)
    other = F.least(points(OTHER_POINTS), shallow, F.when(f["causal"] | deep, 100).otherwise(50))
    return F.when(is_procedure, procedure).otherwise(other)


def subsystems(query: Column, diagnosis: Column) -> Column:
    """(inferred, missing): labels that the question implies, and those of them that the diagnosis doesn't treat."""
    q, d = F.lower(_text(query)), F.lower(_text(diagnosis))
    rows = F.array(*(F.when(has_any(q, asks), F.struct(F.lit(label).alias("label"), has_any(d, needs).alias("there"))) for label, (asks, needs) in SUBSYSTEMS.items()))
    rows = F.filter(rows, lambda r: r.isNotNull())
    label = lambda r: r["label"]
    return F.struct(F.transform(rows, label).alias("inferred"), F.transform(F.filter(rows, lambda r: ~r["there"]), label).alias("missing"))


def electrical_mismatch(query: Column, diagnosis: Column) -> Column:
    return has_any(F.lower(_text(diagnosis)), ELECTRICAL) & has_any(F.lower(_text(query)), MECHANICAL)


def alignment(query: Column, diagnosis: Column, f: Column, missing: Column) -> Column:
    """The share of the question's words that the diagnosis has, as 100, 70, 45 or 20 (50 without words), and its penalties."""
    q, d = F.lower(_text(query)), F.lower(_text(diagnosis))
    for pattern in (r"\[.*?\]", r"(?U)ata\s*\d+", r"(?U)aw139|s/n:?\s*\d+"):
        q = F.regexp_replace(q, pattern, "")
    words = F.array_distinct(F.filter(F.regexp_extract_all(q, F.lit(r"(?U)\b[a-z]{4,}\b"), F.lit(0)), lambda w: ~w.isin(STOP_WORDS)))
    share = F.size(F.filter(words, lambda w: F.contains(d, w))) / F.size(words)
    score = F.when(F.size(words) == 0, 50).when(share >= 0.6, 100).when(share >= 0.4, 70).when(share >= 0.2, 45).otherwise(20)
    least = lambda condition, most: F.when(condition, most).otherwise(100)
    return F.least(score, least(F.size(missing) > 0, 25), least(f["generic"], 35), least(electrical_mismatch(query, diagnosis) & ~f["mechanism"], 40))


def diagram(f: Column, has_wiring: Column, task: Column) -> Column:
    fault = F.when(has_wiring & f["awdp_ref"], 100).when(has_wiring, 70).when(f["awdp_ref"], 60).otherwise(20)
    manual = f["amp"] | f["dmc"]
    return F.when(task.isin(*FAULT_TASKS), fault).when(task.isin(*PROCEDURE_TASKS), F.when(manual, 100).otherwise(40)).otherwise(F.when(manual | f["awdp_ref"], 100).otherwise(50))


def task_caps(score: Column, task: Column, causes: Column, has_steps: Column) -> Column:
    """At most 80 for a fault without causes, 75 for a removal or installation without steps."""
    fault = F.when((task == "fault_isolation") & (F.size(causes) == 0), 80).otherwise(100)
    return F.least(score, fault, F.when(task.isin("remove_procedure", "install_procedure") & ~has_steps, 75).otherwise(100))


#: Words of a document that fits a chosen training material.
COVERED = {"PRIMUS_EPIC": ("primus", "epic", "avionics", "cmc", "fms"), "PT6C_67CD": ("pt6c", "67c", "engine", "turbine", "power plant"), "AW139_AIRFRAME": ("airframe", "structure", "fuselage", "cabin")}


def chosen_tag(chosen: Column) -> Column:
    """What a document must have to fit a choice: a material, or the first two characters of a system's number; '' fits all."""
    code = F.trim(F.replace(_text(chosen), F.lit("ATA "), F.lit("")))
    return F.when(_text(chosen).isin(*COVERED), chosen).otherwise(F.substring(code, 1, 2))


def fitting_tags(path: Column, content: Column) -> Column:
    """All tags that a document has: '', materials, and what stands between two dashes of its path."""
    low_path, low = F.lower(_text(path)), F.lower(_text(content))
    of = F.array(F.lit(""), *(F.when(has_any(low, words) | has_any(low_path, words), F.lit(name)) for name, words in COVERED.items()))
    parts = [F.regexp_extract_all(low_path, F.lit(f"(?s)-(?=({any_of})-)"), F.lit(1)) for any_of in (".", "..")]
    return F.array_distinct(F.concat(F.filter(of, lambda t: t.isNotNull()), *parts))


def pooled_coverage(asked: DataFrame, docs: DataFrame, found: DataFrame, good: float = 0.7) -> DataFrame:
    """query_id, docs, matched, high, coverage of questions that were given all documents of a pool.

    asked: query_id, pool, chosen. docs: pool, doc_path, content. found: query_id, doc_path,
    content, score, the few documents whose score is known. Documents are counted by pool and
    tag before they meet questions, so a question meets two rows, whatever the pool's size.
    """
    counts = docs.select("pool", F.explode(fitting_tags(F.col("doc_path"), F.col("content"))).alias("tag")).groupBy("pool", "tag").agg(F.count("*").alias("n"))
    tagged = asked.select("query_id", "pool", chosen_tag(F.col("chosen")).alias("tag"))
    best = found.where(F.col("score") > good).select(F.col("query_id").alias("_of"), fitting_tags(F.col("doc_path"), F.col("content")).alias("_tags"))
    high = best.join(tagged, F.col("_of") == F.col("query_id")).where(F.array_contains("_tags", F.col("tag"))).groupBy("query_id").agg(F.count("*").alias("high"))
    whole = counts.where("tag = ''").select("pool", F.col("n").alias("docs"))
    both = tagged.join(whole, "pool", "left").join(counts.withColumnRenamed("n", "matched"), ["pool", "tag"], "left").join(high, "query_id", "left")
    numbers = both.select("query_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "matched", "high")))
    return numbers.withColumn("coverage", coverage_ladder(F.col("matched"), F.col("docs"), F.col("high")))


def report(diagnoses: DataFrame, query_docs: DataFrame, matches: Column | None = None, score_col: str | None = None, threshold: int = 95) -> DataFrame:
    """One row per diagnosis with its five parts, certainty and status.

    diagnoses: query_id, query, diagnosis, task_type, has_wiring. query_docs: a row for each
    retrieved document of a query; ``matches`` says which fit the chosen manual (all, if not
    given). Diagnoses without documents have a coverage of 0.
    """
    return assessed(diagnoses, coverage(query_docs, F.lit(True) if matches is None else matches, score_col), threshold)


def assessed(diagnoses: DataFrame, covered: DataFrame, threshold: int = 95) -> DataFrame:
    """The report with a given ``coverage`` per query_id."""
    covered = covered.select("query_id", "coverage")
    base = diagnoses.withColumns({"flags": flags(F.col("diagnosis")), "subsystems": subsystems(F.col("query"), F.col("diagnosis"))}).join(covered, "query_id", "left")
    task, f, wiring = F.coalesce("task_type", F.lit("")), F.col("flags"), F.coalesce("has_wiring", F.lit(False))
    parts = base.withColumns(
        {
            "coverage": F.coalesce("coverage", F.lit(0)), "is_procedure": task.isin(*PROCEDURE_TASKS), "is_fault": task.isin(*FAULT_TASKS), "awdp_doc": wiring,
            "system": system_analysis(f, task.isin(*PROCEDURE_TASKS)), "evidence_count": evidence_count(F.col("diagnosis"), f),
            "alignment": alignment(F.col("query"), F.col("diagnosis"), f, F.col("subsystems.missing")), "diagram": diagram(f, wiring, task),
            "missing_subsystem": F.size("subsystems.missing") > 0, "electrical_mismatch": electrical_mismatch(F.col("query"), F.col("diagnosis")),
        }
        | {k: f[k] for k in certainty.FLAGS if k not in ("is_procedure", "is_fault", "awdp_doc", "missing_subsystem", "electrical_mismatch")}
    )
    scored = certainty.score(parts.withColumn("evidence", evidence_score(F.col("evidence_count"))))
    has_steps = F.rlike(_text(F.col("diagnosis")), F.lit(r"(?Udm)^\s*\d+\."))
    capped = task_caps(F.col("certainty"), task, likely_causes(F.col("diagnosis")), has_steps)
    status = F.when(capped >= threshold, "SAFE_TO_PROCEED").otherwise("REQUIRE_EXPERT")
    return scored.select("query_id", "task_type", "coverage", "system", "evidence_count", "evidence", "alignment", "diagram", F.col("subsystems.missing").alias("missing_subsystems"), capped.alias("certainty"), status.alias("certainty_status"))

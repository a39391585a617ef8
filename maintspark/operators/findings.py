"""Findings in the text of a diagnosis: cleaning, parts, references, causes, tests, wiring.

Every function maps a column to a column with built-in expressions. A null text has no
findings: lists are empty or have their defaults. Lists keep the order of their patterns, then
that of the text. Letters, digits and white space are those of Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (pattern, replacement) of the markup that answers carry, in this order.
CLEANING = [
    (r"={2,}\s*", ""),
    (r"(?m)^\s*#{1,6}\s*", ""),
    (r"([.!?-])\s*#{1,6}\s+", "$1 "),
    (r"(?s)\*\*\*(.+?)\*\*\*", "$1"),
    (r"(?s)\*\*(.+?)\*\*", "$1"),
    (r"(?s)__(.+?)__", "$1"),
    (r"(?<!\w)\*([^*\n]+)\*(?!\w)", "$1"),
    (r"(?<!\w)_([^_\n]+)_(?!\w)", "$1"),
    (r"\*{2,}", ""),
    (r"(?m)^\s*[-]{2,}\s*$", ""),
    (r"(?m)^\s*[_]{3,}\s*$", ""),
    (r"`([^`]+)`", "$1"),
    (r"(?s)```[^`]*```", ""),
    (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
    (r"!\[[^\]]*\]\([^\)]+\)", ""),
    (r'"([^"]{10,})"', "$1"),
    (r"(?m)^\s*[-*+]\s+", "  "),
    (r"\n+\s*(\d+)\.\s+", "\n\n$1. "),
    (r"\n+\s*(\d+)\.(\d+)\.\s+", "\n   $1.$2. "),
    (r"\n+\s*(\d+)\.(\d+)\.(\d+)\.\s+", "\n      $1.$2.$3. "),
    (r"([^\n])\s+(\d)\.(?!\d)\s+([A-Z])", "$1\n\n$2. $3"),
    (r"([^\n])\s+(\d+\.\d+)\.\s+([A-Z])", "$1\n   $2. $3"),
    (r"(?<!\n)(PROCEDURE|PREREQUISITES|SUPPORT EQUIPMENT|DMC Reference|REQUIREMENTS AFTER|SENIOR TECHNICIAN NOTE):", "\n\n$1:"),
    (r"TPD_PSE;(\d+);;;?", "(PSE Ref: $1)"),
    # two references that one space parts become one pair of brackets; pairs are taken from the left
    (r"\((PSE Ref: \d+)\)(\s*)\((PSE Ref: \d+)\)", "($1\u0001$2\u0002$3)"),
    ("\u0001 \u0002", ", "),
    ("\u0001(\\s*)\u0002", ")$1("),
    (r"\n{3,}", "\n\n"),
    (r"(?m)^\s+$", ""),
    (r" {2,}", " "),
    (r"\A\n+", ""),
    (r"\A\s+|\s+\z", ""),
]
#: Part numbers, with what they are.
PARTS = [
    (r"(?i)\b(3G\d{4}[A-Z0-9-]+)\b", "AW139 Component"),
    (r"(?i)\b(\d{3}-\d{4}-\d{2}-\d{2})\b", "Assembly Part"),
    (r"(?i)\b(109-\d{4}-\d{2}-\d{2})\b", "Honeywell Component"),
    (r"(?i)P/N[:\s]*([A-Z0-9-]{6,})", "Identified Part"),
    (r"(?i)\b([A-Z]{2,3}\d{5,}[A-Z0-9-]*)\b", "Aircraft Part"),
]
#: References to manuals.
REFERENCES = [
    r"(?i)(AMM[-\s]\d{2}[-\s]\d{2}[-\s]\d{2,4})",
    r"(?i)(AMP[-\s]\d{2}[-\s]\d{2}[-\s]\d{2,4})",
    r"(?i)(AWD[-\s]\d{2}[-\s]\d{2}[-\s]\d{2,4})",
    r"(?i)(IPD[-\s][A-Z0-9-]+)",
    r"(?i)(FIM[-\s]\d{2}[-\s]\d{2})",
    r"(?i)(IETP[-\s]AW139[-\s][A-Z0-9-]+)",
    r"(?i)(CMM[-\s]\d{2}[-\s]\d{2})",
]
#: Causes that a word stands for, if no shares are given.
CAUSES = [
    ("electrical", "Electrical Connection Issue", 30),
    ("component", "Component Failure", 35),
    ("wiring", "Wiring Fault", 25),
    ("corrosion", "Corrosion", 15),
    ("wear", "Mechanical Wear", 20),
    ("sensor", "Sensor Malfunction", 25),
    ("connector", "Connector Issue", 20),
]
#: Words of a test, and the tests where none is named ({0}: chapter, {1}: its number).
TEST_WORDS = ("test", "check", "verify", "inspect", "measure", "continuity")
TESTS = [
    ("Perform visual inspection of {0} components", "AMP-{1}-00-10", "No visible damage or abnormalities"),
    ("Verify electrical continuity on associated circuits", "AWD-{1}-00-20", "Continuity within specifications"),
    ("Check connector pins for corrosion or damage", "AMM-{1}-10-00", "Pins clean and properly seated"),
]
EXPECTED = "Verify per maintenance manual specifications"
#: Classes of causes by words.
CAUSE_CLASSES = [
    (r"(?i)fault(?:y|ed)?|defect|failure", "Component Failure"),
    (r"(?i)wear|worn|degraded", "Wear and Degradation"),
    (r"(?i)connection|connector|wiring", "Electrical Connection Issue"),
    (r"(?i)corrosion|corroded", "Corrosion"),
    (r"(?i)contamination|contaminated", "Contamination"),
]
#: Steps, plain parts, sections of manuals, and the steps where none is named ({0}: chapter number).
STEPS = [
    r"(?i)(?:step\s*\d+|first|second|third|then|next|finally)[:\s]+([^.]+\.)",
    r"(?i)(?:\d+\.|•|-)\s*([^.]+(?:test|check|verify|inspect|measure)[^.]*\.)",
]
DEFAULT_STEPS = [
    ("Perform visual inspection of ATA {0} components", "No visible damage or abnormalities"),
    ("Verify electrical continuity where applicable", "Continuity within specifications"),
    ("Consult IETP for specific test procedures", "Follow documented procedures"),
]
SIMPLE_PARTS = [r"(?i)(?:P/N|PN|Part\s*(?:No|Number)?)[:\s]*([A-Z0-9-]+)", r"\b(3G\d{4}[A-Z0-9-]*)\b", r"\b(\d{6,}-\d{2,})\b"]
SECTIONS = [
    r"(?i)(?:AMM|IETP|AMP|FIM|CMM|SRM|IPC)\s*[-–]?\s*(\d{2}[-–]\d{2}[-–]\d{2,4})",
    r"(?i)(?:Section|Ref|Doc)\s*:?\s*([A-Z0-9]+-[A-Z0-9-]+)",
    r"(?i)IETP-AW139-([A-Z0-9-]+)",
    r"(?i)AMP-([A-Z0-9-]+)",
]
#: Words of a wiring document, the shorter list for diagnoses, and the codes of such documents.
WIRING_WORDS = ("awdp", "wiring data", "wiring diagram", "schematic", "circuit diagram", "electrical diagram")
WIRING_SAID = ("awdp", "wiring diagram", "schematic", "circuit diagram")
WIRING_CODES = [
    r"(?i)30-[A-Z]-\d{2}-\d{2}-\d{2}-\d{2}[A-Z]-\d{3}[A-Z]-[A-Z]",
    r"(?i)39-[A-Z]-AWDP-\d{2}-[A-Z0-9X-]+",
    r"(?i)\d{2}-[A-Z]-\d{2}-\d{2}-\d{2}-\d{2}[A-Z]-\d{3}[A-Z]-[A-Z]",
]
NO_CODE = "Referenced in procedure"
PYTHON, SCRIPT = "(?Ud)", "(?d)"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _all(text: Column, pattern: str, group: int = 1, dialect: str = PYTHON) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(dialect + pattern), F.lit(group))


def has_any(text: Column, words) -> Column:
    """Whether a text has one of the words in it."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def _first_of(rows: Column, field: str) -> Column:
    """Rows whose field hasn't come before."""
    keys = F.transform(rows, lambda r: r[field])
    return F.filter(rows, lambda r, i: F.array_position(keys, r[field]) == i + 1)


def clean_markdown(text: Column) -> Column:
    for pattern, by in CLEANING:
        text = F.regexp_replace(text, PYTHON + pattern, by)
    return text


def fix_part_numbers(text: Column) -> Column:
    """Drops brackets that are cut off after a part number at the end of a line."""
    text = F.regexp_replace(text, r"(?Udm)([A-Z0-9-]{5,})\s*\([A-Z]{1,2}$", "$1")
    return F.regexp_replace(text, r"(?Udm)([A-Z0-9-]{5,})\s*\($", "$1")


def part_numbers(text: Column, k: int = 10) -> Column:
    """(part_number, description), each number once, in capitals, of 6 characters or more."""
    row = lambda what: lambda x: F.struct(F.upper(x).alias("part_number"), F.lit(what).alias("description"))
    rows = [F.transform(_all(text, p), row(what)) for p, what in PARTS]
    return F.slice(_first_of(F.filter(F.concat(*rows), lambda r: F.length(r["part_number"]) >= 6), "part_number"), 1, k)


def references(text: Column, k: int = 15) -> Column:
    found = F.concat(*(_all(text, p) for p in REFERENCES))
    return F.slice(F.array_distinct(F.transform(found, lambda x: F.replace(F.upper(x), F.lit(" "), F.lit("-")))), 1, k)


def likely_causes(text: Column, k: int = 5) -> Column:
    """(cause, probability): "45% worn seal" and "worn seal (45%)" of 5 to 100 and over 10 characters, else up to three by words; likeliest first, then as they stand."""
    pair = lambda cause, p: F.struct(F.substring(stripped(cause), 1, 100).alias("cause"), p.cast("int").alias("probability"), F.length(stripped(cause)).alias("size"))
    # no match has a point in it, so only the pieces between points that have a share are read; a cause before its share begins a line or follows another match
    first, second = r"(\d{1,3})\s*%[:\s]*([^.\n]+)", r"(?:\G|(?<=\n))([^.\n]+)\s*\((\d{1,3})\s*%\)"
    pieces = F.split(_text(text), "[.]", -1)
    found = lambda sign, pattern, cause, share: F.flatten(F.transform(F.filter(pieces, lambda t: F.contains(t, F.lit(sign))), lambda t: F.zip_with(_all(t, pattern, cause), _all(t, pattern, share), pair)))
    rows = F.concat(found("%", first, 2, 1), found("%)", second, 1, 2))
    rows = F.filter(rows, lambda r: r["probability"].between(5, 100) & (r["size"] > 10))
    low = F.lower(_text(text))
    plain = F.array(*(F.when(F.contains(low, F.lit(w)), F.struct(F.lit(c).alias("cause"), F.lit(p).alias("probability"), F.lit(0).alias("size"))) for w, c, p in CAUSES))
    rows = F.when(F.size(rows) > 0, rows).otherwise(F.slice(F.filter(plain, lambda r: r.isNotNull()), 1, 3))
    rows = F.transform(rows, lambda r, i: F.struct((-r["probability"]).alias("order"), i.alias("at"), r["cause"].alias("cause"), r["probability"].alias("probability")))
    return F.transform(F.slice(F.array_sort(rows), 1, k), lambda r: F.struct(r["cause"].alias("cause"), r["probability"].alias("probability")))


def _test(step, description, reference, expected) -> Column:
    return F.struct(step.cast("int").alias("step"), description.alias("description"), reference.alias("reference"), expected.alias("expected_result"))


def recommended_tests(text: Column, ata: Column, k: int = 6) -> Column:
    """(step, description, reference, expected_result) of the sentences that name a test; three plain tests if none does."""
    ata = F.coalesce(ata, F.lit(""))
    number = F.replace(ata, F.lit("ATA "), F.lit(""))
    said = F.transform(F.split(_text(text), "[.!?]", -1), stripped)
    said = F.slice(F.filter(said, lambda s: has_any(F.lower(s), TEST_WORDS) & (F.length(s) > 20)), 1, k)
    own = lambda s: F.upper(F.regexp_extract(s, r"(?iU)(AMP|AWD|AMM)[-\s]?\d{2}[-\s]?\d{2}", 0))
    other = F.when(ata != "", F.concat(F.lit("AMP-"), number, F.lit("-00"))).otherwise("AMP-XX-XX")
    named = F.transform(said, lambda s, i: _test(i + 1, F.substring(s, 1, 200), F.when(own(s) != "", own(s)).otherwise(other), F.lit(EXPECTED)))
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{0}"), ata), F.lit("{1}"), F.when(ata != "", number).otherwise("XX"))
    plain = F.array(*(_test(F.lit(i + 1), fill(d), fill(r), F.lit(e)) for i, (d, r, e) in enumerate(TESTS)))
    return F.when(F.size(named) > 0, named).otherwise(plain)


def causes_by_keyword(text: Column, k: int = 3) -> Column:
    """(cause, probability): the first three classes that occur have 35, 25 and 15; else one entry of 30."""
    hits = F.array(*(F.when(F.rlike(_text(text), F.lit(p)), F.lit(c)) for p, c in CAUSE_CLASSES))
    hits = F.slice(F.filter(hits, lambda c: c.isNotNull()), 1, k)
    rows = F.transform(hits, lambda c, i: F.struct(c.alias("cause"), (35 - 10 * i).alias("probability")))
    return F.when(F.size(rows) > 0, rows).otherwise(F.array(F.struct(F.lit("Further investigation required").alias("cause"), F.lit(30).alias("probability"))))


def numbered_steps(text: Column, ata: Column, k: int = 5) -> Column:
    """(step, description, expected_result), up to five over both patterns; three plain ones if there is none."""
    found = F.slice(F.concat(*(_all(text, p, dialect=SCRIPT) for p in STEPS)), 1, k)
    rows = F.transform(found, lambda s, i: F.struct((i + 1).alias("step"), stripped(s).alias("description"), F.lit(EXPECTED).alias("expected_result")))
    plain = [F.struct(F.lit(i + 1).alias("step"), F.replace(F.lit(d), F.lit("{0}"), F.coalesce(ata, F.lit(""))).alias("description"), F.lit(e).alias("expected_result")) for i, (d, e) in enumerate(DEFAULT_STEPS)]
    return F.when(F.size(rows) > 0, rows).otherwise(F.array(*plain))


def parts_simple(text: Column, k: int = 5) -> Column:
    """Part numbers as they stand, repeated ones too."""
    return F.slice(F.concat(*(_all(text, p, dialect=SCRIPT) for p in SIMPLE_PARTS)), 1, k)


def manual_references(text: Column) -> Column:
    """(doc_id, section, title) of every match."""
    pair = lambda whole, section: F.struct(F.trim(whole).alias("doc_id"), section.alias("section"), F.concat(F.lit("AW139 Technical Reference "), F.trim(whole)).alias("title"))
    return F.concat(*(F.zip_with(_all(text, p, 0, SCRIPT), _all(text, p, 1, SCRIPT), pair) for p in SECTIONS))


def wiring_refs(text: Column, doc_texts: Column, k: int = 3) -> Column:
    """(has_wiring, wiring_ref): of the retrieved documents' texts with their paths (an array), then of the diagnosis itself."""
    codes = lambda t: F.concat(*(_all(t, p, 0) for p in WIRING_CODES))
    docs = F.filter(F.coalesce(doc_texts, F.array().cast("array<string>")), lambda d: has_any(F.lower(d), WIRING_WORDS))
    # a document without a code adds the stand-in only while nothing has been found
    of_docs = F.aggregate(docs, F.array().cast("array<string>"), lambda acc, d: F.when(F.size(F.concat(acc, codes(d))) > 0, F.concat(acc, codes(d))).otherwise(F.array(F.lit(NO_CODE))))
    own = codes(text)
    said = (F.size(docs) == 0) & (F.size(own) == 0) & has_any(F.lower(_text(text)), WIRING_SAID)
    refs = F.when(said, F.array(F.lit(NO_CODE))).otherwise(F.concat(of_docs, own))
    return F.struct((F.size(refs) > 0).alias("has_wiring"), F.array_join(F.slice(F.array_distinct(refs), 1, k), ", ").alias("wiring_ref"))


def simple_score(n_references: Column, has_ata: Column, text: Column) -> Column:
    """50 and points for references, a chapter, length and words of manuals and steps; 100 at most."""
    low, n = F.lower(_text(text)), F.length(_text(text))
    add = lambda condition, points: F.when(condition, points).otherwise(0)
    total = 50 + F.least(F.coalesce(n_references, F.lit(0)) * 8, F.lit(30)) + add(has_ata, 10) + add(n > 500, 5) + add(n > 1000, 5)
    return F.least(total + add(has_any(low, ("amm", "ietp", "amp")), 5) + add(has_any(low, ("procedure", "step")), 3), F.lit(100))


def verification(text: Column) -> Column:
    """The status by document codes and numbered steps."""
    steps, code = F.rlike(_text(text), F.lit(r"(?Udm)^\s*\d+\.")), F.rlike(_text(text), F.lit(r"(?iU)\d{2}-[A-Z]-\d{2}-\d{2}"))
    return F.when(code & steps, "VERIFIED - NO CORRECTIONS").when(steps, "VERIFIED WITH IMPROVEMENTS").otherwise("CRITICAL CORRECTION REQUIRED")


def diagnosis_text(query: Column, answer: Column, contents: Column) -> Column:
    """The answer in paragraphs of three sentences, then what the first three documents begin with."""
    contents = F.coalesce(contents, F.array().cast("array<string>"))
    sentences = F.split(stripped(F.regexp_replace(_text(answer), r"(?U)\s+", " ")), r"(?<=[.!?])\s+", -1)
    whole = F.sequence(F.lit(0), F.ceil(F.size(sentences) / 3).cast("int") - 1)
    paragraphs = F.when(_text(answer) != "", F.transform(whole, lambda i: F.array_join(F.slice(sentences, i * 3 + 1, 3), " "))).otherwise(F.array().cast("array<string>"))
    previews = F.filter(F.transform(F.slice(contents, 1, 3), lambda c: stripped(F.substring(_text(c), 1, 300))), lambda p: p != "")
    note = F.when(F.size(previews) > 0, F.array(F.concat(F.lit("Supporting documentation indicates: "), F.substring(F.array_join(previews, " "), 1, 500)))).otherwise(F.array().cast("array<string>"))
    every = F.concat(paragraphs, note)
    nothing = F.concat(F.lit("Unable to retrieve documentation for query: "), _text(query), F.lit(". Please verify RAG system connectivity."))
    return F.when((_text(answer) == "") & (F.size(contents) == 0), nothing).when(F.size(every) > 0, F.array_join(every, "\n\n")).otherwise("No detailed diagnosis available.")


def diagnosis_report(diagnoses, text: str = "diagnosis", retrieved: str = "retrieved_refs", doc_texts: str = "doc_texts"):
    """Chapter, parts, references (those of the retrieval, ten at most, if the text has none), causes, tests, wiring and verification of each diagnosis."""
    from maintspark.functions.text import ata_chapter

    t = F.col(text)
    known = diagnoses.withColumns({"ata_chapter": ata_chapter(_text(t)), "references": references(t), "likely_causes": likely_causes(t), "affected_parts": part_numbers(t), "wiring": wiring_refs(t, F.col(doc_texts)), "verification_status": verification(t)})
    other = F.slice(F.coalesce(F.col(retrieved), F.array().cast("array<string>")), 1, 10)
    return known.withColumns({"references": F.when(F.size("references") > 0, F.col("references")).otherwise(other), "recommended_tests": recommended_tests(t, F.col("ata_chapter"))})

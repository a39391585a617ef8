"""Column functions on texts, paths and diagnoses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the shape of a document code.
DMC = r"[0-9]{2}-[A-Z]-[0-9]{2}-[0-9]{2}-[0-9]{2}-[0-9]{2}[A-Z]-[0-9]{3}[A-Z]?-[A-Z]"


def dmc_code(path: Column) -> Column:
    """The document code in a path; else the cleaned file name if it is long and has a dash; else ''."""
    from maintspark.operators.retrieval import document_id

    found, name = F.regexp_extract(path, DMC, 0), document_id(path)
    return F.when(found != "", found).when((F.length(name) > 10) & name.contains("-"), name).otherwise("")


def is_wiring_doc(path: Column, text: Column) -> Column:
    start = F.lower(F.substring(text, 1, 1000))
    return F.contains(F.lower(path), F.lit("39-a-awdp")) | F.contains(start, F.lit("39-a-awdp")) | F.contains(start, F.lit("wiring diagram"))


def truncated(text: Column, name: Column, n: int = 4000) -> Column:
    """The first n characters; a stand-in with the file name for fewer than 20."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) < 20, F.concat(F.lit("[FALLBACK] "), name)).otherwise(F.substring(text, 1, n))


def _has(text: Column, *words: str) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


_STARTING = ("start", "starting", "does not start", "will not start", "not starting", "wont start")
_WIRING = ("awdp", "wiring diagram", "wiring data")
#: The rules: what a question has, what a document has (both in small letters), and the points for both.
BOOSTS = (
    (lambda q: _has(q, "does not start"), lambda d: _has(d, "does not start"), 0.15),
    (lambda q: _has(q, "not starting"), lambda d: _has(d, "not starting"), 0.15),
    (lambda q: _has(q, "will not start"), lambda d: _has(d, "will not start", "does not start"), 0.15),
    (lambda q: _has(q, *_STARTING), lambda d: _has(d, "start sequence", "start cycle", "starting system"), 0.12),
    (lambda q: _has(q, *_STARTING) & _has(q, "start"), lambda d: _has(d, "starter generator"), 0.10),
    (lambda q: _has(q, *_STARTING), lambda d: _has(d, "engine start"), 0.08),
    (lambda q: _has(q, *_STARTING) & ~_has(q, "hot", "overheat", "temperature"), lambda d: _has(d, "gen hot", "overheat", "temperature"), -0.12),
    (lambda q: _has(q, "start"), lambda d: _has(d, "fault isolation") & _has(d, "start", "crank"), 0.10),
    (lambda q: _has(q, "hot"), lambda d: _has(d, "fault isolation") & _has(d, "hot"), 0.10),
    (lambda q: _has(q, "electrical", "wiring", "wire", "connector", "pin", "circuit"), lambda d: _has(d, *_WIRING), 0.12),
    (lambda q: _has(q, "generator", "starter"), lambda d: _has(d, *_WIRING), 0.08),
    (lambda q: _has(q, "fault", "does not", "not working"), lambda d: _has(d, *_WIRING), 0.06),
)
BOOST_POINTS = tuple(points for _, _, points in BOOSTS)


def _mask(low: Column, side: int) -> Column:
    mask = F.lit(0)
    for i, rule in enumerate(BOOSTS):
        mask = mask + F.when(rule[side](low), 1 << i).otherwise(0)
    return mask


def question_mask(low: Column) -> Column:
    """The rules whose conditions a question in small letters meets, as bits; 0 for null."""
    return _mask(low, 0)


def document_mask(low: Column) -> Column:
    """The same for a document: its text is searched once, however many questions there are."""
    return _mask(low, 1)


def mask_boost(question: Column, document: Column) -> Column:
    """The points of the rules that both masks have."""
    both, total = question.bitwiseAND(document), F.lit(0.0)
    for i, points in enumerate(BOOST_POINTS):
        total = total + F.when(both.bitwiseAND(F.lit(1 << i)) != 0, points).otherwise(0.0)
    return total


def keyword_boost(query: Column, doc: Column) -> Column:
    """What keywords add to or take from a document's score."""
    return mask_boost(question_mask(F.lower(query)), document_mask(F.lower(doc)))


def mask_bits(mask: Column) -> Column:
    """The numbers of the rules in a mask."""
    return F.filter(F.sequence(F.lit(0), F.lit(len(BOOSTS) - 1)), lambda i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1)


def gate(score: Column, threshold: int = 95) -> Column:
    return F.when(score >= threshold, "SAFE_TO_PROCEED").otherwise("REQUIRE_EXPERT")


def ata_chapter(text: Column) -> Column:
    """ATA xx-yy of the first pair that is named; else ATA xx of the first chapter, then of the first number; else ''."""
    pair = r"(?iU)ATA[:\s]*(\d{2})[-\s](\d{2})"
    a, b = (F.regexp_extract(text, pair, k) for k in (1, 2))
    chapter, number = F.regexp_extract(text, r"(?iU)ATA Chapter[:\s]*(\d{2})", 1), F.regexp_extract(text, r"(?iU)ATA[:\s]*(\d{2})\b", 1)
    one = F.when(chapter != "", chapter).otherwise(number)
    return F.when(a != "", F.concat(F.lit("ATA "), a, F.lit("-"), b)).when(one != "", F.concat(F.lit("ATA "), one)).otherwise("")


def first_distinct(*arrays: Column, most: int) -> Column:
    """The first appearances over several lists of matches, in their order."""
    return F.slice(F.array_distinct(F.concat(*arrays)), 1, most)

"""Facts read from the text of a diagnosis, with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import likely_causes  # noqa: F401

#: Quantities that count as evidence (letters and word ends as Unicode has them).
UNITS = {
    "torque": r"(?iU)\b\d+\.?\d*\s*(?:N\s*m|Nm|lbf?\s*in|lb-in|ft-lb|lb-ft)\b",
    "pressure": r"(?iU)\b\d+\.?\d*\s*(?:psi|bar|kPa|MPa)\b",
    "voltage": r"(?iU)\b\d+\.?\d*\s*(?:V|mV|kV)\b",
    "current": r"(?iU)\b\d+\.?\d*\s*(?:A|mA)\b",
    "temperature": r"(?iU)\b-?\d+\.?\d*\s*°?(?:C|F)\b",
    "dimension": r"(?iU)\b\d+\.?\d*\s*(?:mm|cm|m|in|ft)\b",
    "resistance": r"(?iU)\b\d+\.?\d*\s*(?:ohm|Ω|kohm|MΩ)\b",
}


def evidence_units(text: Column) -> Column:
    """How many quantities with a unit a text names."""
    total = F.lit(0)
    for pattern in UNITS.values():
        total = total + F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))
    return total


def evidence_score(count: Column) -> Column:
    ladder = F.when(count <= 0, 0)
    for most, score in ((2, 20), (4, 40), (6, 60), (9, 80)):
        ladder = ladder.when(count <= most, score)
    return ladder.otherwise(100)


def coverage_ladder(matched: Column, total: Column, high: Column) -> Column:
    """0, 15, 40, 65, 85 or 100 by the share of matching documents."""
    ratio = matched / total
    return F.when(F.coalesce(total, F.lit(0)) == 0, 0).when((ratio >= 0.8) & (high >= 3), 100).when(ratio >= 0.8, 85).when(ratio >= 0.5, 65).when(ratio >= 0.2, 40).otherwise(15)


def coverage(query_docs: DataFrame, matches: Column, score_col: str | None = None) -> DataFrame:
    """Per query: documents, those that match, those with a score above 0.7, and the ladder's value."""
    high = F.count_if(F.col(score_col) > 0.7) if score_col else F.lit(0)
    counts = query_docs.groupBy("query_id").agg(F.count("*").alias("docs"), F.count_if(matches).alias("matched"), high.alias("high"))
    return counts.withColumn("coverage", coverage_ladder(F.col("matched"), F.col("docs"), F.col("high")))


def connector_gate(certainty: Column, snippet: Column, threshold: float = 0.95, missing: str = "low") -> Column:
    """low_certainty, expert_required and the snippet cut for uncertain answers; a missing value counts as 0 or as 1."""
    value = F.coalesce(certainty, F.lit(0.0 if missing == "low" else 1.0))
    low = value < threshold
    return F.struct(low.alias("low_certainty"), low.alias("expert_required"), F.when(low, F.substring(snippet, 1, 750)).otherwise(snippet).alias("snippet"))

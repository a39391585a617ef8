"""Recurrence, repair time and trend of faults for every system (ata code) at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _since(as_of: Column, days: int) -> Column:
    return F.col("occurrence_date") >= as_of - F.expr(f"interval {days} days")


def rounded(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5).cast("long")


def recurrence(occurrences: DataFrame, as_of: Column, days=(30, 60, 90)) -> DataFrame:
    """Faults since as_of - d for each d, without an upper bound; one pass, partial sums before the shuffle."""
    return occurrences.groupBy("ata_code").agg(*(F.count_if(_since(as_of, d)).alias(f"n{d}") for d in days))


def mttr(occurrences: DataFrame, as_of: Column, window: int = 90) -> DataFrame:
    """Mean and largest days to resolution in the window; null if none is known."""
    recent = F.when(_since(as_of, window), F.col("days_to_resolution"))
    return occurrences.groupBy("ata_code").agg(F.avg(recent).alias("mttr_mean"), F.max(recent).alias("mttr_max"))


def mtbf_low(n30: Column, n90: Column) -> Column:
    return F.when(n90 > 0, rounded(90 * 24 / n90))


def mtbf_high(n90: Column) -> Column:
    return F.when(n90 > 0, rounded(120 * 24 / n90))


def failure_rate(n30: Column) -> Column:
    return n30 / 30 * 100


def trend(n30: Column, n90: Column) -> Column:
    return F.when(n30 > (n90 - n30) / 2, "increasing").otherwise("stable")


def top_parts(parts: DataFrame, k: int = 5) -> DataFrame:
    """Per system the k most replaced parts; ties by part number."""
    order = Window.partitionBy("ata_code").orderBy(F.coalesce("times_replaced", F.lit(0)).desc(), "part_number")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ata_report(occurrences: DataFrame, parts: DataFrame, as_of: Column) -> DataFrame:
    """All figures of a system in one row; systems of either table appear."""
    n30, n90 = F.col("n30"), F.col("n90")
    one = occurrences.groupBy("ata_code").agg(
        *(F.count_if(_since(as_of, d)).alias(f"n{d}") for d in (30, 60, 90)),
        F.avg(F.when(_since(as_of, 90), F.col("days_to_resolution"))).alias("mttr_mean"),
        F.max(F.when(_since(as_of, 90), F.col("days_to_resolution"))).alias("mttr_max"),
    )
    best = top_parts(parts).groupBy("ata_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part_number"))), lambda x: x["part_number"]), ", ").alias("top_parts"))
    both = one.join(best, "ata_code", "full_outer").fillna(0, ["n30", "n60", "n90"])
    return both.select("ata_code", "n30", "n60", "n90", "mttr_mean", "mttr_max", mtbf_low(n30, n90).alias("mtbf_low"), mtbf_high(n90).alias("mtbf_high"), failure_rate(n30).alias("failure_rate"), trend(n30, n90).alias("trend"), F.coalesce("top_parts", F.lit("")).alias("top_parts"))


def rolling_recurrence(occurrences: DataFrame, days: int = 90) -> DataFrame:
    """For each fault, the faults of its system in the days up to and including its moment.

    Faults are counted by system and moment first, so the window holds a row a moment, not a row a fault.
    """
    span = Window.partitionBy("_ata").orderBy("_moment").rangeBetween(-days * 86400, 0)
    at = F.unix_seconds(F.col("occurrence_date").cast("timestamp"))
    counts = occurrences.groupBy(F.col("ata_code").alias("_ata"), at.alias("_moment")).agg(F.count("*").alias("_n"))
    rolling = counts.select("_ata", "_moment", F.sum("_n").over(span).alias("rolling"))
    same = F.col("ata_code").eqNullSafe(F.col("_ata")) & at.eqNullSafe(F.col("_moment"))
    return occurrences.join(rolling, same, "left").drop("_ata", "_moment")

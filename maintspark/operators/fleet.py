"""Downtime of the fleet, and what parts it uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minutes(start: Column, end: Column) -> Column:
    return F.floor((F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))) / 60000 + 0.5).cast("long")


def format_duration(total: Column) -> Column:
    """59m, 2h 5m, 3d 4h."""
    text = lambda x: F.floor(x).cast("string")
    days = F.concat(text(total / 1440), F.lit("d "), text(total % 1440 / 60), F.lit("h"))
    hours = F.concat(text(total / 60), F.lit("h "), text(total % 60), F.lit("m"))
    return F.when(total < 60, F.concat(text(total), F.lit("m"))).when(total < 1440, hours).otherwise(days)


def open_records(downtime: DataFrame, user: Column | None = None) -> DataFrame:
    found = downtime.where(F.col("status") == "open")
    return found if user is None else found.where(F.col("user_id") == user)


def downtime_rollup(downtime: DataFrame) -> DataFrame:
    """Totals by aircraft and system, by aircraft, and of the fleet (nulls), in one aggregation."""
    is_open = F.coalesce(F.col("status") == "open", F.lit(False))
    return downtime.rollup("aircraft_serial", "ata_code").agg(F.coalesce(F.sum(F.coalesce("downtime_minutes", F.lit(0))), F.lit(0)).alias("total_minutes"), F.count_if(is_open).alias("open_count"), F.count_if(~is_open).alias("resolved_count"))


def by_aircraft(downtime: DataFrame) -> DataFrame:
    is_open = F.coalesce(F.col("status") == "open", F.lit(False))
    return downtime.groupBy("aircraft_serial").agg(F.sum(F.coalesce("downtime_minutes", F.lit(0))).alias("total_minutes"), F.count_if(is_open).alias("open_count"), F.count_if(~is_open).alias("resolved_count"))


def by_aircraft_ata(downtime: DataFrame) -> DataFrame:
    """Per aircraft its systems, most minutes first (ties by code), nested."""
    each = downtime.groupBy("aircraft_serial", "ata_code").agg(F.sum(F.coalesce("downtime_minutes", F.lit(0))).alias("minutes"), F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("minutes")).alias("order"), "ata_code", "minutes", "n")))
    return each.groupBy("aircraft_serial").agg(F.transform(rows, lambda x: F.struct(x["ata_code"].alias("ata_code"), x["minutes"].alias("minutes"), x["n"].alias("n"))).alias("systems"))


def replacement_counts(replacements: DataFrame, k: int = 20) -> DataFrame:
    return replacements.groupBy("part_on_pn", "ata_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "part_on_pn", "ata_code").limit(k)


def inventory_summary(parts: DataFrame, ata: str | None = None, k: int = 50, filter_first: bool = False) -> DataFrame:
    """Figures of the k most replaced parts; the system is chosen after the k, unless ``filter_first``."""
    if ata is not None and filter_first:
        parts = parts.where(F.col("ata_code") == ata)
    top = parts.orderBy(F.desc("times_replaced"), "part_number").limit(k)
    if ata is not None and not filter_first:
        top = top.where(F.col("ata_code") == ata)
    return top.agg(F.count("*").alias("tracked"), F.max_by("part_number", F.struct(F.col("times_replaced"), F.col("part_number"))).alias("top_part"), F.sum("times_replaced").alias("replaced"))


def high_failure(parts: DataFrame, least: int = 15, k: int = 3) -> DataFrame:
    order = Window.partitionBy("ata_code").orderBy(F.desc("failure_rate"), "part_number")
    return parts.where(F.col("failure_rate") > least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def min_stock(parts: DataFrame, least: int = 2, k: int = 5) -> DataFrame:
    """Per system the k most replaced parts and how many to hold."""
    order = Window.partitionBy("ata_code").orderBy(F.desc("times_replaced"), "part_number")
    kept = parts.where(F.col("times_replaced") > least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return kept.withColumn("quantity", F.greatest(F.lit(3), 2 * F.ceil(F.col("times_replaced") / 4)))


def stock_alerts(parts: DataFrame, high: int = 15, critical: int = 20) -> DataFrame:
    """Per system the parts that fail most, and whether any part is critical."""
    any_critical = parts.groupBy("ata_code").agg(F.coalesce(F.bool_or(F.col("failure_rate") > critical), F.lit(False)).alias("critical"))
    names = high_failure(parts, high).groupBy("ata_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part_number"))), lambda x: x["part_number"]), ", ").alias("alert_parts"))
    return any_critical.join(names, "ata_code", "left")


def upsert_from_replacements(parts: DataFrame, replacements: DataFrame) -> DataFrame:
    """Each replacement adds 1 to its part; unknown parts come in with a failure rate of 0."""
    added = replacements.groupBy(F.col("part_on_pn").alias("part_number")).agg(F.count("*").alias("added"), F.min_by("ata_code", "id").alias("new_ata"))
    both = parts.join(added, "part_number", "full_outer")
    return both.select("part_number", F.coalesce("description", F.concat(F.lit("Part "), "part_number")).alias("description"), F.coalesce("ata_code", "new_ata").alias("ata_code"), (F.coalesce("times_replaced", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("times_replaced"), F.coalesce("failure_rate", F.lit(0)).alias("failure_rate"))


def propagate_resolution(history: DataFrame, downtime: DataFrame) -> DataFrame:
    """History rows of a resolved downtime become resolved."""
    done = downtime.where(F.col("status") == "resolved").select("diagnostic_query_id").distinct().withColumn("_done", F.lit(True))
    return history.join(done, "diagnostic_query_id", "left").withColumn("solution_status", F.when(F.col("_done"), "resolved").otherwise(F.col("solution_status"))).drop("_done")


def maintenance_alerts(diagnostics: DataFrame, logs: DataFrame, k: int = 3) -> DataFrame:
    """For each diagnosis the number of earlier logs of its system and the newest k."""
    order = Window.partitionBy("ata").orderBy(F.desc("log_date"), F.desc("id"))
    counts = logs.groupBy("ata").agg(F.count("*").alias("n_logs"))
    newest = logs.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).groupBy("ata").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"].cast("string")), ",").alias("newest"))
    return diagnostics.join(counts.join(newest, "ata"), "ata", "left").withColumns({"n_logs": F.coalesce("n_logs", F.lit(0)), "newest": F.coalesce("newest", F.lit(""))})

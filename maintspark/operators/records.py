"""Filters, paging and merges of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, order: tuple[str, ...] = ("id",), parts: int = 200) -> DataFrame:
    """Adds _position (from 1) and _total: every row's place in the order, without a sort of all rows in one task.

    A sample of the keys, ``parts`` of them at most, cuts the rows into ranges; it decides how even
    the ranges are, not the result. Ranges are counted, the counts added up, and each range
    numbers its own rows. The order should end with a unique column: equal keys lie in one range.
    """
    key = F.struct(*order)
    kinds = dict(df.dtypes)
    # the smallest hashes: a sample of bounded size that is the same on every run
    sample = df.select(key.alias("key")).orderBy(F.xxhash64("key"), "key").limit(parts).orderBy("key").collect()
    bounds = F.array(*(F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, r["key"], strict=True))) for r in sample))
    dealt = df.withColumn("_range", F.size(F.filter(bounds, lambda b: b < key)) if sample else F.lit(0))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    every = Window.orderBy("_range")  # a row a range
    before = counts.select("_range", (F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(before, "_range").withColumn("_position", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def pages(df: DataFrame, size: int = 20, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """All pages: every row with its 1-based ``page``."""
    return positions(df, order).withColumn("page", F.ceil(F.col("_position") / size)).drop("_position", "_total")


def page(df: DataFrame, number: int, size: int = 20, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """A 1-based page; beyond the last the last one, of no rows an empty one."""
    last = F.ceil(F.col("_total") / size)
    wanted = F.ceil(F.col("_position") / size) == F.least(F.lit(max(number, 1)).cast("long"), last)
    return positions(df, order).where(wanted).orderBy(*order).drop("_position", "_total")


def latest(df: DataFrame, at_col: str, n: int = 50, id_col: str = "id") -> DataFrame:
    return df.orderBy(F.desc(at_col), id_col).limit(n)


def match_connector(tools: DataFrame, queries: DataFrame) -> DataFrame:
    """Tools whose connector type contains a query, whatever the case. The tools are a fixed lookup of a few rows."""
    return queries.join(tools, F.contains(F.lower("connector_type"), F.lower("connector_query")))


def apply_solutions(history: DataFrame, solutions: DataFrame) -> DataFrame:
    """Each row with its latest solution, which makes it resolved; solutions of unknown rows change nothing.

    Sets solution, solution_status, resolved_at and, where the solutions have it, technician_name;
    rows without a solution keep what they have. Ties: the last text. The parts are in ``solution_parts``.
    """
    last = latest_solutions(solutions)
    new = {"solution": "solution", "resolved_at": "submitted_at"} | ({"technician_name": "technician_name"} if "technician_name" in solutions.columns else {})
    joined = history.join(last.select(F.col("history_id").alias("_of"), *(F.col(c).alias(f"_new_{c}") for c in new.values())), F.col("id") == F.col("_of"), "left")
    solved = F.col("_new_solution").isNotNull()
    old = lambda c: F.col(c) if c in history.columns else F.lit(None)
    values = {c: F.when(solved, F.col(f"_new_{source}")).otherwise(old(c)) for c, source in new.items()}
    values["solution_status"] = F.when(solved, "resolved").otherwise(F.col("solution_status"))
    return joined.withColumns(values).drop("_of", *(f"_new_{c}" for c in new.values()))


def latest_solutions(solutions: DataFrame) -> DataFrame:
    order = Window.partitionBy("history_id").orderBy(F.desc("submitted_at"), F.desc("solution"))
    return solutions.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def solution_parts(history: DataFrame, solutions: DataFrame) -> DataFrame:
    """A replacement row for each part (``replaced_parts``) of the solutions that ``apply_solutions`` takes."""
    known = latest_solutions(solutions).join(history.select(F.col("id").alias("history_id")), "history_id", "left_semi")
    return known.select(F.col("history_id").alias("troubleshooting_id"), F.col("submitted_at").alias("replaced_at"), F.inline("replaced_parts"))


def rejected_solutions(history: DataFrame, solutions: DataFrame) -> DataFrame:
    return solutions.join(history.select(F.col("id").alias("history_id")), "history_id", "left_anti")


def merge_unique(primary: DataFrame, extra: DataFrame, keys: tuple[str, ...] = ("query_id", "doc_path")) -> DataFrame:
    """The first table, and of the second what the first doesn't have."""
    return primary.unionByName(extra.join(primary.select(*keys), list(keys), "left_anti"))


def active_experts(experts: DataFrame, tenant: str) -> DataFrame:
    return experts.where((F.col("tenant_id") == tenant) & (F.col("available") == 1) & F.col("deleted_at").isNull()).orderBy("name", "id")


def escalations(diagnostics: DataFrame, bookings: DataFrame) -> DataFrame:
    """Diagnoses that need an expert, with their bookings."""
    each = bookings.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("id", "expert_id", "status"))).alias("bookings"))
    return diagnostics.where(F.col("certainty_status") == "REQUIRE_EXPERT").join(each, F.col("id") == F.col("query_id"), "left").drop("query_id")


def selftest_summary(results: DataFrame) -> DataFrame:
    """RAG fails if any query has no chunk, the crew if no output has references."""
    return results.agg(
        F.count("*").alias("tests_run"), F.avg("relevance").alias("avg_relevance"), F.avg("chunks").alias("avg_chunks"),
        F.when(F.bool_or(F.col("chunks") == 0), "FAIL").otherwise("PASS").alias("rag"), F.when(F.bool_or("has_references"), "PASS").otherwise("FAIL").alias("crew"),
    )


def first_code(parsed: DataFrame) -> DataFrame:
    """Of codes that occur again the first."""
    order = Window.partitionBy("code").orderBy("position")
    return parsed.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def codes_without_ranges(codes: DataFrame, ranges: DataFrame) -> DataFrame:
    return codes.join(ranges, "code", "left_anti")


def quick_check(requests: DataFrame, applicable: DataFrame, config_col: str = "configuration") -> DataFrame:
    """serial, token, applies: each token of a pasted list; names of configurations are compared with the aircraft's own."""
    tokens = requests.select("serial", config_col, F.explode(F.array_distinct(F.transform(F.filter(F.split("pasted", r"[\s,;]+"), lambda t: t != ""), lambda t: F.regexp_replace(F.upper(t), r"^\*+", "")))).alias("token"))
    alias = F.when(F.col("token") == "EN", "ENH").when(F.col("token") == "EP", "PLUS").otherwise(F.col("token"))
    known = applicable.select("serial", F.col("code").alias("token"), F.lit(True).alias("_has")).distinct()
    joined = tokens.join(known, ["serial", "token"], "left")
    is_config = F.col("token").isin("SN", "LN", "EN", "ENH", "EP", "PLUS")
    return joined.select("serial", "token", F.when(is_config, F.coalesce(alias == F.col(config_col), F.lit(False))).otherwise(F.coalesce("_has", F.lit(False))).alias("applies"))

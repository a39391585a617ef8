"""Effectivity lists: parsing of their text, statistics, and the two tables to store.

A list is a text file: a header line, then for each code a line ``*CODE``, its description and
its serial ranges. Every file is parsed by itself; only whole lines of one file meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import first_code

#: The line after which codes begin, the open end and start, and words of a condition.
HEADER = "- No code (blank)"
OPEN_END, OPEN_START = 99999, 1
CONDITION = r"(?i)that have|that install|equipped with|certified by"
RANGE = "struct<serial_start:int,serial_end:int>"


def parse_ranges(text: Column) -> Column:
    """array of (serial_start, serial_end): pairs, open ranges and double numbers by pattern, then single numbers that no range so far covers."""
    hits = lambda p, g=1: F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(g)), lambda x: x.try_cast("int"))
    pair = lambda a, b: F.struct(a.alias("serial_start"), b.alias("serial_end"))
    thru, double = r"S/N\s+(\d+)\s+thru\s+(\d+)", r"S/N\s+(\d+)\s+and\s+(\d+)(?!\s+subsequent)"
    end, start = F.lit(OPEN_END), F.lit(OPEN_START)
    ranges = F.concat(
        F.zip_with(hits(thru), hits(thru, 2), pair),
        F.transform(hits(r"(?i)S/N\s+(\d+)\s+thru\s+TBD"), lambda x: pair(x, end)),
        F.transform(hits(r"(?i)S/N\s+TBD\s+thru\s+(\d+)"), lambda x: pair(start, x)),
        F.transform(hits(r"S/N\s+(\d+)\s+and\s+subsequent"), lambda x: pair(x, end)),
        F.flatten(F.zip_with(hits(double), hits(double, 2), lambda a, b: F.array(pair(a, a), pair(b, b)))),
    ).cast(f"array<{RANGE}>")
    single = hits(r"S/N\s+(\d+)(?!\s+thru|\s+and|\d)")
    covered = lambda acc, x: F.exists(acc, lambda r: x.between(r["serial_start"], r["serial_end"]))
    return F.aggregate(single, ranges, lambda acc, x: F.when(covered(acc, x), acc).otherwise(F.concat(acc, F.array(pair(x, x)).cast(f"array<{RANGE}>"))))


def parse_codes(files: DataFrame) -> DataFrame:
    """From (path, value = whole text): path, position, code, description, is_deleted, is_conditional, conditional_part_number, ranges."""
    lines = files.select("path", F.posexplode(F.split("value", "\n", -1)).alias("line_no", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))
    header = lines.where(F.col("line") == HEADER).groupBy("path").agg(F.min("line_no").alias("header"))
    body = lines.join(header, "path").where("line_no >= header")
    starts = (F.col("line_no") == F.col("header")) | F.rlike("line", F.lit(r"^\*(\w+)$"))
    # a running count over the lines of one file
    body = body.withColumns({"starts": starts, "position": F.count_if(starts).over(Window.partitionBy("path").orderBy("line_no"))})
    kept = F.when(~F.col("starts") & ~F.col("line").isin("-", ":", ""), F.struct("line_no", "line"))
    code = F.when(F.col("line_no") == F.col("header"), "ALL").otherwise(F.substring("line", 2, 1000000))
    grouped = body.groupBy("path", "position").agg(F.max(F.when(F.col("starts"), code)).alias("code"), F.sort_array(F.collect_list(kept)).alias("rows"))
    said = F.transform("rows", lambda r: r["line"])
    clean = F.filter(F.transform(said, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^:\s*", ""), r"^-\s*", ""))), lambda x: x != "")
    words = F.trim(F.array_join(F.filter(clean, lambda x: ~F.rlike(x, F.lit(r"^S/N\s+\d"))), " "))
    first = F.get(F.filter(clean, lambda x: F.contains(x, F.lit("S/N"))), F.lit(0))
    out = grouped.withColumn("description", F.when(words != "", words).otherwise(F.coalesce(first, F.lit(""))))
    deleted = F.rlike("description", F.lit(r"(?i)^Deleted$"))
    conditional = F.rlike("description", F.lit(CONDITION)) & ~deleted
    number = F.nullif(F.regexp_extract("description", r"P/N\s+(\S+)", 1), F.lit(""))
    return out.select(
        "path", "position", "code", F.when(F.col("description") == "", "No description").otherwise(F.col("description")).alias("description"),
        deleted.cast("int").alias("is_deleted"), conditional.cast("int").alias("is_conditional"), F.when(conditional, number).alias("conditional_part_number"),
        F.when(deleted, F.array().cast(f"array<{RANGE}>")).otherwise(parse_ranges(F.array_join(said, "\n"))).alias("ranges"),
    )


def parse_stats(parsed: DataFrame) -> DataFrame:
    """Counts of codes (different ones), ranges, deleted and conditional codes, and of the others with and without ranges."""
    live, some = F.col("is_deleted") == 0, F.size("ranges") > 0
    return parsed.agg(
        F.count_distinct("code").alias("codes"), F.coalesce(F.sum(F.size("ranges")), F.lit(0)).alias("ranges"), F.count_if(~live).alias("deleted"),
        F.count_if(F.col("is_conditional") == 1).alias("conditional"), F.count_if(live & some).alias("with_ranges"), F.count_if(live & ~some).alias("without_ranges"),
    )


def load(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(codes, ranges, stats): a code once, by its first place; the ranges of all its places."""
    parsed = parse_codes(files)
    codes = first_code(parsed).drop("ranges", "position", "path")
    ranges = parsed.select("code", F.explode("ranges").alias("r")).select("code", "r.serial_start", "r.serial_end")
    return codes, ranges, parse_stats(parsed)


def store(codes: DataFrame, ranges: DataFrame, folder: str) -> bool:
    """Writes both tables anew, unless the folder's table of codes already has as many rows; whether it wrote."""
    spark = codes.sparkSession
    try:
        known = spark.read.parquet(f"{folder}/part_codes").count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = -1
    if known >= codes.count():
        return False
    codes.write.mode("overwrite").parquet(f"{folder}/part_codes")
    ranges.write.mode("overwrite").parquet(f"{folder}/part_code_ranges")
    return True

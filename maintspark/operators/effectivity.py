"""Which configuration and part codes apply to an aircraft: interval joins on serial numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The configurations.
CONFIGURATIONS = {"SN": "Short Nose", "LN": "Long Nose", "ENH": "Enhanced", "PLUS": "Plus"}
#: Bits of a serial number, unless a highest one is given.
BITS = 17


def serial_digits(serial: Column) -> Column:
    """All digits of a serial as a number; null if there are none."""
    return F.regexp_replace(serial, r"[^0-9]", "").try_cast("int")


def serial_prefix(serial: Column) -> Column:
    """The leading digits only."""
    return F.regexp_extract(serial, r"^\s*([0-9]+)", 1).try_cast("int")


def range_nodes(start: Column, end: Column, bits: int = BITS) -> Column:
    """The fewest nodes of a binary tree over 0 .. 2**bits - 1 that cover a range: two a level at most. Nodes are numbered like a heap, the root is 1."""
    one = F.lit(1).cast("long")

    def step(acc: Column, level: Column) -> Column:
        a, b, there = acc["a"], acc["b"], acc["a"] <= acc["b"]
        first = F.call_function("shiftleft", one, (F.lit(bits) - level).cast("int"))
        # a right child at the left end, and a left child at the right end, stand for themselves
        left, right = there & (a % 2 == 1), there & (b % 2 == 0)
        ends = F.array_compact(F.array(F.when(left, first + a), F.when(right, first + b)))
        a, b = F.when(left, a + 1).otherwise(a), F.when(right, b - 1).otherwise(b)
        # an empty rest stays empty
        return F.struct(F.when(a <= b, F.shiftright(a, 1)).otherwise(1 << 40).alias("a"), F.when(a <= b, F.shiftright(b, 1)).otherwise(-1).alias("b"), F.concat(acc["nodes"], ends).alias("nodes"))

    begin = F.struct(F.greatest(start, F.lit(0)).cast("long").alias("a"), F.least(end, F.lit((1 << bits) - 1)).cast("long").alias("b"), F.array().cast("array<long>").alias("nodes"))
    return F.when(start.isNotNull() & end.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(bits)), begin, step, lambda acc: acc["nodes"]))


def value_nodes(value: Column, bits: int = BITS) -> Column:
    """The nodes above a value, itself included: one a level."""
    one, number = F.lit(1).cast("long"), value.cast("long")
    path = F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda level: F.call_function("shiftleft", one, (F.lit(bits) - level).cast("int")) + F.call_function("shiftright", number, level.cast("int")))
    return F.when(value.between(0, (1 << bits) - 1), path)


def interval_join(left: DataFrame, ranges: DataFrame, value: str, highest: int) -> DataFrame:
    """left x ranges where serial_start <= value <= serial_end, by nodes of a binary tree: an equi-join, whatever the sizes.

    A range becomes at most two nodes a level, open-ended ones as well, and a value meets exactly
    one node of each range that holds it. Values above the highest or below 0 and nulls meet nothing.
    """
    bits = max(1, highest.bit_length())
    end = F.when(F.col("serial_end") > highest, highest).otherwise(F.col("serial_end"))
    cut = ranges.withColumn("_node", F.explode(range_nodes(F.col("serial_start"), end, bits)))
    keyed = left.where(F.col(value) <= highest).withColumn("_node", F.explode(value_nodes(F.col(value), bits)))
    return keyed.join(cut, "_node").drop("_node")


def resolve_configuration(aircraft: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row an aircraft: its configuration, or a warning. Distinct serials are resolved once; the first range by start, end and code counts."""
    number = aircraft.withColumn("serial", serial_digits(F.col("serial_number")))
    keys = number.select("serial").dropna().distinct()
    hit = F.min(F.struct("serial_start", "serial_end", "configuration_code"))["configuration_code"]
    found = interval_join(keys, ranges, "serial", 99_999).groupBy("serial").agg(hit.alias("configuration"))
    out = number.join(found, "serial", "left")
    warning = F.when(F.col("serial").isNull(), "invalid format").when(F.col("configuration").isNull(), "not found")
    return out.select(*aircraft.columns, "serial", "configuration", warning.alias("warning"), F.col("configuration").isNotNull().alias("is_resolved"))


def applicable_codes(aircraft: DataFrame, ranges: DataFrame, codes: DataFrame, least: int = 31_005, highest: int = 99_999) -> DataFrame:
    """serial, code, description: the codes in use that apply to each distinct serial."""
    serials = aircraft.select(serial_digits(F.col("serial_number")).alias("serial")).where(F.col("serial") >= least).distinct()
    hits = interval_join(serials, ranges, "serial", highest).select("serial", "code").distinct()
    return hits.join(codes.where(F.col("is_deleted") == 0), "code").select("serial", "code", "description", "is_conditional")


def applicable_summary(aircraft: DataFrame, ranges: DataFrame, codes: DataFrame) -> DataFrame:
    serials = aircraft.select(serial_digits(F.col("serial_number")).alias("serial")).where(F.col("serial") >= 31_005).distinct()
    counts = applicable_codes(aircraft, ranges, codes).groupBy("serial").agg(F.count("*").alias("total"), F.count_if(F.col("is_conditional") == 0).alias("standard"), F.count_if(F.col("is_conditional") == 1).alias("conditional"))
    return serials.join(counts, "serial", "left").fillna(0, ["total", "standard", "conditional"])


def classify_parts(requests: DataFrame, part_effectivity: DataFrame) -> DataFrame:
    """part_number, configuration_code -> applicable, not_applicable or unknown."""
    flags = part_effectivity.groupBy(F.upper("part_number").alias("_pn"), F.col("configuration_code").alias("_cc")).agg(F.max("is_applicable").alias("flag"))
    joined = requests.join(flags, (F.upper(requests["part_number"]) == F.col("_pn")) & (requests["configuration_code"] == F.col("_cc")), "left")
    return joined.withColumn("applicability", F.when(F.col("flag") == 1, "applicable").when(F.col("flag") == 0, "not_applicable").otherwise("unknown")).drop("_pn", "_cc", "flag")


def code_stats(codes: DataFrame, ranges: DataFrame) -> DataFrame:
    a = codes.agg(F.count("*").alias("total_codes"), F.count_if(F.col("is_deleted") == 0).alias("active_codes"), F.count_if(F.col("is_conditional") == 1).alias("conditional_codes"))
    return a.crossJoin(ranges.agg(F.count("*").alias("total_ranges")))  # one row each


def search_codes(codes: DataFrame, text: str) -> DataFrame:
    q = F.upper(F.lit(text))
    return codes.where(F.upper("code").contains(q) | F.upper("description").contains(q))


#: The serial ranges of the configurations (first, last, configuration).
SERIAL_RANGES = (
    (31005, 31200, "SN"), (41001, 41200, "SN"), (31201, 31399, "LN"), (41201, 41299, "LN"), (31400, 31699, "ENH"),
    (41300, 41499, "ENH"), (60001, 60999, "ENH"), (31700, 40999, "PLUS"), (41501, 59999, "PLUS"), (61001, 61999, "PLUS"),
)


def serial_ranges(spark) -> DataFrame:
    return spark.createDataFrame(SERIAL_RANGES, "serial_start int, serial_end int, configuration_code string")

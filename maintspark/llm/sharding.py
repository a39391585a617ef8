"""A uniform shuffle of rows into shards of exact sizes, by a hypergeometric communication matrix.

1. Each partition of the input permutes its rows: a sort by a hash of the row's place.
2. How many rows each partition sends to each shard is drawn exactly as a uniform random
   permutation of all rows would have it: the partition's n rows are a sample without
   replacement from the places that the shards have left, so the counts follow a
   multivariate hypergeometric distribution. Partitions are drawn in two levels, first
   blocks of them, then the partitions of a block, so no row or task holds more than a
   block's counts.
3. The first rows of a permuted partition go to shard 0, the next to shard 1, and so on.
4. Each shard permutes what it received: rows sort by a second hash in buckets of bounded
   size, and the counts of the buckets before give the slots.

Every draw is a hash of the seed and of what is drawn, so reruns over the same partitions
agree; the permuted rows are written before anything is counted, so a lost executor changes
nothing. Another partitioning of the input gives another shuffle, just as uniform.

Shard sizes differ by one at most (the law ``rows``). Rows are dealt one by one: repeated
rows and equal texts have no common shard. Null ids and texts are kept; a null text has no
bytes. Empty tables give empty results; columns of the input keep their names, whatever
they are, inside of ``row``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Of the ratio-of-uniforms hat for unimodal discrete distributions, 2 sqrt(2/e) and 3 - 2 sqrt(3/e).
HAT_WIDTH, HAT_EDGE = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)
#: Tries of one draw; each is accepted with a probability over 0.5, so all fail once in 2**100.
TRIES = 100
#: Partitions of a block, and rows of a bucket on average.
BLOCK, BUCKET = 1000, 200_000
#: Rows of the matrix that are broadcast at most: 24 counts each, 20 MB.
MOST_PARTS = 100_000


def uniform(*of: Column | int | str) -> Column:
    """In (0, 1), by a hash of the values."""
    return (F.shiftrightunsigned(F.xxhash64(*(c if isinstance(c, Column) else F.lit(c) for c in of)), 11).cast("double") + 0.5) / float(1 << 53)


def _log_ratio(m: Column, k: Column) -> Column:
    """ln(m! / k!), without the loss of digits of a difference of large logarithms."""
    series = lambda x: 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    large = (k + 0.5) * F.log1p((m - k) / k) + (m - k) * F.ln(m) - (m - k) + series(m) - series(k)
    small = lambda x: F.when(x <= 20, F.ln(F.factorial(F.least(x, F.lit(20.0)).cast("int")))).otherwise((x + 0.5) * F.ln(F.greatest(x, F.lit(1.0))) - x + 0.5 * math.log(2 * math.pi) + series(F.greatest(x, F.lit(1.0))))
    return F.when((m > 20) & (k > 20), large).otherwise(small(m) - small(k))


def _bind(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(good: Column, bad: Column, n: Column, *of: Column | int) -> Column:
    """How many of n draws without replacement from good + bad are good: a long, by rejection from a ratio-of-uniforms hat.

    ``of`` is what the hash of the draw is made of. 0 <= n <= good + bad.
    """

    def drawn(s: Column) -> Column:
        few, many, take, total = s["few"], s["many"], s["take"], s["few"] + s["many"]
        mode = F.floor((take + 1) * (few + 1) / (total + 2)).cast("double")
        spread = F.sqrt((total - take) * take * (few / total) * (many / total) / F.greatest(total - 1, F.lit(1.0)) + 0.5)
        hat = F.struct(mode.alias("mode"), (take * few / total + 0.5).alias("centre"), (HAT_WIDTH * spread + HAT_EDGE).alias("width"))

        def tries(h: Column) -> Column:
            def attempt(got: Column, i: Column) -> Column:
                def judged(t: Column) -> Column:
                    x, m = t["x"], h["mode"]
                    log = _log_ratio(m, x) + _log_ratio(few - m, few - x) + _log_ratio(take - m, take - x) + _log_ratio(many - take + m, many - take + x)
                    inside = (x >= F.greatest(F.lit(0.0), take - many)) & (x <= F.least(take, few))
                    return F.when(inside, F.when(2 * F.ln(t["u"]) <= log, x))

                u = uniform(*of, i, 1)
                t = F.struct(F.floor(h["centre"] + h["width"] * (uniform(*of, i, 2) - 0.5) / u).cast("double").alias("x"), u.alias("u"))
                return F.when(got.isNotNull(), got).otherwise(_bind(t, judged))

            # the most likely count, should all tries fail
            return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("double"), attempt), h["mode"])

        found = F.when((take == 0) | (few == 0), F.lit(0.0)).otherwise(_bind(hat, tries))
        return found.cast("long")

    # by symmetry of good and bad, and of the drawn and the rest, only the smaller halves are drawn
    total = good + bad
    few, take = F.least(good, bad), F.least(n, total - n)
    got = _bind(F.struct(few.cast("double").alias("few"), F.greatest(good, bad).cast("double").alias("many"), take.cast("double").alias("take")), drawn)
    return _bind(F.struct(got.alias("got"), good.alias("good"), bad.alias("bad"), n.alias("n")), lambda s: _unfold(s))


def _unfold(s: Column) -> Column:
    half = F.when(s["n"] <= s["good"] + s["bad"] - s["n"], s["got"]).otherwise(F.least(s["good"], s["bad"]) - s["got"])
    return F.when(s["good"] <= s["bad"], half).otherwise(s["n"] - half).cast("long")


def row_of_matrix(left: Column, n: Column, *of: Column | int) -> Column:
    """How many of n rows go to each shard, where ``left`` are the places left: one univariate draw a shard, given those before."""

    def step(acc: Column, place: Column) -> Column:
        k = F.size(acc["counts"])
        got = hypergeometric(place, acc["rest"] - place, acc["n"], *of, k)
        return _bind(got, lambda g: F.struct(F.concat(acc["counts"], F.array(g)).alias("counts"), (acc["rest"] - place).alias("rest"), (acc["n"] - g).alias("n")))

    start = F.struct(F.array().cast("array<long>").alias("counts"), F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x).alias("rest"), n.alias("n"))
    return F.aggregate(left, start, step, lambda acc: acc["counts"])


def _dealt(groups: DataFrame, seed: int, level: int) -> DataFrame:
    """groups: left (places of the shards), members (array of id, n). A row per member: id, counts (to each shard)."""

    def step(acc: Column, m: Column) -> Column:
        counts = row_of_matrix(acc["left"], m["n"], seed, level, m["id"])
        return _bind(counts, lambda c: F.struct(F.zip_with(acc["left"], c, lambda a, b: a - b).alias("left"), F.concat(acc["rows"], F.array(F.struct(m["id"].alias("id"), c.alias("counts")))).alias("rows")))

    start = F.struct(F.col("left"), F.array().cast("array<struct<id:long,counts:array<long>>>").alias("rows"))
    return groups.select(F.inline(F.aggregate("members", start, step, lambda acc: acc["rows"])))


def communication_matrix(parts: DataFrame, shards: int, seed: int, block: int = BLOCK) -> DataFrame:
    """parts: part, n. A row per part: part, counts (long for each shard); a shard's counts sum to its size."""
    blocks = parts.groupBy(F.floor(F.col("part") / block).alias("id")).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("part").alias("id"), "n"))).alias("members"))
    sizes = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(F.col("total") / shards) + F.when(s < F.pmod("total", F.lit(shards)), 1).otherwise(0))
    # one row with a count a block
    whole = blocks.agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("id", "n"))).alias("members")).where("total > 0").select("members", sizes.alias("left"))
    placed = _dealt(whole, seed, 1).select("id", F.col("counts").alias("left"))
    return _dealt(blocks.join(placed, "id"), seed, 2).select(F.col("id").alias("part"), "counts")


def shuffled(rows: DataFrame, shards: int = 24, seed: int = 13, bucket: int = BUCKET) -> DataFrame:
    """row (a struct of the columns), shard, slot: every row in a shard, slots gapless from 0 within it."""
    placed = rows.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place"))
    mixed = placed.withColumn("key", F.xxhash64(F.lit(seed), "place")).sortWithinPartitions("key", "place")
    at = F.monotonically_increasing_id()  # partition in the upper bits, place in the permuted partition below
    written = saved(mixed.select("row", "place", at.alias("at")), "permuted")
    part, rank = F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("rank")
    matrix = saved(communication_matrix(written.groupBy(part).agg(F.count("*").alias("n")), shards, seed), "matrix")
    ends = matrix.select("part", F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(F.slice("counts", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x)).alias("ends"))
    ends = F.broadcast(ends) if ends.limit(MOST_PARTS + 1).count() <= MOST_PARTS else ends
    # the shard is the number of ends at or before the row
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard")
    sent = written.select("row", "place", part, rank).join(ends, "part").select("row", "place", shard)
    total = matrix.agg(F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, math.ceil(total / shards / bucket))
    second = F.xxhash64(F.lit(seed + 1), "place")
    sent = sent.withColumns({"key": second, "bucket": F.floor(uniform(second, seed) * buckets).cast("long")})
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "place")) - 1
    return sent.withColumn("order", order).join(starts, ["shard", "bucket"]).select("row", "shard", (F.col("first") + F.col("order")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 13) -> None:
    """Whole documents as Parquet, a folder ``_shard=N`` each, with their slot in ``_slot``; the files of a shard are sorted by it."""
    out = shuffled(docs, shards, seed)
    out.select(F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), "row").repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)


def op13_sharding(docs: DataFrame, shards: int = 24, seed: int = 13) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null) for every document; texts don't travel."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffled(rows, shards, seed).select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

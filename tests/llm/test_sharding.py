import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maintspark.llm.sharding import communication_matrix, hypergeometric, op13_sharding, shuffled, write_shards

from .cases import HARD, clashing, empty, hard


def chi_square(counts, want):
    """Of the values expected often enough; their number goes along."""
    often = {k: v for k, v in want.items() if v > 5}
    return sum((counts.get(k, 0) - v) ** 2 / v for k, v in often.items()), len(often)


@pytest.mark.parametrize(("good", "bad", "n"), [(3, 7, 2), (1, 1, 1), (5, 0, 3), (0, 4, 2), (30, 50, 40), (1000, 200, 17), (40, 3000, 2900)])
def test_draws_are_hypergeometric(spark, good, bad, n):
    runs, long = 20000, lambda v: F.lit(v).cast("long")
    got = Counter(r[0] for r in spark.range(runs).select(hypergeometric(long(good), long(bad), long(n), 5, F.col("id"))).collect())
    want = {k: runs * (math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)) for k in range(max(0, n - bad), min(good, n) + 1)}
    assert set(got) <= set(want)
    value, size = chi_square(got, want)
    assert value < size + 5 * math.sqrt(2 * size) + 5


def test_draws_of_very_large_counts(spark):
    n = 10**12
    mean, var = n / 4, n * 0.25 * 0.75 * (1 - n / (8 * n))
    long = lambda v: F.lit(v).cast("long")
    got = [r[0] for r in spark.range(4000).select(hypergeometric(long(2 * n), long(6 * n), long(n), 5, F.col("id"))).collect()]
    z = [(g - mean) / math.sqrt(var) for g in got]
    assert abs(sum(z) / len(z)) < 0.08
    assert abs(sum(v * v for v in z) / len(z) - 1) < 0.12


def test_matrix_in_two_levels_keeps_all_sums(spark):
    parts = [(i * 3, (i * 37) % 11) for i in range(57)]
    rows = communication_matrix(spark.createDataFrame(parts, "part long, n long"), 5, 3, block=10).collect()
    assert {r["part"]: sum(r["counts"]) for r in rows} == dict(parts)
    total = sum(n for _, n in parts)
    assert [sum(r["counts"][s] for r in rows) for s in range(5)] == [total // 5 + (s < total % 5) for s in range(5)]
    assert all(c >= 0 for r in rows for c in r["counts"])


def test_every_law_holds(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7)
    for table in (docs.unionByName(docs), clashing(hard(spark)), docs.limit(10)):
        table = table.persist()
        rows = op13_sharding(table).collect()
        texts = Counter((r["doc_id"], r["text"]) for r in table.collect())
        assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in texts.elements())
        want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts.elements())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
        slots = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(24)}
        assert all(v == list(range(len(v))) for v in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        assert {r["law"] for r in rows} == {"rows"}
        assert {r["grown_shard"] for r in rows} == {None}
        table.unpersist()


def test_null_ids_and_empty_tables(spark):
    rows = op13_sharding(spark.createDataFrame([(None, None), (None, "a")], "doc_id long, text string")).collect()
    assert sorted(r["size"] for r in rows) == [8, 9]
    out = op13_sharding(empty(spark))
    assert out.count() == 0
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}


def test_shuffle_is_uniform_and_buckets_join_up(spark):
    """Where rows land doesn't depend on where they were: each part of the ids visits each part of each shard alike."""
    got = shuffled(spark.range(24000, numPartitions=3), 3, bucket=900).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, i) for s in range(3) for i in range(8000)]
    seen = Counter((r["row"]["id"] // 2000, r["shard"], r["slot"] // 1000) for r in got)
    value, size = chi_square(seen, {(i, s, t): 24000 / 288 for i in range(12) for s in range(3) for t in range(8)})
    assert size - 5 * math.sqrt(2 * size) < value < size + 5 * math.sqrt(2 * size)


def test_whole_documents_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    write_shards(clashing(hard(spark)), path, 4)
    back = spark.read.parquet(path)
    assert Counter(r["text"] for r in back.select("row.text").collect()) == Counter(HARD)
    assert back.groupBy("_shard").agg(F.max("_slot").alias("m"), F.count("*").alias("n")).where("m + 1 <> n").count() == 0

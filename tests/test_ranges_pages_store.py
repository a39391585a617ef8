import random
from datetime import date

from pyspark.sql import functions as F

from maintspark.operators import effectivity, records
from maintspark.sources import tables


def test_ranges_by_nodes_equal_between(spark):
    rng = random.Random(5)
    ranges = [(i, a := rng.randrange(-5, 70), a + rng.choice([-2, 0, 1, 7, 40, 99999])) for i in range(120)] + [(900, 0, 63), (901, 0, 127), (902, None, 5), (903, 5, None)]
    values = [(v,) for v in [*range(-2, 80), None]]
    df = spark.createDataFrame(ranges, "rid int, serial_start int, serial_end int")
    got = sorted((r.v, r.rid) for r in effectivity.interval_join(spark.createDataFrame(values, "v int"), df, "v", 63).collect())
    assert got == sorted((v, i) for (v,) in values for i, a, b in ranges if v is not None and 0 <= v <= 63 and None not in (a, b) and a <= v <= b)


def test_open_ranges_are_few_nodes(spark):
    for a, b in ((0, 99999), (1, 99999), (1, 131070), (31005, 99999), (7, 7), (5, 4)):
        nodes = spark.range(1).select(effectivity.range_nodes(F.lit(a), F.lit(b)).alias("n")).first().n
        assert len(nodes) <= 2 * effectivity.BITS
        low = lambda n: n << (effectivity.BITS - n.bit_length() + 1)
        covered = sorted((low(n) - (1 << effectivity.BITS), 1 << (effectivity.BITS - n.bit_length() + 1)) for n in nodes)
        assert sum(size for _, size in covered) == max(0, b - a + 1)
        assert all(x + size == y for (x, size), (y, _) in zip(covered, covered[1:], strict=False))
        assert not covered or covered[0][0] == a


def test_every_page(spark):
    rows = [(i % 7, date(2024, 1, 1 + i % 5) if i % 4 else None, f"k{i}") for i in range(103)]
    df = spark.createDataFrame(rows, "a int, d date, id string").repartition(4)
    ordered = [r.id for r in df.orderBy("a", "d", "id").collect()]
    got = {r.id: r.page for r in records.pages(df, 10, ("a", "d", "id")).collect()}
    assert got == {k: i // 10 + 1 for i, k in enumerate(ordered)}
    for number, start in ((1, 0), (0, 0), (-3, 0), (4, 30), (11, 100), (12, 100), (999, 100)):
        page = records.page(df, number, 10, ("a", "d", "id"))
        assert page.columns == df.columns
        assert [r.id for r in page.collect()] == ordered[start : start + 10]
    assert records.page(df.limit(0), 3).collect() == []
    assert records.positions(df, ("a", "d", "id"), parts=3).where("_total <> 103").count() == 0


def test_store_takes_each_batch_and_path_once(spark, tmp_path):
    path, schema = f"file://{tmp_path}/store", tables.CORPUS
    docs = lambda *names: spark.createDataFrame([(n, [1.0], "t") for n in names], schema)
    assert tables.append_new(spark, docs("a", "b", "a"), path, 0)
    assert not tables.append_new(spark, docs("x"), path, 0)
    # what a batch that was cut off left behind is never read, and replaced when the batch is run again
    docs("left").write.parquet(f"{path}/_staged/1/bucket=3")
    assert sorted(r.doc_path for r in tables.read_store(spark, path).collect()) == ["a", "b"]
    assert tables.append_new(spark, docs("b", "c"), path, 1)
    assert sorted(r.doc_path for r in tables.read_store(spark, path).collect()) == ["a", "b", "c"]
    assert sorted(r.doc_path for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    # only the buckets of new paths are read
    known = tables.read_store(spark, path)
    bucket = known.where("doc_path = 'c'").first().bucket
    scan = known.where(F.col("bucket").isin(bucket))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan

"""What the operators of this subpackage share: tables, the shared folder, hashes."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch: texts may be very long, and a batch is held whole by the JVM and by Python.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python workers, unless the session already says something else than Spark's default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, BATCH_ROWS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share.

    The folder is the cluster's ``spark.checkpoint.dir``; only where it is unset
    (single-machine tests) a temporary one is made and set.
    """
    small_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``saved`` wrote and nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files are deleted when the query ends. Else they stay until the driver's JVM happens to collect what refers to them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Keys that are broadcast at most: 16 MB, or 32 with two to a key.
MOST_KEYS = 1_000_000


def only(df: DataFrame, keys: DataFrame, name: str, key: Column | None = None, anti: bool = False) -> DataFrame:
    """The rows whose key is (or, with ``anti``, isn't) in a written table: broadcast if it is small, which is checked, else by a shuffle."""
    small = keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    taken = {c.lower() for c in df.columns}
    fresh = next(n for n in (f"_only_key{i}" for i in range(len(taken) + 1)) if n not in taken)
    other = keys.select(F.col(name).alias(fresh))
    return df.join(F.broadcast(other) if small else other, (df[name] if key is None else key) == other[fresh], "left_anti" if anti else "left_semi")


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads 64-bit values evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def slices(batch, rows: int = 256):
    """A record batch in parts, so that little of it is Python objects at once."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
    pa.default_memory_pool().release_unused()


def fields(schema: str) -> list[str]:
    """The column names of a flat DDL string."""
    return [part.split()[0] for part in schema.split(", ")]

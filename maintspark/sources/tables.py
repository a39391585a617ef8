"""Reading manuals and corpora, and adding to a store."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maintspark.functions.text import truncated

CORPUS = "doc_path string, embedding array<float>, text string"


def read_corpus_json(spark: SparkSession, path: str, legacy: str | None = None) -> DataFrame:
    """One JSON array of documents, at the first path or else the legacy one; those without a vector are left out. Not splittable: store it as Parquet once."""
    if legacy:
        file = spark._jvm.org.apache.hadoop.fs.Path(path)
        path = path if file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file) else legacy
    return spark.read.schema(CORPUS).option("multiLine", True).json(path).where("embedding is not null")


def read_table(spark: SparkSession, source: str, schema: str, table: str | None = None, partition: tuple[str, int, int, int] | None = None, properties: dict | None = None) -> DataFrame:
    """A declared table: a Parquet path, or a JDBC address with ``table``; ``partition``: column, lowest, highest, number of parallel reads."""
    if not source.startswith("jdbc:"):
        return spark.read.schema(schema).parquet(source)
    reader = spark.read.format("jdbc").option("url", source).option("dbtable", table).options(**(properties or {}))
    if partition:
        column, low, high, n = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    names = [c.strip().split()[0] for c in schema.split(",")]
    return reader.load().select(*names)


def read_effectivity_text(spark: SparkSession, path: str) -> DataFrame:
    """path and value: each file of effectivity codes as one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def write_report(df: DataFrame, path: str) -> None:
    """A self-test's rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def list_xml(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of every XML file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(F.lower("path").endswith(".xml")).select("path", "content")


def xml_text(content: bytes | str | None) -> str | None:
    """Text, tail and attribute values of each element in pre-order; None if it can't be parsed."""
    try:
        root = ElementTree.fromstring(content)
    except (ElementTree.ParseError, TypeError, ValueError):
        return None
    parts = [x.strip() for e in root.iter() for x in (e.text, e.tail, *e.attrib.values()) if x and x.strip()]
    return " ".join(parts)


def with_xml_text(files: DataFrame, content_col: str = "content", text_col: str = "text") -> DataFrame:
    @F.pandas_udf("string")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(xml_text)

    return files.withColumn(text_col, parse(content_col))


def page_text(pages: DataFrame) -> DataFrame:
    """The pages' texts of each path, joined in page order."""
    rows = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("path").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def new_documents(files: DataFrame, store: DataFrame) -> DataFrame:
    return files.join(store.select(F.col("doc_path").alias("_known")), F.col("path") == F.col("_known"), "left_anti")


#: Buckets of a store.
BUCKETS = 64


def _folder(spark: SparkSession, path: str):
    """A path and its file system."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file, file.getFileSystem(spark._jsc.hadoopConfiguration())


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a store, with their ``bucket``; only whole batches are there to be read."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def append_new(spark: SparkSession, docs: DataFrame, path: str, batch: str | int | None = None, buckets: int = BUCKETS) -> bool:
    """Adds the documents whose paths the store doesn't have; of equal new paths the smallest row counts. False if the batch is there already.

    A store is a folder a batch, in it a folder a bucket (by a hash of the path). Only buckets of
    the new paths are read to find known ones. A batch is written beside the store and moved in
    as a whole, so a batch that was cut off leaves nothing, and one with the same ``batch`` that
    is run again writes nothing. The number of buckets of a store must stay the same.
    """
    batch = uuid.uuid4().hex if batch is None else batch
    target, fs = _folder(spark, f"{path}/batch={batch}")
    if fs.exists(target):
        return False
    order = Window.partitionBy("doc_path").orderBy("text")
    once = docs.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn").withColumn("bucket", F.pmod(F.xxhash64("doc_path"), F.lit(buckets)).cast("int"))
    if fs.globStatus(_folder(spark, f"{path}/batch=*")[0]):
        touched = [r["bucket"] for r in docs.select(F.pmod(F.xxhash64("doc_path"), F.lit(buckets)).cast("int").alias("bucket")).distinct().collect()]  # ``buckets`` rows at most
        known = read_store(spark, path).where(F.col("bucket").isin(touched)).select("bucket", "doc_path")
        once = once.join(known, ["bucket", "doc_path"], "left_anti")
    staged, _ = _folder(spark, f"{path}/_staged/{batch}")
    once.write.mode("overwrite").partitionBy("bucket").parquet(staged.toString())
    if not fs.rename(staged, target):
        raise OSError(f"{staged.toString()} can't be moved to {target.toString()}")
    return True


def union_store(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new)


def ordered_union(xml: DataFrame, pages: DataFrame) -> DataFrame:
    """Extracted documents of both kinds; ``kind_order`` puts those of XML first."""
    return xml.withColumn("kind_order", F.lit(0)).unionByName(pages.withColumn("kind_order", F.lit(1)))


def corpus(xml: DataFrame, pages: DataFrame, existing: DataFrame) -> DataFrame:
    """From XML files (path, content), page texts (path, page, text) and a store (doc_path): path, text, error and kind_order of the new documents.

    Texts are cut to 4000 characters, those of pages to 8000; the file's name stands in for
    fewer than 20. A file that can't be parsed has an error and no text.
    """
    name = F.element_at(F.split("path", "/"), -1)
    new_xml = with_xml_text(new_documents(xml, existing))
    broken = F.col("text").isNull()
    one = new_xml.select("path", F.when(~broken, truncated(F.col("text"), name)).alias("text"), F.when(broken, "parse error").alias("error"))
    two = page_text(new_documents(pages, existing)).select("path", truncated(F.col("text"), name, 8000).alias("text"), F.lit(None).cast("string").alias("error"))
    return ordered_union(one, two)


def error_report(docs: DataFrame) -> DataFrame:
    return docs.where("error is not null").groupBy("error").agg(F.count("*").alias("n"), F.min("path").alias("example"))


def checkpoint_summary(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count("*").alias("total"))

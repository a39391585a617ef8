"""Documents ranked by the angle between vectors and by keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import best_documents


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.filter(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), lambda x: x.isNotNull()), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty or zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def document_id(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    for part in ("dmc-", ".xml", ".pdf"):
        name = F.replace(name, F.lit(part), F.lit(""))
    return name


def top_k(scored: DataFrame, k: int = 5) -> DataFrame:
    """Per query the k best scores above 0; ties by document."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.where(F.col("score") > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(corpus: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, doc_id, score, rank: the k best of all documents for each question, by blocks; scores are rounded to 6 places, ties go by document."""
    zero, every = F.lit(0), F.struct(F.lit(1).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    docs = corpus.select("doc_id", F.lit("").alias("key"), vector, zero.alias("rules"), every.alias("tags"), F.lit(False).alias("flagged"))
    asked = queries.select("query_id", vector, zero.alias("rules"), zero.alias("tag"), zero.alias("other"))
    return best_documents(docs, asked, k, digits=6).where("not extra").select("query_id", "doc_id", "score", "rank")


def index_stats(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count("*").alias("documents"), F.count_if(F.size("embedding") > 0).alias("with_embedding"), F.count_if(F.length("doc_path") > 0).alias("with_path"))

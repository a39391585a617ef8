"""Search of manuals for many questions at once: filters by material or system, ranking, wiring documents, and the shape of the answer.

Questions: query_id, query, embedding, filter (a material, a system's number, or null).
Documents: doc_id, doc_path, text, embedding. A question without documents that fit falls
back per question, as stated at each filter. Ties go by doc_path, then doc_id.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from maintspark.functions.text import BOOST_POINTS, document_mask, is_wiring_doc, mask_bits, question_mask

from .findings import has_any
from .ranking import best_documents, tag_bits
from .retrieval import document_id

#: Training materials with their names and the words of their documents.
MATERIALS = {
    "PRIMUS_EPIC": ("Primus Epic avionics system", ("primus", "epic", "avionics", "mfd", "pfd", "display unit", "cockpit display")),
    "PT6C_67CD": ("PT6C-67CD engine", ("pt6c", "67cd", "engine", "turbine", "compressor", "turboshaft", "n1", "n2", "t5", "itt")),
    "AW139_AIRFRAME": ("AW139 Airframe systems", ("airframe", "fuselage", "structure", "cabin", "tail boom", "landing gear", "skin")),
}
#: Words of questions by type.
FAULT = ("fail", "failure", "fault", "error", "malfunction", "inoperative", "not working", "caution", "warning", "advisory")
CALIBRATION = ("calibration", "calibrate", "adjust", "adjustment", "zero", "incorrect reading", "wrong reading", "on ground", "on the ground", "feet with", "feet on")
READING, READ_UNITS = ("showing", "reading", "displays"), ("feet", "ft", "knots", "kt", "psi", "degrees")
PROCEDURE = (
    "how to", "como", "step by step", "passo a passo", "procedure", "procedimento", "download", "uploading", "data downloading",
    "installation", "removal", "replace", "install", "remove", "configure", "configuration", "setup", "setting",
)
ELECTRICAL = ("electrical", "voltage", "power", "generator", "sensor", "electronic", "troubleshoot", "luz", "light", "ldg", "sistema", "continuity", "pin", "connector", "wiring", "fuel", "low")
NEEDS_WIRING = ("generator", "starter", "electrical", "wiring", "connector")


def query_type(query: Column) -> Column:
    q = F.lower(F.coalesce(query, F.lit("")))
    calibration = has_any(q, CALIBRATION) | (has_any(q, READING) & has_any(q, READ_UNITS))
    return F.when(has_any(q, FAULT), "fault_code").when(calibration, "calibration").when(has_any(q, PROCEDURE), "procedure").when(has_any(q, ELECTRICAL), "electrical").otherwise("general")


def enhance_query(query: Column, chosen: Column) -> Column:
    """The question behind the name of its material, or its system's number."""
    named = F.lit(None).cast("string")
    for key, (name, _) in MATERIALS.items():
        named = F.when(chosen == key, name).otherwise(named)
    return F.when(F.coalesce(chosen, F.lit("")) == "", query).otherwise(F.concat(F.coalesce(named, F.concat(F.lit("ATA "), chosen)), F.lit(": "), query))


#: Numbers of tags: the materials, then these two, then numbers of systems of one and of two digits.
FIRST_TEN, EVERY, ONE_DIGIT, TWO_DIGITS = len(MATERIALS), len(MATERIALS) + 1, len(MATERIALS) + 2, len(MATERIALS) + 12


def _number_tag(number: Column) -> Column:
    return number.cast("int") + F.when(F.length(number) == 1, ONE_DIGIT).otherwise(TWO_DIGITS)


def question_tags(chosen: Column) -> Column:
    """(tag, other) of a filter: a material falls back to the first ten documents, a system to all, and nothing or another word is all."""
    chosen = F.coalesce(chosen, F.lit(""))
    plain = F.replace(chosen, F.lit("-"), F.lit(""))
    digits = F.rlike(chosen, F.lit(r"^\d+$")) | ((F.length(chosen) == 2) & F.rlike(plain, F.lit(r"^\d+$")))
    tag = F.when(digits, _number_tag(F.substring(plain, 1, 2)))
    for i, name in enumerate(MATERIALS):
        tag = F.when(chosen == name, i).otherwise(tag)
    return F.struct(F.coalesce(tag, F.lit(EVERY)).alias("tag"), F.when(chosen.isin(*MATERIALS), FIRST_TEN).otherwise(EVERY).alias("other"))


def document_tags(low_text: Column, path: Column, is_first: Column) -> Column:
    """The tags of a document as an array of numbers, its text in small letters."""
    low_path = F.lower(path)
    of = [F.when(has_any(low_text, words) | has_any(low_path, words), i) for i, (_, words) in enumerate(MATERIALS.values())]
    numbers = F.transform(F.regexp_extract_all(path, F.lit(r"-(?=(\d{1,2})-)"), F.lit(1)), _number_tag)
    return F.array_distinct(F.concat(F.filter(F.array(*of, F.when(is_first, FIRST_TEN), F.lit(EVERY)), lambda t: t.isNotNull()), numbers))


def tagged_documents(corpus: DataFrame, least: int = 10) -> DataFrame:
    """The corpus with ``low`` (its text in small letters) and ``tag_list``. The first ten by path are found by paths alone."""
    ten = corpus.select("doc_path", F.col("doc_id").alias("_first")).orderBy("doc_path", "_first").limit(least).select("_first").distinct()
    known = corpus.join(F.broadcast(ten), F.col("doc_id") == F.col("_first"), "left").withColumn("low", F.lower(F.coalesce("text", F.lit(""))))
    return known.withColumn("tag_list", document_tags(F.col("low"), F.coalesce("doc_path", F.lit("")), F.col("_first").isNotNull())).drop("_first")


def allowed_documents(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id): all documents that the question's filter leaves."""
    tagged = tagged_documents(corpus).select("doc_id", F.explode("tag_list").alias("tag"))
    there = tagged.select("tag").distinct().withColumn("there", F.lit(True))
    asked = queries.select("query_id", question_tags(F.col("filter")).alias("t")).select("query_id", "t.tag", "t.other").join(there, "tag", "left")
    return asked.select("query_id", F.when(F.col("there"), F.col("tag")).otherwise(F.col("other")).alias("tag")).join(tagged, "tag").select("query_id", "doc_id")


def training_filter(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents with a word of the question's material in text or path; the first ten by path if there is none."""
    return allowed_documents(corpus, queries.where(F.col("filter").isin(*MATERIALS)))


def ata_path_filter(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents with ``-NN-`` in the path; all documents for a filter that isn't a number, or that none has."""
    return allowed_documents(corpus, queries.where(~F.coalesce(F.col("filter"), F.lit("")).isin(*MATERIALS)))


def filter_counts(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, n, ids (the sum of doc_id): how many documents a question's filter leaves. Documents are counted by tag before questions are joined."""
    counts = tagged_documents(corpus).select("doc_id", F.explode("tag_list").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
    asked = queries.select("query_id", question_tags(F.col("filter")).alias("t")).select("query_id", "t.tag", "t.other")
    other = counts.select(F.col("tag").alias("other"), F.col("n").alias("other_n"), F.col("ids").alias("other_ids"))
    both = asked.join(counts, "tag", "left").join(other, "other")
    return both.select("query_id", F.coalesce("n", "other_n").alias("n"), F.when(F.col("n").isNotNull(), F.col("ids")).otherwise(F.col("other_ids")).alias("ids"))


def boost_totals(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, n_rules, total: the rules whose conditions a question meets, and what keywords add over all documents. Documents are counted by rule before questions are joined."""
    bits = corpus.select(F.lower("text").alias("low")).select(F.explode(mask_bits(document_mask(F.col("low")))).alias("bit")).groupBy("bit").agg(F.count("*").alias("docs"))
    asked = queries.select("query_id", F.lower("query").alias("low")).select("query_id", F.explode_outer(mask_bits(question_mask(F.col("low")))).alias("bit"))
    hundredths = F.element_at(F.array(*(F.lit(round(p * 100)).cast("long") for p in BOOST_POINTS)), F.col("bit") + 1)
    total = F.coalesce(F.sum(hundredths * F.coalesce("docs", F.lit(0))), F.lit(0)) / 100
    return asked.join(bits, "bit", "left").groupBy("query_id").agg(F.count("bit").alias("n_rules"), total.alias("total"))


def inject_wiring(found: DataFrame) -> DataFrame:
    """Of ``best_documents``' rows with their question: the best ones and, for a question about wiring without a wiring diagram among them, the best diagram after them."""
    one = Window.partitionBy("query_id")
    has = F.coalesce(F.max(~F.col("extra") & F.col("flagged")).over(one), F.lit(False))
    last = F.coalesce(F.max(F.when(~F.col("extra"), F.col("rank"))).over(one), F.lit(0))
    asks = has_any(F.lower(F.col("query")), NEEDS_WIRING)
    marked = found.withColumns({"_has": has, "_last": last}).where(~F.col("extra") | (asks & ~F.col("_has")))
    return marked.withColumn("rank", F.when(F.col("extra"), F.col("_last") + 1).otherwise(F.col("rank"))).drop("_has", "_last", "extra")


def search(corpus: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The best k documents of each question with a score above 0, a wiring diagram where it is needed, and what is shown of them.

    The score is the cosine of the vectors and what keywords add, compared to 12 places. Each text is
    searched once for all words; documents and questions then meet in blocks (``ranking``).
    Texts are joined again for the few that are left.
    """
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    docs = tagged_documents(corpus).select(
        "doc_id", F.coalesce("doc_path", F.lit("")).alias("key"), vector, document_mask(F.col("low")).alias("rules"), tag_bits(F.col("tag_list")).alias("tags"), is_wiring_doc(F.col("doc_path"), F.col("text")).alias("flagged")
    )
    asked = queries.select("query_id", vector, question_mask(F.lower("query")).alias("rules"), question_tags(F.col("filter")).alias("t")).select("query_id", "embedding", "rules", "t.tag", "t.other")
    found = best_documents(docs, asked, k, BOOST_POINTS).join(queries.select("query_id", "query"), "query_id")
    shown = inject_wiring(found).join(corpus.select("doc_id", "doc_path", "text"), "doc_id")
    ident = document_id(F.col("doc_path"))
    return shown.select(
        "query_id", "rank", "doc_id", "doc_path", F.round("score", 4).alias("similarity_score"), ident.alias("document_id"),
        F.substring("text", 1, 4000).alias("content"), F.substring("text", 1, 1000).alias("snippet"), F.concat(F.lit("ATA "), ident, F.lit(": "), F.col("doc_path")).alias("reference"),
    )


def primary_id(found: DataFrame) -> DataFrame:
    """Per question the first document id in order of rank that isn't empty."""
    return found.where("document_id <> ''").groupBy("query_id").agg(F.min_by("document_id", "rank").alias("primary_id"))


@F.pandas_udf(DoubleType())
def relevance(query: pd.Series, text: pd.Series) -> pd.Series:
    """Likeness of two texts in small letters, 0 to 1, by matching blocks; for the few documents that were found, since it is slow."""
    return pd.Series([SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio() for a, b in zip(query, text, strict=True)])

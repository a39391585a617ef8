"""Solved problems: filters, counts and the search for similar cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that say nothing about a fault.
STOP_WORDS = tuple(
    "the with that this from have been will would could should which when where what about into there their they them then than also just only some such very"
    " after before during while show shows showing shown aircraft helicopter ground total display displayed indication".split()
)


def cleaned(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9 \t\n\x0B\f\r]", " ")


def keywords(text: Column, n: int = 8, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """The first n words of more than three letters that aren't stop words; repeats stay."""
    words = F.filter(F.split(cleaned(text), r"[ \t\n\x0B\f\r]+"), lambda w: (F.length(w) > 3) & ~w.isin(*stop_words) if stop_words else F.length(w) > 3)
    return F.slice(words, 1, n)


def issue_signature(ata: Column, problem: Column) -> Column:
    return F.concat(ata, F.lit(":"), F.substring(F.regexp_replace(F.lower(problem), "[^a-z0-9]", ""), 1, 50))


def status_counts(history: DataFrame) -> DataFrame:
    done = F.coalesce(F.col("solution_status") == "resolved", F.lit(False))
    return history.agg(F.count("*").alias("total"), F.count_if(done).alias("resolved"), F.count_if(~done).alias("pending"))


def recent(df: DataFrame, user_col: str, at_col: str, n: int = 20, id_col: str = "id") -> DataFrame:
    """Each user's last n rows, newest first."""
    order = Window.partitionBy(user_col).orderBy(F.desc(at_col), id_col)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def facet_filter(history: DataFrame, text: str | None = None, ata: str | None = None, status: str | None = None, aircraft: str | None = None, columns: tuple[str, ...] = ("problem",)) -> DataFrame:
    """Substring of any column, exact system, status (anything but resolved is pending), substring of the serial."""
    if text:
        any_of = F.lit(False)
        for c in columns:
            any_of = any_of | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
        history = history.where(any_of)
    if ata:
        history = history.where(F.col("ata") == ata)
    if status:
        done = F.coalesce(F.col("solution_status") == "resolved", F.lit(False))
        history = history.where(done if status == "resolved" else ~done)
    return history.where(F.contains(F.lower("aircraft_serial"), F.lit(aircraft.lower()))) if aircraft else history


def with_replacements(history: DataFrame, replacements: DataFrame) -> DataFrame:
    """Each row with the list of its replaced parts, empty if none. The parts are gathered before the join."""
    parts = replacements.groupBy(F.col("troubleshooting_id").alias("_tid")).agg(F.sort_array(F.collect_list(F.struct("id", "part_off_pn", "part_on_pn", "quantity"))).alias("replaced_parts"))
    joined = history.join(parts, F.col("id") == F.col("_tid"), "left").drop("_tid")
    return joined.withColumn("replaced_parts", F.coalesce("replaced_parts", F.array().cast("array<struct<id:bigint,part_off_pn:string,part_on_pn:string,quantity:int>>")))


def _words_within(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """token, word: each distinct word with the tokens that contain it, found by the word's first four letters."""
    starts = words.select("word").distinct().withColumn("gram", F.substring("word", 1, 4))
    places = F.sequence(F.lit(1), F.length("token") - 3)
    grams = tokens.select("token").distinct().select("token", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("token"), i, F.lit(4))))).alias("gram"))
    return grams.join(starts, "gram").where(F.contains("token", "word")).select("token", "word")


def similar_cases(problems: DataFrame, history: DataFrame, k: int = 3, least: int = 2, recent_limit: int | None = None, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """query_id, id, score, rank: the k resolved cases of the same system that contain most of a problem's keywords.

    A keyword counts as a substring, repeats twice; the same aircraft adds one. A problem
    without a system is compared with all. Ties: the latest resolved, then the smallest id.
    A keyword has no white space, so it lies within one token of a case: the vocabulary is
    matched with the keywords once. Of a problem's keywords, the commonest ones that alone
    can't reach ``least`` hits never make candidates: a case must contain a rarer one. Only
    for candidates the common ones are looked up. Equal rows of a case count once.
    """
    solved = history.where(F.col("solution_status") == "resolved")
    if recent_limit:
        solved = solved.orderBy(F.desc("resolved_seq"), "id").limit(recent_limit)
    case = F.struct("id", "ata", "aircraft_serial", "resolved_seq").alias("case")
    # what is left of a text once it is cleaned and split at white space; shorter ones hold no keyword
    said = F.array_distinct(F.split(F.lower(F.coalesce(F.col("problem"), F.lit(""))), "[^a-z0-9]+"))
    tokens = solved.select(case, F.explode(F.filter(said, lambda t: F.length(t) > 3)).alias("token"))
    asked = problems.select(F.struct("query_id", "serial_number").alias("question"), F.coalesce(F.concat(F.lit("="), "ata"), F.lit("*")).alias("place"), F.explode(keywords(F.col("problem"), stop_words=stop_words)).alias("word"))
    asked = asked.groupBy("question", "place", "word").agg(F.count("*").alias("times"))
    found = tokens.join(_words_within(tokens, asked), "token").select("case", "word").distinct()
    # a case is met at its own system and by problems without one
    placed = found.withColumn("place", F.explode(F.array_compact(F.array(F.concat(F.lit("="), "case.ata"), F.lit("*")))))
    common = placed.groupBy("word", "place").agg(F.count("*").alias("cases"))
    commonest = Window.partitionBy("question", "place").orderBy(F.desc("cases"), "word").rowsBetween(Window.unboundedPreceding, 0)
    ranked = asked.join(common, ["word", "place"]).withColumn("rare", F.sum("times").over(commonest) >= least).drop("cases")
    first = placed.join(ranked.where("rare"), ["word", "place"]).select("question", "case", "times")
    more = first.select("question", "case").distinct().join(ranked.where("not rare").select("question", "word", "times"), "question").join(found, ["case", "word"]).select("question", "case", "times")
    same = F.coalesce(F.col("question.serial_number") == F.col("case.aircraft_serial"), F.lit(False)).cast("int")
    scored = first.unionAll(more).groupBy("question", "case").agg(F.sum("times").alias("hits")).where(F.col("hits") >= least)
    scored = scored.select("question.query_id", "case.id", "case.resolved_seq", (F.col("hits") + same).cast("int").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("resolved_seq"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")

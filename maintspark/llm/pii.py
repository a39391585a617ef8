"""Personal data in texts, with built-in Spark expressions only.

Regular expressions propose spans; validators confirm them (octets of an address,
Luhn for cards, mod 97 for bank accounts, digit counts for phones); words shortly before
a span raise its score. A span is kept if its score reaches ``threshold``.

Null and empty texts have no spans. Every row is kept, repeated rows too; rows don't
depend on each other. Spans of a kind never overlap. Only doc_id and text are read.

The patterns are written so that Java's matcher runs over long texts in a loop: possessive
groups don't recurse, and a match may begin only where a run of its characters begins (or
where the last match ended), so a long run isn't tried from each of its characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in their order. The first four are the base; the method adds the others.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "card_group", "ssn")

#: The characters of an account number, by country.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK|FI|FK|FO|GL|NL|SD",
    19: "MK|SI",
    20: "AT|BA|EE|KZ|LT|LU|MN|XK",
    21: "CH|CR|HR|LI|LV",
    22: "BG|BH|DE|GB|GE|IE|ME|RS",
    23: "AE|GI|IL|IQ|OM|SO|TL",
    24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "AO|CV|GW|LY|MZ|PT|ST",
    26: "DZ|IR|IS|TR",
    27: "BI|CF|CG|CM|DJ|FR|GA|GQ|GR|IT|KM|MC|MG|MR|SM|TD",
    28: "AL|AZ|BF|BJ|BY|CI|CY|DO|GT|HN|HU|LB|MA|ML|NE|NI|PL|SN|SV|TG",
    29: "BR|EG|PS|QA|UA",
    30: "JO|KW|MU|YE",
    31: "MT|SC",
    33: "LC|RU",
}
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole chain of digits, of which the others can't pass
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # as long as its country's numbers are; countries without a known length up to the end of the run
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:"
    + "|".join(f"(?:{codes})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}+" for n, codes in IBAN_LENGTHS.items())
    + f"|(?!{'|'.join(IBAN_LENGTHS.values())})[A-Z]{{2}}[0-9]{{2}}(?:\\x20?[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])",
    # groups of four inside a chain that is too long, or fails as a whole
    "card_group": r"(?<![0-9])[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Words that raise a score when they stand in the 40 characters before a span.
CONTEXT = {
    "email": r"mail|contact|write|reach",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|visa|credit|payment|master",
    "phone": r"phone|\btel\b|call|mobile|fax",
    "iban": r"iban|account|bank|transfer",
    "card_group": r"card|visa|credit|payment|master",
    "ssn": r"ssn|social|security|insurance",
}
#: Score of a confirmed span without context, and what context adds.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "card_group": 0.6, "ssn": 0.3}
CONTEXT_BONUS = 0.3
SPAN = "array<struct<start:int,end:int,text:string,before:string>>"
#: Characters before a span in which context words count.
NEAR = 40
#: Matches that are added up together: an array that grows is copied at each step, so it stays short.
CHUNK = 256


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 0, F.substring(digits, n - i, F.lit(1)).cast("int")).otherwise(
            (2 * F.substring(digits, n - i, F.lit(1)).cast("int")).try_cast("int") - F.when(F.substring(digits, n - i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return (n > 0) & (total % 10 == 0)


def mod97(text: Column) -> Column:
    """Whether a bank account number leaves 1 when divided by 97 (its first four characters moved to the end)."""
    bare = F.replace(text, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(moved)),
        F.lit(0),
        lambda acc, i: F.when(
            F.substring(moved, i, F.lit(1)).between("0", "9"), (acc * 10 + F.ascii(F.substring(moved, i, F.lit(1))) - 48) % 97
        ).otherwise((acc * 100 + F.ascii(F.substring(moved, i, F.lit(1))) - 55) % 97),
    )
    return rest == 1


def _valid(kind: str, text: Column) -> Column:
    if kind in ("card", "card_group"):
        return luhn(_digits(text))
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda part: F.length(F.ltrim(part, F.lit("0"))).between(0, 3) & (F.coalesce(F.right(part, F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    return mod97(text) if kind == "iban" else F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind, each with the characters before it.

    The gaps between the matches give their places, in code points. They are added up in
    chunks, and the chunks' ends then shift what is in them, so the time grows with the text.
    """
    whole = F.zip_with(F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    none = F.array().cast(SPAN)

    def step(acc, piece):
        start = acc["at"] + F.length(piece["gap"])
        end = start + F.length(piece["hit"])
        before = F.right(F.concat(acc["near"], piece["gap"]), F.lit(NEAR))
        span = F.struct(start.alias("start"), end.alias("end"), piece["hit"].alias("text"), before.alias("before"))
        return F.struct(end.alias("at"), F.right(F.concat(before, piece["hit"]), F.lit(NEAR)).alias("near"), F.concat(acc["out"], F.array(span)).alias("out"))

    def chunk(pieces, first):
        # each match has a character at least, so NEAR pieces hold all that is near
        last = F.slice(pieces, F.greatest(first - NEAR, F.lit(0)) + 1, F.least(first, F.lit(NEAR)))
        near = F.right(F.array_join(F.transform(last, lambda p: F.concat(p["gap"], p["hit"])), ""), F.lit(NEAR))
        return F.aggregate(F.slice(pieces, first + 1, F.lit(CHUNK)), F.struct(F.lit(0).alias("at"), near.alias("near"), none.alias("out")), step)

    def placed(chunks):
        ends = F.aggregate(
            chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        )["out"]
        moved = lambda c, by: F.transform(c["out"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["text"].alias("text"), s["before"].alias("before")))
        return F.flatten(F.zip_with(chunks, ends, moved))

    # an array of one element names a value that is used twice
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    in_chunks = lambda pieces: F.transform(F.sequence(F.lit(0), F.greatest(F.size(pieces) - 1, F.lit(0)), F.lit(CHUNK)), lambda first: chunk(pieces, first))
    found = once(F.filter(whole, lambda p: p["hit"].isNotNull()), lambda pieces: once(in_chunks(pieces), placed))
    # a text without the character that every match has is left alone
    might = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.contains("."), "ssn": text.contains("-")}.get(kind, F.lit(True))
    return F.when(might, F.filter(found, lambda s: _valid(kind, s["text"]))).otherwise(none)


def find_pii(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds ``base`` and ``pii``: arrays of (kind, start, end, text, score), by kind and start.

    ``base`` has the spans of the four base kinds, of any score; ``pii`` has those and the
    added kinds' spans that reach the threshold. A card in a group of four digits counts
    only where no base card covers it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = docs.withColumns({f"_{kind}": _spans(text, kind) for kind in (*BASE, *ADDED)})

    def scored(kind: str) -> Column:
        return F.transform(
            f"_{kind}",
            lambda s: F.struct(
                F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"),
                F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(F.lower(s["before"]).rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)).alias("score"),
            ),
        )

    clear = F.filter("_card_group", lambda s: ~F.exists("_card", lambda c: (c["start"] < s["end"]) & (s["start"] < c["end"])))
    raw = raw.withColumn("_card_group", clear)
    out = raw.withColumns({"base": F.concat(*map(scored, BASE)), "_more": F.filter(F.concat(*map(scored, ADDED)), lambda s: s["score"] >= threshold)})
    out = out.withColumn("pii", F.concat("base", "_more"))
    return out.drop("_more", *(f"_{kind}" for kind in (*BASE, *ADDED)))


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents with each span that reaches the threshold replaced by <KIND>; overlapping spans become one."""
    found = find_pii(docs, text_col, threshold)
    hits = F.array_sort(F.filter("pii", lambda s: s["score"] >= threshold), lambda a, b: a["start"] - b["start"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        hits, zero,
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"))),
    )
    rest = F.substring(text, done["at"] + 1, F.length(text))
    return found.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.concat(done["out"], rest))).drop("base", "pii")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(docs: DataFrame) -> DataFrame:
    found = find_pii(docs.select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))

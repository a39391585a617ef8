"""Audit of how far sources of one language differ in their words, by hash-consed segment trees over term ids.

Terms are counted per (language, source). The kept terms of a language get ids: a block by
hash, and a place in the block by falling count. A block is a subtree of each group's segment
tree over these ids. Within it, nodes are hash-consed: a leaf is its count, an inner node the
pair of its children, and equal subtrees of all groups and places are one node. Two groups
are compared by walking both trees at once; each distinct pair of nodes is priced once, from
the leaves up, and the prices of a block's roots are added up over the blocks.

Shares are integers: p = 1 + floor(scale * (count + 1) / (N + V)), and a term's price is
floor((p - q)**2 / q). Null text, language or source counts as ''. Repeated rows count as so
many documents; ids aren't read. Groups without terms are kept: their counts are 0. Ties go by
the UTF-8 bytes of the item. Empty tables give empty results; other columns aren't read.

Tokens are counted in the tasks that read the texts, with a bounded number of counts in
memory. Groups are dealt to tiles of sources, so a task of the comparison holds one block of
terms for two tiles, whatever the number of sources.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, slices

SCALE = 1_000_000_000
#: Term ids of a block, about, and sources of a tile, about.
BLOCK, TILE = 4096, 64
#: Counts that a task holds before it hands them on.
HELD = 600_000
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: Letters in lower case and bytes above 127 stay; all else is a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded size; a term is never cut."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + PIECE)
        end = gap.start() if gap else len(text)
        yield text[start:end].translate(_LETTERS).split()
        start = end


#: A document in a count: occurrences below, documents above.
_DOC = 1 << 40


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text (binary) to lang, source, term, n, docs; a null term for each group."""
    names = ["lang", "source", "term", "n", "docs"]

    def out(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in groups.items():
            counts = np.fromiter(terms.values(), np.int64, len(terms))
            rest = [pa.array(list(terms), pa.binary()), pa.array(counts % _DOC), pa.array(counts // _DOC)]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(counts)), pa.repeat(pa.scalar(source), len(counts)), *rest], names)
        if groups:
            langs, sources = (pa.array(c, pa.string()) for c in zip(*groups, strict=True))
            zeros = pa.array(np.zeros(len(groups), np.int64))
            yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(groups), pa.binary()), zeros, zeros], names)

    groups: dict = {}
    held = 0
    for whole in batches:
        for batch in slices(whole):
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                terms = groups.setdefault((lang, source), {})
                counts: Counter = Counter()
                for words in words_of(text):
                    counts.update(words)
                before, known = len(terms), terms.get
                for t, n in counts.items():
                    terms[t] = known(t, 0) + n + _DOC
                held += len(terms) - before
                if held > HELD:
                    yield from out(groups)
                    groups, held = {}, 0
    yield from out(groups)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs of every group; a row with a null term for each group."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    found = rows.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, divisor: Column) -> Column:
    """1 + floor(scale * (count + 1) / divisor), exact."""
    return F.call_function("div", (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), divisor.cast("decimal(19,0)")) + 1


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _shares(counts: np.ndarray, divisor: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / divisor) by long division in thousands: exact for divisors below 2**53."""
    whole, rest = np.divmod(counts + 1, divisor)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, divisor)
        whole = whole * 1000 + digit
    return whole + 1


class Forest:
    """Hash-consed segment trees of several groups over the same ids.

    ``counts`` has a row per group and a column per id. ``leaves`` are the distinct counts (-1
    for ids past the last one). ``children`` has for each level, from the leaves up, the left
    and right child of each distinct node; ``roots`` the node of each group.
    """

    def __init__(self, counts: np.ndarray):
        size = 1 << max(0, counts.shape[1] - 1).bit_length()
        padded = np.full((len(counts), size), -1, np.int64)
        padded[:, : counts.shape[1]] = counts
        self.leaves, nodes = np.unique(padded, return_inverse=True)
        nodes = nodes.reshape(padded.shape)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        most = len(self.leaves)
        while nodes.shape[1] > 1:
            pairs, code = np.unique(nodes[:, ::2] * most + nodes[:, 1::2], return_inverse=True)
            self.children.append((pairs // most, pairs % most))
            nodes, most = code.reshape(len(counts), -1), len(pairs)
        self.roots = nodes[:, 0]

    def compare(self, a: int, divisor: int, others: np.ndarray, divisors: list[int]) -> np.ndarray:
        """Sum over all ids of floor((p - q)**2 / q), p the share of group ``a``, q that of each of the others."""
        which = np.arange(len(others))
        mine, theirs = np.full(len(others), self.roots[a]), self.roots[others]
        steps = []
        for left, right in reversed(self.children):
            half = len(which)
            which, mine, theirs = np.concatenate([which, which]), np.concatenate([left[mine], right[mine]]), np.concatenate([left[theirs], right[theirs]])
            most = int(max(mine.max(), theirs.max())) + 1
            # an equal pair of nodes of the same two groups is one pair from here on
            keys, code = np.unique((which * most + mine) * most + theirs, return_inverse=True)
            which, mine, theirs = keys // (most * most), keys // most % most, keys % most
            steps.append((code[:half], code[half:]))
        p = _shares(np.maximum(self.leaves, 0), divisor)[mine]
        q = np.empty_like(p)
        for i, d in enumerate(divisors):
            at = which == i
            q[at] = _shares(np.maximum(self.leaves[theirs[at]], 0), d)
        prices = np.where(self.leaves[mine] < 0, 0, (p - q) ** 2 // q)
        for left, right in reversed(steps):
            prices = prices[left] + prices[right]
        return prices


def _compared(key: tuple, terms: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """A block of terms for two tiles of sources: lang, source, item, value for each ordered pair of them."""
    lang, _, first, second = key
    groups = groups.sort_values("source").reset_index(drop=True)
    at = {s: i for i, s in enumerate(groups["source"])}
    # ids by falling count
    ids = terms.groupby("term", sort=True)["total"].first().sort_values(ascending=False, kind="stable")
    place = {t: i for i, t in enumerate(ids.index)}
    # terms of the block that none of these sources has come last
    width = int(groups["width"].iloc[0])
    counts = np.zeros((len(groups), width), np.int64)
    if len(ids):
        counts[terms["source"].map(at).to_numpy(), terms["term"].map(place).to_numpy()] = terms["n"].to_numpy()
    forest = Forest(counts)
    tiles, divisors, sources = groups["tile"].to_numpy(), groups["divisor"].tolist(), groups["source"].tolist()
    out: dict = {"source": [], "item": [], "value": []}
    for a in range(len(groups)):
        others = np.flatnonzero(tiles == (second if tiles[a] == first else first))
        others = others[others != a]
        if len(others):
            values = forest.compare(a, divisors[a], others, [divisors[i] for i in others]) if width else np.zeros(len(others), np.int64)
            out["source"] += [sources[a]] * len(others)
            out["item"] += [sources[i] for i in others]
            out["value"] += values.tolist()
    return pd.DataFrame({"lang": [lang] * len(out["item"]), **out}, dtype=object).astype({"value": "int64"})


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows for all other sources, ``term`` rows up to ``top``."""
    counts = saved(term_counts(docs), "term-counts")
    term = Window.partitionBy("lang", "term")
    seen = counts.where("term is not null").withColumns({"docs": F.sum("docs").over(term), "total": F.sum("n").over(term), "lead": F.col("source") == F.min("source").over(term)})
    kept = saved(seen.where(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "total", "lead"), "kept-terms")

    # one row a language, one a group
    sizes = kept.groupBy("lang").agg(F.count_if("lead").alias("v"), F.sum("n").alias("whole"))
    named = counts.where("term is null").select("lang", "source")
    groups = named.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("size")), ["lang", "source"], "left").join(sizes, "lang", "left")
    v = F.coalesce("v", F.lit(0))
    groups = groups.select("lang", "source", v.alias("v"), (F.coalesce("size", F.lit(0)) + v).alias("divisor"), (F.coalesce("whole", F.lit(0)) + v).alias("lang_divisor"))
    tiles = F.ceil(F.count("*").over(Window.partitionBy("lang")) / tile)
    groups = groups.withColumns({"tiles": tiles, "blocks": F.greatest(F.lit(1), F.ceil(F.col("v") / block))})
    groups = saved(groups.withColumn("tile", F.pmod(F.xxhash64("source"), "tiles")), "groups")

    rows = kept.join(groups, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
    widths = rows.where("lead").groupBy("lang", "block").agg(F.count("*").alias("width"))
    # a tile meets every tile of its language once
    meets = lambda df: df.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumns({"first": F.least("tile", "with"), "second": F.greatest("tile", "with")})
    keys = ("lang", "block", "first", "second")
    terms = meets(rows.select("lang", "source", "term", "n", "total", "tile", "tiles", "block")).select(*keys, "source", "term", "n", "total")
    blocks = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(widths, ["lang", "block"], "left")
    present = meets(blocks).select(*keys, "source", "divisor", "tile", F.coalesce("width", F.lit(0)).alias("width"))
    values = terms.groupBy(*keys).cogroup(present.groupBy(*keys)).applyInPandas(_compared, "lang string, source string, item string, value long")
    pairs = values.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    p, q = share(F.col("n"), F.col("divisor")), share(F.col("total"), F.col("lang_divisor"))
    words = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", price(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pair_rows = pairs.withColumn("rank", rank)
    term_rows = words.withColumn("rank", rank).where(F.col("rank") <= top)
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shape(pair_rows, "pair").unionByName(shape(term_rows, "term"))


def op12_divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    return audit(docs)


#: The same rows by joining all kept terms of all pairs of groups.
ORACLE = f"""with d as (select row_number() over () as id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
k as (select lang, term, count(*) as total from w group by lang, term having count(distinct id) >= 3),
g as (select distinct lang, source from d),
c as (select w.lang, w.source, w.term, count(*) as n from w join k using (lang, term) group by all),
v as (select l.lang, count(term) as v, coalesce(sum(total), 0) as whole from (select distinct lang from g) l left join k on k.lang = l.lang group by l.lang),
s as (select g.lang, g.source, v.v, coalesce(sum(n), 0) + v.v as divisor, whole + v.v as lang_divisor from g join v using (lang) left join c on c.lang = g.lang and c.source = g.source group by g.lang, g.source, v.v, whole),
f as (select s.lang, s.source, k.term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 1)) // divisor::hugeint as p, 1 + (1000000000::hugeint * (total + 1)) // lang_divisor::hugeint as q from s join k on k.lang = s.lang left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
pair as (select a.lang, a.source, b.source as item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::bigint as value from s a join s b on a.lang = b.lang and a.source <> b.source left join f x on x.lang = a.lang and x.source = a.source left join f y on y.lang = b.lang and y.source = b.source and y.term = x.term group by a.lang, a.source, b.source),
term as (select lang, source, term as item, (((p - q) * (p - q)) // q)::bigint as value from f where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pair
union all select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from term) where rank <= 200"""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from maintspark.llm import divergence as D

from .cases import clashing, empty, hard

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, least_docs=3, top=200):
    """docs: (text, lang, source). The definition, with Python's integers."""
    counts, docs_with, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        words = Counter(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text))
        counts[lang, source].update(words)
        docs_with[lang].update(words.keys())
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs_with[lang].items() if n >= least_docs]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for a in sources:
            pair = [(sum(f(p[a][t], p[b][t]) for t in kept), b) for b in sources if b != a]
            term = [(f(p[a][t], q[t]), t) for t in kept if counts[lang, a][t] and p[a][t] > q[t]]
            for part, rows, most in (("pair", pair, None), ("term", term, top)):
                rows = sorted(rows, key=lambda r: (-r[0], r[1].encode()))[:most]
                out |= {(lang, a, part, item, value, i + 1) for i, (value, item) in enumerate(rows)}
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_equals_the_definition(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r["text"], r["lang"], r["source"]) for r in docs.collect()])
    assert rows_of(D.op12_divergence(docs.repartition(3))) == want
    # several blocks and tiles
    assert rows_of(D.audit(docs, block=3000, tile=8)) == want


def test_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(D.ORACLE)
    names = [c[0] for c in want.description]
    got = D.op12_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert names == got.columns
    assert rows_of(got) == set(want.fetchall())


def test_nulls_ties_repeats_and_groups_without_terms(spark):
    rows = [
        ("a b B c É é", None, None), ("a b", "", ""), ("a ſ K K", None, "s"), ("A ſ", "", "t"), ("ſ a 1 2-b", "", "t"), (None, "", "u"), ("", "xx", "lone"), (None, "xx", "other"),
        ("w " * 5, "yy", "one"), ("w", "yy", "one"), ("w", "yy", "one"), ("z", "zz", "z"), ("z", "zz", "z"), ("z", "zz", "z"), ("z", "zz", "y"),
    ]
    rows += rows[:3]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    assert rows_of(D.op12_divergence(docs)) == brute(rows)


def test_hard_texts_empty_tables_and_clashing_names(spark):
    docs = clashing(hard(spark, ["deadbeef word two"] * 3))
    want = brute([(r["text"], r["lang"], r["source"]) for r in docs.collect()])
    assert rows_of(D.op12_divergence(docs)) == want
    assert D.op12_divergence(empty(spark)).count() == 0


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_words_of_long_texts(monkeypatch, piece):
    monkeypatch.setattr(D, "PIECE", piece)
    text = "Ab cd--ÉÉ é " * 20 + "x" * 50 + " end"
    assert [w for part in D.words_of(text.encode()) for w in part] == [re.sub("[A-Z]", lambda m: m[0].lower(), w).encode() for w in TERM.findall(text)]


def test_shares_are_exact():
    for count in (0, 1, 999, 10**12, 2**50):
        for divisor in (1, 7, 10**9 + 7, 2**52 + 1):
            if count < divisor or count < 10**9:
                assert D._shares(np.array([count]), divisor)[0] == 1 + 10**9 * (count + 1) // divisor


def test_equal_subtrees_are_one_node():
    forest = D.Forest(np.array([[1, 0, 1, 0, 1, 0, 1, 0], [1, 0, 1, 0, 0, 0, 0, 0]]))
    assert [len(left) for left, _ in forest.children] == [2, 2, 2]
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (4, 37))
    forest = D.Forest(counts)
    sizes = [int(c.sum()) + 37 for c in counts]
    p = [[1 + 10**9 * (int(v) + 1) // d for v in c] for c, d in zip(counts, sizes, strict=True)]
    got = forest.compare(2, sizes[2], np.array([0, 1, 3]), [sizes[i] for i in (0, 1, 3)])
    assert got.tolist() == [sum((a - b) ** 2 // b for a, b in zip(p[2], p[i], strict=True)) for i in (0, 1, 3)]

import numpy as np
import pytest

from maintspark.llm.common import read
from maintspark.llm.decontaminate import GRAM, Index, _grams, drop_contaminated, find_matches, op8_decontamination, words

from .cases import HARD, SCHEMA, clashing, empty, hard


def brute(docs, items, overlap=0.5):
    """Documents and items of which most word triples are shared, without any index."""
    index = Index(items)
    found = set()
    for d, t in docs:
        w = words(t)
        g, short = _grams(w), {b" ".join(w[j : j + k]) for k in (1, 2) for j in range(len(w) - k + 1)}
        for k, (q, a, n) in enumerate(index.parts):
            have = g if n >= GRAM else short
            if len(q & have) / len(q) >= overlap and len(a & have) / len(a) >= overlap:
                found.add((d, index.ids[k]))
    return found


def test_wand_finds_all_above():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(2, 12)))) for i in range(90)]
    index = Index(items)
    for _ in range(60):
        terms = sorted(set(rng.integers(0, len(index.postings), rng.integers(1, 25)).tolist()))
        for threshold in (0.2, 0.5, 0.9):
            scores = np.zeros(index.n)
            for t in terms:
                for k, x in zip(index.postings[t], index.impacts[t]):
                    scores[k] += x
            assert [k for k, _ in index.wand(terms, threshold)] == np.flatnonzero(scores >= threshold - 1e-9).tolist()


def test_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs, items = read(spark, d, "documents"), read(spark, d, "benchmark")
    got = [(r.doc_id, r.item_id) for r in op8_decontamination(docs, items).collect()]
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    sliced = {(r.doc_id, r.item_id) for r in find_matches(docs, items, slice_chars=2000).collect()}
    assert sliced == want
    kept = drop_contaminated(clashing(docs), items, slice_chars=3000)
    assert kept.columns == clashing(docs).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {a for a, _ in want}


def test_hard_rows(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "What is it? It is a thing of note."), (4, "What is it? It is a thing of note."), (5, "word word word word")], "item_id long, text string")
    docs = hard(spark, ["x " * 500 + "what is it it is a thing OF note!" + " y" * 900, "what is it", "it is a thing of note"])
    got = sorted((r.doc_id, r.item_id) for r in find_matches(docs, items).collect())
    n = len(HARD)
    assert (n, 4) in got and got.count((n, 4)) == 2 and (n + 1, 4) not in got and (n + 2, 4) not in got
    assert (16, 5) in got and (3, 3) in got
    assert find_matches(empty(spark), items).collect() == []
    assert find_matches(docs, items.where("false")).collect() == []
    assert drop_contaminated(docs, items.where("false")).count() == docs.count()


def test_slices_change_nothing(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(80)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(4, 30))) for _ in range(60)] + [" ".join(rng.choice(vocabulary, 300))]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    cut = [t.split()[: len(t.split()) * rng.integers(4, 9) // 10] for t in texts]
    docs = spark.createDataFrame([(i, " ".join(["aside"] * 5 + w + ["beside"] * 9)) for i, w in enumerate(cut)], "doc_id long, text string")
    rows = lambda n: sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in find_matches(docs, items, slice_chars=n).collect())
    whole = rows(10**6)
    assert 10 < len(whole) and rows(1000) == whole and rows(300) == whole


def test_overlap_is_counted_in_one_passage():
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    w = item.split()
    index = Index([(1, item), (2, "one two three four")])
    words_only = " ".join(w[::2] + w[1::2])  # each word, no triple
    pieces = " ".join(" ".join(w[i : i + 4]) + " filler" * 60 for i in range(0, 12, 2))
    assert index.search([words_only + " filler" * 60 + " " + pieces, "filler " * 60 + item], 0.5, 0.5)[0] == []
    assert [x[0] for x in index.search(["filler " * 60 + item + " filler" * 60], 0.5, 0.5)[0]] == [0]

import random
import re

import pytest

from maintspark.llm.common import read
from maintspark.llm.jaccard_join import boundary, keep_one, link_groups, op6_jaccard_join

from .cases import HARD, SCHEMA, clashing, empty, hard


def brute(docs, size=4, percent=85):
    sets = {}
    for d, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        n = min(size, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    of = {}
    for d, s in sets.items():
        for x in s:
            of.setdefault(x, []).append(d)
    for a in sorted(sets):
        near = {b for x in sets[a] for b in of[x] if b < a}
        for b in near:
            i = len(sets[a] & sets[b])
            if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {(d, len(s), find(d)) for d, s in sets.items()}


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_brute_force(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    assert rows(op6_jaccard_join(clashing(docs))) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("size,percent", [(4, 85), (2, 80)])
def test_short_and_edited_texts(spark, size, percent):
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 9)) for _ in range(rng.choice([3, 6, 9, 14, 18, 25, 60, 90]))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["zz"], [w[k], "yy"]])
            texts.append(" ".join(w))
    docs = hard(spark, texts)
    got = rows(link_groups(docs, size, percent).select("doc_id", "n_shingles", "component_id"))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], size, percent)


def test_keep_one_and_empty(spark):
    docs = clashing(hard(spark, ["same words in here too"] * 3))
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 2
    assert op6_jaccard_join(empty(spark)).collect() == [] and keep_one(empty(spark)).collect() == []
    assert op6_jaccard_join(hard(spark).union(hard(spark))).count() == len(HARD)


def test_strangers_in_one_list_and_many_copies(spark):
    """Texts that share a phrase and nothing else; all pairs of a few lines, which are split by the next shingle; copies of one text with an edit each."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    phrase = " ".join(word() for _ in range(30))
    lines = [" ".join(word() for _ in range(12)) for _ in range(9)]
    base = [word() for _ in range(200)]
    texts = [f"{phrase} {word()} {word()} {word()}" for _ in range(60)]
    texts += [" ".join(rng.sample(lines, 6)) for _ in range(150)]
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    docs = hard(spark, texts)
    assert rows(op6_jaccard_join(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr("maintspark.llm.jaccard_join.FEW", 0)
    monkeypatch.setattr("maintspark.llm.jaccard_join._ranked", lambda s, common: (s, 0))  # any order of shingles, any head
    test_short_and_edited_texts(spark, 2, 80)


def test_ids_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(2, a), (1, a + " x"), (2, b), (3, b + " y"), (3, b + " y"), (None, "q")], "doc_id long, text string")
    assert rows(op6_jaccard_join(docs)) == {(2, 27, 1), (1, 28, 1), (2, 27, 2), (3, 28, 2), (-1, 1, -1)}
    assert sorted((r.doc_id or -1, r.text) for r in keep_one(docs).collect()) == sorted([(1, a + " x"), (2, b), (-1, "q")])


def test_boundary_follows_cost():
    assert boundary([(5, 10), (12, 10), (40, 10)], 85) >= 12 and boundary([(60, 10)], 85) == 0

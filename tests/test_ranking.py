import numpy as np
from pyspark.sql import functions as F

from maintspark.functions.text import BOOST_POINTS, keyword_boost
from maintspark.operators import manuals, ranking

DOCS = "doc_id long, key string, embedding array<double>, rules long, tag_list array<int>, flagged boolean"
QUESTIONS = "query_id long, embedding array<double>, rules long, tag int, other int"


def brute(docs, questions, k, points):
    def cosine(a, b):
        a, b = (np.nan_to_num(np.array(v or [], float)) for v in (a, b))
        n = min(len(a), len(b))
        norm = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a[:n] @ b[:n]) / norm if norm else 0.0

    out = set()
    for qid, v, rules, tag, other in questions:
        ok = [d for d in docs if tag in d[4]] or [d for d in docs if other in d[4]]
        scored = [(round(cosine(d[2], v) + sum(p for i, p in enumerate(points) if d[3] & rules & 1 << i), 12), d) for d in ok]
        scored.sort(key=lambda x: (-x[0], x[1][1], x[1][0]))
        out |= {(qid, i + 1, d[0], False) for i, (s, d) in enumerate([x for x in scored if x[0] > 0][:k])}
        out |= {(qid, 1, d[0], True) for _, d in [x for x in scored if x[1][5]][:1]}
    return out


def test_blocks_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [rng.integers(-2, 3, 4).astype(float).tolist() for _ in range(9)] + [None, [], [0.0] * 4, [1.0, None, 2.0]]
    docs = [(i, f"k{i % 5}", vectors[int(rng.integers(len(vectors)))], int(rng.integers(8)), sorted({int(t) for t in rng.choice([0, 1, 62, 63, 64, 125], 2)}), bool(i % 7 == 0)) for i in range(90)]
    questions = [(i, vectors[int(rng.integers(len(vectors)))], int(rng.integers(8)), int(rng.choice([0, 1, 62, 63, 64, 125, 7])), int(rng.choice([0, 63, 9]))) for i in range(40)]
    points = (0.5, -0.25, 0.125)
    monkeypatch.setattr(ranking, "DOCS", 16)
    monkeypatch.setattr(ranking, "QUESTIONS", 11)
    df = spark.createDataFrame(docs, DOCS).withColumn("tags", ranking.tag_bits(F.col("tag_list"))).repartition(3)
    found = ranking.best_documents(df, spark.createDataFrame(questions, QUESTIONS), 3, points)
    assert {(r["query_id"], r["rank"], r["doc_id"], r["extra"]) for r in found.collect()} == brute(docs, questions, 3, points)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoop" not in plan


def test_empty_sides(spark):
    docs, asked = spark.createDataFrame([], DOCS).withColumn("tags", ranking.tag_bits(F.col("tag_list"))), spark.createDataFrame([(1, [1.0], 0, 0, 0)], QUESTIONS)
    assert ranking.best_documents(docs, asked, 3).count() == 0
    one = spark.createDataFrame([(1, "k", [1.0], 0, [0], False)], DOCS).withColumn("tags", ranking.tag_bits(F.col("tag_list")))
    assert ranking.best_documents(one, asked.limit(0), 3).count() == 0
    assert [(r["doc_id"], r["score"]) for r in ranking.best_documents(one, asked, 3).collect()] == [(1, 1.0)]


def test_boosts_by_masks(spark):
    pairs = [
        ("Engine will not start", "it does not start: fault isolation, crank", 0.15 + 0.10), ("hot start", "Gen Hot, fault isolation", 0.10), ("starter fault", "gen hot wiring data", -0.12 + 0.08 + 0.06),
        ("pin of the connector", "AWDP", 0.12), ("wont START", "start cycle engine start starter generator", 0.12 + 0.10 + 0.08), (None, "start", 0.0), ("start", None, 0.0), ("", "", 0.0),
    ]
    df = spark.createDataFrame(pairs, "q string, d string, want double").select(keyword_boost(F.col("q"), F.col("d")).alias("got"), "want")
    assert [round(r["got"], 9) for r in df.collect()] == [round(w, 9) for *_, w in pairs]
    assert len(BOOST_POINTS) == 12


def test_wiring_is_added_even_where_nothing_scores(spark):
    corpus = spark.createDataFrame([(1, "a-24-1.xml", [1.0, 0.0], "plain"), (2, "b-39-a-awdp-24-.xml", [-1.0, 0.0], "diagram"), (3, "c-24-2.xml", [-1.0, 0.0], "plain")], "doc_id long, doc_path string, embedding array<float>, text string")
    asked = spark.createDataFrame([(1, "starter", [1.0, 0.0], "24"), (2, "starter", [0.0, 1.0], "24"), (3, "seal", [1.0, 0.0], "24"), (4, "starter", [1.0, 0.0], "77"), (5, None, [1.0, 0.0], None)], "query_id long, query string, embedding array<float>, filter string")
    got = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in manuals.search(corpus, asked).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (3, 1, 1), (4, 1, 1), (4, 2, 2), (5, 1, 1)]

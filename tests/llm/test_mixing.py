import numpy as np

from maintspark.llm.common import read
from maintspark.llm.mixing import TOPICS, UNIT, calibrate, cell_weights, fit_topics, kmeans, mix, op10_mixing, rake, topic_of, vectors, word_counts

from .cases import HARD, clashing, empty, hard


def test_rake_reaches_the_margins():
    rng = np.random.default_rng(2)
    codes = [rng.integers(0, k, 400) for k in (7, 4, 5)]
    counts = rng.integers(1, 1000, 400).astype(float)
    targets = [rng.dirichlet(np.ones(k) * 5) for k in (7, 4, 5)]
    fitted = rake(counts, codes, targets)
    for code, target in zip(codes, targets):
        assert np.allclose(np.bincount(code, fitted, len(target)), target, atol=1e-6)


def test_calibrated_to_the_budget():
    rng = np.random.default_rng(4)
    n, w = rng.integers(1, 100, 50).astype(float), rng.exponential(1, 50)
    for share in (0.1, 0.5, 0.9, 1.0):
        p = calibrate(n, w, share * n.sum())
        assert abs((n * p).sum() - share * n.sum()) < 1e-6 and (p <= 1).all() and (p >= 0).all()


def test_query(spark):
    docs = read(spark, "/root/testdata/sf0.1", "documents")
    rows = op10_mixing(spark, docs).toPandas()
    assert len(rows) == docs.count() and rows.doc_id.is_unique
    texts = {r.doc_id: r.text for r in docs.limit(300).collect()}
    by = rows.set_index("doc_id")
    assert all(by.n_tokens[i] == len(t.split()) for i, t in texts.items() if t.isascii())
    expected = (rows.n_tokens * rows.probability).sum()
    assert abs(expected / rows.n_tokens.sum() - 0.5) < 1e-3
    kept = rows[rows.kept].n_tokens.sum() / rows.n_tokens.sum()
    assert abs(kept - 0.5) < 0.03
    # weights bring the shares of sources to their targets: equal here but for the power
    share = (rows.n_tokens * rows.weight).groupby(rows.source).sum() / rows.n_tokens.sum()
    want = rows.groupby("source").n_tokens.sum() ** 0.5
    assert np.allclose(share, want / want.sum(), atol=1e-5)


def test_mix_keeps_columns_and_agrees(spark):
    docs = clashing(read(spark, "/root/testdata/sf0.01", "documents"))
    kept = mix(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in op10_mixing(spark, docs).where("kept").collect()}
    only = mix(docs, targets={"lang": {"en": 1.0}}, keep=0.2)
    assert {r.lang for r in only.collect()} == {"en"}


def test_hard_rows(spark):
    docs = hard(spark).selectExpr("doc_id", "text", "if(doc_id % 5 = 0, null, lang) lang", "if(doc_id % 3 = 0, null, source) source", "n_chars")
    assert op10_mixing(spark, docs.union(docs)).count() == 2 * len(HARD)
    assert op10_mixing(spark, empty(spark)).collect() == [] and mix(empty(spark)).collect() == []
    assert mix(docs, keep=1.0).count() >= 1


def test_raked_by_spark_as_on_the_driver(spark):
    rng = np.random.default_rng(8)
    rows = [(f"s{rng.integers(6)}", f"l{j % 3}", f"l{j % 3}/{rng.integers(3)}", int(rng.integers(1, 500))) for j in range(300)] + [("none", "l0", "l0/0", 0)]
    cells = spark.createDataFrame(rows, "_source string, _lang string, _topic string, _tokens long")
    for nested, targets in ((True, {"source": {f"s{i}": 1.0 + i for i in range(6)}}),):
        a, b = ({(r[0], r[1], r[2]): (r.weight, r.probability) for r in cell_weights(cells, targets, 0.4, nested=nested, max_cells=m).collect()} for m in (1000, 0))
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-6) for k in a)


def test_query_equals_brute_force(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    rows = op10_mixing(spark, docs).toPandas().set_index("doc_id").sort_index()
    total = rows.n_tokens.sum()
    share = rows.groupby(["source", "lang", "topic"]).n_tokens.sum() / total
    fit = share.copy()
    goal = {m: (g := share.groupby(m).sum() ** 0.5) / g.sum() for m in ("source", "lang")}
    part = share.groupby(["lang", "topic"]).sum() ** 0.5
    goal["topic"] = (part / part.groupby("lang").transform("sum") * goal["lang"].reindex(part.index.get_level_values("lang")).to_numpy()).droplevel("lang")
    for _ in range(2000):
        for m, want in goal.items():
            fit = fit * (want / fit.groupby(m).sum()).reindex(fit.index.get_level_values(m)).to_numpy()
    weight = (fit / fit.sum() / share).reindex(rows.set_index(["source", "lang", "topic"]).index).to_numpy()
    assert np.allclose(weight, rows.weight, atol=1e-4, rtol=1e-4)
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (rows.n_tokens * np.minimum(1, mid * weight)).sum() < 0.5 * total else (low, mid)
    assert np.allclose(np.minimum(1, low * weight), rows.probability, atol=1e-3)


def test_topics_follow_words(spark):
    themes = ["engine oil pump blade", "wing flap slat rudder", "cabin seat light door", "radio antenna pilot mic"]
    rows = [(i, " ".join(np.random.default_rng(i).choice(themes[i % 4].split(), 40)), "en") for i in range(200)] + [(900, None, "en"), (901, "", None), (902, "wing", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_topics(docs)
    got = {r.doc_id: r.t for r in docs.repartition(7).select("doc_id", topic_of(docs.text, docs.lang, model).alias("t")).collect()}
    assert len({(i % 4, got[i]) for i in range(200)}) == 4 == TOPICS
    assert got[901] == "/0" and got[902] == "xx/0" and got[900].startswith("en/")
    again = fit_topics(docs.repartition(3))
    assert all(np.allclose(again[k][1], model[k][1]) for k in model)
    assert fit_topics(docs.limit(0)) == {} and len(kmeans(np.ones((5, 1)), 3)) == 1


def test_topics_are_fitted_on_all_rows(spark):
    themes = ["engine oil pump blade", "wing flap slat rudder", "cabin seat light door", "radio antenna pilot mic"]
    rare = spark.createDataFrame([(i, " ".join(np.random.default_rng(i).choice(themes[i % 4].split(), 40)), "zz") for i in range(60)], "doc_id long, text string, lang string")
    docs = rare.union(spark.range(1000, 31000).selectExpr("id", "concat('word', id % 7, ' word', id % 11) text", "'en' lang"))
    model = fit_topics(docs)
    got = {r.doc_id: r.t for r in rare.select("doc_id", topic_of(rare.text, rare.lang, model).alias("t")).collect()}
    assert len({(i % 4, t) for i, t in got.items()}) == len(set(got.values())) == TOPICS  # 60 of 30,060 rows: few of them were in a sample
    again = fit_topics(docs.repartition(5))
    assert all(np.array_equal(again[k][0], model[k][0]) and np.array_equal(again[k][1], model[k][1]) for k in model)
    assert model.keys() == {"en", "zz"}


def test_topics_are_as_close_as_in_memory(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").where("lang = 'en'")
    weight, centres = fit_topics(docs)["en"]
    counts = np.array([word_counts(r.text) for r in docs.select("text").collect()])
    counts = counts[counts.any(1)]
    assert np.allclose(weight, np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))))
    x = vectors(counts, weight) / UNIT
    unit = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    local = max(((x @ kmeans(x, TOPICS, seed=s).T).max(1).mean() for s in range(3)))
    assert (x @ unit.T).max(1).mean() >= 0.97 * local

import numpy as np

import corpus_pipeline as pipeline
from maintspark.llm.common import read
from maintspark.llm.mixing import op10_mixing

from .cases import empty


def test_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = read(spark, d, "documents")
    counts = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        counts.append(docs.count())
    assert all(a > b > 0 for a, b in zip(counts, counts[1:])), counts
    last = pipeline.run(spark, d).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in docs.collect()}


def test_empty(spark):
    docs = empty(spark)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.collect() == []


def test_mixing_stage_fits_topics_on_all_rows(spark):
    themes = ["engine oil pump blade", "wing flap slat rudder", "cabin seat light door", "radio antenna pilot mic"]
    # the themes of a language of 120 in 20,120 rows differ much in size, so that raking draws them apart
    of = [0] * 84 + [1] * 12 + [2] * 12 + [3] * 12
    rare = spark.createDataFrame([(i, " ".join(np.random.default_rng(i).choice(themes[t].split(), 40)), "zz", "s") for i, t in enumerate(of)], "doc_id long, text string, lang string, source string")
    docs = rare.union(spark.range(1000, 21000).selectExpr("id", "concat('word', id % 7, ' word', id % 11) text", "'en' lang", "'s' source"))
    given = {r.doc_id: r for r in op10_mixing(spark, docs).where("lang = 'zz'").collect()}
    by_topic = {(of[i], r.topic, round(r.weight, 6)) for i, r in given.items()}
    assert len(by_topic) == 4 and len({w for _, _, w in by_topic}) == 2
    assert {r.doc_id for r in pipeline.mixing(spark, docs, "").where("lang = 'zz'").collect()} == {i for i, r in given.items() if r.kept}

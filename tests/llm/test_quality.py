import zlib

import numpy as np
from pyspark.sql import types as T

from maintspark.llm.common import read
from maintspark.llm.quality import FEATURES, features, fit, keep_good, op9_quality, train

from .cases import HARD, clashing, empty, hard

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = fit(x[:600], y[:600])
    assert ((model.score(x[600:]) > 0.5) == y[600:]).mean() > 0.93
    # the gathers equal a walk of each tree
    for row, raw in zip(x[:50], model.raw(x[:50]), strict=True):
        total = model.base
        for f, c, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            total += leaf[node - len(f)]
        assert abs(total - raw) < 1e-9


def test_features_are_total():
    for t in HARD:
        got = features(t)
        assert len(got) == len(FEATURES) and np.isfinite(got).all()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    rows = {r.doc_id: r for r in op9_quality(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in rows.items())
    held = [(rows[l.doc_id].predicted, l.quality) for l in labels.collect() if rows[l.doc_id].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95


def test_hard_rows_and_no_labels(spark):
    none = spark.createDataFrame([], LABELS)
    rows = op9_quality(clashing(hard(spark)), none).collect()
    assert len(rows) == len(HARD) and all(0 <= r.score <= 1 for r in rows)
    assert op9_quality(empty(spark), none).collect() == []
    some = spark.createDataFrame([(1, None, 0), (2, 1, 0), (2, 1, 0), (3, 0, 0), (4, 1, 0)], LABELS)
    assert len(op9_quality(hard(spark).union(hard(spark)), some).collect()) == 2 * len(HARD)


def test_labels_of_held_out_rows_are_not_read(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - quality, quality) quality", "toxic")
    a, b = train(docs, labels), train(docs, turned)
    assert (a.cut == b.cut).all() and (a.leaf == b.leaf).all()


def test_filter_keeps_columns(spark):
    d = "/root/testdata/sf0.01"
    docs = read(spark, d, "documents")
    kept = keep_good(clashing(docs), read(spark, d, "labels"))
    assert kept.columns == clashing(docs).columns and 0 < kept.count() < docs.count()

"""Quality of documents: gradient-boosted trees over statistics of the text.

Trees are grown on histograms of binned features (logistic loss, second-order gains) and
flattened into complete heaps, so that scoring is a few numpy gathers for a batch of rows.

The model is fitted on at most ``max_rows`` labelled rows (those with the smallest hash of
doc_id), of which the features alone reach the driver; every document is scored. Null and
empty texts have the features of an empty text and are scored like any other. Without
labels of both kinds the score is the share of good labels (0.5 without any). Repeated
rows are kept and score alike. Labels given twice count by their mean.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_sd", "longest_word", "upper", "digits", "space", "punctuation", "symbols", "bars", "exclamations",
    "other_bytes", "line_length", "repeated_lines", "distinct_words", "top_word", "same_word_again", "distinct_triples", "sentence_ends", "capitalised", "all_caps", "squeezed",
)
THRESHOLD = 0.7
_WORD = re.compile(r"\S+")
_COUNTED = [np.zeros(256) for _ in range(7)]
for _row, _chars in zip(_COUNTED, (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \n\t\r", b".,;:?'\"()-", b"#$%&*@^~=<>{}[]\\/_+", b"|", b"!"), strict=True):
    _row[list(_chars)] = 1
_COUNTED = np.stack(_COUNTED, 1)


def features(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256)
    upper, digits, space, punctuation, symbols, bars, bangs = (counts @ _COUNTED / n).tolist()
    words = raw.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen = Counter(words)
    again = sum(map(bytes.__eq__, words, words[1:]))
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    caps = sum(map(bytes.isupper, words))
    title = sum(w[:1].isupper() for w in words)
    ends = sum(counts[list(b".?")].tolist())
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), float(lengths.mean()) if words else 0.0, float(lengths.std()) if words else 0.0, float(np.log1p(lengths.max())) if words else 0.0,
        upper, digits, space, punctuation, symbols, bars, bangs, float(counts[128:].sum()) / n,
        float(np.log1p(n / max(1, len(lines)))), 1 - len(set(lines)) / max(1, len(lines)), len(seen) / m, max(seen.values(), default=0) / m, again / m, triples / max(1, len(words) - 2),
        ends / m, title / m, caps / m, len(zlib.compress(raw, 1)) / n,
    ]


class Trees:
    """Boosted trees as arrays: complete heaps of one depth."""

    def __init__(self, depth: int, base: float):
        self.depth, self.base = depth, base
        self.feature, self.cut, self.leaf = (np.empty((0, (1 << depth) - 1), np.int32), np.empty((0, (1 << depth) - 1)), np.empty((0, 1 << depth)))

    def add(self, feature, cut, leaf) -> None:
        self.feature, self.cut, self.leaf = np.vstack([self.feature, feature]), np.vstack([self.cut, cut]), np.vstack([self.leaf, leaf])

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), dtype=np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return self.base + self.leaf[trees, node - (1 << self.depth) + 1].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, least: float = 4.0, ridge: float = 1.0) -> Trees:
    """Grows the trees level by level; a node without a gain sends all its rows to the left."""
    mean = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or mean in (0.0, 1.0):
        return Trees(depth, float(np.log((mean + 1e-3) / (1 - mean + 1e-3))))
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], 1)
    width = max(len(c) for c in cuts) + 1
    model = Trees(depth, float(np.log(mean / (1 - mean))))
    raw = np.full(n, model.base)
    rows = np.arange(n)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p) + 1e-9
        feature, cut, split = np.zeros((1 << depth) - 1, np.int32), np.full((1 << depth) - 1, np.inf), np.full((1 << depth) - 1, width)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, wide = (1 << level) - 1, 1 << level
            at = node - first
            best = np.zeros(wide)
            for j in range(m):
                key = at * width + binned[:, j]
                left_g = np.bincount(key, g, wide * width).reshape(wide, width).cumsum(1)
                left_h = np.bincount(key, h, wide * width).reshape(wide, width).cumsum(1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                gain[(left_h < least / 4) | (all_h - left_h < least / 4)] = 0
                gain[:, len(cuts[j]) :] = 0
                top = gain.argmax(1)
                better = gain[np.arange(wide), top] > best + 1e-12
                best = np.where(better, gain[np.arange(wide), top], best)
                for k in np.flatnonzero(better):
                    feature[first + k], split[first + k], cut[first + k] = j, top[k], cuts[j][top[k]]
            node = 2 * node + 1 + (binned[rows, feature[node]] > split[node])
        leaf_of = node - (1 << depth) + 1
        leaf = -rate * np.bincount(leaf_of, g, 1 << depth) / (np.bincount(leaf_of, h, 1 << depth) + ridge)
        model.add(feature, cut, leaf)
        raw += leaf[leaf_of]
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))], ["label", "features"])


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> Trees:
    """Fits on labelled rows that aren't held out; ``max_rows`` bounds what is read to the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label")).dropna()
    known = known.where(~held_out()).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # at most max_rows ids and labels
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # of repeated ids one row
    rows = once.select("label", "text").mapInArrow(_feature_rows, "label double, features array<double>").toPandas()
    x = np.array(rows["features"].tolist()).reshape(-1, len(FEATURES))
    y = rows["label"].to_numpy(float)
    order = np.lexsort([y, *x.T])
    return fit(x[order], y[order])


def score_documents(docs: DataFrame, model: Trees, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """All columns of the documents and the score, 0 to 1, higher is better; an equally named column is replaced."""
    docs = docs.drop(score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def rows(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            x = np.array([features(t) for t in batch.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], [*batch.schema.names, score_col])

    return docs.mapInArrow(rows, schema)


def op9_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs.selectExpr("cast(doc_id as long) doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns."""
    name = "_quality_score"
    while name in docs.columns:
        name += "_"
    return score_documents(docs, train(docs, labels), score_col=name).where(F.col(name) >= threshold).drop(name)

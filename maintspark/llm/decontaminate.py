"""Finds documents that contain items of a benchmark.

The items get a BM25 inverted index. Scores are divided by the item's score with itself, so
one threshold serves all items. Every document is cut into overlapping passages, each long
enough to hold any item whole, and every passage is a query. Retrieval is block-max WAND:
a passage is skipped when the sum of its terms' largest impacts can't reach the threshold,
then blocks of items are skipped by the block maxima, and the rest is walked document at a
time from pivot to pivot. All items above the threshold are retrieved, not the top ones.
A candidate counts if enough of the item's word triples are in one of the passages that
retrieved it, of its question (all but the last sentence) and of its answer (the last
sentence) alike; where an item has no own answer the whole item is both.

The index is broadcast in slices of at most ``slice_chars`` characters of items, so it is
bounded however large the benchmark; documents are scanned once a slice. The number of items,
their mean and largest length and the number of items with a word are those of the whole
benchmark, counted by Spark, so that the slices don't change a result. Null and empty
texts and items match nothing. Repeated rows are judged each by itself. Items with equal
text are all reported. Other columns of the documents pass through untouched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices

K1, B = 1.2, 0.75
#: Items in a block of the index: few, so that a block's bound is close to its items' scores.
BLOCK = 4
GRAM = 3
_CLEAN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def _grams(w: list[bytes]) -> set[bytes]:
    n = min(GRAM, len(w))
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def _sentences(text: str) -> list[str]:
    parts, start = [], 0
    for i, c in enumerate(text):
        if c in ".?!\n" and (i + 1 == len(text) or text[i + 1] in " \n\t\r"):
            parts.append(text[start : i + 1])
            start = i + 1
    parts.append(text[start:])
    return [p for p in parts if words(p)]


class Stats(NamedTuple):
    """Of a whole benchmark; ``having``: items with a word, of a slice's words at least."""

    n: int
    mean: float
    longest: int
    having: dict[bytes, int]


def stats_of(split: list[list[bytes]]) -> Stats:
    split = [w for w in split if w]
    sizes = [len(w) for w in split] or [1]
    return Stats(len(split), sum(sizes) / len(sizes), max(sizes), Counter(x for w in split for x in set(w)))


class Index:
    def __init__(self, items: list[tuple[int, str | None]], stats: Stats | None = None):
        items = [(i, t, words(t)) for i, t in sorted(items, key=lambda x: (x[0], x[1] or ""))]
        items = [x for x in items if x[2]]
        self.ids = [i for i, _, _ in items]
        self.n = len(items)
        stats = stats or stats_of([w for _, _, w in items])
        self.longest = stats.longest
        self.parts = []
        for _, t, w in items:
            s = _sentences(t)
            question, answer = (words(" ".join(s[:-1])), words(s[-1])) if len(s) > 1 and len(words(s[-1])) >= GRAM else (w, w)
            self.parts.append((_grams(question), _grams(answer), len(w)))
        self.vocabulary: dict[bytes, int] = {}
        postings: list[list[tuple[int, int]]] = []
        for k, (_, _, w) in enumerate(items):
            for word in sorted(set(w)):
                t = self.vocabulary.setdefault(word, len(postings))
                if t == len(postings):
                    postings.append([])
                postings[t].append((k, w.count(word)))
        mean = stats.mean
        idf = [np.log(1 + (stats.n - stats.having[w] + 0.5) / (stats.having[w] + 0.5)) for w in self.vocabulary]
        own = np.zeros(self.n)
        impacts = []
        for t, p in enumerate(postings):
            row = [idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * self.parts[k][2] / mean)) for k, f in p]
            impacts.append(row)
            for (k, _), x in zip(p, row, strict=True):
                own[k] += x
        self.postings = [[k for k, _ in p] for p in postings]
        self.impacts = [[x / own[k] for (k, _), x in zip(p, row, strict=True)] for p, row in zip(postings, impacts, strict=True)]
        self.blocks = -(-self.n // BLOCK)
        # one more row, of zeros, for words that no item has
        self.most = np.array([*(max(r) for r in self.impacts), 0.0], dtype=np.float64)
        self.block_most = np.zeros((len(postings) + 1, self.blocks), dtype=np.float32)
        for t, (p, row) in enumerate(zip(self.postings, self.impacts, strict=True)):
            np.maximum.at(self.block_most[t], np.array(p) // BLOCK, np.array(row, dtype=np.float32))

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score with the terms reaches the threshold."""
        found = []
        at = dict.fromkeys(terms, 0)
        live = [t for t in terms if self.postings[t]]
        while live:
            live.sort(key=lambda t: self.postings[t][at[t]])
            bound, pivot = 0.0, None
            for i, t in enumerate(live):
                bound += self.most[t]
                if bound >= threshold - 1e-9:
                    pivot = i
                    break
            if pivot is None:
                break
            item = self.postings[live[pivot]][at[live[pivot]]]
            while pivot + 1 < len(live) and self.postings[live[pivot + 1]][at[live[pivot + 1]]] == item:
                pivot += 1
            block = item // BLOCK
            if sum(float(self.block_most[t, block]) for t in live[: pivot + 1]) < threshold - 1e-6:
                # nothing in this block, as far as these lists go: to its end or to the next list's item
                to = (block + 1) * BLOCK
                if pivot + 1 < len(live):
                    to = min(to, self.postings[live[pivot + 1]][at[live[pivot + 1]]])
                moving = live[: pivot + 1]
            elif self.postings[live[0]][at[live[0]]] == item:
                score = sum(self.impacts[t][at[t]] for t in live[: pivot + 1])
                if score >= threshold - 1e-9:
                    found.append((item, score))
                to, moving = item + 1, live[: pivot + 1]
            else:
                to, moving = item, [t for t in live[:pivot] if self.postings[t][at[t]] < item]
            for t in moving:
                at[t] = bisect_left(self.postings[t], to, at[t])
            live = [t for t in live if at[t] < len(self.postings[t])]
        return found

    def search(self, texts: list[str | None], threshold: float, overlap: float) -> list[list[tuple[int, float, float, float]]]:
        """For each text (item number, score, question overlap, answer overlap) of the items that it contains."""
        out: list[list[tuple[int, float, float, float]]] = [[] for _ in texts]
        if not self.n:
            return out
        stride, none = self.longest, len(self.postings)
        get = self.vocabulary.get
        split = [words(t) for t in texts]
        terms = [np.fromiter((get(w, none) for w in s), np.int64, len(s)) for s in split]
        for i, (w, t) in enumerate(zip(split, terms, strict=True)):
            if not len(t):
                continue
            starts = np.arange(0, max(1, len(t) - stride), stride)
            ends = np.minimum(starts + 2 * stride, len(t))
            total = np.concatenate([[0], np.cumsum(self.most[t])])
            keep = total[ends] - total[starts] >= threshold - 1e-6
            if not keep.any():
                continue
            starts, ends = starts[keep], ends[keep]
            best: dict[int, tuple[float, float, float]] = {}
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                own = np.unique(t[a:b])
                # each term counts once: no block can reach the threshold in most passages
                if self.block_most[own].sum(0).max() < threshold - 1e-4:
                    continue
                passage, grams = w[a:b], None
                for item, score in self.wand([x for x in own.tolist() if x != none], threshold):
                    if grams is None:
                        grams = _grams(passage)
                        short = {b" ".join(passage[j : j + k]) for k in (1, 2) for j in range(len(passage) - k + 1)}
                    question, answer, length = self.parts[item]
                    have = grams if length >= GRAM else short
                    found = score, len(question & have) / len(question), len(answer & have) / len(answer)
                    if min(found[1:]) >= overlap:
                        best[item] = max(best.get(item, found), found)
            out[i] = [(item, float(score), q, a) for item, (score, q, a) in sorted(best.items())]
        return out


def _indexes(benchmark: DataFrame, slice_chars: int) -> Iterator[Index]:
    """An index for each slice, which is bounded, with the figures of the whole benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = -(-size // slice_chars) or 1
    if n == 1:
        yield Index([(r.item_id, r.text) for r in items.collect()])
        return

    def count(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            split = [words(t) for t in batch.column(1).to_pylist()]
            rows = [(k, x, len(w)) for k, w in zip(batch.column(0).to_pylist(), split, strict=True) if w for x in (None, *set(w))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.binary(), pa.int64()], strict=True)], ["slice", "word", "size"])

    items = items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    counted = saved(items.select("slice", "text").mapInArrow(count, "slice long, word binary, size long"), "words")
    whole = counted.where("word is null").agg(F.count("*").alias("n"), F.avg("size").alias("mean"), F.max("size").alias("longest")).first()
    having = saved(counted.where("word is not null").groupBy("word").agg(F.count("*").alias("having")), "having")
    own = counted.where("word is not null").select("slice", "word").distinct()
    having = saved(own.join(having, "word"), "slices")
    for k in range(n):
        part = {bytes(r.word): r.having for r in having.where(F.col("slice") == k).collect()}
        stats = Stats(whole["n"], whole["mean"] or 1.0, whole["longest"] or 1, part)
        yield Index([(r.item_id, r.text) for r in items.where(F.col("slice") == k).collect()], stats)


def find_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.5, slice_chars: int = 300_000) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: a row for each item that a document contains."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found = None
    for index in _indexes(benchmark, slice_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared):
            index = shared.value
            for batch in (part for whole in batches for part in slices(whole)):
                ids = batch.column(0).to_pylist()
                hits = index.search(batch.column(1).to_pylist(), threshold, overlap)
                flat = [(d, index.ids[k], *rest) for d, h in zip(ids, hits, strict=True) for k, *rest in h]
                columns = list(zip(*flat, strict=True)) if flat else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema)
        found = got if found is None else found.unionByName(got)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.5, slice_chars: int = 300_000) -> DataFrame:
    """The documents that contain no item, with their own columns. No shuffle."""
    for index in _indexes(benchmark, slice_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared):
            for batch in (part for whole in batches for part in slices(whole)):
                hits = shared.value.search(batch.column("text").to_pylist(), threshold, overlap)
                yield batch.filter(pa.array([not h for h in hits], pa.bool_()))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs


def op8_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_matches(docs, benchmark)
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), F.round("question_overlap", 6).alias("question_overlap"), F.round("answer_overlap", 6).alias("answer_overlap"))

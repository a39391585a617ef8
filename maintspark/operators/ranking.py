"""The best documents of many questions, with blocks of both as rows: pairs of a document and a question are never rows.

Documents are packed in blocks where they lie, questions in blocks by hash. Every block of
questions meets every block of documents by a join on the number of the question block, so
few questions are broadcast and many are shuffled, as Spark finds their size. A pair of blocks
is scored by one product of matrices and gives k rows a question; those are merged by a window.

Documents: doc_id, key (text; ties go by it, then by doc_id), embedding (array of double),
rules (a mask), tags (a mask in two longs, ``tag_bits``), flagged. Questions: query_id,
embedding, rules, tag and other (numbers of bits). A question is compared with the documents
that have its tag, or, if no document has it, with those that have the other one. The score is
the cosine (0 for empty vectors) plus what ``points`` give for the rules that both have,
rounded to ``digits``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents and questions of a block.
DOCS, QUESTIONS = 1024, 256
FIELDS = ("query_id", "embedding", "rules", "tag", "other")


def tag_bits(numbers: Column) -> Column:
    """An array of numbers from 0 to 125 as a struct of two masks."""
    half = lambda first: F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, n: acc.bitwiseOR(F.when(n.between(first, first + 62), F.call_function("shiftleft", F.lit(1).cast("long"), (n - first).cast("int"))).otherwise(F.lit(0).cast("long"))))
    return F.struct(half(0).alias("low"), half(63).alias("high"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors as rows, filled with zeros; null vectors and entries are zeros."""
    sizes = np.where(np.asarray(lists.is_valid()), np.asarray(lists.value_lengths().fill_null(0)), 0)
    values = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(float))
    out = np.zeros((len(sizes), max(1, sizes.max(initial=0))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS):
            part = batch.slice(at, DOCS)
            # by key and id, so the first of equal scores is the right one
            part = part.take(pa.compute.sort_indices(pa.table(part.columns[:2], ["key", "doc_id"]), sort_keys=[("key", "ascending"), ("doc_id", "ascending")], null_placement="at_start"))
            vectors = _matrix(part.column(2))
            one = lambda values, kind=None: pa.array([values], kind)
            columns = [one(part.column(i).to_pylist(), pa.list_(part.schema.field(i).type)) for i in (0, 1)]
            columns += [one(vectors.tobytes(), pa.binary()), one(vectors.shape[1], pa.int32())]
            columns += [one(np.asarray(part.column(i).cast(pa.int64()).fill_null(0)).tobytes(), pa.binary()) for i in range(3, 7)]
            yield pa.RecordBatch.from_arrays(columns, ["keys", "ids", "vectors", "width", "rules", "low", "high", "flagged"])


def _cosines(d: np.ndarray, q: np.ndarray) -> np.ndarray:
    width = min(d.shape[1], q.shape[1])
    norms = np.outer(np.linalg.norm(d, axis=1), np.linalg.norm(q, axis=1))
    return np.divide(d[:, :width] @ q[:, :width].T, norms, out=np.zeros_like(norms), where=norms > 0)


def _rewards(points: tuple[float, ...]) -> np.ndarray:
    """What each mask of rules gives: points added in their order."""
    total = np.zeros(1 << len(points))
    for i, p in enumerate(points):
        total = total + np.where(np.arange(len(total)) >> i & 1, p, 0.0)
    return total


def _scored(k: int, points: tuple[float, ...], digits: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewards = _rewards(points)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                keys, ids = row.column("keys").flatten(), row.column("ids").flatten()
                asked = dict(zip(FIELDS, row.column("asked").flatten().flatten(), strict=True))
                whole = lambda n, row=row: np.frombuffer(row.column(n)[0].as_py(), np.int64)
                d = np.frombuffer(row.column("vectors")[0].as_py()).reshape(-1, row.column("width")[0].as_py())
                q = _matrix(asked["embedding"])
                rules, tag, other = (np.asarray(asked[n].fill_null(0)).astype(np.int64) for n in ("rules", "tag", "other"))
                scores = np.round(_cosines(d, q) + rewards[whole("rules")[:, None] & rules[None, :]], digits)
                bits = np.stack([whole("low"), whole("high")])
                has = lambda t, bits=bits: (bits[t // 63].T >> (t % 63)) & 1 == 1
                flagged = whole("flagged") == 1
                out = {n: [] for n in ("query", "doc", "score", "flagged", "kind")}

                def add(docs, questions, kind, scores=scores, flagged=flagged, out=out):
                    out["query"].append(questions)
                    out["doc"].append(docs)
                    out["score"].append(scores[docs, questions])
                    out["flagged"].append(flagged[docs])
                    out["kind"].append(np.full(len(docs), kind, np.int32))

                for fallback, bit in ((0, tag), (1, other)):
                    ok = has(bit)
                    if fallback:
                        ok &= tag != other
                    elif len(ok):
                        there = np.flatnonzero(ok.any(axis=0))
                        add(np.zeros(len(there), np.int64), there, 4)
                    best = np.argsort(np.where(ok, -scores, np.inf), axis=0, kind="stable")[:k]
                    docs, questions = best.ravel(), np.tile(np.arange(len(q)), len(best))
                    good = ok[docs, questions] & (scores[docs, questions] > 0)
                    add(docs[good], questions[good], 2 * fallback)
                    special = np.where(ok & flagged[:, None], scores, -np.inf)
                    first = special.argmax(axis=0)
                    questions = np.flatnonzero(special[first, np.arange(len(q))] > -np.inf)
                    add(first[questions], questions, 2 * fallback + 1)
                which = {n: np.concatenate(v) for n, v in out.items()}
                docs = pa.array(which["doc"])
                columns = [asked["query_id"].take(pa.array(which["query"])), ids.take(docs), keys.take(docs), *(pa.array(which[n]) for n in ("score", "flagged", "kind"))]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "doc_id", "key", "score", "flagged", "kind"])

    return score


def best_documents(docs: DataFrame, queries: DataFrame, k: int, points: tuple[float, ...] = (), digits: int = 12) -> DataFrame:
    """query_id, rank, doc_id, key, score, flagged, extra: the k best with a score above 0; and, as ``extra``, the best flagged one, whatever its score."""
    doc_type, query_type = dict(docs.dtypes)["doc_id"], dict(queries.dtypes)["query_id"]
    narrow = docs.select("key", "doc_id", "embedding", F.col("rules").cast("long"), "tags.low", "tags.high", F.coalesce("flagged", F.lit(False)).cast("long").alias("flagged"))
    blocks = narrow.mapInArrow(_blocked, f"keys array<string>, ids array<{doc_type}>, vectors binary, width int, rules binary, low binary, high binary, flagged binary")
    parts = max(1, -(-queries.count() // QUESTIONS))
    asked = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct(*FIELDS)).alias("asked"))
    grid = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(asked, "part").drop("part")
    found = grid.mapInArrow(_scored(k, points, digits), f"query_id {query_type}, doc_id {doc_type}, key string, score double, flagged boolean, kind int")
    order = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "key", "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).where((F.col("kind") % 2 == 0) | (F.col("rank") == 1))
    # kind: 0 and 1 the best and the best flagged with the tag, 2 and 3 with the other one, 4 says that a document has the tag
    there = F.max(F.col("kind") == 4).over(Window.partitionBy("query_id"))
    kept = ranked.withColumn("there", there).where((F.col("kind") < 4) & ((F.col("kind") < 2) == F.col("there")))
    return kept.select("query_id", "rank", "doc_id", "key", "score", "flagged", (F.col("kind") % 2 == 1).alias("extra"))

"""Exact Jaccard join of documents on word shingles, and the groups that the links make.

Equal shingle sets are one class, by a 128-bit digest, before anything is compared. Then a
size-aware join: sets up to a boundary are light and are matched by enumerating all subsets
of the sizes that an overlap needs; larger sets are heavy and scan inverted lists of their
rarest shingles (a set that can link needs one of its first n - ceil(t n) + 1 in common;
rarity by a fixed-size counting sketch over all documents). The boundary is the size up to
which the subsets of all sets cost less than their lists would, from a histogram of sizes.

An entry of a list holds the set's size and its ``room``: the most that two sets can share
if this is the first shingle that they share. Two entries meet only if both rooms reach the
overlap that their sizes need. A list isn't expanded into all pairs:

1. Each entry meets the list's head, the set whose shingles are most common (the likeliest
   origin of copies). The links found are united to components.
2. Entries outside of the head's component meet the entries of other components, if there
   are at most ``FEW`` of them in the list: so pairs per list stay in proportion to it.
3. Longer lists of strangers are split by the next shingle that two sets would share. Their
   parts go through 1 and 2 once more, however many entries are left; what meets there shares
   two of its rarest shingles.

So every link is found or lies inside a known component; none is lost. A pair counts when
100 |A & B| >= 100 t |A | B|, on whole sets of 64-bit hashes of shingles (two different
shingles of equal hash would count as one).

Null, empty and white texts have no shingles and link with nothing. Fewer words than a
shingle make one shorter shingle. Rows with one doc_id and different texts are judged each
by itself; null ids count as -1. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, mix64, only, saved, slices

SKETCH = 1 << 20
CHUNK = 1 << 14
#: Entries of a list outside of the head's component that meet all others; a list with more is split.
#: About as many as splitting makes of one entry, so that it is never the dearer way.
FEW = 128


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least n."""
    if len(_powers[0]) < n:
        size = 1 << max(16, n.bit_length())
        for i, factor in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            row = np.full(size, factor, dtype=np.uint64)
            row[0] = 1
            _powers[i] = np.cumprod(row, dtype=np.uint64)
    return _powers


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; ASCII letters in lower case.

    The hash of a word is a polynomial of its bytes, taken from running sums over the text.
    """
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[b], [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(b) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
        a = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        n = min(size, len(a))
        h = np.full(len(a) - n + 1, np.uint64(n))
        for i in range(n):
            h = mix64(h + a[i : len(a) - n + 1 + i])
    return np.unique(h)


def _least(n: int, m: int, percent: int) -> int:
    """The overlap that sets of these sizes need."""
    return -(-percent * (n + m) // (100 + percent))


def _range(n: int, percent: int) -> tuple[int, int]:
    return -(-percent * n // 100), 100 * n // percent


def _overlaps(n: int, percent: int) -> range:
    low, high = _range(n, percent)
    return range(_least(n, low, percent), min(n, _least(n, high, percent)) + 1)


def subsets_of(n: int, percent: int) -> int:
    return sum(comb(n, c) for c in _overlaps(n, percent))


def prefix_of(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def boundary(sizes: list[tuple[int, int]], percent: int, scan: float = 12.0) -> int:
    """The largest size up to which subsets cost no more than lists; ``scan`` is the cost of a list entry in subsets."""
    best, at, saving = 0.0, 0, 0.0
    for n, count in sorted(sizes):
        if n > 64:
            break
        saving += count * (scan * prefix_of(n, percent) - subsets_of(n, percent))
        if saving > best:
            best, at = saving, n
    return at


def _digest(h: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(h.tobytes())


def _name(digest: bytes) -> int:
    """The first half of a digest: with the document's id it names a set."""
    return int.from_bytes(digest[:8], "big", signed=True)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))


def _measured(texts: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n, digest of each document's set; and, with ``piece``, each task's counts of shingles by their hash."""

    def rows(batches: Iterator[pa.RecordBatch]):
        counts = np.zeros(SKETCH, dtype=np.uint32)
        for b in (part for batch in batches for part in slices(batch)):
            sizes, digests = [], []
            for t in b.column(2).to_pylist():
                s = shingles(t, size)
                counts[(s % np.uint64(SKETCH)).astype(np.int64)] += 1
                sizes.append(len(s))
                digests.append(_digest(s))
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names)
        used = [(i, zlib.compress(c.tobytes(), 1)) for i, c in enumerate(counts.reshape(-1, CHUNK)) if c.any()]
        none = pa.nulls(len(used))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array([i for i, _ in used], pa.int32()), pa.array([c for _, c in used], pa.binary())], names)

    names = ["doc_id", "text_key", "n", "digest", "piece", "counts"]
    return texts.mapInArrow(rows, "doc_id long, text_key long, n long, digest binary, piece int, counts binary")


def _sketch(measured: DataFrame) -> np.ndarray:
    """The tasks' counts, added up by Spark in pieces; a table of a fixed size."""

    def add(batches: Iterator[pa.RecordBatch]):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.uint64)
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(v, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], ["piece", "counts"])

    total = np.zeros((SKETCH // CHUNK, CHUNK), dtype=np.uint32)
    pieces = measured.where("piece is not null").select("piece", "counts")
    for r in pieces.repartition("piece").mapInArrow(add, "piece int, counts binary").collect():  # 4 MB in all
        total[r["piece"]] = np.frombuffer(r["counts"], np.uint32)
    return total.ravel()


def _ranked(s: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """(the set from its rarest shingle to its most common, 1000 times the mean logarithm of the counts)."""
    counts = common[(s % np.uint64(SKETCH)).astype(np.int64)]
    return s[np.lexsort((s, counts))], int(1000 * np.log2(counts + np.float64(1)).mean())


POSTING = "key long, id long, set long, n int, room int, central int, light boolean"


def _postings(texts: DataFrame, size: int, percent: int, counts, border: int) -> DataFrame:
    """Subsets of light sets, rarest shingles of heavy sets and of those that heavy sets can reach."""
    reach = _range(border + 1, percent)[0]

    def rows(batches: Iterator[pa.RecordBatch]):
        common = counts.value
        for batch in batches:
            for part in slices(batch):
                keys, rooms, each = [], [], []
                for d, t in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                    s = shingles(t, size)
                    n = len(s)
                    if not n:
                        continue
                    ranked, central = _ranked(s, common)
                    owner = d, _name(_digest(s)), n, central
                    if n <= border:
                        for c in _overlaps(n, percent):
                            picks = np.array(list(combinations(range(n), c)), dtype=np.int64)
                            h = np.full(len(picks), np.uint64(c))
                            for j in range(c):
                                h = mix64(h + s[picks[:, j]])
                            keys.append(h)
                            rooms.append(np.full(len(h), c))
                            each.append((*owner, True, len(h)))
                    if n >= reach:
                        p = prefix_of(n, percent)
                        keys.append(mix64(ranked[:p] ^ np.uint64(0x5851F42D4C957F2D)))
                        rooms.append(n - np.arange(p))
                        each.append((*owner, False, p))
                if not keys:
                    continue
                doc, name, n, central, light, times = zip(*each, strict=True)
                own = [np.repeat(np.array(x), times) for x in (doc, name, n, central, light)]
                columns = [np.concatenate(keys).view(np.int64), own[0], own[1], own[2], np.concatenate(rooms), own[3], own[4]]
                kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)], ["key", "id", "set", "n", "room", "central", "light"])

    return texts.mapInArrow(rows, POSTING)


def _longer(entries: DataFrame, sets: DataFrame, level: int, percent: int) -> DataFrame:
    """Entries of the lists of ``level`` shingles, split by the next one that two sets would share."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in batch.to_pylist():
                n, at = r["n"], level + r["n"] - r["room"]  # the first place after the last shared shingle
                if percent * n <= 100 * level:  # so small that who shares as much links: a light list, whole
                    light = [mix64(np.array([r["key"]], np.int64).view(np.uint64)).view(np.int64), *([r[c]] for c in ("id", "set", "n")), [level], [r["central"]], [True]]
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(light, kinds, strict=True)], names)
                stop = level + n - (-(-percent * n // 100)) + 1
                s = np.frombuffer(r["hashes"], np.uint64)[at:stop]
                keys = mix64((np.uint64(r["key"] & (1 << 64) - 1) ^ np.uint64(0x2545F4914F6CDD1D)) + mix64(s)).view(np.int64)
                m = len(keys)
                columns = [keys, *(np.full(m, r[c]) for c in ("id", "set", "n")), level + n - np.arange(at, at + m), np.full(m, r["central"]), np.zeros(m, bool)]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["key", "id", "set", "n", "room", "central", "light"]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.bool_()]
    return entries.join(sets, NODE).select("key", "id", "set", "n", "room", "central", "hashes").mapInArrow(rows, POSTING)


NODE = ["id", "set"]


def _lists(postings: DataFrame, percent: int) -> DataFrame:
    """The entries of lists in which two sets could meet; a set once in a list, with its smallest id."""
    index = F.col("room") * (100 + percent) >= 2 * percent * F.col("n")  # the smaller of two sets needs such an entry
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("set", "n", "room") for f in (F.min, F.max)]
    meet = f"100 * min_n >= {percent} * max_n and min_room * {100 + percent} >= {percent} * (min_n + max_n)"
    # of a list of two it is known here whether they can meet
    several = postings.groupBy("key").agg(*ends, F.max(index).alias("index"), F.count("*").alias("entries")).where(f"min_set < max_set and index and (entries > 2 or {meet})").select("key")
    several = saved(several, "several")  # so that both sides of the join are plain exchanges, which Spark can split
    both = saved(only(postings, several, "key"), "entries")
    once = both.groupBy("key", "set").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n", "room", "central", "light")))
    out = saved(once.select("key", "id", "set", "n", "room", "central", "light"), "lists")
    discard(several, both)
    return out


def _meet(percent: int, head: str = "head") -> Column:
    """Whether an entry and another, in a struct column, can link."""
    n, m = F.col("n"), F.col(f"{head}.n")
    need = percent * (n + m)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least("room", F.col(f"{head}.room")) * (100 + percent) >= need)


def _node(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}id").alias("id"), F.col(f"{prefix}set").alias("set"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    left = sets.select(_node().alias("a"), F.col("hashes").alias("x"))
    right = sets.select(_node().alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(rows, pairs.schema)


def components(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """node, root: the smallest node reachable, for every node that has an edge. Labels spread and jump until nothing changes.

    ``start``: roots of some of the edges, from which to go on.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    if start is not None:
        old = start.select("node", F.col("root").alias("old"))
        label = label.join(old, "node", "left").select("node", F.least("root", F.coalesce("old", "root")).alias("root"))
    label = saved(label, "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        new = label.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        jump = label.select(F.col("node").alias("new"), F.col("root").alias("far"))
        new = saved(new.join(jump, "new", "left").select("node", F.col("root").alias("old"), F.least("new", F.coalesce("far", "new")).alias("root")), "labels")
        discard(label)
        label = new
        if new.where("old <> root").isEmpty():
            discard(both)
            return label.select("node", "root")


def _linked(texts: DataFrame, measured: DataFrame, size: int, percent: int, repeated: bool) -> DataFrame | None:
    """node, root of the sets that link with others."""
    spark = texts.sparkSession
    histogram = [(r["n"], r["count"]) for r in measured.where("n > 0 and n <= 64").groupBy("n").count().collect()]  # 64 rows at most
    counts = spark.sparkContext.broadcast(_sketch(measured))  # of a fixed size
    postings = saved(_postings(texts, size, percent, counts, boundary(histogram, percent)), "postings")
    lists = _lists(postings, percent)
    discard(postings)

    def set_rows(batches: Iterator[pa.RecordBatch]):
        common = counts.value
        for b in batches:
            for part in slices(b):
                found = [shingles(t, size) for t in part.column(2).to_pylist()]
                names = [_name(_digest(s)) for s in found]
                ranked = [_ranked(s, common)[0].tobytes() if len(s) else b"" for s in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.int64()), pa.array(ranked, pa.binary())], ["id", "set", "hashes"])

    def sets_of(nodes: DataFrame) -> DataFrame:
        """id, set, hashes (rarest first) of the documents that have one of these sets."""
        ids = saved(nodes.select(F.col("id").alias("doc_id")).distinct(), "ids")
        sets = only(texts, ids, "doc_id").mapInArrow(set_rows, "id long, set long, hashes binary")
        return saved(sets.dropDuplicates(NODE) if repeated else sets, "hashes")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = saved(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
        sets = sets_of(pairs.select("a.id").union(pairs.select("b.id")))
        found = saved(_verified(pairs, sets, percent), "links")
        discard(pairs, sets)
        return found

    roots = links = None
    level = 1
    entry = ["id", "set", "n", "room", "central"]
    while True:
        state = lists.withColumn("root", _node()) if roots is None else lists.withColumn("node", _node()).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")
        # of light lists a head for each size: who can meet there links, so the heads join all of them
        heads = state.groupBy("key", F.when(F.col("light"), F.col("n")).otherwise(0).alias("class")).agg(F.max(F.struct("central", "n", "room", *NODE, "root")).alias("head"))
        heads = saved(heads, "heads")
        star = state.join(heads, "key").where((F.col("root") != F.col("head.root")) & _meet(percent)).select(_node().alias("x"), _node("head.").alias("y"))
        found = linked(star)
        links = found if links is None else links.union(found)
        roots = components(links, roots)
        state = saved(lists.where("not light").withColumn("node", _node()).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node"), "state")
        mains = heads.where("class = 0").select("key", _node("head.").alias("node")).join(roots, "node", "left").select("key", F.col("node").alias("head"), F.coalesce("root", "node").alias("main"))
        mains = saved(mains, "mains")
        odd = saved(state.join(mains, "key").where(F.col("root") != F.col("main")), "odd")
        strange = saved(odd.groupBy("key").agg(F.count("*").alias("size")), "strange")
        few = (odd.join(strange.where(F.col("size") <= FEW).select("key"), "key") if level == 1 else odd).select("key", "head", F.struct(*entry, "root").alias("other"))
        cross = state.join(few, "key").where((F.col("root") != F.col("other.root")) & (_node() != F.col("head")) & _meet(percent, "other")).select(_node().alias("x"), _node("other.").alias("y"))
        found = linked(cross)
        if not found.isEmpty():
            links = links.union(found)
            roots = components(links, roots)
        if level == 2:
            break
        many = state.join(strange.where(F.col("size") > FEW).select("key"), "key").select("key", *entry)
        if many.isEmpty():
            break
        lists = _lists(saved(_longer(many, sets_of(many), level, percent), "postings"), percent)
        level += 1
    return roots


def _grouped(docs: DataFrame, size: int, percent: int, text_col: str) -> tuple[DataFrame, bool]:
    """(doc_id, text_key, n_shingles, class_id, component_id of each distinct row, whether rows repeat)."""
    texts = _texts(docs, text_col)
    measured = saved(_measured(texts, size), "sets")
    sized = saved(measured.where("piece is null").drop("piece", "counts").distinct(), "sized")
    repeated = sized.count() < measured.where("piece is null").count()
    roots = _linked(texts, measured, size, percent, repeated)
    lead = saved(sized.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("lead"), F.count("*").alias("docs")).where("docs > 1").select("digest", "lead"), "leads")
    classes = sized.join(lead, "digest", "left").select("doc_id", "text_key", "n", F.coalesce("lead", "doc_id").alias("class_id"), F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long").alias("set"))
    classes = classes.withColumn("node", F.struct(F.col("class_id").alias("id"), "set"))
    out = classes.join(roots, "node", "left")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "class_id", F.coalesce("root.id", "class_id").alias("component_id")), repeated


def link_groups(docs: DataFrame, size: int = 4, percent: int = 85, text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with an equal set), component_id; a row for each distinct doc_id and text."""
    return _grouped(docs, size, percent, text_col)[0].drop("text_key")


def op6_jaccard_join(docs: DataFrame) -> DataFrame:
    return link_groups(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group (the one with the smallest doc_id), with the documents' own columns; of equal rows one."""
    groups, repeated = _grouped(docs, size, percent, "text")
    gone = saved(groups.where("doc_id <> component_id").select("doc_id", "text_key"), "gone")
    if repeated:
        docs = docs.dropDuplicates(["doc_id", "text"])
    own = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    return only(docs, gone.select(F.struct("doc_id", "text_key").alias("gone")), "gone", own, anti=True)

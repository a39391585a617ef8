"""Removes text that a document repeats from documents with smaller ids: byte strings of at least ``least`` bytes.

1. Chunks: some documents of a batch, compressed, are a row of a written table; each later
   step reads that table and no step writes the texts again.
2. Windows: each string of ``least`` bytes has an anchor, the smallest hash of its grams, so
   equal strings have equal anchors. Neighbouring strings of one anchor are a window; each
   string is in one window.
3. A chunk tells each of its anchors once: a hash of its windows (or that they differ) and
   the smallest and the largest id. Anchors meet in parts whose number grows with the text.
   An anchor of one id takes nothing from anyone. One whose windows are all equal (known by
   their anchor and a hash, 111 bits together) is settled: its strings have the windows' ids.
   Bytes are written of the other anchors' windows only. Of those, equal windows become one,
   with the smallest and the largest id, before anything is gathered.
4. Distinct windows are dealt by their anchor into groups whose number grows with them. A
   Burrows-Wheeler transform of them is extended backward, breadth first: the intervals of
   level l give the borders where neighbours share exactly l bytes. The search stops at
   ``least``; neighbours without a border share that many. The smallest id of a run is what
   each of its strings gets. An anchor with more than ``MOST`` distinct windows isn't
   gathered: its windows are cut again, by longer grams, into windows with anchors of their
   own, and these take this step anew. After the longest grams, Spark groups the strings of
   what is left.
5. The verdicts return to the windows' occurrences, and a string is removed where its
   smallest id is below the document's own. The removed starts return to their chunks,
   where they are united.

Null and empty texts lose nothing. Rows with the same id don't remove each other's text;
rows are told apart by their place in a chunk, so each of them loses its own.
Null ids count as -1. Extra columns are ignored. Every text is read whole.
"""

from __future__ import annotations

import itertools
import secrets
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fields, mix64, only, saved, shuffles_freed

GRAM = 24
#: Grams of windows that are cut again, in turn; of strings of fewer bytes only those that are shorter.
LONGER = (40, 48)
#: Bytes of text in a chunk, about; a longer document is a chunk of its own.
CHUNK_BYTES = 2_000_000
#: Bytes of an Arrow batch: a chunk is a row, and a batch is held whole by the JVM and by Python.
BATCH_BYTES = "4m"
#: Bytes of text whose anchors meet in one part, about.
PART_BYTES = 12_000_000
#: Bits of an anchor.
ANCHOR_BITS = 48
#: Bytes of windows that are transformed together (the windows of one anchor always are).
PLACE_BYTES = 120_000
#: Bytes of distinct windows in a group, about; the number of groups follows.
GROUP_BYTES = 4_000_000
#: Distinct windows of one anchor; with more, they are cut again.
MOST = 1_500
#: Places or intervals that are worked on at once: temporary arrays stay small.
BLOCK = 1 << 16


def _few_chunks(spark: SparkSession) -> None:
    """Bounds the bytes of batches that go to Python workers, unless the session already says something else than Spark's default."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "64m") == "64m":
        spark.conf.set(name, BATCH_BYTES)


def windows_of(raw: bytes, sizes: np.ndarray, least: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(starts, one past the last start, number of the document, anchor) of the windows of documents that lie one after another in ``raw``."""
    n, slots, ends = len(raw), least - gram + 1, np.cumsum(sizes)
    if n < least:
        return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint64))
    words, low = _words(raw), np.empty(n - slots + 1, np.uint64)
    for i in range(0, len(low), BLOCK):
        some = low[i : i + BLOCK]
        _least_hashes(words[i : i + len(some) + slots - 1 + gram], some, slots, gram)
    # a window ends where the anchor changes, a document begins, or too few bytes are left of one
    change = np.concatenate([[True], low[1:] != low[:-1]])
    for border in (ends - sizes, np.maximum(ends - least + 1, ends - sizes)):
        change[border[border < len(low)]] = True
    start = np.flatnonzero(change)
    stop = np.append(start[1:], len(low))
    doc = np.searchsorted(ends, start, side="right")
    whole = np.flatnonzero(start + least <= ends[np.minimum(doc, len(ends) - 1)])
    pieces = -(-(stop[whole] - start[whole]) // slots)
    which = np.repeat(whole, pieces)
    first = start[which] + slots * (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return first, np.minimum(first + slots, stop[which]), doc[which], mix64(low[first]) >> np.uint64(64 - ANCHOR_BITS)


def _least_hashes(words: np.ndarray, out: np.ndarray, slots: int, gram: int) -> None:
    """The smallest hash of the ``slots`` grams from each place on."""
    n = len(out) + slots - 1
    mixed = words ^ (words >> np.uint64(32))
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    h = mixed[:n] ^ (mixed[:n] >> np.uint64(29))
    for j in range(8, gram, 8):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += mixed[j : n + j]
    low, span = mix64(h), 1
    while 2 * span <= slots:
        low, span = np.minimum(low[: len(low) - span], low[span:]), 2 * span
    np.minimum(low[: len(out)], low[slots - span : n - span + 1], out=out)


def _words(raw: bytes) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros follow the end."""
    return np.ndarray((len(raw) + 64,), "<u8", raw + bytes(72), strides=(1,))


def keys_of(raw: bytes, start: np.ndarray, stop: np.ndarray, least: int, seed: int) -> np.ndarray:
    """Odd hashes of windows: every word of the first ``least`` bytes, then those before the end that cover the rest."""
    words, end = _words(raw), stop + least - 1
    key = mix64(np.uint64(seed) + (stop - start).astype(np.uint64))
    for j in range(0, least - 7, 8):
        key = mix64((key ^ words[start + j]) + np.uint64(seed))
    for j in range(8, least - GRAM + 16, 8):
        key = mix64((key ^ words[end - j]) + np.uint64(seed))
    return key | np.uint64(1)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in the order of their first 64 letters, which are below 512."""
    n = len(text)
    bits, step = (8, 8) if int(text.max()) < 256 else (9, 7)
    wide = np.concatenate([text, np.zeros(8, text.dtype)]).astype(np.uint64)
    key = wide[:n].copy()
    for j in range(1, step):
        key = (key << np.uint64(bits)) | wide[j : n + j]
    while step < 64:
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
        key = rank << np.uint64(32) | np.concatenate([rank[step:], np.zeros(min(step, n), np.uint64)])[:n]
        step *= 2
    return np.argsort(key, kind="stable")


def letters_of(windows: list[bytes]) -> np.ndarray:
    """Each byte plus one, so that 0 ends a window and nothing else."""
    text = np.frombuffer(b"".join(w + b"\0" for w in windows), np.uint8).astype(np.uint16) + np.uint16(1)
    text[np.cumsum([len(w) + 1 for w in windows]) - 1] = 0
    return text


def runs_of(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, number of the run of each place in it): neighbours in one run share ``least`` letters. Letter 0 ends a window."""
    order = suffix_order(text)
    n = len(text)
    letters, bwt = np.unique(text[order - 1], return_inverse=True)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.where(letters[bwt] != 0, place[order - 1], -1)  # where the suffix that is one letter longer stands
    sigma = len(letters)
    # how often a letter stands before a place: bytes within 256 places, whole numbers between them
    near = np.zeros((n // 256 + 1, 256, sigma), np.uint8)
    near.reshape(-1, sigma)[np.arange(1, n + 1), bwt] = 1
    far = near.sum(axis=1, dtype=np.int64)
    far = np.cumsum(far, axis=0) - far + near[:, 0]
    near[:, 0] = 0
    for i in range(1, 256):
        near[:, i] += near[:, i - 1]
    near = near.reshape(-1, sigma)
    first = np.cumsum(np.bincount(bwt, minlength=sigma)) - np.bincount(bwt, minlength=sigma)
    usable = letters != 0
    border = np.zeros(n + 1, dtype=bool)
    low, high = np.array([0]), np.array([n])
    for _ in range(least):  # strings of one byte more each time
        # an interval of one suffix has one letter before it; of the others all letters are looked up
        many = high - low > 1
        alone = before[low[~many]]
        alone = np.sort(alone[alone >= 0])
        alone = alone[~border[alone + 1]]
        border[alone + 1] = True
        nxt_low, nxt_high = [alone], [alone + 1]
        low, high = low[many], high[many]
        for i in range(0, len(low), BLOCK // 16):
            a, z = (far[x >> 8] + near[x] for x in (low[i : i + BLOCK // 16], high[i : i + BLOCK // 16]))
            which, letter = np.nonzero((z > a) & usable)
            begin, end = first[letter] + a[which, letter], first[letter] + z[which, letter]
            fresh = ~border[end]
            begin, end = begin[fresh], end[fresh]
            end, at = np.unique(end, return_index=True)
            border[end] = True
            nxt_low.append(begin[at])
            nxt_high.append(end)
        low, high = np.concatenate(nxt_low), np.concatenate(nxt_high)
        if not len(low):
            break
    return order, np.cumsum(border[:n])


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _planes(values: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of numbers, all first bytes, then all second ones: what is alike stands together."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T


def _numbers(planes: np.ndarray) -> np.ndarray:
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").reshape(-1)


CHUNKS = "chunk long, n_bytes long, docs binary, sizes binary, raw binary"


def _chunks(batches: Iterator[pa.RecordBatch], most: int):
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1)
            size = int(offsets[end] - offsets[begin])
            raw = pa.compress(texts.buffers()[2].slice(int(offsets[begin]), size), codec="zstd", asbytes=True) if size else b""
            docs, sizes = batch.column(0)[begin:end].to_numpy(), np.diff(offsets[begin : end + 1])
            yield pa.RecordBatch.from_pydict({"chunk": [number], "n_bytes": [size], "docs": [docs.astype("<i8").tobytes()], "sizes": [sizes.astype("<i8").tobytes()], "raw": [raw]})
            number, begin = number + 1, end


def _opened(batch: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray, bytes]:
    chunk, size, docs, sizes, raw = (batch.column(k)[i].as_py() for k in range(5))
    return chunk, np.frombuffer(docs, "<i8"), np.frombuffer(sizes, "<i8"), pa.decompress(raw, size, codec="zstd", asbytes=True) if size else b""


def _by_anchor(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by anchor, places in it where another anchor begins)."""
    order = np.argsort(anchor, kind="stable")
    ordered = anchor[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])


def _anchor_rows(batches: Iterator[pa.RecordBatch], least: int, seed: int, parts: int):
    """A row a part that has any: of each anchor the distance from the one before, the key (0: its windows differ), the smallest id, and how far the largest is from it."""
    for batch in batches:
        for i in range(batch.num_rows):
            chunk, docs, sizes, raw = _opened(batch, i)
            start, stop, doc, anchor = windows_of(raw, sizes, least)
            if not len(start):
                continue
            order, first = _by_anchor(anchor)
            key, ids, anchor = keys_of(raw, start, stop, least, seed)[order], docs[doc[order]], anchor[order][first]
            low, lo = np.minimum.reduceat(key, first), np.minimum.reduceat(ids, first)
            key = np.where(low == np.maximum.reduceat(key, first), low, 0)
            span = np.maximum.reduceat(ids, first).view(np.uint64) - lo.view(np.uint64)
            part, begins = np.unique(anchor * np.uint64(parts) >> np.uint64(ANCHOR_BITS), return_index=True)
            told = []
            for a, z in itertools.pairwise([*begins.tolist(), len(anchor)]):
                steps = np.diff(anchor[a:z], prepend=np.uint64(0))
                told.append(np.concatenate([_planes(v, w).ravel() for v, w in ((steps, 6), (key[a:z], 8), (lo[a:z].view(np.uint64), 8), (span[a:z], 8))]).tobytes())
            yield pa.RecordBatch.from_pydict({"part": part.astype(np.int64), "chunk": pa.array([chunk] * len(part), pa.int64()), "told": told})


def _judged(table: pa.Table) -> pa.Table:
    """Of each anchor of each chunk: 0 nothing to do, 1 settled, 2 to be decided; then the smallest ids of those settled."""
    told = [np.frombuffer(t.as_buffer(), np.uint8).reshape(30, -1) for t in table["told"]]
    order, first = _by_anchor(np.concatenate([np.cumsum(_numbers(t[:6])) for t in told]))
    # a column at a time
    column = lambda k: np.concatenate([_numbers(t[k : k + 8]) for t in told])
    key = column(6)[order]
    least_key = np.minimum.reduceat(key, first)
    one = (least_key == np.maximum.reduceat(key, first)) & (least_key != 0)
    del key, least_key
    hi = column(14)
    least_doc = np.minimum.reduceat(hi.view(np.int64)[order], first)
    hi += column(22)
    hi = hi.view(np.int64)
    shared = least_doc < np.maximum.reduceat(hi[order], first)
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    del order
    code = np.where(shared & ~one, 2, 0).astype(np.uint8)[group]
    code[(shared & one)[group] & (hi > least_doc[group])] = 1
    rows, z = [], 0
    for t in told:
        a, z = z, z + t.shape[1]
        rows.append((code[a:z].tobytes(), _planes(least_doc[group[a:z]][code[a:z] == 1].view(np.uint64), 8).tobytes()))
    return pa.table({"part": table["part"], "chunk": table["chunk"], "code": [r[0] for r in rows], "lows": [r[1] for r in rows]})


HELD = "anchor long, key long, doc_id long, chunk long, start long, n int, bytes binary"


def _rows_of(raw: bytes, start: np.ndarray, stop: np.ndarray, anchor: np.ndarray, docs: np.ndarray, chunks: np.ndarray, places: np.ndarray, least: int, seed: int):
    """Windows of ``raw`` with their bytes; ``places`` are their starts in the chunk."""
    for k in range(0, len(start), BLOCK // 16):
        a, z = start[k : k + BLOCK // 16], stop[k : k + BLOCK // 16]
        size = z - a + least - 1
        at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        told = [x[k : k + BLOCK // 16] for x in (anchor.view(np.int64), docs, chunks, places)]
        columns = [told[0], keys_of(raw, a, z, least, seed).view(np.int64), *told[1:], (z - a).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _binaries(np.frombuffer(raw, np.uint8)[at], size)], fields(HELD))


def _held(batches: Iterator[pa.RecordBatch], least: int, seed: int):
    """Windows to be decided; and a row a chunk without an anchor: ranges of starts that are lost already, as (first, one past the last)."""
    kinds = [*[pa.int64()] * 5, pa.int32(), pa.binary()]
    for batch in batches:
        for i in range(batch.num_rows):
            chunk, docs, sizes, raw = _opened(batch, i)
            start, stop, doc, anchor = windows_of(raw, sizes, least)
            order, first = _by_anchor(anchor)
            parts = sorted(batch.column(5)[i].as_py(), key=lambda r: r["part"])
            code = np.concatenate([np.frombuffer(r["code"], np.uint8) for r in parts])
            low = np.zeros(len(code), np.int64)
            low[code == 1] = np.concatenate([_numbers(np.frombuffer(r["lows"], np.uint8).reshape(8, -1)) for r in parts]).view(np.int64)
            group = np.empty(len(anchor), np.int64)
            group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(anchor))))
            ids = docs[doc]
            gone = np.flatnonzero((code[group] == 1) & (low[group] < ids))
            if len(gone):
                a, z = start[gone], stop[gone]
                apart = a[1:] > z[:-1]
                ranges = np.stack([a[np.append(True, apart)], z[np.append(apart, True)]])
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([None, None, None, chunk, None, None, ranges.astype("<i8").tobytes()], kinds, strict=True)], fields(HELD))
            some = np.flatnonzero(code[group] == 2)
            yield from _rows_of(raw, start[some], stop[some], anchor[some], ids[some], np.full(len(some), chunk), start[some], least, seed)


def _again(batches: Iterator[pa.RecordBatch], least: int, seed: int, gram: int):
    """Windows cut into smaller ones, by the smallest hashes of longer grams. Equal strings still have equal anchors."""
    for batch in batches:
        windows = batch.column(6)
        offsets = np.frombuffer(windows.buffers()[1], np.int32)[windows.offset : windows.offset + len(windows) + 1].astype(np.int64)
        if not len(windows):
            continue
        raw = windows.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes()
        start, stop, row, anchor = windows_of(raw, np.diff(offsets), least, gram)
        docs, chunks, starts = (batch.column(k).to_numpy()[row] for k in (2, 3, 4))
        yield from _rows_of(raw, start, stop, anchor, docs, chunks, starts + start - (offsets[row] - offsets[0]), least, seed)


def _covered(pdf, least: int):
    """Of one place's distinct windows: the smallest id that has the string at each of their starts, where a document loses any; one id if they agree."""
    import pandas as pd

    pdf = pdf.sort_values("anchor", kind="stable")
    windows, anchor = pdf["bytes"].tolist(), pdf["anchor"].to_numpy()
    least_doc, most_doc = pdf["lo"].to_numpy(), pdf["hi"].to_numpy()
    sizes = np.array([len(w) for w in windows])
    slots = least - GRAM + 1
    best = np.full((len(windows), slots), np.iinfo(np.int64).max)
    # cut between anchors into texts to transform
    total = np.cumsum(sizes + 1)
    borders = np.append(np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])), len(windows))
    begin = 0
    for b in range(1, len(borders)):
        end = borders[b]
        if b + 1 < len(borders) and total[borders[b + 1] - 1] - (total[begin - 1] if begin else 0) <= PLACE_BYTES:
            continue
        ids = np.arange(begin, end)
        text = letters_of(windows[begin:end])
        offsets = np.cumsum(sizes[ids] + 1) - sizes[ids] - 1
        order, run = runs_of(text, least)
        run_at = np.empty(len(text), np.int64)
        run_at[order] = run
        owner, slot = np.nonzero(np.arange(slots) <= (sizes[ids] - least)[:, None])
        runs = run_at[offsets[owner] + slot]
        lowest = np.full(int(run.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, runs, least_doc[ids[owner]])
        best[ids[owner], slot] = lowest[runs]
        begin = end
    lost = np.flatnonzero((best < most_doc[:, None]).any(1))
    slots_of = sizes[lost] - least + 1
    constant = np.where(np.arange(slots) < slots_of[:, None], best[lost] == best[lost, :1], True).all(1)
    lows = [best[i, : 1 if one else n] for i, n, one in zip(lost.tolist(), slots_of.tolist(), constant.tolist(), strict=True)]
    return pd.DataFrame({"anchor": anchor[lost], "key": pdf["key"].to_numpy()[lost], "lows": pd.Series(lows, dtype=object)})


def _by_strings(windows: DataFrame, least: int) -> DataFrame:
    """The same as ``_covered``, of any number of windows: their strings are grouped one by one."""
    start = F.explode(F.sequence(F.lit(0), F.length("bytes") - least))
    strings = windows.select("anchor", "key", "lo", "hi", "bytes", start.alias("slot")).select("anchor", "key", "lo", "hi", "slot", F.substring("bytes", F.col("slot") + 1, F.lit(least)).alias("string"))
    # written, so that both sides of the join are plain exchanges and a common string is split
    lowest = saved(strings.groupBy("string").agg(F.min("lo").alias("low")), "strings")
    rows = strings.join(lowest, "string").groupBy("anchor", "key", "hi").agg(F.sort_array(F.collect_list(F.struct("slot", "low"))).alias("lows"))
    return rows.select("anchor", "key", "hi", F.col("lows.low").alias("lows")).where(F.array_min("lows") < F.col("hi")).select("anchor", "key", "lows")


def _decided(windows: DataFrame, least: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(the windows and those cut out of them, the verdicts): of a string, one window that has it has a verdict at most."""
    every, decided, shared = [windows], [], windows
    for gram in (*(g for g in LONGER if g < least), None):
        distinct = saved(shared.groupBy("anchor", "key", "bytes").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "distinct", compression="zstd")
        many = saved(distinct.groupBy("anchor").count().where(F.col("count") > MOST).select("anchor"), "many")
        last = many.isEmpty()
        # enough for every task to have some
        places = max(int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() * 2 * least // GROUP_BYTES))
        placed = (distinct if last else only(distinct, many, "anchor", anti=True)).withColumn("place", F.pmod(F.xxhash64("anchor"), F.lit(places)))
        decided.append(saved(placed.groupBy("place").applyInPandas(lambda pdf: _covered(pdf, least), "anchor long, key long, lows array<bigint>"), "decided", compression="zstd"))
        if not last and gram:
            seed ^= gram
            again = only(every[-1], many, "anchor").select(*fields(HELD)).mapInArrow(lambda it, seed=seed, gram=gram: _again(it, least, seed, gram), HELD)
            every.append(saved(again, "again", compression="zstd"))
            # as before: an anchor of one id takes nothing, one of equal windows is settled
            anchors = saved(every[-1].groupBy("anchor").agg(F.min("key").alias("key"), F.max("key").alias("other"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi"), "anchors", compression="zstd")
            decided.append(anchors.where("key = other").select("anchor", "key", F.array("lo").alias("lows")))
            shared = only(every[-1], anchors.where("key != other"), "anchor")
        elif not last:
            decided.append(saved(_by_strings(only(distinct, many, "anchor"), least), "decided", compression="zstd"))
        discard(distinct, many)
        if last:
            break
    return reduce(DataFrame.union, every), reduce(DataFrame.union, decided)


def _lost(batches: Iterator[pa.RecordBatch]):
    """Bit i of ``lost``: the document loses the string that begins i bytes after the window's start."""
    for batch in batches:
        docs, chunks, starts, n, lows = (batch.column(k) for k in range(5))
        docs, n = docs.to_numpy(), n.to_numpy()
        sizes = np.diff(lows.offsets.to_numpy())
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(docs)), n)
        slot = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        gone = lows.flatten().to_numpy()[first[owner] + np.where(sizes[owner] > 1, slot, 0)] < docs[owner]
        bits = np.zeros(len(docs), np.int64)
        np.add.at(bits, owner[gone], np.int64(1) << slot[gone])
        yield pa.RecordBatch.from_arrays([chunks, starts, pa.array(bits)], ["chunk", "start", "lost"]).filter(pa.array(bits != 0))


def _result(batches: Iterator[pa.RecordBatch], least: int):
    for batch in batches:
        for i in range(batch.num_rows):
            _, docs, sizes, raw = _opened(batch, i)
            edge = np.zeros(len(raw) + 1, np.int32)
            found = batch.column(5)[i]
            if found.is_valid:
                start, lost = (found.values.field(k).to_numpy() for k in range(2))
                for k in range(0, len(start), BLOCK // 16):
                    row, slot = np.nonzero(lost[k : k + BLOCK // 16, None] >> np.arange(least - GRAM + 1) & 1)
                    s = start[k + row] + slot  # each string is in one window
                    edge[s] += 1
                    edge[s + least] -= 1
            for ranges in batch.column(6)[i].as_py() or ():
                a, z = np.frombuffer(ranges, "<i8").reshape(2, -1)
                edge[a] += 1
                np.add.at(edge, z + least - 1, -1)
            cut = np.cumsum(edge[:-1], out=edge[:-1]) > 0
            ends = np.cumsum(sizes)
            begins = cut.copy()
            begins[1:] &= ~cut[:-1]
            # a document's first byte begins a run whatever the document before ends with
            heads = (ends - sizes)[sizes > 0]
            begins[heads] = cut[heads]
            counts, removed_spans = edge, []
            counts[0] = 0
            for x in (cut, begins):
                np.cumsum(x, out=counts[1:])
                removed_spans.append(np.diff(counts[np.concatenate([[0], ends])]).astype(np.int64))
            removed, spans = removed_spans
            kept = _binaries(np.frombuffer(raw, np.uint8)[~cut], sizes - removed)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (docs, sizes, removed, spans)), kept], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, least: int = 50, text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row."""
    if not GRAM < least <= 64:
        raise ValueError("least must be over 24 and at most 64")
    spark, seed = docs.sparkSession, secrets.randbits(64)
    _few_chunks(spark)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("raw"))
    # each table that a later step needs is written, so that the shuffles under it can go
    with shuffles_freed(spark):
        # the texts in it are compressed already
        chunks = saved(texts.mapInArrow(lambda it: _chunks(it, CHUNK_BYTES), CHUNKS), "chunks", compression="none")
        parts = -(-(chunks.agg(F.sum("n_bytes")).first()[0] or 0) // PART_BYTES) or 1
        told = chunks.mapInArrow(lambda it: _anchor_rows(it, least, seed, parts), "part long, chunk long, told binary")
        judged = saved(told.groupBy("part").applyInArrow(_judged, "part long, chunk long, code binary, lows binary"), "judged", compression="zstd")
        per_chunk = judged.groupBy("chunk").agg(F.collect_list(F.struct("part", "code", "lows")).alias("judged"))
        held = saved(chunks.join(per_chunk, "chunk").select(*chunks.columns, "judged").mapInArrow(lambda it: _held(it, least, seed), HELD), "held", compression="zstd")
        discard(judged)
        windows, decided = _decided(held.where("anchor is not null"), least, seed)
    lost = windows.select("anchor", "key", "doc_id", "chunk", "start", "n").join(decided, ["anchor", "key"]).select("doc_id", "chunk", "start", "n", "lows").mapInArrow(_lost, "chunk long, start long, lost long")
    found = lost.groupBy("chunk").agg(F.collect_list(F.struct("start", "lost")).alias("found"))
    ranges = held.where("anchor is null").groupBy("chunk").agg(F.collect_list("bytes").alias("ranges"))
    rows = chunks.join(found, "chunk", "left").join(ranges, "chunk", "left").select(*chunks.columns, "found", "ranges")
    return rows.mapInArrow(lambda it: _result(it, least), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_substring_dedup(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

import hashlib
import os
import time
import tracemalloc

import numpy as np
import pyarrow as pa

from maintspark.llm import substring_dedup
from maintspark.llm.common import read
from maintspark.llm.substring_dedup import op5_substring_dedup, runs_of

from .cases import HARD, clashing, empty, hard


def brute(docs, least=50):
    raws = sorted((d, (t or "").encode()) for d, t in docs)
    low = {}
    for d, r in raws:
        for i in range(len(r) - least + 1):
            low.setdefault(r[i : i + least], d)
    out = {}
    for d, r in raws:
        cut = bytearray(len(r))
        for i in range(len(r) - least + 1):
            if low[r[i : i + least]] < d:
                cut[i : i + least] = b"\1" * least
        kept = bytes(b for b, c in zip(r, cut) if not c)
        out[d] = (len(r), sum(cut), sum(1 for i, c in enumerate(cut) if c and not (i and cut[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_runs_equal_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(20):
        parts = [bytes(rng.integers(97, 100, 30).astype(np.uint8)) for _ in range(3)]
        text = b"\0".join(b"".join(parts[k] for k in rng.integers(0, 3, rng.integers(1, 5))) for _ in range(6)) + b"\0"
        order, run = runs_of(np.frombuffer(text, np.uint8), 50)
        seen = {}
        for i, r in zip(order.tolist(), run.tolist()):
            s = text[i : i + 50]
            if len(s) == 50 and b"\0" not in s:
                assert seen.setdefault(s, r) == r
        assert len(set(seen.values())) == len(seen)


def test_equals_brute_force(spark):
    shared = "this passage of more than fifty bytes is in many of the documents, é and all"
    extra = [shared, "x " + shared, shared + " y", shared[3:60], shared[:49], shared[:50], "ab" * 200, "ba" * 200, "z" * 51, "z" * 300, shared + "?" + shared]
    for docs in (clashing(hard(spark, extra)), read(spark, "/root/testdata/sf0.001", "documents")):
        want = brute([(r.doc_id, r.text) for r in docs.collect()])
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op5_substring_dedup(docs).collect()}
        assert got == want


def test_empty_and_repeated(spark):
    assert op5_substring_dedup(empty(spark)).collect() == []
    assert op5_substring_dedup(hard(spark).union(hard(spark))).count() == 2 * len(HARD)


def test_common_line_is_not_gathered(spark, monkeypatch):
    rng = np.random.default_rng(7)
    line = " licensed to all who read it, without any warranty of any kind, under the terms that are given below. "
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    docs = clashing(hard(spark, [word(90) + line + word(90) for _ in range(600)]))
    gather = substring_dedup._covered

    def bounded(pdf, least):
        size = sum(map(len, pdf["bytes"]))
        if size > 20_000:
            raise ValueError(f"{size} bytes gathered")
        return gather(pdf, least)

    monkeypatch.setattr(substring_dedup, "_covered", bounded)
    monkeypatch.setattr(substring_dedup, "MOST", 50, raising=False)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op5_substring_dedup(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_nul_is_a_byte_like_others(spark):
    shared = "shared text of thirty-odd bytes before"
    tails = ["then something else follows in this one, to the end", "but here it goes on in another way, for a while", "then something else follows in this one, and stops"]
    docs = clashing(hard(spark, [a + shared + "\0" + t for a in ("", "x\0") for t in tails] + ["\0" * 120, "\0" * 60 + "y"]))
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op5_substring_dedup(docs).collect()} == want
    every = [bytes(range(256)), bytes(range(100)) + bytes(range(255, 99, -1)), bytes(range(60))]
    text = substring_dedup.letters_of(every)
    order, run = runs_of(text, 50)
    run_at, ends, seen = dict(zip(order.tolist(), run.tolist())), np.cumsum([len(w) + 1 for w in every]), {}
    for w, end in zip(every, ends.tolist()):
        for i in range(len(w) - 49):
            assert seen.setdefault(w[i : i + 50], run_at[end - len(w) - 1 + i]) == run_at[end - len(w) - 1 + i]
    assert len(set(seen.values())) == len(seen)


def test_one_id_with_different_texts(spark):
    passage = "a passage of more than fifty bytes that comes back in another document, word by word"
    rows = [(0, passage), (1, "some words before it: " + passage), (1, "short text"), (1, passage + " and an end"), (1, passage + " and an end"), (None, passage), (2, passage)]
    docs = clashing(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], hard(spark).schema))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op5_substring_dedup(docs).collect())
    ids = [(-1 if i is None else i, (t or "").encode()) for i, t in rows]
    low = {}
    for d, raw in sorted(ids):
        for i in range(len(raw) - 49):
            low.setdefault(raw[i : i + 50], d)
    want = []
    for d, raw in ids:
        cut = {i + k for i in range(len(raw) - 49) if low[raw[i : i + 50]] < d for k in range(50)}
        kept = bytes(b for i, b in enumerate(raw) if i not in cut)
        want.append((d, len(raw), len(cut), sum(1 for i in cut if i - 1 not in cut), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)


def test_each_string_is_in_one_window_and_equal_ones_share_the_anchor():
    rng = np.random.default_rng(8)
    parts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (30, 55, 80, 200)] + [b"z" * 300, b"ab" * 70, b"", b"\0" * 90]
    raws = [b"".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 6))) for _ in range(60)] + [b"", b"x" * 49, b"x" * 50]
    sizes = np.array([len(r) for r in raws])
    raw, begins = b"".join(raws), np.cumsum(sizes) - sizes
    start, stop, doc, anchor = substring_dedup.windows_of(raw, sizes, 50)
    key = substring_dedup.keys_of(raw, start, stop, 50, 7)
    seen, known, strings = {}, {}, []
    for a, z, d, x, k in zip(*(v.tolist() for v in (start, stop, doc, anchor, key)), strict=True):
        assert 0 < z - a <= 27 and begins[d] <= a and z + 49 <= begins[d] + sizes[d]
        assert known.setdefault(k, raw[a : z + 49]) == raw[a : z + 49]
        strings += range(a, z)
        assert all(seen.setdefault(raw[i : i + 50], x) == x for i in range(a, z))
    assert len(known) == len({raw[a : z + 49] for a, z in zip(start.tolist(), stop.tolist())})
    assert strings == [b + i for b, n in zip(begins.tolist(), sizes.tolist()) for i in range(n - 49)]


def test_whole_copies_write_no_row_a_window(spark, monkeypatch):
    """Anchors of one document or of equal windows are neither written nor shuffled one by one; the chunks and parts are many."""
    rng = np.random.default_rng(9)
    texts = [bytes(rng.integers(97, 123, 3000).astype(np.uint8)).decode() for _ in range(40)]
    docs = clashing(hard(spark, texts + texts[:20] + [texts[0][:1000] + "?" + texts[1][:1000]]))
    save, written = substring_dedup.saved, []
    monkeypatch.setattr(substring_dedup, "saved", lambda df, *a, **b: (out := save(df, *a, **b), written.append(out.count()))[0])
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 20_000, raising=False)
    monkeypatch.setattr(substring_dedup, "PART_BYTES", 50_000, raising=False)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op5_substring_dedup(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(written) < 1000  # the texts have about 13,000 windows


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_arrays_of_a_worker_stay_small():
    """Two megabytes of text, or one transform of 120,000 bytes over a hundred letters; the text's own arrays are 8 bytes a byte."""
    rng = np.random.default_rng(10)
    raw, sizes = bytes(rng.integers(32, 127, 2_000_000).astype(np.uint8)), np.full(1000, 2000)
    start, stop, doc, anchor = substring_dedup.windows_of(raw, sizes, 50)
    assert peak_mb(lambda: substring_dedup.windows_of(raw, sizes, 50)) < 40
    windows = [raw[a : z + 49] for a, z in zip(start[:1600].tolist(), stop[:1600].tolist())]
    assert peak_mb(lambda: runs_of(substring_dedup.letters_of(windows), 50)) < 45
    lost = [{"start": int(a), "lost": (1 << int(z - a)) - 1} for a, z in zip(start, stop)]
    found = pa.array([lost], pa.list_(pa.struct([("start", pa.int64()), ("lost", pa.int64())])))
    chunk = [pa.array([0]), pa.array([len(raw)]), pa.array([np.arange(1000).tobytes()]), pa.array([sizes.tobytes()]), pa.array([pa.compress(raw, codec="zstd", asbytes=True)])]
    batch = pa.RecordBatch.from_arrays([*chunk, found, pa.nulls(1, pa.list_(pa.binary()))], ["chunk", "n_bytes", "docs", "sizes", "raw", "found", "ranges"])
    assert next(substring_dedup._result(iter([batch]), 50)).column(2).to_pylist() == [2000] * 1000
    assert peak_mb(lambda: list(substring_dedup._result(iter([batch]), 50))) < 40


def test_a_batch_has_few_chunks(spark, monkeypatch):
    rng = np.random.default_rng(11)
    texts = [bytes(rng.integers(97, 123, 3000).astype(np.uint8)).decode() for _ in range(40)]
    docs = clashing(hard(spark, texts + texts[:20])).coalesce(1)
    result = substring_dedup._result

    def bounded(batches, least):
        def looked_at():
            for batch in batches:
                if batch.num_rows > 1 and sum(map(len, batch.column(4).to_pylist())) > 100_000:
                    raise ValueError(f"{batch.num_rows} chunks in a batch")
                yield batch

        return result(looked_at(), least)

    monkeypatch.setattr(substring_dedup, "_result", bounded)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 7_000)
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", "30k", raising=False)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op5_substring_dedup(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_windows_cut_again_keep_each_string_once_and_equal_ones_together():
    rng = np.random.default_rng(12)
    parts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (30, 55, 80, 200)] + [b"z" * 300, b"ab" * 70, b"\0" * 90]
    raws = [b"".join(parts[k] for k in rng.integers(0, len(parts), 4)) for _ in range(60)]
    raw, sizes = b"".join(raws), np.array([len(r) for r in raws])
    start, stop, doc, anchor = substring_dedup.windows_of(raw, sizes, 50)
    (batch,) = substring_dedup._rows_of(raw, start[:4000], stop[:4000], anchor[:4000], doc[:4000], doc[:4000] + 7, start[:4000], 50, 1)
    batch = batch.slice(11)
    for gram in substring_dedup.LONGER:
        seen, strings = {}, []
        for row in (r for b in substring_dedup._again(iter([batch, batch.slice(0, 0)]), 50, 2, gram) for r in b.to_pylist()):
            assert 0 < row["n"] <= 51 - gram and row["bytes"] == raw[row["start"] : row["start"] + row["n"] + 49] and row["chunk"] == row["doc_id"] + 7
            strings += range(row["start"], row["start"] + row["n"])
            assert all(seen.setdefault(raw[i : i + 50], row["anchor"]) == row["anchor"] for i in strings[-row["n"] :])
        assert sorted(strings) == [i for r in batch.to_pylist() for i in range(r["start"], r["start"] + r["n"])]


def test_windows_of_a_common_anchor_write_no_row_a_string(spark, monkeypatch):
    rng = np.random.default_rng(13)
    line = " licensed to all who read it, without any warranty of any kind, under the terms that are given below. "
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    docs = clashing(hard(spark, [word(90) + line + word(90) for _ in range(600)]))
    save, written = substring_dedup.saved, {}
    monkeypatch.setattr(substring_dedup, "saved", lambda df, name, *a, **b: (out := save(df, name, *a, **b), written.update({name: written.get(name, 0) + out.count()}))[0])
    monkeypatch.setattr(substring_dedup, "MOST", 50)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op5_substring_dedup(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert written.get("strings", 0) < 4_000  # the windows of anchors that the documents share have some 20,000 strings


def test_shuffles_go_when_their_query_ends(spark, monkeypatch):
    """And not when the driver's JVM collects what refers to them, which a later query may not wait for."""
    def shuffles():
        tops = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
        return {name for top in tops for _, _, names in os.walk(top) for name in names if name.startswith("shuffle_")}

    save, left = substring_dedup.saved, {}

    def looked_at(df, name, *a, **b):
        before, out, until = shuffles(), save(df, name, *a, **b), time.time() + 3
        while (found := shuffles() - before) and time.time() < until:
            time.sleep(0.1)
        left[name] = len(found)
        return out

    monkeypatch.setattr(substring_dedup, "saved", looked_at)
    assert op5_substring_dedup(hard(spark)).count() == len(HARD)
    assert left["judged"] == left["held"] == left["distinct"] == left["decided"] == 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"

import hashlib
import zlib

import numpy as np
import pytest

from maintspark.llm import media
from maintspark.llm.common import read

from .cases import clashing, empty, hard


def test_streams_round_trip():
    rng = np.random.default_rng(3)
    payloads = [bytes([255]) * 576, bytes(576 * 3), rng.integers(0, 256, 576 * 5, dtype=np.uint8).tobytes(), (b"some words of plain text " * 200)[: 576 * 7], bytes(range(256)) * 9]
    streams = media.encode(payloads)
    assert media.decode(streams) == payloads
    assert media.encode(payloads[3:4]) == streams[3:4]
    assert len(streams[3]) < len(payloads[3]) + 300
    assert media.seek(streams[2], 576 * 4 + 7) == (576 * 4, payloads[2][576 * 4 :])


def test_many_frames_have_long_numbers():
    payload = b"abc" * 192 * 2200
    (stream,) = media.encode([payload])
    assert media.decode([stream]) == [payload]
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 1 << 20):
        head = media._header(n)
        assert head[4:-1].decode("utf-8", "surrogatepass") == chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else True


def test_damage_is_found():
    (stream,) = media.encode([b"hello world " * 48])
    for at in (len(stream) - 1, len(stream) - 40, len(stream) - 5):
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            media.decode([bytes(bad)])


def test_digests_equal_brute_force(spark):
    for docs in (clashing(hard(spark)), read(spark, "/root/testdata/sf0.01", "documents")):
        texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        rows = media.op4_media(docs).collect()
        assert len(rows) == len(texts)
        for r in rows:
            raw = (texts[r.doc_id] or "").encode()
            payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert media.op4_media(empty(spark)).collect() == []


def test_copies_are_stored_once(spark):
    docs = hard(spark, extra=["", "one", "one"])
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(docs.selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars").where("text = 'one' or length(text) = 70000"))
    single, shared, again = media.store_distinct(docs)
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    repeated = {t for _, t in texts if sum(u == t for _, u in texts) > 1}
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, t in texts if t not in repeated)
    assert again.count() == sum(t in repeated for _, t in texts) and {bytes(r.key) for r in shared.collect()} == {hashlib.sha256(t.encode()).digest() for t in repeated}
    rows = media.op4_media(docs).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.payload_sha256) for r in rows)
    assert got == sorted((i is None, i or 0, hashlib.sha256(media.padded(t)[1]).hexdigest()) for i, t in texts)


def test_blocks(spark):
    blocks = media.read_blocks(media.store_media(hard(spark))).collect()
    got = {}
    for b in sorted(blocks, key=lambda b: (b.doc_id, b.sample_offset)):
        assert b.sample_offset == len(got.get(b.doc_id, b""))
        got[b.doc_id] = got.get(b.doc_id, b"") + bytes(b.pcm)
    assert all(got[r.doc_id] == media.padded(r.text)[1] for r in hard(spark).collect())

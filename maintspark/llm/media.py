"""Audio held in a binary column as FLAC: mono, 8 bits a sample, blocks of 576 samples.

The encoder picks for each block the cheapest of constant, verbatim, fixed and linear
prediction with Rice-coded residuals. The decoder reads the stream headers, finds the
frames by the seek table (one point a frame, so any sample can be reached), checks each
header's CRC-8, each frame's CRC-16 and the stream's MD5, and decodes many frames in step:
the i-th residual of all of them at once.

Null and empty payloads count as empty and are padded to one block. Equal payloads give
equal streams, which the query stores once. Repeated rows are kept; extra columns, whatever
their names, are left out; an empty table gives an empty result. A stream that fails
a check raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_KEYS, saved

BLOCK = 576
RATE = 8000
PAD = 255
LPC_ORDER, LPC_PRECISION, LPC_SHIFT = 4, 8, 5
#: The predictors of the format's fixed orders 0, 1 and 2.
FIXED = {0: (), 1: (1,), 2: (2, -1)}
#: Frames that are coded in step; bounds the working memory.
STEP_FRAMES = 2500


def _table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly) & mask if crc & top else (crc << 1) & mask
        out.append(crc)
    return np.array(out, dtype=np.uint32)


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def _crc(raw: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of many byte ranges, one byte of each at a time."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    crc = np.zeros(len(start), dtype=np.uint32)
    mask, down = np.uint32((1 << bits) - 1), np.uint32(bits - 8)
    live = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
    for i, n in enumerate(live.tolist()):
        crc[:n] = (crc[:n] << np.uint32(8) & mask) ^ table[crc[:n] >> down ^ raw[start[:n] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number_bytes(n: int) -> bytes:
    """A frame number in the format's variable-length form."""
    if n < 0x80:
        return bytes([n])
    extra = next(k for k in range(1, 7) if n < 1 << (5 * k + 6)) if n >= 0x800 else 1
    return bytes([0xFF << (7 - extra) & 0xFF | n >> (6 * extra), *(0x80 | n >> (6 * j) & 0x3F for j in reversed(range(extra)))])


def _header(number: int) -> bytes:
    head = b"\xff\xf8" + bytes([0x2 << 4 | 0x4, 0x1 << 1]) + _number_bytes(number)
    crc = 0
    for b in head:
        crc = int(CRC8[crc ^ b])
    return head + bytes([crc])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return np.where(r >= 0, 2 * r, -2 * r - 1)


def _rice_cost(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best Rice parameter of each row, and the bits with it."""
    costs = np.stack([(u >> k).sum(1) + u.shape[1] * (k + 1) for k in range(9)])
    return costs.argmin(0), costs.min(0)


def _lpc(s: np.ndarray) -> np.ndarray:
    """Quantised predictor coefficients of each row, by Levinson's recursion."""
    x = s.astype(np.float64)
    lags = np.stack([(x[:, : BLOCK - j] * x[:, j:]).sum(1) for j in range(LPC_ORDER + 1)], 1)
    error = lags[:, 0] * (1 + 1e-6) + 1e-3
    a = np.zeros((len(s), LPC_ORDER))
    for i in range(LPC_ORDER):
        k = (lags[:, i + 1] - (a[:, :i] * lags[:, i:0:-1]).sum(1)) / error
        b = a.copy()
        b[:, i] = k
        b[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a, error = b, error * (1 - k * k)
    most = (1 << (LPC_PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << LPC_SHIFT)), -most, most).astype(np.int64)


def _predict(s: np.ndarray, coefs: np.ndarray, shift: int) -> np.ndarray:
    p = coefs.shape[1]
    total = np.zeros((len(s), BLOCK - p), dtype=np.int64)
    for j in range(p):
        total += coefs[:, j : j + 1] * s[:, p - 1 - j : BLOCK - 1 - j]
    return total >> shift


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Writes a number of each frame; the place after it."""
    for j in range(width):
        bits[at + j] = values >> (width - 1 - j) & 1
    return at + width


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """The FLAC frames of rows of 576 samples in -128..127."""
    s = samples.astype(np.int64)
    n = len(s)
    options = []  # (type code, order, coefficients, shift, zigzag residuals, k, bits)
    for order, c in FIXED.items():
        coefs = np.tile(np.array(c, dtype=np.int64).reshape(1, -1), (n, 1))
        u = _zigzag(s[:, order:] - _predict(s, coefs, 0))
        k, cost = _rice_cost(u)
        options.append((0b001000 | order, order, None, u, k, cost + 8 * order + 10))
    coefs = _lpc(s)
    u = _zigzag(s[:, LPC_ORDER:] - _predict(s, coefs, LPC_SHIFT))
    k, cost = _rice_cost(u)
    options.append((0b100000 | LPC_ORDER - 1, LPC_ORDER, coefs, u, k, cost + 8 * LPC_ORDER + 9 + LPC_ORDER * LPC_PRECISION + 10))
    costs = np.stack([np.where((s == s[:, :1]).all(1), 8, 1 << 40), np.full(n, 8 * BLOCK), *(o[-1] for o in options)])
    pick, body = costs.argmin(0), 8 + costs.min(0)

    heads = [_header(int(i)) for i in numbers]
    head_len = np.array([len(h) for h in heads])
    frame_len = head_len + (body + 7) // 8 + 2
    start = np.concatenate([[0], np.cumsum(frame_len)])
    bits = np.zeros(int(start[-1]) * 8, dtype=np.uint8)
    first = 8 * (start[:-1] + head_len)
    for which in range(len(options) + 2):
        rows = np.flatnonzero(pick == which)
        if not len(rows):
            continue
        zero = np.zeros(len(rows), dtype=np.int64)
        if which < 2:
            at = _put(bits, first[rows], zero + which, 7) + 1
            for j in range(1 if which == 0 else BLOCK):
                at = _put(bits, at, s[rows, j] & 0xFF, 8)
            continue
        code, order, coefs, u, k, _ = options[which - 2]
        at = _put(bits, first[rows], zero + code, 7) + 1
        for j in range(order):
            at = _put(bits, at, s[rows, j] & 0xFF, 8)
        if coefs is not None:
            at = _put(bits, at, zero + LPC_PRECISION - 1, 4)
            at = _put(bits, at, zero + LPC_SHIFT, 5)
            for j in range(order):
                at = _put(bits, at, coefs[rows, j] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
        u, k = u[rows], k[rows, None]
        at = _put(bits, at, zero, 6)
        at = _put(bits, at, k[:, 0], 4)
        width = (u >> k) + 1 + k
        stop = at[:, None] + np.cumsum(width, 1) - 1 - k
        bits[stop] = 1
        for j in range(int(k.max())):
            some = k[:, 0] > j
            bits[stop[some] + k[some] - j] = u[some] >> j & 1
    raw = np.packbits(bits)
    for j in range(int(head_len.max())):
        some = head_len > j
        raw[start[:-1][some] + j] = [h[j] for h in heads if len(h) > j]
    crc = _crc(raw, start[:-1], frame_len - 2, CRC16, 16)
    raw[start[1:] - 2], raw[start[1:] - 1] = crc >> 8, crc & 0xFF
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def padded(text: str | bytes | None) -> tuple[int, bytes]:
    """(bytes without padding, payload): bytes 255 up to a positive multiple of the block."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text or b"")
    return len(raw), raw + bytes([PAD]) * ((-len(raw)) % BLOCK if raw else BLOCK)


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    samples = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    sizes = [len(f) for f in frames]
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(samples).digest()
    seek, at = bytearray(), 0
    for i, size in enumerate(sizes):
        seek += struct.pack(">QQH", i * BLOCK, at, BLOCK)
        at += size
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + bytes(seek) + b"".join(frames)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload, whose bytes less 128 are the samples."""
    frames: list[bytes] = []
    blocks = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    counts = [len(p) // BLOCK for p in payloads]
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.empty(0, int)
    for i in range(0, len(blocks), STEP_FRAMES):
        frames += encode_frames(blocks[i : i + STEP_FRAMES].astype(np.int16) - 128, numbers[i : i + STEP_FRAMES])
    out, at = [], 0
    for payload, c in zip(payloads, counts, strict=True):
        out.append(_stream(payload, frames[at : at + c]))
        at += c
    return out


class Bits:
    """Reads numbers at many bit places of one byte string at once."""

    def __init__(self, raw: np.ndarray):
        wide = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.window = wide[:-4] << np.uint32(24) | wide[1:-3] << np.uint32(16) | wide[2:-2] << np.uint32(8) | wide[3:-1]
        bits = np.unpackbits(raw)
        self.ones = np.concatenate([np.flatnonzero(bits), [8 * len(raw)]]).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(bits, dtype=np.int32)]).astype(np.int32)

    def get(self, at: np.ndarray, width) -> np.ndarray:
        """Numbers of up to 24 bits."""
        width = np.asarray(width)
        return (self.window[at >> 3].astype(np.int64) >> (32 - (at & 7) - width)) & ((1 << width) - 1)

    def next_one(self, at: np.ndarray) -> np.ndarray:
        return self.ones[self.before[at]].astype(np.int64)


def decode_frames(raw: np.ndarray, start: np.ndarray, length: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The samples of many frames, after their checksums were verified."""
    n = len(start)
    end = start + length
    if n == 0:
        return np.empty((0, BLOCK), np.int64)
    lead = raw[start + 4].astype(np.int64)
    extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    head = 5 + extra
    sync = (raw[start] == 0xFF) & (raw[start + 1] == 0xF8) & (raw[start + 2] == 0x24) & (raw[start + 3] == 0x02)
    if not (sync.all() and (_crc(raw, start, head, CRC8, 8) == raw[start + head]).all()):
        raise ValueError("FLAC: a frame header is damaged")
    if not (_crc(raw, start, length - 2, CRC16, 16) == (raw[end - 2].astype(np.uint32) << 8 | raw[end - 1])).all():
        raise ValueError("FLAC: a frame is damaged")
    number = np.where(extra == 0, lead, lead & (0x3F >> extra))
    for j in range(int(extra.max())):
        number = np.where(extra > j, number << 6 | raw[np.minimum(start + 5 + j, len(raw) - 1)] & 0x3F, number)
    if not (number == numbers).all():
        raise ValueError("FLAC: frames are out of order")
    bits = Bits(raw)
    first = 8 * (start + head + 1)
    kind = bits.get(first, 8) >> 1
    out = np.empty((n, BLOCK), dtype=np.int64)
    signed = lambda v, w: v - ((v >> (w - 1) & 1) << w)
    for code in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == code)
        at = first[rows] + 8
        if code < 2:
            for j in range(BLOCK):
                out[rows, j] = signed(bits.get(at, 8), 8)
                at = at + 8 * code
            continue
        if not (8 <= code <= 12 or code >= 32):
            raise ValueError("FLAC: a reserved subframe type")
        order = code - 31 if code >= 32 else code - 8
        history = []
        for _ in range(order):
            history.append(signed(bits.get(at, 8), 8))
            at = at + 8
        shift = np.zeros(len(rows), np.int64)
        coefs = [np.full(len(rows), c) for c in {3: (3, -3, 1), 4: (4, -6, 4, -1), **FIXED}[order]] if code < 32 else []
        if code >= 32:
            precision, shift = bits.get(at, 4) + 1, bits.get(at + 4, 5)
            at = at + 9
            for _ in range(order):
                c = bits.get(at, precision)
                coefs.append(c - ((c >> (precision - 1) & 1) << precision))
                at = at + precision
        if bits.get(at, 6).any():
            raise ValueError("FLAC: a residual coding that isn't read here")
        k = bits.get(at + 6, 4)
        at = at + 10
        low, done = (1 << k) - 1, np.empty((BLOCK, len(rows)), dtype=np.int64)
        for j in range(order):
            done[j] = history[j]
        for i in range(order, BLOCK):
            stop = bits.next_one(at)
            here = stop + 1
            u = (stop - at) << k | (bits.window[here >> 3].astype(np.int64) >> (32 - (here & 7) - k)) & low
            at = here + k
            total = (u >> 1) ^ -(u & 1)
            if order:
                guess = coefs[0] * done[i - 1]
                for j in range(1, order):
                    guess += coefs[j] * done[i - 1 - j]
                total += guess >> shift
            done[i] = total
        out[rows] = done.T
    return out


def _parse(stream: bytes) -> tuple[int, bytes, list[tuple[int, int]], int]:
    """(samples, MD5, seek points as (sample, offset), place of the first frame)."""
    if stream[:4] != b"fLaC":
        raise ValueError("FLAC: no stream marker")
    at, last, total, md5, points = 4, False, 0, b"", []
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            total, md5 = int.from_bytes(body[10:18], "big") & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            points = [struct.unpack_from(">QQ", body, i) for i in range(0, size, 18)]
        at += 4 + size
    return total, md5, points, at


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream, verified by frame checksums and by its MD5."""
    starts, lengths, numbers, wants = [], [], [], []
    base = 0
    for stream in streams:
        total, md5, points, at = _parse(stream)
        offsets = [base + at + o for _, o in points] + [base + len(stream)]
        starts += offsets[:-1]
        lengths += [b - a for a, b in zip(offsets, offsets[1:], strict=False)]
        numbers += [p // BLOCK for p, _ in points]
        wants.append((total, md5, len(points)))
        base += len(stream)
    raw = np.frombuffer(b"".join(streams), np.uint8)
    parts = []
    for i in range(0, len(starts), STEP_FRAMES):
        s, n = np.array(starts[i : i + STEP_FRAMES]), np.array(lengths[i : i + STEP_FRAMES])
        lo, hi = int(s[0]), int(s[-1] + n[-1])
        parts.append((decode_frames(raw[lo:hi], s - lo, n, np.array(numbers[i : i + STEP_FRAMES])) & 0xFF).astype(np.uint8))
    pcm = np.concatenate(parts) if parts else np.empty((0, BLOCK), np.uint8)
    out, at = [], 0
    for total, md5, count in wants:
        samples = pcm[at : at + count].tobytes()
        at += count
        if len(samples) != total or hashlib.md5(samples).digest() != md5:
            raise ValueError("FLAC: the samples don't match the stream's sum")
        out.append((np.frombuffer(samples, np.uint8) ^ 0x80).tobytes())
    return out


def _slices(batch: pa.RecordBatch, column: int, most: int = 1 << 21) -> Iterator[tuple[int, list]]:
    """(first row, values) of bounded size."""
    held, size, first = [], 0, 0
    for i, v in enumerate(batch.column(column)):
        v = v.as_py()
        held.append(v)
        size += len(v or "")
        if size >= most:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of an id or a key and a text: the same with n_bytes and the stream."""
    for batch in batches:
        for first, texts in _slices(batch, 1):
            sized = [padded(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([n for n, _ in sized], pa.int64()), pa.array(encode([p for _, p in sized]), pa.binary())], [batch.schema.names[0], "n_bytes", "media"])


def store_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and ``media``: each text's bytes as a FLAC stream in a binary column."""

    return docs.selectExpr("cast(doc_id as long) doc_id", f"`{text_col}` text").mapInArrow(_coded, "doc_id long, n_bytes long, media binary")


def read_blocks(media: DataFrame) -> DataFrame:
    """PCM blocks of a media column: doc_id, sample_offset, pcm (unsigned 8-bit), one row a block."""

    def rows(batches):
        for batch in batches:
            for first, streams in _slices(batch, 1):
                for i, payload in enumerate(decode(streams)):
                    offsets = list(range(0, len(payload), BLOCK))
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[first + i].as_py()] * len(offsets), pa.int64()), pa.array(offsets, pa.int64()), pa.array([payload[o : o + BLOCK] for o in offsets], pa.binary())], ["doc_id", "sample_offset", "pcm"])

    return media.selectExpr("cast(doc_id as long) doc_id", "media").mapInArrow(rows, "doc_id long, sample_offset long, pcm binary")


def seek(stream: bytes, sample: int) -> tuple[int, bytes]:
    """(first sample, PCM) of the one block that holds a sample; other blocks aren't decoded."""
    total, _, points, at = _parse(stream)
    if not 0 <= sample < total:
        raise ValueError("FLAC: no such sample")
    i = sample // BLOCK
    end = points[i + 1][1] if i + 1 < len(points) else len(stream) - at
    raw = np.frombuffer(stream[at + points[i][1] : at + end], np.uint8)
    block = decode_frames(raw, np.array([0]), np.array([len(raw)]), np.array([i]))
    return i * BLOCK, ((block & 0xFF).astype(np.uint8) ^ 0x80).tobytes()


def features(payload: bytes) -> str:
    """Level, loudness, sign changes and peak of the samples, from integer sums."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"blocks={len(x) // BLOCK};mean={x.sum() / len(x):.4f};rms={(np.dot(x, x) / len(x)) ** 0.5:.4f};changes={changes};peak={int(np.abs(x).max())}"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of an id or a key, n_bytes and media."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        for first, streams in _slices(batch, 2):
            got, n = decode(streams), len(streams)
            sha = lambda items: pa.array([hashlib.sha256(x).hexdigest() for x in items])
            columns = [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array([len(p) for p in got], pa.int64()), sha(got), pa.array([zlib.crc32(p[-32:]) for p in got], pa.int64())]
            columns += [pa.array([len(s) for s in streams], pa.int64()), sha(streams), pa.array([features(p) for p in got])]
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], *names])


#: Repeated texts whose digests are broadcast at most: about 300 bytes each.
MOST_DIGESTS = 50_000


def store_distinct(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables in the shared folder's terms: streams of texts that one row has (doc_id, n_bytes,
    media), streams of texts that several have (key, n_bytes, media), and the rows of those (doc_id, key).

    ``key`` is the text's SHA-256. A shared text is coded for the row with the smallest doc_id only;
    repeated rows of one doc_id and text store it once each.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), text.alias("text"))
    keys = saved(whole.drop("text"), "media-keys")
    again = saved(keys.groupBy("key").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "media-repeated")
    small = again.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    again = F.broadcast(again) if small else again
    single = whole.join(again, "key", "left_anti").select("doc_id", "text")
    firsts = whole.join(again, "key").where(F.col("doc_id").eqNullSafe(F.col("_first"))).select("key", "text")
    single = saved(single.mapInArrow(_coded, "doc_id long, n_bytes long, media binary"), "media", compression="zstd")  # seek tables repeat themselves
    shared = saved(firsts.mapInArrow(_coded, "key binary, n_bytes long, media binary"), "media-shared", compression="zstd")
    return single, shared, keys.join(again.select("key"), "key", "left_semi").select("doc_id", "key")


def op4_media(docs: DataFrame) -> DataFrame:
    """The digests of what is read back from the written media column; only those bytes are decoded. Rows of one text share what is stored for it."""
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    single, shared, again = store_distinct(docs)
    small = shared.select("key").limit(MOST_DIGESTS + 1).count() <= MOST_DIGESTS
    digests = shared.mapInArrow(_digest, f"key binary, {schema}").dropDuplicates(["key"])
    return single.mapInArrow(_digest, f"doc_id long, {schema}").unionByName(again.join(F.broadcast(digests) if small else digests, "key").drop("key"))

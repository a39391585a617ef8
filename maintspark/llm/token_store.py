"""Token ids in a compact binary column format.

A shard (one partition, ascending doc_id) is a run of blocks. A block has its own
table of ids, most frequent first; the ids are written as ranks in that table with a
byte-aligned variable-length code whose 2-bit lengths stand apart in control bytes
(four to a byte). Blocks are self-contained, so any task can decode any block.

Ties and repeated rows: rows are ordered by doc_id, then text; each row is kept.
Null text is the empty text: only the end id. An empty table gives an empty store.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path

END_ID = 2
#: Ids in a block, at which it is closed; a longer document is a block of its own.
BLOCK_IDS = 1 << 19
#: Chunks of a generation that a worker remembers, about 200 bytes each; two generations at most.
CACHE_CHUNKS = 800_000
BLOCK_SCHEMA = "shard int, start_in_shard long, n_ids long, doc_ids binary, lengths binary, table binary, control binary, data binary"
#: Where a piece of the byte-level pattern always begins: a space between two characters that aren't white space.
_GAP = re.compile(r"(?<=\S)(?= \S)")
#: Texts in these letters are cut into pieces here; others by the tokenizer.
_PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")
#: Fixed value: the byte-level pattern, for these letters and without white space but one leading space.
_PIECE = re.compile("'(?:[sdmt]|ll|ve|re)| ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+| ?[0-9]+| ?[^ A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")


def _byte_names() -> str:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return "".join(chr(b if b in shown else 256 + hidden.index(b)) for b in range(256))


_BYTE_NAMES = _byte_names()
#: Letters below this are letters to the tokenizer and to Python alike.
LAST_PLAIN = "\u0180"
#: Marks after a word that are a piece by themselves.
ENDINGS = frozenset(".,;:!?")

#: Bytes of each of the four values of a control byte.
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], dtype=np.uint8)


class Known(dict):
    """Ids by chunk without the ``before`` that it begins with; a missing one comes from the generation before, or is encoded."""

    def __init__(self, encode, before, older):
        self.encode, self.before, self.older = encode, before, older

    def __missing__(self, chunk: str) -> bytes:
        got = self.older.get(chunk)
        if got is None:
            got = self.encode(self.before, chunk)
        self[chunk] = got
        return got

    def renewed(self) -> Known:
        """A generation after this one, which is the last before it."""
        self.older = {}
        return Known(self.encode, self.before, self)


class Encoder:
    """Encodes texts with a public tokenizer, remembering the ids of word-sized chunks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # chunks as they are, and words that have a space before them
        self.plain, self.spaced = Known(self._ids, "", {}), Known(self._ids, " ", {})

    def _pieces(self, text: str) -> list[bytes]:
        """Ids of pieces whose ids, put together, are the ids of the text: words with the space before them, and line ends."""
        if not text:
            return []
        plain, spaced = self.plain.__getitem__, self.spaced.__getitem__
        out = []
        for line in text.split("\n"):
            words, gaps = line.split(), line.count(" ")
            # as many words as single spaces make, and no other white space
            if len(words) != gaps + 1 or len(line) != len("".join(words)) + gaps:
                return [plain(chunk) for chunk in _GAP.split(text)]
            if out:
                out.append(plain("\n"))
            out.append(plain(words[0]))
            out += map(spaced, words[1:])
        return out

    def _ids(self, before: str, word: str) -> bytes:
        if word.isalpha() and (word.isascii() or max(word) < LAST_PLAIN):  # most are one run of letters
            return self._piece(before + word)
        if word[-1:] in ENDINGS and word[:-1].isalpha():
            return (self.spaced if before else self.plain)[word[:-1]] + self.plain[word[-1]]
        chunk = before + word
        if not _PLAIN.fullmatch(word[1:] if word[0] == " " else word) or any(s in chunk for s in self.special):
            return np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
        pieces = _PIECE.findall(chunk)
        return b"".join(map(self.plain.__getitem__, pieces)) if len(pieces) > 1 else self._piece(chunk)

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece, by the tokenizer's model."""
        named = codecs.charmap_decode(piece.encode(), "strict", _BYTE_NAMES)[0]
        return array("I", [t.id for t in self.model.tokenize(named)]).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.plain) + len(self.spaced) > CACHE_CHUNKS:
            self.plain, self.spaced = self.plain.renewed(), self.spaced.renewed()
        return [np.frombuffer(b"".join(self._pieces(t)), dtype="<u4") for t in texts]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One of a worker's lifetime: it keeps its ids from task to task."""
    return Encoder(path)


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(table, control, data) of one block of ids; ids of equal frequency rank by number."""
    counts = np.bincount(ids)
    values = np.flatnonzero(counts).astype(np.uint32)
    order = values[np.argsort(-counts[values], kind="stable")]
    rank_of = np.empty(len(counts), dtype=np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    ranks = rank_of[ids]
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ids) // 4) * 4, dtype=np.uint8)
    codes[: len(ids)] = length - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    keep = np.arange(4) < length[:, None]
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[keep]
    return order.astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(n: int, table: bytes, control: bytes, data: bytes) -> np.ndarray:
    """The ids of a block: lengths from the control bytes by table lookup, then one gather for each byte place."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(length, dtype=np.int64) - length
    raw = np.frombuffer(data, np.uint8)
    ranks = raw[at].astype(np.uint32)
    for place in (1, 2, 3):
        more = np.flatnonzero(length > place)
        if not len(more):
            break
        ranks[more] |= raw[at[more] + place].astype(np.uint32) << np.uint32(8 * place)
    return np.frombuffer(table, "<u4")[ranks]


def _blocks(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    encoder, end = _encoder(tokenizer_path), np.array([end_id], dtype="<u4")
    docs: list[int] = []
    parts: list[np.ndarray] = []
    start, held = 0, 0
    names = ["shard", "start_in_shard", "n_ids", "doc_ids", "lengths", "table", "control", "data"]

    def block() -> pa.RecordBatch:
        table, control, data = pack(np.concatenate(parts))
        row = [shard, start, held, np.asarray(docs, "<i8").tobytes(), np.asarray([len(p) for p in parts], "<i8").tobytes(), table, control, data]
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i in range(0, batch.num_rows, 512):
            some = [t or "" for t in texts.slice(i, 512).to_pylist()]
            for doc_id, got in zip(ids.slice(i, 512).to_pylist(), encoder.encode(some), strict=True):
                docs.append(doc_id)
                parts.append(np.concatenate([got, end]))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield block()
                    start, held, docs, parts = start + held, 0, [], []
    if docs:
        yield block()


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Writes the ids of every text, in ascending doc_id order, as a folder of blocks.

    One range shuffle by doc_id; shards ascend with the ranges. doc_id must not be null
    (null ids are written as -1).
    """
    ordered = (
        docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(lambda it: _blocks(it, tokenizer_path, end_id), BLOCK_SCHEMA).write.parquet(path, compression="zstd")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["n_ids"], row["table"], row["control"], row["data"])
            yield row["shard"], row["start_in_shard"], np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["lengths"], "<i8"), ids


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, token_ids array<long> of every document in the store."""

    def rows(batches):
        for _, _, docs, lengths, ids in _decoded(batches):
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))], ["doc_id", "token_ids"])

    return spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(rows, "doc_id long, token_ids array<long>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the store.

    ``start`` counts the ids of all documents before it: the position inside the shard, known
    from the block, plus the ids of the shards before, a running sum over one row a shard.
    """
    stored = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    shards = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))

    def rows(batches):
        for shard, first, docs, lengths, ids in _decoded(batches):
            ends = np.cumsum(lengths)
            at = ends - lengths
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(docs), pa.int32()), pa.array(docs), pa.array(first + at), pa.array(lengths), pa.array(crc, pa.int64())], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    each = stored.mapInArrow(rows, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # one row a range partition: bounded by the number of shards, not by the rows
    return each.join(F.broadcast(before), "shard").select("doc_id", (F.col("at") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_store(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    path = shared_path(spark, "token-store")
    write_tokens(docs, path, tokenizer_path)
    return digests(spark, path)

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from maintspark.llm.common import read, shared_path
from maintspark.llm.token_store import Encoder, op2_token_store, pack, read_tokens, unpack, write_tokens

from .cases import clashing, empty, hard

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(docs):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_digests_equal_brute_force(spark):
    for docs in (clashing(hard(spark)), read(spark, "/root/testdata/sf0.01", "documents")):
        got = sorted(tuple(r) for r in op2_token_store(spark, docs.repartition(5)).collect())
        assert got == brute(docs)


def test_round_trip_and_empty(spark):
    path = shared_path(spark, "t")
    write_tokens(hard(spark), path, PATH)
    t = Tokenizer.from_file(PATH)
    for r in read_tokens(spark, path).join(hard(spark), "doc_id").collect():
        assert r.token_ids == [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
    assert op2_token_store(spark, empty(spark)).collect() == []


def test_repeated_rows(spark):
    rows = op2_token_store(spark, hard(spark).union(hard(spark))).collect()
    assert len(rows) == 2 * hard(spark).count()
    assert sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)


def test_pack_takes_every_length():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (7, 300), (200_001, 90_000)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        assert (unpack(n, *pack(ids)) == ids).all()


def test_ids_equal_the_tokenizers():
    """Strings of letters, marks and all kinds of white space."""
    import random

    import public_tokenizers

    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    letters = ["a", "the", "B", "é", "ß", "ł", "ª", "µ", "日本", "1", "23", ".", ",", "'s", "'", "!", "<", "<|endoftext|>", "-", "\u0301", "\x1c", "x" * 30, "🙂"]
    spaces = [" ", " ", " ", "\n", "\n", "\t", "\u00a0", "\u3000", "\r", "\x1f", "\u2028", ""]
    texts = ["a\n\u00a0\u00a0b", "word.", " word.", "é.", ".", " ."]
    texts += ["".join(rng.choice(letters) + rng.choice(spaces) for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    texts += ["".join(rng.choice(letters[:6]) + rng.choice(spaces[:5]) for _ in range(rng.randint(1, 9))) for _ in range(5_000)]
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert got.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_few_calls_of_the_model():
    """Words are told apart from the spaces and line ends between them, and encoded once in two generations."""
    encoder = Encoder(PATH)
    calls = []
    encoder.plain.encode = encoder.spaced.encode = lambda before, word: calls.append(before + word) or encoder._ids(before, word)
    text = "one two two\nthree two éa\none two."
    first = encoder.encode([text, text])
    assert sorted(calls) == sorted(["one", " two", "\n", "three", " éa", " two.", "."])
    encoder.plain, encoder.spaced = encoder.plain.renewed(), encoder.spaced.renewed()
    assert [x.tolist() for x in encoder.encode([text, text])] == [x.tolist() for x in first] and len(calls) == 7
    assert first[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_of_a_long_run_are_remembered():
    """Half a million other words, as some 50 MB of text have, don't make the first ones be encoded again."""
    encoder = Encoder(PATH)
    calls = []
    encoder.plain.encode = encoder.spaced.encode = lambda before, word: calls.append(word) or b"\1\0\0\0"
    texts = [" ".join(f"w{i}" for i in range(k, k + 10_000)) for k in range(0, 500_000, 10_000)]
    for text in [*texts, texts[0]]:
        encoder.encode([text])
    assert len(calls) == 500_000

import base64
import random

import public_tokenizers
import tiktoken

from chartloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library():
    with open(PATH, "rb") as f:
        own = bpe.Codec(f.read(), PATTERN)
    lib, rng = library(), random.Random(6)
    texts = ["", " ", "\n\n  x", "<|endoftext|>", "don't 12 12345", "a" * 5000, "".join(rng.choice("abcde") for _ in range(20_000)), " " * 3000 + "x"]
    texts += ["".join(rng.choice("ab cT'éß漢😀\n\t 12१!?.​\xa0 ʰ") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for t in texts:
        ids = own.encode(t)
        assert ids == lib.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_generations_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 2000)
    with open(PATH, "rb") as f:
        own = bpe.Codec(f.read(), PATTERN)
    lib = library()
    for n in range(300):
        t = f"word{n % 37} other{n % 5}"
        assert own.encode(t) == lib.encode_ordinary(t)


def test_operators(spark):
    rows = [(1, "one two three", "i", "b"), (1, "one two three", "i", "b"), (2, None, None, None), (None, "", "x", "y"), (3, "é 漢字 " * 20_000, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, bytes string")
    back = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN)
    assert back.columns == ["doc_id", "text", "ids", "bytes"] or set(back.columns) == {"doc_id", "text", "ids", "bytes"}
    lib = library()
    for r in back.collect():
        assert r.ids == lib.encode_ordinary(r.text or "") and bytes(r.bytes) == (r.text or "").encode()
    assert len({r.n_tokens for r in bpe.digests(docs, PATH, PATTERN).where("doc_id = 1").collect()}) == 1
    assert bpe.encode(docs.where("doc_id = 99"), PATH, PATTERN).count() == 0

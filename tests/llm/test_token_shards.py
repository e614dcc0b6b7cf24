import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chartloom.llm import token_shards
from chartloom.llm.runtime import scratch

with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
    FILE = f.read()
SCHEMA = "doc_id long, text string, ids string"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(np.arange(-(10**6), 10**6), n, replace=False).astype(np.int64)
    hashed = token_shards.PerfectHash.unpack(token_shards.PerfectHash.build(keys).pack())
    assert sorted(hashed.number(keys).tolist()) == list(range(n))


def test_encoder_equals_the_library():
    own, lib = token_shards.WordEncoder(FILE), Tokenizer.from_str(FILE)
    texts = ["", "Don't STOP 123 it's", "É́ ÀÉ ß ẞ İ Σας", "a\x1cb\x85c\xa0d", "<|endoftext|> x <|start", "漢字 हिन्दी 😀", "## # ##x", "x" * 3000, "– … € ½"] * 2
    for t in texts:
        assert np.frombuffer(own.encode(t), own.kind).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_every_character(monkeypatch):
    own, lib = token_shards.WordEncoder(FILE), Tokenizer.from_str(FILE)
    delegated = []
    monkeypatch.setattr(own, "whole", lambda t: delegated.append(t) or b"")
    checked = 0
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        for t in (c, f"ab{c}cd", f"Word{c}"):
            before = len(delegated)
            ids = np.frombuffer(own.encode(t), own.kind).tolist()
            if len(delegated) == before:  # what is delegated is the library's own
                assert ids == lib.encode(t, add_special_tokens=False).ids, hex(ord(c))
                checked += 1
    assert checked > 1500


def test_fuzz():
    own, lib, rng = token_shards.WordEncoder(FILE), Tokenizer.from_str(FILE), random.Random(8)
    alphabet = [chr(i) for i in range(0x250)] + ["ab", "The ", " ", "'s", "'LL", "1", "–", "…", "€", "\u0301", "漢", "😀", "K", "ẞ"]
    for _ in range(20_000):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        assert np.frombuffer(own.encode(t), own.kind).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_generations_change_nothing(monkeypatch):
    monkeypatch.setattr(token_shards, "REMEMBERED_BYTES", 1000)
    own, lib = token_shards.WordEncoder(FILE), Tokenizer.from_str(FILE)
    for n in range(200):
        t = f"word{n % 37}, OTHER{n % 5} {'long' * 40}"
        assert np.frombuffer(own.encode(t), own.kind).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_keyed_access(spark):
    lib = Tokenizer.from_str(FILE)
    rows = [(n * 3, f"text number {n} " * (1 + n % 9)) for n in range(3000)] + [(30, f"another of thirty {n}") for n in range(500)] + [(None, f"no key {n}") for n in range(500)] + [(-(2**63), "least"), (2**63 - 1, "most")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    at = scratch(spark, "test-get")
    token_shards.write(docs, at, FILE, shard_bytes=2000)
    shards = spark.read.parquet(f"{at}/shards").orderBy("shard").collect()
    assert len(shards) > 5 and sum(r.records for r in shards) == len(rows) and all(a.most <= b.least for a, b in zip(shards, shards[1:]) if a.named and b.named)
    want = [0, 30, 30, 299, 4500, 10**12, -(2**63), 2**63 - 1]
    got = sorted((r.doc_id, list(r.ids)) for r in token_shards.get(spark, at, FILE, want).collect())
    assert got == sorted((k, lib.encode(t, add_special_tokens=False).ids + [2]) for k, t in rows if k in want)
    assert token_shards.get(spark, at, FILE, [1, 2]).count() == 0 and token_shards.get(spark, at, FILE, []).count() == 0
    whole = token_shards.read(spark, at, FILE, with_ids=True)
    assert whole.count() == len(rows) and whole.where("doc_id = 4500").first().ids == lib.encode(dict(rows[:3000])[4500], add_special_tokens=False).ids + [2]
    # figures joined by a shuffle are the same
    limit, token_shards.MOST_BROADCAST = token_shards.MOST_BROADCAST, 0
    try:
        assert sorted(map(tuple, token_shards.read(spark, at, FILE).select("start", "ids_crc32").collect())) == sorted(map(tuple, whole.select("start", "ids_crc32").collect()))
    finally:
        token_shards.MOST_BROADCAST = limit


def test_round_trip(spark):
    lib = Tokenizer.from_str(FILE)
    rows = [(n * 7 - 300, f"Document {n} says ## " + "word " * (n % 50), "x") for n in range(400)] + [(5, None, "x"), (5, "again five", "y"), (5, "", None), (None, "no key", "y"), (2**62, "far", "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    at = scratch(spark, "test-shards")
    token_shards.write(docs, at, FILE, shard_bytes=3000)
    got = token_shards.read(spark, at, FILE).collect()
    assert len(got) == len(rows)
    want = {}
    for key, text, _ in rows:
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(key, []).append((len(ids), zlib.crc32(ids.tobytes())))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    at_ = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at_
        at_ += r.n_tokens
    keys = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])


def test_unknown_keys_and_empty(spark):
    keys = np.arange(0, 4000, 2)
    hashed = token_shards.PerfectHash.build(keys)
    slots = np.zeros(len(keys), token_shards.SLOT)
    slots["print"][hashed.number(keys)] = token_shards.fingerprints(keys)
    assert (token_shards.look_up(keys, hashed, slots) >= 0).all()
    assert (token_shards.look_up(keys + 1, hashed, slots) >= 0).mean() < 0.01
    at = scratch(spark, "test-empty")
    token_shards.write(spark.createDataFrame([], SCHEMA), at, FILE)
    assert token_shards.read(spark, at, FILE).count() == 0

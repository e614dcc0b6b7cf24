"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Adjacent pairs wait in buckets, one for each merge rank, that hold the pair's position in a linked list of tokens. A
bitmap with a bit for each rank, and above it one bit for each word of 256 bits, finds the lowest rank that waits by two
find-first-set steps. Entries whose pair has changed meanwhile are skipped. A pre-token of n bytes costs O(n log n) at
most, so very long ones do no harm.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import latin
from chartloom.llm.runtime import Remembered, released, ship, table

#: Bytes, about, of each of the two generations of pre-tokens that a task remembers, and the longest of them in characters.
REMEMBERED_BYTES = 40 << 20
REMEMBERED_CHARS = 64
_BITS = [1 << k for k in range(256)]


class Codec:
    """Encodes and decodes by the ranks of a tiktoken file, splitting text by pattern."""

    def __init__(self, file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        self.twos = {token: rank for token, rank in self.ranks.items() if len(token) == 2}
        self.ones = [self.ranks[bytes([b])] for b in range(256)]
        most = max(self.ranks.values())
        self.code = "H" if most < 1 << 16 else "I"
        self.tokens: list[bytes | None] = [None] * (most + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.names = [f"{i} " for i in range(most + 1)]
        # of the queue; empty whenever no piece is being encoded
        self.low, self.buckets = [0] * ((most >> 8) + 1), [None] * (most + 1)
        # the space of Unicode's White_Space, which is what the libraries' \s means
        self.split_any = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        plain = latin.spelled(pattern)
        self.split_latin = plain.findall if plain else self.split_any
        self.remembered = Remembered(lambda token: self.encode_piece(token.encode("utf-8", "surrogatepass")).tobytes(), REMEMBERED_BYTES, REMEMBERED_CHARS)

    def split(self, text: str) -> list[str]:
        return (self.split_any if latin.beyond(text) else self.split_latin)(text)

    def encode_piece(self, piece: bytes) -> array:
        """Ids of one pre-token: its own rank, or what merging the lowest, leftmost pair again and again leaves.

        The three places that put a pair into its bucket are written out, as a call would cost as much as they do.
        """
        if (whole := self.ranks.get(piece)) is not None:
            return array(self.code, (whole,))
        n, get, two, bits = len(piece), self.ranks.get, self.twos.get, _BITS
        # a bucket is one position or a heap of some; `low` says which buckets hold any, `top` which words of `low` do
        low, buckets, top = self.low, self.buckets, 0
        ids = [*map(self.ones.__getitem__, piece)]  # of the token that starts here,
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # where it ends and the one before starts,
        pair: list[int | None] = [None] * n  # and its rank with the next one
        i = 0
        for stop in range(2, n + 1):
            pair[i] = r = two(piece[i:stop])
            if r is not None:
                bucket = buckets[r]
                if bucket is None:
                    buckets[r] = i
                    low[r >> 8] |= bits[r & 255]
                    top |= bits[r >> 8]
                elif bucket.__class__ is int:
                    buckets[r] = [bucket, i]
                else:
                    bucket.append(i)
            i += 1
        while top:
            a = (top & -top).bit_length() - 1
            word = low[a]
            bit = word & -word
            rank = (a << 8) + bit.bit_length() - 1
            bucket = buckets[rank]
            i = bucket if bucket.__class__ is int else heappop(bucket)
            if i is bucket or not bucket:
                buckets[rank] = None
                low[a] = word = word ^ bit
                if not word:
                    top &= top - 1
            if pair[i] != rank:  # stale
                continue
            ids[i] = rank
            j = end[i]
            stop = end[i] = end[j]
            pair[j] = r = None
            if stop < n:
                prev[stop] = i
                r = get(piece[i : end[stop]])
            pair[i] = r
            if r is not None:
                bucket = buckets[r]
                if bucket is None:
                    buckets[r] = i
                    low[r >> 8] |= bits[r & 255]
                    top |= bits[r >> 8]
                elif bucket.__class__ is int:
                    buckets[r] = [bucket, i] if bucket < i else [i, bucket]
                else:
                    heappush(bucket, i)
            i = prev[i]
            if i >= 0:
                pair[i] = r = get(piece[i:stop])
                if r is not None:
                    bucket = buckets[r]
                    if bucket is None:
                        buckets[r] = i
                        low[r >> 8] |= bits[r & 255]
                        top |= bits[r >> 8]
                    elif bucket.__class__ is int:
                        buckets[r] = [bucket, i] if bucket < i else [i, bucket]
                    else:
                        heappush(bucket, i)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = end[i]
        return array(self.code, out)

    def packed(self, text: str | None) -> array:
        """The text's ids; null is empty."""
        return array(self.code, b"".join(map(self.remembered.__getitem__, self.split(text or ""))))

    def encode(self, text: str | None) -> list[int]:
        return self.packed(text).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def codec(file: bytes, pattern: str) -> Codec:
    """The worker's codec for this file and pattern, made once."""
    key = hashlib.sha256(file + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(file, pattern)
    return _CODECS[key]


def _each(docs: DataFrame, text_col: str, ranks_path: str, pattern: str, make, names: list[str], kinds: str) -> DataFrame:
    """docs with columns that make(codec, text) gives for each row; same-named columns of docs are replaced."""
    spark = docs.sparkSession
    ship(spark)
    with open(ranks_path, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())  # under a few MB: a vocabulary, whatever the input's size
    others = [c for c in docs.columns if c not in names]

    def run(batches):
        own = codec(file.value, pattern)
        for batch in released(batches, own.remembered.forget):
            rows = [make(own, t.as_py()) for t in batch.column(batch.num_columns - 1)]
            made = pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=schema).columns if rows else [pa.array([], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in made)], names=[f"_o{i}" for i in range(len(others))] + names)

    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
    schema = pa.schema([(n, types[k]) for n, k in zip(names, kinds.split())])
    olds = ", ".join(f"_o{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others))
    out = docs.select(*(F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(others)), F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, ", ".join([olds] * bool(olds) + [f"{n} {k}" for n, k in zip(names, kinds.split())]))
    return out.select(*(F.col(f"_o{i}").alias(c) for i, c in enumerate(others)), *names)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids (array of int) of every whole text.

    Null and empty texts have no ids. Rows are encoded one by one: repeated rows, ties and nulls elsewhere change
    nothing. An empty table gives no rows. Other columns pass through; one named like ids_col is replaced.
    """
    return _each(docs, text_col, ranks_path, pattern, lambda own, text: (own.encode(text),), [ids_col], "array<int>")


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """rows with the bytes that their ids stand for; null ids give none. An id outside the vocabulary is an error."""
    return _each(rows, ids_col, ranks_path, pattern, lambda own, ids: (own.decode(ids or ()),), [bytes_col], "binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of each text's ids and of what they decode to, made where the text is encoded so that no id leaves the worker.

    Null texts are empty: no ids, and the digests of nothing. Rows are encoded one by one, repeated ones too. Other columns pass
    through; those named like the three new ones are replaced. An empty table gives no rows.
    """

    def make(own: Codec, text):
        ids = own.packed(text)
        return len(ids), hashlib.sha256("".join(map(own.names.__getitem__, ids)).encode()[:-1]).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    return _each(docs, text_col, ranks_path, pattern, make, ["n_tokens", "ids_sha256", "decoded_sha256"], "long string string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    """The counts and digests of all documents' ids and of what they decode to; nulls, repeated rows and empty tables as in digests."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

"""Token ids as raw binary shards, with a minimal perfect hash index from document keys to shard offsets.

A shard file is a run of records: a 16-byte header (key int64, number of ids uint32, flags uint32: 1 for a null key),
then the ids, little-endian, two bytes each if the vocabulary fits and four if not; the last is the end id. Spark's text
writer puts them down (a record is a "line" and the end id its separator), so shards reach any store that Spark
writes to and commit like any Spark output: tasks can be lost and run again.

A shard ends with its index, as a last record: it numbers the shard's n distinct keys from 0 to n - 1 by a minimal perfect
hash of levels of bits; slot number k has the key's fingerprint (to tell keys that aren't there), how many records the
key has, the first one's offset, and how many ids of the shard precede it. A look-up takes one or two bits, a count and
one slot, and reads no other record. Beside the shards stands a table of a row a shard, with its least and greatest key, which
leads from a key to its shard.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import unicodedata
import zlib
from array import array
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.llm import latin
from chartloom.llm.runtime import Remembered, cut, released, scratch, ship, sized_broadcast, table

END_ID = 2
#: Compressed text that goes to a shard, about. Executors hold a shard or two a core; larger ones make fewer files.
SHARD_BYTES = 16_000_000
#: Shards whose rows are sent to every executor; beyond it their counts are joined by a shuffle (of records' figures, not ids).
MOST_BROADCAST = 1_000_000
#: Keys of one get().
MOST_KEYS = 1_000_000
#: Of struct: key, number of ids, flags.
HEADER, HEADER_SIZE = "<qII", 16
SLOT = np.dtype([("print", "<u4"), ("records", "<u4"), ("offset", "<u8"), ("before", "<u8")])
#: At a shard's end: records, ids, bytes of the hash and of the slots, 1 if any key isn't null, least and greatest key.
TAIL, TAIL_SIZE = "<QQQQQqq", 56
#: Bytes, about, of each of the two generations of words that a task remembers, and the longest of them in characters.
REMEMBERED_BYTES = 24 << 20
REMEMBERED_CHARS = 64
_SEED = 9


class WordEncoder:
    """The tokenizers library's ids as packed bytes, remembered by pre-token.

    Texts are normalised and split as the file says (NFC, lower case letter by letter, words and runs of other
    characters); each distinct pre-token is encoded by the library. Texts with a special token's string or a character
    beyond Latin letters and common punctuation, where Unicode tables of different age may disagree, go to the library
    whole, and so do texts whose lower case has such a character, and all texts if the file asks for another normaliser
    or splitter than that.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file)
        said = json.loads(file)
        steps = [(s["type"], s.get("pattern"), s.get("content")) for s in (said["normalizer"] or {}).get("normalizers", [])]
        splits = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.known = steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)] and len(splits) == 2 and splits[0]["type"] == "Split" and splits[0].get("invert") is True and splits[0]["behavior"] == "Removed" and splits[1]["type"] == "ByteLevel" and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"] and said["post_processor"] is None
        self.strange = [*(t["content"] for t in said["added_tokens"]), "\x1c", "\x1d", "\x1e", "\x1f"]
        self.special = re.compile("|".join(map(re.escape, self.strange))).search
        if self.known:
            plain = latin.spelled(splits[0]["pattern"]["Regex"])
            self.known = plain is not None
            self.split = plain and plain.findall
        self.kind = np.dtype("<u2" if max(self.library.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4")
        self.words, self.marks = Remembered(self.word, REMEMBERED_BYTES, REMEMBERED_CHARS), {}
        # the characters that stand for bytes: printable ones for themselves, then from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.stands = [chr(b) if b in plain else chr(256 + sum(c not in plain for c in range(b))) for b in range(256)]
        self.merge, self.code = self.library.model.tokenize, "H" if self.kind.itemsize == 2 else "I"

    def word(self, w: str) -> bytes:
        """Ids of a run without white space."""
        if w.isalpha():  # letters, or letters and one mark, need no splitting
            return self.part(w)
        head, mark = w[:-1], w[-1]
        if head.isalpha() and mark.isascii() and not mark.isalnum():
            last = self.marks.get(mark)
            if last is None:
                last = self.marks[mark] = self.part(mark)
            return (self.words.get(head) or self.part(head)) + last
        return b"".join([self.words.get(p) or self.part(p) for p in self.split(w)])

    def part(self, token: str) -> bytes:
        """One pre-token's ids, by the library's model."""
        if not (token.isascii() and token.isprintable()):
            token = "".join(map(self.stands.__getitem__, token.encode()))
        return array(self.code, [t.id for t in self.merge(token)]).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known:
            return self.whole(text)
        low = text.lower()
        if text.isascii():
            if any(map(text.__contains__, self.strange)):
                return self.whole(text)
        elif latin.beyond(text) or latin.beyond(low) or self.special(text):
            return self.whole(text)  # what is left has no combining marks, so it is in NFC
        return b"".join(map(self.words.__getitem__, low.split()))  # pre-tokens don't cross white space


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(file: str) -> WordEncoder:
    key = hashlib.sha256(file.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(file)
    return _ENCODERS[key]


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64 bits for each seed, so distinct keys never stay together."""
    x = keys.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, _SEED) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Numbers n distinct int64 keys from 0 to n - 1 by levels of bits.

    A level has two bits for each key that comes to it; a key alone on its bit stays there, the others go to the next level.
    A key's number is how many bits are set before its own, counted up to each word of 64 bits in advance: about
    5 bits a key, and one or two levels to look at.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # words of bits
        self.base, at = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.base.append(at + np.cumsum(ones) - ones)
            at += int(ones.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            size = (2 * len(keys) + 63) // 64 * 64
            at = _mix(keys, len(levels)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[at.astype(np.int64)]]
        return cls(levels)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; -1, or any number, for keys that weren't given."""
        out, rest = np.full(len(keys), -1), np.arange(len(keys))
        for level, (words, base) in enumerate(zip(self.levels, self.base)):
            if not len(rest):
                break
            at = _mix(keys[rest], level) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rest[here]] = (base[word] + below)[here]
            rest = rest[~here]
        return out

    def pack(self) -> bytes:
        return np.array([len(self.levels), *map(len, self.levels)], "<u4").tobytes() + b"".join(w.tobytes() for w in self.levels)

    @classmethod
    def unpack(cls, data) -> PerfectHash:
        n = int(np.frombuffer(data, "<u4", 1)[0])
        sizes = np.frombuffer(data, "<u4", n, 4)
        ends = 4 + 4 * n + 8 * np.cumsum(sizes, dtype=np.int64)
        return cls([np.frombuffer(data, "<u8", int(s), int(e - 8 * s)) for s, e in zip(sizes.astype(np.int64), ends)])


def look_up(keys: np.ndarray, hashed: PerfectHash, slots: np.ndarray) -> np.ndarray:
    """The slot number of each key, -1 where its fingerprint isn't there."""
    at = hashed.number(keys)
    at[at >= 0] = np.where(slots["print"][at[at >= 0]] == fingerprints(keys[at >= 0]), at[at >= 0], -1)
    return at


def footer(keys: np.ndarray, counts: np.ndarray, nameless: np.ndarray, width: int) -> bytes:
    """The index and tail of a shard from its records' keys in order, numbers of ids, and whether the key is null."""
    sizes = HEADER_SIZE + counts * width
    offsets, before = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
    at = np.flatnonzero(~nameless)
    own, first, repeats = np.unique(keys[at], return_index=True, return_counts=True)
    hashed = PerfectHash.build(own)
    slots = np.zeros(len(own), SLOT)
    if len(own):
        number = hashed.number(own)
        slots["print"][number] = fingerprints(own)
        slots["records"][number] = repeats
        slots["offset"][number] = offsets[at[first]]
        slots["before"][number] = before[at[first]]
    packed = hashed.pack()
    return packed + slots.tobytes() + struct.pack(TAIL, len(keys), int(counts.sum()), len(packed), slots.nbytes, len(own) > 0, int(own[0]) if len(own) else 0, int(own[-1]) if len(own) else 0)


class Shard:
    """A shard's bytes, opened at its index."""

    def __init__(self, content, kind: np.dtype):
        self.content, self.kind = content, kind
        tail = len(content) - kind.itemsize - TAIL_SIZE  # each record is followed by the separator
        self.n_records, self.n_ids, hash_size, slots_size, *_ = struct.unpack_from(TAIL, content, tail)
        self.end = tail - hash_size - slots_size
        self.hashed = PerfectHash.unpack(content[self.end : self.end + hash_size])
        self.slots = np.frombuffer(content, SLOT, slots_size // SLOT.itemsize, self.end + hash_size)

    def records(self):
        """(key or None, number of ids before it, ids) of all records, in order."""
        at, before, read, width = 0, 0, HEADER_SIZE, self.kind.itemsize
        while at < self.end:
            key, n, flags = struct.unpack_from(HEADER, self.content, at)
            yield None if flags & 1 else key, before, np.frombuffer(self.content, self.kind, n, at + read)
            at += read + n * width
            before += n

    def get(self, keys: np.ndarray):
        """(key, number of ids before it, ids) of each record of the keys that the shard has, through the index."""
        for key, number in zip(keys.tolist(), look_up(keys, self.hashed, self.slots).tolist()):
            if number < 0:
                continue
            at, before = int(self.slots["offset"][number]), int(self.slots["before"][number])
            for _ in range(int(self.slots["records"][number])):
                found, n, _ = struct.unpack_from(HEADER, self.content, at)
                if found != key:  # a fingerprint that agrees by chance
                    break
                yield key, before, np.frombuffer(self.content, self.kind, n, at + HEADER_SIZE)
                at, before = at + HEADER_SIZE + n * self.kind.itemsize, before + n


def _shards(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(shard, path, content): shard numbers follow the keys."""
    number = F.regexp_extract("path", r"part-(\d+)-", 1).cast("long")
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(paths).where("length > 0").select(number.alias("shard"), "path", "content")


def write(docs: DataFrame, path: str, file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Write every text's ids, in ascending id order, under path/ids, each shard with its index, and the table of shards under path/shards (Parquet: shard, path, records, ids, named, least, most).

    `file` is the tokenizer's JSON. Null and empty texts have the end id alone. Rows with a null id come first and aren't
    indexed. Rows with one id stand together, ordered by a hash of their text, so that a run of them, or of null ids, may go on
    in the next shard; each shard's index has its part. An empty table gives no shards. Other columns are ignored. Ids
    must be integers.
    """
    spark = docs.sparkSession
    ship(spark)
    said = spark.sparkContext.broadcast(file)  # a vocabulary: a few MB, whatever the input's size
    kind = WordEncoder(file).kind
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files, which are about half their text
    if size > 1 << 50:  # not known
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def encode(batches):
        own = encoder(said.value)
        keys, counts, nameless = array("q"), array("q"), bytearray()
        for batch in released(batches, own.words.forget):
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = own.encode(text.as_py())
                n = len(ids) // own.kind.itemsize + 1
                out.append(struct.pack(HEADER, key or 0, n, key is None) + ids)
                keys.append(key or 0)
                counts.append(n)
                nameless.append(key is None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
        if keys:
            index = footer(np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64), np.frombuffer(nameless, bool), own.kind.itemsize)
            yield pa.RecordBatch.from_arrays([pa.array([index], pa.binary())], names=["record"])

    ordered = rows.withColumn("th", F.xxhash64("text")).repartitionByRange(max(1, -(-size // shard_bytes)), "key", "th").sortWithinPartitions("key", "th").select("key", "text")
    separator = end_id.to_bytes(kind.itemsize, "little").decode("ascii")
    ordered.mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", separator).option("maxRecordsPerFile", 0).text(f"{path}/ids")

    def tails(batches):
        for batch in batches:
            found = [struct.unpack(TAIL, t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([t[i] for t in found], pa.int64()) for i in (0, 1, 4, 5, 6))], names=["shard", "path", "records", "ids", "named", "least", "most"])

    tail = F.expr(f"substring(content, length(content) - {kind.itemsize + TAIL_SIZE} + 1, {TAIL_SIZE})")
    _shards(spark, f"{path}/ids").select("shard", "path", tail.alias("tail")).mapInArrow(tails, "shard long, path string, records long, ids long, named long, least long, most long").write.parquet(f"{path}/shards")


def read(spark: SparkSession, path: str, file: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, those with a key found through their shard's index; with_ids: and ids (array of long).

    start counts the ids of all records before it, those of null ids first; the checksum is of the ids as little-endian uint32.
    No shards, no rows. A shard is read once and isn't shuffled.
    """
    ship(spark)
    kind = WordEncoder(file).kind

    def run(batches):
        for batch in released(batches):
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(content.as_buffer(), kind)
                keys, nameless = array("q"), []
                for key, before, ids in shard.records():
                    if key is None:
                        nameless.append((None, before, ids))
                    elif not keys or keys[-1] != key:
                        keys.append(key)
                found = chain(nameless, shard.get(np.frombuffer(keys, np.int64)))
                while part := list(islice(found, 4096)):
                    columns = [pa.array([number] * len(part), pa.int64()), *(pa.array([r[i] for r in part], pa.int64()) for i in (0, 1)), pa.array([len(r[2]) for r in part], pa.int64()), pa.array([zlib.crc32(r[2].astype("<u4").tobytes()) for r in part], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([r[2] for r in part], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "before", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    shards = spark.read.parquet(f"{path}/shards")
    base = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = cut(shards.select("shard", "ids").withColumn("base", base).select("shard", "base"))  # a row a shard
    rows = _shards(spark, f"{path}/ids").select("shard", "content").mapInArrow(run, "shard long, doc_id long, before long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return rows.join(sized_broadcast(bases, bases.count(), MOST_BROADCAST), "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def get(spark: SparkSession, path: str, file: str, keys) -> DataFrame:
    """(doc_id, ids array of long): the records of up to MOST_KEYS integer keys, looked up through the table of shards and the shards' indexes.

    Only shards in whose range a key falls are opened, and in them only the records asked for. Keys that aren't there give no
    row, repeated ones count once, and a key of several records gives a row each. No keys, no rows.
    """
    ship(spark)
    kind = WordEncoder(file).kind
    wanted = np.unique(np.array(list(keys), np.int64))
    if len(wanted) > MOST_KEYS:
        raise ValueError(f"over {MOST_KEYS} keys: join with read(with_ids=True)")
    given = spark.sparkContext.broadcast(wanted)  # of a size checked just above

    def needed(batches):
        for batch in batches:
            least, most = (batch.column(i).to_numpy() for i in (1, 2))
            hit = np.searchsorted(given.value, least) < np.searchsorted(given.value, most, side="right")
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit))], names=["path"])

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                found = list(Shard(content.as_buffer(), kind).get(given.value))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[2] for r in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    paths = [r[0] for r in spark.read.parquet(f"{path}/shards").where("named = 1").select("path", "least", "most").mapInArrow(needed, "path string").collect()]  # two a key at most, but for keys of more records than a shard holds
    if not paths:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    return _shards(spark, paths).select("content").mapInArrow(run, "doc_id long, ids array<long>")


def op9_token_shards(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Write the ids of all documents as shards and read them back: doc_id, start, n_tokens, ids_crc32 of each record.

    Null and empty texts have the end id alone; null ids stand first; repeated ids give a row each; an empty table gives none;
    columns other than doc_id and text are ignored.
    """
    import public_tokenizers

    with open(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        file = f.read()
    path = scratch(spark, "token-shards")
    write(table(spark, sf_dir, "documents"), path, file)
    return read(spark, path, file)

"""SimHash near-duplicates, candidates from anchor points of a covering code.

A fingerprint has 64 bits; two link if at most `bits` = 3 differ. The fingerprint is cut into two halves; of two
linked ones, one half differs in at most one bit. 31 bits of each half are covered by the [31, 26] Hamming code,
whose covering radius is 1: every half lies within 1 of exactly one code word, its home anchor. A half is replicated
to every anchor within covering radius + threshold = 1 + 1 = 2 (16 anchors, or 1 if the half is a code word). If
halves x and y differ in at most one bit, y lies within 2 of x's home, so both meet there. Covering all 64 bits at
once (radius + 3) would replicate each fingerprint hundreds of times; two halves give 2^26 anchors each for about
31 replicas.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.components import components, local_components
from chartloom.llm.runtime import cut, released, ship, sized_broadcast, spare, table

BITS = 3
SEED = 42
#: Anchors with more replicas than this are split by bytes of the other half.
HOT_ANCHOR = 8_192
#: One replica in so many is counted to find such anchors; a miss costs time, not links.
HOT_SAMPLE = 64
#: Rows that a part of a dealt-out anchor shows at once, at least, to find leaders.
HEAD = 32
#: Of similar texts: words of a shingle, the least Jaccard similarity of shingle sets, and the words of a fingerprint.
SHINGLE, SIMILARITY, WORDS = 5, 0.8, 6
#: Texts that are just similar enough differ in 15 % of the bits: of 64 in 9.7 with deviation 2.9, of 384 in 58.2 with 7.
NEAR_BITS, NEAR_SHARE = 20, 0.24
#: What is as near as this to one that leads a bucket doesn't lead there itself.
CLOSE_BITS = 14
#: Documents that are looked up by a broadcast of their ids; more by a shuffle of the texts.
FEW = 500_000
_SMALL = 48
_BATCH = 1 << 19
_MIXERS = np.random.default_rng(64).integers(0, 1 << 63, 15, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, size: int):
    """Arrays of the hashes of lower-cased words' shingles of `size` words, repeats included; fewer words make one shingle, no words none."""
    words = (text or b"").lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if 0 < len(words) <= size:
        yield np.array([digest(join(words), SEED)], np.uint64)
        return
    n = len(words) - size + 1
    each = zip(*(itertools.islice(words, k, None) for k in range(size)))
    for start in range(0, n, 65_536):
        yield np.fromiter((digest(join(s), SEED) for s in itertools.islice(each, 65_536)), np.uint64, min(65_536, n - start))


def majority(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set in rows of 64-bit words."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
    # eight counters of a byte are added at once, for up to 255 rows
    sums = np.add.reduceat(bits.view(np.uint64), np.arange(0, len(bits), 255), axis=0)
    return sums.view(np.uint8).reshape(len(sums), -1).sum(0, dtype=np.int64)


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words give 0."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingles(text, size):
        ones += majority(hashes)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def wide_fingerprint(own: np.ndarray, words: int) -> np.ndarray:
    """`words` words of 64 bits from a set of shingle hashes: the first by the hashes, the others by a mix of them each."""
    ones = np.zeros(64 * words, np.int64)
    for start in range(0, len(own), 65_536):
        x = np.repeat(own[start : start + 65_536, None], words, 1)
        x[:, 1:] ^= x[:, 1:] >> np.uint64(32)
        x[:, 1:] *= _MIXERS[: words - 1]
        x[:, 1:] ^= x[:, 1:] >> np.uint64(29)
        ones += majority(x)
    return np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, hash_col: str | None = None) -> DataFrame:
    """(doc_id, th, fp long) of each row, repeated ones too; th is the long of hash_col, or 0. Null and blank texts have no words and fingerprint 0; a null id stays null; an empty table gives no rows, other columns are ignored."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "th", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), (F.col(hash_col) if hash_col else F.lit(0).cast("long")).alias("th"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, th long, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Of 31-bit values under the Hamming code whose parity check has column i + 1 at bit i."""
    s = np.zeros(x.shape, np.uint64)
    for i in range(31):
        s ^= ((x >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return s


#: For each syndrome the flips that lead to all code words within 2: one bit, and fifteen pairs i ^ j = syndrome.
_FLIPS = np.zeros((32, 16), np.uint64)
for _s in range(1, 32):
    _FLIPS[_s] = [1 << (_s - 1)] + [(1 << (_i - 1)) | (1 << ((_i ^ _s) - 1)) for _i in range(1, 32) if _i < _i ^ _s]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (the half in bit 31, the code word below) of the anchors of each fingerprint, and the fingerprint's index."""
    keys, of = [], []
    index = np.arange(len(fp))
    for half in range(2):
        x = (fp >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)
        s = _syndrome(x)
        words, tag = x[:, None] ^ _FLIPS[s.astype(np.int64)], np.uint64(half << 31)
        on = s == 0
        keys += [x[on] | tag, (words[~on] | tag).ravel()]
        of += [index[on], np.repeat(index[~on], 16)]
    return np.concatenate(keys).astype(np.int64), np.concatenate(of)


def ball_links(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is connected among the distinct fp: a search that compares each point with those not yet reached only."""
    rest, a, b = np.arange(len(fp)), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[at]) <= bits
            if near.any():
                queue += (got := rest[near]).tolist()
                a.append(np.full(len(got), at))
                b.append(got)
                rest = rest[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _compare(keys: np.ndarray, fp: np.ndarray, bits: int) -> pa.RecordBatch:
    """Star edges (a, b) of the links inside equal keys; keys are sorted, (keys, fp) distinct."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [], []
    small = np.repeat(sizes <= _SMALL, sizes)
    for k in range(1, min(_SMALL, int(sizes.max(initial=1)))):
        at = np.flatnonzero((keys[k:] == keys[:-k]) & small[k:])
        if not len(at):
            break
        at = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= bits]
        a.append(at)
        b.append(at + k)
    for i in np.flatnonzero(sizes > _SMALL):
        x, y = ball_links(fp[starts[i] : starts[i] + sizes[i]], bits)
        a.append(x + starts[i])
        b.append(y + starts[i])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    if len(a):  # the same fingerprint stands under many anchors
        value, code = np.unique(np.r_[fp[a], fp[b]], return_inverse=True)
        label = local_components(len(value), code[: len(a)], code[len(a) :])
        at = np.flatnonzero(label != np.arange(len(value)))
        a, b = value[at], value[label[at]]
    else:
        a = b = np.zeros(0, np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links among the distinct fp of prints that connect whatever chains of links within `bits` connect.

    The two halves' covering is complete for up to 3 bits; for more it is an error.
    """
    if bits > 3:
        raise ValueError("the covering code doesn't reach beyond 3 bits")
    spark = prints.sparkSession
    ship(spark)

    def replicate(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fp), 16_384):
                keys, of = anchors(fp[at : at + 16_384].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at : at + 16_384][of])], names=["k", "fp"])

    def compare(batches):
        keys, fps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys.append(batch.column(0).to_numpy(zero_copy_only=False))
            fps.append(batch.column(1).to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held >= _BATCH and keys[-1][0] != keys[-1][-1]:
                k, f = np.concatenate(keys), np.concatenate(fps)
                end = np.searchsorted(k, k[-1])  # the last key may go on
                yield _compare(k[:end], f[:end].view(np.uint64), bits)
                keys, fps, held = [k[end:]], [f[end:]], len(k) - end
        yield _compare(np.concatenate(keys), np.concatenate(fps).view(np.uint64), bits)

    near = prints.select("fp").mapInArrow(replicate, "k long, fp long")
    hot = prints.where(F.pmod(F.xxhash64("fp"), F.lit(HOT_SAMPLE)) == 0).select("fp").mapInArrow(replicate, "k long, fp long").groupBy("k").count().where(F.col("count") >= HOT_ANCHOR // HOT_SAMPLE).select("k", F.lit(True).alias("hot"))
    hot = cut(hot)
    if n := hot.count():
        # the other half differs in at most `bits` bits, so one of bits + 1 parts of it is equal
        width = 32 // (bits + 1)
        other = F.when(F.col("k") >= 1 << 31, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND((1 << 32) - 1)
        parts = F.array(*(F.struct(F.lit(i).alias("i"), F.shiftright(other, i * width).bitwiseAND((1 << width) - 1).alias("part")) for i in range(bits + 1)))
        marked = near.join(sized_broadcast(hot, n, 50_000), "k", "left").select("k", "fp", F.explode(F.when(F.col("hot"), parts).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(-1).cast("long").alias("part"))))).alias("p"))
        near = marked.select(F.when(F.col("p.part") < 0, F.col("k")).otherwise(F.col("k") + (F.col("p.i") + 1) * F.lit(1 << 32) + F.col("p.part") * F.lit(1 << 36)).alias("k"), "fp")
    return near.repartition("k").sortWithinPartitions("k", "fp").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, bits: int = BITS) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id, kept), one for each row of docs.

    component_id is the smallest doc_id among rows whose fingerprints chains of links reach; kept marks the rows
    with that id. Null and blank texts have fingerprint zero and link like any other. Rows of equal fingerprint link,
    so repeated rows share a component (both of two rows with the same id are kept). A row with a null id joins its
    component but can't name it; in a component of such rows component_id is null and all are kept. An empty table
    gives no rows; columns other than the two named are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col, size))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(classes.select("fp"), bits))
    # in a fingerprint's group, the root is the group's smallest fingerprint; ids follow from it
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    out = prints.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def _kept_rows(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows named in rows (doc_id, th, n, keep) with keep false, and once those that stand n > 1 times.

    Only what goes or repeats is looked up, so that texts are shuffled only where that is much.
    """
    i, t = spare(docs, "_id", "_th")
    named = cut(rows.where("not keep or n > 1").select(F.col("doc_id").alias(i), F.col("th").alias(t), "keep"))
    few, again = named.agg(F.count(F.lit(1)), F.count(F.when(F.col("keep"), 1))).first()
    key = F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(t))
    out = docs.join(sized_broadcast(named.drop("keep"), few, FEW), key, "left_anti")
    if again:
        repeated = docs.join(sized_broadcast(named.where("keep").drop("keep"), again, FEW), key)
        out = out.unionByName(repeated.dropDuplicates([i, t]).drop(i, t))
    return out


def _found(prints: DataFrame, group: str, links_: DataFrame) -> DataFrame:
    """(doc_id, th, n, keep) of rows (doc_id, th, group): one stays of each component of the links between groups."""
    rows = prints.groupBy("doc_id", "th", group).agg(F.count(F.lit(1)).alias("n"))
    classes = rows.groupBy(group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("row"))
    found = classes.join(components(links_).withColumnRenamed("node", group), group, "left").withColumn("root", F.coalesce("root", group))
    chosen = found.join(found.groupBy(F.col("root").alias("r")).agg(F.min("row").alias("best")), F.col("root") == F.col("r")).select(F.col(group).alias("g"), "best")
    return rows.join(chosen, F.col(group) == F.col("g")).select("doc_id", "th", "n", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th"))).alias("keep"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, bits: int = BITS) -> DataFrame:
    """One row of docs for each component of near_duplicates: that of the smallest id, and of its rows that of the smallest text hash.

    A row with a null id stays only where its whole component has none. Rows equal in id and text are one row. Columns
    pass through; an empty table gives no rows.
    """
    prints = cut(fingerprints(docs.withColumn("_th", F.xxhash64(F.col(f"`{text_col}`"))), id_col, text_col, size, "_th"))
    return _kept_rows(docs, _found(prints, "fp", links(prints.select("fp").distinct(), bits)), id_col, text_col)


def _set(text: bytes | None, size: int) -> np.ndarray:
    """The hashes of a text's shingles, sorted, each once."""
    found = list(shingles(text, size))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, words: int = WORDS) -> DataFrame:
    """(doc_id, th, c, w0, w1, ...) of each row: a hash of the text, one of its shingle set, and the fingerprint's words. Null texts have no words."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in released(batches):
            found, prints = np.empty(batch.num_rows, np.uint64), np.empty((batch.num_rows, words), np.uint64)
            for i, text in enumerate(batch.column(2)):
                own = _set(text.as_py(), size)
                found[i], prints[i] = xxhash.xxh3_64_intdigest(own.tobytes()), wide_fingerprint(own, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64)), *(pa.array(np.ascontiguousarray(prints[:, w]).view(np.int64)) for w in range(words))], names=["doc_id", "th", "c", *(f"w{w}" for w in range(words))])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, th long, c long" + "".join(f", w{w} long" for w in range(words)))


def _led(keys: np.ndarray, f: np.ndarray, near: int, close: int = CLOSE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, leaders) of buckets of equal, sorted keys: leaders are the first rows in order that are over `close` bits from all leaders before them; (a, b) are each leader and all rows within `near` bits of it, two leaders once.

    So a group of near copies makes a row a copy and leader, not a pair for every two.
    """
    rows, open_, led_before = np.arange(len(keys)), np.ones(len(keys), bool), np.zeros(len(keys), bool)
    a, b, led = [], [], []
    while len(rows):
        k = keys[rows]
        bucket = np.cumsum(np.r_[False, k[1:] != k[:-1]])
        at = np.flatnonzero(open_[rows])
        if not len(at):
            break
        first = at[np.r_[True, bucket[at][1:] != bucket[at][:-1]]]
        leader = np.full(bucket[-1] + 1, -1)
        leader[bucket[first]] = rows[first]
        led.append(rows[first])
        of = leader[bucket]
        rows, of = rows[of >= 0], of[of >= 0]  # the others' buckets are done
        apart = np.bitwise_count(f[rows] ^ f[of])
        led_before[led[-1]] = True
        hit = (apart <= near) & ~led_before[rows]
        a.append(of[hit])
        b.append(rows[hit])
        open_[rows[apart <= close]] = False
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, led))


def _in_buckets(batches, n: int):
    """Columns of whole buckets, of about _BATCH rows or one bucket: batches sorted by their first two columns, of n columns."""
    held, size = [], 0
    for batch in released(batches):
        if not batch.num_rows:
            continue
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)])
        size += batch.num_rows
        k, s = held[-1][:2]
        if size >= _BATCH and (k[0], s[0]) != (k[-1], s[-1]):
            end = int(np.flatnonzero((k != k[-1]) | (s != s[-1]))[-1]) + 1  # the last bucket may go on
            yield [np.concatenate(x) for x in zip(*held[:-1], [x[:end] for x in held[-1]])]
            held, size = [[x[end:] for x in held[-1]]], len(k) - end
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def candidates(prints: DataFrame, words: int = WORDS, near: int = NEAR_BITS, close: int = CLOSE_BITS) -> DataFrame:
    """(a, b), distinct, of classes (c, w0, w1, ...) that meet at an anchor and are near in the next word.

    Each half of each word is covered as in links(), within covering radius + 1. At an anchor all rows meet its leaders. Anchors with very
    many replicas are dealt out by salt and led in rounds: the parts' first open rows, as far as all of them are there, are gone through
    in order, and their leaders go to every part to close rows. So they have the leaders that one task would find, and there, too, all rows meet all leaders.
    """
    spark = prints.sparkSession
    ship(spark)

    def replicate(batches):
        for batch in batches:
            c, prints_ = batch.column(0).to_numpy(), [batch.column(w + 1).to_numpy() for w in range(words)]
            for at in range(0, len(c), 4096):
                for w in range(words):
                    keys, of = anchors(prints_[w][at : at + 4096].view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(keys | w << 32), pa.array(prints_[(w + 1) % words][at : at + 4096][of]), pa.array(c[at : at + 4096][of])], names=["k", "f", "c"])

    def bucket(k, s):
        return np.cumsum(np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]) if len(k) else k

    def met(c, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(c[a], c[b])), pa.array(np.maximum(c[a], c[b]))], names=["a", "b"])

    def compare(batches):
        for k, s, f, c in _in_buckets(batches, 4):
            a, b, _ = _led(bucket(k, s), f.view(np.uint64), near, close)
            yield met(c, a, b)

    def head(batches):
        """The first n rows of each part, with their rank in it."""
        of, seen = None, 0
        for batch in released(batches):
            if not batch.num_rows:
                continue
            k, s, f, c, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            at = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
            rank = np.arange(len(k)) - np.repeat(at, np.diff(np.r_[at, len(k)]))
            if of == (k[0], s[0]):
                rank[: at[1] if len(at) > 1 else len(k)] += seen
            of, seen = (k[-1], s[-1]), int(rank[-1]) + 1
            some = rank < n
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (k, np.zeros_like(k), f, c, rank == n - 1)], names=["k", "s", "f", "c", "last"])

    def lead(batches):
        """An anchor's leaders among its parts' first rows, up to the least of the last ones: beyond it some rows of a part may not be here."""
        for k, s, f, c, last in _in_buckets(batches, 5):
            of = bucket(k, s) - 1
            bound = np.full(of[-1] + 1 if len(of) else 0, np.iinfo(np.int64).max)
            last = last.astype(bool)
            np.minimum.at(bound, of[last], c[last])
            whole = c <= bound[of]
            k, f, c, of = k[whole], f[whole], c[whole], of[whole]
            *_, led = _led(of, f.view(np.uint64), -1, close)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k[led], f[led], c[led], bound[of[led]])], names=["k", "f", "c", "bound"])

    def still_open(batches):
        """Rows past the bound that are over `close` bits from their bucket's new leaders, which come first in it."""
        for k, s, f, c, leads, bound in _in_buckets(batches, 6):
            of, f_ = bucket(k, s), f.view(np.uint64)
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            some = ~leads.astype(bool)
            for start, stop in zip(starts, np.r_[starts[1:], len(of)]):
                n = int(leads[start:stop].sum())
                if n:
                    some[start:stop] &= c[start:stop] > bound[start]
                for i in range(start, start + n):
                    left = np.flatnonzero(some[start:stop]) + start
                    some[left[np.bitwise_count(f_[left] ^ f_[i]) <= close]] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (k, s, f, c)], names=["k", "s", "f", "c"])

    def follow(batches):
        """Rows against the leaders of their bucket, which come first in it."""
        for k, s, f, c, leads in _in_buckets(batches, 5):
            of, f = bucket(k, s), f.view(np.uint64)
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            for start, stop in zip(starts, np.r_[starts[1:], len(of)]):
                n = int(leads[start:stop].sum())
                for i in range(start, start + n):
                    hit = np.flatnonzero(np.bitwise_count(f[start + n : stop] ^ f[i]) <= near) + start + n
                    if len(hit):
                        yield met(c, np.full(len(hit), i), hit)

    columns = ["c", *(f"w{w}" for w in range(words))]
    rows = prints.select(*columns).mapInArrow(replicate, "k long, f long, c long")
    sample = prints.where(F.pmod(F.xxhash64("c"), F.lit(HOT_SAMPLE)) == 0).select(*columns).mapInArrow(replicate, "k long, f long, c long").groupBy("k").count()
    hot = cut(sample.where(F.col("count") >= HOT_ANCHOR // HOT_SAMPLE).select("k", F.ceil(F.col("count") * (2 * HOT_SAMPLE) / HOT_ANCHOR).alias("parts")))
    n = hot.count()
    order = ["k", "s", "c"]  # by class, so that the same ones lead at all anchors
    if not n:
        found = rows.select("k", F.lit(0).cast("long").alias("s"), "f", "c").repartition("k").sortWithinPartitions(*order).mapInArrow(compare, "a long, b long")
    else:
        few = sized_broadcast(hot, n, 50_000)
        cold = rows.join(few, "k", "left_anti").select("k", F.lit(0).cast("long").alias("s"), "f", "c").repartition("k").sortWithinPartitions(*order).mapInArrow(compare, "a long, b long")
        dealt = cut(rows.join(few, "k").select("k", F.pmod(F.xxhash64("c"), F.col("parts")).alias("s"), "f", "c"))
        left, leaders = dealt, None
        share = F.greatest(F.lit(HEAD), F.floor(F.lit(HOT_ANCHOR) / F.col("parts")).cast("long"))
        to_parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("s")
        while not left.isEmpty():
            first = left.join(few, "k").select("k", "s", "f", "c", share.alias("n")).repartition("k", "s").sortWithinPartitions(*order).mapInArrow(head, "k long, s long, f long, c long, last boolean")
            led = cut(first.repartition("k").sortWithinPartitions(*order).mapInArrow(lead, "k long, f long, c long, bound long"))
            leaders = led if leaders is None else leaders.unionByName(led)
            new = led.join(few, "k").select("k", to_parts, "f", "c", F.lit(True).alias("leads"), "bound")
            held = left.select("k", "s", "f", "c", F.lit(False).alias("leads"), F.lit(0).cast("long").alias("bound"))
            left = cut(new.unionByName(held).repartition("k", "s").sortWithinPartitions("k", "s", F.desc("leads"), "c").mapInArrow(still_open, "k long, s long, f long, c long"))
        sent = leaders.join(few, "k").select("k", to_parts, "f", "c", F.lit(True).alias("leads"))
        all_ = sent.unionByName(dealt.withColumn("leads", F.lit(False))).repartition("k", "s").sortWithinPartitions("k", "s", F.desc("leads"), "c")
        found = cold.unionByName(all_.mapInArrow(follow, "a long, b long"))
    return found.where("a != b").distinct()


def similar_links(docs: DataFrame, prints: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, least: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(a, b) of shingle sets (by their hash c) whose Jaccard similarity is at least `least`, worked out on the sets themselves."""
    classes = cut(prints.groupBy("c").agg(F.min(F.struct("doc_id", "th")).alias("row"), *(F.first(f"w{w}").alias(f"w{w}") for w in range(words))))
    told = classes.select("c", *(f"w{w}" for w in range(words)))
    apart = sum((F.bit_count(F.col(f"w{w}").bitwiseXOR(F.col(f"v{w}"))) for w in range(words)), F.lit(0))
    pairs = candidates(classes, words).join(told.withColumnRenamed("c", "a"), "a").join(told.select(F.col("c").alias("b"), *(F.col(f"w{w}").alias(f"v{w}") for w in range(words))), "b")
    pairs = cut(pairs.where(apart <= int(NEAR_SHARE * 64 * words)).select("a", "b"))
    wanted = cut(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct().join(classes, "c").select("c", F.col("row.doc_id").alias("_id"), F.col("row.th").alias("_t")))
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").alias("_own"), F.xxhash64(text).alias("_th"), text.cast("binary").alias("_text")).join(sized_broadcast(wanted, wanted.count(), FEW), F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_t")))

    def sets(batches):
        for batch in released(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_set(t.as_py(), size).tobytes() for t in batch.column(1)], pa.binary())], names=["c", "own"])

    def verify(batches):
        for batch in released(batches):
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = common >= least * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column(j).filter(pa.array(keep)) for j in (0, 1)], names=["a", "b"])

    known = cut(texts.select("c", "_text").mapInArrow(sets, "c long, own binary").dropDuplicates(["c"]))
    joined = pairs.join(known.select(F.col("c").alias("a"), F.col("own").alias("x")), "a").join(known.select(F.col("c").alias("b"), F.col("own").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """One row of docs for each group of similar texts: that of the smallest id, and of its rows that of the smallest text hash.

    Two texts are linked if the Jaccard similarity of their sets of shingles of `size` lower-cased words is at least `least`;
    groups are what links connect. Candidates come from fingerprints of `words` words of 64 bits, 31 bits of each half of
    which are covered by anchors, and are verified on the sets: no link is wrong, and some one in fifteen of those at the least
    similarity may be missed, hardly any from 0.85 on (see README).

    Texts of fewer words are one shingle; null and blank texts have none and are one group. A row with a null id stays only
    where its whole group has none. Rows equal in id and text are one row. Columns pass through; an empty table gives no rows.
    """
    prints = cut(wide_fingerprints(docs, id_col, text_col, size, words))
    return _kept_rows(docs, _found(prints, "c", similar_links(docs, prints, id_col, text_col, size, least, words)), id_col, text_col)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and component; nulls, ties, repeated rows and empty tables as in near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))

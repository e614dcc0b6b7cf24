"""Substring dedup: content-defined chunks cut by a gear rolling hash, deduplicated by digest.

The hash at a byte covers the 32 bytes up to it. A cut falls where the hash is the least within RADIUS bytes on either
side, so cuts rest on the text around them alone and move with it: what is inserted before a passage changes its first
chunk at most. Chunks vary in size, over RADIUS bytes and about twice that on the mean; none is cut inside a character.

The smallest id that has a chunk's digest owns it. A repeated chunk is then extended at either end, byte by byte, by what
agrees with the text around the owner's, so that a repeated passage counts to its last byte; it's found if it holds one whole
chunk, which some 150 bytes nearly always do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.runtime import cut, released, ship, sized_broadcast, table

RADIUS = 24
LEAST, LARGEST = RADIUS + 1, 160
#: Repeats go only where this many bytes of them stand in a row; shorter ones are stock lines and chance.
MIN_RUN = 120
#: Bytes on either side of a chunk that are compared. A cut rests on the 56 bytes before it and the 24 after, so the first that
#: two texts share lies some 80 bytes inside what they share.
REACH = 160
#: The places of one digest are compared with their owner in parts of about this many.
PART = 512
#: Documents that are named by a broadcast; more by a shuffle.
FEW = 500_000
_NO_ID = -(1 << 63)
GEAR = np.random.default_rng(1_234_567).integers(0, 1 << 32, 256, dtype=np.uint32)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        h = np.minimum(h[:-step], h[step:])
        reach += step
    return h


def ends(data: bytes) -> list[int]:
    """Where the chunks of data end; no data, no chunks."""
    n, out, start = len(data), [], 0
    b = np.frombuffer(data, np.uint8)
    if n > 2 * RADIUS + 32:
        h = GEAR[b]
        for s in (1, 2, 4, 8, 16):  # sums of 2, 4, ... 32 bytes' gears, each shifted by its age
            h[s:] += h[:-s] << np.uint32(s)
        h[:-1][(b[1:] & 0xC0) == 0x80] = 0xFFFFFFFF  # never inside a character
        h = h[31:]  # the hash is whole from there on
        at = np.flatnonzero(h[RADIUS:-RADIUS] == _least(h, 2 * RADIUS + 1)) + RADIUS + 32
        at = at[at < n]
        for end in at[h[at - 32] < 0xFFFFFFFF].tolist():
            while end - start > LARGEST:
                start = _forced(b, start + LARGEST)
                out.append(start)
            if end - start > RADIUS:  # of equal hashes, which repeating text has, the first
                out.append(end)
                start = end
    while n - start > LARGEST:
        start = _forced(b, start + LARGEST)
        out.append(start)
    if start < n:
        out.append(n)
    return out


def _forced(b: np.ndarray, at: int) -> int:
    while at < len(b) and b[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunks(data: bytes) -> tuple[list[int], np.ndarray]:
    """Ends of the chunks and their 128-bit digests as pairs of int64."""
    stops = ends(data)
    digest = xxhash.xxh3_128_digest
    return stops, np.frombuffer(b"".join([digest(data[s:e]) for s, e in zip([0, *stops], stops)]), np.int64).reshape(-1, 2)


def common_start(x: bytes, y: bytes) -> int:
    """How many bytes agree from the start on."""
    n = min(len(x), len(y))
    differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - -(-differ.bit_length() // 8)


def common_end(x: bytes, y: bytes) -> int:
    """How many bytes agree up to the end."""
    n = min(len(x), len(y))
    differ = int.from_bytes(x[len(x) - n :], "little") ^ int.from_bytes(y[len(y) - n :], "little")
    return n - -(-differ.bit_length() // 8)


def _merged(ranges, least: int) -> list[list[int]]:
    """Ranges put together where they touch, those of at least `least` bytes."""
    out: list[list[int]] = []
    for x, y in sorted(ranges):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [r for r in out if r[1] - r[0] >= least]


class _Text:
    """A text's chunks with what is known of them: owned maps digests to the least id and the number of places."""

    def __init__(self, data: bytes, place: int, owned: dict, cut_: tuple | None = None):
        self.data, self.place = data, place
        self.stops, found = cut_ or chunks(data)
        self.starts = [0, *self.stops[:-1]] if self.stops else []
        self.keys = [tuple(k) for k in found.tolist()]
        self.owner = [owned.get(k, (place, 1)) for k in self.keys]
        first: dict = {}
        self.before = [first.setdefault(k, i) for i, k in enumerate(self.keys)]  # the chunk's first stand in this text
        self.gone = [o < place or b < i for i, ((o, _), b) in enumerate(zip(self.owner, self.before))]
        self.again = [g or k in owned for g, k in zip(self.gone, self.keys)]
        self.reach: list | None = None  # where the last chunk before, that goes, ends, and the next one starts

    def sides(self, i: int) -> tuple[bytes, bytes]:
        """Up to REACH bytes on either side of chunk i, as far as no chunk there goes itself."""
        if self.reach is None:
            self.reach, at = [], 0
            for e, g in zip(self.stops, self.gone):
                self.reach.append(at)
                at = e if g else at
            ahead, at = [], len(self.data)
            for s, g in zip(reversed(self.starts), reversed(self.gone)):
                ahead.append(at)
                at = s if g else at
            self.reach = list(zip(self.reach, reversed(ahead)))
        s, e, (low, high) = self.starts[i], self.stops[i], self.reach[i]
        return self.data[max(low, s - REACH) : s], self.data[e : min(high, e + REACH)]

    def rows(self):
        """(a, b, part, ask, p, left, right): of owned chunks, for each part of their places, what is around them; of others' chunks at the end of a run, what they ask to compare."""
        for i, ((a, b), (owner, n), before) in enumerate(zip(self.keys, self.owner, self.before)):
            parts = -(-n // PART)
            if owner == self.place and n > 1 and before == i:
                s, e = self.starts[i], self.stops[i]
                for part in range(parts):
                    yield a, b, part, False, s, self.data[max(0, s - REACH) : s], self.data[e : e + REACH]
            elif owner < self.place:
                left, right = self.sides(i)
                if left or right:
                    yield a, b, self.place % parts, True, self.starts[i], left, right

    def ranges(self, found: dict) -> tuple[list, list]:
        """What repeats, and what goes, given (left, right) bytes by which chunks reach further."""
        again, gone = [], []
        for i, (s, e) in enumerate(zip(self.starts, self.stops)):
            if not self.again[i]:
                continue
            left, right = found.get(s, (0, 0))
            if self.before[i] < i:  # what stood in this text before
                x, y = self.sides(i)
                s0, e0 = self.starts[self.before[i]], self.stops[self.before[i]]
                left = max(left, common_end(x, self.data[max(0, s0 - REACH) : s0]))
                right = max(right, common_start(y, self.data[e0 : min(e0 + REACH, s)]))
            again.append((s - left, e + right))
            if self.gone[i]:
                gone.append((s - left, e + right))
        return again, gone


def _place(id_col: str, text_col: str):
    """A row's id as a long; rows without one come before all, each text of theirs by itself."""
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.shiftrightunsigned(F.xxhash64(F.col(f"`{text_col}`")), 2) + F.lit(_NO_ID))


def _owned(column) -> dict:
    return {(k["a"], k["b"]): (k["first"], k["n"]) for k in column.as_py() or ()}


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """docs whose texts lack repeated passages, with the columns n_chunks, repeated_bytes, removed_bytes and first_doc_id.

    A chunk repeats if another id has its digest, or if it stood earlier in the same text; of these it goes where the id
    isn't the smallest, or it stood earlier. At the ends of what goes, chunks reach as far as the bytes agree with those around the
    owner's (the first stand's) chunk; an owner's chunk reaches as far as any such comparison. Runs of repeats of at
    least min_run bytes count as repeated_bytes, and go (removed_bytes) where they are runs of what goes, less halves of
    characters. first_doc_id is the smallest id that owns a removed chunk (null if none went, or it stood in this text
    alone or in a row without id).

    Rows without an id come before all, each text of theirs a place of its own. Rows of one id are one place: none loses
    what the others have. Of equal texts all but the smallest id's lose all, if they have min_run bytes. Null texts stay null
    and empty ones empty. An empty table gives no rows. Other columns pass through; those named like the four new ones are
    replaced. Ids must be integers.
    """
    ship(docs.sparkSession)
    new = ["n_chunks", "repeated_bytes", "removed_bytes", "first_doc_id"]
    others = [c for c in docs.columns if c not in (text_col, *new)]
    text = F.col(f"`{text_col}`")
    whole = docs.select(*(F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(others)), _place(id_col, text_col).alias("_d"), F.xxhash64(text).alias("_th"), text.cast("binary").alias("_text"))

    # equal texts are one: the smallest id's is looked up, and the others are named
    rows = docs.select(_place(id_col, text_col).alias("d"), F.xxhash64(text).alias("th"))
    equal = cut(rows.groupBy("th").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most").select(F.col("th").alias("t"), "least"))
    copies = cut(rows.join(sized_broadcast(equal, equal.count(), FEW), F.col("th") == F.col("t")).select("d", "th", "least").distinct())
    n_copies = copies.count()
    extra = copies.where("d != least").select(F.col("d").alias("_ed"), F.col("th").alias("_et"))
    body = whole.select("_d", "_th", "_text").join(sized_broadcast(extra, n_copies, FEW), (F.col("_d") == F.col("_ed")) & (F.col("_th") == F.col("_et")), "left_anti")

    def emit(batches):
        for batch in released(batches):
            for s in range(0, batch.num_rows, 512):
                pairs, ids = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
                for d, t in zip(batch.column(0)[s : s + 512].to_pylist(), batch.column(1)[s : s + 512]):
                    found = chunks(t.as_py() or b"")[1]
                    if len(found):
                        found = found[np.unique(found[:, 0], return_index=True)[1]]
                        pairs.append(found)
                        ids.append(np.full(len(found), d))
                both = np.concatenate(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), pa.array(np.concatenate(ids))], names=["a", "b", "d"])

    seen = body.select("_d", "_text").mapInArrow(emit, "a long, b long, d long").where("a is not null and b is not null and d is not null").repartition("a", "b")  # all uses read one shuffle; without the filter, which says nothing, joins would put one before their own
    shared = seen.groupBy("a", "b").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").select(F.col("a").alias("sa"), F.col("b").alias("sb"), "first", "n")
    named = seen.join(shared, (F.col("a") == F.col("sa")) & (F.col("b") == F.col("sb"))).groupBy(F.col("d").alias("_n")).agg(F.collect_set(F.struct("a", "b", "first", "n")).alias("_named"))

    def surround(batches):
        for batch in released(batches):
            for s in range(0, batch.num_rows, 64):
                out = [], [], [], [], [], [], [], [], []
                for d, th, t, known in zip(*(batch.column(i)[s : s + 64] for i in range(len(others), len(others) + 4))):
                    for a, b, part, ask, p, left, right in _Text(t.as_py() or b"", d.as_py(), _owned(known)).rows():
                        for column, v in zip(out, (a, b, part, ask, d.as_py(), th.as_py(), p, left, right)):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.bool_()), *(pa.array(c, pa.int64()) for c in out[4:7]), *(pa.array(c, pa.binary()) for c in out[7:])], names=["a", "b", "part", "ask", "d", "th", "p", "l", "r"])

    def compare(batches):
        key, own, reach = None, None, [0, 0]
        for batch in released(batches):
            out = []
            for a, b, part, ask, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b, part) != key:
                    if own is not None and any(reach):
                        out.append((*own[:3], *reach))
                    key, own, reach = (a, b, part), None, [0, 0]
                if not ask:
                    own = own or row  # rows alike in id and text are the same
                elif own is not None:
                    left, right = common_end(row[3], own[3]), common_start(row[4], own[4])
                    reach = [max(reach[0], left), max(reach[1], right)]
                    if left or right:
                        out.append((*row[:3], left, right))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(5)], names=["d", "th", "p", "l", "r"])
        last = [(*own[:3], *reach)] if own is not None and any(reach) else []
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in last], pa.int64()) for i in range(5)], names=["d", "th", "p", "l", "r"])

    # with all columns, though it needs three, so that it reads the same shuffle of texts as the rewriting below
    around = whole.join(named, F.col("_d") == F.col("_n")).drop("_n").mapInArrow(surround, "a long, b long, part long, ask boolean, d long, th long, p long, l binary, r binary")
    found = around.repartition("a", "b", "part").sortWithinPartitions("a", "b", "part", "ask").mapInArrow(compare, "d long, th long, p long, l long, r long")
    found = found.groupBy(F.col("d").alias("_f")).agg(F.collect_set(F.struct("th", "p", "l", "r")).alias("_found"))
    alike = copies.groupBy(F.col("d").alias("_c")).agg(F.collect_set(F.struct("th", "least")).alias("_copies"))
    known = named.join(found, F.col("_n") == F.col("_f"), "left").join(alike, F.col("_n") == F.col("_c"), "full").select(F.coalesce("_n", "_c").alias("_k"), "_named", "_found", "_copies")

    def rewrite(batches):
        for batch in released(batches):
            k, texts, made = len(others), [], []
            for d, th, t, named_, found_, copies_ in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist(), *(batch.column(k + i) for i in range(2, 6))):
                data = t.as_py()
                least = next((c["least"] for c in copies_.as_py() or () if c["th"] == th), None)
                mine: dict = {}
                for f in found_.as_py() or ():
                    if f["th"] == th:
                        x, y = mine.get(f["p"], (0, 0))
                        mine[f["p"]] = max(x, f["l"]), max(y, f["r"])
                stops, digests = chunks(data or b"")
                if not named_.is_valid and least is None and len(set(digests[:, 0].tolist())) == len(stops):  # nothing repeats
                    texts.append(data)
                    made.append((len(stops), 0, 0, None))
                    continue
                of = _Text(data or b"", d, _owned(named_), (stops, digests))
                again, gone = of.ranges(mine)
                if data and least is not None and len(data) >= min_run:
                    again = [(0, len(data))]
                    if least < d:
                        gone = again
                cuts = []
                for x, y in _merged(gone, min_run):
                    while x < y and data[x] & 0xC0 == 0x80:
                        x += 1
                    while x < y < len(data) and data[y] & 0xC0 == 0x80:
                        y -= 1
                    cuts.append((x, y))
                owners = [o for (o, _), s in zip(of.owner, of.starts) if o < d and any(x <= s < y for x, y in cuts)] if cuts else []
                if cuts and least is not None and least < d:
                    owners.append(least)
                if cuts:
                    data = b"".join(data[x:y] for x, y in zip([0, *(y for _, y in cuts)], [*(x for x, _ in cuts), len(data)]))
                texts.append(data)
                made.append((len(stops), sum(y - x for x, y in _merged(again, min_run)), sum(y - x for x, y in cuts), None if not owners or min(owners) < _NO_ID >> 1 else min(owners)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(texts, pa.binary()), *(pa.array([m[i] for m in made], pa.int64()) for i in range(4))], names=[*(f"_o{i}" for i in range(k)), "_text", *new])

    joined = whole.join(known, F.col("_d") == F.col("_k"), "left").drop("_k")
    kinds = ", ".join([*(f"_o{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others)), "_text binary", *(f"{n} long" for n in new)])
    out = joined.mapInArrow(rewrite, kinds)
    named_back = {c: F.col(f"_o{i}").alias(c) for i, c in enumerate(others)} | {text_col: F.col("_text").cast("string").alias(text_col)}
    return out.select(*(named_back[c] for c in docs.columns if c not in new), *new)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages, with what was found; nulls, empty and long texts, ties, repeated rows and empty tables as in dedup_substrings."""
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))

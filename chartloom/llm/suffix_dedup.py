"""Suffix-array dedup: every byte inside a string of WINDOW bytes that also starts earlier goes, exactly.

Sorting all suffixes would move each byte a hundred times. Of the suffixes only the anchored ones are sorted: each window of
WINDOW bytes has one anchor, the leftmost of its strings of GRAM bytes with the least hash, so windows that are equal have equal
anchors at the same place, and the windows of one anchor are neighbours and travel as one segment. Anchors whose
GRAM bytes stand once in the corpus are left out first, by a count of their hashes; a false repeat only costs time.

Splitters from a sample range-partition the segments by their leading tokens (the anchor's bytes) and document, so an anchor of a
third of all rows spreads over many parts. A part sorts its suffixes by multikey quicksort, eight bytes at a time: equal
ones go on to the next eight, and what is alone is done. In each class the earliest stays. An anchor that splitters cut
stands in several parts: their earliest windows are compared once more across the boundaries, by digest.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.llm.runtime import cut, released, ship, sized_broadcast, table
from chartloom.llm.substring_dedup import GEAR, _least

WINDOW, GRAM = 100, 32
#: Texts are taken together up to this many bytes, and longer ones in pieces.
PACK = 1 << 22
#: Segments of a part, at most about this many; sampled ones for each part.
PART, SAMPLE = 1 << 20, 64
#: Segments that are sorted at once.
CHUNK = 1 << 14
#: Segments that a task remembers, so that copies of them aren't shuffled.
KNOWN = 200_000
#: Copies of texts that are named by a broadcast; more by a shuffle.
FEW = 500_000
_NO_ID = -(1 << 63)
_M = np.random.default_rng(13).integers(0, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def anchors(b: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Where the anchor of the window at each byte begins; fewer bytes than a window have none."""
    if len(b) < window:
        return np.zeros(0, np.int64)
    h = GEAR[b]
    for s in (1, 2, 4, 8, 16):  # sums of 2, 4, ... 32 bytes' gears, each shifted by its age
        h[s:] += h[:-s] << np.uint32(s)
    key = h[GRAM - 1 :].astype(np.uint64) << np.uint64(32) | np.arange(len(b) - GRAM + 1, dtype=np.uint64)
    return (_least(key, window - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def packs(texts, window: int = WINDOW, most: int = PACK):
    """(buffer, rows, bases, begins): pieces of texts, joined. Piece i is of text rows[i] from its byte bases[i] on and begins at begins[i]; pieces of a text overlap so that each window is whole in one."""
    held, size, rows, bases, begins = [], 0, [], [], []
    for row, text in enumerate(texts):
        for base in range(0, max(len(text) - window + 1, 0), most):
            piece = text[base : base + most + window - 1]
            held.append(piece)
            rows.append(row)
            bases.append(base)
            begins.append(size)
            size += len(piece)
            if size >= most:
                yield np.frombuffer(b"".join(held), np.uint8), rows, bases, begins
                held, size, rows, bases, begins = [], 0, [], [], []
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), rows, bases, begins


def segments(b: np.ndarray, begins: list[int], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, anchor, gram, piece): runs of windows that have one anchor, with the hash of its bytes."""
    at = anchors(b, window)
    whole = np.ones(len(at), bool)
    for end in begins[1:]:
        whole[max(0, end - window + 1) : end] = False  # these reach into the next piece
    s = np.flatnonzero(whole)
    new = np.r_[True, (at[s[1:]] != at[s[:-1]]) | (np.diff(s) > 1)]
    first, count = s[new], np.diff(np.r_[np.flatnonzero(new), len(s)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(b, GRAM)[at[first]]).view(np.uint64)
    h = np.zeros(len(first), np.uint64)
    for j in range(4):
        h = (h ^ words[:, j]) * _M[j]
        h ^= h >> np.uint64(31)
    return first, count, at[first], (h >> np.uint64(16)).astype(np.int64), np.searchsorted(begins, first, "right") - 1


def multikey(groups: np.ndarray, word, depths) -> tuple[np.ndarray, np.ndarray]:
    """(members, label): the suffixes that are equal to another of their group in the words at all depths, sorted by class, each class in the order given.

    Multikey quicksort by words of eight bytes: what a word parts is apart, equal ones go on to the next word, and a suffix alone is done.
    """
    live, label = np.arange(len(groups)), groups
    for depth in depths:
        w = word(live, depth)
        order = np.lexsort((w, label))
        live, w, label = live[order], w[order], label[order]
        new = np.r_[True, (label[1:] != label[:-1]) | (w[1:] != w[:-1])] if len(live) else np.zeros(0, bool)
        label = np.cumsum(new)
        together = np.bincount(label)[label] > 1
        live, label = live[together], label[together]
    return live, label


class _Rows:
    """Segments sorted by lead and place."""

    def __init__(self):
        self.lead, self.d, self.th, self.s, self.o, self.n, self.seg = ([] for _ in range(7))

    def columns(self):
        return self.lead, self.d, self.th, self.s, self.o, self.n, self.seg

    def take(self, start: int, stop: int) -> _Rows:
        out = _Rows()
        for column, mine in zip(out.columns(), self.columns()):
            column.extend(mine[start:stop])
        return out


def repeats(rows: _Rows, across: set, window: int = WINDOW):
    """(spans, open): spans (row, start, end) of segments' bytes in windows that an earlier row has; open (row, start, window) of the earliest windows of leads that stand in other parts, too."""
    ids, owner, distinct = [], {}, []
    spans, lead_of = [], {}
    for i, (lead, o, seg) in enumerate(zip(rows.lead, rows.o, rows.seg)):
        ids.append(lead_of.setdefault(lead, len(lead_of)))
        if (first := owner.setdefault((o, seg), i)) == i:
            distinct.append(i)
        elif (rows.d[first], rows.th[first], rows.s[first]) != (rows.d[i], rows.th[i], rows.s[i]):  # else rows alike in id and text
            spans.append((i, 0, len(seg)))
    ids = np.array(ids, np.int64)
    flagged = np.array([lead in across for lead in lead_of], bool)
    distinct = np.array(distinct, np.int64)
    if not len(distinct):
        return spans, []
    several = np.bincount(ids[distinct], minlength=len(lead_of)) > 1
    chosen = distinct[(several | flagged)[ids[distinct]]]
    if not len(chosen):
        return spans, []
    n = np.array(rows.n, np.int64)[chosen]
    o = np.array(rows.o, np.int64)[chosen]
    data = b"".join(rows.seg[i] for i in chosen.tolist())
    b = np.frombuffer(data, np.uint8)
    begin = np.cumsum(n + window - 1) - (n + window - 1)
    of = np.repeat(np.arange(len(chosen)), n)
    j = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start = begin[of] + j
    eight = np.lib.stride_tricks.sliding_window_view(b, 8)

    def word(live, depth):
        return np.ascontiguousarray(eight[start[live] + depth]).view(">u8").ravel().astype(np.uint64)

    live, label = multikey(ids[chosen][of] * window + o[of] - j, word, [*range(0, window - 8, 8), window - 8])
    later = np.zeros(len(of), bool)
    if len(live):
        later[live[np.r_[False, label[1:] == label[:-1]]]] = True
    hit = np.flatnonzero(later)
    if len(hit):
        new = np.r_[True, (np.diff(hit) > 1) | (of[hit[1:]] != of[hit[:-1]])]
        low, high = hit[new], hit[np.r_[np.flatnonzero(new)[1:] - 1, len(hit) - 1]]
        spans += zip(chosen[of[low]].tolist(), j[low].tolist(), (j[high] + window).tolist())
    rest = np.flatnonzero(~later & flagged[ids[chosen]][of])
    return spans, [(r, k, data[x : x + window]) for r, k, x in zip(chosen[of[rest]].tolist(), j[rest].tolist(), start[rest].tolist())]


def _merged(ranges) -> list[list[int]]:
    """Ranges put together where they touch."""
    out: list[list[int]] = []
    for x, y in sorted(ranges):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def _batch(columns: list[list], kinds, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """docs with the columns n_bytes, n_removed, n_spans and kept (binary): the text's UTF-8 bytes without those in strings of `window` bytes that also start earlier, in a row of a smaller id or earlier in the same one.

    Strings are judged on the texts as given; removed runs that touch are one span. A null id is smaller than any; its rows, and rows of
    one id with different texts, are in the order of their texts' hashes. Rows alike in id and text are one: none loses
    what the other has. Of equal texts the smallest id's stays as it is judged, the others lose all if they have `window` bytes.
    Null and empty texts have no bytes, and texts of fewer bytes than `window` lose none. Very long texts are read in pieces. An empty
    table gives no rows; other columns pass through, those named like the four new ones are replaced. Ids must be integers.
    """
    if window < 2 * GRAM:
        raise ValueError(f"a window has {2 * GRAM} bytes or more")
    spark = docs.sparkSession
    ship(spark)
    new = ["n_bytes", "n_removed", "n_spans", "kept"]
    others = [c for c in docs.columns if c not in new]
    text = F.col(f"`{text_col}`")
    place = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID))
    whole = docs.select(*(F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(others) if c != text_col), place.alias("_d"), F.xxhash64(text).alias("_th"), text.cast("binary").alias("_text"))
    at = len(whole.columns) - 3

    # equal texts are one: the smallest id's is looked at, and the others are named
    rows = docs.select(place.alias("d"), F.xxhash64(text).alias("th"), F.xxhash64(F.lit(13), text).alias("t2"), F.octet_length(text).alias("size")).where(F.col("size") >= window)
    equal = cut(rows.groupBy("th", "t2", "size").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most").drop("most"))
    copies = cut(rows.join(sized_broadcast(equal, equal.count(), FEW), ["th", "t2", "size"]).where("d != least").select(F.col("d").alias("_ed"), F.col("th").alias("_et")).distinct())
    body = whole.select("_d", "_th", "_text").join(sized_broadcast(copies, copies.count(), FEW), (F.col("_d") == F.col("_ed")) & (F.col("_th") == F.col("_et")), "left_anti")

    def grams(batches):
        """(g, d, n): the anchors' hashes of each text and how often they stand there."""
        for batch in released(batches):
            ids = batch.column(0).to_numpy()
            for b, rows_, _, begins in packs((t.as_py() or b"" for t in batch.column(2)), window):
                *_, g, piece = segments(b, begins, window)
                d = ids[np.array(rows_)[piece]]
                order = np.lexsort((g, d))
                g, d = g[order], d[order]
                first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(g[first]), pa.array(d[first]), pa.array(np.diff(np.r_[first, len(g)]).astype(np.int32))], names=["g", "d", "n"])

    seen = body.mapInArrow(grams, "g long, d long, n int")
    # counted before they are shuffled, and joined from a table of their own, so that Spark can split a common string's rows
    shared = cut(seen.groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g"))
    named = cut(seen.select("g", "d").join(shared, "g").groupBy(F.col("d").alias("_n")).agg(F.collect_set("g").alias("_grams")))
    total = named.agg(F.sum(F.size("_grams"))).first()[0] or 0
    n_parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))

    def places(d, grams_, texts):
        """(row, first, count, anchor, buffer, base) of the segments whose anchors are named, in order."""
        mine = [np.sort(x) for x in grams_]
        for b, rows_, bases, begins in packs(texts, window):
            first, count, anchor, g, piece = segments(b, begins, window)
            data = b.tobytes()
            cuts = np.searchsorted(piece, np.arange(len(rows_) + 1))
            for p, (row, base, begin) in enumerate(zip(rows_, bases, begins)):
                lo, hi = cuts[p], cuts[p + 1]
                known = mine[row]
                if hi > lo and len(known):
                    k = np.minimum(np.searchsorted(known, g[lo:hi]), len(known) - 1)
                    for x in (np.flatnonzero(known[k] == g[lo:hi]) + lo).tolist():
                        yield row, int(first[x]), int(count[x]), int(anchor[x]), data, base - begin

    # the splitters: leads and documents of a sample of anchors, of bounded size
    one_in = max(1, total // (SAMPLE * n_parts))
    drawn = cut(named.select("_n", F.explode("_grams").alias("g")).where(F.pmod(F.xxhash64("_n", "g"), F.lit(one_in)) == 0).groupBy("_n").agg(F.collect_list("g").alias("_grams")))

    def leads(batches):
        for batch in released(batches):
            ids, out = batch.column(0).to_pylist(), ([], [])
            for row, _, _, anchor, data, _ in places(ids, [np.array(x.as_py(), np.int64) for x in batch.column(2)], (t.as_py() or b"" for t in batch.column(1))):
                out[0].append(data[anchor : anchor + GRAM])
                out[1].append(ids[row])
            yield _batch(out, (pa.binary(), pa.int64()), ["lead", "d"])

    sample = sorted((bytes(r.lead), r.d) for r in body.select("_d", "_text").join(F.broadcast(drawn), F.col("_d") == F.col("_n")).select("_d", "_text", "_grams").mapInArrow(leads, "lead binary, d long").collect()) if total else []
    splitters = sorted({sample[len(sample) * i // n_parts] for i in range(1, n_parts)}) if sample else []
    straddling = {lead for lead, _ in splitters}

    def suffixes(batches):
        """Rows of segments, each with its part; and, without a lead, spans of what this task has seen in an earlier place."""
        known: dict = {}
        names = ["part", "lead", "d", "th", "s", "o", "n", "seg"]
        kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        for batch in released(batches, known.clear):
            for start in range(0, batch.num_rows, 512):
                some = batch.slice(start, 512)
                ids, hashes, out, spans = some.column(at).to_pylist(), some.column(at + 1).to_pylist(), [[] for _ in names], {}
                for row, first, count, anchor, data, shift in places(ids, [np.array(x.as_py(), np.int64) for x in some.column(at + 3)], (t.as_py() or b"" for t in some.column(at + 2))):
                    seg = data[first : first + count + window - 1]
                    mine, key = (ids[row], hashes[row], first + shift), (anchor - first, xxhash.xxh3_128_digest(seg))
                    if known.get(key, mine) < mine:
                        spans.setdefault(row, []).append((mine[2], mine[2] + len(seg)))
                        continue
                    if len(known) >= KNOWN:
                        known.clear()
                    known[key] = mine
                    lead = data[anchor : anchor + GRAM]
                    for column, v in zip(out, (bisect_right(splitters, (lead, ids[row])), lead, *mine, anchor - first, count, seg)):
                        column.append(v)
                for row, ranges in spans.items():
                    for x, y in _merged(ranges):
                        for column, v in zip(out, ((ids[row] + x) % n_parts, None, ids[row], hashes[row], x, -1, y - x, None)):
                            column.append(v)
                yield _batch(out, kinds, names)

    out_names = ["a", "b", "d", "th", "s", "e", "open"]
    out_kinds = (*(pa.int64(),) * 6, pa.bool_())

    def compare(batches):
        held, size, broken = _Rows(), 0, set()

        def done(rows_: _Rows, across: set):
            found, open_ = repeats(rows_, across, window)
            out = [[] for _ in out_names]
            for r, x, y in found:
                s, d = rows_.s[r], rows_.d[r]
                for column, v in zip(out, (d, s + x, d, rows_.th[r], s + x, s + y, False)):
                    column.append(v)
            for r, x, bytes_ in open_:
                s, key = rows_.s[r] + x, np.frombuffer(xxhash.xxh3_128_digest(bytes_), np.int64)
                for column, v in zip(out, (int(key[0]), int(key[1]), rows_.d[r], rows_.th[r], s, s + window, True)):
                    column.append(v)
            return _batch(out, out_kinds, out_names)

        for batch in released(batches):
            spans = [[] for _ in out_names]
            for lead, d, th, s, o, n, seg in zip(*(batch.column(i).to_pylist() for i in range(1, 8))):
                if lead is None:
                    for column, v in zip(spans, (d, s, d, th, s, s + n, False)):
                        column.append(v)
                    continue
                if size >= CHUNK and lead != held.lead[-1]:
                    yield done(held, straddling | broken)
                    held, size, broken = _Rows(), 0, set()
                elif size >= 4 * CHUNK:  # one lead, or a few and one of very many rows: it is compared across its pieces
                    broken.add(lead)
                    yield done(held, straddling | broken)
                    held, size = _Rows(), 0
                for column, v in zip(held.columns(), (lead, d, th, s, o, n, seg)):
                    column.append(v)
                size += 1
            if spans[0]:
                yield _batch(spans, out_kinds, out_names)
        yield done(held, straddling | broken)

    # with all columns, though it needs three, so that it reads the same shuffle of texts as the rewriting below
    dealt = whole.join(named, F.col("_d") == F.col("_n")).drop("_n").mapInArrow(suffixes, "part int, lead binary, d long, th long, s long, o int, n long, seg binary")
    found = dealt.repartitionById(n_parts, F.col("part")).sortWithinPartitions("lead", "d", "th", "s").mapInArrow(compare, "a long, b long, d long, th long, s long, e long, open boolean")
    mine = F.struct("d", "th", "s")
    found = found.withColumn("first", F.min(mine).over(Window.partitionBy("open", "a", "b"))).where(~F.col("open") | (F.col("first") < mine))
    spans = found.groupBy(F.col("d").alias("_f")).agg(F.collect_list(F.struct("th", "s", "e")).alias("_spans"))
    gone = copies.groupBy(F.col("_ed").alias("_c")).agg(F.collect_set("_et").alias("_copies"))
    known = spans.join(gone, F.col("_f") == F.col("_c"), "full").select(F.coalesce("_f", "_c").alias("_k"), "_spans", "_copies")

    def rewrite(batches):
        for batch in released(batches):
            made = [[] for _ in new]
            for th, t, spans_, copies_ in zip(batch.column(at + 1).to_pylist(), batch.column(at + 2), batch.column(at + 3), batch.column(at + 4).to_pylist()):
                data = t.as_py()
                n = len(data or b"")
                ranges = [[0, n]] if th in (copies_ or ()) else _merged((x["s"], x["e"]) for x in spans_.as_py() or () if x["th"] == th)
                if ranges:
                    data = b"".join(data[x:y] for x, y in zip([0, *(y for _, y in ranges)], [*(x for x, _ in ranges), n]))
                for column, v in zip(made, (n, sum(y - x for x, y in ranges), len(ranges), data)):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], batch.column(at + 2), *(pa.array(c, pa.int64()) for c in made[:3]), pa.array(made[3], pa.binary())], names=[*batch.schema.names[:at], "_text", *new])

    joined = whole.join(known, F.col("_d") == F.col("_k"), "left").drop("_k")
    kinds = ", ".join([*(f"_o{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others) if c != text_col), "_text binary", "n_bytes long, n_removed long, n_spans long, kept binary"])
    out = joined.mapInArrow(rewrite, kinds)
    back = {c: (F.col("_text").cast("string") if c == text_col else F.col(f"_o{i}")).alias(c) for i, c in enumerate(others)}
    return out.select(*(back[c] for c in others), *new)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the bytes, runs and digest of what dedup_suffixes leaves; nulls, empty and long texts, ties, repeated rows and empty tables as there."""
    out = dedup_suffixes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))

import random

from chartloom.llm import substring_dedup as s


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgéß漢") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_chunks_cover_and_resist_shifts():
    rng = random.Random(1)
    text = words(rng, 3000).encode()
    stops = s.ends(text)
    assert stops[-1] == len(text) and stops == sorted(set(stops))
    assert all(s.LEAST <= b - a <= s.LARGEST + 3 for a, b in zip([0, *stops], stops[:-1]))
    for a, b in zip([0, *stops], stops):
        text[a:b].decode()
    before, after = (set(s.chunks(t)[1][:, 0].tolist()) for t in (text, b"some words put in front " + text))
    assert len(before - after) <= 4
    assert s.ends(b"") == [] and s.ends(b"x") == [1] and s.ends(b"a" * 1000)[-1] == 1000


def plain_ends(data):
    """The chunks' ends by the description alone: hashes by a loop, minima by slices."""
    n, gear = len(data), s.GEAR.tolist()
    hashes, h = [], 0
    for i, byte in enumerate(data):
        h = ((h << 1) + gear[byte]) % (1 << 32)  # a byte's gear has gone after 32 shifts
        inside = i + 1 < n and data[i + 1] & 0xC0 == 0x80
        hashes.append((1 << 32) - 1 if inside else h)
    r, out, start = s.RADIUS, [], 0

    def forced(upto):
        nonlocal start
        while upto - start > s.LARGEST:
            start += s.LARGEST
            while start < n and data[start] & 0xC0 == 0x80:
                start += 1
            out.append(start)

    for i in range(31 + r, n - r):
        if i + 1 < n and hashes[i] < (1 << 32) - 1 and hashes[i] == min(hashes[i - r : i + r + 1]):
            forced(i + 1)
            if i + 1 - start > r:
                start = i + 1
                out.append(start)
    forced(n)
    return out + [n] if start < n else out


def test_chunks_against_plain_loops():
    rng = random.Random(7)
    texts = [words(rng, n) for n in (0, 1, 9, 20, 60, 400)] + ["ab" * 300, "x" * 700, "漢" * 400, "abcdefghijklmnopqrstuvwxyz0123456789" * 20, "a" * 90 + words(rng, 30)]
    for t in texts:
        assert s.ends(t.encode()) == plain_ends(t.encode())


def plain(rows, least=s.MIN_RUN):
    """(n_chunks, repeated, removed, text) of distinct ids by the description: digests are the chunks themselves, ends grow a byte at a time."""
    docs = {d: (t or "").encode() for d, t in rows}
    cut = {}
    for d, data in docs.items():
        stops = plain_ends(data)
        cut[d] = list(zip([0, *stops], stops))
    least_of = {}
    for d, data in sorted(docs.items(), reverse=True):
        least_of[data] = d
    held, first_at = {}, {}
    for d in sorted(docs):
        if least_of[docs[d]] == d:
            for a, b in cut[d]:
                held.setdefault(docs[d][a:b], set()).add(d)
                first_at.setdefault((d, docs[d][a:b]), (a, b))

    def grow(x, left, y, right, back, forth):
        """How far text x at left/right and text y at left/right agree, within the given bytes of x."""
        p = q = 0
        while p < back and left[0] - p > 0 and left[1] - p > 0 and x[left[0] - p - 1] == y[left[1] - p - 1]:
            p += 1
        while q < forth and right[0] + q < len(x) and right[1] + q < len(y) and x[right[0] + q] == y[right[1] + q]:
            q += 1
        return p, q

    reach, out = {}, {}
    for d in sorted(docs):
        data, met, gone = docs[d], {}, []
        for n, (a, b) in enumerate(cut[d]):
            met.setdefault(data[a:b], n)
            gone.append(min(held.get(data[a:b], {d})) < d or met[data[a:b]] < n)
        ranges = []
        for n, (a, b) in enumerate(cut[d]):
            if not gone[n] and len(held.get(data[a:b], ())) < 2:
                continue
            back = min(s.REACH, a - max([y for (_, y), g in zip(cut[d][:n], gone) if g], default=0))
            forth = min(s.REACH, min([x for (x, _), g in zip(cut[d][n + 1 :], gone[n + 1 :]) if g], default=len(data)) - b)
            p = q = 0
            own = min(held.get(data[a:b], {d}))
            if own < d and least_of[data] == d:
                u, v = first_at[own, data[a:b]]
                p, q = grow(data, (a, u), docs[own], (b, v), back, forth)
                old = reach.get((own, u), (0, 0))
                reach[own, u] = max(old[0], p), max(old[1], q)
            if met[data[a:b]] < n:
                u, v = cut[d][met[data[a:b]]]
                x, y = grow(data, (a, u), data, (b, v), back, min(forth, a - v))
                p, q = max(p, x), max(q, y)
            ranges.append((a, b, p, q, gone[n]))
        out[d] = ranges
    done = {}
    for d, ranges in out.items():
        data = docs[d]
        again, gone = set(), set()
        for a, b, p, q, g in ranges:
            p, q = (max(i, j) for i, j in zip((p, q), reach.get((d, a), (0, 0))))
            again.update(range(a - p, b + q))
            if g:
                gone.update(range(a - p, b + q))
        if len(data) >= least and sum(x == data for x in docs.values()) > 1:
            again = set(range(len(data)))
            gone = set() if least_of[data] == d else again
            if least_of[data] == d:
                for a, b, p, q, g in ranges:
                    if g:
                        gone.update(range(a - p, b + q))

        def runs(of):
            found, start = [], None
            for i in range(len(data) + 1):
                if i in of:
                    start = i if start is None else start
                elif start is not None:
                    if i - start >= least:
                        found.append((start, i))
                    start = None
            return found

        cuts = []
        for x, y in runs(gone):
            while x < y and data[x] & 0xC0 == 0x80:
                x += 1
            while x < y < len(data) and data[y] & 0xC0 == 0x80:
                y -= 1
            cuts.append((x, y))
        rest = b"".join(data[i : i + 1] for i in range(len(data)) if not any(x <= i < y for x, y in cuts))
        done[d] = len(cut[d]), sum(y - x for x, y in runs(again)), sum(y - x for x, y in cuts), rest.decode()
    return done


def corpus(seed=4):
    rng = random.Random(seed)
    latin = lambda n: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = []
    for d in range(0, 120, 2):
        passage = latin(51)
        rows += [(d, f"{latin(40)} {passage} {latin(30)}"), (d + 1, f"{latin(25)} {passage} {latin(60)}")]
    twice = latin(40)
    rows += [(200, f"{latin(9)} {twice} {latin(50)} {twice} {latin(9)}"), (201, "ab" * 900), (202, "x" * 121), (203, None), (204, ""), (205, rows[0][1]), (206, rows[0][1][200:]), (207, "ab" * 300)]
    rows += [(300 + i, f"{latin(3)} {rows[1][1][150 + i : 275 + 3 * i]} {latin(3)}") for i in range(20)]
    mixed = [words(rng, 45) for _ in range(6)]
    rows += [(400 + i, " ".join(rng.choice([words(rng, 20), rng.choice(mixed), rng.choice(mixed)[30:200]]) for _ in range(5))) for i in range(60)]
    return rows


def test_against_brute_force(spark, tmp_path, monkeypatch):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain(rows)
    for part, few in ((s.PART, s.FEW), (2, 0)):  # also with every digest's places in parts, and copies shuffled
        monkeypatch.setattr(s, "PART", part)
        monkeypatch.setattr(s, "FEW", few)
        out = {r.doc_id: r for r in s.op1_substring_dedup(spark, str(tmp_path)).collect()}
        assert {d: (r.n_chunks, r.repeated_bytes, r.removed_bytes, r.text or "") for d, r in out.items()} == want
        assert all((out[d].text is None) == (t is None) for d, t in rows)


def test_every_planted_passage_goes_to_its_last_byte(spark, tmp_path):
    """By all windows of 200 bytes, whatever the chunks are."""
    rows = corpus(8)[:120]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in s.op1_substring_dedup(spark, str(tmp_path)).collect()}
    assert {d: (r.repeated_bytes, r.removed_bytes) for d, r in out.items()} == brute_passages(rows, 200)
    assert all(out[d].repeated_bytes >= 200 and out[d].first_doc_id == d - d % 2 for d in range(1, 120, 2))
    odd = [(1, "é" * 10 + "漢字かな" * 40 + "z"), (2, "q" + "漢字かな" * 40 + "ß")]
    shown = [r.text for r in s.dedup_substrings(spark.createDataFrame(odd, "doc_id long, text string")).collect()]
    assert all("�" not in t for t in shown)


def brute_passages(rows, least):
    """Repeated and removed bytes by all windows of `least` bytes."""
    held = {}
    for d, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - least + 1):
            held.setdefault(data[i : i + least], set()).add(d)
    out = {}
    for d, t in rows:
        data, met, again, gone = (t or "").encode(), {}, set(), set()
        for i in range(len(data) - least + 1):
            window = data[i : i + least]
            own = i - met.setdefault(window, i) >= least
            if own or len(held[window]) > 1:
                again.update(range(i, i + least))
            if own or min(held[window]) < d:
                gone.update(range(i, i + least))
        out[d] = len(again), len(gone)
    return out


def test_passages(spark):
    rng = random.Random(2)
    passages = [words(rng, 60) for _ in range(12)]
    rows = []
    for d in range(120):
        parts = [words(rng, rng.randint(5, 80)) for _ in range(3)]
        if d % 2:
            parts.insert(rng.randint(0, 3), passages[d % 12])
        rows.append((d, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, ""), (204, "漢" * 5000), (205, words(rng, 20_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    out = {r.doc_id: r for r in s.dedup_substrings(docs).collect()}
    for d, t in rows:
        r = out[d]
        assert len((t or "").encode()) - len((r.text or "").encode()) == r.removed_bytes and (r.text is None) == (t is None)
        if d < 120:
            assert (r.repeated_bytes > 0) == (d % 2 == 1)
            assert (r.removed_bytes > 0) == (d % 2 == 1 and d >= 12)
            if r.removed_bytes:
                assert r.first_doc_id == d % 12
    assert out[200].text == out[201].text == "" and out[200].first_doc_id == 3


def test_shapes(spark):
    long = words(random.Random(3), 80)
    rows = [(None, long, "a", 1), (5, long, "b", 2), (5, long, "b", 2), (6, long, None, None), (6, "q" + long, "c", 3), (None, words(random.Random(5), 80), "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _d string, n_chunks int")
    out = sorted(((r.doc_id, r.text == long, r.first_doc_id, r._d) for r in s.dedup_substrings(docs).collect()), key=str)
    assert out == sorted([(None, True, None, "a"), (5, False, None, "b"), (5, False, None, "b"), (6, False, None, None), (6, False, None, "c"), (None, False, None, "d")], key=str)
    texts = {r._d: r.text for r in s.dedup_substrings(docs).collect()}
    assert texts["b"] == texts[None] == "" and texts["c"] == "q" and texts["d"] == rows[5][1]
    assert s.dedup_substrings(docs.where("doc_id = 77")).count() == 0

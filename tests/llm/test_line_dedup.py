import random

from chartloom.llm import line_dedup


def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    if len(a) > len(b):
        a, b = b, a
    at = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return 0 if a == b else 1 if (a[at + 1 :] if len(a) == len(b) else a[at:]) == b[at + 1 :] else 2


def brute(docs, least=line_dedup.MIN_CHARS):
    """Removed line numbers by document, for distinct ids; null first."""
    lines = sorted(((-1 << 63 if d is None else d, i, x.lower().strip(" \t\x0b\x0c\r")) for d, t, *_ in docs for i, x in enumerate((t if t is not None else "").split("\n"))), key=lambda r: r[:2])
    lines = [r for r in lines if r[2]]
    first = {}
    for d, i, x in lines:
        first.setdefault(x, (d, i))
    texts = list(first)
    gone = {x for n, x in enumerate(texts) if len(x) >= least and any(len(y) >= least and edits(x, y) == 1 for y in texts[:n])}
    return {d: [i for e, i, x in lines if e == (-1 << 63 if d is None else d) and (first[x] != (e, i) or x in gone)] for d, *_ in docs}


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé漢😀") for _ in range(rng.randint(1, 7)))
    base = ["".join(word() + " " for _ in range(rng.choice([1, 3, 4, 5, 6, 8, 20, 60]))).strip() for _ in range(60)]

    def near(x):
        k, c = rng.randrange(len(x) + 1), rng.choice("xyzé")
        return rng.choice([x[:k] + c + x[k:], x[:k] + x[k + 1 :], x[:k] + c + x[k + 1 :], x.upper(), "  " + x + "\t", x[:k] + c + "q" + x[k:]])

    docs = [(n, "\n".join(near(rng.choice(base)) if rng.random() < 0.7 else rng.choice(base + ["", " "]) for _ in range(rng.randint(1, 12)))) for n in range(150)]
    docs += [(None, base[0] + "\n" + base[1]), (500, ""), (501, None), (502, "a" * 20_000), (503, "a" * 19_999), (504, "a" * 500 + "b" + "a" * 19_500)]
    got = {r.doc_id: r._removed for r in line_dedup.mark_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
    assert sum(map(len, got.values())) > 300


def test_shapes(spark):
    rows = [(1, "Same line of some length here\nb", "d", 1), (1, "Same line of some length here\nb", "d", 1), (2, "same line of some length hers\nc\n\n c ", "d", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d string, h int")
    out = line_dedup.dedup_lines(docs).collect()
    assert sorted(map(tuple, out)) == sorted([rows[0], rows[1], (2, "c\n", "d", 2)])
    assert line_dedup.dedup_lines(docs.where("doc_id = 9")).count() == 0
    assert line_dedup.dedup_lines(docs).columns == docs.columns


def test_rows_of_one_id_with_other_texts(spark):
    docs = spark.createDataFrame([(1, "q"), (5, "x\nx\nq"), (5, "y\nz"), (6, None), (7, "")], "doc_id long, text string")
    got = {r.text: r._removed for r in line_dedup.mark_lines(docs).collect()}
    assert got == {"q": [], "x\nx\nq": [1, 2], "y\nz": [], None: [], "": []}


def test_rows_without_id_are_places_of_their_own(spark):
    docs = spark.createDataFrame([(None, f"own line {i}\na stock line that all have") for i in range(300)] + [(None, "own line 7\na stock line that all have"), (1, "a stock line that all havE!")], "doc_id long, text string")
    out = [(r.text, r._removed) for r in line_dedup.mark_lines(docs).collect()]
    keep = {t for t, gone in out if gone == []}
    assert len(keep) == 1 and all(gone == [1] for t, gone in out if t not in keep and t.startswith("own")) and ("a stock line that all havE!", [0]) in out


def test_far_side_of_the_switch_gives_the_same(spark, monkeypatch):
    rng = random.Random(9)
    lines = ["".join(rng.choice("abcdef ") for _ in range(40)) for _ in range(30)]
    docs = spark.createDataFrame([(n, "\n".join(x[:k] + "q" + x[k + 1 :] for x, k in ((rng.choice(lines), rng.randrange(40)) for _ in range(6)))) for n in range(80)], "doc_id long, text string")
    near = sorted(map(str, line_dedup.mark_lines(docs).collect()))
    monkeypatch.setattr(line_dedup, "_FEW", 0)
    assert sorted(map(str, line_dedup.mark_lines(docs).collect())) == near

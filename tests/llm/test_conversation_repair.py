import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest

from chartloom.llm import conversation_repair as cr

KIND = "conv_id long, turn long, role string, text string, f_pid long"
RIGHT = re.compile(r"(s?(ua)+)?")
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(tokens):
    """(cost, audit) by a search over whole audits, cheapest and ASCII-least first."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(tokens) and q in ("", "a"):
            return cost, audit
        if (i, q, cost, audit) in done or cost > 5 * len(tokens) + 4:
            continue
        done.add((i, q, cost, audit))
        for role in "ua":
            if (q, role) in NEXT and not audit.endswith("II"):
                heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[q, role]))
        if i < len(tokens):
            t = tokens[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q))
            if t != "d":
                for role in "sua":
                    if (q, role) in NEXT:
                        if role == t.lower():
                            heapq.heappush(heap, (cost + t.isupper(), audit + "K", i + 1, NEXT[q, role]))
                        elif role != "s":
                            heapq.heappush(heap, (cost + 2 + t.isupper(), audit + "R", i + 1, NEXT[q, role]))


def joined(tokens, size):
    found = cr.Joined()
    parts = [tokens[i : i + size] for i in range(0, len(tokens), size)]
    for p in parts:
        found.add(p)
    cost, spans, tail = found.result()
    return cost, "".join(cr.chart(p)[x][y][1] for p, (x, y) in zip(parts, spans)) + tail, spans


def test_charts_against_search():
    rng = random.Random(11)
    every = ["".join(t) for n in range(4) for t in itertools.product("suaxUd", repeat=n)] + ["".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(4, 6))) for _ in range(80)]
    for tokens in every:
        want = cheapest(tokens)
        for size in (1, 2, 512):
            assert joined(tokens, size)[:2] == want, tokens


def test_long_pieces_agree():
    rng = random.Random(12)
    for _ in range(30):
        tokens = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(50, 300)))
        cost, audit, _ = joined(tokens, 512)
        assert joined(tokens, 7)[:2] == (cost, audit)
        roles, rows = "", 0
        for row, role, inserted in cr.edits(joined(tokens, 512)[2][0][0], audit, tokens):
            roles += role[0] if role else tokens[row].lower()
        assert RIGHT.fullmatch(roles)


def history(seed):
    rng = random.Random(seed)
    texts = ["Hi there.", "What?", "No end", "", "  \t", "Yes!  ", "é.", "Hi there.", "tail.\n\n", None]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, t, t * 2, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]), rng.choice(texts)))
    rows += [(100, t, "user" if t % 2 else "assistant", f"turn {t // 3}.") for t in range(700)] + [(101, 5, "user", "same.")] * 40 + [(102, None, "user", "x")] * 3
    rows += [(None, t, "user" if t % 2 == 0 else "assistant", "q" * 100_000 + ".") for t in range(3)] + [(103, 4, "user", "a."), (103, 4, "user", "b."), (103, -7, "system", "s.")]
    # a conversation that loses all its rows
    gone = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return rows + [(gone, 0, "user", "lost.")]


def brute(rows):
    import numpy as np
    import xxhash

    out = {}
    convs = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        mine = convs.setdefault(conv, [])
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        mine += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    for conv, mine in convs.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), np.uint64(xxhash.xxh64_intdigest(x[2].encode(), 42)).view(np.int64)))
        tokens, seen, n = "", set(), [0, 0, 0]
        for turn, role, text in mine:
            bare = text.rstrip(" \t\n\x0b\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            tokens += "d" if fault in (0, 1) else letter.upper() if fault == 2 else letter
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(mine, mine[1:]))
        cost, audit, spans = joined(tokens, 10**6) if tokens else (0, "", None)
        lines = [f"{role or mine[row][1]}:{'' if inserted else mine[row][2]}" for row, role, inserted in cr.edits(spans[0][0], audit, tokens)] if tokens else []
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], KIND).repartition(3)


def asked(spark, rows, tmp_path):
    frame(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return {r[0]: tuple(r)[1:] for r in cr.op11_conversation_repair(spark, str(tmp_path)).collect()}


@pytest.mark.parametrize("piece,few", [(512, 500_000), (3, 0)])
def test_against_plain_python(spark, monkeypatch, tmp_path, piece, few):
    """Also in pieces so small that long and repeated turns, and turns of many rows, are cut."""
    monkeypatch.setattr(cr, "PIECE", piece)
    monkeypatch.setattr(cr, "FEW", few)
    rows = history(5)
    got = asked(spark, rows, tmp_path)
    want = brute(rows)
    assert {k: (got[k], want[k]) for k in want if got.get(k) != want[k]} == {} and len(got) == len(want)


def test_sql(spark, tmp_path):
    """The SQL's rows, where no two texts share a turn and role."""
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["A.", "B?", "open", " ", None, f"{c}-{t}!"])) for c in range(80) for t in range(rng.randint(1, 7))] + [(None, 1, "user", "n."), (None, None, "assistant", "m.")]
    got = asked(spark, rows, tmp_path)
    con = duckdb.connect()
    con.register("conversations", pa.table({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()), "role": [r[2] for r in rows], "text": [r[3] for r in rows]}))
    assert {r[0]: r[1:] for r in con.execute(cr.ORACLE_SQL).fetchall()} == got


def test_empty(spark, tmp_path):
    assert asked(spark, [], tmp_path) == {}


def test_turns_and_other_columns(spark):
    """The repaired rows themselves, of rows without damage."""
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "tool", "Done."), (1, 4, "user", "More"), (2, 1, "system", None), (3, 1, "user", "Hi.")]
    found, turns = cr.repair(frame(spark, rows))
    assert [(r.conv_id, r.role, r.text) for r in turns.orderBy("pid", "k").collect()] == [(1, "user", "Hi."), (1, "assistant", "Done."), (3, "user", "Hi."), (3, "assistant", "")]
    assert {(r.conv_id, r.cost, r.audit, r.duplicate, r.truncated, r.blank) for r in found.collect()} == {(1, 8, "KDRD", 1, 1, 0), (2, 3, "D", 0, 0, 1), (3, 2, "KI", 0, 0, 0)}

"""Conversation structure repair by error-correcting Earley parsing of roles.

The grammar of roles is S -> P | nothing, P -> P u a | u a | s u a. Error productions have costs: a row may be deleted or take
another role, and a row of no text may be inserted. A chart's column holds, for each item, the least (cost, audit), the audit being
the edits' letters so far. Nonterminals stand first in bodies only, so all items begin where the conversation does, and of an
item no more than its head and the symbols after the dot matters: a column has four items at most.

So a chart can also start from any one item, and a conversation of any length is parsed in pieces: rows are range-partitioned in
order, each piece is a row's worth of tokens, and the pieces' charts are joined in order, from which the best items and, backwards,
those that each piece begins with follow. Only tokens and keys travel until the edits are known.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.runtime import SPACE, WORD, cut, released, ship, sized_broadcast, table

GRAMMAR = {"S": ((), ("P",)), "P": (("P", "u", "a"), ("u", "a"), ("s", "u", "a"))}
ROLES = {"u": "user", "a": "assistant"}
#: What may follow what.
NEIGHBOURS = ("su", "ua", "au")
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
BLANKS = " \t\n\x0b\f\r"
#: Rows of a piece.
PIECE = 512
#: Rows of texts said before that are named by a broadcast; more by a shuffle.
FEW = 500_000

Item = tuple[str, tuple[str, ...]]  # the head and the symbols after the dot
Column = dict[Item, tuple[int, str]]


def _predicted(head: str) -> set[Item]:
    found: set[Item] = set()
    heads = [head]
    while heads:
        h = heads.pop()
        for body in GRAMMAR[h]:
            if (h, body) not in found:
                found.add((h, body))
                heads += [body[0]] if body and body[0] in GRAMMAR else []
    return found


#: The first column's items, and those of them that wait for a nonterminal, without it.
_FIRST = _predicted("S")
_WAITING = {h: [(x, body[1:]) for x, body in sorted(_FIRST) if body[:1] == (h,)] for h in GRAMMAR}
START = [(h, body) for h, body in sorted(_FIRST) if not body or body[0] not in GRAMMAR]
DONE: Item = ("S", ())


def _completed(item: Item) -> list[Item]:
    """The items that an item stands for once completions are followed: itself, or what waited for its head."""
    head, rest = item
    if rest or head == "S":
        return [item]
    return [x for w in _WAITING[head] for x in _completed(w)]


#: All items that a column can have.
ITEMS = sorted({x for h, bodies in GRAMMAR.items() for body in bodies for i in range(len(body) + 1) for x in _completed((h, body[i:])) if not x[1] or x[1][0] not in GRAMMAR})


def _put(column: Column, item: Item, weight: tuple[int, str]) -> None:
    for x in _completed(item):
        if x not in column or weight < column[x]:
            column[x] = weight


def with_inserts(column: Column) -> Column:
    """The column once rows are inserted: dearer items come from cheaper ones, so each is settled when it's the least."""
    best, settled = dict(column), set()
    heap = [(w, i) for i, w in best.items()]
    heapq.heapify(heap)
    while heap:
        (cost, audit), item = heapq.heappop(heap)
        if item in settled:
            continue
        settled.add(item)
        head, rest = item
        if rest and rest[0] in ROLES:
            before = dict(best)
            _put(best, (head, rest[1:]), (cost + INSERT, audit + "I"))
            for x in best:
                if best[x] != before.get(x):
                    heapq.heappush(heap, (best[x], x))
    return best


def scanned(column: Column, token: str) -> Column:
    """The next column: each item over a row by deleting it, keeping it or giving it another role.

    A token is the role's first letter (x for any but s, u, a), as a capital if the text is cut off, or d if the row has to go.
    """
    out: Column = {}
    extra = CUT_OFF if token.isupper() else 0
    for (head, rest), (cost, audit) in with_inserts(column).items():
        _put(out, (head, rest), (cost + DELETE, audit + "D"))
        if token != "d" and rest:
            if rest[0] == token.lower():
                _put(out, (head, rest[1:]), (cost + extra, audit + "K"))
            elif rest[0] in ROLES:
                _put(out, (head, rest[1:]), (cost + REROLE + extra, audit + "R"))
    return out


@lru_cache(4096)
def chart(tokens: str) -> dict[Item, Column]:
    """The last column over all tokens for each item that a chart can start from."""
    out = {}
    for item in ITEMS:
        column: Column = {item: (0, "")}
        for token in tokens:
            column = scanned(column, token)
        out[item] = column
    return out


class Joined:
    """Charts of a conversation's pieces, joined in order: for each item its cost, the rank of its audit, and where it came from."""

    def __init__(self):
        self.items: dict[Item, tuple[int, int]] = dict.fromkeys(START, (0, 0))
        self.steps: list[dict[Item, Item]] = []

    def add(self, tokens: str) -> None:
        # audits up to here have as many rows each and end with one, so none is the beginning of another: ranks decide
        best: dict[Item, tuple[int, int, str, Item]] = {}
        for start, column in chart(tokens).items():
            if start in self.items:
                cost, rank = self.items[start]
                for item, (more, audit) in column.items():
                    way = (cost + more, rank, audit, start)
                    if item not in best or way < best[item]:
                        best[item] = way
        ranks = {x: i for i, x in enumerate(sorted({way[1:3] for way in best.values()}))}
        self.items = {item: (way[0], ranks[way[1:3]]) for item, way in best.items()}
        self.steps.append({item: way[3] for item, way in best.items()})

    def result(self) -> tuple[int, list[tuple[Item, Item]], str]:
        """The least cost, each piece's first and last item, and the edits after the last row."""
        cost, _, tail, item = min((c + more, rank, audit, x) for x, (c, rank) in self.items.items() for done, (more, audit) in with_inserts({x: (0, "")}).items() if done == DONE)
        spans = []
        for step in reversed(self.steps):
            spans.append((step[item], item))
            item = step[item]
        return cost, spans[::-1], tail


def edits(start: Item, audit: str, tokens: str):
    """(row, role, inserted): what stays and what is inserted, in order; role is null where a row keeps its own."""
    (head, rest), row = start, 0
    for letter in audit:
        if letter == "D":
            row += 1
            continue
        role = ROLES.get(rest[0])
        yield row, None if letter == "K" else role, letter == "I"
        row += letter != "I"
        head, rest = next(x for x in _completed((head, rest[1:])) if x[1] or x == (head, rest[1:]))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after damage by the CRC of `conv_id:turn`, n times each. Null roles and texts, and null ids and turns in the CRC, are one space."""
    crc = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), crc.alias("fate")).where("fate != 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("n"))


def _same(x: str, y: str):
    return F.col(x).eqNullSafe(F.col(y))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) of rows (conv_id, turn, role, text) and, where it is given, n, how often a row stands there.

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, one row for each conversation. turns: conv_id, pid,
    k, role, text of the repaired rows, in order of pid and k. A conversation's rows are in the order of turn (nulls first), role and a hash of
    the text, so repeated rows are neighbours, and all but the first are duplicates, as is what an earlier turn said in the same role. Of a row's faults the
    first of blank, duplicate, truncated counts. Rows blank or duplicate have to go. Null roles and texts are empty, a null conv_id is a conversation. An empty
    table gives no rows; other columns are ignored. Texts are shuffled to drop repeated rows and no more: the parse reads hashes.
    """
    spark = rows.sparkSession
    ship(spark)
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(11), text).alias("t2"), text.alias("text"), F.col("n") if "n" in rows.columns else F.lit(1).cast("long").alias("n"))
    key = ["conv_id", "turn", "role", "t1", "t2"]
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", 1).when(~last.isin(".", "!", "?"), 2).otherwise(0)
    light = cut(rows.select(*key, "n", fault.alias("fault")).groupBy(*key).agg(F.sum("n").alias("n"), F.max("fault").alias("fault")))
    # what was said before: the first turn of each role's text, aggregated before it is shuffled, and joined from a table of its own
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = light.where("fault != 1").groupBy("conv_id", "role", "t1", "t2").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    said = cut(said.select(*(F.col(c).alias(f"s_{c}") for c in ("conv_id", "role", "t1", "t2")), "first"))
    again = F.col("first").isNotNull() & (F.col("first") < when)
    condition = _same("conv_id", "s_conv_id") & (F.col("role") == F.col("s_role")) & (F.col("t1") == F.col("s_t1")) & (F.col("t2") == F.col("s_t2"))
    light = light.join(sized_broadcast(said, said.count(), FEW), condition, "left").select(*key, "n", "fault", F.coalesce(again, F.lit(False)).alias("again"))
    light = cut(light)

    id_kind = light.schema["conv_id"].dataType
    longs = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")
    kind = T.StructType([T.StructField("conv_id", id_kind), T.StructField("pid", T.LongType()), T.StructField("tokens", T.StringType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("rows", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType())])))])
    arrow = _arrow(kind)

    def pieces(batches):
        """Up to PIECE rows of one conversation each, in order: tokens, counts, and the keys of the rows that may stay."""
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId() << 32
        open_: dict | None = None
        for batch in released(batches):
            out = []
            for conv, turn, role_, t1, t2, n, fault_, again_ in zip(*(c.to_pylist() for c in batch.columns)):
                initial = role_[:1]
                letter = initial if initial in ("s", "u", "a") else "x"
                head = "d" if fault_ == 1 or again_ else letter.upper() if fault_ == 2 else letter
                done = 0
                while done < n:
                    if open_ is None or open_["conv_id"] != conv or len(open_["tokens"]) >= PIECE:
                        if open_ is not None:
                            out.append(open_)
                        open_ = {"conv_id": conv, "pid": pid, "tokens": "", "first": initial, "last": None, **dict.fromkeys(longs, 0), "low": None, "high": None, "rows": []}
                        pid += 1
                    take = min(n - done, PIECE - len(open_["tokens"]))
                    first = head if not done else "d"
                    if open_["last"] is not None and open_["last"] + initial not in NEIGHBOURS:
                        open_["illegal"] += 1
                    if initial + initial not in NEIGHBOURS:
                        open_["illegal"] += take - 1
                    if first != "d":
                        open_["rows"].append({"at": len(open_["tokens"]), "turn": turn, "role": role_, "t1": t1, "t2": t2})
                        open_["truncated"] += fault_ == 2
                    if fault_ == 1:
                        open_["blank"] += take
                    else:
                        open_["duplicate"] += take - (first != "d")
                    if turn is not None:
                        open_["turns"] += open_["high"] != turn
                        open_["low"] = turn if open_["low"] is None else open_["low"]
                        open_["high"] = turn
                    open_["last"] = initial
                    open_["tokens"] += first + "d" * (take - 1)
                    done += take
            yield pa.RecordBatch.from_pylist(out, arrow)
        yield pa.RecordBatch.from_pylist([open_] if open_ is not None else [], arrow)

    made = cut(light.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(pieces, kind))

    sums = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    fold_kind = T.StructType([T.StructField("conv_id", id_kind), T.StructField("f_pid", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("tail", T.StringType()), *(T.StructField(c, T.LongType()) for c in sums), T.StructField("audit", T.StringType())])
    fold_arrow = _arrow(fold_kind)

    def fold(batches):
        """Joins a conversation's pieces: for each the items that it begins and ends with, and with the last what is known of the whole."""

        def closed(pids, tokens, joined, total):
            cost, spans, tail = joined.result()
            audit = "".join([chart(t)[x][y][1] for t, (x, y) in zip(tokens, spans)]) + tail
            low, high = total["low"], total["high"]
            gaps = 0 if low is None else high - low + 1 - total["turns"]
            out = [{"conv_id": total["conv_id"], "f_pid": p, "start": ITEMS.index(x), "end": ITEMS.index(y), "tail": ""} for p, (x, y) in zip(pids, spans)]
            out[-1] |= {"tail": tail, "gaps": gaps, "cost": cost, "audit": audit, **{c: total[c] for c in sums[1:5]}}
            return out

        state = None
        for batch in released(batches):
            out = []
            for row in batch.to_pylist():
                if state is None or state[3]["conv_id"] != row["conv_id"]:
                    if state is not None:
                        out += closed(*state)
                    state = [], [], Joined(), row
                else:
                    total = state[3]
                    total["illegal"] += total["last"] + row["first"] not in NEIGHBOURS
                    total["turns"] -= total["high"] is not None and total["high"] == row["low"]  # a turn may go on in the next piece
                    for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                        total[c] += row[c]
                    total["low"] = row["low"] if total["low"] is None else total["low"]
                    total["high"] = total["high"] if row["high"] is None else row["high"]
                    total["last"] = row["last"]
                state[0].append(row["pid"])
                state[1].append(row["tokens"])
                state[2].add(row["tokens"])
            yield pa.RecordBatch.from_pylist(out, fold_arrow)
        yield pa.RecordBatch.from_pylist(closed(*state) if state is not None else [], fold_arrow)

    folded = cut(made.drop("rows").repartition("conv_id").sortWithinPartitions("conv_id", "pid").mapInArrow(fold, fold_kind))

    edit_kind = T.StructType([T.StructField("e_conv_id", id_kind), T.StructField("pid", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("e_turn", T.LongType()), T.StructField("e_role", T.StringType()), T.StructField("e_t1", T.LongType()), T.StructField("e_t2", T.LongType()), T.StructField("new_role", T.StringType()), T.StructField("inserted", T.BooleanType())])
    edit_arrow = _arrow(edit_kind)

    def edited(batches):
        for batch in released(batches):
            for start in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(start, 256).to_pylist():
                    first, audit = ITEMS[row["start"]], chart(row["tokens"])[ITEMS[row["start"]]][ITEMS[row["end"]]][1] + row["tail"]
                    by_place = {r["at"]: r for r in row["rows"]}
                    for k, (at, role_, inserted) in enumerate(edits(first, audit, row["tokens"])):
                        own = {"turn": None, "role": None, "t1": None, "t2": None} if inserted else by_place[at]
                        out.append({"e_conv_id": row["conv_id"], "pid": row["pid"], "k": k, **{f"e_{c}": own[c] for c in ("turn", "role", "t1", "t2")}, "new_role": role_ or own["role"], "inserted": inserted})
                yield pa.RecordBatch.from_pylist(out, edit_arrow)

    chosen = made.select("conv_id", "pid", "tokens", "rows").join(folded.select("f_pid", "start", "end", "tail"), F.col("pid") == F.col("f_pid")).drop("f_pid")
    told = cut(chosen.mapInArrow(edited, edit_kind))
    texts = rows.groupBy(*key).agg(F.first("text").alias("text"))
    match = _same("conv_id", "e_conv_id") & _same("turn", "e_turn") & (F.col("role") == F.col("e_role")) & (F.col("t1") == F.col("e_t1")) & (F.col("t2") == F.col("e_t2"))
    kept = told.where("not inserted").join(texts, match).select(F.col("e_conv_id").alias("conv_id"), "pid", "k", F.col("new_role").alias("role"), "text")
    turns = kept.unionByName(told.where("inserted").select(F.col("e_conv_id").alias("conv_id"), "pid", "k", F.col("new_role").alias("role"), F.lit("").alias("text")))
    return folded.where("audit is not null").select("conv_id", *sums, "audit"), turns


def _arrow(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of turns (conv_id, pid, k, role, text): `role:text`, joined by newlines. A digest reads its conversation in order, row by row, and holds none of it."""
    ship(turns.sparkSession)
    kind = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), T.StructField("repaired_sha256", T.StringType())])
    arrow = _arrow(kind)

    def run(batches):
        state = None
        for batch in released(batches):
            out = []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(3)):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append({"conv_id": state[0], "repaired_sha256": state[1].hexdigest()})
                    state = conv, hashlib.sha256()
                else:
                    state[1].update(b"\n")
                state[1].update(line.as_py())
            yield pa.RecordBatch.from_pylist(out, arrow)
        yield pa.RecordBatch.from_pylist([{"conv_id": state[0], "repaired_sha256": state[1].hexdigest()}] if state is not None else [], arrow)

    lines = turns.select("conv_id", "pid", "k", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "pid", "k").mapInArrow(run, kind)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired. Nulls, empty texts, ties and repeated rows as in damaged and repair; conversations without rows after damage have zeros, an empty audit and the empty string's digest; an empty table gives no rows."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, turns = repair(damaged(conversations))
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    out = ids.join(found, _same("id", "conv_id"), "left").drop("conv_id").join(digests(turns), _same("id", "conv_id"), "left")
    zeros = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return out.select(F.col("id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


_BYTES = "list_transform(range(1, strlen(key) + 1), lambda i: ascii(substr(key, i::INT, 1))::BIGINT)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

#: q: 0 nothing yet, 1 after s, 2 after u, 3 after a.
ORACLE_SQL = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), fated AS (SELECT *, {_CRC} % 20 AS fate FROM src
), damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(x)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r, left(role, 1) AS i,
         NOT regexp_matches(text, '{WORD}') AS blank, right(regexp_replace(text, '[{SPACE}]+$', ''), 1) NOT IN ('.', '!', '?') AS cut
  FROM damaged
), seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 AS again FROM placed
), judged AS (
  SELECT *, blank OR again AS goes, (cut AND NOT blank AND NOT again)::INT AS extra, lag(i) OVER (PARTITION BY conv_id ORDER BY r) || i NOT IN ('su', 'ua', 'au') AS illegal FROM seen
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE again AND NOT blank) AS duplicate, sum(extra) AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM judged GROUP BY conv_id
), inserts(q, q2, letters, added) AS (
  VALUES (0, 0, '', []::VARCHAR[]), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']), (3, 2, 'I', ['user:']),
         (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:']), (2, 2, 'II', ['assistant:', 'user:']), (3, 3, 'II', ['user:', 'assistant:'])
), moves(q2, initial, role, q3) AS (VALUES (0, 's', NULL, 1), (0, 'u', 'user', 2), (1, 'u', 'user', 2), (2, 'a', 'assistant', 3), (3, 'u', 'user', 2)
), edits AS (
  SELECT conv_id, r, q, q2 AS q3, {DELETE} + {INSERT} * length(letters) AS cost, letters || 'D' AS audit, added AS lines FROM judged, inserts
  UNION ALL
  SELECT conv_id, r, q, q3, (CASE WHEN i = initial THEN 0 ELSE {REROLE} END) + extra + {INSERT} * length(letters), letters || CASE WHEN i = initial THEN 'K' ELSE 'R' END,
         list_append(added, CASE WHEN i = initial THEN judged.role ELSE moves.role END || ':' || text)
  FROM judged, inserts JOIN moves USING (q2) WHERE NOT goes AND (i = initial OR moves.role IS NOT NULL)
), chart(conv_id, r, q, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} FROM conversations
  UNION ALL
  SELECT c.conv_id, c.r + 1, e.q3, min({{'cost': best.cost + e.cost, 'audit': best.audit || e.audit, 'lines': best.lines || e.lines}})
  FROM chart c JOIN edits e ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND e.r = c.r + 1 AND e.q = c.q GROUP BY c.conv_id, c.r, e.q3
), ended AS (
  SELECT chart.conv_id, any_value(gaps) AS gaps, any_value(blank) AS blank, any_value(duplicate) AS duplicate, any_value(truncated) AS truncated, any_value(illegal) AS illegal,
         min({{'cost': best.cost + {INSERT} * length(letters), 'audit': best.audit || letters, 'lines': best.lines || added}}) AS best
  FROM chart LEFT JOIN counted ON chart.conv_id IS NOT DISTINCT FROM counted.conv_id JOIN inserts USING (q)
  WHERE r = coalesce(n, 0) AND (q2 = 3 OR (q2 = 0 AND letters = '')) GROUP BY chart.conv_id
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM ended
"""

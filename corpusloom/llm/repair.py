"""Conversation structure repair by a run-length dynamic program.

A conversation is a string of symbols: a row's role and its fault. Equal neighbours form runs. What a row may cost between
two states of the pattern `(s?(ua)+)?` is a 4 x 4 matrix over (min, +), so a run of n rows is its n-th power, put together
from cached binary powers; the costs from each row to the end are carried back over runs, and the cheapest edits with the
least audit are then read off from the front.

Rows are sorted by ranges of (conversation, turn), so that a conversation, however long, is a chain of segments of SEGMENT
rows at most that lie on any number of tasks. Segments meet as matrices only: costs go back over them, states forward.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows, and characters, of a segment.
SEGMENT, SEGMENT_CHARS = 4096, 4 << 20
SPACE = " \t\n\x0b\x0c\r"
#: A row's symbol: its role's initial, and its fault: `.` none, `t` truncated, `x` one that must go.
INITIALS = "sua"
INF = 1 << 60
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant. The state, and role, that a rerole or insert leads to.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
TURN = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {("s", EMPTY): SYSTEM, ("u", EMPTY): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: Costs from each state at the end of a conversation: inserts until it is empty or after an assistant.
FINAL = (0, 2 * INSERT, INSERT, 0)


def edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of what may be done with a row, ASCII-least first."""
    role, fault = symbol
    found = [("D", DELETE, state)]
    if fault != "x":
        extra = TRUNCATED * (fault == "t")
        if (role, state) in KEPT:
            found.append(("K", KEEP + extra, KEPT[role, state]))
        found.append(("R", REROLE + extra, TURN[state]))
    return found


def inserted(state: int) -> list[tuple[int, int]]:
    """(cost, state) with no, one or two inserts before a row; more come back to a state that was there."""
    return [(0, state), (INSERT, TURN[state]), (2 * INSERT, TURN[TURN[state]])]


def times(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def applied(a: tuple, v: tuple) -> tuple:
    return tuple(min(min(a[i][k] + v[k] for k in range(4)), INF) for i in range(4))


@lru_cache(maxsize=1024)
def power(symbol: str, k: int) -> tuple:
    """The matrix of 2**k rows with this symbol."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    best = [[INF] * 4 for _ in range(4)]
    for state in range(4):
        for paid, s in inserted(state):
            for _, cost, then in edits(symbol, s):
                best[state][then] = min(best[state][then], paid + cost)
    return tuple(map(tuple, best))


def back(symbol: str, n: int, after: tuple) -> tuple:
    """Costs from each state before n rows with this symbol, given those after them."""
    k = 0
    while n:
        if n & 1:
            after = applied(power(symbol, k), after)
        n, k = n >> 1, k + 1
    return after


def runs(symbols: str) -> list[tuple[str, int]]:
    return [(s, len(list(g))) for s, g in groupby(symbols[i : i + 2] for i in range(0, len(symbols), 2))]


def matrix(symbols: str) -> list[int]:
    """A segment's matrix, row by row."""
    columns = []
    for j in range(4):
        v = tuple(0 if i == j else INF for i in range(4))
        for symbol, n in reversed(runs(symbols)):
            v = back(symbol, n, v)
        columns.append(v)
    return [columns[j][i] for i in range(4) for j in range(4)]


@lru_cache(maxsize=1 << 14)
def unrolled(symbols: str, after: tuple, state: int, last: bool) -> tuple[str, int]:
    """The audit of a segment from a state on, and the state that it leaves. after: costs from each state behind it."""
    parts, v = runs(symbols), after
    ends = []
    for symbol, n in reversed(parts):
        ends.append(v)
        v = back(symbol, n, v)
    audit = []
    for (symbol, n), end in zip(parts, reversed(ends), strict=True):
        costs = [end]
        for _ in range(n):
            costs.append(applied(power(symbol, 0), costs[-1]))
        for left in range(n, 0, -1):
            goal, then = costs[left], costs[left - 1]
            while True:
                options = [(e, s) for e, cost, s in edits(symbol, state) if cost + then[s] == goal[state]]
                if INSERT + goal[TURN[state]] == goal[state]:
                    options.append(("I", TURN[state]))
                edit, state = min(options)
                audit.append(edit)
                if edit != "I":
                    break
    while last and FINAL[state]:
        audit.append("I")
        state = TURN[state]
    return "".join(audit), state


def repaired(audit: str, roles: list[str], texts: list[str], state: int) -> list[str]:
    """The repaired rows of a segment as `role:text`."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            state = TURN[state]
            out.append(f"{NAMES[state]}:")
            continue
        if edit == "K":
            state = KEPT[roles[at][:1], state]
            out.append(f"{roles[at]}:{texts[at]}")
        elif edit == "R":
            state = TURN[state]
            out.append(f"{NAMES[state]}:{texts[at]}")
        at += 1
    return out


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults that crc32 of `conv_id:turn` modulo 20 deals out; nulls in role, text and the key are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return x.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def faults(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with fault: the first of blank, duplicate, truncated, or null; and tie, which tells equal rows apart."""
    x = turns.select("conv_id", "turn", "role", "text").withColumns({"tie": F.monotonically_increasing_id(), "key": F.sha2("text", 256)})
    x = written(x)
    place = F.struct("turn", "tie")
    again = x.groupBy("conv_id", "role", "key").agg(F.min(F.struct(F.col("turn").isNotNull(), *(F.col(c) for c in ("turn", "tie")))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("key").alias("_key"), F.struct("first.turn", "first.tie").alias("first"))
    core = F.rtrim("text", F.lit(SPACE))
    x = x.join(again, same("conv_id", "_conv") & same("role", "_role") & same("key", "_key"), "left")
    fault = F.when(core == "", "blank").when(F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first")), "duplicate").when(~F.right(core, F.lit(1)).isin(".", "!", "?"), "truncated")
    return x.select("conv_id", "turn", "role", "text", fault.alias("fault"), "tie")


def segments(rows: DataFrame) -> DataFrame:
    """Rows in order of (conv_id, turn, role, text), cut into segments of one conversation each."""
    conv = rows.schema["conv_id"].dataType.simpleString()

    def cut(batches):
        part, made = TaskContext.get().partitionId(), 0
        own, held, chars = None, [], 0

        def closed():
            nonlocal made, held, chars
            out = {"conv_id": own[0], "segment": (part << 32) + made, "symbols": "".join(h[0] for h in held), "roles": [h[1] for h in held], "texts": [h[2] for h in held]}
            made, held, chars = made + 1, [], 0
            return out

        schema = None
        for batch in batches:
            names = pa.field("conv_id", batch.schema.field("conv_id").type)
            schema = pa.schema([names, ("segment", pa.int64()), ("symbols", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
            out = []
            for conv_id, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "fault")), strict=True):
                if held and ((conv_id,) != own or len(held) >= SEGMENT or chars >= SEGMENT_CHARS):
                    out.append(closed())
                own = (conv_id,)
                initial = role[:1] if role[:1] in INITIALS else "-"
                held.append(((initial or "-") + {None: ".", "truncated": "t"}.get(fault, "x"), role, text))
                chars += len(text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([closed()], schema)

    order = ["conv_id", "turn", "role", "text", "tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", "fault")
    return written(rows.mapInArrow(cut, f"conv_id {conv}, segment long, symbols string, roles array<string>, texts array<string>"))


def illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


def whole(segs: DataFrame) -> DataFrame:
    """Conversations of one segment: conv_id, illegal, cost, audit, repaired_sha256."""

    def run(batches):
        for batch in batches:
            cols = [[], [], [], []]
            for symbols, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("symbols", "roles", "texts")), strict=True):
                audit, _ = unrolled(symbols, FINAL, EMPTY, True)
                v = FINAL
                for symbol, n in reversed(runs(symbols)):
                    v = back(symbol, n, v)
                text = "\n".join(repaired(audit, roles, texts, EMPTY))
                for c, value in zip(cols, (illegal(roles), v[EMPTY], audit, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()), strict=True):
                    c.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["conv_id", "illegal", "cost", "audit", "repaired_sha256"])

    conv = segs.schema["conv_id"].dataType.simpleString()
    return segs.select("conv_id", "symbols", "roles", "texts").mapInArrow(run, f"conv_id {conv}, illegal long, cost long, audit string, repaired_sha256 string")


def chained(segs: DataFrame) -> DataFrame:
    """Conversations of several segments, as `whole` has them.

    A chain's segments meet in one task as matrices, and then as the four states that each leads to; texts pass through one
    task in order, as their hash asks for, a batch at a time.
    """
    conv = segs.schema["conv_id"].dataType.simpleString()

    def matrices(batches):
        for batch in batches:
            symbols = batch.column("symbols").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("segment"), pa.array([matrix(s) for s in symbols], pa.list_(pa.int64()))], ["conv_id", "segment", "matrix"])

    def costs(table: pa.Table) -> pa.Table:
        table = table.sort_by("segment")
        v, out = FINAL, []
        for m in reversed(table.column("matrix").to_pylist()):
            out.append(list(v))
            v = applied(tuple(tuple(m[4 * i : 4 * i + 4]) for i in range(4)), v)
        n = len(out)
        return pa.table({"segment": table.column("segment"), "after": pa.array(out[::-1], pa.list_(pa.int64())), "last": pa.array([i == n - 1 for i in range(n)]), "total": pa.array([v[EMPTY]] * n, pa.int64())})

    after = written(segs.select("conv_id", "segment", "symbols").mapInArrow(matrices, f"conv_id {conv}, segment long, matrix array<long>").groupBy("conv_id").applyInArrow(costs, "segment long, after array<long>, last boolean, total long"))

    def exits(batches):
        for batch in batches:
            found = [[unrolled(s, tuple(a), e, z)[1] for e in range(4)] for s, a, z in zip(*(batch.column(c).to_pylist() for c in ("symbols", "after", "last")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("segment"), pa.array(found, pa.list_(pa.int32()))], ["conv_id", "segment", "exits"])

    def entries(table: pa.Table) -> pa.Table:
        table = table.sort_by("segment")
        state, out = EMPTY, []
        for e in table.column("exits").to_pylist():
            out.append(state)
            state = e[state]
        return pa.table({"segment": table.column("segment"), "entry": pa.array(out, pa.int32())})

    led = segs.select("conv_id", "segment", "symbols").join(after, "segment").select("conv_id", "segment", "symbols", "after", "last")
    entry = written(led.mapInArrow(exits, f"conv_id {conv}, segment long, exits array<int>").groupBy("conv_id").applyInArrow(entries, "segment long, entry int"))

    def told(batches):
        own, state = None, None

        def result():
            return {"conv_id": own[0], "illegal": state["illegal"], "cost": state["cost"], "audit": "".join(state["audit"]), "repaired_sha256": state["hash"].hexdigest()}

        schema = None
        for batch in batches:
            schema = pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            out = []
            for r in batch.to_pylist():
                if own != (r["conv_id"],):
                    if own:
                        out.append(result())
                    own, state = (r["conv_id"],), {"illegal": 0, "cost": r["total"], "audit": [], "hash": hashlib.sha256(), "any": False, "role": None}
                audit, _ = unrolled(r["symbols"], tuple(r["after"]), r["entry"], r["last"])
                pieces = repaired(audit, r["roles"], r["texts"], r["entry"])
                state["audit"].append(audit)
                state["illegal"] += illegal(r["roles"] if state["role"] is None else [state["role"], *r["roles"]])
                state["role"] = r["roles"][-1]
                if pieces:
                    state["hash"].update((("\n" if state["any"] else "") + "\n".join(pieces)).encode("utf-8", "surrogatepass"))
                    state["any"] = True
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if own:
            yield pa.RecordBatch.from_pylist([result()], schema)

    x = segs.join(after, "segment").join(entry, "segment").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return x.mapInArrow(told, f"conv_id {conv}, illegal long, cost long, audit string, repaired_sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The rows of a conversation are taken by turn (nulls first; ties by role and text). Null roles and texts are one space;
    a null conv_id is a conversation of its own. A role's initial is its first character; an empty role has none and can't
    be kept. Repeated rows are duplicates of the first. Other columns take no part; no rows give none.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = written(faults(turns.select("conv_id", "turn", said("role"), said("text"))))
    count = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias(f)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    stats = rows.groupBy("conv_id").agg(gaps.alias("gaps"), *(count(f) for f in ("blank", "duplicate", "truncated")))
    segs = segments(rows)
    many = segs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("_many"))
    many = written(many)
    found = whole(segs.join(many, same("conv_id", "_many"), "left_anti")).union(chained(segs.join(many, same("conv_id", "_many"), "left_semi")))
    found = found.withColumnRenamed("conv_id", "_conv")
    return stats.join(found, same("conv_id", "_conv")).drop("_conv")


def repaired_conversations(turns: DataFrame) -> DataFrame:
    """The repair of turns after `damaged`, for every original conv_id; one without rows after damage has zeros, an empty audit and the hash of nothing."""
    own = turns.select(F.col("conv_id").alias("_own")).distinct()
    x = own.join(repair(damaged(turns.select("conv_id", "turn", "role", "text"))), same("_own", "conv_id"), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return x.select(F.col("_own").alias("conv_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

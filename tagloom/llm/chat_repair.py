"""Chat formatting: the cheapest role repair that a legal-turn automaton accepts.

Legal sequences: an optional system turn, then user and assistant in turn,
beginning with user and ending with assistant.  Each turn may be kept, given
another role, or merged into the turn before it, and empty turns may be put in
before it (and at the end); each has a cost.  Dynamic programming over the
automaton's states finds the repair of least total cost.

A long conversation needs no single task.  Turns are sorted by range of
(conv_id, turn) and written, so a conversation may span several parts of the
table.  For a conversation that does, each part gives the least cost from every
state to every state (a small min-plus matrix); these are chained in part order
to fix the states at the part boundaries, and each part repairs its own turns
between them.  There are at most two such matrices per part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.lineage import Scratch

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = ("start", "system", "user", "assistant")
ROLES = ("system", "user", "assistant")
#: Legal next states of each state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs, in hundredths, so that sums are exact.
KEEP, MERGE, RELABEL, INSERT = 0, 60, 100, 90
_INF = 1 << 40
#: Turns of a part of the sorted table, about; parts grow in number with the turns, not in size.
PART_TURNS = 1 << 16


def _insertions() -> np.ndarray:
    """Least cost of going from state to state by empty turns alone; no more than three are ever needed."""
    cost = np.full((4, 4), _INF, np.int64)
    np.fill_diagonal(cost, 0)
    for a, following in LEGAL.items():
        for b in following:
            cost[a, b] = INSERT
    for _ in range(3):
        cost = np.minimum(cost, (cost[:, :, None] + cost[None, :, :]).min(1))
    return cost


_INSERT = _insertions()


def _path(a: int, b: int) -> list[int]:
    """The states entered on the cheapest insertion path from a to b."""
    out = []
    while a != b:
        a = min((s for s in LEGAL[a] if INSERT + _INSERT[s, b] == _INSERT[a, b]))
        out.append(a)
    return out


def _moves(role: int) -> tuple[np.ndarray, np.ndarray]:
    """For a turn of this role (0-2; -1 unknown): least cost from state to state, and how: (action, via state)."""
    cost, how = np.full((4, 4), _INF, np.int64), np.zeros((4, 4, 2), np.int64)
    for a in range(4):
        options: list[tuple[int, int, int, int]] = []  # cost, action, via, to
        for via in range(4):
            if _INSERT[a, via] >= _INF:
                continue
            for to in LEGAL[via]:
                kept = to == role + 1
                options.append((int(_INSERT[a, via]) + (KEEP if kept else RELABEL), 0 if kept else 1, via, to))
        if a != START:
            options.append((MERGE + (0 if a == role + 1 else 20), 2, a, a))
        for c, action, via, to in sorted(options, reverse=True):
            if c <= cost[a, to]:
                cost[a, to], how[a, to] = c, (action, via)
    return cost, how


_MOVES = {r: _moves(r) for r in (-1, 0, 1, 2)}
_FINAL = _INSERT[:, ASSISTANT].copy()
_FINAL[START] = 0  # a conversation without turns stays empty
ACTIONS = ("keep", "relabel", "merge")


def chain(roles: list[int]) -> np.ndarray:
    """Min-plus product of the turns' matrices: least cost from state to state over all of them."""
    total = np.full((4, 4), _INF, np.int64)
    np.fill_diagonal(total, 0)
    for r in roles:
        total = np.minimum((total[:, :, None] + _MOVES[r][0][None, :, :]).min(1), _INF)
    return total


def repair(roles: list[int], start: int = START, end: int | None = None) -> list[tuple[str, str, list[str]]]:
    """(action, role, roles of empty turns put in before it) of each turn, between the given states.

    end None: any state, with the insertions that then close the conversation counted.
    """
    n = len(roles)
    best = np.full((n + 1, 4), _INF, np.int64)
    best[n] = _FINAL if end is None else np.where(np.arange(4) == end, 0, _INF)
    for k in range(n - 1, -1, -1):
        best[k] = np.minimum((_MOVES[roles[k]][0] + best[k + 1][None, :]).min(1), _INF)
    state, out = start, []
    for k, r in enumerate(roles):
        cost, how = _MOVES[r]
        to = int(np.argmin(cost[state] + best[k + 1]))
        action, via = how[state, to]
        out.append((ACTIONS[action], STATES[to], [STATES[s] for s in _path(state, int(via))] if action != 2 else []))
        state = to
    return out


def closing(last_role: str) -> list[str]:
    """Roles of the empty turns that end a conversation legally."""
    return [STATES[s] for s in _path(STATES.index(last_role), ASSISTANT)]


def code(role: str | None) -> int:
    """Place of a role in ROLES, letter case and outer white space aside; -1 for any other."""
    folded = (role or "").strip().lower()
    return ROLES.index(folded) if folded in ROLES else -1


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's part of the table and place in it."""
    part, at = TaskContext.get().partitionId(), 0  # type: ignore[union-attr]
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array([code(r) for r in b.column(2).to_pylist()], pa.int32()), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], [*b.schema.names, "code", "part", "seq"]
        )
        at += n


def _codes(column: pa.Array, row: int) -> list[int]:
    return [x["code"] for x in column[row].as_py()]


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([chain(_codes(b.column(2), k)).ravel().tolist() for k in range(b.num_rows)])], ["conv_id", "part", "cost"])


_DECISION = "part int, seq long, action string, new_role string, inserted array<string>, closing array<string>, first boolean, last boolean"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("part", "seq", "action", "new_role", "inserted", "closing", "first", "last")}
        for k in range(b.num_rows):
            rows = b.column(1)[k].as_py()
            start, end = b.column(2)[k].as_py(), b.column(3)[k].as_py()
            found = repair([r["code"] for r in rows], start, end)
            out["part"] += [b.column(0)[k].as_py()] * len(rows)
            out["seq"] += [r["seq"] for r in rows]
            for name, values in zip(("action", "new_role", "inserted"), zip(*found, strict=True), strict=True):
                out[name] += values
            out["first"] += [start == START, *[False] * (len(rows) - 1)]
            out["last"] += [*[False] * (len(rows) - 1), end is None]
            out["closing"] += [[]] * (len(rows) - 1) + [closing(found[-1][1]) if end is None else []]
        strings = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["part"], pa.int32()), pa.array(out["seq"], pa.int64()), pa.array(out["action"], pa.string()), pa.array(out["new_role"], pa.string()), pa.array(out["inserted"], strings), pa.array(out["closing"], strings), pa.array(out["first"]), pa.array(out["last"])], list(out)
        )


def boundaries(parts: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int | None]]:
    """(part, state before it, state after it) of one conversation, from its parts' matrices in order; the last ends free."""
    ahead = [_FINAL]
    for _, m in reversed(parts):
        ahead.append(np.minimum((m + ahead[-1][None, :]).min(1), _INF))
    ahead.reverse()
    state, out = START, []
    for k, (part, m) in enumerate(parts):
        to = int(np.argmin(m[state] + ahead[k + 1]))
        out.append((part, state, to if k + 1 < len(parts) else None))
        state = to
    return out


def repair_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, action, new_role, inserted, closing, rendered) for each row of turns (conv_id, turn, role, text).

    action: keep, relabel or merge (into the turn before); inserted: roles of
    empty turns put in before; closing: those put in after a conversation's last
    turn; rendered: this row's part of the rendered conversation.

    Turns go by ``turn``, null last; ties by role, then text.  A null or unknown
    role costs a relabel; a null text is empty; null conv_ids are one
    conversation.  Equal rows are turns like others, in any order, and may lie in
    different parts.  More columns are ignored; an empty table gives an empty
    result.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "chats")
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.xxhash64("text")]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-turns.count() // PART_TURNS))
    # a row's place in the input comes last, so that rows that are alike do not share one range
    placed_in = [*order, F.col("place")]
    sorted_ = own.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(n, *placed_in).sortWithinPartitions(*placed_in)
    rows = scratch.save(sorted_.drop("place").mapInArrow(_number, "conv_id long, turn long, role string, text string, code int, part int, seq long"), "rows")
    # a conversation's turns within one part: bounded by the part
    pieces = scratch.save(rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "code"))).alias("codes")), "pieces")
    spans = pieces.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"))
    across = pieces.join(spans, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").mapInArrow(_chains, "conv_id long, part int, cost array<long>")
    # a part holds the end of one such conversation and the start of another at most
    by: dict[object, list[tuple[int, np.ndarray]]] = {}
    for r in across.collect():
        by.setdefault(r.conv_id, []).append((r.part, np.array(r.cost, np.int64).reshape(4, 4)))
    states = [(conv, *x) for conv, parts in by.items() for x in boundaries(sorted(parts, key=lambda p: p[0]))]
    known = spark.createDataFrame(states, "c long, p int, before int, after int")
    placed = pieces.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    decided = placed.select("part", "codes", F.coalesce("before", F.lit(START)).alias("before"), "after").mapInArrow(_decide, _DECISION)
    empty = lambda role: F.concat(F.lit("<|"), role, F.lit("|>\n<|end|>\n"))
    # the end mark of a turn stands before the next turn, since merged rows go on in the same one
    opened = F.concat(F.when(F.col("first"), F.lit("")).otherwise(F.lit("<|end|>\n")), F.array_join(F.transform("inserted", empty), ""), F.lit("<|"), F.col("new_role"), F.lit("|>\n"))
    head = F.when(F.col("action") == "merge", F.lit("")).otherwise(opened)
    tail = F.when(F.col("last"), F.concat(F.lit("<|end|>\n"), F.array_join(F.transform("closing", empty), ""))).otherwise(F.lit(""))
    joined = rows.join(decided, ["part", "seq"])
    return joined.select(
        "conv_id", "turn", "role", "action", "new_role", "inserted", "closing",
        F.concat(head, F.coalesce("text", F.lit("")), F.lit("\n"), tail).alias("rendered"),
    )

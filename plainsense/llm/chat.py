"""Chat formatting by minimum-cost role repair: dynamic programming over an automaton of legal turns.

A legal chat is an optional system message, then user and assistant messages in turn, ending with the assistant. Each
turn of a conversation either starts a message (with its role or relabelled, after empty messages where the automaton
needs them) or is merged into the message before; the repair of least total cost is rendered.

The conversations are range-sorted and cut into blocks of at most ``BLOCK`` turns. For a conversation within one block
the dynamic program is run there. For one that crosses blocks, each block gives its cost matrix between automaton
states, the matrices (one small row for each block) are chained for each conversation, and every block is then repaired
between its fixed states: no task holds a whole long conversation, and the result is the same as if one had.

Defined results: a null conv_id is one conversation of its own; turns are ordered by turn (nulls last), then role, then
text; unknown and null roles may take any role at a small cost; a null text is empty; repeated rows are turns like
others; of equally cheap repairs the one that prefers earlier automaton states at the end is taken; an empty table
gives an empty result; extra columns are ignored. Marker strings inside texts are broken up by a blank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import kept, map_texts

BLOCK = 4096
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")

# fixed values: other names in use for the roles
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}

#: Empty messages needed before a new message of a role (column) in a state (row); None: it can't be had.
BETWEEN: tuple[tuple[tuple[int, ...] | None, ...], ...] = (
    (None, (), (), (USER,)),
    (None, None, (), (USER,)),
    (None, None, (ASSISTANT,), ()),
    (None, None, (), (USER,)),
)
AT_END: tuple[tuple[int, ...], ...] = ((USER, ASSISTANT), (USER, ASSISTANT), (ASSISTANT,), ())


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    relabel: int = 3
    unknown: int = 1
    insert: int = 2


def role_code(role: str | None) -> int:
    r = (role or "").strip().lower()
    r = ALIASES.get(r, r)
    return NAMES.index(r) if r in NAMES[1:] else START


class Automaton:
    """Transition costs of a turn: cost[role][state][next state], and whether the turn is merged."""

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        self.cost = np.full((4, 4, 4), np.inf)
        self.merged = np.zeros((4, 4, 4), bool)
        for role in range(4):
            for s in range(4):
                for t in range(1, 4):
                    label = 0 if role == t else costs.unknown if role == START else costs.relabel
                    new = np.inf if BETWEEN[s][t] is None else costs.insert * len(BETWEEN[s][t])
                    merge = costs.merge if s == t else np.inf
                    self.merged[role, s, t] = merge <= new and merge < np.inf
                    self.cost[role, s, t] = label + min(new, merge)
        self.final = np.array([costs.insert * len(x) for x in AT_END], float)

    def matrix(self, roles: list[int]) -> np.ndarray:
        """Least costs from each state to each state over the turns."""
        m = np.where(np.eye(4, dtype=bool), 0, np.inf)
        for r in roles:
            m = (m[:, :, None] + self.cost[r][None]).min(1)
        return m

    def path(self, roles: list[int], first: int, last: int | None) -> list[int]:
        """The states after each turn of a cheapest way from ``first`` to ``last`` (None: to the cheapest end)."""
        best, back = np.full(4, np.inf), []
        best[first] = 0
        for r in roles:
            step = best[:, None] + self.cost[r]
            back.append(step.argmin(0))
            best = step.min(0)
        state = int((best + self.final).argmin()) if last is None else last
        out = []
        for b in reversed(back):
            out.append(state)
            state = int(b[state])
        return out[::-1]


def _open(role: int) -> str:
    return f"<|im_start|>{NAMES[role]}\n"


_CLOSE = "<|im_end|>\n"


def _empty(roles: tuple[int, ...]) -> str:
    return "".join(_open(r) + _CLOSE for r in roles)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows with equal (block, conv_id), which are the first two columns, from sorted batches."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if held and held[-1][:2] != row[:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def repair(conversations: DataFrame, costs: Costs = Costs(), block: int = BLOCK) -> DataFrame:
    """One row per turn: conv_id, position, turn, role, new_role, action, n_inserted, cost, rendered.

    The rendered pieces of a conversation, joined in order of position, are its chat.
    """
    key, turn = conversations.schema["conv_id"], conversations.schema["turn"]
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last()]
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id())
    # the order is fixed by writing it: a block is a run of rows of one partition
    turns = kept(turns.withColumn("block", F.floor(F.col("ord") / block).cast("long")), "chat-turns")
    where = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("conv_id")
    where = where.withColumn("blocks", F.count(F.lit(1)).over(inside)).where("blocks > 1")
    rule = Automaton(costs)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            m = rule.matrix([role_code(r[2]) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int64()), pa.array([rows[0][1]], key_type), pa.array([len(rows)], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["block", "conv_id", "n", "m"])

    from pyspark.sql.pandas.types import to_arrow_type

    key_type, turn_type = to_arrow_type(key.dataType), to_arrow_type(turn.dataType)
    same = (turns["conv_id"].eqNullSafe(where["conv_id"])) & (turns["block"] == where["block"])
    crossing = turns.join(where, same, "left_semi").select("block", "conv_id", "role", "ord").repartition("block").sortWithinPartitions("block", "ord")
    m_schema = T.StructType([T.StructField("block", T.LongType()), key, T.StructField("n", T.LongType()), T.StructField("m", T.ArrayType(T.DoubleType()))])
    chained = map_texts(crossing, matrices, m_schema)

    def chain(table: pa.Table) -> pa.Table:
        t = table.sort_by("block")
        ms = [np.array(x).reshape(4, 4) for x in t.column("m").to_pylist()]
        best, back = np.array([0, np.inf, np.inf, np.inf]), []
        for m in ms:
            step = best[:, None] + m
            back.append(step.argmin(0))
            best = step.min(0)
        state, states = int((best + rule.final).argmin()), []
        for b in reversed(back):
            states.append((int(b[state]), state))
            state = int(b[state])
        n = np.array(t.column("n").to_pylist())
        ends = [s for _, s in states[::-1]]
        return pa.table({"c_conv": t.column("conv_id"), "c_block": t.column("block"), "first": pa.array([s for s, _ in states[::-1]], pa.int32()), "last": pa.array(ends, pa.int32()), "before": pa.array(np.cumsum(n) - n, pa.int64()), "closes": pa.array([i == len(ms) - 1 for i in range(len(ms))])})

    c_schema = T.StructType([T.StructField("c_conv", key.dataType), *[T.StructField(c, t) for c, t in (("c_block", T.LongType()), ("first", T.IntegerType()), ("last", T.IntegerType()), ("before", T.LongType()), ("closes", T.BooleanType()))]])
    plan = chained.groupBy("conv_id").applyInArrow(chain, c_schema)
    joined = turns.join(plan, turns["conv_id"].eqNullSafe(plan["c_conv"]) & (turns["block"] == plan["c_block"]), "left")
    joined = joined.select("block", "conv_id", "role", "turn", "text", "first", "last", "before", "closes", "ord").repartition("block").sortWithinPartitions("block", "ord")
    schema = T.StructType([key, T.StructField("position", T.LongType()), turn, *[T.StructField(c, T.StringType()) for c in ("role", "new_role", "action")], T.StructField("n_inserted", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("rendered", T.StringType())])
    types = [key_type, pa.int64(), turn_type, pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()]

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _runs(batches):
            first, last, before, closes = rows[0][5:9]
            state = first or START
            roles = [role_code(r[2]) for r in rows]
            path = rule.path(roles, state, last)
            for i, (row, role, to) in enumerate(zip(rows, roles, path, strict=True)):
                merged = bool(rule.merged[role, state, to])
                put = () if merged else BETWEEN[state][to]
                text = row[4].replace("<|im_", "<| im_")
                piece = "\n" + text if merged else (_CLOSE if state != START else "") + _empty(put) + _open(to) + text
                cost, n_in = rule.cost[role, state, to], len(put)
                if i == len(rows) - 1 and closes is not False:
                    piece += _CLOSE + _empty(AT_END[to])
                    cost, n_in = cost + rule.final[to], n_in + len(AT_END[to])
                action = ("merge" if merged else "keep") + ("" if role == to else "+relabel") + ("+insert" if n_in else "")
                out.append((row[1], (before or 0) + i, row[3], row[2], NAMES[to], action, n_in, int(cost), piece))
                state = to
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[f.name for f in schema])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[f.name for f in schema])

    return map_texts(joined, rendered, schema)

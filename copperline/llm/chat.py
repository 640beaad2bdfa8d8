"""Chat formatting with minimum-cost role repair (operator 4).

A legal conversation is: at most one system turn, first; then user and assistant in turn, from user to assistant.
Dynamic programming over this automaton finds the cheapest way to make the turns legal: a turn may be merged
with the one before (``merge``), given another role (``relabel``; ``unknown`` if its role is none of the known), or
preceded by empty turns (``insert`` each); empty turns may also follow the last one. On equal costs a turn keeps
its role before it merges, merges before it takes another, and user comes before assistant before system.

A turn's costs from state to state are a 4 x 4 matrix, and costs of consecutive turns combine by the
(min, +) product, which is associative. So a conversation may span partitions: turns are range-partitioned and
sorted by (conversation, turn); each partition gives the matrices of its first and last conversation alone,
the driver, which sees at most two rows a partition, chooses the states at the boundaries, and each partition then
finds its own part of the cheapest path on roles only. Texts are rendered by DataFrame functions.

Defined results: role names are compared without case and outer blanks; aliases map to the three roles. Null text is
empty. Null conversation ids are one conversation, null turns come first; equal turns order by role, then a hash of
their text, then as the input has them. Repeated rows are repeated turns. Long texts are rendered whole. An empty table gives no rows. Extra columns are not looked at. In texts ``<|`` is
rendered as ``< |``, so that no text can open or close a turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperline.llm.common import stored

#: States: before the first turn, and after a turn of each role. Roles have the numbers of their states.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ["", "system", "user", "assistant"]
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}
#: Roles in the order in which equal costs are settled.
PREFERRED = (USER, ASSISTANT, SYSTEM)
#: Roles of the empty turns that must come between a state and a turn of another role; absent: not legal.
BETWEEN = {
    (START, SYSTEM): (),
    (START, USER): (),
    (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (),
    (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (),
    (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (),
    (ASSISTANT, ASSISTANT): (USER,),
}
#: Roles of the empty turns that must follow the last turn.
AFTER = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
KEEP, MERGE = 0, 1


@dataclass(frozen=True)
class Costs:
    merge: float = 1.0
    relabel: float = 2.0
    unknown: float = 1.0
    insert: float = 3.0


def moves(role: int, costs: Costs) -> np.ndarray:
    """[from, to, open or merge] costs of a turn; role 0 is unknown."""
    out = np.full((4, 4, 2), np.inf)
    for to in PREFERRED:
        label = 0.0 if role == to else costs.unknown if role == START else costs.relabel
        for state in range(4):
            if (state, to) in BETWEEN:
                out[state, to, KEEP] = label + costs.insert * len(BETWEEN[state, to])
            if state == to:
                out[state, to, MERGE] = label + costs.merge
    return out


def best(step: np.ndarray) -> np.ndarray:
    """[from, to] costs."""
    return step.min(2)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product: the cheapest way through a, then b."""
    return (a[:, :, None] + b[None, :, :]).min(1)


def repair(roles: list[int], costs: Costs, entry: int = START, exit_state: int | None = None, last: bool = True) -> list[tuple[int, int, int]]:
    """(role, 1 if merged, empty turns before) of each turn on the cheapest path; without exit_state it also pays its end."""
    steps = [moves(r, costs) for r in range(4)]
    cost = np.full(4, np.inf)
    cost[entry] = 0.0
    back = np.zeros((len(roles), 4), np.int8)
    rank = np.argsort([PREFERRED.index(s) if s else -1 for s in range(4)], kind="stable")  # states in order of preference
    for t, r in enumerate(roles):
        total = cost[:, None] + best(steps[r])
        back[t] = rank[total[rank].argmin(0)]
        cost = total.min(0)
    if exit_state is None:
        end = cost + (np.array([costs.insert * len(AFTER[s]) for s in range(4)]) if last else 0)
        exit_state = int(rank[end[rank].argmin()])
    out: list[tuple[int, int, int]] = []
    state = exit_state
    for t in range(len(roles) - 1, -1, -1):
        before = int(back[t, state])
        merged = int(steps[roles[t]][before, state].argmin())
        out.append((state, merged, 0 if merged else len(BETWEEN[before, state])))
        state = before
    return out[::-1]


def boundaries(pieces: list[np.ndarray], costs: Costs) -> list[int]:
    """The state after each piece of a conversation, on its cheapest path."""
    rank = np.argsort([PREFERRED.index(s) if s else -1 for s in range(4)], kind="stable")
    cost = np.array([0.0, np.inf, np.inf, np.inf])
    back = []
    for m in pieces:
        total = cost[:, None] + m
        back.append(rank[total[rank].argmin(0)])
        cost = total.min(0)
    end = cost + np.array([costs.insert * len(AFTER[s]) for s in range(4)])
    states = [int(rank[end[rank].argmin()])]
    for b in back[:0:-1]:
        states.append(int(b[states[-1]]))
    return states[::-1]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, list[int], list[int]]]:
    """(part, conversation, rows, roles) of each run of one part and conversation."""
    at, rows, roles = None, [], []
    for batch in batches:
        for part, row, conv, role in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (part, conv) != at:
                if rows:
                    yield *at, rows, roles
                at, rows, roles = (part, conv), [], []
            rows.append(row)
            roles.append(role)
    if rows:
        yield *at, rows, roles


def ordered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns in order, numbered and stored: part, row, conv_id, turn, role, code (of the role), text."""
    name = F.trim(F.lower(F.col(role_col).cast("string")))
    code = F.coalesce(*[F.when(name.isin([k for k, v in ALIASES.items() if v == r]), F.lit(r)) for r in PREFERRED], F.lit(START))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), code.alias("code"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "code", "tie", "place"]  # the place lets one repeated turn fill many partitions
    rows = rows.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "place")
    return stored(rows.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "chat-turns")


def decisions(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(row, new_code, merged, inserted_before, is_first, is_last) of each turn of ``ordered``."""
    n_parts = (rows.agg(F.max("part")).first()[0] or 0) + 1  # a task for each; adaptive execution would join these narrow rows
    narrow = rows.select("part", "row", "conv_id", "code").repartition(n_parts, "part").sortWithinPartitions("part", "row")
    kind = rows.schema["conv_id"].dataType
    arrow = pa.from_numpy_dtype("int64") if kind.simpleString() in ("bigint", "int") else pa.string()
    ddl = "bigint" if arrow == pa.int64() else "string"
    narrow = narrow.select("part", "row", F.col("conv_id").cast(ddl).alias("conv_id"), "code")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = [best(moves(r, costs)) for r in range(4)]

        def total(piece) -> tuple:
            part, conv, rows, roles = piece
            m = np.where(np.eye(4) > 0, 0.0, np.inf)
            for r in roles:
                m = product(m, steps[r])
            return part, conv, rows[0], m.ravel().tolist()

        out, last = [], None
        for piece in _pieces(batches):
            if last is None or last[0] != piece[0]:
                out += [total(last)] if last is not None and out[-1][2] != last[2][0] else []
                out.append(total(piece))
            last = piece
        if last is not None and out[-1][2] != last[2][0]:
            out.append(total(last))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), arrow, pa.int64(), pa.list_(pa.float64())), strict=True)], names=["part", "conv_id", "row", "m"])

    chains: dict[object, list] = {}
    for r in narrow.mapInArrow(ends, f"part int, conv_id {ddl}, row long, m array<double>").collect():  # two rows a partition at most
        chains.setdefault(r.conv_id, []).append((r.row, r.part, np.array(r.m).reshape(4, 4)))
    given: dict[tuple[int, object], tuple[int, int, bool]] = {}
    for conv, pieces in chains.items():
        if len(pieces) > 1:
            pieces.sort(key=lambda p: p[0])
            states = [START, *boundaries([p[2] for p in pieces], costs)]
            for k, p in enumerate(pieces):
                given[p[1], conv] = states[k], states[k + 1], k + 1 == len(pieces)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for part, conv, rows, roles in _pieces(batches):
            entry, leave, last = given.get((part, conv), (START, None, True))
            for k, (row, (role, merged, before)) in enumerate(zip(rows, repair(roles, costs, entry, leave, last), strict=True)):
                out.append((row, role, bool(merged), before, k == 0 and entry == START, last and k + 1 == len(rows)))
            if len(out) >= 10_000:
                yield _decided(out)
                out = []
        if out:
            yield _decided(out)

    return narrow.mapInArrow(decide, "row long, new_code int, merged boolean, inserted_before int, is_first boolean, is_last boolean")


def _decided(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["row", "new_code", "merged", "inserted_before", "is_first", "is_last"])


def _role(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in NAMES]), code + 1)


OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs = Costs()) -> DataFrame:
    """One row per turn, with its part of the rendered conversation.

    Columns: conv_id, place (the turn's place in the conversation's order), turn, role, new_role, merged, relabelled,
    inserted_before, inserted_after, cost, rendered. The rendered parts of a conversation, in the order of place,
    are its text; a turn closes the one before it, the last closes itself.
    """
    rows = ordered(turns, conv_col, turn_col, role_col, text_col)
    made = rows.join(decisions(rows, costs), "row")
    code, new = F.col("code"), F.col("new_code")
    other = F.when(new == USER, F.lit("assistant")).otherwise(F.lit("user"))  # the role of an empty turn before this one
    opened = lambda role: F.concat(F.lit("<|"), role, F.lit("|>\n"))
    empty = F.when(F.col("inserted_before") > 0, F.concat(opened(other), F.lit(CLOSE))).otherwise("")
    closing = F.when(F.col("is_first"), "").otherwise(CLOSE)
    body = F.replace(F.col("text"), F.lit("<|"), F.lit("< |"))
    begun = F.when(F.col("merged"), F.concat(F.lit("\n\n"), body)).otherwise(F.concat(closing, empty, opened(_role(new)), body))
    after = F.when(~F.col("is_last"), 0).when(new == USER, len(AFTER[USER])).when(new == SYSTEM, len(AFTER[SYSTEM])).otherwise(0)
    tail = {s: CLOSE + "".join(OPEN.format(NAMES[r]) + CLOSE for r in AFTER[s]) for s in (SYSTEM, USER, ASSISTANT)}
    end = F.when(~F.col("is_last"), "").when(new == SYSTEM, tail[SYSTEM]).when(new == USER, tail[USER]).otherwise(tail[ASSISTANT])
    label = F.when(code == new, F.lit(0.0)).when(code == START, F.lit(costs.unknown)).otherwise(F.lit(costs.relabel))
    cost = label + F.when(F.col("merged"), costs.merge).otherwise(0.0) + (F.col("inserted_before") + after) * costs.insert
    return made.select("conv_id", F.col("row").alias("place"), "turn", "role", _role(new).alias("new_role"), "merged", (code != new).alias("relabelled"), "inserted_before", after.alias("inserted_after"), cost.alias("cost"), F.concat(begun, end).alias("rendered"))

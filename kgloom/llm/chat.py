"""Minimum-cost role repair of conversations, and their rendering.

Legal conversations: an optional system turn, then user and assistant in turn,
ending with the assistant. A dynamic programme over that automaton picks, turn
by turn, to keep a turn, to merge it into the one before, to give it another
role, or to insert an empty turn, at the least total cost.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm import names

MERGE, INSERT, RELABEL, UNKNOWN = 1, 2, 3, 1
NEXT = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant", "chatbot": "assistant", "developer": "system"}


def known_role(role: str | None) -> str | None:
    r = (role or "").strip().lower()
    r = ALIASES.get(r, r)
    return r if r in NEXT else None


@lru_cache(maxsize=1 << 14)
def repair(roles: tuple[str | None, ...]) -> tuple[int, tuple[tuple[str, int, int], ...]]:
    """(cost, turns), each turn (role, first, end) over the given turns; first = end: inserted.

    Among repairs of equal cost the one that, from the first turn on, rather
    keeps than merges, merges than relabels, relabels than inserts.
    """

    def label(i, r):
        return 0 if roles[i] == r else UNKNOWN if roles[i] is None else RELABEL

    n = len(roles)
    states = (None, "system", "user", "assistant")
    # togo[i][q]: least cost of turns i.. when the last turn written has role q, and the first step
    togo: list[dict] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        best = {}
        for q in states:
            options = []
            if i == n:
                if q == "assistant" or (q is None and n == 0):
                    options.append((0, 0, ("end", None)))
            else:
                for r in NEXT[q]:
                    c = label(i, r)
                    options.append((c + togo[i + 1][r][0], 0 if not c else 2, ("turn", r)))
                if q is not None:
                    options.append((MERGE + label(i, q) + togo[i + 1][q][0], 1, ("merge", q)))
            best[q] = min(options) if options else (float("inf"), 9, ("none", None))
        # insertions stay at i: relax until nothing changes
        changed = True
        while changed:
            changed = False
            for q in states:
                for r in NEXT[q]:
                    c = INSERT + best[r][0]
                    if c < best[q][0]:
                        best[q], changed = (c, 3, ("insert", r)), True
        togo[i] = best
    turns: list[list] = []
    i, q = 0, None
    while True:
        kind, r = togo[i][q][2]
        if kind == "end":
            break
        if kind == "insert":
            turns.append([r, i, i])
        elif kind == "turn":
            turns.append([r, i, i + 1])
            i += 1
        else:
            # an inserted turn takes in the text that is merged into it
            turns[-1][1:] = [turns[-1][1], i + 1]
            i += 1
        q = r
    return togo[0][None][0], tuple(map(tuple, turns))


_PLAN = "struct<cost:int,turns:array<struct<role:string,first:int,stop:int>>>"
_ARROW = pa.struct([("cost", pa.int32()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("first", pa.int32()), ("stop", pa.int32())])))])


def _plan(roles: pa.Array) -> pa.Array:
    out = []
    for given in roles.to_pylist():
        cost, turns = repair(tuple(map(known_role, given)))
        out.append({"cost": cost, "turns": [{"role": r, "first": a, "stop": b} for r, a, b in turns]})
    return pa.array(out, _ARROW)


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", joiner: str = "\n", drop_repeats: bool = False) -> DataFrame:
    """(conv_id, repair_cost, n_turns, rendered) of every conversation.

    Turns go by number; equal numbers, and null ones (first), by role and text.
    Repeated rows are turns like others, unless ``drop_repeats`` makes equal rows
    of a conversation one. A null or unknown role may take any
    role for little; a null text is an empty one and texts merge with a line
    break. Rows without conv_id belong to no conversation and are left out.
    Other columns are ignored; an empty table gives no rows. Texts are rendered
    whole; only the role lists leave the JVM. A conversation is one row of the
    result, and so one task's work.
    """
    rows = turns.select(
        names.col(turns, conv_id).alias("conv_id"), F.struct(names.col(turns, turn).alias("turn"), names.col(turns, role).cast("string").alias("role"), F.coalesce(names.col(turns, text), F.lit("")).alias("text")).alias("x")
    ).where("conv_id is not null")
    convs = rows.groupBy("conv_id").agg(F.sort_array((F.collect_set if drop_repeats else F.collect_list)("x")).alias("x"))
    convs = convs.withColumn("plan", F.arrow_udf(_plan, _PLAN)(F.transform("x", lambda x: x["role"])))
    body = F.transform(
        "plan.turns",
        lambda t: F.concat(
            F.lit("<|"), t["role"], F.lit("|>\n"), F.array_join(F.transform(F.slice("x", t["first"] + 1, t["stop"] - t["first"]), lambda x: x["text"]), joiner), F.lit("<|end|>\n")
        ),
    )
    return convs.select("conv_id", F.col("plan.cost").alias("repair_cost"), F.size("plan.turns").alias("n_turns"), F.array_join(body, "").alias("rendered"))

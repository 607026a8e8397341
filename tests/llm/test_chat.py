import itertools

import pytest

from kgloom.llm import chat

ROLES = ("system", "user", "assistant")


def cheapest(roles):
    """Least cost over all legal conversations that the turns can be laid into."""
    best = {}

    def cost(i, r):
        return 0 if roles[i] == r else chat.UNKNOWN if roles[i] is None else chat.RELABEL

    def go(i, q, inserted):
        key = (i, q, inserted)
        if key in best:
            return best[key]
        out = 0 if i == len(roles) and (q == "assistant" or (q is None and not roles)) else float("inf")
        for r in chat.NEXT[q]:
            if i < len(roles):
                out = min(out, cost(i, r) + go(i + 1, r, 0))
            if inserted < 3:
                out = min(out, chat.INSERT + go(i, r, inserted + 1))
        if i < len(roles) and q is not None:
            out = min(out, chat.MERGE + cost(i, q) + go(i + 1, q, 0))
        best[key] = out
        return out

    return go(0, None, 0)


@pytest.mark.parametrize("n", range(5))
def test_cost_is_the_least(n):
    for roles in itertools.product((*ROLES, None), repeat=n):
        cost, turns = chat.repair(roles)
        assert cost == cheapest(roles), roles
        said = [r for r, _, _ in turns]
        body = said[1:] if said[:1] == ["system"] else said
        assert body == [("user", "assistant")[i % 2] for i in range(len(body))] and len(body) % 2 == 0
        assert [i for _, a, b in turns for i in range(a, b)] == list(range(n))


def test_rendering(spark):
    rows = [(1, 0, "Human", "hi"), (1, 1, "user", "there"), (1, 2, "bot", "yes"), (2, 0, "assistant", "a"), (3, None, None, None), (3, 1, "assistant", "b"), (None, 0, "user", "lost"), (1, 2, "bot", "yes"), (4, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, rendered int")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1].rendered == "<|user|>\nhi\nthere<|end|>\n<|assistant|>\nyes\nyes<|end|>\n" and got[1].repair_cost == 2 * chat.MERGE
    assert got[2].rendered == "<|user|>\n<|end|>\n<|assistant|>\na<|end|>\n" and got[2].repair_cost == chat.INSERT
    assert got[3].n_turns == 2 and got[3].repair_cost == chat.UNKNOWN and "x" * 100_000 in got[4].rendered
    assert chat.format_chats(df.where("false")).count() == 0
    once = {r.conv_id: r for r in chat.format_chats(df, drop_repeats=True).collect()}
    assert once[1].rendered == "<|user|>\nhi\nthere<|end|>\n<|assistant|>\nyes<|end|>\n" and once[1].repair_cost == chat.MERGE
    twice = spark.createDataFrame([(1, None, "user", "a"), (1, None, "user", "a")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(twice).first().rendered == "<|user|>\na\na<|end|>\n<|assistant|>\n<|end|>\n"


def test_whole_table_keeps_every_text(spark, sf):
    t = spark.read.parquet(f"{sf}/conversations.parquet")
    by = {}
    for r in t.collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or "", r.role))
    for r in chat.format_chats(t).collect():
        turns = sorted(by[r.conv_id], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        cost, plan = chat.repair(tuple(chat.known_role(x[3]) for x in turns))
        assert r.repair_cost == cost
        assert r.rendered == "".join(f"<|{role}|>\n" + "\n".join(x[2] for x in turns[a:b]) + "<|end|>\n" for role, a, b in plan)

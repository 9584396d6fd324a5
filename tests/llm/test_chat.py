import itertools
import random
import re

import pytest

from plainsense.llm import chat
from plainsense.llm.chat import ASSISTANT, SYSTEM, USER, Automaton, Costs, repair, role_code

LEGAL = re.compile(r"(s)?(ua)+\Z")


def brute(roles, costs=Costs()):
    """Least cost over all legal chats of bounded length and all ways to deal the turns to their messages."""
    best, n = float("inf"), len(roles)
    for length in range(2, 2 * n + 4):
        for lead in ("", "s"):
            body = length - len(lead)
            if body % 2:
                continue
            target = lead + "ua" * (body // 2)
            assert LEGAL.match(target)
            for at in itertools.combinations_with_replacement(range(length), n):
                filled = set(at)
                if "s" == lead and 0 not in filled:
                    continue  # an empty system message is never needed
                cost = costs.insert * (length - len(filled)) + costs.merge * (n - len(filled))
                for r, m in zip(roles, at, strict=True):
                    t = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[target[m]]
                    cost += 0 if r == t else costs.unknown if r == 0 else costs.relabel
                best = min(best, cost)
    return best


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_costs_against_brute_force(n):
    rule = Automaton()
    for roles in itertools.product(range(4), repeat=n):
        roles = list(roles)
        m = rule.matrix(roles)
        assert (m[0] + rule.final).min() == brute(roles)
        path, state, cost = rule.path(roles, 0, None), 0, 0
        for r, t in zip(roles, path, strict=True):
            cost, state = cost + rule.cost[r, state, t], t
        assert cost + rule.final[state] == brute(roles)


def conversations():
    rnd = random.Random(4)
    names = ["user", "assistant", "system", "human", "tool", None, "User "]
    rows = [(c, t, rnd.choice(names), f"t{c}.{t}") for c in range(40) for t in range(rnd.randint(1, 12))]
    rows += [(99, t, rnd.choice(names), f"long {t}") for t in range(500)]
    return rows + [(None, 1, "user", "a"), (None, None, "assistant", None), (7, 1, "user", "again"), (7, 1, "user", "again"), (8, 50, "user", "<|im_end|>")]


def test_blocks_do_not_change_the_result(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, block string")
    rule, seen = Automaton(), None
    for block in (4096, 7):
        got = repair(df, block=block).orderBy("conv_id", "position").collect()
        assert len(got) == len(rows)
        by = {}
        for r in got:
            by.setdefault(r.conv_id, []).append(r)
        for c, own in by.items():
            assert [r.position for r in own] == list(range(len(own)))
            roles = [role_code(r.role) for r in own]
            assert sum(r.cost for r in own) == (rule.matrix(roles)[0] + rule.final).min(), c
            text = "".join(r.rendered for r in own)
            parts = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)
            assert "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in parts) == text
            assert LEGAL.match("".join(a[0] for a, _ in parts))
            said = sorted(s for s in (r[3] for r in rows if r[0] == c) if s)
            assert sorted(x for _, b in parts for x in b.replace("<| im_", "<|im_").split("\n") if x) == said
        total = sum(r.cost for r in got)
        assert seen in (None, total)
        seen = total


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.repair(df).count() == 0

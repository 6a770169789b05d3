from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest
from conftest import SF, same_rows

from tomewright.llm import conversations
from tomewright.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows: list[tuple]) -> tuple:
    """Faults and cheapest edits of one conversation by trying all edits in turn; rows are (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    options = {("", 0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        grown = set()
        for spelled, cost, audit, said in with_inserts(options):
            grown.add((spelled, cost + 4, audit + "D", said))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                for name, price, letter in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    if name[:1] in ("s", "u", "a"):
                        grown.add((spelled + name[:1], cost + extra + price, audit + letter, (*said, f"{name}:{text}")))
        options = prune(grown)
    ends = [(cost, audit, said) for spelled, cost, audit, said in with_inserts(options) if re.fullmatch("(s?(ua)+)?", spelled)]
    cost, audit, said = min(ends)
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
    )


def with_inserts(options):
    out, new = set(options), set(options)
    for _ in range(3):
        new = {(s + r[0], c + 3, a + "I", (*m, f"{r}:")) for s, c, a, m in new for r in ("user", "assistant")}
        out |= new
    return prune(out)


def prune(options):
    """Only spellings that can still become right; no option is dropped for its cost unless it is far above the best."""
    right = {o for o in options if re.fullmatch("s?(ua)*u?", o[0])}
    best = min(c for _, c, _, _ in right)
    return {o for o in right if o[1] <= best + 9}


def test_op11_equals_sql(spark, duck):
    same_rows(QUERIES["op11_conversations"](spark, SF), duck, ORACLES["op11_conversations"])


def test_repair_equals_all_edits(spark):
    rng = random.Random(7)
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "s", None])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \n", "Why?", None, "é.", "x" * 3000 + "."])
            rows.append((conv, rng.choice([turn, turn, turn + rng.randint(0, 3), None]), role, text))
    rows += [(None, 1, "user", "Hm."), (None, 2, "assistant", "Ah."), (999, None, None, None)]
    got = conversations.repair(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: r for r in got.withColumn("sha", conversations.digest(got.messages)).collect()}
    key = lambda r: (r[0] is None, r[0] or 0)
    for conv, group in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        turns = [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in group]
        r = got.pop(conv)
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.sha) == brute(turns), turns
    assert not got


def test_damage_by_rule(spark):
    rows = [(c, t, "assistant", f"One. Two? {t}!") for c in range(40) for t in range(4)] + [(None, None, None, None)]
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in conversations.damage(spark.createDataFrame(rows, SCHEMA)).collect() if r.present and r.conv_id is not None)
    want = []
    for conv, turn, role, text in rows[:-1]:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(want)


def test_dropped_empty_and_clashing(spark):
    rows = [(1, 0, "user", "Hi.", False, 1, "x"), (2, 0, "user", "Hi.", True, 1, "x"), (2, 1, "assistant", "Ho.", True, 2, "y")]
    df = spark.createDataFrame(rows, SCHEMA + ", present boolean, cost long, fault string")
    got = {r.conv_id: r for r in conversations.repair(df).collect()}
    assert (got[1].cost, got[1].audit, got[1].messages, got[1].gaps) == (0, "", [], 0)
    assert (got[2].cost, got[2].audit, [tuple(m) for m in got[2].messages]) == (0, "KK", [("user", "Hi."), ("assistant", "Ho.")])
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("turns", [2000])
def test_a_long_conversation(spark, turns):
    rows = [(5, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(turns)]
    rows += [(5, 10, "user", "y" * 2_000_000 + ".")]
    got = conversations.repair(spark.createDataFrame(rows, SCHEMA)).collect()[0]
    assert got.cost == 3 and len(got.messages) == turns + 2 and got.audit.count("I") == 1

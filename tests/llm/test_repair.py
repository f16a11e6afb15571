"""Conversation repair against a plain search over all cheapest edits."""

import hashlib
import random
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from cytolake.llm import repair
from cytolake.llm.repair import Costs

WS = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault:
            row = (conv, turn, "user" if fault == 4 else role, "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text)
            out += [row, row] if fault == 3 else [row]
    return out


def plain(rows, ids, costs=Costs()):
    """The result of (conv_id, turn, role, text) rows by a search over suffixes."""
    found = {c: (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in ids}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        kinds, seen = [], set()
        for _, role, text in mine:
            bare = text.rstrip(WS)
            kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "good")
            seen.add((role, text))
        kept = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
        turned = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))

        @cache
        def best(i, place, inserts=0, mine=mine, kinds=kinds):
            """(cost, letters, lines) of the cheapest way from here; at most three inserts in a row, as more can't be of use."""
            options = [(0, "", ())] if i == len(mine) and place in (0, 3) else []
            if inserts < 3:
                to, role = turned[place]
                cost, letters, lines = best(i, to, inserts + 1)
                options.append((cost + costs.insert, "I" + letters, (role + ":", *lines)))
            if i < len(mine):
                _, role, text = mine[i]
                cost, letters, lines = best(i + 1, place)
                options.append((cost + costs.delete, "D" + letters, lines))
                if kinds[i] in ("good", "truncated"):
                    more = costs.truncated * (kinds[i] == "truncated")
                    for letter, price, to, name in [("K", costs.keep, kept[place].get(role[:1]), role), ("R", costs.rerole, *turned[place])]:
                        if to is not None:
                            cost, letters, lines = best(i + 1, to)
                            options.append((cost + price + more, letter + letters, (f"{name}:{text}", *lines)))
            return min(options, default=(10**9, "", ()))

        cost, letters, lines = best(0, 0)
        turns = [t for t, _, _ in mine if t is not None]
        initials = [r[:1] for _, r, _ in mine]
        found[conv] = (
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return set(found.values())


def conversations(seed, n=150):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]
    texts = ["Yes.", "No!", "why?", "cut off", " \n", "", None, "long text. " * 30, "ends so.\t \n", "ÄÖ. é", "one more!", "and again?"]
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, 9)):
            rows.append((conv if conv else None, turn if r.random() < 0.9 else r.choice([None, 3]), r.choice(roles), r.choice(texts) if r.random() < 0.6 else f"{r.random()}."))
    return rows + rows[:3]


SCHEMA = "conv_id long, turn long, role string, text string"


def collected(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("costs", [Costs(), Costs(0, 1, 2, 1, 5), Costs(1, 1, 1, 1, 0), Costs(0, 9, 9, 2, 1), Costs(0, 3, 4, 1, 1)])
def test_cheapest_edits_and_least_letters(spark, costs):
    rows = conversations(1)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert collected(repair.repair(frame, costs=costs)) == plain(rows, set(), costs)


@pytest.mark.parametrize("size", [1, 2, 3])
def test_in_small_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(repair, "BLOCK_ROWS", size)
    rows = conversations(2, 80)
    for costs in (Costs(), Costs(0, 3, 4, 1, 1)):
        assert collected(repair.repair(spark.createDataFrame(rows, SCHEMA), costs=costs)) == plain(rows, set(), costs)


def test_damage(spark):
    rows = conversations(3, 200)
    got = sorted(map(tuple, repair.damage(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted(damaged(rows), key=str)
    ids = {r[0] for r in rows} | {999}
    every = spark.createDataFrame([(i,) for i in ids], "conv_id long")
    assert collected(repair.repair(repair.damage(spark.createDataFrame(rows, SCHEMA)), every)) == plain(damaged(rows), ids)


def test_one_hot_conversation(spark, monkeypatch):
    """A conversation of many rows lies in many parts, its duplicates far from each other."""
    monkeypatch.setattr(repair, "BLOCK_ROWS", 16)
    r = random.Random(4)
    rows = [(7, t, r.choice(["user", "assistant"]), r.choice(["Yes.", "No.", f"{t} says so.", f"{t} cut"])) for t in range(400)] + conversations(5, 20)
    out = repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(8))
    import sys

    sys.setrecursionlimit(5000)
    assert collected(out) == plain(rows, set())


def test_very_long_texts_extra_columns_and_empty_tables(spark):
    rows = [(1, 0, "user", "x" * 2_000_000 + "."), (1, 1, "assistant", "y " * 700_000), (1, 2, "assistant", "ok."), (2, 0, "user", None)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"kinds": F.lit(1), "part": F.lit("p"), "cost": F.lit(2)})
    assert collected(repair.repair(frame)) == plain(rows, set())
    nothing = spark.createDataFrame([], SCHEMA)
    assert repair.repair(nothing).count() == 0
    assert collected(repair.repair(nothing, spark.createDataFrame([(5,), (None,), (5,)], "conv_id long"))) == plain([], {5, None})


def test_inserted_rows_cost_something():
    with pytest.raises(ValueError, match="costs something"):
        repair.Steps(Costs(insert=0))

import hashlib
import random
import zlib

import pytest

from tidewire.llm import repair

BLANKS = " \t\n\x0b\f\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def slow_repair(rows):
    """By the least (cost, audit) of every prefix and state, one conversation at a time."""
    convs: dict = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(BLANKS)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {"": (0, "", ())}  # by the last initial: cost, audit, lines
        for (_, role, text), fault in zip(own, faults):
            after: dict = {}

            def offer(state, cost, audit, lines, after=after):
                if state not in after or (cost, audit) < after[state][:2]:
                    after[state] = cost, audit, lines

            for state, (cost, audit, lines) in list(best.items()):
                for _ in range(3):
                    offer(state, cost + 4, audit + "D", lines)
                    if fault not in ("blank", "duplicate"):
                        more = 3 * (fault == "truncated")
                        new = NEXT[state]
                        offer(new, cost + 3 + more, audit + "R", (*lines, f"{FULL[new]}:{text}"))
                        first = role[:1]
                        if first and (first == new or (first == "s" and state == "")):
                            offer(first, cost + more, audit + "K", (*lines, f"{role}:{text}"))
                    state = NEXT[state]
                    cost, audit, lines = cost + 3, audit + "I", (*lines, f"{FULL[state]}:")
            best = after
        ends = []
        for state, (cost, audit, lines) in best.items():
            while state not in ("", "a"):
                state = NEXT[state]
                cost, audit, lines = cost + 3, audit + "I", (*lines, f"{FULL[state]}:")
            ends.append((cost, audit, lines))
        cost, audit, lines = min(ends)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SHAPE = "conv_id long, turn long, role string, text string"


def got(rows):
    return sorted((tuple(r) for r in repair.Repair(rows).result().select(*NAMES).collect()), key=str)


def made(n, convs, seed):
    pick = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "", " \t", "Why? ", "a.\n", None, "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "under"]
    return [(pick.choice(convs), pick.choice([None, *range(n // len(convs) + 2)]),
             pick.choices(roles, [8, 8, 2, 1, 1, 1, 1])[0], pick.choice(texts) if pick.random() < 0.5 else f"text {i}.")
            for i in range(n)]


def test_cheapest_repairs_of_made_conversations(spark):
    rows = made(400, [None, *range(60)], 1)
    assert got(spark.createDataFrame(rows, SHAPE)) == slow_repair(rows)


def test_one_conversation_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 4)
    monkeypatch.setattr(repair, "FAN", 3)
    rows = made(150, [7], 2) + made(60, range(20), 3) + [(30, t, "user", f"t{t}.") for t in range(40)]
    assert got(spark.createDataFrame(rows, SHAPE)) == slow_repair(rows)


def test_whole_table(spark, small):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in small["conversations"].collect()]
    assert got(small["conversations"]) == slow_repair(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_repeats_and_clashing_columns(spark, n):
    rows = [(1, t, "user", "same.") for t in range(n) for _ in range(3)]
    table = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SHAPE + ", cid string, seq string, letters string, copy int")
    assert got(table) == slow_repair(rows)


def test_a_very_long_conversation_and_text(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"turn {t}" + "." * (t % 5 > 0)) for t in range(1500)] + [(2, 0, "user", "long " * 200_000 + ".")]
    assert got(spark.createDataFrame(rows, SHAPE)) == slow_repair(rows)


def test_repaired_rows_are_legal(spark, small):
    convs: dict = {}
    for r in sorted(repair.repaired(small["conversations"]).collect(), key=lambda r: (r.conv_id, r.place)):
        convs[r.conv_id] = convs.get(r.conv_id, "") + r.role[0]
    import re
    assert convs and all(re.fullmatch("(s?(ua)+)?", c) for c in convs.values())

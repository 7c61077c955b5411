"""Conversation repair against a plain reading of its rules, and small conversations against all possible repairs."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from vicinity.llm import conversation_repair as repair

TURNS = "conv_id long, turn long, role string, text string, copies long, fault string, audit string"
FACTS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def after_damage(rows):
    """Rows of each conversation, in order, by the rules as they are written."""
    out = {}
    for conv, turn, role, text in rows:
        here = out.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        here += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode())) for c, r in out.items()}


def fault_of(rows, k):
    _, role, text = rows[k]
    signs = re.findall(r"[^\x20\x09-\x0D]", text)
    if not signs:
        return "blank"
    if any(r[1:] == (role, text) for r in rows[:k]):
        return "duplicate"
    return None if signs[-1] in ".!?" else "truncated"


def plain_best(rows, kinds):
    """Least (cost, audit, lines) by filling a table row by row, with up to three insertions at each place."""
    legal = re.compile(r"(s?(ua)+)?")
    table = {"": (0, "", [])}

    def open_prefix(initials):
        return re.fullmatch(r"s?(ua)*u?", initials) is not None

    def inserted(table):
        for _ in range(3):
            for initials, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    more = initials + role[0]
                    if open_prefix(more):
                        short = {"s": "s", "u": "u", "a": "ua"}[more[-1]]
                        item = (cost + 3, audit + "I", [*lines, f"{role}:"])
                        if short not in table or item[:2] < table[short][:2]:
                            table[short] = item
        return table

    table = inserted(table)
    for (_, role, text), kind in zip(rows, kinds):
        fresh = {}

        def offer(initials, item):
            short = "" if not initials else {"s": "s", "u": "u", "a": "ua"}[initials[-1]]
            if open_prefix(initials) and (short not in fresh or item[:2] < fresh[short][:2]):
                fresh[short] = item

        for initials, (cost, audit, lines) in table.items():
            offer(initials, (cost + 4, audit + "D", lines))
            if kind not in ("blank", "duplicate"):
                left = 3 if kind == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    offer(initials + role[0], (cost + left, audit + "K", [*lines, f"{role}:{text}"]))
                for new in ("user", "assistant"):
                    offer(initials + new[0], (cost + left + 3, audit + "R", [*lines, f"{new}:{text}"]))
        table = inserted(fresh)
    return min((item for initials, item in table.items() if legal.fullmatch(initials)), key=lambda i: i[:2])


def all_repairs(rows, kinds):
    """Least (cost, audit, lines) of every sequence of edits with up to two insertions at each place."""
    legal, best = re.compile(r"(s?(ua)+)?"), None
    gap = [g for n in range(3) for g in itertools.product(("user", "assistant"), repeat=n)]
    choices = [[("D", 4, None)] if kind in ("blank", "duplicate") else
               [("D", 4, None), ("K", 3 * (kind == "truncated"), role)] + [("R", 3 + 3 * (kind == "truncated"), r) for r in ("user", "assistant")]
               for (_, role, _), kind in zip(rows, kinds)]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(gap, repeat=len(rows) + 1):
            cost, audit, lines, initials = 0, "", [], ""
            for k, inserted in enumerate(gaps):
                for role in inserted:
                    cost, audit, initials = cost + 3, audit + "I", initials + role[0]
                    lines.append(f"{role}:")
                if k < len(rows):
                    letter, price, role = edits[k]
                    cost, audit = cost + price, audit + letter
                    if role is not None:
                        initials += role[:1] or "?"
                        lines.append(f"{role}:{rows[k][2]}")
            if legal.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def by_hand(rows):
    out = []
    for conv, found in after_damage(rows).items():
        kinds = [fault_of(found, k) for k in range(len(found))]
        turns = {t for t, *_ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        cost, audit, lines = plain_best(found, kinds)
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed=2, many=150):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent", "u"]
    ends = [".", "!", "?", "", " ", ".\n", "\x0b", "… "]
    rows = []
    for c in range(many):
        for t in range(r.randint(1, 9)):
            text = r.choice([None, "", " \t", "one", "two", "é漢", "a. b"])
            turn = None if r.random() < 0.05 else t * r.choice([1, 1, 1, 3])
            rows.append((None if c == 7 else c, turn, r.choice(roles), text if text is None or not text.strip() else text + r.choice(ends)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", "y") for r in rows], TURNS).repartition(3)


def plain(df):
    return sorted((tuple(r) for r in df.select(*FACTS).collect()), key=str)


def test_small_repairs_are_the_best_of_all():
    r = random.Random(1)
    for _ in range(60):
        rows = [(k, r.choice(["user", "assistant", "system", "tool", ""]), r.choice("xyz")) for k in range(r.randint(0, 2))]
        kinds = [r.choice([None, None, "truncated", "blank", "duplicate"]) for _ in rows]
        cost, audit, lines = all_repairs(rows, kinds)
        given = [(*row, kind) for row, kind in zip(rows, kinds)]
        (found,) = repair.lightest(given, repair.BEGIN, repair.LEGAL_ENDS, True).values()
        assert found == (cost, audit)
        assert list(repair.replayed(iter(given), audit)) == lines
        assert plain_best(rows, kinds) == (cost, audit, lines)


@pytest.mark.parametrize("segment", [repair.SEGMENT, 3])
def test_repair(spark, segment):
    rows = conversations()
    assert plain(repair.damage_and_repair(frame(spark, rows), segment=segment)) == by_hand(rows)


def test_long_conversations(spark):
    """Over several segments and partitions, with repeats far apart and rows without a turn."""
    r = random.Random(5)
    rows = [(1, t, r.choice(["user", "assistant"]), f"text {r.randint(0, 300)}{r.choice(['.', '?', ''])}") for t in range(1700)]
    rows += [(2, None, r.choice(["user", "assistant"]), f"{k % 500}.") for k in range(1100)]
    rows += [(3, 5, "user", "same.")] * 600 + [(4, 0, "user", "a?"), (4, 1, "assistant", "b.")]
    assert plain(repair.damage_and_repair(frame(spark, rows))) == by_hand(rows)


def test_conversations_that_vanish(spark):
    gone = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = plain(repair.damage_and_repair(frame(spark, [(c, 0, "user", "x.") for c in gone])))
    assert got == sorted([(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone], key=str)


def test_no_conversations(spark):
    assert repair.damage_and_repair(frame(spark, [])).count() == 0

"""Conversation repair against all edits in plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from factloom.llm import dialogues

ROWS = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\f\r"


def all_edits(rows):
    """(cost, audit, turns) of the cheapest, by trying all edits with up to three inserts in a place; ``rows`` has role, text and fault."""
    best = None
    inserts = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    options = []
    for role, text, fault in rows:
        own = [("D", 3, None)]
        if fault not in "bd":
            own += [("K", fault == "t", (role, text)), *(("R", 2 + (fault == "t"), (r, text)) for r in ("user", "assistant"))]
        options.append([*own])
    for chosen in itertools.product(*options):
        for places in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(x[1] for x in chosen) + 2 * sum(map(len, places))
            if best and cost > best[0]:
                continue
            audit, said = "", []
            for place, x in itertools.zip_longest(places, chosen):
                audit += "I" * len(place) + (x[0] if x else "")
                said += [({"u": "user", "a": "assistant"}[p], "") for p in place]
                said += [x[2]] if x and x[2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in said)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, said)
    return best


def shortest(rows):
    """The same by the least (cost, audit) of every place, turn by turn."""
    keep = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    to, wanted = {0: 2, 1: 2, 2: 3, 3: 2}, {0: "user", 1: "user", 2: "assistant", 3: "user"}
    now = {0: (0, "", ())}

    def with_inserts(now):
        for _ in range(4):
            for q, (cost, audit, said) in list(now.items()):
                x = (cost + 2, audit + "I", (*said, (wanted[q], "")))
                now[to[q]] = min(now.get(to[q], x), x)
        return now

    for role, text, fault in rows:
        new = {}
        for q, (cost, audit, said) in with_inserts(now).items():
            ways = [(q, (cost + 3, audit + "D", said))]
            if fault not in "bd":
                stay = cost + (fault == "t")
                ways += [(to[q], (stay + 2, audit + "R", (*said, (wanted[q], text))))]
                ways += [(keep[q][role[:1]], (stay, audit + "K", (*said, (role, text))))] if role[:1] in keep[q] else []
            for p, x in ways:
                new[p] = min(new.get(p, x), x)
        now = new
    return min(x for q, x in with_inserts(now).items() if q in (0, 3))


def brute(table, damage=True):
    of = {}
    for c, t, r, x in table:
        rows = of.setdefault(c, [])
        blank = lambda v: " " if v is None else v
        k = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20 if damage else 9
        r, x = "user" if k == 4 else blank(r), "" if k == 1 else re.sub("[.!?]", "", blank(x)) if k == 2 else blank(x)
        rows += [] if k == 0 else [(t, r, x)] * (2 if k == 3 else 1)
    out = []
    for c, rows in of.items():
        rows.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
        seen, faults = set(), []
        for _, r, x in rows:
            held = x.strip(SPACE)
            faults.append("b" if not held else "d" if (r, x) in seen else "t" if held[-1] not in ".!?" else "-")
            seen.add((r, x))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, said = shortest([(r, x, f) for (_, r, x), f in zip(rows, faults, strict=True)])
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in said).encode()).hexdigest()
        out.append((c, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def repaired(spark, table):
    rows = spark.createDataFrame(table, ROWS)
    got = dialogues.audited(dialogues.damaged(rows), rows)
    assert [c for c, _ in got.dtypes] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_search_against_all_edits():
    draw = random.Random(1)
    for n in [0, 1, 1, 1, *[2] * 30, *[3] * 40]:
        rows = [(draw.choice(["system", "user", "assistant", "tool"]), f"x{i}", draw.choice("bdt----")) for i in range(n)]
        cost, audit, said = all_edits(rows)
        assert (cost, audit) == dialogues.search("".join(r[0] if r[0] in "sua" else "o" for r, _, _ in rows), "".join(f for _, _, f in rows))
        assert (cost, audit, tuple(said)) == shortest(rows)


@pytest.mark.parametrize("n", [4, 9, 40, 300])
def test_search_against_shortest(n):
    draw = random.Random(n)
    for _ in range(40):
        weights = [draw.random() for _ in range(4)]
        rows = [(draw.choices(["system", "user", "assistant", "tool"], weights)[0], "x", draw.choice("bdt-----")) for i in range(n)]
        roles, faults = "".join(r[0] if r[0] in "sua" else "o" for r, _, _ in rows), "".join(f for _, _, f in rows)
        assert dialogues.search(roles, faults) == shortest(rows)[:2]
        assert dialogues.bounds(roles, faults)[0][0] <= shortest(rows)[0] <= dialogues.bounds(roles, faults)[0][0] + 4


def test_long_conversation():
    draw = random.Random(2)
    roles, faults = "".join(draw.choice("suao") for _ in range(50_000)), "".join(draw.choice("bdt---") for _ in range(50_000))
    cost, audit = dialogues.search(roles, faults)
    assert sum(x != "I" for x in audit) == 50_000 and cost <= dialogues.bounds(roles, faults)[0][0] + 4


def test_random_conversations(spark):
    draw = random.Random(3)
    table = []
    for c in range(150):
        for t in range(draw.randrange(1, 14)):
            text = draw.choice(["Yes.", "No!", "Why? ", "well", "ok.\n", "", " \t", f"t{t}.", f"u{t}"])
            table.append((c, draw.choice([t, t, t, t + 3, None]), draw.choice(["user", "assistant", "user", "assistant", "system", "tool"]), text))
    assert repaired(spark, table) == brute(table)


def test_hard_rows(spark):
    """Nulls in every column, repeated rows, ties of turns, a conversation that vanishes, odd roles, very long texts."""
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = [
        (None, None, None, None), (None, 1, "user", "a."), (None, 1, "user", "a."), (None, 1, "assistant", "b."), (gone, 0, "user", "x."), (2000, 5, "", "x."), (2000, 6, "User", "é\x0b"), (2000, 9, "assistant", "𝔘?" * 50_000),
        (2001, None, "system", "s."), (2001, None, "user", "u."), (2001, -3, "assistant", "a."), (2001, 7, "assistant", None), *[(2002, 1, "user", "same.")] * 30, *[(2003, t, "assistant", "same.") for t in range(40)],
    ]
    got = repaired(spark, table)
    assert got == brute(table)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got


def test_turns_and_other_columns(spark):
    from pyspark.sql import functions as F

    table = [(1, 0, "user", "q."), (1, 1, "user", "r."), (1, 2, "assistant", "a."), (2, 0, "assistant", "x.")]
    rows = spark.createDataFrame(table, ROWS).select("*", *(F.lit("z").alias(n) for n in ("c", "at", "n", "first", "o", "fault", "letter", "_r")))
    got = dialogues.repaired_turns(rows).orderBy("conv_id", "at", "part").collect()
    assert [(r.conv_id, r.role, r.text) for r in got if r.conv_id == "1"] == [("1", r, x) for r, x in shortest([(r, x, "-") for _, _, r, x in table[:3]])[2]]
    assert dialogues.audited(rows).count() == 2
    assert dialogues.audited(rows.limit(0)).count() == 0 == dialogues.repaired_turns(rows.limit(0)).count()

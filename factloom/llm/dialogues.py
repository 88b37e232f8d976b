"""Repair of conversations whose turns are missing, empty, repeated, cut off or out of turn (operator 13).

Turns are cleaned of repeats and numbered as tables, which no conversation's
size hurts: what makes a turn faulty is found by grouping, and numbers come
from ranges of turns. Only a letter for each turn's role and fault goes through
the search for the cheapest edits, a conversation after the other from sorted
rows; the texts stay in the table, meet their edits by a join on conversation
and number, and are hashed in order as they stream by.

The search is depth first with a stack of its own. It tries edits by their
letters, D, I, K, R, so that of two ways to the same place the first has the
lesser audit: a later one counts only if it costs less, which a table of the
least cost by place decides. A bound from behind, the cheapest edits of the
rest if a conversation could end anywhere, cuts what can't beat the incumbent.
That bound misses at most four, the two turns that may be wanted at the end,
and so the first limit is four above it.

Defined cases: a null conversation, turn, role or text reads as one space, and
null turns come first; turns that share a number are ordered by role and text;
a role that is no known one has to be changed; a conversation all of whose
turns are gone gets zeros; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.ranks import within_group

from .common import column, stored

REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Where a conversation may stand: nothing said, a system turn said, a user's turn said, an answer said.
START, SYSTEM, ASKED, ANSWERED = range(4)
#: Where a kept turn of a role leads from each place.
KEEP = {START: {"s": SYSTEM, "u": ASKED}, SYSTEM: {"u": ASKED}, ASKED: {"a": ANSWERED}, ANSWERED: {"u": ASKED}}
#: Where a turn that gets the wanted role leads.
NEXT = {START: ASKED, SYSTEM: ASKED, ASKED: ANSWERED, ANSWERED: ASKED}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}


def bounds(roles: str, faults: str) -> tuple[list, list, list]:
    """From each turn on, the least cost of the rest when nothing was said, a user or an answer is wanted, if any end were allowed."""
    n = len(roles)
    start, user, answer = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        if faults[i] in "bd":
            start[i], user[i], answer[i] = start[i + 1] + DELETE, user[i + 1] + DELETE, answer[i + 1] + DELETE
            continue
        stay, role = CUT * (faults[i] == "t"), roles[i]
        u = min(user[i + 1] + DELETE, answer[i + 1] + stay + REROLE * (role != "u"))
        a = min(answer[i + 1] + DELETE, user[i + 1] + stay + REROLE * (role != "a"))
        user[i], answer[i] = min(u, a + INSERT), min(a, u + INSERT)
        start[i] = min(start[i + 1] + DELETE, user[i], user[i + 1] + stay if role == "s" else user[i])
    return start, user, answer


def search(roles: str, faults: str) -> tuple[int, str]:
    """Cost and letters of the cheapest edits, of these the least letters; ``roles`` has s, u, a or another letter for each turn, ``faults`` b, d, t or -."""
    from array import array

    n = len(roles)
    start, user, answer = bounds(roles, faults)
    rest = (start, user, answer, user)
    limit, found = start[0] + 2 * INSERT + 1, ""
    least = array("q", [limit]) * (4 * (n + 1))
    path: list[str] = []
    stack = [(0, START, 0, 0, "")]
    while stack:
        i, at, cost, depth, edit = stack.pop()
        if cost + rest[at][i] >= limit or cost >= least[4 * i + at]:
            continue
        least[4 * i + at] = cost
        path[depth:] = edit
        if i == n and at in (START, ANSWERED):
            limit, found = cost, "".join(path)
            continue
        depth = len(path)
        if i < n and faults[i] not in "bd":
            stay = cost + CUT * (faults[i] == "t")
            stack.append((i + 1, NEXT[at], stay + REROLE, depth, "R"))
            if roles[i] in KEEP[at]:
                stack.append((i + 1, KEEP[at][roles[i]], stay, depth, "K"))
        stack.append((i, NEXT[at], cost + INSERT, depth, "I"))
        if i < n:
            stack.append((i + 1, at, cost + DELETE, depth, "D"))
    return limit, found


def edits(roles: str, audit: str):
    """(inserted roles before it, letter, role) of each turn, and at last the roles inserted behind all."""
    at, before, i = START, "", 0
    for x in audit:
        if x == "D":
            yield before, "D", ""
            before, i = "", i + 1
            continue
        role = "s" if x == "K" and roles[i] == "s" else "a" if at == ASKED else "u"
        at = SYSTEM if role == "s" else NEXT[at]
        if x == "I":
            before += role
        else:
            yield before, x, role
            before, i = "", i + 1
    yield before, "", ""


class _Out:
    """Rows of the search's result, given out by some thousands."""

    NAMES = ("c", "at", "before", "edit", "role", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    COLUMNS = "c string, at bigint, before string, edit string, role string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"

    def __init__(self):
        self.rows: list[tuple] = []

    def batch(self):
        import pyarrow as pa

        numbers = {"at", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"}
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if name in numbers else pa.string()) for i, name in enumerate(self.NAMES)], list(self.NAMES))


def _searched(batches):
    """Letters of turns in order of conversation and number, to edits of turns and a row (at 0) for each conversation."""
    out, c, roles, faults, copies, spread = _Out(), None, [], [], [], [None, None, 0]

    def done():
        r = "".join(x * n for x, n in zip(roles, copies, strict=True))
        f = "".join(x + ("b" if x == "b" else "d") * (n - 1) for x, n in zip(faults, copies, strict=True))
        cost, audit = search(r, f)
        least, most, distinct = spread
        gaps = 0 if least is None else most - least + 1 - distinct
        out.rows.append((c, 0, None, None, None, gaps, f.count("b"), f.count("d"), f.count("t"), sum(a + b not in LEGAL for a, b in zip(r, r[1:])), cost, audit))
        each, at = edits(r, audit), 0
        for at, n in enumerate(copies, 1):
            yield_row = next(each)
            for _ in range(n - 1):  # the copies go
                next(each)
            if yield_row[1] != "D":
                out.rows.append((c, at, *yield_row, *[None] * 7))
            if len(out.rows) >= 10_000:
                yield out.batch()
        if (last := next(each))[0]:
            out.rows.append((c, at + 1, *last, *[None] * 7))

    for batch in batches:
        for name, turn, role, fault, n in zip(*(batch.column(x).to_pylist() for x in ("c", "turn", "letter", "fault", "n")), strict=True):
            if name != c:
                if c is not None:
                    yield from done()
                c, roles, faults, copies, spread = name, [], [], [], [None, None, 0]
            roles.append(role)
            faults.append(fault)
            copies.append(n)
            if turn is not None and turn != spread[1]:
                spread = [turn if spread[0] is None else spread[0], turn, spread[2] + 1]
        if len(out.rows) >= 1000:
            yield out.batch()
    if c is not None:
        yield from done()
    if out.rows:
        yield out.batch()


def _hashed(batches):
    """Lines in order of conversation and number, to a digest for each conversation."""
    import hashlib

    import pyarrow as pa

    c, digest, names, digests = None, None, [], []
    for batch in batches:
        for name, line in zip(batch.column("c").to_pylist(), batch.column("line").cast(pa.binary()).to_pylist(), strict=True):
            if name != c:
                if c is not None:
                    names.append(c)
                    digests.append(digest.hexdigest())
                c, digest = name, hashlib.sha256(line)
            else:
                digest.update(b"\n" + line)
        if len(names) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(digests, pa.string())], ["c", "repaired_sha256"])
            names, digests = [], []
    if c is not None:
        yield pa.RecordBatch.from_arrays([pa.array([*names, c], pa.string()), pa.array([*digests, digest.hexdigest()], pa.string())], ["c", "repaired_sha256"])


def _spaced(name: str) -> Column:
    return F.coalesce(column(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The same columns, with one row in twenty each gone, emptied, without full stops, said twice, and given to the user, by a checksum of conversation and turn."""
    kind = F.crc32(F.concat(_spaced(conv), F.lit(":"), _spaced(turn)).cast("binary")) % 20
    told = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(_spaced(text), "[.!?]", "")).otherwise(_spaced(text))
    out = rows.filter(kind != 0).select(column(conv).alias(conv), column(turn).alias(turn), F.when(kind == 4, F.lit("user")).otherwise(_spaced(role)).alias(role), told.alias(text), F.when(kind == 3, 2).otherwise(1).alias("_n"))
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def numbered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """c, at (from 1), turn, role, text, n (how often it is there), letter and fault of every different turn, written once."""
    own = rows.select(_spaced(conv).alias("c"), column(turn).cast("bigint").alias("turn"), _spaced(role).alias("role"), _spaced(text).alias("text"))
    own = own.groupBy("c", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    first = own.groupBy("c", "role", "text").agg(F.min(F.struct("turn")).alias("first"))
    space = r"\x20\x09-\x0D"
    fault = F.when(~F.col("text").rlike(f"[^{space}]"), "b").when(~F.col("first.turn").eqNullSafe(F.col("turn")), "d").when(F.col("text").rlike(rf"[^{space}.!?][{space}]*\z"), "t").otherwise("-")
    letter = F.substring("role", 1, 1)
    turns = own.join(first, ["c", "role", "text"]).select("c", "n", fault.alias("fault"), F.when(letter.isin("s", "u", "a"), letter).otherwise("o").alias("letter"), F.struct("turn", "role", "text").alias("o"))
    return stored(within_group(turns, ["c"], "o").select("c", F.col("_r").cast("bigint").alias("at"), "o.*", "n", "letter", "fault"), "turns")


def _in_order(df: DataFrame) -> DataFrame:
    return df.repartition("c").sortWithinPartitions("c", "at")


def _edited(turns: DataFrame) -> DataFrame:
    narrow = _in_order(turns.select("c", "at", "turn", "letter", "fault", "n"))
    return stored(narrow.mapInArrow(_searched, _Out.COLUMNS), "edits")


def _lines(turns: DataFrame, found: DataFrame) -> DataFrame:
    """c, at and the turns (role, text) that take the place of a turn."""
    full = lambda x: F.when(x == "u", NAMES["u"]).otherwise(NAMES["a"])
    plan = found.filter("at > 0").select("c", "at", "before", "edit", F.col("role").alias("given"))
    met = plan.join(turns.select("c", "at", "role", "text"), ["c", "at"], "left")
    new = F.transform(F.filter(F.split("before", ""), lambda x: x != ""), lambda x: F.struct(full(x).alias("role"), F.lit("").alias("text")))
    own = F.array(F.struct(F.when(F.col("edit") == "K", F.col("role")).otherwise(full(F.col("given"))).alias("role"), F.col("text").alias("text")))
    return met.select("c", "at", F.when(F.col("edit") != "", F.concat(new, own)).otherwise(new).alias("turns"))


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, at and part (in whose order they are said), role and text of all turns of the repaired conversations."""
    turns = numbered(rows, conv, turn, role, text)
    lines = _lines(turns, _edited(turns)).select("c", "at", F.posexplode("turns").alias("part", "t"))
    return lines.select(F.col("c").alias(conv), "at", "part", F.col("t.role").alias(role), F.col("t.text").alias(text))


def audited(rows: DataFrame, original: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation of ``original`` (else of ``rows``): faults, cost and letters of its repair, and a digest of the result."""
    turns = numbered(rows, conv, turn, role, text)
    found = _edited(turns)
    lines = _lines(turns, found)
    line = F.concat_ws("\n", F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    digests = _in_order(lines.select("c", "at", line.alias("line"))).select("c", "line").mapInArrow(_hashed, "c string, repaired_sha256 string")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    every = (original if original is not None else rows).select(column(conv).alias(conv), _spaced(conv).alias("c")).distinct()
    out = every.join(found.filter("at = 0").select("c", *counts, "audit"), "c", "left").join(digests, "c", "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("bigint").alias(n)
    return out.select(conv, *map(zero, counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

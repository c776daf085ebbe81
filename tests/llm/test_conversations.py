import hashlib
import random
import re
import zlib
from functools import lru_cache

import pyarrow.parquet as pq
import pytest

from plumbob.llm import conversations as C
from plumbob.llm import queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, segment string, place string, kind string"
PATTERN = re.compile("(s?(ua)+)?")


def all_audits(symbols):
    """Every least-cost audit, by trying all edits with up to two inserts at a place."""
    best = {}

    @lru_cache(None)
    def least(place, state):
        options = []
        if place == len(symbols):
            if state in C.ENDS:
                options.append((0, ""))
        else:
            symbol = symbols[place]
            extra = 3 if symbol.isupper() else 0
            cost, rest = least(place + 1, state)
            options.append((cost + 4, "D" + rest))
            if symbol != "x":
                for name, role, price in (("K", symbol.lower(), 0), ("R", "u", 3), ("R", "a", 3)):
                    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, role))
                    if after is not None:
                        cost, rest = least(place + 1, after)
                        options.append((cost + price + extra, name + rest))
        # Inserts: all runs of up to three, then a row's edit or the end.
        return min(options + inserted(place, state, 0)) if options or inserted(place, state, 0) else (10**9, "")

    def inserted(place, state, depth):
        if depth == 3:
            return []
        after = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        found = []
        if place == len(symbols):
            if after in C.ENDS:
                found.append((3, "I"))
        else:
            symbol, extra = symbols[place], 3 if symbols[place].isupper() else 0
            cost, rest = least(place + 1, after)
            found.append((cost + 7, "ID" + rest))
            if symbol != "x":
                for name, role, price in (("K", symbol.lower(), 0), ("R", "u", 3), ("R", "a", 3)):
                    then = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((after, role))
                    if then is not None:
                        cost, rest = least(place + 1, then)
                        found.append((cost + price + extra + 3, "I" + name + rest))
        return found + [(c + 3, "I" + a) for c, a in inserted(place, after, depth + 1)]

    return least(0, 0)


def test_least_audit_of_short_conversations():
    rng = random.Random(3)
    some = ["", "s", "u", "a", "x", "ss", "au", "sas", "uua", "UA", "oo"]
    some += ["".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    for symbols in some:
        assert C.cheapest_audit(symbols) == all_audits(symbols), symbols


def test_long_conversation():
    symbols = ("s" + "ua" * 1500 + "u" + "xA" * 500 + "ua" * 800)
    cost, audit = C.cheapest_audit(symbols)
    assert cost == C.cheapest_audit(symbols[::1])[0] and sum(c != "I" for c in audit) == len(symbols)


def plain(table):
    """What the query returns, by plain code."""
    space = lambda v: " " if v is None else v
    found = {}
    for r in table:
        found.setdefault(r["conv_id"], [])
    for r in table:
        key = f"{space(r['conv_id'])}:{space(r['turn'])}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = space(r["role"]), space(r["text"])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        found[r["conv_id"]] += [(r["turn"], "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, symbols, counts = set(), "", [0, 0, 0]
        for _, role, text in rows:
            bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            first = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in (0, 1) else first.upper() if fault == 2 else first
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {r[0] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = all_audits(symbols)
        lines, left = [], list(rows)
        emitted = ""
        for e in audit:
            row = left.pop(0) if e != "I" else (None, "", "")
            if e != "D":
                role = row[1] if e == "K" else "assistant" if emitted.endswith("u") else "user"
                emitted += role[0]
                lines.append(f"{role}:{row[2]}")
        assert PATTERN.fullmatch(emitted)
        yield conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def check(df, table):
    assert sorted(map(tuple, df.collect()), key=str) == sorted(plain(table), key=str)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(None, None, None, None)],
        [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "user", None), (None, 3, "user", "x."), (None, 3, "user", "x.")],
        [(7, t, ("user", "assistant", "tool", "", "system")[t % 5], "word " * t + ".") for t in range(40)],
        [(8, None, "user", f"t{i}.") for i in range(20)] + [(8, 5, "assistant", "a " * 20000 + "!"), (8, -3, "user", "\t\n")] * 3,
        [(9, i, "us"[i % 2] * 3, "same.") for i in range(60)],
    ],
)
def test_small_tables(frame, rows):
    table = [dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows]
    check(C.repair_digests(frame(rows, SCHEMA)), table)


def test_conversation_over_many_tasks(frame, spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system"]
    rows = [(1, rng.randrange(400), rng.choice(roles), f"{rng.randrange(50)}{rng.choice('.!? ')}") for _ in range(600)]
    before = C.SEGMENT_BITS
    try:
        C.SEGMENT_BITS = 3
        table = [dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows]
        check(C.repair_digests(frame(rows, SCHEMA).repartition(5)), table)
    finally:
        C.SEGMENT_BITS = before


def test_repaired_turns(frame):
    rows = [(4, i, r, t) for i, (r, t) in enumerate([("assistant", "A."), ("user", "B?"), ("user", "C."), ("user", " "), ("assistant", "D")])]
    turns = C.repaired_conversations(C.conversation_rows(frame(rows, SCHEMA))).orderBy("turn").collect()
    audit = C.judge_conversations(C.conversation_rows(frame(rows, SCHEMA))).first()["audit"]
    assert PATTERN.fullmatch("".join(t["role"][0] for t in turns))
    assert [t["edit"] for t in turns] == [e for e in audit if e != "D"] and [t["turn"] for t in turns] == list(range(len(turns)))


def test_query_over_the_table(spark, data):
    check(queries.op13_conversation_repair(spark, data), pq.read_table(f"{data}/conversations.parquet").to_pylist())

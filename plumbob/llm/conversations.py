"""Cheapest repair of damaged conversations, by a search from both ends of the edit lattice.

A conversation is repaired when its roles read: nothing, or an optional system
turn and then user and assistant by turns. Rows are kept (K, 0), get the other
role (R, 3), are deleted (D, 4, the only choice for a blank row or one seen
before), and empty turns are inserted (I, 3); a truncated row that stays adds 3.

The lattice has a node for each (rows done, state of the role pattern) and an
edge for each edit. One heap grows from the start, one from the accepted ends.
When the two least entries together exceed the best meeting, every crossing of
that cost is known; the nodes before the crossings that lead to one are marked,
and a walk from the start that takes the ASCII-least edit on a cheapest path
gives the least audit. From a state an edit leads to one state only, so no
cheapest audit is the beginning of another, and the walk is exact.

Only a byte for each row (initial and fault) is brought together for a
conversation, which its audit has in any case; texts are read in order, once,
when the repaired rows are written, and none is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbob.functions.columns import ref
from plumbob.llm.common import as_long, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

# States of the role pattern: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an emitted user or assistant turn, of which each state allows one.
TURN = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
INITIALS = "sua"
LEGAL = frozenset(("su", "ua", "au"))

BLANKS = " \t\n\x0b\f\r"
#: Rows of a conversation that are first gathered together.
SEGMENT_BITS = 12
#: Audits that a worker remembers, by the faults and roles of a conversation; beyond it starts afresh.
REMEMBERED = 100_000
#: Codes of an initial (s, u, a, other) and a fault (none, blank, duplicate, truncated).
CODES = "abcdefghijklmnop"


def _after(state: int, initial: str) -> int | None:
    """The state after a row that keeps its role."""
    if initial == "s":
        return SYSTEM if state == START else None
    role = {"u": USER, "a": ASSISTANT}.get(initial)
    return role if role == TURN[state] else None


def _edits(symbol: str) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a row: ``(initial, cost, next state)``, ASCII-least first."""
    found = []
    for state in range(4):
        here = [("D", DELETE, state)]
        if symbol != "x":
            extra = TRUNCATED if symbol.isupper() else 0
            kept = _after(state, symbol.lower())
            if kept is not None:
                here.append(("K", KEEP + extra, kept))
            here.append(("R", REROLE + extra, TURN[state]))
        found.append(here)
    return found


EDITS = {s: _edits(s) for s in "suaoSUAOx"}
#: The same from a row's end: for each state ``(cost, state before)``.
BACK = {s: [[(c, q) for q in range(4) for _, c, to in EDITS[s][q] if to == state] for state in range(4)] for s in EDITS}
INSERT_BACK = [[q for q in range(4) if TURN[q] == state] for state in range(4)]


def cheapest_audit(symbols: str) -> tuple[int, str]:
    """Cost and ASCII-least audit of rows given as role initials.

    ``s u a`` are roles, ``o`` any other; upper case for truncated rows, ``x``
    for rows that must go.
    """
    n = len(symbols)
    reached, left = {0: 0}, {4 * n + q: 0 for q in ENDS}  # costs from the start, and to an end
    ahead, behind = [(0, 0)], sorted((0, node) for node in left)
    best = left.get(0, None) if n == 0 else None
    settled, done = set(), set()
    while ahead and behind and (best is None or ahead[0][0] + behind[0][0] <= best):
        if ahead[0][0] <= behind[0][0]:
            cost, node = heappop(ahead)
            if node in settled:
                continue
            settled.add(node)
            place, state = divmod(node, 4)
            steps = [(INSERT, node - state + TURN[state])]
            if place < n:
                steps += [(c, 4 * place + 4 + to) for _, c, to in EDITS[symbols[place]][state]]
            mine, other, heap = reached, left, ahead
        else:
            cost, node = heappop(behind)
            if node in done:
                continue
            done.add(node)
            place, state = divmod(node, 4)
            steps = [(INSERT, node - state + q) for q in INSERT_BACK[state]]
            if place:
                steps += [(c, 4 * place - 4 + q) for c, q in BACK[symbols[place - 1]][state]]
            mine, other, heap = left, reached, behind
        for step, to in steps:
            total = cost + step
            if total < mine.get(to, total + 1):
                mine[to] = total
                heappush(heap, (total, to))
                if to in other and (best is None or total + other[to] < best):
                    best = total + other[to]
    return best, _least_audit(symbols, reached, left, best)


def _out(symbols: str, node: int) -> list[tuple[str, int, int]]:
    place, state = divmod(node, 4)
    found = [("I", INSERT, node - state + TURN[state])]
    if place < len(symbols):
        found += [(name, c, 4 * place + 4 + to) for name, c, to in EDITS[symbols[place]][state]]
    return sorted(found)


def _least_audit(symbols: str, reached: dict[int, int], left: dict[int, int], best: int) -> str:
    """The walk over all cheapest paths, which cross from ``reached`` to ``left``."""
    tight: dict[int, list[int]] = {}
    leads = []
    for node, cost in reached.items():
        if cost > best:
            continue
        if left.get(node, best + 1) + cost == best:
            leads.append(node)
        for _, step, to in _out(symbols, node):
            if cost + step + left.get(to, best + 1) == best:
                leads.append(node)
            if reached.get(to, -1) == cost + step:
                tight.setdefault(to, []).append(node)
    good = set()
    while leads:
        node = leads.pop()
        if node not in good:
            good.add(node)
            leads += tight.get(node, ())
    audit, node, cost = [], 0, 0
    ends = {4 * len(symbols) + q for q in ENDS}
    while not (node in ends and cost == best):
        for name, step, to in _out(symbols, node):
            total = cost + step
            if total + left.get(to, best + 1) == best or (to in good and reached[to] == total):
                audit.append(name)
                node, cost = to, total
                break
    return "".join(audit)


_audits: dict[str, tuple[int, str]] = {}


def audit_of(symbols: str) -> tuple[int, str]:
    """:func:`cheapest_audit`, remembered by this worker for short conversations."""
    if len(symbols) > 64:
        return cheapest_audit(symbols)
    if symbols not in _audits:
        if len(_audits) > REMEMBERED:
            _audits.clear()
        _audits[symbols] = cheapest_audit(symbols)
    return _audits[symbols]


# -- damage ---------------------------------------------------------------------


def _spaced(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def conversation_rows(df: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` of a table that may have any other columns; a null role or text is one space."""
    return df.select(
        as_long("conv_id").alias("conv_id"),
        as_long("turn").alias("turn"),
        _spaced(ref("role")).alias("role"),
        _spaced(ref("text")).alias("text"),
    )


def damage(rows: DataFrame) -> DataFrame:
    """Rows damaged by ``crc32('conv_id:turn') % 20``, a null being one space there too.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4
    makes it the user's. ``rows`` are those of :func:`conversation_rows`.
    A dropped row stays with a null role and text, so its conversation is known.
    """
    kind = F.crc32(F.concat(_spaced(F.col("conv_id")), F.lit(":"), _spaced(F.col("turn"))).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    hurt = rows.withColumn("kind", kind).select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").when(F.col("kind") != 0, F.col("role")).alias("role"),
        F.when(F.col("kind") != 0, text).alias("text"),
        copies.alias("copy"),
    )
    return hurt.drop("copy")


# -- faults ---------------------------------------------------------------------


def _digest(column: str) -> Column:
    return F.unhex(F.md5(F.col(column).cast("binary")))


def _order() -> tuple[Column, ...]:
    """Rows of one turn follow by role and digest; what is then equal is interchangeable."""
    return F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("digest")


def conversation_codes(rows: DataFrame) -> DataFrame:
    """Per conversation ``conv_id`` and ``segments``: in order, up to 4,096 rows each, a code for every row.

    A segment is ``(segment, codes, first_turn, last_turn, turns)``, the last
    three of turns that are not null. Rows without a role are no rows, but
    their conversation is returned.
    Rows are dealt out by range, so a long conversation is spread over tasks.
    """
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    light = rows.select(
        "conv_id",
        "turn",
        "role",
        _digest("text").alias("digest"),
        F.when(bare == "", 1).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0).alias("fault"),
        # Only rows that are equal otherwise are dealt out by it; any order of those is the same.
        (F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()) % 64).alias("salt"),
    )
    order = (F.asc_nulls_first("conv_id"), *_order(), F.col("salt"))
    placed = stored(
        light.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("place", F.monotonically_increasing_id()),
        "conversation-rows",
    )
    repeated = (
        placed.where("role IS NOT NULL")
        .groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
        .agg(F.min("place").alias("first"), F.count("*").alias("rows"))
        .where("rows > 1")
        .drop("rows")
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    fault = F.when((F.col("fault") != 1) & (F.col("place") > F.col("first")), 2).otherwise(F.col("fault"))
    # Zero where the initial is none of these or there is no role character.
    initial = F.when(F.col("role") == "", 0).otherwise(F.position(F.left("role", F.lit(1)), F.lit(INITIALS)))
    number = 4 * fault + F.when(initial == 0, 3).otherwise(initial - 1)
    code = F.when(F.col("role").isNull(), "").otherwise(F.substring(F.lit(CODES), number + 1, F.lit(1)))
    coded = placed.join(repeated, same, "left").select(
        "conv_id",
        "place",
        code.alias("code"),
        F.when(F.col("role").isNotNull(), F.col("turn")).alias("turn"),
    )
    pieces = F.array_sort(F.collect_list(F.struct("place", "code")))
    segments = coded.groupBy("conv_id", F.shiftright("place", SEGMENT_BITS).alias("segment")).agg(
        F.array_join(F.transform(pieces, lambda p: p["code"]), "").alias("codes"),
        F.min("turn").alias("first_turn"),
        F.max("turn").alias("last_turn"),
        F.size(F.collect_set("turn")).alias("turns"),
    )
    whole = F.struct("segment", "codes", "first_turn", "last_turn", "turns")
    return segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(whole)).alias("segments"))


FIGURES = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _judge(segments: list[dict]) -> tuple[int, int, int, int, int, int, str]:
    codes = "".join(s["codes"] for s in segments)
    turned = [s for s in segments if s["turns"]]
    gaps = 0
    if turned:
        shared = sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:]))
        gaps = turned[-1]["last_turn"] - turned[0]["first_turn"] + 1 - (sum(s["turns"] for s in turned) - shared)
    numbers = [ord(c) - 97 for c in codes]
    initials = "".join("suao"[k & 3] for k in numbers)
    faults = [k >> 2 for k in numbers]
    symbols = "".join("x" if f in (1, 2) else i.upper() if f else i for i, f in zip(initials, faults))
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    cost, audit = audit_of(symbols)
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit


def _judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kinds = [pa.int64()] * 6 + [pa.string()]
    for batch in batches:
        found = [_judge(s) for s in batch.column("segments").to_pylist()]
        columns = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", *names])


def judge_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``.

    ``rows`` have a conv_id, turn, role and text; see :func:`damage`.
    A row's first fault counts. ``gaps`` are missing turns between the least and
    the greatest, nulls left out. A role's initial is its first character as it
    is; an empty role has none and can't be kept. A conversation without rows
    has zeros and an empty audit; null is a conv_id like any other.
    """
    return conversation_codes(rows).mapInArrow(_judged, f"conv_id bigint, {FIGURES}")


# -- repaired rows --------------------------------------------------------------


def _in_order(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows in order, within one task."""
    empty = {n: F.lit(None) for n in ("turn", "role", "digest", "text")}
    figures = [n for n in judged.columns if n != "conv_id"]
    heads = judged.withColumns(empty).withColumn("kind", F.lit(0))
    body = (
        rows.where("role IS NOT NULL")
        .withColumn("digest", _digest("text"))
        .withColumns({n: F.lit(None).cast(judged.schema[n].dataType) for n in figures})
        .withColumn("kind", F.lit(1))
    )
    both = heads.select(*body.columns).unionByName(body)
    return both.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", *_order())


class _Repair:
    """Repairs one conversation as its rows come in."""

    def __init__(self, head: dict):
        self.head, self.place, self.state = head, 0, START
        self.audit = head["audit"]

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.place : self.place + 1] == "I":
            self.place += 1
            self.state = TURN[self.state]
            yield "I", ROLES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The turns that come from a row: ``(edit, role, text)``."""
        yield from self._inserted()
        edit = self.audit[self.place]
        self.place += 1
        if edit == "K":
            self.state = _after(self.state, role[:1])
            yield edit, role, text
        elif edit == "R":
            self.state = TURN[self.state]
            yield edit, ROLES[self.state], text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def _events(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[_Repair, Iterator[tuple[str, str, str]] | None]]:
    """Each conversation's repaired turns, row by row; None when it is over."""
    repair = None
    for batch in batches:
        # Small pieces, as a batch of long texts should not be unpacked at once.
        for start in range(0, batch.num_rows, 256):
            for row in batch.slice(start, 256).to_pylist():
                if row["kind"] == 0:
                    if repair:
                        yield repair, repair.end()
                        yield repair, None
                    repair = _Repair(row)
                else:
                    yield repair, repair.row(row["role"], row["text"])
    if repair:
        yield repair, repair.end()
        yield repair, None


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    held, size, turn = [], 0, 0
    for repair, turns in _events(batches):
        if turns is None:
            turn = 0
            continue
        for edit, role, text in turns:
            held.append((repair.head["conv_id"], turn, role, text, edit))
            turn += 1
            size += len(text) + 64
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def repaired_conversations(rows: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """``(conv_id, turn, role, text, edit)``: repaired turns, numbered from 0; ``edit`` is K, R or I."""
    judged = stored(judge_conversations(rows), "audits") if judged is None else judged
    return _in_order(rows, judged).mapInArrow(_repaired, "conv_id bigint, turn bigint, role string, text string, edit string")


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    pick = itemgetter(*names[:-1])
    held, size, digest, first = [], 0, hashlib.sha256(), True
    for repair, turns in _events(batches):
        if turns is not None:
            for _, role, text in turns:
                digest.update((role if first else "\n" + role).encode() + b":" + text.encode())
                first = False
            continue
        held.append((*pick(repair.head), digest.hexdigest()))
        size += len(repair.audit) + 256
        digest, first = hashlib.sha256(), True
        if size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def repair_digests(df: DataFrame) -> DataFrame:
    """Damage, judge and repair a table of conversations; one row per conv_id of the table.

    ``repaired_sha256`` is over the lines ``role:text`` of the repaired turns,
    as one stream from first to last turn, so a conversation's texts pass
    through one task, none of them held. An empty table gives no rows.
    """
    rows = damage(conversation_rows(df))
    judged = stored(judge_conversations(rows), "audits")
    return _in_order(rows, judged).mapInArrow(_hashed, f"conv_id bigint, {FIGURES}, repaired_sha256 string")

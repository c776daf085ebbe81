"""Files whose rows may hold their own separators, read by byte ranges.

A range of a CSV file can't be cut into rows by itself: whether it begins within
a quoted cell depends on all that comes before. So a first pass works out for
each range what it makes of every state it may begin in; these functions are put
together along each file, a row per range; and a second pass cuts every range
with its true state. Rows that reach over ranges are put together from their
parts. A CSV range is a run of physical lines, a range of a JSON array a run of
pieces that end in a closing brace.

Ranges are those of Spark's text source, so ``spark.sql.files.maxPartitionBytes``
sets their size, and compressed files are one range.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbob.session import stored

#: Bytes of rows that a task holds before it passes them on.
BATCH_BYTES = 1 << 20

# What a text is: a whole row; the end, a part or the beginning of one that other ranges share.
ROW, HEAD, MIDDLE, TAIL = range(4)


class QuotedLines:
    """Lines of CSV: within a quoted cell or not. A quote counts where a cell begins."""

    separator = "\n"
    starts = (0, 1)

    def __init__(self, quote: str = '"', delimiter: str = ","):
        q, d = re.escape(quote), re.escape(delimiter)
        self.quote = quote
        bare, closed = f"(?!{q})[^{d}]*+", f"{q}(?:[^{q}]|{q}{q})*+{q}(?!{q})[^{d}]*+"
        cells = f"(?:{bare}|{closed})(?:{d}(?:{bare}|{closed}))*+\\Z"
        self.from_outside = re.compile(cells)
        self.from_within = re.compile(f"(?:[^{q}]|{q}{q})*+{q}(?!{q})[^{d}]*+(?:\\Z|{d}{cells})")

    def after(self, state: int, piece: str) -> int:
        if self.quote not in piece:
            return state
        return 0 if (self.from_within if state else self.from_outside).match(piece) else 1

    def ends_row(self, state: int) -> bool:
        return state == 0

    def shift(self, start: int, end: int, known: int) -> int:
        return end

    def row(self, text: str) -> str | None:
        text = text.removesuffix("\r")
        return text if text.strip() else None

    begin = 0


class ArrayObjects:
    """Pieces of a JSON array of objects: depth, and within a string or not.

    The state is twice the depth plus one within a string. A range is worked out
    from depth 0 and moved to the true depth.
    """

    separator = "}"
    starts = (0, 1)
    begin = 0
    mark = re.compile(r'"|\\.|[{}\[\]]', re.DOTALL)

    def after(self, state: int, piece: str) -> int:
        depth, string = state >> 1, state & 1
        for found in self.mark.finditer(piece + "}"):
            c = found[0]
            if c == '"':
                string ^= 1
            elif not string and len(c) == 1:
                depth += 1 if c in "{[" else -1
        return 2 * depth + string

    def ends_row(self, state: int) -> bool:
        return state == 2

    def shift(self, start: int, end: int, known: int) -> int:
        return end + 2 * (known >> 1)

    def row(self, text: str) -> str | None:
        text = text.lstrip(" \t\r\n,[﻿")
        return text if text.startswith("{") else None


Machine = QuotedLines | ArrayObjects


def _pieces(spark: SparkSession, path: str | list[str], machine: Machine) -> DataFrame:
    """``(path, start, piece)`` in order within each range."""
    read = spark.read.option("lineSep", machine.separator).text(path)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("piece"))


def _runs(batches: Iterable[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[str]]]:
    """``(values of columns, pieces)``: consecutive pieces of one range."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in columns)))
        pieces = batch.column("piece").to_pylist()
        at = 0
        while at < len(keys):
            end = len(keys) if keys[at] == keys[-1] else next(i for i in range(at, len(keys)) if keys[i] != keys[at])
            yield keys[at], pieces[at:end]
            at = end


def _functions(machine: Machine) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per range the state it ends in from each state it may begin in; plain if, begun with a row, each piece ends one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ends, plain = None, [], True

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([here[0]]), pa.array([here[1]], pa.int64()), pa.array([ends], pa.list_(pa.int64())), pa.array([plain])],
                ["path", "start", "ends", "plain"],
            )

        for key, pieces in _runs(batches, ("path", "start")):
            if key != here:
                if here:
                    yield out()
                here, ends, plain = key, list(machine.starts), True
            for piece in pieces:
                first, second = ends
                ends = [machine.after(first, piece), machine.after(second, piece)] if first != second else [machine.after(first, piece)] * 2
                plain = plain and machine.ends_row(ends[0])
        if here:
            yield out()

    return run


def _composed(machine: Machine) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per file, whose ranges come in order, the state each begins in."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state = None, machine.begin
        for batch in batches:
            states = []
            for row_path, ends in zip(batch.column("path").to_pylist(), batch.column("ends").to_pylist()):
                if row_path != path:
                    path, state = row_path, machine.begin
                states.append(state)
                at = machine.starts.index(state & 1)
                state = machine.shift(machine.starts[at], ends[at], state)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("start"), pa.array(states, pa.int64())], ["path", "start", "state"])

    return run


def _cut(machine: Machine, wanted: tuple[int, ...]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(path, start, kind, leads, text)``: rows and parts of rows of each range; ``leads`` marks a file's first row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("leads", pa.bool_()), ("text", pa.string())])
        held, size = [], 0
        here, state, open_row, head, first = None, machine.begin, [], False, True

        def keep(kind: int) -> None:
            nonlocal size, first
            # Every text but a whole file's last keeps its separator for the parts around it.
            text = "".join(open_row)
            if kind == ROW:
                text = machine.row(text.removesuffix(machine.separator) if machine.separator == "\n" else text)
            if kind in wanted and text is not None:
                held.append((here[0], here[1], kind, first and kind in (ROW, TAIL) and here[1] == 0, text))
                size += len(text) + 64
            if text is not None and kind in (ROW, TAIL):
                first = False

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            rows, held, size = held, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for key, pieces in _runs(batches, ("path", "start", "state")):
            if key[:2] != here:
                if here and open_row:
                    keep(MIDDLE if head else TAIL)
                here, state, open_row, first = key[:2], key[2], [], True
                head = not (machine.ends_row(state) or here[1] == 0)
            for piece in pieces:
                state = machine.after(state, piece)
                open_row.append(piece + machine.separator)
                if machine.ends_row(state):
                    keep(HEAD if head else ROW)
                    open_row, head = [], False
                    if size > BATCH_BYTES:
                        yield flush()
        if here and open_row:
            keep(MIDDLE if head else TAIL)
        if held:
            yield flush()

    return run


PARTS = "path string, start bigint, kind int, leads boolean, text string"


def _joined(machine: Machine) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows from parts in order: a beginning, any number of middles, an end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, parts, leads = None, [], False
        for batch in batches:
            found = []

            def end() -> None:
                text = "".join(parts)
                # An array's closing bracket is no row; a file may end within a quoted cell.
                row = machine.row(text.removesuffix(machine.separator) if machine.separator == "\n" else text)
                if row is not None:
                    found.append((leads, row))
                parts.clear()

            rows = zip(*(batch.column(c).to_pylist() for c in ("path", "kind", "leads", "text")))
            for row_path, kind, first, text in rows:
                if parts and (row_path != path or kind == TAIL):
                    end()
                if not parts:
                    path, leads = row_path, first
                parts.append(text)
                if kind == HEAD:
                    end()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], ["leads", "text"])
        if parts:
            found = []
            end()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], ["leads", "text"])

    return run


FUNCTIONS = "path string, start bigint, ends array<bigint>, plain boolean"


def functions(spark: SparkSession, path: str | list[str], machine: Machine) -> DataFrame:
    """``(path, start, ends, plain)``: what each range makes of the states it may begin in. Stored, a row per range."""
    return stored(_pieces(spark, path, machine).mapInArrow(_functions(machine), FUNCTIONS), "range-functions")


def is_plain(found: DataFrame) -> bool:
    """Every piece is a row by itself, so any reader of lines will do."""
    return not found.where("NOT plain").limit(1).count()


def rows(spark: SparkSession, path: str | list[str], machine: Machine, found: DataFrame | None = None) -> DataFrame:
    """``(leads, text)``: the rows of files as text, in no order; ``leads`` marks the first of a file.

    Three passes over the files: one works out the ranges' functions (``found``),
    one fetches the few parts of rows that ranges share, one the rows. The first
    two are stored below ``spark.checkpoint.dir``, a row per range and a part per
    range; the row per range, of bounded size, is broadcast.
    """
    pieces = _pieces(spark, path, machine)
    found = functions(spark, path, machine) if found is None else found
    ordered = found.drop("plain").repartition("path").sortWithinPartitions("path", "start")
    states = stored(ordered.mapInArrow(_composed(machine), "path string, start bigint, state bigint"), "range-states")
    known = pieces.join(F.broadcast(states), ["path", "start"])
    shared = stored(known.mapInArrow(_cut(machine, (HEAD, MIDDLE, TAIL)), PARTS), "range-parts")
    together = shared.repartition("path").sortWithinPartitions("path", "start", "kind")
    whole = known.mapInArrow(_cut(machine, (ROW,)), PARTS).select("leads", "text")
    return whole.unionByName(together.mapInArrow(_joined(machine), "leads boolean, text string"))


def as_dataset(df: DataFrame):
    """A text column as the JVM's dataset of texts, which Spark's readers parse."""
    return getattr(df._jdf, "as")(df.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING())

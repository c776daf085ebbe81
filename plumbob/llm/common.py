"""Shared helpers: tables between stages, and texts in blocks of bounded size."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbob.functions.columns import ref

#: Bytes of text that a task holds unpacked at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes of a row group of whole texts.
TEXT_ROW_GROUP = 16 << 20
#: Rows that Spark hands a Python worker at a time while a table is stored; both hold them, and the buffers that grew with them.
BATCH_ROWS = 2000
#: Parts of a table of counts that are added up apart.
SLICES = 64

_local_root: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that driver and executors share.

    A temporary folder of this machine is used only where the setting is absent
    and the master is local, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local_root:
            _local_root.append(tempfile.mkdtemp(prefix="plumbob-llm-"))
        root = _local_root[0]
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile hands workers at most :data:`BATCH_ROWS` rows at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, label: str, whole_texts: bool = False) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read again.

    It ends the lineage: a lost executor costs a read, not the work before it.
    Tables of ``whole_texts`` are written in small row groups and by a codec that
    needs no direct buffers of a page's size, which executors would keep.
    """
    path = scratch(df.sparkSession, label)
    writer = df.write
    if whole_texts:
        writer = writer.option("compression", "zstd").option("parquet.block.size", TEXT_ROW_GROUP)
    with small_batches(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_long(name: str) -> Column:
    return ref(name).cast("bigint")


def texts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(doc_id, text)`` of a table that may have any other columns, of any names."""
    return df.select(as_long(id_column).alias("doc_id"), ref(text_column).cast("string").alias("text"))


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``BLOCK_BYTES`` of text each, and their texts; a null text is empty."""
    for batch in batches:
        start = size = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for i, length in enumerate(lengths):
            size += length
            if size >= BLOCK_BYTES or i + 1 == len(lengths):
                part = batch.slice(start, i + 1 - start)
                yield part, [t or "" for t in part.column(column).to_pylist()]
                start, size = i + 1, 0


def releasing(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving back to the system what Arrow and the allocator hold unused, now and then and at its end.

    Spark keeps a worker after its task, and with it all that the worker has not given back.
    """

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        pool = pa.default_memory_pool()
        try:
            for i, batch in enumerate(run(batches), 1):
                yield batch
                if i % 64 == 0:
                    pool.release_unused()
        finally:
            pool.release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some systems have it
            if trim:
                trim(0)

    return wrapped


def id_lists(blobs: list[bytes], value_type: pa.DataType = pa.int32()) -> pa.ListArray:
    """Byte strings of little-endian unsigned 32-bit ids as one list column."""
    import numpy as np

    offsets = np.zeros(len(blobs) + 1, np.int32)
    np.cumsum([len(b) // 4 for b in blobs], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(blobs), "<u4").astype(value_type.to_pandas_dtype(), copy=False))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def list_slices(column: pa.Array) -> Iterator[memoryview]:
    """The bytes of each list of 32-bit ids, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    import numpy as np

    offsets = np.asarray(column.offsets).tolist()
    values = memoryview(np.ascontiguousarray(np.asarray(column.values).astype("<u4", copy=False)).view("u1"))
    for a, b in zip(offsets, offsets[1:]):
        yield values[4 * a : 4 * b]


def count_slices(counts) -> pa.RecordBatch:
    """A table of counts as rows ``slice, counts``."""
    import numpy as np

    blobs = [zlib.compress(p.astype("<i8").tobytes(), 1) for p in np.split(counts, SLICES)]
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], ["slice", "counts"])


def _add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of slices; the number of slices bounds what is held."""
    import numpy as np

    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(zlib.decompress(blob), "<i8")
            sums[k] = sums[k] + part if k in sums else part
    if sums:
        blobs = [zlib.compress(p.tobytes(), 1) for p in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(blobs, pa.binary())], ["slice", "counts"])


def count_table(slices: DataFrame, size: int):
    """The whole table of ``size`` counts, the sum of what tasks have counted, on the driver."""
    import numpy as np

    merged = slices.select("slice", "counts").repartition("slice").mapInArrow(releasing(_add_up), "slice int, counts binary")
    counts = np.zeros((SLICES, size // SLICES), np.int64)
    for r in merged.collect():  # at most SLICES rows
        counts[r["slice"]] += np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    return counts.reshape(-1)


def tally(*columns: Column) -> Column:
    """A checksum of rows that doesn't depend on their order."""
    return F.sum(F.xxhash64(*columns).cast("decimal(20,0)"))

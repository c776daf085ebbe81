"""Reading registered data: scans, samples, previews and the dataset registry."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbob.functions.columns import local_table
from plumbob.sources import files, jdbc


def scan(df: DataFrame, condition: str | None = None) -> DataFrame:
    """Rows that meet a SQL condition; the source evaluates what it can."""
    return df.where(F.expr(condition)) if condition else df


def scan_count(df: DataFrame, condition: str | None = None) -> DataFrame:
    """``total_rows`` of a scan, without moving its rows."""
    return scan(df, condition).agg(F.count(F.lit(1)).alias("total_rows"))


def sample(df: DataFrame, n: int = 1000, seed: int | None = None) -> DataFrame:
    """Exactly ``n`` random rows, or all when there are fewer.

    The rows are counted first. A threshold on the random numbers then lets
    little more than ``n`` rows of the whole table through, so the task that
    picks the smallest does not get ``n`` rows from every other.
    """
    rows = df.count()
    if rows <= n:
        return df
    number = "__sample_number"
    numbered = df.withColumn(number, F.rand(seed))
    some = numbered.where(F.col(number) < (n + 6 * math.sqrt(n) + 10) / rows)
    if some.count() < n:  # about once in a billion samples
        some = numbered
    return some.orderBy(number).limit(n).drop(number)


def head(df: DataFrame, n: int = 100_000, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows, for profiling a part of a table. Without an order, any ``n``."""
    return (df.orderBy(order_by) if order_by is not None else df).limit(n)


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n)


def from_rows(spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: T.StructType | str | None = None) -> DataFrame:
    """Rows handed over in memory; a key absent from a row is null."""
    names = list(dict.fromkeys(k for row in rows for k in row))
    if not names and schema is None:
        return spark.createDataFrame([], T.StructType([]))
    if schema is not None:
        struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return spark.createDataFrame([tuple(r.get(n) for n in struct.names) for r in rows], struct)
    columns = {n: [r.get(n) for r in rows] for n in names}
    fields = [T.StructField(n, _common_type(c)) for n, c in columns.items()]
    if any(f.dataType is None for f in fields):  # nested cells
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], names)
    cells = [_as_type(c, f.dataType) for f, c in zip(fields, columns.values())]
    return spark.createDataFrame(list(zip(*cells)), T.StructType(fields))


def _common_type(cells: Sequence[Any]) -> T.DataType | None:
    """The type of a column of cells: the narrowest that holds them all, text where they have none in common."""
    kinds = {type(c) for c in cells if c is not None}
    if kinds & {dict, list, tuple, set}:
        return None
    if not kinds:
        return T.StringType()
    if kinds == {bool}:
        return T.BooleanType()
    if kinds == {int}:
        return T.LongType() if all(abs(c) < 1 << 63 for c in cells if c is not None) else T.StringType()
    if kinds <= {int, float}:
        return T.DoubleType()
    if kinds <= {int, decimal.Decimal}:
        return T.DecimalType(38, 18)
    for kind, dtype in ((dt.datetime, T.TimestampType()), (dt.date, T.DateType()), (bytes, T.BinaryType())):
        if kinds == {kind}:
            return dtype
    return T.StringType()


def _as_type(cells: Sequence[Any], dtype: T.DataType) -> list:
    make = {T.DoubleType: float, T.DecimalType: decimal.Decimal, T.StringType: str}.get(type(dtype), lambda c: c)
    return [None if c is None else make(c) for c in cells]


class UnknownDataset(LookupError):
    pass


class Registry:
    """Datasets by id: where they come from, and their DataFrame.

    The entries are metadata of the driver program; the data stays where it is.
    """

    SCHEMA = "id string, name string, source_type string, path string, config map<string,string>, registered_at timestamp"

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._entries: dict[str, tuple] = {}
        self._frames: dict[str, DataFrame] = {}

    def register(
        self,
        name: str,
        source_type: str = "file",
        path: str | None = None,
        config: Mapping[str, str] | None = None,
        data: DataFrame | None = None,
    ) -> str:
        key = uuid.uuid4().hex[:12]
        now = dt.datetime.now(dt.timezone.utc)
        self._entries[key] = (key, name, source_type, path, dict(config or {}), now)
        if data is not None:
            self._frames[key] = data
        return key

    def upload(self, key: str, rows: Sequence[Mapping[str, Any]], schema=None) -> DataFrame:
        self._entry(key)
        self._frames[key] = from_rows(self.spark, rows, schema)
        return self._frames[key]

    def _entry(self, key: str) -> tuple:
        if key not in self._entries:
            raise UnknownDataset(key)
        return self._entries[key]

    def data(self, key: str) -> DataFrame:
        """The dataset, read lazily from its source on first use."""
        _, name, source_type, path, config, _ = self._entry(key)
        if key not in self._frames:
            if source_type == "file" and path:
                self._frames[key] = files.load(self.spark, path)
            elif source_type == "jdbc":
                self._frames[key] = jdbc.read_table(self.spark, config, config.get("table", name))
            else:
                raise UnknownDataset(f"no data for {key}")
        return self._frames[key]

    def view(self, key: str) -> str:
        """Make the dataset available to SQL under its name."""
        name = self._entry(key)[1]
        self.data(key).createOrReplaceTempView(name)
        return name

    def datasets(self) -> DataFrame:
        return local_table(self.spark, list(self._entries.values()), self.SCHEMA)

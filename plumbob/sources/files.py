"""File sources and the file catalogue."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbob.functions.columns import ref
from plumbob.sources import ranges

# Extensions and the reader each one selects.
READERS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json"}


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def _reader_of(path: str) -> str:
    name = path.lower()
    for suffix, reader in READERS.items():
        if name.endswith(suffix):
            return reader
    raise ValueError(f"unsupported file extension: {path}")


def read_csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """Header and types are inferred; a schema saves the inference pass.

    A quote within a quoted cell is doubled. Cells may hold line breaks; files
    are read by ranges all the same (:mod:`plumbob.sources.ranges`): a first pass
    finds out whether any cell does, and only if so rows are put together from
    lines. ``multi_line=False`` saves that pass for files known to hold none.
    The rows of such cells come in no order.
    """
    if multi_line:
        machine = ranges.QuotedLines()
        found = ranges.functions(spark, path, machine)
        if not ranges.is_plain(found):
            return _csv_of_rows(spark, ranges.rows(spark, path, machine, found), schema)
    reader = spark.read.options(**_csv_options(False))
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def _csv_of_rows(spark: SparkSession, rows: DataFrame, schema: str | T.StructType | None) -> DataFrame:
    """Parse rows of CSV. The first row of a file is its header, and that of any file names the columns."""
    body = ranges.as_dataset(rows.where("NOT leads").select("text"))
    options = _csv_options(True)
    if schema is None:
        header = rows.where("leads").select("text").limit(1)
        # The header goes first, so that the reader names the columns by it.
        both = ranges.as_dataset(header.coalesce(1).unionByName(rows.where("NOT leads").select("text")))
        inferred = spark.read.options(**options, inferSchema="true")._jreader.csv(both)
        schema = DataFrame(inferred, spark).schema
    return DataFrame(spark.read.options(**options | {"header": "false"}).schema(schema)._jreader.csv(body), spark)


def _csv_options(multi_line: bool) -> dict[str, str]:
    return {"header": "true", "quote": '"', "escape": '"', "multiLine": str(multi_line).lower()}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def json_kind(spark: SparkSession, path: str) -> str:
    """``objects``, ``array``, ``object`` or ``lines``: how a JSON file lays out its rows.

    ``objects`` is an array whose first element is an object. An object that ends
    on its line, with another object after it, makes lines. Only characters and
    flags come from the tasks, no text.
    """
    begins = F.translate("value", " \t\r\n\ufeff", "")
    first = spark.read.option("lineSep", "}").text(path).where(begins != "").select(F.left(begins, F.lit(2)).alias("begins")).first()
    if first is None or first["begins"].startswith("["):
        return "objects" if first and first["begins"] == "[{" else "array"
    value = F.trim("value")
    whole = F.coalesce(value.startswith("{") & F.try_parse_json(value).isNotNull(), F.lit(False))
    lines = spark.read.text(path).where(value != "").select(whole.alias("whole")).limit(2).collect()
    return "lines" if len(lines) == 2 and all(r["whole"] for r in lines) else "object"


def read_json(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, flatten_object: bool = False, kind: str | None = None
) -> DataFrame:
    """A JSON array gives its elements as rows, JSON lines one row each, nested cells kept nested.

    ``kind`` is :func:`json_kind`'s, which is asked if it is not given. Lines and
    arrays of objects are split over tasks, however they are laid out
    (:mod:`plumbob.sources.ranges`); other arrays and an object are one task.
    ``flatten_object=True`` turns the nested objects of a file that holds one
    object into columns ``a.b``.
    """
    kind = kind or json_kind(spark, path)
    reader = spark.read.option("multiLine", kind != "lines")
    reader = reader.schema(schema) if schema else reader
    if kind == "objects":
        rows = ranges.rows(spark, path, ranges.ArrayObjects()).select("text")
        df = DataFrame(reader._jreader.json(ranges.as_dataset(rows)), spark)
    else:
        df = reader.json(path)
    return flatten(df) if flatten_object else df


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs become columns named by their path; arrays stay as they are."""

    def leaves(col: Column, name: str, dtype: T.DataType) -> Iterator[Column]:
        if not isinstance(dtype, T.StructType) or not dtype.fields:
            yield col.alias(name)
            return
        for f in dtype.fields:
            yield from leaves(col.getField(f.name), f"{name}.{f.name}", f.dataType)

    return df.select(*(c for f in df.schema for c in leaves(ref(f.name), f.name, f.dataType)))


def load(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """Read one dataset with the reader its extension selects."""
    reader = _reader_of(path)
    if reader == "csv":
        return read_csv(spark, path, schema)
    if reader == "parquet":
        return read_parquet(spark, path)
    kind = options.pop("kind", None) or json_kind(spark, path)
    # One object is one row, its nested objects columns.
    return read_json(spark, path, schema, **{"flatten_object": kind == "object", **options}, kind=kind)


def discover(
    spark: SparkSession, root: str, extensions: Sequence[str] = tuple(READERS), recursive: bool = True
) -> DataFrame:
    """Files below ``root`` with a wanted extension: path, name, size and time.

    ``content`` is not selected, so no file is opened.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(root)
        .select("path", "length", "modificationTime")
    )
    return files.where(extension(F.col("path")).isin([e.lower() for e in extensions])).select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        extension(F.col("path")).alias("extension"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("last_modified"),
    )


def dataset_bytes(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``size_bytes``: summed length of the files of a dataset."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"))


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Column names of each file, from its footer or header line, and a footer's row count; null if unreadable."""
    from urllib.parse import quote

    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    for batch in batches:
        found, rows = [], []
        for path, ext in zip(batch["path"], batch["extension"]):
            count = None
            try:
                system, inner = fs.FileSystem.from_uri(quote(path, safe="/:@"))
                if READERS[ext] == "parquet":
                    with system.open_input_file(inner) as file:
                        footer = pq.ParquetFile(file)
                        found.append(list(footer.schema_arrow.names))
                        count = footer.metadata.num_rows
                else:
                    with system.open_input_stream(inner) as stream:
                        found.append(next(csv.reader(io.TextIOWrapper(stream, encoding="utf-8-sig", newline=""))))
            except Exception:
                found.append(None)
            rows.append(count)
        batch["columns"] = pd.Series(found, index=batch.index, dtype=object)
        batch["footer_rows"] = pd.Series(rows, index=batch.index, dtype="Int64")
        yield batch


def list_datasets(
    spark: SparkSession,
    root: str,
    extensions: Sequence[str] = (".csv", ".parquet", ".pq"),
    recursive: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """The catalogue of ``root``: one row per file with its rows and columns.

    Parquet rows are counted from the footers, CSV rows by one job for all files,
    with the options of :func:`read_csv`. Unreadable files stay listed with null
    rows; a read error while counting is an error, never a smaller count.
    """
    files = discover(spark, root, extensions, recursive)
    more = [T.StructField("columns", T.ArrayType(T.StringType())), T.StructField("footer_rows", T.LongType())]
    described = files.mapInPandas(_describe, T.StructType([*files.schema, *more]))
    wanted = sorted(e for e in extensions if READERS.get(e.lower()) == "csv")
    if wanted:
        # Globs are case-sensitive, extensions are not.
        either = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in wanted)
        counted = (
            spark.read.schema(T.StructType([T.StructField("line", T.StringType())]))
            .options(**_csv_options(multi_line), recursiveFileLookup=str(recursive).lower(), pathGlobFilter=f"*{{{either}}}")
            .csv(root)
            .groupBy(F.col("_metadata.file_path").alias("path"))
            .agg(F.count(F.lit(1)).alias("row_count"))
        )
    else:
        counted = files.select("path", F.lit(None).cast("bigint").alias("row_count")).limit(0)
    readable = F.col("columns").isNotNull()
    # The metadata column percent-encodes paths, the file listing does not.
    one_slash = lambda path: F.regexp_replace(path, r"^file:/+", "file:/")
    decoded = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    return (
        described.withColumn("k", one_slash(F.col("path")))
        .join(counted.select(one_slash(decoded).alias("k"), "row_count"), "k", "left")
        .select(
            "name",
            F.col("path").alias("source"),
            F.when(readable, F.coalesce("footer_rows", "row_count", F.lit(0))).alias("row_count"),
            F.coalesce(F.size("columns"), F.lit(0)).alias("column_count"),
            F.coalesce("columns", F.array().cast("array<string>")).alias("columns"),
            "size_bytes",
            "last_modified",
        )
        .orderBy("source")
    )

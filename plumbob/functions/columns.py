"""Column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRACTIONAL = (T.FloatType, T.DoubleType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)

# Longer keys are grouped by their digest, so a shuffle moves 65 characters
# per row instead of a whole text.
DIGEST_OVER = 64


def ref(name: str) -> Column:
    """A column by its exact name; dots and backticks are not special."""
    return F.col("`" + name.replace("`", "``") + "`")


def quoted(name: str) -> str:
    """A column by its exact name, for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def present_sql(name: str, dtype: T.DataType) -> str:
    """:func:`present` as SQL text. Wide tables are described by text: one call per expression."""
    col = quoted(name)
    if isinstance(dtype, FRACTIONAL):
        return f"CASE WHEN NOT isnan({col}) THEN {col} + CAST(0 AS {dtype.simpleString()}) END"
    return col


def text_sql(expression: str, dtype: T.DataType) -> str:
    """:func:`text_of` as SQL text, for a value without NaN."""
    if isinstance(dtype, T.StringType):
        return expression
    if isinstance(dtype, T.BinaryType):
        return f"base64({expression})"
    if isinstance(dtype, NESTED):
        return f"CASE WHEN {expression} IS NOT NULL THEN to_json({expression}, map('ignoreNullFields', 'false')) END"
    return f"CAST({expression} AS STRING)"


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_missing(col: Column, dtype: T.DataType) -> Column:
    """Null or NaN. ``NaN >= 0`` holds in Spark, so NaN must be named."""
    return col.isNull() | F.isnan(col) if isinstance(dtype, FRACTIONAL) else col.isNull()


def present(col: Column, dtype: T.DataType) -> Column:
    """The value with NaN turned into null and -0.0 into 0.0."""
    if isinstance(dtype, FRACTIONAL):
        return F.when(~F.isnan(col), col + F.lit(0).cast(dtype))
    return col


def text_of(col: Column, dtype: T.DataType) -> Column:
    """One text per distinct value; missing values become null."""
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, T.BinaryType):
        return F.base64(col)
    if isinstance(dtype, NESTED):
        return F.when(col.isNotNull(), F.to_json(col, {"ignoreNullFields": "false"}))
    return present(col, dtype).cast("string")


def compact(text: Column) -> Column:
    """A grouping key of bounded length: long texts are replaced by a digest.

    Keys of up to 64 characters stay as they are and digests have 65, so the
    two kinds cannot collide.
    """
    return F.when(F.length(text) > DIGEST_OVER, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)


def _unbounded(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.BinaryType, *NESTED))


def packed(texts: Sequence[Column], dtypes: Sequence[T.DataType]) -> Column:
    """One grouping key from the texts of several cells; nulls are equal to each other.

    Free texts carry their length, so no two rows share a key by accident. A
    single cell is its own key and stays null when missing.
    """
    open_ended = any(map(_unbounded, dtypes))
    if len(texts) == 1:
        return compact(texts[0]) if open_ended else texts[0]
    parts = [
        F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t) if _unbounded(d) else t, F.lit("~"))
        for t, d in zip(texts, dtypes, strict=True)
    ]
    key = F.concat_ws("|", *parts)
    return compact(key) if open_ended else key


def row_key(df: DataFrame, names: Sequence[str]) -> Column:
    """Grouping key of one or several columns."""
    dtypes = [type_of(df, n) for n in names]
    return packed([text_of(ref(n), d) for n, d in zip(names, dtypes)], dtypes)


def row_text_sql(fields: Sequence[T.StructField]) -> str:
    """All cells of a row as one unambiguous text, as SQL text."""
    parts = []
    for f in fields:
        text = text_sql(present_sql(f.name, f.dataType), f.dataType)
        parts.append(f"coalesce(concat(length({text}), ':', {text}), '~')" if _unbounded(f.dataType) else f"coalesce({text}, '~')")
    return f"concat_ws('|', {', '.join(parts)})"


def as_number(col: Column, dtype: T.DataType) -> Column:
    """Number or null; text that is no number becomes null."""
    if isinstance(dtype, T.StringType):
        col = F.trim(col)
    return col.try_cast("double")


def generalise(text: Column) -> Column:
    """Letter runs become ``A+`` and digit runs ``D+``.

    Letters go first: the other order would rewrite the ``D`` of ``D+``.
    """
    return F.regexp_replace(F.regexp_replace(text, r"\p{L}+", "A+"), r"\p{Nd}+", "D+")


# The characters that count as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("bigint")


def share(part: Column, whole: Column, empty: float) -> Column:
    """part / whole as a double, with a value for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(empty))


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A small driver-side table (rule metadata, weights, policies)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [()] * len(struct)
    table = pa.table(
        [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow
    )
    return spark.createDataFrame(table, schema=struct)

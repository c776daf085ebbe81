"""Column and dataset profiles.

A full profile reads a table twice, whatever the number of columns:

1. the cells of all columns, counted by value before their only exchange, from
   which come distinct counts, top values, patterns, quartiles and every
   statistic of whole numbers and doubles (:mod:`plumbob.operators.frequencies`);
2. fused aggregates with the extremes and lengths of the other columns; a few
   columns per aggregate, so that the generated code stays small enough to be
   compiled (a row-oriented source is read once per aggregate: raise
   ``COLUMNS_PER_AGGREGATE`` or store it as Parquet first).

Long texts that a result shows are fetched in a third read. A profile with
quartiles only shuffles no values: one scan sketches, one counts
(:mod:`plumbob.operators.quartiles`).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from plumbob.functions.columns import (
    generalise,
    literal,
    local_table,
    present_sql,
    quoted,
    ref,
    row_text_sql,
    share,
    text_of,
    text_sql,
)
from plumbob.operators.frequencies import cells, column_list, counts, deviations, family, leading, numbers
from plumbob.operators.quartiles import QUARTILES, SKETCH_SIZE, bracket_ranks, cuts_of_brackets, cuts_of_values, quartiles_of

# The parts of a profile beyond the fused statistics.
PARTS = ("distinct", "top", "patterns", "quartiles")

# Columns per aggregate. Wider ones outgrow what the JVM compiles.
COLUMNS_PER_AGGREGATE = 4

_NO_ORDER = (T.MapType, T.VariantType, T.NullType)
_FIXED_WIDTH = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.FloatType: 4,
    T.DateType: 4,
    T.LongType: 8,
    T.DoubleType: 8,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
}

_BARE = "array<struct<value:string,count:bigint>>"


def _fields(df: DataFrame, columns: Sequence[str] | None) -> list[tuple[int, T.StructField]]:
    names = set(columns) if columns is not None else None
    return [(i, f) for i, f in enumerate(df.schema) if names is None or f.name in names]


def _width(dtype: T.DataType) -> int | None:
    if isinstance(dtype, T.DecimalType):
        return 8 if dtype.precision <= 18 else 16
    return _FIXED_WIDTH.get(type(dtype))


def _cell_bytes(f: T.StructField) -> str:
    dtype, col = f.dataType, quoted(f.name)
    width = _width(dtype)
    if width is not None:
        return f"count({col}) * {width}"
    return f"coalesce(sum(octet_length({text_sql(col, dtype)})), 0)"


def _chunks(items: list, size: int = COLUMNS_PER_AGGREGATE) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def column_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Counts, extremes, moments and lengths: one row per column."""
    return reduce(DataFrame.unionByName, (_statistics(df, part) for part in _chunks(_fields(df, columns))))


# Output of the statistics; a column that has no such statistic gets null.
_STATISTICS = {
    "bytes": "bigint",
    "min_value": "string",
    "max_value": "string",
    "min_number": "double",
    "mean": "double",
    "std": "double",
    "min_length": "int",
    "max_length": "int",
    "avg_length": "double",
}


def _statistics(df: DataFrame, part: list[tuple[int, T.StructField]]) -> DataFrame:
    aggregates, rows = ["count(1) AS total"], []
    for i, f in part:
        dtype, value = f.dataType, present_sql(f.name, f.dataType)
        put = {"valued": f"count({value})", "bytes": _cell_bytes(f)}
        shown = {"bytes": f"bytes_{i}"}
        if not isinstance(dtype, _NO_ORDER):
            put |= {"min": f"min({value})", "max": f"max({value})"}
            shown |= {"min_value": text_sql(f"min_{i}", dtype), "max_value": text_sql(f"max_{i}", dtype)}
        if isinstance(dtype, T.NumericType):
            number = f"CAST({value} AS DOUBLE)"
            put |= {"mean": f"avg({number})", "std": f"stddev_samp({number})"}
            shown |= {"min_number": f"min_{i}", "mean": f"mean_{i}", "std": f"std_{i}"}
        if isinstance(dtype, T.StringType):
            put |= {f"{g}_length": f"{g}(length({value}))" for g in ("min", "max", "avg")}
            shown |= {f"{g}_length": f"{g}_length_{i}" for g in ("min", "max", "avg")}
        aggregates += [f"{a} AS {k}_{i}" for k, a in put.items()]
        fields = ", ".join(f"CAST({shown.get(k, 'NULL')} AS {t}) AS {k}" for k, t in _STATISTICS.items())
        rows.append(
            f"struct({i} AS position, {literal(f.name)} AS name, {literal(dtype.simpleString())} AS dtype, "
            f"total AS total_count, total - valued_{i} AS null_count, {fields})"
        )
    return df.agg(*map(F.expr, aggregates)).selectExpr(f"inline(array({', '.join(rows)}))")


def _with_statistics(rows: DataFrame, has: dict[str, Column | str]) -> DataFrame:
    """Rows per column in the form of :func:`column_statistics`; what they lack is null."""
    kept = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("total_count", "null_count")]
    cast = [(F.expr(has[k]) if k in has else F.lit(None)).cast(t).alias(k) for k, t in _STATISTICS.items()]
    return rows.select("position", "name", "dtype", *kept, *cast)


def _widths(fields: list[tuple[int, T.StructField]]) -> str:
    """Bytes per present cell, by position."""
    return "CASE " + " ".join(f"WHEN position = {i} THEN valued * {_width(f.dataType)}" for i, f in fields) + " END"


def _statistics_of_cells(df: DataFrame, fields: list, table: DataFrame, counted: DataFrame) -> DataFrame:
    """The same statistics; those of whole numbers and doubles come from the counted cells."""
    known = [(i, f) for i, f in fields if not isinstance(family(f.dataType), T.StringType)]
    others = [(i, f) for i, f in fields if isinstance(family(f.dataType), T.StringType)]
    parts = [_statistics(df, part) for part in _chunks(others)]
    if known:
        rows = (
            column_list(df, known)
            .join(F.broadcast(counted), "position", "left")
            .join(F.broadcast(deviations(table, counted)), "position", "left")
            .withColumn("null_count", F.col("total_count") - F.col("valued"))
        )
        shown = {
            "bytes": f"coalesce({_widths(known)}, 0)",
            "min_value": "coalesce(CAST(min_whole AS STRING), CAST(least AS STRING))",
            "max_value": "coalesce(CAST(max_whole AS STRING), CAST(greatest AS STRING))",
            "min_number": "coalesce(CAST(min_whole AS DOUBLE), least)",
            "mean": "mean",
            "std": "std",
        }
        parts.append(_with_statistics(rows, shown))
    return reduce(DataFrame.unionByName, parts)


def _frequencies_by_family(df: DataFrame, columns: Sequence[str] | None) -> dict[T.DataType, DataFrame]:
    """``(position, value, n)`` of the present cells, one table per cell type.

    Each table is read in one scan of its columns and counted before its one
    exchange. Numbers are neither printed nor parsed.
    """
    families: dict[T.DataType, list] = {}
    for i, f in _fields(df, columns):
        families.setdefault(family(f.dataType), []).append((i, f))

    def cell(i: int, f: T.StructField, family: T.DataType) -> str:
        value = present_sql(f.name, f.dataType)
        value = text_sql(value, f.dataType) if isinstance(family, T.StringType) else f"CAST({value} AS {family.simpleString()})"
        return f"struct({i} AS position, {value} AS value)"

    return {
        family: df.selectExpr(f"inline(array({', '.join(cell(i, f, family) for i, f in part)}))")
        .where("value IS NOT NULL")
        .groupBy("position", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        for family, part in families.items()
    }


def _as_text(families: dict[T.DataType, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (t.withColumn("value", F.col("value").cast("string")) for t in families.values()))


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(position, value, n)``: how often each present cell occurs, as text."""
    return _as_text(_frequencies_by_family(df, columns))


def distinct_counts(frequencies: DataFrame) -> DataFrame:
    # Counting by `n` keeps it in the plan, so the exchange equals that of the
    # other readers and is reused.
    return frequencies.groupBy("position").agg(F.count_if(F.col("n") > 0).alias("distinct_count"))


def _leading(counted: DataFrame, what: str, k: int) -> DataFrame:
    """The ``k`` most frequent per column, ties by text; pruned before the shuffle."""
    order = W.partitionBy("position").orderBy(F.col("n").desc(), F.col(what))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_values(frequencies: DataFrame, k: int = 10) -> DataFrame:
    """``(position, rank, value, n)``."""
    return _leading(frequencies, "value", k)


def value_patterns(frequencies: DataFrame, k: int = 10, positions: Sequence[int] | None = None) -> DataFrame:
    """``(position, rank, pattern, n, pct)``; pct is the share among the kept patterns.

    Columns outside ``positions`` collapse to one null pattern that is dropped
    at the end: a filter here would travel below the exchange and keep it from
    being shared.
    """
    pattern = generalise(F.col("value"))
    if positions is not None:
        pattern = F.when(F.col("position").isin(list(positions)), pattern)
    counted = frequencies.groupBy("position", pattern.alias("pattern")).agg(F.sum("n").alias("n"))
    kept = F.sum("n").over(W.partitionBy("position"))
    leading = _leading(counted, "pattern", k).withColumn("pct", F.round(F.col("n") * 100.0 / kept, 1))
    return leading.where(F.col("pattern").isNotNull())


def _numeric(df: DataFrame, columns: Sequence[str] | None) -> list[tuple[int, T.StructField]]:
    return [(i, f) for i, f in _fields(df, columns) if isinstance(f.dataType, T.NumericType)]


def _number(f: T.StructField) -> str:
    return f"CAST({present_sql(f.name, f.dataType)} AS DOUBLE)"


def quartile_brackets(df: DataFrame, columns: Sequence[str] | None = None) -> dict[int, list[float]]:
    """Per numeric column, values around each of the three quartiles, ascending.

    Runs one scan with quantile sketches and collects these few numbers.
    Columns without any number are left out.
    """
    chosen = _numeric(df, columns)
    if not chosen:
        return {}
    ranks = ", ".join(f"{r!r}D" for r in bracket_ranks())
    rows = (
        _long_numbers(df, chosen)
        .groupBy("position")
        .agg(F.expr(f"kll_sketch_agg_double(v, {SKETCH_SIZE})").alias("sketch"))
        .selectExpr("position", f"kll_sketch_get_quantile_double(sketch, array({ranks})) AS edges")
        .collect()
    )
    return {r["position"]: list(r["edges"]) for r in rows}


def _long_numbers(df: DataFrame, chosen: list[tuple[int, T.StructField]]) -> DataFrame:
    """``(position, v, n)`` of each numeric cell."""
    rows = ", ".join(f"struct({i} AS position, {_number(f)} AS v)" for i, f in chosen)
    return df.selectExpr(f"inline(array({rows}))").where("v IS NOT NULL").withColumn("n", F.lit(1).cast("bigint"))


def quartiles(df: DataFrame, brackets: dict[int, list[float]], columns: Sequence[str] | None = None) -> DataFrame:
    """Exact, linearly interpolated quartiles: ``(position, p25, median, p75)``.

    Values outside the brackets are only counted, so no column is shuffled; see
    :mod:`plumbob.operators.quartiles`. Brackets that are off cost a read, not
    the result.
    """
    chosen = [(i, f) for i, f in _numeric(df, columns) if i in brackets]
    if not chosen:
        empty = df.select(F.lit(0).alias("position")).limit(0)
        return empty.select("position", *(F.lit(None).cast("double").alias(c) for c in ("p25", "median", "p75")))
    edges = local_table(df.sparkSession, [(i, brackets[i]) for i, _ in chosen], "position int, edges array<double>")
    return quartiles_of(_long_numbers(df, chosen), cuts_of_brackets(edges), most=max(map(len, brackets.values())))


def _gathered(ranked: DataFrame, name: str, **fields: str) -> DataFrame:
    """Ranked rows as one array per column; the ranking keeps the arrays short."""
    entries = F.array_sort(F.collect_list(F.struct("rank", *fields.values())))
    return ranked.groupBy("position").agg(
        F.transform(entries, lambda e: F.struct(*(e[c].alias(f) for f, c in fields.items()))).alias(name)
    )


def _sketched(df: DataFrame, columns: Sequence[str] | None, top_k: int, pattern_k: int) -> DataFrame:
    """Distinct counts, top values and patterns from sketches."""

    def leading(text: Column, k: int) -> Column:
        return F.call_function("approx_top_k", text, F.lit(k))

    def chunk(part: list[tuple[int, T.StructField]]) -> DataFrame:
        aggregates, rows = [], []
        for i, f in part:
            text = text_of(ref(f.name), f.dataType)
            is_text = isinstance(f.dataType, T.StringType)
            aggregates += [F.approx_count_distinct(text).alias(f"d_{i}"), leading(text, top_k).alias(f"t_{i}")]
            if is_text:
                aggregates.append(leading(generalise(text), pattern_k).alias(f"p_{i}"))
            top = F.filter(f"t_{i}", lambda e: e["item"].isNotNull())
            shapes = F.filter(f"p_{i}", lambda e: e["item"].isNotNull()) if is_text else None
            kept = F.aggregate(shapes, F.lit(0).cast("bigint"), lambda a, e: a + e["count"]) if is_text else None
            rows.append(
                F.struct(
                    F.lit(i).alias("position"),
                    F.col(f"d_{i}").alias("distinct_count"),
                    F.transform(top, lambda e: F.struct(e["item"].alias("value"), e["count"].alias("count"))).alias("top_k"),
                    (
                        F.transform(
                            shapes,
                            lambda e: F.struct(
                                e["item"].alias("pattern"), e["count"].alias("count"), F.round(e["count"] * 100.0 / kept, 1).alias("pct")
                            ),
                        )
                        if is_text
                        else F.lit(None).cast("array<struct<pattern:string,count:bigint,pct:double>>")
                    ).alias("patterns"),
                )
            )
        return df.agg(*aggregates).select(F.inline(F.array(*rows)))

    return reduce(DataFrame.unionByName, map(chunk, _chunks(_fields(df, columns))))


def profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    top_k: int = 10,
    pattern_k: int = 10,
    approx: bool = False,
    include: Sequence[str] = PARTS,
) -> DataFrame:
    """One row per column with every statistic.

    ``include`` names the parts that cost an extra read: ``distinct``, ``top``,
    ``patterns`` and ``quartiles``. A part left out is null or empty.
    ``approx=True`` takes distinct counts, quartiles, top values and patterns
    from sketches, so that no value is shuffled at all.
    """
    wanted = _fields(df, columns)
    texts = [i for i, f in wanted if isinstance(f.dataType, T.StringType)]
    unknown = set(include) - set(PARTS)
    if unknown:
        raise ValueError(f"unknown parts: {sorted(unknown)}")
    numeric = _numeric(df, columns)
    sides = []
    if approx:
        joined = column_statistics(df, columns)
        sides.append(_sketched(df, columns, top_k, pattern_k))
        # The middle of a bracket is an approximate quartile.
        brackets = quartile_brackets(df, columns) if "quartiles" in include else {}
        if brackets:
            near = [(i, *(e[(2 * q + 1) * len(e) // (2 * len(QUARTILES))] for q in range(len(QUARTILES)))) for i, e in brackets.items()]
            sides.append(local_table(df.sparkSession, near, "position int, p25 double, median double, p75 double"))
    elif {"distinct", "top", "patterns"} & set(include):
        table = cells(df, wanted, shaped="patterns" in include)
        counted = counts(table)
        joined = _statistics_of_cells(df, wanted, table, counted)
        if "distinct" in include:
            sides.append(counted.select("position", "distinct_count"))
        tops, shapes = leading(
            df, wanted, table, top_k if "top" in include else None, pattern_k if "patterns" in include and texts else None
        )
        if tops is not None:
            sides.append(_gathered(tops, "top_k", value="value", count="n"))
        if shapes is not None:
            sides.append(_gathered(shapes, "patterns", pattern="pattern", count="n", pct="pct"))
        if "quartiles" in include and numeric:
            values = numbers(table, wanted)
            sides.append(quartiles_of(values, cuts_of_values(values)))
    else:
        joined = column_statistics(df, columns)
        if "quartiles" in include and numeric:
            sides.append(quartiles(df, quartile_brackets(df, columns), columns))
    # Each joined side holds at most one row per column.
    for side in sides:
        joined = joined.join(F.broadcast(side), "position", "left")
    absent = {"distinct_count": "bigint", "top_k": _BARE, "patterns": "array<struct<pattern:string,count:bigint,pct:double>>", "p25": "double", "median": "double", "p75": "double"}
    for name, dtype in absent.items():
        if name not in joined.columns:
            joined = joined.withColumn(name, F.lit(None).cast(dtype))

    total, distinct_n = F.col("total_count"), F.col("distinct_count")
    if approx or "distinct" in include:
        distinct_n = F.coalesce(distinct_n, F.lit(0))
    return joined.select(
        "position",
        "name",
        "dtype",
        "total_count",
        "null_count",
        F.round(share(F.col("null_count"), total, 0.0) * 100, 2).alias("null_pct"),
        distinct_n.alias("distinct_count"),
        F.round(share(distinct_n, total, 0.0) * 100, 2).alias("distinct_pct"),
        "min_value",
        "max_value",
        "mean",
        "std",
        "median",
        "p25",
        "p75",
        "min_length",
        "max_length",
        F.round("avg_length", 2).alias("avg_length"),
        F.coalesce("top_k", F.array().cast(_BARE)).alias("top_k"),
        F.coalesce("patterns", F.array().cast("array<struct<pattern:string,count:bigint,pct:double>>")).alias("patterns"),
        ((total > 0) & (F.col("null_count") == 0) & (distinct_n == total)).alias("is_unique"),
        "min_number",
    ).orderBy("position")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``duplicate_row_count``: rows beyond the first of each equal group.

    Rows are compared by a 256-bit digest of all cells, so the exchange moves 32
    bytes per row however wide the table is.
    """
    digest = F.expr(f"unhex(sha2({row_text_sql(df.schema.fields)}, 256))")
    return (
        df.select(digest.alias("digest"))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_row_count"))
    )


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: row, column and duplicate counts, cell bytes, share of null cells."""
    width = len(df.columns)
    sums = column_statistics(df).agg(
        F.max("total_count").alias("row_count"),
        F.sum("null_count").alias("nulls"),
        F.sum("bytes").alias("memory_bytes"),
    )
    return sums.withColumn("duplicate_row_count", duplicate_rows(df).scalar()).select(
        "row_count",
        F.lit(width).alias("column_count"),
        "duplicate_row_count",
        "memory_bytes",
        (share(F.col("nulls"), F.col("row_count") * width, 0.0) * 100).alias("null_cell_pct"),
    )


def profile_view(profiles: DataFrame) -> DataFrame:
    """The short form: type, nulls, distincts, extremes and moments.

    Needs no other part than ``distinct``.
    """
    return profiles.select(
        "name",
        "dtype",
        "null_count",
        "null_pct",
        "distinct_count",
        "distinct_pct",
        "is_unique",
        F.col("min_value").alias("min"),
        F.col("max_value").alias("max"),
        "mean",
        "std",
    )


# Name parts that mark identifier columns.
ID_HINTS = ("id", "key", "code", "uuid", "email")


def derived_rules(profiles: DataFrame) -> DataFrame:
    """Rules that a profile suggests, as rows ``(position, rule_no, type, column, ...)``."""
    from plumbob.functions.patterns import EMAIL_RULE, PHONE_RULE

    name = F.lower("name")
    nulls = F.col("null_count") / F.col("total_count")
    filled = F.col("total_count") - F.col("null_count")

    def suggestion(when: Column, no: int, kind: str, severity: Column, pattern=None, min_value=None) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(no).alias("rule_no"),
                F.lit(kind).alias("type"),
                severity.alias("severity"),
                F.lit(pattern).cast("string").alias("pattern"),
                F.lit(min_value).cast("double").alias("min_value"),
            ),
        )

    hinted = F.lit(False)
    for hint in ID_HINTS:
        hinted |= name.contains(hint)
    suggestions = F.array(
        suggestion(F.col("null_count") > 0, 0, "null_check", F.when(nulls < 0.05, "high").otherwise("medium")),
        suggestion(hinted & (filled > 0) & (F.col("distinct_count") == filled), 1, "unique_check", F.lit("high")),
        suggestion(F.col("min_number") >= 0, 2, "range_check", F.lit("medium"), min_value=0.0),
        suggestion(name.contains("email"), 3, "regex_check", F.lit("high"), pattern=EMAIL_RULE),
        suggestion(name.contains("phone"), 4, "regex_check", F.lit("medium"), pattern=PHONE_RULE),
    )
    return profiles.select("position", F.col("name").alias("column"), F.inline(F.array_compact(suggestions)))


def auto_rules(df: DataFrame, profiles: DataFrame | None = None) -> list:
    """Collect the derived rules (a few per column) as rule specifications."""
    from plumbob.operators.rules import null_check, range_check, regex_check, unique_check

    profiles = profile(df, include=("distinct",)) if profiles is None else profiles
    rules = []
    for r in derived_rules(profiles).orderBy("position", "rule_no").collect():
        if r["type"] == "null_check":
            rules.append(null_check(r["column"], severity=r["severity"]))
        elif r["type"] == "unique_check":
            rules.append(unique_check(r["column"], severity=r["severity"]))
        elif r["type"] == "range_check":
            rules.append(range_check(r["column"], min_value=r["min_value"], severity=r["severity"]))
        else:
            rules.append(regex_check(r["column"], r["pattern"], severity=r["severity"]))
    return rules



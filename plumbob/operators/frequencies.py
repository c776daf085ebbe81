"""How often each value of each column occurs, in one scan and one exchange.

Cells of all columns share one long table ``(position, whole, number, text, long,
n)``; one of the four value columns is set, none for a missing cell. Whole
numbers and doubles stay numbers. A text of more than ``DIGEST_OVER`` characters
is counted by its 256-bit digest, with the beginnings of the text and of its
pattern for sorting, so whole texts are never shuffled; those that a result
shows are fetched at the end by their digests.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from plumbob.functions.columns import DIGEST_OVER, generalise, local_table, present_sql, text_sql

#: Characters of a long text that travel for sorting. Texts that begin alike are fetched to be compared.
BEGINNING = 32

Field = tuple[int, T.StructField]

_LONG = "struct<digest:binary,start:string,shape:binary,shape_start:string>"


def family(dtype: T.DataType) -> T.DataType:
    """The type a column's cells are counted in; whole numbers and doubles stay numbers."""
    if isinstance(dtype, T.IntegralType):
        return T.LongType()
    return dtype if isinstance(dtype, T.DoubleType) else T.StringType()


def _texts(fields: Sequence[Field]) -> list[Field]:
    return [(i, f) for i, f in fields if isinstance(family(f.dataType), T.StringType)]


def _cell_text(f: T.StructField) -> str:
    return text_sql(present_sql(f.name, f.dataType), f.dataType)


def cells(df: DataFrame, fields: Sequence[Field], shaped: bool = True) -> DataFrame:
    """``(position, whole, number, text, long, n)`` of all cells, missing ones too.

    ``shaped`` adds the patterns of long texts, for :func:`leading_patterns`.
    """
    textual = dict(_texts(fields))
    with_shape = {i for i, f in textual.items() if shaped and isinstance(f.dataType, T.StringType)}
    # Texts and patterns are named first, so that each is worked out once.
    first = [F.expr(present_sql(f.name, f.dataType)).alias(f"v{i}") for i, f in fields if i not in textual]
    first += [F.expr(_cell_text(f)).alias(f"v{i}") for i, f in textual.items()]
    named = df.select(*first)
    named = named.select("*", *(F.when(F.length(f"v{i}") > DIGEST_OVER, generalise(F.col(f"v{i}"))).alias(f"s{i}") for i in sorted(with_shape)))

    def cell(i: int, f: T.StructField) -> str:
        v, kind = f"v{i}", family(f.dataType)
        whole = f"CAST({v} AS BIGINT)" if isinstance(kind, T.LongType) else "CAST(NULL AS BIGINT)"
        number = v if isinstance(kind, T.DoubleType) else "CAST(NULL AS DOUBLE)"
        text, long = "CAST(NULL AS STRING)", f"CAST(NULL AS {_LONG})"
        if i in textual:
            text = f"CASE WHEN length({v}) <= {DIGEST_OVER} THEN {v} END"
            shape = (f"unhex(sha2(s{i}, 256))", f"left(s{i}, {BEGINNING})") if i in with_shape else ("CAST(NULL AS BINARY)", "CAST(NULL AS STRING)")
            long = (
                f"CASE WHEN length({v}) > {DIGEST_OVER} THEN named_struct('digest', unhex(sha2({v}, 256)), "
                f"'start', left({v}, {BEGINNING}), 'shape', {shape[0]}, 'shape_start', {shape[1]}) END"
            )
        return f"struct({i} AS position, {whole} AS whole, {number} AS number, {text} AS text, {long} AS long)"

    return (
        named.selectExpr(f"inline(array({', '.join(cell(i, f) for i, f in fields)}))")
        .groupBy("position", "whole", "number", "text", "long")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def is_present() -> Column:
    return F.col("whole").isNotNull() | F.col("number").isNotNull() | F.col("text").isNotNull() | F.col("long").isNotNull()


def counts(table: DataFrame) -> DataFrame:
    """Per column ``total_count, valued, distinct_count`` and, for numbers, extremes and the mean."""
    there = is_present()
    value = F.coalesce(F.col("whole").cast("double"), F.col("number"))
    # Conditions on `n` stay above the shared exchange.
    valued = F.sum(F.when(there, F.col("n")).otherwise(0))
    return table.groupBy("position").agg(
        F.sum("n").alias("total_count"),
        valued.alias("valued"),
        F.count_if(there & (F.col("n") > 0)).alias("distinct_count"),
        F.min("whole").alias("min_whole"),
        F.max("whole").alias("max_whole"),
        F.min("number").alias("least"),
        F.max("number").alias("greatest"),
        (F.sum(value * F.col("n")) / F.nullif(F.sum(F.when(value.isNotNull(), F.col("n"))), F.lit(0))).alias("mean"),
    )


def deviations(table: DataFrame, counted: DataFrame) -> DataFrame:
    """``(position, std)``: sample standard deviations of the numbers, around the means already known."""
    value = F.coalesce(F.col("whole").cast("double"), F.col("number"))
    # One row per column.
    near = table.join(F.broadcast(counted.select("position", "mean")), "position")
    apart = (value - F.col("mean")) * (value - F.col("mean")) * F.col("n")
    size = F.sum(F.when(value.isNotNull(), F.col("n")).otherwise(0))
    return near.groupBy("position").agg(F.when(size > 1, F.sqrt(F.sum(apart) / (size - 1))).alias("std"))


def _shown(value: Column) -> Column:
    return F.coalesce(F.col("whole").cast("string"), F.col("number").cast("string"), F.col("text"), value)


def _candidates(counted: DataFrame, start: Column, k: int) -> DataFrame:
    """At least the ``k`` most frequent per column: more only where long texts begin alike."""
    order = W.partitionBy("position").orderBy(F.col("n").desc(), start)
    return counted.withColumn("at", F.rank().over(order)).where(F.col("at") <= k).drop("at")


def _fetched(df: DataFrame, fields: Sequence[Field], wanted: DataFrame) -> DataFrame:
    """``(position, digest, full)`` of the long texts with the wanted digests; the table is not read if there are none."""
    rows = ", ".join(f"struct({i} AS position, {_cell_text(f)} AS full)" for i, f in _texts(fields))
    long = df.selectExpr(f"inline(array({rows}))").where(F.length("full") > DIGEST_OVER)
    long = long.withColumn("digest", F.unhex(F.sha2("full", 256)))
    return long.join(wanted.distinct(), ["position", "digest"], "left_semi").groupBy("position", "digest").agg(F.min("full").alias("full"))


def _ranked(candidates: DataFrame, what: str, k: int) -> DataFrame:
    order = W.partitionBy("position").orderBy(F.col("n").desc(), F.col(what))
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def leading(
    df: DataFrame, fields: Sequence[Field], table: DataFrame, top_k: int | None, pattern_k: int | None
) -> tuple[DataFrame | None, DataFrame | None]:
    """The most frequent values ``(position, rank, value, n)`` and patterns ``(position, rank, pattern, n, pct)``.

    Ties go by text. A pattern's share is among the kept ones. Either is None if
    its number is None.
    """
    textual = _texts(fields)
    strings = [i for i, f in textual if isinstance(f.dataType, T.StringType)]
    values = shapes = None
    wanted = []
    if top_k is not None:
        there = table.withColumn("n", F.when(is_present(), F.col("n")).otherwise(0)).where("n > 0")
        values = _candidates(there, _shown(F.col("long.start")), top_k)
        wanted.append(values.select("position", F.col("long.digest").alias("digest")))
    if pattern_k is not None and strings:
        short = F.when(F.col("position").isin(strings), generalise(F.col("text")))
        # A long text's pattern goes by its digest, even where it is short itself, until the text is there.
        counted = table.select("position", short.alias("pattern"), "long", F.when(is_present(), F.col("n")).otherwise(0).alias("n")).groupBy(
            "position", "pattern", F.col("long.shape").alias("shape"), F.col("long.shape_start").alias("shape_start")
        ).agg(F.sum("n").alias("n"), F.min("long.digest").alias("digest"))
        shapes = counted.where((F.col("n") > 0) & (F.col("pattern").isNotNull() | F.col("shape").isNotNull()))
        # Long texts may have the pattern of short ones; such a pattern is counted in both parts.
        short_digest = F.unhex(F.sha2("pattern", 256))
        shapes = shapes.groupBy("position", F.coalesce("shape", short_digest).alias("shape")).agg(
            F.max("pattern").alias("pattern"),
            F.min("digest").alias("digest"),
            F.max(F.coalesce("shape_start", F.left("pattern", F.lit(BEGINNING)))).alias("shape_start"),
            F.sum("n").alias("n"),
        )
        shapes = _candidates(shapes, F.col("shape_start"), pattern_k)
        wanted.append(shapes.where("pattern IS NULL").select("position", "digest"))
    if textual and wanted:
        found = _fetched(df, textual, reduce(DataFrame.unionByName, wanted).where("digest IS NOT NULL"))
        if values is not None:
            values = values.withColumn("digest", F.col("long.digest")).join(found, ["position", "digest"], "left")
        if shapes is not None:
            shapes = shapes.join(found, ["position", "digest"], "left").withColumn("pattern", F.coalesce("pattern", generalise(F.col("full"))))
    elif values is not None:
        values = values.withColumn("full", F.lit(None).cast("string"))
    if values is not None:
        values = _ranked(values.select("position", _shown(F.col("full")).alias("value"), "n"), "value", top_k)
    if shapes is not None:
        kept = F.sum("n").over(W.partitionBy("position"))
        shapes = _ranked(shapes.select("position", "pattern", "n"), "pattern", pattern_k)
        shapes = shapes.withColumn("pct", F.round(F.col("n") * 100.0 / kept, 1))
    return values, shapes


def numbers(table: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """``(position, v, n)``: the numeric cells as doubles, decimals and floats included."""
    value = "coalesce(CAST(whole AS DOUBLE), number"
    for kind, sql in ((T.FloatType, "CAST(CAST(text AS FLOAT) AS DOUBLE)"), (T.DecimalType, "CAST(text AS DOUBLE)")):
        which = [str(i) for i, f in fields if isinstance(f.dataType, kind)]
        if which:
            value += f", CASE WHEN position IN ({', '.join(which)}) THEN {sql} END"
    placed = table.selectExpr("position", f"{value}) AS v", "n")
    # The condition is on `n`, so that it stays above the shared exchange.
    return placed.withColumn("n", F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).where("n > 0")


def column_list(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """``(position, name, dtype)``, one row per column."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in fields]
    return local_table(df.sparkSession, rows, "position int, name string, dtype string")

"""Run rules over a table.

All row rules share one scan and one aggregate. All uniqueness, referential and
combination rules share one scan and one exchange: their keys are laid out as
``(rule_no, key)`` rows and counted before anything is joined, so a key that
holds a third of the table travels as one row per task. Failing rows are
fetched by one further scan for all rules together.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from plumbob.functions.columns import (
    compact,
    is_missing,
    local_table,
    packed,
    present,
    ref,
    row_key,
    share,
    text_of,
    type_of,
)
from plumbob.operators.rules import Rule, RuleError, is_key_rule, row_predicate

# Wider aggregates outgrow a generated method; longer rule lists are split.
AGGREGATE_WIDTH = 200

_META = (
    "rule_no int, rule_name string, dimension string, severity string, threshold double, "
    "`column` string, details string"
)


@dataclass(frozen=True)
class Evaluation:
    """``results``: one row per rule. ``skipped``: rules that could not run, and why."""

    results: DataFrame
    skipped: DataFrame


@dataclass(frozen=True)
class _Compiled:
    no: int
    rule: Rule
    passes: Column | None = None
    key: Column | None = None
    reference: DataFrame | None = None


def run_instant(as_of: Column | dt.datetime | str | None) -> Column:
    """The run time as a column; zone-less input is UTC."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    return F.lit(as_of)


# -- compilation ---------------------------------------------------------------


_BINARY = (T.FloatType, T.DoubleType)


def _digits(dtype: T.DataType) -> tuple[int, int]:
    """Precision and scale that hold every value of an exact numeric type."""
    return (dtype.precision, dtype.scale) if isinstance(dtype, T.DecimalType) else (20, 0)


def _common_key(left: T.DataType, right: T.DataType) -> T.DataType:
    """The type both sides of a key comparison are cast to."""
    if left == right:
        return left
    whole = T.IntegralType
    if isinstance(left, whole) and isinstance(right, whole):
        return T.LongType()
    if isinstance(left, T.NumericType) and isinstance(right, T.NumericType):
        if isinstance(left, _BINARY) or isinstance(right, _BINARY):
            return T.DoubleType()
        # Exact on both sides: integers beyond 2^53 differ as doubles no more.
        (p1, s1), (p2, s2) = (_digits(t) for t in (left, right))
        scale, digits = max(s1, s2), max(p1 - s1, p2 - s2)
        return T.DecimalType(digits + scale, scale) if digits + scale <= 38 else T.StringType()
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(left, times) and isinstance(right, times):
        return T.TimestampNTZType()
    return T.StringType()


def _paired_keys(df: DataFrame, names, other: DataFrame, other_names) -> tuple[Column, DataFrame]:
    """The key column of ``df`` and the distinct keys of ``other``.

    A key with a missing part is null on both sides.
    """
    left, right, types, present_all, other_all = [], [], [], F.lit(True), F.lit(True)
    for name, other_name in zip(names, other_names, strict=True):
        dtype, other_dtype = type_of(df, name), type_of(other, other_name)
        common = _common_key(dtype, other_dtype)
        types.append(common)
        left.append(text_of(ref(name).try_cast(common), common))
        right.append(text_of(ref(other_name).try_cast(common), common))
        present_all &= ~is_missing(ref(name), dtype)
        other_all &= ~is_missing(ref(other_name), other_dtype)
    keys = other.where(other_all).select(packed(right, types).alias("key"))
    return F.when(present_all, packed(left, types)), keys


def _compile(no: int, rule: Rule, df: DataFrame, as_of: Column) -> _Compiled:
    needed = (*rule.columns, *rule.params.get("keys", ()))
    gone = [c for c in needed if c not in df.columns]
    if gone:
        raise RuleError(f"missing column: {', '.join(gone)}")
    if not is_key_rule(rule):
        passes = row_predicate(rule, df, as_of)
        df.select(passes)  # analysed here, so a broken expression skips this rule only
        return _Compiled(no, rule, passes=passes)
    if rule.kind == "unique_check":
        return _Compiled(no, rule, key=row_key(df, rule.columns))
    if rule.kind == "accuracy_check":
        sides = _truth_sides(rule, df)
        return _Compiled(no, rule, key=_truth_key(sides.mine, sides.value))
    reference, names = rule.params["reference_df"], rule.params["reference_columns"]
    gone = [c for c in names if c not in reference.columns]
    if gone:
        raise RuleError(f"missing reference column: {', '.join(gone)}")
    key, keys = _paired_keys(df, rule.columns, reference, names)
    return _Compiled(no, rule, key=key, reference=keys)


def _compile_all(df: DataFrame, rules: Sequence[Rule], as_of: Column):
    """``(df, rules that run, rules that cannot and why)``; the table gains a column per text condition.

    Whatever one rule raises, also a custom predicate, skips that rule alone.
    """
    good, bad = [], []
    df, held = _with_conditions(df, rules, bad)
    failed = {no for no, *_ in bad}
    for no, rule in enumerate(rules):
        if no in failed:
            continue
        try:
            if no in held:
                good.append(_Compiled(no, rule, passes=F.coalesce(ref(held[no]), F.lit(False))))
            else:
                good.append(_compile(no, rule, df, as_of))
        except Exception as err:
            bad.append((no, rule.name, (str(err) or type(err).__name__).split("\n")[0]))
    return df, *_drop_bad_patterns(df, good, bad)


_CONDITION = "__condition_"


def _with_conditions(df: DataFrame, rules: Sequence[Rule], bad: list) -> tuple[DataFrame, dict[int, str]]:
    """Text conditions as columns in which a bad cast or a division by zero is null, and so fails, in its row alone."""
    texts = {no: r for no, r in enumerate(rules) if isinstance(r.params.get("condition"), str)}
    held: dict[int, str] = {}
    conf = df.sparkSession.conf
    ansi = conf.get("spark.sql.ansi.enabled")
    try:
        conf.set("spark.sql.ansi.enabled", "false")
        for no, rule in texts.items():
            gone = [c for c in rule.columns if c not in df.columns]
            name = f"{_CONDITION}{no}"
            try:
                if gone:
                    raise RuleError(f"missing column: {', '.join(gone)}")
                # Analysed here, where the lenient mode of casts and divisions is fixed.
                df = df.withColumn(name, F.expr(f"CAST(({rule.params['condition']}) AS BOOLEAN)"))
                held[no] = name
            except Exception as err:
                bad.append((no, rule.name, str(err).split("\n")[0]))
    finally:
        conf.set("spark.sql.ansi.enabled", ansi)
    return df, held


def _own_fields(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema if not f.name.startswith(_CONDITION)]


def _drop_bad_patterns(df: DataFrame, good: list[_Compiled], bad: list):
    """Try patterns on an empty text, so a pattern Java refuses skips one rule.

    The probe is a constant that the optimizer folds; no job runs.
    """
    probe = df.sparkSession.sql("SELECT '' AS v")

    def works(items: list[_Compiled]) -> bool:
        from plumbob.functions.patterns import full_match

        try:
            probe.select(
                *(full_match(F.col("v"), c.rule.params["pattern"]).alias(f"m{c.no}") for c in items)
            ).collect()
            return True
        except PySparkException:
            return False

    with_pattern = [c for c in good if c.passes is not None and "pattern" in c.rule.params]
    if not with_pattern or works(with_pattern):
        return good, bad
    broken = {c.no for c in with_pattern if not works([c])}
    bad += [(c.no, c.rule.name, "pattern not supported") for c in good if c.no in broken]
    return [c for c in good if c.no not in broken], bad


# -- counting ------------------------------------------------------------------


def _row_counts(df: DataFrame, compiled: Sequence[_Compiled]) -> DataFrame:
    """One aggregate for all row rules, turned into one row per rule."""

    def counted(part: Sequence[_Compiled]) -> DataFrame:
        wide = df.agg(
            F.count(F.lit(1)).alias("total"),
            *(F.sum(c.passes.cast("int")).alias(f"pass_{c.no}") for c in part),
        )
        return wide.select(
            F.inline(
                F.array(
                    *(
                        F.struct(
                            F.lit(c.no).alias("rule_no"),
                            F.col(f"pass_{c.no}").alias("pass_count"),
                            F.col("total").alias("total_count"),
                        )
                        for c in part
                    )
                )
            )
        )

    chunks = [compiled[i : i + AGGREGATE_WIDTH] for i in range(0, len(compiled), AGGREGATE_WIDTH)]
    return reduce(DataFrame.unionByName, map(counted, chunks))


def _keyed_rows(df: DataFrame, compiled: Sequence[_Compiled], *extra: Column) -> DataFrame:
    """``(rule_no, key)`` for every row and key rule."""
    pairs = F.array(
        *(F.struct(F.lit(c.no).alias("rule_no"), c.key.alias("key")) for c in compiled)
    )
    return df.select(*extra, F.inline(pairs))


def _judged_keys(df: DataFrame, compiled: Sequence[_Compiled], order: Column | None) -> DataFrame:
    """Per rule and key: rows, failing rows, and the first position of the key.

    Reference keys enter the same aggregate as rows that weigh nothing. A key is
    then known or unknown within its own group, and no join is needed whatever
    the sizes of the two tables are.
    """
    extra = () if order is None else (order.alias("position"),)
    first = F.col("key") if order is None else F.col("position")
    rows = _keyed_rows(df, compiled, *extra).withColumn("n", F.lit(1)).withColumn("known", F.lit(False))
    for c in compiled:
        if c.reference is not None:
            keys = c.reference.select(
                F.lit(c.no).alias("rule_no"), "key", F.lit(0).alias("n"), F.lit(True).alias("known")
            )
            rows = rows.unionByName(keys, allowMissingColumns=True)
    counted = (
        rows.groupBy("rule_no", "key")
        .agg(
            F.sum("n").alias("n"),
            F.bool_or("known").alias("known"),
            F.min(F.when(F.col("n") > 0, first)).alias("first_at"),
        )
        .where(F.col("n") > 0)
    )
    unique = [c.no for c in compiled if c.rule.kind == "unique_check"]
    clash = F.col("rule_no").isin(unique) if unique else F.lit(False)
    fails = F.when(clash, F.col("n") > 1).otherwise(F.col("key").isNotNull() & ~F.col("known"))
    return counted.select("rule_no", "key", "first_at", "n", F.when(fails, F.col("n")).otherwise(0).alias("fail"))


@dataclass(frozen=True)
class _Truth:
    """The two sides of a reconciliation, brought to common types."""

    names: list[str]
    mine: list[Column]
    theirs: list[Column]
    value: Column
    true_value: Column


def _truth_sides(rule: Rule, df: DataFrame) -> _Truth:
    p = rule.params
    truth = p["truth_df"]
    gone = [c for c in (*p["truth_keys"], p["truth_column"]) if c not in truth.columns]
    if gone:
        raise RuleError(f"missing truth column: {', '.join(gone)}")
    names, mine, theirs = [], [], []
    for i, (key, truth_key) in enumerate(zip(p["keys"], p["truth_keys"], strict=True)):
        common = _common_key(type_of(df, key), type_of(truth, truth_key))
        names.append(f"k{i}")
        mine.append(text_of(ref(key).try_cast(common), common))
        theirs.append(text_of(ref(truth_key).try_cast(common), common))
    dtype, truth_type = type_of(df, rule.column), type_of(truth, p["truth_column"])
    common = T.DoubleType() if p["tolerance"] is not None else _common_key(dtype, truth_type)
    return _Truth(
        names,
        mine,
        theirs,
        present(present(ref(rule.column), dtype).try_cast(common), common),
        present(present(ref(p["truth_column"]), truth_type).try_cast(common), common),
    )


def _truth_key(keys: Sequence[Column], value: Column) -> Column:
    texts = [*keys, value.cast("string")]
    return packed(texts, [T.StringType()] * len(texts))


def _join_key(keys: Sequence[Column]) -> Column:
    """Null if a part is missing: such a row has no truth."""
    there = reduce(Column.__and__, (k.isNotNull() for k in keys))
    return F.when(there, packed(keys, [T.StringType()] * len(keys)))


def _value_parts(value: Column, tolerance: float | None) -> dict[str, Column]:
    """A value to compare: a number where it need only be near, else a text that equal values share."""
    none = F.lit(None)
    if tolerance is None:
        return {"text": compact(value.cast("string")), "number": none.cast("double")}
    return {"text": none.cast("string"), "number": value}


def _judged_truths(df: DataFrame, compiled: Sequence[_Compiled], order: Column | None) -> DataFrame:
    """The same shape for reconciliations with sources of truth, all rules together.

    The table is read once and each source of truth once. Rows are first counted
    per (rule, key, value) and the truths are reduced to one row per (rule, key),
    so a hot key costs one row on either side of the one join.
    """
    sides = {c.no: _truth_sides(c.rule, df) for c in compiled}
    tolerances = {c.no: c.rule.params["tolerance"] for c in compiled}
    extra = () if order is None else (order.alias("position"),)
    first = F.lit(None).cast("string") if order is None else F.min("position")

    def entry(c: _Compiled) -> Column:
        side = sides[c.no]
        parts = _value_parts(side.value, tolerances[c.no])
        return F.struct(F.lit(c.no).alias("rule_no"), c.key.alias("key"), _join_key(side.mine).alias("meet"), *(v.alias(n) for n, v in parts.items()))

    counted = (
        df.select(*extra, F.inline(F.array(*map(entry, compiled))))
        .groupBy("rule_no", "key", "meet", "text", "number")
        .agg(F.count(F.lit(1)).alias("n"), first.alias("first_at"))
    )

    def truth(c: _Compiled) -> DataFrame:
        side = sides[c.no]
        parts = _value_parts(side.true_value, tolerances[c.no])
        limit = F.lit(None if tolerances[c.no] is None else float(tolerances[c.no])).cast("double")
        return c.rule.params["truth_df"].select(
            F.lit(c.no).alias("rule_no"), _join_key(side.theirs).alias("meet"), *(v.alias(n) for n, v in parts.items()), limit.alias("limit")
        )

    truths = reduce(DataFrame.unionByName, map(truth, compiled)).where(F.col("meet").isNotNull())
    reduced = truths.groupBy("rule_no", "meet").agg(
        *(f(n).alias(f"{side}_{n}") for n in ("text", "number") for side, f in (("low", F.min), ("high", F.max))),
        F.count(F.coalesce("text", F.col("number").cast("string"))).alias("valued"),
        F.count(F.lit(1)).alias("rows"),
        F.max("limit").alias("limit"),
    )
    number = F.col("number")
    same = (F.col("text") == F.col("low_text")) & (F.col("text") == F.col("high_text"))
    near = (F.abs(number - F.col("low_number")) <= F.col("limit")) & (F.abs(number - F.col("high_number")) <= F.col("limit"))
    nothing = F.col("text").isNull() & number.isNull()
    agrees = F.when(nothing, F.col("valued") == 0).otherwise(F.coalesce(same, near) & (F.col("valued") == F.col("rows")))
    return counted.join(reduced, ["rule_no", "meet"], "left").select(
        "rule_no",
        "key",
        (F.col("key") if order is None else F.col("first_at")).alias("first_at"),
        "n",
        F.when(F.coalesce(agrees, F.lit(False)), 0).otherwise(F.col("n")).alias("fail"),
    )


def _judged(df: DataFrame, keyed: Sequence[_Compiled], order: Column | None) -> DataFrame | None:
    parts = []
    shared = [c for c in keyed if c.rule.kind != "accuracy_check"]
    if shared:
        parts.append(_judged_keys(df, shared, order))
    accurate = [c for c in keyed if c.rule.kind == "accuracy_check"]
    if accurate:
        parts.append(_judged_truths(df, accurate, order))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _key_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("rule_no").agg(
        F.sum(F.col("n") - F.col("fail")).alias("pass_count"), F.sum("n").alias("total_count")
    )


# -- failing rows --------------------------------------------------------------


def _order_column(df: DataFrame, order_by: str | Sequence[str] | None) -> Column | None:
    if order_by is None:
        return None
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    return F.struct(*(ref(n) for n in names))


def _samples(df, row_rules, keyed, judged, order: Column | None, size: int) -> DataFrame:
    """The first ``size`` failing rows of each rule, as ``(rule_no, rank, row)``.

    A failing row among the first ``size`` belongs to one of the ``size``
    failing keys that appear first, so at most ``size`` keys per rule have to be
    matched against the table. The window keeps ``size`` rows per rule and task
    before it shuffles.
    """
    position = F.xxhash64(*(text_of(ref(f.name), f.dataType) for f in _own_fields(df))) if order is None else order
    marks = [
        F.struct(
            F.lit(c.no).alias("rule_no"),
            F.lit(None).cast("string").alias("key"),
            (~c.passes).alias("fails"),
        )
        for c in row_rules
    ] + [
        F.struct(F.lit(c.no).alias("rule_no"), c.key.alias("key"), F.lit(None).cast("boolean").alias("fails"))
        for c in keyed
    ]
    open_marks = F.filter(F.array(*marks), lambda m: F.coalesce(m["fails"], F.lit(True)))
    rows = df.select(F.struct(*(ref(f.name) for f in _own_fields(df))).alias("row"), position.alias("position"), F.inline(open_marks))
    if judged is not None:
        first = W.partitionBy("rule_no").orderBy("first_at", "key")
        suspects = (
            judged.where(F.col("fail") > 0)
            .withColumn("rank", F.row_number().over(first))
            .where(F.col("rank") <= size)
            .select(F.col("rule_no").alias("s_no"), F.col("key").alias("s_key"))
        )
        # At most `size` keys per rule, whatever the table holds.
        rows = rows.join(
            F.broadcast(suspects),
            (F.col("rule_no") == F.col("s_no")) & F.col("key").eqNullSafe(F.col("s_key")),
            "left",
        ).where(F.col("fails") | F.col("s_no").isNotNull())
    by_position = W.partitionBy("rule_no").orderBy("position")
    return (
        rows.withColumn("rank", F.row_number().over(by_position))
        .where(F.col("rank") <= size)
        .select("rule_no", "rank", "row")
    )


def failing_rows(df: DataFrame, rules: Sequence[Rule], order_by=None, size: int = 5, as_of=None) -> DataFrame:
    """Long form of the failing samples: rule_name, rank and the row itself."""
    df, good, _ = _compile_all(df, rules, run_instant(as_of))
    row_rules = [c for c in good if c.passes is not None]
    keyed = [c for c in good if c.passes is None]
    order = _order_column(df, order_by)
    judged = _judged(df, keyed, order)
    names = local_table(df.sparkSession, [(c.no, c.rule.name) for c in good], "rule_no int, rule_name string")
    samples = _samples(df, row_rules, keyed, judged, order, size)
    return samples.join(F.broadcast(names), "rule_no").select("rule_no", "rule_name", "rank", "row")


# -- results -------------------------------------------------------------------


def evaluate(
    df: DataFrame,
    rules: Sequence[Rule],
    as_of=None,
    order_by: str | Sequence[str] | None = None,
    sample_size: int = 5,
) -> Evaluation:
    """Evaluate ``rules`` on ``df`` lazily.

    ``order_by`` fixes what "first" means for failing samples; without it rows
    are ordered by a digest of their content. ``sample_size=0`` leaves the
    samples out and saves their scan.
    """
    spark = df.sparkSession
    instant = run_instant(as_of)
    df, good, bad = _compile_all(df, rules, instant)
    skipped = local_table(spark, bad, "rule_no int, rule_name string, reason string")
    meta = local_table(
        spark,
        [
            (c.no, c.rule.name, c.rule.dimension, c.rule.severity, c.rule.threshold, c.rule.column, c.rule.details)
            for c in good
        ],
        _META,
    )
    row_rules = [c for c in good if c.passes is not None]
    keyed = [c for c in good if c.passes is None]
    order = _order_column(df, order_by) if sample_size else None
    judged = _judged(df, keyed, order)

    parts = []
    if row_rules:
        parts.append(_row_counts(df, row_rules))
    if judged is not None:
        parts.append(_key_counts(judged))
    if parts:
        counts = reduce(DataFrame.unionByName, parts)
    else:
        counts = local_table(spark, [], "rule_no int, pass_count bigint, total_count bigint")

    # The metadata has one row per rule; broadcasting the counts keeps rules
    # whose table is empty.
    results = meta.join(F.broadcast(counts), "rule_no", "left")
    total = F.coalesce(F.col("total_count"), F.lit(0)).cast("bigint")
    passed = F.coalesce(F.col("pass_count"), F.lit(0)).cast("bigint")
    rate = share(passed, total, 1.0)
    if sample_size and good:
        samples = (
            _samples(df, row_rules, keyed, judged, order, sample_size)
            .groupBy("rule_no")
            .agg(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("rank", F.to_json("row", {"ignoreNullFields": "false"}).alias("json")))),
                    lambda s: s["json"],
                ).alias("failing_sample")
            )
        )
        results = results.join(F.broadcast(samples), "rule_no", "left")
        sample = F.coalesce(F.col("failing_sample"), F.array().cast("array<string>"))
    else:
        sample = F.array().cast("array<string>")
    results = results.select(
        "rule_no",
        "rule_name",
        "dimension",
        "severity",
        passed.alias("pass_count"),
        (total - passed).alias("fail_count"),
        total.alias("total_count"),
        F.round(rate, 6).alias("pass_rate"),
        (rate >= F.col("threshold")).alias("passed"),
        "threshold",
        "column",
        "details",
        sample.alias("failing_sample"),
        (F.lit(1.0) - F.round(rate, 6)).alias("fail_rate"),
    )
    return Evaluation(results, skipped)


def by_dimension(results: DataFrame) -> DataFrame:
    """Results gathered per dimension; a dimension holds at most all rules."""
    fields = ("rule_name", "severity", "pass_count", "fail_count", "total_count", "pass_rate", "passed")
    return results.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("rule_count"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("rule_no", *fields))),
            lambda r: F.struct(*(r[f].alias(f) for f in fields)),
        ).alias("results"),
    )


def report(results: DataFrame) -> DataFrame:
    """Failed rules first, most failures first; split by failures, not by threshold."""
    failed = F.col("fail_count") > 0
    return results.select(
        F.when(failed, "failed").otherwise("passed").alias("section"),
        "rule_name",
        "column",
        "dimension",
        "severity",
        "pass_count",
        "fail_count",
        (share(F.col("fail_count"), F.col("total_count"), 0.0) * 100).alias("fail_pct"),
        "passed",
    ).orderBy(F.col("fail_count").desc(), "rule_name")


class RuleSet:
    """A growing list of rules with the evaluation entry points."""

    def __init__(self, rules: Sequence[Rule] = ()) -> None:
        self.rules = list(rules)

    @classmethod
    def from_yaml(cls, path) -> RuleSet:
        from plumbob.operators.rules import rules_from_yaml_file

        return cls(rules_from_yaml_file(path))

    @classmethod
    def from_dicts(cls, entries) -> RuleSet:
        from plumbob.operators.rules import rules_from_dicts

        return cls(rules_from_dicts(entries))

    def add(self, rule: Rule) -> None:
        self.rules.append(rule)

    def evaluate(self, df: DataFrame, **options) -> Evaluation:
        return evaluate(df, self.rules, **options)

    def evaluate_by_dimension(self, df: DataFrame, **options) -> DataFrame:
        return by_dimension(self.evaluate(df, **options).results)

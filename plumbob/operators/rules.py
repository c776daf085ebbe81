"""Rule specifications.

A rule is data: what to check on which columns. Two families exist.

* *Row rules* decide each row alone and compile to one boolean ``Column``.
* *Key rules* (uniqueness, referential, allowed combinations, reconciliation)
  need the other rows or another table; they compile to a grouping key.

:mod:`plumbob.operators.evaluate` turns both into counts.
"""

from __future__ import annotations

import datetime as dt
import decimal
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbob.functions.columns import as_number, is_missing, ref, type_of
from plumbob.functions.patterns import FORMATS, full_match

# The vocabulary of results.
SEVERITIES = ("critical", "high", "medium", "low", "info")
DIMENSIONS = (
    "completeness",
    "uniqueness",
    "validity",
    "consistency",
    "timeliness",
    "accuracy",
    "integrity",
    "conformity",
)

# Detail texts of results.
DETAILS = {
    "null_check": "Null check on '{column}'",
    "unique_check": "Uniqueness check on {columns}",
    "range_check": "Range [{min_value}, {max_value}] on '{column}'",
    "regex_check": "Regex '{pattern}' on '{column}'",
    "foreign_key_check": "FK check: '{column}' against {count} reference values",
    "freshness_check": "Freshness: '{column}' within {max_age_hours}h",
}


class RuleError(ValueError):
    """The rule cannot run on this table; it is reported as skipped."""


@dataclass(frozen=True)
class Rule:
    kind: str
    name: str
    column: str | None
    columns: tuple[str, ...]
    dimension: str
    severity: str = "medium"
    threshold: float = 1.0
    details: str = ""
    params: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES:
            raise ValueError(f"unknown severity {self.severity!r}")
        if self.dimension not in DIMENSIONS:
            raise ValueError(f"unknown dimension {self.dimension!r}")


def _rule(kind, column, dimension, severity, threshold, name, details, prefix=None, **params) -> Rule:
    columns = (column,) if isinstance(column, str) else tuple(column or ())
    label = "+".join(columns)
    return Rule(
        kind=kind,
        name=name or f"{prefix or kind}_{label}",
        column=label or None,
        columns=columns,
        dimension=dimension,
        severity=severity,
        threshold=float(threshold),
        details=details,
        params=params,
    )


# -- row rules ---------------------------------------------------------------


def null_check(column: str, threshold=1.0, severity="high", name=None) -> Rule:
    """Fails where the value is null or NaN."""
    return _rule(
        "null_check", column, "completeness", severity, threshold, name, DETAILS["null_check"].format(column=column)
    )


def range_check(
    column: str, min_value=None, max_value=None, threshold=1.0, severity="medium", name=None
) -> Rule:
    """Inclusive bounds; missing values and text that is no number fail."""
    return _rule(
        "range_check",
        column,
        "validity",
        severity,
        threshold,
        name,
        DETAILS["range_check"].format(column=column, min_value=min_value, max_value=max_value),
        min_value=min_value,
        max_value=max_value,
    )


def regex_check(column: str, pattern: str, threshold=1.0, severity="medium", name=None) -> Rule:
    """The whole text must match; missing values fail."""
    re.compile(pattern)
    return _rule(
        "regex_check",
        column,
        "conformity",
        severity,
        threshold,
        name,
        DETAILS["regex_check"].format(column=column, pattern=pattern),
        pattern=pattern,
    )


def format_check(column: str, format: str, threshold=1.0, severity="medium", name=None) -> Rule:
    """Match one of the named formats in :data:`plumbob.functions.patterns.FORMATS`."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}")
    return _rule(
        "format_check",
        column,
        "conformity",
        severity,
        threshold,
        name,
        f"Format {format} on '{column}'",
        pattern=FORMATS[format],
    )


def freshness_check(column: str, max_age_hours=24.0, threshold=1.0, severity="high", name=None) -> Rule:
    """Not older than ``max_age_hours`` before the run; the future passes, missing fails."""
    return _rule(
        "freshness_check",
        column,
        "timeliness",
        severity,
        threshold,
        name,
        DETAILS["freshness_check"].format(column=column, max_age_hours=max_age_hours),
        max_age_hours=float(max_age_hours),
    )


def cast_check(column: str, type: str, threshold=1.0, severity="medium", name=None) -> Rule:
    """The value is missing or can be cast to the SQL type."""
    return _rule(
        "cast_check",
        column,
        "validity",
        severity,
        threshold,
        name,
        f"Cast to {type} on '{column}'",
        type=type,
    )


def enum_check(column: str, values: Iterable[Any], threshold=1.0, severity="medium", name=None) -> Rule:
    """The value is missing or one of ``values``."""
    values = tuple(values)
    return _rule(
        "enum_check",
        column,
        "validity",
        severity,
        threshold,
        name,
        f"One of {len(set(values))} values on '{column}'",
        reference_values=values,
    )


# -- key rules ---------------------------------------------------------------


def unique_check(column: str | Sequence[str], threshold=1.0, severity="high", name=None) -> Rule:
    """Every member of a duplicate group fails; nulls are equal to each other."""
    columns = [column] if isinstance(column, str) else list(column)
    return _rule(
        "unique_check",
        columns,
        "uniqueness",
        severity,
        threshold,
        name,
        DETAILS["unique_check"].format(columns=columns),
    )


def foreign_key_check(
    column: str,
    reference_values: Iterable[Any] | None = None,
    reference_df: DataFrame | None = None,
    reference_column: str | None = None,
    threshold=1.0,
    severity="high",
    name=None,
) -> Rule:
    """Present values must occur in a literal set or in a column of another table."""
    if reference_values is not None:
        values = tuple(reference_values)
        return _rule(
            "foreign_key_check",
            column,
            "integrity",
            severity,
            threshold,
            name,
            DETAILS["foreign_key_check"].format(column=column, count=len(set(values))),
            prefix="fk_check",
            reference_values=values,
        )
    if reference_df is None or reference_column is None:
        raise ValueError("give reference_values, or reference_df and reference_column")
    return _rule(
        "foreign_key_check",
        column,
        "integrity",
        severity,
        threshold,
        name,
        f"FK check: '{column}' against column '{reference_column}'",
        prefix="fk_check",
        reference_df=reference_df,
        reference_columns=(reference_column,),
    )


def consistency_check(
    condition: str | Column | None = None,
    columns: Sequence[str] = (),
    reference_df: DataFrame | None = None,
    reference_columns: Sequence[str] | None = None,
    threshold=1.0,
    severity="medium",
    name=None,
) -> Rule:
    """Cross-field agreement: a condition per row, or an allowed combination.

    A condition that is null fails. A combination with a missing part passes,
    as in referential checks.
    """
    if condition is not None:
        return _rule(
            "consistency_check",
            list(columns),
            "consistency",
            severity,
            threshold,
            name or (None if columns else "consistency_check"),
            f"Consistency: {condition if isinstance(condition, str) else 'condition'}",
            condition=condition,
        )
    if reference_df is None or not columns:
        raise ValueError("give a condition, or columns and reference_df")
    return _rule(
        "consistency_check",
        list(columns),
        "consistency",
        severity,
        threshold,
        name,
        f"Allowed combinations of {list(columns)}",
        reference_df=reference_df,
        reference_columns=tuple(reference_columns or columns),
    )


def accuracy_check(
    key: str | Sequence[str],
    column: str,
    truth_df: DataFrame,
    truth_key: str | Sequence[str] | None = None,
    truth_column: str | None = None,
    tolerance: float | None = None,
    threshold=1.0,
    severity="high",
    name=None,
) -> Rule:
    """The value agrees with the source of truth; a key unknown there fails.

    With a tolerance, numbers may differ by that much. Both missing agree. When
    the truth holds several rows for a key, the value must agree with each.
    """
    keys = (key,) if isinstance(key, str) else tuple(key)
    truth_keys = (truth_key,) if isinstance(truth_key, str) else tuple(truth_key or keys)
    return _rule(
        "accuracy_check",
        column,
        "accuracy",
        severity,
        threshold,
        name,
        f"Accuracy of '{column}' by {list(keys)}",
        keys=keys,
        truth_df=truth_df,
        truth_keys=truth_keys,
        truth_column=truth_column or column,
        tolerance=tolerance,
    )


# -- compilation of row rules --------------------------------------------------

Predicate = Callable[[Rule, DataFrame, Column], Column]


def _not_null(rule: Rule, df: DataFrame, as_of: Column) -> Column:
    return ~is_missing(ref(rule.column), type_of(df, rule.column))


def _in_range(rule: Rule, df: DataFrame, as_of: Column) -> Column:
    dtype = type_of(df, rule.column)
    if not isinstance(dtype, (T.NumericType, T.StringType, T.BooleanType)):
        raise RuleError(f"range check needs numbers or text, '{rule.column}' is {dtype.simpleString()}")
    number = as_number(ref(rule.column), dtype)
    ok = number.isNotNull() & ~F.isnan(number)
    if rule.params.get("min_value") is not None:
        ok &= number >= F.lit(float(rule.params["min_value"]))
    if rule.params.get("max_value") is not None:
        ok &= number <= F.lit(float(rule.params["max_value"]))
    return ok


def _matches(rule: Rule, df: DataFrame, as_of: Column) -> Column:
    col, dtype = ref(rule.column), type_of(df, rule.column)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BinaryType)):
        raise RuleError(f"regex check cannot read {dtype.simpleString()}")
    return ~is_missing(col, dtype) & full_match(col.cast("string"), rule.params["pattern"])


def _fresh(rule: Rule, df: DataFrame, as_of: Column) -> Column:
    dtype = type_of(df, rule.column)
    if not isinstance(dtype, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise RuleError(f"freshness check needs times, '{rule.column}' is {dtype.simpleString()}")
    age = F.make_dt_interval(secs=F.lit(decimal.Decimal(str(rule.params["max_age_hours"] * 3600))))
    oldest, col = as_of - age, ref(rule.column)
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        # Zone-less values are UTC. The limit is moved, not the values: it is a
        # constant, so nothing is converted per row.
        oldest = F.convert_timezone(F.current_timezone(), F.lit("UTC"), oldest.cast("timestamp_ntz"))
        return col.cast("timestamp_ntz") >= oldest
    return col.try_cast("timestamp") >= oldest


def literals_for(dtype: T.DataType, values: Iterable[Any]) -> list[Any]:
    """The values that can equal a cell of this type, as values of this very type.

    Numbers are compared exactly: an integer equals a double or a decimal of the
    same value, and a value that the type cannot hold equals no cell.
    """
    numbers = (bool, int, float, decimal.Decimal)

    def held(v: Any) -> Any:
        if v is None or v != v:
            return None
        if isinstance(dtype, T.StringType):
            return v if isinstance(v, str) else None
        if isinstance(dtype, T.DateType):
            return v if isinstance(v, dt.date) and not isinstance(v, dt.datetime) else None
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            return v if isinstance(v, dt.datetime) else None
        if not isinstance(v, numbers):
            return None
        if isinstance(dtype, T.BooleanType):
            return bool(v) if v in (0, 1) else None
        if isinstance(dtype, T.IntegralType):
            return int(v) if abs(v) != float("inf") and v == int(v) and abs(v) < 1 << 63 else None
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            return float(v) if isinstance(v, (float, decimal.Decimal)) or float(v) == v else None
        if isinstance(dtype, T.DecimalType):
            exact = decimal.Decimal(repr(v)) if isinstance(v, float) else decimal.Decimal(v)
            if not exact.is_finite():
                return None
            with decimal.localcontext(prec=100):
                fixed = exact.quantize(decimal.Decimal(1).scaleb(-dtype.scale))
            return fixed if fixed == exact and len(fixed.as_tuple().digits) <= dtype.precision else None
        return None

    return list(dict.fromkeys(h for h in map(held, values) if h is not None))


def _member(rule: Rule, df: DataFrame, as_of: Column) -> Column:
    """One path for lists of any length; Spark turns them into a hash set."""
    dtype = type_of(df, rule.column)
    values = literals_for(dtype, rule.params["reference_values"])
    known = ref(rule.column).isin(values) if values else F.lit(False)
    return is_missing(ref(rule.column), dtype) | known


def _castable(rule: Rule, df: DataFrame, as_of: Column) -> Column:
    col, dtype = ref(rule.column), type_of(df, rule.column)
    return is_missing(col, dtype) | col.try_cast(rule.params["type"]).isNotNull()


def _holds(rule: Rule, df: DataFrame, as_of: Column) -> Column:
    condition = rule.params["condition"]
    return F.expr(condition) if isinstance(condition, str) else condition


def _refuse(rule: Rule, df: DataFrame, as_of: Column) -> Column:
    raise RuleError(rule.params["reason"])


@dataclass(frozen=True)
class Kind:
    """How one rule type is built from configuration and compiled."""

    build: Callable[..., Rule]
    params: tuple[str, ...] = ()
    predicate: Predicate | None = None
    defaults: Mapping[str, Any] = field(default_factory=dict)


_KINDS: dict[str, Kind] = {
    "null_check": Kind(null_check, (), _not_null),
    "unique_check": Kind(unique_check),
    "range_check": Kind(range_check, ("min_value", "max_value"), _in_range),
    "regex_check": Kind(regex_check, ("pattern",), _matches, {"pattern": ".*"}),
    "foreign_key_check": Kind(
        foreign_key_check, ("reference_values",), _member, {"reference_values": ()}
    ),
    "freshness_check": Kind(freshness_check, ("max_age_hours",), _fresh, {"max_age_hours": 24.0}),
    "format_check": Kind(format_check, ("format",), _matches),
    "cast_check": Kind(cast_check, ("type",), _castable),
    "enum_check": Kind(enum_check, ("values",), _member, {"values": ()}),
    "consistency_check": Kind(consistency_check, ("condition",), _holds),
    "accuracy_check": Kind(accuracy_check),
    "unbuilt": Kind(lambda *a, **k: None, (), _refuse),
}


def register_rule(
    type_name: str,
    predicate: Callable[[Rule, DataFrame], Column],
    dimension: str = "validity",
) -> Callable[..., Rule]:
    """Add a rule type. ``predicate(rule, df)`` returns the boolean pass column.

    Returns a builder ``(column, threshold, severity, name, **params)``; the
    type can also be used in YAML, where ``params`` reaches the predicate.
    """

    def build(column=None, threshold=1.0, severity="medium", name=None, **params) -> Rule:
        return _rule(
            type_name,
            column,
            dimension,
            severity,
            threshold,
            name or (None if column else type_name),
            f"{type_name} on '{column}'" if column else type_name,
            **params,
        )

    _KINDS[type_name] = Kind(build, ("*",), lambda rule, df, as_of: predicate(rule, df))
    return build


def row_predicate(rule: Rule, df: DataFrame, as_of: Column) -> Column:
    """Compile a row rule to a pass column that is never null."""
    return F.coalesce(_KINDS[rule.kind].predicate(rule, df, as_of), F.lit(False))


def is_key_rule(rule: Rule) -> bool:
    return rule.kind in ("unique_check", "accuracy_check") or "reference_df" in rule.params


# -- configuration -------------------------------------------------------------


def rule_from_dict(entry: Mapping[str, Any]) -> Rule | None:
    """Build one rule from configuration; an unknown type gives ``None``."""
    kind = _KINDS.get(entry.get("type"))
    if kind is None:
        return None
    given = dict(entry.get("params") or {})
    if kind.params != ("*",):
        given = {k: given.get(k, kind.defaults.get(k)) for k in kind.params}
    common = {
        "threshold": float(entry.get("threshold", 1.0)),
        "severity": entry.get("severity", "medium"),
        "name": entry.get("name"),
    }
    if entry["type"] == "consistency_check":
        return kind.build(**common, **given)
    if not entry.get("column") and kind.params != ("*",):
        raise RuleError("a column is needed")
    return kind.build(entry.get("column"), **common, **given)


def rules_from_dicts(entries: Iterable[Mapping[str, Any]]) -> list[Rule]:
    """Build rules from inline dictionaries, leaving out unknown types.

    An entry that cannot be built becomes a rule that is skipped with its
    reason; only a wrong severity is an error of the whole configuration.
    """
    import logging

    rules = []
    for entry in entries:
        if entry.get("severity", "medium") not in SEVERITIES:
            raise ValueError(f"unknown severity: {entry['severity']!r}")
        try:
            rule = rule_from_dict(entry)
        except Exception as err:
            rule = _unbuilt(entry, f"{type(err).__name__}: {err}")
        if rule is None:
            logging.getLogger(__name__).warning("unknown rule type %r skipped", entry.get("type"))
        else:
            rules.append(rule)
    return rules


def _unbuilt(entry: Mapping[str, Any], reason: str) -> Rule:
    name = entry.get("name") or f"{entry.get('type')}_{entry.get('column')}"
    return _rule("unbuilt", None, "validity", "medium", 1.0, name, reason, reason=reason)


def rules_from_yaml(text: str) -> list[Rule]:
    """Build rules from YAML text with a top-level ``rules`` list."""
    raw = yaml.safe_load(text)
    if not isinstance(raw, dict) or "rules" not in raw:
        raise ValueError("rule configuration needs a top-level 'rules' key")
    return rules_from_dicts(raw["rules"] or [])


def rules_from_yaml_file(path: str | Path) -> list[Rule]:
    return rules_from_yaml(Path(path).read_text())

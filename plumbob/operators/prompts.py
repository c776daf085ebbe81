"""Prompt texts built from profiles and rule results, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbob.operators.rules import DIMENSIONS, SEVERITIES
from plumbob.operators.semantic import DETECTORS


def _shown(c: Column | str, digits: int | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    text = F.format_string(f"%.{digits}f", col) if digits is not None else col.cast("string")
    return F.when(col.isNull(), "n/a").otherwise(text)


def _lines(*parts) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def classification_prompts(profiles: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """One prompt per column: ``(column_name, prompt)``.

    ``samples`` has ``name`` and ``samples`` (array of text); up to 20 are
    shown, or the top values when it is absent.
    """
    kinds = ", ".join([d.type for d in DETECTORS] + ["numeric_id", "categorical", "free_text"])
    if samples is not None:
        profiles = profiles.join(samples.select("name", "samples"), "name", "left")
        shown = F.slice(F.coalesce("samples", F.array().cast("array<string>")), 1, 20)
    else:
        shown = F.slice(F.transform("top_k", lambda t: t["value"]), 1, 20)
    prompt = _lines(
        "Which kind of data does this column hold?",
        "",
        F.concat(F.lit("column: "), "name"),
        F.concat(F.lit("type: "), "dtype"),
        F.concat(F.lit("nulls: "), _shown("null_count"), F.lit(" of "), _shown("total_count"), F.lit(" ("), _shown("null_pct"), F.lit("%)")),
        F.concat(F.lit("distinct: "), _shown("distinct_count"), F.lit(" ("), _shown("distinct_pct"), F.lit("%)")),
        F.concat(F.lit("length: "), _shown("min_length"), F.lit(" to "), _shown("max_length")),
        F.concat(F.lit("top values: "), F.to_json(F.slice("top_k", 1, 5))),
        F.concat(F.lit("samples: "), F.to_json(shown)),
        "",
        f"Answer in JSON with semantic_type ({kinds} or another), confidence (0 to 1), pii_detected,",
        "pii_category (none, low, medium, high, critical), pii_types, suggested_validation and rationale.",
    )
    return profiles.select(F.col("name").alias("column_name"), prompt.alias("prompt"))


def _column_summary() -> Column:
    top = F.transform(F.slice("top_k", 1, 3), lambda t: t["value"])
    shapes = F.transform(F.slice("patterns", 1, 3), lambda p: p["pattern"])
    return F.concat(
        F.lit("- "), "name", F.lit(": type="), "dtype",
        F.lit(", nulls="), _shown("null_count"), F.lit("/"), _shown("total_count"), F.lit(" ("), _shown("null_pct"), F.lit("%)"),
        F.lit(", distinct="), _shown("distinct_count"), F.lit(" ("), _shown("distinct_pct"), F.lit("%)"),
        F.lit(", unique="), _shown("is_unique"),
        F.when(F.col("mean").isNotNull(), F.concat(F.lit(", mean="), _shown("mean", 2), F.lit(", std="), _shown("std", 2))).otherwise(""),
        F.when(F.col("min_length").isNotNull(), F.concat(F.lit(", length="), _shown("min_length"), F.lit(".."), _shown("max_length"))).otherwise(""),
        F.when(F.size("top_k") > 0, F.concat(F.lit(", top="), F.to_json(top))).otherwise(""),
        F.when(F.size("patterns") > 0, F.concat(F.lit(", patterns="), F.to_json(shapes))).otherwise(""),
    )


def proposal_prompt(profiles: DataFrame, dataset: DataFrame, table: str = "unknown", context: str | None = None) -> DataFrame:
    """One prompt that asks for rules, with one summary line per column.

    ``dataset`` is the one-row dataset profile.
    """
    lines = profiles.agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", _column_summary().alias("line")))), lambda c: c["line"]),
            "\n",
        ).alias("columns")
    )
    facts = dataset.withColumn("columns", lines.scalar())
    prompt = _lines(
        "Propose data quality rules for this table.",
        "",
        F.concat(F.lit(f"table: {table}, rows: "), _shown("row_count"), F.lit(", columns: "), _shown("column_count"), F.lit(", duplicate rows: "), _shown("duplicate_row_count")),
        *([f"context: {context}"] if context else []),
        "",
        F.col("columns"),
        "",
        "rule types and their params: null_check, unique_check, range_check (min_value, max_value),",
        "regex_check (pattern), freshness_check (max_age_hours), foreign_key_check (reference_values)",
        "Answer in JSON: rules, a list of rule_type, column, params, "
        f"severity ({', '.join(SEVERITIES[:4])}), dimension ({', '.join(DIMENSIONS)}), rationale, confidence (0 to 1).",
    )
    return facts.select(F.lit(table).alias("table_name"), prompt.alias("prompt"))


def explanation_prompts(results: DataFrame, context: str | None = None, rows: int = 10) -> DataFrame:
    """One prompt per rule that missed its threshold: ``(rule_name, prompt)``."""
    prompt = _lines(
        "A data quality rule failed. Explain why.",
        "",
        F.concat(F.lit("rule: "), "rule_name", F.lit(" ("), "dimension", F.lit(", "), "severity", F.lit(")")),
        F.concat(F.lit("column: "), F.coalesce("column", F.lit("n/a"))),
        F.concat(F.lit("check: "), "details"),
        F.concat(
            F.lit("pass rate: "), _shown("pass_rate", 4), F.lit(", passed "), _shown("pass_count"), F.lit(", failed "),
            _shown("fail_count"), F.lit(" of "), _shown("total_count"), F.lit(", threshold "), _shown("threshold"),
        ),
        *([f"context: {context}"] if context else []),
        F.concat(F.lit("failing rows: ["), F.array_join(F.slice("failing_sample", 1, rows), ","), F.lit("]")),
        "",
        "Answer in JSON with summary, root_cause, impact, suggested_fix, severity_assessment and tags.",
    )
    return results.where(~F.col("passed")).select("rule_no", "rule_name", prompt.alias("prompt"))

"""Dimension scores, the overall score and the letter grade."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbob.functions.columns import local_table 

# Default dimension weights.
DEFAULT_WEIGHTS = {
    "completeness": 0.20,
    "uniqueness": 0.15,
    "validity": 0.15,
    "consistency": 0.10,
    "timeliness": 0.10,
    "accuracy": 0.10,
    "integrity": 0.10,
    "conformity": 0.10,
}

# Lowest score of each grade; below the last it is F.
GRADES = (("A", 0.95), ("B", 0.85), ("C", 0.70), ("D", 0.50))

# Severity weights of the severity-weighted option. The outer
# two levels have no documented weight; pass your own mapping to change them.
SEVERITY_WEIGHTS = {"critical": 3.0, "high": 3.0, "medium": 2.0, "low": 1.0, "info": 0.0}


def weights_from_yaml(text: str) -> dict[str, float]:
    """Weights under ``dimensions`` or ``weights``; a number or ``{weight: x}`` each."""
    raw = yaml.safe_load(text) or {}
    entries = raw.get("dimensions", raw.get("weights", {})) or {}
    return {
        name: float(entry.get("weight", 0.0) if isinstance(entry, Mapping) else entry)
        for name, entry in entries.items()
    }


def weights_from_yaml_file(path: str | Path) -> dict[str, float]:
    return weights_from_yaml(Path(path).read_text())


def weights_table(spark: SparkSession, weights: Mapping[str, float] | None = None) -> DataFrame:
    rows = [(name, float(w)) for name, w in (weights or DEFAULT_WEIGHTS).items()]
    return local_table(spark, rows, "dimension string, weight double")


def normalised(weights: DataFrame, *by: str) -> DataFrame:
    """Scale weights to a sum of one, unless they sum to zero or already do."""
    total = F.sum("weight").over(W.partitionBy(*by))
    off = (total > 0) & (F.abs(total - 1.0) > 1e-6)
    return weights.withColumn("weight", F.when(off, F.col("weight") / total).otherwise(F.col("weight")))


def grade(score: Column) -> Column:
    letters = F.lit("F")
    for letter, lowest in reversed(GRADES):
        letters = F.when(score >= lowest, letter).otherwise(letters)
    return letters


def _severity_weight(weights: Mapping[str, float]) -> Column:
    pairs = [F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
    return F.create_map(*pairs)[F.col("severity")]


def dimension_scores(
    results: DataFrame,
    weights: Mapping[str, float] | DataFrame | None = None,
    severity_weights: Mapping[str, float] | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """One row per weighted dimension (and per team, when ``by`` names one).

    The pass rate is the plain mean over the dimension's rules; with
    ``severity_weights`` it is the mean weighted by severity. A dimension
    without rules has a pass rate of 1.
    """
    if not isinstance(weights, DataFrame):
        weights = weights_table(results.sparkSession, weights)
    mean = F.avg("pass_rate")
    if severity_weights is not None:
        s = F.when(F.col("pass_rate").isNotNull(), _severity_weight(severity_weights))
        mean = F.when(F.sum(s) > 0, F.sum(F.col("pass_rate") * s) / F.sum(s)).otherwise(F.avg("pass_rate"))
    # Both sides hold a handful of rows: dimensions x teams, and rules.
    joined = normalised(weights, *by).join(
        results.select("rule_no", "rule_name", "dimension", "severity", "pass_rate", "passed"),
        "dimension",
        "left",
    )
    return (
        joined.groupBy(*by, "dimension", "weight")
        .agg(
            F.count("rule_no").alias("rule_count"),
            F.count_if(F.col("passed")).alias("pass_count"),
            F.count_if(~F.col("passed")).alias("fail_count"),
            F.coalesce(mean, F.lit(1.0)).alias("rate"),
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("rule_no").isNotNull(), F.struct("rule_no", "rule_name")))),
                lambda r: r["rule_name"],
            ).alias("rules"),
        )
        .select(
            *by,
            "dimension",
            "weight",
            "rule_count",
            "pass_count",
            "fail_count",
            F.round("rate", 6).alias("pass_rate"),
            F.round(F.col("weight") * F.col("rate"), 6).alias("weighted_score"),
            "rules",
            "rate",
        )
    )


def dataset_score(
    results: DataFrame,
    weights: Mapping[str, float] | DataFrame | None = None,
    severity_weights: Mapping[str, float] | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """One row (per team): overall score, grade, rule totals and the dimensions.

    Rules of dimensions without a weight count in the totals only.
    """
    dims = dimension_scores(results, weights, severity_weights, by)
    overall = dims.groupBy(*by).agg(
        F.round(
            F.when(F.sum("weight") > 0, F.sum(F.col("weight") * F.col("rate")) / F.sum("weight")).otherwise(1.0), 6
        ).alias("overall_score"),
        F.map_from_entries(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "dimension",
                        F.struct("weight", "pass_rate", "weighted_score", "rule_count", "rules").alias("score"),
                    )
                )
            )
        ).alias("dimensions"),
    )
    totals = results.agg(
        F.struct(
            F.count(F.lit(1)).alias("total_rules"),
            F.count_if(F.col("passed")).alias("total_passed"),
            F.count_if(~F.col("passed")).alias("total_failed"),
        )
    )
    return overall.withColumn("totals", totals.scalar()).select(
        *by, "overall_score", grade(F.col("overall_score")).alias("grade"), "totals.*", "dimensions"
    )


def score_view(scores: DataFrame) -> DataFrame:
    """The score as one JSON document per row."""
    return scores.select(
        F.to_json(F.struct("overall_score", "grade", "total_rules", "total_passed", "total_failed", "dimensions")).alias(
            "score"
        )
    )


def run_view(scores: DataFrame) -> DataFrame:
    """The run summary: weight, pass rate and weighted score of each dimension only."""
    slim = F.transform_values(
        "dimensions",
        lambda _, d: F.struct(
            d["weight"].alias("weight"), d["pass_rate"].alias("pass_rate"), d["weighted_score"].alias("weighted_score")
        ),
    )
    return scores.withColumn("dimensions", slim)

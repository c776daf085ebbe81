"""Data quality on Spark: profile, check, score, monitor."""

from plumbob.operators.evaluate import Evaluation, RuleSet, by_dimension, evaluate, failing_rows, report
from plumbob.operators.profile import auto_rules, dataset_profile, profile
from plumbob.operators.rules import (
    Rule,
    accuracy_check,
    cast_check,
    consistency_check,
    enum_check,
    foreign_key_check,
    format_check,
    freshness_check,
    null_check,
    range_check,
    regex_check,
    register_rule,
    rules_from_dicts,
    rules_from_yaml,
    rules_from_yaml_file,
    unique_check,
)
from plumbob.operators.score import dataset_score, dimension_scores, weights_from_yaml
from plumbob.plans.quality_run import QualityRun, report_on, run_quality

__all__ = [
    "Evaluation",
    "QualityRun",
    "Rule",
    "RuleSet",
    "accuracy_check",
    "auto_rules",
    "by_dimension",
    "cast_check",
    "consistency_check",
    "dataset_profile",
    "dataset_score",
    "dimension_scores",
    "enum_check",
    "evaluate",
    "failing_rows",
    "foreign_key_check",
    "format_check",
    "freshness_check",
    "null_check",
    "profile",
    "range_check",
    "regex_check",
    "register_rule",
    "report",
    "report_on",
    "rules_from_dicts",
    "rules_from_yaml",
    "rules_from_yaml_file",
    "run_quality",
    "unique_check",
    "weights_from_yaml",
]

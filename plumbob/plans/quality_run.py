"""The whole run: rules, scores and the history entry."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from plumbob.operators.evaluate import evaluate
from plumbob.operators.profile import profile
from plumbob.operators.rules import Rule
from plumbob.operators.score import dataset_score, dimension_scores
from plumbob.sources.history import append_run, as_run


@dataclass(frozen=True)
class QualityRun:
    results: DataFrame
    skipped: DataFrame
    dimensions: DataFrame
    score: DataFrame
    run_id: str
    run_at: dt.datetime


def _once(results: DataFrame) -> DataFrame:
    """Evaluate now and keep the outcome: one row per rule, five samples each."""
    return results.sparkSession.createDataFrame(results.collect(), results.schema)


def run_quality(
    df: DataFrame,
    dataset: str,
    rules: Sequence[Rule],
    weights: Mapping[str, float] | None = None,
    as_of: dt.datetime | None = None,
    history_path: str | None = None,
    order_by=None,
    sample_size: int = 5,
    run_id: str | None = None,
) -> QualityRun:
    """Evaluate, score and, with a path, append to the history.

    The table is read for the rules once; the scores work on the outcome.
    """
    run_at = as_of or dt.datetime.now(dt.timezone.utc)
    run_id = run_id or uuid.uuid4().hex
    evaluation = evaluate(df, rules, run_at, order_by, sample_size)
    results = _once(evaluation.results)
    score = dataset_score(results, weights)
    if history_path is not None:
        append_run(as_run(score, dataset, run_id, run_at), history_path)
    return QualityRun(results, evaluation.skipped, dimension_scores(results, weights), score, run_id, run_at)


def report_on(df: DataFrame, dataset: str, weights=None, as_of=None, sample_rows: int | None = None) -> tuple[DataFrame, QualityRun]:
    """Profile a table, derive rules from the profile and run them.

    ``sample_rows`` limits the profile to the head of the table; the rules
    always see every row.
    """
    from plumbob.operators.profile import auto_rules

    profiles = profile(df if sample_rows is None else df.limit(sample_rows))
    return profiles, run_quality(df, dataset, auto_rules(df, profiles), weights, as_of)

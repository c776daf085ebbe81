"""The score history: an append-only table of runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbob.operators.evaluate import run_instant

HISTORY_COLUMNS = (
    "dataset",
    "run_id",
    "run_at",
    "overall_score",
    "grade",
    "total_rules",
    "total_passed",
    "total_failed",
    "dimensions",
)


class NoRuns(LookupError):
    pass


def as_run(score: DataFrame, dataset: str, run_id: str, run_at=None) -> DataFrame:
    """A score as one history row, stamped with the time of the run."""
    return score.select(
        F.lit(dataset).alias("dataset"),
        F.lit(run_id).alias("run_id"),
        run_instant(run_at).alias("run_at"),
        *HISTORY_COLUMNS[3:],
    )


def append_run(run: DataFrame, path: str) -> None:
    """Append runs that the history does not hold yet, so a run that is written again stays one run."""
    try:
        known = read_history(run.sparkSession, path).select("dataset", "run_id")
    except AnalysisException as err:
        if err.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        run = run.join(known, ["dataset", "run_id"], "left_anti").select(*run.columns)
    run.write.mode("append").partitionBy("dataset").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All runs. Dataset names are text, also those that look like numbers or dates."""
    found = spark.read.parquet(path)
    fields = [T.StructField("dataset", T.StringType()) if f.name == "dataset" else f for f in found.schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def score_history(history: DataFrame, dataset: str | None = None) -> DataFrame:
    """Runs in order; a dataset name prunes to its partition."""
    rows = history if dataset is None else history.where(F.col("dataset") == dataset)
    return rows.select("dataset", "run_id", "run_at", "overall_score", "grade", "total_rules").orderBy(
        "dataset", "run_at", "run_id"
    )


def latest_scores(history: DataFrame) -> DataFrame:
    """The last run of each dataset; of simultaneous runs the greater id."""
    fields = [c for c in history.columns if c != "dataset"]
    last = F.max_by(F.struct(*fields), F.struct("run_at", "run_id"))
    return history.groupBy("dataset").agg(last.alias("last")).select("dataset", "last.*")


def latest_score(history: DataFrame, dataset: str) -> DataFrame:
    """The last run of one dataset; raises when it never ran."""
    last = latest_scores(history.where(F.col("dataset") == dataset))
    if last.isEmpty():
        raise NoRuns(dataset)
    return last

"""Quality runs over a stream: every micro-batch is one run in the history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbob.operators.rules import Rule
from plumbob.plans.quality_run import run_quality
from plumbob.sources.history import read_history


def _written(spark: SparkSession, history_path: str, dataset: str, run_id: str) -> bool:
    try:
        history = read_history(spark, history_path)
    except AnalysisException as err:
        if err.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return not history.where((F.col("dataset") == dataset) & (F.col("run_id") == run_id)).isEmpty()


def quality_stream(
    stream: DataFrame,
    dataset: str,
    rules: Sequence[Rule],
    history_path: str,
    checkpoint: str,
    weights=None,
    **trigger,
) -> StreamingQuery:
    """Score each micro-batch with the batch engine and append it to the history.

    A run's id follows from the dataset and the batch, so a batch that is
    replayed after a failure is recognised and not written twice.
    """

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{dataset}-{batch_id}"
        if not batch.isEmpty() and not _written(batch.sparkSession, history_path, dataset, run_id):
            run_quality(batch, dataset, rules, weights, history_path=history_path, sample_size=0, run_id=run_id)

    writer = stream.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()

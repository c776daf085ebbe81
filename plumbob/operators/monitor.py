"""Score drift and service-level gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbob.operators.rules import DIMENSIONS
from plumbob.operators.score import GRADES


def long_scores(history: DataFrame) -> DataFrame:
    """History rows as one row per run and dimension, and ``overall``."""
    dims = F.transform(
        F.map_entries("dimensions"),
        lambda e: F.struct(e["key"].alias("dimension"), e["value"]["pass_rate"].alias("score")),
    )
    overall = F.array(F.struct(F.lit("overall").alias("dimension"), F.col("overall_score").alias("score")))
    return history.select("dataset", "run_id", "run_at", F.inline(F.concat(overall, dims)))


def detect_drift(scores: DataFrame, min_drop: float = 0.05, trend_length: int = 2) -> DataFrame:
    """Each run next to the one before it.

    ``dropped`` marks a fall of at least ``min_drop``; ``trend`` marks the last
    of ``trend_length`` consecutive falls of any size. Input is one row per
    (dataset, dimension, run_at); a window holds the runs of one of them.
    """
    runs = W.partitionBy("dataset", "dimension").orderBy("run_at")
    recent = runs.rowsBetween(-(trend_length - 1), 0)
    previous = F.lag("score").over(runs)
    stepped = scores.withColumn("previous", previous).withColumn("change", F.round(F.col("score") - previous, 6))
    falls = F.sum(F.when(F.col("change") < 0, 1).otherwise(0)).over(recent)
    return stepped.select(
        "dataset",
        "dimension",
        "run_at",
        "score",
        "previous",
        "change",
        (F.coalesce(F.col("change"), F.lit(0.0)) <= -min_drop).alias("dropped"),
        (falls == trend_length).alias("trend"),
    )


def _grade_rank(grade: Column) -> Column:
    rank = F.lit(len(GRADES))
    for i, (letter, _) in enumerate(GRADES):
        rank = F.when(grade == letter, i).otherwise(rank)
    return rank


def evaluate_sla(latest: DataFrame, policies: DataFrame) -> DataFrame:
    """Check the latest run of each dataset against policies.

    A policy row has ``policy, dataset, dimension, min_grade, min_score,
    action``. A null dataset means every dataset. ``dimension`` set: that
    dimension's pass rate must reach ``min_score``; ``'*'``: each dimension's
    must that it scores. Null: the overall grade and score are checked. One
    output row per policy, dataset and checked dimension; a named dimension that
    a dataset does not score is not met and has a null score.
    """
    scored = long_scores(latest).join(latest.select("dataset", "grade"), "dataset").select("dataset", "dimension", "grade", "score")
    silent = F.array_except(F.array(*map(F.lit, DIMENSIONS)), F.map_keys("dimensions"))
    unscored = latest.select("dataset", F.explode(silent).alias("dimension"), "grade", F.lit(None).cast("double").alias("score"))
    each = scored.withColumn("scored", F.lit(True)).union(unscored.withColumn("scored", F.lit(False)))
    target = (
        F.when(F.col("dimension").isNull(), F.array(F.lit("overall")))
        .when(F.col("dimension") == "*", F.array(*map(F.lit, DIMENSIONS)))
        .otherwise(F.array("dimension"))
    )
    starred = F.coalesce(F.col("dimension") == "*", F.lit(False))
    wanted = policies.withColumn("starred", starred).withColumn("dimension", F.explode(target))
    everywhere = each.join(wanted.where(F.col("dataset").isNull()).drop("dataset"), "dimension")
    named = each.join(wanted.where(F.col("dataset").isNotNull()), ["dataset", "dimension"])
    grade_ok = (
        (F.col("dimension") != "overall")
        | F.col("min_grade").isNull()
        | (_grade_rank(F.col("grade")) <= _grade_rank(F.col("min_grade")))
    )
    met = F.coalesce(F.col("scored") & grade_ok & (F.col("min_score").isNull() | (F.col("score") >= F.col("min_score"))), F.lit(False))
    return everywhere.unionByName(named).where("scored OR NOT starred").select(
        "policy",
        "dataset",
        "dimension",
        "grade",
        "score",
        met.alias("met"),
        F.when(met, F.lit("pass")).otherwise(F.col("action")).alias("action"),
    )

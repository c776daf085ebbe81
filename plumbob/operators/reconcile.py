"""Reconciliation of a file set with its manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_check(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(path, status, expected_bytes, size_bytes)``.

    Status is ``ok``, ``missing`` (listed, not there), ``unexpected`` (there, not
    listed) or ``size_mismatch``. A null size in the manifest is not compared.
    Both inputs have one row per path.
    """
    there = files.select("path", "size_bytes", F.lit(True).alias("there"))
    listed = manifest.select("path", F.col("size_bytes").alias("expected_bytes"), F.lit(True).alias("listed"))
    return there.join(listed, "path", "full_outer").select(
        "path",
        F.when(F.col("there").isNull(), "missing")
        .when(F.col("listed").isNull(), "unexpected")
        .when(F.col("expected_bytes") != F.col("size_bytes"), "size_mismatch")
        .otherwise("ok")
        .alias("status"),
        "expected_bytes",
        "size_bytes",
    )


def manifest_result(checked: DataFrame, name: str = "manifest_check") -> DataFrame:
    """The check as an integrity result: one row with counts and pass rate."""
    ok = F.count_if(F.col("status") == "ok")
    total = F.count(F.lit(1))
    return checked.agg(
        F.lit(name).alias("rule_name"),
        F.lit("integrity").alias("dimension"),
        ok.alias("pass_count"),
        (total - ok).alias("fail_count"),
        total.alias("total_count"),
        F.when(total > 0, F.round(ok / total, 6)).otherwise(1.0).alias("pass_rate"),
        F.count_if(F.col("status") == "missing").alias("missing"),
        F.count_if(F.col("status") == "unexpected").alias("unexpected"),
        F.count_if(F.col("status") == "size_mismatch").alias("size_mismatch"),
    )

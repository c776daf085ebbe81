"""Semantic types and personal data per column, and text redaction.

Deterministic: a column is what most of its values look like, helped by its
name. Regular expressions run once per distinct value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbob.functions.columns import strip, text_of, ref, type_of, word_count
from plumbob.operators.profile import value_frequencies
from plumbob.operators.redaction import redacted


@dataclass(frozen=True)
class Detector:
    """A value pattern; ``hints`` are name parts, ``needs_hint`` makes one mandatory."""

    type: str
    pattern: str
    hints: tuple[str, ...]
    pii: str = "none"
    needs_hint: bool = False


# Semantic types in order of preference, and their sensitivity.
# The patterns use ASCII classes only.
DETECTORS = (
    Detector("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", ("email", "mail"), "medium"),
    Detector("uuid", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", ("uuid", "guid")),
    Detector("url", r"https?://[^ ]+", ("url", "link", "href")),
    Detector("ip_address", r"([0-9]{1,3}\.){3}[0-9]{1,3}", ("ip",), "low"),
    Detector("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", ("ssn", "social"), "high"),
    Detector("credit_card", r"[0-9]{4}([ -]?[0-9]{4}){3}", ("card", "pan"), "high"),
    Detector("date_of_birth", r"[0-9]{4}-[0-9]{2}-[0-9]{2}( .*)?", ("birth", "dob"), "medium", True),
    Detector("postal_code", r"[A-Z0-9][A-Z0-9 -]{2,9}", ("zip", "postal", "postcode"), "low", True),
    Detector("country_code", r"[A-Z]{2,3}", ("country", "nation"), "low", True),
    Detector("latitude", r"-?[0-9]{1,2}(\.[0-9]+)?", ("latitude", "lat"), "low", True),
    Detector("longitude", r"-?[0-9]{1,3}(\.[0-9]+)?", ("longitude", "lon", "lng"), "low", True),
    Detector("currency", r"-?[$€£]?[0-9][0-9,]*\.[0-9]{1,2}", ("price", "amount", "balance", "bal", "cost"), "none", True),
    Detector("phone", r"\+?[0-9][0-9 ().-]{6,18}[0-9]", ("phone", "mobile", "tel"), "medium", True),
    Detector("full_name", r"[A-Z][a-z]+( [A-Z][a-z'.-]*)+", ("name",), "medium"),
)

LEAST_SHARE = 0.5
FALLBACK_CONFIDENCE = 0.6


def _hinted(name: Column, hints: Sequence[str]) -> Column:
    """A name part between underscores equals a hint."""
    parts = F.split(F.lower(name), "[^a-z]+")
    return F.arrays_overlap(parts, F.array(*map(F.lit, hints)))


def classify_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per text or number column: semantic type, confidence and sensitivity."""
    readable = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, (T.StringType, T.NumericType)) and (columns is None or f.name in columns)
    ]
    frequencies = value_frequencies(df, readable)
    value, n = strip(F.col("value")), F.col("n")
    rows = F.sum("n")
    shares = [
        (F.sum(F.when(value.rlike(rf"\A(?:{d.pattern})\z"), n).otherwise(0)) / rows).alias(f"share_{i}")
        for i, d in enumerate(DETECTORS)
    ]
    measured = frequencies.groupBy("position").agg(
        rows.alias("rows"),
        F.count(F.lit(1)).alias("distinct_count"),
        (F.sum(word_count(value) * n) / rows).alias("mean_words"),
        *shares,
    )
    kinds = F.create_map(
        *(
            x
            for i, f in enumerate(df.schema)
            if f.name in readable
            for x in (
                F.lit(i),
                F.struct(
                    F.lit(f.name).alias("name"),
                    F.lit(isinstance(f.dataType, T.StringType)).alias("is_text"),
                    F.lit(isinstance(f.dataType, T.IntegralType)).alias("is_whole"),
                ),
            )
        )
    )
    named = measured.withColumn("c", kinds[F.col("position")]).select(
        "position", "c.name", "c.is_text", "c.is_whole", "rows", "distinct_count", "mean_words", *(f"share_{i}" for i in range(len(DETECTORS)))
    )
    candidates = []
    for i, d in enumerate(DETECTORS):
        share = F.col(f"share_{i}")
        hint = _hinted(F.col("name"), d.hints)
        allowed = (share >= LEAST_SHARE) & (hint if d.needs_hint else F.col("is_text") | hint)
        confidence = F.round(share * 0.9 + F.when(hint, 0.1).otherwise(0.0), 4)
        candidates.append(F.when(allowed, _candidate(confidence, -i, d.type, d.pii, d.pattern)))
    few = (F.col("distinct_count") <= 50) & (F.col("distinct_count") * 2 <= F.col("rows"))
    one_each = F.col("is_whole") & (F.col("distinct_count") == F.col("rows"))
    last = len(DETECTORS)
    fallback = F.lit(FALLBACK_CONFIDENCE)
    candidates += [
        F.when(one_each | (F.col("is_whole") & _hinted(F.col("name"), ("id", "key", "custkey", "number"))), _candidate(fallback - 0.1, -last, "numeric_id")),
        F.when(few, _candidate(fallback - 0.2, -last - 1, "categorical")),
        F.when(F.col("is_text") & (F.col("mean_words") >= 5), _candidate(fallback - 0.3, -last - 2, "free_text")),
        _candidate(F.lit(0.0), -last - 3, "unknown"),
    ]
    best = F.array_max(F.array_compact(F.array(*candidates)))
    return named.withColumn("best", best).select(
        F.col("name").alias("column_name"),
        F.col("best.type").alias("semantic_type"),
        F.round("best.confidence", 4).alias("confidence"),
        (F.col("best.pii") != "none").alias("pii_detected"),
        F.col("best.pii").alias("pii_category"),
        F.when(F.col("best.pii") != "none", F.array("best.type")).otherwise(F.array().cast("array<string>")).alias("pii_types"),
        F.col("best.pattern").alias("suggested_validation"),
        F.concat(F.lit("rows "), "rows", F.lit(", distinct "), "distinct_count").alias("rationale"),
        "position",
    )


def _candidate(confidence: Column, rank: int, kind: str, pii: str = "none", pattern: str | None = None) -> Column:
    """Structs compare field by field: confidence first, then preference."""
    return F.struct(
        confidence.cast("double").alias("confidence"),
        F.lit(rank).alias("rank"),
        F.lit(kind).alias("type"),
        F.lit(pii).alias("pii"),
        F.lit(pattern).cast("string").alias("pattern"),
    )


def redact(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace personal data in the named text columns, see :mod:`plumbob.operators.redaction`."""
    return df.withColumns({c: redacted(text_of(ref(c), type_of(df, c))) for c in columns})

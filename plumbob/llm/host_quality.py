"""Quality rules on documents, and on the hosts they come from.

A document is judged by rules on its words and lines. The failures of each rule
are then counted per host, the rates are shrunk towards those of all hosts by a
beta prior fitted to the hosts themselves, and a host whose shrunk rate of any
rule stays above a limit takes all its documents with it. Everything is a
DataFrame expression; a task holds one document at a time, only counts per host
and a few numbers per document are shuffled, and documents of a host that holds
much of the table meet its verdict in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbob.functions.columns import ref
from plumbob.llm.common import as_long, stored

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Each rule's failure, over the metrics.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}
#: Rules that reject a document by themselves.
BASE_RULES = ("few_words", "repeated_words")

#: A host is rejected if more than this part of its documents fails a rule, after shrinking.
MAX_HOST_RATE = 0.5
#: Limits of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 1e6)
#: Tasks over which the documents of one host are spread when they meet its verdict.
SALTS = 32
#: Rejected hosts are broadcast up to this many, and joined by shuffle beyond.
BROADCAST_HOSTS = 100_000


def _fresh(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def with_metrics(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` and a struct ``name`` of :data:`METRICS`, all long; a null text has no words and no lines.

    A word is a run of characters other than ASCII white space. ``n_repeat_words``
    counts the words that lie in a three-word window found again in the text;
    windows are compared by 64-bit hashes.
    """
    t, w, k = (_fresh(df, f"{name}_{x}") for x in ("text", "words", "windows"))
    df = df.withColumn(t, F.coalesce(text.cast("string"), F.lit("")))
    df = df.withColumn(w, F.regexp_extract_all(F.col(t), F.lit(WORD), F.lit(0)))

    def window(x: Column, i: Column) -> Column:
        return F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))

    last = F.greatest(F.size(w) - 2, F.lit(0))
    df = df.withColumn(k, F.sort_array(F.transform(F.slice(w, F.lit(1), last), window)))

    def twice(x: Column, i: Column) -> Column:
        return (F.get(k, i - 1)["h"] == x["h"]) | (F.get(k, i + 1)["h"] == x["h"])

    repeated = F.filter(k, twice)
    places = F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    lines = F.filter(F.split(F.col(t), "\n", -1), lambda x: x.rlike(WORD))
    metrics = {
        "n_words": F.size(w),
        "word_chars": F.length(F.regexp_replace(F.col(t), BLANK, "")),
        "n_symbols": F.regexp_count(F.col(t), F.lit(SYMBOL)),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.size(F.array_distinct(places)),
        "n_lines": F.size(lines),
    }
    return df.withColumn(name, F.struct(*(metrics[m].cast("bigint").alias(m) for m in METRICS))).drop(t, w, k)


def base_failed() -> Column:
    return F.expr(" OR ".join(f"({RULES[r]})" for r in BASE_RULES))


def host_rates(documents: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``(host, rule, n_docs, n_failed, rate, rejected)`` from rows of ``host`` and :data:`METRICS`.

    The prior of a rule is a beta distribution with the mean and the variance of
    the hosts' rates, less the variance that their sizes explain; ``rate`` is the
    mean of the host's posterior. Documents without a host count for none.
    """
    counts = documents.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), *(F.count_if(F.expr(f)).alias(r) for r, f in RULES.items())
    )
    rows = counts.unpivot(["host", "n_docs"], list(RULES), "rule", "n_failed")
    p, n = F.col("n_failed") / F.col("n_docs"), F.col("n_docs")
    sums = rows.groupBy("rule").agg(
        (F.sum("n_failed") / F.sum(n)).alias("mean"),
        (F.sum(n * p * p) / F.sum(n)).alias("square"),
        (F.count(F.lit(1)) / F.sum(n)).alias("noise"),
    )
    spread = F.col("mean") * (1 - F.col("mean"))
    between = F.col("square") - F.col("mean") * F.col("mean") - spread * F.col("noise")
    low, high = PRIOR_WEIGHT
    weight = F.when(between > spread / high, F.greatest(spread / between - 1, F.lit(low))).otherwise(F.lit(high))
    prior = sums.select("rule", "mean", weight.alias("weight"))
    rate = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    # One row per rule.
    return rows.join(F.broadcast(prior), "rule").select(
        "host", "rule", "n_docs", "n_failed", rate.alias("rate"), (rate > max_rate).alias("rejected")
    )


def judge_documents(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", max_rate: float = MAX_HOST_RATE
) -> DataFrame:
    """One row per document: ``doc_id``, the metrics, ``base_failed``, ``host_failed`` and ``kept``.

    Each row is judged for itself, so repeated rows and null ids stay. A null or
    empty text fails. A null host is never rejected. Columns other than the
    three named ones are ignored.
    """
    rows = df.select(as_long(id_column).alias("doc_id"), ref(host_column).cast("string").alias("host"), ref(text_column).alias("text"))
    rows = with_metrics(rows, F.col("text"), "m").select("doc_id", "host", "m.*")
    rows = stored(rows.withColumn("base_failed", base_failed()), "quality")
    bad = host_rates(rows, max_rate).where("rejected").select("host").distinct()
    salted = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("host_failed", F.lit(True))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    joined = rows.join(salted, ["host", "salt"], "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    return joined.select(
        "doc_id", *METRICS[:-1], "base_failed", "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept")
    )


def kept_documents(
    df: DataFrame, text_column: str = "text", host_column: str = "source", max_rate: float = MAX_HOST_RATE
) -> DataFrame:
    """The rows of ``df`` that :func:`judge_documents` keeps, with all their columns.

    The rows are measured once and written with their metrics to the shared
    folder; hosts are judged from these, and the rows read again less the rejected.
    """
    m, h = _fresh(df, "quality_metrics"), _fresh(df, "quality_host")
    rows = stored(with_metrics(df, ref(text_column), m), "quality-documents", whole_texts=True)
    measured = rows.select(ref(host_column).cast("string").alias("host"), f"{m}.*")
    bad = stored(host_rates(measured, max_rate).where("rejected").select(F.col("host").alias(h)).distinct(), "hosts")
    rows = rows.where(~base_failed_of(m))
    n = bad.count()
    if n == 0:
        return rows.select(*map(ref, df.columns))
    if n <= BROADCAST_HOSTS:
        return rows.join(F.broadcast(bad), ref(host_column).cast("string") == F.col(h), "left_anti").select(*map(ref, df.columns))
    s = _fresh(df, "quality_salt")
    salted = bad.withColumn(s, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn(s, F.pmod(F.xxhash64(ref(text_column)), F.lit(SALTS)).cast("int"))
    matched = (ref(host_column).cast("string") == salted[h]) & (rows[s] == salted[s])
    return rows.join(salted, matched, "left_anti").select(*map(ref, df.columns))


def base_failed_of(struct: str) -> Column:
    """:func:`base_failed` over a struct of metrics."""
    import re

    condition = " OR ".join(f"({RULES[r]})" for r in BASE_RULES)
    return F.expr(re.sub("|".join(METRICS), lambda x: f"`{struct}`.{x[0]}", condition))


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), win AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM w, unnest(range(1, len(w) - 1)) AS u(i)
), again AS (
  SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, t) > 1
), covered AS (
  SELECT k, count(DISTINCT i + d) AS n FROM again, (VALUES (0), (1), (2)) AS v(d) GROUP BY k
), lines AS (
  SELECT k, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS dup
  FROM (SELECT k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w)
), m AS (
  SELECT w.k, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(dup AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, n_lines
  FROM w JOIN lines USING (k) LEFT JOIN covered USING (k)
), flags AS (
  SELECT source AS host, rule, CAST(failed AS INT) AS failed FROM (
    SELECT source, unnest(['a', 'b', 'c', 'd', 'e']) AS rule, unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words,
      10 * n_symbols > n_words, 100 * n_dup_lines > 30 * n_lines, word_chars < 3 * n_words OR word_chars > 10 * n_words]) AS failed
    FROM m WHERE source IS NOT NULL)
), rates AS (
  SELECT host, rule, count(*) AS n, sum(failed) AS f FROM flags GROUP BY host, rule
), sums AS (
  SELECT rule, sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) AS square, count(*) / sum(n) AS noise FROM rates GROUP BY rule
), prior AS (
  SELECT rule, mean, CASE WHEN b > s / 1e6 THEN greatest(s / b - 1, 1) ELSE 1e6 END AS weight
  FROM (SELECT rule, mean, mean * (1 - mean) AS s, square - mean * mean - mean * (1 - mean) * noise AS b FROM sums)
), bad AS (
  SELECT DISTINCT host FROM rates JOIN prior USING (rule) WHERE (f + mean * weight) / (n + weight) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed,
  NOT base_failed AND NOT host_failed AS kept
FROM (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, source IS NOT NULL AND source IN (SELECT host FROM bad) AS host_failed
  FROM m)
"""

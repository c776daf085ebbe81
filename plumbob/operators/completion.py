"""Batches of completions: cache, parsing, typed answers and usage.

The completion function is the caller's. It receives a list of prompts and
returns one ``(content, prompt_tokens, completion_tokens, cost)`` per prompt.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbob.operators.evaluate import run_instant

Complete = Callable[[Sequence[str]], Sequence[tuple[str, int, int, float]]]

CACHE_DAYS = 30
# Beside the cache: requests and answers of runs, until they are in the table.
STAGED = "-runs"
# Tasks over which the rows of one prompt are spread.
SALTS = 16
COMPLETION = (
    "cache_key string, model string, content string, prompt_tokens bigint, completion_tokens bigint, "
    "cost double, latency_ms double, completed_at timestamp"
)


def cache_key(model: Column, prompt: Column, schema: Column | None = None, attachments: Column | None = None) -> Column:
    """Digest of everything that decides an answer, each part apart from the others."""
    none = F.lit(None).cast("string")
    parts = {"model": model, "prompt": prompt, "schema": none if schema is None else schema, "attachments": none if attachments is None else attachments}
    return F.sha2(F.to_json(F.struct(*(c.alias(n) for n, c in parts.items())), {"ignoreNullFields": "false"}), 256)


def missing_prompts(requests: DataFrame, cache: DataFrame | None, as_of=None, ttl_days: float = CACHE_DAYS) -> DataFrame:
    """Each distinct request that no valid cache entry answers, once."""
    wanted = requests.dropDuplicates(["cache_key"])
    if cache is None:
        return wanted
    # Keys hardly compress and grow with the cache, so they are sorted, never broadcast.
    return wanted.join(valid_entries(cache, as_of, ttl_days).select("cache_key").hint("merge"), "cache_key", "left_anti")


def valid_entries(cache: DataFrame, as_of=None, ttl_days: float = CACHE_DAYS) -> DataFrame:
    """The youngest entry per key that is not too old."""
    oldest = run_instant(as_of) - F.make_dt_interval(secs=F.lit(float(ttl_days) * 86400))
    fields = [c for c in cache.columns if c != "cache_key"]
    # Answers to one prompt are few; the aggregate keeps one per key and task.
    return (
        cache.where(F.col("completed_at") >= oldest)
        .groupBy("cache_key")
        .agg(F.max_by(F.struct(*fields), "completed_at").alias("e"))
        .select("cache_key", "e.*")
    )


def call(requests: DataFrame, complete: Complete, run_at: dt.datetime | None = None, batch: int = 64, staged: str | None = None) -> DataFrame:
    """Run the completion function over the requests, batch by batch in the tasks.

    With ``staged``, a folder that all executors share, the answers of a batch
    are put there as soon as they are in, under a name that its keys decide. A
    task that is run again, whatever ended it, takes them from there, so a batch
    is sent again only if it was lost before it was put there. The requests of
    a task must then be the same each time, as those of a stored table are.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                name = f"{staged}/{_batch_name(part['cache_key'])}.parquet" if staged else None
                out = _put_before(name) if name else None
                if out is None:
                    out = _answered(part, complete, run_at)
                    if name:
                        _put(out, name)
                yield out

    return requests.select("cache_key", "model", "prompt").mapInPandas(run, COMPLETION)


def _answered(part: pd.DataFrame, complete: Complete, run_at: dt.datetime | None) -> pd.DataFrame:
    import time

    started = time.perf_counter()
    answers = complete(part["prompt"].tolist())
    spent = (time.perf_counter() - started) * 1000 / max(len(part), 1)
    out = pd.DataFrame(answers, columns=["content", "prompt_tokens", "completion_tokens", "cost"])
    out.insert(0, "cache_key", part["cache_key"].to_numpy())
    out.insert(1, "model", part["model"].to_numpy())
    out["latency_ms"] = round(spent, 2)
    out["completed_at"] = pd.Timestamp(run_at or dt.datetime.now(dt.timezone.utc))
    return out


def _batch_name(keys: pd.Series) -> str:
    import hashlib

    return hashlib.sha256("\n".join(keys).encode()).hexdigest()


def _put_before(name: str) -> pd.DataFrame | None:
    """The answers that an earlier run of the task has put there."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    system, path = fs.FileSystem.from_uri(name)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    return pq.read_table(path, filesystem=system).to_pandas()


def _put(answers: pd.DataFrame, name: str) -> None:
    """Write under a name of one's own and rename, so that nobody reads half a file."""
    import uuid

    import pyarrow as pa
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    system, path = fs.FileSystem.from_uri(name)
    folder, _, last = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    mine = f"{folder}/_{uuid.uuid4().hex}"
    table = pa.Table.from_pandas(answers, preserve_index=False)
    for column, kind in (("latency_ms", pa.float64()), ("cost", pa.float64()), ("completed_at", pa.timestamp("us", "UTC"))):
        at = table.schema.get_field_index(column)
        table = table.set_column(at, column, table.column(column).cast(kind, safe=False))
    pq.write_table(table, mine, filesystem=system)
    system.move(mine, f"{folder}/{last}")


def complete_batch(
    prompts: DataFrame,
    complete: Complete,
    model: str,
    cache_path: str,
    schema: str | None = None,
    use_cache: bool = True,
    as_of: dt.datetime | None = None,
    ttl_days: float = CACHE_DAYS,
) -> DataFrame:
    """Answer every row of ``prompts`` (column ``prompt``).

    Only prompts without a valid entry in the cache table are sent, each once.
    The prompts to send are stored first and their answers are put beside the
    cache batch by batch (see :func:`call`), so neither a lost executor nor a run
    that ends half way repeats a paid call whose answer was in: the next run
    moves such answers to the table first. Answers are appended to the table
    before anything reads them. ``cached`` tells whether the answer was there
    before this run.
    """
    spark = prompts.sparkSession
    now = as_of or dt.datetime.now(dt.timezone.utc)
    if now.tzinfo is None:
        now = now.replace(tzinfo=dt.timezone.utc)
    keyed = prompts.withColumn("model", F.lit(model)).withColumn(
        "cache_key", cache_key(F.lit(model), F.col("prompt"), F.lit(schema) if schema else None)
    )
    _recover(spark, cache_path)
    before = _read_cache(spark, cache_path)
    run = f"{cache_path.rstrip('/')}{STAGED}/{uuid.uuid4().hex}"
    missing_prompts(keyed, before if use_cache else None, now, ttl_days).select("cache_key", "model", "prompt").write.parquet(f"{run}/requests")
    todo = spark.read.schema("cache_key string, model string, prompt string").parquet(f"{run}/requests")
    call(todo, complete, now, staged=f"{run}/answers").write.mode("append").parquet(cache_path)
    _finish(spark, run)
    stored = valid_entries(_read_cache(spark, cache_path), now, ttl_days)
    known = F.col("completed_at") < F.lit(now)
    # The rows of a frequent prompt meet its one answer in many tasks. Estimates
    # leave out the repeats, so without the hint all of them went through the driver.
    answers = stored.drop("model").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = keyed.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(answers.hint("merge"), ["cache_key", "__salt"]).drop("__salt").withColumn("cached", known)


def _finish(spark: SparkSession, run: str) -> None:
    """Mark a run whose answers are all in the table."""
    spark.range(1).write.mode("overwrite").parquet(f"{run}/done")


def _recover(spark: SparkSession, cache_path: str) -> None:
    """Move the answers of runs that ended half way to the table."""
    import pyarrow.fs as fs

    folder = cache_path.rstrip("/") + STAGED
    system, root = fs.FileSystem.from_uri(folder)
    if system.get_file_info(root).type == fs.FileType.NotFound:
        return
    runs = {i.base_name for i in system.get_file_info(fs.FileSelector(root))}
    there = lambda run, part: system.get_file_info(f"{root}/{run}/{part}").type != fs.FileType.NotFound
    for run in sorted(runs):
        if there(run, "answers") and not there(run, "done/_SUCCESS"):
            answers = spark.read.schema(COMPLETION).parquet(f"{folder}/{run}/answers")
            old = _read_cache(spark, cache_path)
            if old is not None:  # some may have been appended before the run ended
                answers = answers.join(old.select("cache_key", "completed_at").hint("merge"), ["cache_key", "completed_at"], "left_anti").select(*answers.columns)
            answers.write.mode("append").parquet(cache_path)
            _finish(spark, f"{folder}/{run}")


def _read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The cache table, or ``None`` before its first entry."""
    try:
        return spark.read.schema(COMPLETION).parquet(path)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


# -- answers -------------------------------------------------------------------

# Answers that count as empty.
_EMPTY = ("{}", "[]", '""', "0", "0.0", "false", "null")


def parsed(content: Column) -> Column:
    """The answer as JSON text.

    JSON is taken as it is, also inside a ``json`` code fence; anything else
    becomes ``{"text": content}``.
    """
    trim = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
    bare = trim(F.regexp_replace(F.regexp_replace(trim(content), r"\A```json", ""), r"```\z", ""))
    value = F.to_json(F.coalesce(F.try_parse_json(content), F.try_parse_json(bare)))
    text = F.to_json(F.struct(content.alias("text")))
    return F.when(value.isNull() | value.isin(*_EMPTY), text).otherwise(value)


# Texts that stand for a missing part of an explanation.
MISSING_PARTS = {
    "summary": "No summary available.",
    "root_cause": "Unknown.",
    "impact": "Unknown impact.",
    "suggested_fix": "Manual review recommended.",
    "severity_assessment": "",
}


def classifications(answers: DataFrame) -> DataFrame:
    """Typed column classifications from ``(column_name, parsed)``."""
    shape = (
        "semantic_type string, confidence double, pii_detected boolean, pii_category string, "
        "pii_types array<string>, suggested_validation string, rationale string"
    )
    a = answers.withColumn("a", F.from_json("parsed", shape))
    return a.select(
        "column_name",
        F.coalesce("a.semantic_type", F.lit("unknown")).alias("semantic_type"),
        F.coalesce("a.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("a.pii_detected", F.lit(False)).alias("pii_detected"),
        F.coalesce("a.pii_category", F.lit("none")).alias("pii_category"),
        F.coalesce("a.pii_types", F.array().cast("array<string>")).alias("pii_types"),
        F.col("a.suggested_validation").alias("suggested_validation"),
        F.coalesce("a.rationale", F.lit("")).alias("rationale"),
    )


def proposals(answers: DataFrame) -> DataFrame:
    """Typed rule proposals: one row per proposed rule of ``(table_name, parsed)``."""
    shape = (
        "rules array<struct<rule_type:string,column:string,params:string,severity:string,"
        "dimension:string,rationale:string,confidence:double>>"
    )
    rules = F.from_json("parsed", shape)["rules"]
    r = answers.select("table_name", F.posexplode(rules).alias("proposal_no", "r"))
    return r.select(
        "table_name",
        "proposal_no",
        F.coalesce("r.rule_type", F.lit("null_check")).alias("rule_type"),
        F.coalesce("r.column", F.lit("")).alias("column"),
        F.coalesce("r.params", F.lit("{}")).alias("params"),
        F.coalesce("r.severity", F.lit("medium")).alias("severity"),
        F.coalesce("r.dimension", F.lit("validity")).alias("dimension"),
        F.coalesce("r.rationale", F.lit("")).alias("rationale"),
        F.coalesce("r.confidence", F.lit(0.0)).alias("confidence"),
    )


def explanations(answers: DataFrame) -> DataFrame:
    """Typed failure explanations from ``(rule_name, fail_count, parsed)``."""
    shape = (
        "summary string, root_cause string, impact string, suggested_fix string, "
        "severity_assessment string, tags array<string>"
    )
    a = answers.withColumn("a", F.from_json("parsed", shape))
    return a.select(
        "rule_name",
        *(F.coalesce(f"a.{part}", F.lit(text)).alias(part) for part, text in MISSING_PARTS.items()),
        F.col("fail_count").alias("affected_rows_estimate"),
        F.coalesce("a.tags", F.array().cast("array<string>")).alias("tags"),
    )


def proposals_to_yaml(proposed: DataFrame) -> str:
    """Proposals as rule configuration. Collects one row per proposed rule."""
    import json

    rules = []
    for p in proposed.orderBy("table_name", "proposal_no").collect():
        entry = {"type": p["rule_type"], "column": p["column"], "severity": p["severity"]}
        params = json.loads(p["params"])
        if params:
            entry["params"] = params
        rules.append(entry)
    return yaml.safe_dump({"rules": rules}, default_flow_style=False, sort_keys=False)


def usage(completions: DataFrame) -> DataFrame:
    """Tokens, cost and calls per model; feed it the cache table, where hits add nothing."""
    return completions.groupBy("model").agg(
        F.count(F.lit(1)).alias("call_count"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        F.sum("cost").alias("estimated_cost_usd"),
    )

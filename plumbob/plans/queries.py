"""The query registry: every operator on the test tables.

``plumbob.plans.oracle`` holds the same questions in SQL.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbob.functions.columns import local_table
from plumbob.functions.patterns import EMAIL_RULE
from plumbob.operators import completion, dedup, documents, images, monitor, prompts, reconcile, semantic
from plumbob.operators import profile as profiling
from plumbob.operators import rules as r
from plumbob.operators import score as scoring
from plumbob.operators.evaluate import RuleSet, by_dimension, evaluate, failing_rows, report
from plumbob.plans.quality_run import run_quality
from plumbob.session import scratch_path
from plumbob.sources import files, history, tables

AS_OF = "2024-01-31T00:00:00"

RULES_YAML = r"""
rules:
  - {type: null_check, column: email, severity: high, threshold: 0.85}
  - {type: null_check, column: segment}
  - {type: null_check, column: bal_nan, severity: critical, threshold: 0.95}
  - {type: unique_check, column: dup_key, severity: critical}
  - {type: unique_check, column: c_custkey, severity: high, name: key_unique}
  - {type: range_check, column: age, params: {min_value: 0, max_value: 120}, threshold: 0.9}
  - {type: range_check, column: bal_text, severity: low, params: {min_value: 0}}
  - {type: regex_check, column: email, severity: high, threshold: 0.75, params: {pattern: '^[^@]+@[^@]+\.[^@]+$'}}
  - {type: foreign_key_check, column: segment, params: {reference_values: [AUTOMOBILE, BUILDING, MACHINERY, HOUSEHOLD]}}
  - {type: null_check, column: not_there}
  - {type: no_such_rule, column: email}
"""

TEAM_WEIGHTS = (
    ("finance", "accuracy", 0.3),
    ("finance", "consistency", 0.2),
    ("finance", "completeness", 0.5),
    ("marketing", "timeliness", 0.25),
    ("marketing", "completeness", 0.25),
    ("compliance", "conformity", 0.25),
    ("compliance", "validity", 0.2),
    ("operations", "uniqueness", 0.25),
    ("operations", "integrity", 0.2),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nulls, NaN, duplicates, bad text and broken references."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "CASE WHEN c_custkey % 50 = 1 THEN c_custkey - 1 ELSE c_custkey END AS dup_key",
        "CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'invalid' "
        "ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END AS email",
        "CASE WHEN c_custkey % 25 = 0 THEN -5 ELSE 18 + c_custkey % 62 END AS age",
        "CASE WHEN c_custkey % 13 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS STRING) END AS bal_text",
        "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS segment",
        "CASE WHEN c_custkey % 40 = 0 THEN 99 WHEN c_custkey % 41 = 0 THEN NULL ELSE c_nationkey END AS nation_fk",
        "CASE WHEN c_custkey % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE c_acctbal END AS bal_nan",
    )


COUNTS = ("rule_name", "dimension", "severity", "pass_count", "fail_count", "total_count", "pass_rate", "passed", "fail_rate")


def _counts(df: DataFrame, *rules: r.Rule, as_of=AS_OF) -> DataFrame:
    return evaluate(df, rules, as_of, sample_size=0).results.select(*COUNTS)


# -- scans ---------------------------------------------------------------------


def scan_filter(spark, sf):
    rows = tables.scan(table(spark, sf, "lineitem"), "l_quantity > 45 AND l_returnflag = 'R'")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


def scan_count(spark, sf):
    return tables.scan_count(table(spark, sf, "lineitem"), "l_discount >= 0.05 AND l_tax < 0.04")


def sample_rows(spark, sf):
    return tables.sample(table(spark, sf, "orders"), 1000, seed=7)


def sample_summary(spark, sf):
    """What an exact sample promises: its size, rows of the table only, and none twice."""
    orders = table(spark, sf, "orders")
    picked = tables.sample(orders, 500, seed=11)
    known = orders.select("o_orderkey", F.lit(True).alias("known"))
    return picked.join(known, "o_orderkey", "left").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("known").alias("n_known"), F.count_distinct("o_orderkey").alias("n_distinct")
    )


def preview_rows(spark, sf):
    rows = tables.head(table(spark, sf, "orders"), 100, order_by="o_orderkey")
    return rows.select("o_orderkey", "o_custkey", "o_totalprice")


def list_files(spark, sf):
    listed = files.list_datasets(spark, sf)
    return listed.select("name", "row_count", F.col("column_count").cast("bigint").alias("column_count"), F.array_join("columns", ",").alias("columns"))


def csv_source(spark, sf):
    path = scratch_path(spark, "customer") + ".csv"
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return files.load(spark, path).select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "c_acctbal", "c_mktsegment"
    )


def flatten_json(spark, sf):
    nested = table(spark, sf, "events").select(
        "event_id", F.struct(F.from_json("props", "k bigint").alias("props"), F.col("event_type").alias("type")).alias("e")
    )
    return files.flatten(nested).withColumnsRenamed({"e.props.k": "e_props_k", "e.type": "e_type"})


def dataset_registry(spark, sf):
    registry = tables.Registry(spark)
    for name in ("customer", "supplier", "orders"):
        registry.view(registry.register(name, path=f"{sf}/{name}.parquet"))
    return spark.sql(
        "SELECT 'customer' AS name, count(*) AS row_count FROM customer UNION ALL "
        "SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'orders', count(*) FROM orders"
    )


# -- profiles ------------------------------------------------------------------


def dataset_profile(spark, sf):
    return profiling.dataset_profile(dirty_customer(spark, sf)).select(
        "row_count",
        F.col("column_count").cast("bigint").alias("column_count"),
        "duplicate_row_count",
        "memory_bytes",
        F.round("null_cell_pct", 4).alias("null_cell_pct"),
    )


def duplicate_rows(spark, sf):
    """Every line item twice where its quantity is odd, compared over all columns."""
    rows = table(spark, sf, "lineitem")
    return profiling.duplicate_rows(rows.unionAll(rows.where("l_quantity % 2 = 1")))


def column_counts(spark, sf):
    return profiling.profile(dirty_customer(spark, sf), include=("distinct",)).select(
        "name", "total_count", "null_count", "null_pct", "distinct_count", "distinct_pct", "min_value", "max_value", "is_unique"
    )


def _rounded(df, names, digits=4):
    return [F.round(n, digits).alias(n) for n in names]


def numeric_stats(spark, sf):
    p = profiling.profile(table(spark, sf, "lineitem"), include=("quartiles",))
    return p.where(F.col("mean").isNotNull()).select("name", *_rounded(p, ("mean", "std", "median", "p25", "p75")))


def quartiles_with_missing(spark, sf):
    p = profiling.profile(dirty_customer(spark, sf), columns=["age", "nation_fk", "bal_nan"], include=("quartiles",))
    return p.select("name", *_rounded(p, ("median", "p25", "p75")))


#: Small tables made of large ones: name, table, what to group by, numbers.
SMALL_TABLES = (
    ("all", "orders", "1", "max(o_totalprice)"),
    ("status", "orders", "o_orderstatus", "sum(o_custkey)"),
    ("flags", "lineitem", "l_returnflag, l_linestatus", "max(l_extendedprice)"),
    ("priority", "orders", "o_orderpriority", "CASE WHEN min(o_orderkey) % 5 < 9 THEN count(*) END"),
    ("tens", "orders", "o_custkey % 10", "max(o_totalprice)"),
    ("tax", "lineitem", "l_tax", "sum(l_quantity)"),
    ("days", "orders", "CAST(o_orderdate AS DATE)", "min(o_totalprice)"),
    ("suppliers", "lineitem", "l_suppkey", "max(l_partkey)"),
    ("infinite", "lineitem", "l_quantity", "CASE WHEN l_quantity >= 49 THEN CAST('Infinity' AS DOUBLE) WHEN l_quantity < 3 THEN CAST('-Infinity' AS DOUBLE) ELSE max(l_tax) * l_quantity END"),
)


def quartiles_small(spark, sf):
    """Tables of one row to some thousands, by counted cells and by brackets."""
    found = []
    for name, source, by, value in SMALL_TABLES:
        rows = table(spark, sf, source).groupBy(*map(F.expr, by.split(", "))).agg(F.expr(value).alias("v")).select(F.col("v").cast("double").alias("v"))
        for way, include in (("counted", ("distinct", "quartiles")), ("brackets", ("quartiles",))):
            p = profiling.profile(rows, include=include)
            found.append(p.select(F.lit(name).alias("name"), F.lit(way).alias("way"), *_rounded(p, ("p25", "median", "p75"))))
    return reduce(DataFrame.unionByName, found)


def text_profile(spark, sf):
    """A profile of whole texts, which are counted by digest."""
    p = profiling.profile(table(spark, sf, "documents").select("text", "source", "lang"), top_k=3, pattern_k=3)
    ends = lambda name, key: F.transform(F.col(name), lambda v: F.concat_ws(":", F.sha2(v[key], 256), v["count"].cast("string")))
    return p.select(
        "name", "total_count", "null_count", "distinct_count", "max_length",
        F.sha2("min_value", 256).alias("least"), F.array_join(ends("top_k", "value"), " ").alias("top"),
        F.array_join(ends("patterns", "pattern"), " ").alias("patterns"),
    )


def string_lengths(spark, sf):
    p = profiling.column_statistics(table(spark, sf, "documents"), columns=["text", "lang", "source"])
    return p.select(
        "name",
        F.col("min_length").cast("bigint").alias("min_length"),
        F.col("max_length").cast("bigint").alias("max_length"),
        F.round("avg_length", 2).alias("avg_length"),
    )


def _named_top(df: DataFrame, k: int = 10) -> DataFrame:
    top = profiling.top_values(profiling.value_frequencies(df), k)
    name = F.element_at(F.array(*map(F.lit, df.columns)), F.col("position") + 1)
    return top.select(name.alias("name"), F.col("rank").cast("bigint").alias("rank"), "value", "n")


def top_values(spark, sf):
    part = table(spark, sf, "part").select("p_brand", "p_type", "p_size")
    events = table(spark, sf, "events").select("event_type", "user_id")
    return _named_top(part).unionByName(_named_top(events))


def value_patterns(spark, sf):
    def shapes(df):
        p = profiling.value_patterns(profiling.value_frequencies(df))
        return p.select(F.lit(df.columns[0]).alias("name"), F.col("rank").cast("bigint").alias("rank"), "pattern", "n", "pct")

    return shapes(table(spark, sf, "supplier").select("s_name")).unionByName(shapes(table(spark, sf, "pages").select("url")))


def profile_view(spark, sf):
    p = profiling.profile_view(profiling.profile(table(spark, sf, "supplier"), include=("distinct",)))
    return p.select("name", "null_count", "distinct_count", "is_unique", "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def full_profile(spark, sf):
    """Every statistic of every column of the largest table."""
    p = profiling.profile(table(spark, sf, "lineitem"))
    return p.select(
        "name", "total_count", "null_count", "distinct_count", "is_unique", *_rounded(p, ("mean", "std", "median", "p25", "p75")),
        F.element_at("top_k", 1)["value"].alias("top_value"),
        F.element_at("top_k", 1)["count"].alias("top_count"),
        F.size("top_k").cast("bigint").alias("top_values"),
        F.array_join(F.transform("patterns", lambda x: x["pattern"]), ",").alias("patterns"),
    )


def auto_rules(spark, sf):
    derived = profiling.derived_rules(profiling.profile(dirty_customer(spark, sf), include=("distinct",)))
    return derived.select("column", "type", "severity", "pattern", "min_value")


# -- rules ---------------------------------------------------------------------


def rule_null(spark, sf):
    return _counts(dirty_customer(spark, sf), *(r.null_check(c) for c in ("email", "segment", "bal_nan", "age")))


def rule_unique(spark, sf):
    return _counts(dirty_customer(spark, sf), *(r.unique_check(c) for c in ("dup_key", "email", "c_custkey")))


def rule_unique_multi(spark, sf):
    return _counts(table(spark, sf, "lineitem"), r.unique_check(["l_orderkey", "l_linenumber"], threshold=0.5))


def rule_range(spark, sf):
    return _counts(
        dirty_customer(spark, sf),
        r.range_check("age", 0, 120),
        r.range_check("bal_text", min_value=0),
        r.range_check("bal_nan", min_value=0, name="nan_guard"),
        r.range_check("age", max_value=70, name="age_max", threshold=0.5),
    )


def rule_regex(spark, sf):
    return _counts(
        dirty_customer(spark, sf),
        r.regex_check("email", EMAIL_RULE),
        r.regex_check("bal_text", r"(?P<whole>-?\d+)\.\d{1,2}", name="two_digits"),
        r.format_check("email", "e164"),
        r.regex_check("age", r"\d\d", name="digits_of_number"),
    )


def rule_fk_values(spark, sf):
    events = table(spark, sf, "events")
    return _counts(
        events,
        r.foreign_key_check("event_type", ["signup", "click", "view", "purchase"]),
        r.enum_check("event_type", ["click"]),
        r.foreign_key_check("event_type", [], name="nothing_allowed"),
        r.cast_check("props", "bigint"),
        r.cast_check("user_id", "tinyint"),
    )


def rule_fk_long_list(spark, sf):
    """A literal list too long for an IN predicate."""
    return _counts(table(spark, sf, "orders"), r.foreign_key_check("o_custkey", range(0, 3000, 2)))


def rule_fk_table(spark, sf):
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    return _counts(
        dirty_customer(spark, sf),
        r.foreign_key_check("nation_fk", reference_df=nation, reference_column="n_nationkey"),
    ).unionByName(
        _counts(
            table(spark, sf, "orders"),
            r.foreign_key_check("o_custkey", reference_df=customer.where("c_acctbal > 0"), reference_column="c_custkey"),
        )
    )


def rule_freshness(spark, sf):
    events = table(spark, sf, "events")
    return _counts(
        events,
        r.freshness_check("ts"),
        r.freshness_check("ts", max_age_hours=240, threshold=0.3, name="ten_days"),
    )


def rule_consistency(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return _counts(joined, r.consistency_check("l_shipdate >= o_orderdate", ["l_shipdate", "o_orderdate"]))


def rule_consistency_pairs(spark, sf):
    allowed = table(spark, sf, "customer").where("c_custkey % 3 = 0").select("c_nationkey", "c_mktsegment")
    rule = r.consistency_check(
        columns=["nation_fk", "segment"], reference_df=allowed, reference_columns=["c_nationkey", "c_mktsegment"]
    )
    return _counts(dirty_customer(spark, sf), rule)


def rule_accuracy(spark, sf):
    truth = table(spark, sf, "customer").where("c_custkey % 30 <> 7")
    return _counts(
        dirty_customer(spark, sf),
        r.accuracy_check("c_custkey", "segment", truth, truth_column="c_mktsegment"),
        r.accuracy_check("c_custkey", "bal_nan", truth, truth_column="c_acctbal", tolerance=0.005, name="balance"),
        r.accuracy_check("dup_key", "bal_nan", truth, truth_key="c_custkey", truth_column="c_acctbal", tolerance=100.0, name="wide"),
    )


def _evaluated(spark, sf, **options):
    rules = r.rules_from_yaml(RULES_YAML)
    nation = table(spark, sf, "nation")
    rules.append(r.foreign_key_check("nation_fk", reference_df=nation, reference_column="n_nationkey", name="nation"))
    return evaluate(dirty_customer(spark, sf), rules, AS_OF, **{"sample_size": 0, **options})


def rule_set(spark, sf):
    return _evaluated(spark, sf).results.select(*COUNTS)


def rule_skipped(spark, sf):
    e = _evaluated(spark, sf)
    ran = e.results.agg(F.count(F.lit(1)).alias("ran"))
    return e.skipped.select("rule_name", "reason").withColumn("ran", ran.scalar())


def rule_by_dimension(spark, sf):
    grouped = by_dimension(_evaluated(spark, sf).results)
    names = F.array_join(F.transform("results", lambda x: x["rule_name"]), ",")
    fails = F.aggregate("results", F.lit(0).cast("bigint"), lambda a, x: a + x["fail_count"])
    return grouped.select("dimension", "rule_count", names.alias("rule_names"), fails.alias("fail_count"))


def rule_report(spark, sf):
    return report(_evaluated(spark, sf).results).select(
        "section", "rule_name", "fail_count", F.round("fail_pct", 4).alias("fail_pct"), "passed"
    )


def failing_samples(spark, sf):
    nation = table(spark, sf, "nation")
    rules = [
        r.null_check("email"),
        r.unique_check("dup_key"),
        r.unique_check("email"),
        r.range_check("bal_text", min_value=0),
        r.foreign_key_check("nation_fk", reference_df=nation, reference_column="n_nationkey"),
    ]
    rows = failing_rows(dirty_customer(spark, sf), rules, order_by="c_custkey", size=5)
    return rows.select("rule_name", F.col("rank").cast("bigint").alias("rank"), "row.c_custkey", "row.email")


# -- scores --------------------------------------------------------------------


def dimension_scores(spark, sf):
    d = scoring.dimension_scores(_evaluated(spark, sf).results)
    return d.select(
        "dimension", "weight", "rule_count", "pass_count", "fail_count", "pass_rate", "weighted_score", F.array_join("rules", ",").alias("rules")
    )


def dataset_score(spark, sf):
    s = scoring.dataset_score(_evaluated(spark, sf).results)
    return s.select("overall_score", "grade", "total_rules", "total_passed", "total_failed")


def score_views(spark, sf):
    s = scoring.run_view(scoring.dataset_score(_evaluated(spark, sf).results, {"completeness": 3, "validity": 1}))
    return s.select("overall_score", "grade", F.explode("dimensions").alias("dimension", "d")).select(
        "overall_score", "grade", "dimension", "d.weight", "d.pass_rate", "d.weighted_score"
    )


def score_severity(spark, sf):
    d = scoring.dimension_scores(_evaluated(spark, sf).results, severity_weights=scoring.SEVERITY_WEIGHTS)
    return d.select("dimension", "pass_rate", "weighted_score")


def score_by_team(spark, sf):
    weights = local_table(spark, TEAM_WEIGHTS, "team string, dimension string, weight double")
    s = scoring.dataset_score(_evaluated(spark, sf).results, weights, by=("team",))
    return s.select("team", "overall_score", "grade", "total_rules")


def _event_history(spark, sf) -> DataFrame:
    """One run per event type and day: the shares of two conditions as scores."""
    days = table(spark, sf, "events").groupBy(
        F.col("event_type").alias("dataset"), F.col("ts").cast("date").alias("day")
    )
    rates = days.agg(
        F.count_if(F.col("value") > 20).cast("double").alias("a"),
        F.count_if(F.col("user_id") % 4 != 0).cast("double").alias("b"),
        F.count(F.lit(1)).alias("n"),
    ).select("dataset", "day", "n", F.round(F.col("a") / F.col("n"), 6).alias("validity"), F.round(F.col("b") / F.col("n"), 6).alias("accuracy"))
    overall = F.round((F.col("validity") * 2 + F.col("accuracy")) / 3, 6)
    entry = lambda c: F.struct(F.col(c).alias("pass_rate"))
    return rates.select(
        "dataset",
        F.col("day").cast("string").alias("run_id"),
        F.col("day").cast("timestamp_ntz").alias("run_at"),
        overall.alias("overall_score"),
        scoring.grade(overall).alias("grade"),
        F.lit(2).alias("total_rules"),
        F.lit(0).alias("total_passed"),
        F.lit(2).alias("total_failed"),
        F.create_map(F.lit("validity"), entry("validity"), F.lit("accuracy"), entry("accuracy")).alias("dimensions"),
    )


def score_latest(spark, sf):
    path = scratch_path(spark, "history")
    history.append_run(_event_history(spark, sf), path)
    last = history.latest_scores(history.read_history(spark, path))
    return last.select("dataset", "run_id", "overall_score", "grade")


def score_history(spark, sf):
    rows = history.score_history(_event_history(spark, sf), "click")
    return rows.select("dataset", "run_id", "overall_score", "grade")


def score_drift(spark, sf):
    drift = monitor.detect_drift(monitor.long_scores(_event_history(spark, sf)), min_drop=0.05, trend_length=2)
    return drift.select("dataset", "dimension", F.col("run_at").cast("date").cast("string").alias("day"), "score", "previous", "change", "dropped", "trend")


POLICIES = (
    ("grade_b", None, None, "B", None, "block"),
    ("any_dimension", None, "*", None, 0.78, "alert"),
    ("click_validity", "click", "validity", None, 0.5, "block"),
)


def sla_gate(spark, sf):
    policies = local_table(
        spark, POLICIES, "policy string, dataset string, dimension string, min_grade string, min_score double, action string"
    )
    return monitor.evaluate_sla(history.latest_scores(_event_history(spark, sf)), policies)


def manifest_check(spark, sf):
    pages = table(spark, sf, "pages")
    there = pages.where("page_id % 9 <> 4").select(F.col("url").alias("path"), F.length("html").cast("bigint").alias("size_bytes"), "page_id")
    listed = pages.where("page_id % 11 <> 3").selectExpr(
        "url AS path", "CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN length(html) + 1L ELSE length(html) END AS size_bytes", "page_id"
    )
    number = lambda df: df.select(F.concat("path", F.lit("#"), F.col("page_id").cast("string")).alias("path"), F.col("size_bytes").cast("bigint").alias("size_bytes"))
    return reconcile.manifest_check(number(there), number(listed))


def manifest_result(spark, sf):
    return reconcile.manifest_result(manifest_check(spark, sf))


# -- texts, documents ------------------------------------------------------------


def text_duplicates(spark, sf):
    return dedup.text_duplicates(table(spark, sf, "documents"), "doc_id", "text")


def _altered_hashes(spark, sf, kept: str = "-1L") -> DataFrame:
    """Sign bits of the embeddings, each with altered copies up to three bits away. ``kept`` are the bits that are not made zero."""
    signs = table(spark, sf, "embeddings").selectExpr(
        "vec_id",
        f"aggregate(transform(embedding, (x, i) -> IF(x > 0, shiftleft(1L, i), 0L)), 0L, (a, x) -> a | x) & {kept} AS h",
    )
    bit = lambda e: f"shiftleft(1L, CAST({e} AS INT))"
    return signs.selectExpr(
        "inline(array("
        "struct(vec_id * 10 AS id, h AS hash),"
        f"struct(vec_id * 10 + 1 AS id, h ^ {bit('vec_id % 64')} AS hash),"
        f"struct(vec_id * 10 + 2 AS id, h ^ {bit('vec_id % 31')} ^ {bit('32 + vec_id % 29')} AS hash),"
        "struct(vec_id * 10 + 3 AS id, h AS hash)))"
    )


def _near(copies: DataFrame, distance: int) -> DataFrame:
    found = dedup.near_duplicates(copies, "id", "hash", max_distance=distance)
    return found.select("id_a", "id_b", F.col("distance").cast("bigint").alias("distance"))


def near_duplicates(spark, sf):
    return _near(_altered_hashes(spark, sf), 3)


# A third of the hashes has nothing but zeros in its lower 32 bits.
THIRD_ALIKE = "IF(vec_id % 3 = 0, shiftleft(4294967295L, 32), -1L)"


def near_duplicates_crowded(spark, sf):
    """A third of the hashes share half of their bits."""
    return _near(_altered_hashes(spark, sf, THIRD_ALIKE), 3)


def near_duplicates_8(spark, sf):
    return _near(_altered_hashes(spark, sf, THIRD_ALIKE), 8)


def near_duplicates_12(spark, sf):
    return _near(_altered_hashes(spark, sf, THIRD_ALIKE), 12)


def _pages(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return lines.select(
        "doc_id",
        (F.col("i") + 1).alias("page_number"),
        "text",
        F.when(F.col("i") % 2 == 1, F.concat(F.lit("scan "), "text")).otherwise("").alias("ocr_text"),
    )


def document_profile(spark, sf):
    return documents.profile_documents(documents.classify_pages(_pages(spark, sf)))


def document_pages(spark, sf):
    p = documents.classify_pages(_pages(spark, sf), only_pages=[1, 2, 5000])
    return p.select("doc_id", F.col("page_number").cast("bigint").alias("page_number"), "page_type", "text", "is_ocr")


def table_cells(spark, sf):
    """Lines with bars are the rows of one table per document."""
    rows = F.transform(
        F.filter(F.split("text", "\n"), lambda l: l.contains(" | ")), lambda l: F.split(F.regexp_replace(l, "^[A-Z]", ""), r" \| ")
    )
    found = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page_number"), F.lit(0).alias("table_no"), rows.alias("rows"))
    cells = documents.table_cells(found)
    return cells.select("doc_id", F.col("row_no").cast("bigint").alias("row_no"), F.col("column_no").cast("bigint").alias("column_no"), "header", "value")


def semantic_types(spark, sf):
    kept = ("column_name", "semantic_type", "confidence", "pii_detected", "pii_category")
    a = semantic.classify_columns(dirty_customer(spark, sf)).select(*kept)
    b = semantic.classify_columns(table(spark, sf, "pages").select("page_id", "url")).select(*kept)
    return a.unionByName(b)


def redact_text(spark, sf):
    return semantic.redact(table(spark, sf, "documents").select("doc_id", "text"), ["text"]).select(
        "doc_id", F.sha2("text", 256).alias("redacted_hash"), F.length("text").cast("bigint").alias("redacted_chars")
    )


def redact_edge_cases(spark, sf):
    """Numbers that are no personal data, and personal data right beside others."""
    text = """CASE c_custkey % 9
        WHEN 0 THEN concat('on 20', lpad(c_custkey % 100, 2, '0'), '-01-02 10:30') WHEN 1 THEN concat('order ', lpad(c_custkey, 20, '7'))
        WHEN 2 THEN concat('12-34-56-78-', 10 + c_custkey % 90, ' items') WHEN 3 THEN concat('1.2.3.4.', c_custkey)
        WHEN 4 THEN concat('host ', 256 + c_custkey, '.1.1.1') WHEN 5 THEN concat('from 10.0.0.', c_custkey % 256, ', by u.', c_custkey, '@mail.example.org.')
        WHEN 6 THEN concat('call +1 (743) 555-', 1000 + c_custkey % 9000, ' 190.137.', c_custkey % 256, '.204 or 555-123-', 1000 + c_custkey % 9000)
        WHEN 7 THEN 'not 4111 1111 1111 1112 but 4111-1111-1111-1111 7536784127813050'
        ELSE concat(c_name, ' born 02.01.1990, 123-45-', 1000 + c_custkey % 9000) END"""
    rows = table(spark, sf, "customer").selectExpr("c_custkey", f"{text} AS redacted")
    return semantic.redact(rows, ["redacted"])


# -- completions -----------------------------------------------------------------


def explanation_prompts(spark, sf):
    results = _evaluated(spark, sf).results
    return prompts.explanation_prompts(results, context="customers").select("rule_name", "prompt")


def classification_prompts(spark, sf):
    return prompts.classification_prompts(profiling.profile(dirty_customer(spark, sf)))


def proposal_prompt(spark, sf):
    df = dirty_customer(spark, sf)
    return prompts.proposal_prompt(profiling.profile(df), profiling.dataset_profile(df), "customers", "billing")


def word_answers(texts):
    """A deterministic completion function: counts words."""
    return [(f'{{"words": {len(t.split())}}}', len(t), 12, len(t) * 0.001) for t in texts]


def _completed(spark, sf) -> tuple[DataFrame, str]:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    path = scratch_path(spark, "completions")
    first, second = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 15)
    completion.complete_batch(turns.where("conv_id % 3 = 0"), word_answers, "stub", path, as_of=first)
    return completion.complete_batch(turns, word_answers, "stub", path, as_of=second), path


def completion_cache(spark, sf):
    answers, _ = _completed(spark, sf)
    return answers.select("conv_id", "turn", "cache_key", "content", "cached")


def completion_usage(spark, sf):
    _, path = _completed(spark, sf)
    u = completion.usage(spark.read.parquet(path))
    return u.select("model", "call_count", "prompt_tokens", "completion_tokens", "total_tokens", F.round("estimated_cost_usd", 4).alias("estimated_cost_usd"))


def parse_response(spark, sf):
    raw = table(spark, sf, "conversations").selectExpr(
        "conv_id",
        "turn",
        "CASE (conv_id + turn) % 5 "
        "WHEN 0 THEN concat('{\"role\":\"', role, '\",\"n\":', CAST(length(text) AS STRING), '}') "
        "WHEN 1 THEN concat('```json\\n{\"role\":\"', role, '\"}\\n```') "
        "WHEN 2 THEN '{}' "
        "WHEN 3 THEN concat('answer ', role) "
        "ELSE '{\"role\": ' END AS content",
    )
    answer = raw.select("conv_id", "turn", "content", completion.parsed(F.col("content")).alias("p"))
    return answer.select(
        "conv_id",
        "turn",
        F.get_json_object("p", "$.role").alias("role"),
        F.get_json_object("p", "$.n").alias("n"),
        F.get_json_object("p", "$.text").alias("text"),
    )


def typed_answers(spark, sf):
    answers = table(spark, sf, "conversations").selectExpr(
        "concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS column_name",
        "CASE turn % 3 "
        "WHEN 0 THEN concat('{\"semantic_type\":\"', role, '\",\"confidence\":0.5,\"pii_detected\":true}') "
        "WHEN 1 THEN '{\"pii_category\":\"low\",\"pii_types\":[\"a\",\"b\"]}' "
        "ELSE '{\"text\":\"no json\"}' END AS parsed",
    )
    c = completion.classifications(answers)
    return c.withColumn("pii_types", F.array_join("pii_types", ","))


# -- images ----------------------------------------------------------------------


def embedding_images(spark, sf) -> DataFrame:
    """Every embedding drawn as an 8 x 8 gray image, and a slightly brighter copy.

    One original in seventeen is undecodable.
    """
    level = lambda x, more: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.6) * 212).cast("int") + more))
    drawn = lambda more: F.unhex(F.array_join(F.transform("embedding", lambda x, i: F.lpad(F.hex(level(x, more(i))), 2, "0")), ""))
    source = table(spark, sf, "embeddings").withColumn("broken", F.col("vec_id") % 17 == 0)
    originals = source.select("vec_id", "broken", F.when(F.col("broken"), F.unhex(F.lit(""))).otherwise(drawn(lambda i: F.lit(0))).alias("data"))
    copies = source.select(F.col("vec_id") + 1_000_000, F.lit(False), drawn(lambda i: i % 4))
    side = lambda n: F.when(F.col("broken"), -1).otherwise(n)
    return originals.union(copies).select(
        F.concat(F.lit("img-"), F.col("vec_id").cast("string")).alias("origin"),
        side(8).alias("height"),
        side(8).alias("width"),
        side(1).alias("nChannels"),
        "data",
    )


def image_profile(spark, sf):
    p = images.image_profile(images.measure_images(embedding_images(spark, sf)))
    return p.select(
        "path",
        F.col("width").cast("bigint").alias("width"),
        F.col("height").cast("bigint").alias("height"),
        F.col("channels").cast("bigint").alias("channels"),
        "is_corrupt",
        "blur_score",
        "is_blurry",
        "exposure_mean",
        "exposure_std",
        "is_overexposed",
        "is_underexposed",
        "color_mode",
        "aspect_ratio",
    )


def image_hash(spark, sf):
    p = images.measure_images(embedding_images(spark, sf))
    return p.where(F.col("width") > 0).select("path", "phash")


def image_near_duplicates(spark, sf):
    hashed = images.measure_images(embedding_images(spark, sf)).select(
        F.substring("path", 5, 20).cast("bigint").alias("id"), images.hash_bits(F.col("phash")).alias("hash")
    )
    found = dedup.near_duplicates(hashed, "id", "hash", max_distance=4, blocks=7)
    return found.select("id_a", "id_b", F.col("distance").cast("bigint").alias("distance"))


def _image_file(kind: int, width: int, height: int, levels: list[int]) -> bytes:
    """An uncompressed image file; kinds are the modes L, RGB, RGBA, P and 1 of PNG, then BMP."""
    import struct
    import zlib

    level = lambda x, y: levels[(y * width + x) % len(levels)]
    if kind == 5:
        rows = b"".join(b"".join(bytes([level(x, y)] * 3) for x in range(width)).ljust(-(-width * 3 // 4) * 4, b"\0") for y in range(height))
        return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(rows), 0, 0, 54, 40, width, height, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    pixel = (lambda v: [v], lambda v: [v, v // 2, 255 - v], lambda v: [v, v, v, 255], lambda v: [v % 4])[min(kind, 3)]
    row = lambda y: bytes(c for x in range(width) for c in pixel(level(x, y)))
    if kind == 4:
        row = lambda y: int("".join("01"[level(x, y) > 127] for x in range(width)).ljust(-(-width // 8) * 8, "0"), 2).to_bytes(-(-width // 8), "big")
    raw = b"".join(b"\0" + row(y) for y in range(height))
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    head = struct.pack(">IIBBBBB", width, height, 1 if kind == 4 else 8, (0, 2, 6, 3, 0)[kind], 0, 0, 0)
    colours = chunk(b"PLTE", bytes(12)) if kind == 3 else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + colours + chunk(b"IDAT", zlib.compress(raw, 0)) + chunk(b"IEND", b"")


def image_files(spark, sf):
    """Image files of several kinds drawn from the embeddings, and some that are none, profiled from disk."""
    path = scratch_path(spark, "images")

    def write(batches):
        import pyarrow.fs as fs

        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for i, values in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                levels = [max(0, min(255, int((v + 0.6) * 212))) for v in values]
                data = b"no image" if i % 17 == 0 else _image_file(i % 6, 1 + i % 9, 1 + i % 7, levels)
                with system.open_output_stream(f"{root}/img-{i}.bin") as file:
                    file.write(data)
            yield batch.select(["vec_id"])

    table(spark, sf, "embeddings").select("vec_id", "embedding").mapInArrow(write, "vec_id bigint").write.format("noop").mode("overwrite").save()
    found = images.profile_image_files(spark, path)
    return found.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "format", F.col("width").cast("bigint").alias("width"),
        F.col("height").cast("bigint").alias("height"), F.col("channels").cast("bigint").alias("channels"), "file_size_bytes", "is_corrupt",
        "color_mode", F.col("bit_depth").cast("bigint").alias("bit_depth"), "aspect_ratio",
    )


# -- inputs that once went wrong -------------------------------------------------


def rule_fk_mixed_types(spark, sf):
    """Literals of another numeric type than the column, in short and long lists: the same answer."""
    part = table(spark, sf, "part").selectExpr(
        "CAST(p_partkey AS DOUBLE) AS as_double", "CAST(p_partkey AS DECIMAL(12,2)) AS as_decimal", "p_partkey AS as_bigint"
    )
    rules = []
    for n in (10, 5000):
        rules += [
            r.foreign_key_check("as_double", list(range(0, n * 3, 3)), name=f"double_{n}"),
            r.enum_check("as_decimal", list(range(0, n * 3, 3)), name=f"decimal_{n}"),
            r.foreign_key_check("as_bigint", [i + (0.5 if i % 2 else 0.0) for i in range(0, n * 3, 3)], name=f"bigint_{n}"),
        ]
    return _counts(part, *rules)


#: The first integer that a double cannot hold follows this one.
WIDE = 9007199254740992


def rule_fk_decimal_key(spark, sf):
    """Integers against decimals that differ by one, beyond what doubles tell apart."""
    part = table(spark, sf, "part")
    keys = part.selectExpr(f"p_partkey + {WIDE}L AS wide_key", "p_size")
    known = part.where("p_partkey % 2 = 0").selectExpr(f"CAST(p_partkey + {WIDE}L AS DECIMAL(20,0)) AS wide_key", "CAST(p_size AS DECIMAL(20,2)) AS p_size")
    return _counts(
        keys,
        r.foreign_key_check("wide_key", reference_df=known, reference_column="wide_key"),
        r.accuracy_check("wide_key", "p_size", known),
    )


def failing_sample_json(spark, sf):
    """The failing rows of a result row, with their null cells."""
    rows = dirty_customer(spark, sf).select("c_custkey", "email", "segment")
    results = evaluate(rows, [r.null_check("email"), r.null_check("segment")], AS_OF, order_by="c_custkey").results
    return results.select("rule_name", F.posexplode("failing_sample").alias("place", "row")).select(
        "rule_name", F.col("place").cast("bigint").alias("place"), "row"
    )


def explanation_prompts_rows(spark, sf):
    """Explanation prompts that show up to ten failing rows."""
    rows = dirty_customer(spark, sf).select("c_custkey", "email", "segment")
    rules = [r.null_check("email"), r.null_check("segment"), r.null_check("c_custkey")]
    results = evaluate(rows, rules, AS_OF, order_by="c_custkey", sample_size=10).results
    return prompts.explanation_prompts(results).select("rule_name", "prompt")


def rule_isolation(spark, sf):
    """Rules that cannot run, or fail in some rows, beside good ones."""

    def broken(rule, df):
        raise KeyError("no such parameter")

    raising = r.register_rule("raising_check", broken)
    rules = [
        r.null_check("email"),
        r.consistency_check("cast(bal_text AS double) > 0", name="bad_cast"),
        r.consistency_check("100 / (c_custkey % 4) > 40", name="zero_division"),
        r.consistency_check("no_such_column > 0", name="unknown_column"),
        raising("email", name="raising"),
        *r.rules_from_dicts([{"type": "null_check", "name": "without_column"}]),
        r.unique_check("c_custkey"),
    ]
    found = evaluate(dirty_customer(spark, sf), rules, AS_OF, sample_size=0)
    ran = found.results.select("rule_name", F.lit("ran").alias("outcome"), "pass_count", "fail_count")
    return ran.union(found.skipped.select("rule_name", F.lit("skipped"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")))


BROKEN_YAML = r"""
rules:
  - {type: null_check, column: email, name: good}
  - {type: regex_check, column: email, name: bad_pattern, params: {pattern: '['}}
  - {type: accuracy_check, column: email, name: bad_type}
  - {type: range_check, column: age, name: bad_threshold, threshold: high}
  - {type: unique_check, column: c_custkey, name: good_too}
"""


def rule_yaml_bad_entries(spark, sf):
    """One bad entry of a configuration leaves the others."""
    found = evaluate(dirty_customer(spark, sf), r.rules_from_yaml(BROKEN_YAML), AS_OF, sample_size=0)
    ran = found.results.select("rule_name", F.lit("ran").alias("outcome"), "fail_count")
    return ran.union(found.skipped.select("rule_name", F.lit("skipped"), F.lit(None).cast("bigint")))


def _quoted(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey", "concat('a \"', c_mktsegment, '\", b') AS said", "CASE WHEN c_custkey % 3 = 0 THEN concat('one', chr(10), c_name) ELSE c_name END AS lines"
    )


def csv_quoted(spark, sf):
    """Quotes and line breaks within cells of several files, and the catalogue's counts of such files."""
    path = scratch_path(spark, "quoted")
    _quoted(spark, sf).repartition(3).write.options(header=True, escape='"').csv(path)
    rows = files.load(spark, path + "/*.csv").select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "said", "lines")
    counted = files.list_datasets(spark, path).agg(F.lit(-1).cast("bigint"), F.lit("row_count"), F.sum("row_count").cast("string"))
    return rows.union(counted)


def json_lines(spark, sf):
    path = scratch_path(spark, "lines")
    table(spark, sf, "customer").selectExpr("c_custkey AS k", "c_name AS name").write.json(path)
    return files.load(spark, path + "/*.json").select(F.col("k").cast("bigint").alias("k"), "name")


def json_array(spark, sf):
    """Files with an array each, of up to a thousand objects whose texts hold brackets and quotes."""
    path = scratch_path(spark, "arrays")
    item = "struct(c_custkey AS k, concat('}, {\"', c_name, '\\\\') AS name, array(struct(c_nationkey AS n)) AS more)"
    rows = table(spark, sf, "customer").selectExpr("c_custkey DIV 1000 AS block", f"{item} AS r")
    arrays = rows.groupBy("block").agg(F.to_json(F.sort_array(F.collect_list("r"))).alias("value"))
    arrays.repartition("block").write.partitionBy("block").text(path)
    found = files.read_json(spark, path + "/*/*.txt")
    return found.select(F.col("k").cast("bigint").alias("k"), "name", F.col("more")[0]["n"].cast("bigint").alias("n"))


def json_object(spark, sf):
    """One object, nested, of figures of all orders."""
    path = scratch_path(spark, "object")
    first = F.struct(F.min("o_orderkey").alias("k"), F.min("o_orderpriority").alias("name"))
    whole = table(spark, sf, "orders").agg(F.struct(first.alias("first"), F.count(F.lit(1)).alias("n")).alias("o"))
    whole.select(F.regexp_replace(F.to_json(F.struct("o")), ",", ",\n")).write.text(path)
    found = files.read_json(spark, path, flatten_object=True)
    return found.select(
        F.col("`o.first.k`").cast("bigint").alias("k"), F.col("`o.first.name`").alias("name"), F.col("`o.n`").cast("bigint").alias("n")
    )


def in_memory_rows(spark, sf):
    """Rows handed over as dictionaries, with missing and mixed cells: one per order priority."""
    priorities = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = [
        {"k": int(x.o_orderpriority[0]), "mixed": x.n if x.n % 2 else x.n / 2, "none": None, **({} if x.o_orderpriority.startswith("1") else {"name": x.o_orderpriority})}
        for x in priorities
    ]
    return tables.from_rows(spark, rows)


def history_names(spark, sf):
    """Dataset names that look like numbers stay apart."""
    path = scratch_path(spark, "names")
    counts = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    for name in ("007", "7", "2024-01-01"):
        rows = counts.selectExpr("concat('run', o_orderstatus) AS run_id", "n", f"'{name}' AS dataset")
        history.append_run(rows, path)
    return history.read_history(spark, path).select("dataset", "run_id", "n")


def sla_unscored(spark, sf):
    """A gate on a dimension without a score blocks."""
    scores = table(spark, sf, "orders").groupBy(F.concat(F.lit("r"), F.col("o_custkey") % 5).alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    runs = scores.selectExpr(
        "dataset", "'x' AS run_id", "timestamp'2024-01-01' AS run_at", "1.0D AS overall_score", "'A' AS grade",
        "map('validity', named_struct('pass_rate', 1.0D)) AS dimensions",
    )
    policies = local_table(
        spark,
        [("fresh", None, "timeliness", None, 0.5, "block"), ("valid", None, "validity", None, 0.5, "block"), ("each", "r1", "*", None, 0.5, "warn")],
        "policy string, dataset string, dimension string, min_grade string, min_score double, action string",
    )
    return monitor.evaluate_sla(runs, policies).select("policy", "dataset", "dimension", "met", "action")


# -- runs, rule sets and answers from end to end -------------------------------------

WEIGHTS_YAML = """
dimensions:
  completeness: {weight: 2}
  uniqueness: 1.5
  validity: {weight: 0.5}
  conformity: 0
"""


def quality_run(spark, sf):
    """A whole run with its rules, weights and history entry, as the history then holds it."""
    path = scratch_path(spark, "runs")
    nation = r.foreign_key_check("nation_fk", reference_df=table(spark, sf, "nation"), reference_column="n_nationkey", name="nation")
    for run_id, day in (("first", dt.datetime(2024, 1, 30)), ("second", dt.datetime.fromisoformat(AS_OF))):
        rules = r.rules_from_yaml(RULES_YAML) + ([nation] if run_id == "second" else [])
        run_quality(dirty_customer(spark, sf), "customers", rules, as_of=day, history_path=path, run_id=run_id)
    last = history.latest_score(history.read_history(spark, path), "customers")
    runs = history.read_history(spark, path).agg(F.count(F.lit(1)).alias("runs"))
    return last.select("dataset", "run_id", "overall_score", "grade", F.col("total_rules").cast("bigint").alias("total_rules"), F.col("total_passed").cast("bigint").alias("total_passed")).withColumn("runs", runs.scalar())


def weights_yaml(spark, sf):
    """Dimension scores under weights of a configuration, given as numbers and as entries."""
    weights = scoring.weights_from_yaml(WEIGHTS_YAML)
    d = scoring.dimension_scores(_evaluated(spark, sf).results, weights)
    return d.select("dimension", F.round("weight", 6).alias("weight"), F.round("pass_rate", 6).alias("pass_rate"), F.round("weighted_score", 6).alias("weighted_score"))


CUSTOM_YAML = """
rules:
  - {type: multiple_check, column: age, name: from_yaml, severity: low, threshold: 0.3, params: {of: 3}}
"""


def custom_rule(spark, sf):
    """A rule type of one's own, built by its builder and from a configuration."""
    multiple = r.register_rule("multiple_check", lambda rule, df: F.col(rule.column) % rule.params["of"] == 0, dimension="conformity")
    rules = [multiple("c_custkey", of=2, name="even"), *r.rules_from_yaml(CUSTOM_YAML), multiple("nation_fk", 0.5, "high", of=1)]
    return _counts(dirty_customer(spark, sf), *rules)


def rule_added(spark, sf):
    """A rule set that grows after it was read."""
    rules = RuleSet.from_dicts([{"type": "null_check", "column": "email", "severity": "high"}])
    rules.add(r.range_check("age", min_value=18, max_value=60))
    rules.add(r.unique_check("dup_key", severity="low"))
    found = rules.evaluate(dirty_customer(spark, sf), as_of=AS_OF, sample_size=0)
    return found.results.select(*COUNTS)


#: Columns of the suppliers, orders and others put in the formats that rules know by name.
FORMATTED = {
    "e164": "concat('+', 1 + c_custkey % 9, lpad(c_custkey, c_custkey % 16, '5'))",
    "iso_country2": "IF(c_custkey % 3 = 0, upper(left(c_mktsegment, 2)), left(c_name, 2))",
    "iso_country3": "left(c_mktsegment, CAST(2 + c_custkey % 2 AS INT))",
    "iso_language": "lower(left(c_mktsegment, CAST(1 + c_custkey % 3 AS INT)))",
    "iso_date": "concat('2024-', lpad(c_custkey % 14, 2, '0'), '-', lpad(c_custkey % 33, 2, '0'))",
    "iso_datetime": "concat('2024-01-02T', lpad(c_custkey % 30, 2, '0'), ':30', IF(c_custkey % 2 = 0, 'Z', '+1'))",
    "uuid": "concat(lpad(c_custkey, 8, 'a'), '-0000-0000-0000-', lpad(c_custkey, CAST(11 + c_custkey % 2 AS INT), 'F'))",
    "ipv4": "concat_ws('.', c_custkey % 300, c_custkey % 256, '0', '25')",
    "email": "concat(c_custkey, IF(c_custkey % 4 = 0, '', '@'), 'x.org')",
}


def rule_formats(spark, sf):
    """Every named format on a column of which a part has it."""
    rows = table(spark, sf, "customer").selectExpr(*(f"{sql} AS {name}" for name, sql in FORMATTED.items()))
    return _counts(rows, *(r.format_check(name, name, threshold=0.5) for name in FORMATTED))


def typed_proposals(spark, sf):
    """Answers that propose rules, with and without their parts."""
    answers = table(spark, sf, "conversations").selectExpr(
        "concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS table_name",
        """CASE turn % 3 WHEN 0 THEN concat('{"rules":[{"rule_type":"range_check","column":"', role, '","params":{"min_value":', turn, '},"confidence":0.5},{"column":"x"}]}')
        WHEN 1 THEN '{"rules":[{"rule_type":"null_check","severity":"high","dimension":"completeness","rationale":"why"}]}' ELSE '{"text":"none"}' END AS parsed""",
    )
    p = completion.proposals(answers)
    return p.withColumn("proposal_no", F.col("proposal_no").cast("bigint"))


def typed_explanations(spark, sf):
    """Answers that explain failures; missing parts have their texts."""
    answers = table(spark, sf, "conversations").selectExpr(
        "concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS rule_name", "length(text) AS fail_count",
        """CASE turn % 2 WHEN 0 THEN concat('{"summary":"by ', role, '","impact":"small","tags":["a","', role, '"]}') ELSE '{"root_cause":"load","severity_assessment":"low"}' END AS parsed""",
    )
    e = completion.explanations(answers)
    return e.withColumn("tags", F.array_join("tags", ",")).withColumn("affected_rows_estimate", F.col("affected_rows_estimate").cast("bigint"))


def proposals_yaml(spark, sf):
    """Rules that a profile suggests, as an answer, as proposals, as a configuration, and run from it."""
    derived = profiling.derived_rules(profiling.profile(dirty_customer(spark, sf), include=("distinct",)))
    params = F.when(F.col("type") == "range_check", F.struct(F.col("min_value"), F.lit(None).cast("string").alias("pattern"))).when(
        F.col("type") == "regex_check", F.struct(F.lit(None).cast("double").alias("min_value"), F.col("pattern"))
    )
    one = F.struct("position", "rule_no", F.col("type").alias("rule_type"), "column", "severity", params.alias("params"))
    answer = derived.agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("rules"))).alias("parsed")).withColumn("table_name", F.lit("customers"))
    text = completion.proposals_to_yaml(completion.proposals(answer))
    return _counts(dirty_customer(spark, sf), *r.rules_from_yaml(text))


def classification_prompts_samples(spark, sf):
    """Classification prompts that show given samples in place of the top values."""
    rows = dirty_customer(spark, sf)
    kept = rows.agg(F.min_by("segment", "c_custkey").alias("a"), F.max_by("email", F.when(F.col("email").isNotNull(), F.col("c_custkey"))).alias("b"))
    samples = kept.select(F.explode(F.array(F.struct(F.lit("segment").alias("name"), F.array("a").alias("samples")), F.struct(F.lit("email").alias("name"), F.array("b", "b").alias("samples")))).alias("s")).select("s.*")
    p = prompts.classification_prompts(profiling.profile(rows), samples)
    return p.select("column_name", F.regexp_extract("prompt", r"(?m)^(samples: .*)$", 1).alias("samples"))


def completion_expiry(spark, sf):
    """Answers older than the cache keeps them are asked for again."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    path = scratch_path(spark, "expiry")
    for part, day in (("conv_id % 3 = 0", dt.datetime(2024, 1, 1)), ("conv_id % 3 = 1", dt.datetime(2024, 1, 20))):
        completion.complete_batch(turns.where(part), word_answers, "stub", path, as_of=day)
    last = completion.complete_batch(turns, word_answers, "stub", path, as_of=dt.datetime(2024, 2, 10))
    return last.select("conv_id", "turn", "cached", F.date_format("completed_at", "yyyy-MM-dd").alias("answered"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_filter, scan_count, sample_rows, sample_summary, preview_rows, list_files, csv_source, flatten_json, dataset_registry,
        dataset_profile, duplicate_rows, column_counts, numeric_stats, quartiles_with_missing, quartiles_small, text_profile, string_lengths,
        top_values, value_patterns, profile_view, full_profile, auto_rules,
        rule_null, rule_unique, rule_unique_multi, rule_range, rule_regex, rule_fk_values, rule_fk_long_list,
        rule_fk_table, rule_freshness, rule_consistency, rule_consistency_pairs, rule_accuracy, rule_set,
        rule_skipped, rule_by_dimension, rule_report, failing_samples,
        dimension_scores, dataset_score, score_views, score_severity, score_by_team,
        score_latest, score_history, score_drift, sla_gate, manifest_check, manifest_result,
        text_duplicates, near_duplicates, near_duplicates_crowded, near_duplicates_8, near_duplicates_12, document_profile, document_pages, table_cells, semantic_types, redact_text, redact_edge_cases,
        explanation_prompts, classification_prompts, proposal_prompt, completion_cache, completion_usage,
        parse_response, typed_answers, image_profile, image_hash, image_near_duplicates, image_files,
        rule_fk_mixed_types, rule_fk_decimal_key, failing_sample_json, explanation_prompts_rows, rule_isolation, rule_yaml_bad_entries, csv_quoted,
        json_lines, json_array, json_object, in_memory_rows, history_names, sla_unscored,
        quality_run, weights_yaml, custom_rule, rule_added, rule_formats, typed_proposals, typed_explanations, proposals_yaml,
        classification_prompts_samples, completion_expiry,
    )
}

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from plumbob import (
    RuleSet,
    accuracy_check,
    cast_check,
    consistency_check,
    enum_check,
    evaluate,
    failing_rows,
    foreign_key_check,
    format_check,
    freshness_check,
    null_check,
    range_check,
    regex_check,
    register_rule,
    report,
    rules_from_dicts,
    rules_from_yaml,
    unique_check,
)
from plumbob.operators.evaluate import by_dimension

NOW = dt.datetime(2024, 6, 1, 12, 0, tzinfo=dt.timezone.utc)
EMAIL = r"^[^@]+@[^@]+\.[^@]+$"


@pytest.fixture(scope="module")
def customers(spark):
    ago = lambda **k: (NOW - dt.timedelta(**k)).replace(tzinfo=None)
    rows = [
        (1, "a@b.com", 25, "active", ago(hours=1)),
        (2, "invalid", 30, "active", ago(hours=2)),
        (3, "c@d.org", -5, "inactive", ago(days=5)),
        (4, None, 200, "active", ago(hours=6)),
        (5, "e@f.net", 40, "deleted", ago(days=60)),
    ]
    return spark.createDataFrame(rows, "id bigint, email string, age bigint, status string, updated_at timestamp_ntz")


def one(df, rule, **options):
    return evaluate(df, [rule], **{"as_of": NOW, "sample_size": 0, **options}).results.first()


def fails(df, rule, **options):
    return one(df, rule, **options).fail_count


def column(spark, values, dtype="bigint"):
    return spark.createDataFrame([(v,) for v in values], f"val {dtype}")


def test_null_check(customers):
    r = one(customers, null_check("email"))
    assert (r.pass_count, r.fail_count, r.total_count, r.pass_rate, r.passed) == (4, 1, 5, 0.8, False)
    assert (r.dimension, r.severity, r.rule_name) == ("completeness", "high", "null_check_email")
    assert r.fail_rate == pytest.approx(0.2)
    assert one(customers, null_check("id")).passed
    assert one(customers, null_check("email", threshold=0.8)).passed


def test_nan_is_missing(spark):
    df = column(spark, [1.0, float("nan"), None], "double")
    assert fails(df, null_check("val")) == 2
    assert fails(df, range_check("val", 0)) == 2
    assert fails(df, foreign_key_check("val", [1.0])) == 0


def test_unique_check(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,)], "col bigint")
    assert fails(df, unique_check("col")) == 2
    pairs = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "a bigint, b string")
    r = one(pairs, unique_check(["a", "b"]))
    assert (r.fail_count, r.column) == (0, "a+b")
    assert fails(column(spark, [None, None, 1]), unique_check("val")) == 2
    assert fails(column(spark, [0.0, -0.0, float("nan"), None], "double"), unique_check("val")) == 4
    long = "x" * 100
    assert fails(column(spark, [long, long, long + "y"], "string"), unique_check("val")) == 2
    nulls = spark.createDataFrame([(1, None), (1, None), (1, "null")], "a bigint, b string")
    assert fails(nulls, unique_check(["a", "b"])) == 2


def test_range_check(spark, customers):
    assert fails(customers, range_check("age", 0, 150)) == 2
    assert fails(column(spark, [-1, 0, 5]), range_check("val", min_value=0)) == 1
    assert fails(column(spark, [50, 100, 200]), range_check("val", max_value=150)) == 1
    assert fails(column(spark, ["1", " 2 ", "x", None, "1e2"], "string"), range_check("val", 0)) == 2
    assert fails(column(spark, [1, None]), range_check("val")) == 1


def test_regex_check(spark, customers):
    assert fails(customers, regex_check("email", EMAIL)) == 2
    text = column(spark, ["a", "a\n", "ab", None], "string")
    assert fails(text, regex_check("val", "^a$")) == 3
    assert fails(text, regex_check("val", "a|ab")) == 2
    assert fails(column(spark, [12, 7]), regex_check("val", r"\d\d")) == 1
    assert fails(column(spark, ["x]&&[", "x"], "string"), regex_check("val", r"x[]&[]+")) == 1
    assert fails(column(spark, ["", "xx", "xxx"], "string"), regex_check("val", "x{,2}")) == 1
    named = regex_check("val", r"(?P<first_part>a)(?P=first_part)")
    assert fails(column(spark, ["aa", "ab"], "string"), named) == 1
    assert fails(column(spark, ["٣", "3"], "string"), regex_check("val", r"\d")) == 0
    with pytest.raises(Exception):
        regex_check("val", "(")


def test_formats_casts_and_enums(spark):
    phones = column(spark, ["+4915112345678", "0151 123", None], "string")
    assert fails(phones, format_check("val", "e164")) == 2
    numbers = column(spark, ["1", "x", None], "string")
    assert fails(numbers, cast_check("val", "int")) == 1
    assert fails(numbers, enum_check("val", ["1", "2"])) == 1
    with pytest.raises(ValueError):
        format_check("val", "nope")


def test_foreign_key(spark):
    status = column(spark, ["active", "deleted", "unknown"], "string")
    assert fails(status, foreign_key_check("val", {"active", "inactive"})) == 2
    assert fails(status, foreign_key_check("val", [])) == 3
    fk, ref = column(spark, [1, 2, 99, None]), spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "id int")
    assert fails(fk, foreign_key_check("val", reference_df=ref, reference_column="id")) == 1
    # Values of another type can equal no cell; a long list is joined.
    assert fails(status, foreign_key_check("val", [1, 2])) == 3
    assert fails(column(spark, [1, 5000, None]), foreign_key_check("val", range(2000))) == 1
    with pytest.raises(ValueError):
        foreign_key_check("val")


def test_freshness(spark, customers):
    assert fails(customers, freshness_check("updated_at")) == 2
    assert fails(customers, freshness_check("updated_at", max_age_hours=24 * 30)) == 1
    text = column(spark, ["2024-06-01 11:00:00", "2030-01-01", "soon", None], "string")
    assert fails(text, freshness_check("val")) == 2


def test_naive_times_are_utc_in_any_session_zone(spark, customers):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert fails(customers, freshness_check("updated_at", max_age_hours=4)) == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_consistency(spark):
    df = spark.createDataFrame([(1, 2, "x"), (3, 2, "x"), (None, 2, "y")], "a int, b int, c string")
    assert fails(df, consistency_check("a <= b", ["a", "b"])) == 2
    allowed = spark.createDataFrame([(2, "x")], "k int, c string")
    rule = consistency_check(columns=["b", "c"], reference_df=allowed, reference_columns=["k", "c"])
    assert fails(df, rule) == 1


def test_accuracy(spark):
    mine = spark.createDataFrame([(1, 1.0), (2, 2.4), (3, None), (4, 1.0), (5, None), (1, 1.0)], "k int, v double")
    truth = spark.createDataFrame([(1, 1.0), (2, 2.5), (3, None), (5, 1.0)], "id bigint, v double")
    args = {"truth_key": "id"}
    assert fails(mine, accuracy_check("k", "v", truth, **args)) == 3
    assert fails(mine, accuracy_check("k", "v", truth, tolerance=0.2, **args)) == 2
    twice = truth.union(spark.createDataFrame([(1, 1.5)], "id bigint, v double"))
    assert fails(mine, accuracy_check("k", "v", twice, **args)) == 5


def test_empty_table(spark):
    df = spark.createDataFrame([], "a bigint, b string")
    rules = [null_check("a"), unique_check("b"), regex_check("b", "x"), foreign_key_check("a", range(2000))]
    for r in evaluate(df, rules).results.collect():
        assert (r.total_count, r.pass_rate, r.passed, r.failing_sample) == (0, 1.0, True, [])


def test_bad_rules_are_skipped_alone(customers):
    rules = [
        null_check("nope"),
        null_check("id"),
        consistency_check("no_column > 1"),
        regex_check("email", "(a)?(?(1)b|c)"),
        range_check("updated_at", 0),
        regex_check("email", r"(?a:\d)x"),
    ]
    e = evaluate(customers, rules, sample_size=0)
    assert [r.rule_name for r in e.results.collect()] == ["null_check_id"]
    assert sorted(r.rule_no for r in e.skipped.collect()) == [0, 2, 3, 4, 5]


def test_failing_samples(customers):
    rules = [range_check("age", 0, 150), unique_check("status")]
    first, second = evaluate(customers, rules, order_by="id").results.orderBy("rule_no").collect()
    assert [json.loads(x)["id"] for x in first.failing_sample] == [3, 4]
    assert [json.loads(x)["id"] for x in second.failing_sample] == [1, 2, 4]
    rows = failing_rows(customers, rules, order_by="id", size=1).orderBy("rule_no").collect()
    assert [(r["rank"], r["row"]["id"]) for r in rows] == [(1, 3), (1, 1)]


def test_samples_of_key_rules_match_brute_force(spark):
    rows = [(i, (i * 7) % 13 if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, k bigint")
    ref = spark.createDataFrame([(i,) for i in range(0, 13, 2)], "k bigint")
    found = failing_rows(
        df, [unique_check("k"), foreign_key_check("k", reference_df=ref, reference_column="k")], order_by="id"
    ).collect()
    ks = [k for _, k in rows]
    expected = {
        0: [i for i, k in rows if ks.count(k) > 1][:5],
        1: [i for i, k in rows if k is not None and k % 2][:5],
    }
    for no, ids in expected.items():
        assert [r["row"]["id"] for r in sorted(found, key=lambda r: r["rank"]) if r["rule_no"] == no] == ids


def test_samples_without_an_order_are_repeatable(customers):
    rules = [null_check("email"), unique_check("status"), range_check("age", 0, 150)]
    first = evaluate(customers, rules).results.collect()
    again = evaluate(customers.repartition(3), rules).results.collect()
    key = lambda rs: sorted((r.rule_no, r.failing_sample) for r in rs)
    assert key(first) == key(again)


YAML = """
rules:
  - {type: null_check, column: email, threshold: 0.5}
  - {type: range_check, column: age, severity: low, name: ages, params: {min_value: 0, max_value: 150}}
  - {type: regex_check, column: email}
  - {type: foreign_key_check, column: status, params: {reference_values: [active]}}
  - {type: freshness_check, column: updated_at}
  - {type: unheard_of, column: email}
"""


def test_yaml(customers):
    rules = rules_from_yaml(YAML)
    assert [r.kind for r in rules] == ["null_check", "range_check", "regex_check", "foreign_key_check", "freshness_check"]
    assert (rules[0].severity, rules[0].threshold) == ("medium", 0.5)
    assert (rules[1].name, rules[1].severity) == ("ages", "low")
    assert rules[2].params["pattern"] == ".*" and rules[4].params["max_age_hours"] == 24.0
    got = {r.rule_name: r.fail_count for r in evaluate(customers, rules, NOW, sample_size=0).results.collect()}
    assert got == {"null_check_email": 1, "ages": 2, "regex_check_email": 1, "fk_check_status": 2, "freshness_check_updated_at": 2}


def test_yaml_errors():
    with pytest.raises(ValueError):
        rules_from_yaml("checks: []")
    with pytest.raises(ValueError):
        rules_from_yaml("")
    with pytest.raises(ValueError):
        rules_from_yaml("rules: [{type: null_check, column: a, severity: awful}]")


def test_custom_rule_gets_its_params(customers):
    even = register_rule("divisible", lambda rule, df: F.col(rule.column) % rule.params["by"] == 0)
    assert fails(customers, even("id", by=2)) == 3
    (rule,) = rules_from_dicts([{"type": "divisible", "column": "id", "params": {"by": 5}}])
    assert fails(customers, rule) == 4


def test_rule_set_and_views(customers):
    rules = RuleSet([null_check("email")])
    rules.add(unique_check("id"))
    rules.add(null_check("id"))
    grouped = {r.dimension: [x.rule_name for x in r.results] for r in rules.evaluate_by_dimension(customers).collect()}
    assert grouped == {"completeness": ["null_check_email", "null_check_id"], "uniqueness": ["unique_check_id"]}
    rows = report(rules.evaluate(customers).results).collect()
    assert [r.section for r in rows] == ["failed", "passed", "passed"]
    assert rows[0].fail_pct == pytest.approx(20.0)
    assert by_dimension(rules.evaluate(customers).results).count() == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_rules_share_one_scan(spark, data):
    df = spark.read.parquet(f"{data}/customer.parquet")
    rules = [null_check(c) for c in df.columns] + [range_check("c_acctbal", 0), regex_check("c_name", ".*")]
    plan = plan_of(evaluate(df, rules, sample_size=0).results)
    assert plan.count("FileScan") == 1
    assert "Python" not in plan and "BatchEval" not in plan


def test_key_rules_share_one_exchange_and_collect_nothing(spark, data):
    orders, customer = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("orders", "customer"))
    rules = [
        unique_check("o_orderkey"),
        unique_check(["o_custkey", "o_orderdate"]),
        foreign_key_check("o_custkey", reference_df=customer, reference_column="c_custkey"),
    ]
    plan = plan_of(evaluate(orders, rules, sample_size=0).results)
    assert plan.count("FileScan") == 2
    assert plan.count("hashpartitioning(rule_no") == 2  # the keys, then a handful of counts
    assert "SortMergeJoin" not in plan


def test_reconciliations_share_a_scan(spark, data):
    from plumbob.operators import rules as r
    from plumbob.operators.evaluate import evaluate

    customers, truth = (spark.read.parquet(f"{data}/customer.parquet") for _ in range(2))
    half = truth.where("c_custkey % 2 = 0")
    rules = [
        r.accuracy_check("c_custkey", "c_name", truth_df=half),
        r.accuracy_check("c_custkey", "c_acctbal", truth_df=half.withColumn("c_acctbal", half.c_acctbal + 0.5), tolerance=1.0, name="near"),
        r.accuracy_check(["c_custkey", "c_nationkey"], "c_mktsegment", truth_df=half, name="pair"),
    ]
    results = evaluate(customers, rules, sample_size=0).results
    n = half.count()
    assert {(x.rule_name, x.pass_count) for x in results.collect()} == {("accuracy_check_c_name", n), ("near", n), ("pair", n)}
    scans = [x for x in results._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in x and "parquet" in x]
    assert len(scans) == 1 + len(rules)  # the table once, each truth once

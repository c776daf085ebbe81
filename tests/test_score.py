import datetime as dt

import pytest

from plumbob import dataset_score, dimension_scores, null_check, range_check, report_on, run_quality, unique_check, weights_from_yaml
from plumbob.operators import monitor
from plumbob.operators.score import SEVERITY_WEIGHTS, run_view, score_view
from plumbob.session import scratch_path
from plumbob.sources import history as h

SCHEMA = "rule_no int, rule_name string, dimension string, severity string, pass_rate double, passed boolean"


def results(spark, *rows):
    return spark.createDataFrame([(i, f"r{i}", d, s, rate, ok) for i, (d, s, rate, ok) in enumerate(rows)], SCHEMA)


def test_mean_per_dimension(spark):
    r = results(spark, ("completeness", "high", 0.9, False), ("completeness", "low", 0.8, True))
    rows = {x.dimension: x for x in dimension_scores(r).collect()}
    c = rows["completeness"]
    assert (c.rule_count, c.pass_count, c.fail_count, c.pass_rate, c.weighted_score) == (2, 1, 1, 0.85, 0.17)
    assert c.rules == ["r0", "r1"]
    assert (rows["accuracy"].pass_rate, rows["accuracy"].weighted_score, rows["accuracy"].rule_count) == (1.0, 0.1, 0)


def test_overall_and_totals(spark):
    r = results(spark, ("completeness", "high", 1.0, True), ("validity", "high", 0.0, False), ("integrity", "low", 0.0, False))
    s = dataset_score(r, {"completeness": 0.9, "validity": 0.1}).first()
    assert (s.overall_score, s.grade, s.total_rules, s.total_passed, s.total_failed) == (0.9, "B", 3, 1, 2)


def test_weights_are_normalised(spark):
    r = results(spark, ("completeness", "high", 0.5, False))
    rows = dimension_scores(r, {"completeness": 2, "validity": 2}).collect()
    assert {x.weight for x in rows} == {0.5}
    assert dataset_score(r, {"completeness": 0.0}).first().overall_score == 1.0
    assert dataset_score(r.limit(0)).first().overall_score == 1.0


@pytest.mark.parametrize("rate, letter", [(0.95, "A"), (0.96, "A"), (0.90, "B"), (0.75, "C"), (0.55, "D"), (0.30, "F"), (0.4999, "F")])
def test_grades(spark, rate, letter):
    r = results(spark, ("completeness", "high", rate, False))
    assert dataset_score(r, {"completeness": 1.0}).first().grade == letter


def test_severity_weights(spark):
    r = results(
        spark,
        ("completeness", "high", 0.95, False),
        ("completeness", "medium", 0.90, False),
        ("completeness", "low", 0.92, False),
    )
    rows = dimension_scores(r, {"completeness": 1.0}, SEVERITY_WEIGHTS).collect()
    assert rows[0].pass_rate == pytest.approx((0.95 * 3 + 0.9 * 2 + 0.92) / 6, abs=1e-6)


def test_weights_from_yaml():
    assert weights_from_yaml("dimensions: {completeness: {weight: 0.5}, validity: {weight: 0.5}}") == {"completeness": 0.5, "validity": 0.5}
    assert weights_from_yaml("weights: {validity: 2}") == {"validity": 2.0}
    assert weights_from_yaml("") == {}


def customers(spark):
    rows = [
        (i, None if i % 10 == 0 else f"u{i}@x.org", -5 if i % 25 == 0 else 20 + i % 50) for i in range(1, 201)
    ]
    return spark.createDataFrame(rows, "customer_id bigint, email string, age bigint")


RULES = [null_check("email"), unique_check("customer_id"), range_check("age", 0, 120)]


def test_run_and_history(spark):
    path = scratch_path(spark, "history")
    df = customers(spark)
    for day, frame in ((1, df), (2, df.where("email IS NOT NULL")), (3, df.where("age < 0"))):
        run = run_quality(frame, "customers", RULES, as_of=dt.datetime(2024, 1, day), history_path=path)
    assert {r.rule_name: r.fail_count for r in run_quality(df, "x", RULES).results.collect()} == {
        "null_check_email": 20,
        "unique_check_customer_id": 0,
        "range_check_age": 8,
    }
    history = h.read_history(spark, path)
    runs = h.score_history(history, "customers").collect()
    assert [r.run_at.day for r in runs] == [1, 2, 3]
    assert h.latest_score(history, "customers").first().run_id == run.run_id
    with pytest.raises(h.NoRuns):
        h.latest_score(history, "other")
    drift = monitor.detect_drift(monitor.long_scores(history), 0.05).where("dropped").collect()
    assert {(d.dimension, d.run_at.day) for d in drift} >= {("validity", 3), ("overall", 3)}


def test_all_fail_and_all_pass(spark):
    bad = spark.createDataFrame([(1, None, -1)] * 3, "id bigint, email string, age bigint")
    rules = [unique_check("id"), null_check("email"), range_check("age", 0)]
    weights = {"uniqueness": 1, "completeness": 1, "validity": 1}
    assert run_quality(bad, "bad", rules, weights).score.first().grade == "F"
    good = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id bigint, email string, age bigint")
    assert run_quality(good, "good", rules).score.first().grade == "A"


def test_report_on_derives_rules(spark):
    profiles, run = report_on(customers(spark), "customers")
    assert profiles.count() == 3
    assert run.results.where("rule_name = 'null_check_email'").first().fail_count == 20


def test_views(spark):
    import json

    s = dataset_score(results(spark, ("completeness", "high", 0.5, False)))
    doc = json.loads(score_view(s).first().score)
    assert doc["dimensions"]["completeness"]["rules"] == ["r0"] and doc["total_failed"] == 1
    assert set(run_view(s).first().dimensions["completeness"].asDict()) == {"weight", "pass_rate", "weighted_score"}


def test_drift_trend_and_sla(spark):
    scores = spark.createDataFrame(
        [("d", "completeness", i, s) for i, s in enumerate((0.98, 0.95, 0.85, 0.72))],
        "dataset string, dimension string, run_at int, score double",
    )
    rows = monitor.detect_drift(scores, min_drop=0.05, trend_length=3).orderBy("run_at").collect()
    assert [r.dropped for r in rows] == [False, False, True, True]
    assert [r.trend for r in rows] == [False, False, False, True]
    latest = spark.sql(
        "SELECT 'd' AS dataset, 'r' AS run_id, 1 AS run_at, 0.8D AS overall_score, 'C' AS grade, "
        "map('timeliness', named_struct('pass_rate', 0.85D), 'validity', named_struct('pass_rate', 0.7D)) AS dimensions"
    )
    policies = spark.createDataFrame(
        [
            ("gate", None, None, "B", None, "block"),
            ("each", None, "*", None, 0.8, "alert"),
            ("refresh", "d", "timeliness", None, 0.9, "block"),
            ("other", "e", "timeliness", None, 0.9, "block"),
        ],
        "policy string, dataset string, dimension string, min_grade string, min_score double, action string",
    )
    got = {(r.policy, r.dimension): r.action for r in monitor.evaluate_sla(latest, policies).collect()}
    assert got == {
        ("gate", "overall"): "block",
        ("each", "timeliness"): "pass",
        ("each", "validity"): "alert",
        ("refresh", "timeliness"): "block",
    }


def test_stream_of_runs(spark):
    from plumbob.streaming.runs import quality_stream

    source, path, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "checkpoint"))
    customers(spark).write.parquet(source)
    stream = spark.readStream.schema("customer_id bigint, email string, age bigint").parquet(source)
    query = quality_stream(stream, "live", RULES, path, checkpoint, availableNow=True)
    query.awaitTermination(120)
    assert h.read_history(spark, path).count() >= 1


def test_a_run_that_is_appended_twice_is_one(spark, tmp_path):
    from plumbob.sources import history

    path = str(tmp_path / "history")
    runs = spark.createDataFrame([("a", "r1", 1.0), ("b", "r1", 0.5)], "dataset string, run_id string, overall_score double")
    for _ in range(2):
        history.append_run(runs, path)
    history.append_run(runs.selectExpr("dataset", "'r2' AS run_id", "overall_score"), path)
    assert history.read_history(spark, path).count() == 4

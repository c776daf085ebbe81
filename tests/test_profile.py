import numpy as np
import pytest

from plumbob import auto_rules, dataset_profile, profile
from plumbob.operators import profile as p


@pytest.fixture(scope="module")
def people(spark):
    cities = ["NYC"] * 40 + ["LA"] * 30 + ["CHI"] * 20 + [None] * 10
    rows = [(i, f"user_{i}", f"user{i}@example.com", 25 + i % 50, i * 1.5, cities[i - 1]) for i in range(1, 101)]
    return spark.createDataFrame(rows, "id bigint, name string, email string, age bigint, score double, city string")


@pytest.fixture(scope="module")
def profiled(people):
    return {r["name"]: r for r in profile(people).collect()}


def test_counts(profiled):
    city = profiled["city"]
    assert (city.total_count, city.null_count, city.null_pct) == (100, 10, 10.0)
    assert (city.distinct_count, city.distinct_pct, city.is_unique) == (3, 3.0, False)
    assert profiled["id"].is_unique and profiled["email"].is_unique
    assert profiled["id"].dtype == "bigint"


def test_numbers(profiled):
    score = profiled["score"]
    values = np.arange(1, 101) * 1.5
    assert score["mean"] == pytest.approx(values.mean())
    assert score["std"] == pytest.approx(values.std(ddof=1))
    assert [score["p25"], score["median"], score["p75"]] == pytest.approx(list(np.quantile(values, (0.25, 0.5, 0.75))))
    assert (score.min_value, score.max_value) == ("1.5", "150.0")


def test_texts(profiled):
    email = profiled["email"]
    assert (email.min_length, email.max_length, email.avg_length) == (17, 19, 17.92)
    assert [tuple(x) for x in profiled["city"].top_k] == [("NYC", 40), ("LA", 30), ("CHI", 20)]
    assert [tuple(x) for x in email.patterns] == [("A+D+@A+.A+", 100, 100.0)]
    assert profiled["age"].patterns == [] and profiled["age"].min_length is None


def test_parts(spark, people):
    rows = {r["name"]: r for r in profile(people, include=("distinct",)).collect()}
    assert rows["city"].distinct_count == 3 and rows["city"].top_k == [] and rows["id"]["median"] is None
    bare = profile(people, include=()).where("name = 'id'").first()
    assert (bare.distinct_count, bare.is_unique, bare["mean"]) == (None, None, 50.5)
    with pytest.raises(ValueError):
        profile(people, include=("everything",))


def test_top_k_limit_and_ties(spark):
    df = spark.createDataFrame([(c,) for c in "zyxwv"], "c string")
    (row,) = profile(df, top_k=3).collect()
    assert [t["value"] for t in row.top_k] == ["v", "w", "x"]


def test_empty_all_null_and_single(spark):
    empty = {r["name"]: r for r in profile(spark.createDataFrame([], "a bigint, b string")).collect()}
    a = empty["a"]
    assert (a.total_count, a.null_count, a.null_pct, a.distinct_count, a.is_unique) == (0, 0, 0.0, 0, False)
    assert a["median"] is None and a.top_k == []
    (nulls,) = profile(spark.createDataFrame([(None,), (None,)], "a double")).collect()
    assert (nulls.null_count, nulls.distinct_count, nulls["mean"], nulls["p25"]) == (2, 0, None, None)
    (single,) = profile(spark.createDataFrame([(4,)], "a int")).collect()
    assert (single["median"], single["std"], single.is_unique) == (4.0, None, True)


def test_odd_types(spark):
    df = spark.sql(
        "SELECT true AS b, DATE'2024-01-02' AS d, TIMESTAMP_NTZ'2024-01-02 03:04:05' AS t, 1.50BD AS dec, "
        "CAST(0.1 AS FLOAT) AS f, array(1, 2) AS arr, map('k', 1) AS m, named_struct('x', 1) AS s, X'00FF' AS bin, "
        "CAST('NaN' AS DOUBLE) AS nan, 1 AS `a.b` UNION ALL "
        "SELECT false, NULL, NULL, 2.50BD, 0.3, NULL, NULL, NULL, NULL, 2.0, 2"
    )
    rows = {r["name"]: r for r in profile(df).collect()}
    assert rows["dec"]["median"] == 2.0 and rows["dec"].min_value == "1.50"
    assert rows["f"]["median"] == pytest.approx(0.2) and rows["f"].max_value == "0.3"
    assert rows["nan"].null_count == 1 and rows["nan"].max_value == "2.0"
    assert rows["arr"].top_k[0]["value"] == "[1,2]" and rows["m"].distinct_count == 1
    assert rows["a.b"].is_unique and rows["b"].min_value == "false"
    assert rows["d"].min_value == "2024-01-02"


def test_zero_signs_are_one_value(spark):
    (r,) = profile(spark.createDataFrame([(0.0,), (-0.0,)], "a double")).collect()
    assert r.distinct_count == 1


def test_patterns(spark):
    df = spark.createDataFrame([("D12",), ("A7",), ("Ünï-٣",), ("",), ("+1 A",)], "v string")
    shapes = {r["pattern"]: r["n"] for r in p.value_patterns(p.value_frequencies(df)).collect()}
    assert shapes == {"A+D+": 2, "A+-D+": 1, "": 1, "+D+ A+": 1}


@pytest.mark.parametrize("shape", ["uniform", "hot", "heavy", "few", "negative"])
def test_quartiles_match_numpy(spark, shape):
    rng = np.random.default_rng(5)
    n = 30_011
    values = {
        "uniform": rng.uniform(0, 1, n),
        "hot": np.where(rng.uniform(size=n) < 0.34, 7.0, rng.normal(7, 1, n)),
        "heavy": rng.pareto(0.5, n) * 1e6,
        "few": rng.integers(0, 4, n).astype(float),
        "negative": -rng.exponential(3, n),
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(7)
    (r,) = p.quartiles(df, p.quartile_brackets(df)).collect()
    assert [r["p25"], r["median"], r["p75"]] == pytest.approx(list(np.quantile(values, (0.25, 0.5, 0.75))), rel=1e-12)


def test_approximate_profile_shuffles_no_values(spark, people):
    approx = profile(people, approx=True)
    rows = {r["name"]: r for r in approx.collect()}
    assert rows["city"].distinct_count == 3
    assert rows["city"].top_k[0]["value"] == "NYC"
    assert "hashpartitioning(position" not in approx._jdf.queryExecution().executedPlan().toString()


def test_dataset(spark, people):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, None), (3, None)], "a bigint, b string")
    (r,) = dataset_profile(df).collect()
    assert (r.row_count, r.column_count, r.duplicate_row_count, r.null_cell_pct) == (5, 2, 2, 20.0)
    assert r.memory_bytes == 5 * 8 + 3
    assert dataset_profile(people).first().memory_bytes > 0


def test_auto_rules(spark):
    rows = [(i, f"u{i}@x.org" if i % 30 else None, float(i), -i, "+49 151 1234") for i in range(1, 91)]
    df = spark.createDataFrame(rows, "customer_id bigint, email string, amount double, delta bigint, phone string")
    got = [(r.kind, r.column, r.severity) for r in auto_rules(df)]
    assert got == [
        ("unique_check", "customer_id", "high"),
        ("range_check", "customer_id", "medium"),
        ("null_check", "email", "high"),
        ("unique_check", "email", "high"),
        ("regex_check", "email", "high"),
        ("range_check", "amount", "medium"),
        ("regex_check", "phone", "medium"),
    ]


def test_profile_counts_values_once(spark, data):
    result = profile(spark.read.parquet(f"{data}/supplier.parquet"))
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    exchanges = [line for line in plan.splitlines() if "hashpartitioning(position" in line and ", whole" in line]
    made = [line for line in exchanges if "ReusedExchange" not in line]
    assert len(made) == 1  # whole numbers, doubles and texts together
    assert "Python" not in plan


def _quantiles(values):
    return list(np.quantile(np.array(values, float), (0.25, 0.5, 0.75)))


SIZES = [1, 2, 3, 4, 5, 6, 7, 10, 11, 199, 1501, 1502, 3003, 5003, 6000]


@pytest.mark.parametrize("part", [0, 1])
def test_quartiles_of_any_size(spark, part):
    """Many small columns, through the counted cells and through brackets."""
    rng = np.random.default_rng(9 + part)
    columns = [rng.choice([rng.normal(0, 1, n), rng.integers(0, 3, n).astype(float), rng.pareto(0.3, n)]) for n in SIZES]
    columns[2][0] = columns[5][1] = float("inf")
    columns[6][2] = -float("inf")
    rows = zip(*(list(c) + [None] * (max(SIZES) - len(c)) for c in columns))
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in rows], ", ".join(f"c{n} double" for n in SIZES)).repartition(5)
    for include in ({"distinct", "quartiles"}, {"quartiles"}):
        got = {r["name"]: [r["p25"], r["median"], r["p75"]] for r in profile(df, include=include).collect()}
        for n, values in zip(SIZES, columns):
            v = np.sort(values)
            for mine, q in zip(got[f"c{n}"], (0.25, 0.5, 0.75)):
                low, high, at = v[int(np.floor(q * (n - 1)))], v[int(np.ceil(q * (n - 1)))], q * (n - 1)
                want = low if low == high or at == int(at) else low + (high - low) * (at - int(at))
                assert mine == pytest.approx(want, rel=1e-12, nan_ok=True), (n, q, include)


def test_cuts_that_are_off_cost_no_rank(spark):
    values = [float(v) for v in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    for edges in ([0.0] * 6, [5.0, 6.0] * 3, [-9.0, 2000.0] * 3, [3.0, 3.0, 500.0, 500.0, 999.0, 999.0]):
        (r,) = p.quartiles(df, {0: edges}).collect()
        assert [r["p25"], r["median"], r["p75"]] == _quantiles(values)


def _plain_leading(values, k):
    counted = {}
    for v in values:
        counted[v] = counted.get(v, 0) + 1
    return sorted(counted.items(), key=lambda e: (-e[1], e[0].encode()))[:k]


def test_long_texts_travel_as_digests(spark):
    """Ties among long texts with equal beginnings, patterns shared by long and short ones, no text in the exchange."""
    import re

    start = "the same beginning of many texts, longer than any that is cut off "
    texts = [f"{start}{c} {n} end" for c in "abcdefghij" for n in (1, 22, 333)] * 2 + [f"{start}{c} 1 end" for c in "ab"]
    texts += ["x" * 100, "y" * 100, "z", "short 1", "x" * 30, "", "1" * 70, "22"] + [None] * 3
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int").repartition(4)
    got = profile(df, top_k=7, pattern_k=6)
    (r,) = got.where("name = 't'").collect()
    present = [t for t in texts if t is not None]
    assert [tuple(v) for v in r["top_k"]] == _plain_leading(present, 7)
    shapes = [re.sub(r"\d+", "D+", re.sub(r"[^\W\d_]+", "A+", t)) for t in present]
    assert [(v["pattern"], v["count"]) for v in r["patterns"]] == _plain_leading(shapes, 6)
    assert (r["distinct_count"], r["null_count"], r["min_value"], r["max_length"]) == (len(set(present)), 3, "", 100)
    from plumbob.operators import frequencies as f

    keys = f.cells(df, list(enumerate(df.schema))).where("long IS NOT NULL").selectExpr("max(length(to_json(long))) AS n").first()
    assert keys["n"] < 300


def test_no_long_texts_no_second_read(spark, data):
    result = profile(spark.read.parquet(f"{data}/supplier.parquet"))
    result.collect()
    final = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Scan parquet") <= 2

import json
import shutil

import pytest

from plumbob.sources import files, jdbc, tables


@pytest.fixture()
def folder(spark, tmp_path):
    root = tmp_path / "root"
    (root / "deep").mkdir(parents=True)
    (root / "a b.csv").write_text("id,name,value\n1,a,10.5\n2,b,\n3,c,30.0\n")
    (root / "deep" / "U.CSV").write_text("k\n")
    (root / "note.txt").write_text("no")
    (root / "broken.parquet").write_text("this is not parquet")
    out = tmp_path / "out"
    spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, name string").coalesce(1).write.parquet(str(out))
    part = next(out.glob("part-*.parquet"))
    shutil.copy(part, root / "deep" / "t.pq")
    shutil.copy(part, root / "t.parquet")
    return str(root)


def test_csv(spark, folder):
    df = files.load(spark, f"{folder}/a b.csv")
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "string", "double"]
    assert df.count() == 3 and df.where("value IS NULL").count() == 1
    typed = files.load(spark, f"{folder}/a b.csv", schema="id bigint, name string, value string")
    assert typed.schema["id"].dataType.simpleString() == "bigint"


def test_parquet_and_unknown(spark, folder):
    assert files.load(spark, f"{folder}/deep/t.pq").count() == 2
    with pytest.raises(ValueError):
        files.load(spark, "x.docx")


def test_json_array_and_object(spark, tmp_path):
    array, nested = tmp_path / "array.json", tmp_path / "object.json"
    array.write_text(json.dumps([{"a": 1, "b": {"c": 2}}, {"a": 3}]))
    nested.write_text(json.dumps({"a": 1, "b": {"c": 2, "d": {"e": [1, 2]}}}))
    rows = files.load(spark, str(array))
    assert rows.count() == 2 and rows.select("b.c").first().c == 2
    flat = files.load(spark, str(nested), flatten_object=True)
    assert flat.columns == ["a", "b.c", "b.d.e"]
    assert flat.count() == 1 and flat.first()["b.d.e"] == [1, 2]


def test_discover(spark, folder):
    names = lambda **k: sorted(r["name"] for r in files.discover(spark, folder, **k).collect())
    assert names() == ["U.CSV", "a b.csv", "broken.parquet", "t.parquet", "t.pq"]
    assert names(extensions=(".csv",), recursive=False) == ["a b.csv"]
    plan = files.discover(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    total = files.dataset_bytes(spark, folder).first().size_bytes
    assert total > sum(r.size_bytes for r in files.discover(spark, folder, extensions=(".csv",)).collect())


def test_list_datasets(spark, folder):
    rows = {r["name"]: r for r in files.list_datasets(spark, folder).collect()}
    assert set(rows) == {"U.CSV", "a b.csv", "broken.parquet", "t.parquet", "t.pq"}
    assert (rows["a b.csv"].row_count, rows["a b.csv"].columns) == (3, ["id", "name", "value"])
    assert (rows["t.pq"].row_count, rows["t.pq"].column_count) == (2, 2)
    assert (rows["U.CSV"].row_count, rows["U.CSV"].columns) == (0, ["k"])
    assert (rows["broken.parquet"].row_count, rows["broken.parquet"].columns) == (None, [])


def test_scan_pushes_its_filter(spark, data):
    df = tables.scan(spark.read.parquet(f"{data}/lineitem.parquet"), "l_quantity > 45").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "l_comment" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_sample_and_head(spark, data):
    df = spark.read.parquet(f"{data}/orders.parquet")
    n = df.count()
    assert tables.sample(df, 100, seed=1).count() == 100
    assert tables.sample(df, n * 2).count() == n
    assert tables.sample(df, 50, 3).collect() == tables.sample(df, 50, 3).collect()
    assert tables.sample(df, 50, 3).collect() != tables.sample(df, 50, 4).collect()
    assert "TakeOrderedAndProject" in tables.sample(df, 100)._jdf.queryExecution().executedPlan().toString()
    assert tables.preview(df).count() == 100
    assert tables.head(df, 3, "o_orderkey").count() == 3


def test_registry(spark, data):
    registry = tables.Registry(spark)
    key = registry.register("suppliers", path=f"{data}/supplier.parquet")
    empty = registry.register("later", source_type="memory")
    assert registry.data(key).count() > 0
    registry.view(key)
    assert spark.sql("SELECT count(*) AS n FROM suppliers").first().n == registry.data(key).count()
    assert registry.upload(empty, [{"a": 1}, {"a": 2, "b": "x"}]).columns == ["a", "b"]
    assert registry.data(empty).where("b IS NULL").count() == 1
    assert {r["name"] for r in registry.datasets().collect()} == {"suppliers", "later"}
    with pytest.raises(tables.UnknownDataset):
        registry.data("nope")
    with pytest.raises(tables.UnknownDataset):
        registry.data(registry.register("nothing", source_type="memory"))


def test_jdbc_options():
    config = {"host": "db", "database": "shop", "user": "u", "password": "p"}
    assert jdbc.jdbc_options(config) == {"url": "jdbc:postgresql://db:5432/shop", "user": "u", "password": "p"}
    assert jdbc.jdbc_options({"url": "jdbc:x:y"}) == {"url": "jdbc:x:y"}
    whole = jdbc.table_options(config, 'odd"name')
    assert whole["dbtable"] == '"public"."odd""name"' and "numPartitions" not in whole
    split = jdbc.table_options(config | {"schema": "s"}, "t", "id", 0, 100, 8)
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == ('"id"', "0", "100", "8")
    with pytest.raises(ValueError):
        jdbc.table_options(config, "t", "id")

import csv
import io
import json
import random

import pytest

from plumbob.sources import files, ranges


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few hundred bytes, so small files have many."""
    names = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


CELLS = ["", "a", "b c", 'say "x"', "two\nlines", 'three\n"quoted"\nlines', ",", '"', '""', "\n", "x" * 700, "ends\n", "7", "é✓", "l1\n\nl3"]


def table(rows, width, seed):
    rng = random.Random(seed)
    return [[str(i), *(rng.choice(CELLS) for _ in range(width - 1))] for i in range(rows)]


@pytest.mark.parametrize("rows,seed,end", [(0, 1, "\n"), (1, 2, "\n"), (60, 3, "\n"), (400, 4, "\n"), (120, 5, "\r\n")])
def test_csv_over_ranges(small_ranges, tmp_path, rows, seed, end):
    spark, cells = small_ranges, table(rows, 4, seed)
    if end == "\r\n":
        cells = [[c.replace("\n", " ") if i % 2 else c for c in r] for i, r in enumerate(cells)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerows([["id", "b", "c d", "e"], *cells])
    path = tmp_path / "t.csv"
    path.write_bytes(out.getvalue().removesuffix(end if seed == 3 else "").encode())
    df = files.read_csv(spark, str(path), "id string, b string, c string, e string")
    got = sorted((tuple(r) for r in df.collect()), key=lambda r: int(r[0]))
    assert got == [tuple(c or None for c in r) for r in cells]
    if rows > 1:
        assert ranges.functions(spark, str(path), ranges.QuotedLines()).count() > 3


def test_csv_header_types_and_several_files(small_ranges, tmp_path):
    for n in range(3):
        rows = "".join(f'{n * 100 + i},"{"line" if i % 3 else "two"}\n{"x" * 30}",{i / 4}\n' for i in range(40))
        (tmp_path / f"{n}.csv").write_text(f'"the\nid",said,x\n{rows}')
    df = files.read_csv(small_ranges, str(tmp_path))
    assert df.dtypes == [("the\nid", "int"), ("said", "string"), ("x", "double")]
    assert sorted(r[0] for r in df.collect()) == [n * 100 + i for n in range(3) for i in range(40)]
    listed = files.list_datasets(small_ranges, str(tmp_path))
    assert {tuple(r["columns"]) for r in listed.collect()} == {("the\nid", "said", "x")}


def test_csv_without_line_breaks_is_read_by_lines(small_ranges, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(100)))
    df = files.read_csv(small_ranges, str(path))
    assert "mapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.rdd.getNumPartitions() > 3 and df.where("b = 'x, \"7\"'").first()["a"] == 7


def test_quotes_that_open_no_cell(small_ranges, tmp_path):
    """A quote within a bare cell is a character, even beside cells with line breaks."""
    path = tmp_path / "t.csv"
    lines = "".join(f'{i},5" pipe,"a\nb {"y" * 50}"\n' for i in range(60))
    path.write_text("id,size,text\n" + lines)
    rows = files.read_csv(small_ranges, str(path), "id int, size string, text string").collect()
    assert sorted(r["id"] for r in rows) == list(range(60)) and {r["size"] for r in rows} == {'5" pipe'}


def objects(n, seed):
    rng = random.Random(seed)

    def value(depth):
        kind = rng.randrange(7 if depth < 3 else 4)
        if kind == 0:
            return rng.choice(['br}ace{"', "back\\slash\\", 'q"uote', "]},[{", "é✓", "", "\\\"}", "nl\n"])
        if kind < 3:
            return rng.randrange(99)
        if kind == 3:
            return None
        if kind == 4:
            return [value(depth + 1) for _ in range(rng.randrange(3))]
        return {f"k{j}": value(depth + 1) for j in range(rng.randrange(3))}

    return [{"id": i, "s": rng.choice(["}", "{", "x" * 400, '"}', "\\"]), "v": json.dumps(value(0)), "o": value(2) and {"a": [value(3)], "b": {}}} for i in range(n)]


@pytest.mark.parametrize("n,indent", [(0, None), (1, None), (200, None), (60, 2), (60, 0)])
def test_json_array_over_ranges(small_ranges, tmp_path, n, indent):
    items = objects(n, n)
    path = tmp_path / "t.json"
    path.write_text(json.dumps(items, indent=indent, ensure_ascii=False) + "\n")
    assert files.json_kind(small_ranges, str(path)) == ("objects" if n else "array")
    df = files.read_json(small_ranges, str(path), "id int, s string, v string")
    assert sorted(tuple(r) for r in df.collect()) == [(i["id"], i["s"], i["v"]) for i in items]
    if n > 1:
        assert ranges.functions(small_ranges, str(path), ranges.ArrayObjects()).count() > 3


def test_json_kinds(spark, tmp_path):
    kinds = {
        "[1, 2]": "array", "[]": "array", "": "array", ' \n[ \n {"a": 1}]': "objects", '{"a": {"b": 1}}': "object",
        '{"a": 1}\n{"a": 2}': "lines", '{"a":\n {"b": 1},\n "c": 2}': "object", '{"a": "}"}\n\n{"a": 2}': "lines",
    }
    for i, (text, kind) in enumerate(kinds.items()):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        assert files.json_kind(spark, str(path)) == kind, text

"""Documents, images, duplicates, semantic types and completions."""

import datetime as dt
import hashlib
import itertools
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
import yaml

from plumbob import null_check, evaluate, profile, rules_from_yaml
from plumbob.functions import pixels
from plumbob.operators import completion, dedup, documents, images, prompts, reconcile, semantic
from plumbob.session import scratch_path

# -- documents


def test_documents(spark):
    long = "word " * 20
    pages = spark.createDataFrame(
        [(1, 1, long, ""), (1, 2, " \u2003 x ", "from the scan"), (2, 1, long, None), (3, 1, "", ""), (3, 2, None, "y z")],
        "doc_id int, page_number int, text string, ocr_text string",
    )
    rows = {r.doc_id: r for r in documents.profile_documents(documents.classify_pages(pages)).collect()}
    assert [rows[i].doc_type for i in (1, 2, 3)] == ["mixed", "native", "scanned"]
    assert (rows[1].page_count, rows[1].word_count, rows[1].ocr_page_count) == (2, 23, 1)
    assert (rows[3].total_chars, rows[3].word_count) == (3, 2)
    plain = {(r.doc_id, r.page_number): r for r in documents.classify_pages(pages, ocr_enabled=False).collect()}
    assert plain[(1, 2)].text == " \u2003 x " and not plain[(1, 2)].is_ocr
    assert documents.classify_pages(pages, only_pages=[2, 9]).count() == 2


def test_table_cells(spark):
    tables = spark.createDataFrame(
        [(1, 1, 0, [["a", "", None], ["1", "2", "3"], ["4", None, "6"]]), (1, 1, 1, [["lonely"]]), (1, 2, 0, [["h"], ["x", "extra"]])],
        "doc_id int, page_number int, table_no int, rows array<array<string>>",
    )
    cells = [tuple(r) for r in documents.table_cells(tables).collect()]
    assert {c[3:] for c in cells if c[1] == 1} == {
        (0, 0, "a", "1"), (0, 1, "col_1", "2"), (0, 2, "col_2", "3"), (1, 0, "a", "4"), (1, 1, "col_1", None), (1, 2, "col_2", "6"),
    }
    assert {c[3:] for c in cells if c[1] == 2} == {(0, 0, "h", "x"), (0, 1, "col_1", "extra")}


def test_manifest(spark):
    there = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("e", 5)], "path string, size_bytes bigint")
    listed = spark.createDataFrame([("a", 1), ("b", 9), ("d", 4), ("e", None)], "path string, size_bytes bigint")
    checked = reconcile.manifest_check(there, listed)
    assert {r.path: r.status for r in checked.collect()} == {
        "a": "ok", "b": "size_mismatch", "c": "unexpected", "d": "missing", "e": "ok",
    }
    assert reconcile.manifest_result(checked).first().pass_rate == 0.4


# -- duplicates


def brute_pairs(rows, distance):
    reps = {}
    for i, h in rows:
        reps[h] = min(i, reps.get(h, i))
    out = {(reps[h], i, 0) for i, h in rows if i != reps[h]}
    for (ha, a), (hb, b) in itertools.combinations(reps.items(), 2):
        d = ((ha ^ hb) & (2**64 - 1)).bit_count()
        if d <= distance:
            out.add((min(a, b), max(a, b), d))
    return out


@pytest.mark.parametrize("distance, hot", [(0, 1000), (1, 1000), (3, 1000), (3, 2), (2, 0), (4, 3), (8, 1000), (8, 4), (12, 16)])
def test_near_duplicates_are_exact(spark, distance, hot):
    rng = np.random.default_rng(distance * 10 + hot)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 12)]
    hashes = list(base)
    for h in base * 6:
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            h ^= -(2**63) if bit == 63 else 1 << int(bit)
        hashes.append(h)
    hashes += [base[0]] * 25  # a third of the rows share one hash
    rows = list(enumerate(hashes))
    df = spark.createDataFrame(rows, "id bigint, h bigint")
    found = dedup.near_duplicates(df, "id", "h", distance, hot_bucket=hot)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs(rows, distance)


def test_crowded_buckets_are_split(spark, monkeypatch):
    """A third of the hashes agree on 40 bits; buckets that are joined stay small, but for hashes that are all near."""
    rng = np.random.default_rng(4)
    values = [int(v) >> 40 if i % 3 == 0 else int(v) for i, v in enumerate(rng.integers(0, 2**63 - 1, 900))]
    values += [values[1] ^ 1 << int(b) for b in range(60)]
    rows = list(enumerate(values))
    tiled = []
    plain = dedup._pairs_in_tiles
    monkeypatch.setattr(dedup, "_pairs_in_tiles", lambda c, t, n: tiled.append(c.agg({"members": "max"}).first()[0]) or plain(c, t, n))
    df = spark.createDataFrame(rows, "id bigint, h bigint")
    assert {tuple(r) for r in dedup.near_duplicates(df, "id", "h", 3, hot_bucket=32).collect()} == brute_pairs(rows, 3)
    assert tiled and max(m or 0 for m in tiled) <= 70  # the near ones only


def test_hashes_that_share_many_choices_are_compared_once(spark, monkeypatch):
    """All hashes agree on ten of the choices; they are compared for the first one only, and each pair is found once."""
    rng = np.random.default_rng(5)
    rows = [(i, int(v) << 32) for i, v in enumerate(rng.integers(-(2**31), 2**31 - 1, 200))]
    rows += [(1000 + i, h ^ 1 << 32 + i % 31) for i, h in rows[:60]]
    tiled = []
    plain = dedup._pairs_in_tiles
    monkeypatch.setattr(dedup, "_pairs_in_tiles", lambda c, t, n: tiled.append(c.count()) or plain(c, t, n))
    got = [tuple(r) for r in dedup.near_duplicates(spark.createDataFrame(rows, "id bigint, h bigint"), "id", "h", 8, hot_bucket=64).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, 8)
    assert sum(tiled) <= len({h for _, h in rows})


@pytest.mark.parametrize("hot", [0, 32])
def test_no_more_pairs_are_compared_than_there_are(spark, monkeypatch, hot):
    """A third of the hashes agree on most of 32 bits; at 12 bits the buckets hold more pairs than there are."""
    rng = np.random.default_rng(6)
    values = [int(v) & (-(2**32) if i % 3 == 0 else -1) for i, v in enumerate(rng.integers(-(2**63), 2**63 - 1, 120))]
    values += [v ^ 1 << int(b) for v, b in zip(values, rng.integers(0, 63, 120))]
    rows = list(enumerate(values))
    compared = []
    plain = dedup._pairs_within

    def counted(units, *rest):
        unit = [c for c in dedup.UNIT if c in units.columns]
        parts = {}
        for *of, _, n in units.withColumn("tile", units.tile if "tile" in units.columns else F.lit(0)).groupBy(*unit, "tile").count().collect():
            parts.setdefault(tuple(of), []).append(n)
        tiled = "tile" in units.columns
        for of, sizes in parts.items():
            n = sizes[0]
            compared.append(n * sum(sizes[1:]) if tiled and of[-1] != of[-2] else n * (n - 1) // 2)
        return plain(units, *rest)

    monkeypatch.setattr(dedup, "_pairs_within", counted)
    found = dedup.near_duplicates(spark.createDataFrame(rows, "id bigint, h bigint"), "id", "h", 12, hot_bucket=hot)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, 12)
    n = len(set(values))
    assert sum(compared) <= n * (n - 1) // 2


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("size", [0, 1, 30, 400])
def test_arrays_of_hashes_are_compared_in_blocks(monkeypatch, same, size):
    monkeypatch.setattr(dedup, "CHUNK", 1 << 10)
    monkeypatch.setattr(dedup, "WIDTH", 1 << 6)
    rng = np.random.default_rng(size)
    left = rng.integers(0, 2**64, size, dtype=np.uint64) & rng.choice(np.array([2**64 - 1, 2**20 - 1, 2**40 - 1], np.uint64), size)
    right = left if same else rng.permutation(left)[: size * 2 // 3] ^ np.uint64(1 << 63)
    got = [(int(i), int(j), int(d)) for a, b, c in dedup._compared(left, right, 12, same) for i, j, d in zip(a, b, c)]
    assert len(got) == len({frozenset(x[:2]) if same else x[:2] for x in got})
    near = {(i, j): (int(x) ^ int(y)).bit_count() for i, x in enumerate(left) for j, y in enumerate(right) if i != j or not same}
    want = {(min(k), max(k), d) if same else (*k, d) for k, d in near.items() if d <= 12}
    assert {(min(i, j), max(i, j), d) if same else (i, j, d) for i, j, d in got} == want


def test_copies_of_hashes_are_neither_multiplied_nor_broadcast(spark):
    rows = [(f"r{i:03}", i % 40 - (2**62 if i % 3 else 0)) for i in range(400)]
    found = dedup.near_duplicates(spark.createDataFrame(rows, "id string, h bigint"), "id", "h", 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Broadcast" not in plan
    assert {tuple(r) for r in found.collect()} == brute_pairs(rows, 0)
    near = {tuple(r) for r in dedup.near_duplicates(spark.createDataFrame(rows, "id string, h bigint"), "id", "h", 2, hot_bucket=8).collect()}
    assert near == brute_pairs(rows, 2)


def test_text_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)], "id int, t string")
    (row,) = dedup.text_duplicates(df, "id", "t").collect()
    assert (row.copies, row.first_id, row.text_hash) == (2, 1, hashlib.sha256(b"a").hexdigest())


# -- semantic types


def test_semantic_types(spark):
    rows = [
        (f"u{i}@x.org", f"{100 + i}-22-{1000 + i}", f"Ann{'a' * (i % 3)} Lee", i, 48.1 + i / 100, "ab"[i % 2], f"some longer words number {i} here", "DE")
        for i in range(60)
    ]
    df = spark.createDataFrame(
        rows, "contact string, ssn string, person string, order_id int, latitude double, flag string, remark string, country string"
    )
    got = {r.column_name: r for r in semantic.classify_columns(df).collect()}
    assert {c: r.semantic_type for c, r in got.items()} == {
        "contact": "email", "ssn": "ssn", "person": "full_name", "order_id": "numeric_id", "latitude": "latitude",
        "flag": "categorical", "remark": "free_text", "country": "country_code",
    }
    assert (got["ssn"].pii_category, got["ssn"].pii_types, got["ssn"].confidence) == ("high", ["ssn"], 1.0)
    assert not got["flag"].pii_detected and got["contact"].suggested_validation


def test_redaction(spark):
    df = spark.createDataFrame(
        [(1, "write to ann@x.org or +49 151 23456789, ssn 123-45-6789, card 4111 1111 1111 1111, ip 10.0.0.1")], "id int, t string"
    )
    assert semantic.redact(df, ["t"]).first().t == "write to [EMAIL] or [PHONE], ssn [SSN], card [CARD], ip [IP]"


# -- images


def png(path, array):
    array = np.asarray(array, dtype=np.uint8)
    height, width = array.shape[:2]
    kind = {2: 0, 3: {3: 2, 4: 6}.get(array.shape[-1])}[array.ndim]
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    raw = b"".join(b"\0" + array[y].tobytes() for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def pictures(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(1)
    texture = rng.integers(0, 200, (60, 80, 3))
    png(root / "texture.png", texture)
    png(root / "brighter.png", texture + 9)
    png(root / "other.png", rng.integers(0, 200, (60, 80, 3)))
    png(root / "alpha.png", np.concatenate([texture, np.full((60, 80, 1), 255)], axis=2))
    png(root / "red.png", np.tile(np.array([250, 0, 0]), (40, 50, 1)))
    png(root / "black.png", np.zeros((32, 32, 3)))
    png(root / "white.png", np.full((20, 10), 255))
    png(root / "thin.png", np.full((2, 9), 90))
    (root / "broken.png").write_bytes(b"\x89PNG no image at all")
    rows = images.profile_image_files(spark, str(root)).collect()
    return {r.path.rsplit("/", 1)[1]: r for r in rows}, texture


def test_many_small_files_are_few_tasks(spark, tmp_path):
    """One task per few files made most of the time; sizes and headers must not pass through the driver."""
    for i in range(40):
        png(tmp_path / f"{i}.png", np.full((3, 2 + i % 5), i))
    bytes_, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    was = {c: spark.conf.get(c) for c in (bytes_, cost)}
    try:
        spark.conf.set(bytes_, "1000"), spark.conf.set(cost, "1000")
        assert spark.read.format("binaryFile").load(str(tmp_path)).rdd.getNumPartitions() == 40
        least = 3 * spark.sparkContext.defaultParallelism
        assert images._read_files(spark, "binaryFile", str(tmp_path)).rdd.getNumPartitions() <= least
        found = images.profile_image_files(spark, str(tmp_path))
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.format) for r in found.collect()} == {f"{i}.png": (2 + i % 5, 3, "PNG") for i in range(40)}
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)


def test_image_metadata(pictures):
    rows, _ = pictures
    t = rows["texture.png"]
    assert (t.width, t.height, t.channels, t.format, t.color_mode, t.bit_depth) == (80, 60, 3, "PNG", "RGB", 8)
    assert (t.megapixels, t.aspect_ratio, t.is_corrupt) == (0.0, 1.3333, False) and t.file_size_bytes > 100
    assert (rows["alpha.png"].channels, rows["alpha.png"].color_mode) == (4, "RGBA")
    assert rows["white.png"].color_mode == "L"
    b = rows["broken.png"]
    assert (b.is_corrupt, b.width, b.channels, b.format, b.phash, b.is_blurry) == (True, 0, 0, "unknown", "", False)
    assert b.file_size_bytes == 20


def test_image_quality(pictures):
    rows, texture = pictures
    gray = (texture[..., 0] * 19595 + texture[..., 1] * 38470 + texture[..., 2] * 7471 + 0x8000) >> 16
    assert rows["texture.png"].exposure_mean == pytest.approx(gray.mean(), abs=0.01)
    assert rows["texture.png"].exposure_std == pytest.approx(gray.std(), abs=0.01)
    padded = np.pad(gray.astype(float), 1, mode="edge")
    slow = [
        padded[y, x + 1] + padded[y + 2, x + 1] + padded[y + 1, x] + padded[y + 1, x + 2] - 4 * padded[y + 1, x + 1]
        for y in range(60)
        for x in range(80)
    ]
    assert rows["texture.png"].blur_score == pytest.approx(np.var(slow), abs=0.01)
    assert not rows["texture.png"].is_blurry and rows["red.png"].is_blurry
    # Red weighs 0.299: the channel order matters.
    assert rows["red.png"].exposure_mean == pytest.approx(75, abs=0.5)
    assert rows["black.png"].is_underexposed and rows["white.png"].is_overexposed
    assert rows["thin.png"].blur_score == 0.0


def test_image_hashes(pictures):
    rows, _ = pictures
    bits = lambda name: int(rows[name].phash, 16)
    assert rows["alpha.png"].phash == rows["texture.png"].phash and len(rows["texture.png"].phash) == 16
    assert (bits("texture.png") ^ bits("brighter.png")).bit_count() <= 4
    assert (bits("texture.png") ^ bits("other.png")).bit_count() > 12


def test_hash_against_the_definition():
    rng = np.random.default_rng(3)
    small = rng.integers(0, 256, (32, 32)).astype(np.uint8)
    n = 32
    scale = lambda u: np.sqrt(1 / n) if u == 0 else np.sqrt(2 / n)
    wave = lambda u: np.cos(np.pi * (2 * np.arange(n) + 1) * u / (2 * n))
    low = np.array([[scale(u) * scale(v) * (np.outer(wave(u), wave(v)) * small).sum() for v in range(8)] for u in range(8)])
    expected = "".join("1" if b else "0" for b in (low > np.median(low)).ravel())
    assert pixels.perceptual_hash(small) == f"{int(expected, 2):016x}"


def test_hash_bits_keep_all_64(spark):
    df = spark.createDataFrame([("ffffffffffffffff",), ("8000000000000001",), ("",)], "p string")
    assert [r.b for r in df.select(images.hash_bits(df.p).alias("b")).collect()] == [-1, -(2**63) + 1, None]


# -- prompts and completions


def test_prompts(spark):
    df = spark.createDataFrame([(1, "a@b.com"), (2, None)], "id int, email string")
    p = profile(df)
    texts = {r.column_name: r.prompt for r in prompts.classification_prompts(p).collect()}
    assert "column: email" in texts["email"] and "nulls: 1 of 2 (50.0%)" in texts["email"]
    assert "length: n/a to n/a" in texts["id"]
    from plumbob import dataset_profile

    (row,) = prompts.proposal_prompt(p, dataset_profile(df), "people", "crm").collect()
    assert "rows: 2, columns: 2" in row.prompt and "- id: type=int" in row.prompt and "context: crm" in row.prompt
    single = spark.createDataFrame([(1,)], "x int")
    assert "std=n/a" in prompts.proposal_prompt(profile(single), dataset_profile(single)).first().prompt
    results = evaluate(df, [null_check("id"), null_check("email")], order_by="id").results
    (failed,) = prompts.explanation_prompts(results).collect()
    assert failed.rule_name == "null_check_email" and 'failing rows: [{"id":2,"email":null}]' in failed.prompt


def counting(log):
    def answer(texts):
        with open(log, "a") as f:
            f.write("".join(t + "\n" for t in texts))
        return [(json.dumps({"n": len(t)}), len(t), 1, 0.5) for t in texts]

    return answer


def test_completions_are_cached(spark, tmp_path):
    path, log = scratch_path(spark, "cache"), str(tmp_path / "calls")
    day = lambda n: dt.datetime(2024, 1, n)
    ask = lambda texts, when, **k: completion.complete_batch(
        spark.createDataFrame([(t,) for t in texts], "prompt string"), counting(log), "m", path, as_of=when, **k
    ).collect()
    first = ask(["a", "bb", "a", "a"], day(1))
    assert sorted((r.prompt, r.content, r.cached) for r in first) == [("a", '{"n": 1}', False)] * 3 + [("bb", '{"n": 2}', False)]
    second = ask(["a", "ccc"], day(2))
    assert {r.prompt: r.cached for r in second} == {"a": True, "ccc": False}
    assert sorted(open(log).read().split()) == ["a", "bb", "ccc"]
    ask(["a"], day(2), schema='{"type": "object"}')
    assert open(log).read().split().count("a") == 2
    late = ask(["a"], dt.datetime(2024, 3, 1))
    assert not late[0].cached and open(log).read().split().count("a") == 3
    assert not ask(["a"], dt.datetime(2024, 3, 2), use_cache=False)[0].cached
    (u,) = completion.usage(spark.read.parquet(path)).collect()
    assert (u.call_count, u.total_tokens, u.estimated_cost_usd) == (6, 9 + 6, 3.0)


def test_answers_of_a_failed_run_are_not_asked_for_again(spark, tmp_path):
    path, log, broken = scratch_path(spark, "cache"), str(tmp_path / "calls"), tmp_path / "broken"
    broken.write_text("x")
    plain = counting(log)

    def complete(texts):
        import os

        if os.path.exists(str(broken)) and os.path.exists(log) and len(open(log).read().split()) > 100:
            raise RuntimeError("provider is down")
        return plain(texts)

    df = spark.createDataFrame([(f"p{i}",) for i in range(300)], "prompt string").coalesce(1)
    with pytest.raises(Exception, match="provider is down"):
        completion.complete_batch(df, complete, "m", path, as_of=dt.datetime(2024, 1, 1)).collect()
    sent = open(log).read().split()
    assert 100 < len(sent) < 300
    broken.rename(tmp_path / "mended")
    rows = completion.complete_batch(df, complete, "m", path, as_of=dt.datetime(2024, 1, 2)).collect()
    assert len(rows) == 300 and sum(r.cached for r in rows) == len(sent)
    assert sorted(open(log).read().split()) == sorted(f"p{i}" for i in range(300))
    assert spark.read.parquet(path).count() == 300
    completion.complete_batch(df, complete, "m", path, as_of=dt.datetime(2024, 1, 3)).collect()
    assert spark.read.parquet(path).count() == 300


def test_answers_never_pass_through_the_driver(spark, tmp_path):
    """Estimates leave out that answers are repeated, so nothing may be broadcast by them."""
    path, plan = scratch_path(spark, "cache"), lambda df: df._jdf.queryExecution().executedPlan().toString()
    prompts_ = spark.createDataFrame([(f"p{i % 7}",) for i in range(30)], "prompt string")
    done = completion.complete_batch(prompts_, counting(str(tmp_path / "calls")), "m", path, as_of=dt.datetime(2024, 1, 1))
    assert "SortMergeJoin" in plan(done) and "Broadcast" not in plan(done)
    assert done.count() == 30
    wanted = completion.missing_prompts(done.select("cache_key", "prompt"), spark.read.parquet(path), dt.datetime(2024, 1, 2))
    assert "SortMergeJoin" in plan(wanted) and "Broadcast" not in plan(wanted)
    assert wanted.count() == 0


def test_a_task_that_is_run_again_takes_its_answers(spark, tmp_path):
    log = str(tmp_path / "calls")
    requests = spark.createDataFrame([(f"k{i}", "m", f"p{i}") for i in range(90)], "cache_key string, model string, prompt string").coalesce(1)
    asked = completion.call(requests, counting(log), dt.datetime(2024, 1, 1), 40, staged=str(tmp_path / "staged"))
    first, again = (sorted(map(tuple, asked.collect())) for _ in range(2))
    assert first == again and len(first) == 90 and len(open(log).read().split()) == 90


def test_cache_key_matches_its_definition(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("p",)], "prompt string")
    key = df.select(completion.cache_key(F.lit("m"), df.prompt).alias("k")).first().k
    assert key == hashlib.sha256(b'{"model":"m","prompt":"p","schema":null,"attachments":null}').hexdigest()
    # Parts don't run into each other.
    two = df.select(completion.cache_key(F.lit("m"), F.lit("p"), F.lit("s")), completion.cache_key(F.lit("m"), F.lit("p::s"))).first()
    assert two[0] != two[1]


def test_parsing(spark):
    texts = ['{"a": 1}', '```json\n{"a": 2}\n```', "plain", "{}", "```json\nbroken\n```", "[1]", ' {"a": 3} ']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    got = [json.loads(r.p) for r in df.select("i", completion.parsed(df.c).alias("p")).orderBy("i").collect()]
    assert got == [{"a": 1}, {"a": 2}, {"text": "plain"}, {"text": "{}"}, {"text": texts[4]}, [1], {"a": 3}]


def test_typed_answers(spark):
    answers = spark.createDataFrame(
        [
            ("t", '{"rules": [{"rule_type": "range_check", "column": "age", "params": {"min_value": 0}, "severity": "high", "rationale": "r"}, {"column": "id"}]}'),
            ("u", '{"text": "no rules"}'),
        ],
        "table_name string, parsed string",
    )
    proposed = completion.proposals(answers)
    assert [(p.rule_type, p.column, p.severity, p.confidence) for p in proposed.orderBy("proposal_no").collect()] == [
        ("range_check", "age", "high", 0.0),
        ("null_check", "id", "medium", 0.0),
    ]
    text = completion.proposals_to_yaml(proposed)
    assert yaml.safe_load(text)["rules"][0] == {"type": "range_check", "column": "age", "severity": "high", "params": {"min_value": 0}}
    assert [r.name for r in rules_from_yaml(text)] == ["range_check_age", "null_check_id"]
    failed = spark.createDataFrame([("r", 3, '{"summary": "s", "tags": ["x"]}'), ("q", 1, '{"text": "?"}')], "rule_name string, fail_count bigint, parsed string")
    rows = {r.rule_name: r for r in completion.explanations(failed).collect()}
    assert (rows["r"].summary, rows["r"].tags, rows["r"].affected_rows_estimate) == ("s", ["x"], 3)
    assert (rows["q"].summary, rows["q"].root_cause, rows["q"].tags) == ("No summary available.", "Unknown.", [])


@pytest.mark.parametrize(
    "head, want",
    [
        (b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBB", 13, b"IHDR", 300, 70000, 16, 4), ("PNG", 300, 70000, "LA")),
        (b"GIF89a" + struct.pack("<HHB", 513, 7, 0x80), ("GIF", 513, 7, "P")),
        (struct.pack("<2sIHHIIiiHH", b"BM", 0, 0, 0, 54, 40, 12, -34, 1, 8), ("BMP", 12, 34, "P")),
        (b"\xff\xd8" + b"\xff\xe0\x00\x10" + bytes(14) + b"\xff\xc4\x00\x04ab" + b"\xff\xff\xc2\x00\x0b\x08" + struct.pack(">HHB", 480, 640, 3), ("JPEG", 640, 480, "RGB")),
        (b"\xff\xd8" + b"\xff\xe1\x03\xe8" + bytes(998) * 1 + b"\xff\xc0\x00\x0b\x08" + struct.pack(">HHB", 1, 2, 1), ("JPEG", 2, 1, "L")),
        (b"\xff\xd8\xff\xe0\x00", ("JPEG", None, None, None)),
        (b"\x89PNG", ("PNG", None, None, None)),
        (b"", (None, None, None, None)),
    ],
)
def test_image_headers(spark, head, want):
    df = spark.createDataFrame([(bytearray(head),)], "content binary").select(images.image_header(F.col("content")).alias("h"))
    got = df.select("h.*").first()
    assert tuple(got)[1:] == want[1:] and got["format"] == (want[0] or "unknown")

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from plumbob.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, rows):
    """Pieces cover each row's ids exactly once, and windows are gapless and need little padding."""
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    docs = Counter()
    for (i, _), e in zip(rows, t.encode_batch([x or "" for _, x in rows], add_special_tokens=False)):
        docs[i, tuple(e.ids + [1])] += 1
    by_id = defaultdict(list)
    for i, ids in docs:
        by_id[i].append(ids)
    covered = Counter()
    for p in pieces:
        ids = [x for x in by_id[p.doc_id] if len(x) == p.doc_tokens and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32]
        assert p.length > 0 and ids, p
        for k in range(p.start, p.start + p.length):
            covered[p.doc_id, ids[0], k] += 1
    assert all(covered[i, ids, k] == n for (i, ids), n in docs.items() for k in range(len(ids))) and len(covered) == sum(len(i[1]) for i in docs)
    sizes = []
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
    for ps in windows.values():
        end = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == end
            end += p.length
        assert end <= 2048
        sizes.append(end)
    return sizes


def table(data):
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


def test_query_over_the_table(spark, data):
    sizes = check(queries.op10_lexical_packing(spark, data).collect(), table(data))
    assert all(n & (n - 1) == 0 for n in sizes)


def test_small_shards(spark, data):
    got = packing.pack_documents(spark.read.parquet(f"{data}/documents.parquet"), PATH, 1, shard_tokens=3000).collect()
    assert all(n & (n - 1) == 0 for n in check(got, table(data)))


@pytest.mark.parametrize("rows", [[], [(5, None)], [(3, "a b"), (1, ""), (2, None), (None, "x"), (9, "y " * 9000), (9, "y " * 9000), (9, "z")]])
def test_small_tables(frame, rows):
    got = packing.pack_documents(frame(rows), PATH, 1).collect()
    check(got, rows)
    assert all(zlib.crc32(np.array(p.tokens, "<u4").tobytes()) == p.ids_crc32 for p in got)


def test_counts_and_neighbours(frame):
    rows = [(i, f"{'apple pear plum' if i % 2 else 'steel iron zinc'} {'x' * (i + 1)}") for i in range(40)]
    encoded = packing.encode_documents(frame(rows), PATH, 1)
    counts = packing.document_counts(encoded)
    ids = [np.array(r.tokens, "<u4") for r in encoded.orderBy("doc_id").collect()]
    want = Counter(t for x in ids for t in set(x.tolist()))
    assert counts == want | {-1: 40, -2: sum(map(len, ids))}
    idf = np.zeros(packing.VOCABULARY, np.float32)
    for t, n in want.items():
        idf[t] = np.log(1 + (40 - n + 0.5) / (n + 0.5))
    shard = packing.Shard(ids, idf, sum(map(len, ids)) / 40)
    shard.used[[0, 2]] = True
    near = list(shard.neighbours(0))
    assert not {0, 2} & set(near) and all(d % 2 == 0 for d in near[:18])

    def bm25(q, d):
        score = 0
        for t in set(q.tolist()) & set(d.tolist()):
            tf = (d == t).sum()
            score += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) * 40 / sum(map(len, ids))))
        return score

    scores = [bm25(ids[0], ids[d]) for d in near]
    assert all(a >= b - 1e-4 for a, b in zip(scores, scores[1:]))


def test_windows_keep_neighbours_together():
    rng = np.random.default_rng(0)
    ids = [np.concatenate([rng.integers(100 * (k % 4), 100 * (k % 4) + 100, 500), [1]]).astype("<u4") for k in range(80)]
    n = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=packing.VOCABULARY)
    idf = np.log(1 + (80 - n + 0.5) / (n + 0.5)).astype(np.float32)
    kinds = [{d % 4 for d, *_ in w} for w in packing.windows(ids, idf, 501.0)]
    assert np.mean([len(k) for k in kinds]) < 1.6


def test_long_seeds_score_all_terms():
    rng = np.random.default_rng(5)
    ids = [np.concatenate([rng.integers(0, 60, 100), rng.zipf(1.3, 600) % 3000, [3000 + k]]).astype("<u4") for k in range(60)]
    ids[1] = np.unique(ids[0])[:80].astype("<u4")  # shares frequent terms only
    assert min(len(np.unique(x)) for x in ids[:1] + ids[2:]) > 100
    mean = float(np.mean(list(map(len, ids))))
    n = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=packing.VOCABULARY)
    idf = np.log(1 + (60 - n + 0.5) / (n + 0.5)).astype(np.float32)
    shard = packing.Shard(ids, idf, mean)

    def bm25(q, d):
        tf = Counter(d.tolist())
        norm = packing.K1 * (1 - packing.B + packing.B * len(d) / mean)
        return sum(float(idf[t]) * tf[t] * (packing.K1 + 1) / (tf[t] + norm) for t in set(q.tolist()) if t in tf)

    for seed in (0, 7, 33):
        shard.used[:] = False
        shard.used[seed] = True
        want = [bm25(ids[seed], d) for d in ids]
        near = list(shard.neighbours(seed))
        assert set(near) == {d for d in range(60) if d != seed and want[d] > 0}
        assert all(want[a] >= want[b] - 1e-3 for a, b in zip(near, near[1:]))


def test_a_compact_index_returns_the_same():
    rng = np.random.default_rng(7)
    ids = [np.concatenate([rng.integers(0, 40, 30), rng.zipf(1.3, 200) % 2000]).astype("<u4") for _ in range(90)]
    n = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=packing.VOCABULARY)
    idf = np.log(1 + (90 - n + 0.5) / (n + 0.5)).astype(np.float32)
    whole, compact = (packing.Shard(ids, idf, 230.0) for _ in range(2))
    for gone in (10, 50, 75, 90):
        for shard in (whole, compact):
            shard.used[:gone] = True
        compact.compact()
        for seed in (0, 45, 89):
            assert list(compact.neighbours(seed)) == list(whole.neighbours(seed))
    assert len(whole.held) == 90 and not len(compact.held) and not len(compact.docs)


def test_counted_while_encoding(frame):
    rows = [(i, f"{'apple pear' if i % 2 else 'steel iron'} {'x' * i}" if i else None) for i in range(30)]
    files = packing._encoded(frame(rows), PATH, 1, "doc_id", "text")
    counts = packing.document_counts(files)
    encoded = packing.encode_documents(frame(rows), PATH, 1)
    assert counts == packing.document_counts(encoded) and counts[-1] == 30 and counts[1] == 30
    want = {r.doc_id: r.tokens for r in encoded.collect()}
    got = files.where("slice IS NULL").collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in got} == want and all(2 * r.n_tokens == len(r.ids) for r in got)


def test_stored_hands_out_few_rows(spark, monkeypatch):
    from plumbob.llm import common

    monkeypatch.setattr(common, "BATCH_ROWS", 7)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    got = [r.n for r in common.stored(spark.range(100).mapInArrow(sizes, "n bigint"), "sizes").collect()]
    assert sum(got) == 100 and max(got) <= 7 and spark.conf.get(name) == before

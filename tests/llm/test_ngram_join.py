import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from plumbob.llm import ngram_join as nj
from plumbob.llm import queries
from test_shingles import brute


def groups(rows):
    """Sets, and the rows of each component, by comparing all pairs that share a shingle."""
    sets = [brute(t or "") for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    seen = set()
    for hs in holders.values():
        for a in hs:
            for b in hs:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    k = len(sets[a] & sets[b])
                    if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                        up[find(a)] = find(b)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    return sets, list(members.values())


def components(rows):
    sets, members = groups(rows)
    out = []
    for g in members:
        least = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), least if least is not None else rows[i][0]) for i in g]
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(map(tuple, nj.near_components(df, bucket_bits=14, **kw).collect()), key=str)


def table(data, n=None):
    t = pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"]) for r in t][:n]


def test_query_over_the_table(spark, data):
    got = sorted(map(tuple, queries.op4_adaptive_join(spark, data).collect()), key=str)
    assert got == components(table(data))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def crowd(seed=0):
    """Groups of near copies around the threshold, chains, copies, shared passages and odd rows."""
    rng = random.Random(seed)
    rows = []
    for g in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 120))]
        rows += [edited(rng, words, rng.randint(0, len(words) // 18)) for _ in range(30)]
        chain = words
        for _ in range(12):
            chain = edited(rng, chain, max(1, len(words) // 50)).split(" ")
            rows.append(" ".join(chain))
    passage = [f"p{i}" for i in range(60)]
    rows += [" ".join(passage + [f"x{rng.randrange(10**6)}" for _ in range(rng.randint(5, 40))]) for _ in range(60)]
    rows += ["same text of six words here"] * 25 + ["a b c", "a b c", "a b", "A  B", "", None, " ", "a b c d e", "a b c d e a b c d e"] * 2
    rng.shuffle(rows)
    return [(1000 - 3 * i, t) for i, t in enumerate(rows)] + [(None, "a b c"), (None, "own words only"), (5, rows[0]), (5, rows[1]), (5, None)]


@pytest.mark.parametrize("most, tile", [(nj.CROWDED, nj.TILE), (0, 4)])
def test_crowd(frame, monkeypatch, most, tile):
    """At once, and by rounds with the holders of a shingle spread over many tiles."""
    monkeypatch.setattr(nj, "CROWDED", most)
    monkeypatch.setattr(nj, "STAR_GAIN", 1.0)
    rows = crowd()
    assert run(frame(rows), tile=tile) == components(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(7, "x y")], [(2, "a b c d e f"), (1, "a b c d e f")]])
def test_few(frame, rows):
    assert run(frame(rows)) == components(rows)


def test_prefixes_share_enough():
    """Sets that link share at least the smaller l of their prefixes, whatever the estimates."""
    rng = np.random.default_rng(2)
    for _ in range(400):
        base = rng.choice(10**6, rng.integers(2, 60), replace=False)
        own, other = set(base.tolist()), set(base.tolist())
        for s in (own, other):
            for x in rng.choice(base, rng.integers(0, 1 + len(base) // 8), replace=False).tolist():
                s.discard(x)
            s.update(rng.integers(10**6, 2 * 10**6, rng.integers(0, 1 + len(base) // 8)).tolist())
        k = len(own & other)
        if not own or not other or 100 * k < 80 * (len(own) + len(other) - k):
            continue
        prefixes = []
        for s in (own, other):
            ordered = sorted(s)
            longest = len(s) - nj.needed_overlap(len(s)) + nj.MOST_SHARED
            shared, length = nj.choose_prefix((rng.integers(0, 50, len(ordered)) * rng.integers(0, 2))[:longest], len(s), 80)
            prefixes.append((shared, set(ordered[:length])))
        assert len(prefixes[0][1] & prefixes[1][1]) >= min(prefixes[0][0], prefixes[1][0])


def test_costly_prefixes_grow():
    assert nj.choose_prefix(np.zeros(60), 8, 80)[0] == 1
    assert nj.choose_prefix(np.full(60, 5.0), 100, 80)[0] > nj.choose_prefix(np.zeros(60), 100, 80)[0] > 1


@pytest.mark.parametrize("limit", [nj.BROADCAST_KEYS, 0])
def test_one_stays(frame, monkeypatch, limit):
    monkeypatch.setattr(nj, "BROADCAST_KEYS", limit)
    rows = crowd(4)
    df = frame([(i, t, "en", str(k)) for k, (i, t) in enumerate(rows)])
    got = nj.one_per_group(df, bucket_bits=14)
    assert got.columns == df.columns
    kept = [int(r.source) for r in got.collect()]
    assert len(set(kept)) == len(kept)
    _, members = groups(rows)
    for g in members:
        stay = [k for k in g if k in kept]
        if not brute(rows[g[0]][1] or ""):
            assert stay == g
        else:
            ids = [rows[k][0] for k in g if rows[k][0] is not None]
            assert len(stay) == 1 and rows[stay[0]][0] == min(ids, default=None)


def test_sketches_never_rule_out_a_link():
    """The sketches of two sets differ in no more places than the sets do."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 900), dtype=np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[: rng.integers(0, len(x) + 1)], rng.integers(0, 1 << 63, rng.integers(0, 200), dtype=np.uint64)]))
        a, b = (np.array([c[0].as_py() for c in nj._sketches([s])]) for s in (x, y))
        differ = sum(int(v & (1 << 64) - 1).bit_count() for v in (a ^ b).tolist())
        assert differ <= len(np.setxor1d(x, y))
        assert a.tolist() == [c[0].as_py() for c in nj._sketches([x])]

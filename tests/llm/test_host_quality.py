import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbob.llm import host_quality as hq


def metrics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if n[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
    )


TEXTS = [
    None, "", " \n\t", "a", "a b c a b c", "x\x0by\x0cz\r\nq", "a\na\n a\n\n\na", "#*$%&|<> 😀😀 é", "　a　b c",
    "the cat sat " * 40, "w" * 5000, " ".join(f"w{i}" for i in range(3000)), "a a a a", "one two", "l1\nl1\r\nl1\n",
]


def test_metrics(frame):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(1, "", "en", None), (None, "a b", None, "s")]
    got = hq.judge_documents(frame(rows)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(((i, *metrics(t)) for i, t, *_ in rows), key=str)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not r.base_failed or not r.kept


def test_empty(frame):
    assert hq.judge_documents(frame([])).count() == 0
    assert hq.kept_documents(frame([])).count() == 0


GOOD = " ".join(f"word{i}" for i in range(60))


def mixed(frame, shout=1.0):
    noisy = GOOD + " ###" * 5
    rows = [(i, GOOD + f" {i}", "en", f"good{i % 5}") for i in range(200)]
    rows += [(1000 + i, noisy + f" {i}" if i < 60 * shout else GOOD + f" x{i}", "en", "noisy") for i in range(60)]
    rows += [(2000, noisy, "en", "rare"), (2001, GOOD, "en", None), (2002, "short", "en", "good1")]
    return frame(rows)


def test_hosts_are_rejected_by_their_shrunken_rate(frame):
    got = {r.doc_id: r for r in hq.judge_documents(mixed(frame)).collect()}
    assert all(got[i].kept for i in range(200)) and got[2001].kept
    assert not any(got[1000 + i].kept for i in range(60)) and all(got[1000 + i].host_failed for i in range(60))
    assert not got[2002].kept and not got[2002].host_failed
    assert all(r.kept for r in hq.judge_documents(mixed(frame, 0.3)).where("doc_id between 1000 and 1999").collect())


def test_shrinking(spark, frame):
    rows = hq.with_metrics(mixed(frame), F.col("text"), "m").select(F.col("source").alias("host"), "m.*")
    rates = {(r.host, r.rule): r for r in hq.host_rates(rows).collect()}
    one, many = rates["rare", "symbols"], rates["noisy", "symbols"]
    assert (one.n_failed, one.n_docs) == (1, 1) and one.rate < many.rate <= 1
    assert rates["good1", "few_words"].n_failed == 1 and not rates["good1", "few_words"].rejected


@pytest.mark.parametrize("limit", [hq.BROADCAST_HOSTS, 0])
def test_kept_rows(monkeypatch, frame, limit):
    monkeypatch.setattr(hq, "BROADCAST_HOSTS", limit)
    df = mixed(frame)
    df = df.union(df.where("doc_id = 3"))
    want = sorted(r.doc_id for r in hq.judge_documents(df).where("kept").collect())
    got = hq.kept_documents(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == want


def test_native(frame):
    plan = hq.judge_documents(mixed(frame))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

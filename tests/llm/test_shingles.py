import re

import numpy as np

from plumbob.llm import shingles as sh


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def brute(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


TEXTS = [
    "", " \n\t", "a", "A b", "a b c d", "a b c d e", "a b c d e f", "E d C b a", "a a a a a a a", "É é İ ß 　x y z", "x\x1cy z \x85 q \xa0 r s t",
    "a\r\nb\x0bc\x0cd\te", "ab a b", "a ab b", "the cat sat on the mat the cat sat on the mat", "w" * 70000 + " a b c d e", "a b c d e " + "v" * 70001,
]


def test_sets_agree_with_words(data):
    import pyarrow.parquet as pq

    texts = TEXTS + pq.read_table(f"{data}/documents.parquet").column("text").to_pylist()
    sets = sh.shingle_sets(texts)
    known = {}
    for t, s in zip(texts, sets):
        want = brute(t)
        assert len(s) == len(want) and (np.diff(s.astype(object)) > 0).all()
        for h in s.tolist():
            known.setdefault(h, set())
    # One hash per shingle, and one shingle per hash.
    alone = {w: sh.shingle_sets([" ".join(w)])[0][0] for t in texts for w in brute(t)}
    assert len(set(alone.values())) == len(alone)
    for t, s in zip(texts, sets):
        assert {alone[w] for w in brute(t)} == set(s.tolist())


def test_segments_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join("abcdefg"[: 1 + k % 7] * (1 + k % 3) for k in rng.integers(0, 50, n)) for n in (0, 3, 500, 2000)] + ["z" * 3000, "q" * 500 + " a b c d"]
    want = sh.shingle_sets(texts)
    monkeypatch.setattr(sh, "LONG_WORD", 400)
    whole = sh.shingle_sets(texts)
    for size in (1000, 4096):
        monkeypatch.setattr(sh, "SEGMENT", size)
        assert all((a == b).all() for a, b in zip(sh.shingle_sets(texts), whole))
    assert all((a == b).all() for a, b in zip(want[:4], whole[:4]))

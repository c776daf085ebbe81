import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbob.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
MODEL = bpe.MergeModel(PATH)

ODD = [
    "", " ", "  ", "\n\n a", "a  b", "a   b", "a \n b", "\n b", "a\n\n b", " lead", "trail ", "it's we'll 'tis", "x\x1cy \x1f z",
    "　x y", "x\xa0 y \xa0z", "tab\t\tq", "9 12 ab12", "Ωmega éé Ünï ß", "á̀b ǽ", "<|endoftext|> x", "a<|endoftext|><|endoftext|>b  c",
    "word,word.  end ", "\r\n\x0b\x0c\x85  ", "中文 字\n 中文", "x" * 3000, "aaaaaaa", "ababababa abab", " '", "'s's", "don't’s", "abЖc d",
    "a_b __ 1.2", "😀😀 😀", "퟿", "﻿x", "==========---------- ((((((", "\x00", "0" * 500, "  \n  \n   if (a):\n\t\treturn",
]


def ids(texts):
    return [np.frombuffer(b, "<u4").tolist() for b in MODEL.encode(pa.array(texts, pa.string()))]


def truth(texts):
    return [e.ids for e in LIB.encode_batch(texts, add_special_tokens=False)]


def test_equal_to_the_library(data):
    table = ODD + pq.read_table(f"{data}/documents.parquet").column("text").to_pylist()[:120]
    assert ids(table) == truth(table)
    lists = pa.array(truth(table), pa.list_(pa.int32()))
    assert MODEL.decode(lists) == [LIB.decode(i, skip_special_tokens=False) for i in truth(table)]


def test_every_piece_of_the_vocabulary():
    names = [LIB.decode([i], skip_special_tokens=False) for i in range(LIB.get_vocab_size())]
    assert ids(names) == truth(names)


def test_runs_and_neighbours_in_one_index():
    """Pieces share an index, so merges of one must not reach into the next."""
    rng = random.Random(1)
    pieces = list({"".join(rng.choice("aabehinot") for _ in range(rng.randint(1, 30))).encode() for _ in range(3000)} | {b"a" * n for n in range(1, 40)})
    found = [np.frombuffer(b, "<u4").tolist() for b in MODEL.merge(pieces)]
    assert found == truth([p.decode() for p in pieces])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab thein.\n\té "), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_any_text(texts):
    assert ids(texts) == truth(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_any_ids(some):
    assert MODEL.decode(pa.array([some], pa.list_(pa.int32()))) == [LIB.decode(some, skip_special_tokens=False)]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 1)
    for _ in range(3):
        assert ids(ODD) == truth(ODD)


def test_models_that_are_not_supported(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}, {"normalizer": {"type": "NFC"}}):
        path = tmp_path / "m.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.MergeModel(str(path))


def expected(rows):
    for i, t in rows:
        e = LIB.encode(t or "", add_special_tokens=False).ids
        back = LIB.decode(e, skip_special_tokens=False)
        yield i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(5, None)],
        [(3, "a b"), (1, ""), (2, None), (None, "x"), (9, "y  z " * 5000), (9, "y  z " * 5000), (9, "y")],
        [(1, "long " * 1_100_000), (2, "x" * 200_000), (3, "tail")],
    ],
)
def test_small_tables(frame, rows):
    got = bpe.text_digests(frame(rows), PATH).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(rows), key=str)


def test_query_over_the_table(spark, data):
    t = pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = sorted(map(tuple, queries.op12_pair_index(spark, data).collect()))
    assert got == sorted(expected([(r["doc_id"], r["text"]) for r in t]))

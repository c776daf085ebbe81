import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from plumbob.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = SentencePieceProcessor(model_file=PATH)
MODEL = pieces.PieceModel(PATH)

ODD = [
    "", " ", "   ", "  a  b ", "a\tb\n\nc", "\n \n", "　x", "ＡＢＣ ﬁ", "a▁b▁▁c", "▁", "\x00a", "<s></s><unk><0x0A>",
    "aaaaaaaaaaaaaaaaaaaa", "((((((()))))))", "==========----------", "x" * 999, "日本語のテキスト 😀😀 é é", " \n\n  \n   x",
    "if (a){\n        return;\n    }", "......................", "http://a.b/c?d=e&f=g", "1234567890 1,234.5",
]


def ids(text):
    return np.frombuffer(MODEL.encode(text), "<u4").tolist()


def truth(text):
    return LIB.encode(text, add_bos=True, add_eos=True)


def test_equal_to_the_library(data):
    table = pq.read_table(f"{data}/documents.parquet").column("text").to_pylist()
    for text in ODD + table[:80]:
        assert ids(text) == truth(text), text[:50]
        assert MODEL.decode(ids(text)) == LIB.decode(truth(text))


def test_whole_texts_without_cuts():
    rng = random.Random(1)
    for _ in range(300):
        chunk = "▁" + "".join(rng.choice("abteins.,▁▁(é\n") for _ in range(rng.randint(1, 60)))
        want = LIB.encode(chunk[1:].replace("▁", " "))
        assert np.frombuffer(MODEL.chunk_ids(chunk), "<u4").tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab thein.\n▁é"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(text):
    assert ids(text) == truth(text)
    assert MODEL.decode(ids(text)) == LIB.decode(truth(text))


def test_any_ids():
    rng = random.Random(2)
    for _ in range(500):
        some = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randint(0, 12))]
        assert MODEL.decode(some) == LIB.decode(some), some


def expected(rows):
    for i, t in rows:
        e = truth(t or "")
        yield i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIB.decode(e).encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], [(5, None)], [(3, "a b"), (1, ""), (None, "x"), (9, "y " * 5000), (9, "y " * 5000)]])
def test_small_tables(frame, rows):
    got = map(tuple, pieces.piece_digests(frame(rows), PATH).collect())
    assert sorted(got, key=str) == sorted(expected(rows), key=str)


def test_query_over_the_table(spark, data):
    t = pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = sorted(map(tuple, queries.op3_piece_round_trip(spark, data).collect()))
    assert got == sorted(expected([(r["doc_id"], r["text"]) for r in t]))

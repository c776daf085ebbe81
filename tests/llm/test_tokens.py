import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from plumbob.llm import common, queries, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")

ODD = [
    "", " ", "  ", "\n\n a", "a  b", "it's we'll 'tis", "x\x1cy \x1f z", " 　x y", "tab\t\tq", "9 12 ab12",
    "Ωmega éé Ünï ß", "áb", "<|endoftext|> x", "word,word.  end ", "\r\n\x0b\x0c\x85  ", "中文 字\n", "x" * 3000,
    " '", "'s's", "don't’s", "abЖc d", "a_b __ 1.2",
]


def truth(texts, end):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids + [end] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_equal_whole_texts(data):
    table = pq.read_table(f"{data}/documents.parquet").column("text").to_pylist()
    texts = ODD + table[:60]
    mine = [np.frombuffer(b, "<u4").tolist() + [2] for b in tokens.PieceEncoder(PATH).encode(texts)]
    assert mine == truth(texts, 2)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 1)
    e = tokens.PieceEncoder(PATH)
    assert [e.encode(["a b c"]) for _ in range(3)] == [e.encode(["a b c"])] * 3


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    start, out = 0, []
    for (i, _), ids in zip(rows, truth([t or "" for _, t in rows], 2)):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("rows", [[], [(5, None)], [(3, "a b"), (1, ""), (2, None), (None, "x"), (9, "y " * 5000), (9, "y " * 5000)]])
def test_small_tables(frame, rows):
    got = tokens.token_table(frame(rows), PATH, 2)
    key = lambda r: (r[0] is not None, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(rows), key=key)


def test_files_in_order_with_indexes(spark, frame):
    path = common.scratch(spark, "t")
    tokens.write_tokens(frame([(i, f"text {i}") for i in range(500, 0, -1)]), path, PATH, 2)
    rows = tokens.read_tokens(spark, path).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1, 501))
    assert [r.doc_id for r in tokens.read_tokens(spark, path, 10, 12).orderBy("doc_id").collect()] == [10, 11, 12]
    plan = tokens.read_tokens(spark, path, 10, 12)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10), LessThanOrEqual(doc_id,12)]" in plan
    import glob

    shards = sorted(glob.glob(f"{path}/*.parquet"))
    ids = [pq.read_table(s, columns=["doc_id"]).column(0).to_pylist() for s in shards]
    assert sum(sorted(ids), []) == list(range(1, 501)) and all(i == sorted(i) for i in ids)
    column = pq.ParquetFile(next(s for s, i in zip(shards, ids) if i)).metadata.row_group(0).column(4)
    assert "RLE_DICTIONARY" in column.encodings and column.has_column_index and column.has_offset_index


def test_query_over_the_table(spark, data):
    t = pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = sorted(map(tuple, queries.op2_token_files(spark, data).collect()))
    assert got == expected([(r["doc_id"], r["text"]) for r in t])


ADDED = ["<|endoftext|>", "<|endoftext|> x", "a  <|endoftext|><|endoftext|>\n b", "it's <|endoftext| > <|endoftext|>Ж\x1c", "x" * 50 + " <|endoftext|>"]


def test_added_tokens_as_the_library(frame):
    t = Tokenizer.from_file(PATH)
    want = [t.encode(x, add_special_tokens=False).ids for x in ODD + ADDED]
    assert want[ODD.index("<|endoftext|> x")] == [50256, 2124]
    assert [np.frombuffer(b, "<u4").tolist() for b in tokens.encoder(PATH).encode(ODD + ADDED)] == want
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokens.token_table(frame(list(enumerate(ODD + ADDED))), PATH, 2).collect()}
    assert got == {i: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, x in enumerate(want)}


def test_added_tokens_that_take_text_along(tmp_path):
    from tokenizers import AddedToken

    t = Tokenizer.from_file(PATH)
    t.add_tokens([AddedToken("<pad>", lstrip=True, rstrip=True)])
    t.save(path := str(tmp_path / "t.json"))
    texts = ["a  <pad>  b", "<pad>", "c d"]
    assert [np.frombuffer(b, "<u4").tolist() for b in tokens.encoder(path).encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_any_white_space_and_script_as_the_library(monkeypatch):
    rng = np.random.default_rng(3)
    parts = ["a", "the", "é", "Ж", "字", "'s", "'", "12", "²", "_", "%%%", " ", " ", " ", "\n", "\t", "\x85", "\xa0", "　", "᠎", "\x1c", " ",
             "w" * 120, "<|endoftext|>", "ÿþ", "😀"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)]
    t = Tokenizer.from_file(PATH)
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    e = tokens.PieceEncoder(PATH, added=True)
    for remembered in (1, 1000, 10**6):
        monkeypatch.setattr(tokens, "REMEMBERED", remembered)
        got = [b for k in range(0, 3000, 500) for b in e.encode(texts[k : k + 500])]
        assert [np.frombuffer(b, "<u4").tolist() for b in got] == want


def test_the_library_sees_a_word_once():
    e = tokens.PieceEncoder(PATH, added=True)
    seen = []
    e._latin = lambda ps, run=e._latin: seen.extend(ps) or run(ps)
    e._encode_each = lambda ps, run=e._encode_each: seen.extend(ps) or run(ps)
    for text in ("x word word, word. x", "y word,word word", "word. x word,word"):
        e.encode([text])
    assert len(seen) == len(set(seen)) and seen.count(" word") == 1
    before = len(seen)
    e.encode(["x word word, word. x"] * 50)
    assert len(seen) == before


def test_word_table_grows_and_forgets():
    from plumbob.llm.words import WordTable, word_keys

    words = [f"w{i}" for i in range(5000)]
    raw = np.frombuffer((" ".join(words) + " ").encode(), np.uint8)
    ends = np.flatnonzero(raw == 32)
    a, b = word_keys(raw, np.append(0, ends[:-1] + 1), ends)
    assert len(set(zip(a.tolist(), b.tolist()))) == 5000
    t = WordTable(3000)
    for k in range(0, 5000, 700):
        n = len(a[k : k + 700])
        t.add(a[k : k + 700], b[k : k + 700], np.arange(n) % 3, np.repeat(np.arange(k, k + n), np.arange(n) % 3).astype(np.uint32))
    e = t.find(a, b)
    assert (e >= 0).all() and t.spelled(e[1:3]).tolist() == [1, 2, 2] and (t.find(b, a) < 0).all()
    t.met[e[4001:4003]] = True
    t.shrink()
    e = t.find(a, b)
    assert np.flatnonzero(e >= 0).tolist() == [4001, 4002]
    assert t.spelled(e[4001:4003]).tolist() == [4001] * ((4001 % 700) % 3) + [4002] * ((4002 % 700) % 3)


def test_words_are_cut_between_letters_digits_signs_and_lines():
    rng = np.random.default_rng(11)
    parts = ["a", "Be", "7", "42", ".", ",", "--", "'", "'s", "'ll", "\n", "\n", "\n\n", "\r\n", "\t", " ", " ", "  ", "é", "\x00", "\x7f", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts[: 21 if i % 2 else 22], rng.integers(0, 25))) for i in range(4000)]
    texts += ["\n  foo", "a\n  foo", "a\n foo", "\nfoo", "a\nfoo\n", "a\n\nb", "a.\nb", "a'\n'b", "don't.'s", "x'5", "5'x"]
    t = Tokenizer.from_file(PATH)
    e = tokens.PieceEncoder(PATH, added=True)
    for k in (1, 40, 1000):
        for i in range(0, len(texts), k):
            got = [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts[i : i + k])]
            assert got == [x.ids for x in t.encode_batch(texts[i : i + k], add_special_tokens=False)]
    e = tokens.PieceEncoder(PATH, added=True)
    e.encode(["The word. A word, one word;\nAnd (word) and word9 word"])
    known = e.words.n
    e.encode([f"The {a}word{b} A word" for a in "(.," for b in ".,);"])
    assert e.words.n <= known + 12 and not any("word" in p and "." in p for p in e.pieces)

import re

import pyarrow.parquet as pq

import corpus_pipeline
from plumbob.llm import pii
from test_host_quality import metrics
from test_ngram_join import groups
from test_packing import check


def masked(text, spans):
    out, end = "", 0
    for s in filter(None, spans.split(",")):
        kind, a, b = s.split(":")
        if int(a) >= end:
            out += text[end : int(a)] + f"[{kind.upper()}]"
        end = max(end, int(b))
    return out + text[end:]


def test_against_plain_code(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    rows = [(i, t) for i, t in rows if (m := metrics(t))[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    _, members = groups(rows)
    rows = [min((rows[i] for i in g), key=lambda r: r[0]) for g in members]
    found = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    rows = [(i, masked(t, found[i])) for i, t in rows]
    assert any(re.search(r"\[(EMAIL|IP|CARD|PHONE|SECRET)\]", t) for _, t in rows)
    sizes = check(corpus_pipeline.run(spark, data).collect(), rows)
    assert all(n & (n - 1) == 0 for n in sizes)


def test_stages_keep_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).schema.names == docs.schema.names


def test_empty(spark, frame):
    docs = frame([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0

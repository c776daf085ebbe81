import hashlib

import pytest
from pyspark.sql import functions as F

from plumbob.llm import common, warc

SCHEMA = "page_id bigint, url string, html string, block string, record string, digest string"


def expected(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, p in data:
        same = [j for j, q in data if q == p and j is not None]
        keep = max(same, default=None)
        again = len(p) >= 1000 and keep is not None and i != keep and len([1 for j, q in data if q == p]) > 1
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", keep if again else None, True))
    return sorted(out, key=str)


BIG = "é中\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 40
ROWS = [
    (1, "http://a/", None), (2, None, ""), (3, "http://b/\r\nX: y", BIG), (4, "u", BIG), (9, "u", BIG), (9, "u", BIG), (None, "n", BIG),
    (5, "é", "small"), (6, "z", "small"), (7, "long", "😀x" * 30000), (8, "long", "😀x" * 30000), (10, "one", "y" * 200_000), (10, "one", "y" * 200_000),
    (11, "own", "q" * 999), (12, "own", "q" * 999), (13, "edge", "e" * 1000), (14, "edge", "e" * 1000),
]


@pytest.mark.parametrize("segment", [warc.SEGMENT_BYTES, 1000])
@pytest.mark.parametrize("rows", [[], ROWS])
def test_round_trip(spark, frame, rows, segment):
    path = common.scratch(spark, "w")
    warc.write_archive(frame(rows, SCHEMA), path, segment_bytes=segment)
    assert sorted(map(tuple, warc.read_pages(spark, path).collect()), key=str) == expected(rows)


def test_segments(spark, frame):
    path = common.scratch(spark, "w")
    warc.write_archive(frame([(7, "http://x/", "ab" * 3000)], SCHEMA), path, segment_bytes=1000)
    records = warc.read_records(spark, path)
    rows = sorted(records.collect(), key=lambda r: r.number)
    assert [r.number for r in rows] == list(range(1, len(rows) + 1)) and len(rows) > 6
    assert [r.record_type for r in rows] == ["response"] + ["continuation"] * (len(rows) - 1)
    assert {r.origin for r in rows[1:]} == {rows[0].record_id}
    assert rows[-1].total == sum(len(r.block) for r in rows) and all(r.total is None for r in rows[:-1])
    whole = warc.reassembled(records.orderBy(F.rand(1))).first()
    assert whole.complete and bytes(whole.block) == b"".join(bytes(r.block) for r in rows)
    assert not warc.reassembled(records.where("number <> 3")).first().complete
    assert not warc.reassembled(records.where(f"number <> {len(rows)}")).first().complete
    assert warc.reassembled(records.where("number <> 1")).count() == 0


def test_framing():
    for n in (0, 1, 5, 8191, 8192, 8193, 20000):
        p = bytes(i % 251 for i in range(n))
        assert warc.unchunked(warc.chunked(p)) == p
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: z\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_parser_in_pieces():
    raw = b"".join(r + b"\r\n\r\n" for r in warc.records(1, "u", b"x" * 5000, None, "d", 700))
    whole = list(warc.parse([raw]))
    for n in (1, 7, 1000):
        assert list(warc.parse(raw[i : i + n] for i in range(0, len(raw), n))) == whole
    with pytest.raises(ValueError):
        list(warc.parse([raw[:-600]]))

"""Token windows filled with lexically similar documents.

Documents are encoded once, and written as ids of 16 bits. How many documents hold
each token id is counted meanwhile (the vocabulary bounds this table), then shards of the encoded
documents are packed one by one: a shard's inverted index with BM25 weights over
token ids returns, for the seed of a window, the unused documents most like it,
and they fill the window in that order. The last one is cut where the window
ends, and its rest is the next seed. A shard is bounded by its tokens, so a task
holds one shard whatever the table's size, and nothing but counts is shuffled.
Similar documents of different shards do not meet; the README says how many.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbob.llm import tokens as tok
from plumbob.llm.common import count_slices, count_table, id_lists, list_slices, releasing, stored, text_blocks, texts

WINDOW = 2048
#: Tokens of an index shard; a task holds one at a time.
SHARD_TOKENS = 1 << 22
#: Ids are below this; it bounds the table of document counts.
VOCABULARY = 1 << 16
#: Tokens of a shard that are sorted at a time.
STRETCH = 1 << 18
#: A term that more than one in so many of a shard's documents hold is kept as a row of weights, at most this many times the postings' size.
DENSE = 8
K1, B = 1.2, 0.75


def _distinct(ids: list) -> tuple:
    """``(term, document, times)`` of lists of ids, in order of the terms and then of the documents."""
    import numpy as np

    flat = np.concatenate(ids).astype(np.uint16)
    order = np.argsort(flat, kind="stable")  # 16 bits are sorted without comparisons
    terms, documents = flat[order], np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in ids])[order]
    at = np.flatnonzero(np.append(len(terms) > 0, (terms[1:] != terms[:-1]) | (documents[1:] != documents[:-1])))
    return terms[at].astype(np.int32), documents[at], np.diff(np.append(at, len(terms)))


def _encode(path: str, end_id: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names = ["doc_id", "ids", "n_tokens", "slice", "counts"]
        holders, any_text = np.zeros(VOCABULARY, np.int32), False
        for batch, block in text_blocks(batches):
            ids = [np.frombuffer(b + end, "<u4") for b in tok.encoder(path).encode(block)]
            if max(int(x.max()) for x in ids) >= VOCABULARY:
                raise ValueError(f"token ids must be below {VOCABULARY}")
            holders += np.bincount(_distinct(ids)[0], minlength=VOCABULARY).astype(np.int32)
            any_text = True
            n = len(ids)
            columns = [batch.column("doc_id"), pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary()), pa.array(list(map(len, ids)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if any_text:
            part = count_slices(holders)
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), part.column(0), part.column(1)], names)

    return run


def _encoded(df: DataFrame, tokenizer_path: str, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """``(doc_id, ids, n_tokens)`` of whole texts, the ids in 16 bits, and in rows of their own how many documents of a task hold each id."""
    run = releasing(_encode(tokenizer_path, end_id))
    rows = texts(df, id_column, text_column).mapInArrow(run, "doc_id bigint, ids binary, n_tokens bigint, slice int, counts binary")
    return stored(rows, "packing", whole_texts=True)


def _lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), id_lists([x.astype("<u4").tobytes() for x in _ids(batch)])], ["doc_id", "tokens"])


def encode_documents(df: DataFrame, tokenizer_path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, tokens)`` of whole texts, each with ``end_id`` at its end, written to the shared folder."""
    rows = _encoded(df, tokenizer_path, end_id, id_column, text_column).where("slice IS NULL")
    return rows.select("doc_id", "ids").mapInArrow(_lists, "doc_id bigint, tokens array<int>")


def _ids(batch: pa.RecordBatch) -> list:
    import numpy as np

    if "ids" in batch.schema.names:
        return [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column("ids")]
    return [np.frombuffer(m, "<u4") for m in list_slices(batch.column("tokens"))]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    holders = np.zeros(VOCABULARY, np.int64)
    for batch in batches:
        if batch.num_rows:
            holders += np.bincount(_distinct(_ids(batch))[0], minlength=VOCABULARY)
    yield count_slices(holders)


def document_counts(encoded: DataFrame) -> dict[int, int]:
    """Documents that hold each token id, over the whole table; at -1 all documents, at -2 all tokens."""
    import numpy as np

    if "counts" in encoded.columns:  # counted while they were encoded
        slices, rows = encoded.where("slice IS NOT NULL"), encoded.where("slice IS NULL")
    else:
        slices = encoded.select("tokens").mapInArrow(releasing(_count), "slice int, counts binary")
        rows = encoded.select(F.size("tokens").alias("n_tokens"))
    counts = count_table(slices, VOCABULARY)
    total, documents = rows.agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
    used = np.flatnonzero(counts)
    return dict(zip(used.tolist(), counts[used].tolist())) | {-2: total or 0, -1: documents}


class Shard:
    """An inverted index over a few documents, with BM25 weights from the whole table's counts."""

    def __init__(self, ids: list, idf, mean_length: float):
        import numpy as np

        self.used = np.zeros(len(ids), bool)
        lengths = np.array([len(x) for x in ids], np.int64)
        found, ends = [], np.cumsum(lengths)
        cuts = [0, *(np.flatnonzero(np.diff(ends // STRETCH)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            t, d, tf = _distinct(ids[a:b])
            found.append((t, d + np.int32(a), tf))
        terms, docs, tf = (np.concatenate(c) for c in zip(*found))
        weights = (idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / mean_length)[docs])).astype(np.float32)
        by_document = np.argsort(docs, kind="stable")
        self.queries = np.split(terms[by_document], np.cumsum(np.bincount(docs, minlength=len(ids)))[:-1])  # a query is all distinct terms of a document
        order = np.argsort(terms.astype(np.uint16), kind="stable")
        self.docs, self.weights = docs[order], weights[order]
        self.places = np.searchsorted(terms[order], np.arange(VOCABULARY + 1))
        frequent = np.flatnonzero(np.diff(self.places) * DENSE > len(ids))
        self.row = np.full(VOCABULARY, -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), len(ids)), np.float32)
        for k, t in enumerate(frequent.tolist()):
            a, b = self.places[t], self.places[t + 1]
            self.dense[k, self.docs[a:b]] = self.weights[a:b]
        #: The documents that the index still holds, by their place in it.
        self.held = np.arange(len(ids))

    def compact(self) -> None:
        """Take used documents out of the index once they are half of it; what it returns stays the same."""
        import numpy as np

        free = ~self.used[self.held]
        if 2 * int(free.sum()) > len(free):
            return
        place = np.cumsum(free) - 1
        kept = free[self.docs]
        self.places = np.append(0, np.cumsum(kept))[self.places]
        self.docs, self.weights = place[self.docs[kept]].astype(np.int32), self.weights[kept]
        self.dense = np.ascontiguousarray(self.dense[:, free])
        self.held = self.held[free]

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents that share a term with the seed, best first by the weights of all shared terms; ties by position."""
        import numpy as np

        terms = self.queries[seed]
        rows = self.row[terms]
        scores = np.zeros(len(self.held), np.float32)
        for k in rows[rows >= 0].tolist():
            scores += self.dense[k]
        rare = terms[rows < 0]
        begins, lengths = self.places[rare], self.places[rare + 1] - self.places[rare]
        ends = np.cumsum(lengths)
        at = np.repeat(begins - ends + lengths, lengths) + np.arange(lengths.sum())
        np.add.at(scores, self.docs[at], self.weights[at])
        scores[self.used[self.held]] = 0
        while len(scores):
            best = int(scores.argmax())
            if scores[best] <= 0:
                return
            scores[best] = 0
            yield int(self.held[best])


def windows(ids: list, idf, mean_length: float) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of ``(document, start, length)`` over all tokens of a shard.

    All are full but the last ones: what remains there is cut into windows whose
    lengths are powers of two, which need no padding.
    """
    shard = Shard(ids, idf, mean_length)
    waiting = iter(range(len(ids)))
    window, room = [], WINDOW
    seed, start = next(waiting, None), 0
    rest: list[tuple[int, int, int]] = []

    def fill(document: int, start: int):
        """Put as much of a document into the window as fits; what is left starts at the returned place."""
        nonlocal room
        shard.used[document] = True
        length = min(room, len(ids[document]) - start)
        window.append((document, start, length))
        room -= length
        return start + length

    while seed is not None:
        nearest = None
        leader = seed
        while seed is not None and room:
            start = fill(seed, start)
            if start < len(ids[seed]):
                break  # the window is full and the rest of this document leads the next
            if not room:
                seed = None
                break
            if nearest is None:
                shard.compact()
                nearest = shard.neighbours(leader)
            seed, start = next(nearest, None), 0
            if seed is None:
                seed = next((d for d in waiting if not shard.used[d]), None)
        if room:
            rest = window
            break
        yield window
        window, room = [], WINDOW
        if seed is None:
            seed, start = next((d for d in waiting if not shard.used[d]), None), 0
    size = sum(n for _, _, n in rest)
    while size:
        room = 1 << (size.bit_length() - 1)
        size -= room
        window = []
        while room:
            d, s, n = rest.pop(0)
            take = min(n, room)
            window.append((d, s, take))
            room -= take
            if take < n:
                rest.insert(0, (d, s + take, n - take))
        yield window


def _pack(counts: dict[int, int], with_tokens: bool, shard_tokens: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    documents = counts.get(-1, 0)
    mean_length = max(1.0, counts.get(-2, 0) / max(1, documents))
    terms = [t for t in counts if t >= 0]
    weights = [math.log(1 + (documents - counts[t] + 0.5) / (counts[t] + 0.5)) for t in terms]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        idf = np.zeros(VOCABULARY, np.float32)
        idf[terms] = weights
        sequence = TaskContext.get().partitionId() << 40

        def packed(doc_ids: list, ids: list) -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for window in windows(ids, idf, mean_length):
                offset = 0
                for d, start, length in window:
                    rows.append((doc_ids[d], start, length, ids[d][start : start + length], len(ids[d]), sequence, offset))
                    offset += length
                sequence += 1
            columns = list(zip(*rows))
            blobs = [x.astype("<u4").tobytes() for x in columns[3]]
            arrays = [pa.array(columns[i], pa.int64()) for i in (0, 1, 2)]
            arrays.append(pa.array(list(map(zlib.crc32, blobs)), pa.int64()))
            arrays += [pa.array(columns[i], pa.int64()) for i in (4, 5, 6)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_tokens:
                arrays.append(id_lists(blobs))
                names.append("tokens")
            return pa.RecordBatch.from_arrays(arrays, names)

        doc_ids, ids, size = [], [], 0
        for batch in batches:
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), _ids(batch)):
                doc_ids.append(doc_id)
                ids.append(own)
                size += len(own)
                if size >= shard_tokens:
                    yield packed(doc_ids, ids)
                    doc_ids, ids, size = [], [], 0
        if ids:
            yield packed(doc_ids, ids)

    return run


def pack_documents(
    df: DataFrame, tokenizer_path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", with_tokens: bool = True,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Pieces of documents in windows of at most :data:`WINDOW` tokens, each token in exactly one piece.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if
    asked for, the ``tokens``. ``start`` counts the document's tokens before the
    piece, ``offset`` the window's. A null or empty text is its end id alone;
    repeated rows are packed each; an empty table gives no rows.
    """
    encoded = _encoded(df, tokenizer_path, end_id, id_column, text_column)
    run = releasing(_pack(document_counts(encoded), with_tokens, shard_tokens))
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    rows = encoded.where("slice IS NULL").select("doc_id", "ids")
    return rows.mapInArrow(run, schema + (", tokens array<int>" if with_tokens else ""))

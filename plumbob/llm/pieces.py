"""Merge-type subword encoding by backtracking, and decoding.

The ids are those of a merge encoder that joins the best-scored adjacent pair
again and again, leftmost first. They are found from left to right instead: at
each place the longest piece an Aho-Corasick automaton knows is tried, then its
shorter prefixes, until one is compatible with the piece before it. Two pieces
are compatible if merging their concatenation anew leaves the cut between them
alone, which follows from undoing their merges, latest first. A place that no
piece leaves is marked in a bit field and never tried again, so the work grows
with the length of the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbob.llm.common import id_lists, list_slices, text_blocks, texts

SPACE = "▁"
#: Encoded chunks and compatible pairs that a worker remembers; beyond it starts afresh.
REMEMBERED = 400_000
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


class PieceModel:
    """Pieces, scores and kinds of a merge model whose texts are not normalised."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.ids = {names[i]: i for i in plain}
        scores = sorted({model.get_score(i) for i in plain if len(names[i]) > 1}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        #: When a piece is merged, from 0; pieces of one character are there from the start.
        self.rank = {names[i]: order[model.get_score(i)] for i in plain if len(names[i]) > 1}
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.splits = {n: self._last_merge(n) for n in self.rank}
        # A piece whose merges end before it never arises.
        arising = [n for n in self.ids if self.splits.get(n, ("", ""))]
        self.automaton = ahocorasick.Automaton()
        for name in arising:
            self.automaton.add_word(name, name)
        self.automaton.make_automaton()
        self.shorter = {n: next((n[:k] for k in range(len(n) - 1, 1, -1) if self.splits.get(n[:k])), n[:1]) for n in arising}
        # A cut is safe between two characters that follow each other in no piece.
        within = {a + b for n in self.ids for a, b in zip(n, n[1:])}
        self.whole = any(b[1] == SPACE and b[0] != SPACE for b in within) or any("\n" in b for b in within)
        letters = re.findall(f"[{LETTERS}]", "".join(map(chr, range(256))))
        stops = [c for c in map(chr, range(128)) if not c.isalpha() and not any(a + c in within for a in letters)]
        self.chunk = re.compile(
            f"{SPACE}*[{LETTERS}]+(?=[{re.escape(''.join(stops))}{SPACE}]|\\Z)|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"
        )
        self.decoded = [b""] * size
        for i in plain:
            self.decoded[i] = names[i].replace(SPACE, " ").encode()
        for value, i in self.byte_ids.items():
            self.decoded[i] = bytes([value])
        self.decoded[self.unknown] = " ⁇ ".encode()
        self.control = {i for i in range(size) if model.is_control(i)}
        self.starts_blank = {i for i in plain if names[i].startswith(SPACE)}
        self.id_bytes = {n: i.to_bytes(4, "little") for n, i in self.ids.items()}
        self.known = _Known(self)
        self.pairs: dict[tuple[str, str], bool] = {}
        if model.encode("　 Ａ  ﬁ ", out_type=str) != self._names("　 Ａ  ﬁ "):
            raise ValueError("only models that leave texts as they are and put a blank before them are supported")

    def _names(self, text: str) -> list[str]:
        names = {i: n for n, i in self.ids.items()} | {i: f"<0x{b:02X}>" for b, i in self.byte_ids.items()}
        import numpy as np

        return [names[i] for i in np.frombuffer(self.encode(text), "<u4")[1:-1].tolist()]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes ``piece``; None if its merges end before it."""
        parts, last = list(piece), None
        while len(parts) > 1:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                return None
            i = best[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return last

    def compatible(self, left: str, right: str) -> bool:
        limit = len(self.rank) + 1  # a merge over the cut counts if it comes before this one
        while True:
            if self.rank.get(left + right, limit) < limit:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            # The later merge is undone first; of equal ones the right one came later.
            if a > b:
                limit, left = a, self.splits[left][1]
            else:
                limit, right = b + 1, self.splits[right][0]

    def pieces(self, chunk: str) -> list[str]:
        """The pieces of one chunk."""
        n, pairs, shorter = len(chunk), self.pairs, self.shorter
        longest = list(chunk)
        for end, name in self.automaton.iter(chunk):
            start = end + 1 - len(name)
            if len(name) > len(longest[start]):
                longest[start] = name
        failed, found, place, piece = bytearray(n + 1), [], 0, longest[0]
        while True:
            after = place + len(piece)
            fits = not failed[after]
            if fits and found:
                key = (found[-1], piece)
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.compatible(*key)
            if fits:
                found.append(piece)
                if after == n:
                    return found
                place, piece = after, longest[after]
            elif len(piece) > 1:
                piece = shorter[piece]
            else:
                failed[place] = 1
                piece = found.pop()
                place -= len(piece)

    def chunk_ids(self, chunk: str) -> bytes:
        return b"".join([self.id_bytes.get(p) or self._no_piece(p) for p in self.pieces(chunk)])

    def _no_piece(self, character: str) -> bytes:
        ids = [self.byte_ids[b] for b in character.encode()] if self.byte_ids else [self.unknown]
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text with the begin and end ids, as little-endian unsigned 32-bit integers."""
        edge = (self.begin.to_bytes(4, "little"), self.end.to_bytes(4, "little"))
        if not text:
            return edge[0] + edge[1]
        line = SPACE + text.replace(" ", SPACE)
        chunks = [line] if self.whole else self.chunk.findall(line)
        for memory in (self.known, self.pairs):
            if len(memory) > REMEMBERED:
                memory.clear()
        return edge[0] + b"".join(map(self.known.__getitem__, chunks)) + edge[1]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: blanks for their mark, less the one put before the text; no control ids.

        A byte that is part of no character becomes U+FFFD.
        """
        begin, end = 0, len(ids)
        while begin < end and ids[begin] in self.control:
            begin += 1
        while begin < end and ids[end - 1] in self.control:
            end -= 1
        ids = ids[begin:end]
        if not self.control.isdisjoint(ids):  # one within ends a run of bytes
            parts = [[]]
            for i in ids:
                parts.append([]) if i in self.control else parts[-1].append(i)
        else:
            parts = [ids]
        raws = [b"".join(map(self.decoded.__getitem__, p)) for p in parts]
        if ids and ids[0] in self.starts_blank:
            raws[0] = raws[0][1:]
        return "".join(map(self._text, raws))

    @staticmethod
    def _text(raw: bytes) -> str:
        out, place = [], 0
        while place < len(raw):
            try:
                out.append(raw[place:].decode())
                break
            except UnicodeDecodeError as e:
                out.append(raw[place : place + e.start].decode() + "\ufffd")
                place += e.start + 1
        return "".join(out)


class _Known(dict):
    """The ids of chunks, encoded when first asked for."""

    def __init__(self, model: PieceModel):
        self.model = model

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = self.model.chunk_ids(chunk)
        return ids


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The model of this worker; it outlives tasks."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _encode(path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in text_blocks(batches):
            encode = piece_model(path).encode
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), id_lists([encode(t) for t in block])], ["doc_id", "ids"])

    return run


def encode_pieces(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, ids)``: whole texts as ids of the model at ``model_path``, with the begin and end ids.

    A null text is empty and gives these two ids alone. Every row gives one
    row, so repeated rows and null ids stay; other columns are ignored.
    """
    return texts(df, id_column, text_column).mapInArrow(_encode(model_path), "doc_id bigint, ids array<int>")


def _decode(path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    import numpy as np

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decode = piece_model(path).decode
            parts = list(list_slices(batch.column("ids")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(p) // 4 for p in parts], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in parts]),
                    pa.array([decode(np.frombuffer(p, "<u4").tolist()) for p in parts], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "text"],
            )

    return run


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, text)`` of the ids of :func:`encode_pieces`.

    ``ids_sha256`` is over the ids as little-endian unsigned 32-bit integers.
    """
    return encoded.mapInArrow(_decode(model_path), "doc_id bigint, n_tokens bigint, ids_sha256 string, text string")


def piece_digests(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode, decode the ids, and describe both: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    back = decode_pieces(encode_pieces(df, model_path, id_column, text_column), model_path)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))

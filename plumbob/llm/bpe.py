"""Byte-level BPE by an index of pair occurrences, and decoding.

A task cuts its texts where the tokenizer cuts them and lays the distinct pieces
it has not met end to end. An index maps each mergeable pair to all its
positions there. The active ranks are applied in ascending order, each to all
its positions at once, leftmost first where they overlap; the pairs that a merge
makes with its neighbours are added to the index under their ranks. A merge only
makes pairs of later ranks (checked when a model is read), so every rank is
applied once, and the ids are those of merging each piece by itself.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbob.llm.common import id_lists, list_slices, texts
from plumbob.llm.tokens import BEYOND_LATIN, DISPUTED, LATIN

#: Bytes of text whose pieces are indexed together; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Encoded words and pieces that a worker remembers; beyond it starts afresh. It saves time and changes no result.
REMEMBERED = 300_000
SEPARATOR = b"\xff"  # in no UTF-8 text

# White space in any script, for Arrow's patterns.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Beside a blank, white space makes longer pieces; a single blank always starts a piece.
RUN = f" {WHITE}|{WHITE} "


def _byte_characters() -> dict[str, int]:
    """The characters that stand for bytes: printable Latin-1 itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeModel:
    """Merges, ids and bytes of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if odd or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level models that leave texts as they are are supported")
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.byte_of = _byte_characters()
        self.unmap = {ord(c): b for c, b in self.byte_of.items()}
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = [vocab[a] for a, _ in pairs]
        self.right = [vocab[b] for _, b in pairs]
        self.made = [vocab[a + b] for a, b in pairs]
        first_made: dict[int, int] = {}
        for rank, z in enumerate(self.made):
            first_made.setdefault(z, rank)
        if len(first_made) < len(pairs) or any(first_made.get(x, -1) >= r for r, ab in enumerate(zip(self.left, self.right)) for x in ab):
            raise ValueError("only models whose merges make pairs of later ranks are supported")
        self.size = max(vocab.values()) + 1
        keys = np.array(self.left, np.int64) * self.size + np.array(self.right, np.int64)
        self.rank_order = np.argsort(keys)
        self.keys = np.append(keys[self.rank_order], np.iinfo(np.int64).max)
        self.rank_order = np.append(self.rank_order, 0)
        self.byte_ids = np.full(256, -1, np.int32)
        for c, b in self.byte_of.items():
            if b != SEPARATOR[0]:
                self.byte_ids[b] = vocab[c]
        added = sorted(spec.get("added_tokens") or [], key=lambda t: -len(t["content"]))
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
            raise ValueError("added tokens that take the text around them along are not supported")
        self.added = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in added}
        self.added_pattern = "|".join(re.escape(t["content"]) for t in added)
        self.added_split = re.compile(f"({self.added_pattern})") if added else None
        names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in added}
        self.spelled = pa.array([self._bytes(names.get(i, "")) for i in range(max(names) + 1)], pa.binary())
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str | bytes, bytes] = {}

    def _bytes(self, token: str) -> bytes:
        if all(c in self.byte_of for c in token):
            return bytes(map(self.byte_of.__getitem__, token))
        return token.encode()

    # -- cutting

    def cut(self, text: str) -> list[str | bytes]:
        """Pieces that are encoded by themselves: as text where all of it is Latin-1, else as bytes."""
        if not DISPUTED.search(text) and not BEYOND_LATIN.search(text):
            return LATIN.findall(text)
        return [piece.translate(self.unmap).encode("latin-1") for piece, _ in self.cutter.pre_tokenize_str(text)] if text else []

    # -- merging

    def _ranks(self, left, right):
        """Rank of each pair of ids, -1 for none."""
        import numpy as np

        keys = left.astype(np.int64) * self.size + right
        keys[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.rank_order[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces, as little-endian unsigned 32-bit integers."""
        import numpy as np

        if not pieces:
            return []
        raw = np.frombuffer(SEPARATOR.join([b"", *pieces, b""]), np.uint8)
        ids = self.byte_ids[raw]
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list] = {}  # positions of each active rank's pair

        def add(ranks, positions) -> None:
            hit = np.flatnonzero(ranks >= 0)
            if not len(hit):
                return
            if len(hit) < 8:
                for rank, p in zip(ranks[hit].tolist(), positions[hit].tolist()):
                    if rank in index:
                        index[rank].append([p])
                    else:
                        index[rank] = [[p]]
                        heappush(active, rank)
                return
            order = hit[np.argsort(ranks[hit], kind="stable")]
            sorted_ranks, sorted_positions = ranks[order], positions[order]
            cuts = [0, *(np.flatnonzero(np.diff(sorted_ranks)) + 1).tolist(), len(order)]
            for a, b, rank in zip(cuts, cuts[1:], sorted_ranks[cuts[:-1]].tolist()):
                if rank in index:
                    index[rank].append(sorted_positions[a:b])
                else:
                    index[rank] = [sorted_positions[a:b]]
                    heappush(active, rank)

        active: list[int] = []
        add(self._ranks(ids[:-1], ids[1:]), np.arange(n - 1))
        heapify(active)
        while active:
            rank = heappop(active)
            found = index.pop(rank)
            a, b, z = self.left[rank], self.right[rank], self.made[rank]
            at = np.asarray(found[0] if len(found) == 1 else np.concatenate(found))
            partner = after[at]
            there = (ids[at] == a) & (ids[partner] == b)
            if not there.all():
                at, partner = at[there], partner[there]
                if not len(at):
                    continue
            if a == b and len(at) > 1:  # of a run, every second pair
                at = np.sort(at)
                starts = np.append(True, at[1:] != after[at[:-1]])
                begins = np.flatnonzero(starts)
                at = at[(np.arange(len(at)) - begins[np.cumsum(starts) - 1]) % 2 == 0]
                partner = after[at]
            ids[at], ids[partner] = z, -2
            following, preceding = after[partner], before[at]
            after[at], before[following] = following, at
            right = ids[following]
            add(self._ranks(np.full(len(at), z, np.int32), right), at)
            left = ids[preceding]
            other = left != z  # else the pair has just been added from its left side
            add(self._ranks(left[other], np.full(int(other.sum()), z, np.int32)), preceding[other])
        ends = np.flatnonzero(ids == -1)
        kept = ids >= 0
        cuts = (4 * np.cumsum(kept)[ends]).tolist()
        flat = ids[kept].astype("<u4").tobytes()
        return [flat[x:y] for x, y in zip(cuts, cuts[1:])]

    # -- texts

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of stretches of text that no piece crosses."""
        for memory in (self.words, self.pieces):
            if len(memory) > REMEMBERED:
                memory.clear()
        known, pieces = self.words, self.pieces
        fresh = [w for w in words if w not in known]
        cuts = [self.cut(w) for w in fresh]
        new = list({p for ps in cuts for p in ps if p not in pieces})
        pieces.update(zip(new, self.merge([p.encode() if isinstance(p, str) else p for p in new])))
        known.update(zip(fresh, [b"".join(map(pieces.__getitem__, ps)) for ps in cuts]))
        return list(map(known.__getitem__, words))

    def _long_text(self, text: str) -> bytes:
        """A text with white space beside blanks or an added token: cut as a whole."""
        parts = self.added_split.split(text) if self.added_split else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.added[part])
            elif part:
                cut = self.cut(part)
                new = list({p for p in cut if p not in self.pieces})
                self.pieces.update(zip(new, self.merge([p.encode() if isinstance(p, str) else p for p in new])))
                out.extend(map(self.pieces.__getitem__, cut))
        return b"".join(out)

    def encode(self, block: pa.StringArray) -> list[bytes]:
        """The ids of whole texts, as little-endian unsigned 32-bit integers."""
        import numpy as np

        whole = pc.match_substring_regex(block, f"{RUN}|[\\x1c-\\x1f]" + (f"|{self.added_pattern}" if self.added else ""))
        lists = pc.split_pattern(block.filter(pc.invert(whole)), " ")
        offsets = np.asarray(lists.offsets)
        words = lists.flatten()
        starts = offsets[:-1] - offsets[0]
        coded = words.dictionary_encode()
        first = words.take(pa.array(starts)).dictionary_encode()
        # A word follows a blank, but for a text's first.
        table = [" " + w for w in coded.dictionary.to_pylist()] + first.dictionary.to_pylist()
        places = np.array(coded.indices)
        places[starts] = len(coded.dictionary) + np.asarray(first.indices)
        spelled = pa.array(self._word_ids(table), pa.binary()).take(pa.array(places))
        ends = np.frombuffer(spelled.buffers()[1], np.int32, len(spelled) + 1, 4 * spelled.offset)
        flat = memoryview(spelled.buffers()[2] or b"")
        cuts = ends[offsets - offsets[0]].tolist()
        quick = iter([bytes(flat[a:b]) for a, b in zip(cuts, cuts[1:])])
        return [self._long_text(block[i].as_py()) if w else next(quick) for i, w in enumerate(whole.to_pylist())]

    def decode(self, ids: pa.ListArray) -> list[str]:
        """The texts of lists of ids; bytes that are part of no character become U+FFFD."""
        import numpy as np

        offsets = np.asarray(ids.offsets)
        spelled = self.spelled.take(ids.flatten())
        ends = np.frombuffer(spelled.buffers()[1], np.int32, len(spelled) + 1, 4 * spelled.offset)
        flat = memoryview(spelled.buffers()[2] or b"")
        cuts = ends[offsets - offsets[0]].tolist()
        return [str(flat[a:b], "utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


_models: dict[str, MergeModel] = {}


def merge_model(path: str) -> MergeModel:
    """The model of this worker; it outlives tasks."""
    if path not in _models:
        _models[path] = MergeModel(path)
    return _models[path]


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``BLOCK_BYTES`` in one column."""
    start = size = 0
    values = batch.column(column)
    lengths = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    for i, length in enumerate(pc.fill_null(lengths, 0).to_pylist()):
        size += length
        if size >= BLOCK_BYTES or i + 1 == batch.num_rows:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0


def _encode(path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch, "text"):
                ids = merge_model(path).encode(pc.fill_null(part.column("text"), ""))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), id_lists(ids)], ["doc_id", "ids"])

    return run


def encode_texts(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, ids)``: whole texts as ids of the model file, its added tokens included, no others put in.

    A null text is empty and has no ids. Every row gives one row, so repeated
    rows and null ids stay; other columns are ignored.
    """
    return texts(df, id_column, text_column).mapInArrow(_encode(model_path), "doc_id bigint, ids array<int>")


def _decode(path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch, "ids"):
                ids = part.column("ids")
                slices = list(list_slices(ids))
                columns = [
                    part.column("doc_id"),
                    pa.array([len(s) // 4 for s in slices], pa.int64()),
                    pa.array([hashlib.sha256(s).hexdigest() for s in slices], pa.string()),
                    pa.array(merge_model(path).decode(ids), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "text"])

    return run


def decode_texts(encoded: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, text)`` of the ids of :func:`encode_texts`.

    ``ids_sha256`` is over the ids as little-endian unsigned 32-bit integers.
    """
    return encoded.mapInArrow(_decode(model_path), "doc_id bigint, n_tokens bigint, ids_sha256 string, text string")


def text_digests(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode, decode the ids, and describe both: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    back = decode_texts(encode_texts(df, model_path, id_column, text_column), model_path)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))

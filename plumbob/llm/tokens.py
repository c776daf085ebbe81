"""Token ids of documents in Parquet files that allow selective reads.

The files hold ``(doc_id, n_tokens, shard, shard_start, tokens)`` in ascending
order of the ids. Token lists are dictionary-coded (the dictionary is the
vocabulary, so it always fits its page; beyond it the writer falls back to delta
coding), row groups and pages have set sizes, and the column and page indexes
let a reader fetch a few documents, or the lengths alone, without the tokens.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import compress
from operator import not_

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbob.llm.common import id_lists, list_slices, scratch, text_blocks, texts

#: Encoded words, and pieces, that a worker remembers; beyond it words not met again go. It saves time and changes no result.
REMEMBERED = 1_000_000
#: Words of more bytes are not remembered, and a text that holds one is cut as a whole.
LONG = 100

FORMAT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}

# The pieces into which byte-level pre-tokenisation cuts a text,
# in Latin-1, where the classes of letters and digits can be written out.
LATIN = re.compile(
    r" ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9²³¹¼½¾]+| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]+|\s+(?!\S)|\s+"
)
# In any text: such pieces are never joined, but may be several.
PIECE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\x00-@\[-`{-\x7f]|\Z)| ?\S+|\s+(?!\S)|\s+")
BEYOND_LATIN = re.compile("[^\x00-\xff]")
# White space for Python only, so such a text is encoded as one piece.
DISPUTED = re.compile("[\x1c-\x1f]")
# Words between blanks that may not be pieces of their own: with white space at an end, or of disputed class. And the same in a line of them.
BLURRED = re.compile("\\A\\s|\\s\\Z|\\A\\Z|[\x1c-\x1f\u180e]")
BLURRED_LINE = re.compile(" \\s|\\s |\\s\\Z|[\x1c-\x1f\u180e]")
# Bytes that no text has: one begins a word, one is between pieces.
MARK, CUT = 0xFF, 0xFE
# Kinds of bytes: letters, digits and signs of ASCII, which never share a piece; apostrophes, which may begin one; line ends; all others are 0.
LETTER, DIGIT, SIGN, APOSTROPHE, LINE_END = range(1, 6)
KINDS = bytes(
    LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else APOSTROPHE if b == 39 else SIGN if 32 < b < 127 else LINE_END if b == 10 else 0
    for b in range(128)
) + bytes(128)


class PieceEncoder:
    """Byte-level BPE by the tokenizers library, for each distinct word of text once.

    Texts are cut at blanks and between letters, digits and signs of ASCII, and
    words that are not known yet where the tokenizer itself always cuts, so the
    ids are those of the whole text. A text with other
    white space beside a blank is cut as a whole. Pieces in Latin-1 go to the
    library's model in the characters that stand for their bytes; all others to
    the whole tokenizer. The ids of a text are returned as little-endian unsigned
    32-bit integers. The strings of the tokenizer's added tokens are ordinary
    text, or with ``added`` have their own ids, as by the library's default.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from plumbob.llm.words import WordTable

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        strings = sorted((t.content for t in tokens), key=len, reverse=True)
        own = re.compile(f"({'|'.join(map(re.escape, strings))})") if strings else None
        self.added = own if added else None
        #: Such a token may take the text around it along, so a text that holds it is not cut.
        self.joined = added and any(t.single_word or t.lstrip or t.rstrip for t in tokens)
        #: Words do not show whether a text holds such a token.
        self.spaced = self.added if any(" " in s for s in strings) else None
        self.strings = [t.encode() for t in strings] if added else []
        self.model = self._model()
        #: The ids of words with nothing before them, and of others with a blank.
        self.words = WordTable(REMEMBERED)
        #: The ids of pieces of new words, and of texts that are cut as a whole.
        self.pieces: dict[str, bytes] = {}

    def _model(self):
        """A tokenizer that takes pieces in the characters of their bytes, one a line, if the file's is of the usual kind."""
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        characters = pre_tokenizers.ByteLevel.alphabet()
        plain = [b for b in range(256) if chr(b) in characters]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        if spec["model"].get("type") != "BPE" or len(plain) + 68 != 256 or self.tokenizer.model.token_to_id(chr(MARK)) is None:
            return None
        self.characters = np.zeros(256, np.uint32)
        self.characters[plain] = plain
        self.characters[[b for b in range(256) if chr(b) not in characters]] = np.arange(256, 256 + 68)
        self.characters[CUT] = ord("\n")
        self.mark = self.tokenizer.model.token_to_id(chr(MARK))
        model = Tokenizer(self.tokenizer.model)
        model.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        return model

    @staticmethod
    def cut(text: str) -> list[str]:
        if not text.isascii() and BEYOND_LATIN.search(text):
            return [text] if DISPUTED.search(text) else PIECE.findall(text)
        return [text] if DISPUTED.search(text) else LATIN.findall(text)

    def _pieces(self, text: str) -> list[str]:
        if not self.added or not self.added.search(text):
            return self.cut(text)
        if self.joined:
            return [text]
        parts = self.added.split(text)  # every second one is an added token
        return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self.cut(part))]

    def _apart(self, word: str) -> bool:
        """Whether the ids of a blank and a word are the same in any text."""
        return not BLURRED.search(word) and not (self.joined and self.added.search(word))

    def _usual(self, text: str) -> bool:
        """Whether :data:`LATIN` cuts a text as the tokenizer does."""
        return not DISPUTED.search(text) and not BEYOND_LATIN.search(text) and not (self.added and self.added.search(text))

    def encode(self, block: list[str]) -> list[bytes]:
        import numpy as np

        from plumbob.llm.words import FIRST, LINE, word_keys

        if not block:
            return []
        if len(self.pieces) > REMEMBERED // 10:
            self.pieces = {}
        table = self.words
        table.most = REMEMBERED
        table.shrink()
        parts = [t.encode() for t in block]
        data = b" ".join([*parts, b""])  # a blank ends each text's last word
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(raw == 32)
        begins = np.append(0, ends[:-1] + 1)
        kinds = np.frombuffer(KINDS, np.uint8)[raw]
        usual = bool(self.model) and not any(t in data for t in self.strings)
        inner = self._inner(kinds) if usual else begins[:0]
        begins, ends = (np.sort(np.concatenate([x, inner]), kind="stable") for x in (begins, ends))
        texts = np.cumsum([0] + [len(p) + 1 for p in parts])
        heads = np.searchsorted(begins, texts[:-1])
        bare = np.zeros(len(begins), bool)  # first words, and what is cut off another, have no blank before them
        bare[heads] = bare[np.searchsorted(begins, inner)] = True
        first, second = word_keys(raw, begins, ends)
        first[bare] ^= FIRST
        line = np.searchsorted(begins, inner[kinds[inner] == LINE_END])
        first[line] ^= LINE  # alone between two words, and not before other white space
        found = table.find(first, second)
        missing = np.flatnonzero(found < 0)
        table.met[found[found >= 0]] = True
        if len(missing):
            one = missing[np.unique(first[missing], return_index=True)[1]]
            one = one[ends[one] - begins[one] <= LONG]
            others = np.zeros(len(raw) + 1, np.int32)
            np.cumsum(kinds != LETTER, out=others[1:])
            plain = usual & (begins[one] < ends[one]) & (others[begins[one]] == others[ends[one]])

            def words(at) -> list[str]:
                return b" ".join([data[x:y] for x, y in zip(begins[at].tolist(), ends[at].tolist())]).decode().split(" ")

            plain |= np.isin(one, line)
            for at, blank in ((one[plain & ~bare[one]], " "), (one[plain & bare[one]], "")):
                if len(at):  # of letters alone, or a line end, so a piece each
                    blobs = self._latin([blank + w for w in words(at)])
                    table.add(first[at], second[at], np.array(list(map(len, blobs)), np.int64) // 4, np.frombuffer(b"".join(blobs), "<u4"))
            for at, learn in ((one[~plain & ~bare[one]], self._learn), (one[~plain & bare[one]], self._learn_heads)):
                if len(at):
                    learn(words(at))
            found[missing] = table.find(first[missing], second[missing])
        # Texts with words that could not be learned are cut as a whole.
        whole = set(np.searchsorted(heads, np.flatnonzero(found < 0), "right").tolist())
        if self.spaced:
            whole.update(i for i, t in enumerate(block, 1) if self.spaced.search(t))
        there = found >= 0
        totals = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.where(there, table.lengths[found], 0), out=totals[1:])
        flat = table.spelled(found[there]).astype("<u4", copy=False).tobytes()
        cuts = (4 * totals[[*heads, len(found)]]).tolist()
        return [self._joined([self._pieces(t)])[0] if i in whole else flat[x:y] for i, (t, x, y) in enumerate(zip(block, cuts, cuts[1:]), 1)]

    @staticmethod
    def _inner(kinds):
        """Where a piece always begins without a blank before it: between two kinds, and around the line end between two words."""
        import numpy as np

        alike = (kinds >= LETTER) & (kinds <= SIGN)
        begun = np.flatnonzero((kinds[1:] != kinds[:-1]) & alike[1:] & alike[:-1]) + 1
        lines = np.flatnonzero(kinds[1:-1] == LINE_END) + 1
        before, after = kinds[lines - 1], kinds[lines + 1]
        lines = lines[(before >= LETTER) & (before <= APOSTROPHE) & (after >= LETTER) & (after <= APOSTROPHE)]
        return np.sort(np.concatenate([begun, lines, lines + 1]), kind="stable")

    def _remember(self, spelled: dict[str, bytes], heads: bool = False) -> None:
        import numpy as np

        from plumbob.llm.words import FIRST

        first, second = self._keys(list(spelled))
        ids = np.frombuffer(b"".join(spelled.values()), "<u4")
        self.words.add(first ^ FIRST if heads else first, second, np.array([len(x) // 4 for x in spelled.values()], np.int64), ids)

    @staticmethod
    def _keys(words: list[str]):
        import numpy as np

        from plumbob.llm.words import word_keys

        raw = np.frombuffer(" ".join([*words, ""]).encode(), np.uint8)
        ends = np.flatnonzero(raw == 32)
        return word_keys(raw, np.append(0, ends[:-1] + 1)[: len(ends)], ends)

    def _learn_heads(self, words: list[str]) -> None:
        """Remember the ids of first words; white space before them changes nothing."""
        words = [w for w in words if not w or self._apart(w.lstrip())]
        self._remember(dict(zip(words, self._joined([self._pieces(w) for w in words]))), heads=True)

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of words with a blank before them, but of those that the text around them may change."""
        pieces, table = self.pieces, self.words
        learned = {}
        line, other = " " + " ".join(words), []
        if BLURRED_LINE.search(line) or not self._usual(line) or not self.model:
            words = list(filter(self._apart, words))
            other = [w for w in words if not self.model or not self._usual(w)]
            words = list(set(words).difference(other))
            line = " " + " ".join(words)
        if words:
            cut = LATIN.findall(line)  # a blank begins a word and is nowhere else
            spelled, new, begun = {}, [], []
            for p in set(cut):
                if p[0] == " ":
                    begun.append(p)
                elif p in pieces:
                    spelled[p] = pieces[p]
                else:
                    new.append(p)
            # What a word begins with may be a known word by itself.
            entries = table.find(*self._keys([p[1:] for p in begun])).tolist()
            begins, lengths, ids = table.begins, table.lengths, table.ids
            for p, e in zip(begun, entries):
                if e < 0:
                    new.append(p)
                else:
                    spelled[p] = ids[begins[e] : begins[e] + lengths[e]].tobytes()
            for p, blob in zip(new, self._latin(new)):
                spelled[p] = blob
                if p[0] == " ":
                    learned[p[1:]] = blob
                else:
                    pieces[p] = blob
            blobs = list(map(spelled.__getitem__, cut))
            starts = [i for i, p in enumerate(cut) if p[0] == " "]
            learned.update(zip(words, [blobs[a] if b - a == 1 else b"".join(blobs[a:b]) for a, b in zip(starts, [*starts[1:], len(cut)])]))
        learned.update(zip(other, self._joined([self._pieces(" " + w) for w in other])))
        if learned:
            self._remember(learned)

    def _joined(self, cuts: list[list[str]]) -> list[bytes]:
        """The ids of each list of pieces."""
        pieces = self.pieces
        fresh = list({p for ps in cuts for p in ps if p not in pieces})
        # What PIECE cuts may be several pieces.
        usual = [self.model and self._usual(p) and LATIN.match(p).end() == len(p) for p in fresh]
        latin = list(compress(fresh, usual))
        pieces.update(zip(latin, self._latin(latin)))
        other = list(compress(fresh, map(not_, usual)))
        pieces.update(zip(other, self._encode_each(other)))
        return [b"".join(map(pieces.__getitem__, ps)) for ps in cuts]

    def _latin(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that :data:`LATIN` has cut. Marks and cuts are written as lone surrogates, for bytes that no text has."""
        import numpy as np

        if not pieces:
            return []
        line = "\udcff\udcfe" + "\udcfe\udcff\udcfe".join(pieces)
        raw = np.frombuffer(line.encode("utf-8", "surrogateescape"), np.uint8)
        spelled = self.characters[raw].tobytes().decode("utf-32-le")
        ids = np.array(self.model.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
        at = (4 * np.flatnonzero(ids == self.mark)).tolist()
        flat = ids.tobytes()
        return [flat[a + 4 : b] for a, b in zip(at, [*at[1:], len(flat)])]

    def _encode_each(self, pieces: list[str]) -> list[bytes]:
        import numpy as np

        encoded = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(encoded.ids, "<u4").tobytes()
        cuts = (4 * np.searchsorted(np.array(encoded.word_ids, np.int64), np.arange(len(pieces) + 1))).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this worker, with the ids of added tokens; it outlives tasks."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path, added=True)
    return _encoders[path]


def _encode_shard(path: str, end_id: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        shard, done = TaskContext.get().partitionId(), 0
        for batch, block in text_blocks(batches):
            blobs = [b + end for b in encoder(path).encode(block)]
            counts = np.array([len(b) // 4 for b in blobs], np.int64)
            ends = done + np.cumsum(counts)
            columns = [
                batch.column("doc_id"),
                pa.array(counts),
                pa.array(np.full(len(blobs), shard, np.int32)),
                pa.array(ends - counts),
                id_lists(blobs),
            ]
            done = int(ends[-1])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "shard", "shard_start", "tokens"])

    return run


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode whole texts and write their ids in ascending order of ``id_column``.

    The ids of a document end with ``end_id``. A null text is empty, a null id
    comes first; rows of one id follow each other in the order of a hash of
    their texts, so repeated rows are kept. An empty table gives files without
    rows. Ranges are sampled from the table before anything is encoded, and a
    range is sorted on disk if it must be, so a task holds a block of texts only.
    """
    order = ("doc_id", "tie")
    ranged = (
        texts(df, id_column, text_column)
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )
    ranged.mapInArrow(
        _encode_shard(tokenizer_path, end_id),
        "doc_id bigint, n_tokens bigint, shard int, shard_start bigint, tokens array<int>",
    ).write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """``(doc_id, n_tokens, shard, shard_start, tokens)``, all or of a range of ids.

    The range reaches the scan, where page indexes skip everything else.
    """
    df = spark.read.parquet(path)
    if first_id is not None:
        df = df.where(F.col("doc_id") >= first_id)
    return df if last_id is None else df.where(F.col("doc_id") <= last_id)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, before)``: ids in all shards before each. Reads no tokens; one row per shard."""
    sizes = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = pa.array([zlib.crc32(ids) for ids in list_slices(batch.column("tokens"))], pa.int64())
        columns = [batch.column(n) for n in ("doc_id", "shard", "shard_start", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*columns, sums], ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``."""
    rows = read_tokens(spark, path).mapInArrow(
        _digest, "doc_id bigint, shard int, shard_start bigint, n_tokens bigint, ids_crc32 bigint"
    )
    # One row per shard, so its size is bounded by the number of files.
    return rows.join(F.broadcast(starts(spark, path)), "shard").select(
        "doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_table(df: DataFrame, tokenizer_path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write the ids of ``df`` to files in the shared folder and describe what the files hold."""
    path = scratch(df.sparkSession, "tokens")
    write_tokens(df, path, tokenizer_path, end_id, id_column, text_column)
    return token_digests(df.sparkSession, path)

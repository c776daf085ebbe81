"""A bounded table from words to their token ids, looked up for all words of a block at once.

Words are told apart by two 64-bit hashes, each a polynomial over its own random
numbers for a word's bytes.
"""

from __future__ import annotations

import numpy as np

from plumbob.llm.shingles import _BYTES, _mixed, _powers_to

#: Words are hashed in stretches of about so many bytes; a longer word has no hash.
STRETCH = 1 << 17
#: What tells a text's first word from the same word after a blank.
FIRST = np.uint64(0x5851F42D4C957F2D)
#: And a line end between two words from any other.
LINE = np.uint64(0x2545F4914F6CDD1D)
_OTHER = np.random.Generator(np.random.PCG64(20250311)).integers(0, 1 << 64, 256, dtype=np.uint64)


def word_keys(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word of ``raw``, given by ascending places."""
    keys = np.zeros((2, len(begins)), np.uint64)
    power, inverse = _powers_to(STRETCH)
    i = 0
    while i < len(begins):
        at = int(begins[i])
        j = int(np.searchsorted(ends, at + STRETCH, "right"))
        if j <= i:
            i += 1
            continue
        part = raw[at : ends[j - 1]]
        a, b = begins[i:j] - at, ends[i:j] - at
        back, length = inverse[a], (b - a).astype(np.uint64)
        sums = np.zeros(len(part) + 1, np.uint64)
        for row, values in zip(keys, (_BYTES, _OTHER)):
            np.cumsum(values[part] * power[: len(part)], out=sums[1:])
            row[i:j] = _mixed((sums[b] - sums[a]) * back + length)
        i = j
    return keys[0], keys[1]


class WordTable:
    """Ids by the hashes of words. Beyond ``most`` words, only those met again since stay."""

    def __init__(self, most: int):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.n = self.used = 0
        self.keys = np.zeros((2, 1024), np.uint64)
        self.begins, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.met = np.zeros(1024, bool)
        self.ids = np.zeros(4096, np.uint32)
        self._deal(1 << 12)

    def _deal(self, size: int) -> None:
        self.slots = np.full(size, -1, np.int32)
        self.shift = np.uint64(65 - size.bit_length())
        self._place(np.arange(self.n))

    def _place(self, entries: np.ndarray) -> None:
        at = (self.keys[0, entries] >> self.shift).astype(np.int64)
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]  # of several for one slot, one stays
            left = self.slots[at] != entries
            entries, at = entries[left], (at[left] + 1) & (len(self.slots) - 1)

    def shrink(self) -> None:
        """Forget words, if there are too many."""
        if self.n <= self.most:
            return
        kept = np.flatnonzero(self.met[: self.n])
        if len(kept) > self.most // 2:
            kept = kept[-(self.most // 2) :]
        keys, lengths = self.keys[:, kept], self.lengths[kept]
        ids = self.spelled(kept)
        self._clear()
        self.add(keys[0], keys[1], lengths, ids)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The entry of each word, -1 for none."""
        at = (first >> self.shift).astype(np.int64)
        found = self.slots[at]
        open_ = np.flatnonzero((found >= 0) & ((self.keys[0][found] != first) | (self.keys[1][found] != second)))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            now = self.slots[at[open_]]
            found[open_] = now
            open_ = open_[(now >= 0) & ((self.keys[0][now] != first[open_]) | (self.keys[1][now] != second[open_]))]
        return found

    def add(self, first: np.ndarray, second: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Words that are not there, no two the same, with their ids end to end."""
        n, used = self.n + len(first), self.used + len(ids)
        if n > len(self.met):
            more = max(n, 2 * len(self.met)) - len(self.met)
            self.keys = np.pad(self.keys, ((0, 0), (0, more)))
            self.begins, self.lengths, self.met = (np.pad(x, (0, more)) for x in (self.begins, self.lengths, self.met))
        if used > len(self.ids):
            self.ids = np.pad(self.ids, (0, max(used, 2 * len(self.ids)) - len(self.ids)))
        new = slice(self.n, n)
        self.keys[0, new], self.keys[1, new], self.lengths[new] = first, second, lengths
        self.begins[new] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : used] = ids
        self.used = used
        fresh, self.n = np.arange(self.n, n), n
        if 2 * n > len(self.slots):
            self._deal(1 << (4 * n).bit_length())
        else:
            self._place(fresh)

    def spelled(self, entries: np.ndarray) -> np.ndarray:
        """The ids of entries, end to end."""
        lengths = self.lengths[entries]
        ends = np.cumsum(lengths)
        if not len(ends):
            return np.zeros(0, np.uint32)
        return self.ids[np.repeat(self.begins[entries] - ends + lengths, lengths) + np.arange(ends[-1])]

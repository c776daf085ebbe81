"""Sets of word shingles of whole texts, as sorted 64-bit hashes.

Words are runs of characters other than ASCII white space, with A-Z in lower
case. Hashing works on the bytes of many texts at once: a word's hash is a
polynomial over random numbers for its bytes, mixed; a shingle's is mixed from
its words' in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

BLANKS = b"\t\n\x0b\x0c\r "
#: Texts are hashed in segments of about so many bytes; a longer word is hashed by itself.
SEGMENT = 1 << 20
LONG_WORD = 1 << 16

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS)] = True
_EACH_BLANK = [BLANKS[i : i + 1] for i in range(len(BLANKS))]
_BLANK = re.compile(rb"[\t-\r ]")
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def _segment_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the words of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    blank = _IS_BLANK[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    if not len(begins):
        return np.zeros(0, np.uint64), begins
    power, inverse = _powers_to(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * power[: len(raw)], out=sums[1:])
    hashes = _mixed((sums[ends] - sums[begins]) * inverse[begins])
    for i in np.flatnonzero(ends - begins > LONG_WORD):
        hashes[i] = _long_word(data[begins[i] : ends[i]])
    return hashes, begins


def _long_word(word: bytes) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(word))


def _segments(data: bytes) -> Iterator[tuple[int, int]]:
    """Parts of about :data:`SEGMENT` bytes that end after white space or at the end."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        if end < len(data):
            cut = max(data.rfind(b, at, end) for b in _EACH_BLANK)
            if cut < at:
                found = _BLANK.search(data, end)
                cut = found.start() if found else len(data) - 1
            end = cut + 1
        yield at, end
        at = end


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of all words, segment by segment."""
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, end in _segments(data):
        if end - at > SEGMENT:  # a part without white space but at its end: one word
            word = data[at:end].strip(BLANKS)
            hashes.append(np.array([_long_word(word)], np.uint64))
            places.append(np.array([at + data[at:end].index(word[:1])]))
        else:
            h, p = _segment_hashes(data[at:end])
            hashes.append(h)
            places.append(p + at)
    return np.concatenate(hashes), np.concatenate(places)


def shingle_sets(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """The sorted set of each text's shingles; of fewer words the whole sequence; empty without words."""
    parts = [t.encode().lower() for t in texts]  # of bytes, lower() changes A-Z only
    hashes, places = word_hashes(b"\n".join(parts))
    starts = np.cumsum([0] + [len(p) + 1 for p in parts])
    cuts = np.searchsorted(places, starts).tolist()
    rolled = hashes
    if len(hashes) >= size:
        rolled = hashes[: len(hashes) - size + 1].copy()
        for k in range(1, size):
            rolled = _mixed(rolled + np.uint64(k)) + hashes[k : len(hashes) - size + 1 + k]
        rolled = _mixed(rolled)
    sets = []
    for a, b in zip(cuts, cuts[1:]):
        if b - a >= size:
            sets.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            h = hashes[a : a + 1]
            for k in range(1, b - a):
                h = _mixed(h + np.uint64(k)) + hashes[a + k : a + k + 1]
            sets.append(_mixed(h ^ np.uint64(0x5851F42D4C957F2D * (b - a) & (1 << 64) - 1)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets

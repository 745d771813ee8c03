"""Word shingles of whole columns of texts, hashed in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
#: Bytes that are hashed at once, and bytes of texts that a worker takes at once.
BLOCK, SLICE = 1 << 18, 1 << 19
_power: np.ndarray | None = None


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    """Powers of the base modulo 2**64."""
    global _power
    if _power is None or len(_power) < n:
        _power = np.cumprod(np.full(max(n, 1 << 12), _BASE, np.uint64))
    return _power


def word_hashes(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offset at which each text's words begin); words are runs of bytes that are no white space.

    fold: A-Z count as a-z. Null texts have no words. Bytes are read in blocks of about BLOCK that end between
    words, so that beside the result memory does not grow with the texts.
    """
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    if last == first:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8, last - first, first)
    offsets = offsets - first
    hashes, starts, at = [], [], 0
    while at < len(data):
        to = _between_words(data, min(at + BLOCK, len(data)))
        cuts = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
        got, where = _hashed(data[at:to], cuts, fold)
        hashes.append(got)
        starts.append(where + at)
        at = to
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def _between_words(data: np.ndarray, at: int) -> int:
    """The first place from at on where no word is cut."""
    while at < len(data):
        near = np.flatnonzero(_SPACE[data[at - 1 : at + 4096]])
        if len(near):
            return at + int(near[0])
        at += 4096
    return len(data)


def _hashed(data: np.ndarray, cuts: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the words of a block; a word ends at white space and where a text begins (cuts)."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[cuts] = inside[cuts]  # a text's first byte begins a word even if the text before ends with one
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.uint64), start
    # polynomial hash of each word by its bytes' places within it
    at = np.flatnonzero(inside)
    letters = np.diff(np.searchsorted(at, np.append(start, len(data))))
    place = np.arange(len(at)) - np.repeat(np.cumsum(letters) - letters, letters)
    power = _powers(int(letters.max()) + 1)
    value = (_FOLD[data[at]] if fold else data[at].astype(np.uint64)) + np.uint64(1)
    value *= power[place]
    return mix(np.add.reduceat(value, np.cumsum(letters) - letters)), start


def by_bytes(batch: pa.RecordBatch, column: int, size: int = SLICE, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes in a column of texts and at most so many rows; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, before + size, "right"))), at + rows)
        yield batch.slice(at, to - at)
        at = to


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of k words of each text; fewer words: the whole sequence as one; none: empty."""
    words, at = word_hashes(texts)
    grams = shingled(words, k)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(np.array([_sequence(words[a:b])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingled(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on (of all texts together; places near a text's end run over it)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total = (total + words[i : len(words) - k + 1 + i]) * _MIX[2 + i % 4]
        total ^= total >> np.uint64(29)
    return mix(total)


def _sequence(words: np.ndarray) -> np.uint64:
    total = np.zeros(1, np.uint64)
    for w in words:
        total = (total + w) * _MIX[2]
        total ^= total >> np.uint64(29)
    return mix(total + np.uint64(len(words)))[0]

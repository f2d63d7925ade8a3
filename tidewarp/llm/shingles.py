"""Word hashes and shingle sets of whole texts, computed on the bytes of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 18  # bytes hashed at a time, for which some 30 bytes each are held; a segment ends at white space
_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _segment_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of a run of bytes; words also end at ``cuts``."""
    word = ~_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] |= word[cuts]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.empty(0, np.uint64), start
    at = np.flatnonzero(word)
    nth = np.cumsum(begins)[at] - 1
    place = at - start[nth]
    h = _BYTE[data[at]] * _PLACE[place & 0xFFF] + (place >> 12).astype(np.uint64)
    first = np.searchsorted(at, start)
    size = np.diff(np.append(first, len(at))).astype(np.uint64)
    return mix(np.add.reduceat(h, first) + size * _TURN[15]), start


def word_hashes(texts: pa.Array):
    """(hashes, counts): 64-bit hashes of the lower-cased (A-Z) words of all texts in turn, and each text's number of
    words. Words are runs without space and the controls 9 to 13; a null text has none."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    buffer = texts.buffers()[2]
    lo, hi = int(ends[0]), int(ends[-1])
    data = np.frombuffer(buffer, np.uint8, hi - lo, lo) if buffer is not None and hi > lo else np.empty(0, np.uint8)
    ends = ends - lo
    hashes, starts, at = [], [], 0
    while at < len(data):
        to = min(at + SEGMENT, len(data))
        if to < len(data):  # end the segment before a word that would be cut, or after a word longer than a segment
            space = np.flatnonzero(_SPACE[data[at:to]])
            doc = ends[np.searchsorted(ends, to, "right") - 1]
            if doc > at:
                to = int(doc)
            elif len(space):
                to = at + int(space[-1]) + 1
            else:
                end = int(ends[np.searchsorted(ends, to, "left")])
                while to < end and not _SPACE[data[to]]:
                    to = min(to + SEGMENT, end) if not _SPACE[data[to:to + SEGMENT]].any() else to + int(np.argmax(_SPACE[data[to:to + SEGMENT]]))
        inside = ends[np.searchsorted(ends, at, "left"):np.searchsorted(ends, to, "left")] - at
        h, s = _segment_words(data[at:to], inside)
        hashes.append(h)
        starts.append(s + at)
        at = to
    hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    starts = np.concatenate(starts) if starts else np.empty(0, np.int64)
    return hashes, np.diff(np.searchsorted(starts, ends, "left"))


def shingle_sets(texts: pa.Array, width: int):
    """The sorted set of ``width``-word shingle hashes of each text, one uint64 array after the other; a text with fewer
    words has its whole sequence as one shingle, a text without words the empty set. Works on a few megabytes of text
    at a time, so memory follows the longest text and not the batch."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = lengths[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(lengths, done + SEGMENT, "right")))
        yield from _sets(texts.slice(at, to - at), width)
        at = to


def _sets(texts: pa.Array, width: int):
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    total = len(words)
    if total >= width:
        rolled = words[:total - width + 1] * _TURN[0]
        for i in range(1, width):
            rolled = rolled + words[i:total - width + 1 + i] * _TURN[i]
        rolled = mix(rolled)
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= width:
            yield np.unique(rolled[end - n:end - width + 1])
        elif n:
            yield mix((words[end - n:end] * _TURN[:n]).sum(keepdims=True) + _TURN[14] - np.array([n], np.uint64))
        else:
            yield np.empty(0, np.uint64)

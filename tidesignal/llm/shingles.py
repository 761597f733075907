"""Shingle sets of whole texts, from the bytes of an Arrow column and without an object for each word.

Words are runs of bytes other than ASCII white space, with A-Z read as a-z. A word's hash is a polynomial over its bytes modulo
2**64, taken as a difference of running sums, then mixed; a shingle's hash is a weighted sum of its words' hashes, mixed again. Text
is read in windows of about ``WINDOW`` bytes that end between words, so working memory doesn't grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes read at a time; longer words are hashed on their own.
WINDOW = 1 << 18

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_BASE = 0xD6E8FEB86659FD93
_SPACES = b" \t\n\v\f\r"


def _powers(base: int) -> np.ndarray:
    out, block = np.ones(WINDOW + 1, np.uint64), 1
    while block <= WINDOW:  # by doubling
        part = out[block : 2 * block]
        part[:] = out[: len(part)] * np.uint64(pow(base, block, 1 << 64))
        block *= 2
    return out


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
_LETTER = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(_SPACES)] = False
_WEIGHT = np.random.default_rng(8).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _M[1]
    x ^= x >> np.uint64(27)
    x *= _M[2]
    x ^= x >> np.uint64(31)
    return x


def _word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a window, and where each begins; ``starts`` are the places at which a text begins."""
    inside = _IN_WORD[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts = starts[starts < len(raw)]
    first[starts] = inside[starts]
    before = starts[starts > 0] - 1
    last[before] = inside[before]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(raw) <= WINDOW:
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_LETTER[raw] * _UP[: len(raw)], out=total[1:])
        return mix((total[b] - total[a]) * _DOWN[a] + (b - a).astype(np.uint64) * _M[0]), a
    return np.array([xxhash.xxh64_intdigest(raw[x:y].tobytes().lower()) for x, y in zip(a, b)], np.uint64), a  # one long word


def _windows(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of at most ``WINDOW`` bytes that end at the end of a text or between words; longer for a longer word only."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + WINDOW, end)
        if to < end:
            k = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[k] > at:
                to = int(offsets[k])
            else:  # inside one text
                gaps = np.flatnonzero(~_IN_WORD[raw[at:to]])
                stop = int(offsets[k + 1])
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                else:
                    while to < stop and _IN_WORD[raw[to]]:
                        more = np.flatnonzero(~_IN_WORD[raw[to : min(to + WINDOW, stop)]])
                        to = to + int(more[0]) if len(more) else min(to + WINDOW, stop)
        yield at, to
        at = to


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of the whole sequence where it has fewer words."""
    if not len(texts):
        return
    raw, offsets = _text_bytes(texts)
    row, held = 0, []  # held: hashes of the words of a text that spans windows
    for a, b in _windows(raw, offsets):
        h, at = _word_hashes(raw[a:b], offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a)
        while row < len(texts) and offsets[row + 1] <= a and offsets[row + 1] < b:  # empty texts
            yield _set(np.concatenate(held) if held else h[:0], n)
            held, row = [], row + 1
        ends = offsets[row + 1 : np.searchsorted(offsets, b, "right")] - a  # texts that end in this window
        cuts = np.searchsorted(at, ends)
        x = _shingles(h, n)
        low = 0
        for high in cuts.tolist():
            if held:
                yield _set(np.concatenate([*held, h[low:high]]), n)
                held = []
            elif high - low >= n:
                yield _distinct(x[low : high - n + 1].copy())
            else:
                yield _set(h[low:high], n)
            low, row = high, row + 1
        if low < len(h) or (row < len(texts) and offsets[row] < a):
            held.append(h[low:].copy())
    while row < len(texts):
        yield _set(np.concatenate(held) if held else np.zeros(0, np.uint64), n)
        held, row = [], row + 1


def _shingles(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        return h[:0]
    x = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        x += h[k : k + len(x)] * _WEIGHT[k]
    return mix(x)


def _set(h: np.ndarray, n: int) -> np.ndarray:
    return _distinct(_shingles(h, min(n, len(h)))) if len(h) else np.zeros(0, np.uint64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]

"""Words and shingles of Arrow text columns as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS_IN_SHINGLE = 5
SEGMENT = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_letters = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_fold = np.arange(256)
_fold[65:91] += 32
LETTERS = _letters[_fold]  # A-Z count as a-z
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; tables up to a segment are kept."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _powers:
        both = []
        for base in (_ODD, _INVERSE):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            both.append(np.cumprod(run, dtype=np.uint64))
        if size > 4 * SEGMENT:
            return both[0], both[1]
        _powers[size] = (both[0], both[1])
    return _powers[size]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), at


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a word also ends where the next text starts."""
    blank = IS_BLANK[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:], after[-1], after[:-1] = True, blank[:-1], True, blank[1:]
    inner = starts[(starts > 0) & (starts < len(data))]
    before[inner], after[inner - 1] = True, True
    return np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1


def _hash_segment(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * up[: len(data)], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first])


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each word. Long data are taken in segments that end between words."""
    if len(data) <= SEGMENT or not len(first):
        return _hash_segment(data, first, last) if len(first) else np.empty(0, np.uint64)
    out, at = [], 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(last, first[at] + SEGMENT, "right")))
        low, high = first[at], last[to - 1]
        out.append(_hash_segment(data[low:high], first[at:to] - low, last[at:to] - low))
        at = to
    return np.concatenate(out)


def groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, next row, word hashes, word bounds of the rows), for rows of about SEGMENT bytes together."""
    data, at = texts(column)
    row = 0
    while row < len(at) - 1:
        to = max(row + 1, int(np.searchsorted(at, at[row] + SEGMENT, "right")) - 1)
        own, starts = data[at[row] : at[to]], at[row : to + 1] - at[row]
        if len(own):
            first, last = word_spans(own, starts[:-1])
            yield row, to, word_hashes(own, first, last), np.searchsorted(first, starts)
        else:
            yield row, to, np.empty(0, np.uint64), np.zeros(to - row + 1, np.int64)
        row = to


_STEPS = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C5)]


def shingles(words: np.ndarray) -> np.ndarray:
    """Hash of each run of five words; of the whole text where it has fewer."""
    n = len(words)
    if not n:
        return words
    k = min(n, WORDS_IN_SHINGLE)
    out = words[: n - k + 1] * _STEPS[0] + np.uint64(k)
    for i in range(1, k):
        out = mix(out) + words[i : n - k + 1 + i] * _STEPS[i]
    return mix(out)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for row, to, words, bounds in groups(column):
        for k in range(row, to):
            yield k, distinct(shingles(words[bounds[k - row] : bounds[k - row + 1]]))


def set_id(hashes: np.ndarray) -> int:
    """Signed 64-bit identity of a set; 0 for the empty one."""
    if not len(hashes):
        return 0
    sums = np.array([mix(hashes).sum(), np.bitwise_xor.reduce(mix(hashes + _ODD))], np.uint64)
    sums = mix(sums + np.array([0, len(hashes)], np.uint64))
    x = int(mix(sums[:1] * _STEPS[1] + sums[1:])[0]) or 1
    return x - (1 << 64) if x >= 1 << 63 else x


def set_ids(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit identities of many sets: the runs of ``values`` from ``first`` on."""
    values = values.astype(np.uint64)
    if not len(first):
        return values
    sums, crossed = np.add.reduceat(mix(values), first), np.bitwise_xor.reduceat(mix(values + _ODD), first)
    return mix(mix(sums) * _STEPS[1] + mix(crossed + sizes.astype(np.uint64)))

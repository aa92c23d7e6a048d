"""Words of whole Arrow batches as 64-bit hashes, without Python objects per word.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` in the UTF-8 text. All arithmetic is modulo
2**64: a word's hash is a polynomial in its bytes, a sequence's hash a polynomial in its words, so every window
comes from two prefix sums. Hashes are mixed with lengths; equal text has equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _STEP = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
CHUNK = 1 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + U(salt * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_PLAIN = mix(np.arange(256, dtype=U), 7)
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _PLAIN[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: U, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = U(pow(int(base), -1, 1 << 64))
        have = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (base, inverse))
        _powers[int(base)] = have
    return have[0][:n], have[1][:n]


def text_slices(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about ``limit`` bytes; a null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def _pieces(space: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut a long run of bytes where no word is cut."""
    begin, total = 0, len(space)
    while total - begin > 2 * CHUNK:
        gap = np.flatnonzero(space[begin + CHUNK:])
        edge = bounds[np.searchsorted(bounds, begin + CHUNK)]
        end = min(int(edge), begin + CHUNK + int(gap[0]) if len(gap) else total)
        yield begin, end
        begin = end
    yield begin, total


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word, and the first word of each text (with the total at the end)."""
    space = _SPACE[data]
    starts, ends, hashes = [], [], []
    for lo, hi in _pieces(space, bounds):
        if hi == lo:
            continue
        word = ~space[lo:hi]
        cut = np.zeros(hi - lo + 1, bool)
        cut[bounds[(bounds >= lo) & (bounds <= hi)] - lo] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | cut[1:-1]
        last[:-1] &= ~word[1:] | cut[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = powers(_BASE, hi - lo + 1)
        value = (_LOWER if lower else _PLAIN)[data[lo:hi]]
        total = np.concatenate([np.zeros(1, U), np.cumsum(value * up[:-1], dtype=U)])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(U)))
        starts.append(s + lo)
        ends.append(e + lo)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(len(bounds), np.int64)
    s, e, h = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    return s, e, h, np.searchsorted(s, bounds)


def windows(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` words, by its first word (also runs that cross texts)."""
    if len(h) < k:
        return np.zeros(0, U)
    return spans(h, np.arange(len(h) - k + 1), np.full(len(h) - k + 1, k), salt)


def spans(h: np.ndarray, start: np.ndarray, length: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of runs of words of any length."""
    up, down = powers(_STEP, len(h) + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h, salt) * up[:-1], dtype=U)])
    return mix((total[start + length] - total[start]) * down[start] + length.astype(U), salt + 1)


def ragged(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: the group of each member, and its place in the group."""
    group = np.repeat(np.arange(len(count)), count)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def batch(schema: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema)

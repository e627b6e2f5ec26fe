"""Words, shingles and their 64-bit hashes for whole Arrow batches, in numpy.

A word's hash is a polynomial over random 64-bit values of its bytes, taken as the difference of two
prefix sums; so a batch costs a few passes over its bytes and no Python loop over words. Batches
are cut into slices of a bounded number of bytes; only a single text beyond that bound is taken
alone, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, and 5 modulo 8
_rng = np.random.Generator(np.random.PCG64(20240611))
VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: Values of bytes, with A-Z as a-z.
LOWER_VALUES = VALUES[_LOWER]
#: For normalised words: ASCII letters, digits and all bytes beyond ASCII; the rest parts words.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  glibc only
except (OSError, AttributeError):
    _LIBC = None

_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base or of its inverse modulo 2**64."""
    got = _powers[kind]
    if len(got) < n:
        size = 1 << (n - 1).bit_length()
        step = U(_BASE if kind == "up" else pow(_BASE, -1, 1 << 64))
        all_ = np.full(size, step, U)
        all_[0] = 1
        got = np.multiply.accumulate(all_)
        if size <= 4 * SLICE_BYTES:
            _powers[kind] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def trim() -> None:
    """Give memory that this worker doesn't use back to the system; idle workers share their executor's memory with busy ones."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with at most so many bytes, or of one row. Null counts as empty."""
    column = column.cast(pa.large_string()) if column.type not in (pa.large_string(), pa.large_binary()) else column
    if column.null_count:
        column = column.fill_null("" if column.type == pa.large_string() else b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    trim()


def words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the bytes, and the number of the first word of each text (with the total at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~parts[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = LOWER_VALUES) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, U)
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum(values[data] * _power("up", len(data))[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("down", len(data))[starts]
    return mix(raw + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def join_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of consecutive words; depends on their order and number."""
    out = np.full(len(parts[0]), U(0x2545F4914F6CDD1D * (2 * len(parts) + 1) % (1 << 64)), U)
    for p in parts:
        out = mix(out * U(0x9FB21C651E98DF25) + p)
    return out


def shingles(word_hashes: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All k-word shingles of the texts, with the number of the first shingle of each; a text of 1 to k-1 words has one, of all of them."""
    counts = np.diff(firsts)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(int(first[-1]), U)
    total = len(word_hashes)
    if total >= k:
        windows = join_hashes([word_hashes[i : total - k + 1 + i] for i in range(k)])
        at = np.arange(int(first[-1])) + np.repeat(firsts[:-1] - first[:-1], n)
        out = windows[np.minimum(at, len(windows) - 1)]
    for row in np.flatnonzero((counts > 0) & (counts < k)):
        a, b = firsts[row], firsts[row + 1]
        out[first[row]] = join_hashes([word_hashes[i : i + 1] for i in range(a, b)])[0]
    return out, first


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of the column; empty for null and for texts without words."""
    for _, data, offsets in slices(column):
        starts, ends, firsts = words(data, offsets)
        all_, first = shingles(hashes(data, starts, ends), firsts, k)
        for i in range(len(offsets) - 1):
            yield np.unique(all_[first[i] : first[i + 1]])

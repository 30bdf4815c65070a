"""Vectorised word splitting and n-gram hashing for Arrow batches (small per-task helpers).

Words are maximal runs of bytes that do not separate. A word's hash has 64 bits and is not linear in its bytes: lanes of
eight bytes are mixed one after another, and a word of more than ``MOST_LANES`` of them is hashed by BLAKE2b. Hashes find
candidates; what decides compares the words (``exact_ids``) or a cryptographic digest of their bytes (``digests``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_B = 0x9E3779B97F4A7C15
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(_B | 1)
MOST_LANES = 16
#: The lowest n bytes of a lane, n = 0 to 8.
_MASKS = np.array([2 ** (8 * n) - 1 for n in range(9)], dtype=np.uint64)

#: Bytes between words: space and \t \n \v \f \r.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _C1
    x = x ^ (x >> np.uint64(27))
    x = x * _C2
    return x ^ (x >> np.uint64(31))


def chunks(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with their texts as UTF-8 bytes (null: empty), each of about ``most_bytes`` or one row."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.array(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    parts = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(sizes)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo), [x or b"" for x in col.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]


def words(texts: list[bytes], separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(text index, hash, start, end) of each word, and the joined bytes that start and end point into."""
    data = b" ".join(texts)
    a = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(a) + 2, dtype=np.int8)
    inside[1:-1] = ~separators[a]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none, data
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    doc = np.searchsorted(np.cumsum(lengths + 1), starts, side="right")
    return doc, _hashes(data, starts, ends), starts, ends, data


def _lanes(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    padded = data + bytes(8)
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))


def _hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lanes, lengths = _lanes(data), ends - starts
    out = mix(lengths.astype(np.uint64) * _STEP)
    left = np.flatnonzero(lengths <= 8 * MOST_LANES)
    for k in range(MOST_LANES):
        if not len(left):
            break
        rest = lengths[left] - 8 * k
        out[left] = mix(out[left] * _STEP ^ (lanes[starts[left] + 8 * k] & _MASKS[np.minimum(rest, 8)]))
        left = left[rest > 8]
    for n in np.flatnonzero(lengths > 8 * MOST_LANES).tolist():
        out[n] = int.from_bytes(hashlib.blake2b(data[starts[n] : ends[n]], digest_size=8).digest(), "little")
    return out


def distinct_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: bytes) -> bool:
    """Whether equal hashes are equal words throughout, so that hashes can stand for these words."""
    if not len(hashes):
        return True
    _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    other, lengths = first[place], ends - starts
    if (lengths[other] != lengths).any():
        return False
    lanes, left = _lanes(data), np.flatnonzero(other != np.arange(len(other)))
    for k in range(MOST_LANES):
        rest = lengths[left] - 8 * k
        if ((lanes[starts[left] + 8 * k] ^ lanes[starts[other[left]] + 8 * k]) & _MASKS[np.minimum(rest, 8)]).any():
            return False
        left = left[rest > 8]
        if not len(left):
            return True
    return all(data[starts[n] : ends[n]] == data[starts[m] : ends[m]] for n, m in zip(left.tolist(), other[left].tolist()))


def same_words(data: bytes, starts: np.ndarray, ends: np.ndarray, other: bytes, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each word equals its partner in other bytes."""
    lengths = ends - starts
    out = lengths == other_ends - other_starts
    here, there = _lanes(data), _lanes(other)
    left = np.flatnonzero(out & (lengths <= 8 * MOST_LANES))
    for k in range(MOST_LANES):
        if not len(left):
            break
        rest = lengths[left] - 8 * k
        same = ((here[starts[left] + 8 * k] ^ there[other_starts[left] + 8 * k]) & _MASKS[np.minimum(rest, 8)]) == 0
        out[left[~same]] = False
        left = left[same & (rest > 8)]
    for n in np.flatnonzero(out & (lengths > 8 * MOST_LANES)).tolist():
        out[n] = data[starts[n] : ends[n]] == other[other_starts[n] : other_ends[n]]
    return out


def exact_ids(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: bytes) -> np.ndarray:
    """A number for each word, equal for equal words only: its hash, or its rank where two words share a hash."""
    if distinct_hashes(hashes, starts, ends, data):
        return hashes
    number: dict[bytes, int] = {}
    each = (number.setdefault(data[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist()))
    return mix(np.fromiter(each, dtype=np.uint64, count=len(hashes)))


def distinct_grams(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, place of one occurrence) of the distinct runs of k exact ids. A run whose hash another run has is
    told apart by a hash of its own, which depends on its ids alone as long as no third one meets it."""
    h = grams(ids, k)
    found, first, place = np.unique(h, return_index=True, return_inverse=True)
    if len(found) == len(h):
        return found, first
    runs = ids[np.arange(len(h))[:, None] + np.arange(k)]
    if (runs[first[place]] == runs).all():
        return found, first
    first = np.unique(runs, axis=0, return_index=True)[1]
    order = np.argsort(h[first], kind="stable")
    return h[first][order], first[order]


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """80 bits of BLAKE2b of each slice of the bytes, as numbers of 64 and of 16 bits."""
    cut = memoryview(data)
    joined = b"".join(hashlib.blake2b(cut[a:b], digest_size=10).digest() for a, b in zip(starts.tolist(), ends.tolist()))
    both = np.frombuffer(joined, dtype=[("high", "<i8"), ("low", "<i2")])
    return both["high"].copy(), both["low"].copy()


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values (texts' bounds are the caller's to respect)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * _STEP + hashes[j : j + n]
    return mix(out)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Smallest of each k consecutive values, by doubling."""
    if len(x) < k:
        return x[:0]
    width, m = 1, x
    while width * 2 <= k:
        m = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    n = len(x) - k + 1
    return np.minimum(m[:n], m[k - width : k - width + n])

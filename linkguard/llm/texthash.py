"""Word boundaries and rolling hashes over many texts at once, in numpy.

Texts lie in one byte buffer, each followed by a line feed. A word's hash takes its bytes eight at a time through a bit mixer,
so no pattern of letters cancels out. Hashes of windows are polynomials modulo 2**64 over word hashes, and those of byte ranges
over random byte values, finished by the mixer; they serve windows of few words and what is compared byte by byte afterwards.
Two seeds give independent hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BYTES = [np.random.RandomState(11 + i).randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2 * i + 3)
          for i in range(2)]
_POWERS: dict[int, np.ndarray] = {}
#: Words that are hashed together, and bytes beyond which a word is hashed on its own.
STRETCH, LONG_WORD = 1 << 15, 256
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = got = np.multiply.accumulate(steps)
    return got[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer, and the start of each (with the end of the buffer behind)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) \
        else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8)[offs[0]:offs[-1]] if raw is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    ends = offs[1:] - offs[0]
    return np.insert(data, ends, 10), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int64)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of the first word of each text (with the count of all behind)."""
    space = _SPACE[buf]
    before = np.concatenate([[True], space[:-1]])
    start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    return start, end, np.searchsorted(start, offs)


def byte_sums(buf: np.ndarray, seed: int = 0) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[seed][buf] * powers(_ODD[seed], len(buf)))])


def slice_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each buf[start:end]; the place in the buffer does not matter."""
    back = powers(inverse(_ODD[seed]), len(sums))[start]
    return mix((sums[end] - sums[start]) * back + (end - start).astype(np.uint64))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each word: its length, then eight bytes after the other, go through the mixer."""
    out = np.zeros(len(start), np.uint64)
    for i in range(0, len(start), STRETCH):
        lo, hi = start[i:i + STRETCH], end[i:i + STRETCH]
        part = np.concatenate([buf[lo[0]:hi[-1]], np.zeros(8, np.uint8)])
        out[i:i + STRETCH] = _few_hashes(part, lo - lo[0], hi - lo[0], seed)
    return out


def _few_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """buf has eight bytes more than the words."""
    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64(_ODD[seed]))
    eight = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))  # at each byte
    live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    done = 0
    while len(live):
        left = size[live] - done
        unused = np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))
        out[live] = mix((out[live] ^ (eight[start[live] + done] << unused)) + np.uint64(_ODD[1 - seed]))
        done += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        digest = hashlib.blake2b(buf[start[i]:end[i]].tobytes(), digest_size=8, key=bytes([seed]))
        out[i] = int.from_bytes(digest.digest(), "little")
    return out


def windows(h: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of each `size` neighbouring entries of h."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    base, n = _ODD[1 - seed], len(h)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(base, n))])
    return mix((sums[size:] - sums[:-size]) * powers(inverse(base), n)[:n - size + 1])


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """Which windows of `size` words lie in one text."""
    n = int(first[-1])
    ok = np.ones(max(0, n - size + 1), bool)
    for end in first[1:-1] if size > 1 else ():
        ok[max(0, end - size + 1):end] = False
    return ok

"""Array kernels over batches of texts: code points, words, hashes and ragged gathers.

A batch of texts is laid out as one array, so the cost is a few array passes for each million
characters instead of Python work for each word.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts of a batch are worked through in chunks of about so many characters; a longer text is a chunk of its own.
CHUNK = 1 << 18


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    return _made_powers(2 * CHUNK)


def _made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64; those of the usual sizes are kept."""
    p, q = _powers() if n <= 2 * CHUNK else _made_powers(n)
    return p[:n], q[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] that depend on the content alone; starts and ends ascend.

    Long values are gone through in stretches, so that only a single span beyond CHUNK takes more room.
    """
    if len(values) < 2 * CHUNK:
        return _hashes(values, starts, ends)
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(int(np.searchsorted(ends, base + CHUNK, side="right")), i + 1)
        out[i:j] = _hashes(values[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


def _hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(values)
    p, q = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of all the runs, one run after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total, dtype=np.int64)


def chunks(texts: list, size: int = CHUNK):
    """Runs (from, to) of texts of about `size` characters together."""
    at, have = 0, 0
    for i, t in enumerate(texts):
        have += len(t) + 1
        if have >= size:
            yield at, i + 1
            at, have = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def parts(batches, column: str = "text", size: int = CHUNK):
    """The batches in slices whose `column` has about `size` bytes, so that only a slice's texts become
    Python objects at a time; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        a = 0
        while a < batch.num_rows:
            b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")), a + 1)
            yield batch.slice(a, b - a)
            a = b


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a slice as UTF-8."""
    return batch.column(column).cast(pa.binary()).to_pylist()


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def byte_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (runs without ASCII white space, A-Z lower-cased), the
    words' counts by text, and for each word the position of its text."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    space = SPACE[data]
    flips = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = flips[0::2], flips[1::2]
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.cumsum(sizes)
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, bounds))))
    return span_hashes(data, starts, ends), counts, np.repeat(np.arange(len(texts)), counts)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text as sorted hashes, and their number by text.

    A text of fewer words has its whole sequence as its only shingle; one without words has none.
    """
    words, counts, owner = byte_words(texts)
    if not len(words):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    first = np.cumsum(counts) - counts
    n_shingles = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    at = ragged(first, n_shingles)
    doc = np.repeat(np.arange(len(texts)), n_shingles)
    h = np.zeros(len(at), dtype=np.uint64)
    length = np.minimum(counts, k)[doc]
    for j in range(k):
        here = j < length
        h[here] = mix(h[here] * np.uint64(BASE) + words[at[here] + j] + np.uint64(j + 1))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(texts))

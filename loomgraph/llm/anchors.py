"""Minimizers of byte strings: places that any two equal windows have in common.

In every window of `window` bytes the first k-gram with the least hash is its anchor. Equal windows
have their anchor at the same place within them, so grouping anchors by hash brings together all
occurrences of every string of at least `window` bytes.
"""

from __future__ import annotations

import numpy as np

from loomgraph.llm import kernels

GRAM = 24


def gram_hashes(data: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hashes of data[i:i+k] for every i."""
    starts = np.arange(len(data) - k + 1)
    return kernels.span_hashes(data, starts, starts + k) if len(starts) > 0 else np.zeros(0, dtype=np.uint64)


def sliding_first_min(h: np.ndarray, w: int) -> np.ndarray:
    """For each i: the first place of the least of h[i:i+w]."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at = np.arange(len(h))
    span = 1
    while span < w:
        step = min(span, w - span)
        other = at[step:]
        own = at[: len(other)]
        at = np.where(h[other] < h[own], other, own)
        span += step
    return at[:n]


def owned(data: np.ndarray, window: int = 100, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """place and hash of each anchor, and the first and last start of the windows it is the anchor of."""
    h = gram_hashes(data, k)
    at = sliding_first_min(h, window - k + 1)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none, np.zeros(0, dtype=np.uint64), none, none
    new = np.ones(len(at), dtype=bool)
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    return at[first], h[at[first]], first, np.append(first[1:], len(at)) - 1

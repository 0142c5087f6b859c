"""Array versions of the two word patterns of the public tokenizers, and a table of encoded words."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
from tokenizers import Regex, pre_tokenizers

from loomgraph.llm import kernels

OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
#: Stands between texts; it is no code point, so no word crosses it.
SENTINEL = 0x110000


#: Beyond these, planes hold no letters, numbers or white space in any Unicode version so far.
PLANES = 0x40000


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point under \\p{L}, \\p{N} and \\s, as the tokenizers' own pattern engine
    has it, whatever version of Unicode that follows."""
    table = np.full(SENTINEL + 1, OTHER, dtype=np.uint8)
    table[SENTINEL] = EDGE
    points = [*range(0xD800), *range(0xE000, PLANES)]
    every = "".join(map(chr, points))
    place = np.array(points)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        for piece, (a, b) in pre_tokenizers.Split(Regex(rf"{pattern}+"), "isolated").pre_tokenize_str(every):
            if pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(piece[0]) == []:
                table[place[a:b]] = kind
    return table


def layout(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts with a sentinel behind each, and where each text's part ends."""
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.cumsum(sizes)
    joined = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", dtype=np.uint32).copy()
    joined[bounds - 1] = SENTINEL
    return joined, bounds


def _suffix_lengths(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For apostrophes at `at`: the length of 's 't 'm 'd (1) or 're 've 'll (2) behind them, else 0."""
    a, b = cp[np.minimum(at + 1, len(cp) - 1)], cp[np.minimum(at + 2, len(cp) - 1)]
    one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    return np.where(one, 1, np.where(two, 2, 0))


def byte_level_spans(cp: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the byte-level pattern: runs of a class with at most one blank before them,
    English contractions, and white space whose last character stays with what follows."""
    n = len(cp)
    start = np.ones(n + 1, dtype=bool)
    start[1:n] = kind[1:] != kind[:-1]
    space, edge = kind == SPACE, kind == EDGE
    before_word = np.zeros(n, dtype=bool)
    before_word[:-1] = space[:-1] & ~space[1:] & ~edge[1:]
    at = np.flatnonzero(before_word)
    start[at] = True  # the last of white space stands apart from the rest
    blank = at[cp[at] == 32]
    start[blank + 1] = False  # and a blank joins the word behind it
    start[:n][edge] = True
    start[1 : n + 1][edge] = True
    # a contraction needs an apostrophe that begins a word
    quote = np.flatnonzero((cp == 39) & start[:n])
    length = _suffix_lengths(cp, quote)
    quote, length = quote[length > 0], length[length > 0]
    start[quote + 1] = False
    start[quote + 1 + length] = True
    two = quote[length == 2]
    start[two + 2] = False
    begin = np.flatnonzero(start[:n])
    end = np.append(begin[1:], n)
    keep = ~edge[begin]
    return begin[keep], end[keep]


def word_level_spans(cp: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the word-level pattern: contractions, letters, single digits, other runs; white space goes."""
    n = len(cp)
    start = np.ones(n + 1, dtype=bool)
    start[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    quote = np.flatnonzero((cp == 39) & start[:n])
    length = _suffix_lengths(cp, quote)
    quote, length = quote[length > 0], length[length > 0]
    start[quote + 1] = False
    start[quote + 1 + length] = True
    start[quote[length == 2] + 2] = False
    begin = np.flatnonzero(start[:n])
    end = np.append(begin[1:], n)
    keep = (kind[begin] != SPACE) & (kind[begin] != EDGE)
    return begin[keep], end[keep]


class WordTable:
    """Encoded words by the hash of the word: arrays, so a million words take some tens of MB.

    The table is emptied when it has `limit` words or eight ids for each of them (some 56 MB in all);
    then words are encoded again as they come.
    """

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 1_000_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # keys (sorted), starts and counts
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.used = self.held = 0

    def find(self, keys: np.ndarray, words: Callable[[np.ndarray], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of the sorted distinct keys stand in the pool, and how many they are."""
        if self.held + len(keys) > self.limit or self.used > 8 * self.limit:
            self.clear()
        starts, counts = np.full(len(keys), -1), np.zeros(len(keys), dtype=np.int64)
        for own, start, count in self.levels:
            at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
            hit = own[at] == keys
            starts[hit], counts[hit] = start[at[hit]], count[at[hit]]
        new = np.flatnonzero(starts < 0)
        if len(new):
            found = self.encode(words(new))
            counts[new] = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            need = self.used + int(counts[new].sum())
            if need > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros(max(len(self.pool), need), dtype=np.uint32)))
            self.pool[self.used : need] = np.fromiter((i for ids in found for i in ids), dtype=np.uint32, count=need - self.used)
            starts[new] = self.used + np.cumsum(counts[new]) - counts[new]
            self.used, self.held = need, self.held + len(new)
            self.levels.append((keys[new], starts[new], counts[new]))
            # a level goes into the one before it once that is not four times as large: few levels, few copies
            while len(self.levels) > 1 and len(self.levels[-2][0]) < 4 * len(self.levels[-1][0]):
                joined = [np.concatenate(c) for c in zip(*self.levels[-2:])]
                order = np.argsort(joined[0], kind="stable")
                self.levels[-2:] = [tuple(c[order] for c in joined)]
        return starts, counts


def encoded(texts: list[str], spans: Callable, words: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the number of ids of each text."""
    cp, bounds = layout(texts)
    begin, end = spans(cp, classes()[cp])
    if not len(begin):
        return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
    keys, first, inverse = np.unique(kernels.span_hashes(cp, begin, end), return_index=True, return_inverse=True)

    data = cp.tobytes()

    def spelled(which: np.ndarray) -> list[str]:
        at = first[which]
        return [data[4 * a : 4 * b].decode("utf-32-le", "surrogatepass") for a, b in zip(begin[at].tolist(), end[at].tolist())]

    starts, counts = words.find(keys, spelled)
    counts = counts[inverse]
    ids = words.pool[kernels.ragged(starts[inverse], counts)]
    # words of a text lie between its bounds
    cut = np.searchsorted(begin, bounds)
    ends = np.concatenate(([0], np.cumsum(counts)))[cut]
    return ids, np.diff(np.concatenate(([0], ends)))


class Encoder:
    """Encodes whole texts: added tokens of the vocabulary are cut out of the text as it stands, and the
    pieces between them are normalised, split into words and looked up."""

    def __init__(self, added: list[dict], spans: Callable, words: WordTable, normalised: Callable[[str], str] | None = None):
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("only added tokens that are matched as they stand are known here")
        self.added = {t["content"]: t["id"] for t in added}
        self.pattern = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.spans, self.words, self.normalised = spans, words, normalised or (lambda t: t)

    def encode(self, texts: list[str]):
        """Yields the ids of each text, in order, as an unsigned 32-bit array."""
        for a, b in kernels.chunks(texts):
            part = texts[a:b]
            whole = [not any(x in t for x in self.added) for t in part]
            pieces, tokens = [], []
            for t, plain in zip(part, whole):
                pieces += [t] if plain else self.pattern.split(t)
                tokens.append([] if plain else [self.added[m] for m in self.pattern.findall(t)])
            ids, counts = encoded([self.normalised(p) for p in pieces], self.spans, self.words)
            ends = np.cumsum(counts)
            at = 0
            for own in tokens:
                runs = [ids[ends[k] - counts[k] : ends[k]] for k in range(at, at + len(own) + 1)]
                at += len(runs)
                for k, token in enumerate(own):
                    runs.insert(2 * k + 1, np.array([token], dtype=np.uint32))
                yield runs[0] if len(runs) == 1 else np.concatenate(runs)

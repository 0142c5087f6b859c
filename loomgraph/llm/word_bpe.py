"""BPE encoding and decoding with a pair occurrence index.

The distinct new words of a stretch of the partition (some 2**18 characters, so memory stays bounded)
are laid out as one row of symbols. An index maps each mergeable pair to all its positions; the active
ranks are applied in ascending order, each at all positions of its pair from left to right, and a merge
updates the lists of the pairs it makes beside it. Words once merged are kept in an array table, so the
work is by distinct word and not by occurrence. Every text takes this way; of the tokenizers library only
the character tables are asked (what it takes for letters, numbers and white space, what it composes).

Defined cases: a null or empty text has no ids and decodes to the empty text; a very long text is a
stretch of its own; positions of equal rank are merged from left to right; repeated rows and null ids are
encoded like others; an empty table gives no rows; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import normalizers

from loomgraph.llm import common, kernels, splitting
from loomgraph.llm.byte_bpe import byte_symbols

END = "</w>"
NFC = normalizers.NFC()


class Merges:
    """The merges of a vocabulary: ranks by pair of ids, and the id each makes."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        a = np.array([vocab[x] for x, _ in pairs], dtype=np.int64)
        b = np.array([vocab[y] for _, y in pairs], dtype=np.int64)
        self.made = [vocab[x + y] for x, y in pairs]
        self.left, self.right = a.tolist(), b.tolist()
        self.rank_of = {(x << 20) | y: r for r, (x, y) in reversed(list(enumerate(zip(self.left, self.right))))}
        keys = np.fromiter(self.rank_of, dtype=np.int64, count=len(self.rank_of))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.fromiter(self.rank_of.values(), dtype=np.int64, count=len(keys))[order]

    def ranks_at(self, symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each symbol, or -1; `last` marks the ends of words."""
        out = np.full(len(symbols), -1, dtype=np.int64)
        if len(symbols) > 1 and len(self.keys):
            keys = (symbols[:-1] << 20) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out[:-1] = np.where((self.keys[at] == keys) & ~last[:-1], self.ranks[at], -1)
        return out

    def apply(self, words: list[np.ndarray]) -> list[list[int]]:
        """Merges the symbols of each word until no pair has a rank."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        bounds = np.cumsum(sizes)
        flat = np.concatenate(words).astype(np.int64)
        last = np.zeros(len(flat), dtype=bool)
        last[bounds[sizes > 0] - 1] = True
        ranks = self.ranks_at(flat, last)
        held = np.flatnonzero(ranks >= 0)
        held = held[np.argsort(ranks[held], kind="stable")]
        active, first = np.unique(ranks[held], return_index=True)
        index = {r: x.tolist() for r, x in zip(active.tolist(), np.split(held, first[1:]))} if len(held) else {}
        # links to the neighbours within the word; -1 beyond its ends
        after = np.arange(1, len(flat) + 1)
        after[last] = -1
        before = np.arange(-1, len(flat) - 1)
        before[np.concatenate(([0], bounds[:-1]))[sizes > 0]] = -1
        symbol, after, before = flat.tolist(), after.tolist(), before.tolist()
        self._merge(symbol, after, before, index)
        flat = np.array(symbol, dtype=np.int64)
        alive = flat >= 0
        counts = np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], bounds))]
        ids = flat[alive].tolist()
        return [ids[a:b] for a, b in zip(counts[:-1].tolist(), counts[1:].tolist())]

    def _merge(self, symbol: list[int], after: list[int], before: list[int], index: dict[int, list[int]]) -> None:
        rank_of, heap = self.rank_of.get, list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            positions = index.pop(rank, None)
            if positions is None:
                continue
            a, b, made = self.left[rank], self.right[rank], self.made[rank]
            positions.sort()
            for k, i in enumerate(positions):
                j = after[i]
                if symbol[i] != a or j < 0 or symbol[j] != b:
                    continue  # an earlier merge took one of the two
                symbol[i], symbol[j] = made, -1
                n, p = after[j], before[i]
                after[i] = n
                if n >= 0:
                    before[n] = i
                    r = rank_of((made << 20) | symbol[n])
                    if r is not None:
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            heapq.heappush(heap, r)
                if p >= 0:
                    r = rank_of((symbol[p] << 20) | made)
                    if r is not None:
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            heapq.heappush(heap, r)
                if heap and heap[0] < rank:  # what was made goes first
                    rest = positions[k + 1 :]
                    if rest:
                        index.setdefault(rank, []).extend(rest)
                        heapq.heappush(heap, rank)
                    break


@functools.lru_cache(maxsize=1)
def lower_cased() -> dict[int, str]:
    """Code points whose lower case differs here from that of the tokenizers' own tables."""
    lower = normalizers.Lowercase().normalize_str
    found = {c: lower(chr(c)) for c in [*range(128, 0xD800), *range(0xE000, 0x20000)]}
    return {c: x for c, x in found.items() if x != chr(c).lower()}


class WordLevelCodec(splitting.Encoder):
    """Encodes and decodes as the tokenizers library does with the given word-end BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = {b: c for c, b in byte_symbols().items()}
        inner = np.array([vocab[symbols[b]] for b in range(256)], dtype=np.int64)
        final = np.array([vocab[symbols[b] + END] for b in range(256)], dtype=np.int64)
        merges = Merges(vocab, spec["model"]["merges"])

        def encode(words: list[str]) -> list[list[int]]:
            rows = []
            for w in words:
                raw = np.frombuffer(w.encode("utf-8", "replace"), dtype=np.uint8)
                row = inner[raw]
                row[-1] = final[raw[-1]]
                rows.append(row)
            return merges.apply(rows)

        super().__init__(spec["added_tokens"], splitting.word_level_spans, splitting.WordTable(encode), self.lowered)
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        spelled = [b""] * size
        for token, i in [*vocab.items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            spelled[i] = token.encode() + b" "
        self.token_counts = np.fromiter(map(len, spelled), dtype=np.int64, count=size)
        self.token_starts = np.cumsum(self.token_counts) - self.token_counts
        self.token_bytes = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    @staticmethod
    def lowered(text: str) -> str:
        """NFC, then each character's own lower case (a sigma at a word's end is one like others)."""
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):  # the library's own tables decide what it composes
            text = NFC.normalize_str(text)
        return text.replace("Σ", "σ").translate(lower_cased()).lower()

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' spellings with a blank between them, in UTF-8: the file names no decoder."""
        counts = self.token_counts[ids]
        return self.token_bytes[kernels.ragged(self.token_starts[ids], counts)][:-1].tobytes()


@functools.lru_cache(maxsize=2)
def codec(path: str) -> WordLevelCodec:
    return WordLevelCodec(path)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and the decoded text of every document."""

    def run(batches):
        c = codec(tokenizer)
        for batch in kernels.parts(batches):
            ids = list(c.encode(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([i.tolist() for i in ids], pa.list_(pa.int64())), pa.array([c.decode(i).decode() for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return common.text_of(docs).mapInArrow(run, "doc_id long, ids array<long>, decoded string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """As encode(), but with digests of ids (little-endian unsigned 32-bit) and decoded text made in
    the same pass, so that neither leaves the worker."""

    def run(batches):
        c = codec(tokenizer)
        for batch in kernels.parts(batches):
            n, a, b = [], [], []
            for ids in c.encode(batch.column("text").to_pylist()):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.text_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

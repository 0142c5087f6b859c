"""Ids of the byte-level tokenizer file for batches of texts."""

from __future__ import annotations

import functools
import json

from loomgraph.llm import splitting


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevelEncoder(splitting.Encoder):
    """Encodes as the tokenizers library does with the given file and add_special_tokens=False.

    Words come from array passes over the whole batch; every distinct word is merged once.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_symbols()
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in added}
        core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        words = splitting.WordTable(lambda new: [core.encode_single_piece(w.encode("utf-8", "replace")) for w in new])
        super().__init__(spec["added_tokens"], splitting.byte_level_spans, words)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)

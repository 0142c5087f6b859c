"""Slow and plain versions of the operators, and documents with every odd case."""

import re
import zlib
from collections import defaultdict

from pyspark.sql import types as T

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SENTENCE = "The quick brown fox jumps over the lazy dog while eleven quiet geese look on from afar. "
PASSAGE = "A passage of plain words that several of these documents share with each other, long enough to count as one, and then some more of it. "

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use themselves
        *[T.StructField(c, T.IntegerType()) for c in ("h1", "salt", "rank", "pos", "gaps", "rep", "shard", "score", "pii", "kept", "component_id", "length", "a", "b", "th", "doc", "start", "row", "own", "own_hash", "text_hash", "place", "made", "_doc", "_own", "_hash", "_text_hash", "_gaps", "_made", "_place", "_kept", "mixed", "arc", "at", "range", "salt2")],
    ]
)
#: Every case but null ids and repeated ids.
PLAIN = [
    (1, ""),
    (2, None),
    (3, " \t\n"),
    (4, "word"),
    (5, "two words"),
    (6, SENTENCE * 3),
    (7, SENTENCE * 3),
    (8, SENTENCE * 3 + "tail"),
    (9, (SENTENCE.upper() + "\n") * 4),
    (10, "  " + SENTENCE + "\n\n\n" + PASSAGE + "\nend"),
    (11, "x\n" + SENTENCE + "\r\n" + PASSAGE + "\nünïcödé ß 漢字 🎉 ǅ Σίσυφος"),
    (12, PASSAGE + SENTENCE + "\n"),
    (13, "".join(f"w{i} " for i in range(30_000))),
    (14, "a" * 5000),
    (15, "".join(f"w{i} " for i in range(30_000)) + "more"),
    (16, "ab" * 400 + PASSAGE),
    (17, "can't won't I'll they've we're 12345 1 2 3 <|endoftext|> ... !!! a_b"),
    (18, PASSAGE * 2),
    (19, "\n"),
    (20, "".join(f"line number {i % 7} of this text has its own words\n" for i in range(50))),
    (21, "Mail ann.lee@example.org or call (212) 555-0143, card 4111 1111 1111 1111."),
]
ODD = [*PLAIN, (None, SENTENCE * 3), (None, None), (4, "word"), (6, SENTENCE * 3), (9, "another text under an id that is taken " * 5), (7, None)]


def frame(spark, rows, partitions=3):
    filled = [(i, t, None if k % 3 else "en", None if k % 2 else "web", None if k % 4 == 1 else len(t or ""), *[7] * (len(SCHEMA) - 5)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(filled, SCHEMA).repartition(partitions)


def kept_lines(rows):
    """doc_id -> (n_lines, n_dropped, text) for distinct ids."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def uncovered(rows, window=100):
    """doc_id -> (removed spans, kept bytes) for distinct ids: later occurrences of `window` bytes go."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            piece = data[p : p + window]
            if piece in seen:
                gone[p : p + window] = b"\1" * window
            else:
                seen.add(piece)
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out[i] = spans, bytes(c for c, g in zip(data, gone) if not g)
    return out


def shingles(text, k):
    words = WORD.findall((text or "").encode().translate(FOLD))
    if not words:
        return set()
    return {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))}


def near_classes(rows, k, percent):
    """doc_id -> (number of shingles, smallest id reachable) by comparing every pair."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)  # pairs without a common shingle cannot link
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    near = {(a, b) for ids in by.values() for a in ids[:60] for b in ids if a < b}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def crc(x: bytes) -> int:
    return zlib.crc32(x)

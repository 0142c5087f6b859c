"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A bin is filled greedily with the largest documents that fit; then its smallest document is taken
out again if two unpacked documents fill the widened gap more tightly. Documents of one length are
alike for this rule, so the rule runs over the counts by length (at most `capacity` numbers) and a
bin's pattern is repeated as long as the counts allow: the result is that of the rule applied bin
by bin, and the driver's work does not grow with the corpus. The rows then find their places by
their rank among the rows of their length.

Defined cases: a null or empty text is one separator id; a very long text is cut into pieces of which
only the first may be shorter; of documents of one length the order is that of a hash of their ids and
content, and rows alike in all of these may take each other's places; repeated rows and null ids are packed
like others; an empty table gives no rows; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, kernels
from loomgraph.llm.byte_bpe import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, how many such bins); lengths descend but for the two that replaced one.

    Every repetition leaves fewer than half of the documents of some length in the pattern, so there
    are at most capacity * (2 + log2(capacity / length)) patterns summed over lengths.
    """
    left = Counter({length: n for length, n in counts.items() if n > 0})
    bits = sum(1 << length for length in left)
    out = []
    while bits:
        free, used, pattern, gap = bits, Counter(), [], capacity

        def take(length: int) -> None:
            nonlocal free, gap
            used[length] += 1
            pattern.append(length)
            gap -= length
            if used[length] == left[length]:
                free &= ~(1 << length)

        while (fits := free & ((1 << (gap + 1)) - 1)) and gap:
            take(fits.bit_length() - 1)
        if gap and len(pattern) > 1:
            smallest = min(pattern)
            pair = _best_pair(free, left, used, gap + smallest)
            if pair and sum(pair) > smallest:
                pattern.remove(smallest)
                used[smallest] -= 1
                gap += smallest
                free |= 1 << smallest
                for length in pair:
                    take(length)
        times = min(left[length] // n for length, n in used.items() if n)
        for length, n in used.items():
            left[length] -= n * times
            if not left[length]:
                bits &= ~(1 << length)
        out.append((tuple(pattern), times))
    return out


def _best_pair(free: int, left: Counter, used: Counter, gap: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum up to gap; of equal sums the one with the larger document."""
    best, pair = 0, None
    below = free & ((1 << gap) - 1)
    while below:
        a = below.bit_length() - 1
        if 2 * a < best or a * 2 <= best:
            break
        below &= ~(1 << a)
        others = free & ((1 << (min(a, gap - a) + 1)) - 1)
        if others.bit_length() - 1 == a and left[a] - used[a] < 2:
            others &= ~(1 << a)
        if others and a + others.bit_length() - 1 > best:
            best, pair = a + others.bit_length() - 1, (a, others.bit_length() - 1)
            if best == gap:
                break
    return pair


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan as runs of ranks by length: ranks from `rank` on go, `each` to a sequence, to the
    sequences from `sequence` on, at `offset` there."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, each in Counter(pattern).items():
            rows.append((length, taken[length], sequence, each, offset))
            taken[length] += each * times
            offset += each * length
        sequence += times
    rows.sort()
    return {name: np.array(x, dtype=np.int64) for name, x in zip(("length", "rank", "sequence", "each", "offset"), zip(*rows) if rows else [()] * 5)}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenised documents; those longer than `capacity` in pieces, of which only the first may be shorter."""

    def tokenised(batches):
        encode = encoder(tokenizer).encode
        for batch in kernels.parts(batches):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                ids = np.append(ids, np.uint32(separator)).astype("<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].astype(np.int64)] if with_ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int64())] if with_ids else [])]
    return common.text_of(docs).mapInArrow(tokenised, PIECES + (", ids array<long>" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """Where each piece goes: PIECES plus sequence_id and offset.

    The pieces' lengths and checksums, not the texts, are kept in the shared folder between the two
    passes. Ranks are dealt out over ranges of a hash, so a length that a third of all rows has is no hot
    spot, and a row's place does not depend on how many partitions there are.
    """
    session = docs.sparkSession
    cutting = common.cut(pieces(docs, tokenizer, capacity, separator), splits=4)
    counts = {r["length"]: r["n"] for r in cutting.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = session.sparkContext.broadcast(places(best_two_fit(counts, capacity)))
    mixed = cutting.withColumn("mixed", F.xxhash64("doc_id", "piece", "ids_crc32"))
    ranked = common.ranked(mixed, "length", "mixed", ["doc_id", "piece", "ids_crc32"], "rank")

    def placed(batches):
        p = plan.value
        keys = (p["length"] << 48) + p["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            nth, within = np.divmod(rank - p["rank"][at], p["each"][at])
            places = [pa.array(p["sequence"][at] + nth, pa.int64()), pa.array(p["offset"][at] + within * length, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *places], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return common.fewer(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), 4).mapInArrow(placed, f"{PIECES}, sequence_id long, offset long")


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids, at most `capacity` of them in a row."""
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    nth = F.row_number().over(common.Window.partitionBy(*key).orderBy(F.lit(0)))
    left = pieces(docs, tokenizer, capacity, separator, with_ids=True).withColumn("nth", nth)
    right = placed.select(*key, "sequence_id", "offset").withColumn("nth", nth)
    same = [left[c].eqNullSafe(right[c]) for c in [*key, "nth"]]
    joined = left.join(right, same).select("sequence_id", "offset", "ids")
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))

"""A consistent-hash ring with virtual nodes and bounded loads.

Every shard has `vnodes` points on the ring; a key belongs to the first point clockwise from its
hash. A shard holds no more than its capacity: the keys of an arc beyond it continue clockwise to the
next point whose shard has room. An arc's keys are alike for this rule but for their order (that of
another hash of the key), so the rule runs over the counts by arc (shards * vnodes numbers), and rows find
their places by their rank within the arc. Keys and ring alone decide the places, not partitions. With
no slack the capacities add up to the rows and differ by one at most.

Defined cases: a null text has size 1; a very long text is measured whole; rows with a null key share one
place on the ring; rows of one key come in the order of a hash of their ties, and rows alike in these too
may take each other's slots; repeated rows each take a slot; an empty table gives no rows; further
columns, whatever their names, are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import common


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """The points' positions (signed 64-bit, ascending) and the shard of each.

    A shard's points depend on its number alone, so adding shards leaves the others' points alone.
    """
    points = [(int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big", signed=True), s) for s in range(shards) for v in range(vnodes)]
    points.sort()
    return np.array([p for p, _ in points], dtype=np.int64), np.array([s for _, s in points], dtype=np.int64)


def bounded(arc_counts: np.ndarray, arc_shard: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first rank, rows, shard, first slot) that place every row of every arc.

    Every arc's own shard is served before anything overflows; then the overflow of each arc goes
    on clockwise until it finds room.
    """
    load = np.zeros(len(capacity), dtype=np.int64)
    runs, over = [], []
    for arc, n in enumerate(arc_counts.tolist()):
        s = int(arc_shard[arc])
        fits = min(n, int(capacity[s] - load[s]))
        if fits:
            runs.append((arc, 0, fits, s, int(load[s])))
            load[s] += fits
        if n > fits:
            over.append((arc, fits, n - fits))
    for arc, rank, n in over:
        step = 1
        while n:
            s = int(arc_shard[(arc + step) % len(arc_shard)])
            fits = min(n, int(capacity[s] - load[s]))
            if fits:
                runs.append((arc, rank, fits, s, int(load[s])))
                load[s] += fits
                rank, n = rank + fits, n - fits
            step += 1
    return sorted(runs)


def capacities(rows: int, shards: int, slack: float) -> np.ndarray:
    """Without slack: shares that differ by one row at most. With slack: the mean's share plus that part."""
    if slack:
        return np.full(shards, int(np.ceil(rows / shards * (1 + slack))), dtype=np.int64)
    return rows // shards + (np.arange(shards) < rows % shards).astype(np.int64)


def assign(rows: DataFrame, key: str, shards: int = 16, vnodes: int = 128, slack: float = 0.0, tie: list[str] = ()) -> DataFrame:
    """Adds shard and slot (gapless from 0 within the shard; replaced if there) to every row.

    `tie` names columns that tell rows of one key apart; with them a hot key is dealt out over ranges.
    The rows are kept in the shared folder between the two passes, so give it narrow ones.
    """
    session = rows.sparkSession
    positions, owner = ring(shards, vnodes)
    columns = rows.columns
    # the key's hash decides its arc; within an arc the rows come in the order of another hash
    hashed = rows.select(common.whole(rows).alias("row"), F.xxhash64(key).alias("at"), F.xxhash64(F.lit("order"), key, *tie).alias("mixed"))

    def arced(batches):
        for batch in batches:
            arc = np.searchsorted(positions, batch.column("at").to_numpy(zero_copy_only=False)) % len(positions)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("mixed"), pa.array(arc, pa.int64())], ["row", "mixed", "arc"])

    row, long = T.StructField("row", hashed.schema["row"].dataType), T.LongType()
    found = common.cut(hashed.mapInArrow(arced, T.StructType([row, T.StructField("mixed", long), T.StructField("arc", long)])), splits=4)
    counts = np.zeros(len(positions), dtype=np.int64)
    for r in found.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect():  # at most shards * vnodes rows
        counts[r["arc"]] = r["n"]
    runs = bounded(counts, owner, capacities(int(counts.sum()), shards, slack))
    plan = session.sparkContext.broadcast({name: np.array(x, dtype=np.int64) for name, x in zip(("arc", "rank", "n", "shard", "slot"), zip(*runs) if runs else [()] * 5)})
    ranked = common.ranked(found, "arc", "mixed", [f"row.`{c}`" for c in (key, *tie)], "rank")

    def placed(batches):
        p = plan.value
        keys = (p["arc"] << 44) + p["rank"]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            run = np.searchsorted(keys, (batch.column("arc").to_numpy() << 44) + rank, side="right") - 1
            shard, slot = p["shard"][run], p["slot"][run] + rank - p["rank"][run]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(shard, pa.int32()), pa.array(slot, pa.int64())], ["row", "shard", "slot"])

    made = ranked.select("row", "arc", "rank").mapInArrow(placed, T.StructType([row, T.StructField("shard", T.IntegerType()), T.StructField("slot", long)]))
    return common.unpacked(made, columns, {"shard": F.col("shard"), "slot": F.col("slot")})


def sharded_documents(docs: DataFrame, shards: int = 16, vnodes: int = 128, slack: float = 0.0) -> DataFrame:
    """doc_id, size and text_crc32 of every document with its shard and slot; only these are shuffled."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign(rows, "doc_id", shards, vnodes, slack, tie=["text_crc32", "size"])

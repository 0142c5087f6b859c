"""Code tokens, weighted trigrams, MinHash signatures and similar pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators.checkpoint import cut, dealt

# The keywords that stay as they are, and the signs of a token.
KEYWORDS = "async await break case catch class const continue def else enum export fn for from function if impl import in interface let match new pub return struct switch trait try type use var while".split()
PIECES = r"""(#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/)|("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`[^`]*`)|(\d[\w.]*)|([A-Za-z_]\w*)|(->|=>|::|==|!=|<=|>=|&&|\|\||[^\s\w])"""
PRIME = 2_147_483_659
K = 64
#: Members of a bucket in a block; every two blocks of a bucket meet on their own.
BLOCK = 512


def code_tokens(source: Column) -> Column:
    """Normalised tokens: identifiers I, strings S, numbers N, keywords and signs as they are; no comments."""
    raw = F.filter(F.regexp_extract_all(source, F.lit(PIECES), F.lit(0)), lambda t: ~t.startswith("//") & ~t.startswith("/*") & ~t.startswith("#"))
    words = F.array(*[F.lit(k) for k in KEYWORDS])
    name = lambda t: F.when(F.array_contains(words, t), t).otherwise("I")
    return F.transform(raw, lambda t: F.when(t.rlike(r"^[\"'`]"), "S").when(t.rlike(r"^\d"), "N").when(t.rlike(r"^[A-Za-z_]"), name(t)).otherwise(t))


def trigrams(tokens: Column) -> Column:
    """Distinct trigrams with their weight: how many of the three are not normalised; weightless ones go."""
    made = F.transform(F.sequence(F.lit(1), F.size(tokens) - 2), lambda i: F.slice(tokens, i, F.lit(3)))
    weight = lambda g: F.size(F.filter(g, lambda t: ~t.isin("I", "S", "N")))
    both = F.transform(made, lambda g: F.struct(F.array_join(g, " ").alias("gram"), weight(g).alias("weight")))
    kept = F.filter(F.array_distinct(both), lambda x: (x["weight"] > 0) & (F.octet_length(x["gram"]) <= 256))
    return F.when(F.size(tokens) >= 3, kept).otherwise(F.array().cast("array<struct<gram:string,weight:int>>"))


def base_hash(text: Column) -> Column:
    """28 bits of md5, which other engines compute alike."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint")


def permutations(n: int = K) -> list[tuple[int, int]]:
    """Multipliers and offsets of the hash permutations."""
    out, x = [], 12345
    for _ in range(n):
        pair = []
        for _ in range(2):
            x = (x * 1103515245 + 12345) % (1 << 31)
            pair.append(x | 1)
        out.append(tuple(pair))
    return out


def signatures(items: DataFrame, key: str, gram: str, k: int = K, weight: str | None = None) -> DataFrame:
    """key and sig (k minima) of rows of key and gram; each gram is hashed once, then permuted.

    A weight takes the minimum over that many further permutations of the gram.
    """
    hashed = items.select(key, base_hash(F.col(gram)).alias("_h"), *([F.col(weight).alias("_w")] if weight else []))
    if weight:
        hashed = hashed.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda r: (F.col("_h") * 3 + r) % PRIME)).alias("_h"))
    minima = [F.min((F.lit(a) * F.col("_h") + F.lit(b)) % PRIME).alias(f"_m{i}") for i, (a, b) in enumerate(permutations(k))]
    return hashed.groupBy(key).agg(*minima).select(key, F.array(*[f"_m{i}" for i in range(k)]).alias("sig"))


def similar_pairs(sigs: DataFrame, key: str, bands: int = 32, threshold: float = 0.95, hot: int | None = 200) -> DataFrame:
    """a < b and jaccard of the signatures that share a band and reach the threshold.

    Pairs are compared where they meet, in the first band that they share, so they are neither held nor moved.

    Buckets of more than `hot` members are passed over, as in the operator this one follows. With None no
    bucket is; then rows with equal signatures are one class: each is paired with the least of its class,
    and only those least ones are compared.
    """
    if hot is None:
        classes = cut(sigs.groupBy("sig").agg(F.min(key).alias("rep")))
        copies = sigs.join(classes, "sig").where(F.col(key) != F.col("rep")).select(F.col("rep").alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("jaccard"))
        sigs = classes.select(F.col("rep").alias(key), "sig")
    rows = F.size("sig") / bands
    keyed = sigs.select(F.col(key).alias("id"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.slice("sig", (i * rows).cast("int") + 1, rows.cast("int")))).alias("band", "part"))
    bucket = keyed.select("id", "band", F.xxhash64("part").alias("bucket"))
    used = bucket.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, hot or 1 << 62)).select("band", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = dealt(bucket.join(used, ["band", "bucket"]), "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("band", "bucket", "blocks"))).alias("places"))
    short = F.transform("sig", lambda x: (x - (1 << 31)).cast("int"))  # minima are below 2**31 + 11
    met = own.join(sigs.select(F.col(key).alias("id"), short.alias("sig")), "id").select("id", "sig", F.transform("places", lambda x: x["band"]).alias("bands"), F.explode("places").alias("_p"))
    met = met.select("id", "sig", "bands", "_p.*").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    met = dealt(met.select("band", "bucket", "i", "j", "own", "id", "bands", "sig"), "band", "bucket", "i", "j").sortWithinPartitions("band", "bucket", "i", "j", "id")
    kind = sigs.schema[key].dataType.simpleString()
    found = met.mapInArrow(lambda batches: _compared(batches, bands, threshold), f"a {kind}, b {kind}, jaccard double")
    return found if hot is not None else found.unionByName(copies)


def _compared(batches, bands: int, threshold: float):
    """The pairs of each group (rows of equal band, bucket, i and j) that reach the threshold and share no
    used band before this one, so that no pair is given twice. Rows come in the order of id in a group."""
    rest = None
    for batch in batches:
        if batch.num_rows:
            held = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            change = _changes(held)
            if len(change):
                yield from _reached(held.slice(0, change[-1]), bands, threshold)
            rest = held.slice(change[-1] if len(change) else 0)
    if rest is not None:
        yield from _reached(rest, bands, threshold)


def _changes(held: pa.Table) -> np.ndarray:
    columns = [held.column(c).to_numpy() for c in ("band", "bucket", "i", "j")]
    return np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1


def _reached(held: pa.Table, bands: int, threshold: float, most: int = 1 << 16):
    ids, band, own = held.column("id").combine_chunks(), held.column("band").to_numpy(), held.column("own").to_numpy()
    inner = held.column("i").to_numpy() == held.column("j").to_numpy()
    sigs = held.column("sig").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    lists = held.column("bands").combine_chunks()
    used = np.zeros((len(ids), bands), dtype=bool)
    used[np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
    ends = np.append(_changes(held), len(ids))
    last = ends[np.searchsorted(ends, np.arange(len(ids)), side="right")]
    after = last - 1 - np.arange(len(ids))  # of each row: how many rows of its group come later
    total, width = np.concatenate([[0], np.cumsum(after)]), sigs.shape[1] // bands
    s = 0
    while s < len(ids):
        e = max(s + 1, int(np.searchsorted(total, total[s] + most, side="right")) - 1)
        n = after[s:e]
        x = np.repeat(np.arange(s, e), n)
        y = np.arange(total[e] - total[s]) - np.repeat(total[s:e] - total[s], n) + x + 1
        apart = inner[x] | (own[x] != own[y])
        x, y = x[apart], y[apart]
        equal = sigs[x] == sigs[y]
        score = equal.sum(axis=1) / sigs.shape[1]
        good = score >= threshold
        x, y, score, equal = x[good], y[good], score[good], equal[good]
        shared = equal[:, : bands * width].reshape(len(x), bands, width).all(axis=2) & used[x]
        here = shared[np.arange(len(x)), band[x]] & (np.argmax(shared, axis=1) == band[x])
        if here.any():
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x[here])), ids.take(pa.array(y[here])), pa.array(score[here])], ["a", "b", "jaccard"])
        s = e


def similar_edges(pairs: DataFrame, files: DataFrame, limit: int = 10) -> DataFrame:
    """The best `limit` partners of each a, with text properties."""
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("jaccard"), "b"))
    best = pairs.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")
    of = lambda s: files.select(F.col("id").alias(s), F.col("file_path").alias(f"_{s}"))
    named = best.join(of("a"), "a").join(of("b"), "b")
    props = F.create_map(F.lit("jaccard"), F.format_string("%.3f", "jaccard"), F.lit("same_file"), (F.col("_a") == F.col("_b")).cast("string"))
    return named.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit("SIMILAR_TO").alias("type"), props.alias("properties"))

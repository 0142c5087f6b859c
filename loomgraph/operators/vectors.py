"""Text tokens as hashed vectors, cosine scores, related pairs and vector search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators.checkpoint import cut
from loomgraph.operators.similarity import base_hash

# Groups of words that stand for each other, and words that stand for nothing.
SYNONYMS = [
    "send publish emit dispatch enqueue message event task".split(),
    "route handler endpoint controller".split(),
    "error exception raise throw fail failure".split(),
    "log logger logging audit".split(),
    "auth authenticate authentication authorize authorization token".split(),
]
STOP = "def fn let var const true false null self this class function method return from with into main user users".split()
DIM = 128


def text_tokens(text: Column) -> Column:
    """Distinct lower-case tokens of two signs or more, split at camel case too, with their synonyms."""
    parts = F.split(F.lower(F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2")), r"[^a-z0-9]+")
    kept = F.array_distinct(F.filter(parts, lambda t: (F.char_length(t) >= 2) & ~t.isin(STOP)))
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(s) for s in x]) for group in SYNONYMS for word in group for x in (word, group)])
    return F.array_distinct(F.flatten(F.transform(kept, lambda t: F.coalesce(F.try_element_at(table, t), F.array(t)))))


def hashed_vectors(items: DataFrame, key: str, tokens: str, dim: int = DIM) -> DataFrame:
    """key and vector of bytes: each token adds to three slots; the largest slot becomes 127."""
    token = items.select(key, F.explode(tokens).alias("_t")).select(key, base_hash(F.col("_t")).alias("_h"))
    slots = F.array(*[F.struct((F.floor(F.col("_h") / d) % dim).cast("int").alias("slot"), F.lit(w).alias("w")) for d, w in ((1, 1.0), (1 << 9, 0.75), (1 << 18, 0.5))])
    summed = token.select(key, F.explode(slots).alias("_s")).groupBy(key, "_s.slot").agg(F.sum("_s.w").alias("w"))
    packed = summed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("_m"), F.max(F.abs("w")).alias("_top"))
    value = lambda i: F.round(F.coalesce(F.try_element_at("_m", i), F.lit(0.0)) / F.col("_top") * 127).cast("tinyint")
    return packed.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value).alias("vector"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def search(vectors: DataFrame, keywords: list[list[float]], vector: str = "embedding") -> DataFrame:
    """Rows with score, the least cosine over all keyword vectors; only positive ones stay."""
    least = F.array_min(F.array(*[cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in q])) for q in keywords]))
    return vectors.withColumn("score", least).where("score > 0")


def _met(tokens: DataFrame, vectors: DataFrame, key: str, token: str, vector: str, threshold: float, limit: int, block: int = 256) -> DataFrame:
    """source, target and score of each source's best `limit` in every two blocks of a token's rows.

    Every two blocks meet on their own, so a task holds two blocks however many rows a token has. Sums
    go in the order of cosine(), so equal vectors have equal scores.
    """
    kept = tokens.select(F.col(key).alias("_key"), F.col(token).alias("_token")).where("_token is not null").distinct()
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    kept = kept.join(vectors.where(whole).select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_vector")), "_key")
    kept = cut(kept)  # tokens and vectors are read once
    sizes = kept.groupBy("_token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_token", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = kept.join(sizes, "_token").withColumn("own", F.pmod(F.xxhash64("_key"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    dealt = met.select("_token", "i", "j", "own", "_key", "_vector").repartition("_token", "i", "j").sortWithinPartitions("_token", "i", "j", "_key")
    kind = kept.schema["_key"].dataType.simpleString()

    def best(rows: list[pa.RecordBatch]):
        group = pa.Table.from_batches(rows)
        inner = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        keys, owns = group.column("_key").combine_chunks(), group.column("own").to_numpy()
        lists = group.column("_vector").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        for length in np.unique(lengths[lengths > 0]):
            own = np.flatnonzero(lengths == length)
            x = lists.take(pa.array(own)).flatten().to_numpy().reshape(-1, length).T.copy()
            dots, squares = np.zeros((len(own), len(own))), np.zeros(len(own))
            for d in x:
                dots += d[:, None] * d[None, :]
                squares += d * d
            sizes = np.sqrt(squares)[:, None] * np.sqrt(squares)[None, :]
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(~(sizes <= 0), dots / sizes, 0.0)
            _, same = np.unique(np.array(keys.take(pa.array(own)).to_pylist()), return_inverse=True)
            good = ~(score < threshold) & (same[:, None] != same[None, :]) & (inner | (owns[own][:, None] != owns[own][None, :]))
            source, target = [], []
            for a in np.flatnonzero(good.any(axis=1)):
                b = np.flatnonzero(good[a])
                b = b[np.lexsort((same[b], np.where(np.isnan(score[a, b]), -np.inf, -score[a, b])))][:limit]
                source += [a] * len(b)
                target += b.tolist()
            if source:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(own[source])), keys.take(pa.array(own[target])), pa.array(score[source, target])], ["source", "target", "score"])

    def run(batches):
        held, key_ = [], None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("_token", "i", "j"))))
            starts = [0, *(at for at in range(1, len(names)) if names[at] != names[at - 1]), len(names)] if names else [0]
            for s, e in zip(starts, starts[1:]):
                if held and names[s] != key_:
                    yield from best(held)
                    held = []
                key_ = names[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield from best(held)

    return dealt.mapInArrow(run, f"source {kind}, target {kind}, score double")


def related(tokens: DataFrame, vectors: DataFrame, key: str, token: str, vector: str, hot: int | None = 96, threshold: float = 0.45, limit: int = 6) -> DataFrame:
    """source, target and score: of the rows that share a token of at most `hot` rows (of any token
    if None), the best `limit` above the threshold for each source."""
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "target"))
    if hot is None:
        return _met(tokens, vectors, key, token, vector, threshold, limit).distinct().withColumn("place", place).where(F.col("place") <= limit)
    used = tokens.groupBy(token).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, hot)).select(token)
    kept = tokens.select(key, token).distinct().join(used, token)
    pairs = kept.withColumnRenamed(key, "source").join(kept.withColumnRenamed(key, "target"), token).where("source != target").select("source", "target").distinct()
    of = lambda s, v: vectors.select(F.col(key).alias(s), F.col(vector).alias(v))
    scored = pairs.join(of("source", "_x"), "source").join(of("target", "_y"), "target").select("source", "target", cosine(F.col("_x"), F.col("_y")).alias("score")).where(F.col("score") >= threshold)
    return scored.withColumn("place", place).where(F.col("place") <= limit)

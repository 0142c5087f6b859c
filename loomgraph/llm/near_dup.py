"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: t bins are filled in rounds. In round i < t each element of a set goes to a bin by hash; in
round t + j every element goes to bin j. A bin keeps the least value of the first round that
reached it, and a set stops as soon as all its bins are full, so every bin fills and the expected
work is t log t plus the set's size. The share of equal bins estimates the Jaccard similarity with
the concentration of independent samples.

Links: documents with equal sets become one class. Classes that agree in a whole band of their
sketches are candidates. First each class of a bucket is compared with the bucket's least class, which
makes one component of most groups of near copies. Buckets whose classes still belong to several
components are then gone through group by group (classes connected by such buckets), in blocks: pairs
across components that their sketches leave possible are compared on the full sets within the
task, and only links that join components are given out. No link is left out that could change the
result; pairs within one component cannot.

Defined cases: a null or empty text has no shingles and no links; a very long text has all its shingles;
of equal sets the least doc_id stands for them, and the least hash of its texts; a null doc_id takes no
part and is kept; rows with one doc_id are one document in links, whatever their texts, each row with its
own number of shingles; an empty table gives no rows; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, kernels
from loomgraph.llm.components import components

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Places over which the sets of a bucket are dealt out when they meet what is known of it.
SALTS = 16


def sketches(elements: np.ndarray, counts: np.ndarray, t: int) -> np.ndarray:
    """The sketches of sets given one after another; empty sets keep empty bins."""
    n = len(counts)
    out = np.full(n * t, EMPTY, dtype=np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int64), counts)
    h = elements
    for i in range(2 * t):
        if not len(h):
            break
        x = kernels.mix(h + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bin_of = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(out, owner * t + bin_of, (x & np.uint64(0xFFFFFFFF)) | np.uint64(i) << np.uint64(32))
        open_ = (out.reshape(n, t) == EMPTY).any(axis=1)
        stay = open_[owner]
        if not stay.all():
            h, owner = h[stay], owner[stay]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, which takes in the band's number."""
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(kernels.mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sketch), bands)).copy()
    for r in range(rows):
        key = kernels.mix(key * np.uint64(kernels.BASE) + parts[:, :, r])
    return key


def least_share(percent: int, t: int) -> float:
    """The share of equal bins below which a pair cannot be at the threshold: six deviations less."""
    p = percent / 100
    return p - 6 * np.sqrt(max(p * (1 - p), 0.01) / t)


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's hash, which tell the rows apart."""
    return common.text_of(docs).withColumn("text_hash", F.xxhash64("text"))


def described(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """Of each row: its text's hash, n_shingles, two halves of its set's fingerprint, its band keys and one byte of each bin."""

    def run(batches):
        for batch in kernels.parts(batches):
            texts = kernels.raw(batch)
            for a, b in kernels.chunks(texts):
                h, counts = kernels.shingle_sets(texts[a:b], k)
                ends = np.concatenate(([0], np.cumsum(counts)))
                prints = []
                for salt in (1, 2):
                    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(kernels.mix(h + np.uint64(salt)))))
                    prints.append(kernels.mix(total[ends[1:]] - total[ends[:-1]] + counts.astype(np.uint64)).view(np.int64))
                sketch = sketches(h, counts, bands * rows)
                keys = band_keys(sketch, bands, rows).view(np.int64)
                small = (kernels.mix(sketch) >> np.uint64(56)).astype(np.uint8)
                lists = pa.ListArray.from_arrays(np.arange(0, len(keys) * bands + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("text_hash")[a:b], pa.array(counts, pa.int64()), pa.array(prints[0]), pa.array(prints[1]), lists, pa.array([x.tobytes() for x in small], pa.binary())], ["doc_id", "text_hash", "n_shingles", "f1", "f2", "keys", "sketch"])

    return hashed(docs).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, keys array<long>, sketch binary")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """The sorted shingle hashes of each text as bytes."""

    def run(batches):
        for batch in kernels.parts(batches):
            texts = kernels.raw(batch)
            for a, b in kernels.chunks(texts):
                h, counts = kernels.shingle_sets(texts[a:b], k)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([batch.column("rep")[a:b], pa.array([h[s:e].tobytes() for s, e in zip((ends - counts).tolist(), ends.tolist())], pa.binary())], ["rep", "set"])

    return docs.select("rep", "text").mapInArrow(run, "rep long, set binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            keep, last, left = [], None, None
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x = x.as_buffer()
                if last is None or not last.equals(x):
                    last, left = x, np.frombuffer(x, dtype=np.uint64)
                right = np.frombuffer(y.as_buffer(), dtype=np.uint64)
                small, large = min(len(left), len(right)), max(len(left), len(right))
                if 100 * small < percent * large:
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(left, right), len(left) - 1)
                common_ = int((left[at] == right).sum())
                keep.append(100 * common_ >= percent * (len(left) + len(right) - common_))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _possible(pairs: DataFrame, sketched: DataFrame, percent: int, t: int) -> DataFrame:
    """The pairs (a, b) whose sketches leave a link possible."""
    least = least_share(percent, t) * t

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, t) for c in ("of_a", "of_b"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    left = sketched.select(F.col("rep").alias("a"), F.col("sketch").alias("of_a"))
    right = sketched.select(F.col("rep").alias("b"), F.col("sketch").alias("of_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _across(members: DataFrame, percent: int, t: int, block: int = 512) -> DataFrame:
    """Links (a, b) that join components within each group of (group, rep, component, sketch, set).

    A group is cut into blocks by hash, of which every two meet on their own, so a task holds two
    blocks of sets however large the group is. Pairs that the sketches leave possible are compared on
    their sets right there, and only links that join two components leave the task.
    """
    least = least_share(percent, t) * t
    sizes = members.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = members.join(sizes, "group").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    dealt = met.select("group", "i", "j", "own", "rep", "component", "sketch", "set").repartition(F.col("group"), F.col("i"), F.col("j")).sortWithinPartitions("group", "i", "j")

    def links(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        group = pa.Table.from_batches(rows)
        rep, component, own = (group.column(c).to_numpy() for c in ("rep", "component", "own"))
        component = component.copy()
        inner = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, t)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("set").to_pylist()]
        size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        found = []
        for x in range(len(rep)):
            near = (component != component[x]) & (rep > rep[x]) & ((own != own[x]) | inner) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
            y = np.flatnonzero(near)
            if len(y):
                y = y[(sketch[y] == sketch[x]).sum(axis=1) >= least]
            for part in range(0, len(y), 64):
                z = y[part : part + 64]
                other = np.concatenate([sets[i] for i in z])
                at = np.minimum(np.searchsorted(sets[x], other), size[x] - 1)
                ends = np.cumsum(size[z])
                both = np.diff(np.concatenate(([0], np.cumsum(sets[x][at] == other)[ends - 1])))
                for i in z[100 * both >= percent * (size[x] + size[z] - both)]:
                    if component[i] != component[x]:
                        found.append((rep[x], rep[i]))
                        component[component == component[i]] = component[x]
        a, b = (np.array(c, dtype=np.int64) for c in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches):
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("group", "i", "j")]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for s, e in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                here = tuple(int(c[s]) for c in columns)
                if held and here != key:
                    yield links(held)
                    held = []
                key = here
                held.append(batch.slice(s, e - s))
        if held:
            yield links(held)

    return dealt.mapInArrow(run, "a long, b long")


def _labels(reps: DataFrame, links: DataFrame) -> DataFrame:
    """rep and component of every class, linked or not."""
    of = components(links).select(F.col("node").alias("rep"), "component")
    return reps.join(of, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))


def _met(members: DataFrame, of: DataFrame) -> DataFrame:
    """members with what is known of their buckets; a bucket that very many share meets them in SALTS places."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    places = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(places, ["bucket", "salt"]).drop("salt")


def _set_links(docs: DataFrame, k: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The described rows, the distinct sets (f1, f2, rep, doc_id, text_hash) and the links (a, b) of sets.

    Each set has a number of its own, rep, in the order of the least doc_id that has it; doc_id and
    text_hash are those of the row that stands for it.
    """
    t = bands * rows
    narrow = common.cut(described(docs, k, bands, rows), splits=2)
    prints = narrow.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # rows with equal sets: the smallest doc_id, then the smallest hash, stands for the set
    firsts = prints.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "text_hash")).alias("_first")).select("f1", "f2", "_first.*")
    firsts = common.cut(firsts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "f1", "f2").withColumn("rep", F.monotonically_increasing_id()))
    by_set = common.cut(prints.join(firsts, ["f1", "f2", "doc_id", "text_hash"]).select("rep", "keys", "sketch").dropDuplicates(["rep"]))
    members = by_set.select("rep", F.explode("keys").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader != last")
    members = common.cut(_met(members, shared.select("bucket", "leader")))
    sketched = by_set.select("rep", "sketch")
    stars = members.where("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    stars = common.cut(_possible(stars, sketched, percent, t))
    # the sets of the candidates alone
    wanted = members.select("rep").distinct()
    rows_of = firsts.join(wanted, "rep", "left_semi").select("doc_id", "text_hash", "rep")
    sets = common.cut(_sets(hashed(docs).join(rows_of, ["doc_id", "text_hash"]), k).dropDuplicates(["rep"]))
    links = common.cut(_linked(stars, sets, percent))
    labels = common.cut(_labels(wanted, links))
    labelled = members.select("bucket", "rep").join(labels, "rep")
    several = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket")
    rest = common.cut(_met(labelled, several))
    # classes that share an unresolved bucket, directly or by further buckets, are one group
    heads = rest.groupBy("bucket").agg(F.min("rep").alias("a"))
    groups = components(_met(rest, heads).select("a", F.col("rep").alias("b")).where("a != b").distinct())
    rest = rest.select("rep", "component").distinct().join(groups.select(F.col("node").alias("rep"), F.col("component").alias("group")), "rep")
    rest = rest.join(sketched, "rep").join(sets, "rep")
    return narrow, firsts, common.cut(links.unionByName(_across(rest, percent, t)))


def _id_links(narrow: DataFrame, firsts: DataFrame) -> DataFrame:
    """Links (a, b) of the sets that rows of one doc_id have."""
    prints = narrow.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "f1", "f2")
    each = F.struct("f1", "f2")
    several = prints.groupBy("doc_id").agg(F.min(each).alias("low"), F.max(each).alias("high")).where("low != high").select("doc_id")
    held = common.cut(prints.join(several, "doc_id", "left_semi").join(firsts.select("f1", "f2", "rep"), ["f1", "f2"]).select("doc_id", "rep").distinct())
    heads = held.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return held.join(heads, "doc_id").where("a != rep").select("a", F.col("rep").alias("b"))


def classes(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    With the defaults a pair at the threshold is missed with probability (1 - 0.8**4)**32 < 1e-7.
    """
    narrow, firsts, links = _set_links(docs, k, percent, bands, rows)
    of = _labels(firsts.select("rep"), links.unionByName(_id_links(narrow, firsts)))
    # sets are numbered in the order of doc_id, so a component's least set has its least doc_id
    ids = firsts.select(F.col("rep").alias("component"), F.col("doc_id").alias("component_id"))
    alone = of.where("rep = component").join(firsts, "rep").select("f1", "f2", F.col("doc_id").alias("_component"))
    others = of.where("rep != component").join(firsts.select("f1", "f2", "rep"), "rep").join(ids, "component").select("f1", "f2", F.col("component_id").alias("_component"))
    out = narrow.select("doc_id", "n_shingles", "f1", "f2").join(alone.unionByName(others), ["f1", "f2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def survivors(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, text_hash and whole of the rows that stay: one for each class of near-duplicate texts, and
    (whole) every row without shingles.

    Rows are classed by their own texts alone, so a row never goes for the class of another row of its doc_id.
    """
    narrow, firsts, links = _set_links(docs, k, percent, bands, rows)
    of = _labels(firsts.select("rep"), links)
    first = firsts.join(of.where("rep = component"), "rep", "left_semi").select("doc_id", "text_hash", F.lit(False).alias("whole"))
    return first.unionByName(narrow.where("n_shingles = 0 and doc_id is not null").select("doc_id", "text_hash", F.lit(True).alias("whole")).distinct())

"""A quality classifier: naive Bayes features in a linear hinge-loss model.

The features are indicators of n-grams: words and word pairs, and runs of one to five word shapes (what
a word begins and ends with, its case, and whether it repeats the word before it). Each indicator
is scaled by its log-count ratio between the classes, the features of a document are brought to
length one, and a linear model is fitted by dual coordinate descent. Margins become scores by a
logistic curve that meets the cut-off at the margin where out-of-fold predictions are best.

Training rows: the labelled documents allowed for it, at most `sample` of them, chosen by hash, and of
those as many as have FEATURES indicators together (134 MB, however long texts are). One task fits the
model on them; the driver gets the model alone (2 MB).

Defined cases: a null or empty text is scored by the model's bias; a very long text has at most 2**17
indicators; labels other than 0 and 1 are left out and of several labels of a document the largest counts;
without training rows of both classes every score is that class's own (0.5 without any); of cuts with
equally few errors the middle one is taken; repeated rows get equal scores; an empty table gives no rows;
further columns, whatever their names, are kept.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm import common, kernels

BITS = 17
SIZE = 1 << BITS
CUTOFF = 0.7
#: Indicators of all training rows together, at most.
FEATURES = 1 << 25
#: Documents looked at together: the table of their indicators takes GROUP * SIZE bytes.
GROUP = 128

# classes of bytes for word shapes: a lower, A upper, 0 digit, other ASCII signs as they are, the rest as lower
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = 97
SHAPE[65:91] = 65
SHAPE[48:58] = 48
SHAPE[128:] = 97


def indicators(texts: list[bytes]):
    """Yields, for runs of texts, the position of each text there and the feature of each indicator it has."""
    at = 0
    for a, b in kernels.chunks(texts):
        for c in range(a, b, GROUP):
            part = texts[c : min(c + GROUP, b)]
            owner, feature = _indicators(part)
            yield at, len(part), owner, feature
            at += len(part)


def _indicators(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = kernels.SPACE[raw]
    flips = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = flips[0::2], flips[1::2]
    bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    owner = np.searchsorted(bounds, starts, side="right")
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    word = kernels.span_hashes(kernels.LOWER[raw], starts, ends)
    shape = SHAPE[raw]
    upper = np.concatenate(([0], np.cumsum(shape == 65)))
    lower = np.concatenate(([0], np.cumsum(shape == 97)))
    n_upper, n_lower = upper[ends] - upper[starts], lower[ends] - lower[starts]
    same = np.zeros(len(word), dtype=bool)
    same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    second_last = np.where(ends - starts > 1, shape[ends - 2], 0)
    case = np.where(n_upper == 0, 0, np.where(n_lower > 0, 1, np.where(n_upper > 1, 2, 3)))
    kind = ((shape[starts].astype(np.uint64) * np.uint64(256) + shape[ends - 1]) * np.uint64(256) + second_last.astype(np.uint64)) * np.uint64(8) + (case * 2 + same).astype(np.uint64)
    kind = kernels.mix(kind + np.uint64(1))
    grams = []
    for stream, longest, salt in ((word, 2, 11), (kind, 5, 23)):
        h = kernels.mix(stream + np.uint64(salt))
        grams.append((owner, h))
        for n in range(2, longest + 1):
            h = kernels.mix(h[:-1] * np.uint64(kernels.BASE) + stream[n - 1 :])
            inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
            grams.append((owner[n - 1 :][inside], h[inside]))
    table = np.zeros(len(texts) * SIZE, dtype=bool)
    for own, h in grams:
        table[(own << BITS) + (h >> np.uint64(64 - BITS)).astype(np.int64)] = True
    held = np.flatnonzero(table)
    return held >> BITS, held & (SIZE - 1)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Of each feature: the log of its smoothed share in the good class over that in the bad one."""
    counts = []
    for label in (1, -1):
        c = np.full(SIZE, smooth)
        for x, t in zip(rows, y):
            if t == label:
                c[x] += 1  # a row has no indicator twice
        counts.append(c / c.sum())
    return np.log(counts[0] / counts[1])


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = 12) -> np.ndarray:
    """Weights of the linear hinge-loss model on rows whose indicators are scaled and brought to
    length one, with a constant feature at the end. Scaled values are made anew at each step: those of all
    rows would take twice the room of the rows."""
    w = np.zeros(SIZE + 1)
    alpha = np.zeros(len(rows))
    norms, squares = np.ones(len(rows)), np.zeros(len(rows))
    for i, x in enumerate(rows):
        v = scale[x]
        norms[i] = np.sqrt((v * v).sum()) or 1.0
        v /= norms[i]
        squares[i] = v @ v
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, t = rows[i].astype(np.intp), y[i]
            v = scale.take(x) / norms[i]
            held = w.take(x)
            gradient = t * (held @ v + w[SIZE]) - 1
            new = min(max(alpha[i] - gradient / (squares[i] + 1.0), 0.0), cost[i])
            step = (new - alpha[i]) * t
            if step:
                alpha[i] = new
                w[x] = held + step * v
                w[SIZE] += step
    return w


def margins(rows: list[np.ndarray], scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = []
    for x in rows:
        v = scale[x]
        norm = np.sqrt((v * v).sum())
        out.append((w[x] @ v) / norm + w[SIZE] if norm else w[SIZE])
    return np.array(out)


class Model:
    """Weights by feature and the curve from margins to scores; arrays of 2**17 numbers."""

    def __init__(self, linear: np.ndarray, squares: np.ndarray, bias: float, slope: float, shift: float, constant: float | None = None):
        self.linear, self.squares, self.bias, self.slope, self.shift, self.constant = linear, squares, bias, slope, shift, constant

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.zeros(len(texts))
        for at, n, owner, feature in indicators(texts):
            total = np.bincount(owner, self.linear[feature], minlength=n)
            norm = np.sqrt(np.bincount(owner, self.squares[feature], minlength=n))
            out[at : at + n] = np.where(norm > 0, total / np.maximum(norm, 1e-12), 0) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * (out - self.shift), -30, 30) - np.log(CUTOFF / (1 - CUTOFF))))


def fit(rows: list[np.ndarray], quality: np.ndarray, folds: int = 3) -> Model:
    """The model of labelled rows (quality 0 or 1)."""
    y = np.where(quality == 1, 1, -1)
    if not len(y) or (y == y[0]).all():
        return Model(*[np.zeros(0)] * 2, 0, 0, 0, constant=0.5 if not len(y) else float(y[0] == 1))
    share = {t: len(y) / (2 * (y == t).sum()) for t in (1, -1)}

    def trained(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, t = [rows[i] for i in which], y[which]
        scale = log_count_ratios(own, t)
        return scale, dual_coordinate_descent(own, t, scale, np.array([4 * share[k] for k in t]))

    fold = np.arange(len(y)) % folds
    out = np.zeros(len(y))
    for k in range(folds):
        scale, w = trained(np.flatnonzero(fold != k))
        out[fold == k] = margins([rows[i] for i in np.flatnonzero(fold == k)], scale, w)
    # the cut with the fewest out-of-fold errors, in the middle of its gap
    order = np.argsort(out, kind="stable")
    m, t = out[order], y[order]
    errors = np.concatenate(([0], np.cumsum(t == 1))) + np.concatenate((np.cumsum((t == -1)[::-1])[::-1], [0]))
    edges = np.concatenate(([m[0] - 1], m, [m[-1] + 1]))
    best = np.flatnonzero(errors == errors.min())
    cut = best[len(best) // 2]
    shift = (edges[cut] + edges[cut + 1]) / 2
    scale, w = trained(np.arange(len(y)))
    return Model(scale * w[:SIZE], scale * scale, float(w[SIZE]), 4.0, float(shift))


def _training(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Labels and indicators (32 bits each) of at most `sample` documents and FEATURES indicators, chosen by
    hash, in one partition and in order of that hash."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in kernels.parts(batches):
            texts = kernels.raw(batch)
            rows = []
            for _, n, owner, feature in indicators(texts):
                cuts = np.searchsorted(owner, np.arange(n + 1))
                rows += [feature[s:e].astype(np.int32).tobytes() for s, e in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.binary())], ["doc_id", "quality", "features"])

    # `chosen` has at most `sample` rows of two numbers
    order = [F.xxhash64("doc_id"), "doc_id", "features"]
    rows = common.text_of(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, quality int, features binary").orderBy(*order).limit(sample)
    so_far = F.sum(F.octet_length("features") / 4).over(Window.orderBy(*order))  # of `sample` rows at most
    return rows.withColumn("so_far", so_far).where(F.col("so_far") <= FEATURES).select("quality", "features")


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The training rows' indicators and labels on the driver, to look at them; `fitted` does without."""
    found = _training(docs, labels, sample).collect()
    return [np.frombuffer(r["features"], dtype=np.int32) for r in found], np.array([r["quality"] for r in found], dtype=np.int64)


def fitted(docs: DataFrame, labels: DataFrame, sample: int) -> Model:
    """The model of the training rows, fitted by the task that has them."""

    def run(batches):
        rows, quality = [], []
        for batch in batches:
            rows += [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in batch.column("features")]  # without a copy
            quality += batch.column("quality").to_pylist()
        model = pickle.dumps(fit(rows, np.array(quality, dtype=np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    found = _training(docs, labels, sample).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], np.zeros(0, dtype=np.int64))


def scored(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> DataFrame:
    """docs with the columns score and predicted (replaced if there), from a model of `labels`."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text.fill_null("")], ["text"])
        parts = [shared.value.scores(kernels.raw(part)) for part in kernels.parts([batch])]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return docs.withColumn("score", score(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))


def held_out(doc_id):
    """Rows whose labels are kept from training: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))

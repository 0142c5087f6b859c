"""Byte spans that also start earlier in the corpus, removed from every later document.

Anchors (minimizers) bring together all occurrences of each string of `window` bytes: equal windows have
their anchor at the same place within them. Around each anchor that occurs more than once the bytes of
the windows it belongs to are gathered by the anchor's hash. Of the distinct ones of many groups, the
stretches whose windows have a fingerprint that occurs again are laid end to end, their suffix array
is built by linear grouping, and suffixes that stand next to each other and agree in `window` bytes
are occurrences of one string. All but the earliest are covered. The fingerprints only choose what is
compared; the suffix array decides on the bytes.

Order: smaller doc_id first, within a document the earlier start. Defined cases: a null or empty text has
no bytes; rows equal in doc_id and text are one document and get equal results; rows of one doc_id
with other texts are further documents, in order of their text's hash; a null doc_id comes before all
others; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import anchors, common, kernels
from loomgraph.llm.suffix_array import suffix_array

#: Distinct bytes whose windows are looked at together, and those for which one suffix array is built.
LOAD, SORTED = 1 << 20, 1 << 16
#: Marks of anchors whose hash occurs so often among those given out together.
AGAIN, FIRST, FREQUENT = 1 << 62, 1 << 61, 64
#: Contexts that a task remembers.
SEEN = 1 << 17


def _groups(batches, names: list[str]):
    """Runs of rows with equal values in the named columns, of rows sorted by them; a run may come in parts."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for s, e in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
            here = tuple(c[s] for c in columns)
            yield here != last, here, batch.slice(s, e - s)
            last = here


def _anchored(docs: DataFrame, window: int) -> DataFrame:
    """h, doc, th and meta of every anchor; meta packs its place and how far its windows start before it.

    Among the anchors given out together, the first of each frequent hash is marked FIRST and the others
    AGAIN: those are known to be repeated, so only the first has to meet the hash's others.
    """

    def run(batches):
        for batch in batches:
            ids, hashes = batch.column("doc").to_numpy(), batch.column("th").to_numpy()
            out = [[], [], [], []]

            def packed():
                h, doc, th, meta = (np.concatenate(c) for c in out)
                _, first, of, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                frequent = counts[of] >= FREQUENT
                meta = np.where(frequent, meta | AGAIN, meta)
                first = first[frequent[first]]
                meta[first] ^= AGAIN | FIRST
                return pa.RecordBatch.from_arrays([pa.array(c) for c in (h, doc, th, meta)], ["h", "doc", "th", "meta"])

            have = 0  # anchors not yet given out
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                data = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                if len(data) < window:
                    continue
                at, h, first, last = anchors.owned(data, window)
                out[0].append(h.view(np.int64))
                out[1].append(np.full(len(at), ids[i]))
                out[2].append(np.full(len(at), hashes[i]))
                out[3].append(at << 16 | (at - first) << 8 | (at - last))
                have += len(at)
                if have > 100_000:
                    yield packed()
                    out, have = [[], [], [], []], 0
            if have:
                yield packed()

    return docs.mapInArrow(run, "h long, doc long, th int, meta long")


def _repeated(found: DataFrame) -> DataFrame:
    """The anchors whose hash occurs more than once; runs of a hash are streamed, not held.

    What is marked AGAIN is dealt out by its place, so a hash that very many anchors have is spread.
    """

    def run(batches):
        held, given = None, False  # the last row so far, and whether it was given out
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            h, meta = rows.column("h").to_numpy(), rows.column("meta").to_numpy()
            same = h[1:] == h[:-1]
            keep = meta >= FIRST
            keep[1:] |= same
            keep[:-1] |= same
            held, last = rows.slice(len(h) - 1), bool(keep[-1])
            if given:
                keep[0] = False
            kept = rows.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*kept.columns[:3], pa.array(kept.column("meta").to_numpy() & (FIRST - 1))], kept.schema.names)
            given = last

    dealt = F.when(F.col("meta") >= AGAIN, F.xxhash64("doc", "meta")).otherwise(F.col("h"))
    return found.repartition(dealt).sortWithinPartitions("h").mapInArrow(run, found.schema)


def _contexts(repeats: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """h, doc, th, first start, number of further starts and the bytes of the windows of each repeated anchor.

    What a task has given out before is not sent again: such windows stand earlier, so they come as
    runs without bytes, dealt out anew. A task so sends each context of a hot anchor about once.
    """
    left = texts.select("doc", "th", F.lit(-1).cast("long").alias("meta"), F.lit(0).cast("long").alias("h"), "packed")
    right = repeats.select("doc", "th", "meta", "h", F.lit(None).cast("binary").alias("packed"))
    met = left.unionByName(right).repartition("doc", "th").sortWithinPartitions("doc", "th", "meta")

    def run(batches):
        text, unpack = b"", zstandard.ZstdDecompressor().decompress
        seen: set[bytes] = set()
        last_meta = -1
        for new, _, part in _groups(batches, ["doc", "th"]):
            meta = part.column("meta").to_numpy()
            if new:
                text, last_meta = unpack(part.column("packed")[0].as_py()), -1
            other = np.diff(meta, prepend=last_meta) > 0  # not the texts, and an anchor of a document's copies once
            last_meta = int(meta[-1])
            part, meta = part.filter(pa.array(other)), meta[other]
            if not len(meta):
                continue
            at = meta >> 16
            first, last = at - (meta >> 8 & 255), at - (meta & 255)
            contexts, known = [], []
            for a, b in zip(first.tolist(), (last + window).tolist()):
                c = text[a:b]
                known.append(c in seen)
                if known[-1]:
                    contexts.append(None)
                else:
                    contexts.append(c)
                    seen.add(c)
            if len(seen) > SEEN:
                seen.clear()
            h = part.column("h").to_numpy().copy()
            again = np.array(known)
            h[again] = kernels.mix((part.column("doc").to_numpy() + at).astype(np.uint64)).view(np.int64)[again]
            yield pa.RecordBatch.from_arrays([pa.array(h), part.column("doc"), part.column("th"), pa.array(first), pa.array((last - first).astype(np.int32)), pa.array(contexts, pa.binary())], ["h", "doc", "th", "start", "more", "context"])

    return met.mapInArrow(run, "h long, doc long, th int, start long, more int, context binary")


def later_windows(contexts: list[bytes], firsts: list[tuple], window: int) -> list[np.ndarray]:
    """For each context: the offsets of the windows that also start earlier.

    `firsts` are the contexts' places (doc, th, start), all different; a window's place is its context's
    with the offset added. Equal windows are neighbours in the suffix array.
    """
    marks = [np.zeros(max(len(c) - window + 1, 0), dtype=bool) for c in contexts]
    if len(contexts) < 2:
        return marks
    text = np.frombuffer(b"\0".join(contexts) + b"\0", dtype=np.uint8)
    symbols = text.astype(np.int64) + 1
    sizes = np.fromiter((len(c) + 1 for c in contexts), dtype=np.int64, count=len(contexts))
    begin = np.cumsum(sizes) - sizes
    symbols[begin + sizes - 1] = 0
    of = np.repeat(np.arange(len(contexts)), sizes)
    offset = np.arange(len(text)) - begin[of]
    whole = offset + window < sizes[of]
    order = suffix_array(symbols)
    order = order[whole[order]]
    if len(order) < 2:
        return marks
    view = np.lib.stride_tricks.sliding_window_view(text, window)
    same = np.concatenate([(view[order[a : a + 8192]][1:] == view[order[a : a + 8192]][:-1]).all(axis=1) for a in range(0, len(order) - 1, 8191)])
    string = np.concatenate(([0], np.cumsum(~same)))
    place = np.array(firsts, dtype=np.int64)[of[order]]
    start = place[:, 2] + offset[order]
    by = np.lexsort((start, place[:, 1], place[:, 0], string))
    first = np.ones(len(by), dtype=bool)
    first[1:] = string[by][1:] != string[by][:-1]
    for p in order[by[~first]].tolist():
        marks[of[p]][offset[p]] = True
    return marks


def shared_runs(contexts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """context, first and last offset of the runs of windows whose fingerprints occur more than once."""
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    sizes = np.fromiter(map(len, contexts), dtype=np.int64, count=len(contexts))
    begin = np.cumsum(sizes) - sizes
    at = kernels.ragged(begin, np.maximum(sizes - window + 1, 0))
    _, string, counts = np.unique(anchors.gram_hashes(data, window)[at], return_inverse=True, return_counts=True)
    at = at[counts[string] > 1]
    new = np.ones(len(at), dtype=bool)
    new[1:] = np.diff(at) > 1  # window - 1 places lie between the windows of two contexts
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] if len(at) else at
    which = np.searchsorted(begin, first, side="right") - 1
    return which, first - begin[which], last - begin[which]


def covered_runs(contexts: list[bytes], places: list[tuple], groups: list[int], window: int):
    """doc, th, first and last start of the runs of windows that also start earlier.

    `places` (doc, th, start) ascend within a group; equal windows are always of one group.
    """
    out = []
    parts: list[bytes] = []
    firsts: list[tuple] = []
    load, last, seen = 0, None, set()

    def resolved():
        for (doc, th, start), mark in zip(firsts, later_windows(parts, firsts, window)):
            edges = np.flatnonzero(np.diff(np.concatenate(([0], mark.astype(np.int8), [0]))))
            out.extend((doc, th, start + a, start + b - 1) for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist()))
        parts.clear()
        firsts.clear()

    def closed():
        nonlocal load
        if len(seen) == 1:  # no other is left to compare it with, and it does not repeat itself
            load -= len(parts.pop())
            firsts.pop()
        seen.clear()
        if load >= SORTED:
            resolved()
            load = 0

    for which, a, b in zip(*(x.tolist() for x in shared_runs(contexts, window))):
        if groups[which] != last:
            closed()
            last = groups[which]
        doc, th, start = places[which]
        part = contexts[which][a : b + window]
        if part in seen:  # all its windows stand earlier
            out.append((doc, th, start + a, start + b))
        else:
            seen.add(part)
            parts.append(part)
            firsts.append((doc, th, start + a))
            load += len(part)
    closed()
    if parts:
        resolved()
    return out


def _covered(contexts: DataFrame, window: int) -> DataFrame:
    """doc, th, and the first and last start of runs of windows that also start earlier."""
    dealt = contexts.repartition("h").sortWithinPartitions("h", "doc", "th", "start")

    def run(batches):
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        waiting: list[bytes] = []  # what was new in its group, its place and its group
        places: list[tuple] = []
        groups: list[int] = []
        seen: set[bytes] = set()
        load, group, last = 0, -1, None

        def given(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], ["doc", "th", "a", "b"])

        def known(rows):
            return pa.RecordBatch.from_arrays([rows.column("doc"), rows.column("th"), rows.column("start"), pa.array(rows.column("start").to_numpy() + rows.column("more").to_numpy(), pa.int64())], ["doc", "th", "a", "b"])

        def closed():
            # equal windows have their anchor at the same place, so no context repeats itself
            nonlocal load
            if len(seen) == 1:
                load -= len(waiting.pop())
                places.pop()
                groups.pop()

        for batch in batches:
            runs = batch.filter(batch.column("context").is_null())
            yield known(runs)
            batch = batch.filter(batch.column("context").is_valid())
            # the first of each distinct context of the batch; the others' windows all stand earlier
            codes = batch.column("context").dictionary_encode().indices.to_numpy()
            first = np.zeros(len(codes), dtype=bool)
            first[np.unique(codes, return_index=True)[1]] = True
            yield known(batch.filter(pa.array(~first)))
            out = []
            own = batch.filter(pa.array(first))
            for h, doc, th, start, context in zip(*(own.column(c).to_pylist() for c in ("h", "doc", "th", "start", "context"))):
                if h != last:
                    closed()
                    group, last = group + 1, h
                    seen.clear()
                    if load >= LOAD:
                        yield given(covered_runs(waiting, places, groups, window))
                        waiting.clear()
                        places.clear()
                        groups.clear()
                        load = 0
                if context in seen:
                    out.append((doc, th, start, start + len(context) - window))
                    continue
                seen.add(context)
                waiting.append(context)
                places.append((doc, th, start))
                groups.append(group)
                load += len(context)
            if out:
                yield given(out)
        closed()
        if waiting:
            yield given(covered_runs(waiting, places, groups, window))

    return dealt.mapInArrow(run, "doc long, th int, a long, b long")


def without_repeats(docs: DataFrame, window: int = 100, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (with_text) the kept bytes and removed spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.hash(text).alias("th"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    def pack(batches):
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "th", "doc_id")), pa.array([compress(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())], ["doc", "th", "doc_id", "packed"])

    texts = rows.mapInArrow(pack, "doc long, th int, doc_id long, packed binary")
    repeats = _repeated(_anchored(rows.select("doc", "th", "text"), window))
    covered = common.stored(_covered(_contexts(repeats, texts, window), window))
    docs.sparkSession._jvm.System.gc()  # lets Spark drop the shuffle files of what is stored now
    end = (1 << 63) - 1
    left = texts.select("doc", "th", F.lit(end).alias("run"), "doc_id", "packed")
    packed_run = F.shiftleft("a", 16).bitwiseOR(F.col("b") - F.col("a"))  # a run is shorter than two windows
    right = covered.select("doc", "th", packed_run.alias("run"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("packed"))
    met = left.unionByName(right).repartition("doc", "th").sortWithinPartitions("doc", "th", "run")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "spans"] if with_text else [])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary(), pa.list_(pa.list_(pa.int64()))] if with_text else [])]

    def run(batches):
        spans, unpack = [], zstandard.ZstdDecompressor().decompress
        for new, _, part in _groups(batches, ["doc", "th"]):
            runs = part.column("run").to_numpy()
            n = int(np.searchsorted(runs, end))
            if new:
                spans = []
            if n:
                spans.append(runs[:n])
            part = part.slice(n)
            if not part.num_rows:
                continue
            out = []
            for doc_id, packed in zip(part.column("doc_id").to_pylist(), part.column("packed").to_pylist()):
                data = np.frombuffer(unpack(packed), dtype=np.uint8)
                change = np.zeros(len(data) + 1, dtype=np.int64)
                for run in spans:
                    np.add.at(change, run >> 16, 1)
                    np.add.at(change, (run >> 16) + (run & 0xFFFF) + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                kept = data[~gone].tobytes()
                more = [kept, edges.reshape(-1, 2).tolist()] if with_text else []
                out.append((doc_id, len(data), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), *more))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    more = ", kept binary, spans array<array<long>>" if with_text else ""
    return met.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")

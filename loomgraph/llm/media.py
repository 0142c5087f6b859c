"""Texts as GIF columns: stored losslessly as samples, read back as timed frames with colour histograms.

Defined cases: a null text is empty and takes one row of blanks; a very long text takes as many frames as
it needs; repeated rows, equal texts and null ids are stored like others; a null or broken stream has no
frames, and what a frame has beyond the canvas is not shown; an empty table gives no rows; further columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm import common, gif, kernels

WIDTH = 192
#: Rows in a frame; longer texts take further frames.
ROWS = 256


def payload(text: bytes) -> bytes:
    """The text with blanks up to a positive multiple of the width."""
    return text + b" " * (-len(text) % WIDTH or (0 if text else WIDTH))


def stored(data: bytes) -> bytes:
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, WIDTH)
    return gif.write([rows[a : a + ROWS] for a in range(0, len(rows), ROWS)])


def described(media: bytes) -> tuple[bytes, str]:
    """The stored bytes read back, and the features: size, frames, time and the brightness histogram."""
    width, height, frames = gif.read(media)
    total = np.zeros(64, dtype=np.int64)
    for canvas in gif.shown(width, height, frames):
        total += gif.histogram(canvas)
    grey = total.reshape(4, 4, 4)[range(4), range(4), range(4)]
    feature = f"{width}x{height};frames={len(frames)};ms={sum(f.delay_ms for f in frames)};grey={','.join(map(str, grey.tolist()))}"
    return b"".join(f.samples.tobytes() for f in frames), feature


def store(docs: DataFrame) -> DataFrame:
    """doc_id and the GIF stream of every document's text."""

    def run(batches):
        for batch in kernels.parts(batches):
            texts = kernels.raw(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([stored(payload(t)) for t in texts], pa.binary())], ["doc_id", "media"])

    return common.text_of(docs).mapInArrow(run, "doc_id long, media binary")


def frames(media: DataFrame, bins: int = 4) -> DataFrame:
    """A row for each frame of doc_id and media: its number, times in ms, size, and the histogram of
    what is shown with it (an array of bins**3 counts)."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
                try:
                    width, height, found = gif.read(data or b"")
                except ValueError:
                    continue
                start = 0
                for k, (f, canvas) in enumerate(zip(found, gif.shown(width, height, found))):
                    rows.append((doc_id, k, start, f.delay_ms, width, height, gif.histogram(canvas, bins).tolist()))
                    start += f.delay_ms
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "frame", "start_ms", "delay_ms", "width", "height", "histogram"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, frame int, start_ms long, delay_ms long, width int, height int, histogram array<long>")


def digests(docs: DataFrame) -> DataFrame:
    """Every text stored, read back and described in one pass, of which only digests leave the worker."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in kernels.parts(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), kernels.raw(batch)):
                media = stored(payload(text))
                back, feature = described(media)
                rows.append((doc_id, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return common.text_of(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

"""GIF streams: LZW coding, palettes, disposal, transparency and timed frames.

Encoding finds the longest known string code by code; decoding is by array passes: all code widths
between two clear codes are known from the codes' places, an entry is a stretch of the output that
begins where its first code begins, and pointers from each output byte to an earlier one are
followed by doubling.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

CLEAR, STOP, FIRST, FULL = 256, 257, 258, 4096


def _widths(n: int, bits: int = 8) -> np.ndarray:
    """The widths of the n codes behind a clear code."""
    first = (1 << bits) + 2
    known = first + np.maximum(np.arange(n) - 1, 0)
    known[:1] = first
    return np.clip(np.frexp(known.astype(np.float64))[1], bits + 1, 12)


_WIDTHS = _widths(FULL)


def compress(data: bytes) -> bytes:
    """The LZW code stream of 8-bit samples, without sub-blocks."""
    codes = [CLEAR]
    widths = [np.array([9])]
    at = 1  # where the codes behind the last clear code begin
    table: dict[int, int] = {}
    get, put = table.get, codes.append
    new, current = FIRST, -1
    for b in data:
        if current < 0:
            current = b
            continue
        key = current << 8 | b
        code = get(key)
        if code is not None:
            current = code
            continue
        put(current)
        table[key] = new
        new += 1
        current = b
        if new == FULL:
            put(current)  # the sample on its own, so that the table starts afresh behind it
            put(CLEAR)
            widths.append(_WIDTHS[: len(codes) - at])
            at = len(codes)
            table.clear()
            new, current = FIRST, -1
    if current >= 0:
        put(current)
    put(STOP)
    widths.append(_WIDTHS[: len(codes) - at])
    value, width = np.array(codes, dtype=np.uint16), np.concatenate(widths)
    places = np.arange(12)
    bits = (value[:, None] >> places.astype(np.uint16) & 1).astype(np.uint8)
    return np.packbits(bits[places < width[:, None]], bitorder="little").tobytes()


def decompress(stream: bytes, bits: int = 8) -> np.ndarray:
    """The samples of a code stream whose literals have so many bits."""
    clear = 1 << bits
    raw = np.frombuffer(stream + b"\0\0\0\0", dtype=np.uint8)
    total, at = 8 * len(stream), 0
    out, window = [], FULL
    while at < total:
        width = _WIDTHS if bits == 8 else _widths(FULL, bits)
        if window > FULL:
            width = np.concatenate((width, np.full(window - FULL, 12)))
        ends = np.cumsum(width)
        n = int(np.searchsorted(ends, total - at, side="right"))
        start = at + ends[:n] - width[:n]
        byte = start >> 3
        word = raw[byte].astype(np.uint32) | raw[byte + 1].astype(np.uint32) << 8 | raw[byte + 2].astype(np.uint32) << 16
        codes = ((word >> (start & 7).astype(np.uint32)) & ((1 << width[:n]) - 1).astype(np.uint32)).astype(np.int64)
        ends_at = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if not len(ends_at) and n == len(width):
            window *= 2  # a full table that is kept: codes go on at 12 bits
            continue
        n_codes = int(ends_at[0]) if len(ends_at) else n
        if n_codes:
            out.append(_strings(codes[:n_codes], clear))
        if not len(ends_at) or codes[n_codes] == clear + 1:
            break
        at += int(ends[n_codes])
        window = FULL
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint8)


def _strings(codes: np.ndarray, clear: int) -> np.ndarray:
    """What the codes between two clear codes stand for."""
    n = len(codes)
    index = np.arange(n)
    literal = codes < clear
    parent = np.where(literal, index, codes - (clear + 2))
    if (parent[~literal] >= index[~literal]).any():
        raise ValueError("a code stands for an entry that does not exist yet")
    depth, above = (~literal).astype(np.int64), parent
    while True:
        more = depth[above]
        if not more.any():
            break
        depth, above = depth + more, above[above]
    length = depth + 1
    start = np.cumsum(length) - length
    source = np.arange(int(length.sum())) - np.repeat(np.where(literal, 0, start - start[parent]), length)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    samples = np.zeros(len(source), dtype=np.uint8)
    samples[start[literal]] = codes[literal]
    return samples[source]


@dataclass
class Frame:
    """One image of a stream: its samples as rows, its place, and how it is shown."""

    samples: np.ndarray
    left: int
    top: int
    palette: np.ndarray
    delay_ms: int
    disposal: int
    transparent: int | None


def _blocks(data: bytes) -> bytes:
    """data in sub-blocks of at most 255 bytes."""
    full = len(data) // 255
    head = np.full((full, 256), 255, dtype=np.uint8)
    head[:, 1:] = np.frombuffer(data[: 255 * full], dtype=np.uint8).reshape(full, 255)
    tail = data[255 * full :]
    return head.tobytes() + (bytes([len(tail)]) + tail if tail else b"") + b"\0"


GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def write(frames: list[np.ndarray], palette: np.ndarray = GREY, delay_ms: int = 100, disposal: int = 1) -> bytes:
    """A stream of frames (rows of 8-bit samples) from the top left corner, each shown for delay_ms."""
    height, width = max(len(f) for f in frames), max(f.shape[1] for f in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for f in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2, delay_ms // 10, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, f.shape[1], len(f), 0, 8))
        out.append(_blocks(compress(f.tobytes())))
    return b"".join([*out, b"\x3b"])


def read(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and frames of a stream; ValueError if it is none."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF stream")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def colours(flags: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flags & 7)
        table = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
        at += 3 * n
        return table

    def sub_blocks() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    try:
        common = colours(flags) if flags & 0x80 else GREY
        frames, shown = [], (0, 0, None)
        while data[at] != 0x3B:
            kind = data[at]
            at += 1
            if kind == 0x21:
                label = data[at]
                at += 1
                block = sub_blocks()
                if label == 0xF9:
                    shown = (block[1] | block[2] << 8) * 10, block[0] >> 2 & 7, block[3] if block[0] & 1 else None
            elif kind == 0x2C:
                left, top, w, h, own = struct.unpack_from("<HHHHB", data, at)
                at += 9
                palette = colours(own) if own & 0x80 else common
                bits = data[at]
                at += 1
                samples = decompress(sub_blocks(), bits)[: w * h]
                if len(samples) < w * h:
                    raise ValueError("a frame ends early")
                samples = samples.reshape(h, w)
                if own & 0x40:
                    order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                    rows = np.empty_like(samples)
                    rows[order] = samples
                    samples = rows
                frames.append(Frame(samples, left, top, palette, *shown))
                shown = (0, 0, None)
            else:
                raise ValueError("an unknown block")
    except (IndexError, struct.error) as e:
        raise ValueError("the stream ends early") from e
    return width, height, frames


def shown(width: int, height: int, frames: list[Frame]):
    """The canvas (rows of RGBA) as each frame is shown; it is one array that the next frame changes."""
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        # what lies beyond the canvas is not shown
        h, w = max(min(len(f.samples), height - f.top), 0), max(min(f.samples.shape[1], width - f.left), 0)
        part = canvas[f.top : f.top + h, f.left : f.left + w]
        samples = f.samples[:h, :w]
        table = np.full((256, 4), (0, 0, 0, 255), dtype=np.uint8)
        table[: len(f.palette), :3] = f.palette
        if f.transparent is None:
            part[:] = table[samples]
        else:
            drawn = samples != f.transparent
            part[drawn] = table[samples[drawn]]
        yield canvas
        if f.disposal == 2:
            part[:] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(canvas: np.ndarray, bins: int = 4) -> np.ndarray:
    """Visible pixels by red, green and blue, each in `bins` equal parts."""
    seen = canvas[canvas[:, :, 3] > 0][:, :3].astype(np.int64) * bins >> 8
    return np.bincount((seen[:, 0] * bins + seen[:, 1]) * bins + seen[:, 2], minlength=bins**3)

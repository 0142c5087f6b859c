import hashlib
import zlib

import numpy as np
import pytest
from brute_force import ODD, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import catalog, gif, media

SF = "/root/testdata/sf0.001"


def plain_decompress(stream, bits=8):
    """Code by code, as the format describes it."""
    clear, stop = 1 << bits, (1 << bits) + 1
    value = int.from_bytes(stream, "little")
    at, width, table, last, out = 0, bits + 1, [], None, bytearray()
    while at + width <= 8 * len(stream):
        code = value >> at & (1 << width) - 1
        at += width
        if code == clear:
            table, last, width = [bytes([i]) for i in range(clear)] + [b"", b""], None, bits + 1
            continue
        if code == stop:
            break
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            if len(table) < 4096:
                table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) == 1 << width and width < 12:
            width += 1
    return bytes(out)


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(min_size=1, max_size=3000), st.text("ab", min_size=1, max_size=9000).map(str.encode)))
def test_code_streams(data):
    stream = gif.compress(data)
    assert plain_decompress(stream) == data
    assert gif.decompress(stream).tobytes() == data


def test_long_streams_restart_the_table():
    data = np.random.default_rng(1).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert plain_decompress(gif.compress(data)) == data == gif.decompress(gif.compress(data)).tobytes()


def test_query(spark):
    got = {r.doc_id: r for r in catalog.QUERIES["op3_gif_media"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = (d.text or "").encode()
        payload = text + b" " * (-len(text) % 192) if text else b" " * 192
        r = got.pop(d.doc_id)
        assert (r.n_bytes, r.payload_bytes) == (len(text), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        levels = [sum(b >> 6 == q for b in payload) if len(payload) <= 192 * 256 else None for q in range(4)]
        size = f"192x{min(256, len(payload) // 192)};frames={-(-len(payload) // 49152)};ms={100 * -(-len(payload) // 49152)};grey="
        assert r.media_bytes > 0 and r.feature.startswith(size)
        if None not in levels:  # one frame: the brightness of the payload's own bytes
            assert r.feature == size + ",".join(map(str, levels))
    assert not got


def test_frames_of_odd_documents(spark):
    stored = media.store(frame(spark, ODD))
    rows = media.frames(stored).collect()
    assert len({r.doc_id for r in rows}) == len({i for i, _ in ODD})
    assert all(sum(r.histogram) == r.width * min(256, r.height) or r.frame for r in rows)
    assert media.digests(frame(spark, [])).count() == 0
    broken = spark.createDataFrame([(1, b"GIF89a"), (2, None)], "doc_id long, media binary")
    assert media.frames(broken).count() == 0


def test_disposal_and_transparency():
    palette = np.zeros((4, 3), dtype=np.uint8)
    palette[1], palette[2] = (255, 0, 0), (0, 255, 0)
    base = np.full((2, 2), 1, dtype=np.uint8)
    over = np.array([[2, 3], [3, 3]], dtype=np.uint8)
    made = [gif.Frame(base, 0, 0, palette, 100, 1, None), gif.Frame(over, 0, 0, palette, 50, 3, 3), gif.Frame(over[:1, :1], 1, 1, palette, 50, 2, 3), gif.Frame(np.full((1, 1), 3, dtype=np.uint8), 0, 0, palette, 10, 1, 3)]
    seen = [c.copy() for c in gif.shown(2, 2, made)]
    assert seen[1][0, 0].tolist() == [0, 255, 0, 255] and seen[1][1, 1].tolist() == [255, 0, 0, 255]
    assert seen[2][0, 0].tolist() == [255, 0, 0, 255] and seen[2][1, 1].tolist() == [0, 255, 0, 255]
    assert seen[3][1, 1].tolist() == [0, 0, 0, 0]
    with pytest.raises(ValueError):
        gif.read(b"not a stream")


@pytest.mark.parametrize("place", [(5, 0), (0, 9), (70, 70), (1, 1)])
def test_frames_beyond_the_canvas(spark, place):
    stream = bytearray(gif.write([np.full((3, 10), 255, dtype=np.uint8)]))
    stream[6:10] = (2).to_bytes(2, "little") * 2  # the canvas is 2 by 2
    at = stream.index(b"\x2c\0\0\0\0")
    stream[at + 1 : at + 5] = place[0].to_bytes(2, "little") + place[1].to_bytes(2, "little")
    rows = media.frames(spark.createDataFrame([(1, bytearray(stream))], "doc_id long, media binary")).collect()
    assert len(rows) == 1 and (rows[0].width, rows[0].height) == (2, 2)
    assert sum(rows[0].histogram) == (1 if place == (1, 1) else 0)


def test_histograms_by_counting(spark):
    """Colours of several frames, counted pixel by pixel on a canvas kept by hand."""
    rng = np.random.default_rng(8)
    palette = rng.integers(0, 256, (256, 3)).astype(np.uint8)
    images = [rng.integers(0, 256, (5, 7)).astype(np.uint8) for _ in range(3)]
    row = [bytearray(gif.write(images, palette, 70))]
    got = sorted(media.frames(spark.createDataFrame([(1, *row)], "doc_id long, media binary")).collect(), key=lambda r: r.frame)
    for k, (r, image) in enumerate(zip(got, images)):
        wanted = [0] * 64
        for sample in image.reshape(-1):
            red, green, blue = (int(c) // 64 for c in palette[sample])
            wanted[16 * red + 4 * green + blue] += 1
        assert r.histogram == wanted and (r.start_ms, r.delay_ms) == (70 * k, 70)

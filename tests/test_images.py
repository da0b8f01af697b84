import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.operators import ocr
from folioflow.sources import images


def filtered_png(px, kinds, colour):
    """An image file whose rows use the given filters, written straight from the definition of each filter."""
    height, width, n = px.shape
    flat = px.reshape(height, width * n).astype(int)
    body = b""
    for y in range(height):
        kind = kinds[y % len(kinds)]
        row = [kind]
        for x in range(width * n):
            a = flat[y, x - n] if x >= n else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - n] if y and x >= n else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            row.append((flat[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        body += bytes(row)
    import struct

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([3, 4]), st.integers(0, 2**32 - 1), st.lists(st.integers(0, 4), min_size=1, max_size=5))
def test_pixels_come_back(height, width, n, seed, kinds):
    px = np.random.default_rng(seed).integers(0, 256, (height, width, n), np.uint8)
    assert (images.read_image(images.write_png(px)) == px).all()
    assert (images.read_image(filtered_png(px, kinds, {3: 2, 4: 6}[n])) == px).all()
    grey = px[:, :, :1]
    assert (images.read_image(filtered_png(grey, kinds, 0)) == np.repeat(grey, 3, 2)).all()


def test_scaling_keeps_means():
    px = np.random.default_rng(1).integers(0, 256, (40, 60, 3), np.uint8)
    small = images.scaled(px, 15)
    assert small.shape == (10, 15, 3) and abs(small.mean() - px.mean()) < 1
    assert (small == np.floor(px.reshape(10, 4, 15, 4, 3).mean((1, 3)) + 0.5)).all()
    assert images.scaled(px, 60) is px and images.scaled(px[:, :1], 20).shape == (20, 1, 3)


def test_images_are_redacted(spark):
    px = np.full((50, 100, 3), 200, np.uint8)
    rows = [(1, images.write_png(px)), (2, images.write_png(px)), (3, b"no image"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, content binary")
    boxes = spark.createDataFrame([(1, 0.1, 0.2, 0.3, 0.1), (1, 0.995, 0.99, 0.2, 0.2), (3, 0.0, 0.0, 0.1, 0.1)], "doc_id long, x double, y double, width double, height double")
    out = {r.doc_id: r for r in images.redact_images(df, boxes).collect()}
    got = images.read_image(out[1].content)
    want = px.copy()
    want[10:16, 10:40] = 0
    want[49:, 99:] = 0
    # 0.2 + 0.1 is a little more than 0.3: a row more.
    assert (got == want).all() and out[1].n_boxes == 2
    assert (images.read_image(out[2].content) == px).all()
    assert out[3].content is None and out[3].error and out[4].error
    pixel = ocr.pixel_boxes(boxes.filter("doc_id = 1"), *(__import__("pyspark.sql.functions", fromlist=["lit"]).lit(float(v)) for v in (100, 50))).orderBy("x").first()
    assert (pixel.left, pixel.top, pixel.px_width, pixel.px_height) == (10, 10, 30, 6)


def test_recognition_takes_a_function(spark):
    px = np.zeros((4, 4000, 3), np.uint8)
    df = spark.createDataFrame([(1, images.write_png(px)), (2, b"x")], "doc_id long, content binary")
    small = {r.doc_id: r for r in images.prepare_for_recognition(df).collect()}
    assert (small[1].width, small[1].height) == (1800, 2) and small[2].error
    words = images.recognise(df, lambda p: [[("a", 90.0, 0.0, 0.0, 1.0, 1.0), ("b", 80.0, 2.0, 0.0, 3.0, 1.0)]]).collect()
    assert [(w.doc_id, w.line, w.pos, w.text, w.image_width) for w in words] == [(1, 0, 0, "a", 1800.0), (1, 0, 1, "b", 1800.0)]
    with pytest.raises(images.UnreadableImage):
        images.read_image(b"\x89PNG\r\n\x1a\n")

"""Images: Portable Network Graphics to pixels and back, redaction by filled boxes, and sizes for recognition.

Pixels are read and written here for 8-bit images without interlacing, in grey,
colour or palette, with or without transparency. Other kinds are read by an
imaging library where one is installed; else they give an error and no image.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.batches import map_batches
from ..operators.ocr import RASTER_MAX

_SIGN = b"\x89PNG\r\n\x1a\n"
#: Bytes of a pixel by the kind of colour.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class UnreadableImage(ValueError):
    """The bytes are no image that can be read here."""


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(_SIGN)
    while at + 8 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += size + 12


def _unfilter(raw: np.ndarray, width: int, bpp: int) -> np.ndarray:
    """Rows of bytes from rows that begin with the number of their filter."""
    out = np.zeros((len(raw), width), np.uint8)
    above = np.zeros(width, np.int32)
    for y, row in enumerate(raw):
        kind, line = row[0], row[1:].astype(np.int32)
        if kind == 1:
            for k in range(bpp):
                line[k::bpp] = np.cumsum(line[k::bpp])
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            for x in range(width):
                a = line[x - bpp] if x >= bpp else 0
                b = above[x]
                if kind == 3:
                    line[x] = (line[x] + (a + b) // 2) & 255
                else:
                    c = above[x - bpp] if x >= bpp else 0
                    # The neighbour nearest to left plus above less the corner.
                    best = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                    line[x] = (line[x] + best) & 255
        elif kind:
            raise UnreadableImage("unknown filter")
        above = line & 255
        out[y] = above
    return out


def read_image(data: bytes) -> np.ndarray:
    """Pixels as (rows, columns, channels) of bytes, with 3 or 4 channels."""
    if data[:8] != _SIGN:
        return _by_library(data)
    head, body, palette, clear = None, b"", None, b""
    for kind, content in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"PLTE":
            palette = np.frombuffer(content, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = content
        elif kind == b"IDAT":
            body += content
    if head is None or head[2] != 8 or head[6] or head[3] not in _CHANNELS or (head[3] == 3 and palette is None):
        return _by_library(data)
    width, height, colour = head[0], head[1], head[3]
    n = _CHANNELS[colour]
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8)[: height * (width * n + 1)].reshape(height, width * n + 1)
    except (zlib.error, ValueError) as e:
        raise UnreadableImage(str(e)) from e
    px = _unfilter(raw, width * n, n).reshape(height, width, n)
    if colour == 3:
        rgb = palette[np.minimum(px[:, :, 0], len(palette) - 1)]
        if not clear:
            return rgb
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        return np.concatenate([rgb, alpha[px]], 2)
    if colour in (0, 4):
        return np.concatenate([np.repeat(px[:, :, :1], 3, 2), px[:, :, 1:]], 2)
    return px


def _by_library(data: bytes) -> np.ndarray:
    try:
        from PIL import Image, ImageOps
    except ImportError:
        raise UnreadableImage("this kind of image needs an imaging library") from None
    try:
        with Image.open(io.BytesIO(data)) as image:
            return np.asarray(ImageOps.exif_transpose(image).convert("RGBA"))
    except OSError as e:
        raise UnreadableImage(str(e)) from e


def write_png(px: np.ndarray) -> bytes:
    """The image file of (rows, columns, 3 or 4) bytes."""
    height, width, n = px.shape
    rows = np.zeros((height, width * n + 1), np.uint8)
    rows[:, 1:] = px.reshape(height, -1)

    def chunk(kind: bytes, content: bytes) -> bytes:
        return struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if n == 3 else 6, 0, 0, 0)
    return _SIGN + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def filled(px: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The pixels with boxes of left, top, width and height in black; what reaches beyond the image is cut off."""
    out = px.copy()
    for left, top, width, height in boxes:
        part = out[max(0, top) : max(0, top + height), max(0, left) : max(0, left + width)]
        part[:, :, :3] = 0
        part[:, :, 3:] = 255
    return out


def scaled(px: np.ndarray, most: int = RASTER_MAX) -> np.ndarray:
    """The pixels with a longest side of at most ``most``: each new pixel is the mean of what it covers."""
    height, width = px.shape[:2]
    scale = min(1.0, most / max(height, width))
    if scale == 1:
        return px
    for axis, size in ((0, height), (1, width)):
        n = max(1, int(size * scale + 0.5))
        edges = np.arange(n + 1) * size / n
        total = np.concatenate([np.zeros_like(px.take([0], axis), np.float64), np.cumsum(px, axis, np.float64)], axis)
        low = np.floor(edges).astype(int)
        part = (edges - low).reshape([-1 if k == axis else 1 for k in range(3)])
        at = total.take(low, axis) * (1 - part) + total.take(np.minimum(low + 1, size), axis) * part
        px = np.diff(at, axis=axis) * n / size
    return (px + 0.5).clip(0, 255).astype(np.uint8)


def redact_images(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, content, n_boxes, error): each image as a file with its boxes filled.

    ``images`` has doc_id and content; ``boxes`` doc_id, x, y, width and height in
    shares of the image, as ``redaction_boxes`` gives them. A box covers every pixel
    that it touches, one at least. An image that can't be read gives an error and no content.
    """
    by = boxes.groupBy("doc_id").agg(F.collect_list(F.struct("x", "y", "width", "height")).alias("boxes"))
    joined = images.select("doc_id", "content").join(by, "doc_id", "left")
    schema = T.StructType([joined.schema["doc_id"], T.StructField("content", T.BinaryType()), T.StructField("n_boxes", T.IntegerType()), T.StructField("error", T.StringType())])

    def one(r: dict) -> Iterator[tuple]:
        rects = r["boxes"] or []
        try:
            px = read_image(r["content"] or b"")
        except UnreadableImage as e:
            yield r["doc_id"], None, len(rects), str(e)
            return
        height, width = px.shape[:2]
        whole = []
        for b in rects:
            left, top = int(np.floor(b["x"] * width)), int(np.floor(b["y"] * height))
            right, bottom = int(np.ceil((b["x"] + b["width"]) * width)), int(np.ceil((b["y"] + b["height"]) * height))
            whole.append((left, top, max(1, right - left), max(1, bottom - top)))
        yield r["doc_id"], write_png(filled(px, whole)), len(rects), None

    return map_batches(joined, one, schema, rows=8)


def prepare_for_recognition(images: DataFrame, most: int = RASTER_MAX) -> DataFrame:
    """(doc_id, content, width, height, error): each image as a file whose longest side is at most ``most``."""
    src = images.select("doc_id", "content")
    schema = T.StructType([src.schema["doc_id"], T.StructField("content", T.BinaryType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("error", T.StringType())])

    def one(r: dict) -> Iterator[tuple]:
        try:
            px = scaled(read_image(r["content"] or b""), most)
        except UnreadableImage as e:
            yield r["doc_id"], None, None, None, str(e)
        else:
            yield r["doc_id"], write_png(px), px.shape[1], px.shape[0], None

    return map_batches(src, one, schema, rows=8)


WORDS = "line int, pos int, text string, confidence double, x0 double, y0 double, x1 double, y1 double"


def recognise(images: DataFrame, recogniser: Callable[[np.ndarray], list[list[tuple]]]) -> DataFrame:
    """Words of images (doc_id, WORDS, image_width, image_height), by a function that is given.

    ``recogniser`` gets the pixels, scaled for recognition, and gives lines of (text,
    confidence, x0, y0, x1, y1). It runs on the executors; none comes with the package.
    Images that can't be read have no words.
    """
    src = images.select("doc_id", "content")
    words = T.StructType.fromDDL(WORDS)
    schema = T.StructType([src.schema["doc_id"], *words.fields, T.StructField("image_width", T.DoubleType()), T.StructField("image_height", T.DoubleType())])

    def one(r: dict) -> Iterator[tuple]:
        try:
            px = scaled(read_image(r["content"] or b""))
        except UnreadableImage:
            return
        for n, line in enumerate(recogniser(px)):
            for k, word in enumerate(line):
                yield r["doc_id"], n, k, *word, float(px.shape[1]), float(px.shape[0])

    return map_batches(src, one, schema, rows=8)

"""Operator 6: media columns. PNG files in a binary column are decoded and hashed by their low cosine frequencies.

The container is read chunk by chunk with its checksums, inflated by zlib and unfiltered in numpy; no imaging library is used.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}

#: Side of the image that is transformed, side of the block of low frequencies that makes the hash, and width of a page's image.
SIDE = 32
LOW = 8
PAGE_WIDTH = 64

#: Pixels that an image may declare (a task holds some 16 bytes for each), and bytes that are unfiltered together.
MOST_PIXELS = 1 << 24
TOGETHER = 1 << 22


class Broken(ValueError):
    """What is wrong with a file."""


def chunks_of(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, content) of each chunk up to IEND, each held against its checksum."""
    if data[:8] != SIGNATURE:
        raise Broken("signature")
    at = 8
    while True:
        if at + 12 > len(data):
            raise Broken("truncated")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if at + 12 + n > len(data):
            raise Broken("truncated")
        content = data[at + 8 : at + 8 + n]
        if zlib.crc32(content, zlib.crc32(kind)) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise Broken("checksum")
        yield kind, content
        if kind == b"IEND":
            return
        at += 12 + n


def unfilter(images: list) -> list:
    """The rows of bytes of each image (raw, height, stride, step) without their filters; step: bytes from a pixel to the same channel
    of the next. Images of one step go together, about TOGETHER bytes at a time."""
    out: list = [None] * len(images)
    order = sorted(range(len(images)), key=lambda k: (images[k][3], images[k][2], images[k][1]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and images[order[to]][2:] == images[order[at]][2:] and (to + 1 - at) * images[order[to]][1] * images[order[at]][2] <= TOGETHER:
            to += 1
        for k, rows in zip(order[at:to], _wavefront([images[k] for k in order[at:to]])):
            out[k] = rows
        at = to
    return out


def _wavefront(images: list) -> list:
    """unfilter() of images of one stride and step: a pixel needs those to its left, above and between, so all pixels with the same
    sum of row and column are done at once."""
    import numpy as np

    _, _, stride, step = images[0]
    n, most, wide = len(images), max(h for _, h, _, _ in images), -(-stride // step)
    kinds, data = np.zeros((n, most), np.uint8), np.zeros((n, most, wide * step), np.uint8)
    for k, (raw, height, _, _) in enumerate(images):
        rows = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
        kinds[k, :height], data[k, :height, :stride] = rows[:, 0], rows[:, 1:]
    data = data.reshape(n, most, wide, step)
    done = np.zeros((n, most + 1, wide + 1, step), np.uint8)  # a row above and a column to the left, of zeros
    if kinds.any():
        for d in range(most + wide - 1):
            y = np.arange(max(0, d - wide + 1), min(most, d + 1))
            x = d - y
            kind = kinds[:, y, None]
            left, up, corner = done[:, y + 1, x].astype(np.int16), done[:, y, x + 1].astype(np.int16), done[:, y, x].astype(np.int16)
            a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
            paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
            guess = np.where(kind == 4, paeth, np.where(kind == 3, (left + up) >> 1, np.where(kind == 2, up, np.where(kind == 1, left, 0))))
            done[:, y + 1, x + 1] = data[:, y, x] + guess.astype(np.uint8)
    else:
        done[:, 1:, 1:] = data
    return [done[k, 1 : h + 1, 1:].reshape(h, -1)[:, :stride] for k, (_, h, _, _) in enumerate(images)]


def inflated(data: bytes, most_pixels: int = MOST_PIXELS):
    """(header, palette, rows with their filters) of a PNG, all of it tested but what the pixels' values can break."""
    import numpy as np

    head, palette, packed, ended = None, None, [], False
    for kind, content in chunks_of(data):
        if head is None and kind != b"IHDR":
            raise Broken("header")
        if kind == b"IHDR":
            if head is not None or len(content) != 13:
                raise Broken("header")
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"PLTE":
            palette = np.frombuffer(content, np.uint8)
            if len(palette) % 3 or not len(palette):
                raise Broken("palette")
            palette = palette.reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(content)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise Broken("unknown critical chunk")
    width, height, depth, colour, method, filtering, interlace = head
    if not (width and height) or depth not in DEPTHS.get(colour, ()) or method or filtering or not ended:
        raise Broken("header")
    if interlace:
        raise Broken("interlaced")
    if width * height > most_pixels:
        raise Broken("too large")
    size = height * (layout(head)[0] + 1)
    engine = zlib.decompressobj()
    try:
        raw = engine.decompress(b"".join(packed), size + 1)
    except zlib.error:
        raise Broken("deflate") from None
    if len(raw) != size:
        raise Broken("size")
    if max(raw[:: layout(head)[0] + 1]) > 4:
        raise Broken("filter")
    return head, palette, raw


def layout(head) -> tuple[int, int]:
    """Bytes of a row without its filter, and from a pixel to the next (1 at least)."""
    width, _, depth, colour, *_ = head
    bits = depth * CHANNELS[colour]
    return (width * bits + 7) // 8, max(1, bits // 8)


def grey_of(head, palette, rows):
    """Grey values 0..255 as a float array (height, width), made some rows at a time."""
    import numpy as np

    width, height, depth, colour, *_ = head
    out, weights = np.empty((height, width)), np.array([0.299, 0.587, 0.114])
    some = max(1, TOGETHER // (8 * rows.shape[1]))
    for y in range(0, height, some):
        part = rows[y : y + some]
        if depth == 16:
            pairs = part.reshape(len(part), -1, 2)
            values = (pairs[:, :, 0].astype(float) + pairs[:, :, 1] / 256) * (255 / (255 + 255 / 256))
        elif depth == 8:
            values = part.astype(float)
        else:
            each = np.unpackbits(part, axis=1)[:, : width * depth].reshape(len(part), -1, depth) @ (1 << np.arange(depth)[::-1])
            values = each.astype(float) * (1 if colour == 3 else 255 / ((1 << depth) - 1))
        values = values.reshape(len(part), width, CHANNELS[colour])
        if colour == 3:
            index = values[:, :, 0].astype(int)
            if palette is None or index.max() >= len(palette):
                raise Broken("palette")
            out[y : y + some] = palette[index] @ weights
        else:
            out[y : y + some] = values[:, :, :3] @ weights if colour in (2, 6) else values[:, :, 0]
    return out


def decode_png(data: bytes, most_pixels: int = MOST_PIXELS):
    """Grey values 0..255 as a float array (height, width). Alpha is left out; colours are weighted 299, 587, 114."""
    head, palette, raw = inflated(data, most_pixels)
    return grey_of(head, palette, unfilter([(raw, head[1], *layout(head))])[0])


@lru_cache(maxsize=256)
def shrink(size: int, to: int):
    """(to, size) weights of an area mean."""
    import numpy as np

    edges = np.arange(to + 1) * size / to
    at = np.arange(size)
    return np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None) * (to / size)


def cosine_hash(grey, side: int = SIDE, low: int = LOW) -> bytes:
    """low * low bits: which low frequencies of the image, shrunk to side by side, are above their median; row by row, the
    highest bit first. The mean's bit is always 0."""
    import numpy as np

    small = shrink(grey.shape[0], side) @ grey @ shrink(grey.shape[1], side).T
    basis = np.cos(np.pi * (np.arange(side) + 0.5) * np.arange(low)[:, None] / side)
    block = np.round(basis @ small @ basis.T, 6).ravel()
    bits = block > np.median(block[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


def hashed(images: list, most_pixels: int) -> list:
    """(width, height, hash, problem) of each PNG."""
    out, read, bytes_, at = [(None, None, None, "missing")] * len(images), [], 0, 0
    for k, data in enumerate(images):
        try:
            if data is not None:
                read.append((k, *inflated(data, most_pixels)))
                bytes_ += len(read[-1][3])
        except Broken as e:
            out[k] = (None, None, None, str(e))
        if bytes_ < TOGETHER and k + 1 < len(images):
            continue
        for (i, head, palette, _), rows in zip(read, unfilter([(raw, head[1], *layout(head)) for _, head, _, raw in read])):
            try:
                out[i] = (head[0], head[1], cosine_hash(grey_of(head, palette, rows)), None)
            except Broken as e:
                out[i] = (None, None, None, str(e))
        read, bytes_ = [], 0
    return out


def hash_media(media: DataFrame, column: str = "png", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """Every column but `column`, plus width, height (int), hash (binary) and problem (string).

    problem says what is wrong with a file (signature, truncated, checksum, header, palette, deflate, size, filter,
    interlaced, unknown critical chunk, too large for more than `most_pixels` pixels, or missing for null); the three others are null
    then. Otherwise problem is null. Bytes after IEND are ignored. Repeated rows are hashed alike; an empty table gives an empty one;
    columns named like the new ones are replaced.
    """
    rest = [c for c in media.columns if c not in (column, "width", "height", "hash", "problem")]
    media = media.select(*rest, F.col(column).alias("__data"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != "__data"), "width int, height int, hash binary, problem string"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = hashed(batch.column(batch.num_columns - 1).to_pylist(), most_pixels)
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string()]
            new = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*rest, "width", "height", "hash", "problem"])

    return media.mapInArrow(run, schema)


def encode_png(grey, level: int = 1) -> bytes:
    """A grey 8-bit image (height, width) as PNG; the five filters take turns from row to row."""
    import numpy as np

    x = grey.astype(np.int16)
    left = np.pad(x[:, :-1], ((0, 0), (1, 0)))
    up = np.pad(x[:-1], ((1, 0), (0, 0)))
    corner = np.pad(left[:-1], ((1, 0), (0, 0)))
    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    guesses = [np.zeros_like(x), left, up, (left + up) >> 1, paeth]
    rows = np.empty((x.shape[0], x.shape[1] + 1), np.uint8)
    for k, guess in enumerate(guesses):
        rows[k::5, 0] = k
        rows[k::5, 1:] = ((x - guess) & 255)[k::5]

    def chunk(kind: bytes, content: bytes) -> bytes:
        return struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(content, zlib.crc32(kind)))

    head = struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def page_images(pages: DataFrame, width: int = PAGE_WIDTH) -> DataFrame:
    """(page_id, png): each page drawn as an image, its UTF-8 bytes the grey values, row by row, the last filled up with 0.

    The tables hold no images, so these stand in for a media column. Null pages give null, empty ones one row of zeros.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for html in batch.column(1):
                if not html.is_valid:
                    out.append(None)
                    continue
                raw = np.frombuffer(html.as_py().encode(), np.uint8)
                out.append(encode_png(np.pad(raw, (0, -len(raw) % width if len(raw) else width)).reshape(-1, width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["page_id", "png"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, png binary")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_media(page_images(read(spark, sf_dir, "pages")))


QUERIES = {"op6_media": op6_media}
SQL: dict[str, str] = {}

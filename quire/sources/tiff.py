"""Frames of a TIFF file: its directories, the bytes of one frame, and pixels of the plain kinds."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

# Tags and kinds of numbers of the file format.
WIDTH, HEIGHT, BITS, COMPRESSION, MEANING, OFFSETS, SAMPLES, SIZES, PLANES, PREDICTOR, COLOURS, TILE = 256, 257, 258, 259, 262, 273, 277, 279, 284, 317, 320, 322
NUMBERS = {1: "B", 3: "H", 4: "I"}
PLAIN, PACKED, DEFLATED = (1,), (32773,), (8, 32946)


def frames(content: bytes) -> Iterator[dict[int, list[int]]]:
    """The numeric tags of each frame, in the file's order; a directory that comes again ends the file."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(content[:4])
    if order is None:
        raise ValueError("no TIFF directory")
    (at,), seen = struct.unpack_from(order + "I", content, 4), set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", content, at)
        tags: dict[int, list[int]] = {}
        for entry in range(at + 2, at + 2 + 12 * n, 12):
            tag, kind, count = struct.unpack_from(order + "HHI", content, entry)
            if kind in NUMBERS:
                layout = f"{order}{count}{NUMBERS[kind]}"
                where = entry + 8 if struct.calcsize(layout) <= 4 else struct.unpack_from(order + "I", content, entry + 8)[0]
                tags[tag] = list(struct.unpack_from(layout, content, where))
        yield tags
        (at,) = struct.unpack_from(order + "I", content, at + 2 + 12 * n)


def strips(content: bytes, tags: dict[int, list[int]]) -> list[bytes]:
    return [content[a : a + n] for a, n in zip(tags.get(OFFSETS, []), tags.get(SIZES, []), strict=False)]


def _unpacked(data: bytes) -> bytes:
    """Packed runs: a count, then so many bytes, or one byte to be repeated."""
    out, i = bytearray(), 0
    while i < len(data) - 1:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            out += data[i + 1 : i + 2] * (257 - n if n > 128 else 0)
            i += 2 if n > 128 else 1
    return bytes(out)


def pixels(tags: dict[int, list[int]], data: list[bytes]) -> np.ndarray:
    """Grey, or blue-green-red with or without opacity, as Spark's image source gives them."""
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, samples, packing, meaning = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1), one(COMPRESSION, 1), one(MEANING, 1)
    bits = set(tags.get(BITS, [1]))
    if TILE in tags or one(PLANES, 1) != 1 or bits not in ({1}, {8}) or (bits == {1} and samples > 1) or samples not in (1, 3, 4) or meaning not in (0, 1, 2, 3):
        raise ValueError("a frame in this layout is not read here")
    if packing not in PLAIN + PACKED + DEFLATED:
        raise ValueError(f"a frame of compression {packing} is not read here")
    raw = b"".join(zlib.decompress(bytes(x)) if packing in DEFLATED else _unpacked(bytes(x)) if packing in PACKED else bytes(x) for x in data)
    line = (width + 7) // 8 if bits == {1} else width * samples
    if not width or not height or len(raw) < line * height:
        raise ValueError("a frame ends early")
    rows = np.frombuffer(raw, np.uint8, line * height).reshape(height, line)
    if bits == {1}:
        rows = np.unpackbits(rows, axis=1)[:, :width] * (1 if meaning == 3 else 255)
    out = rows.reshape(height, width, samples)
    if one(PREDICTOR, 1) == 2 and bits == {8}:
        out = np.cumsum(out, axis=1, dtype=np.uint8)
    if meaning == 3:
        colours = (np.array(tags[COLOURS]).reshape(3, -1) // 257).astype(np.uint8)
        return colours[::-1].T[out[:, :, 0]]
    if samples > 1:
        return out[:, :, [2, 1, 0, 3][:samples]]
    return 255 - out if meaning == 0 else out

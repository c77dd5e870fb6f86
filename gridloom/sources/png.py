"""PNG images of 8 or 16 bits: channels are bands, an alpha channel like any other."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np

from .raster import Meta, Raster, RasterError

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type; 3 is a palette, whose indices are the samples.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column, first row, column step and row step of each pass of interlaced images.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def chunks(raw: bytes):  # noqa: ANN201
    at = len(MAGIC)
    while at + 8 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack_from(">I", raw, at + 8 + size)[0]:
            raise RasterError("a PNG chunk is cut short or has a wrong checksum")
        yield kind, body
        at += 12 + size


def unfiltered(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes with their filters undone; ``step`` is the distance to the byte on the left."""
    data = np.frombuffer(raw, np.uint8, rows * (stride + 1)).reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride + step), np.uint8)
    for r in range(rows):
        kind, line, up, own = int(data[r, 0]), data[r, 1:], out[r], out[r + 1]
        if kind == 0:
            own[step:] = line
        elif kind == 1:
            for k in range(step):
                own[step + k :: step] = np.add.accumulate(line[k::step], dtype=np.uint8)
        elif kind == 2:
            own[step:] = line + up[step:]
        elif kind in (3, 4):
            x, above, cur = line.tolist(), up.tolist(), own.tolist()
            for i, v in enumerate(x):
                a, b, c = cur[i], above[i + step], above[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                cur[i + step] = (v + guess) & 255
            own[:] = cur
        else:
            raise RasterError(f"PNG filter {kind}")
    return out[1:, step:]


def read(path: str | Path) -> Raster:
    raw = Path(path).read_bytes()
    if not raw.startswith(MAGIC):
        raise RasterError(f"{path}: not a PNG file")
    head, packed = None, []
    for kind, body in chunks(raw):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or not packed:
        raise RasterError(f"{path}: a PNG without header or samples")
    cols, rows, depth, colour, _, _, interlaced = head
    if depth not in (8, 16) or colour not in CHANNELS:
        raise RasterError(f"{path}: {depth} bits and colour type {colour}; 8 and 16 bits are supported")
    bands = CHANNELS[colour]
    step = bands * depth // 8
    kind = np.dtype(">u2" if depth == 16 else "u1")
    data = zlib.decompress(b"".join(packed))
    image = np.zeros((rows, cols, bands), kind.newbyteorder("="))
    at = 0
    for c0, r0, dc, dr in PASSES if interlaced else ((0, 0, 1, 1),):
        n, m = len(range(r0, rows, dr)), len(range(c0, cols, dc))
        if n and m:
            part = unfiltered(data[at:], n, m * step, step)
            image[r0::dr, c0::dc] = np.ascontiguousarray(part).view(kind).reshape(n, m, bands)
            at += n * (m * step + 1)
    return Raster(Meta(rows, cols, bands, str(image.dtype), "png"), image.reshape(-1, bands))

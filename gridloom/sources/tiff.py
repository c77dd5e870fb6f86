"""TIFF and GeoTIFF: strips or tiles, chunky or planar, plain, LZW, Deflate, PackBits or Zstandard."""

from __future__ import annotations

import math
import struct
import zlib
from pathlib import Path

import numpy as np

from ..functions.geo import Affine
from .raster import Meta, Raster, RasterError

#: Sizes and struct codes of TIFF field types.
FIELD = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q")}
#: Tags used here, by name.
TAG = {"cols": 256, "rows": 257, "bits": 258, "compression": 259, "offsets": 273, "bands": 277, "strip_rows": 278, "counts": 279, "planar": 284, "predictor": 317, "tile_cols": 322, "tile_rows": 323, "tile_offsets": 324, "tile_counts": 325, "sample_format": 339, "scale": 33550, "tiepoint": 33922, "matrix": 34264, "geokeys": 34735, "nodata": 42113}
KINDS = {(8, 1): "u1", (16, 1): "u2", (16, 2): "i2", (32, 3): "f4"}
MAX_BYTES = 3 << 30


class Tags:
    """The first directory of a classic or big TIFF."""

    def __init__(self, raw: bytes, name: str):
        self.raw, self.name = raw, name
        self.order = {b"II": "<", b"MM": ">"}.get(raw[:2], "")
        if not self.order or len(raw) < 8:
            raise RasterError(f"{name}: not a TIFF file")
        version = self.unpack("H", 2)[0]
        if version not in (42, 43):
            raise RasterError(f"{name}: not a TIFF file")
        self.big = version == 43
        at = self.unpack("Q", 8)[0] if self.big else self.unpack("I", 4)[0]
        count = self.unpack("Q" if self.big else "H", at)[0]
        at += 8 if self.big else 2
        self.entries = {}
        for k in range(count):
            e = at + k * (20 if self.big else 12)
            tag, kind = self.unpack("HH", e)
            n = self.unpack("Q" if self.big else "I", e + 4)[0]
            size = FIELD.get(kind, (1, "B"))[0] * n
            inline = e + (12 if self.big else 8)
            where = inline if size <= (8 if self.big else 4) else self.unpack("Q" if self.big else "I", inline)[0]
            self.entries[tag] = (kind, n, where)

    def unpack(self, code: str, at: int) -> tuple:
        try:
            return struct.unpack_from(self.order + code, self.raw, at)
        except struct.error as e:
            raise RasterError(f"{self.name}: cut short") from e

    def get(self, name: str, default: tuple = ()) -> tuple:
        if TAG[name] not in self.entries:
            return default
        kind, n, at = self.entries[TAG[name]]
        code = FIELD.get(kind, (1, "B"))[1]
        if code == "s":
            return (self.raw[at : at + n].split(b"\0")[0].decode("latin-1"),)
        return self.unpack(code * n, at)

    def one(self, name: str, default: int) -> int:
        return int(self.get(name, (default,))[0])


def georeference(t: Tags) -> tuple[Affine | None, int | None]:
    """A matrix wins over scale and tie point; the projected system wins over the geographic one.

    A scale of zero, and any term that isn't finite, is no transform.  The key directory ends at the count it states.
    """
    m, scale, tie = t.get("matrix"), t.get("scale"), t.get("tiepoint")
    place = None
    if len(m) >= 8:
        place = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif len(scale) >= 2 and len(tie) >= 6 and scale[0] and scale[1]:
        place = (tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1])
    if place is not None and not all(map(math.isfinite, place)):
        place = None
    keys = t.get("geokeys")
    count = keys[3] if len(keys) > 3 else 0
    own = [keys[k : k + 4] for k in range(4, 4 + 4 * count, 4)]
    named = {k[0]: k[3] for k in own if len(k) == 4 and k[1] == 0 and k[3] not in (0, 32767)}
    return place, named.get(3072, named.get(2048))


def meta_of(t: Tags) -> tuple[Meta, str]:
    bands = t.one("bands", 1)
    kind = KINDS.get((t.one("bits", 1), t.one("sample_format", 1)))
    if kind is None or len(set(t.get("bits", (1,)))) > 1:
        raise RasterError(f"{t.name}: samples of {t.get('bits')} bits, format {t.one('sample_format', 1)}, aren't supported")
    meta = Meta(t.one("rows", 0), t.one("cols", 0), bands, {"u1": "uint8", "u2": "uint16", "i2": "int16", "f4": "float32"}[kind], "tiff")
    if not meta.rows or not meta.cols:
        raise RasterError(f"{t.name}: an image without pixels")
    meta.transform, meta.epsg = georeference(t)
    try:
        meta.nodata = float(t.get("nodata", ("",))[0])
    except ValueError:
        pass
    return meta, kind


def unpacked_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def unpacked_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, most significant bit first, widened one code early."""
    out = bytearray()
    table: list[bytes] = []
    width, last, hold, bits = 9, b"", 0, 0
    for byte in data:
        hold, bits = (hold << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = hold >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise RasterError("LZW data is damaged")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        # after this code the next entry is len(table): codes widen one early
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def decompressed(data: bytes, kind: int, size: int) -> bytes:
    if kind == 1:
        return data
    if kind == 5:
        return unpacked_lzw(data)
    if kind in (8, 32946):
        return zlib.decompress(data)
    if kind == 32773:
        return unpacked_bits(data)
    if kind == 50000:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    raise RasterError(f"TIFF compression {kind}")


def read(path: str | Path) -> Raster:
    t = Tags(Path(path).read_bytes(), str(path))
    meta, kind = meta_of(t)
    dtype = np.dtype(t.order + kind)
    if meta.rows * meta.cols * meta.bands * dtype.itemsize > MAX_BYTES:
        raise RasterError(f"{path}: more than {MAX_BYTES} bytes of samples")
    planar = t.one("planar", 1) == 2
    layers, per = (meta.bands, 1) if planar else (1, meta.bands)
    tiled = bool(t.get("tile_offsets"))
    block_rows, block_cols = (t.one("tile_rows", 0), t.one("tile_cols", 0)) if tiled else (min(t.one("strip_rows", meta.rows), meta.rows), meta.cols)
    offsets, counts = (t.get("tile_offsets"), t.get("tile_counts")) if tiled else (t.get("offsets"), t.get("counts"))
    down, across = -(-meta.rows // block_rows), -(-meta.cols // block_cols)
    if len(offsets) < layers * down * across or len(counts) < len(offsets):
        raise RasterError(f"{path}: {len(offsets)} blocks of {layers * down * across}")
    out = np.zeros((meta.rows, meta.cols, meta.bands), dtype.newbyteorder("="))
    for k in range(layers * down * across):
        layer, rest = divmod(k, down * across)
        r, c = (rest // across) * block_rows, (rest % across) * block_cols
        rows = block_rows if tiled else min(block_rows, meta.rows - r)
        size = rows * block_cols * per * dtype.itemsize
        data = decompressed(t.raw[offsets[k] : offsets[k] + counts[k]], t.one("compression", 1), size)
        if len(data) < size:
            raise RasterError(f"{path}: a block has {len(data)} bytes of {size}")
        block = np.frombuffer(data, dtype, rows * block_cols * per).reshape(rows, block_cols, per).astype(out.dtype)
        predictor = t.one("predictor", 1)
        if predictor == 2:
            block = np.add.accumulate(block, axis=1, dtype=block.dtype)
        elif predictor == 3:
            planes = np.frombuffer(data, np.uint8, size).reshape(rows, -1)
            planes = np.add.accumulate(planes.reshape(rows, -1, per), axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, -1)
            block = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">{kind}").reshape(rows, block_cols, per).astype(out.dtype)
        h, w = min(rows, meta.rows - r), min(block_cols, meta.cols - c)
        out[r : r + h, c : c + w, layer if planar else slice(None)] = block[:h, :w, 0] if planar else block[:h, :w]
    return Raster(meta, out.reshape(-1, meta.bands))


def write_region_map(path: str | Path, labels: np.ndarray, shape: tuple[int, int], width: int, software: str = "", command: str = "") -> None:
    """One grey band of ``width`` bytes, uncompressed, in strips of about 64 KiB."""
    rows, cols = shape
    data = labels.astype(f"<u{width}").tobytes()
    strip = max(1, min(rows, 65536 // max(1, cols * width)))
    offsets = list(range(8, 8 + len(data), strip * cols * width)) or [8]
    ends = [*offsets[1:], 8 + len(data)]
    texts = [(tag, s.encode("ascii", "replace") + b"\0") for tag, s in ((270, command), (305, software)) if s]
    fields = [(256, 4, [cols]), (257, 4, [rows]), (258, 3, [8 * width]), (259, 3, [1]), (262, 3, [1]), (273, 4, offsets), (277, 3, [1]), (278, 4, [strip]), (279, 4, [b - a for a, b in zip(offsets, ends)]), (339, 3, [1])]
    entries = [(tag, kind, len(v), struct.pack(f"<{len(v)}{FIELD[kind][1]}", *v)) for tag, kind, v in fields] + [(tag, 2, len(s), s) for tag, s in texts]
    at = 8 + len(data) + len(data) % 2
    spill = at + 2 + 12 * len(entries) + 4
    directory, extra = struct.pack("<H", len(entries)), b""
    for tag, kind, n, value in sorted(entries):
        if len(value) > 4:
            directory += struct.pack("<HHII", tag, kind, n, spill + len(extra))
            extra += value + b"\0" * (len(value) % 2)
        else:
            directory += struct.pack("<HHI4s", tag, kind, n, value)
    Path(path).write_bytes(struct.pack("<2sHI", b"II", 42, at) + data + b"\0" * (len(data) % 2) + directory + b"\0\0\0\0" + extra)

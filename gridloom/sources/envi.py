"""ENVI images: a text header beside raw samples."""

from __future__ import annotations

from pathlib import Path

import numpy as np

from ..functions.geo import from_map_info
from .raster import Meta, Raster, RasterError, by_pixel

#: ENVI's numbers of the sample types, for images and for region maps.
IMAGE_TYPES = {1: "u1", 2: "i2", 4: "f4", 12: "u2"}
MAP_TYPES = {1: "u1", 12: "u2", 13: "u4"}
WIDTH_TYPES = {1: 1, 2: 12, 4: 13}


def parse_header(text: str) -> dict[str, str]:
    """``key = value`` fields by lower-case key; values in braces may span lines and nest."""
    if not text.lstrip().startswith("ENVI"):
        raise RasterError("the header doesn't begin with ENVI")
    out: dict[str, str] = {}
    lines = iter(text.splitlines())
    for line in lines:
        key, equals, value = line.partition("=")
        if not equals:
            continue
        value = value.strip()
        if value.startswith("{"):
            while value.count("{") > value.count("}"):
                more = next(lines, None)
                if more is None:
                    break
                value += "\n" + more
            end, depth = len(value), 0
            for i, c in enumerate(value):
                depth += (c == "{") - (c == "}")
                if depth == 0:
                    end = i
                    break
            value = value[1:end].strip()
        out[key.strip().lower()] = value
    return out


def header_path(path: str | Path) -> Path:
    """The header beside an image: its extension replaced if that is there, else ``.hdr`` appended."""
    path = Path(path)
    replaced = path.with_suffix(".hdr")
    return replaced if replaced.exists() and replaced != path else path.with_name(path.name + ".hdr")


def read_header(path: str | Path) -> tuple[Meta, dict[str, str]]:
    hdr = header_path(path)
    try:
        text = hdr.read_text(encoding="utf-8", errors="replace")
    except OSError as e:
        raise RasterError(f"{hdr}: {e}") from e
    return meta_of(parse_header(text), str(path))


def meta_of(fields: dict[str, str], name: str) -> tuple[Meta, dict[str, str]]:
    def number(key: str) -> int:
        try:
            return int(fields.get(key, "0"))
        except ValueError:
            return 0

    rows, cols, bands = (number(k) for k in ("lines", "samples", "bands"))
    if not rows or not cols or not bands:
        raise RasterError(f"{name}: the header lacks lines, samples or bands")
    fields = {"interleave": "bsq", "byte order": "0", "header offset": "0"} | fields
    try:
        nodata = float(fields["data ignore value"])
    except (KeyError, ValueError):
        nodata = None
    kind = {1: "uint8", 2: "int16", 4: "float32", 12: "uint16", 13: "uint32"}.get(number("data type"), f"ENVI type {number('data type')}")
    meta = Meta(rows, cols, bands, kind, "envi", nodata, wkt=fields.get("coordinate system string"), map_info=fields.get("map info"), description=fields.get("description"))
    meta.band_names = [x.strip() for x in fields["band names"].split(",")] if "band names" in fields else []
    if meta.map_info and (place := from_map_info(meta.map_info)):
        meta.transform, meta.epsg = place
    return meta, fields


def _samples(path: str | Path, meta: Meta, fields: dict[str, str], types: dict[int, str]) -> np.ndarray:
    kind = types.get(int(fields.get("data type", "0")))
    if kind is None:
        raise RasterError(f"{path}: samples of type {meta.dtype} aren't supported here")
    order = ">" if fields["byte order"].strip() == "1" else "<"
    count = meta.rows * meta.cols * meta.bands
    raw = Path(path).read_bytes()[int(fields["header offset"]) :]
    if len(raw) < count * int(kind[1]):
        raise RasterError(f"{path}: {len(raw)} bytes of samples, the header asks for {count * int(kind[1])}")
    flat = np.frombuffer(raw, order + kind, count).astype(kind)
    return by_pixel(flat, meta.rows, meta.cols, meta.bands, fields["interleave"].lower())


def read(path: str | Path) -> Raster:
    meta, fields = read_header(path)
    return Raster(meta, _samples(path, meta, fields, IMAGE_TYPES))


def read_region_map(path: str | Path) -> Raster:
    """A map of region ids, one unsigned little-endian band, as 64-bit ids."""
    meta, fields = read_header(path)
    if meta.bands != 1:
        raise RasterError(f"{path}: a region map has one band, not {meta.bands}")
    if fields["byte order"].strip() == "1" and meta.dtype != "uint8":
        raise RasterError(f"{path}: big-endian region maps aren't supported")
    return Raster(meta, _samples(path, meta, fields, MAP_TYPES).astype(np.int64))


def map_header(name: str, rows: int, cols: int, width: int, masked: bool, meta: Meta | None, software: str, command: str) -> str:
    lines = ["ENVI", f"description = {{\n{name}}}", f"samples = {cols}", f"lines   = {rows}", "bands   = 1", "header offset = 0", "file type = ENVI Standard", f"data type = {WIDTH_TYPES[width]}", "interleave = bsq", "byte order = 0"]
    if masked:
        lines.append("data ignore value = 0")
    if meta and meta.map_info:
        lines.append(f"map info = {{{meta.map_info}}}")
    if meta and meta.wkt:
        lines.append(f"coordinate system string = {{{meta.wkt}}}")
    lines.append(f"band names = {{\n{name}}}")
    lines += [f"{key} = {{{value}}}" for key, value in (("software", software), ("history", command)) if value]
    return "\n".join(lines) + "\n"


def write_region_map(path: str | Path, labels: np.ndarray, shape: tuple[int, int], width: int, masked: bool, meta: Meta | None = None, software: str = "", command: str = "") -> None:
    """Ids as raw little-endian integers of ``width`` bytes, and the header; 0 is nodata if ``masked``."""
    path = Path(path)
    path.write_bytes(labels.astype(f"<u{width}").tobytes())
    path.with_name(path.name + ".hdr").write_text(map_header(path.name, *shape, width, masked, meta, software, command))

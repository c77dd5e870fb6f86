"""IPW images: text records up to a form feed, then samples by pixel."""

from __future__ import annotations

from pathlib import Path

import numpy as np

from .raster import Meta, Raster, RasterError

MAGIC = b"!<header>"


def parse(raw: bytes, name: str) -> tuple[Meta, dict]:
    end = raw.find(b"\x0c")
    if end < 0:
        raise RasterError(f"{name}: no form feed ends the header")
    general: dict[str, str] = {}
    per_band: dict[int, dict[str, str]] = {}
    at = general
    for line in raw[:end].decode("latin-1").splitlines():
        line = line.strip()
        if line.startswith("!<header>"):
            words = line.removeprefix("!<header>").split()
            band = int(words[1]) if len(words) > 1 and words[1].lstrip("-").isdigit() else -1
            at = per_band.setdefault(band, {}) if words[:1] == ["basic_image"] and band >= 0 else general
        elif "=" in line:
            key, _, value = line.partition("=")
            at[key.strip()] = value.strip()
    number = lambda d, k: int(d[k]) if d.get(k, "").isdigit() else 0
    rows, cols, bands = (number(general, k) for k in ("nlines", "nsamps", "nbands"))
    if not rows or not cols or not bands:
        raise RasterError(f"{name}: the header lacks nlines, nsamps or nbands")
    sizes = [number(per_band.get(b, {}), "bytes") for b in range(bands)]
    bits = [number(per_band.get(b, {}), "bits") for b in range(bands)]
    if len(set(sizes)) != 1:
        raise RasterError(f"{name}: bands of {sizes} bytes; mixed widths aren't supported")
    if any(not 0 < n <= 8 * s for n, s in zip(bits, sizes)):
        raise RasterError(f"{name}: {bits} bits in {sizes} bytes")
    if sizes[0] not in (1, 2):
        raise RasterError(f"{name}: {sizes[0]} bytes a sample; 1 and 2 are supported")
    start = end + 1 + (raw[end + 1 : end + 2] == b"\n")
    big = general.get("byteorder", "0").startswith("0")
    return Meta(rows, cols, bands, f"uint{8 * sizes[0]}", "ipw"), {"start": start, "bits": bits, "kind": f"{'>' if big else '<'}u{sizes[0]}"}


def read(path: str | Path) -> Raster:
    raw = Path(path).read_bytes()
    meta, h = parse(raw, str(path))
    count = meta.rows * meta.cols * meta.bands
    kind = np.dtype(h["kind"])
    if len(raw) - h["start"] < count * kind.itemsize:
        raise RasterError(f"{path}: {len(raw) - h['start']} bytes of samples, the header asks for {count * kind.itemsize}")
    data = np.frombuffer(raw, kind, count, h["start"]).astype(kind.newbyteorder("=")).reshape(-1, meta.bands)
    return Raster(meta, data & ((1 << np.array(h["bits"])) - 1).astype(data.dtype))

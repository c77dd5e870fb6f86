"""Which format a file has, and reading it whole or its header only."""

from __future__ import annotations

import mmap
from pathlib import Path

from . import envi, ipw, png, tiff
from .raster import Meta, Raster, RasterError

READERS = {"envi": envi.read, "ipw": ipw.read, "png": png.read, "tiff": tiff.read}
EXTENSIONS = {".ipw": "ipw", ".tif": "tiff", ".tiff": "tiff", ".png": "png"}


def sniffed(head: bytes) -> str | None:
    """The format that a file's first 16 bytes show."""
    if head.startswith(ipw.MAGIC):
        return "ipw"
    if head.startswith(png.MAGIC):
        return "png"
    if head[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        return "tiff"
    return None


def detect(path: str | Path) -> str:
    """By content, then by extension, then by an ENVI header beside it."""
    path = Path(path)
    try:
        with path.open("rb") as f:
            head = f.read(16)
    except OSError as e:
        raise RasterError(f"{path}: {e}") from e
    found = sniffed(head) or EXTENSIONS.get(path.suffix.lower())
    if found:
        return found
    if envi.header_path(path).exists():
        return "envi"
    raise RasterError(f"{path}: not IPW, PNG or TIFF, and there is no {envi.header_path(path).name} beside it")


def read(path: str | Path) -> Raster:
    return READERS[detect(path)](path)


def read_with_nodata(path: str | Path) -> tuple[Raster, float | None]:
    """The image and the nodata value its file declares (ENVI and TIFF can)."""
    r = read(path)
    return r, r.meta.nodata


def read_region_map(path: str | Path) -> Raster:
    kind = detect(path)
    if kind != "envi":
        raise RasterError(f"{path}: region maps are read from ENVI files, not {kind}")
    return envi.read_region_map(path)


def probe(path: str | Path) -> Meta:
    """Size and georeferencing.  ENVI and TIFF headers are enough; IPW and PNG are read whole."""
    kind = detect(path)
    if kind == "envi":
        return envi.read_header(path)[0]
    if kind == "tiff":
        with Path(path).open("rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as raw:  # only the pages that tags are on
            return tiff.meta_of(tiff.Tags(raw, str(path)))[0]
    return READERS[kind](path).meta

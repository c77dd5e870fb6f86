"""What every raster file becomes: samples by pixel, and what its header says."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions.geo import Affine

#: Sample types that can be read; floats are for the second stage only.
SAMPLES = ("uint8", "uint16", "int16", "float32")


class RasterError(ValueError):
    """A file that can't be read, or not as what is asked for."""


@dataclass
class Meta:
    rows: int
    cols: int
    bands: int
    dtype: str
    format: str
    nodata: float | None = None
    transform: Affine | None = None
    epsg: int | None = None
    wkt: str | None = None
    map_info: str | None = None
    band_names: list[str] = field(default_factory=list)
    description: str | None = None


@dataclass
class Raster:
    """``data`` is (rows * cols, bands), pixels in raster order."""

    meta: Meta
    data: np.ndarray


def by_pixel(flat: np.ndarray, rows: int, cols: int, bands: int, interleave: str) -> np.ndarray:
    """Samples as (pixel, band) from band (bsq), line (bil) or pixel (bip) interleaving."""
    if interleave == "bip":
        return flat.reshape(rows * cols, bands)
    if interleave == "bsq":
        return flat.reshape(bands, rows * cols).T
    if interleave == "bil":
        return flat.reshape(rows, bands, cols).transpose(0, 2, 1).reshape(rows * cols, bands)
    raise RasterError(f"unknown interleave {interleave!r}")


def width_of(count: int) -> int:
    """Bytes of an id: the bit width of the number of regions, rounded up to 1, 2 or 4 bytes."""
    return 1 if count < 256 else 2 if count < 65536 else 4


"""Region maps as polygons: boundary edges chained to rings, rings sorted into shells and holes, WKB.

Edges come from ``regions.boundary_edges`` with the region on their left.  They are sorted by region, and a task
stitches the regions it has one after another as they stream by; it holds the edges of one region.
"""

from __future__ import annotations

import struct
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import PIXEL_SPACE, Affine, apply, pixel_area
from .regions import boundary_edges
from .streams import by_group

Corner = tuple[int, int]
Ring = list[Corner]


def rings_of(edges: list[tuple[Corner, Corner]]) -> list[Ring]:
    """Closed rings (first corner repeated).  Where a ring meets itself in a corner it takes the leftmost turn.

    Hugging the region on the left at such a pinch splits pixels that touch only in a corner into parts.
    """
    leaving: dict[Corner, list[Corner]] = defaultdict(list)
    for a, b in sorted(edges, key=lambda e: (e[0][1], e[0][0], e[1][1], e[1][0]), reverse=True):
        leaving[a].append(b)
    out = []
    for start in sorted(leaving, key=lambda p: (p[1], p[0])):
        while leaving[start]:
            ring = [start, leaving[start].pop()]
            while ring[-1] != start:
                (x0, y0), (x1, y1) = ring[-2:]
                options = leaving[ring[-1]]
                # y points down: a left turn has a negative cross product
                best = min(options, key=lambda p: (x1 - x0) * (p[1] - y1) - (y1 - y0) * (p[0] - x1))
                options.remove(best)
                ring.append(best)
            out.append(ring)
    return out


def doubled_area(ring: list) -> float:
    """Twice the signed area; negative for shells in pixel corners, whose y points down."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))


def contains(ring: Ring, x: float, y: float) -> bool:
    """Whether a ray from the point to the right crosses the ring's vertical sides an odd number of times."""
    return sum(x < a[0] and min(a[1], b[1]) < y < max(a[1], b[1]) for a, b in zip(ring, ring[1:]) if a[0] == b[0]) % 2 == 1


def parts_of(rings: list[Ring]) -> list[list[Ring]]:
    """Shells, each with its holes: a hole belongs to the smallest shell around the pixel below its top side."""
    shells = [r for r in rings if doubled_area(r) < 0]
    parts = [[s] for s in shells]
    for hole in (r for r in rings if doubled_area(r) >= 0):
        top = min(y for _, y in hole)
        x = min(min(a[0], b[0]) for a, b in zip(hole, hole[1:]) if a[1] == b[1] == top)
        around = [p for p in parts if contains(p[0], x + 0.5, top + 0.5)]
        if around:
            min(around, key=lambda p: abs(doubled_area(p[0]))).append(hole)
    return parts


def on_map(part: list[Ring], t: Affine) -> list[list[tuple[float, float]]]:
    """A part in map coordinates, its shell counter-clockwise and its holes clockwise."""
    out = []
    for k, ring in enumerate(part):
        points = [apply(t, x, y) for x, y in ring]
        if (doubled_area(points) > 0) != (k == 0):
            points.reverse()
        out.append(points)
    return out


def wkb(parts: list[list[list[tuple[float, float]]]]) -> bytes:
    """Little-endian WKB of a multipolygon."""
    out = [struct.pack("<BII", 1, 6, len(parts))]
    for part in parts:
        out.append(struct.pack("<BII", 1, 3, len(part)))
        for ring in part:
            out.append(struct.pack(f"<I{2 * len(ring)}d", len(ring), *[v for p in ring for v in p]))
    return b"".join(out)


def envelope(parts: list[list[list[tuple[float, float]]]]) -> tuple[float, float, float, float]:
    """minx, maxx, miny, maxy."""
    xs, ys = zip(*[p for part in parts for ring in part for p in ring])
    return min(xs), max(xs), min(ys), max(ys)


def geometry_blob(parts: list[list[list[tuple[float, float]]]], srs_id: int) -> bytes:
    """A GeoPackage geometry: magic, version 0, flags (envelope, little-endian), SRS, envelope, WKB."""
    return b"GP" + struct.pack("<BBi4d", 0, 0b11, srs_id, *envelope(parts)) + wkb(parts)


_RINGS = "array<array<array<struct<x: double, y: double>>>>"


def polygons(labels: DataFrame, transform: Affine = PIXEL_SPACE, skip_zero: bool = True) -> DataFrame:
    """``scene, region_id, npix, area, parts, rings, geometry, wkb``: one multipolygon per region.

    ``skip_zero`` leaves region 0 (nodata) out, as masked maps want.  The area is the sum of the cells'.
    """
    edges = boundary_edges(labels)
    if skip_zero:
        edges = edges.filter("region_id <> 0")
    cell = pixel_area(transform)

    def build(rows: pa.Table) -> dict:
        ends = np.stack([rows.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")], axis=1).tolist()
        found = parts_of(rings_of([((a, b), (c, d)) for a, b, c, d in ends]))
        npix = -sum(doubled_area(r) for p in found for r in p) // 2
        parts = [on_map(p, transform) for p in found]
        nested = [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in parts]
        row = [rows.column("scene")[0].as_py(), rows.column("region_id")[0].as_py(), int(npix), npix * cell, len(parts), sum(map(len, parts)), nested, wkb(parts)]
        return dict(zip(arrow.names, row))

    rings = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    arrow = pa.schema([("scene", pa.string()), ("region_id", pa.int64()), ("npix", pa.int64()), ("area", pa.float64()), ("parts", pa.int32()), ("rings", pa.int32()), ("geometry", rings), ("wkb", pa.binary())])
    schema = f"scene string, region_id long, npix long, area double, parts int, rings int, geometry {_RINGS}, wkb binary"
    return by_group(edges, ["scene", "region_id"], [], build, schema, arrow)


def largest(polygon_table: DataFrame, k: int) -> DataFrame:
    """The k regions of largest area, ties to the smaller id."""
    return polygon_table.orderBy(F.desc("area"), "region_id").limit(k)

"""Region polygons as a GeoPackage: an SQLite file, the same bytes for the same map."""

from __future__ import annotations

import os
import sqlite3
from pathlib import Path

from pyspark.sql import DataFrame

from ..functions.geo import PIXEL_SPACE, Affine, pixel_area, wkt
from ..operators.vector import envelope, geometry_blob, polygons
from .provenance import Provenance

#: Fixed values of the GeoPackage standard, version 1.3, and of the tables it requires.
APPLICATION_ID, USER_VERSION = 0x47504B47, 10300
TABLES = """
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL,
  organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '',
  last_change DATETIME NOT NULL, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER REFERENCES gpkg_spatial_ref_sys(srs_id));
CREATE TABLE gpkg_geometry_columns (table_name TEXT UNIQUE REFERENCES gpkg_contents(table_name), column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL,
  srs_id INTEGER NOT NULL REFERENCES gpkg_spatial_ref_sys(srs_id), z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
"""
#: The time of change is a constant, so that equal maps give equal files.
LAST_CHANGE = "2000-01-01T00:00:00.000Z"
CUSTOM_SRS, UNDEFINED_SRS = 100000, -1


def srs_of(epsg: int | None, text: str | None) -> tuple[int, str, int, str]:
    """Id, organisation, its id and definition of a reference system: by EPSG code, by WKT, or undefined."""
    if epsg is not None:
        return epsg, "EPSG", epsg, text or wkt(epsg) or "undefined"
    if text:
        return CUSTOM_SRS, "NONE", CUSTOM_SRS, text
    return UNDEFINED_SRS, "NONE", UNDEFINED_SRS, "undefined"


def write_region_map(path: str | Path, labels: DataFrame, transform: Affine | None = None, epsg: int | None = None, srs_wkt: str | None = None, layer: str = "regions", masked: bool = True, provenance: Provenance = Provenance()) -> int:
    """Polygons of all regions of a scene, in order of id; replaces the file; the number of features.

    Polygons are made on the executors and arrive one partition at a time; the single file is the driver's to write.
    """
    path = Path(path)
    part = path.with_name(path.name + ".part")
    part.unlink(missing_ok=True)
    table = polygons(labels, transform or PIXEL_SPACE, skip_zero=masked)
    srs_id, org, org_id, definition = srs_of(epsg, srs_wkt)
    name = '"' + layer.replace('"', '""') + '"'
    con = sqlite3.connect(part, isolation_level=None)
    con.executescript(f"PRAGMA application_id = {APPLICATION_ID}; PRAGMA user_version = {USER_VERSION}; {TABLES}")
    systems = [("Undefined cartesian SRS", -1, "NONE", -1, "undefined"), ("Undefined geographic SRS", 0, "NONE", 0, "undefined"), ("WGS 84 geodetic", 4326, "EPSG", 4326, wkt(4326)), (f"{org}:{org_id}", srs_id, org, org_id, definition)]
    con.executemany("INSERT OR IGNORE INTO gpkg_spatial_ref_sys (srs_name, srs_id, organization, organization_coordsys_id, definition) VALUES (?, ?, ?, ?, ?)", systems)
    area = transform is not None and pixel_area(transform)
    con.execute(f"CREATE TABLE {name} (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom MULTIPOLYGON, region_id INTEGER NOT NULL, n_pixels INTEGER NOT NULL{', area REAL' if transform else ''})")
    con.execute("BEGIN")
    box, count = None, 0
    for r in table.select("region_id", "npix", "geometry").orderBy("region_id").toLocalIterator():
        parts = [[[(p.x, p.y) for p in ring] for ring in part_] for part_ in r.geometry]
        own = envelope(parts)
        box = own if box is None else (min(box[0], own[0]), max(box[1], own[1]), min(box[2], own[2]), max(box[3], own[3]))
        row = [geometry_blob(parts, srs_id), r.region_id, r.npix, *([r.npix * area] if transform else [])]
        con.execute(f"INSERT INTO {name} (geom, region_id, n_pixels{', area' if transform else ''}) VALUES ({', '.join('?' * len(row))})", row)
        count += 1
    minx, maxx, miny, maxy = box or (None,) * 4
    about = "; ".join(x for x in (provenance.software, provenance.command) if x)
    con.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, ?, ?, ?, ?, ?, ?, ?)", (layer, layer, about, LAST_CHANGE, minx, miny, maxx, maxy, srs_id))
    con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'MULTIPOLYGON', ?, 0, 0)", (layer, srs_id))
    con.execute("COMMIT")
    con.close()
    os.replace(part, path)
    return count

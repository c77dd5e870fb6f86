"""Readers and writers: round trips, formats that agree, refusals; vectors, manifests, command line, data sources."""

import json
import os
import sqlite3
import struct
import zlib

import numpy as np
import pytest

from gridloom import cli
from gridloom.functions import geo
from gridloom.operators import vector
from gridloom.sources import datasource, detect, envi, gpkg, ipw, manifest, png, provenance, tiff
from gridloom.sources.raster import Meta, RasterError

RNG = np.random.default_rng(7)
SHAPE = (13, 11)


def image(bands=3, kind=np.uint8):
    top = 255 if kind == np.uint8 else 30000
    return RNG.integers(0, top, (SHAPE[0] * SHAPE[1], bands)).astype(kind)


def put_envi(path, data, interleave="bip", order=0, offset=0, extra=""):
    kind = {"u1": 1, "i2": 2, "f4": 4, "u2": 12, "u4": 13}[data.dtype.str[1:]]
    cube = data.reshape(*SHAPE, -1)
    cube = {"bip": cube, "bsq": cube.transpose(2, 0, 1), "bil": cube.transpose(0, 2, 1)}[interleave]
    path.write_bytes(b"\0" * offset + cube.astype(data.dtype.newbyteorder(">" if order else "<")).tobytes())
    path.with_name(path.name + ".hdr").write_text(f"ENVI\ndescription = {{\n two {{nested}}\n lines}}\nSamples = {SHAPE[1]}\nlines = {SHAPE[0]}\nbands = {cube.size // (SHAPE[0] * SHAPE[1])}\nheader offset = {offset}\ndata type = {kind}\ninterleave = {interleave}\nbyte order = {order}\n{extra}")
    return path


@pytest.mark.parametrize("interleave", ["bip", "bsq", "bil"])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.int16, np.float32])
@pytest.mark.parametrize("order, offset", [(0, 0), (1, 12)])
def test_envi(tmp_path, interleave, kind, order, offset):
    data = image(kind=kind)
    r = envi.read(put_envi(tmp_path / "a", data, interleave, order, offset, "data ignore value = 7\nband names = {x, y, z}\n"))
    assert (r.data == data).all() and r.data.dtype == kind
    assert r.meta.nodata == 7 and r.meta.band_names == ["x", "y", "z"] and r.meta.description.replace("\n", " ").split() == ["two", "{nested}", "lines"]


def test_envi_refusals(tmp_path):
    p = put_envi(tmp_path / "a", image())
    p.write_bytes(p.read_bytes()[:-1])
    with pytest.raises(RasterError):
        envi.read(p)
    with pytest.raises(RasterError):
        envi.read_region_map(p)
    with pytest.raises(RasterError):
        detect.read(put_envi(tmp_path / "b", image(1).astype(np.uint32)))
    with pytest.raises(RasterError):
        envi.parse_header("samples = 3")
    with pytest.raises(RasterError):
        detect.detect(tmp_path / "none")


@pytest.mark.parametrize("top, width", [(200, 1), (60000, 2), (70000, 4)])
def test_region_maps_round_trip(tmp_path, top, width):
    labels = RNG.integers(0, top, SHAPE[0] * SHAPE[1])
    labels[0] = top
    meta = Meta(*SHAPE, 1, "uint8", "envi", map_info="UTM, 1, 1, 500000, 4000000, 30, 30, 15, North, WGS-84")
    envi.write_region_map(tmp_path / "m", labels, SHAPE, width, True, meta, "s", "a (b)")
    back = detect.read_region_map(tmp_path / "m")
    assert (back.data[:, 0] == labels).all() and back.meta.nodata == 0 and back.meta.epsg == 32615
    tiff.write_region_map(tmp_path / "m.tif", labels, SHAPE, width, "s", "c")
    if width < 4:
        assert (tiff.read(tmp_path / "m.tif").data[:, 0] == labels).all()
    with pytest.raises(RasterError):
        detect.read_region_map(tmp_path / "m.tif")


def put_ipw(path, data, bits, order=None):
    n = data.dtype.itemsize
    head = f"!<header> basic_image_i -1 $Revision$\n{f'byteorder = {order}' if order else ''}\nnlines = {SHAPE[0]}\nnsamps = {SHAPE[1]}\nnbands = {data.shape[1]}\n"
    head += "".join(f"!<header> basic_image {b} $Revision$\nbytes = {n}\nbits = {bits}\n" for b in range(data.shape[1]))
    body = data.astype(data.dtype.newbyteorder("<" if order == "10" else ">")).tobytes()
    path.write_bytes(head.encode() + b"!<header> image -1\n\x0c\n" + body)
    return path


def test_ipw(tmp_path):
    a, b = image(), image(kind=np.uint16)
    assert (detect.read(put_ipw(tmp_path / "a", a, 8)).data == a).all()
    assert (ipw.read(put_ipw(tmp_path / "b", b, 16, "10")).data == b).all()
    assert (ipw.read(put_ipw(tmp_path / "c", b, 10, "01")).data == b & 1023).all()
    with pytest.raises(RasterError):
        ipw.read(put_ipw(tmp_path / "d", a, 9))
    (tmp_path / "e").write_bytes((tmp_path / "a").read_bytes()[:-1])
    with pytest.raises(RasterError):
        ipw.read(tmp_path / "e")


def put_png(path, data, kind, interlace=False):
    """A PNG whose rows use all five filters in turn."""
    cube, depth = data.reshape(*SHAPE, -1), 8 * data.dtype.itemsize
    step, body = cube.shape[2] * data.dtype.itemsize, b""
    for c0, r0, dc, dr in png.PASSES if interlace else ((0, 0, 1, 1),):
        part = cube[r0::dr, c0::dc]
        if part.size == 0:
            continue
        above = bytes(part.shape[1] * step)
        for r, row in enumerate(part.astype(data.dtype.newbyteorder(">"))):
            x, f, out = row.tobytes(), r % 5, bytearray()
            for i, v in enumerate(x):
                a = x[i - step] if i >= step else 0
                b, c = above[i], above[i - step] if i >= step else 0
                p = a + b - c
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                out.append((v - (0, a, b, (a + b) // 2, paeth)[f]) & 255)
            body += bytes([f]) + bytes(out)
            above = x
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(png.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", SHAPE[1], SHAPE[0], depth, kind, 0, 0, interlace)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b""))
    return path


@pytest.mark.parametrize("bands, colour", [(1, 0), (3, 2), (2, 4), (4, 6)])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("interlace", [False, True])
def test_png(tmp_path, bands, colour, kind, interlace):
    data = image(bands, kind)
    assert (detect.read(put_png(tmp_path / "a", data, colour, interlace)).data == data).all()


def lzw(data):
    """LZW codes, most significant bit first, widened one code early."""
    table, out, bits, count = {bytes([k]): k for k in range(256)}, 0, 0, 258
    width, cur, codes = 9, b"", [(256, 9)]
    for v in data:
        nxt = cur + bytes([v])
        if nxt in table:
            cur = nxt
            continue
        codes.append((table[cur], width))
        table[nxt] = count
        count += 1
        cur = bytes([v])
        width = 9 if count < 512 else 10 if count < 1024 else 11 if count < 2048 else 12
        if count == 4094:
            codes.append((256, width))
            table, count, width = {bytes([k]): k for k in range(256)}, 258, 9
    codes += [(table[cur], width)] if cur else []
    codes.append((257, width))
    for code, n in codes:
        out, bits = out << n | code, bits + n
    return (out << -bits % 8).to_bytes((bits + 7) // 8, "big")


def put_tiff(path, data, compression=1, planar=False, order="<", tile=None, predictor=1, extra=()):
    cube = data.reshape(*SHAPE, -1)
    bands, kind = cube.shape[2], data.dtype.newbyteorder(order)
    h, w = tile or (5, SHAPE[1])
    blocks = []
    for layer in range(bands) if planar else [slice(None)]:
        part = cube[:, :, layer].reshape(*SHAPE, -1)
        for r in range(0, SHAPE[0], h):
            for c in range(0, SHAPE[1], w):
                b = part[r : r + h, c : c + w]
                if tile:
                    b = np.pad(b, ((0, h - b.shape[0]), (0, w - b.shape[1]), (0, 0)))
                if predictor == 2:
                    b = np.concatenate((b[:, :1], np.diff(b, axis=1)), axis=1).astype(data.dtype)
                blocks.append(np.ascontiguousarray(b).astype(kind).tobytes())
    import zstandard

    def packbits(d):
        return b"".join(bytes([len(d[i : i + 100]) - 1]) + d[i : i + 100] for i in range(0, len(d), 100)) + b"\xfe" + d[:0] + b"\x00"

    pack = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits, 50000: zstandard.ZstdCompressor().compress}[compression]
    blocks = [pack(b) for b in blocks]
    code = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    offsets = np.cumsum([8] + [len(b) for b in blocks])[:-1].tolist()
    at = 8 + sum(map(len, blocks))
    where, count = ((324, 325) if tile else (273, 279))
    fields = [(256, 4, [SHAPE[1]]), (257, 4, [SHAPE[0]]), (258, 3, [8 * data.dtype.itemsize] * bands), (259, 3, [compression]), (262, 3, [1]), (where, 4, offsets), (277, 3, [bands]), (count, 4, [len(b) for b in blocks]), (284, 3, [1 + planar]), (317, 3, [predictor]), (339, 3, [code] * bands), *extra]
    fields += [(322, 4, [w]), (323, 4, [h])] if tile else [(278, 4, [h])]
    spill, entries, more = at + 2 + 12 * len(fields) + 4, b"", b""
    for tag, t, v in sorted(fields):
        value = v[0] if t == 2 else struct.pack(f"{order}{len(v)}{tiff.FIELD[t][1]}", *v)
        n = len(value) if t == 2 else len(v)
        if len(value) > 4:
            entries += struct.pack(order + "HHII", tag, t, n, spill + len(more))
            more += value
        else:
            entries += struct.pack(order + "HHI4s", tag, t, n, value)
    path.write_bytes(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, at) + b"".join(blocks) + struct.pack(order + "H", len(fields)) + entries + b"\0\0\0\0" + more)
    return path


@pytest.mark.parametrize("compression", [1, 5, 8, 32773, 50000])
@pytest.mark.parametrize("planar", [False, True])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [None, (16, 16)])
def test_tiff(tmp_path, compression, planar, order, tile):
    for kind in (np.uint8, np.uint16, np.int16, np.float32):
        data = image(kind=kind)
        assert (detect.read(put_tiff(tmp_path / "a", data, compression, planar, order, tile)).data == data).all()
    data = image(kind=np.uint16)
    assert (tiff.read(put_tiff(tmp_path / "a", data, compression, planar, order, tile, 2)).data == data).all()


def test_long_lzw(tmp_path):
    data = RNG.integers(0, 255, 30_000).astype(np.uint8).tobytes()
    assert tiff.unpacked_lzw(lzw(data)) == data


def test_geotiff(tmp_path):
    keys = (34735, 3, [1, 1, 0, 2, 2048, 0, 1, 4326, 3072, 0, 1, 32767])
    p = put_tiff(tmp_path / "a", image(1), extra=[(33550, 12, [30.0, 30.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 500.0, 900.0, 0.0]), keys, (42113, 2, [b"-9\0"])])
    m = detect.probe(p)
    assert m.transform == (500.0, 30.0, 0.0, 900.0, 0.0, -30.0) and m.epsg == 4326 and m.nodata == -9
    matrix = (34264, 12, [2.0, 0, 0, 7.0, 0, -2.0, 0, 9.0] + [0.0] * 8)
    assert detect.probe(put_tiff(tmp_path / "b", image(1), extra=[matrix, (33550, 12, [30.0, 30.0, 0.0])])).transform == (7.0, 2.0, 0, 9.0, 0, -2.0)


def test_formats_agree(tmp_path):
    data = image()
    files = [put_envi(tmp_path / "a", data), put_ipw(tmp_path / "b.ipw", data, 8), put_png(tmp_path / "c.png", data, 2), put_tiff(tmp_path / "d.tif", data, 8)]
    assert [detect.detect(f) for f in files] == ["envi", "ipw", "png", "tiff"]
    maps = []
    for f in files:
        out = tmp_path / f"{f.name}-out"
        out.mkdir()
        assert cli.main([str(f), "-t", "60", "-m", "0.5", "-n", "2,3,9,40,40", "-o", "x", "--outdir", str(out)]) == 0
        maps.append({p.name: p.read_bytes() for p in out.iterdir() if not p.name.endswith(".hdr")})
    assert maps[0] and all(m == maps[0] for m in maps)


def test_command_line_rules(tmp_path):
    f = str(put_envi(tmp_path / "a", image()))
    for bad in ([f], [f, "-t=-1"], [f, "-t", "5", "-B", "0"], [f, "-t", "5", "-B", "9", "-N", "1,2"], [f, "-t", "5", "--n2", "2,3"], [f, "-t", "5", "-m", "0"], [f, "-t", "5", "--nodata", "256"], ["--rmap", f, "-t", "5"], [f, "-t", "5", "-A", "--stage2", f, "--n2", "2,9"]):
        assert cli.main([*bad, "--outdir", str(tmp_path)]) == 1
    assert cli.main([f, "-t", "0", "-o", "z", "--outdir", str(tmp_path), "-A", "--format", "tiff", "--verbose"]) == 0
    layer = str(put_envi(tmp_path / "l", image(1, np.float32)))
    assert cli.main([f, "-t", "50", "--stage2", layer, "--n2", "5,60", "-o", "two", "--outdir", str(tmp_path)]) == 0
    rmap = next(p for p in tmp_path.iterdir() if p.name.startswith("two.rmap") and p.suffix != ".hdr")
    assert cli.main(["--rmap", str(rmap), "--stage2", layer, "--n2", "5,60", "-o", "again", "--outdir", str(tmp_path)]) == 0
    one, again = ([p.read_bytes() for p in tmp_path.iterdir() if p.name.startswith(f"{b}.armap") and p.suffix != ".hdr"] for b in ("two", "again"))
    assert one == again


def test_series(tmp_path):
    classes = np.repeat([1, 1, 2], [5, 6, 2])[:, None] * np.ones(SHAPE[1], int)
    rows = ["label, IMAGE, stage2, classes", "", "# a comment"]
    for k in range(3):
        c = classes.copy()
        c[k : 2 * k, 2:5] = 4
        for name, data in (("image", image()), ("stage2", image(1)), ("classes", c.reshape(-1, 1).astype(np.uint8))):
            put_envi(tmp_path / f"{name}{k}", data)
        rows.append(f"y{k}, image{k}, stage2{k}, classes{k}")
    (tmp_path / "m.csv").write_text("\n".join(rows))
    assert [s.label for s in manifest.read(tmp_path / "m.csv")] == ["y0", "y1", "y2"]
    assert cli.main(["temporal", "--manifest", str(tmp_path / "m.csv"), "-t", "50", "--n2", "4,90", "-o", "s", "--outdir", str(tmp_path), "--intermediates"]) == 0
    names = {p.name for p in tmp_path.iterdir()}
    assert "s.y1.change" in names and "s.y2.combined" in names and any(n.startswith("s.y0.armap.") for n in names)
    assert detect.read(tmp_path / "s.y1.change").data.sum() == 3
    for bad in ("", "image,x\na,b", "image,stage2,classes,change\na,b,c,d", "image,stage2\na"):
        with pytest.raises(ValueError):
            manifest.parse(bad)
    assert manifest.parse("image,stage2,change\na,b,\nc,d,e", "/f")[1].change == "/f/e"


def test_provenance(spark):
    assert provenance.of_arguments(["a", "b c", "it's", "{x}\n"]).command == "a 'b c' 'it'\\''s' '(x) '"
    assert provenance.of_arguments(["*.tif", "a;b", ""]).command == "*.tif a;b ''"
    args = ["plain", "b c", "it's", "", "a=b,c:1", "*.tif", "$x|y", 'say "x"', "{a}", "a\nb", "a\tb", "é\u00a0x"]
    t = spark.createDataFrame([(a,) for a in args], "a string")
    assert [r[0] for r in t.select(provenance.quoted_col(t.a)).collect()] == [provenance.quoted(a) for a in args]


def test_one_grid(spark):
    a = (0.0, 30.0, 0.0, 0.0, 0.0, -30.0)
    geo.one_grid(spark, [("a", a, None), ("b", (0.02, *a[1:]), 4326), ("c", None, 32615), ("d", a, None)])
    cases = [((1.0, *a[1:]), None, "origin"), ((0.0, 30.001, *a[2:]), None, "pixel width"), ((0.0, 30.0, 0.1, *a[3:]), None, "rotation"), ((*a[:5], -30.1), None, "pixel height"), (a, 32615, "coordinate system")]
    for transform, epsg, what in cases:
        with pytest.raises(ValueError, match=what):
            geo.one_grid(spark, [("a", a, 4326), ("b", transform, epsg)])


MAP_INFO = [("UTM, 1, 1, 0, 0, 30, 30, 10, N, WGS-84", 32610), ("Geographic Lat/Lon, 1, 1, 0, 0, 1, 1, WGS 1984", 4326), ("utm, 1, 1, 0, 0, 30, 30, 7, southern, wgs_1984 x", 32707), ("UTM, 1, 1, 0, 0, 30, 30, 61, North, WGS-84", None), ("UTM, 1, 1, 0, 0, 30, 30, 10, North, NAD-83", None), ("UTM, 1, 1, 0, 0, 30, 30, 10", None), ("UTM, 1, 1, 0, 0, 30, 30, ten, North, WGS-84", None), ("My geographic, 1, 1, 0, 0, 1, 1, WGS84", 4326), ("Geographic, 1, 1, 0, 0, 1, 1", None), ("Albers, 1, 1, 0, 0, 1, 1, WGS-84", None)]


def test_epsg_of_map_info(spark):
    t = spark.createDataFrame([(m,) for m, _ in MAP_INFO] + [(None,), ("",)], "m string")
    assert [r[0] for r in t.select(geo.epsg_col("m")).collect()] == [e for _, e in MAP_INFO] + [None, None]
    assert [geo.epsg_from_fields([x.strip() for x in m.split(",")]) for m, _ in MAP_INFO] == [e for _, e in MAP_INFO]


def test_tiff_places():
    tags = lambda **t: type("T", (), {"get": lambda self, name, default=(): t.get(name, default)})()
    tie = (0.0, 0.0, 0.0, 500.0, 900.0, 0.0)
    assert tiff.georeference(tags(scale=(30.0, 20.0), tiepoint=tie))[0] == (500.0, 30.0, 0.0, 900.0, 0.0, -20.0)
    assert tiff.georeference(tags(scale=(0.0, 20.0), tiepoint=tie))[0] is None
    assert tiff.georeference(tags(scale=(30.0, float("nan")), tiepoint=tie))[0] is None
    assert tiff.georeference(tags(matrix=(float("inf"),) * 16))[0] is None
    keys = (1, 1, 0, 1, 2048, 0, 1, 4326, 3072, 0, 1, 32615)  # a second key beyond the stated count
    assert tiff.georeference(tags(geokeys=keys))[1] == 4326
    assert tiff.georeference(tags(geokeys=(*keys[:3], 2, *keys[4:])))[1] == 32615


def test_geo():
    assert geo.from_map_info("{UTM, 2, 3, 500, 900, 30, 20, 15, South, WGS-84}") == ((470.0, 30.0, 0.0, 940.0, 0.0, -20.0), 32715)
    assert geo.from_map_info("UTM, 1, 1, 0, 0, 0, 30") is None and geo.from_map_info("x, 1") is None
    assert geo.from_map_info("Geographic Lat/Lon, 1, 1, 0, 0, 1, 1, WGS-84")[1] == 4326
    assert '"central_meridian",-93' in geo.wkt(32615) and geo.wkt(4326).startswith("GEOGCS") and geo.wkt(1) is None


def edges_of(m):
    rows, cols = m.shape
    at = lambda r, c: m[r, c] if 0 <= r < rows and 0 <= c < cols else -1
    out = {}
    for r in range(rows):
        for c in range(cols):
            own = out.setdefault(int(m[r, c]), [])
            for dr, dc, a, b in ((-1, 0, (c + 1, r), (c, r)), (0, 1, (c + 1, r + 1), (c + 1, r)), (1, 0, (c, r + 1), (c + 1, r + 1)), (0, -1, (c, r), (c, r + 1))):
                if at(r + dr, c + dc) != m[r, c]:
                    own.append((a, b))
    return out


def test_polygons():
    ring = np.ones((5, 5), int)
    ring[1:4, 1:4] = 2
    ring[2, 2] = 1
    e = edges_of(ring)
    parts = vector.parts_of(vector.rings_of(e[2]))
    assert [len(p) for p in parts] == [2]
    parts = vector.parts_of(vector.rings_of(e[1]))
    assert sorted(len(p) for p in parts) == [1, 2]
    checker = np.array([[1, 2], [2, 1]])
    assert len(vector.parts_of(vector.rings_of(edges_of(checker)[1]))) == 2
    part = vector.on_map(parts[0], (0.0, 30.0, 0.0, 90.0, 0.0, -30.0))
    assert vector.doubled_area(part[0]) > 0 and all(vector.doubled_area(h) < 0 for h in part[1:])


def test_polygons_fill_their_regions():
    m = RNG.integers(0, 3, (12, 12))
    for region, edges in edges_of(m).items():
        parts = vector.parts_of(vector.rings_of(edges))
        back = np.zeros(m.shape, int)
        for r in range(12):
            for c in range(12):
                back[r, c] = sum(vector.contains(p[0], c + 0.5, r + 0.5) and not any(vector.contains(h, c + 0.5, r + 0.5) for h in p[1:]) for p in parts)
        assert (back == (m == region)).all()


def labels_table(spark, m):
    rows = [("s", int(r), int(c), int(r * m.shape[1] + c), int(m[r, c])) for r in range(m.shape[0]) for c in range(m.shape[1])]
    return spark.createDataFrame(rows, "scene string, row int, col int, px long, region_id long")


def test_geopackage(spark, tmp_path):
    m = RNG.integers(0, 4, (6, 7))
    t = (500.0, 30.0, 0.0, 900.0, 0.0, -30.0)
    for name in ("a", "b"):
        n = gpkg.write_region_map(tmp_path / f"{name}.gpkg", labels_table(spark, m), t, 32615, layer='odd "name"', provenance=provenance.Provenance("x", "y"))
    assert (tmp_path / "a.gpkg").read_bytes() == (tmp_path / "b.gpkg").read_bytes()
    con = sqlite3.connect(tmp_path / "a.gpkg")
    rows = con.execute('SELECT region_id, n_pixels, area, geom FROM "odd ""name""" ORDER BY fid').fetchall()
    ids, counts = np.unique(m[m > 0], return_counts=True)
    assert n == len(rows) and [r[:3] for r in rows] == [(int(i), int(k), k * 900.0) for i, k in zip(ids, counts)]
    assert all(r[3][:2] == b"GP" and r[3][3] == 3 and struct.unpack_from("<i", r[3], 4)[0] == 32615 for r in rows)
    assert con.execute("PRAGMA application_id").fetchone()[0] == gpkg.APPLICATION_ID
    assert {r[0] for r in con.execute("SELECT srs_id FROM gpkg_spatial_ref_sys")} == {-1, 0, 4326, 32615}


def test_data_sources(spark, tmp_path):
    datasource.register(spark)
    for interleave in ("bip", "bsq", "bil"):
        data = image(2)
        p = put_envi(tmp_path / f"i{interleave}", data, interleave)
        df = spark.read.format("raster").option("scene", "z").option("blockRows", 4).load(str(p))
        assert df.rdd.getNumPartitions() == 4
        assert [tuple(r.bands) for r in df.orderBy("px").collect()] == [tuple(x) for x in data.tolist()]
    f = put_tiff(tmp_path / "f.tif", image(1, np.float32), 8)
    assert dict(spark.read.format("raster").load(str(f)).dtypes)["bands"] == "array<float>"
    labels = spark.range(SHAPE[0] * SHAPE[1]).selectExpr("id px", "id % 300 region_id").repartition(5)
    out = str(tmp_path / "map")
    labels.write.format("regionmap").mode("append").option("rows", SHAPE[0]).option("cols", SHAPE[1]).save(out)
    back = spark.read.format("raster").option("kind", "map").load(out)
    assert [r.region_id for r in back.orderBy("px").collect()] == [k % 300 for k in range(SHAPE[0] * SHAPE[1])]
    assert detect.read_region_map(out).meta.dtype == "uint8"
    place = "UTM, 1, 1, 500, 900, 30, 30, 15, North, WGS-84"
    labels.write.format("regionmap").mode("append").option("rows", SHAPE[0]).option("cols", SHAPE[1]).option("mapinfo", place).option("masked", "false").save(out)
    meta = detect.read_region_map(out).meta
    assert meta.epsg == 32615 and meta.nodata is None
    labels.write.format("regionmap").mode("append").option("rows", SHAPE[0]).option("cols", SHAPE[1]).option("like", out).save(out + "2")
    assert detect.read_region_map(out + "2").meta.transform == meta.transform and detect.read_region_map(out + "2").meta.nodata == 0


def test_streamed_series(spark, small, tmp_path):
    from gridloom.operators import pixels
    from gridloom.plans import catalog, scene
    from gridloom.streaming import series

    p = pixels.valid_mask(scene.scene(spark, small), 0)
    layer = p.select("scene", "row", "col", "px", p.layer.alias("bands"))
    classes = [p.select("scene", "row", "col", "px", scene.F.array(f"class{t}").alias("bands")) for t in range(3)]
    tables = {"image": p, "layer": layer, "c1": pixels.changed(*classes[:2]), "c2": pixels.changed(*classes[1:])}
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"step": k, "label": str(k), "image": "image", "stage2": "layer", "change": f"c{k}" if k else None}))
        os.utime(tmp_path / "in" / f"{k}.json", (1e9 + k, 1e9 + k))  # files are taken in order of time
    state = series.SeriesState(spark, f"file://{tmp_path}/state")
    q = series.start(spark, str(tmp_path / "in"), state, tables.__getitem__, scene.CONFIG, scene.STAGE2, str(tmp_path / "checkpoint"))
    q.awaitTermination()
    want = catalog.QUERIES["segment_series"](spark, small).filter("step = 3").orderBy("px").toPandas()
    again = series.SeriesState(spark, f"file://{tmp_path}/state")
    assert again.done == 2 and again.labels.orderBy("px").toPandas()["region_id"].tolist() == want["region_id"].tolist()
    late = spark.createDataFrame([(7, "7", "image", "layer", "c1")], series.SCHEMA)
    with pytest.raises(ValueError):
        series.sink(again, tables.__getitem__, scene.CONFIG, scene.STAGE2)(late, 0)

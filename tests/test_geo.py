"""Spatial sources against files that the tests write."""

import json
import sqlite3
import struct

import numpy as np
import pytest

from terraloom.sources import geo

SQUARE, FAR = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)], [(10.0, 10.0), (11.0, 10.0), (11.0, 11.0), (10.0, 10.0)]


def plain(rows):
    return sorted((r["id"], r["kind"], [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]], dict(r["props"])) for r in rows)


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "a", "n": 1, "no": None}, "geometry": {"type": "Polygon", "coordinates": [SQUARE]}},
        {"type": "Feature", "properties": {"name": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[FAR]]}},
        {"type": "Feature", "properties": None, "geometry": {"type": "Point", "coordinates": [1.0, 1.0, 5.0]}},
        {"type": "Feature", "properties": {}, "geometry": None}]}
    (tmp_path / "x.geojson").write_text(json.dumps(doc))
    got = plain(geo.geojson(spark, str(tmp_path)).collect())
    assert got == [(0, "Polygon", [SQUARE], {"name": "a", "n": "1", "no": None}), (1, "MultiPolygon", [FAR], {"name": "b"}), (2, "Point", [[(1.0, 1.0)]], {}), (3, "none", [], {})]
    assert [r["id"] for r in geo.geojson(spark, str(tmp_path), (0.5, 0.5, 3.0, 3.0)).orderBy("id").collect()] == [0, 2]
    assert geo.optional_features(spark, str(tmp_path / "none")).count() == 0
    lines = [json.loads(r[0]) for r in geo.as_geojson(geo.geojson(spark, str(tmp_path)).filter("id = 0"), ["id"]).collect()]
    assert lines == [{"type": "Feature", "properties": {"id": 0}, "geometry": {"type": "Polygon", "coordinates": [[list(p) for p in SQUARE]]}}]


def shape(kind, rings):
    points = [p for r in rings for p in r]
    xs, ys = zip(*points)
    if kind == 1:
        return struct.pack("<i2d", 1, *points[0])
    starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
    return struct.pack(f"<i4d2i{len(rings)}i", kind, min(xs), min(ys), max(xs), max(ys), len(rings), len(points), *starts) + b"".join(struct.pack("<2d", *p) for p in points)


def test_shapefile(spark, tmp_path):
    bodies = [shape(5, [SQUARE, FAR]), shape(3, [FAR[:2]]), shape(1, [[(1.5, 1.5)]]), struct.pack("<i", 0)]
    (tmp_path / "v.shp").write_bytes(b"\0" * 100 + b"".join(struct.pack(">2i", k + 1, len(b) // 2) + b for k, b in enumerate(bodies)))
    fields = [(b"NAME", b"C", 6), (b"N", b"N", 5)]
    head = 32 + 32 * len(fields) + 1
    rows = [(b" ", "uno", "1"), (b" ", "dos", "2.5"), (b"*", "x", "3"), (b" ", "", "")]
    (tmp_path / "v.dbf").write_bytes(struct.pack("<4xIHH20x", len(rows), head, 12) + b"".join(n.ljust(11, b"\0") + t + struct.pack("<4xB15x", w) for n, t, w in fields) + b"\r" + b"".join(f + a.encode().ljust(6) + b.encode().rjust(5) for f, a, b in rows))
    got = plain(geo.shapefile(spark, str(tmp_path)).collect())
    assert got == [(0, "Polygon", [SQUARE, FAR], {"NAME": "uno", "N": "1"}), (1, "MultiLineString", [FAR[:2]], {"NAME": "dos", "N": "2.5"}), (3, "none", [], {"NAME": None, "N": None})]
    assert [r["id"] for r in geo.shapefile(spark, str(tmp_path), (-1.0, -1.0, 1.0, 1.0)).collect()] == [0]


def test_geopackage(spark, tmp_path):
    def wkb(kind, *rings):
        if kind == 3:
            return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in rings)
        return struct.pack("<BI2d", 1, 1, *rings[0][0])

    db = sqlite3.connect(tmp_path / "v.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('zones', 'geom')")
    db.execute("CREATE TABLE zones (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT)")
    multi = struct.pack("<BII", 1, 6, 1) + wkb(3, FAR)
    for n, (flags, box, body) in enumerate([(1, b"", wkb(3, SQUARE)), (3, struct.pack("<4d", 10, 11, 10, 11), multi), (1, b"", wkb(1, [(4.0, 5.0)])), (17, b"", b"")]):
        db.execute("INSERT INTO zones VALUES (?, ?, ?)", (n, b"GP\0" + bytes([flags]) + struct.pack("<i", 4326) + box + body, f"z{n}"))
    db.commit()
    db.close()
    got = plain(geo.geopackage(spark, str(tmp_path), "zones").collect())
    assert [(k, rings, p["name"]) for _, k, rings, p in got] == [("Polygon", [SQUARE], "z0"), ("MultiPolygon", [FAR], "z1"), ("Point", [[(4.0, 5.0)]], "z2"), ("none", [], "z3")]
    assert [r["id"] for r in geo.geopackage(spark, str(tmp_path), box=(9.0, 9.0, 12.0, 12.0)).collect()] == [1]


def test_npy(spark, tmp_path):
    x = np.arange(12, dtype="f4").reshape(4, 3)
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "b.npy", np.array([7, 8]))
    got = {(r["path"][-5:], r["row"]): r["values"] for r in geo.npy(spark, str(tmp_path)).collect()}
    assert got == {("a.npy", k): x[k].tolist() for k in range(4)} | {("b.npy", 0): [7.0], ("b.npy", 1): [8.0]}


@pytest.mark.parametrize("dtype", ["u1", "i2", "f4", "f8"])
def test_geotiff_round_trip(dtype):
    x = (np.arange(2 * 5 * 7) % 50).reshape(2, 5, 7).astype(dtype)
    back, origin, pixel, nodata = geo.read_geotiff(geo.write_geotiff(x, (-77.0, 9.0), (0.25, 0.5), 3))
    assert (back == x).all() and origin == (-77.0, 9.0) and pixel == (0.25, 0.5) and nodata == 3


def tiff(order, blocks, tags):
    """A file of given blocks of one band."""
    fields = sorted({**tags, 273 if 322 not in tags else 324: ("I", [0] * len(blocks)), 279 if 322 not in tags else 325: ("I", [len(b) for b in blocks])}.items())
    codes = {"H": 3, "I": 4, "d": 12}
    at = 8 + 2 + 12 * len(fields) + 4
    extra, entries = b"", b""
    room = at + sum(struct.calcsize(f"{len(v)}{f}") for _, (f, v) in fields if struct.calcsize(f"={len(v)}{f}") > 4)
    for tag, (form, values) in fields:
        if tag in (273, 324):
            values = [room + sum(map(len, blocks[:k])) for k in range(len(blocks))]
        raw = struct.pack(f"{order}{len(values)}{form}", *values)
        entries += struct.pack(f"{order}HHI", tag, codes[form], len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(f"{order}I", at + len(extra)))
        extra += raw if len(raw) > 4 else b""
    return struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 8) + struct.pack(f"{order}H", len(fields)) + entries + b"\0" * 4 + extra + b"".join(blocks)


def lzw(data):
    """A plain encoder with early change."""
    table, codes, w = {bytes([k]): k for k in range(256)}, [(256, 9)], b""
    n, width = 258, 9
    for b in data:
        if w + bytes([b]) in table:
            w += bytes([b])
            continue
        codes.append((table[w], width))
        table[w + bytes([b])] = n
        n += 1
        width = 9 if n < 511 else 10 if n < 1023 else 11 if n < 2047 else 12
        w = bytes([b])
    codes += [(table[w], width), (257, 9 if n + 1 < 511 else 10 if n + 1 < 1023 else 11 if n + 1 < 2047 else 12)]
    bits = "".join(f"{c:0{size}b}" for c, size in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def test_geotiff_of_other_makers():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, (40, 33)).astype("u1")
    base = {256: ("I", [33]), 257: ("I", [40]), 258: ("H", [8]), 278: ("I", [16])}
    strips = [x[k : k + 16].tobytes() for k in (0, 16, 32)]
    assert (geo.read_geotiff(tiff(">", strips, base))[0][0] == x).all()
    assert (geo.read_geotiff(tiff("<", [lzw(s) for s in strips], base | {259: ("H", [5])}))[0][0] == x).all()
    diff = np.diff(x, axis=1, prepend=np.zeros((40, 1), "u1"))
    assert (geo.read_geotiff(tiff("<", [diff[k : k + 16].tobytes() for k in (0, 16, 32)], base | {317: ("H", [2])}))[0][0] == x).all()
    padded = np.zeros((48, 48), "u1")
    padded[:40, :33] = x
    tiles = [padded[r : r + 16, c : c + 16].tobytes() for r in (0, 16, 32) for c in (0, 16, 32)]
    assert (geo.read_geotiff(tiff("<", tiles, {256: ("I", [33]), 257: ("I", [40]), 258: ("H", [8]), 322: ("I", [16]), 323: ("I", [16])}))[0][0] == x).all()
    assert geo._unpackbits(bytes([2, 1, 2, 3, 254, 9, 128, 0, 7])) == bytes([1, 2, 3, 9, 9, 9, 7])


def test_geotiff_cells_and_tiles(spark, tmp_path):
    x = np.arange(30.0).reshape(1, 5, 6)
    (tmp_path / "a.tif").write_bytes(geo.write_geotiff(x, (10.0, 50.0), (2.0, 1.0), 7.0))
    cells = geo.geotiff(spark, str(tmp_path), ["v"])
    got = {(r["row"], r["col"]): (r["x"], r["y"], r["v"]) for r in cells.collect()}
    assert len(got) == 30 and got[1, 1] == (13.0, 48.5, None) and got[4, 5] == (21.0, 45.5, 29.0)
    tiles = {(r["tile_row"], r["tile_col"]): geo.read_geotiff(r["tiff"]) for r in geo.raster_tiles(cells, ["v"], (10.0, 50.0), (2.0, 1.0), 4).collect()}
    assert sorted(tiles) == [(0, 0), (0, 1), (1, 0), (1, 1)] and tiles[1, 1][1] == (18.0, 46.0)
    assert tiles[0, 0][0][0][1, 1] == -9999 and tiles[1, 1][0][0][0, 1] == 29

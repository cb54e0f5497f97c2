"""Sources of the spatial world: GeoJSON, shapefiles, GeoPackages, GeoTIFF and .npy arrays; and tiles as GeoTIFF.

A file of these formats is one unit: a task decodes it whole, and a folder's files spread over tasks. For large layers convert
once to Parquet with box columns, whose comparisons reach the scan (`operators.spatial.overlapping`).

Features have id, kind, rings (array<array<struct<x,y>>>; of points and lines one ring), xmin, ymin, xmax, ymax and props, a
map of strings.
"""

from __future__ import annotations

import io
import json
import sqlite3
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import overlapping
from ..session import ship_package

Box = tuple[float, float, float, float]
RINGS = "array<array<struct<x:double,y:double>>>"
FEATURES = f"path string, id long, kind string, rings {RINGS}, xmin double, ymin double, xmax double, ymax double, props map<string,string>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_SCHEMA = pa.schema([("path", pa.string()), ("id", pa.int64()), ("kind", pa.string()), ("rings", pa.list_(pa.list_(_POINT))), ("xmin", pa.float64()), ("ymin", pa.float64()), ("xmax", pa.float64()), ("ymax", pa.float64()), ("props", pa.map_(pa.string(), pa.string()))])
#: Features, or values of an array, that leave a task at once.
STEP = 4096


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    ship_package(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def _row(path: str, n: int, kind: str, rings: list[list[tuple[float, float]]], props: dict) -> dict:
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    said = [(k, None if v is None else v if isinstance(v, str) else json.dumps(v)) for k, v in props.items()]
    return {"path": path, "id": n, "kind": kind, "rings": [[{"x": float(p[0]), "y": float(p[1])} for p in r] for r in rings], "xmin": min(xs, default=None), "ymin": min(ys, default=None), "xmax": max(xs, default=None), "ymax": max(ys, default=None), "props": said}


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == STEP:
            yield pa.RecordBatch.from_pylist(held, _SCHEMA)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _SCHEMA)


def _features(files: DataFrame, decode, box: Box | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield from _batches(decode(r, box))

    found = files.mapInArrow(run, FEATURES)
    return found if box is None else overlapping(found, box)


def _geometry(g: dict | None) -> tuple[str, list[list[tuple[float, float]]]]:
    """Kind and rings of a GeoJSON geometry."""
    if not g:
        return "none", []
    kind, c = g["type"], g.get("coordinates")
    if kind == "GeometryCollection":
        return kind, [r for part in g["geometries"] for r in _geometry(part)[1]]
    depth = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}[kind]
    if depth == 0:
        return kind, [[c]]
    if depth == 1:
        return kind, [c] if kind == "LineString" else [[p] for p in c]
    return kind, c if depth == 2 else [r for part in c for r in part]


def geojson(spark: SparkSession, path: str, box: Box | None = None, pattern: str = "*json") -> DataFrame:
    """Features of GeoJSON files whose boxes meet a box."""

    def decode(r: dict, box: Box | None) -> Iterator[dict]:
        doc = json.loads(r["content"])
        every = doc["features"] if doc["type"] == "FeatureCollection" else [doc if doc["type"] == "Feature" else {"geometry": doc, "properties": {}}]
        for n, f in enumerate(every):
            kind, rings = _geometry(f.get("geometry"))
            yield _row(r["path"], n, kind, [[(p[0], p[1]) for p in ring] for ring in rings], f.get("properties") or {})

    return _features(_binary(spark, path, pattern), decode, box)


def _dbf(data: bytes) -> list[dict]:
    """Rows of a dBase table; deleted rows are None, so that numbers stay those of the shapes."""
    if len(data) < 32:
        return []
    n, head, size = struct.unpack_from("<IHH", data, 4)
    names, at = [], 32
    while at < head - 1 and data[at] != 0x0D:
        names.append((data[at : at + 11].split(b"\0")[0].decode("utf-8", "replace"), chr(data[at + 11]), data[at + 16]))
        at += 32
    out = []
    for k in range(n):
        raw, place, row = data[head + k * size : head + (k + 1) * size], 1, {}
        for name, kind, width in names:
            text = raw[place : place + width].decode("utf-8", "replace").strip("\0 ")
            row[name] = (None if not text or "*" in text else float(text) if "." in text or "e" in text.lower() else int(text)) if kind in "NF" else text or None
            place += width
        out.append(None if raw[:1] == b"*" else row)
    return out


def _shapes(data: bytes, box: Box | None) -> Iterator[tuple[int, str, list[list[tuple[float, float]]]]]:
    """Number, kind and rings of a shapefile's records; those whose own box misses the box are passed over undecoded."""
    kinds = {1: "Point", 3: "MultiLineString", 5: "Polygon", 8: "MultiPoint"}
    at, n = 100, 0
    while at + 12 <= len(data):
        length = struct.unpack_from(">i", data, at + 4)[0] * 2
        body = data[at + 8 : at + 8 + length]
        at, n = at + 8 + length, n + 1
        code = struct.unpack_from("<i", body)[0] % 10  # the variants with a height or a measure have like bodies
        if code == 1:
            yield n - 1, "Point", [[struct.unpack_from("<2d", body, 4)]]
        elif code in kinds:
            x0, y0, x1, y1 = struct.unpack_from("<4d", body, 4)
            if box is not None and (x0 > box[2] or x1 < box[0] or y0 > box[3] or y1 < box[1]):
                continue
            if code == 8:
                many = struct.unpack_from("<i", body, 36)[0]
                yield n - 1, "MultiPoint", [[tuple(p)] for p in np.frombuffer(body, "<f8", 2 * many, 40).reshape(-1, 2).tolist()]
                continue
            parts, many = struct.unpack_from("<2i", body, 36)
            cuts = [*struct.unpack_from(f"<{parts}i", body, 44), many]
            points = np.frombuffer(body, "<f8", 2 * many, 44 + 4 * parts).reshape(-1, 2).tolist()
            yield n - 1, kinds[code], [[tuple(p) for p in points[i:j]] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        else:
            yield n - 1, "none", []


def shapefile(spark: SparkSession, path: str, box: Box | None = None) -> DataFrame:
    """Features of shapefiles (.shp, attributes from the .dbf beside it) whose boxes meet a box."""
    stem = F.regexp_replace("path", r"(?i)\.(shp|dbf)$", "")
    shapes = _binary(spark, path, "*.[sS][hH][pP]").withColumn("stem", stem)
    tables = _binary(spark, path, "*.[dD][bB][fF]").select(stem.alias("stem"), F.col("content").alias("dbf"))

    def decode(r: dict, box: Box | None) -> Iterator[dict]:
        rows = _dbf(r["dbf"] or b"")
        for n, kind, rings in _shapes(r["content"], box):
            if n >= len(rows) or rows[n] is not None:
                yield _row(r["path"], n, kind, rings, rows[n] if n < len(rows) else {})

    return _features(shapes.join(tables, "stem", "left").select("path", "content", "dbf"), decode, box)


def _wkb(data: bytes, at: int = 0) -> tuple[str, list[list[tuple[float, float]]], int]:
    """Kind, rings and the end of a well-known binary geometry; heights and measures are dropped."""
    order = "<" if data[at] else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5
    if code & 0x20000000:
        at += 4  # an extended one with a reference system
    wide = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) + {0: 0, 1: 1, 2: 1, 3: 2}[(code & 0xFFFF) // 1000]
    kind = (code & 0xFFFF) % 1000

    def points(at: int, n: int) -> tuple[list[tuple[float, float]], int]:
        x = np.frombuffer(data, order + "f8", n * wide, at).reshape(n, wide)
        return [tuple(p) for p in x[:, :2].tolist()], at + 8 * n * wide

    if kind == 1:
        ring, at = points(at, 1)
        return "Point", [ring], at
    n = struct.unpack_from(order + "I", data, at)[0]
    at += 4
    rings: list[list[tuple[float, float]]] = []
    if kind == 2:
        ring, at = points(at, n)
        return "LineString", [ring], at
    if kind == 3:
        for _ in range(n):
            many = struct.unpack_from(order + "I", data, at)[0]
            ring, at = points(at + 4, many)
            rings.append(ring)
        return "Polygon", rings, at
    for _ in range(n):
        _, some, at = _wkb(data, at)
        rings += some
    return {4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}.get(kind, "GeometryCollection"), rings, at


def geopackage(spark: SparkSession, path: str, layer: str | None = None, box: Box | None = None) -> DataFrame:
    """Features of a GeoPackage's layers (one, if named) whose boxes meet a box."""

    def decode(r: dict, box: Box | None) -> Iterator[dict]:
        db = sqlite3.connect(":memory:")
        db.deserialize(r["content"])
        for table, column in db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY 1").fetchall():
            if layer is not None and table != layer:
                continue
            rows = db.execute('SELECT * FROM "{}"'.format(table.replace('"', '""')))
            names = [c[0] for c in rows.description]
            for n, values in enumerate(rows):
                props = dict(zip(names, values, strict=True))
                blob = props.pop(column)
                kind, rings = "none", []
                if blob and not blob[3] & 0x10:
                    kind, rings, _ = _wkb(blob, 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7])
                yield _row(r["path"], n, kind, rings, {k: v for k, v in props.items() if not isinstance(v, bytes)} | ({"layer": table} if layer is None else {}))
        db.close()

    return _features(_binary(spark, path, "*.gpkg"), decode, box)


def optional_features(spark: SparkSession, path: str, read=geojson, **options) -> DataFrame:
    """Features of a file that may be missing: then an empty table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return read(spark, path, **options) if there else spark.createDataFrame([], FEATURES)


def npy(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """Numeric .npy arrays: path, row (place along the first axis), values (the row, flattened)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = np.load(io.BytesIO(r["content"]), allow_pickle=False)
                x = x.reshape(x.shape[0], -1).astype(float) if x.ndim else x.reshape(1, 1).astype(float)
                for at in range(0, len(x), STEP):
                    part = x[at : at + STEP]
                    values = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * x.shape[1], pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(part)), pa.array(np.arange(at, at + len(part))), values], ["path", "row", "values"])

    return _binary(spark, path, pattern).mapInArrow(run, "path string, row long, values array<double>")


_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def _unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, highest bit first, that widen one code early."""
    out, table, width, prev, bits, n, at = bytearray(), [], 9, b"", 0, 0, 0
    fresh = [bytes([k]) for k in range(256)] + [b"", b""]
    while True:
        while n < width:
            if at >= len(data):
                return bytes(out)
            bits, n, at = bits << 8 | data[at], n + 8, at + 1
        code = bits >> (n - width)
        n -= width
        bits &= (1 << n) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, prev = [*fresh], 9, b""
            continue
        entry = table[code] if code < len(table) else prev + prev[:1]
        out += entry
        if prev:
            table.append(prev + entry[:1])
        prev = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def _unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        k = data[at]
        if k < 128:
            out += data[at + 1 : at + k + 2]
            at += k + 2
        else:
            if k > 128:
                out += data[at + 1 : at + 2] * (257 - k)
            at += 2 if k > 128 else 1
    return bytes(out)


def read_geotiff(data: bytes) -> tuple[np.ndarray, tuple[float, float], tuple[float, float], float | None]:
    """bands x rows x columns, the upper left corner, a pixel's width and height, and the value that means no data.

    Strips and tiles, chunky and planar; plain, LZW, deflate and PackBits; predictors 1 and 2; classic files.
    """
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    if struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in _TYPES:
            continue
        form = f"{order}{count * len(_TYPES[kind])}{_TYPES[kind][0]}"
        place = at + 10 + 12 * k
        if struct.calcsize(form) > 4:
            place = struct.unpack_from(order + "I", data, place)[0]
        tags[tag] = struct.unpack_from(form, data, place)
    width, height, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    bits, sign = tags.get(258, (1,))[0], tags.get(339, (1,))[0]
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[sign]}{bits // 8}")
    plain = {1: bytes, 5: _unlzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpackbits}[tags.get(259, (1,))[0]]
    planar = tags.get(284, (1,))[0] == 2
    tiled = 322 in tags
    w, h = (tags[322][0], tags[323][0]) if tiled else (width, min(tags.get(278, (height,))[0], height))
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-width // w), -(-height // h)
    out = np.zeros((bands, down * h, across * w), dtype.newbyteorder("="))
    deep = 1 if planar else bands
    for k, (o, size) in enumerate(zip(offsets, sizes, strict=True)):
        band, place = divmod(k, across * down)
        r, c = divmod(place, across)
        raw = np.frombuffer(plain(data[o : o + size]), dtype)
        rows = min(h, len(raw) // (w * deep))
        block = raw[: rows * w * deep].reshape(rows, w, deep)
        if tags.get(317, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
        block = np.moveaxis(block, 2, 0)
        out[band : band + deep, r * h : r * h + rows, c * w : (c + 1) * w] = block
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    nodata = b"".join(tags[42113]).rstrip(b"\0 ") if 42113 in tags else b""
    return out[:, :height, :width], (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]), (scale[0], scale[1]), float(nodata) if nodata else None


def write_geotiff(bands: np.ndarray, origin: tuple[float, float], pixel: tuple[float, float], nodata: float | None = None) -> bytes:
    """A classic little-endian GeoTIFF of bands x rows x columns: one deflated strip a band."""
    bands = np.ascontiguousarray(bands)
    kind = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    strips = [zlib.compress(b.astype(b.dtype.newbyteorder("<")).tobytes()) for b in bands]
    n, rows, cols = bands.shape
    said = b"" if nodata is None else f"{nodata:g}".encode() + b"\0"
    fields = [(256, "I", (cols,)), (257, "I", (rows,)), (258, "H", (bands.dtype.itemsize * 8,) * n), (259, "H", (8,)), (262, "H", (1,)), (273, "I", (0,) * n), (277, "H", (n,)), (278, "I", (rows,)), (279, "I", tuple(map(len, strips))), (284, "H", (2,)), (339, "H", (kind,) * n), (33550, "d", (*pixel, 0.0)), (33922, "d", (0.0, 0.0, 0.0, *origin, 0.0)), (34735, "H", (1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4326))]
    if said:
        fields.append((42113, "c", tuple(bytes([b]) for b in said)))
    codes = {"I": 4, "H": 3, "d": 12, "c": 2}
    head = 8 + 2 + 12 * len(fields) + 4
    room = head + sum(struct.calcsize(f"<{len(v)}{f}") for _, f, v in fields if struct.calcsize(f"<{len(v)}{f}") > 4)
    starts = tuple(room + sum(map(len, strips[:k])) for k in range(n))
    entries, more = b"", b""
    for tag, form, values in fields:
        values = starts if tag == 273 else values
        raw = struct.pack(f"<{len(values)}{form}", *values)
        entries += struct.pack("<HHI", tag, codes[form], len(values))
        if len(raw) > 4:
            entries += struct.pack("<I", head + len(more))
            more += raw
        else:
            entries += raw.ljust(4, b"\0")
    return struct.pack("<2sHIH", b"II", 42, 8, len(fields)) + entries + struct.pack("<I", 0) + more + b"".join(strips)


def geotiff(spark: SparkSession, path: str, bands: list[str], pattern: str = "*.tif*") -> DataFrame:
    """Cells of GeoTIFF files: path, row, col, x and y of the centre, and the bands by name; no data is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x, origin, pixel, nodata = read_geotiff(r["content"])
                rows = max(1, STEP // x.shape[2])
                for at in range(0, x.shape[1], rows):
                    part = x[: len(bands), at : at + rows].astype(float)
                    row, col = np.divmod(np.arange(part[0].size), x.shape[2])
                    row += at
                    flat = [p.ravel() for p in part]
                    cols = [pa.array(v, mask=(v == nodata) | np.isnan(v) if nodata is not None else np.isnan(v)) for v in flat]
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(row)), pa.array(row, pa.int64()), pa.array(col, pa.int64()), pa.array(origin[0] + (col + 0.5) * pixel[0]), pa.array(origin[1] - (row + 0.5) * pixel[1]), *cols], ["path", "row", "col", "x", "y", *bands])

    return _binary(spark, path, pattern).mapInArrow(run, "path string, row long, col long, x double, y double" + "".join(f", `{n}` double" for n in bands))


def raster_tiles(cells: DataFrame, bands: list[str], origin: tuple[float, float], pixel: tuple[float, float], tile: int = 256, nodata: float = -9999.0) -> DataFrame:
    """cells(row, col, bands) as GeoTIFF tiles: tile_row, tile_col, tiff. A tile is one task's group; missing cells are no data."""
    ship_package(cells.sparkSession)

    def draw(t: pa.Table) -> pa.Table:
        row, col = t.column("row").to_numpy(), t.column("col").to_numpy()
        tr, tc = int(row[0] // tile), int(col[0] // tile)
        x = np.full((len(bands), tile, tile), nodata)
        for k, name in enumerate(bands):
            v = t.column(name).to_numpy(zero_copy_only=False)
            x[k, row - tr * tile, col - tc * tile] = np.where(np.isnan(v), nodata, v)
        corner = (origin[0] + tc * tile * pixel[0], origin[1] - tr * tile * pixel[1])
        return pa.table({"tile_row": [tr], "tile_col": [tc], "tiff": [write_geotiff(x, corner, pixel, nodata)]})

    d = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *(F.col(b).cast("double").alias(b) for b in bands))
    return d.groupBy(F.expr(f"row div {tile}").alias("__r"), F.expr(f"col div {tile}").alias("__c")).applyInArrow(lambda t: draw(t), "tile_row long, tile_col long, tiff binary")


def as_geojson(features: DataFrame, props: list[str]) -> DataFrame:
    """Polygons (rings and columns) as lines of GeoJSON features: a text that any number of tasks writes."""
    ring = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    shape = F.struct(F.lit("Polygon").alias("type"), F.transform("rings", ring).alias("coordinates"))
    return features.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), shape.alias("geometry"))).alias("value"))

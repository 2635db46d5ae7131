"""GeoPackage and Shapefile.

A GeoPackage is read by the task that Spark gives its bytes to, a Shapefile in
pieces; writers take rows or records from an ordered iterator and replace the
target only when it is complete.
"""

from __future__ import annotations

import json
import os
import re
import sqlite3
import struct
import tempfile
from collections.abc import Iterator
from contextlib import ExitStack, closing
from functools import partial
from itertools import count, islice
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..model import FID, GEOM, TYPES, Field, Layer, LayerError, LayerMeta
from .place import exists, machine_path, on_driver, replaced, staged

_SQL = {"text": "TEXT", "number": "REAL", "bool": "BOOLEAN"}


def check_dbf_names(fields) -> None:
    """1 to 10 of ``[A-Za-z0-9_]``, distinct whatever their case."""
    names = [f.name for f in fields]
    if any(not re.fullmatch(r"[A-Za-z0-9_]{1,10}", n) for n in names) or len({n.lower() for n in names}) < len(names):
        raise LayerError("field names do not fit a DBF table")


def _writable(lay: Layer) -> str:
    if lay.meta.geometry_type not in ("POINT", "LINESTRING", "POLYGON"):
        raise LayerError("only layers of points, lines or polygons are written")
    return lay.meta.geometry_type


def _srid(crs: str) -> int:
    code = crs.upper().removeprefix("EPSG:")
    return int(code) if code.isdigit() else 0


def write_geopackage(lay: Layer, path: str, keep_others: bool = True) -> None:
    """One layer into a GeoPackage; other layers stay; the old file is replaced only by a complete new one."""
    kind, names = _writable(lay), lay.meta.names()
    with replaced(lay.df.sparkSession, path, keep=keep_others) as (made,), closing(sqlite3.connect(made)) as db:
        db.executescript(
            "PRAGMA application_id=1196444487; PRAGMA user_version=10300;"
            "CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys(srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);"
            "CREATE TABLE IF NOT EXISTS gpkg_contents(table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);"
            "CREATE TABLE IF NOT EXISTS gpkg_geometry_columns(table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);"
        )
        table, srid = lay.meta.name, _srid(lay.meta.crs)
        quote = lambda n: '"' + n.replace('"', '""') + '"'
        for known in {0, -1, 4326, srid}:
            db.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?,?,?,?,?,?)", (f"EPSG:{known}", known, "EPSG" if known > 0 else "NONE", known, "undefined", ""))
        db.execute(f"DROP TABLE IF EXISTS {quote(table)}")
        for meta in ("gpkg_contents", "gpkg_geometry_columns"):
            db.execute(f"DELETE FROM {meta} WHERE table_name = ?", (table,))
        columns = "".join(f", {quote(f.name)} {_SQL[f.type]}" for f in lay.meta.fields)
        db.execute(f"CREATE TABLE {quote(table)}(fid INTEGER PRIMARY KEY, geom BLOB{columns})")
        db.execute("INSERT INTO gpkg_contents(table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (table, table, srid))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", (table, kind, srid))
        head = b"GP\x00\x01" + struct.pack("<i", srid)
        insert = f"INSERT INTO {quote(table)} VALUES ({','.join('?' * (2 + len(names)))})"
        for row in lay.df.select(FID, GEOM, *names).orderBy(FID).toLocalIterator():
            if row[GEOM] is not None and codec.decode(bytes(row[GEOM]))[0] != kind:
                raise LayerError("mixed geometry types")
            db.execute(insert, (row[FID], None if row[GEOM] is None else head + bytes(row[GEOM]), *row[2:]))
        db.commit()


def _open_bytes(content: bytes) -> tuple[sqlite3.Connection, str]:
    handle, name = tempfile.mkstemp(suffix=".gpkg")
    with os.fdopen(handle, "wb") as out:
        out.write(content)
    return sqlite3.connect(name), name


def _described(spark: SparkSession, path: str) -> list:
    """(name, geometry type, srs, geometry column, table_info) of the feature layers; the file stays on the executors."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                db, temporary = _open_bytes(bytes(data))
                found = db.execute("SELECT table_name, geometry_type_name, srs_id, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall()
                info = [[(c[1], c[2], bool(c[5])) for c in db.execute('PRAGMA table_info("{}")'.format(r[0].replace('"', '""')))] for r in found]
                db.close()
                os.remove(temporary)
                yield pd.DataFrame([(*r, json.dumps(i)) for r, i in zip(found, info, strict=True)], columns=["name", "kind", "srs", "geom", "info"])

    content = spark.read.format("binaryFile").load(path).select("content")
    return content.mapInPandas(rows, "name string, kind string, srs long, geom string, info string").collect()


def geopackage_layers(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(name, geometry type, CRS) of the feature layers."""
    return [(r.name, r.kind, f"EPSG:{r.srs}" if r.srs > 0 else "") for r in _described(spark, path)]


def read_geopackage(spark: SparkSession, path: str, name: str = "", geometry_only: bool = False) -> Layer:
    """A feature layer, the first by default; ids are places in the order of reading."""
    found = next((r for r in _described(spark, path) if not name or r.name == name), None)
    if found is None:
        raise LayerError(f"no such layer: {name}")
    table, kind, crs = found.name, found.kind, f"EPSG:{found.srs}" if found.srs > 0 else ""
    content = spark.read.format("binaryFile").load(path).select("content")
    geom = found.geom
    number = ("INT", "REAL", "DOUB", "FLOA", "MEDIUM", "TINY", "SMALL")
    fields = tuple(
        Field(name, "bool" if kind.upper() == "BOOLEAN" else "number" if kind.upper().startswith(number) else "text")
        for name, kind, is_key in json.loads(found.info)
        if not is_key and name != geom
    )
    fields = () if geometry_only else fields

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                db, temporary = _open_bytes(bytes(data))
                columns = ", ".join(f'"{f.name}"' for f in fields)
                cursor = db.execute(f'SELECT "{geom}"{", " + columns if columns else ""} FROM "{table}" ORDER BY rowid')
                place = 0
                while got := cursor.fetchmany(10_000):
                    out = pd.DataFrame([(place + i + 1, _plain(r[0]), *(_cast(v, f.type) for v, f in zip(r[1:], fields, strict=True))) for i, r in enumerate(got)])
                    place += len(got)
                    yield out
                db.close()
                os.remove(temporary)

    shape = ", ".join([f"{FID} long", f"{GEOM} binary", *(f"`{f.name}` {TYPES[f.type]}" for f in fields)])
    df = content.mapInPandas(lambda it: (f.set_axis([FID, GEOM, *[x.name for x in fields]], axis=1) for f in rows(it)), shape)
    return Layer(df.select(FID, *[f"`{f.name}`" for f in fields], GEOM), LayerMeta(table, crs, kind, fields, source=path))


def _plain(blob: bytes | None) -> bytes | None:
    """The WKB inside a GeoPackage blob."""
    if blob is None:
        return None
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7]
    return bytes(blob[8 + envelope :])


def _cast(value, kind: str):
    if value is None:
        return None
    return bool(value) if kind == "bool" else float(value) if kind == "number" else str(value).strip()


_SHAPES = {"POINT": 1, "LINESTRING": 3, "POLYGON": 5}


def write_shapefile(lay: Layer, path: str, encoding: str = "utf-8") -> None:
    """``.shp``, ``.shx``, ``.dbf`` and ``.cpg`` beside each other; UTF-8 by default."""
    kind = _writable(lay)
    check_dbf_names(lay.meta.fields)
    stem = path.removesuffix(".shp")
    codes = {"text": b"C", "number": b"N", "bool": b"L"}
    # A text column is as wide as its longest value, and 254 at most, which is the format's bound.
    texts = [f.name for f in lay.meta.fields if f.type == "text"]
    as_text = {c: F.col(f"`{c}`").cast("string") for c in texts}
    longest = lay.df.agg(F.lit(0), *[F.max(F.octet_length(c)) for c in as_text.values()]).first()[1:]
    widths = dict(zip(texts, (min(254, max(1, n or 1)) for n in longest), strict=True))
    sizes = [widths.get(f.name) or {"number": 24, "bool": 1}[f.type] for f in lay.meta.fields]
    at, n = 50, 0
    low, high = np.full(2, np.inf), np.full(2, -np.inf)
    descriptors = b"".join(
        f.name.encode().ljust(11, b"\0") + codes[f.type] + bytes(4) + bytes([size, 8 if f.type == "number" else 0]) + bytes(14) for f, size in zip(lay.meta.fields, sizes, strict=True)
    )

    def header(words: int) -> bytes:
        box = struct.pack("<8d", *(np.concatenate([low, high]) if n and np.isfinite(low).all() else np.zeros(4)), 0, 0, 0, 0)
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i", 1000, _SHAPES[kind]) + box

    def table_header() -> bytes:
        return struct.pack("<4BIHH20x", 3, 100, 1, 1, n, 33 + len(descriptors), 1 + sum(sizes)) + descriptors + b"\r"

    # The executors make the bytes of records in order; the driver only numbers and places them.
    rows = lay.df.select(FID, GEOM, *[as_text[f.name].alias(f.name) if f.type == "text" else F.col(f"`{f.name}`") for f in lay.meta.fields]).orderBy(FID).drop(FID)
    blocks = rows.mapInArrow(partial(_blocks, kind=kind, types=[f.type for f in lay.meta.fields], sizes=sizes, encoding=encoding), _BLOCK).persist(StorageLevel.DISK_ONLY)
    try:
        blocks.count()  # all partitions at once, which the iterator takes one by one
        with replaced(lay.df.sparkSession, *(stem + end for end in (".shp", ".shx", ".dbf", ".cpg"))) as made, ExitStack() as stack:
            shapes, index, table, code_page = (stack.enter_context(open(name, "wb")) for name in made)
            # The headers hold counts and bounds, so they are written again at the end.
            shapes.write(header(0))
            index.write(header(0))
            table.write(table_header())
            for block in blocks.toLocalIterator():
                if block.mixed:
                    raise LayerError("mixed geometry types")
                words = np.frombuffer(block.words, "<i4").astype(np.int64)
                places = np.concatenate([[0], np.cumsum(words + 4)])
                if at + places[-1] >= 1 << 31:
                    raise LayerError("a Shapefile holds 4 GB at most")
                body = np.frombuffer(bytearray(block.shapes), np.uint8)
                body[2 * places[:-1, None] + np.arange(4)] = np.arange(n + 1, n + 1 + len(words)).astype(">i4").view(np.uint8).reshape(-1, 4)
                shapes.write(body)
                index.write(np.stack([at + places[:-1], words], 1).astype(">i4").tobytes())
                table.write(block.cells)
                box = np.frombuffer(block.box, "<f8").reshape(2, 2)
                low, high = np.minimum(low, box[0]), np.maximum(high, box[1])
                at, n = at + int(places[-1]), n + len(words)
            table.write(b"\x1a")
            for out, head in ((shapes, header(at)), (index, header(50 + 4 * n)), (table, table_header())):
                out.seek(0)
                out.write(head)
            code_page.write(encoding.upper().encode())
    finally:
        blocks.unpersist()


_BLOCK = "words binary, shapes binary, cells binary, box binary, mixed boolean"


def _blocks(batches: Iterator[pa.RecordBatch], kind: str, types: list[str], sizes: list[int], encoding: str) -> Iterator[pa.RecordBatch]:
    """Records of ``.shp``, still without numbers, and of ``.dbf``, a thousand a row."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            geoms, *columns = (c.to_pylist() for c in batch.slice(start, 1000).columns)
            bodies, low, high = _bodies(kind, geoms)
            mixed = None in bodies
            words = np.array([0 if b is None else len(b) // 2 for b in bodies], "<i4")
            heads = np.stack([np.zeros_like(words), words], 1).astype(">i4").tobytes()
            shapes = b"" if mixed else b"".join(x for i, b in enumerate(bodies) for x in (heads[8 * i : 8 * i + 8], b))
            cells = zip([b" "] * len(geoms), *([_cell(v, *how, encoding) for v in c] for c, *how in zip(columns, types, sizes, strict=True)), strict=True)
            row = [words.tobytes(), shapes, b"".join(x for row in cells for x in row), np.stack([low, high]).tobytes(), mixed]
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in row[:4]), pa.array(row[4:])], names=["words", "shapes", "cells", "box", "mixed"])


def _cell(value, kind: str, size: int, encoding: str) -> bytes:
    if kind == "bool":
        return b" " if value is None else b"T" if value else b"F"
    text = "" if value is None else repr(float(value)) if kind == "number" else value
    raw = text.encode(encoding)[:size]
    return raw.rjust(size) if kind == "number" else raw.ljust(size)


def _bodies(kind: str, geoms: list[bytes | None]) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """What ``.shp`` holds of each geometry, None where it is of another type, and the bounds of all."""
    bodies, alike = [None] * len(geoms), {}
    low, high = np.full(2, np.inf), np.full(2, -np.inf)
    for i, data in enumerate(geoms):
        alike.setdefault(len(data or b""), []).append(i)
    for size, places in alike.items():
        # Of one part, in this byte order and without Z, those of one size differ in their coordinates alone.
        n = 1 if kind == "POINT" else max(0, size - 9) // 16
        head, rest = _wkb_head(kind, n), places
        if 0 < n <= codec.MAX_ELEMENTS and size == len(head) + 16 * n:
            data = np.frombuffer(b"".join(geoms[i] for i in places), np.uint8).reshape(-1, size)
            xy = data[:, len(head) :].copy().view("<f8").reshape(-1, n, 2)
            plain = (data[:, : len(head)] == np.frombuffer(head, np.uint8)).all(1) & ~np.isnan(xy).any((1, 2))
            xy, rest = xy[plain], [i for i, p in zip(places, plain, strict=True) if not p]
            if len(xy):
                least, most = xy.min(1), xy.max(1)
                low, high = np.minimum(low, least.min(0)), np.maximum(high, most.max(0))
                of = lambda *numbers: np.broadcast_to(np.array(numbers, "<i4").view(np.uint8), (len(xy), 4 * len(numbers)))
                flat = [np.ascontiguousarray(v.reshape(len(xy), -1)).view(np.uint8) for v in (least, most, xy)]
                made = [of(1), flat[2]] if kind == "POINT" else [of(_SHAPES[kind]), *flat[:2], of(1, n, 0), flat[2]]
                made = np.concatenate(made, axis=1)
                whole, step = made.tobytes(), made.shape[1]
                for k, i in enumerate(np.array(places)[plain].tolist()):
                    bodies[i] = whole[k * step : (k + 1) * step]
        for i in rest:
            geometry = (kind, []) if geoms[i] is None else codec.decode(geoms[i])
            parts = codec.lines(geometry)
            if geometry[0] != kind:
                continue
            bodies[i] = struct.pack("<i", 0)
            if parts:
                xy = np.concatenate(parts)
                low, high = np.minimum(low, xy.min(0)), np.maximum(high, xy.max(0))
                if kind == "POINT":
                    bodies[i] = struct.pack("<i2d", 1, *xy[0])
                else:
                    starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
                    bodies[i] = struct.pack("<i4d2i", _SHAPES[kind], *xy.min(0), *xy.max(0), len(parts), len(xy)) + starts.astype("<i4").tobytes() + xy.astype("<f8").tobytes()
    return bodies, low, high


def parse_shapes(data: bytes) -> Iterator[bytes | None]:
    """WKB of each record: rings that turn with the clock begin polygons, the others are holes."""
    at, starts, sizes = 100, [], []
    while at + 8 <= len(data):
        starts.append(at + 8)
        sizes.append(struct.unpack_from(">i", data, at + 4)[0] * 2)
        at += 8 + sizes[-1]
    made = _plain_shapes(np.frombuffer(data, np.uint8), np.array(starts, np.int64), np.array(sizes, np.int64))
    for i, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        yield made[i] if i in made else _parse_shape(data[start : start + size])


def _plain_shapes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[int, bytes]:
    """WKB of points and of lines and polygons of one part, by record; those of one size are taken at once, where there are some."""
    made = {}
    for size in np.unique(sizes).tolist():
        places = np.flatnonzero((sizes == size) & (starts + size <= len(data)))
        skip = 4 if size == 20 else 48
        n = (size - skip) // 16
        if n < 1 or size != skip + 16 * n or len(places) < 8:
            continue
        numbers = lambda at: data[starts[places, None] + at + np.arange(4)].view("<i4")[:, 0]
        # Beside the type: parts, points and where the part begins.
        single = True if skip == 4 else (numbers(36) == 1) & (numbers(40) == n) & (numbers(44) == 0)
        for kind in ("POINT",) if skip == 4 else ("LINESTRING", "POLYGON"):
            own = places[(numbers(0) == _SHAPES[kind]) & single]
            xy = data[starts[own, None] + np.arange(skip, size)]
            head = _wkb_head(kind, n)
            whole = np.concatenate([np.broadcast_to(np.frombuffer(head, np.uint8), (len(own), len(head))), xy], axis=1)
            raw, step = whole.tobytes(), whole.shape[1]
            made.update((i, raw[k * step : (k + 1) * step]) for k, i in enumerate(own.tolist()))
    return made


def _wkb_head(kind: str, n: int) -> bytes:
    """What WKB has before the ``n`` vertices of a geometry of one part."""
    return b"\x01" + struct.pack("<I", codec.CODES[kind]) + {"POINT": b"", "LINESTRING": struct.pack("<I", n), "POLYGON": struct.pack("<2I", 1, n)}[kind]


def _parse_shape(body: bytes) -> bytes | None:
    kind = struct.unpack_from("<i", body)[0] % 10
    if kind == 1:
        return codec.encode(("POINT", [struct.unpack_from("<2d", body, 4)]))
    if kind in (3, 5):
        n_parts, n = struct.unpack_from("<2i", body, 36)
        starts = [*struct.unpack_from(f"<{n_parts}i", body, 44), n]
        xy = np.frombuffer(body, "<f8", 2 * n, 44 + 4 * n_parts).reshape(-1, 2)
        parts = [xy[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        if kind == 3:
            return codec.encode(("LINESTRING", parts[0]) if len(parts) == 1 else ("MULTILINESTRING", [("LINESTRING", p) for p in parts]))
        return codec.encode(_assembled(parts))
    if kind == 8:
        n = struct.unpack_from("<i", body, 36)[0]
        xy = np.frombuffer(body, "<f8", 2 * n, 40).reshape(-1, 2)
        return codec.encode(("MULTIPOINT", [("POINT", p.reshape(1, 2)) for p in xy]))
    return None


def _assembled(rings: list[np.ndarray]):
    from ..functions.planar import signed_area

    if len(rings) == 1:
        return "POLYGON", rings
    polygons = [[r] for r in rings if signed_area(r) <= 0] or [[rings[0]]]
    for hole in (r for r in rings if signed_area(r) > 0 and r is not polygons[0][0]):
        inside = [p for p in polygons if (hole[0] >= p[0].min(0)).all() and (hole[0] <= p[0].max(0)).all()]
        (inside or polygons)[0].append(hole)
    return ("POLYGON", polygons[0]) if len(polygons) == 1 else ("MULTIPOLYGON", [("POLYGON", p) for p in polygons])


def parse_dbf(data: bytes, encoding: str) -> tuple[list[Field], Iterator[tuple]]:
    n, start, width = struct.unpack_from("<IHH", data, 4)
    fields, sizes, at = [], [], 32
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode(encoding)
        fields.append(Field(name, {"N": "number", "F": "number", "L": "bool"}.get(chr(data[at + 11]), "text")))
        sizes.append(data[at + 16])
        at += 32

    def rows():
        for i in range(n):
            place, out = start + i * width + 1, []
            for f, size in zip(fields, sizes, strict=True):
                raw = data[place : place + size]
                place += size
                text = raw.decode(encoding, "replace").strip(" \0")
                out.append((None if not text else float(text)) if f.type == "number" else text.upper() in ("T", "Y") if f.type == "bool" and text else None if f.type == "bool" else text)
            yield tuple(out)

    return fields, rows()


#: Bytes and records of a Shapefile that a task takes at once.
PIECE_BYTES, PIECE_ROWS = 8 << 20, 50_000


def _pieces(shapes: BinaryIO, rows: int, width: int) -> Iterator[tuple[int, int, int, int]]:
    """(records before, records, start, end) of pieces that hold whole records; only their lengths are looked at."""
    end = shapes.seek(0, os.SEEK_END)
    at = start = base = 100
    before, n, data = 0, 0, b""
    while n < rows and at + 8 <= end:
        if at + 8 > base + len(data):
            shapes.seek(at)
            data, base = shapes.read(PIECE_BYTES), at
        size = struct.unpack_from(">i", data, at + 4 - base)[0] * 2
        if size < 0:
            raise LayerError(f"record {n + 1} is damaged")
        at, n = at + 8 + size, n + 1
        if at - start >= PIECE_BYTES or (n - before) * width >= PIECE_BYTES or n - before == PIECE_ROWS:
            yield before, n - before, start, at
            before, start = n, at
    if n > before:
        yield before, n - before, start, at


def read_shapefile(spark: SparkSession, path: str, crs: str = "", encoding: str | None = None) -> Layer:
    """``.shp`` and ``.dbf`` of one stem; ids are places in the file.

    The driver looks at the lengths of the records and the executors read them
    in pieces, so no machine holds a whole file.
    """
    stem = path.removesuffix(".shp")
    if encoding is None:
        encoding = "utf-8"
        if exists(spark, stem + ".cpg"):
            with on_driver(spark, stem + ".cpg") as (name,), open(name, "rb") as code_page:
                encoding = code_page.read(64).decode("ascii").strip().lower()
    with on_driver(spark, stem + ".shp", stem + ".dbf") as found, ExitStack() as stack:
        shapes, table = (stack.enter_context(open(name, "rb")) for name in found)
        code = struct.unpack_from("<i", shapes.read(36), 32)[0] % 10
        n, first, width = struct.unpack_from("<IHH", table.read(12), 4)
        table.seek(0)
        head = table.read(first)
        fields = tuple(parse_dbf(head, encoding)[0])
        pieces = list(_pieces(shapes, n, width))
        stamps = [_stamp(f) for f in (shapes, table)]
        names = [machine_path(spark, stem + end) for end in (".shp", ".dbf")]
        folder = None if all(names) else _stage(spark, shapes, table, first, width, pieces)

    def frames(before: int, n: int, shp: bytes, cells: bytes) -> Iterator[pd.DataFrame]:
        rows = parse_dbf(head[:4] + struct.pack("<I", n) + head[8:] + cells, encoding)[1]
        records = zip(count(before + 1), rows, parse_shapes(bytes(100) + shp))
        while got := [(i, *r, g) for i, r, g in islice(records, 10_000)]:
            yield pd.DataFrame(got, columns=[FID, *[f.name for f in fields], GEOM])

    def from_files(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for before, n, start, end in part.to_numpy().tolist():
                with open(names[0], "rb") as shapes, open(names[1], "rb") as table:
                    if [_stamp(f) for f in (shapes, table)] != stamps:
                        raise LayerError(f"source has changed: {path}")
                    shapes.seek(start)
                    table.seek(first + before * width)
                    yield from frames(before, n, shapes.read(end - start), table.read(n * width))

    def from_staged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                before, n, size = struct.unpack_from("<3q", content)
                yield from frames(before, n, content[24 : 24 + size], content[24 + size :])

    shape = ", ".join([f"{FID} long", *(f"`{f.name}` {TYPES[f.type]}" for f in fields), f"{GEOM} binary"])
    if folder:
        df = spark.read.format("binaryFile").load(folder).select("content").mapInPandas(from_staged, shape)
    else:
        # Of an RDD Spark does not know the size, so it won't take the few rows of places for a table to broadcast.
        places = spark.sparkContext.parallelize(pieces, max(1, len(pieces)))
        df = spark.createDataFrame(places, "before long, n long, start long, end long").mapInPandas(from_files, shape)
    kind = {1: "POINT", 3: "LINESTRING", 5: "POLYGON", 8: "MULTIPOINT"}.get(code, "")
    return Layer(df, LayerMeta(os.path.basename(stem), crs, kind, fields, source=path))


def _stamp(file: BinaryIO) -> tuple[int, int]:
    found = os.fstat(file.fileno())
    return found.st_size, found.st_mtime_ns


def _stage(spark: SparkSession, shapes: BinaryIO, table: BinaryIO, first: int, width: int, pieces: list) -> str:
    """A folder with a file of each piece, which Spark's readers open from any store; it goes when the session ends."""

    def contents() -> Iterator[bytes]:
        for before, n, start, end in pieces or [(0, 0, 100, 100)]:
            shapes.seek(start)
            table.seek(first + before * width)
            shp = shapes.read(end - start)
            yield struct.pack("<3q", before, n, len(shp)) + shp + table.read(n * width)

    return staged(spark, contents())


def overview(lay: Layer) -> DataFrame:
    """One row: name, geometry type, CRS, bounds and count."""
    from ..operators.summarise import extent

    return extent(lay, pad=False).select(F.lit(lay.meta.name).alias("name"), F.lit(lay.meta.geometry_type).alias("geometry_type"), F.lit(lay.meta.crs).alias("crs"), "*")

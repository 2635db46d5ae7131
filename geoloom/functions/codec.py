"""WKB and WKT: one decoder to nested coordinates, one encoder.

Both byte orders, nested collections, Z and M ordinates (dropped) and EWKB
SRIDs (skipped) are read; trailing bytes and nesting beyond 64 levels are
errors.  A geometry is ``(type, parts)``: parts is an (n, 2) array for points
and lines, a list of rings for polygons, a list of geometries for the rest.
"""

from __future__ import annotations

import re
import struct

import numpy as np

NAMES = ("", "POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION")
CODES = {name: i for i, name in enumerate(NAMES) if name}
MAX_ELEMENTS, MAX_DEPTH = 1_000_000, 64
_SINGLE = {"MULTIPOINT": "POINT", "MULTILINESTRING": "LINESTRING", "MULTIPOLYGON": "POLYGON"}


class GeometryError(ValueError):
    pass


def decode(data: bytes):
    geometry, end = _read(memoryview(data), 0, 0)
    if end != len(data):
        raise GeometryError("trailing bytes")
    return geometry


def _count(data, at: int, order: str) -> int:
    if at + 4 > len(data):
        raise GeometryError("truncated")
    n = struct.unpack_from(order + "I", data, at)[0]
    if n > MAX_ELEMENTS:
        raise GeometryError("too many elements")
    return n


def _coordinates(data, at: int, n: int, size: int, order: str):
    end = at + 8 * n * size
    if end > len(data):
        raise GeometryError("truncated")
    return np.frombuffer(data, order + "f8", n * size, at).reshape(n, size)[:, :2].astype(float), end


def _read(data, at: int, depth: int):
    if depth > MAX_DEPTH or at + 5 > len(data):
        raise GeometryError("too deep or truncated")
    order = "<" if data[at] == 1 else ">"
    if data[at] > 1:
        raise GeometryError("unknown byte order")
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5
    size = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    if code & 0x20000000:
        at += 4
    code &= 0x0FFFFFFF
    size += {0: 0, 1: 1, 2: 1, 3: 2}.get(code // 1000, 0)
    kind = code % 1000
    if not 1 <= kind <= 7 or code // 1000 > 3:
        raise GeometryError(f"unknown type {code}")
    name = NAMES[kind]
    if name == "POINT":
        xy, at = _coordinates(data, at, 1, size, order)
        return (name, xy[~np.isnan(xy).any(1)]), at
    n = _count(data, at, order)
    at += 4
    if name == "LINESTRING":
        xy, at = _coordinates(data, at, n, size, order)
        return (name, xy), at
    parts = []
    for _ in range(n):
        if name == "POLYGON":
            m = _count(data, at, order)
            part, at = _coordinates(data, at + 4, m, size, order)
        else:
            part, at = _read(data, at, depth + 1)
        parts.append(part)
    return (name, parts), at


def encode(geometry) -> bytes:
    name, parts = geometry
    head = b"\x01" + struct.pack("<I", CODES[name])
    if name == "POINT":
        xy = np.asarray(parts, "<f8").reshape(-1, 2)
        return head + (xy[0].tobytes() if len(xy) else struct.pack("<2d", np.nan, np.nan))
    if name == "LINESTRING":
        xy = np.asarray(parts, "<f8").reshape(-1, 2)
        return head + struct.pack("<I", len(xy)) + xy.tobytes()
    if name == "POLYGON":
        rings = [np.asarray(r, "<f8").reshape(-1, 2) for r in parts]
        return head + struct.pack("<I", len(rings)) + b"".join(struct.pack("<I", len(r)) + r.tobytes() for r in rings)
    return head + struct.pack("<I", len(parts)) + b"".join(encode(p) for p in parts)


def lines(geometry) -> list[np.ndarray]:
    """All coordinate sequences, in order."""
    name, parts = geometry
    if name in ("POINT", "LINESTRING"):
        return [parts] if len(parts) else []
    if name == "POLYGON":
        return list(parts)
    return [x for part in parts for x in lines(part)]


def polygons(geometry) -> list[list[np.ndarray]]:
    name, parts = geometry
    if name == "POLYGON":
        return [parts] if parts else []
    return [] if name in ("POINT", "LINESTRING") else [x for part in parts for x in polygons(part)]


def map_xy(geometry, change):
    """The geometry with ``change`` applied to each (n, 2) array."""
    name, parts = geometry
    if name in ("POINT", "LINESTRING"):
        return name, change(np.asarray(parts, float).reshape(-1, 2)) if len(parts) else parts
    if name == "POLYGON":
        return name, [change(np.asarray(r, float)) for r in parts]
    return name, [map_xy(p, change) for p in parts]


def number_text(value: float) -> str:
    """Shortest digits without an exponent."""
    text = np.format_float_positional(value, trim="-")
    return "0" if text == "-0" else text


def _xy_text(xy) -> str:
    return ", ".join(f"{number_text(x)} {number_text(y)}" for x, y in np.asarray(xy, float).reshape(-1, 2).tolist())


def _body(geometry) -> str:
    name, parts = geometry
    if not len(parts):
        return "EMPTY"
    if name in ("POINT", "LINESTRING"):
        return f"({_xy_text(parts)})"
    if name == "POLYGON":
        return "(" + ", ".join(f"({_xy_text(r)})" for r in parts) + ")"
    if name == "GEOMETRYCOLLECTION":
        return "(" + ", ".join(to_wkt(p) for p in parts) + ")"
    return "(" + ", ".join(_body(p) for p in parts) + ")"


def to_wkt(geometry) -> str:
    return f"{geometry[0]} {_body(geometry)}"


_TOKEN = re.compile(r"\s*([A-Za-z]+|[(),]|[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)")


def parse_wkt(text: str):
    tokens, at = [], 0
    text = re.sub(r"^\s*SRID=[0-9]+;", "", text)
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise GeometryError(f"unexpected text at {at}")
        tokens.append(m[1])
        at = m.end()
    geometry, end = _parse(tokens, 0)
    if end != len(tokens):
        raise GeometryError("trailing text")
    return geometry


def _want(tokens, at: int, sign: str) -> int:
    if at >= len(tokens) or tokens[at] != sign:
        raise GeometryError(f"expected {sign}")
    return at + 1


def _sequence(tokens, at: int):
    at, rows = _want(tokens, at, "("), []
    while True:
        row = []
        nested = at < len(tokens) and tokens[at] == "("
        at += nested
        while at < len(tokens) and tokens[at] not in ("(", ")", ","):
            row.append(float(tokens[at]))
            at += 1
        if nested:
            at = _want(tokens, at, ")")
        if len(row) < 2:
            raise GeometryError("a position needs two numbers")
        rows.append(row[:2])
        if at < len(tokens) and tokens[at] == ",":
            at += 1
            continue
        return np.array(rows, float), _want(tokens, at, ")")


def _parse(tokens, at: int, name: str | None = None):
    if name is None:
        name = tokens[at].upper() if at < len(tokens) else ""
        if name not in CODES:
            raise GeometryError(f"unknown type {name}")
        at += 1
        while at < len(tokens) and tokens[at].upper() in ("Z", "M", "ZM"):
            at += 1
    if at < len(tokens) and tokens[at].upper() == "EMPTY":
        return (name, np.zeros((0, 2)) if name in ("POINT", "LINESTRING") else []), at + 1
    if name in ("POINT", "LINESTRING"):
        xy, at = _sequence(tokens, at)
        if name == "POINT" and len(xy) != 1:
            raise GeometryError("a point has one position")
        return (name, xy), at
    if name == "MULTIPOINT":
        xy, at = _sequence(tokens, at)
        return (name, [("POINT", row.reshape(1, 2)) for row in xy]), at
    at, parts = _want(tokens, at, "("), []
    while True:
        if name == "POLYGON":
            part, at = _sequence(tokens, at)
        else:
            part, at = _parse(tokens, at, _SINGLE.get(name))
        parts.append(part)
        if at < len(tokens) and tokens[at] == ",":
            at += 1
            continue
        return (name, parts), _want(tokens, at, ")")


def from_geojson(value: dict):
    """A GeoJSON geometry object."""
    if value["type"] == "GeometryCollection":
        return "GEOMETRYCOLLECTION", [from_geojson(g) for g in value["geometries"]]
    name, xy = value["type"].upper(), value["coordinates"]
    if name == "POINT":
        return name, np.array([xy[:2]], float) if xy else np.zeros((0, 2))
    if name == "LINESTRING":
        return name, np.array([p[:2] for p in xy], float).reshape(-1, 2)
    if name == "POLYGON":
        return name, [np.array([p[:2] for p in ring], float).reshape(-1, 2) for ring in xy]
    if name not in _SINGLE:
        raise GeometryError(f"unknown type {name}")
    single = {"MULTIPOINT": "Point", "MULTILINESTRING": "LineString", "MULTIPOLYGON": "Polygon"}[name]
    return name, [from_geojson({"type": single, "coordinates": c}) for c in xy]

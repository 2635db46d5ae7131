"""Coordinate systems: geographic, web Mercator and transverse Mercator on GRS80 or WGS84.

Positions are always x (lon, easting) first.  Point transforms exist twice:
as plain Column arithmetic for point tables, and as an Arrow kernel over all
positions of any geometry.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from . import codec


class CRSError(ValueError):
    pass


@dataclass(frozen=True)
class System:
    """``kind``: geographic, mercator or tm; angles in degrees, lengths in metres; area as lon/lat bounds."""

    kind: str
    name: str
    lon0: float = 0.0
    lat0: float = 0.0
    scale: float = 1.0
    east: float = 0.0
    north: float = 0.0
    flattening: float = 1 / 298.257222101
    area: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0)


AXIS = 6378137.0
_WGS84 = 1 / 298.257223563
#: Published definitions.
SYSTEMS = {
    "EPSG:4326": System("geographic", "WGS 84", flattening=_WGS84),
    "EPSG:4737": System("geographic", "Korea 2000", area=(122.71, 28.6, 134.28, 40.27)),
    "EPSG:3857": System("mercator", "Web Mercator", flattening=_WGS84, area=(-180.0, -85.06, 180.0, 85.06)),
    "EPSG:5179": System("tm", "Unified coordinate system", 127.5, 38, 0.9996, 1_000_000, 2_000_000, area=(122.71, 28.6, 134.28, 40.27)),
    "EPSG:5185": System("tm", "West belt 2010", 125, 38, 1, 200_000, 600_000, area=(124.53, 33.99, 126.0, 38.04)),
    "EPSG:5186": System("tm", "Central belt 2010", 127, 38, 1, 200_000, 600_000, area=(126.0, 33.14, 128.0, 38.33)),
    "EPSG:5187": System("tm", "East belt 2010", 129, 38, 1, 200_000, 600_000, area=(128.0, 34.49, 129.65, 38.64)),
    "EPSG:5188": System("tm", "East sea belt 2010", 131, 38, 1, 200_000, 600_000, area=(130.71, 37.39, 131.99, 37.62)),
}
for zone in range(1, 61):
    SYSTEMS[f"EPSG:{32600 + zone}"] = System("tm", f"UTM zone {zone}N", zone * 6 - 183, 0, 0.9996, 500_000, 0, _WGS84, (zone * 6 - 186, 0, zone * 6 - 180, 84))
    SYSTEMS[f"EPSG:{32700 + zone}"] = System("tm", f"UTM zone {zone}S", zone * 6 - 183, 0, 0.9996, 500_000, 10_000_000, _WGS84, (zone * 6 - 186, -80, zone * 6 - 180, 0))


def system(code: str) -> System:
    found = SYSTEMS.get(code.strip().upper())
    if found is None:
        raise CRSError(f"unknown CRS: {code}")
    return found


def catalog(spark):
    """The known systems, by code."""
    rows = [(code, s.name, *map(float, s.area)) for code, s in sorted(SYSTEMS.items())]
    return spark.createDataFrame(rows, "code string, name string, west double, south double, east double, north double")


def _series(f: float):
    """Krueger's series to the fourth order: rectifying radius, forward, inverse and latitude coefficients, eccentricity."""
    n = f / (2 - f)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    inverse = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    latitude = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    )
    return radius, forward, inverse, latitude, math.sqrt(f * (2 - f))


def _meridian(s: System) -> float:
    """Northing of the origin latitude."""
    radius, forward, _, _, e = _series(s.flattening)
    lat = math.radians(s.lat0)
    t = math.sinh(math.atanh(math.sin(lat)) - e * math.atanh(e * math.sin(lat)))
    xi = math.atan(t)
    return radius * (xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(forward)))


def _to_lonlat(s: System, x, y, m):
    """``m`` is numpy or Spark's functions: the formulas are the same."""
    if s.kind == "geographic":
        return x, y
    if s.kind == "mercator":
        return x * (180 / math.pi / AXIS), _deg(m, m.atan(m.sinh(y * (1 / AXIS))))
    radius, _, inverse, latitude, _ = _series(s.flattening)
    k = s.scale * radius
    xi, eta = (y - s.north + s.scale * _meridian(s)) * (1 / k), (x - s.east) * (1 / k)
    xi1, eta1 = xi, eta
    for j, b in enumerate(inverse):
        w = 2.0 * (j + 1)
        xi1 = xi1 - b * m.sin(w * xi) * m.cosh(w * eta)
        eta1 = eta1 - b * m.cos(w * xi) * m.sinh(w * eta)
    lon = s.lon0 + _deg(m, m.atan2(m.sinh(eta1), m.cos(xi1)))
    # From the conformal latitude, which is a position on the sphere, to the geographic one.
    chi = m.asin(m.sin(xi1) / m.cosh(eta1))
    phi = chi
    for j, d in enumerate(latitude):
        phi = phi + d * m.sin(2.0 * (j + 1) * chi)
    return lon, _deg(m, phi)


def _from_lonlat(s: System, lon, lat, m):
    if s.kind == "geographic":
        return lon, lat
    phi = lat * (math.pi / 180)
    if s.kind == "mercator":
        return lon * (math.pi / 180 * AXIS), m.asinh(m.tan(phi)) * AXIS
    radius, forward, _, _, e = _series(s.flattening)
    d = (lon - s.lon0) * (math.pi / 180)
    t = m.sinh(m.atanh(m.sin(phi)) - e * m.atanh(e * m.sin(phi)))
    xi1, eta1 = m.atan2(t, m.cos(d)), m.asinh(m.sin(d) / m.sqrt(t * t + m.cos(d) * m.cos(d)))
    xi, eta = xi1, eta1
    for j, a in enumerate(forward):
        w = 2.0 * (j + 1)
        xi = xi + a * m.sin(w * xi1) * m.cosh(w * eta1)
        eta = eta + a * m.cos(w * xi1) * m.sinh(w * eta1)
    k = s.scale * radius
    return s.east + k * eta, s.north + k * xi - s.scale * _meridian(s)


def _deg(m, value):
    return value * (180 / math.pi)


class _Numpy:
    sin, cos, tan, sinh, cosh, sqrt = np.sin, np.cos, np.tan, np.sinh, np.cosh, np.sqrt
    asin, atan, atan2, asinh, atanh = np.arcsin, np.arctan, np.arctan2, np.arcsinh, np.arctanh


def transform_columns(x, y, source: str, target: str):
    """(x, y) Columns of points in another system, without leaving the JVM."""
    a, b = system(source), system(target)
    if source.strip().upper() == target.strip().upper():
        return x, y
    return _from_lonlat(b, *_to_lonlat(a, x, y, F), F)


def transform_array(xy: np.ndarray, source: str, target: str) -> np.ndarray:
    a, b = system(source), system(target)
    if source.strip().upper() == target.strip().upper():
        return xy
    return np.stack(_from_lonlat(b, *_to_lonlat(a, xy[:, 0], xy[:, 1], _Numpy), _Numpy), 1)


def transform_geometry(source: str, target: str):
    """Arrow kernel: all positions of a batch in one array."""
    system(source), system(target)

    @F.pandas_udf("binary")
    def change(geom: pd.Series) -> pd.Series:
        decoded = [None if g is None else codec.decode(g) for g in geom]
        flat = [xy for g in decoded if g is not None for xy in codec.lines(g)]
        if not flat:
            return geom
        moved = iter(np.split(transform_array(np.concatenate(flat), source, target), np.cumsum([len(x) for x in flat])[:-1]))
        return pd.Series([None if g is None else codec.encode(codec.map_xy(g, lambda _: next(moved))) for g in decoded], dtype=object)

    return change


def transform_bounds(bounds: tuple[float, float, float, float], source: str, target: str, steps: int = 21):
    """Bounds of the edges with ``steps`` positions on each."""
    x0, y0, x1, y1 = bounds
    xs, ys = np.linspace(x0, x1, steps), np.linspace(y0, y1, steps)
    edge = np.concatenate([np.stack([xs, np.full(steps, y)], 1) for y in (y0, y1)] + [np.stack([np.full(steps, x), ys], 1) for x in (x0, x1)])
    got = transform_array(edge, source, target)
    return (*got.min(0).tolist(), *got.max(0).tolist())

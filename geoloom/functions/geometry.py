"""Geometry functions as Columns: Arrow kernels around the codec, plain expressions on coordinates.

A decoded geometry is ``parts``: an array of coordinate sequences, each an
array of (x, y) structs.  What can be said on those is said with Spark's own
array functions; the kernels only translate, clip, build hulls and the like.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batch, codec, overlay, planar

def numbers(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


# Type objects, as a type's text could only be read with a session at hand.
POINT = numbers("x", "y")
PARTS = T.ArrayType(T.ArrayType(POINT))
BBOX = numbers("minx", "miny", "maxx", "maxy")
BINARY = T.BinaryType()


def geometry_type(geom: Column) -> Column:
    """From the header bytes alone, in either byte order; null where it is none."""
    code = F.when(F.substring(geom, 1, 1) == F.unhex(F.lit("01")), F.conv(F.hex(F.concat(F.substring(geom, 3, 1), F.substring(geom, 2, 1))), 16, 10)).otherwise(
        F.conv(F.hex(F.substring(geom, 4, 2)), 16, 10)
    )
    names = F.array(*[F.lit(n) for n in codec.NAMES[1:]])
    return F.when(geom.isNotNull(), F.get(names, (code.cast("int") % 1000) - 1))


@F.arrow_udf(PARTS)
def parts_of(geom: pa.Array) -> pa.Array:
    """All coordinate sequences; null for null and for what is no geometry."""
    return batch.nested(batch.decode_all(geom))


@F.arrow_udf(BBOX)
def bbox_of(geom: pa.Array) -> pa.Array:
    return batch.bounds(batch.decode_all(geom))


METRICS = T.StructType([T.StructField("sequences", T.LongType()), *numbers("length", "area").fields])


@F.arrow_udf(METRICS)
def metrics_of(geom: pa.Array) -> pa.Array:
    """The number of sequences (null for what is no geometry), and the first one's length and enclosed area."""
    return batch.metrics(batch.decode_all(geom))


@F.pandas_udf(T.StringType())
def to_wkt(geom: pd.Series) -> pd.Series:
    def one(data):
        try:
            return None if data is None else codec.to_wkt(codec.decode(data))
        except codec.GeometryError:
            return None

    return geom.map(one)


@F.pandas_udf(BINARY)
def from_wkt(text: pd.Series) -> pd.Series:
    def one(value):
        try:
            return None if value is None else codec.encode(codec.parse_wkt(value))
        except (codec.GeometryError, ValueError):
            return None

    return text.map(one)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


@F.arrow_udf(BINARY)
def point(x: pa.Array, y: pa.Array) -> pa.Array:
    """POINT of two numbers; null where one is missing."""
    x, y = _numbers(x), _numbers(y)
    return batch.points(x, y, np.isnan(x) | np.isnan(y))


@F.arrow_udf(BINARY)
def line(points: pa.Array) -> pa.Array:
    """LINESTRING of an array of (x, y)."""
    return batch.lines(points)


@F.arrow_udf(BINARY)
def box(minx: pa.Array, miny: pa.Array, maxx: pa.Array, maxy: pa.Array) -> pa.Array:
    return batch.boxes(np.stack([_numbers(c) for c in (minx, miny, maxx, maxy)], 1))


def overlaps(bbox: Column, minx: float, miny: float, maxx: float, maxy: float) -> Column:
    """Inclusive overlap of bounds; plain comparisons, so they reach a Parquet scan of the bbox columns."""
    return (bbox["minx"] <= maxx) & (bbox["maxx"] >= minx) & (bbox["miny"] <= maxy) & (bbox["maxy"] >= miny)


def _pairs(seq: Column) -> Column:
    """(a, b) of neighbouring positions of a sequence."""
    n = F.size(seq) - 1
    return F.when(n > 0, F.zip_with(F.slice(seq, 1, F.greatest(n, F.lit(0))), F.slice(seq, 2, F.greatest(n, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def length_of(seq: Column) -> Column:
    """Length along one sequence."""
    step = lambda p: F.sqrt(
        (p["b"]["x"] - p["a"]["x"]) * (p["b"]["x"] - p["a"]["x"]) + (p["b"]["y"] - p["a"]["y"]) * (p["b"]["y"] - p["a"]["y"])
    )
    return F.aggregate(F.coalesce(_pairs(seq), F.array()), F.lit(0.0), lambda acc, p: acc + step(p))


def area_of(ring: Column) -> Column:
    """Area of one closed ring."""
    cross = lambda p: p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]
    return F.abs(F.aggregate(F.coalesce(_pairs(ring), F.array()), F.lit(0.0), lambda acc, p: acc + cross(p))) / 2


@F.arrow_udf(POINT)
def representative_point(geom: pa.Array) -> pa.Array:
    """A point's own position, a line's half-length point, a polygon's centroid; null for other types."""
    d = batch.decode_all(geom)
    xy, ok = batch.centers(d)
    for i in np.flatnonzero(d.kind == 2).tolist():
        found = planar.half_length_point(d.xy[d.seqs[d.rows[i]] : d.seqs[d.rows[i + 1]]])
        if found is not None:
            xy[i], ok[i] = found, True
    return pa.StructArray.from_arrays([pa.array(xy[:, k], mask=~ok) for k in (0, 1)], ["x", "y"])


@F.pandas_udf(POINT)
def point_on_surface(geom: pd.Series) -> pd.DataFrame:
    """A position inside a polygon: the middle of the widest inner stretch at half height."""
    rows = [planar.inner_point(codec.decode(g)) if g is not None else None for g in geom]
    return pd.DataFrame([(None, None) if r is None else r for r in rows], columns=["x", "y"])


@F.pandas_udf(numbers("x", "y", "angle"))
def longest_segment(geom: pd.Series) -> pd.DataFrame:
    """Middle of the longest segment and its readable angle in degrees, above -90 and up to 90."""
    rows = [planar.longest_segment(codec.decode(g)) if g is not None else None for g in geom]
    return pd.DataFrame([(None,) * 3 if r is None else r for r in rows], columns=["x", "y", "angle"])


def _encoded(polygons: list) -> bytes | None:
    """POLYGON or MULTIPOLYGON; None without an area."""
    if not polygons:
        return None
    return codec.encode(("POLYGON", polygons[0]) if len(polygons) == 1 else ("MULTIPOLYGON", [("POLYGON", p) for p in polygons]))


@F.arrow_udf(BINARY)
def clip_to(geom: pa.Array, window: pa.Array) -> pa.Array:
    """The polygonal part of a geometry inside a polygonal window; null where nothing with an area is left.

    Geometries whose bounds no edge of the window touches stay as they are or
    go, found for all rows at once; convex windows of one ring are clipped
    side by side, others by overlay.
    """
    if isinstance(window, pa.ChunkedArray):
        window = window.combine_chunks()
    names = window.dictionary_encode() if not isinstance(window, pa.DictionaryArray) else window
    which = np.asarray(names.indices.fill_null(-1))
    d = batch.decode_all(geom)
    edges = batch.bounds(d)
    edges = np.stack([edges.field(i).to_numpy(zero_copy_only=False) for i in range(4)], 1)
    whole = (d.kind == 3) & (batch.metrics(d).field(2).to_numpy(zero_copy_only=False) > 1e-12)
    raw, out = geom.to_pylist(), [None] * len(geom)
    for w, data in enumerate(names.dictionary.to_pylist()):
        found = codec.polygons(codec.decode(data))
        convex = len(found) == 1 and len(found[0]) == 1 and planar.is_convex(found[0][0])
        corners = found[0][0] if convex else None
        rows = np.flatnonzero((which == w) & (d.kind >= 3) & ~np.isnan(edges[:, 0]))
        boxes = edges[rows]
        if convex and len(corners) == 5 and ((np.diff(corners, axis=0) == 0).sum(1) == 1).all():
            low, high = corners.min(0), corners.max(0)
            kept = (boxes[:, :2] >= low).all(1) & (boxes[:, 2:] <= high).all(1)
            gone = np.zeros(len(rows), bool)
        else:
            touched, inside = overlay.place_boxes(found, boxes)
            kept, gone = ~touched & inside, ~touched & ~inside
        kept &= whole[rows]
        for i in rows[kept].tolist():
            out[i] = raw[i]
        for i in rows[~kept & ~gone].tolist():
            shapes = codec.polygons(codec.decode(raw[i]))
            out[i] = _encoded(planar.clip_polygons(shapes, corners) if corners is not None else overlay.intersection(shapes, found))
    return pa.array(out, pa.binary())


def overlay_of(operation: str):
    """``intersect``, ``union`` or ``difference`` of two polygonal geometries; an empty POLYGON where nothing is left."""
    combine = {"intersect": overlay.intersection, "union": overlay.union, "difference": overlay.difference}[operation]

    @F.pandas_udf(BINARY)
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(left, right, strict=True):
            sides = [codec.polygons(codec.decode(g)) if g is not None else [] for g in (a, b)]
            out.append(_encoded(combine(*sides)) or codec.encode(("POLYGON", [])))
        return pd.Series(out, dtype=object)

    return run


def buffer(distance: float, segments: int = 8):
    """All places within a distance; lines and points have round ends, and below 0 polygons shrink. Null where nothing is left."""

    @F.pandas_udf(BINARY)
    def grow(geom: pd.Series) -> pd.Series:
        def one(data):
            if data is None:
                return None
            geometry = codec.decode(data)
            if geometry[0] == "POINT":
                return _encoded([[overlay.disc(geometry[1][0], distance, segments)]] if distance > 0 and len(geometry[1]) else [])
            return _encoded(overlay.buffer(geometry[0], codec.lines(geometry), codec.polygons(geometry), distance, segments))

        return geom.map(one)

    return grow


@F.pandas_udf(BINARY)
def hull_of(points: pd.Series) -> pd.Series:
    """Convex hull polygon of an array of (x, y); null without three that are not in line."""

    def one(values):
        ring = planar.convex_hull([(v["x"], v["y"]) for v in values])
        return None if ring is None else codec.encode(("POLYGON", [ring]))

    return points.map(one)


@F.pandas_udf(BINARY)
def ordered_polygon(points: pd.Series) -> pd.Series:
    """Closed polygon of positions in their order; null if they make no simple ring."""

    def one(values):
        ring = planar.simple_ring([(v["x"], v["y"]) for v in values])
        return None if ring is None else codec.encode(("POLYGON", [ring]))

    return points.map(one)


def simplify(tolerance: float):
    """Douglas-Peucker on lines and rings of 32 positions or more; rings keep four positions."""

    @F.pandas_udf(BINARY)
    def reduce(geom: pd.Series) -> pd.Series:
        def one(data):
            if data is None:
                return None
            geometry = codec.decode(data)
            if sum(len(x) for x in codec.lines(geometry)) < 32:
                return data
            return codec.encode(codec.map_xy(geometry, lambda xy: planar.simplify(xy, tolerance)))

        return geom.map(one)

    return reduce


@F.pandas_udf(T.ArrayType(BINARY))
def triangles_of(geom: pd.Series) -> pd.Series:
    """Triangles that cover a polygon without its holes."""

    def one(data):
        if data is None:
            return None
        found = [t for p in codec.polygons(codec.decode(data)) for t in planar.triangulate(p)]
        return [codec.encode(("POLYGON", [[*t, t[0]]])) for t in found]

    return geom.map(one)


def move_vertex(index: int, x: float, y: float):
    """Position ``index`` over all sequences moved; a ring's first and last move together."""

    @F.pandas_udf(BINARY)
    def move(geom: pd.Series) -> pd.Series:
        def one(data):
            if data is None:
                return None
            seen = 0

            def change(xy):
                nonlocal seen
                at, seen = index - seen, seen + len(xy)
                if 0 <= at < len(xy):
                    closed = len(xy) > 3 and (xy[0] == xy[-1]).all() and at in (0, len(xy) - 1)
                    xy = xy.copy()
                    xy[[0, -1] if closed else [at]] = (x, y)
                return xy

            return codec.encode(codec.map_xy(codec.decode(data), change))

        return geom.map(one)

    if not (np.isfinite(x) and np.isfinite(y)):
        raise codec.GeometryError("positions must be finite")
    return move

"""Operators that make or change geometries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import batch, codec, geometry, overlay, planar
from ..model import FID, GEOM, Field, Layer, LayerError, fail_if
from ..scale import is_small
from .combine import zip_features
from .summarise import first_seen_groups


def points(df: DataFrame, x, y):
    return df.withColumn(GEOM, geometry.point(x, y))


def hull_by_group(lay: Layer, group: str) -> Layer:
    """Convex hull polygon of each group's points, named B000001 and on in order of first appearance.

    Each batch of rows gives the corners of its groups' hulls before anything
    is shuffled; those are merged in parts of a group and then as a whole, so
    a large group is never in one place.  A group without three points off one
    line is an error.
    """
    kind = lay.df.schema[group].dataType.simpleString()

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            d = batch.decode_all(rows.column(1))
            first, last = d.spans()
            codes = rows.column(0).dictionary_encode()
            which = np.asarray(codes.indices.fill_null(len(codes.dictionary)))
            of_point = np.repeat(which, last - first)
            order = np.argsort(of_point, kind="stable")
            xy, of_point = d.xy[order], of_point[order]
            kinds, at = np.unique(of_point, return_index=True)
            names = codes.dictionary.to_pylist() + [None]
            found = [_corners([tuple(p) for p in part.tolist()]) for part in np.split(xy, at[1:])] if len(kinds) else []
            points = pa.array([[{"x": x, "y": y} for x, y in c] for c in found], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in kinds.tolist()], rows.column(0).type), points], [group, "points"])

    made = lay.df.select(group, GEOM).mapInArrow(corners, f"`{group}` {kind}, points array<struct<x:double,y:double>>")
    salted = made.groupBy(group, F.pmod(F.xxhash64("points"), F.lit(64)).alias("_part")).agg(F.array_distinct(F.flatten(F.collect_list("points"))).alias("points"))
    merged = salted.select(group, corner_points("points").alias("points"))
    whole = merged.groupBy(group).agg(F.array_distinct(F.flatten(F.collect_list("points"))).alias("points"))
    hulls = whole.select(group, geometry.hull_of("points").alias(GEOM))
    fail_if(hulls.where(f"{GEOM} is null").select(group), "no hull")
    named = hulls.join(first_seen_groups(lay.df, group), group)
    df = named.select(F.col("number").cast("long").alias(FID), F.format_string("B%06d", "number").alias("shape_id"), group, GEOM)
    fields = (Field("shape_id"), lay.require(group))
    return Layer(df, replace(lay.meta, name=f"{lay.meta.name}_hulls", geometry_type="POLYGON", fields=fields))


def _corners(xy: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The corners of the hull; of points in line the outermost two."""
    ring = planar.convex_hull(xy)
    return ring[:-1] if ring else sorted({min(xy), max(xy)}) if xy else []


@F.pandas_udf(T.ArrayType(geometry.POINT))
def corner_points(values: pd.Series) -> pd.Series:
    return values.map(lambda points: [{"x": x, "y": y} for x, y in _corners([(p["x"], p["y"]) for p in points])])


def polygon_from(lay: Layer, fids: list[int], name: str = "polygon") -> Layer:
    """One polygon through points in the order of their ids; it must be simple and have an area."""
    spark = lay.df.sparkSession
    if len(fids) < 3:
        raise LayerError("a polygon needs three points")
    wanted = spark.createDataFrame(list(enumerate(fids)), f"pos int, {FID} long")
    rows = lay.df.select(FID, geometry.parts_of(GEOM).alias("p"), geometry.geometry_type(F.col(GEOM)).alias("t"))
    found = F.broadcast(wanted).join(rows, FID, "left")
    fail_if(found.where("t is null or t <> 'POINT'").select(FID), "not a point")
    ring = found.agg(F.array_sort(F.collect_list(F.struct("pos", F.get(F.get("p", F.lit(0)), F.lit(0)).alias("xy")))).alias("r"))
    df = ring.select(F.lit(1).cast("long").alias(FID), geometry.ordered_polygon(F.transform("r", lambda v: v["xy"])).alias(GEOM))
    fail_if(df.where(f"{GEOM} is null").select(FID), "the points make no simple polygon")
    return Layer(df, replace(lay.meta, name=name, geometry_type="POLYGON", fields=()))


def _in_cells(rows: DataFrame, bbox: str, cell: float) -> DataFrame:
    """Each row once for every grid cell that its bounds touch, as ``_cx`` and ``_cy``."""
    span = lambda axis: F.sequence(F.floor(F.col(f"{bbox}.min{axis}") / cell), F.floor(F.col(f"{bbox}.max{axis}") / cell))
    return rows.select("*", F.explode(span("x")).alias("_cx")).select("*", F.explode(span("y")).alias("_cy"))


def _overlap(source: DataFrame, other: DataFrame, cell: float) -> DataFrame:
    """Rows of ``source`` (with bounds ``_a``) beside rows of ``other`` (with ``_b``) whose bounds overlap.

    Of all cells that both rows touch only the one with the lower corner of
    their common rectangle reports the pair, so nothing has to be made
    distinct.  The other side is broadcast if it is measured to be small, and
    then no row of the source is shuffled.
    """
    cells = _in_cells(other, "_b", cell)
    a, b = _in_cells(source, "_a", cell), F.broadcast(cells) if is_small(cells) else cells
    first = (F.floor(F.greatest("_a.minx", "_b.minx") / cell) == F.col("_cx")) & (F.floor(F.greatest("_a.miny", "_b.miny") / cell) == F.col("_cy"))
    meet = (F.col("_a.minx") <= F.col("_b.maxx")) & (F.col("_b.minx") <= F.col("_a.maxx")) & (F.col("_a.miny") <= F.col("_b.maxy")) & (F.col("_b.miny") <= F.col("_a.maxy"))
    return a.join(b, ["_cx", "_cy"]).where(meet & first).drop("_cx", "_cy")


def candidate_pairs(source: DataFrame, other: DataFrame, cell: float) -> DataFrame:
    """(fid, other) of rows whose bounds overlap, each pair once, by an equi-join on grid cells.

    Both sides need ``bbox``; ``cell`` should be about the size of the larger
    side's bounds.
    """
    a = source.select(FID, F.col("bbox").alias("_a"))
    return _overlap(a, other.select(F.col(FID).alias("other"), F.col("bbox").alias("_b")), cell).select(FID, "other")


def boundary_split(lay: Layer, boundaries: Layer, cell: float, shape_field: str = "shape_id", max_pairs: int | None = None) -> Layer:
    """The polygonal parts of features inside each boundary, of any shape, with the boundary's ``shape_id``.

    A feature over several boundaries appears once for each; touching is not
    overlapping.  A field that would clash with the feature id is renamed.
    Features carry their geometry through the join and are clipped in the
    same stage; where the boundaries are small nothing is shuffled.
    """
    if not lay.meta.crs or lay.meta.crs.upper() != boundaries.meta.crs.upper():
        raise LayerError("boundary split needs one known CRS")
    fail_if(boundaries.df.groupBy(shape_field).count().where("count > 1").select(shape_field), "repeated shape_id")
    names = {n: f"source_{n.lower()}" if n.lower() == FID else n for n in lay.meta.names() if n != "shape_id"}
    source = lay.df.select(FID, *[F.col(f"`{o}`").alias(n) for o, n in names.items()], GEOM, geometry.bbox_of(GEOM).alias("_a"))
    windows = boundaries.df.select(F.col(shape_field).alias("shape_id"), F.col(GEOM).alias("_window"), geometry.bbox_of(GEOM).alias("_b"))
    pairs = _overlap(source.where("_a.minx is not null"), windows, cell)
    if max_pairs is not None and pairs.limit(max_pairs + 1).count() > max_pairs:
        raise LayerError(f"more than {max_pairs} candidate pairs")
    cut = pairs.withColumn(GEOM, geometry.clip_to(GEOM, "_window"))
    df = cut.where(f"{GEOM} is not null").select(FID, *names.values(), "shape_id", GEOM)
    fields = tuple(replace(f, name=names[f.name]) for f in lay.meta.fields if f.name in names) + (Field("shape_id"),)
    return Layer(df, replace(lay.meta, name=f"{lay.meta.name}_split", fields=fields))


def boundary_split_boxes(source: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """The same for rectangles on both sides, in plain expressions: (fid, other, minx, miny, maxx, maxy)."""
    pairs = _overlap(source.select(FID, F.col("bbox").alias("_a")), boxes.select(F.col(FID).alias("other"), F.col("bbox").alias("_b")), cell)
    got = pairs.select(
        FID, "other", F.greatest("_a.minx", "_b.minx").alias("minx"), F.greatest("_a.miny", "_b.miny").alias("miny"),
        F.least("_a.maxx", "_b.maxx").alias("maxx"), F.least("_a.maxy", "_b.maxy").alias("maxy"),
    )
    return got.where("maxx > minx and maxy > miny")


def same_place(*layers: Layer) -> str:
    """The one CRS of layers; two that are known and differ are an error."""
    known = {lay.meta.crs.strip().upper() for lay in layers} - {""}
    if len(known) > 1:
        raise LayerError(f"different CRS: {', '.join(sorted(known))}")
    return next(iter(known), "")


OPERATIONS = ("intersect", "union", "difference")


def overlay_positional(left: Layer, right: Layer, operation: str) -> Layer:
    """The n-th polygon of the left with the n-th of the right; attributes from the left, empty results stay as empty polygons."""
    if operation not in OPERATIONS:
        raise LayerError(f"unknown operation: {operation}")
    same_place(left, right)
    pairs = zip_features(left.df, right.df)
    df = pairs.withColumn(GEOM, geometry.overlay_of(operation)(GEOM, "other")).select(left.df.columns)
    return left.with_df(df, name=f"{left.meta.name}_{operation}")


def intersect_positional(left: Layer, right: Layer) -> Layer:
    return overlay_positional(left, right, "intersect")


def buffer(lay: Layer, distance: float, segments: int = 8) -> Layer:
    """All places within a distance of each feature, as polygons; 0 and what is no number are errors."""
    if not distance or not np.isfinite(distance):
        raise LayerError("a buffer needs a distance")
    return lay.with_df(lay.df.withColumn(GEOM, geometry.buffer(distance, segments)(GEOM)), name=f"{lay.meta.name}_buffer", geometry_type="POLYGON")


def spatial(operation: str, layers: list[Layer], distance: float | None = None) -> Layer:
    """An operation by its name; ``buffer`` takes one layer and a distance, the others two layers."""
    if operation == "buffer":
        if len(layers) != 1 or distance is None:
            raise LayerError("buffer takes one layer and a distance")
        return buffer(layers[0], distance)
    if operation not in OPERATIONS:
        raise LayerError(f"unknown operation: {operation}")
    if len(layers) != 2:
        raise LayerError(f"{operation} takes two layers")
    return overlay_positional(*layers, operation)


#: Distances of snapped positions in metres and in degrees.
GRIDS = {"projected": 0.1, "geographic": 1e-6}


def dissolve(lay: Layer, cell: float, group: str | None = None, grid: float = 0.0, rounds: int = 2, outline: bool = False) -> Layer:
    """The union of all polygons, or of each group's, as one feature each; with ``outline`` its rings as lines.

    Polygons are merged within the grid cell of their lower corner first,
    then within cells four times as wide, ``rounds`` times, and at last
    together, so each step only holds what a cell is left with.
    """
    key = [group] if group else []
    kind = f"`{group}` {lay.df.schema[group].dataType.simpleString()}, " if group else ""

    def merge(table: pa.Table) -> pa.Table:
        found = [p for g in table[GEOM].to_pylist() if g is not None for p in codec.polygons(codec.decode(g))]
        merged = overlay.union(found, grid=grid)
        made = codec.encode(("MULTIPOLYGON", [("POLYGON", p) for p in merged]))
        return pa.table({**({group: table[group][:1]} if group else {}), GEOM: pa.array([made], pa.binary())})

    rows = lay.df.where(f"{GEOM} is not null").select(*key, GEOM)
    for i in range(rounds):
        size = cell * 4**i
        at = rows.withColumn("_b", geometry.bbox_of(GEOM)).where("_b.minx is not null")
        at = at.select(*key, F.floor(F.col("_b.minx") / size).alias("_cx"), F.floor(F.col("_b.miny") / size).alias("_cy"), GEOM)
        rows = at.groupBy(*key, "_cx", "_cy").applyInArrow(merge, f"{kind}{GEOM} binary")
    whole = (rows if group else rows.withColumn("_all", F.lit(0))).groupBy(*(key or ["_all"])).applyInArrow(merge, f"{kind}{GEOM} binary")
    if outline:
        whole = whole.withColumn(GEOM, _outline(GEOM))
    if group:
        numbers = first_seen_groups(lay.df, group).withColumnRenamed(group, "_group")
        df = whole.join(numbers, F.col(f"`{group}`").eqNullSafe(F.col("_group"))).select(F.col("number").cast("long").alias(FID), group, GEOM)
    else:
        df = whole.select(F.lit(1).cast("long").alias(FID), GEOM)
    fields = (lay.require(group),) if group else ()
    return Layer(df, replace(lay.meta, name=f"{lay.meta.name}_dissolved", geometry_type="MULTILINESTRING" if outline else "MULTIPOLYGON", fields=fields))


@F.pandas_udf(geometry.BINARY)
def _outline(geom: pd.Series) -> pd.Series:
    return geom.map(lambda g: None if g is None else codec.encode(("MULTILINESTRING", [("LINESTRING", r) for r in codec.lines(codec.decode(g))])))


def area_of(geom: str | Column = GEOM) -> Column:
    """Area of all polygons of a geometry, holes taken off; an Arrow kernel."""

    @F.pandas_udf(T.DoubleType())
    def total(values: pd.Series) -> pd.Series:
        def one(data):
            found = codec.polygons(codec.decode(data)) if data is not None else []
            return float(sum(abs(planar.signed_area(p[0])) - sum(abs(planar.signed_area(h)) for h in p[1:]) for p in found))

        return values.map(one).astype(float)

    return total(geom)


def dissolve_coverage(df: DataFrame, group: str | None = None) -> DataFrame:
    """Outline of polygons that share edges: edges met from both sides cancel.

    Each ring gives its directed edges; an edge and its reverse leave nothing,
    which is a sum by undirected edge with partial sums.  The result is the
    edges that are left, (group, x0, y0, x1, y1), and their total length and
    the enclosed area follow from them by sums.
    """
    key = F.col(group) if group else F.lit(0)
    rings = df.select(key.alias("group"), F.explode(geometry.parts_of(GEOM)).alias("ring"))
    n = F.size("ring")
    edges = rings.select("group", F.explode(F.zip_with(F.slice("ring", 1, n - 1), F.slice("ring", 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e"))
    forward = (F.col("e.a.x") < F.col("e.b.x")) | ((F.col("e.a.x") == F.col("e.b.x")) & (F.col("e.a.y") < F.col("e.b.y")))
    lo, hi = F.when(forward, F.col("e.a")).otherwise(F.col("e.b")), F.when(forward, F.col("e.b")).otherwise(F.col("e.a"))
    net = edges.groupBy("group", lo.alias("lo"), hi.alias("hi")).agg(F.sum(F.when(forward, 1).otherwise(-1)).alias("net")).where("net <> 0")
    start, end = F.when(F.col("net") > 0, F.col("lo")).otherwise(F.col("hi")), F.when(F.col("net") > 0, F.col("hi")).otherwise(F.col("lo"))
    return net.select("group", start.alias("s"), end.alias("t")).select("group", F.col("s.x").alias("x0"), F.col("s.y").alias("y0"), F.col("t.x").alias("x1"), F.col("t.y").alias("y1"))


def outline_totals(edges: DataFrame) -> DataFrame:
    """(group, length, area) of dissolved outlines."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return edges.groupBy("group").agg(
        F.sum(F.sqrt(dx * dx + dy * dy)).alias("length"), F.abs(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("area")
    )

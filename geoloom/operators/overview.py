"""What of several layers a view is to show, and how much of it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs as systems
from ..functions import geometry
from ..model import FID, GEOM, Layer, LayerError

Box = tuple[float, float, float, float]
#: Features of a view of strides and of a sample in source order, and the range of zoom buckets.
VIEW_FEATURES, SAMPLE_FEATURES, BUCKETS = 240_000, 2000, (-10, 20)
#: How many times wider than the main layer a small one may make the view.
GROWTH = 64


def bucket_of(zoom: float) -> int:
    if not math.isfinite(zoom):
        return 0
    return min(max(math.floor(math.log2(zoom)), BUCKETS[0]), BUCKETS[1]) if zoom > 0 else BUCKETS[0]


def window_share(bucket: int) -> float:
    """The side of a window as a share of the extent: a thirty-second at first, halved at most zooms, with rests at 2 to 4 and 6 to 8."""
    z = min(max(bucket, BUCKETS[0]), BUCKETS[1])
    halvings = min(7, 5 + max(0, z)) if z <= 4 else 7 + max(min(z - 4, 2), z - 6)
    return 2.0**-halvings


def stride(bucket: int, features: int = 0, most: int = VIEW_FEATURES) -> int:
    """One feature in so many is shown; ``most`` grows fourfold with each bucket above 3."""
    far = 1 if bucket >= -1 else 2 ** min(8, 1 - bucket)
    if features <= 0 or bucket == 2:
        return far
    allowed = most * 4 ** min(10, max(0, bucket - 3))
    return max(far, -(-features // min(allowed, features)))


def _valid(box: Box | None) -> bool:
    return box is not None and all(map(math.isfinite, box)) and box[0] <= box[2] and box[1] <= box[3]


def joined(boxes: list[Box]) -> Box | None:
    boxes = [b for b in boxes if _valid(b)]
    return (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else None


def dominant_fit(layers: list[tuple[Box | None, int]]) -> Box | None:
    """The bounds to show of layers (bounds, features): those with under a hundredth of the largest's features must not widen it too much."""
    known = [(b, n) for b, n in layers if n > 0 and _valid(b)]
    if not known:
        return None
    main, count = max(known, key=lambda x: x[1])

    def growth(box: Box) -> float:
        both = joined([main, box])
        spans = [(both[i + 2] - both[i], main[i + 2] - main[i]) for i in (0, 1)]
        return max(1.0 if span == own else math.inf if own == 0 else span / own for span, own in spans)

    return joined([b for b, n in known if b == main or n >= max(1, count // 100) or growth(b) <= GROWTH])


def tiles_of_layer(tiles: list[tuple[int, int]], extent: Box, share: float, bounds: Box | None) -> list[tuple[int, int]]:
    """Of tiles of the extent's unit square those that a layer's bounds touch; all of them where its bounds are unknown."""
    if not _valid(bounds) or share <= 0 or not (extent[0] < extent[2] and extent[1] < extent[3]):
        return tiles
    out = []
    for tile in tiles:
        low = [max(0.0, t * share) for t in tile]
        high = [min(1.0, (t + 1) * share) for t in tile]
        world = [(extent[i] + a * (extent[i + 2] - extent[i]), extent[i] + b * (extent[i + 2] - extent[i])) for i, (a, b) in enumerate(zip(low, high, strict=True)) if a < b]
        if len(world) == 2 and all(world[i][0] <= bounds[i + 2] and world[i][1] >= bounds[i] for i in (0, 1)):
            out.append(tile)
    return out


def normalised(x: Column, y: Column, extent: Box) -> tuple[Column, Column]:
    """Positions in the unit square of an extent; a side without length is in the middle."""
    scaled = lambda v, a, b: (v - a) / (b - a) if b > a else F.when(v.isNotNull(), 0.5)
    return scaled(x, extent[0], extent[2]), scaled(y, extent[1], extent[3])


def sampled(lay: Layer, most: int = SAMPLE_FEATURES) -> tuple[DataFrame, bool]:
    """The first features in the order of ids, and whether they are all: an overview that says that it is approximate."""
    rows = lay.df.orderBy(FID).limit(most + 1)
    return rows.limit(most), rows.count() <= most


def dense_windows(lay: Layer, extent: Box, most: int, depth: int = 8) -> DataFrame:
    """Quarters of an extent, quartered again where more than ``most`` features begin: (level, cx, cy, features).

    All levels are counted in one aggregation of the features' lower corners
    at the deepest one; a cell is reported where it is full enough to stop, or
    cannot be cut further.
    """
    if not (extent[0] < extent[2] and extent[1] < extent[3]):
        raise LayerError("an extent needs an area")
    cells = 2**depth
    box = lay.df.select(geometry.bbox_of(GEOM).alias("b")).where("b.minx is not null")
    place = lambda v, a, b: F.least(F.greatest(F.floor((v - a) / (b - a) * cells), F.lit(0)), F.lit(cells - 1)).cast("int")
    deep = box.select(place(F.col("b.minx"), extent[0], extent[2]).alias("x"), place(F.col("b.miny"), extent[1], extent[3]).alias("y"))
    deep = deep.groupBy("x", "y").agg(F.count("*").alias("n"))
    levels = deep.select("n", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    shift = F.lit(depth) - F.col("level")
    sums = levels.select("level", F.floor(F.col("x") / F.pow(F.lit(2), shift)).alias("cx"), F.floor(F.col("y") / F.pow(F.lit(2), shift)).alias("cy"), "n")
    sums = sums.groupBy("level", "cx", "cy").agg(F.sum("n").alias("features"))
    above = sums.select((F.col("level") + 1).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("features").alias("parent"))
    own = sums.withColumns({"px": F.floor(F.col("cx") / 2), "py": F.floor(F.col("cy") / 2)})
    open_ = own.join(above, ["level", "px", "py"], "left").where((F.col("level") == 0) | (F.col("parent") > most))
    return open_.where((F.col("features") <= most) | (F.col("level") == depth)).select("level", "cx", "cy", "features")


def aligned(layers: list[Layer], target: str = "") -> list[Layer]:
    """All layers in one CRS: the target, or the first that is known; a layer with features but without a CRS is an error."""
    target = target or next((lay.meta.crs for lay in layers if lay.meta.crs), "")
    if not target:
        return layers
    out = []
    for lay in layers:
        if lay.meta.crs.strip().upper() == target.strip().upper():
            out.append(lay)
        elif lay.meta.crs:
            moved = lay.df.withColumn(GEOM, systems.transform_geometry(lay.meta.crs, target)(GEOM))
            out.append(lay.with_df(moved, crs=target))
        elif lay.df.limit(1).count():
            raise LayerError(f"layer without a CRS: {lay.meta.name}")
        else:
            out.append(lay)
    return out

"""Tiles, levels of detail, hits and labels: what a map view asks of a layer."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import batch, geometry, tiling
from ..functions.text import is_blank, kind_of, trim_space, value_text
from ..model import FID, GEOM, Layer, LayerError
from ..plans.rules import compile_rule, compile_text

MAX_TILES = 65_536
LABEL = "struct<text:string,x:double,y:double,anchor_set:boolean,rotation:double>"


@dataclass(frozen=True)
class Viewport:
    x: float
    y: float
    zoom: float
    width: float
    height: float

    def world(self) -> tuple[float, float, float, float]:
        w, h = self.width / self.zoom / 2, self.height / self.zoom / 2
        return self.x - w, self.y - h, self.x + w, self.y + h

    def to_world(self, sx: float, sy: float) -> tuple[float, float]:
        """Screen positions grow downwards."""
        return self.x + (sx - self.width / 2) / self.zoom, self.y - (sy - self.height / 2) / self.zoom

    def pan(self, dx: float, dy: float) -> Viewport:
        return Viewport(self.x - dx / self.zoom, self.y + dy / self.zoom, self.zoom, self.width, self.height)

    def zoomed(self, factor: float) -> Viewport:
        return Viewport(self.x, self.y, max(0.0001, self.zoom * factor), self.width, self.height)


def zoom_bucket(zoom: float) -> int:
    return math.floor(math.log2(max(zoom, 0.0001)))


def tile_size(zoom: float, pixels: float = 256.0) -> float:
    return pixels / 2.0 ** zoom_bucket(zoom)


def visible_tiles(view: Viewport, margin: int = 1) -> list[tuple[int, int, int]]:
    """(zoom bucket, x, y) of the view's tiles and a margin around, by rows; too many are an error."""
    size, (x0, y0, x1, y1) = tile_size(view.zoom), view.world()
    xs = range(math.floor(x0 / size) - margin, math.floor(x1 / size) + margin + 1)
    ys = range(math.floor(y0 / size) - margin, math.floor(y1 / size) + margin + 1)
    if len(xs) * len(ys) > MAX_TILES:
        raise LayerError("too many tiles")
    return [(zoom_bucket(view.zoom), x, y) for y in ys for x in xs]


def by_distance(tiles: list[tuple[int, int, int]], view: Viewport) -> list[tuple[int, int, int]]:
    size = tile_size(view.zoom)
    return sorted(tiles, key=lambda t: ((t[1] + 0.5) * size - view.x) ** 2 + ((t[2] + 0.5) * size - view.y) ** 2)


def tile_of_points(df: DataFrame, x: Column, y: Column, size: float, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Points with their tile; positions outside of the bounds go to the nearest tile."""
    if bounds is not None:
        x0, y0, x1, y1 = bounds
        x, y = F.least(F.greatest(x, F.lit(x0)), F.lit(x1)), F.least(F.greatest(y, F.lit(y0)), F.lit(y1))
    return df.withColumns({"tx": F.floor(x / size), "ty": F.floor(y / size)})


def tile_segments(segments: DataFrame, size: float) -> DataFrame:
    """Rows (fid, x0, y0, x1, y1) cut at tile borders: (fid, tx, ty, x0, y0, x1, y1), parts of no length left out.

    A segment meets a column of tiles between two shares of its length, and
    in that column only the tiles between the heights at those shares, so the
    rows made are those of the tiles crossed.  Each step is a column of its
    own below an explode, so no expression is evaluated more than once or twice.
    """
    c = F.col
    tile = lambda v: F.floor(v / size)
    columns = segments.select(
        FID, "x0", "y0", "x1", "y1", (c("x1") - c("x0")).alias("dx"), (c("y1") - c("y0")).alias("dy"),
        F.explode(F.sequence(tile(F.least("x0", "x1")), tile(F.greatest("x0", "x1")))).alias("tx"),
    )
    shares = lambda d, start, t: (F.when(d == 0, 0.0).otherwise((t * size - start) / d), F.when(d == 0, 1.0).otherwise((t * size + size - start) / d))
    a, b = shares(c("dx"), c("x0"), c("tx"))
    columns = columns.select("*", F.greatest(F.lit(0.0), F.least(a, b)).alias("u0"), F.least(F.lit(1.0), F.greatest(a, b)).alias("u1"))
    ya, yb, slack = c("y0") + c("dy") * c("u0"), c("y0") + c("dy") * c("u1"), size * 1e-9
    # What rounding adds to a height must not hide a tile; the shares below decide.
    low = F.greatest(tile(F.least(ya, yb) - slack), tile(F.least("y0", "y1")))
    high = F.least(tile(F.greatest(ya, yb) + slack), tile(F.greatest("y0", "y1")))
    tiles = columns.where("u0 <= u1").select("*", F.explode(F.when(low <= high, F.sequence(low, high))).alias("ty"))
    a, b = shares(c("dy"), c("y0"), c("ty"))
    tiles = tiles.select("*", F.greatest(c("u0"), F.least(a, b)).alias("s"), F.least(c("u1"), F.greatest(a, b)).alias("e")).where("s < e and (dx <> 0 or dy <> 0)")
    at = lambda start, d, share: (c(start) + c(d) * c(share))
    return tiles.select(FID, "tx", "ty", at("x0", "dx", "s").alias("x0"), at("y0", "dy", "s").alias("y0"), at("x0", "dx", "e").alias("x1"), at("y0", "dy", "e").alias("y1"))


def tile_totals(df: DataFrame, size: float) -> DataFrame:
    """(tx, ty, n, length): how many segments of a layer's geometries cross each tile and their length in it.

    The totals of ``tile_segments``, for tiles with at least one part.  Rows
    made are the runs of tiles in a row or column, not the tiles crossed, and
    tasks hand on their sums.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = tiling.Sums()

        def handed_on(axis: int, across: np.ndarray, along: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            whole = [v if "length" in name else v.astype(np.int64) for name, v in zip(tiling.VALUES, values, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(across), axis, np.int32), across, along, *whole)], ["axis", "across", "along", *tiling.VALUES])

        for rows in batches:
            for event in tiling.events(*tiling.segments(batch.decode_all(rows.column(0))), size):
                for full in kept.add(*event):
                    yield handed_on(*full)
        for full in kept.rest():
            yield handed_on(*full)

    c = F.col
    shape = ", ".join(f"{name} {'double' if 'length' in name else 'long'}" for name in tiling.VALUES)
    # Each task hands on a row for each tile that it met, so more tasks than work side by side make more rows.
    tasks = max(16, 2 * df.sparkSession.sparkContext.defaultParallelism)
    by_tile = df.select(GEOM).coalesce(tasks).mapInArrow(sums, f"axis int, across long, along long, {shape}").groupBy("axis", "across", "along").agg(*[F.sum(v).alias(v) for v in tiling.VALUES])
    row = Window.partitionBy("axis", "across").orderBy("along")
    so_far = row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = by_tile.select(
        "*", F.lead("along").over(row).alias("next"),
        F.sum(c("opened") - c("closed")).over(so_far).alias("m"), F.sum(c("opened_length") - c("closed_length")).over(so_far).alias("behind"),
    )
    # Where no run is open nothing is, whatever rounding has left.
    before = F.when(c("m") > c("opened"), c("behind") - c("opened_length")).otherwise(0.0)
    own = running.select("axis", "across", "along", (c("n") + c("m") - c("opened")).alias("n"), (c("length") + before).alias("length"))
    between = running.where("m > 0 and next > along + 1").select(
        "axis", "across", F.explode(F.sequence(c("along") + 1, c("next") - 1)).alias("along"), c("m").alias("n"), c("behind").alias("length")
    )
    tx, ty = (F.when(c("axis") == axis, c("along")).otherwise(c("across")) for axis in (0, 1))
    tiles = own.union(between).where("n > 0").select(tx.alias("tx"), ty.alias("ty"), "n", "length")
    return tiles.groupBy("tx", "ty").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))


def shared_edges_once(segments: DataFrame) -> DataFrame:
    """Segments that several features share, once, in either direction."""
    c = F.col
    forward = (c("x0") < c("x1")) | ((c("x0") == c("x1")) & (c("y0") <= c("y1")))
    ends = {n: F.when(forward, c(n)).otherwise(c(m)) for n, m in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))}
    return segments.select(*[v.alias(k) for k, v in ends.items()], FID).groupBy("x0", "y0", "x1", "y1").agg(F.min(FID).alias(FID))


def segments_of(df: DataFrame) -> DataFrame:
    """(fid, x0, y0, x1, y1) of all sequences of a layer's geometries."""
    seq = df.select(FID, F.explode(geometry.parts_of(GEOM)).alias("s")).where("size(s) > 1")
    n = F.size("s") - 1
    pairs = F.zip_with(F.slice("s", 1, n), F.slice("s", 2, n), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))
    return seq.select(FID, F.explode(pairs).alias("p")).select(FID, "p.*")


def hit(lay: Layer, x: float, y: float, tolerance: float) -> DataFrame:
    """The feature whose boundary or point is nearest to a position, within the tolerance: (fid, distance).

    The inside of a polygon is no hit; of equal distances the first fid wins.
    """
    rows = lay.df.withColumn("_b", geometry.bbox_of(GEOM)).where(geometry.overlaps(F.col("_b"), x - tolerance, y - tolerance, x + tolerance, y + tolerance))
    parts = rows.select(FID, F.explode(geometry.parts_of(GEOM)).alias("s"))
    n = F.greatest(F.size("s") - 1, F.lit(1))
    after = F.when(F.size("s") > 1, F.slice("s", 2, n)).otherwise(F.col("s"))

    def distance(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.coalesce(F.try_divide((F.lit(x) - a["x"]) * dx + (F.lit(y) - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        ex, ey = a["x"] + t * dx - x, a["y"] + t * dy - y
        return F.sqrt(ex * ex + ey * ey)

    near = F.array_min(F.zip_with(F.slice("s", 1, n), after, distance))
    best = parts.select(FID, near.alias("distance")).where(F.col("distance") <= tolerance).agg(F.min(F.struct("distance", FID)).alias("h"))
    return best.where("h is not null").select(f"h.{FID}", "h.distance")


def hit_on_screen(lay: Layer, view: Viewport, sx: float, sy: float, pixels: float = 6.0) -> DataFrame:
    return hit(lay, *view.to_world(sx, sy), pixels / view.zoom)


def label_field(lay: Layer, name: str, rotation: str | None = None) -> Layer:
    """Labels with a field's trimmed text at the representative point; blank text means none."""
    lay.require(name)
    text = trim_space(F.when(F.col(f"`{name}`").isNotNull(), value_text(F.col(f"`{name}`"), kind_of(lay.df, name))))
    return _labelled(lay, text, rotation)


def label_rule(lay: Layer, rule: str | None, text: str, rotation: str | None = None) -> Layer:
    """Labels composed by a rule and a text; where the rule is false or the text blank a feature stays unlabelled."""
    value = trim_space(compile_text(text, lay.df))
    return _labelled(lay, value if rule is None else F.when(compile_rule(rule, lay.df), value), rotation)


def _labelled(lay: Layer, text: Column, rotation: str | None) -> Layer:
    angle = F.lit(0.0)
    if rotation is not None:
        lay.require(rotation)
        value = F.col(f"`{rotation}`").cast("string")
        number = value.try_cast("double")
        bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
        angle = F.when(is_blank(value), 0.0).when(bad, F.raise_error(F.lit("label rotation is no number")).cast("double")).otherwise(number)
    df = lay.df.withColumn("_text", F.when(~is_blank(text), text))
    anchor = F.when(F.col("_text").isNotNull(), geometry.representative_point(GEOM))
    df = df.withColumn("_at", anchor)
    missing = F.col("_text").isNotNull() & F.col("_at.x").isNull()
    x = F.when(missing, F.raise_error(F.lit("labels need points, lines or polygons")).cast("double")).otherwise(F.col("_at.x"))
    label = F.struct(F.col("_text").alias("text"), x.alias("x"), F.col("_at.y").alias("y"), F.lit(True).alias("anchor_set"), angle.alias("rotation"))
    return lay.with_df(df.withColumn("label", F.when(F.col("_text").isNotNull(), label)).drop("_text", "_at"))


#: Scale denominators and how many labels a view shows up to them.
LABEL_LIMITS = ((500, 200), (2_000, 150), (10_000, 100))


def label_limit(denominator: float) -> int:
    return next((n for most, n in LABEL_LIMITS if denominator <= most), 50)


def place_labels(labels: DataFrame, view: Viewport, limit: int, width: float = 7.0, height: float = 14.0) -> DataFrame:
    """Labels of a view (fid, text, x, y) that do not overlap, first come by (y, x, fid, text).

    Culling and the limit are distributed; the greedy pass sees at most
    ``limit`` rows, of one view.
    """
    x0, y0, x1, y1 = view.world()
    cx, cy, w, h = (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) * 0.55, (y1 - y0) * 0.55
    seen = labels.where((F.abs(F.col("x") - cx) <= w) & (F.abs(F.col("y") - cy) <= h)).orderBy("y", "x", FID, "text").limit(limit)
    zoom = view.zoom

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: dict[tuple[int, int], list[tuple[float, float, float, float]]] = {}
        keep = []
        for row in pdf.sort_values(["y", "x", FID, "text"]).itertuples():
            half = max(1, len(row.text)) * width / 2
            a, b, c, d = row.x * zoom - half, row.y * zoom - height / 2, row.x * zoom + half, row.y * zoom + height / 2
            cells = [(i, j) for i in range(int(a // 48), int(c // 48) + 1) for j in range(int(b // 48), int(d // 48) + 1)]
            free = not any(a < q[2] and q[0] < c and b < q[3] and q[1] < d for cell in cells for q in taken.get(cell, ()))
            keep.append(free)
            if free:
                for cell in cells:
                    taken.setdefault(cell, []).append((a, b, c, d))
        return pdf.sort_values(["y", "x", FID, "text"])[keep]

    shape = ", ".join(f"{n} {k}" for n, k in seen.dtypes)
    return seen.withColumn("_view", F.lit(1)).groupBy("_view").applyInPandas(lambda pdf: greedy(pdf.drop(columns="_view")), shape)


def outline_parcels(df: DataFrame, tolerance: float) -> DataFrame:
    """Features whose bounds are large enough to be drawn: side 5 and area 100 times the tolerance and its square."""
    b = F.col("bbox")
    w, h = b["maxx"] - b["minx"], b["maxy"] - b["miny"]
    return df.where((F.greatest(w, h) >= 5 * tolerance) & (w * h >= 100 * tolerance * tolerance))


def every_kth(df: DataFrame, stride: int) -> DataFrame:
    """Each ``stride``-th feature by fid, where fids are places."""
    return df.where((F.col(FID) - 1) % stride == stride - 1)

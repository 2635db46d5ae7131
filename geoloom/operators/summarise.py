"""Aggregates, validation and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import geometry
from ..functions.text import is_blank, kind_of, value_text
from ..model import FID, GEOM, Field, Layer, LayerError
from ..scale import small
from .combine import numbered


def group_totals(lay: Layer, group: str, sum_field: str | None = None) -> DataFrame:
    """(group, count, sum) by the group's text, null for missing; a sum over anything but numbers is an error."""
    lay.require(group)
    key = F.when(F.col(f"`{group}`").isNotNull(), value_text(F.col(f"`{group}`"), kind_of(lay.df, group))).alias("group")
    if sum_field is None:
        return lay.df.groupBy(key).agg(F.count("*").alias("count"), F.lit(0.0).alias("sum")).orderBy("group")
    lay.require(sum_field)
    value = F.col(f"`{sum_field}`")
    number = value.cast("string").try_cast("double") if kind_of(lay.df, sum_field) == "string" else value.cast("double")
    checked = F.when(number.isNotNull(), number).otherwise(F.raise_error(F.lit(f"{sum_field}: not a number")).cast("double"))
    return lay.df.groupBy(key).agg(F.count("*").alias("count"), F.sum(checked).alias("sum")).orderBy("group")


def validate(lay: Layer, required: list[str] = (), unique: list[str] = (), geometry_rule: bool = True) -> DataFrame:
    """(feature_id, rule, reason, position): every failed rule of every feature.

    A repeated key names the first feature that has it.  The first ones are
    found by an aggregation; those of repeated keys are broadcast where they
    are measured to be few, so a frequent key is neither a large window nor
    one task of a join.
    """
    text = lambda name: value_text(F.col(f"`{name}`"), kind_of(lay.df, name))
    issue = lambda ok, rule, reason: F.when(~ok, F.struct(F.lit(rule).alias("rule"), reason.alias("reason")))
    df, found = lay.df, []
    for name in required:
        lay.require(name)
        blank = F.col(f"`{name}`").isNull() | is_blank(text(name))
        found.append(issue(~blank, "required", F.lit(f"{name} is blank")))
    if geometry_rule and GEOM in df.columns:
        df = df.withColumn("_parts", geometry.metrics_of(GEOM)["sequences"])
        found.append(issue(F.col(GEOM).isNotNull(), "geometry", F.lit("geometry is missing")))
        bad = F.col(GEOM).isNotNull() & (F.col("_parts").isNull() | (F.col("_parts") == 0))
        found.append(issue(~bad, "geometry", F.lit("geometry is invalid")))
    for name in unique:
        lay.require(name)
        key = text(name)
        first = df.groupBy(key.alias("_key")).agg(F.min(FID).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        df = df.withColumn("_key", key).join(small(first), "_key", "left").withColumnRenamed("_first", f"_first_{name}").drop("_key")
        again = F.coalesce(F.col(f"_first_{name}") < F.col(FID), F.lit(False))
        blank = F.col(f"`{name}`").isNotNull() & is_blank(key)
        found.append(issue(~blank, "unique", F.lit(f"{name} is blank")))
        found.append(issue(blank | ~again, "unique", F.concat(F.lit(f"{name} repeats feature "), F.col(f"_first_{name}").cast("string"))))
    if not found:
        return df.sparkSession.createDataFrame([], "feature_id long, rule string, reason string, position int")
    issues = F.filter(F.transform(F.array(*found), lambda x, i: F.when(x.isNotNull(), F.struct(x["rule"].alias("rule"), x["reason"].alias("reason"), i.alias("position")))), lambda x: x.isNotNull())
    return df.select(F.col(FID).alias("feature_id"), F.explode(issues).alias("issue")).select(
        "feature_id", "issue.rule", "issue.reason", "issue.position"
    )


def geographic(crs: str) -> bool:
    code = crs.upper().removeprefix("EPSG:")
    return crs.upper() == "OGC:CRS84" or (code.isdigit() and 4000 <= int(code) <= 4999)


def measure(lay: Layer) -> Layer:
    """``length`` and ``area`` in the plane; a polygon's length is its perimeter, holes are an error."""
    if not lay.meta.crs or geographic(lay.meta.crs):
        raise LayerError("measures need a projected CRS")
    rows = lay.df.withColumn("_type", geometry.geometry_type(F.col(GEOM))).withColumn("_m", geometry.metrics_of(GEOM))
    bad = F.col("_type").isNull() | ~F.col("_type").isin("POINT", "LINESTRING", "POLYGON") | (F.col("_m.sequences") > 1)
    fail = F.raise_error(F.lit("measures need points, lines or polygons without holes")).cast("double")
    length = F.when(bad, fail).when(F.col("_type") == "POINT", 0.0).otherwise(F.col("_m.length"))
    area = F.when(F.col("_type") == "POLYGON", F.col("_m.area")).otherwise(0.0)
    names = [n for n in lay.meta.names() if n not in ("length", "area")]
    df = rows.select(FID, *[F.col(f"`{n}`") for n in names], length.alias("length"), area.alias("area"), GEOM)
    fields = tuple(f for f in lay.meta.fields if f.name in names) + (Field("length", "number"), Field("area", "number"))
    return lay.with_df(df, fields=fields)


_FLOORS = {"EPSG:4326": 0.005, "EPSG:3857": 10.0, "EPSG:5179": 10.0, "EPSG:5186": 10.0}


def extent(lay: Layer, pad: bool = True) -> DataFrame:
    """One row: minx, miny, maxx, maxy, count; a side without extent is padded."""
    box = F.col("bbox") if "bbox" in lay.df.columns else geometry.bbox_of(GEOM)
    got = lay.df.select(box.alias("b")).agg(
        F.min("b.minx").alias("minx"), F.min("b.miny").alias("miny"), F.max("b.maxx").alias("maxx"), F.max("b.maxy").alias("maxy"),
        F.count("*").alias("count"),
    )
    if not pad:
        return got
    floor = F.lit(_FLOORS.get(lay.meta.crs.upper(), 0.5))
    width, height = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    least = F.greatest(F.abs("minx"), F.abs("maxx"), F.abs("miny"), F.abs("maxy")) * 1e-9
    grow = lambda own, other: F.when(own <= 0, F.greatest(floor, other * 0.05, least)).otherwise(0.0)
    x, y = grow(width, height), grow(height, width)
    return got.select((F.col("minx") - x).alias("minx"), (F.col("miny") - y).alias("miny"), (F.col("maxx") + x).alias("maxx"), (F.col("maxy") + y).alias("maxy"), "count")


def mean_spans(lay: Layer) -> DataFrame:
    box = lay.df.select(geometry.bbox_of(GEOM).alias("b"))
    return box.agg(F.avg(F.col("b.maxx") - F.col("b.minx")).alias("width"), F.avg(F.col("b.maxy") - F.col("b.miny")).alias("height"))


def median_spans(lay: Layer) -> DataFrame:
    """The upper median of widths and of heights, by ranks that Spark's percentile takes exactly."""
    box = lay.df.select(geometry.bbox_of(GEOM).alias("b")).select((F.col("b.maxx") - F.col("b.minx")).alias("w"), (F.col("b.maxy") - F.col("b.miny")).alias("h"))
    n = box.count()
    at = (n // 2 + 1) / max(1, n)
    return box.agg(F.expr(f"percentile_disc({at}) within group (order by w)").alias("width"), F.expr(f"percentile_disc({at}) within group (order by h)").alias("height"))


def robust_bounds(lay: Layer) -> dict | None:
    """Bounds without the outermost hundredth on each side, padded by 5 %, where the whole is 64 times as wide or high."""
    box = lay.df.select(geometry.bbox_of(GEOM).alias("b")).select("b.*").where("minx is not null")
    whole = box.agg(F.count("*").alias("n"), F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
    n, minx, miny, maxx, maxy = whole
    if n < 64:
        return None
    cut = max(1, n // 100)
    low, high = (cut + 1) / n, (n - cut) / n
    disc = lambda p, c: F.expr(f"percentile_disc({p}) within group (order by {c})")
    a, b, c, d = box.agg(disc(low, "minx"), disc(low, "miny"), disc(high, "maxx"), disc(high, "maxy")).first()
    if maxx - minx < 64 * (c - a) and maxy - miny < 64 * (d - b):
        return None
    px, py = (c - a) * 0.05, (d - b) * 0.05
    return {"minx": max(minx, a - px), "miny": max(miny, b - py), "maxx": min(maxx, c + px), "maxy": min(maxy, d + py)}


#: Groups that one task puts in order.
ORDERED_GROUPS = 100_000


def first_seen_groups(df: DataFrame, group: str) -> DataFrame:
    """(group, number): groups numbered from 1 in order of their first fid, by ranges where they are many."""
    firsts = df.groupBy(group).agg(F.min(FID).alias("_first"))
    if firsts.limit(ORDERED_GROUPS + 1).count() <= ORDERED_GROUPS:
        return firsts.withColumn("number", F.row_number().over(Window.orderBy("_first"))).drop("_first")
    ranged = numbered(firsts.withColumnRenamed("_first", FID), "number")
    return ranged.select(group, F.col("number").cast("int").alias("number"))

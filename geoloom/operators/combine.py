"""Joins, merges and duplicates."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import is_blank, kind_of, value_text
from ..model import FID, GEOM, Field, Layer, LayerError, fail_if
from ..scale import is_small


@dataclass(frozen=True)
class Joined:
    layer: Layer
    #: One row: matched, unmatched_features, unmatched_rows, duplicate_rows.
    report: DataFrame


def _key(df: DataFrame, name: str):
    text = value_text(F.col(f"`{name}`"), kind_of(df, name))
    return F.when(F.col(f"`{name}`").isNull() | is_blank(text), None).otherwise(text)


def join_table(lay: Layer, table: DataFrame, layer_key: str, table_key: str, check: bool = True) -> Joined:
    """Each feature with the fields of the table's row of its key, as text; blank keys never match.

    A key that two rows of the table have, and a field that both sides have,
    are errors.  Every feature stays.
    """
    lay.require(layer_key)
    if table_key not in table.columns:
        raise LayerError(f"no such table column: {table_key}")
    added = sorted(c for c in table.columns if c != table_key)
    clash = {c.lower() for c in added} & {n.lower() for n in lay.meta.names()}
    if clash:
        raise LayerError(f"fields on both sides: {', '.join(sorted(clash))}")
    keyed = table.select(_key(table, table_key).alias("_key"), *[F.col(f"`{c}`").cast("string").alias(c) for c in added])
    usable = keyed.where("_key is not null")
    if check:
        fail_if(usable.groupBy("_key").count().where("count > 1").select("_key"), "duplicate table key")
    left = lay.df.withColumn("_key", _key(lay.df, layer_key))
    if is_small(usable):
        out = left.join(F.broadcast(usable), "_key", "left")
    else:
        # Features without a key would all be shuffled to one task.
        blank = left.where("_key is null").select("*", *[F.lit(None).cast("string").alias(c) for c in added])
        out = left.where("_key is not null").join(usable, "_key", "left").unionByName(blank)
    columns = [FID, *lay.meta.names(), *added, *([GEOM] if GEOM in lay.df.columns else [])]
    fields = lay.meta.fields + tuple(Field(c) for c in added)
    return Joined(lay.with_df(out.select(*[F.col(f"`{c}`") for c in columns]), fields=fields), _report(left, keyed))


def _report(left: DataFrame, keyed: DataFrame) -> DataFrame:
    """Both sides are counted by key first, so a frequent key is one row where they meet."""
    features = left.groupBy("_key").agg(F.count("*").alias("features"))
    rows = keyed.groupBy("_key").agg(F.count("*").alias("rows"))
    met = features.where("_key is not null").join(rows.where("_key is not null"), "_key", "full")
    blank_features = features.where("_key is null").agg(F.coalesce(F.sum("features"), F.lit(0)).alias("bf"))
    blank_rows = rows.where("_key is null").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("br"))
    sums = met.agg(
        F.coalesce(F.sum(F.when(F.col("rows").isNotNull(), F.col("features"))), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.when(F.col("rows").isNull(), F.col("features"))), F.lit(0)).alias("alone"),
        F.coalesce(F.sum(F.when(F.col("features").isNull(), 1)), F.lit(0)).alias("unused"),
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("duplicate_rows"),
    )
    return sums.join(F.broadcast(blank_features)).join(F.broadcast(blank_rows)).select(
        "matched",
        (F.col("alone") + F.col("bf")).alias("unmatched_features"),
        (F.col("unused") + F.col("br")).alias("unmatched_rows"),
        "duplicate_rows",
    )


def merge(layers: list[Layer], check: bool = True) -> Layer:
    """All features of layers with one schema and CRS (blank fits any); an id that occurs twice is an error."""
    if len(layers) < 2:
        raise LayerError("merge needs two layers or more")
    first, crs = layers[0], ""
    for lay in layers:
        if [(f.name, f.type) for f in lay.meta.fields] != [(f.name, f.type) for f in first.meta.fields]:
            raise LayerError("merge: different fields")
        if crs and lay.meta.crs and crs.upper() != lay.meta.crs.upper():
            raise LayerError("merge: different CRS")
        crs = crs or lay.meta.crs
    df = first.df
    for lay in layers[1:]:
        df = df.unionByName(lay.df)
    if check:
        fail_if(df.groupBy(FID).count().where("count > 1").select(FID), "duplicate feature id")
    return Layer(df, replace(first.meta, name=f"{first.meta.name}_merged", crs=crs, source=""))


def append(layers: list[Layer]) -> Layer:
    """Layers one after the other; the ids of each start after the largest so far."""
    offset, moved = 0, []
    for lay in layers:
        moved.append(lay.with_df(lay.df.withColumn(FID, F.col(FID) + F.lit(offset))))
        offset += lay.df.agg(F.max(FID)).first()[0] or 0
    return merge(moved, check=False) if len(moved) > 1 else moved[0]


def zip_features(left: DataFrame, right: DataFrame) -> DataFrame:
    """The n-th feature of one side with the n-th of the other (``geom`` and ``other``); counts must agree.

    Places are numbered without bringing all rows to one task: rows are
    ranged by id, each range is counted, and a row's place is its range's
    offset and its place within.
    """
    a, b = numbered(left, "place"), numbered(right, "place")
    if left.count() != right.count():
        raise LayerError("different numbers of features")
    return a.join(b.select("place", F.col(GEOM).alias("other")), "place")


def numbered(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Places from 1 in fid order, by ranges."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = df.stat.approxQuantile(FID, [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
    part = F.lit(0)
    for edge in sorted(set(edges)):
        part = part + (F.col(FID) > F.lit(edge)).cast("int")
    ranged = df.withColumn("_part", part)
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    offset, offsets = 0, F.lit(0)
    for p in sorted(sizes):
        offsets = F.when(F.col("_part") == p, offset).otherwise(offsets)
        offset += sizes[p]
    within = F.row_number().over(Window.partitionBy("_part").orderBy(FID))
    return ranged.withColumn(name, (offsets + within).cast("long")).drop("_part")


def without_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of rows equal in ``columns`` the one with the smallest fid, chosen by a partial aggregation."""
    rest = [c for c in df.columns if c not in columns and c != FID]
    best = df.groupBy(*columns).agg(F.min(F.struct(FID, *rest)).alias("_row"))
    return best.select(F.col(f"_row.{FID}").alias(FID), *columns, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(df.columns)

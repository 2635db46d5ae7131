"""Filters, splits, projections and spatial windows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.text import kind_of, trim_space
from ..model import FID, GEOM, Layer, LayerError, TYPES, fail_if
from ..plans.rules import compile_rule, compile_text

MAX_GROUPS, MAX_GROUP_BYTES = 64, 128
_TRUE, _FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")


def filter_property(lay: Layer, name: str, expected: str) -> Layer:
    """Rows whose field equals ``expected``, read once as the field's own type; unreadable means no row."""
    lay.require(name)
    column, kind = F.col(f"`{name}`"), kind_of(lay.df, name)
    if kind == "string":
        condition: Column = column == expected
    elif kind == "boolean":
        condition = column == (expected in _TRUE) if expected in _TRUE + _FALSE else F.lit(False)
    else:
        try:
            number = int(expected) if kind in ("tinyint", "smallint", "int", "bigint") else float(expected)
            condition = column == F.lit(number)
        except ValueError:
            condition = F.lit(False)
    return lay.with_df(lay.df.where(condition), source="", visible=True)


def filter_where(lay: Layer, condition: Column) -> Layer:
    return lay.with_df(lay.df.where(condition), source="", visible=True)


def filter_rule(lay: Layer, rule: str) -> Layer:
    return filter_where(lay, compile_rule(rule, lay.df))


def split_column(lay: Layer, rule: str) -> DataFrame:
    """The rows with ``split_id``, the rule's trimmed text; rows without one are dropped."""
    value = trim_space(compile_text(rule, lay.df))
    checked = F.when(
        (F.octet_length(value) > MAX_GROUP_BYTES) | value.rlike(r"[/\\\r\n\u0000]"), F.raise_error(F.lit("split: bad group name")).cast("string")
    ).otherwise(value)
    return lay.df.withColumn("split_id", checked).where("split_id is not null and split_id <> ''")


def split_rule(lay: Layer, rule: str, prefix: str) -> list[Layer]:
    """One layer for each group, in order of first appearance; more than 64 groups are an error."""
    rows = split_column(lay, rule)
    groups = rows.groupBy("split_id").agg(F.min(FID).alias("first")).orderBy("first").limit(MAX_GROUPS + 1).collect()
    if len(groups) > MAX_GROUPS:
        raise LayerError(f"more than {MAX_GROUPS} groups")
    return [
        lay.with_df(rows.where(F.col("split_id") == g["split_id"]).drop("split_id"), name=f"{prefix}_{g['split_id']}", source="")
        for g in groups
    ]


def remap(lay: Layer, mapping: dict[str, str]) -> Layer:
    """Fields renamed, all at once, so two can be swapped."""
    for old in mapping:
        lay.require(old)
    names = [mapping.get(n, n).strip() for n in lay.meta.names()]
    folded = [n.lower() for n in names]
    if "" in names or len(set(folded)) < len(folded):
        raise LayerError("remap: empty or repeated field names")
    fields = tuple(replace(f, name=n) for f, n in zip(lay.meta.fields, names, strict=True))
    chosen = [F.col(f"`{old}`").alias(new) for old, new in zip(lay.meta.names(), names, strict=True)]
    kept = [c for c in (FID, GEOM) if c in lay.df.columns]
    return lay.with_df(lay.df.select(*[c for c in kept if c == FID], *chosen, *[c for c in kept if c == GEOM]), fields=fields)


def parse_mapping(text: str) -> dict[str, str]:
    out = {}
    for part in text.split(","):
        old, _, new = part.partition("=")
        if not old.strip() or not new.strip():
            raise LayerError(f"bad mapping: {part}")
        out[old.strip()] = new.strip()
    return out


def window(lay: Layer, minx: float, miny: float, maxx: float, maxy: float, rule: str | None = None, limit: int | None = None) -> Layer:
    """Rows whose bounds overlap a rectangle; with a limit, more rows are an error and never a part."""
    df = lay.df if rule is None else lay.df.where(compile_rule(rule, lay.df))
    if "bbox" in df.columns:
        df = df.where(geometry.overlaps(F.col("bbox"), minx, miny, maxx, maxy))
    else:
        bounds = df.where(F.col(GEOM).isNotNull()).withColumn("bbox", geometry.bbox_of(GEOM))
        df = bounds.where(geometry.overlaps(F.col("bbox"), minx, miny, maxx, maxy)).drop("bbox")
    if limit is not None and df.limit(limit + 1).count() > limit:
        raise LayerError(f"more than {limit} features")
    return lay.with_df(df)


def lookup(lay: Layer, fids: list[int]) -> DataFrame:
    """The rows of the ids in their order; a missing id is an error."""
    wanted = lay.df.sparkSession.createDataFrame(list(enumerate(fids)), "pos long, fid long")
    found = F.broadcast(wanted).join(lay.df, FID, "left" if GEOM not in lay.df.columns else "inner")
    missing = F.broadcast(wanted).join(lay.df.select(FID), FID, "left_anti").select(FID)
    fail_if(missing, "no such feature")
    return found.orderBy("pos")


def sample_evenly(df: DataFrame, total: int, count: int) -> DataFrame:
    """The rows with the fids 1 + i * (total - 1) / (count - 1)."""
    wanted = sorted({1 + i * (total - 1) // max(1, count - 1) for i in range(min(count, total))})
    return df.where(F.col(FID).isin(wanted))

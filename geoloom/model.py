"""Layers: a DataFrame of features and what is known about it as a whole."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FID, GEOM = "fid", "geom"
TYPES = {"text": "string", "number": "double", "bool": "boolean"}


class LayerError(ValueError):
    """An operation's conditions are not met; no partial result exists."""


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "text"

    def __post_init__(self):
        if self.type not in TYPES:
            raise LayerError(f"unknown field type: {self.type}")


@dataclass(frozen=True)
class LayerMeta:
    name: str
    crs: str = ""
    geometry_type: str = ""
    fields: tuple[Field, ...] = ()
    display_name: str = ""
    visible: bool = True
    editable: bool = True
    geometry_locked: bool = False
    source: str = ""
    style: dict = field(default_factory=dict)

    def names(self) -> list[str]:
        return [f.name for f in self.fields]


@dataclass(frozen=True)
class Layer:
    """Rows (fid, the fields, geom as WKB or null) and their description."""

    df: DataFrame
    meta: LayerMeta

    def with_df(self, df: DataFrame, **changes) -> Layer:
        return Layer(df, replace(self.meta, **changes))

    def require(self, name: str) -> Field:
        for f in self.meta.fields:
            if f.name == name:
                return f
        raise LayerError(f"no such field: {name}")

    def attributes(self) -> DataFrame:
        return self.df.select(FID, *self.meta.names())


def infer_fields(df: DataFrame, skip: Iterable[str] = (FID, GEOM)) -> tuple[Field, ...]:
    """Fields by the columns' types: numbers, booleans, everything else text."""
    out = []
    for name, kind in df.dtypes:
        if name not in skip:
            number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
            out.append(Field(name, "number" if number else "bool" if kind == "boolean" else "text"))
    return tuple(out)


def layer(df: DataFrame, name: str, crs: str = "", geometry_type: str = "", **more) -> Layer:
    return Layer(df, LayerMeta(name, crs, geometry_type, more.pop("fields", None) or infer_fields(df), **more))


def same_crs(a: str, b: str) -> bool:
    return a.strip().upper() == b.strip().upper()


def fail_if(df: DataFrame, message: str) -> None:
    """Raise if ``df`` has a row, naming the first one's values."""
    row = df.head(1)
    if row:
        raise LayerError(f"{message}: {', '.join(str(v) for v in row[0])}")


def empty_layer(spark, name: str, geometry_type: str, crs: str, fields: Iterable[Field] = ()) -> Layer:
    if geometry_type not in ("POINT", "LINESTRING", "POLYGON"):
        raise LayerError(f"unsupported geometry type: {geometry_type}")
    fields = tuple(fields)
    shape = ", ".join([f"{FID} long", *(f"`{f.name}` {TYPES[f.type]}" for f in fields), f"{GEOM} binary"])
    return Layer(spark.createDataFrame([], shape), LayerMeta(name, crs, geometry_type, fields))


def page(lay: Layer, offset: int, limit: int) -> tuple[DataFrame, int]:
    """One page of attributes in fid order, and the number of all rows; limit 1 to 1000, offset clamped.

    Where the ids are the places 1 to n, a page is a range of ids and no deep
    sort is made.
    """
    if not 1 <= limit <= 1000:
        raise LayerError("limit must be 1 to 1000")
    total, least, most = lay.df.agg(F.count("*"), F.min(FID), F.max(FID)).first()
    offset = max(0, min(offset, total))
    rows = lay.attributes()
    if total and (least, most) == (1, total):
        return rows.where(F.col(FID).between(offset + 1, offset + limit)).orderBy(FID), total
    return rows.orderBy(FID).offset(offset).limit(limit), total


def by_fid(lay: Layer, fid: int) -> DataFrame:
    return lay.df.where(F.col(FID) == fid)


def preview(lay: Layer, limit: int = 500) -> tuple[DataFrame, bool]:
    """The first features by id and whether there are more; the bound is the feature."""
    rows = lay.df.orderBy(FID).limit(limit + 1)
    return rows.limit(limit), rows.count() > limit

"""Layers by path: the format follows from the ending."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import FID, Layer, LayerError, layer
from . import cad, delimited, files, geojson

READABLE = (".gpkg", ".shp", ".geojson", ".json", ".geojsonl", ".ndjson", ".dxf", ".parquet")
WRITABLE = (".gpkg", ".shp", ".geojsonl", ".dxf", ".csv", ".parquet")


def _ending(path: str, known: tuple[str, ...]) -> str:
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if ending not in known:
        raise LayerError(f"unknown format: {path}")
    return ending


def layer_names(spark: SparkSession, path: str) -> list[str]:
    if _ending(path, READABLE) == ".gpkg":
        return [name for name, _, _ in files.geopackage_layers(spark, path)]
    return [os.path.splitext(os.path.basename(path.rstrip("/")))[0]]


def open_layer(spark: SparkSession, path: str, name: str = "", crs: str = "", encoding: str | None = None) -> Layer:
    """One layer; ``crs`` stands in where the source names none."""
    ending = _ending(path, READABLE)
    if ending == ".gpkg":
        found = files.read_geopackage(spark, path, name)
    elif ending == ".shp":
        found = files.read_shapefile(spark, path, crs, encoding)
    elif ending in (".geojson", ".json"):
        found = geojson.read_collection(spark, path, name=name or None)
    elif ending in (".geojsonl", ".ndjson"):
        found = geojson.read_sequence(spark, path, name=name or None)
    elif ending == ".dxf":
        found = cad.read_dxf(spark, path, encoding or "utf-8", crs)
    else:
        found = layer(spark.read.parquet(path), name or layer_names(spark, path)[0], crs, source=path)
    return found if found.meta.crs or not crs else found.with_df(found.df, crs=crs)


def open_all(spark: SparkSession, path: str, crs: str = "") -> dict[str, Layer]:
    """Every layer of a source, by name."""
    return {name: open_layer(spark, path, name, crs) for name in layer_names(spark, path)}


def save_layer(lay: Layer, path: str, name: str = "", encoding: str = "utf-8") -> None:
    """The layer written whole or not at all; other layers of a GeoPackage stay."""
    lay = lay.with_df(lay.df, name=name) if name else lay
    ending = _ending(path, WRITABLE)
    if ending == ".gpkg":
        files.write_geopackage(lay, path)
    elif ending == ".shp":
        files.write_shapefile(lay, path, encoding)
    elif ending == ".geojsonl":
        geojson.write_sequence(lay, path)
    elif ending == ".dxf":
        cad.write_dxf([lay], path, encoding)
    elif ending == ".csv":
        delimited.write_layer(lay, path)
    else:
        lay.df.write.mode("overwrite").parquet(path)


def stamp(spark: SparkSession, path: str) -> list[tuple[str, int, str]]:
    """(file, bytes, time of change) of a source's files, through Spark's own file listing."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").cast("string").alias("at"))
    return sorted((r["path"], r["length"], r["at"]) for r in rows.collect())


def check_unchanged(spark: SparkSession, path: str, before: list[tuple[str, int, str]]) -> None:
    if stamp(spark, path) != before:
        raise LayerError(f"source has changed: {path}")


def attributes_of(lay: Layer, fid: int) -> dict | None:
    """One feature's fields, or None."""
    row = lay.attributes().where(F.col(FID) == fid).head()
    return row.asDict() if row else None

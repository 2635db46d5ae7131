"""GeoJSON collections and line-delimited GeoJSON."""

from __future__ import annotations

import json
import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec
from ..functions.geometry import BINARY, bbox_of
from ..model import FID, GEOM, Layer, LayerError, LayerMeta, infer_fields
from ..operators.combine import numbered

#: Bytes of a feature and of its properties; more are an error, and nothing is left out.
MAX_FEATURE, MAX_PROPERTIES = 64 << 20, 8 << 20
MAX_DEPTH, MAX_NODES = 128, 100_000


@F.pandas_udf(BINARY)
def geometry_from(text: pd.Series) -> pd.Series:
    """WKB of a GeoJSON geometry's text, null for null; anything else is an error."""

    def one(value):
        try:
            value = None if value is None else json.loads(value)
            return None if value is None else codec.encode(codec.from_geojson(value))
        except (ValueError, KeyError, TypeError, IndexError) as e:
            raise ValueError(f"malformed geometry: {e}: {str(value)[:200]}") from e

    return text.map(one)


@F.pandas_udf(T.StringType())
def _checked_properties(text: pd.Series) -> pd.Series:
    """The properties' text as it is; too deep or too many values are an error."""

    def one(value):
        if value is None:
            return None
        # Brackets and commas bound depth and number from above, so most texts need no parsing.
        if value.count("{") + value.count("[") >= MAX_DEPTH or value.count(",") + value.count(":") >= MAX_NODES:
            level, nodes = [json.loads(value)], 0
            depth = 0
            while level:
                depth, nodes = depth + 1, nodes + len(level)
                if depth > MAX_DEPTH or nodes > MAX_NODES:
                    raise ValueError("properties are too complex")
                level = [x for v in level if isinstance(v, dict | list) for x in (v.values() if isinstance(v, dict) else v)]
        return value

    return text.map(one)


def _bounded(text: Column, most: int, what: str) -> Column:
    return F.when(F.octet_length(text) > most, F.raise_error(F.lit(f"{what}: more than {most} bytes")).cast("string")).otherwise(text)


def _properties(feature: Column) -> Column:
    return _checked_properties(_bounded(F.get_json_object(feature, "$.properties"), MAX_PROPERTIES, "properties"))


def crs_of(name: str | None) -> str:
    """The last EPSG code of a legacy ``crs`` member's name, else EPSG:4326."""
    codes = re.findall(r"EPSG:+([0-9]+)", name or "")
    return f"EPSG:{codes[-1]}" if codes else "EPSG:4326"


def _features(rows: DataFrame, properties: str | None) -> DataFrame:
    """(fid, the properties' fields, geom) from (fid, feature text); without a schema, the one that all features agree on."""
    text = _properties(F.col("feature"))
    if properties is None:
        # Properties that are no object have no fields and say nothing about the others'.
        texts = rows.select(text.alias("p")).where("p like '{%'").rdd.map(lambda r: r[0])
        properties = rows.sparkSession.read.json(texts, mode="DROPMALFORMED").schema
    elif properties == "struct<>":
        properties = None
    parsed = rows.select(FID, F.from_json(text, properties).alias("p") if properties else F.lit(None).alias("p"), geometry_from(F.get_json_object("feature", "$.geometry")).alias(GEOM))
    return parsed.select(FID, *(["p.*"] if properties else []), GEOM)


def parse_lines(lines: DataFrame, properties: str) -> DataFrame:
    """Features of lines (value) without ids: what batch and stream have in common."""
    text = F.regexp_replace("value", "^\\x1e", "")
    rows = lines.select(_bounded(text, MAX_FEATURE, "feature").alias("feature")).where(F.trim("feature") != "")
    return rows.select(
        F.from_json(_properties(F.col("feature")), properties).alias("p"), geometry_from(F.get_json_object("feature", "$.geometry")).alias(GEOM)
    ).select("p.*", GEOM)


def read_sequence(spark: SparkSession, path: str, properties: str | None = None, name: str | None = None) -> Layer:
    """Line- or RS-delimited features; split by Spark, numbered by their place in the file."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias(FID), _bounded(F.regexp_replace("value", "^\\x1e", ""), MAX_FEATURE, "feature").alias("feature"))
    rows = numbered(lines.where(F.trim("feature") != ""), "place").select(F.col("place").alias(FID), "feature")
    df = _features(rows, properties)
    return Layer(df, LayerMeta(name or _stem(path), "EPSG:4326", "", infer_fields(df), source=path))


def read_collection(spark: SparkSession, path: str, properties: str | None = None, name: str | None = None) -> Layer:
    """One FeatureCollection; a repeated ``features`` member and trailing text are errors."""

    def split(frames):
        for frame in frames:
            for content in frame["content"]:
                def once(pairs):
                    keys = [k for k, _ in pairs]
                    if keys.count("features") > 1:
                        raise ValueError("repeated features member")
                    return dict(pairs)

                document = json.loads(bytes(content).decode("utf-8-sig"), object_pairs_hook=once)
                if document.get("type") != "FeatureCollection":
                    raise ValueError("not a FeatureCollection")
                features = document["features"]
                yield pd.DataFrame({FID: range(1, len(features) + 1), "feature": [json.dumps(f, ensure_ascii=False) for f in features]})

    files = spark.read.format("binaryFile").load(path)
    head = files.select(F.get_json_object(F.decode("content", "UTF-8"), "$.crs.properties.name").alias("crs")).head()
    if head is None:
        raise LayerError(f"no such file: {path}")
    rows = files.select("content").mapInPandas(split, f"{FID} long, feature string")
    df = _features(rows, properties)
    crs = crs_of(head["crs"])
    return Layer(df, LayerMeta(name or _stem(path), crs, "", infer_fields(df), source=path))


def _stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0]


def as_features(lay: Layer) -> DataFrame:
    """(value): one GeoJSON feature's text for each row."""

    @F.pandas_udf("string")
    def shape(geom: pd.Series) -> pd.Series:
        return geom.map(lambda g: "null" if g is None else json.dumps(_geojson(codec.decode(g))))

    text: Column = F.concat(
        F.lit('{"type":"Feature","id":'), F.col(FID).cast("string"), F.lit(',"properties":'),
        F.to_json(F.struct(*[F.col(f"`{n}`") for n in lay.meta.names()]), {"ignoreNullFields": "false"}) if lay.meta.fields else F.lit("{}"),
        F.lit(',"geometry":'), shape(GEOM), F.lit("}"),
    )
    return lay.df.select(text.alias("value"))


def write_sequence(lay: Layer, path: str) -> None:
    as_features(lay).write.mode("overwrite").text(path)


def _geojson(geometry) -> dict:
    name, parts = geometry
    kind = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}
    if name == "GEOMETRYCOLLECTION":
        return {"type": "GeometryCollection", "geometries": [_geojson(p) for p in parts]}

    def xy(name, parts):
        if name == "POINT":
            return parts[0].tolist() if len(parts) else []
        if name == "LINESTRING":
            return parts.tolist()
        if name == "POLYGON":
            return [r.tolist() for r in parts]
        return [xy(n, p) for n, p in parts]

    return {"type": kind[name], "coordinates": xy(name, parts)}


def write_indexed(lay: Layer, path: str, cell: float) -> None:
    """Parquet with a ``bbox`` column, neighbours together: row groups' minima and maxima are the spatial index."""
    df = lay.df.withColumn("bbox", bbox_of(GEOM))
    df.withColumn("_x", F.floor(F.col("bbox.minx") / cell)).withColumn("_y", F.floor(F.col("bbox.miny") / cell)).repartitionByRange("_x", "_y").sortWithinPartitions(
        "_x", "_y"
    ).drop("_x", "_y").write.mode("overwrite").parquet(path)

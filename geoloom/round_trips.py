"""Queries that write a source or a sink and read it again, and the SQL of what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry
from .model import Layer, layer
from .operators import combine, overview, select, shapes, summarise
from .project import Project
from .queries import CUST, EVENTS, METRES, NATIONS, RECTS, customers, customers_xy, events_xy, nations, rects, register
from .sources import cad, catalog, delimited, files, geojson
from .sources.place import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that driver and executors share; where none is set, on one machine, in a temporary one."""
    return f"{shared_folder(spark)}/{name}"


def _points(lay: Layer) -> DataFrame:
    at = F.get(F.get(geometry.parts_of("geom"), F.lit(0)), F.lit(0))
    return lay.df.withColumn("p", at).select("fid", "c_name", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


_CUST_POINTS = f"SELECT fid, c_name, x, y FROM {CUST}"


def _plain(spark, sf_dir) -> Layer:
    rows = customers(spark, sf_dir).df.select("fid", "c_name", "c_acctbal", "geom")
    return layer(rows, "customers", METRES, "POINT")


@register(f"SELECT fid, c_name, x, y, c_acctbal FROM {CUST}")
def source_csv(spark, sf_dir):
    path = scratch(spark, "c.csv")
    delimited.write_report(customers_xy(spark, sf_dir).select("fid", "c_name", "c_acctbal", "x", "y"), path, ["fid"])
    got = delimited.read_points(spark, path, "x", "y", METRES, types={"c_acctbal": "number", "fid": "number"}).layer
    at = F.get(F.get(geometry.parts_of("geom"), F.lit(0)), F.lit(0))
    rows = got.df.where("fid = source_fid").withColumn("p", at)
    return rows.select("fid", "c_name", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "c_acctbal")


@register(f"SELECT count(*) AS accepted, CAST(0 AS BIGINT) AS rejected, max(fid) AS last FROM (SELECT fid FROM {CUST} UNION ALL SELECT fid + (SELECT count(*) FROM customer) FROM {CUST})")
def source_csv_several(spark, sf_dir):
    path = scratch(spark, "c.csv")
    delimited.write_report(customers_xy(spark, sf_dir).select("c_name", "x", "y"), path, ["c_name"])
    got = delimited.read_points(spark, [path, path], "x", "y", METRES)
    accepted, rejected = got.counts()
    return got.layer.df.agg(F.lit(accepted).cast("long").alias("accepted"), F.lit(rejected).cast("long").alias("rejected"), F.max("fid").alias("last"))


@register(f"SELECT r.fid, r.o_custkey, c.c_mktsegment FROM {RECTS} r LEFT JOIN customer c ON r.o_custkey = c.c_custkey")
def source_csv_table(spark, sf_dir):
    path = scratch(spark, "t.csv")
    delimited.write_report(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment"), path, ["c_custkey"])
    rows, _ = delimited.read_table(spark, path)
    return combine.join_table(rects(spark, sf_dir), rows, "o_custkey", "c_custkey").layer.df.select("fid", "o_custkey", "c_mktsegment")


@register(_CUST_POINTS)
def source_geojson_lines(spark, sf_dir):
    path = scratch(spark, "c.geojsonl")
    rows = _plain(spark, sf_dir)
    geojson.write_sequence(rows.with_df(rows.df.coalesce(1).sortWithinPartitions("fid")), path)
    return _points(geojson.read_sequence(spark, path))


@register(_CUST_POINTS)
def source_geopackage(spark, sf_dir):
    path = scratch(spark, "c.gpkg")
    files.write_geopackage(_plain(spark, sf_dir), path)
    return _points(catalog.open_all(spark, path)["customers"])


@register(f"SELECT fid, 2 * ((x1 - x0) + (y1 - y0)) AS length, (x1 - x0) * (y1 - y0) AS area FROM {RECTS}")
def source_shapefile(spark, sf_dir):
    path = scratch(spark, "r.shp")
    lay = rects(spark, sf_dir)
    files.write_shapefile(layer(lay.df.select("fid", F.col("o_orderstatus").alias("status"), "geom"), "rects", METRES, "POLYGON"), path)
    return summarise.measure(files.read_shapefile(spark, path, METRES)).df.select("fid", "length", "area")


@register(f"SELECT 'customers' AS layer, count(*) AS n, sum(x) AS x, sum(y) AS y FROM {CUST}")
def source_dxf(spark, sf_dir):
    path = scratch(spark, "c.dxf")
    cad.write_dxf([_plain(spark, sf_dir)], path)
    at = F.get(F.get(geometry.parts_of("geom"), F.lit(0)), F.lit(0))
    rows = cad.read_dxf(spark, path).df.withColumn("p", at)
    return rows.groupBy("layer").agg(F.count("*").alias("n"), F.sum("p.x").alias("x"), F.sum("p.y").alias("y"))


@register(f"SELECT fid, o_totalprice FROM {RECTS} WHERE x0 <= 3000 AND x1 >= 2000 AND y0 <= 4500 AND y1 >= 4000")
def source_indexed_window(spark, sf_dir):
    path = scratch(spark, "r.parquet")
    geojson.write_indexed(rects(spark, sf_dir), path, 512.0)
    return select.window(catalog.open_layer(spark, path, crs=METRES), 2000, 4000, 3000, 4500).df.select("fid", "o_totalprice")


@register(f"SELECT 'nations' AS name, 'POLYGON' AS geometry_type, '{METRES}' AS crs, min(x0) AS minx, min(y0) AS miny, max(x1) AS maxx, max(y1) AS maxy, count(*) AS count FROM {NATIONS}")
def source_overview(spark, sf_dir):
    return files.overview(nations(spark, sf_dir))


@register(f"SELECT fid, CASE WHEN fid = 3 THEN 'changed' ELSE c_name END AS c_name FROM {CUST} WHERE fid <> 5")
def project_saved(spark, sf_dir):
    """A draft published, saved with its layers and loaded again."""
    project = Project("p", METRES)
    project.publish(_plain(spark, sf_dir))
    with project:
        project.set_property("customers", 3, "c_name", "changed")
        project.delete_feature("customers", 5)
    path = scratch(spark, "p.json")
    project.save_all(path)
    return Project.open(spark, path).layer("customers").df.select("fid", "c_name")


# Operators that need no file.


@register(f"SELECT fid, 'POINT (' || CAST(x AS BIGINT) || ' ' || CAST(y AS BIGINT) || ')' AS wkt FROM {CUST}")
def wkt_round_trip(spark, sf_dir):
    text = F.concat(F.lit("point("), F.col("x").cast("string"), F.lit("  "), F.col("y").cast("string"), F.lit(" )"))
    return customers_xy(spark, sf_dir).withColumn("geom", geometry.from_wkt(text)).select("fid", geometry.to_wkt("geom").alias("wkt"))


@register(f"SELECT fid, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM {RECTS}")
def surface_points(spark, sf_dir):
    return rects(spark, sf_dir).df.select("fid", geometry.point_on_surface("geom").alias("p")).select("fid", "p.x", "p.y")


@register(f"SELECT fid, CASE WHEN x1 - x0 >= y1 - y0 THEN (x0 + x1) / 2 ELSE x1 END AS x, CASE WHEN x1 - x0 >= y1 - y0 THEN y0 ELSE (y0 + y1) / 2 END AS y, CASE WHEN x1 - x0 >= y1 - y0 THEN 0.0::DOUBLE ELSE 90 END AS angle FROM {RECTS}")
def longest_segments(spark, sf_dir):
    return rects(spark, sf_dir).df.select("fid", geometry.longest_segment("geom").alias("p")).select("fid", "p.x", "p.y", "p.angle")


@register(f"SELECT fid, CAST(2 AS BIGINT) AS triangles, round((x1 - x0) * (y1 - y0), 6) AS area FROM {NATIONS}")
def triangulated(spark, sf_dir):
    parts = nations(spark, sf_dir).df.select("fid", F.explode(geometry.triangles_of("geom")).alias("geom"))
    return parts.groupBy("fid").agg(F.count("*").alias("triangles"), F.round(F.sum(shapes.area_of("geom")), 6).alias("area"))


@register(f"SELECT fid, -10.0::DOUBLE AS minx, -20.0::DOUBLE AS miny, x1 AS maxx, y1 AS maxy FROM {NATIONS}")
def moved_vertices(spark, sf_dir):
    """The first corner of each boundary moved; the ring stays closed."""
    got = nations(spark, sf_dir).df.withColumn("geom", geometry.move_vertex(0, -10, -20)("geom"))
    return got.select("fid", geometry.bbox_of("geom").alias("b")).select("fid", "b.*")


@register(f"SELECT fid, c_name FROM {CUST} WHERE fid IN (SELECT 1 + i * ((SELECT count(*) FROM customer) - 1) // 9 FROM range(10) r(i))")
def even_sample(spark, sf_dir):
    df = customers(spark, sf_dir).df
    return select.sample_evenly(df, df.count(), 10).select("fid", "c_name")


@register(
    f"""SELECT count(*) AS edges, CAST(sum(x1 - x0 + y1 - y0) AS DOUBLE) AS length FROM (SELECT x0, y0, x1, y0 AS y1 FROM {NATIONS} UNION SELECT x0, y1, x1, y1 FROM {NATIONS}
 UNION SELECT x0, y0, x0, y1 FROM {NATIONS} UNION SELECT x1, y0, x1, y1 FROM {NATIONS})"""
)
def shared_edges(spark, sf_dir):
    from .operators import display

    edges = display.shared_edges_once(display.segments_of(nations(spark, sf_dir).df))
    return edges.agg(F.count("*").alias("edges"), F.sum(F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0")).alias("length"))


@register(f"SELECT fid, round((x - lx) / (hx - lx), 9) AS x, round((y - ly) / (hy - ly), 9) AS y FROM {CUST}, (SELECT min(x) lx, max(x) hx, min(y) ly, max(y) hy FROM {CUST})")
def normalised_points(spark, sf_dir):
    rows = customers_xy(spark, sf_dir)
    box = summarise.extent(customers(spark, sf_dir), pad=False).first()
    x, y = overview.normalised(F.col("x"), F.col("y"), tuple(box)[:4])
    return rows.select("fid", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"))


_CELL = "CAST(least(greatest(floor({0} / 10000 * 256), 0), 255) AS BIGINT)"


@register(
    f"""WITH d AS (SELECT {_CELL.format("x")} AS x, {_CELL.format("y")} AS y FROM {CUST}),
 s AS (SELECT level, x // (2 ** (8 - level))::BIGINT AS cx, y // (2 ** (8 - level))::BIGINT AS cy, count(*) AS features FROM d, range(9) r(level) GROUP BY ALL)
 SELECT s.level, s.cx, s.cy, s.features FROM s LEFT JOIN s p ON p.level = s.level - 1 AND p.cx = s.cx // 2 AND p.cy = s.cy // 2
 WHERE (s.level = 0 OR p.features > 40) AND (s.features <= 40 OR s.level = 8)"""
)
def dense_windows(spark, sf_dir):
    got = overview.dense_windows(customers(spark, sf_dir), (0.0, 0.0, 10000.0, 10000.0), 40)
    return got.select(*[F.col(c).cast("long").alias(c) for c in got.columns])


@register(f"SELECT fid, round(x * 6378137.0 * pi() / 180, 3) AS x, round(asinh(tan(y * pi() / 180)) * 6378137.0, 3) AS y FROM {EVENTS}")
def aligned_layers(spark, sf_dir):
    rows = events_xy(spark, sf_dir)
    lay = layer(rows.withColumn("geom", geometry.point("x", "y")).select("fid", "geom"), "events", "EPSG:4326", "POINT")
    moved = overview.aligned([lay], "EPSG:3857")[0].df
    at = F.get(F.get(geometry.parts_of("geom"), F.lit(0)), F.lit(0))
    return moved.withColumn("p", at).select("fid", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@register(
    f"""SELECT fid, 'x ' || c_name AS trimmed, c_mktsegment ILIKE '%build%' AS has, c_name LIKE '%9%' AS plain, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE c_name END AS filled,
 substr(c_name, 1, 3) || '|' || reverse(c_mktsegment) || '|' || CAST(length(c_name) AS BIGINT) AS cut FROM {CUST}"""
)
def rule_functions(spark, sf_dir):
    from .plans.rules import compile_rule, compile_text

    df = customers(spark, sf_dir).df.withColumn("maybe", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))
    return df.select(
        "fid",
        compile_text('return tools.trim("  x " .. feature.c_name .. "\\t ")', df).alias("trimmed"),
        compile_rule('return tools.contains(feature.c_mktsegment, "build", true)', df).alias("has"),
        compile_rule('return tools.contains(feature.c_name, "9")', df).alias("plain"),
        compile_text("return tools.coalesce(feature.maybe, feature.c_name)", df).alias("filled"),
        compile_text('return string.format("%s|%s|%d", string.sub(feature.c_name, 1, 3), string.reverse(feature.c_mktsegment), string.len(feature.c_name))', df).alias("cut"),
    )

"""The command line, sources by path, presentation, overviews and jobs."""

import csv
import json
import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from geoloom import cli
from geoloom.functions import codec, geometry
from geoloom.jobs import Job
from geoloom.model import LayerError, LayerMeta, layer, page, preview
from geoloom.operators import overview
from geoloom.plans import presentation
from geoloom.plans.rules import RuleError, compile_text
from geoloom.sources import catalog


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Eight wells in two fields, two fields' outlines, and a table of owners."""
    made = tmp_path_factory.mktemp("cli")
    rows = ["well,owner,depth,e,n", *(f"w{i},{'kim' if i % 2 else 'lee'},{10 * i},{(i % 4) * 10},{(i // 4) * 10 + (i % 3)}" for i in range(8)), "w9,kim,1,bad,2"]
    (made / "wells.csv").write_text("\n".join(rows) + "\n")
    (made / "owners.csv").write_text("who,phone\nkim,1\nchoi,2\n")
    edges = [{"type": "Feature", "properties": {"shape_id": s}, "geometry": {"type": "Polygon", "coordinates": [[[x, -1], [x + 18, -1], [x + 18, 14], [x, 14], [x, -1]]]}} for s, x in (("west", -1), ("east", 17))]
    (made / "edges.geojson").write_text(json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": "EPSG:5186"}}, "features": edges}))
    cli.run(spark, ["import-csv", "--input", f"{made}/wells.csv", "--output", f"{made}/w.gpkg", "--x-field", "e", "--y-field", "n", "--crs", "EPSG:5186", "--output-layer", "wells", "--boundary-group", "owner"])
    return made


def call(spark, folder, line):
    return cli.run(spark, [a.replace("@", f"{folder}/") for a in line.split()])


def rows_of(path):
    with open(path, newline="") as file:
        return list(csv.reader(file))


def test_import_reports_rejected_rows(spark, folder):
    assert catalog.layer_names(spark, f"{folder}/w.gpkg") == ["wells", "wells_boundary"]
    said = call(spark, folder, "import-csv --input @wells.csv --output @again.gpkg --x-field e --y-field n --crs EPSG:5186")
    assert said.startswith("8 features") and "row 9 line 10" in said
    assert {k: v.df.count() for k, v in catalog.open_all(spark, f"{folder}/w.gpkg").items()} == {"wells": 8, "wells_boundary": 2}


def test_convert_filter_script_merge(spark, folder):
    assert call(spark, folder, "convert --input @w.gpkg --layer wells --output @c.shp") == f"8 features written to {folder}/c.shp"
    assert call(spark, folder, "filter --input @w.gpkg --layer wells --field owner --value kim --output @k.geojsonl").startswith("4 ")
    (folder / "deep.lua").write_text("return tonumber(feature.depth) >= 50")
    assert call(spark, folder, "script --input @w.gpkg --layer wells --script @deep.lua") == "3 features"
    assert call(spark, folder, "merge --input @w.gpkg --input @w.gpkg --layer wells --layer wells --output @m.parquet").startswith("16 ")
    with pytest.raises(LayerError):
        call(spark, folder, "merge --input @w.gpkg --output @m.parquet")
    with pytest.raises(LayerError):
        call(spark, folder, "convert --input @w.gpkg --output @x.tif")


def test_join_aggregate_validate(spark, folder):
    said = call(spark, folder, "join --input @w.gpkg --layer wells --table @owners.csv --layer-key owner --table-key who --output @j.gpkg")
    assert json.loads(said.split("\n")[1]) == {"matched": 4, "unmatched_features": 4, "unmatched_rows": 1, "duplicate_rows": 0}
    call(spark, folder, "aggregate --input @w.gpkg --layer wells --group owner --sum depth --output @a.csv")
    assert rows_of(folder / "a.csv") == [["group", "count", "sum"], ["kim", "4", "160.0"], ["lee", "4", "120.0"]]
    assert call(spark, folder, "validate --input @w.gpkg --layer wells --required well --unique owner --output @v.csv").startswith("6 issues")
    assert [r[0] for r in rows_of(folder / "v.csv")[1:]] == ["3", "4", "5", "6", "7", "8"]


def test_shapes_by_command(spark, folder):
    call(spark, folder, "spatial --operation buffer --input @w.gpkg --layer wells --distance 2 --output @b.gpkg")
    said = call(spark, folder, "split-boundary --input @b.gpkg --boundary-file @edges.geojson --boundary-layer edges --output @s.gpkg")
    split = catalog.open_layer(spark, f"{folder}/s.gpkg").df.groupBy("shape_id").count().collect()
    assert {r.shape_id: r["count"] for r in split} == {"west": 4, "east": 4} and said.startswith("8 ")
    call(spark, folder, "polygon --input @w.gpkg --layer wells --feature-ids 1,2,6,5 --output @p.parquet")
    assert spark.read.parquet(f"{folder}/p.parquet").count() == 1
    call(spark, folder, "measure --input @p.parquet --crs EPSG:5186 --output @area.parquet")
    assert spark.read.parquet(f"{folder}/area.parquet").first().area > 0
    call(spark, folder, "create-layer --output @n.gpkg --output-layer empty --geometry-type polygon --crs EPSG:5186")
    assert catalog.open_layer(spark, f"{folder}/n.gpkg", "empty").df.count() == 0


def test_labels_by_command(spark, folder):
    call(spark, folder, "label --input @w.gpkg --layer wells --field well --output @l.parquet")
    assert spark.read.parquet(f"{folder}/l.parquet").where("label_text = well").count() == 8
    call(spark, folder, "label-field --input @w.gpkg --layer wells --field shown --template {well}/{id} --output @lf.parquet")
    assert {r.shown for r in spark.read.parquet(f"{folder}/lf.parquet").collect()} == {f"w{i}/{i + 1}" for i in range(8)}


def test_errors_and_options(spark, folder, capsys):
    assert cli.main(["convert", "--input", f"{folder}/none.gpkg", "--output", f"{folder}/x.gpkg"]) == 1
    for bad in ([], ["convert"], ["fly"], ["filter", "--input", "a"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)
    assert set(cli.COMMANDS) == {
        "convert", "spatial", "merge", "filter", "label", "script", "create-layer", "import-csv", "split-boundary", "join", "polygon",
        "label-field", "aggregate", "measure", "validate", "postgis-list", "postgis-import", "postgis-export", "postgis-insert", "postgis-delete",
    }


def test_source_changes_are_seen(spark, folder):
    path = folder / "t.geojsonl"
    path.write_text('{"type":"Feature","properties":{},"geometry":null}\n')
    before = catalog.stamp(spark, str(path))
    catalog.check_unchanged(spark, str(path), before)
    path.write_text('{"type":"Feature","properties":{"a":1},"geometry":null}\n')
    with pytest.raises(LayerError, match="changed"):
        catalog.check_unchanged(spark, str(path), before)
    db = sqlite3.connect(folder / "w.gpkg")
    assert db.execute("SELECT count(*) FROM gpkg_contents").fetchone()[0] == 2
    db.close()


def test_pages_and_previews(spark):
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(1, 31)], "fid long, name string")
    for df in (rows, rows.where("fid <> 4")):
        lay = layer(df, "l")
        ids = sorted(r.fid for r in df.collect())
        for offset, limit in ((0, 5), (10, 7), (28, 9), (99, 3)):
            got, total = page(lay, offset, limit)
            assert [r.fid for r in got.collect()] == ids[offset : offset + limit] and total == len(ids)
    first, more = preview(layer(rows, "l"), 3)
    assert [r.fid for r in first.collect()] == [1, 2, 3] and more


def test_settings(spark):
    assert presentation.Style().check().fill() == (0x35, 0x6B, 0x53, round(255 * 0.12))
    assert presentation.Style(line="#01020304").stroke("MULTILINESTRING") == (1, 2, 3, 4)
    for bad in ({"point": "red"}, {"line": "#12345"}, {"point_mm": 0}, {"line_mm": math.inf}, {"opacity": 1.5}):
        with pytest.raises(LayerError):
            presentation.Style(**bad).check()
    for bad in ({"placement": "left"}, {"direction": "UP"}, {"offset_mm": -1}, {"enabled": True}, {"height_mm": 0}, {"min_scale": 9, "max_scale": 2}):
        with pytest.raises(LayerError):
            presentation.Labels(**bad).check()
    assert presentation.Labels(enabled=True, rule="return 1", max_scale=5, min_scale=5).check().offset() == (1.5, -1.5)
    assert presentation.Labels(direction="SW", offset_mm=2).offset() == (-2, 2) and presentation.Labels(direction="").offset() == (1.5, -1.5)
    shown = presentation.with_defaults(LayerMeta("a", style={"style": presentation.Style(opacity=1)}))
    assert shown.style["style"].opacity == 1 and shown.style["labels"].placement == "center"


def test_levels_of_detail(spark):
    assert [overview.window_share(z) for z in (-10, 0, 1, 2, 4, 5, 6, 8, 9, 20)] == [2.0**-n for n in (5, 5, 6, 7, 7, 8, 9, 9, 10, 21)]
    assert [overview.stride(z) for z in (3, -1, -2, -6, -10)] == [1, 1, 8, 128, 256]
    assert [overview.stride(z, 1_000_000) for z in (0, 2, 3, 4, 5)] == [5, 1, 5, 2, 1] and overview.bucket_of(math.nan) == 0
    assert overview.dominant_fit([((0, 0, 10, 10), 1000), ((500, 0, 9000, 5), 5), ((20, 20, 30, 30), 5), (None, 9)]) == (0, 0, 30, 30)
    assert overview.dominant_fit([((0, 0, 10, 10), 1000), ((500, 0, 9000, 5), 500)]) == (0, 0, 9000, 10)
    tiles = [(x, y) for x in range(4) for y in range(4)]
    assert overview.tiles_of_layer(tiles, (0, 0, 100, 100), 0.25, (10, 10, 20, 30)) == [(0, 0), (0, 1)]
    assert overview.tiles_of_layer(tiles, (0, 0, 100, 100), 0.25, None) == tiles
    x, y = overview.normalised(F.lit(5.0), F.lit(7.0), (0, 7, 10, 7))
    assert spark.range(1).select(x, y).first()[:] == (0.5, 0.5)


def test_windows_are_cut_where_they_are_dense(spark):
    points = [(i + 1, float(i % 20) / 10, float(i // 20) / 10) for i in range(200)] + [(300, 90.0, 90.0)]
    df = spark.createDataFrame(points, "fid long, x double, y double").withColumn("geom", geometry.point("x", "y"))
    rows = overview.dense_windows(layer(df, "p"), (0, 0, 128, 128), 50, depth=7).collect()
    assert sum(r.features for r in rows) == 201 and all(r.features <= 50 or r.level == 7 for r in rows)
    assert (1, 1, 1, 1) in [tuple(r) for r in rows]


def test_layers_are_brought_to_one_system(spark):
    df = spark.createDataFrame([(1, 127.0, 38.0)], "fid long, x double, y double").withColumn("geom", geometry.point("x", "y")).drop("x", "y")
    here, there, none = layer(df, "a", "EPSG:5186"), layer(df, "b", "EPSG:4326"), layer(df, "c")
    moved = overview.aligned([here, there])
    assert [x.meta.crs for x in moved] == ["EPSG:5186"] * 2
    x, y = codec.decode(bytes(moved[1].df.first().geom))[1][0]
    assert abs(x - 200_000) < 1e-3 and abs(y - 600_000) < 1e-3
    with pytest.raises(LayerError, match="without a CRS"):
        overview.aligned([here, none])
    assert overview.aligned([none, none]) == [none, none]


def test_jobs(spark):
    job = Job(spark, "count", lambda: spark.range(1000).repartition(4).count())
    assert job.result(60) == 1000 and job.progress()[0] <= job.progress()[1]
    slow = Job(spark, "slow", lambda: spark.sparkContext.parallelize(range(4), 4).map(lambda _: __import__("time").sleep(15)).count())
    import time

    time.sleep(2)
    slow.cancel()
    with pytest.raises(Exception):
        slow.result(40)


def test_rule_texts(spark):
    df = spark.createDataFrame([("añb50%", 3.14159)], "name string, n double")
    value = lambda rule: df.select(compile_text(rule, df)).first()[0]
    assert value('return string.format("%s", "50%")') == "50%" and value('return string.format("%.2f|%s", feature.n, "a%d")') == "3.14|a%d"
    assert value('return string.sub("a" .. "ñb", 1, 3)') == "añ" and value('return string.sub("añb", 4, 4)') == "b" and value('return string.sub("abc", -2, -1)') == "bc"
    assert value("return tools.format_number(feature.n, 3)") == "3.142"
    with pytest.raises(RuleError):
        value("return string.format(feature.name, 1)")
    with pytest.raises(Exception, match="too long"):
        value('return string.rep("abcdefgh", 1000000)')
    with pytest.raises(RuleError, match="too long"):
        value("return 1 -- " + "x" * (1 << 20))

"""Operators, sources and projects on small fixtures."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoloom import round_trips
from geoloom.functions import batch, codec, geometry, tiling
from geoloom.model import Field, LayerError, empty_layer, layer, page
from geoloom.operators import combine, display, select, shapes, summarise
from geoloom.project import Project
from geoloom.sources import cad, database, delimited, files, geojson
from geoloom.streaming import features


def make(spark, rows, fields, crs="EPSG:5186", kind="POINT", name="layer"):
    names = ["fid", *[f.split()[0] for f in fields], "wkt"]
    df = spark.createDataFrame(rows, "fid long, " + "".join(f + ", " for f in fields) + "wkt string").toDF(*names)
    return layer(df.withColumn("geom", geometry.from_wkt("wkt")).drop("wkt"), name, crs, kind)


@pytest.fixture(scope="module")
def graded(spark):
    """Three trees of two kinds."""
    rows = [(1, "oak", "POINT (0 0)"), (2, "elm", "POINT (1 0)"), (3, "oak", "POINT (0 1)")]
    return make(spark, rows, ["grade string"])


def test_filter_and_split(graded):
    assert [r.fid for r in select.filter_rule(graded, 'return feature.grade ~= "elm"').df.orderBy("fid").collect()] == [1, 3]
    assert select.filter_property(graded, "grade", "elm").df.first().fid == 2
    parts = {p.meta.name: p.df.count() for p in select.split_rule(graded, 'return feature.grade == "oak" and "old" or feature.grade', "trees")}
    assert parts == {"trees_old": 2, "trees_elm": 1}
    with pytest.raises(LayerError):
        select.filter_property(graded, "height", "elm")


def test_remap_swaps(spark):
    lay = make(spark, [(7, "up", "down", "POINT (3 4)")], ["first string", "second string"])
    row = select.remap(lay, {"second": "first", "first": "second"}).df.first()
    assert (row["first"], row["second"], row["fid"]) == ("down", "up", 7)
    with pytest.raises(LayerError):
        select.remap(lay, {"first": "SECOND"})


def test_join_report_and_errors(spark, monkeypatch):
    stops = make(spark, [(i, code, f"POINT ({i} 5)") for i, code in enumerate(["N7", "S2", "N7", "", "W9", None, "N7"], 10)], ["code string"])
    rows = [("N7", "north"), ("S2", "south"), ("E4", "east"), ("E5", "east"), ("", "none"), (None, "none")]
    table = spark.createDataFrame(rows, "stop string, side string")
    for bound in (combine.is_small, lambda df: False):
        monkeypatch.setattr(combine, "is_small", bound)
        got = combine.join_table(stops, table, "code", "stop")
        assert {r.fid: r.side for r in got.layer.df.collect()} == {10: "north", 11: "south", 12: "north", 13: None, 14: None, 15: None, 16: "north"}
        assert tuple(got.report.first()) == (4, 3, 4, 0)
    with pytest.raises(LayerError, match="duplicate"):
        combine.join_table(stops, table.union(table), "code", "stop")
    with pytest.raises(LayerError, match="both sides"):
        combine.join_table(stops, table.withColumnRenamed("side", "Code"), "code", "stop")


def test_merge_and_append(spark, graded):
    with pytest.raises(LayerError, match="duplicate feature id"):
        combine.merge([graded, graded])
    assert sorted(r.fid for r in combine.append([graded, graded, graded]).df.collect()) == list(range(1, 10))
    far = make(spark, [(40, "ash", "POINT (8 8)"), (41, "ash", "POINT (8 9)")], ["grade string"], crs="")
    merged = combine.merge([far, graded])
    assert merged.df.count() == 5 and (merged.meta.name, merged.meta.crs) == ("layer_merged", "EPSG:5186")
    with pytest.raises(LayerError, match="CRS"):
        combine.merge([graded, far.with_df(far.df, crs="EPSG:4326")])


def test_validation(spark):
    lay = make(spark, [(1, "a", "POINT (0 0)"), (2, " ", "POINT (0 0)"), (3, "a", None), (4, None, "POINT EMPTY"), (5, None, "POINT (1 1)")], ["name string"])
    got = [(r.feature_id, r.rule, r.reason) for r in summarise.validate(lay, ["name"], ["name"]).orderBy("feature_id", "position").collect()]
    assert got == [
        (2, "required", "name is blank"), (2, "unique", "name is blank"), (3, "geometry", "geometry is missing"), (3, "unique", "name repeats feature 1"),
        (4, "required", "name is blank"), (4, "geometry", "geometry is invalid"), (5, "required", "name is blank"), (5, "unique", "name repeats feature 4"),
    ]


def test_measures(spark):
    line = make(spark, [(1, "LINESTRING (0 0, 10 0, 10 10)")], [], kind="LINESTRING")
    assert summarise.measure(line).df.select("length", "area").first()[:] == (20.0, 0.0)
    with pytest.raises(LayerError):
        summarise.measure(make(spark, [(1, "POINT (0 0)")], [], crs="EPSG:4326"))
    holed = make(spark, [(1, "POLYGON ((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1))")], [])
    with pytest.raises(Exception, match="without holes"):
        summarise.measure(holed).df.collect()


def test_totals_and_extent(spark, graded):
    assert [tuple(r) for r in summarise.group_totals(graded, "grade").collect()] == [("elm", 1, 0.0), ("oak", 2, 0.0)]
    with pytest.raises(Exception, match="not a number"):
        summarise.group_totals(graded, "grade", "grade").collect()
    one = make(spark, [(1, "POINT (5 5)")], [])
    assert tuple(summarise.extent(one).first()) == (-5.0, -5.0, 15.0, 15.0, 1)


def test_shapes(spark):
    points = make(spark, [(i + 1, "AB"[i % 2], f"POINT ({x} {y})") for i, (x, y) in enumerate([(0, 0), (9, 9), (1, 0), (8, 9), (1, 1), (9, 8), (0, 1), (8, 8), (0.5, 0.5)])], ["block string"])
    hulls = shapes.hull_by_group(points, "block").df.orderBy("fid").collect()
    assert [r.shape_id for r in hulls] == ["B000001", "B000002"]
    assert codec.to_wkt(codec.decode(bytes(hulls[0].geom))) == "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"
    with pytest.raises(LayerError):
        shapes.hull_by_group(make(spark, [(i, "A", f"POINT ({i} {i})") for i in range(4)], ["block string"]), "block")
    ring = shapes.polygon_from(points, [1, 3, 7]).df.first().geom
    assert codec.to_wkt(codec.decode(bytes(ring))) == "POLYGON ((0 0, 1 0, 0 1, 0 0))"
    two = make(spark, [(1, "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"), (2, "POLYGON ((2 0, 4 0, 4 2, 2 2, 2 0))")], [], kind="POLYGON")
    total = shapes.outline_totals(shapes.dissolve_coverage(two.df)).first()
    assert (total.length, total.area) == (12.0, 8.0)
    box = make(spark, [(1, "S", "POLYGON ((1 1, 3 1, 3 3, 1 3, 1 1))")], ["shape_id string"], kind="POLYGON", name="b")
    split = shapes.boundary_split(two, box, 4.0).df.select("fid", geometry.to_wkt("geom").alias("w")).collect()
    assert {r.fid for r in split} == {1, 2}
    touch = make(spark, [(1, "S", "POLYGON ((4 2, 6 2, 6 4, 4 4, 4 2))")], ["shape_id string"], kind="POLYGON")
    assert shapes.boundary_split(two, touch, 4.0).df.count() == 0


def areas(lay):
    return {r.fid: round(r.a, 6) for r in lay.df.select("fid", shapes.area_of("geom").alias("a")).collect()}


def test_overlay_operations(spark):
    left = make(spark, [(1, "x", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"), (2, "y", "POLYGON ((0 0, 6 0, 6 6, 0 6, 0 0), (2 2, 2 4, 4 4, 4 2, 2 2))")], ["k string"], kind="POLYGON")
    right = make(spark, [(5, "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))"), (9, "POLYGON ((3 3, 9 3, 9 9, 3 9, 3 3))")], [], kind="POLYGON")
    assert areas(shapes.spatial("intersect", [left, right])) == {1: 4.0, 2: 8.0}
    assert areas(shapes.spatial("union", [left, right])) == {1: 28.0, 2: 60.0}
    assert areas(shapes.spatial("difference", [left, right])) == {1: 12.0, 2: 24.0}
    apart = make(spark, [(i, f"POLYGON (({x} 0, {x + 1} 0, {x} 1, {x} 0))") for i, x in ((1, 50), (2, 60))], [], kind="POLYGON")
    got = shapes.spatial("intersect", [left, apart]).df.select("k", geometry.to_wkt("geom").alias("w")).collect()
    assert {(r.k, r.w) for r in got} == {("x", "POLYGON EMPTY"), ("y", "POLYGON EMPTY")}
    for bad in (("xor", [left, right]), ("union", [left]), ("buffer", [left])):
        with pytest.raises(LayerError):
            shapes.spatial(*bad)
    with pytest.raises(LayerError, match="CRS"):
        shapes.spatial("union", [left, right.with_df(right.df, crs="EPSG:4326")])


def test_buffers(spark):
    import math

    lay = make(spark, [(1, "POINT (3 3)"), (2, "LINESTRING (0 0, 10 0)"), (3, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"), (4, None)], [], kind="POINT")
    disc = 16 * math.sin(math.pi / 16)
    got = {r.fid: r.a for r in shapes.buffer(lay, 1.0).df.where("geom is not null").select("fid", shapes.area_of("geom").alias("a")).collect()}
    assert got == pytest.approx({1: disc, 2: disc + 20, 3: disc + 32}, abs=1e-6)
    shrunk = shapes.buffer(lay, -1.0).df.where("geom is not null").select("fid", geometry.to_wkt("geom").alias("w")).collect()
    assert [(r.fid, r.w) for r in shrunk] == [(3, "POLYGON ((1 1, 3 1, 3 3, 1 3, 1 1))")]
    with pytest.raises(LayerError):
        shapes.buffer(lay, 0)


def test_dissolve_and_split_of_any_shape(spark):
    cells = [(i + 1, "ab"[i % 2], f"POLYGON (({x} {y}, {x + 2} {y}, {x + 2} {y + 2}, {x} {y + 2}, {x} {y}))") for i, (x, y) in enumerate((x, y) for x in (0, 2, 4) for y in (0, 2, 4) if (x, y) != (2, 2))]
    lay = make(spark, cells, ["block string"], kind="POLYGON")
    whole = shapes.dissolve(lay, 2.0)
    row = whole.df.select(geometry.to_wkt("geom")).first()[0]
    assert row == "MULTIPOLYGON (((0 0, 6 0, 6 6, 0 6, 0 0), (2 2, 2 4, 4 4, 4 2, 2 2)))"
    assert areas(shapes.dissolve(lay, 2.0, "block", rounds=1)) == {1: 16.0, 2: 16.0}
    assert shapes.dissolve(lay, 2.0, outline=True).df.select(geometry.to_wkt("geom")).first()[0].startswith("MULTILINESTRING ((0 0, 6 0")
    bend = make(spark, [(1, "S", "POLYGON ((-1 -1, 7 -1, 7 1, 1 1, 1 7, -1 7, -1 -1))")], ["shape_id string"], kind="POLYGON")
    got = areas(shapes.boundary_split(lay, bend, 4.0))
    assert got == {1: 3.0, 2: 2.0, 3: 2.0, 4: 2.0, 6: 2.0}


def test_overlay_against_a_raster():
    """Random simple polygons, with several on a side, against parity on a grid of places."""
    import random

    import numpy as np

    from geoloom.functions import overlay, planar

    rng = random.Random(21)
    at = (np.arange(120) + 0.5) / 120 * 16 - 8
    x, y = np.meshgrid(at, at)

    def star():
        while True:
            turns, cx, cy = sorted(rng.random() * 6.283 for _ in range(rng.randint(3, 12))), rng.uniform(-2, 2), rng.uniform(-2, 2)
            ring = planar.simple_ring([(cx + r * np.cos(t), cy + r * np.sin(t)) for t in turns for r in [rng.uniform(1, 5)]])
            if ring:
                return [np.array(ring)]

    def raster(polygons):
        out = np.zeros(x.shape, bool)
        for p in polygons:
            odd = np.zeros(x.shape, int)
            for ring in p:
                for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:]):
                    if y0 != y1:
                        odd += ((y0 > y) != (y1 > y)) & (x0 + (y - y0) * (x1 - x0) / (y1 - y0) > x)
            out |= odd % 2 == 1
        return out

    for _ in range(25):
        a, b = [star() for _ in range(rng.randint(1, 3))], [star() for _ in range(rng.randint(1, 2))]
        ra, rb = raster(a), raster(b)
        for found, want in ((overlay.union(a, b), ra | rb), (overlay.intersection(a, b), ra & rb), (overlay.difference(a, b), ra & ~rb)):
            assert (raster(found) != want).sum() == 0


def test_batch_decoding_equals_the_codec():
    """Types mixed in one column, nulls, broken bytes, empty and three-dimensional geometries."""
    import struct

    import pyarrow as pa

    from geoloom.functions import batch

    texts = ["POINT (1 2)", "POINT EMPTY", "LINESTRING (0 0, 3 4, 3 5)", "POLYGON ((0 0, 4 0, 4 4, 0 0))", "POLYGON ((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOINT (1 1, 2 2)", "GEOMETRYCOLLECTION (POINT (5 5))"]
    column = [codec.encode(codec.parse_wkt(t)) for t in texts] + [None, b"", b"\x01\x02", struct.pack("<BI3d", 1, 1001, 7, 8, 9)]
    for order in (column, column[::-1], column[1:2] * 2, column[:1] * 3, []):
        d = batch.decode_all(pa.array(order, pa.binary()))
        want = []
        for data in order:
            try:
                want.append(None if data is None else [x.tolist() for x in codec.lines(codec.decode(data))])
            except codec.GeometryError:
                want.append(None)
        got = batch.nested(d).to_pylist()
        assert [None if g is None else [[[p["x"], p["y"]] for p in s] for s in g] for g in got] == want
        boxes = batch.bounds(d).to_pylist()
        assert [b["minx"] is None for b in boxes] == [not w for w in want]
    one = batch.metrics(batch.decode_all(pa.array(column, pa.binary()))).to_pylist()
    assert [r["length"] for r in one[:4]] == [0.0, 0.0, 6.0, 8.0 + 32**0.5] and one[3]["area"] == 8.0 and one[7]["sequences"] is None


def test_display(spark, graded):
    view = display.Viewport(0, 0, 1, 512, 512)
    tiles = display.visible_tiles(view)
    assert len(tiles) == 25 and display.by_distance(tiles, view)[0] in {(0, -1, -1), (0, -1, 0), (0, 0, -1), (0, 0, 0)}
    assert display.hit(graded, 0.9, 0.1, 0.5).first().fid == 2
    assert display.hit(graded, 50, 50, 0.5).count() == 0
    labelled = display.label_field(graded, "grade").df.select("fid", "label.*")
    placed = display.place_labels(labelled.select("fid", "text", "x", "y"), view, 50)
    assert [r.fid for r in placed.collect()] == [1]
    segments = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 10.0, 0.0, 0.0, 0.0)], "fid long, x0 double, y0 double, x1 double, y1 double")
    assert display.shared_edges_once(segments).count() == 1
    assert display.tile_segments(segments.where("fid = 1"), 4.0).agg(F.sum(F.col("x1") - F.col("x0"))).first()[0] == 10.0
    steep = [(1, 0.5, 0.5, 0.5, 30.0), (2, -3.0, 9.0, 11.0, -5.0), (3, 4.0, 4.0, 8.0, 8.0), (4, 2.0, 2.0, 2.0, 2.0), (5, 8.0, 1.0, 8.0, 3.0)]
    cut = display.tile_segments(spark.createDataFrame(steep, segments.schema), 4.0).collect()
    length = lambda r: ((r.x1 - r.x0) ** 2 + (r.y1 - r.y0) ** 2) ** 0.5
    for fid, x0, y0, x1, y1 in steep:
        assert sum(length(r) for r in cut if r.fid == fid) == pytest.approx(((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5)
    assert {(r.tx, r.ty) for r in cut if r.fid == 1} == {(0, i) for i in range(8)} and {(r.tx, r.ty) for r in cut if r.fid == 3} == {(1, 1)}
    assert {(r.tx, r.ty) for r in cut if r.fid == 5} == {(2, 0)} and len([r for r in cut if r.fid == 2]) <= 8


def test_tile_totals(spark):
    """The totals of ``tile_segments`` for lines in all directions, through corners, along borders and far beyond a tile."""
    rng = np.random.default_rng(5)
    lines = [rng.integers(-60, 60, (rng.integers(2, 6), 2)) * step for step in (1.0, 4.0, 0.37) for _ in range(150)]
    lines += [np.array(x, float) for x in ([[4, 4], [4, 400]], [[-400, 8], [8, 8]], [[0, 0], [400, 400]], [[400, -400], [0, 0]], [[2, 2], [2, 2]], [[3, 3]], [[0, 1], [4000, 2]], [[1, 4000], [2, 0]])]
    data = [(i, codec.encode(("LINESTRING", x))) for i, x in enumerate(lines)]
    data += [(1000, codec.encode(("MULTILINESTRING", [("LINESTRING", lines[0]), ("LINESTRING", lines[1])]))), (1001, None), (1002, b"no geometry"), (1003, codec.encode(("LINESTRING", [])))]
    data += [(1004, codec.encode(("LINESTRING", [[0, 0], [np.nan, 3]])))]
    df = spark.createDataFrame(data, "fid long, geom binary")
    parts = display.tile_segments(display.segments_of(df.where("fid < 1004")), 4.0)
    want = parts.groupBy("tx", "ty").agg(F.count("*").alias("n"), F.sum(F.expr("sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))")).alias("length"))
    want = {(r.tx, r.ty): (r.n, r.length) for r in want.collect()}
    got = {(r.tx, r.ty): (r.n, r.length) for r in display.tile_totals(df, 4.0).collect()}
    assert got.keys() == want.keys() and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-8) for k in want)
    assert display.tile_totals(df.where("fid >= 1001"), 4.0).count() == 0
    # In boxes of a few tiles, or of none.
    ends = tiling.segments(batch.decode_all(pa.array([g for i, g in data[: len(lines)]], pa.binary())))
    for tiles in (tiling.TILES, 300, 1):
        sums, handed_on = tiling.Sums(tiles), []
        for event in tiling.events(*ends, 4.0):
            handed_on += sums.add(*event)
        handed_on += sums.rest()
        assert (len(handed_on) > 4) == (tiles < tiling.TILES)
        total = {}
        for axis, across, along, values in handed_on:
            for at, row in zip(zip([axis] * len(across), across.tolist(), along.tolist(), strict=True), values.T, strict=True):
                total[at] = total.get(at, 0) + row
        total = {k: v for k, v in total.items() if v[[0, 2, 4]].any()}
        first = total if tiles == tiling.TILES else first
        assert total.keys() == first.keys() and all(np.allclose(total[k], first[k]) for k in first)


def test_tile_totals_of_long_lines(spark):
    """300 million tiles crossed, in 100,000 tiles: only the runs are made."""
    df = spark.range(3000).select(F.col("id").alias("fid"), F.lit(codec.encode(("LINESTRING", [[0, 1], [400_000, 1]]))).alias("geom"))
    got = display.tile_totals(df, 4.0).agg(F.count("*"), F.min("n"), F.max("n"), F.min("length"), F.max("length")).first()
    assert tuple(got) == (100_000, 3000, 3000, 12_000.0, 12_000.0)


def test_lines_of_points(spark):
    rows = [(1, [(1.0, 2.0), (3.5, -4.0)]), (2, None), (3, []), (4, [(0.0, None)]), (5, [(7.0, 8.0)] * 3)]
    df = spark.createDataFrame(rows, "fid long, p array<struct<x double, y double>>").coalesce(1)
    got = {r.fid: r.g for r in df.select("fid", geometry.line("p").alias("g")).collect()}
    nan = [(0.0, float("nan"))]
    assert got == {i: None if p is None else codec.encode(("LINESTRING", nan if i == 4 else p)) for i, p in rows}


def test_pages_and_empty_layers(spark, graded):
    rows, total = page(graded, 1, 5)
    assert ([r.fid for r in rows.collect()], total) == ([2, 3], 3)
    assert empty_layer(spark, "new", "POLYGON", "EPSG:5186", [Field("a", "number")]).df.count() == 0
    with pytest.raises(LayerError):
        empty_layer(spark, "new", "CIRCLE", "")


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,x,y,ok\n0012,1,2,true\n\nb,bad,3,\n\"c\nd\",4,5,x\ne,6,7,\nf,8\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,x,y,ok\ng,9,9,false\n", encoding="utf-8")
    got = delimited.read_points(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "x", "y", types={"ok": "bool"})
    assert [(r.fid, r.id, r.ok) for r in got.layer.df.orderBy("fid").collect()] == [(1, "0012", True), (4, "e", None), (5, "g", False)]
    bad = [(r.row, r.line, r.reason) for r in got.diagnostics().collect()]
    assert bad == [(2, 4, "coordinates are not finite numbers"), (3, 5, "ok: not a bool"), (5, 8, "wrong number of fields")]
    (tmp_path / "k.csv").write_bytes("이름,x,y\n서울,1,2\n".encode("cp949"))
    assert delimited.read_points(spark, str(tmp_path / "k.csv"), "x", "y", encoding="EUC-KR").layer.df.first()["이름"] == "서울"
    delimited.write_layer(got.layer, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns[-1] == "WKT"


@pytest.mark.parametrize(("seed", "size"), [(1, 64), (2, 200), (3, 1000), (4, 37)])
def test_delimited_in_blocks(spark, tmp_path, seed, size):
    """Quoted cells with line ends, blank lines and broken records, cut into blocks anywhere."""
    import csv
    import random

    rng, text = random.Random(seed), "id,x,y,note\r\n"
    cells = ["plain", '"a, b"', '"line\nend"', '"said ""so"""', "", '"\n\n"', '"long ' + "x" * 90 + '\nmore"', "é", 'bad"quote', '"bad"quote']
    for i in range(120):
        text += rng.choice([f"{i},{i},1,{rng.choice(cells)}\n"] * 8 + ["\n", f"{i},oops\r\n", "\r\n"])
    text += '9,9,9,"never closed\nat the end'
    (tmp_path / "a.csv").write_text(text, encoding="utf-8", newline="")
    want, reader, row, line = {}, csv.reader(text.removesuffix("\n").splitlines(keepends=True), strict=True), -1, 1
    lines = [x + "\n" for x in text.split("\n")]
    reader = csv.reader(lines, strict=True)
    while True:
        try:
            found, problem = next(reader), None
        except StopIteration:
            break
        except csv.Error as e:
            found, problem = [], str(e)
        start, line = line, reader.line_num + 1
        if found or problem:
            row += 1
            want[row] = (start, found if problem is None else [], problem)
    settings = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        names, rows = delimited.records(spark, str(tmp_path / "a.csv"))
        got = rows.collect()
        blocks = delimited._lines(spark, str(tmp_path / "a.csv")).select("block").distinct().count()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert names == ["id", "x", "y", "note"] and blocks > min(2, len(text) // size)
    assert sorted(r.row for r in got) == sorted(want.keys() - {0})
    for r in got:
        start, cells, problem = want[r.row]
        assert (r.line, r.cells) == (start, cells) and (r.problem is None) == (problem is None and len(cells) == 4), r


def test_geojson(spark, tmp_path):
    feature = lambda i, g: {"type": "Feature", "properties": {"name": f"n{i}", "angle": i}, "geometry": g}
    shapes_ = [{"type": "Point", "coordinates": [1, 2]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, None]
    items = [feature(i, g) for i, g in enumerate(shapes_)]
    (tmp_path / "s.geojson").write_text(json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::5186"}}, "features": items}))
    lay = geojson.read_collection(spark, str(tmp_path / "s.geojson"))
    assert lay.meta.crs == "EPSG:5186" and lay.meta.names() == ["angle", "name"]
    assert [r.w for r in lay.df.orderBy("fid").select(geometry.to_wkt("geom").alias("w")).collect()] == ["POINT (1 2)", "POLYGON ((0 0, 1 0, 1 1, 0 0))", None]
    (tmp_path / "s.geojsonl").write_text("\n".join("\x1e" + json.dumps(i) for i in items))
    seq = geojson.read_sequence(spark, str(tmp_path / "s.geojsonl"))
    assert [(r.fid, r.name) for r in seq.df.orderBy("fid").collect()] == [(1, "n0"), (2, "n1"), (3, "n2")]
    geojson.write_sequence(seq, str(tmp_path / "again"))
    again = geojson.read_sequence(spark, str(tmp_path / "again"))
    assert again.df.count() == 3
    geojson.write_indexed(seq, str(tmp_path / "indexed"), 10.0)
    assert select.window(layer(spark.read.parquet(str(tmp_path / "indexed")), "i"), 0, 0, 1, 1).df.count() == 1
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.geojsonl").write_text(json.dumps(items[0]) + "\n")
    query = features.read_stream(spark, str(tmp_path / "in"), "name string, angle long").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("seen").first().name == "n0"


@pytest.mark.parametrize(("kind", "wkt"), [("POINT", "POINT (1 2)"), ("LINESTRING", "LINESTRING (0 0, 1 1)"), ("POLYGON", "POLYGON ((0 0, 0 1, 1 1, 0 0))")])
def test_geopackage_and_shapefile(spark, tmp_path, kind, wkt):
    lay = make(spark, [(1, "a", 1.5, True, wkt), (2, None, None, None, None)], ["name string", "n double", "ok boolean"], kind=kind, name="roads")
    path = str(tmp_path / "x.gpkg")
    files.write_geopackage(lay, path)
    files.write_geopackage(lay.with_df(lay.df, name="more"), path)
    assert [x[0] for x in files.geopackage_layers(spark, path)] == ["more", "roads"]
    back = files.read_geopackage(spark, path, "roads")
    assert back.meta.crs == "EPSG:5186"
    rows = back.df.orderBy("fid").select("name", "n", "ok", geometry.to_wkt("geom").alias("w")).collect()
    assert [tuple(r) for r in rows] == [("a", 1.5, True, wkt), (None, None, None, None)]
    shp = str(tmp_path / "x.shp")
    files.write_shapefile(lay, shp)
    back = files.read_shapefile(spark, shp)
    row = back.df.orderBy("fid").select("name", "n", "ok", geometry.to_wkt("geom").alias("w")).first()
    assert back.meta.geometry_type == kind and tuple(row) == ("a", 1.5, True, wkt)
    with pytest.raises(LayerError):
        files.write_geopackage(lay.with_df(lay.df, geometry_type="MULTIPOINT"), path)
    with pytest.raises(LayerError):
        files.check_dbf_names([Field("a"), Field("A")])


def test_drawings(spark, tmp_path, graded):
    path = str(tmp_path / "x.dxf")
    cad.write_dxf([display.label_field(graded, "grade")], path)
    got = cad.read_dxf(spark, path)
    assert got.df.where("layer = 'layer'").count() == 3 and got.df.where("text = 'oak'").count() == 2
    with pytest.raises(LayerError):
        cad.write_dxf([graded, graded], path)


def test_drawings_open_fill_and_align(spark, tmp_path, graded):
    rings = make(spark, [(1, "POLYGON ((0 0, 8 0, 8 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))")], [], kind="POLYGON", name="areas")
    path = tmp_path / "f.dxf"
    cad.write_dxf([display.label_field(graded, "grade"), rings], str(path), fill=True, direction="SW", offset=2)
    rows = path.read_text().split("\n")
    groups = list(zip(rows[::2], rows[1::2]))
    at = groups.index(("9", "$EXTMAX"))
    assert groups[at + 1 : at + 3] == [("10", "8"), ("20", "4")] and ("2", "*ACTIVE") in groups and groups[groups.index(("2", "*ACTIVE")) + 6][0] == "12"
    hatch = groups[groups.index(("0", "HATCH")) :]
    assert ("91", "2") in hatch and [v for c, v in hatch if c == "93"] == ["4", "3"]
    texts = [i for i, g in enumerate(groups) if g == ("0", "TEXT")]
    assert len(texts) == 3 and groups[texts[0] + 4 : texts[0] + 6] == [("72", "2"), ("73", "3")]
    assert [float(groups[texts[1] + k][1]) for k in (2, 3)] == [-1.0, -2.0]
    assert cad.read_dxf(spark, str(path)).df.where("layer = 'areas'").count() == 2
    with pytest.raises(LayerError):
        cad.write_dxf([graded], str(path), direction="UP")


def test_database_texts(graded):
    assert database.quoted("a.b") == '"a"."b"' and database.srid("epsg:5186") == 5186
    for bad in ("a.b.c", "a;b", "1a", "x" * 64):
        with pytest.raises(LayerError):
            database.quoted(bad)
    assert [s.split()[0] for s in database.replace_statements("t", "s", "EPSG:5186")] == ["CREATE", "DELETE", "INSERT", "DROP"]
    assert [s.split()[0] for s in database.append_statements("t", "s", "EPSG:5186")] == ["CREATE", "INSERT", "DROP"]
    assert database.delete_statement("a.t", 7) == 'DELETE FROM "a"."t" WHERE id = 7'
    assert "HAVING" in database.catalog_query() and "LIMIT 20" in database.page_query("t", 5, 20)
    assert "ST_Intersects" in database.scan_query("t", (0, 0, 1, 1), "EPSG:4326")
    assert [r.properties for r in database.as_rows(graded).orderBy("id").limit(1).collect()] == ['{"grade":"oak"}']


def test_project(graded, tmp_path):
    project = Project("p", "EPSG:5186")
    project.publish(graded)
    with pytest.raises(LayerError):
        with project:
            project.set_property("layer", 1, "grade", "Z")
            project.delete_feature("layer", 77)
    assert project.layer("layer").df.where("grade = 'Z'").count() == 0
    with project:
        project.set_property("layer", 1, "grade", "Z")
        project.add_feature("layer", {"fid": 9, "grade": "N"})
        project.move_vertex("layer", 2, 0, 7, 7)
        project.rename("layer", "Shown")
        project.lock_geometry("layer")
    df = project.layer("layer").df
    assert df.where("grade = 'Z'").count() == 1 and df.count() == 4
    assert df.where("fid = 2").select(geometry.to_wkt("geom")).first()[0] == "POINT (7 7)"
    with pytest.raises(LayerError), project:
        project.set_geometry("layer", 1, b"")
    project.save(str(tmp_path / "p.json"))
    assert Project.load(str(tmp_path / "p.json"))[2][0].display_name == "Shown"


def test_geojson_fails_rather_than_leaves_out(spark, tmp_path, monkeypatch):
    deep = {"a": 1}
    for _ in range(140):
        deep = {"d": deep}
    wide = {"list": list(range(100_001))}
    good = {"type": "Feature", "properties": {"a": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    for bad in ({"type": "Point"}, {"type": "Circle", "coordinates": [1, 2]}, {"type": "Point", "coordinates": ["x", 2]}, 7):
        (tmp_path / "g.geojsonl").write_text("\n".join(json.dumps(x) for x in (good, good | {"geometry": bad})))
        with pytest.raises(Exception, match="malformed geometry"):
            geojson.read_sequence(spark, str(tmp_path / "g.geojsonl")).df.collect()
    for bad in (deep, wide):
        (tmp_path / "p.geojsonl").write_text("\n".join(json.dumps(x) for x in (good, good | {"properties": bad})))
        with pytest.raises(Exception, match="too complex"):
            geojson.read_sequence(spark, str(tmp_path / "p.geojsonl"), "a long").df.collect()
    (tmp_path / "g.geojsonl").write_text(json.dumps(good))
    monkeypatch.setattr(geojson, "MAX_FEATURE", 20)
    with pytest.raises(Exception, match="more than 20 bytes"):
        geojson.read_sequence(spark, str(tmp_path / "g.geojsonl"), "a long").df.collect()
    monkeypatch.undo()
    late = {"type": "FeatureCollection", "features": [good | {"properties": {"pad": "x" * 70_000}}], "crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}}
    (tmp_path / "late.geojson").write_text(json.dumps(late))
    assert geojson.read_collection(spark, str(tmp_path / "late.geojson")).meta.crs == "EPSG:3857"


def test_geojson_schema_covers_all_features(spark, tmp_path):
    """A property that comes late, a type that changes late, and properties that are no object."""
    items = [{"type": "Feature", "properties": {"n": i}, "geometry": None} for i in range(1200)]
    items += [{"type": "Feature", "properties": {"n": "text", "late": {"x": 1}}, "geometry": None}, {"type": "Feature", "properties": [{"no": 1}], "geometry": None}]
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": items}))
    (tmp_path / "s.geojsonl").write_text("\n".join(json.dumps(i) for i in items))
    for lay in (geojson.read_collection(spark, str(tmp_path / "c.geojson")), geojson.read_sequence(spark, str(tmp_path / "s.geojsonl"))):
        assert lay.df.columns == ["fid", "late", "n", "geom"]
        rows = {r.fid: r for r in lay.df.collect()}
        assert len(rows) == 1202 and [rows[i + 1].n for i in range(1200)] == [str(i) for i in range(1200)]
        assert rows[1201].n == "text" and rows[1201].late.x == 1 and rows[1202].n is None


def test_files_are_written_where_executors_find_them(spark, tmp_path, graded):
    """In the shared folder even on one machine, since executors may have temporary folders of their own; and in stores that only Hadoop opens."""
    assert round_trips.scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./d", f"file://{tmp_path}")
    points = layer(graded.df.select("fid", "geom"), "points", "EPSG:5186", "POINT")
    for folder in (f"file://{tmp_path}", "viewfs://store/d"):
        for _ in range(2):
            delimited.write_report(graded.df.select("fid", "grade"), f"{folder}/t.csv", ["fid"])
            files.write_geopackage(points, f"{folder}/p.gpkg")
            files.write_shapefile(points, f"{folder}/p.shp")
            cad.write_dxf([points], f"{folder}/p.dxf")
        assert delimited.read_table(spark, f"{folder}/t.csv")[0].count() == 3
        assert files.read_geopackage(spark, f"{folder}/p.gpkg").df.count() == 3
        assert files.read_shapefile(spark, f"{folder}/p.shp").df.count() == 3
        assert cad.read_dxf(spark, f"{folder}/p.dxf").df.count() == 3
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".new")]


def test_shapefiles_are_read_in_pieces(spark, tmp_path, monkeypatch):
    """Records of all kinds, in pieces smaller than the file, by a path of this machine and by one that only Hadoop opens; no task holds the file."""
    box = "POLYGON (({0} 0, {0} 1, {1} 1, {1} 0, {0} 0))"
    many = [(i, f"n{i}", float(i) if i % 7 else None, box.format(i, i + 2)) for i in range(1, 301)]
    odd = [(301, None, None, None), (302, "hole", 1.0, "POLYGON ((0 0, 0 9, 9 9, 9 0, 0 0), (1 1, 2 1, 2 2, 1 1))"), (303, "big", 2.5, "POLYGON ((" + ", ".join(f"{i} {i * i}" for i in range(400)) + ", 0 0))"), (304, "none", 0.0, "POLYGON EMPTY")]
    lay = make(spark, (many + odd)[::-1], ["name string", "n double"], kind="POLYGON", name="areas")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.pieces.link./p", f"file://{tmp_path}")
    files.write_shapefile(lay, str(tmp_path / "x.shp"))
    raw, index = (tmp_path / "x.shp").read_bytes(), (tmp_path / "x.shx").read_bytes()
    at = np.frombuffer(index[100:], ">i4").reshape(-1, 2)
    assert len(at) == 304 and [int.from_bytes(raw[2 * a : 2 * a + 4], "big") for a in at[:, 0]] == list(range(1, 305))
    assert 2 * int.from_bytes(raw[24:28], "big") == len(raw) and np.frombuffer(raw[36:68], "<f8").tolist() == [0, 0, 399, 399 * 399]
    expected = [(i, name or "", n, None if w in (None, "POLYGON EMPTY") else w) for i, name, n, w in many + odd]
    whole = files.read_shapefile(spark, str(tmp_path / "x.shp")).df
    monkeypatch.setattr(files, "PIECE_BYTES", 1000)
    monkeypatch.setattr(files, "PIECE_ROWS", 50)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 10_000)  # Spark then reads no longer file whole
    try:
        assert len(raw) > 40_000
        for df in (whole, *(files.read_shapefile(spark, f"{folder}/x.shp").df for folder in (str(tmp_path), f"file://{tmp_path}", "viewfs://pieces/p"))):
            assert [tuple(r) for r in df.orderBy("fid").select("fid", "name", "n", geometry.to_wkt("geom")).collect()] == expected
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    pieces = files.read_shapefile(spark, str(tmp_path / "x.shp")).df
    assert pieces.rdd.getNumPartitions() > 30 and "BroadcastHashJoin" not in lay.df.join(pieces, "fid")._jdf.queryExecution().executedPlan().toString()
    files.write_shapefile(lay.with_df(lay.df.where("fid < 9")), str(tmp_path / "x.shp"))
    with pytest.raises(Exception, match="source has changed"):
        pieces.collect()
    with pytest.raises(LayerError, match="mixed"):
        files.write_shapefile(lay.with_df(lay.df, geometry_type="POINT"), str(tmp_path / "x.shp"))
    assert files.read_shapefile(spark, str(tmp_path / "x.shp")).df.count() == 8
    for folder in (str(tmp_path), "viewfs://pieces/p"):
        with pytest.raises(FileNotFoundError):
            files.read_shapefile(spark, f"{folder}/none.shp")


@pytest.mark.parametrize(("kind", "one"), [("POINT", "POINT ({0} 2)"), ("LINESTRING", "LINESTRING ({0} 0, 1 {0})")])
def test_records_of_one_size_are_those_of_each(spark, kind, one):
    """Bytes and bounds of many geometries at once, of other byte orders, of Z and of none among them, as of each by itself."""
    plain = [codec.encode(codec.parse_wkt(one.format(i))) for i in range(20)]
    big = b"\x00" + plain[3][4:0:-1] + (plain[3][8:4:-1] if kind == "LINESTRING" else b"") + np.frombuffer(plain[3][-16 * (1 + (kind == "LINESTRING")) :], "<f8").astype(">f8").tobytes()
    geoms = [*plain, None, big, *plain[:5]]
    each = [files._bodies(kind, [g])[0][0] for g in geoms]
    bodies, low, high = files._bodies(kind, geoms)
    assert bodies == each and bodies[21] == bodies[3] and low.tolist() == [0, 0 if kind == "LINESTRING" else 2] and high.tolist() == [19, 19 if kind == "LINESTRING" else 2]
    data = bytes(100) + b"".join(i.to_bytes(4, "big") + (len(b) // 2).to_bytes(4, "big") + b for i, b in enumerate(bodies, 1))
    assert list(files.parse_shapes(data)) == [*plain, None, plain[3], *plain[:5]]
    assert None in files._bodies(kind, [*plain, codec.encode(codec.parse_wkt("POLYGON ((0 0, 0 1, 1 1, 0 0))"))])[0]

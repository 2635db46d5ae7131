"""Codec, plane geometry, coordinate systems, text, rules."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions import codec, crs, geometry, planar, text
from geoloom.plans import rules, templates

finite = st.floats(-1e6, 1e6, allow_nan=False).map(lambda v: v + 0.0)
xy = st.tuples(finite, finite)


@given(st.lists(st.lists(xy, min_size=1, max_size=5), min_size=1, max_size=3))
@settings(max_examples=100, deadline=None)
def test_wkb_and_wkt_round_trip(parts):
    for geometry_ in (("LINESTRING", parts[0]), ("POLYGON", parts), ("MULTILINESTRING", [("LINESTRING", p) for p in parts]), ("MULTIPOINT", [("POINT", [p]) for p in parts[0]])):
        data = codec.encode(geometry_)
        assert codec.encode(codec.decode(data)) == data
        assert codec.encode(codec.parse_wkt(codec.to_wkt(codec.decode(data)))) == data


def test_wkb_limits():
    assert codec.decode(bytes.fromhex("0101000000000000000000f03f0000000000000040"))[1].tolist() == [[1, 2]]
    big = b"\x00" + struct.pack(">I2d", 1, 3, 4)
    assert codec.decode(big)[1].tolist() == [[3, 4]]
    ewkb = b"\x01" + struct.pack("<II", 0x20000001, 4326) + struct.pack("<2d", 5, 6)
    assert codec.decode(ewkb)[1].tolist() == [[5, 6]]
    assert codec.decode(b"\x01" + struct.pack("<I4d", 3001, 1, 2, 3, 4))[1].tolist() == [[1, 2]]
    for bad in (b"", b"\x01\x01", codec.encode(("POINT", [(1, 2)])) + b"x", b"\x01" + struct.pack("<II", 2, 2_000_000)):
        with pytest.raises(codec.GeometryError):
            codec.decode(bad)


def test_wkt_forms():
    assert codec.to_wkt(codec.parse_wkt("multipoint (1 2, (3 4))")) == "MULTIPOINT ((1 2), (3 4))"
    assert codec.to_wkt(codec.parse_wkt("POINT Z (1 2 3)")) == "POINT (1 2)"
    assert codec.to_wkt(codec.parse_wkt("GEOMETRYCOLLECTION (POINT (1 2), POLYGON EMPTY)")) == "GEOMETRYCOLLECTION (POINT (1 2), POLYGON EMPTY)"
    with pytest.raises(codec.GeometryError):
        codec.parse_wkt("POINT (1)")


def square(n):
    return np.array([(0, 0), (n, 0), (n, n), (0, n), (0, 0)], float)


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=3, max_size=30))
@settings(max_examples=100, deadline=None)
def test_hull_of_hull_is_itself(points):
    ring = planar.convex_hull(points)
    if ring:
        assert planar.convex_hull(ring[:-1]) == ring and planar.signed_area(ring) > 0


def test_clip_area_is_the_overlap():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = rng.integers(0, 10, 4), rng.integers(0, 10, 4)
        box = lambda v: np.array([(v[0], v[1]), (v[0] + v[2] + 1, v[1]), (v[0] + v[2] + 1, v[1] + v[3] + 1), (v[0], v[1] + v[3] + 1), (v[0], v[1])], float)
        got = planar.clip_ring(box(a), box(b))
        w = min(a[0] + a[2], b[0] + b[2]) + 1 - max(a[0], b[0])
        h = min(a[1] + a[3], b[1] + b[3]) + 1 - max(a[1], b[1])
        assert (0 if got is None else abs(planar.signed_area(got))) == pytest.approx(max(0, w) * max(0, h) if min(w, h) > 0 else 0)


def test_triangles_cover_a_square_with_a_hole():
    hole = square(4) + 3
    area = sum(abs(planar.signed_area([*t, t[0]])) for t in planar.triangulate([square(10), hole]))
    assert area == pytest.approx(84)


def test_anchors_and_rings():
    assert planar.representative(("LINESTRING", np.array([(0, 0), (20, 0)], float))) == (10, 0)
    assert planar.representative(("POLYGON", [square(10)])) == (5, 5)
    assert planar.longest_segment(("LINESTRING", np.array([(0, 0), (0, 2), (9, 2)], float))) == (4.5, 2, 0)
    assert planar.simple_ring([(0, 0), (1, 0), (0, 1)]) == [(0, 0), (1, 0), (0, 1), (0, 0)]
    assert planar.simple_ring([(0, 0), (1, 1), (1, 0), (0, 1)]) is None
    assert planar.inner_point(("POLYGON", [square(10)]))[0] == 5
    wave = np.array([(i, (i % 2) * 0.01) for i in range(100)], float)
    assert len(planar.simplify(wave, 0.1)) == 2


def test_known_positions():
    got = [crs.transform_array(np.array([[127.0, 37.0]]), "EPSG:4326", t)[0] for t in ("EPSG:5179", "EPSG:5186")]
    assert got[0] == pytest.approx((955511.809285, 1889174.174347), abs=0.02)
    assert got[1] == pytest.approx((200000.0, 489012.955691), abs=0.02)
    back = crs.transform_array(crs.transform_array(np.array([[128.7, 35.2]]), "EPSG:4326", "EPSG:32652"), "EPSG:32652", "EPSG:4326")
    assert back[0] == pytest.approx((128.7, 35.2), abs=1e-9)
    with pytest.raises(crs.CRSError):
        crs.system("EPSG:1")


def test_columns_and_kernels_agree(spark):
    rows = spark.range(20).select((126 + F.col("id") / 10).alias("x"), (35 + F.col("id") / 20).alias("y"))
    x, y = crs.transform_columns(F.col("x"), F.col("y"), "EPSG:4326", "EPSG:5186")
    kernel = geometry.parts_of(crs.transform_geometry("EPSG:4326", "EPSG:5186")(geometry.point("x", "y")))
    for r in rows.select(x.alias("a"), y.alias("b"), kernel.alias("p")).collect():
        assert (r.p[0][0].x, r.p[0][0].y) == pytest.approx((r.a, r.b), abs=1e-6)


def test_number_texts(spark):
    want = {1.0: "1", 0.5: "0.5", 100000.0: "100000", 1e6: "1e+06", 1234567.0: "1.234567e+06", 1e20: "1e+20", 1e-12: "1e-12", 0.0001: "0.0001", 0.00012: "0.00012", 1.5e-5: "1.5e-05", -2.5: "-2.5", -1e7: "-1e+07"}
    df = spark.createDataFrame([(k,) for k in want], "v double")
    assert {r.v: r.t for r in df.select("v", text.value_text(F.col("v"), "double").alias("t")).collect()} == want
    none = spark.createDataFrame([(None,)], "v double").select(text.value_text(F.col("v"), "double")).first()[0]
    assert none == "<nil>"


def test_text_helpers(spark):
    df = spark.createDataFrame([("　 a b ", "", 1234.5)], "s string, e string, n double")
    row = df.select(
        text.trim_space(F.col("s")).alias("t"), text.first_filled(F.col("e"), F.col("s")).alias("c"), text.format_number(F.col("n"), 0).alias("f"),
        text.has_part(F.col("s"), "A B", True).alias("i"), text.format_number(F.col("s")).alias("bad"),
    ).first()
    assert (row.t, row.f, row.i, row.bad) == ("a b", "1,234", True, None) and row.c == "　 a b "


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ('return feature.grade == "A"', [True, False, False]),
        ("return feature.n > 1 and not feature.ok", [False, True, False]),
        ('return feature.missing == nil and "4" ~= 4', [True, True, True]),
        ('return string.sub(feature.grade or "zz", 1, 1) == "z"', [False, False, True]),
        ('return text.contains(feature.grade, "a", true) or #"abc" == 2', [True, False, False]),
        ("return math.floor(feature.n / 2) * 2 == feature.n", [False, True, False]),
    ],
)
def test_rules(spark, rule, want):
    df = spark.createDataFrame([(1, "A", 1.0, True), (2, "B", 2.0, False), (3, None, 3.0, True)], "fid long, grade string, n double, ok boolean")
    assert [r[0] for r in df.orderBy("fid").select(rules.compile_rule(rule, df)).collect()] == want


def test_bad_rules(spark):
    df = spark.createDataFrame([(1, "A", None)], "fid long, grade string, n double")
    for rule in ("return 1", "return feature.grade <", "return feature.grade < 3", "os.exit()", "return feature.grade + 1 == 2", "x = 1"):
        with pytest.raises(rules.RuleError):
            rules.compile_rule(rule, df)
    with pytest.raises(Exception, match="nil"):
        df.where(rules.compile_rule("return feature.n > 1", df)).collect()


def test_templates(spark):
    df = spark.createDataFrame([(7, "한강로", 12.0, None)], "fid long, road string, number double, gone string")
    label = lambda t: df.select(templates.label_template(t, df)).first()[0]
    assert label("${road} ${number}") == "한강로 12" and label("road") == "한강로" and label("a${gone}b${none}") == "ab"
    assert df.select(templates.field_template("{road}-{id} {x} {gone}", df)).first()[0] == "한강로-7 {x} <nil>"
    for bad in ("${", "${}", "x" * 5000):
        with pytest.raises(templates.TemplateError):
            templates.label_template(bad, df)

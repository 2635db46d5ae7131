"""ASCII DXF: layers to CAD layers, a row's entities made in Spark, the file written in order."""

from __future__ import annotations

import io
import os
import re
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.geometry import bbox_of
from ..model import FID, GEOM, Layer, LayerError, LayerMeta
from ..plans.presentation import DIRECTIONS
from .place import replaced

#: Text encoding and the file version and code page that go with it.
ENCODINGS = {"utf-8": ("AC1021", "ANSI_1252"), "cp949": ("AC1015", "ANSI_949"), "shift_jis": ("AC1015", "ANSI_932")}
_FORBIDDEN = re.compile(r'[<>/\\":;?*|=`]')


def check_names(names: list[str]) -> None:
    if any(not n or n != n.strip() or len(n) > 255 or _FORBIDDEN.search(n) for n in names) or len({n.lower() for n in names}) < len(names):
        raise LayerError("bad or repeated CAD layer names")


#: Horizontal and vertical alignment codes of a text that lies in a direction from its point.
ALIGNMENT = {"N": (1, 1), "NE": (0, 1), "E": (0, 2), "SE": (0, 3), "S": (1, 3), "SW": (2, 3), "W": (2, 2), "NW": (2, 1), "": (0, 0)}


def _pair(x: float, y: float, code: int = 10) -> list[str]:
    return [str(code), codec.number_text(x), str(code + 10), codec.number_text(y)]


def filled(rings: list, name: str) -> list[str]:
    """A solid hatch of a polygon, its holes left open."""
    paths = [r[:-1] for r in rings if len(r) > 3]
    if not paths:
        return []
    out = ["0", "HATCH", "8", name, *_pair(0, 0), "30", "0", "210", "0", "220", "0", "230", "1", "2", "SOLID", "70", "1", "71", "0", "91", str(len(paths))]
    for i, path in enumerate(paths):
        out += ["92", "3" if i == 0 else "2", "72", "0", "73", "1", "93", str(len(path))]
        for x, y in path.tolist():
            out += _pair(x, y)
        out += ["97", "0"]
    return [*out, "75", "0", "76", "1", "98", "0"]


def opening_view(box) -> tuple[list[str], list[str]]:
    """Header variables of the drawing's bounds, and the table of the view that it opens with: all of it and a twentieth around."""
    if box is None or box["minx"] is None:
        return [], []
    width, height = box["maxx"] - box["minx"], box["maxy"] - box["miny"]
    side = max(width, height, 1e-9) * 1.05
    middle = (box["minx"] + width / 2, box["miny"] + height / 2)
    header = ["9", "$EXTMIN", *_pair(box["minx"], box["miny"]), "9", "$EXTMAX", *_pair(box["maxx"], box["maxy"])]
    port = ["0", "TABLE", "2", "VPORT", "70", "1", "0", "VPORT", "2", "*ACTIVE", "70", "0", *_pair(0, 0), *_pair(1, 1, 11), *_pair(*middle, 12)]
    return header, [*port, "40", codec.number_text(side), "41", codec.number_text(max(1.0, width / max(height, 1e-9))), "0", "ENDTAB"]


def entities(geometry, name: str, fill: bool = False) -> list[str]:
    """Group lines of a geometry; collections are taken apart."""
    kind, parts = geometry
    out: list[str] = filled(parts, name) if fill and kind == "POLYGON" else []
    if kind == "POINT":
        if len(parts):
            out += ["0", "POINT", "8", name, "10", codec.number_text(parts[0][0]), "20", codec.number_text(parts[0][1])]
    elif kind in ("LINESTRING", "POLYGON"):
        for xy in [parts] if kind == "LINESTRING" else parts:
            closed = kind == "POLYGON" and len(xy) > 1
            xy = xy[:-1] if closed else xy
            out += ["0", "LWPOLYLINE", "8", name, "90", str(len(xy)), "70", "1" if closed else "0"]
            for x, y in xy.tolist():
                out += ["10", codec.number_text(x), "20", codec.number_text(y)]
    else:
        for part in parts:
            out += entities(part, name, fill)
    return out


def _lines(lay: Layer, name: str, fill: bool, direction: str, offset: float) -> DataFrame:
    @F.pandas_udf("array<string>")
    def shapes(geom: pd.Series) -> pd.Series:
        return geom.map(lambda g: [] if g is None else entities(codec.decode(g), name, fill))

    columns = [shapes(GEOM).alias("lines")]
    if "label" in lay.df.columns:
        at = F.col("label")
        text = F.regexp_replace(at["text"], r"[\r\n]+", " ")
        number = lambda c: c.cast("decimal(30,9)").cast("string")
        (across, up), (dx, dy) = ALIGNMENT[direction], DIRECTIONS.get(direction, (0, 0))
        x, y = at["x"] + dx * offset, at["y"] - dy * offset
        place = [F.lit("10"), number(x), F.lit("20"), number(y)]
        if direction:
            place += [F.lit("72"), F.lit(str(across)), F.lit("73"), F.lit(str(up)), F.lit("11"), number(x), F.lit("21"), number(y)]
        made = F.array(*[F.lit(x) for x in ("0", "TEXT", "8", "LABEL")], *place, F.lit("40"), F.lit("2.5"), F.lit("1"), text, F.lit("50"), number(at["rotation"]))
        columns[0] = F.concat(columns[0], F.when(at.isNotNull(), made).otherwise(F.array())).alias("lines")
    return lay.df.select(FID, *columns).orderBy(FID)


def write_dxf(layers: list[Layer], path: str, encoding: str = "utf-8", fill: bool = False, direction: str = "", offset: float = 0.0) -> None:
    """A drawing of all layers; text that the encoding lacks is an error, and the target is replaced whole.

    ``fill`` adds solid hatches of polygons; ``direction`` and ``offset`` (in
    map units) say where a label lies from its point.  The drawing opens on
    the bounds of all layers.
    """
    version, page = ENCODINGS[encoding]
    if direction not in ALIGNMENT:
        raise LayerError(f"unknown direction: {direction}")
    names = [lay.meta.display_name or lay.meta.name for lay in layers]
    check_names([*names, *(["LABEL"] if any("label" in x.df.columns for x in layers) else [])])
    boxes = layers[0].df.select(bbox_of(GEOM).alias("b"))
    for lay in layers[1:]:
        boxes = boxes.unionByName(lay.df.select(bbox_of(GEOM).alias("b")))
    bounds = boxes.agg(F.min("b.minx").alias("minx"), F.min("b.miny").alias("miny"), F.max("b.maxx").alias("maxx"), F.max("b.maxy").alias("maxy"))
    variables, port = opening_view(bounds.first())
    try:
        with replaced(layers[0].df.sparkSession, path) as (made,), open(made, "w", encoding=encoding, newline="\r\n") as out:
            head = ["0", "SECTION", "2", "HEADER", "9", "$ACADVER", "1", version, "9", "$DWGCODEPAGE", "3", page, *variables, "0", "ENDSEC"]
            head += ["0", "SECTION", "2", "TABLES", *port, "0", "TABLE", "2", "LAYER", "70", str(len(names) + 1)]
            for name in [*names, "LABEL"]:
                head += ["0", "LAYER", "2", name, "70", "0", "62", "7", "6", "CONTINUOUS"]
            out.write("\n".join([*head, "0", "ENDTAB", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES"]) + "\n")
            for lay, name in zip(layers, names, strict=True):
                for row in _lines(lay, name, fill, direction, offset).toLocalIterator():
                    if row["lines"]:
                        out.write("\n".join(row["lines"]) + "\n")
            out.write("0\nENDSEC\n0\nEOF\n")
    except UnicodeEncodeError as e:
        raise LayerError(f"text does not fit {encoding}") from e


def read_dxf(spark: SparkSession, path: str, encoding: str = "utf-8", crs: str = "") -> Layer:
    """Points, lines, light polylines and texts of the entities section, with their CAD layer and text."""

    def parse(frames):
        for frame in frames:
            for content in frame["content"]:
                rows = io.TextIOWrapper(io.BytesIO(content), encoding)
                groups = ((int(c), v.strip()) for c, v in zip(rows, rows, strict=False))
                found, entity, number = [], None, 0
                inside = False
                for code, value in chain(groups, [(0, "EOF")]):
                    if code == 2 and value == "ENTITIES":
                        inside = True
                    if code == 0:
                        if inside and entity and (made := _geometry(entity)):
                            number += 1
                            found.append((number, entity.get(8, ["0"])[0], entity.get(1, [None])[0], codec.encode(made)))
                            if len(found) == 10_000:
                                yield pd.DataFrame(found, columns=[FID, "layer", "text", GEOM])
                                found = []
                        entity = {0: value}
                    elif entity is not None:
                        entity.setdefault(code, []).append(value)
                yield pd.DataFrame(found, columns=[FID, "layer", "text", GEOM])

    df = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, f"{FID} long, layer string, text string, {GEOM} binary")
    from ..model import Field

    return Layer(df, LayerMeta(os.path.splitext(os.path.basename(path))[0], crs, "", (Field("layer"), Field("text")), source=path))


def _geometry(entity: dict):
    xy = list(zip(map(float, entity.get(10, [])), map(float, entity.get(20, [])), strict=False))
    if entity[0] in ("POINT", "TEXT") and xy:
        return "POINT", [xy[0]]
    if entity[0] == "LINE" and xy:
        return "LINESTRING", [xy[0], (float(entity[11][0]), float(entity[21][0]))]
    if entity[0] == "LWPOLYLINE" and len(xy) > 1:
        closed = int(entity.get(70, ["0"])[0]) & 1
        return ("POLYGON", [[*xy, xy[0]]]) if closed else ("LINESTRING", xy)
    return None

"""The command line: ``python -m geoloom.cli COMMAND --option value ...``.

Each command opens layers by path, calls one operator and writes one result;
an error leaves what was there before.  Every command is a function
``(spark, options)`` that returns a line to print, so it can be called from
Python with the same options.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import geometry
from .model import FID, GEOM, Field, Layer, LayerError, empty_layer
from .operators import combine, display, select, shapes, summarise
from .plans.templates import field_template
from .sources import catalog, database, delimited


@dataclass(frozen=True)
class Command:
    run: Callable
    required: tuple[str, ...]
    optional: tuple[str, ...]


COMMANDS: dict[str, Command] = {}
#: Options that may be given several times, and those without a value.
REPEATED, SWITCHES = ("input", "layer"), ("boundary",)


def command(required: str, optional: str = ""):
    def add(function):
        COMMANDS[function.__name__.replace("_", "-")] = Command(function, tuple(required.split()), tuple(optional.split()))
        return function

    return add


def _source(spark: SparkSession, o, i: int = 0) -> Layer:
    return catalog.open_layer(spark, o.input[i], o.layer[i] if o.layer and i < len(o.layer) else "", o.crs or "", o.encoding)


def _sources(spark: SparkSession, o, least: int = 1) -> list[Layer]:
    if o.layer and len(o.layer) != len(o.input):
        raise LayerError("as many layers as inputs, or none")
    if len(o.input) < least:
        raise LayerError(f"{least} inputs are needed")
    return [_source(spark, o, i) for i in range(len(o.input))]


def _write(lay: Layer, o) -> str:
    catalog.save_layer(lay, o.output, o.output_layer or "", o.encoding or "utf-8")
    return f"{lay.df.count()} features written to {o.output}"


@command("input output", "layer output-layer crs encoding")
def convert(spark, o) -> str:
    return _write(_source(spark, o), o)


@command("operation input output", "layer output-layer distance crs encoding")
def spatial(spark, o) -> str:
    return _write(shapes.spatial(o.operation, _sources(spark, o), float(o.distance) if o.distance else None), o)


@command("input output", "layer output-layer crs encoding")
def merge(spark, o) -> str:
    return _write(combine.append(_sources(spark, o, 2)), o)


@command("input field value output", "layer output-layer crs encoding")
def filter(spark, o) -> str:  # noqa: A001 the command's name
    return _write(select.filter_property(_source(spark, o), o.field, o.value), o)


def _with_text(lay: Layer, name: str, text) -> Layer:
    """The layer with a text field set."""
    fields = tuple(f for f in lay.meta.fields if f.name != name) + (Field(name),)
    return lay.with_df(lay.df.withColumn(name, text), fields=fields)


@command("input field output", "layer output-layer rotation crs encoding")
def label(spark, o) -> str:
    shown = display.label_field(_source(spark, o), o.field, o.rotation)
    texts = _with_text(shown, "label_text", F.col("label.text"))
    return _write(texts.with_df(texts.df.drop("label")), o)


@command("input field template output", "layer output-layer crs encoding")
def label_field(spark, o) -> str:
    lay = _source(spark, o)
    return _write(_with_text(lay, o.field, field_template(o.template, lay.df)), o)


@command("output output-layer geometry-type crs", "encoding")
def create_layer(spark, o) -> str:
    return _write(empty_layer(spark, o.output_layer, o.geometry_type.upper(), o.crs), o)


@command("input output x-field y-field crs", "output-layer delimiter encoding boundary boundary-group")
def import_csv(spark, o) -> str:
    got = delimited.read_points(spark, o.input, o.x_field, o.y_field, o.crs, o.delimiter or ",", o.encoding or "utf-8", name=o.output_layer or "points")
    rejected = got.diagnostics().collect()
    said = [_write(got.layer, o), *(f"file {r['file']} row {r['row']} line {r['line']}: {r['reason']}" for r in rejected)]
    if o.boundary or o.boundary_group:
        if not o.output.endswith(".gpkg") or not o.boundary_group:
            raise LayerError("boundaries need a group and a GeoPackage")
        hulls = shapes.hull_by_group(got.layer, o.boundary_group)
        catalog.save_layer(hulls, o.output, f"{got.layer.meta.name}_boundary")
    return "\n".join(said)


@command("input boundary-file boundary-layer output", "layer output-layer cell boundary-field crs encoding")
def split_boundary(spark, o) -> str:
    lay, edges = _source(spark, o), catalog.open_layer(spark, o.boundary_file, o.boundary_layer)
    box = summarise.mean_spans(edges).first()
    cell = float(o.cell) if o.cell else max(box["width"] or 0, box["height"] or 0) or 1.0
    return _write(shapes.boundary_split(lay, edges, cell, o.boundary_field or "shape_id"), o)


@command("input table layer-key table-key output", "layer output-layer delimiter crs encoding")
def join(spark, o) -> str:
    rows, _ = delimited.read_table(spark, o.table, o.delimiter or ",", o.encoding or "utf-8")
    got = combine.join_table(_source(spark, o), rows, o.layer_key, o.table_key)
    return f"{_write(got.layer, o)}\n{json.dumps(got.report.first().asDict())}"


@command("input feature-ids output", "layer output-layer crs encoding")
def polygon(spark, o) -> str:
    return _write(shapes.polygon_from(_source(spark, o), [int(i) for i in o.feature_ids.split(",")]), o)


@command("input group output", "layer sum crs encoding")
def aggregate(spark, o) -> str:
    delimited.write_report(summarise.group_totals(_source(spark, o), o.group, o.sum), o.output, ["group"])
    return f"report written to {o.output}"


@command("input output", "layer output-layer crs encoding")
def measure(spark, o) -> str:
    return _write(summarise.measure(_source(spark, o)), o)


@command("input output", "layer required unique crs encoding")
def validate(spark, o) -> str:
    names = lambda text: [n for n in (text or "").split(",") if n]
    issues = summarise.validate(_source(spark, o), names(o.required), names(o.unique))
    delimited.write_report(issues, o.output, ["feature_id", "position"])
    return f"{issues.count()} issues written to {o.output}"


@command("input script", "layer output output-layer crs encoding")
def script(spark, o) -> str:
    """The features for which a rule file is true."""
    with open(o.script, encoding="utf-8") as file:
        found = select.filter_rule(_source(spark, o), file.read())
    return _write(found, o) if o.output else f"{found.df.count()} features"


def _login(o) -> dict[str, str]:
    return {k: v for k, v in (("user", o.user), ("password", o.password)) if v}


@command("dsn", "schema user password")
def postgis_list(spark, o) -> str:
    rows = database.query(spark, o.dsn, database.catalog_query().rsplit(" ORDER BY", 1)[0], **_login(o))
    rows = rows.where(F.col("schema_name") == o.schema) if o.schema else rows
    return "\n".join(f"{r['schema_name']}.{r['table_name']}\t{r['geometry_type']}\t{r['srid']}" for r in rows.orderBy("schema_name", "table_name").collect())


@command("input dsn table", "layer crs user password encoding")
def postgis_import(spark, o) -> str:
    lay = _source(spark, o)
    database.write_table(lay, o.dsn, o.table, **_login(o))
    return f"{o.table} replaced"


@command("dsn table output", "crs output-layer user password encoding")
def postgis_export(spark, o) -> str:
    return _write(database.read_table(spark, o.dsn, o.table, crs=o.crs or "", **_login(o)), o)


@command("dsn table id wkt crs", "properties user password")
def postgis_insert(spark, o) -> str:
    fields = json.loads(o.properties or "{}")
    if not isinstance(fields, dict):
        raise LayerError("properties must be an object")
    made = spark.createDataFrame([(int(o.id), o.wkt, json.dumps(fields, ensure_ascii=False))], f"{FID} long, wkt string, properties string")
    good = made.withColumn(GEOM, geometry.from_wkt("wkt"))
    if good.where(f"{GEOM} is null").limit(1).count():
        raise LayerError("not a geometry")
    staging = f"{o.table}_staging"
    made.withColumnRenamed(FID, "id").write.format("jdbc").option("url", o.dsn).option("dbtable", database.quoted(staging)).options(**_login(o)).mode("overwrite").save()
    database.run_statements(spark, o.dsn, database.append_statements(o.table, staging, o.crs), o.user or "", o.password or "")
    return f"{o.table}: {o.id} added"


@command("dsn table id", "user password")
def postgis_delete(spark, o) -> str:
    changed = database.run_statements(spark, o.dsn, [database.delete_statement(o.table, int(o.id))], o.user or "", o.password or "")
    if changed != [1]:
        raise LayerError(f"no such feature: {o.id}")
    return f"{o.table}: {o.id} deleted"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="geoloom", allow_abbrev=False)
    commands = top.add_subparsers(dest="command", required=True)
    for name, c in COMMANDS.items():
        sub = commands.add_parser(name, help=(c.run.__doc__ or "").strip() or None, allow_abbrev=False)
        for option in (*c.required, *c.optional):
            if option in SWITCHES:
                sub.add_argument(f"--{option}", action="store_true")
            else:
                sub.add_argument(f"--{option}", required=option in c.required, action="append" if option in REPEATED else "store")
        sub.set_defaults(**{k: None for k in ("layer", "crs", "encoding", "output_layer", "user", "password") if k.replace("_", "-") not in (*c.required, *c.optional)})
    return top


def run(spark: SparkSession, arguments: list[str]) -> str:
    options = parser().parse_args(arguments)
    return COMMANDS[options.command].run(spark, options)


def main(arguments: list[str] | None = None) -> int:
    arguments = sys.argv[1:] if arguments is None else arguments
    parser().parse_args(arguments)
    spark = SparkSession.builder.appName("geoloom").getOrCreate()
    try:
        print(run(spark, arguments))
    except (LayerError, ValueError, OSError, PySparkException) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

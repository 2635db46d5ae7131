"""Tables of a spatial database over JDBC: ``id bigint, geom geometry, properties jsonb``.

The driver is whatever the session has on its class path; what is checked and
sent is made here as text, so it can be tested without a server.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..model import FID, GEOM, Layer, LayerError, LayerMeta, infer_fields

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def quoted(name: str) -> str:
    """A table's name with at most a schema before it, each part checked and quoted."""
    parts = name.split(".")
    if len(parts) > 2 or any(not _NAME.fullmatch(p) or len(p.encode()) > 63 for p in parts):
        raise LayerError(f"bad table name: {name}")
    return ".".join(f'"{p}"' for p in parts)


def srid(crs: str) -> int:
    m = re.fullmatch(r"EPSG:([1-9][0-9]*)", crs.strip().upper())
    if not m:
        raise LayerError(f"only EPSG codes have an SRID: {crs}")
    return int(m[1])


#: The columns of a feature table and their types.
COLUMNS = (("id", "bigint"), ("properties", "jsonb"))
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog")


def catalog_query() -> str:
    """Feature tables: ordinary ones with all columns of ``COLUMNS`` and one geometry column ``geom``.

    The columns of each table are counted in one pass over the catalogue.
    """
    needed = " ".join(f"AND COUNT(*) FILTER (WHERE c.column_name = '{name}' AND c.data_type = '{kind}') = 1" for name, kind in COLUMNS)
    hidden = ", ".join(f"'{s}'" for s in SYSTEM_SCHEMAS)
    return (
        "WITH features AS (SELECT c.table_schema AS s, c.table_name AS n FROM information_schema.columns AS c "
        f"WHERE c.table_schema NOT IN ({hidden}) GROUP BY c.table_schema, c.table_name "
        f"HAVING COUNT(*) FILTER (WHERE c.column_name = 'geom') = 1 {needed}) "
        "SELECT features.s AS schema_name, features.n AS table_name, gc.srid, gc.type AS geometry_type "
        "FROM features INNER JOIN information_schema.tables AS it ON it.table_schema = features.s AND it.table_name = features.n AND it.table_type = 'BASE TABLE' "
        "INNER JOIN geometry_columns AS gc ON gc.f_table_schema = features.s AND gc.f_table_name = features.n AND gc.f_geometry_column = 'geom' "
        "ORDER BY schema_name, table_name"
    )


def describe_query(table: str) -> str:
    """One row: features, least and largest id, SRID, geometry types and bounds."""
    return (
        "SELECT COUNT(*) AS features, MIN(id) AS least, MAX(id) AS largest, MAX(ST_SRID(geom)) AS srid, "
        "STRING_AGG(DISTINCT GeometryType(geom), ',') AS types, ST_AsText(ST_Extent(geom)) AS bounds "
        f"FROM {quoted(table)}"
    )


def check_query() -> str:
    """One row if the server answers and has the spatial extension."""
    return "SELECT extversion AS version FROM pg_extension WHERE extname = 'postgis'"


def page_query(table: str, after: int, limit: int) -> str:
    """A page of attributes past an id, by the primary key."""
    if not 1 <= limit <= 1000:
        raise LayerError("limit must be 1 to 1000")
    return f"SELECT id, properties::text AS properties FROM {quoted(table)} WHERE id > {int(after)} ORDER BY id LIMIT {limit}"


def scan_query(table: str, window: tuple[float, float, float, float] | None = None, crs: str = "") -> str:
    text = f"SELECT id, ST_AsBinary(geom) AS geom, properties::text AS properties FROM {quoted(table)}"
    if window is None:
        return text
    x0, y0, x1, y1 = window
    if not (x1 > x0 and y1 > y0):
        raise LayerError("a window needs an area")
    corners = ", ".join(repr(float(v)) for v in (x0, y0, x1, y1))
    return f"WITH view AS (SELECT ST_MakeEnvelope({corners}, {srid(crs)}) AS box) {text}, view WHERE ST_Intersects(geom, view.box)"


def read_table(spark: SparkSession, url: str, table: str, properties: str | None = None, crs: str = "", window=None, partitions: int = 8, bounds: tuple[int, int] | None = None, **options) -> Layer:
    """A table as a layer; with ``bounds`` of its ids it is read in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({scan_query(table, window, crs)}) AS t").options(**options)
    if bounds:
        reader = reader.option("partitionColumn", "id").option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    df = reader.load().withColumnRenamed("id", FID)
    if properties:
        df = df.select(FID, F.from_json("properties", properties).alias("p"), GEOM).select(FID, "p.*", GEOM)
    return Layer(df, LayerMeta(table, crs, "", infer_fields(df), source=url))


def as_rows(lay: Layer) -> DataFrame:
    """(id, wkt, properties): what is inserted."""
    properties = F.to_json(F.struct(*[F.col(f"`{n}`") for n in lay.meta.names()])) if lay.meta.fields else F.lit("{}")
    return lay.df.select(F.col(FID).alias("id"), geometry.to_wkt(GEOM).alias("wkt"), properties.alias("properties"))


def _insert(table: str, staging: str, crs: str) -> str:
    return f"INSERT INTO {quoted(table)} (id, geom, properties) SELECT r.id, ST_GeomFromText(r.wkt, {srid(crs)}), r.properties::jsonb FROM {quoted(staging)} AS r"


def create_statement(table: str) -> str:
    columns = {"id": "bigint", "geom": "geometry", "properties": "jsonb"}
    needed = {"id": "PRIMARY KEY", "geom": "NOT NULL", "properties": "NOT NULL DEFAULT '{}'"}
    return f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({', '.join(f'{n} {k} {needed[n]}' for n, k in columns.items())})"


def replace_statements(table: str, staging: str, crs: str) -> list[str]:
    """What one transaction runs after all rows are in the staging table: the old rows go only with it."""
    return [create_statement(table), f"DELETE FROM {quoted(table)}", _insert(table, staging, crs), f"DROP TABLE {quoted(staging)}"]


def append_statements(table: str, staging: str, crs: str) -> list[str]:
    """New rows beside the old ones; an id that is there already fails the whole transaction."""
    return [create_statement(table), _insert(table, staging, crs), f"DROP TABLE {quoted(staging)}"]


def delete_statement(table: str, fid: int) -> str:
    return f"DELETE FROM {quoted(table)} WHERE id = {int(fid)}"


def run_statements(spark: SparkSession, url: str, statements: list[str], user: str = "", password: str = "") -> list[int]:
    """The statements in one transaction over the session's JDBC driver, on the driver; rows that each changed."""
    manager = spark._jvm.java.sql.DriverManager
    connection = manager.getConnection(url, user, password) if user else manager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        changed = []
        try:
            for text in statements:
                statement = connection.createStatement()
                changed.append(statement.executeUpdate(text))
                statement.close()
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        return changed
    finally:
        connection.close()


def write_table(lay: Layer, url: str, table: str, append: bool = False, **options) -> None:
    """All features, staged in parallel and then published in one transaction."""
    staging = f"{table}_staging"
    write_staging(lay, url, staging, **options)
    statements = (append_statements if append else replace_statements)(table, staging, lay.meta.crs)
    run_statements(lay.df.sparkSession, url, statements, options.get("user", ""), options.get("password", ""))


def query(spark: SparkSession, url: str, text: str, **options) -> DataFrame:
    """The rows of one of the queries above."""
    return spark.read.format("jdbc").option("url", url).option("query", text).options(**options).load()


def write_staging(lay: Layer, url: str, staging: str, **options) -> None:
    as_rows(lay).write.format("jdbc").option("url", url).option("dbtable", quoted(staging)).options(**options).mode("overwrite").save()

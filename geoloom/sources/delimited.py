"""Delimited text: every row is either a feature or a diagnostic.

A file is read in blocks, as Spark splits it at line ends.  A quoted cell may
hold line ends, so whether a block begins inside one is known only from what
comes before: a first pass reads each block both ways and counts its records,
the driver walks over one row a block, and a second pass gives every record
its place.  A record over several blocks is put together from its pieces.
Cells stay text, so leading zeros stay; a row's id is its place among the
file's records, rejected rows leaving gaps.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.text import is_blank, trim_space
from ..model import FID, GEOM, Field, Layer, LayerError, LayerMeta
from .place import replaced

ENCODINGS = {"utf-8": "utf-8", "utf8": "utf-8", "cp949": "cp949", "euc-kr": "cp949"}
DIAGNOSTICS = 100
#: Of a file that a preview reads.
PREVIEW_BYTES = 1 << 20
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_TRUE, _FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")


@dataclass(frozen=True)
class Imported:
    layer: Layer
    #: (file, row, line, reason), all of them; ``diagnostics`` are the first hundred.
    rejected: DataFrame

    def counts(self) -> tuple[int, int]:
        return self.layer.df.count(), self.rejected.count()

    def diagnostics(self) -> DataFrame:
        return self.rejected.orderBy("file", "row").limit(DIAGNOSTICS)


def _codec(encoding: str) -> str:
    found = ENCODINGS.get(encoding.strip().lower())
    if found is None:
        raise LayerError(f"unsupported encoding: {encoding}")
    return found


def _header(spark: SparkSession, path: str, delimiter: str, encoding: str) -> list[str]:
    """Names of the first record, from the head of the file."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 1 << 16).alias("c")).head()
    if head is None:
        raise LayerError(f"no such file: {path}")
    text = bytes(head["c"]).decode(encoding, "replace").removeprefix("﻿")
    names = [n.strip() for n in next(csv.reader(io.StringIO(text), delimiter=delimiter), [])]
    if not names or "" in names or len(set(names)) < len(names):
        raise LayerError("the header has empty or repeated names")
    return names


def _parse(lines: list[str], delimiter: str, inside: bool) -> Iterator[tuple[int, int, list[str], str | None, bool]]:
    """(first line, line after, cells, problem, unfinished) of the records of some lines; ``inside`` says that they begin in a quoted cell."""
    text = [('"' if inside and i == 0 else "") + line + "\n" for i, line in enumerate(lines)]
    reader = csv.reader(text, delimiter=delimiter, strict=True)
    at = 0
    while at < len(lines):
        problem, cells, unfinished = None, [], False
        try:
            cells = next(reader)
        except StopIteration:
            return
        except csv.Error as e:
            unfinished = "unexpected end" in str(e)
            problem = f"bad record: {e}"
        yield at, reader.line_num, cells, problem, unfinished
        at = reader.line_num


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(block, value): the file's lines as bytes, with the place where their block begins."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _blocks(batches: Iterator[pa.RecordBatch], encoding: str) -> Iterator[tuple[int, list[str]]]:
    """The lines of one block after the other; a block is a task's unit, of some hundred megabytes at most."""
    block, held = None, []
    for batch in batches:
        for at, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if at != block and held:
                yield block, held
                held = []
            block = at
            text = value.decode(encoding, "replace")
            held.append(text.removeprefix("\ufeff") if at == 0 and not held else text)
    if held:
        yield block, held


def _scan(lines: DataFrame, delimiter: str, encoding: str) -> list:
    """A row for each block: its lines, and for both ways to begin the records that begin in it and whether its end is inside a cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _blocks(batches, encoding):
            row = {"block": [block], "lines": [len(held)]}
            for way, inside in (("plain", False), ("inside", True)):
                number, unfinished = 0, False
                for i, (_, _, cells, problem, unfinished) in enumerate(_parse(held, delimiter, inside)):
                    number += (bool(cells) or problem is not None) and not (inside and i == 0)
                row[f"{way}_records"], row[f"{way}_open"] = [number], [unfinished]
            yield pa.RecordBatch.from_pydict(row)

    shape = "block long, lines long, plain_records long, plain_open boolean, inside_records long, inside_open boolean"
    return sorted(lines.mapInArrow(count, shape).collect())


def records(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8") -> tuple[list[str], DataFrame]:
    """The header's names, and (row, line, cells, problem) of all records of one file."""
    encoding = _codec(encoding)
    names, lines = _header(spark, path, delimiter, encoding), _lines(spark, path)
    # Of each block: whether it begins inside a cell, the row of the record it begins in or before, and its first line.
    starts, inside, row, line = {}, False, -1, 1
    for b in _scan(lines, delimiter, encoding):
        starts[b["block"]] = (inside, row, line)
        row += b["inside_records" if inside else "plain_records"]
        line += b["lines"]
        inside = b["inside_open" if inside else "plain_open"]
    last = max(starts, default=0)
    width = len(names)

    def judged(cells: list[str], problem: str | None) -> str | None:
        if problem is None and len(cells) != width:
            return "wrong number of fields"
        return "invalid text encoding" if problem is None and any("\ufffd" in c for c in cells) else problem

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _blocks(batches, encoding):
            begins_inside, row, first = starts[block]
            out = []
            for i, (at, end, cells, problem, unfinished) in enumerate(_parse(held, delimiter, begins_inside)):
                piece = begins_inside and i == 0
                if not piece and not cells and problem is None:
                    continue
                row += not piece
                if piece or (unfinished and block != last):
                    out.append((row, first + at, [], None, block, "\n".join(held[at:end])))
                elif row > 0:
                    out.append((row, first + at, cells, judged(cells, problem), None, None))
                if len(out) >= 20_000:
                    yield _record_batch(out)
                    out = []
            yield _record_batch(out)

    def whole(key: tuple, pieces: pa.Table) -> pa.Table:
        parts = sorted(zip(pieces["piece"].to_pylist(), pieces["line"].to_pylist(), pieces["text"].to_pylist(), strict=True))
        found = list(_parse("\n".join(t for _, _, t in parts).split("\n"), delimiter, False))
        _, _, cells, problem, _ = found[0]
        row = (key[0].as_py(), parts[0][1], cells, judged(cells, problem), None, None)
        return pa.Table.from_batches([_record_batch([row] if row[0] > 0 else [])]).select(["row", "line", "cells", "problem"])

    found = lines.mapInArrow(place, "row long, line long, cells array<string>, problem string, piece long, text string")
    done = found.where("piece is null").select("row", "line", "cells", "problem")
    if not any(inside for inside, _, _ in starts.values()):
        return names, done
    pieces = found.where("piece is not null").select("row", "line", "piece", "text")
    return names, done.unionByName(pieces.groupBy("row").applyInArrow(whole, "row long, line long, cells array<string>, problem string"))


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"row": pa.int64(), "line": pa.int64(), "cells": pa.list_(pa.string()), "problem": pa.string(), "piece": pa.int64(), "text": pa.string()}
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def _typed(cell, kind: str):
    """(value, problem) of a cell; blank typed cells are null."""
    if kind == "number":
        value = F.when(trim_space(cell).rlike(_NUMBER), trim_space(cell).try_cast("double"))
        return value, ~is_blank(cell) & value.isNull()
    if kind == "bool":
        value = F.when(trim_space(cell).isin(*_TRUE), True).when(trim_space(cell).isin(*_FALSE), False)
        return value, ~is_blank(cell) & value.isNull()
    return cell, F.lit(False)


def _finite(cell):
    value = F.when(trim_space(cell).rlike(_NUMBER), trim_space(cell).try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def read_points(
    spark: SparkSession, paths: str | list[str], x: str, y: str, crs: str = "", delimiter: str = ",", encoding: str = "utf-8",
    types: dict[str, str] | None = None, name: str = "points", max_rows: int | None = None,
) -> Imported:
    """Points of one file or of several with one header; later files' ids start after the largest accepted one."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    types = types or {}
    good, bad, first, offset = None, None, None, 0
    for number, path in enumerate(paths, 1):
        names, rows = records(spark, path, delimiter, encoding)
        if first is None:
            first = names
            for wanted in (x, y, *types):
                if wanted not in names:
                    raise LayerError(f"no such column: {wanted}")
        elif names != first:
            raise LayerError("different headers")
        cell = {n: F.get("cells", F.lit(i)) for i, n in enumerate(names)}
        # The features' own id keeps its name.
        shown = {n: f"source_{n.lower()}" if n.lower() in (FID, GEOM) else n for n in names}
        reason = F.when(F.col("problem").isNotNull(), F.col("problem"))
        reason = reason.when(_finite(cell[x]).isNull() | _finite(cell[y]).isNull(), "coordinates are not finite numbers")
        values = []
        for n in names:
            value, problem = _typed(cell[n], types.get(n, "text"))
            reason = reason.when(problem, f"{n}: not a {types.get(n, 'text')}")
            values.append(value.alias(shown[n]))
        judged = rows.withColumn("reason", reason)
        ok = judged.where("reason is null").select(
            (F.col("row") + F.lit(offset)).alias(FID), *values, geometry.point(_finite(cell[x]), _finite(cell[y])).alias(GEOM)
        )
        no = judged.where("reason is not null").select(F.lit(number).alias("file"), "row", "line", "reason")
        good, bad = (ok, no) if good is None else (good.unionByName(ok), bad.unionByName(no))
        if number < len(paths):
            offset = good.agg(F.max(FID)).first()[0] or offset
    if max_rows is not None and good.limit(max_rows + 1).count() > max_rows:
        raise LayerError(f"more than {max_rows} rows")
    fields = tuple(Field(shown[n], types.get(n, "text")) for n in first)
    return Imported(Layer(good, LayerMeta(name, crs, "POINT", fields, source=",".join(paths))), bad)


def read_table(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8") -> tuple[DataFrame, DataFrame]:
    """A table without geometry, all text: (rows, rejected)."""
    names, rows = records(spark, path, delimiter, encoding)
    good = rows.where("problem is null").select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return good, rows.where("problem is not null").select(F.lit(1).alias("file"), "row", "line", F.col("problem").alias("reason"))


def preview(spark: SparkSession, path: str, max_rows: int = 50, delimiter: str = ",", encoding: str = "utf-8"):
    """The first good rows, and whether there are more: from the head of the file alone, the bound being the feature."""
    names = _header(spark, path, delimiter, _codec(encoding))
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, PREVIEW_BYTES).alias("c"), "length").head()
    lines = bytes(head["c"]).decode(_codec(encoding), "replace").removeprefix("\ufeff").split("\n")
    cut = head["length"] > PREVIEW_BYTES
    found = [c for _, _, c, problem, unfinished in _parse(lines[:-1] if cut else lines, delimiter, False) if problem is None and not unfinished and len(c) == len(names)][1:]
    return found[:max_rows], cut or len(found) > max_rows


def write_layer(lay: Layer, path: str) -> None:
    """The fields and ``WKT``, missing values empty."""
    columns = [F.col(f"`{f.name}`").cast("string").alias(f.name) for f in lay.meta.fields]
    lay.df.select(*columns, geometry.to_wkt(GEOM).alias("WKT")).write.mode("overwrite").csv(path, header=True, nullValue="")


def write_report(df: DataFrame, path: str, order: list[str] = ()) -> None:
    """A validation or aggregate report as one CSV file in the order of ``order``, replaced whole.

    Rows come to the driver one partition at a time, in ranges of the order.
    """
    rows = df.orderBy(*order) if order else df
    with replaced(df.sparkSession, path) as (made,), open(made, "w", encoding="utf-8", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(df.columns)
        for row in rows.toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])

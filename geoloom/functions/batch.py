"""A whole Arrow column of WKB decoded at once.

Points, lines and polygons of one ring, in two dimensions and the usual byte
order, are read with array operations on the column's buffer; every other
geometry goes through the codec one by one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from . import codec


class Decoded(NamedTuple):
    """Of row i the sequences ``rows[i]:rows[i+1]``; of sequence j the positions ``seqs[j]:seqs[j+1]`` of ``xy``."""

    #: False for null and for what is no geometry.
    valid: np.ndarray
    #: Type codes, 0 where not valid.
    kind: np.ndarray
    rows: np.ndarray
    seqs: np.ndarray
    xy: np.ndarray

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one position of each row's whole walk."""
        return self.seqs[self.rows[:-1]], self.seqs[self.rows[1:]]


def _u32(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return data[at[:, None] + np.arange(4)].copy().view("<u4").ravel().astype(np.int64)


def decode_all(column: pa.Array) -> Decoded:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    known = ~np.asarray(column.is_null()) if n else np.zeros(0, bool)
    _, at, raw = column.buffers()
    at = np.frombuffer(at, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    start, size = at[:-1], np.diff(at)
    kind, count, skip = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    head = np.flatnonzero(known & (size >= 13))
    head = head[data[start[head]] == 1]
    code, one = _u32(data, start[head] + 1), _u32(data, start[head] + 5)
    two = _u32(data, start[head] + 9)
    shapes = ((1, np.ones_like(one), 5), (2, one, 9), (3, np.where(one == 1, two, 0), 13))
    for wanted, many, before in shapes:
        fits = (code == wanted) & (many > 0) & (size[head] == before + 16 * many) & (many <= codec.MAX_ELEMENTS)
        kind[head[fits]], count[head[fits]], skip[head[fits]] = wanted, many[fits], before
    fast = kind > 0
    slow: dict[int, list[np.ndarray]] = {}
    valid = fast.copy()
    for i in np.flatnonzero(known & ~fast).tolist():
        try:
            geometry = codec.decode(data[start[i] : start[i] + size[i]].tobytes())
        except codec.GeometryError:
            continue
        valid[i], kind[i], slow[i] = True, codec.CODES[geometry[0]], codec.lines(geometry)
        count[i] = sum(len(x) for x in slow[i])
    first = np.concatenate([[0], np.cumsum(count)])
    xy = np.empty((first[-1], 2))
    many = count[fast]
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    source = np.repeat((start + skip)[fast], many) + 16 * within
    xy[np.repeat(first[:-1][fast], many) + within] = data[source[:, None] + np.arange(16)].view("<f8") if len(source) else np.zeros((0, 2))
    per_row, lengths = fast.astype(np.int64), [count[fast]]
    if slow:
        for i, found in slow.items():
            per_row[i] = len(found)
            if found:
                xy[first[i] : first[i + 1]] = np.concatenate(found)
        lengths = [np.array([len(x) for x in slow[i]], np.int64) if i in slow else count[i : i + 1] for i in range(n) if per_row[i]]
    # A point without coordinates is an empty one.
    empty = (kind == 1) & fast
    empty[empty] = np.isnan(xy[first[:-1][empty]]).any(1)
    if empty.any():
        keep = np.ones(len(xy), bool)
        keep[first[:-1][empty]] = False
        kept_rows = [not empty[i] for i in range(n) if per_row[i]]
        lengths = [np.concatenate([x for x, k in zip(_by_row(lengths, per_row), kept_rows, strict=True) if k] or [np.zeros(0, np.int64)])]
        xy, per_row = xy[keep], np.where(empty, 0, per_row)
    seqs = np.concatenate([[0], np.cumsum(np.concatenate(lengths) if lengths else [])]).astype(np.int64)
    return Decoded(valid, kind, np.concatenate([[0], np.cumsum(per_row)]), seqs, xy)


def _by_row(lengths: list[np.ndarray], per_row: np.ndarray) -> list[np.ndarray]:
    """The sequences' lengths of each row that has some."""
    return np.split(np.concatenate(lengths), np.cumsum(per_row[per_row > 0])[:-1])


def nested(d: Decoded) -> pa.Array:
    """array<array<struct<x, y>>>; null where not valid."""
    points = pa.StructArray.from_arrays([pa.array(d.xy[:, 0]), pa.array(d.xy[:, 1])], ["x", "y"])
    inner = pa.ListArray.from_arrays(pa.array(d.seqs, pa.int32()), points)
    return pa.ListArray.from_arrays(pa.array(d.rows, pa.int32()), inner, mask=pa.array(~d.valid))


def _floats(values: np.ndarray, ok: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=~ok)


def bounds(d: Decoded) -> pa.Array:
    """struct<minx, miny, maxx, maxy>; nulls where there is no position."""
    first, last = d.spans()
    ok = last > first
    out = np.zeros((4, len(first)))
    if ok.any():
        at = first[ok]
        for i, (f, axis) in enumerate(((np.minimum, 0), (np.minimum, 1), (np.maximum, 0), (np.maximum, 1))):
            out[i, ok] = f.reduceat(d.xy[:, axis], at)
    return pa.StructArray.from_arrays([_floats(x, ok) for x in out], ["minx", "miny", "maxx", "maxy"])


def metrics(d: Decoded) -> pa.Array:
    """struct<sequences, length, area>: the length along each row's first sequence and the area it encloses."""
    parts = np.diff(d.rows)
    has = parts > 0
    head = d.rows[:-1][has]
    first, last = d.seqs[head], d.seqs[head + 1]
    length, area = np.zeros(len(parts)), np.zeros(len(parts))
    if len(first) and len(d.xy) > 1:
        steps = last - first - 1
        owner = np.repeat(np.arange(len(first)), steps)
        index = np.repeat(first - (np.cumsum(steps) - steps), steps) + np.arange(steps.sum())
        a, b = d.xy[index], d.xy[index + 1]
        length[has] = np.bincount(owner, np.hypot(*(b - a).T), len(first))
        area[has] = np.abs(np.bincount(owner, a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1], len(first))) / 2
    return pa.StructArray.from_arrays([pa.array(parts, pa.int64(), mask=~d.valid), pa.array(length), pa.array(area)], ["sequences", "length", "area"])


def centers(d: Decoded) -> tuple[np.ndarray, np.ndarray]:
    """Positions of points and centroids of polygons, and for which rows they hold."""
    first, last = d.spans()
    out, ok = np.zeros((len(first), 2)), np.zeros(len(first), bool)
    point = (d.kind == 1) & (last > first)
    out[point], ok[point] = d.xy[first[point]], True
    rows = np.flatnonzero((d.kind == 3) & (last - first > 1))
    if len(rows):
        size = last[rows] - first[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        begin = np.cumsum(size) - size
        index = np.repeat(first[rows] - begin, size) + np.arange(size.sum())
        after = index + 1
        after[begin + size - 1] = first[rows]
        a, b = d.xy[index], d.xy[after]
        cross = a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]
        twice = np.bincount(owner, cross, len(rows))
        flat = np.abs(twice) < 1e-12
        for axis in (0, 1):
            total = np.bincount(owner, (a[:, axis] + b[:, axis]) * cross, len(rows))
            out[rows, axis] = np.where(flat, d.xy[first[rows] + size // 2, axis], total / np.where(flat, 1, 3 * twice))
        ok[rows] = True
    return out, ok


def boxes(edges: np.ndarray) -> pa.Array:
    """POLYGON of each row (minx, miny, maxx, maxy)."""
    n = len(edges)
    made = np.zeros(n, np.dtype([("order", "u1"), ("code", "<u4"), ("rings", "<u4"), ("count", "<u4"), ("xy", "<f8", 10)]))
    made["order"], made["code"], made["rings"], made["count"] = 1, 3, 1, 5
    made["xy"] = edges[:, [0, 1, 2, 1, 2, 3, 0, 3, 0, 1]]
    return binary(made, np.zeros(n, bool))


def points(x: np.ndarray, y: np.ndarray, missing: np.ndarray) -> pa.Array:
    made = np.zeros(len(x), np.dtype([("order", "u1"), ("code", "<u4"), ("x", "<f8"), ("y", "<f8")]))
    made["order"], made["code"], made["x"], made["y"] = 1, 1, x, y
    return binary(made, missing)


def lines(column: pa.Array) -> pa.Array:
    """LINESTRING of each list of struct<x, y>; null for null, NaN for a missing number."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    missing = np.asarray(column.is_null()) if len(column) else np.zeros(0, bool)
    count = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    xy = np.stack([x.cast(pa.float64()).to_numpy(zero_copy_only=False) for x in column.flatten().flatten()], 1).astype("<f8")
    at = np.concatenate([[0], np.cumsum(np.where(missing, 0, 9 + 16 * count))])
    data, start = np.zeros(at[-1], np.uint8), at[:-1][~missing]
    head = np.zeros(len(start), np.dtype([("order", "u1"), ("code", "<u4"), ("count", "<u4")]))
    head["order"], head["code"], head["count"] = 1, 2, count[~missing]
    data[start[:, None] + np.arange(9)] = head.view(np.uint8).reshape(-1, 9)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    data[(np.repeat(at[:-1] + 9, count) + 16 * within)[:, None] + np.arange(16)] = xy.view(np.uint8).reshape(-1, 16)
    known = pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(count), [known, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data)])


def binary(made: np.ndarray, missing: np.ndarray) -> pa.Array:
    """A binary column of records of one size."""
    offsets = np.arange(len(made) + 1, dtype=np.int32) * made.dtype.itemsize
    known = pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(made), [known, pa.py_buffer(offsets.tobytes()), pa.py_buffer(made.tobytes())])

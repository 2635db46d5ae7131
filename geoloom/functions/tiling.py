"""How often and how far segments run through the tiles of a grid, without a row for each tile crossed.

A segment goes through each row of tiles (or column, where it is steep) in one
run of neighbouring tiles.  The first and the last tile of a run are cut
exactly; those between are crossed from border to border, so all of them hold
the same length, and the run is told by where it opens and where it closes.
Sums of openings less closings along the row give those tiles back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .batch import Decoded

#: Runs that are looked at together; few enough for a processor's cache.
RUNS = 1 << 15
#: Tiles of the box for which a task keeps sums.
TILES = 1 << 21

#: What is summed by tile: segments and length in it, and in tiles further on the runs that open behind it, less those that close before it.
VALUES = ("n", "length", "opened", "opened_length", "closed", "closed_length")


def segments(d: Decoded) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of each segment of all sequences."""
    steps = np.maximum(np.diff(d.seqs) - 1, 0)
    at = np.repeat(d.seqs[:-1] - (np.cumsum(steps) - steps), steps) + np.arange(steps.sum())
    return d.xy[at], d.xy[at + 1] if len(at) else d.xy[at]


def _shares(start: np.ndarray, step: np.ndarray, tile: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Between which shares of its length a segment is within a tile's borders of one axis."""
    flat = step == 0
    by = np.where(flat, 1.0, step)
    a, b = (tile * size - start) / by, (tile * size + size - start) / by
    return np.where(flat, 0.0, np.minimum(a, b)), np.where(flat, 1.0, np.maximum(a, b))


def events(start: np.ndarray, end: np.ndarray, size: float) -> Iterator[tuple]:
    """(axis of the runs, tile across, tile along, n, length, None) of cut tiles, of segments of some length and with finite ends.

    In place of None ("opened" or "closed", runs, length in each of their tiles) where runs open or close.
    """
    step = end - start
    ok = np.isfinite(step).all(1) & (step != 0).any(1)
    start, end, step = start[ok], end[ok], step[ok]
    low, high = np.floor(np.minimum(start, end) / size), np.floor(np.maximum(start, end) / size)
    if len(low) and max(abs(low).max(), abs(high).max()) >= 2.0**53:
        raise ValueError("positions too far out for tiles of this size")
    steep = (high - low)[:, 1] > (high - low)[:, 0]
    for axis in (0, 1):
        of = np.flatnonzero(steep == bool(axis))
        along = abs(step[of, axis])
        steady = np.hypot(*step[of].T) * size / np.where(along == 0, 1.0, along)
        p, dp, q, dq = (x[of, i] for i in (axis, 1 - axis) for x in (start, step))
        left, right, first = low[of, axis], high[of, axis], low[of, 1 - axis].astype(np.int64)
        many = high[of, 1 - axis].astype(np.int64) - first + 1
        after = np.cumsum(many)
        before = after - many
        for begin in range(0, int(after[-1]) if len(of) else 0, RUNS):
            index = np.arange(begin, min(begin + RUNS, int(after[-1])))
            i = np.searchsorted(after, index, "right")
            across = (first - before)[i] + index
            for found in _runs(p[i], dp[i], q[i], dq[i], across, left[i], right[i], steady[i], size):
                yield axis, *found


def _runs(p, dp, q, dq, across, low, high, steady, size) -> Iterator[tuple]:
    """One run each: positions and steps along it and across, its row of tiles, the segment's tiles along, a whole tile's length."""
    u, v = _shares(q, dq, across, size)
    u, v = np.maximum(u, 0.0), np.minimum(v, 1.0)
    some = u < v
    if not some.all():
        p, dp, dq, across, low, high, steady, u, v = (x[some] for x in (p, dp, dq, across, low, high, steady, u, v))
    one, two = p + dp * u, p + dp * v
    first, last = np.minimum(one, two), np.maximum(one, two)
    # Near a border rounding decides whether a tile is met at all, so both tiles there are cut by their shares.
    slack = size * 1e-9 + 1e-14 * np.maximum(abs(first), abs(last))
    tile = lambda x: np.minimum(np.maximum(np.floor(x / size), low), high)
    outer_low, inner_low, inner_high, outer_high = tile(first - slack), tile(first + slack), tile(last - slack), tile(last + slack)
    whole = inner_high - inner_low > 1

    def cut(rows: np.ndarray, along: np.ndarray, what: str | None) -> tuple:
        if rows.all():
            rows = slice(None)
        along, step, turn = along[rows], dp[rows], dq[rows]
        a, b = _shares(p[rows], step, along, size)
        f, g = np.maximum(u[rows], a), np.minimum(v[rows], b)
        held = f < g
        length = np.where(held, np.sqrt((step * g - step * f) ** 2 + (turn * g - turn * f) ** 2), 0.0)
        runs = whole[rows].astype(float)
        return across[rows], along.astype(np.int64), held.astype(float), length, (what, runs, runs * steady[rows]) if what else None

    for rows, along, what in (
        (inner_low <= inner_high, inner_low, "opened"), (inner_low < inner_high, inner_high, "closed"),
        (outer_low < inner_low, outer_low, None), (outer_high > inner_high, outer_high, None),
    ):
        if rows.any():
            yield cut(rows, along, what)


class Sums:
    """Sums by axis and tile of a task's events: in a box of at most ``TILES`` tiles, which is handed on when others are met."""

    def __init__(self, tiles: int = TILES) -> None:
        self.tiles = tiles
        #: By axis (lowest across and along, and sums by value, across and along).
        self.boxes: list[tuple[np.ndarray, np.ndarray] | None] = [None, None]

    def add(self, axis: int, across: np.ndarray, along: np.ndarray, n: np.ndarray, length: np.ndarray, runs: tuple | None) -> Iterator[tuple]:
        """What has to be handed on: (axis, across, along, sums by value)."""
        low, high = np.array([across.min(), along.min()]), np.array([across.max(), along.max()])
        box = self.boxes[axis]
        if box is None or (low < box[0]).any() or (high >= box[0] + box[1].shape[1:]).any():
            if box is not None and _tiles(low, high) <= self.tiles:
                whole_low, whole_high = np.minimum(low, box[0]), np.maximum(high, box[0] + box[1].shape[1:] - 1)
                if _tiles(whole_low, whole_high) > self.tiles:
                    yield from self.rest(axis)
                    box = None
                else:
                    low, high = whole_low, whole_high
            if _tiles(low, high) > self.tiles:
                # Events this far apart have few tiles in common.
                sums = np.zeros((len(VALUES), len(across)))
                sums[0], sums[1] = n, length
                if runs:
                    i = VALUES.index(runs[0])
                    sums[i], sums[i + 1] = runs[1:]
                order = np.lexsort((along, across))
                across, along = across[order], along[order]
                first = np.flatnonzero(np.append(True, (np.diff(across) != 0) | (np.diff(along) != 0)))
                yield axis, across[first], along[first], np.add.reduceat(sums[:, order], first, axis=1)
                return
            sums = np.zeros((len(VALUES), *(high - low + 1)))
            if box is not None:
                at = box[0] - low
                sums[:, at[0] : at[0] + box[1].shape[1], at[1] : at[1] + box[1].shape[2]] = box[1]
            self.boxes[axis] = box = low, sums
        low, sums = box
        at = (across - low[0]) * sums.shape[2] + (along - low[1])
        flat = sums.reshape(len(VALUES), -1)
        np.add.at(flat[0], at, n)
        np.add.at(flat[1], at, length)
        if runs:
            i = VALUES.index(runs[0])
            np.add.at(flat[i], at, runs[1])
            np.add.at(flat[i + 1], at, runs[2])

    def rest(self, *axes: int) -> Iterator[tuple]:
        for axis in axes or (0, 1):
            if self.boxes[axis] is not None:
                low, sums = self.boxes[axis]
                across, along = np.nonzero(sums[[0, 2, 4]].any(0))
                yield axis, across + low[0], along + low[1], sums[:, across, along]
                self.boxes[axis] = None


def _tiles(low: np.ndarray, high: np.ndarray) -> int:
    return (int(high[0]) - int(low[0]) + 1) * (int(high[1]) - int(low[1]) + 1)

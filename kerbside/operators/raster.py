"""Row spans of many grids at once, in numpy: what a task does with an Arrow batch in which each row is one grid.

Spark groups the boxes, lines or spans of a grid into one row (``per_grid``) and takes the spans that come back as rows again;
the helpers here only work on flat arrays, in which ``grid`` says to which row of the batch an entry belongs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries (boxes, lines, spans) and grids worked on together, and grids laid out in full together: they bound the arrays of a task, whatever the batch holds.
TOGETHER, GRIDS = 20_000, 500
BLOCK = 8
#: What stands for a null value (below all others) and for no value at all.
MISSING, ABSENT = -2**63, -2**63 + 1


def per_grid(rows: DataFrame, keys: list[str], columns: list[str], out: str | list[T.StructField], kernel: Callable, in_order: bool = False) -> DataFrame:
    """``kernel(grid, *columns)`` for all grids (``keys``) of ``rows``: it returns the grid of each result and the columns ``out`` (DDL or fields).

    With ``in_order`` the entries of a grid come in the order of ``columns``.  A column that is no number is handed over as Arrow
    has it, and a kernel may return Arrow arrays.
    """
    fields = T.StructType.fromDDL(out).fields if isinstance(out, str) else out
    entries = F.collect_list(F.struct(*columns))
    packed = rows.groupBy(*keys).agg((F.sort_array(entries) if in_order else entries).alias("_entries"))
    schema = T.StructType([packed.schema[k] for k in keys] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = batch.column("_entries")
            ends = np.asarray(entries.offsets, dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, min(at + GRIDS, int(np.searchsorted(ends, ends[at] + TOGETHER, side="right")) - 1))
                flat = entries.values.slice(ends[at], ends[to] - ends[at])
                grid = np.repeat(np.arange(to - at), np.diff(ends[at:to + 1]))
                found, *results = kernel(grid, *[_values(flat.field(c)) for c in columns])
                taken = pa.array(found + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).take(taken) for k in keys] + [r if isinstance(r, pa.Array) else pa.array(r, type=arrow(f)) for r, f in zip(results, fields, strict=True)],
                    names=schema.fieldNames())
                at = to

    return packed.mapInArrow(run, schema)


class Steps(NamedTuple):
    """How the rows of a DataFrame come out of ``per_grid``, so that what follows can go on in the same task with the arrays:
    Spark takes a row at a time to Python, which costs more than the work on it.

    ``kernel(grid, *columns)`` gives ascending grids and a dict of arrays; a text is a number there, and ``names`` has the texts.
    In the columns ``nulls`` the number ``MISSING`` stands for null.
    """
    rows: DataFrame
    keys: list[str]
    columns: list[str]
    kernel: Callable
    names: dict[str, pa.Array]
    nulls: tuple[str, ...] = ()

    def then(self, step: Callable, **names: pa.Array) -> Steps:
        """Steps whose arrays go through ``step(grid, arrays)``."""
        before = self.kernel
        return self._replace(kernel=lambda *given: step(*before(*given)), names={**self.names, **names})

    def frame(self, fields: list[T.StructField]) -> DataFrame:
        arrays, names, nulls = self.kernel, self.names, self.nulls

        def value(f: T.StructField, v: np.ndarray) -> np.ndarray | pa.Array:
            if f.name in names:
                return names[f.name].take(pa.array(v))
            return pa.array(np.where(v == MISSING, 0, v), type=arrow(f), mask=v == MISSING) if f.name in nulls else v

        def kernel(*given):
            grid, c = arrays(*given)
            return grid, *[value(f, c[f.name]) for f in fields]

        return per_grid(self.rows, self.keys, self.columns, fields, kernel)


def within(grid: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A number for each pair of a grid and a value, in their order."""
    low, high = (int(f(value)) if len(value) else 0 for f in (np.min, np.max))
    if high - low < 2**20:
        return grid * (high - low + 1) + value - low
    found, rank = np.unique(value, return_inverse=True)
    return grid * len(found) + rank


def kept(df: DataFrame, steps: list[Steps]) -> DataFrame:
    """``df`` with the steps that make it (several, if it is a union of what they make)."""
    df._steps = steps
    return df


def steps_of(df: DataFrame) -> list[Steps] | None:
    """The steps that make exactly the rows of ``df``, where they are known."""
    return getattr(df, "_steps", None)


def stacked(steps: list[Steps], fields: list[T.StructField]) -> DataFrame:
    """The rows of several steps, with the steps."""
    frames = [s.frame(fields) for s in steps]
    whole_df = frames[0]
    for f in frames[1:]:
        whole_df = whole_df.unionByName(f)
    return kept(whole_df, steps)


def grouped(rows: DataFrame, keys: list[str], **aggs: tuple[str, str]) -> DataFrame:
    """``groupBy(keys)``: ``name=(how, column)`` with how one of ``sum``, ``max``, ``min``, ``count`` and ``distinct``.

    Where the steps of ``rows`` are known and work on the first key, their groups are summed up in the task that made them;
    steps that are stacked must not share groups.
    """
    steps = steps_of(rows)
    if steps is None or any(s.keys != keys[:1] for s in steps):
        how = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "distinct": F.count_distinct}
        return rows.groupBy(*keys).agg(*[how[h](c).alias(n) for n, (h, c) in aggs.items()])

    def sums(grid, c):
        of = grid
        for k in keys[1:]:
            of = within(of, c[k])
        order = np.argsort(of, kind="stable")
        of = of[order]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][:len(of)])

        def value(how: str, column: str) -> np.ndarray:
            v = c[column][order]
            if how == "count" or not len(starts):
                return np.diff(np.r_[starts, len(of)])
            if how == "distinct":
                group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(of)]))
                by = np.lexsort((v, group))
                new = np.r_[True, (group[by][1:] != group[by][:-1]) | (v[by][1:] != v[by][:-1])]
                return np.bincount(group[by][new], minlength=len(starts))
            return {"sum": np.add, "max": np.maximum, "min": np.minimum}[how].reduceat(v, starts)

        first = order[starts]
        return grid[first], {**{k: c[k][first] for k in keys[1:]}, **{n: value(*a) for n, a in aggs.items()}}

    whole_sum = lambda how, c: how != "sum" or not isinstance(rows.schema[c].dataType, T.DoubleType)
    kind = lambda how, c: rows.schema[c].dataType if how in ("max", "min") or not whole_sum(how, c) else T.LongType()
    fields = [rows.schema[k] for k in keys[1:]] + [T.StructField(n, kind(*a)) for n, a in aggs.items()]
    return stacked([s.then(sums) for s in steps], fields)


def whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _values(column: pa.Array) -> np.ndarray | pa.Array:
    kind = column.type
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind) else column


def codes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value, null among them."""
    return whole(column).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def distinct(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The values that ``codes`` numbers."""
    column = whole(column)
    code = codes(column)
    return column.take(pa.array(np.unique(code, return_index=True)[1]))


def values(table: pa.Table, column: str) -> np.ndarray:
    return _values(whole(table.column(column)))


def change(*columns: np.ndarray) -> np.ndarray:
    """A number for each run of equal rows, from 0."""
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.cumsum(np.r_[0, new])[:len(columns[0])]


def arrow(field: T.StructField) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "smallint": pa.int16()}[field.dataType.simpleString()]


def counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts ``n``: the index of each entry, n times, and 0, 1, .. in each run."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def quad_rows(u: list[np.ndarray], v: list[np.ndarray], size: int) -> tuple[np.ndarray, ...]:
    """(quad, cy, x0, x1) of the cells whose centre lies in convex rings of four corners."""
    first = lambda c: np.ceil(np.round(c - 0.5, 9)).astype(np.int64)
    low, high = np.maximum(0, first(np.minimum.reduce(v))), np.minimum(size - 1, first(np.maximum.reduce(v)) - 1)
    quad, step = counted(np.maximum(0, high - low + 1))
    cy = low[quad] + step
    at, left, right = cy + 0.5, np.full(len(cy), np.inf), np.full(len(cy), -np.inf)
    for i in range(4):
        ax, ay, bx, by = (c[quad] for c in (u[i], v[i], u[(i + 1) % 4], v[(i + 1) % 4]))
        hit = np.flatnonzero((ay > at) != (by > at))
        cross = ax[hit] + (at[hit] - ay[hit]) * (bx[hit] - ax[hit]) / (by[hit] - ay[hit])
        left[hit], right[hit] = np.minimum(left[hit], cross), np.maximum(right[hit], cross)
    some = np.flatnonzero(left <= right)
    x0, x1 = np.maximum(0, first(left[some])), np.minimum(size - 1, first(right[some]) - 1)
    kept = x0 <= x1
    return quad[some][kept], cy[some][kept], x0[kept], x1[kept]


def box_rows(u: list[np.ndarray], v: list[np.ndarray], size: int) -> tuple[np.ndarray, ...]:
    """(box, cy, x0, x1) of rings of whole cells: inside, or on an edge drawn to the nearest cell (see ``spans``)."""
    low, high = np.maximum(0, np.minimum.reduce(v)), np.minimum(size - 1, np.maximum.reduce(v))
    box, step = counted(np.maximum(0, high - low + 1))
    cy = low[box] + step
    x0, x1 = np.full(len(cy), size, dtype=np.int64), np.full(len(cy), -1, dtype=np.int64)
    for i in range(4):
        ax, ay, bx, by = u[i], v[i], u[(i + 1) % 4], v[(i + 1) % 4]
        on = np.flatnonzero((cy >= np.minimum(ay, by)[box]) & (cy <= np.maximum(ay, by)[box]))
        of, y = box[on], cy[on]
        dx, dy = (bx - ax)[of], (by - ay)[of]
        least, most = np.minimum(ax, bx)[of], np.maximum(ax, bx)[of]
        level, steep = dy == 0, np.abs(dy) >= np.abs(dx)
        safe = np.where(level, 1, dy)
        twice = 2 * (ax[of] * dy - ay[of] * dx) + 2 * y * dx
        near = (twice + dy) // (2 * safe)
        turned, wide = twice * np.sign(dy), 2 * np.abs(safe)
        lo = np.where(level, least, np.where(steep, near, np.maximum(-((np.abs(dx) - turned) // wide), least)))
        hi = np.where(level, most, np.where(steep, near, np.minimum((turned + np.abs(dx)) // wide, most)))
        x0[on], x1[on] = np.minimum(x0[on], lo), np.maximum(x1[on], hi)
    x0, x1 = np.maximum(0, x0), np.minimum(size - 1, x1)
    kept = x0 <= x1
    return box[kept], cy[kept], x0[kept], x1[kept]


def centre_rows(x, y, cos, sin, length, width, low, high, cell: float, extent: float, size: int) -> tuple[np.ndarray, ...]:
    """(box, cy, x0, x1) of the cells whose centre lies in a box; ``low`` and ``high`` are its bounding rows and columns."""
    box, step = counted(np.maximum(0, high[1] - low[1] + 1))
    cy = low[1][box] + step
    row, along = counted(np.maximum(0, high[0] - low[0] + 1)[box])
    of = box[row]
    cx = low[0][of] + along
    dx, dy = -extent + cell * (cx + 0.5) - x[of], -extent + cell * (cy[row] + 0.5) - y[of]
    inside = np.flatnonzero((np.abs(dx * cos[of] + dy * sin[of]) <= length[of] / 2) & (np.abs(-dx * sin[of] + dy * cos[of]) <= width[of] / 2))
    row, cx = row[inside], cx[inside]
    # a box is convex: what it covers of a row is one span
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(row)] - 1 if len(row) else starts
    return box[row[starts]], cy[row[starts]], cx[starts], cx[ends]


def flat(grid, cy, x0, x1) -> tuple[int, np.ndarray, np.ndarray]:
    """Spans as runs of one long line on which no two rows touch: (width of a row, start, end); rows may reach from -1 on."""
    wide, high = (int(a.max()) + 4 if len(a) else 4 for a in (x1, cy))
    start = (grid * high + cy + 1) * wide + 1
    return wide, start + x0, start + x1


def unflat(wide: int, cy: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    high = int(cy.max()) + 4 if len(cy) else 4
    row = start // wide
    return (row - 1) // high, (row - 1) % high, start % wide - 1, end % wide - 1


def paint(grid, cy, x0, x1, value, missing: bool = False) -> tuple[np.ndarray, ...]:
    """(grid, cy, x0, x1, value) without overlap: where several spans cover a cell the largest value stays.

    Where only null values overlap nothing stays, unless ``missing``.
    """
    wide, start, end = flat(grid, cy, x0, x1)
    order = np.argsort(start, kind="stable")
    start, end, value = start[order], end[order], value[order]
    reach = np.maximum.accumulate(end) if len(end) else end
    fresh = np.r_[True, start[1:] > reach[:-1]][:len(start)]
    island = np.cumsum(fresh) - 1
    alone = np.bincount(island, minlength=0)[island] == 1 if len(island) else np.zeros(0, bool)
    # only spans that overlap others are looked at cell by cell
    many = np.flatnonzero(~alone)
    of, step = counted((end - start + 1)[many])
    cell = start[many][of] + step
    values, rank = np.unique(value[many], return_inverse=True)
    top = np.sort(cell * max(1, len(values)) + rank[of])
    cell, rank = top // max(1, len(values)), top % max(1, len(values))
    last = np.r_[cell[1:] != cell[:-1], True][:len(cell)]
    if not missing and len(values) and values[0] == MISSING:
        last &= rank > 0
    cell, rank = cell[last], rank[last]
    begins = np.r_[True, (cell[1:] != cell[:-1] + 1) | (rank[1:] != rank[:-1])][:len(cell)]
    b = np.flatnonzero(begins)
    e = np.r_[b[1:], len(cell)][:len(b)] - 1
    g, y, a, z = unflat(wide, cy, np.r_[start[alone], cell[b]], np.r_[end[alone], cell[e]])
    return g, y, a, z, np.r_[value[alone], values[rank[b]]]


def draw(grid, cy, x0, x1, size: int) -> tuple[np.ndarray, ...]:
    """(grid, cy, x0, x1, index): what stays of spans drawn one over the other in their order, and which span it is of; ``grid`` ascends.

    A few canvases at a time are laid out in full, as many as a core's cache holds.
    """
    wide, out = size + 1, []
    for at in range(0, int(grid[-1]) + 1 if len(grid) else 0, BLOCK):
        a, b = np.searchsorted(grid, (at, at + BLOCK))
        start = ((grid[a:b] - at) * size + cy[a:b]) * wide + x0[a:b] + 1
        of, step = counted(x1[a:b] - x0[a:b] + 1)
        # the first cell of each row stays free, so that no span runs on into the next
        canvas = np.zeros(BLOCK * size * wide + 1, np.int32)
        canvas[start[of] + step] = of + 1
        change = np.flatnonzero(canvas[1:] != canvas[:-1]) + 1
        found = canvas[change]
        some = np.flatnonzero(found)
        begin, end = change[some], change[np.minimum(some + 1, len(change) - 1)] - 1
        row = begin // wide
        out.append((row // size + at, row % size, begin % wide - 1, end % wide - 1, found[some] - 1 + a))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (grid, cy, x0, x1, grid)


def ring_rows(ring, x, y, size: int) -> tuple[np.ndarray, ...]:
    """(ring, cy, x0, x1) of the cells whose centre lies in rings of any number of corners, by the even-odd rule; corners of a ring follow one another."""
    first = lambda c: np.ceil(np.round(c - 0.5, 9)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, ring[1:] != ring[:-1]][:len(ring)])
    nxt = np.arange(1, len(ring) + 1)
    nxt[np.r_[starts[1:], len(ring)][:len(starts)] - 1] = starts
    bx, by = x[nxt], y[nxt]
    least, most = (f.reduceat(y, starts) if len(starts) else y for f in (np.minimum, np.maximum))
    of = np.cumsum(np.r_[True, ring[1:] != ring[:-1]][:len(ring)]) - 1
    low, high = np.maximum(np.maximum(0, first(least))[of], first(np.minimum(y, by))), np.minimum(np.minimum(size - 1, first(most) - 1)[of], first(np.maximum(y, by)))
    edge, step = counted(np.maximum(0, high - low + 1))
    cy = low[edge] + step
    at = cy + 0.5
    hit = np.flatnonzero((y[edge] > at) != (by[edge] > at))
    edge, cy, at = edge[hit], cy[hit], at[hit]
    cross = x[edge] + (at - y[edge]) * (bx[edge] - x[edge]) / (by[edge] - y[edge])
    order = np.lexsort((cross, cy, of[edge]))
    of, cy, cross = of[edge][order], cy[order], cross[order]
    # an edge leaves a row as often as it enters it, so crossings come in pairs
    x0, x1 = np.maximum(0, first(cross[::2])), np.minimum(size - 1, first(cross[1::2]) - 1)
    kept = x0 <= x1
    return ring[starts[of[::2][kept]]], cy[::2][kept], x0[kept], x1[kept]


def union(grid, cy, x0, x1) -> tuple[np.ndarray, ...]:
    """Spans that overlap or touch become one."""
    wide, start, end = flat(grid, cy, x0, x1)
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    reach = np.maximum.accumulate(end) if len(end) else end
    b = np.flatnonzero(np.r_[True, start[1:] > reach[:-1] + 1][:len(start)])
    e = np.r_[b[1:], len(start)][:len(b)] - 1
    return unflat(wide, cy, start[b], reach[e])


def overlay(grid, side, cy, x0, x1) -> tuple[np.ndarray, ...]:
    """(grid, cy, x0, x1, a, b): pieces that a span of side 0, of side 1 or of both covers, with the index of the span or -1.

    The spans of a side do not overlap one another, so the sum of the indexes that have begun and not ended is the one that holds.
    """
    wide, start, end = flat(grid, cy, x0, x1)
    at = np.r_[start, end + 1]
    mark = np.arange(1, len(start) + 1)
    a = np.where(side == 0, mark, 0)
    order = np.argsort(at, kind="stable")
    at = at[order]
    a, b = (np.cumsum(np.r_[m, -m][order]) for m in (a, mark - a))
    piece = np.flatnonzero(np.r_[(at[1:] > at[:-1]) & ((a[:-1] > 0) | (b[:-1] > 0)), False][:len(at)])
    g, y, s, e = unflat(wide, cy, at[piece], at[np.minimum(piece + 1, len(at) - 1)] - 1)
    return g, y, s, e, a[piece] - 1, b[piece] - 1


def edge(grid, cy, x0, x1, size: int) -> tuple[np.ndarray, ...]:
    """Spans of the cells of merged spans that have one of their four neighbours outside them or outside the canvas."""
    n, wide = (int(grid.max()) + 1 if len(grid) else 0), size + 2
    begun = np.zeros(n * wide * wide + 1, np.int8)
    row = (grid * wide + cy + 1) * wide + 1
    begun[row + x0] += 1
    np.subtract.at(begun, row + x1 + 1, 1)
    m = np.cumsum(begun[:-1], dtype=np.int8).astype(bool).reshape(n, wide, wide)
    core = m[:, 1:-1, 1:-1] & m[:, :-2, 1:-1] & m[:, 2:, 1:-1] & m[:, 1:-1, :-2] & m[:, 1:-1, 2:]
    m[:, 1:-1, 1:-1] &= ~core
    line = m.reshape(-1)
    change = np.flatnonzero(line[1:] != line[:-1]) + 1
    start, end = change[::2], change[1::2] - 1
    r = start // wide
    return r // wide, r % wide - 1, start % wide - 1, end % wide - 1


def outside(grid, side, cy, x0, x1) -> tuple[np.ndarray, ...]:
    """(grid, cy, x0, x1, index): what is left of the spans of side 0 outside those of side 1, with the index of the span."""
    own, hole = np.flatnonzero(side == 0), side == 1
    holes = union(*(a[hole] for a in (grid, cy, x0, x1)))
    both = [np.r_[a[own], h] for a, h in zip((grid, cy, x0, x1), holes, strict=True)]
    g, y, s, e, a, b = overlay(both[0], np.r_[np.zeros(len(own), int), np.ones(len(holes[0]), int)], *both[1:])
    left = (a >= 0) & (b < 0)
    return g[left], y[left], s[left], e[left], own[a[left]]


def nearest(grid, mx, my, radius: int, size: int) -> tuple[np.ndarray, ...]:
    """(grid, cx, cy, d2): the squared distance to the nearest centre, on the cells within ``radius`` rows and columns of one.

    Only a few grids at a time are laid out in full, as many as a core's cache holds; ``grid`` ascends.
    """
    reach = lambda c: (np.maximum(0, np.ceil(c - radius)).astype(np.int64), np.minimum(size - 1, np.floor(c + radius)).astype(np.int64))
    (left, right), (low, high) = reach(mx), reach(my)
    out = []
    for at in range(0, int(grid.max()) + 1 if len(grid) else 0, BLOCK):
        some = slice(*np.searchsorted(grid, (at, at + BLOCK)))
        of, up = counted(np.maximum(0, high - low + 1)[some])
        line = low[some][of] + up
        dy = (line - my[some][of]) ** 2
        row, along = counted(np.maximum(0, right - left + 1)[some][of])
        of = of[row]
        cx = left[some][of] + along
        dx = cx - mx[some][of]
        least = np.full(BLOCK * size * size, np.inf)
        np.minimum.at(least, (((grid[some] - at) * size)[of] + line[row]) * size + cx, dx * dx + dy[row])
        found = np.flatnonzero(least < np.inf)
        out.append((found // (size * size) + at, found % size, found // size % size, least[found]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (grid, grid, grid, mx)

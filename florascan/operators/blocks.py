"""Neighbourhoods over blocks of pixels: one shuffle a stencil, whatever its window.

Images are cut into square blocks of ``BLOCK`` places. A pixel goes to its own block and, where it lies within the window of
a neighbouring block, to that one, too (the halo); a block is several windows wide, so this adds at most 125 % of the rows and
for common windows a few percent. A block becomes one dense plane a column in a task, a stencil is array arithmetic on these
planes, and the block's own pixels leave with the results. A task holds one block at a time, however large its image is.
Places that have no pixel are marked as such; stencils use the pixels that exist.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florascan.operators.pixels import IMAGE

PLACE = [IMAGE, "y", "x"]
BLOCK = 256
Planes = dict[str, np.ndarray]
#: planes and the plane of existing pixels to the planes of results; a result named KEEP tells which pixels stay.
Stencil = Callable[[Planes, np.ndarray], Planes]
KEEP = "__keep"
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}


def tiles_of(df: DataFrame, halo: int, multiple: int = 1) -> tuple[DataFrame, int]:
    """df with the block (__ty, __tx) of each copy of a row, and the side of a block, a multiple of a number."""
    side = -(-max(BLOCK, 4 * halo) // multiple) * multiple

    def blocks(at: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(at) - halo) / side).cast("int"), F.floor((F.col(at) + halo) / side).cast("int")))

    if not halo:
        return df.withColumns({"__ty": F.floor(F.col("y") / side).cast("int"), "__tx": F.floor(F.col("x") / side).cast("int")}), side
    return df.withColumn("__ty", blocks("y")).withColumn("__tx", blocks("x")), side


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """A column as numbers, nulls as NaN."""
    return column.to_numpy().astype(np.float64) if column.null_count else column.to_numpy()


class Laid:
    """The pixels of a block laid out on planes."""

    def __init__(self, rows: pa.Table, side: int) -> None:
        y, x = rows["y"].to_numpy().astype(np.int64), rows["x"].to_numpy().astype(np.int64)
        self.top, self.left = int(y.min()), int(x.min())
        self.v, self.u = y - self.top, x - self.left
        self.shape = (int(self.v.max()) + 1, int(self.u.max()) + 1)
        ty, tx = rows["__ty"][0].as_py(), rows["__tx"][0].as_py()
        self.own = (y // side == ty) & (x // side == tx)
        # the block's own places among those of the planes
        self.inner = np.zeros(self.shape, dtype=bool)
        low_y, low_x = max(0, ty * side - self.top), max(0, tx * side - self.left)
        self.inner[low_y : max(0, (ty + 1) * side - self.top), low_x : max(0, (tx + 1) * side - self.left)] = True

    def plane(self, values: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(self.shape, dtype=values.dtype)
        out[(self.v, self.u) if where is None else (self.v[where], self.u[where])] = values if where is None else values[where]
        return out


def stencil(px: DataFrame, halo: int, inputs: Sequence[str], results: str, compute: Stencil) -> DataFrame:
    """px with the columns ``results`` (name type, ...) that ``compute`` makes of the inputs' planes."""
    added = [T.StructField(f.name, f.dataType) for f in T.StructType.fromDDL(results)]
    names = {f.name for f in added}
    kept = [f for f in px.schema if f.name not in names]
    schema = T.StructType(kept + added)

    def run(rows: pa.Table) -> pa.Table:
        laid = Laid(rows, side)
        exists = laid.plane(np.ones(len(laid.v), dtype=bool))
        made = compute({c: laid.plane(_numbers(rows[c])) for c in inputs}, exists)
        own = laid.own & made[KEEP][laid.v, laid.u] if KEEP in made else laid.own
        out = rows.select([f.name for f in kept]).filter(pa.array(own))
        for f in added:
            out = out.append_column(f.name, pa.array(made[f.name][laid.v[own], laid.u[own]]).cast(ARROW[f.dataType.simpleString()]))
        return out

    tiles, side = tiles_of(px, halo)
    return tiles.groupBy(IMAGE, "__ty", "__tx").applyInArrow(run, schema)


def mask_stencil(mask: DataFrame, px: DataFrame, halo: int, compute: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(image_id, y, x) of the places for which ``compute`` (mask plane, plane of existing pixels) is true."""
    both = px.select(*PLACE, F.lit(False).alias("__in")).unionByName(mask.select(*PLACE, F.lit(True).alias("__in")))
    schema = px.select(*PLACE).schema

    def run(rows: pa.Table) -> pa.Table:
        laid = Laid(rows, side)
        inside = rows["__in"].to_numpy()
        out = compute(laid.plane(inside, inside), laid.plane(~inside, ~inside)) & laid.inner
        v, u = out.nonzero()
        image = pa.array([rows[IMAGE][0].as_py()] * len(v), rows.schema.field(IMAGE).type)
        return pa.table([image, pa.array(v + laid.top), pa.array(u + laid.left)], names=PLACE).cast(pa.schema([rows.schema.field(c) for c in PLACE]))

    tiles, side = tiles_of(both, halo)
    return tiles.groupBy(IMAGE, "__ty", "__tx").applyInArrow(run, schema)


def counts(px: DataFrame, halo: int, inputs: Sequence[str], results: str, compute: Callable[[Planes, np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """(image_id, results): rows that ``compute`` (planes, existing, own places) counts in each block; to be summed up."""
    schema = T.StructType([px.schema[IMAGE], *T.StructType.fromDDL(results)])

    def run(rows: pa.Table) -> pa.Table:
        laid = Laid(rows, side)
        made = compute({c: laid.plane(_numbers(rows[c])) for c in inputs}, laid.plane(np.ones(len(laid.v), dtype=bool)), laid.inner)
        n = len(next(iter(made.values())))
        image = pa.array([rows[IMAGE][0].as_py()] * n, rows.schema.field(IMAGE).type)
        return pa.table([image, *[pa.array(made[f.name]).cast(ARROW[f.dataType.simpleString()]) for f in schema.fields[1:]]], names=schema.names)

    tiles, side = tiles_of(px.select(*PLACE, *inputs), halo)
    return tiles.groupBy(IMAGE, "__ty", "__tx").applyInArrow(run, schema)


# --- plane arithmetic ------------------------------------------------------------------------------------------------


def shifted(plane: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The plane whose place (y, x) holds what the given one has at (y + dy, x + dx); zero from outside."""
    out = np.zeros_like(plane)
    h, w = plane.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = plane[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def _run_sums(plane: np.ndarray, low: int, high: int, axis: int) -> np.ndarray:
    """Sums over the places from low to high (both included) around each place, along an axis."""
    size = plane.shape[axis]
    total = np.concatenate([np.zeros_like(plane.take([0], axis)), plane.cumsum(axis)], axis)
    at = np.arange(size)
    return total.take(np.clip(at + high + 1, 0, size), axis) - total.take(np.clip(at + low, 0, size), axis)


def box_sum(plane: np.ndarray, r: int) -> np.ndarray:
    """Sums over the (2r + 1)-square around each place; the work does not depend on r."""
    return _run_sums(_run_sums(plane, -r, r, 1), -r, r, 0)


def spread(mask: np.ndarray, offsets: Sequence[tuple[int, int]]) -> np.ndarray:
    """Places that mask + offset reaches; a long run of offsets takes one step."""
    out = np.zeros_like(mask)
    for dy in sorted({dy for dy, _ in offsets}):
        dxs = sorted(dx for row, dx in offsets if row == dy)
        starts = [dx for dx in dxs if dx - 1 not in dxs]
        ends = [dx for dx in dxs if dx + 1 not in dxs]
        row = shifted(mask, -dy, 0)
        for start, end in zip(starts, ends):
            if end - start < 8:
                for dx in range(start, end + 1):
                    out |= shifted(row, 0, -dx)
            else:
                out |= _run_sums(row.astype(np.int32), -end, -start, 1) > 0
    return out


def windowed_max(plane: np.ndarray, exists: np.ndarray, r: int) -> np.ndarray:
    """The maximum of the pixels that exist in the (2r + 1)-square: by doubling the width of the window."""
    out = np.where(exists & ~np.isnan(plane), plane, -np.inf)
    for axis in (1, 0):
        width, want = 1, 2 * r + 1
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        line = np.moveaxis(np.pad(out, pad, constant_values=-np.inf), axis, -1)
        while width * 2 <= want:
            line = np.maximum(line[..., : line.shape[-1] - width], line[..., width:])
            width *= 2
        if width < want:
            rest = want - width
            line = np.maximum(line[..., : line.shape[-1] - rest], line[..., rest:])
        out = np.moveaxis(line, -1, axis)
    return out


def windowed_median(plane: np.ndarray, exists: np.ndarray, r: int) -> np.ndarray:
    """The median of the pixels that exist in the (2r + 1)-square (the mean of the middle two of an even number).

    Windows of up to 49 places are sorted place by place. For larger ones values are replaced by their ranks among the block's distinct values. A histogram of ranks a column runs down the block,
    one row entering and one leaving; its sums over columns give each place's histogram. The work a place depends on the
    number of distinct values (256 for a channel), not on the window; ranks are handled in slices where they are many.
    """
    use = exists & ~np.isnan(plane)
    number = box_sum(use.astype(np.int64), r)
    low_at, high_at = np.maximum(number - 1, 0) // 2, number // 2  # zero-based places of the middle values
    if r <= 3:
        padded = np.pad(np.where(use, plane, np.inf), r, constant_values=np.inf)
        h, w = plane.shape
        window = np.sort(np.stack([padded[dy : dy + h, dx : dx + w] for dy in range(2 * r + 1) for dx in range(2 * r + 1)]), 0)
        low, high = (np.take_along_axis(window, np.minimum(at, len(window) - 1)[None], 0)[0] for at in (low_at, high_at))
        return np.where(number > 0, (low + high) / 2, 0)
    levels, rank = np.unique(plane[use], return_inverse=True)
    h, w = plane.shape
    out = np.zeros((h, w))
    if not len(levels):
        return out
    ranks = np.full((h, w), -1, dtype=np.int64)
    ranks[use] = rank
    slice_size = max(1, min(len(levels), 4_000_000 // w))
    for first in range(0, len(levels), slice_size):
        last = min(len(levels), first + slice_size)
        column = np.zeros((w, last - first), dtype=np.int32)
        below = box_sum((use & (ranks < first)).astype(np.int64), r)

        def move(row: int, by: int, column=column, first=first, last=last) -> None:
            if 0 <= row < h:
                here = np.flatnonzero((ranks[row] >= first) & (ranks[row] < last))
                column[here, ranks[row, here] - first] += by

        for row in range(min(r, h)):
            move(row, 1)
        for y in range(h):
            move(y + r, 1)
            move(y - r - 1, -1)
            within = below[y][:, None] + _run_sums(column, -r, r, 0).cumsum(1)
            for place in (low_at, high_at):
                # the first rank up to which there are more values than its place
                hit = (within > place[y][:, None]).argmax(1)
                good = (number[y] > 0) & (within[:, -1] > place[y]) & (below[y] <= place[y])
                out[y, good] += levels[first + hit[good]] / 2
    return out

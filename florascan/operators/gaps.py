"""Gaps between labelled objects: how near they are, and which of them chains of small gaps connect.

Both work on blocks of pixels with a halo as wide as the tolerance (see ``blocks``), a shuffle each.

``object_distances`` lists all pairs of objects nearer than the tolerance; its result, and so its work, grows with the number
of such pairs. ``linked_groups`` only asks what is connected, and its work is linear in the pixels at any tolerance: in a
grid whose cells are so small that any two of their pixels are nearer than the tolerance, all objects of a cell are
connected, and cells are connected if their pixels come near enough. Two cells of a grid are apart in rows or in columns, so
the pixels of each row (or column) that lie closest to the other cell decide, of which a cell has as many as its side.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florascan.operators.blocks import PLACE, Laid, shifted, tiles_of
from florascan.operators.graph import components
from florascan.operators.pixels import IMAGE


def _least_distance(a: np.ndarray, b: np.ndarray, tolerance: float) -> float:
    """The least squared distance between two sets of places (y, x), if below the tolerance's square; else at least that.

    Places are compared with all others or, where that is less work, with the next ones in each row within the tolerance.
    """
    if len(b) > len(a):
        a, b = b, a
    reach = math.ceil(tolerance)
    least = math.inf
    if len(b) <= 60 * reach:
        for start in range(0, len(a), max(1, 2_000_000 // len(b))):
            gap = a[start : start + max(1, 2_000_000 // len(b)), None, :] - b[None, :, :]
            least = min(least, int((gap * gap).sum(2).min()))
        return least
    low, width = int(min(a[:, 1].min(), b[:, 1].min())), int(max(a[:, 1].max(), b[:, 1].max())) + 1
    width = 2 * (width - low) + 2  # neighbours in the order of keys that lie in another row are far off
    keys = np.sort(a[:, 0] * width + (a[:, 1] - low))
    for dy in range(-reach + 1, reach):
        if dy * dy >= least:
            continue
        asked = (b[:, 0] + dy) * width + (b[:, 1] - low)
        at = keys.searchsorted(asked)
        for k in (np.maximum(at - 1, 0), np.minimum(at, len(keys) - 1)):
            gap = keys[k] - asked
            gap = gap[np.abs(gap) < width // 2]
            if len(gap):
                least = min(least, int((gap * gap).min()) + dy * dy)
    return least


def object_distances(labels: DataFrame, tolerance: float) -> DataFrame:
    """(image_id, a, b, distance) of object pairs a < b with pixels nearer than tolerance."""
    halo = max(1, math.ceil(tolerance))
    kind = labels.schema["label"].dataType
    schema = T.StructType([labels.schema[IMAGE], T.StructField("a", kind), T.StructField("b", kind), T.StructField("__d2", T.LongType())])

    def run(rows: pa.Table) -> pa.Table:
        laid = Laid(rows, side)
        label = rows["label"].to_numpy()
        plane = laid.plane(label.astype(np.int64))
        there = laid.plane(np.ones(len(label), dtype=bool))
        edge = np.zeros_like(there)
        for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
            edge |= ~shifted(there, dy, dx) | (shifted(plane, dy, dx) != plane)
        y, x = (there & edge).nonzero()
        own = plane[y, x]
        order = np.argsort(own, kind="stable")
        points, own, inner = np.stack([y, x], 1)[order].astype(np.int64), own[order], laid.inner[y, x][order]
        names, first = np.unique(own, return_index=True)
        last = np.append(first[1:], len(own))
        found: list[tuple[int, int, int]] = []
        if len(names) > 1:
            low = np.stack([np.minimum.reduceat(points[:, k], first) for k in (0, 1)], 1)
            high = np.stack([np.maximum.reduceat(points[:, k], first) for k in (0, 1)], 1)
            for i in range(len(names)):
                inside = points[first[i] : last[i]][inner[first[i] : last[i]]]
                if not len(inside):
                    continue
                gap = np.maximum(np.maximum(low - inside.max(0), inside.min(0) - high), 0)
                for j in ((gap * gap).sum(1) < tolerance * tolerance).nonzero()[0]:
                    if j != i:
                        d2 = _least_distance(inside, points[first[j] : last[j]], tolerance)
                        if d2 < tolerance * tolerance:
                            found.append((int(min(names[i], names[j])), int(max(names[i], names[j])), d2))
        image = pa.array([rows[IMAGE][0].as_py()] * len(found), rows.schema.field(IMAGE).type)
        columns = [pa.array([f[k] for f in found], t) for k, t in ((0, rows.schema.field("label").type), (1, rows.schema.field("label").type), (2, pa.int64()))]
        return pa.table([image, *columns], names=schema.names)

    tiles, side = tiles_of(labels.select(*PLACE, "label"), halo)
    pairs = tiles.groupBy(IMAGE, "__ty", "__tx").applyInArrow(run, schema)
    return pairs.groupBy(IMAGE, "a", "b").agg(F.sqrt(F.min("__d2")).alias("distance"))


def _cell_side(tolerance: float) -> int:
    """The side of the largest cells all of whose pixels are nearer to each other than the tolerance."""
    return math.floor((tolerance - 1e-9) / math.sqrt(2)) + 1


def near_cells(mask: DataFrame, tolerance: float) -> DataFrame:
    """(image_id, ay, ax, by, bx) of pairs of different cells with pixels nearer than the tolerance."""
    cell = _cell_side(tolerance)
    reach = math.floor((tolerance - 1 - 1e-9) / cell) + 1 if tolerance > 1 else 0
    schema = T.StructType([mask.schema[IMAGE], *[T.StructField(c, T.LongType()) for c in ("ay", "ax", "by", "bx")]])
    offsets = [(dy, dx) for dy in range(0, reach + 1) for dx in range(-reach, reach + 1) if (dy, dx) > (0, 0)]
    far = 4 * (reach + 2) * cell  # stands for a row or column without pixels

    def extremes(plane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For cells (cy, cx) and each of their rows: the first and the last pixel's column within the cell."""
        h, w = plane.shape
        rows = plane.reshape(h // cell, cell, w // cell, cell).transpose(0, 2, 1, 3)
        some = rows.any(3)
        return np.where(some, rows.argmax(3), far), np.where(some, cell - 1 - rows[..., ::-1].argmax(3), -far)

    def near(last: np.ndarray, first: np.ndarray, along: int, across: int) -> np.ndarray:
        """Whether cells come near: last pixels of lines of one, first pixels of lines of the other, so many cells apart."""
        out = np.zeros(last.shape[:2], dtype=bool)
        line = np.arange(cell)
        for i in range(cell):
            gap = first + along * cell - last[..., i : i + 1]
            side = line + across * cell - i
            out |= (gap * gap + side * side < tolerance * tolerance).any(2)
        return out

    def run(rows: pa.Table) -> pa.Table:
        laid = Laid(rows, side)
        pad_y, pad_x = laid.top % cell, laid.left % cell
        h, w = (-(-(n + p) // cell) * cell for n, p in zip(laid.shape, (pad_y, pad_x)))
        plane, inner = np.zeros((h, w), dtype=bool), np.zeros((h, w), dtype=bool)
        plane[laid.v + pad_y, laid.u + pad_x] = True
        inner[laid.v[laid.own] + pad_y, laid.u[laid.own] + pad_x] = True
        first_x, last_x = extremes(plane)
        first_y, last_y = (e.transpose(1, 0, 2) for e in extremes(plane.T))
        own = inner.reshape(h // cell, cell, w // cell, cell).any((1, 3))
        cy0, cx0 = (laid.top - pad_y) // cell, (laid.left - pad_x) // cell
        found = []
        for dy, dx in offsets:
            a = (slice(0, max(0, own.shape[0] - dy)), slice(max(0, -dx), max(0, own.shape[1] - max(0, dx))))
            b = (slice(dy, None), slice(max(0, dx), max(0, own.shape[1] + min(0, dx))))
            if not own[a].size:
                continue
            if dx > 0:
                met = near(last_x[a], first_x[b], dx, dy)
            elif dx < 0:
                met = near(last_x[b], first_x[a], -dx, -dy)
            else:
                met = near(last_y[a], first_y[b], dy, dx)
            ys, xs = (met & own[a]).nonzero()
            ys, xs = ys + a[0].start + cy0, xs + a[1].start + cx0
            found.append((ys, xs, ys + dy, xs + dx))
        ends = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        image = pa.array([rows[IMAGE][0].as_py()] * len(ends[0]), rows.schema.field(IMAGE).type)
        return pa.table([image, *[pa.array(e.astype(np.int64)) for e in ends]], names=schema.names)

    tiles, side = tiles_of(mask.select(*PLACE), (reach + 1) * cell, cell)
    return tiles.groupBy(IMAGE, "__ty", "__tx").applyInArrow(run, schema)


def linked_groups(labels: DataFrame, tolerance: float) -> DataFrame:
    """(image_id, label, group): objects that chains of gaps below the tolerance connect share a group."""
    if tolerance <= 0:
        return labels.select(IMAGE, "label").distinct().withColumn("group", _node("object", F.col("label")))
    cell = _cell_side(tolerance)
    at = _node("cell", F.floor(F.col("y") / cell), F.floor(F.col("x") / cell))
    held = labels.select(IMAGE, "label", at.alias("b")).distinct()
    edges = held.select(_node("object", F.col("label")).alias("a"), "b")
    cells = near_cells(labels, tolerance).select(_node("cell", F.col("ay"), F.col("ax")).alias("a"), _node("cell", F.col("by"), F.col("bx")).alias("b"))
    groups = components(edges.unionByName(cells))
    objects = labels.select(IMAGE, "label").distinct().withColumn("node", _node("object", F.col("label")))
    return objects.join(groups, "node").select(IMAGE, "label", F.col("root").alias("group"))


def _node(kind: str, *at: Column) -> Column:
    return F.concat_ws("|", F.lit(kind), F.col(IMAGE).cast("string"), *[c.cast("string") for c in at])

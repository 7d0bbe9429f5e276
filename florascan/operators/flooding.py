"""Values that spread over an image until they settle: grey reconstruction, regional maxima and marker watersheds.

Each is the one fixpoint of a rule between neighbouring pixels, so it does not matter in which order the rule is applied. A
pass settles every block of pixels (with a halo of one) by sweeps over its lines and is written; an image takes part in the
next pass only if a pixel on a border between its blocks changed. The number of passes follows the blocks that a value crosses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florascan.operators import blocks
from florascan.operators.blocks import PLACE, Planes, shifted, stencil
from florascan.operators.neighbourhood import gaussian
from florascan.operators.pixels import IMAGE
from florascan.sources.storage import stored

#: A level that no pixel has, and the cost that belongs to it: cost = level * STEPS + steps taken at that level.
NO_LEVEL = 1 << 30
STEPS = 1 << 32
NO_COST = NO_LEVEL * STEPS


def _sides(connectivity: int) -> tuple[int, ...]:
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    return (0,) if connectivity == 4 else (-1, 0, 1)


def _pairs(planes: Sequence[np.ndarray], sides: tuple[int, ...]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """Views of each line and of its neighbours in the line before, sweeping down, up, right and left."""
    for axis in (0, 1):
        for way in (1, -1):
            lines = [np.moveaxis(p, axis, 0)[::way] for p in planes]
            count, width = lines[0].shape
            for i in range(1, count):
                for d in sides:
                    here, there = slice(max(0, d), width + min(0, d)), slice(max(0, -d), width + min(0, -d))
                    yield [line[i, here] for line in lines], [line[i - 1, there] for line in lines]


def _settle(planes: Sequence[np.ndarray], sides: tuple[int, ...], rule: Callable[[list[np.ndarray], list[np.ndarray]], None]) -> None:
    """Apply a rule, which changes the first plane at a line from its neighbours, until nothing changes."""
    while True:
        before = planes[0].copy()
        for here, there in _pairs(planes, sides):
            rule(here, there)
        if (planes[0] == before).all():
            return


def _passes(px: DataFrame, column: str, inputs: Sequence[str], settle: Callable[[Planes, np.ndarray], np.ndarray]) -> DataFrame:
    """px with ``column`` settled in all blocks; ``settle`` makes a block's plane of it from the inputs' planes."""
    kind = px.schema[column].dataType.simpleString()
    names, done, rest = px.columns, [], px

    def compute(planes: Planes, exists: np.ndarray) -> Planes:
        made = settle(planes, exists)
        return {column: made, "__moved": (made != planes[column]).astype(np.int32)}

    def outer(at: str) -> Column:
        return F.pmod(F.col(at), F.lit(blocks.BLOCK)).isin(0, blocks.BLOCK - 1)

    def block(at: str) -> Column:
        return F.floor(F.col(at) / blocks.BLOCK)

    while True:
        out = stored(stencil(rest, 1, inputs, f"{column} {kind}, __moved int", compute), "flooded")
        several = (F.min(block("y")) < F.max(block("y"))) | (F.min(block("x")) < F.max(block("x")))
        again = out.groupBy(F.col(IMAGE).alias("__image")).agg((several & F.bool_or((F.col("__moved") == 1) & (outer("y") | outer("x")))).alias("__again"))
        again = stored(again.filter("__again").select("__image"), "flooding")
        out = out.select(*names)
        if again.isEmpty():
            for part in done:
                out = out.unionByName(part)
            return out
        same = F.col(IMAGE).eqNullSafe(F.col("__image"))
        done.append(out.join(again, same, "left_anti"))
        rest = out.join(again, same, "left_semi")


def reconstruct(px: DataFrame, seed: str, limit: str, name: str = "level", connectivity: int = 8) -> DataFrame:
    """px with the grey reconstruction by dilation of ``seed`` under ``limit``: values spread and are cut at each pixel's limit.

    A pixel gets the greatest, over all paths to it, of the least of the path's limits and the seed that it starts from; a
    seed above its limit counts as the limit. Pixels whose seed or limit is null or NaN take no part and are left out; values
    do not cross places without a pixel. A place occurs once in px.
    """
    sides = _sides(connectivity)
    whole = all(isinstance(px.schema[c].dataType, T.IntegralType) for c in (seed, limit))
    kind = "bigint" if whole else "double"
    there = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (seed, limit)]
    start = px.filter(there[0] & there[1]).withColumns({name: F.least(F.col(seed), F.col(limit)).cast(kind), "__limit": F.col(limit).cast(kind)})

    def spread(here: list[np.ndarray], before: list[np.ndarray]) -> None:
        np.maximum(here[0], np.minimum(before[0], here[1]), out=here[0])

    def settle(planes: Planes, exists: np.ndarray) -> np.ndarray:
        lowest = np.iinfo(np.int64).min if whole else -np.inf
        level, limits = (np.where(exists, planes[c], lowest) for c in (name, "__limit"))
        _settle([level, limits], sides, spread)
        return level

    return _passes(start, name, [name, "__limit"], settle).drop("__limit")


def regional_maxima(px: DataFrame, channel: str, border: float = 0, size: int = 7) -> DataFrame:
    """(image_id, y, x, smooth, background, peak): what rises above the reconstruction from the image's border.

    The channel is smoothed (Gaussian of that size, sigma (size - 1) / 6, six decimals). The seed is the smoothed channel less
    ``border`` in the image's outermost rows and columns and its least value elsewhere; the background is the reconstruction
    and the peak what the smoothed channel has beyond it. Pixels without a value take no part. A place occurs once in px.
    """
    own = px.filter(F.col(channel).isNotNull()).select(*PLACE, F.col(channel).cast("double").alias("__value"))
    smooth = stored(gaussian(own, "__value", size).select(*PLACE, F.round("smooth", 6).alias("smooth")), "smoothed")
    ends = smooth.groupBy(F.col(IMAGE).alias("__image")).agg(*[f(c).alias(f"__{f.__name__}_{c}") for f in (F.min, F.max) for c in ("y", "x")], F.min("smooth").alias("__least"))
    outermost = (F.col("y") == F.col("__min_y")) | (F.col("y") == F.col("__max_y")) | (F.col("x") == F.col("__min_x")) | (F.col("x") == F.col("__max_x"))
    seeded = smooth.join(ends, F.col(IMAGE).eqNullSafe(F.col("__image"))).select(*PLACE, "smooth", F.when(outermost, F.col("smooth") - border).otherwise(F.col("__least")).alias("__seed"))
    out = reconstruct(seeded, "__seed", "smooth", "background")
    return out.select(*PLACE, "smooth", "background", F.round(F.col("smooth") - F.col("background"), 6).alias("peak"))


def watershed(px: DataFrame, level: str, markers: DataFrame, connectivity: int = 8, lines: bool = False) -> DataFrame:
    """(image_id, y, x, label) of the pixels that the markers (image_id, y, x, label) flood.

    A pixel belongs to the marker that reaches it at the least water level (the highest level on the way); on equal ones to the
    one with fewer steps since the water got that high; on equal ones to the smaller label among the neighbours it came from.
    Markers keep their labels. Levels are whole numbers below 2^30 in size, labels whole numbers below 2^62. With ``lines``,
    pixels next to a basin of a smaller label are left out. Pixels with a null level are walls; of repeated places the
    lowest level and the smallest label count; markers without a pixel or a label are dropped; what no marker reaches is left out.
    """
    sides = _sides(connectivity)
    empty = F.lit(None).cast("bigint")
    rows = px.select(*PLACE, F.col(level).cast("bigint").alias("__level"), empty.alias("label"))
    rows = rows.unionByName(markers.select(*PLACE, empty.alias("__level"), F.col("label").cast("bigint").alias("label")))
    rows = rows.groupBy(*PLACE).agg(F.min("__level").alias("__level"), F.min("label").alias("label")).filter(F.col("__level").isNotNull())
    too_big = F.raise_error(F.lit("levels must be below 2^30 in size"))
    cost = F.when(F.abs("__level") >= NO_LEVEL, too_big.cast("bigint")).when(F.col("label").isNotNull(), F.col("__level") * STEPS).otherwise(NO_COST)
    start = rows.withColumns({"__cost": cost, "__marker": F.col("label").isNotNull().cast("int"), "label": F.coalesce("label", F.lit(NO_COST))})

    def entered(cost: np.ndarray, level: np.ndarray) -> np.ndarray:
        return np.where(level > cost >> 32, level << 32, cost + 1)

    def cheaper(here: list[np.ndarray], before: list[np.ndarray]) -> None:
        np.minimum(here[0], entered(before[0], here[1]), out=here[0])

    def smaller(here: list[np.ndarray], before: list[np.ndarray]) -> None:
        came = (entered(before[1], here[2]) == here[1]) & (here[3] == 0)
        np.minimum(here[0], np.where(came, before[0], NO_COST), out=here[0])

    def costs(planes: Planes, exists: np.ndarray) -> np.ndarray:
        cost, height = np.where(exists, planes["__cost"], NO_COST), np.where(exists, planes["__level"], NO_LEVEL)
        _settle([cost, height], sides, cheaper)
        return cost

    def labels(planes: Planes, exists: np.ndarray) -> np.ndarray:
        label, cost, height = (np.where(exists, planes[c], none) for c, none in (("label", NO_COST), ("__cost", NO_COST), ("__level", NO_LEVEL)))
        _settle([label, cost, height, planes["__marker"]], sides, smaller)
        return label

    flooded = _passes(start, "__cost", ["__cost", "__level"], costs).filter(F.col("__cost") < NO_COST)
    out = _passes(flooded, "label", ["label", "__cost", "__level", "__marker"], labels).select(*PLACE, "label")
    return _without_lines(out, sides) if lines else out


def _without_lines(labels: DataFrame, sides: tuple[int, ...]) -> DataFrame:
    """The pixels that have no neighbour of a smaller label."""
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (len(sides) == 3 or not (dy and dx))]

    def inner(planes: Planes, exists: np.ndarray) -> Planes:
        keep = exists.copy()
        for dy, dx in near:
            keep &= ~(shifted(exists, dy, dx) & (shifted(planes["label"], dy, dx) < planes["label"]))
        return {blocks.KEEP: keep}

    return stencil(labels, 1, ["label"], "", inner)

"""Windows around pixels: box statistics, local thresholds, filters, edges, morphology, textures, votes.

All of them but the votes are stencils on blocks of pixels (see ``blocks``): rows are shuffled once, and their number does not
depend on the window. Borders use the pixels that exist. Channels hold no nulls.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from florascan.operators.blocks import KEEP, PLACE, box_sum, counts, mask_stencil, shifted, spread, stencil, windowed_max, windowed_median
from florascan.operators.pixels import IMAGE


def _odd(n: int) -> int:
    return n + 1 - n % 2


def box_sums(px: DataFrame, values: dict[str, Column], r: int) -> DataFrame:
    """px with each value summed over the (2r + 1)-square around the pixel."""
    df = px.withColumns(values)
    kinds = {n: "long" if isinstance(df.schema[n].dataType, T.IntegralType) else "double" for n in values}
    return stencil(df, r, list(values), ", ".join(f"{n} {kind}" for n, kind in kinds.items()), lambda planes, exists: {n: box_sum(planes[n].astype(np.int64 if kinds[n] == "long" else np.float64), r) for n in kinds})


def box_stats(px: DataFrame, channel: str, r: int) -> DataFrame:
    """px with box_n, box_mean and box_std (population)."""
    v = F.col(channel).cast("double")
    sums = box_sums(px, {"box_n": F.lit(1), "__s": v, "__q": v * v}, r)
    mean = F.col("__s") / F.col("box_n")
    return sums.withColumns({"box_mean": mean, "box_std": F.sqrt(F.greatest(F.lit(0.0), F.round(F.col("__q") / F.col("box_n") - mean * mean, 9)))}).drop("__s", "__q")


def adaptive_mask(px: DataFrame, channel: str, block: int = 3, c: float = 2, method: str = "mean", invert: bool = False) -> DataFrame:
    """v > local mean - c, by a box or a Gaussian mean."""
    if method == "mean":
        df, local = box_stats(px, channel, _odd(block) // 2), F.col("box_mean")
    else:
        df, local = gaussian(px, channel, _odd(block)), F.col("smooth")
    above = F.col(channel) > F.round(local - c, 6)
    return df.filter(~above if invert else above).select(*px.columns)


def niblack(px: DataFrame, channel: str, window: int = 25, k: float = 0.8) -> DataFrame:
    df = box_stats(px, channel, _odd(window) // 2)
    return df.filter(F.col(channel) > F.round(F.col("box_mean") - k * F.col("box_std"), 6)).select(*px.columns)


def sauvola(px: DataFrame, channel: str, window: int = 25, k: float = 0.2, span: float = 128) -> DataFrame:
    df = box_stats(px, channel, _odd(window) // 2)
    return df.filter(F.col(channel) > F.round(F.col("box_mean") * (1 + k * (F.col("box_std") / span - 1)), 6)).select(*px.columns)


def gaussian(px: DataFrame, channel: str, size: int, name: str = "smooth") -> DataFrame:
    """px with a Gaussian mean, sigma (size - 1) / 6, rows and then columns, over the pixels that exist."""
    size, r = _odd(size), _odd(size) // 2
    sigma = max((size - 1) / 6, 1e-6)
    weights = {k: math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)}

    def smooth(planes, exists):
        out, there = np.where(exists, planes[channel], 0).astype(np.float64), exists.astype(np.float64)
        for dy, dx in ((0, 1), (1, 0)):
            total, share = np.zeros_like(out), np.zeros_like(out)
            for k, w in weights.items():
                total += w * shifted(out, k * dy, k * dx)
                share += w * shifted(there, k * dy, k * dx)
            out = np.where(exists, total / np.where(share > 0, share, 1), 0)
        return {name: out}

    return stencil(px, r, [channel], f"{name} double", smooth)


def median_filter(px: DataFrame, channel: str, size: int = 3, name: str = "smooth") -> DataFrame:
    r = _odd(size) // 2
    return stencil(px, r, [channel], f"{name} int", lambda planes, exists: {name: np.floor(windowed_median(planes[channel].astype(np.float64), exists, r)).astype(np.int64)})


def local_max(px: DataFrame, channel: str, r: int, name: str = "smooth") -> DataFrame:
    kind = "double" if isinstance(px.schema[channel].dataType, T.FractionalType) else "long"
    whole = (lambda v: v) if kind == "double" else (lambda v: np.where(np.isfinite(v), v, 0).astype(np.int64))
    return stencil(px, r, [channel], f"{name} {kind}", lambda planes, exists: {name: whole(windowed_max(planes[channel].astype(np.float64), exists, r))})


def de_vignette(px: DataFrame, channel: str, dilate: int = 3, median: int = 3) -> DataFrame:
    """px with flat: 255 - |value - background|, the background being the dilated and median-filtered image."""
    r, m = dilate // 2, _odd(median) // 2

    def background(planes, exists):
        top = windowed_max(planes[channel].astype(np.float64), exists, r)
        return {"__back": np.floor(windowed_median(np.where(exists, top, 0), exists, m)).astype(np.int64)}

    back = stencil(px, r + m, [channel], "__back int", background)
    return back.withColumn("flat", 255 - F.abs(F.col(channel) - F.col("__back"))).drop("__back")


#: Kernels as (dy, dx, weight); a result needs all of its kernel's pixels.
KERNELS = {
    "laplacian": ((0, 0, -4), (0, 1, 1), (0, -1, 1), (1, 0, 1), (-1, 0, 1)),
    "sobel_h": ((-1, -1, 1), (-1, 0, 2), (-1, 1, 1), (1, -1, -1), (1, 0, -2), (1, 1, -1)),
    "sobel_v": ((-1, -1, 1), (0, -1, 2), (1, -1, 1), (-1, 1, -1), (0, 1, -2), (1, 1, -1)),
    "prewitt_h": ((-1, -1, 1), (-1, 0, 1), (-1, 1, 1), (1, -1, -1), (1, 0, -1), (1, 1, -1)),
    "prewitt_v": ((-1, -1, 1), (0, -1, 1), (1, -1, 1), (-1, 1, -1), (0, 1, -1), (1, 1, -1)),
    "roberts_p": ((0, 0, 1), (1, 1, -1)),
    "roberts_n": ((0, 1, 1), (1, 0, -1)),
}


#: Kernels of two directions, taken together as the root of their mean square.
PAIRS = {"sobel": ("sobel_h", "sobel_v"), "prewitt": ("prewitt_h", "prewitt_v"), "roberts": ("roberts_p", "roberts_n")}


def convolutions(px: DataFrame, channel: str, kernels: dict[str, str]) -> DataFrame:
    """(image_id, y, x, and a column for each name) where all of the kernels lie in the image; kernels: name to kernel."""
    steps = {name: KERNELS[kernel] for name, kernel in kernels.items()}

    def convolve(planes, exists):
        plane, keep = planes[channel].astype(np.float64), np.ones_like(exists)
        made = {}
        for name, parts in steps.items():
            made[name] = sum(w * shifted(plane, dy, dx) for dy, dx, w in parts)
            for dy, dx, _ in parts:
                keep = keep & shifted(exists, dy, dx)
        return made | {KEEP: keep}

    out = stencil(px.select(*PLACE, F.col(channel)), 1, [channel], ", ".join(f"{name} double" for name in steps), convolve)
    return out.select(*PLACE, *steps)


def convolve3(px: DataFrame, channel: str, kernel: str, name: str = "edge") -> DataFrame:
    """(image_id, y, x, name) where the whole kernel lies in the image; sobel, prewitt and roberts combine two kernels."""
    if kernel in KERNELS:
        return convolutions(px, channel, {name: kernel})
    a, b = PAIRS[kernel]
    both = convolutions(px, channel, {"__a": a, "__b": b})
    return both.select(*PLACE, F.sqrt((F.col("__a") * F.col("__a") + F.col("__b") * F.col("__b")) / 2).alias(name))


def sharpness(px: DataFrame, channel: str) -> DataFrame:
    """Variance of the Laplacian."""
    return convolve3(px, channel, "laplacian").groupBy(IMAGE).agg(F.var_pop("edge").alias("sharpness"))


RING = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))


def local_binary_pattern(px: DataFrame, channel: str) -> DataFrame:
    """(image_id, y, x, pattern): bit k is set where neighbour k is at least as bright; inner pixels only."""

    def pattern(planes, exists):
        v, bits, keep = planes[channel], np.zeros(exists.shape, dtype=np.int64), np.ones_like(exists)
        for k, (dy, dx) in enumerate(RING):
            bits += (shifted(v, dy, dx) >= v).astype(np.int64) << k
            keep = keep & shifted(exists, dy, dx)
        return {"pattern": bits, KEEP: keep}

    return stencil(px.select(*PLACE, F.col(channel)), 1, [channel], "pattern int", pattern).select(*PLACE, "pattern")


def circle_points(points: int = 8, radius: float = 3) -> list[tuple[int, int, int, float]]:
    """(k, dy, dx, weight): the up to four pixels that each point of the circle mixes, counted from the right, turning up."""
    out = []
    for k in range(points):
        angle = 2 * math.pi * k / points
        fy, fx = round(-radius * math.sin(angle), 5), round(radius * math.cos(angle), 5)
        y0, x0 = math.floor(fy), math.floor(fx)
        parts = [(y0 + j, x0 + i, round(abs(1 - j - fy + y0) * abs(1 - i - fx + x0), 9)) for j in (0, 1) for i in (0, 1)]
        out += [(k, dy, dx, w) for dy, dx, w in parts if w > 0]
    return out


def circular_pattern(px: DataFrame, channel: str, points: int = 8, radius: float = 3) -> DataFrame:
    """(image_id, y, x, pattern): bit k is set where point k of the circle is at least as bright, between pixels by their mix.

    Only places whose whole circle lies in the image have one.
    """
    steps = circle_points(points, radius)

    def pattern(planes, exists):
        v = planes[channel].astype(np.float64)
        bits, keep = np.zeros(exists.shape, dtype=np.int64), exists.copy()
        for k in range(points):
            own = [(dy, dx, w) for at, dy, dx, w in steps if at == k]
            bits += (np.round(sum(w * shifted(v, dy, dx) for dy, dx, w in own), 5) >= v).astype(np.int64) << k
            for dy, dx, _ in own:
                keep = keep & shifted(exists, dy, dx)
        return {"pattern": bits, KEEP: keep}

    return stencil(px.select(*PLACE, F.col(channel)), math.ceil(radius) + 1, [channel], "pattern long", pattern).select(*PLACE, "pattern")


def cut_levels(df: DataFrame, column: str, lower: float = 0, upper: float = 0) -> DataFrame:
    """column with levels below lower percent of the image's maximum at zero, and those above 100 - upper percent of it there."""
    top = df.groupBy(IMAGE).agg(F.max(column).alias("__top"))
    v, least, most = F.col(column), F.round(F.col("__top") * lower / 100, 6), F.round(F.col("__top") * (100 - upper) / 100, 6)
    return df.join(top, IMAGE).withColumn(column, F.when(v < least, 0.0).when(v > most, most).otherwise(v.cast("double"))).drop("__top")


def glcm(px: DataFrame, channel: str, distances: Sequence[int] = (1, 10), angles: Sequence[float] = (0.0, math.pi / 4), levels: int = 256) -> DataFrame:
    """Grey co-occurrence features (image_id, distance, angle, contrast, dissimilarity, homogeneity, energy, correlation, asm).

    Each pixel meets the one distance away at the angle; pairs are not mirrored.
    """
    steps = [(round(math.sin(a) * d), round(math.cos(a) * d), d, round(a, 6)) for d in distances for a in angles]

    def pairs_of(planes, exists, own):
        grey = planes["grey"].astype(np.int64)
        found = []
        for dy, dx, d, a in steps:
            met = own & exists & shifted(exists, dy, dx)
            n = np.bincount(grey[met] * levels + shifted(grey, dy, dx)[met], minlength=1)
            code = n.nonzero()[0]
            found.append((np.full(len(code), d), np.full(len(code), a), code // levels, code % levels, n[code]))
        return dict(zip(("distance", "angle", "i", "j", "n"), map(np.concatenate, zip(*found))))

    halo = max((max(abs(dy), abs(dx)) for dy, dx, _, _ in steps), default=0)
    grey = px.select(*PLACE, F.floor(F.col(channel) * levels / 256).cast("int").alias("grey"))
    pairs = counts(grey, halo, ["grey"], "distance int, angle double, i int, j int, n long", pairs_of).groupBy(IMAGE, "distance", "angle", "i", "j").agg(F.sum("n").alias("n"))
    group = [IMAGE, "distance", "angle"]
    p = pairs.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*group)))
    i, j, q = F.col("i"), F.col("j"), F.col("p")
    m = p.groupBy(*group).agg(
        F.sum(q * (i - j) * (i - j)).alias("contrast"), F.sum(q * F.abs(i - j)).alias("dissimilarity"), F.sum(q / (1 + (i - j) * (i - j))).alias("homogeneity"), F.sum(q * q).alias("asm"),
        F.sum(q * i).alias("mi"), F.sum(q * j).alias("mj"), F.sum(q * i * i).alias("qi"), F.sum(q * j * j).alias("qj"), F.sum(q * i * j).alias("qij"),
    )
    si, sj = F.sqrt(F.col("qi") - F.col("mi") * F.col("mi")), F.sqrt(F.col("qj") - F.col("mj") * F.col("mj"))
    correlation = F.when(si * sj > 1e-12, (F.col("qij") - F.col("mi") * F.col("mj")) / (si * sj)).otherwise(1.0)
    return m.select(*group, "contrast", "dissimilarity", "homogeneity", F.sqrt("asm").alias("energy"), correlation.alias("correlation"), "asm")


# --- morphology ------------------------------------------------------------------------------------------------------


def structuring_element(size: int = 3, shape: str = "ellipse") -> list[tuple[int, int]]:
    """Offsets (dy, dx) of an odd-sized rectangle, cross or ellipse."""
    r = _odd(size) // 2
    square = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    if shape == "rectangle":
        return square
    if shape == "cross":
        return [(dy, dx) for dy, dx in square if dy == 0 or dx == 0]
    return [(dy, dx) for dy, dx in square if abs(dx) <= round(r * math.sqrt(1 - dy * dy / (r * r)) if r else 0)]


def _grown(mask: np.ndarray, exists: np.ndarray, offsets: Sequence[tuple[int, int]], times: int) -> np.ndarray:
    for _ in range(times):
        mask = spread(mask, offsets) & exists
    return mask


def _shrunk(mask: np.ndarray, exists: np.ndarray, offsets: Sequence[tuple[int, int]], times: int) -> np.ndarray:
    return mask & ~_grown(exists & ~mask, exists, offsets, times)


#: What each operation does to planes, and the windows that it looks through.
STEPS = {
    "erode": (_shrunk, 1),
    "dilate": (_grown, 1),
    "open": (lambda m, *e: _grown(_shrunk(m, *e), *e), 2),
    "close": (lambda m, *e: _shrunk(_grown(m, *e), *e), 2),
    "gradient": (lambda m, *e: _grown(m, *e) & ~_shrunk(m, *e), 1),
}


def morphology(mask: DataFrame, px: DataFrame, op: str, size: int = 3, shape: str = "ellipse", iterations: int = 1) -> DataFrame:
    """The mask after none, erode, dilate, open, close or gradient by an element of the shape, in one pass over the blocks."""
    if op == "none":
        return mask
    offsets, (change, windows) = structuring_element(size, shape), STEPS[op]
    return mask_stencil(mask, px, windows * iterations * (_odd(size) // 2), lambda m, exists: change(m, exists, offsets, iterations))


def dilate(mask: DataFrame, px: DataFrame, size: int = 3, shape: str = "ellipse", iterations: int = 1) -> DataFrame:
    """Places of px that an element of the shape around some mask pixel reaches."""
    return morphology(mask, px, "dilate", size, shape, iterations)


def erode(mask: DataFrame, px: DataFrame, size: int = 3, shape: str = "ellipse", iterations: int = 1) -> DataFrame:
    """Mask pixels that no element around a pixel outside the mask reaches."""
    return morphology(mask, px, "erode", size, shape, iterations)


def open_(mask: DataFrame, px: DataFrame, **element) -> DataFrame:
    return morphology(mask, px, "open", **element)


def close_(mask: DataFrame, px: DataFrame, **element) -> DataFrame:
    return morphology(mask, px, "close", **element)


def gradient(mask: DataFrame, px: DataFrame, **element) -> DataFrame:
    return morphology(mask, px, "gradient", **element)


# --- votes -----------------------------------------------------------------------------------------------------------


def hough_lines(mask: DataFrame, threshold: int, step_degrees: int = 3, only_horizontal: bool = False) -> DataFrame:
    """(image_id, rho, theta, votes) of the lines x cos + y sin = rho that at least threshold pixels lie on."""
    degrees = [90] if only_horizontal else list(range(0, 180, step_degrees))
    theta = F.explode(F.array(*[F.struct(F.lit(d).alias("theta"), F.lit(round(math.cos(math.radians(d)), 12)).alias("c"), F.lit(round(math.sin(math.radians(d)), 12)).alias("s")) for d in degrees]))
    votes = mask.select(IMAGE, "y", "x", theta.alias("t")).groupBy(IMAGE, F.floor(F.round(F.col("x") * F.col("t.c") + F.col("y") * F.col("t.s"), 6) + 0.5).cast("int").alias("rho"), F.col("t.theta").alias("theta")).agg(F.count(F.lit(1)).alias("votes"))
    return votes.filter(F.col("votes") >= threshold)


def hough_circles(mask: DataFrame, radii: Sequence[int], top: int = 3, step_degrees: int = 10) -> DataFrame:
    """(image_id, r, cy, cx, votes): the top centres of each radius by votes, shares of the circle's distinct places."""
    rings = []
    for r in radii:
        places = sorted({(round(r * math.sin(math.radians(a))), round(r * math.cos(math.radians(a)))) for a in range(0, 360, step_degrees)})
        rings += [(r, dy, dx) for dy, dx in places]
    ask = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for r, dy, dx in rings]))
    votes = mask.select(IMAGE, "y", "x", ask.alias("o")).groupBy(IMAGE, F.col("o.r").alias("r"), (F.col("y") - F.col("o.dy")).alias("cy"), (F.col("x") - F.col("o.dx")).alias("cx")).agg(F.count(F.lit(1)).alias("votes"))
    rank = F.row_number().over(W.partitionBy(IMAGE, "r").orderBy(F.desc("votes"), "cy", "cx"))
    return votes.withColumn("__k", rank).filter(F.col("__k") <= top).drop("__k")


def downscale(px: DataFrame, k: int, channels: Sequence[str] = ("b", "g", "r")) -> DataFrame:
    """Means of k by k blocks."""
    return px.groupBy(IMAGE, F.expr(f"cast(y div {k} as int)").alias("y"), F.expr(f"cast(x div {k} as int)").alias("x")).agg(*[F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in channels])

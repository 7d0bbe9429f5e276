"""Histograms and what follows from them: statistics, thresholds, equalisation, balance.

Pixels are unpivoted once to (image, channel, value) and pre-aggregated to at most 256 rows for each image and channel;
all else works on these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from florascan.operators.pixels import IMAGE, brightness_of, chlorophyll, exposure_zone, lut_apply, stretch
from florascan.sources.storage import stored

BGR = ("b", "g", "r")


def unpivot(px: DataFrame, channels: Sequence[str] = BGR) -> DataFrame:
    pairs = ", ".join(f"'{c}', `{c}`" for c in channels)
    return px.select(IMAGE, F.expr(f"stack({len(channels)}, {pairs}) as (channel, value)"))


def value_counts(px: DataFrame, channels: Sequence[str] = BGR) -> DataFrame:
    """(image_id, channel, value, n)."""
    return unpivot(px, channels).groupBy(IMAGE, "channel", "value").agg(F.count(F.lit(1)).alias("n"))


def histogram(px: DataFrame, channels: Sequence[str] = BGR, bins: int = 256, include_max: bool = False) -> DataFrame:
    """(image_id, channel, bin, n) over [0, 255); value 255 is in no bin unless include_max puts it in the last."""
    counts = value_counts(px, channels)
    counts = counts if include_max else counts.filter("value < 255")
    slot = F.least(F.lit(bins - 1), F.floor(F.col("value") * bins / 255).cast("int"))
    return counts.groupBy(IMAGE, "channel", slot.alias("bin")).agg(F.sum("n").alias("n"))


def histogram_sheet(px: DataFrame, channels: Sequence[str] = BGR, bins: int = 256) -> DataFrame:
    """One row for each image and channel, one column for each bin."""
    wide = histogram(px, channels, bins).groupBy(IMAGE, "channel").pivot("bin", list(range(bins))).sum("n")
    return wide.select(IMAGE, "channel", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"bin_{k}") for k in range(bins)])


def channel_stats(px: DataFrame, channels: Sequence[str] = BGR) -> DataFrame:
    """(image_id, channel, mean, std): population deviation; filter px by a mask first where one is wanted."""
    return unpivot(px, channels).groupBy(IMAGE, "channel").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def stats_text(stats: DataFrame, digits: int = 2) -> DataFrame:
    return stats.withColumn("text", F.concat_ws(" +/- ", F.format_number("mean", digits), F.format_number("std", digits)))


def colour_quantiles(px: DataFrame, n: int = 4, channels: Sequence[str] = BGR) -> DataFrame:
    """One column for each channel and quantile: percent of the counted pixels in each of n equal ranges."""
    h = histogram(px, channels, n)
    share = h.withColumn("p", 100 * F.col("n") / F.sum("n").over(W.partitionBy(IMAGE, "channel")))
    return share.groupBy(IMAGE).agg(*[F.coalesce(F.max(F.when((F.col("channel") == c) & (F.col("bin") == k), F.col("p"))), F.lit(0.0)).alias(f"quantile_color_{c}_{k + 1}_{n}_percent") for c in channels for k in range(n)])


def cumulative(counts: DataFrame) -> DataFrame:
    """counts with below (pixels up to the value), total."""
    group = W.partitionBy(IMAGE, "channel")
    return counts.withColumns({"below": F.sum("n").over(group.orderBy("value").rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("n").over(group)})


def percentile_bounds(px: DataFrame, low: float, high: float, channels: Sequence[str] = BGR) -> DataFrame:
    """(image_id, channel, lo, hi): the least values whose cumulative shares reach low and 1 - high."""
    c = cumulative(value_counts(px, channels)).withColumn("share", F.col("below") / F.col("total"))
    lo, hi = F.min(F.when(F.col("share") >= low, F.col("value"))), F.min(F.when(F.col("share") >= 1 - high, F.col("value")))
    return c.groupBy(IMAGE, "channel").agg(lo.alias("lo"), hi.alias("hi"))


def _wide(bounds: DataFrame, channels: Sequence[str]) -> DataFrame:
    return bounds.groupBy(IMAGE).agg(*[F.max(F.when(F.col("channel") == c, F.col(e))).alias(f"__{c}_{e}") for c in channels for e in ("lo", "hi")])


def clip_outliers(px: DataFrame, low: float = 0.02, high: float = 0.02, channels: Sequence[str] = BGR) -> DataFrame:
    joined = px.join(_wide(percentile_bounds(px, low, high, channels), channels), IMAGE)
    return joined.withColumns({c: F.greatest(F.col(f"__{c}_lo"), F.least(F.col(f"__{c}_hi"), F.col(c))) for c in channels}).drop(*[f"__{c}_{e}" for c in channels for e in ("lo", "hi")])


def white_balance(px: DataFrame, low: float = 0.02, high: float = 0.02, channels: Sequence[str] = BGR) -> DataFrame:
    """Each channel clipped at its percentiles and stretched over 0..255."""
    joined = px.join(_wide(percentile_bounds(px, low, high, channels), channels), IMAGE)
    return joined.withColumns({c: stretch(F.col(c), F.col(f"__{c}_lo"), F.col(f"__{c}_hi")) for c in channels}).drop(*[f"__{c}_{e}" for c in channels for e in ("lo", "hi")])


def brightness(px: DataFrame, mode: str = "std") -> DataFrame:
    value = brightness_of(mode)
    return px.groupBy(IMAGE).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def image_stats(px: DataFrame, channels: Sequence[str]) -> DataFrame:
    """mean, std, min and max of perceived brightness and of each channel, in one pass."""
    measures = {"brightness": brightness_of("p2")} | {c: F.col(c) for c in channels}
    return px.groupBy(IMAGE).agg(*[f(v).alias(f"{n}_{s}") for n, v in measures.items() for s, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


def chlorophyll_stats(px: DataFrame) -> DataFrame:
    return px.groupBy(IMAGE).agg(F.avg(chlorophyll()).alias("chlorophyll_mean"), F.stddev_pop(chlorophyll()).alias("chlorophyll_std"))


def exposure(px: DataFrame, **limits: int) -> DataFrame:
    """Percent of over-, under-exposed and grey pixels."""
    zone = exposure_zone(**limits)
    return px.groupBy(IMAGE).agg(*[(100 * F.count_if(zone == z) / F.count(F.lit(1))).alias(z) for z in ("over", "under", "grey")])


def area_ratio(px: DataFrame, condition: Column) -> DataFrame:
    """Share of an image's masked pixels that meet a further condition."""
    return px.groupBy(IMAGE).agg((F.count_if(condition) / F.count(F.lit(1))).alias("ratio"))


def otsu_thresholds(px: DataFrame, channels: Sequence[str] = BGR) -> DataFrame:
    """(image_id, channel, threshold): the least t that maximises n0 n1 (m0 - m1)^2, classes v <= t and v > t."""
    group = W.partitionBy(IMAGE, "channel")
    up = group.orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    mass = F.col("n") * F.col("value")
    c = value_counts(px, channels).withColumns({"n0": F.sum("n").over(up), "s0": F.sum(mass).over(up), "n_all": F.sum("n").over(group), "s_all": F.sum(mass).over(group)})
    n1 = F.col("n_all") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("s_all") - F.col("s0")) / n1
    c = c.filter("n0 < n_all").withColumn("score", F.round(F.col("n0").cast("double") * n1 * gap * gap, 3))
    return c.groupBy(IMAGE, "channel").agg(F.min_by("value", F.struct(-F.col("score"), F.col("value"))).alias("threshold"))


def triangle_thresholds(px: DataFrame, channels: Sequence[str] = BGR) -> DataFrame:
    """(image_id, channel, threshold): the value farthest below the line from the histogram's peak to the end of its longer tail."""
    h = value_counts(px, channels)
    peak = h.groupBy(IMAGE, "channel").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("peak"), F.max("n").alias("top"), F.min("value").alias("first"), F.max("value").alias("last"))
    tail = F.when(F.col("peak") - F.col("first") > F.col("last") - F.col("peak"), F.col("first")).otherwise(F.col("last"))
    j = h.join(peak.withColumn("tail", tail), [IMAGE, "channel"]).filter((F.col("value") >= F.least("peak", "tail")) & (F.col("value") <= F.greatest("peak", "tail")))
    line = F.col("top") * F.abs(F.col("value") - F.col("tail")) / F.greatest(F.abs(F.col("peak") - F.col("tail")), F.lit(1))
    j = j.withColumn("drop", F.round(line - F.col("n"), 6))
    return j.groupBy(IMAGE, "channel").agg(F.min_by("value", F.struct(-F.col("drop"), F.col("value"))).alias("threshold"))


def above_threshold(px: DataFrame, thresholds: DataFrame, channel: str, invert: bool = False) -> DataFrame:
    own = thresholds.filter(F.col("channel") == channel).select(IMAGE, F.col("threshold").alias("__t"))
    above = F.col(channel) > F.col("__t")
    return px.join(own, IMAGE).filter(~above if invert else above).drop("__t")


def otsu_merge(px: DataFrame, channels: Sequence[str] = BGR, weighted: bool = True) -> DataFrame:
    """px with merged: the sum over channels of 1, or 2 to the channel's number, where the pixel is above its threshold."""
    wide = otsu_thresholds(px, channels).groupBy(IMAGE).agg(*[F.max(F.when(F.col("channel") == c, F.col("threshold"))).alias(f"__t_{c}") for c in channels])
    total = F.lit(0)
    for k, c in enumerate(channels):
        total = total + F.when(F.col(c) > F.col(f"__t_{c}"), 2**k if weighted else 1).otherwise(0)
    return px.join(wide, IMAGE).withColumn("merged", total).drop(*[f"__t_{c}" for c in channels])


def equalize_lut(px: DataFrame, channels: Sequence[str] = BGR) -> DataFrame:
    """(image_id, channel, value, mapped): round((cdf - cdf_min) / (N - cdf_min) 255)."""
    c = cumulative(value_counts(px, channels)).withColumn("least", F.min("below").over(W.partitionBy(IMAGE, "channel")))
    mapped = F.when(F.col("total") > F.col("least"), F.floor((F.col("below") - F.col("least")) * 255 / (F.col("total") - F.col("least")) + 0.5).cast("int")).otherwise(F.col("value"))
    return c.select(IMAGE, "channel", "value", mapped.alias("mapped"))


def equalize(px: DataFrame, channels: Sequence[str] = BGR) -> DataFrame:
    lut = equalize_lut(px, channels)
    for c in channels:
        px = lut_apply(px, lut, c)
    return px


def equalize_luma(px: DataFrame) -> DataFrame:
    """px with its luma (Y of YUV) equalised and its colour differences kept; Y, U and V are held in eight bits."""
    byte = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.round(v, 6) + 0.5))).cast("int")
    luma, b, r = F.col("__luma"), F.col("b"), F.col("r")
    yuv = px.withColumn("__luma", byte(0.299 * r + 0.587 * F.col("g") + 0.114 * b)).withColumns({"__u": byte(0.492 * (b - luma) + 128), "__v": byte(0.877 * (r - luma) + 128)})
    u, v = F.col("__u") - 128, F.col("__v") - 128
    flat = lut_apply(yuv, equalize_lut(yuv, ["__luma"]), "__luma")
    return flat.withColumns({"b": byte(luma + 2.032 * u), "g": byte(luma - 0.395 * u - 0.581 * v), "r": byte(luma + 1.140 * v)}).select(*px.columns)


def clahe(px: DataFrame, channel: str, tile: int = 8, clip: float = 2.0) -> DataFrame:
    """Tiled, clipped equalisation: px with equalized, blended between the four nearest tile centres.

    A tile's histogram is cut at clip times its mean bin and what is cut is spread over all 256 values.
    """
    cell = px.select(IMAGE, F.expr(f"y div {tile}").alias("ty"), F.expr(f"x div {tile}").alias("tx"), F.col(channel).alias("value"))
    counts = cell.groupBy(IMAGE, "ty", "tx", "value").agg(F.count(F.lit(1)).alias("n"))
    where = W.partitionBy(IMAGE, "ty", "tx")
    counts = counts.withColumn("total", F.sum("n").over(where))
    limit = F.greatest(F.lit(1.0), F.col("total") * clip / 256)
    counts = counts.withColumn("kept", F.least(F.col("n").cast("double"), limit)).withColumn("spread", (F.col("total") - F.sum("kept").over(where)) / 256)
    full = counts.groupBy(IMAGE, "ty", "tx", "total", "spread").agg(F.map_from_entries(F.collect_list(F.struct("value", "kept"))).alias("bins"))  # at most 256 entries
    steps = full.select(IMAGE, "ty", "tx", "total", "spread", "bins", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("value"))
    steps = steps.withColumn("m", F.coalesce(F.element_at("bins", F.col("value")), F.lit(0.0)) + F.col("spread"))
    lut = steps.withColumn("mapped", F.sum("m").over(where.orderBy("value").rowsBetween(W.unboundedPreceding, 0)) * 255 / F.col("total")).select(IMAGE, "ty", "tx", "value", "mapped")

    fy, fx = (F.col("y") + 0.5) / tile - 0.5, (F.col("x") + 0.5) / tile - 0.5
    corners = F.array(*[F.struct((F.floor(fy) + dy).cast("int").alias("ty"), (F.floor(fx) + dx).cast("int").alias("tx"), ((F.lit(1.0) - F.abs(fy - F.floor(fy) - dy)) * (F.lit(1.0) - F.abs(fx - F.floor(fx) - dx))).alias("w")) for dy in (0, 1) for dx in (0, 1)])
    ask = px.select("*", F.explode(corners).alias("c")).select(*px.columns, "c.ty", "c.tx", "c.w")
    lookup = lut.withColumnRenamed("value", channel)
    found = ask.join(lookup, [IMAGE, "ty", "tx", channel])
    keys = list(px.columns)
    return found.groupBy(*keys).agg(F.floor(F.round(F.sum(F.col("mapped") * F.col("w")) / F.sum("w"), 6) + 0.5).cast("int").alias("equalized"))


def kmeans_colours(px: DataFrame, k: int = 4, rounds: int = 5, channels: Sequence[str] = BGR) -> DataFrame:
    """px with cluster and the cluster's colour: Lloyd rounds for each image over its distinct colours, started at evenly spaced greys.

    The colours are counted and written once, and so is each round's result, k rows an image: no plan holds the rounds before it.
    """
    colours = stored(px.groupBy(IMAGE, *channels).agg(F.count(F.lit(1)).alias("n")), "colours")
    start = F.array(*[F.struct(F.lit(j).alias("j"), *[F.lit(255.0 * (2 * j + 1) / (2 * k)).alias(c) for c in channels]) for j in range(k)])
    centres = colours.select(IMAGE).distinct().withColumn("centres", start)

    def nearest(centres: DataFrame, df: DataFrame) -> DataFrame:
        def gap(c: Column) -> Column:
            return F.struct(sum((F.col(ch) - c[ch]) * (F.col(ch) - c[ch]) for ch in channels).alias("d"), c["j"].alias("j"), *[c[ch].alias(ch) for ch in channels])

        return df.join(centres, IMAGE).withColumn("best", F.array_min(F.transform("centres", gap)))

    for _ in range(rounds):
        near = nearest(centres, colours)
        moved = near.groupBy(IMAGE, F.col("best.j").alias("j")).agg(*[F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 6).alias(c) for c in channels])
        centres = stored(moved.groupBy(IMAGE).agg(F.array_sort(F.collect_list(F.struct("j", *channels))).alias("centres")), "centres")  # at most k
    best = nearest(centres, px)
    return best.select(*[c for c in px.columns], F.col("best.j").alias("cluster"), *[F.floor(F.col(f"best.{c}") + 0.5).cast("int").alias(f"{c}_centre") for c in channels])

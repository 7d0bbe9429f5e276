"""Point operators on pixels: channels, thresholds, arithmetic, balance. A pixel table has image_id, channels b, g, r and, where place matters, y and x.

Nothing here shuffles unless a statistic of the image is part of the definition; such statistics are joined back from one
aggregated row for each image.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE = "image_id"


def clip8(v: Column) -> Column:
    """Nearest whole number in 0 to 255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v + 0.5).cast("int")))


def hsv(b: Column, g: Column, r: Column) -> dict[str, Column]:
    """Eight-bit hue (half degrees, 0 to 179), saturation and value."""
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    span = (top - low).cast("double")
    degrees = F.when(span == 0, 0.0).when(top == r, 60 * (g - b) / span).when(top == g, 120 + 60 * (b - r) / span).otherwise(240 + 60 * (r - g) / span)
    hue = F.floor(F.when(degrees < 0, degrees + 360).otherwise(degrees) / 2 + 0.5).cast("int") % 180
    return {"h": hue, "s": F.when(top == 0, F.lit(0)).otherwise(F.floor(255 * span / top + 0.5).cast("int")), "v": top}


def lab(b: Column, g: Column, r: Column) -> dict[str, Column]:
    """Eight-bit CIE L*a*b* (D65) of sRGB."""

    def linear(c: Column) -> Column:
        u = c / 255.0
        return F.when(u > 0.04045, F.pow((u + 0.055) / 1.055, F.lit(2.4))).otherwise(u / 12.92)

    lb, lg, lr = linear(b), linear(g), linear(r)
    x = (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456
    y = 0.212671 * lr + 0.715160 * lg + 0.072169 * lb
    z = (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)

    lum = F.when(y > 0.008856, 116 * F.cbrt(y) - 16).otherwise(903.3 * y)
    return {"l": clip8(lum * 255 / 100), "a": clip8(500 * (f(x) - f(y)) + 128), "bb": clip8(200 * (f(y) - f(z)) + 128)}


def channels(px: DataFrame, which: Sequence[str]) -> DataFrame:
    """px with columns h, s, v, l, a, bb (the b of Lab), rd, gr, bl as asked for."""
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    made = {"rd": r, "gr": g, "bl": b} | hsv(b, g, r) | lab(b, g, r)
    return px.withColumns({c: made[c] for c in which})


def in_range(channel: str, low: int, high: int) -> Column:
    """Inclusive; bounds given the wrong way round are swapped."""
    return F.col(channel).between(min(low, high), max(low, high))


def range_mask(px: DataFrame, channel: str, low: int = 0, high: int = 255) -> DataFrame:
    return px.filter(in_range(channel, low, high))


def multi_range_mask(px: DataFrame, ranges: Sequence[tuple[str, int, int]], merge: str = "and") -> DataFrame:
    """Up to three ranges, all or any of which must hold."""
    if not 1 <= len(ranges) <= 3:
        raise ValueError("one to three ranges")
    each = [in_range(*r) for r in ranges]
    return px.filter(reduce((lambda a, b: a & b) if merge == "and" else (lambda a, b: a | b), each))


def split_range_mask(px: DataFrame, inside: Column, channel: str, within: tuple[int, int], without: tuple[int, int]) -> DataFrame:
    """One range inside the regions, another outside."""
    return px.filter(F.when(inside, in_range(channel, *within)).otherwise(in_range(channel, *without)))


def grey(b: Column | str = "b", g: Column | str = "g", r: Column | str = "r") -> Column:
    b, g, r = (F.col(c) if isinstance(c, str) else c for c in (b, g, r))
    return F.floor(F.round(0.114 * b + 0.587 * g + 0.299 * r, 6) + 0.5).cast("int")


def image_to_mask(px: DataFrame, threshold: int = 0) -> DataFrame:
    return px.filter(grey() > threshold)


def invert_mask(px: DataFrame, mask: DataFrame, place: Sequence[str] = (IMAGE, "y", "x")) -> DataFrame:
    return px.select(*place).join(mask.select(*place), list(place), "left_anti")


def with_image_range(df: DataFrame, value: str) -> DataFrame:
    """df with the least and greatest value of its image as __low and __high."""
    ends = df.groupBy(IMAGE).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    return df.join(ends, IMAGE)


def rescale8(df: DataFrame, value: str, name: str | None = None) -> DataFrame:
    """value stretched over 0 to 255 within its image and cut to whole numbers; a flat image becomes 0."""
    scaled = F.when(F.col("__high") > F.col("__low"), (F.col(value) - F.col("__low")) / (F.col("__high") - F.col("__low")) * 255).otherwise(0.0)
    return with_image_range(df, value).withColumn(name or value, F.floor(scaled + 1e-9).cast("int")).drop("__low", "__high")


def to_fuzzy(df: DataFrame, value: str, name: str) -> DataFrame:
    """value stretched over 0 to 1 within its image."""
    scaled = F.when(F.col("__high") > F.col("__low"), (F.col(value) - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(0.0)
    return with_image_range(df, value).withColumn(name, scaled).drop("__low", "__high")


def to_bit(value: Column, threshold: int = 0) -> Column:
    return F.when(value > threshold, 1).otherwise(0)


def transfer(df: DataFrame, value: str, curve: str, name: str) -> DataFrame:
    """A curve over the image's range: sigmoid over -5 to 5, logit within 0.001 to 0.999, arcsin, sqrt, log, or none; then 0 to 255."""
    df = to_fuzzy(df, value, "__u")
    u = F.col("__u")
    inner = F.greatest(F.lit(0.001), F.least(F.lit(0.999), u))
    curves = {"none": u, "sigmoid": 1 / (1 + F.exp(-(u * 10 - 5))), "logit": F.log(inner / (1 - inner)), "arcsin": F.asin(u), "sqrt": F.sqrt(u), "log": F.log(u * 254 + 1)}
    return rescale8(df.withColumn("__v", F.round(curves[curve], 9)), "__v", name).drop("__u", "__v")


def _operate(left: Column, op: str, right: Column, zero_safe: bool = False) -> Column:
    if op == "/":
        return F.when(right == 0, 0.0 if zero_safe else F.lit(None)).otherwise(left / right)
    return {"+": lambda: left + right, "-": lambda: left - right, "*": lambda: left * right, "^": lambda: F.pow(left, right)}[op]()


def channel_operation(px: DataFrame, c1: str, a: float, op1: str, c2: str, b: float, op2: str, c3: str, g: float, cut_negative: bool = False, name: str = "value") -> DataFrame:
    """(a c1 op1 b c2) op2 g c3 with weights in percent, rescaled to 0..255 within the image; division by zero gives 0."""
    first = _operate(F.col(c1) * a / 100, op1, F.col(c2) * b / 100, zero_safe=True)
    value = F.round(F.coalesce(_operate(first, op2, F.col(c3) * g / 100, zero_safe=True), F.lit(0.0)), 9)
    return rescale8(px.withColumn("__op", F.greatest(value, F.lit(0.0)) if cut_negative else value), "__op", name).drop("__op")


def channel_subtraction(px: DataFrame, c1: str, c2: str, a: float = 100, b: float = 100, post: str = "normalize", name: str = "value") -> DataFrame:
    """a c1 - b c2 in percent; post: normalize, cut_negative, cut_negative_and_normalize or rescale (halved around 127)."""
    value = F.round(F.col(c1) * a / 100 - F.col(c2) * b / 100, 9)
    if post == "cut_negative":
        return px.withColumn(name, F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0))).cast("int"))
    if post == "rescale":
        return px.withColumn(name, clip8((value + 255) / 2))
    cut = F.greatest(value, F.lit(0.0)) if post == "cut_negative_and_normalize" else value
    return rescale8(px.withColumn("__op", cut), "__op", name).drop("__op")


def mix_channels(px: DataFrame, weights: Sequence[float], names: Sequence[str] = ("b", "g", "r")) -> DataFrame:
    """Each channel times its weight, cut to whole numbers and wrapped into eight bits."""
    return px.withColumns({c: F.floor(F.round(F.col(c) * w, 9)).cast("int") % 256 for c, w in zip(names, weights)})


def distance_image(px: DataFrame, names: Sequence[str], metric: str = "l1", origin: str = "zero", name: str = "value") -> DataFrame:
    """Distance of the named channels from zero, or from the image's median or mean of each, rescaled to 0..255."""
    df = px
    if origin != "zero":
        f = {"median": F.median, "mean": F.avg}[origin]
        df = df.join(df.groupBy(IMAGE).agg(*[f(c).cast("double").alias(f"__o_{c}") for c in names]), IMAGE)
    at = [F.lit(0.0) if origin == "zero" else F.col(f"__o_{c}") for c in names]
    gaps = [F.abs(F.col(c) - o) for c, o in zip(names, at)]
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    most, least = (F.greatest(*gaps), F.least(*gaps)) if len(gaps) > 1 else (gaps[0], gaps[0])
    canberra = [F.when(F.col(c) + o == 0, 0.0).otherwise(d / (F.col(c) + o)) for c, o, d in zip(names, at, gaps)]
    signed = total([F.col(c) - o for c, o in zip(names, at)])
    value = {"l1": total(gaps), "l2": F.sqrt(total([d * d for d in gaps])), "chebyshev": most, "inverse_chebyshev": least, "canberra": total(canberra), "delta_plus": F.greatest(signed, F.lit(0.0)), "delta_minus": F.greatest(-signed, F.lit(0.0))}[metric]
    out = rescale8(df.withColumn("__d", F.round(value.cast("double"), 9)), "__d", name)
    return out.drop("__d", *[f"__o_{c}" for c in names])


def linear(px: DataFrame, alpha: float = 100, beta: float = 0, names: Sequence[str] = ("b", "g", "r")) -> DataFrame:
    return px.withColumns({c: F.least(F.lit(255), F.floor(F.abs(F.round(F.col(c) * alpha / 100 + beta, 9))).cast("int")) for c in names})


def gamma_lut(v: Column, g: float) -> Column:
    return F.floor(F.round(255 * F.pow(v / 255.0, F.lit(1.0 / g)), 9)).cast("int")


def gamma(px: DataFrame, g: float, names: Sequence[str] = ("b", "g", "r")) -> DataFrame:
    return px.withColumns({c: gamma_lut(F.col(c), g) for c in names})


BRIGHTNESS = {"std": (0.0722, 0.7152, 0.2126), "p1": (0.114, 0.587, 0.299)}


def brightness_of(mode: str = "std") -> Column:
    """Brightness of a pixel: by luminance (std), or perceived (p1, p2)."""
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    if mode == "p2":
        return F.sqrt(0.068 * b * b + 0.691 * g * g + 0.241 * r * r)
    wb, wg, wr = BRIGHTNESS[mode]
    return wb * b + wg * g + wr * r


def target_brightness(px: DataFrame, target: float, max_delta: float = 255, case: str = "always", mode: str = "std") -> DataFrame:
    """Channels scaled so that the image's mean brightness nears the target; case always, over or under says which images."""
    mean = px.groupBy(IMAGE).agg(F.round(F.avg(brightness_of(mode)), 6).alias("__m"))
    m = F.col("__m")
    goal = F.greatest(m - max_delta, F.least(m + max_delta, F.lit(float(target))))
    due = {"always": F.lit(True), "over": m > target, "under": m < target}[case]
    change = {c: F.when(due, F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.round(F.col(c) * (goal + m) / (2 * m) + (goal - m) / 2, 6)).cast("int")))).otherwise(F.col(c)) for c in "bgr"}
    return px.join(mean, IMAGE).withColumns(change).drop("__m")


def temperature_tint(px: DataFrame, temperature: int = 0, tint: int = 0, clip: bool = True) -> DataFrame:
    """b - temperature, g + tint, r + temperature, clipped, or rescaled where a channel of an image leaves 0..255."""
    moved = px.withColumns({"b": F.col("b") - temperature, "g": F.col("g") + tint, "r": F.col("r") + temperature})
    if clip:
        return moved.withColumns({c: F.greatest(F.lit(0), F.least(F.lit(255), F.col(c))) for c in "bgr"})
    for c in "bgr":
        moved = rescale8(moved, c)
    return moved


def stretch(v: Column, low: Column, high: Column) -> Column:
    """v clipped to low..high and stretched over 0..255."""
    inside = F.greatest(low, F.least(high, v))
    return F.when(high > low, F.floor(F.round((inside - low) * 255 / (high - low), 9)).cast("int")).otherwise(v)


def forced_balance(px: DataFrame, bounds: Mapping[str, tuple[int, int]]) -> DataFrame:
    return px.withColumns({c: stretch(F.col(c), F.lit(lo), F.lit(hi)) for c, (lo, hi) in bounds.items()})


def roi_balance(px: DataFrame, inside: Column) -> DataFrame:
    """Channels scaled so that the mean of the region's pixels, zeros apart, is the same grey in all."""
    means = px.filter(inside).groupBy(IMAGE).agg(*[F.avg(F.when(F.col(c) > 0, F.col(c))).alias(f"__{c}") for c in "bgr"])
    luma = (F.col("__b") + F.col("__g") + F.col("__r")) / 3
    scaled = {c: F.coalesce(F.least(F.lit(255), F.floor(F.round(F.col(c) * luma / F.col(f"__{c}"), 6)).cast("int")), F.col(c)) for c in "bgr"}
    return px.join(means, IMAGE, "left").withColumns(scaled).drop("__b", "__g", "__r")


def grey_world(px: DataFrame, gr: float = 0, yb: float = 0) -> DataFrame:
    """Lab channels l, a, bb with the image's mean tint taken off in proportion to lightness."""
    df = channels(px, ["l", "a", "bb"])
    means = df.groupBy(IMAGE).agg(F.avg("a").alias("__a"), F.avg("bb").alias("__b"))
    df = df.join(means, IMAGE)
    shift = lambda c, m, extra: clip8(F.round(F.col(c) - (F.col(m) - 128 + extra) * (F.col("l") / 255.0) * 1.1, 6))
    return df.withColumns({"a": shift("a", "__a", gr), "bb": shift("bb", "__b", yb)}).drop("__a", "__b")


def posterize(px: DataFrame, colours: Mapping[str, tuple[int, int, int]], share: float = 34, version: int = 1) -> DataFrame:
    """Pixels that one channel dominates take its colour (b, g, r).

    Version 1: the channel is greater than both others and more than share percent of their sum. Version 2: the channel is
    the greatest after scaling by its percentage (share for all).
    """
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    value = {"b": b, "g": g, "r": r}
    if version == 2:
        value = {c: F.floor(F.round(v * share / 100, 9)) for c, v in value.items()}
    wins = {}
    for c, v in value.items():
        others = [w for k, w in value.items() if k != c]
        wins[c] = (v > others[0]) & (v > others[1])
        if version == 1:
            wins[c] = wins[c] & (F.when(b + g + r > 0, v / (b + g + r)).otherwise(0.0) > share / 100)
    out = {}
    for k, c in enumerate("bgr"):
        made = F.col(c)
        for name, colour in colours.items():
            made = F.when(wins[name], F.lit(colour[k])).otherwise(made)
        out[c] = made
    return px.withColumns(out)


def exposure_zone(over: int = 255, under: int = 0, grey_level: int = 0) -> Column:
    """over, under, grey or none: all channels at the limits, or all alike within grey_level."""
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    return F.when(low >= over, "over").when(top <= under, "under").when(top - low <= grey_level, "grey").otherwise("none")


def colour_zones(px: DataFrame, colours: Mapping[str, tuple[int, int, int]], **limits: int) -> DataFrame:
    zone = exposure_zone(**limits)
    out = {}
    for k, c in enumerate("bgr"):
        made = F.col(c)
        for name, colour in colours.items():
            made = F.when(zone == name, F.lit(colour[k])).otherwise(made)
        out[c] = made
    return px.withColumns(out)


def chlorophyll() -> Column:
    """The chlorophyll index of a pixel."""
    return F.exp(-0.0280 * 1.049 * F.col("r") + 0.0190 * 1.049 * F.col("g") - 0.0030 * 1.041 * F.col("b") + 5.780)


def chlorophyll_image(px: DataFrame) -> DataFrame:
    return rescale8(px.withColumn("__c", F.round(chlorophyll(), 6)), "__c", "chlorophyll").drop("__c")


def apply_mask(px: DataFrame, mask: DataFrame, background: tuple[int, int, int] = (0, 0, 0), place: Sequence[str] = (IMAGE, "y", "x")) -> DataFrame:
    """Pixels outside the mask take the background's colour."""
    joined = px.join(mask.select(*place, F.lit(True).alias("__in")), list(place), "left")
    return joined.withColumns({c: F.when(F.col("__in"), F.col(c)).otherwise(F.lit(v)) for c, v in zip("bgr", background)}).drop("__in")


def lut_apply(px: DataFrame, lut: DataFrame, channel: str) -> DataFrame:
    """channel looked up in (image_id, channel, value, mapped): at most 256 rows for each image and channel."""
    own = lut.filter(F.col("channel") == channel).select(IMAGE, F.col("value").alias(channel), F.col("mapped").alias("__mapped"))
    return px.join(own, [IMAGE, channel]).withColumn(channel, F.col("__mapped")).drop("__mapped")

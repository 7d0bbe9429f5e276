"""Queries over pixels: channels, masks, arithmetic, balance, histograms, thresholds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from florascan.operators import histogram as h
from florascan.operators import pixels as p
from florascan.plans import fixtures as fx
from florascan.plans.fixtures import sql
from florascan.plans.registry import query
from florascan.sources import tables as t
from florascan.sources.storage import new_path

PLACE = "image_id, y, x"


@query("s3_pixels", sql("px", "select image_id, y, x, b, g, r from px"))
def s3(spark, d):
    return fx.px(spark, d)


@query("s3_pixels_from_arrays", "select vec_id as image_id, cast(label as bigint) as y, cast((i - 1) // 2 as int) as x, cast(max(case when i % 2 = 1 then floor(v * 100) end) as bigint) as b, cast(max(case when i % 2 = 0 then floor(v * 100) end) as bigint) as g from (select vec_id, label, unnest(embedding)::double v, generate_subscripts(embedding, 1) i from embeddings) group by 1, 2, 3")
def s3b(spark, d):
    e = t.table(spark, d, "embeddings")
    return t.pixels_from_arrays(e, F.col("vec_id"), F.col("label").cast("bigint"), F.transform("embedding", lambda v: F.floor(v.cast("double") * 100)), ("b", "g"))


@query("s16_image_path", sql("px", "select image_id, '/out/' || image_id || '_mask.png' as path from (select distinct image_id from px)"))
def s16(spark, d):
    return fx.px(spark, d).select("image_id").distinct().select("image_id", t.image_path("/out/", F.col("image_id"), F.lit("mask")).alias("path"))


def layouts(spark, d):
    """The pixels and the mask as tables of one layout."""
    px, name = fx.px(spark, d), "layout_" + uuid.uuid4().hex
    stored_px = t.save_layout(px, name, new_path(spark, "layout"), 8)
    mask = px.filter(F.col("g").between(100, 160)).select("image_id", "y", "x", (F.col("r") - F.col("b")).alias("tone"))
    return stored_px, t.save_layout(mask, name + "_mask", new_path(spark, "layout"), 8)


@query("s16_stored_layout", sql("px", "select image_id, y // 256 as band, y, count(*) as n, max(x) - min(x) + 1 as span, sum(g)::bigint as g, sum(r - b)::bigint as tone from px where g between 100 and 160 group by 1, 2, 3"))
def s16_layout(spark, d):
    """Masked rows measured over stored tables: joined by place, grouped by row, nothing shuffled."""
    joined = t.join_layouts(*layouts(spark, d))
    return joined.groupBy("image_id", "band", "y").agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x") + 1).alias("span"), F.sum("g").alias("g"), F.sum("tone").alias("tone"))



HSV = """hsv as (select *, greatest(b, g, r) as v, greatest(b, g, r) - least(b, g, r) as span from px),
hs as (select *, case when v = 0 then 0 else cast(floor(255 * span::double / v + 0.5) as int) end as s,
  case when span = 0 then 0.0 when v = r then 60.0 * (g - b) / span when v = g then 120.0 + 60.0 * (b - r) / span else 240.0 + 60.0 * (r - g) / span end as deg from hsv),
h as (select *, cast(floor(case when deg < 0 then deg + 360 else deg end::double / 2 + 0.5) as int) % 180 as h from hs)"""


@query("p1_hsv", sql("px", HSV + " select image_id, y, x, h, s, v from h"))
def p1(spark, d):
    return p.channels(fx.px(spark, d), ["h", "s", "v"]).select("image_id", "y", "x", "h", "s", "v")


LAB = """li as (select *, case when b / 255.0::double > 0.04045 then pow((b / 255.0::double + 0.055) / 1.055, 2.4) else b / 255.0::double / 12.92 end lb, case when g / 255.0::double > 0.04045 then pow((g / 255.0::double + 0.055) / 1.055, 2.4) else g / 255.0::double / 12.92 end lg, case when r / 255.0::double > 0.04045 then pow((r / 255.0::double + 0.055) / 1.055, 2.4) else r / 255.0::double / 12.92 end lr from px),
xyz as (select *, (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456 xx, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb yy, (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 zz from li),
ff as (select *, case when xx > 0.008856 then cbrt(xx) else 7.787 * xx + 16.0 / 116.0 end fx, case when yy > 0.008856 then cbrt(yy) else 7.787 * yy + 16.0 / 116.0 end fy, case when zz > 0.008856 then cbrt(zz) else 7.787 * zz + 16.0 / 116.0 end fz, case when yy > 0.008856 then 116 * cbrt(yy) - 16 else 903.3 * yy end ll from xyz),
lab as (select image_id, y, x, greatest(0, least(255, cast(floor(ll * 255 / 100 + 0.5) as int))) as l, greatest(0, least(255, cast(floor(500 * (fx - fy) + 128 + 0.5) as int))) as a, greatest(0, least(255, cast(floor(200 * (fy - fz) + 128 + 0.5) as int))) as bb from ff)"""


@query("p1_lab", sql("px", LAB + " select * from lab"))
def p1b(spark, d):
    return p.channels(fx.px(spark, d), ["l", "a", "bb"]).select("image_id", "y", "x", "l", "a", "bb")


@query("p2_range_mask", sql("px", HSV + " select image_id, y, x from h where v between 120 and 200"))
def p2(spark, d):
    return p.range_mask(p.channels(fx.px(spark, d), ["v"]), "v", 200, 120).select("image_id", "y", "x")


@query("p3_multi_range", sql("px", "select image_id, y, x, 'and' as merge from px where g between 100 and 160 and b between 0 and 130 and r between 90 and 255 union all select image_id, y, x, 'or' from px where g between 100 and 110 or b between 0 and 60"))
def p3(spark, d):
    px = fx.px(spark, d)
    both = p.multi_range_mask(px, [("g", 100, 160), ("b", 0, 130), ("r", 90, 255)]).select("image_id", "y", "x", F.lit("and").alias("merge"))
    return both.unionByName(p.multi_range_mask(px, [("g", 100, 110), ("b", 0, 60)], "or").select("image_id", "y", "x", F.lit("or").alias("merge")))


@query("p4_split_range", sql("px", "select image_id, y, x from px where case when x between 3 and 10 and y between 5 and 16 then g between 100 and 160 else g between 0 and 90 end"))
def p4(spark, d):
    return p.split_range_mask(fx.px(spark, d), F.col("x").between(3, 10) & F.col("y").between(5, 16), "g", (100, 160), (0, 90)).select("image_id", "y", "x")


@query("p6_image_to_mask", sql("px", "select image_id, y, x from px where cast(floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5) as int) > 127"))
def p6(spark, d):
    return p.image_to_mask(fx.px(spark, d), 127).select("image_id", "y", "x")


@query("p6_invert_mask", sql("mask", "select image_id, y, x from px where not (g between 100 and 160)"))
def p6b(spark, d):
    return p.invert_mask(fx.px(spark, d), fx.mask(spark, d))


def rescaled(value: str, source: str = "px") -> str:
    return f"v0 as (select *, {value} as val from {source}), v1 as (select *, min(val) over (partition by image_id) lo, max(val) over (partition by image_id) hi from v0) select image_id, y, x, case when hi > lo then cast(floor((val - lo) / (hi - lo) * 255 + 1e-9) as int) else 0 end as value from v1"


@query("p7_channel_operation", sql("px", rescaled("round(coalesce(case when r * 50::double / 100 = 0 then 0 else (case when g * 80::double / 100 = 0 then 0 else b * 100::double / 100 / (g * 80::double / 100) end) / (r * 50::double / 100) end, 0), 9)")))
def p7(spark, d):
    return p.channel_operation(fx.px(spark, d), "b", 100, "/", "g", 80, "/", "r", 50).select("image_id", "y", "x", "value")


@query("p7_channel_operation_cut", sql("px", rescaled("greatest(round((b * 120::double / 100 - g * 80::double / 100) + r * 10::double / 100, 9), 0)")))
def p7b(spark, d):
    return p.channel_operation(fx.px(spark, d), "b", 120, "-", "g", 80, "+", "r", 10, cut_negative=True).select("image_id", "y", "x", "value")


@query("p8_subtract_rescale", sql("px", "select image_id, y, x, greatest(0, least(255, cast(floor((round(g * 100::double / 100 - b * 100::double / 100, 9) + 255) / 2 + 0.5) as int))) as value from px"))
def p8(spark, d):
    return p.channel_subtraction(fx.px(spark, d), "g", "b", post="rescale").select("image_id", "y", "x", "value")


@query("p8_subtract_normalize", sql("px", rescaled("round(g * 100::double / 100 - r * 70::double / 100, 9)")))
def p8b(spark, d):
    return p.channel_subtraction(fx.px(spark, d), "g", "r", 100, 70).select("image_id", "y", "x", "value")


@query("p8_subtract_cut", sql("px", "select image_id, y, x, cast(floor(least(greatest(round(g * 100::double / 100 - r * 70::double / 100, 9), 0.0), 255.0)) as int) as value from px"))
def p8c(spark, d):
    return p.channel_subtraction(fx.px(spark, d), "g", "r", 100, 70, "cut_negative").select("image_id", "y", "x", "value")


@query("p9_mix", sql("px", "select image_id, y, x, cast(floor(round(b * 0.5::double, 9)) as int) % 256 as b, cast(floor(round(g * 1.5::double, 9)) as int) % 256 as g, cast(floor(round(r * 1.0::double, 9)) as int) % 256 as r from px"))
def p9(spark, d):
    return p.mix_channels(fx.px(spark, d), (0.5, 1.5, 1.0))


@query("p10_sigmoid", sql("px", "u as (select *, (g - min(g) over (partition by image_id))::double / (max(g) over (partition by image_id) - min(g) over (partition by image_id)) as u from px), " + rescaled("round(1 / (1 + exp(-(u * 10 - 5))), 9)", "u")))
def p10(spark, d):
    return p.transfer(fx.px(spark, d), "g", "sigmoid", "value").select("image_id", "y", "x", "value")


@query("p10_invert_channel", sql("px", "select image_id, y, x, 255 - g as value from px"))
def p10b(spark, d):
    return fx.px(spark, d).select("image_id", "y", "x", (255 - F.col("g")).alias("value"))


for _curve, _e in (("logit", "ln(greatest(0.001, least(0.999, u)) / (1 - greatest(0.001, least(0.999, u))))"), ("arcsin", "asin(u)"), ("sqrt", "sqrt(u)"), ("log", "ln(u * 254 + 1)")):

    @query(f"x19_{_curve}", sql("px", "u as (select *, (r - min(r) over (partition by image_id))::double / (max(r) over (partition by image_id) - min(r) over (partition by image_id)) as u from px), " + rescaled(f"round({_e}, 9)", "u")))
    def x19(spark, d, curve=_curve):
        return p.transfer(fx.px(spark, d), "r", curve, "value").select("image_id", "y", "x", "value")


@query("x18_rescale", sql("px", rescaled("b + g")))
def x18(spark, d):
    return p.rescale8(fx.px(spark, d).withColumn("v", F.col("b") + F.col("g")), "v", "value").select("image_id", "y", "x", "value")


ORIGIN = "o as (select *, median(b) over (partition by image_id)::double ob, median(g) over (partition by image_id)::double og, median(r) over (partition by image_id)::double o_r from px), "
for _metric, _e in (("l1", "abs(b - ob) + abs(g - og) + abs(r - o_r)"), ("l2", "sqrt((b - ob) * (b - ob) + (g - og) * (g - og) + (r - o_r) * (r - o_r))"), ("chebyshev", "greatest(abs(b - ob), abs(g - og), abs(r - o_r))"), ("inverse_chebyshev", "least(abs(b - ob), abs(g - og), abs(r - o_r))"), ("delta_plus", "greatest((b - ob) + (g - og) + (r - o_r), 0)"), ("canberra", "case when b + ob = 0 then 0 else abs(b - ob) / (b + ob) end + case when g + og = 0 then 0 else abs(g - og) / (g + og) end + case when r + o_r = 0 then 0 else abs(r - o_r) / (r + o_r) end")):

    @query(f"p11_distance_{_metric}", sql("px", ORIGIN + rescaled(f"round(({_e})::double, 9)", "o")))
    def p11(spark, d, metric=_metric):
        return p.distance_image(fx.px(spark, d), ["b", "g", "r"], metric, "median").select("image_id", "y", "x", "value")


@query("p12_linear", sql("px", "select image_id, y, x, " + ", ".join(f"least(255, cast(floor(abs(round({c} * 150::double / 100 - 40, 9))) as int)) as {c}" for c in "bgr") + " from px"))
def p12(spark, d):
    return p.linear(fx.px(spark, d), 150, -40)


@query("p12_gamma", sql("px", "select image_id, y, x, " + ", ".join(f"cast(floor(round(255 * pow({c} / 255.0::double, 1.0::double / 1.8), 9)) as int) as {c}" for c in "bgr") + " from px"))
def p12b(spark, d):
    return p.gamma(fx.px(spark, d), 1.8)


TARGET = "greatest(m - 60, least(m + 60, 150.0::double))"


@query("p12_target_brightness", sql("px", f"mm as (select image_id, round(avg(0.0722 * b + 0.7152 * g + 0.2126 * r), 6)::double as m from px group by 1), g0 as (select image_id, m, {TARGET} as goal from mm) select image_id, y, x, " + ", ".join(f"case when m < 150 then least(255, greatest(0, cast(floor(round({c} * (goal + m) / (2 * m) + (goal - m) / 2, 6)) as int))) else {c} end as {c}" for c in "bgr") + " from px join g0 using (image_id)"))
def p12c(spark, d):
    return p.target_brightness(fx.px(spark, d), 150, 60, "under").select("image_id", "y", "x", "b", "g", "r")


@query("p13_temperature_tint", sql("px", "select image_id, y, x, greatest(0, least(255, b - 30)) as b, greatest(0, least(255, g + 12)) as g, greatest(0, least(255, r + 30)) as r from px"))
def p13(spark, d):
    return p.temperature_tint(fx.px(spark, d), 30, 12)


COUNTS = """long as (select image_id, 'b' as channel, b as value from px union all select image_id, 'g', g from px union all select image_id, 'r', r from px),
counts as (select image_id, channel, value, count(*) as n from long group by all),
cum as (select *, sum(n) over (partition by image_id, channel order by value)::bigint as below, sum(n) over (partition by image_id, channel)::bigint as total from counts)"""
BOUNDS = COUNTS + ", bounds as (select image_id, channel, min(case when below::double / total >= 0.05 then value end) as lo, min(case when below::double / total >= 1 - 0.05::double then value end) as hi from cum group by 1, 2)"
SIX = ", ".join(f"max(case when channel = '{c}' then {e} end) as {c}_{e}" for c in "bgr" for e in ("lo", "hi"))


@query("p14_white_balance", sql("px", BOUNDS + f", w as (select image_id, {SIX} from bounds group by 1) select image_id, y, x, " + ", ".join(f"case when {c}_hi > {c}_lo then cast(floor(round((greatest({c}_lo, least({c}_hi, {c})) - {c}_lo) * 255::double / ({c}_hi - {c}_lo), 9)) as int) else {c} end as {c}" for c in "bgr") + " from px join w using (image_id)"))
def p14(spark, d):
    return h.white_balance(fx.px(spark, d), 0.05, 0.05).select("image_id", "y", "x", "b", "g", "r")


@query("a14_clip_outliers", sql("px", BOUNDS + f", w as (select image_id, {SIX} from bounds group by 1) select image_id, y, x, " + ", ".join(f"greatest({c}_lo, least({c}_hi, {c})) as {c}" for c in "bgr") + " from px join w using (image_id)"))
def a14(spark, d):
    return h.clip_outliers(fx.px(spark, d), 0.05, 0.05).select("image_id", "y", "x", "b", "g", "r")


@query("w4_cumulative_histogram", sql("px", COUNTS + " select * from cum"))
def w4(spark, d):
    return h.cumulative(h.value_counts(fx.px(spark, d)))


@query("p15_forced_balance", sql("px", "select image_id, y, x, cast(floor(round((greatest(50, least(200, b)) - 50) * 255::double / 150, 9)) as int) as b, g, cast(floor(round((greatest(80, least(180, r)) - 80) * 255::double / 100, 9)) as int) as r from px"))
def p15(spark, d):
    return p.forced_balance(fx.px(spark, d), {"b": (50, 200), "r": (80, 180)})


@query("p16_roi_balance", sql("px", "m as (select image_id, avg(case when b > 0 then b end) mb, avg(case when g > 0 then g end) mg, avg(case when r > 0 then r end) mr from px where x between 3 and 10 and y between 5 and 16 group by 1) select image_id, y, x, " + ", ".join(f"coalesce(least(255, cast(floor(round({c} * ((mb + mg + mr) / 3) / m{c}, 6)) as int)), {c}) as {c}" for c in "bgr") + " from px left join m using (image_id)"))
def p16(spark, d):
    return p.roi_balance(fx.px(spark, d), F.col("x").between(3, 10) & F.col("y").between(5, 16)).select("image_id", "y", "x", "b", "g", "r")


@query("p17_grey_world", sql("px", LAB + ", m as (select *, avg(a) over (partition by image_id) ma, avg(bb) over (partition by image_id) mb from lab) select image_id, y, x, l, greatest(0, least(255, cast(floor(round(a - (ma - 128) * (l / 255.0::double) * 1.1, 6) + 0.5) as int))) as a, greatest(0, least(255, cast(floor(round(bb - (mb - 128) * (l / 255.0::double) * 1.1, 6) + 0.5) as int))) as bb from m"))
def p17(spark, d):
    return p.grey_world(fx.px(spark, d)).select("image_id", "y", "x", "l", "a", "bb")


def poster(wins: dict[str, str]) -> str:
    colours = {"b": (255, 0, 0), "g": (0, 255, 0)}
    return ", ".join(f"case when {wins['g']} then {colours['g'][k]} when {wins['b']} then {colours['b'][k]} else {c} end as {c}" for k, c in enumerate("bgr"))


@query("p18_posterize", sql("px", "select image_id, y, x, " + poster({"b": "b > g and b > r and b::double / (b + g + r) > 0.36", "g": "g > b and g > r and g::double / (b + g + r) > 0.36"}) + " from px"))
def p18(spark, d):
    return p.posterize(fx.px(spark, d), {"b": (255, 0, 0), "g": (0, 255, 0)}, 36)


@query("p18_posterize_scaled", sql("px", "select image_id, y, x, " + poster({"b": "floor(b * 0.5) > floor(g * 0.5) and floor(b * 0.5) > floor(r * 0.5)", "g": "floor(g * 0.5) > floor(b * 0.5) and floor(g * 0.5) > floor(r * 0.5)"}) + " from px"))
def p18b(spark, d):
    return p.posterize(fx.px(spark, d), {"b": (255, 0, 0), "g": (0, 255, 0)}, 50, version=2)


ZONE = "case when least(b, g, r) >= 150 then 'over' when greatest(b, g, r) <= 110 then 'under' when greatest(b, g, r) - least(b, g, r) <= 12 then 'grey' else 'none' end"
LIMITS = {"over": 150, "under": 110, "grey_level": 12}


@query("p19_colour_zones", sql("px", f"z as (select *, {ZONE} as zone from px) select image_id, y, x, case zone when 'over' then 255 when 'under' then 0 else b end as b, case zone when 'over' then 0 when 'under' then 0 else g end as g, case zone when 'over' then 0 when 'under' then 255 else r end as r from z"))
def p19(spark, d):
    return p.colour_zones(fx.px(spark, d), {"over": (255, 0, 0), "under": (0, 0, 255)}, **LIMITS)


@query("a32_exposure", sql("px", f"z as (select *, {ZONE} as zone from px) select image_id, " + ", ".join(f"round(100.0 * count(*) filter (zone = '{z}') / count(*), 6) as {z}" for z in ("over", "under", "grey")) + " from z group by 1"))
def a32(spark, d):
    return h.exposure(fx.px(spark, d), **LIMITS).select("image_id", *[F.round(z, 6).alias(z) for z in ("over", "under", "grey")])


CHL = "exp(-0.0280 * 1.049 * r + 0.0190 * 1.049 * g - 0.0030 * 1.041 * b + 5.780)"


@query("a19_chlorophyll", sql("tall", f"select image_id, round(avg({CHL}), 4) as chlorophyll_mean, round(stddev_pop({CHL}), 4) as chlorophyll_std from tall group by 1"))
def a19(spark, d):
    return h.chlorophyll_stats(fx.tall(spark, d)).select("image_id", F.round("chlorophyll_mean", 4).alias("chlorophyll_mean"), F.round("chlorophyll_std", 4).alias("chlorophyll_std"))


@query("p20_chlorophyll_image", sql("px", rescaled(f"round({CHL}, 6)").replace("as value from v1", "as chlorophyll from v1")))
def p20(spark, d):
    return p.chlorophyll_image(fx.px(spark, d)).select("image_id", "y", "x", "chlorophyll")


@query("p21_apply_mask", sql("mask", "select image_id, y, x, case when g between 100 and 160 then b else 10 end as b, case when g between 100 and 160 then g else 20 end as g, case when g between 100 and 160 then r else 30 end as r from px"))
def p21(spark, d):
    return p.apply_mask(fx.px(spark, d), fx.mask(spark, d), (10, 20, 30)).select("image_id", "y", "x", "b", "g", "r")


TALL = """long as (select image_id, 'b' as channel, b as value from tall union all select image_id, 'g', g from tall union all select image_id, 'r', r from tall)"""


@query("a10_channel_stats", sql("tall", TALL + " select image_id, channel, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std from long group by 1, 2"))
def a10(spark, d):
    return h.channel_stats(fx.tall(spark, d)).select("image_id", "channel", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("a11_stats_text", sql("px", COUNTS.split(",\ncounts")[0] + " select image_id, channel, format('{:.2f}', avg(value)) || ' +/- ' || format('{:.2f}', stddev_pop(value)) as text from long group by 1, 2"))
def a11(spark, d):
    return h.stats_text(h.channel_stats(fx.px(spark, d))).select("image_id", "channel", "text")


@query("a12_histogram", sql("tall", TALL + " select image_id, channel, least(255, cast(floor(value * 256 / 255) as int)) as bin, count(*) as n from long where value < 255 group by 1, 2, 3"))
def a12(spark, d):
    return h.histogram(fx.tall(spark, d))


@query("a13_colour_quantiles", sql("tall", TALL + ", q as (select image_id, channel, least(3, cast(floor(value * 4 / 255) as int)) as bin, count(*) as n from long where value < 255 group by 1, 2, 3), s as (select *, 100.0 * n / sum(n) over (partition by image_id, channel) as p from q) select image_id, " + ", ".join(f"round(coalesce(max(case when channel = '{c}' and bin = {k} then p end), 0), 6) as quantile_color_{c}_{k + 1}_4_percent" for c in "bgr" for k in range(4)) + " from s group by 1"))
def a13(spark, d):
    q = h.colour_quantiles(fx.tall(spark, d))
    return q.select("image_id", *[F.round(c, 6).alias(c) for c in q.columns[1:]])


@query("s14_histogram_sheet", sql("px", COUNTS + " select image_id, channel, " + ", ".join(f"coalesce(sum(n) filter (least(15, cast(floor(value * 16 / 255) as int)) = {k}), 0)::bigint as bin_{k}" for k in range(16)) + " from counts where value < 255 group by 1, 2"))
def s14(spark, d):
    return h.histogram_sheet(fx.px(spark, d), bins=16)


BRIGHT = {"std": "0.0722 * b + 0.7152 * g + 0.2126 * r", "p1": "0.114 * b + 0.587 * g + 0.299 * r", "p2": "sqrt(0.068 * b * b + 0.691 * g * g + 0.241 * r * r)"}


@query("a15_brightness", sql("tall", " union all ".join(f"select '{m}' as mode, image_id, round(avg({e})::double, 5) as mean, round(stddev_pop({e})::double, 5) as std from tall group by 2" for m, e in BRIGHT.items())))
def a15(spark, d):
    tall = fx.tall(spark, d)
    parts = [h.brightness(tall, m).select(F.lit(m).alias("mode"), "image_id", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std")) for m in BRIGHT]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a16_image_stats", sql("tall", "select image_id, " + ", ".join(f"round({f}({e})::double, 5) as {n}_{s}" for n, e in (("brightness", BRIGHT["p2"]), ("b", "b"), ("g", "g"), ("r", "r")) for s, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + " from tall group by 1"))
def a16(spark, d):
    s = h.image_stats(fx.tall(spark, d), ["b", "g", "r"])
    return s.select("image_id", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in s.columns[1:]])


@query("a28_area_ratio", sql("mask", "select image_id, round(count(*) filter (r > 128)::double / count(*), 6) as ratio from px where g between 100 and 160 group by 1"))
def a28(spark, d):
    return h.area_ratio(fx.px(spark, d).filter(F.col("g").between(100, 160)), F.col("r") > 128).withColumn("ratio", F.round("ratio", 6))


OTSU = COUNTS + """, o as (select *, below as n0, sum(n * value) over (partition by image_id, channel order by value)::bigint as s0, total as n_all, sum(n * value) over (partition by image_id, channel)::bigint as s_all from cum),
sc as (select *, round(n0::double * (n_all - n0) * (s0::double / n0 - (s_all - s0)::double / (n_all - n0)) * (s0::double / n0 - (s_all - s0)::double / (n_all - n0)), 3) as score from o where n0 < n_all),
otsu as (select image_id, channel, value as threshold from (select *, row_number() over (partition by image_id, channel order by score desc, value) k from sc) where k = 1)"""


@query("h1_otsu", sql("px", OTSU + " select * from otsu"))
def h1(spark, d):
    return h.otsu_thresholds(fx.px(spark, d))


@query("h1_otsu_mask", sql("px", OTSU + " select image_id, y, x from px join otsu using (image_id) where channel = 'g' and g > threshold"))
def h1b(spark, d):
    px = fx.px(spark, d)
    return h.above_threshold(px, h.otsu_thresholds(px), "g").select("image_id", "y", "x")


WIDE = ", w as (select image_id, max(case when channel = 'b' then threshold end) tb, max(case when channel = 'g' then threshold end) tg, max(case when channel = 'r' then threshold end) tr from otsu group by 1)"


@query("h2_otsu_all", sql("px", OTSU + WIDE + " select image_id, y, x from px join w using (image_id) where b > tb and g > tg and r > tr"))
def h2(spark, d):
    return h.otsu_merge(fx.px(spark, d), weighted=False).filter("merged = 3").select("image_id", "y", "x")


@query("h3_otsu_merge", sql("px", OTSU + WIDE + " select image_id, y, x, case when b > tb then 1 else 0 end + case when g > tg then 2 else 0 end + case when r > tr then 4 else 0 end as merged from px join w using (image_id)"))
def h3(spark, d):
    return h.otsu_merge(fx.px(spark, d)).select("image_id", "y", "x", "merged")


EQ = COUNTS + ", l0 as (select *, min(below) over (partition by image_id, channel) as least from cum), lut as (select image_id, channel, value, case when total > least then cast(floor((below - least) * 255::double / (total - least) + 0.5) as int) else value end as mapped from l0)"


@query("h4_equalize", sql("px", EQ + " select p.image_id, y, x, lb.mapped as b, lg.mapped as g, lr.mapped as r from px p join lut lb on lb.image_id = p.image_id and lb.channel = 'b' and lb.value = p.b join lut lg on lg.image_id = p.image_id and lg.channel = 'g' and lg.value = p.g join lut lr on lr.image_id = p.image_id and lr.channel = 'r' and lr.value = p.r"))
def h4(spark, d):
    return h.equalize(fx.px(spark, d)).select("image_id", "y", "x", "b", "g", "r")


BYTE = "cast(greatest(0, least(255, floor(round({}, 6) + 0.5))) as int)"
LUMA = f"""l0 as (select *, {BYTE.format('0.299 * r + 0.587 * g + 0.114 * b')} as l from px), l1 as (select *, {BYTE.format('0.492 * (b - l) + 128')} - 128 as u, {BYTE.format('0.877 * (r - l) + 128')} - 128 as v from l0),
l2 as (select image_id, l, count(*) as n from l1 group by 1, 2), l3 as (select *, sum(n) over (partition by image_id order by l) as below, sum(n) over (partition by image_id) as total from l2),
l4 as (select *, min(below) over (partition by image_id) as least from l3), l5 as (select image_id, l, case when total > least then cast(floor((below - least) * 255::double / (total - least) + 0.5) as int) else l end as q from l4)
select image_id, y, x, {BYTE.format('q + 2.032 * u')} as b, {BYTE.format('q - 0.395 * u - 0.581 * v')} as g, {BYTE.format('q + 1.140 * v')} as r from l1 join l5 using (image_id, l)"""


@query("h4_equalize_luma", sql("px", LUMA))
def h4b(spark, d):
    return h.equalize_luma(fx.px(spark, d)).select("image_id", "y", "x", "b", "g", "r")


@query("j16_lut_apply", sql("px", "select image_id, y, x, cast(floor(round(255 * pow(g / 255.0::double, 1.0::double / 0.5), 9)) as int) as g from px"))
def j16(spark, d):
    px = fx.px(spark, d)
    lut = px.select("image_id", F.lit("g").alias("channel"), F.col("g").alias("value")).distinct().withColumn("mapped", p.gamma_lut(F.col("value"), 0.5))
    return p.lut_apply(px, lut, "g").select("image_id", "y", "x", "g")


TRI = COUNTS + """, pk as (select image_id, channel, arg_min(value, (1000000 - n) * 1000 + value) as peak, max(n) as top, min(value) as first, max(value) as last from counts group by 1, 2),
tl as (select *, case when peak - first > last - peak then first else last end as tail from pk),
dr as (select image_id, channel, value, round(top * abs(value - tail)::double / greatest(abs(peak - tail), 1) - n, 6) as d from counts join tl using (image_id, channel) where value >= least(peak, tail) and value <= greatest(peak, tail))
select image_id, channel, value as threshold from (select *, row_number() over (partition by image_id, channel order by d desc, value) k from dr) where k = 1"""


@query("h6_triangle", sql("px", TRI))
def h6(spark, d):
    return h.triangle_thresholds(fx.px(spark, d))


TILES = """t0 as (select image_id, y // 8 as ty, x // 8 as tx, g as value, count(*) as n from px group by 1, 2, 3, 4), t1 as (select *, sum(n) over (partition by image_id, ty, tx)::double as total from t0),
t2 as (select *, least(n::double, greatest(1::double, total * 2 / 256)) as kept from t1), t3 as (select image_id, ty, tx, total, (total - sum(kept)) / 256 as spread from t2 group by 1, 2, 3, 4), vs as (select unnest(range(256)) as value),
t4 as (select t3.*, vs.value, coalesce(kept, 0) + spread as m from t3 cross join vs left join t2 on t2.image_id = t3.image_id and t2.ty = t3.ty and t2.tx = t3.tx and t2.value = vs.value),
t5 as (select image_id, ty, tx, value, sum(m) over (partition by image_id, ty, tx order by value rows unbounded preceding) * 255 / total as mapped from t4),
fr as (select image_id, y, x, g, (y + 0.5::double) / 8 - 0.5::double as fy, (x + 0.5::double) / 8 - 0.5::double as fx from px),
ak as (select image_id, y, x, g, floor(fy) + dy as ty, floor(fx) + dx as tx, (1 - abs(fy - floor(fy) - dy)) * (1 - abs(fx - floor(fx) - dx)) as w from fr, (values (0, 0), (0, 1), (1, 0), (1, 1)) as cn(dy, dx))
select ak.image_id, ak.y, ak.x, ak.g, cast(floor(round(sum(mapped * w) / sum(w), 6) + 0.5) as int) as equalized from ak join t5 on t5.image_id = ak.image_id and t5.ty = ak.ty and t5.tx = ak.tx and t5.value = ak.g group by 1, 2, 3, 4"""


@query("h5_clahe", sql("px", TILES))
def h5(spark, d):
    return h.clahe(fx.px(spark, d), "g").select("image_id", "y", "x", "g", "equalized")


def _lloyd(k: int = 4, rounds: int = 5) -> str:
    start = ", ".join(f"({j}, {255 * (2 * j + 1) / (2 * k)}::double)" for j in range(k))
    near = "select {0}.image_id, {1}, j, row_number() over (partition by {0}.image_id, {1} order by (b - cb) * (b - cb) + (g - cg) * (g - cg) + (r - cr) * (r - cr), j) as rank_, cb, cg, cr{2} from {0} join {3} using (image_id)"
    steps = ["co as (select image_id, b, g, r, count(*) as n from px group by 1, 2, 3, 4)", f"c0 as (select image_id, j, v as cb, v as cg, v as cr from (select distinct image_id from px), (values {start}) as st(j, v))"]
    for i in range(rounds):
        means = ", ".join(f"round(sum({c} * n) / sum(n), 6) as c{c}" for c in "bgr")
        steps += [f"n{i} as ({near.format('co', 'b, g, r', ', n', f'c{i}')})", f"c{i + 1} as (select image_id, j, {means} from n{i} where rank_ = 1 group by 1, 2)"]
    places = near.format("px", "y, x", "", f"c{rounds}")
    return ", ".join(steps) + f" select image_id, y, x, j as cluster, " + ", ".join(f"cast(floor(c{c} + 0.5) as int) as {c}_centre" for c in "bgr") + f" from ({places}) where rank_ = 1"


@query("a34_kmeans_colours", sql("px", _lloyd()))
def a34(spark, d):
    return h.kmeans_colours(fx.px(spark, d)).select("image_id", "y", "x", "cluster", "b_centre", "g_centre", "r_centre")

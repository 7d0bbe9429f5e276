"""Queries over neighbourhoods, masks, objects, regions and generated images."""

from __future__ import annotations

import functools
import math

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from florascan.operators import edges as ed
from florascan.operators import flooding
from florascan.operators import histogram as h
from florascan.operators import neighbourhood as n
from florascan.operators import objects as o
from florascan.operators import perspective
from florascan.operators import pixels as p
from florascan.operators import regions as r
from florascan.operators import series as s
from florascan.operators import thinning
from florascan.plans import fixtures as fx
from florascan.plans.fixtures import sql
from florascan.plans.registry import query
from florascan.sources import tables as t

PLACE = ["image_id", "y", "x"]
M = "mask as (select image_id, y, x from px where g between 100 and 160)"


def box(r_: int) -> str:
    return f"bx as (select a.image_id, a.y, a.x, a.g, count(*) as n, avg(b.g) as m, greatest(0, round(avg(b.g::double * b.g) - avg(b.g) * avg(b.g), 9)) as var from px a join px b on a.image_id = b.image_id and abs(a.y - b.y) <= {r_} and abs(a.x - b.x) <= {r_} group by 1, 2, 3, 4)"


@query("w7_box_mean", sql("px", box(2) + " select image_id, y, x, n as box_n, round(m, 6) as box_mean, round(sqrt(var), 4) as box_std from bx"))
def w7(spark, d):
    return n.box_stats(fx.px(spark, d), "g", 2).select(*PLACE, "box_n", F.round("box_mean", 6).alias("box_mean"), F.round("box_std", 4).alias("box_std"))


@query("n1_adaptive", sql("px", box(2) + " select image_id, y, x from bx where g > round(m - 2, 6)"))
def n1(spark, d):
    return n.adaptive_mask(fx.px(spark, d), "g", 5, 2).select(*PLACE)


@query("n2_niblack", sql("px", box(3) + " select image_id, y, x from bx where g > round(m - 0.8 * sqrt(var), 6)"))
def n2(spark, d):
    return n.niblack(fx.px(spark, d), "g", 6).select(*PLACE)


@query("n3_sauvola", sql("px", box(3) + " select image_id, y, x from bx where g > round(m * (1 + 0.2 * (sqrt(var) / 128 - 1)), 6)"))
def n3(spark, d):
    return n.sauvola(fx.px(spark, d), "g", 7).select(*PLACE)


@query("n4_median_filter", sql("px", "select a.image_id, a.y, a.x, cast(floor(median(b.g)) as int) as smooth from px a join px b on a.image_id = b.image_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by 1, 2, 3"))
def n4(spark, d):
    return n.median_filter(fx.px(spark, d), "g", 3).select(*PLACE, "smooth")


def gauss(size: int) -> str:
    sg = (size - 1) / 6
    w = f"exp(-(a.{{c}} - b.{{c}}) * (a.{{c}} - b.{{c}}) / (2 * {sg * sg}))"
    return f"""g1 as (select a.image_id, a.y, a.x, a.g, sum(b.g * {w.format(c='x')}) / sum({w.format(c='x')}) as u from px a join px b on a.image_id = b.image_id and a.y = b.y and abs(a.x - b.x) <= {size // 2} group by 1, 2, 3, 4),
g2 as (select a.image_id, a.y, a.x, a.g, sum(b.u * {w.format(c='y')}) / sum({w.format(c='y')}) as smooth from g1 a join g1 b on a.image_id = b.image_id and a.x = b.x and abs(a.y - b.y) <= {size // 2} group by 1, 2, 3, 4)"""


@query("n5_gaussian", sql("px", gauss(5) + " select image_id, y, x, round(smooth, 5) as smooth from g2"))
def n5(spark, d):
    return n.gaussian(fx.px(spark, d), "g", 5).select(*PLACE, F.round("smooth", 5).alias("smooth"))


@query("n1_adaptive_gaussian", sql("px", gauss(5) + " select image_id, y, x from g2 where g > round(smooth - 2, 6)"))
def n1b(spark, d):
    return n.adaptive_mask(fx.px(spark, d), "g", 5, 2, "gaussian").select(*PLACE)


@query("n6_de_vignette", sql("px", """t as (select a.image_id, a.y, a.x, a.g, max(b.g) as top from px a join px b on a.image_id = b.image_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by 1, 2, 3, 4),
b as (select a.image_id, a.y, a.x, a.g, cast(floor(median(b.top)) as int) as back from t a join t b on a.image_id = b.image_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by 1, 2, 3, 4) select image_id, y, x, 255 - abs(g - back) as flat from b"""))
def n6(spark, d):
    return n.de_vignette(fx.px(spark, d), "g").select(*PLACE, "flat")


def convolved(kernel: str, name: str) -> str:
    steps = n.KERNELS[kernel]
    weight = " ".join(f"when b.y - a.y = {dy} and b.x - a.x = {dx} then {w}" for dy, dx, w in steps)
    within = " or ".join(f"(b.y - a.y = {dy} and b.x - a.x = {dx})" for dy, dx, _ in steps)
    return f"{name} as (select a.image_id, a.y, a.x, sum(b.g * case {weight} end)::double as edge from px a join px b on a.image_id = b.image_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and ({within}) group by 1, 2, 3 having count(*) = {len(steps)})"


@query("n7_laplacian", sql("px", convolved("laplacian", "k") + " select * from k"))
def n7(spark, d):
    return n.convolve3(fx.px(spark, d), "g", "laplacian")


@query("a17_sharpness", sql("px", convolved("laplacian", "k") + " select image_id, round(var_pop(edge), 4) as sharpness from k group by 1"))
def a17(spark, d):
    return n.sharpness(fx.px(spark, d), "g").withColumn("sharpness", F.round("sharpness", 4))


for _name, _a, _b in (("sobel", "sobel_h", "sobel_v"), ("prewitt", "prewitt_h", "prewitt_v"), ("roberts", "roberts_p", "roberts_n")):

    @query(f"n8_{_name}", sql("px", convolved(_a, "ka") + ", " + convolved(_b, "kb") + " select ka.image_id, ka.y, ka.x, round(sqrt((ka.edge * ka.edge + kb.edge * kb.edge) / 2), 6) as edge from ka join kb on ka.image_id = kb.image_id and ka.y = kb.y and ka.x = kb.x"))
    def n8(spark, d, name=_name):
        return n.convolve3(fx.px(spark, d), "g", name).withColumn("edge", F.round("edge", 6))


@query("n9_binary_pattern", sql("px", "select a.image_id, a.y, a.x, cast(sum(case when b.g >= a.g then case " + " ".join(f"when b.y - a.y = {dy} and b.x - a.x = {dx} then {2**k}" for k, (dy, dx) in enumerate(n.RING)) + " end else 0 end) as int) as pattern from px a join px b on a.image_id = b.image_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and not (a.y = b.y and a.x = b.x) group by 1, 2, 3 having count(*) = 8"))
def n9(spark, d):
    return n.local_binary_pattern(fx.px(spark, d), "g")


RING8 = f"pts(k, dy, dx, w) as (values {', '.join(f'({k}, {dy}, {dx}, {w}::double)' for k, dy, dx, w in n.circle_points())})"


@query("n9_circular_pattern", sql("px", f"""{RING8}, mx as (select a.image_id, a.y, a.x, a.g, k, sum(b.g * w) as v, count(*) as m from px a cross join pts join px b on b.image_id = a.image_id and b.y = a.y + dy and b.x = a.x + dx group by 1, 2, 3, 4, 5),
pt as (select image_id, y, x, sum(case when round(v, 5) >= g then 1 << k else 0 end)::bigint as pattern from mx group by 1, 2, 3 having sum(m) = {len(n.circle_points())}), tp as (select *, max(pattern) over (partition by image_id)::double as top from pt)
select image_id, y, x, pattern, case when pattern < round(top * 10 / 100, 6) then 0::double when pattern > round(top * 80 / 100, 6) then round(top * 80 / 100, 6) else pattern::double end as cut from tp"""))
def n9b(spark, d):
    pattern = n.circular_pattern(fx.px(spark, d), "g")
    return n.cut_levels(pattern.withColumn("cut", F.col("pattern")), "cut", 10, 20)


@query("n10_hough_lines", sql("mask", "th as (select unnest(generate_series(0, 177, 3)) as theta), v as (select image_id, cast(floor(round(x * round(cos(radians(theta)), 12) + y * round(sin(radians(theta)), 12), 6) + 0.5) as int) as rho, theta::int as theta, count(*) as votes from mask, th group by 1, 2, 3) select * from v where votes >= 12"))
def n10(spark, d):
    return n.hough_lines(fx.mask(spark, d), 12)


RINGS = sorted({(rad, round(rad * math.sin(math.radians(a))), round(rad * math.cos(math.radians(a)))) for rad in (3, 5) for a in range(0, 360, 10)})


@query("n11_hough_circles", sql("mask", "ring(r, dy, dx) as (values " + ", ".join(map(str, RINGS)) + "), v as (select image_id, r, y - dy as cy, x - dx as cx, count(*) as votes from mask, ring group by 1, 2, 3, 4) select image_id, r, cy, cx, votes from (select *, row_number() over (partition by image_id, r order by votes desc, cy, cx) k from v) where k <= 3"))
def n11(spark, d):
    return n.hough_circles(fx.mask(spark, d), (3, 5))


@query("r4_circle_region", sql("mask", "ring(r, dy, dx) as (values " + ", ".join(map(str, RINGS)) + "), v as (select image_id, r, y - dy as cy, x - dx as cx, count(*) as votes from mask, ring group by 1, 2, 3, 4) select image_id, r::double as radius, cx::double as cx, cy::double as cy from (select *, row_number() over (partition by image_id, r order by votes desc, cy, cx) k from v) where k = 1"))
def r4(spark, d):
    return n.hough_circles(fx.mask(spark, d), (3, 5), top=1).select("image_id", F.col("r").cast("double").alias("radius"), F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"))


GLCM = """q as (select px.*, dd.d, dd.a, dd.dy, dd.dx from px, (values (1, 0.0, 0, 1), (1, 0.785398, 1, 1)) as dd(d, a, dy, dx)),
pr as (select q.image_id, d, a, q.g as i, t.g as j, count(*)::double as n from q join px t on t.image_id = q.image_id and t.y = q.y + q.dy and t.x = q.x + q.dx group by 1, 2, 3, 4, 5),
pp as (select *, n / sum(n) over (partition by image_id, d, a) as p from pr),
mm as (select image_id, d, a, sum(p * (i - j) * (i - j)) as contrast, sum(p * abs(i - j)) as dissimilarity, sum(p / (1 + (i - j) * (i - j))) as homogeneity, sum(p * p) as asm, sum(p * i) mi, sum(p * j) mj, sum(p * i * i) qi, sum(p * j * j) qj, sum(p * i * j) qij from pp group by 1, 2, 3)
select image_id, d as distance, a::double as angle, round(contrast, 4) as contrast, round(dissimilarity, 4) as dissimilarity, round(homogeneity, 6) as homogeneity, round(sqrt(asm), 6) as energy, round((qij - mi * mj) / (sqrt(qi - mi * mi) * sqrt(qj - mj * mj)), 5) as correlation, round(asm, 6) as asm from mm"""


@query("a18_glcm", sql("px", GLCM))
def a18(spark, d):
    out = n.glcm(fx.px(spark, d), "g", distances=(1,))
    digits = {"contrast": 4, "dissimilarity": 4, "homogeneity": 6, "energy": 6, "correlation": 5, "asm": 6}
    return out.withColumns({c: F.round(c, k) for c, k in digits.items()})


def near(shape: str, name: str, source: str, size: int = 3) -> str:
    cond = " or ".join(f"(m.y - p.y = {dy} and m.x - p.x = {dx})" for dy, dx in n.structuring_element(size, shape))
    return f"{name} as (select distinct p.image_id, p.y, p.x from px p join {source} m on m.image_id = p.image_id and ({cond}))"


REST = "rest as (select image_id, y, x from px except select image_id, y, x from mask)"


@query("m1_dilate", sql("mask", near("cross", "d1", "mask") + ", " + near("cross", "d2", "d1") + " select * from d2"))
def m1(spark, d):
    return n.dilate(fx.mask(spark, d), fx.px(spark, d), 3, "cross", 2)


@query("m1_erode", sql("mask", REST + ", " + near("rectangle", "d1", "rest") + " select image_id, y, x from mask except select * from d1"))
def m1b(spark, d):
    return n.erode(fx.mask(spark, d), fx.px(spark, d), 3, "rectangle")


ERODED = REST + ", " + near("cross", "d1", "rest") + ", er as (select image_id, y, x from mask except select * from d1)"


@query("m2_open", sql("mask", ERODED + ", " + near("cross", "op", "er") + " select * from op"))
def m2(spark, d):
    return n.open_(fx.mask(spark, d), fx.px(spark, d), size=3, shape="cross")


@query("m2_close", sql("mask", near("cross", "di", "mask") + ", out1 as (select image_id, y, x from px except select * from di), " + near("cross", "d3", "out1") + " select image_id, y, x from di except select * from d3"))
def m2b(spark, d):
    return n.close_(fx.mask(spark, d), fx.px(spark, d), size=3, shape="cross")


@query("m3_gradient", sql("mask", ERODED + ", " + near("cross", "di", "mask") + " select * from di except select * from er"))
def m3(spark, d):
    return n.gradient(fx.mask(spark, d), fx.px(spark, d), size=3, shape="cross")


@query("m4_morphology", sql("mask", near("ellipse", "d1", "mask", 5) + " select * from d1"))
def m4(spark, d):
    return n.morphology(fx.mask(spark, d), fx.px(spark, d), "dilate", size=5, shape="ellipse")


@query("m12_clean_with_previous", sql("mask snap", near("cross", "dd", "prev") .replace("join prev m on m.image_id = p.image_id", "join mask m on m.image_id = p.image_id - 1") + " select m.image_id, m.y, m.x from mask m join dd using (image_id, y, x)"))
def m12(spark, d):
    mask, px = fx.mask(spark, d), fx.px(spark, d)
    images = px.select("image_id").distinct().withColumn("plant", F.lit("p"))
    before = s.previous_observation(images, ["plant"], ["image_id"], "image_id", "previous").filter("previous is not null")
    moved = mask.join(before.select(F.col("image_id").alias("next"), F.col("previous").alias("image_id")), "image_id").select(F.col("next").alias("image_id"), "y", "x")
    return mask.join(n.dilate(moved, px, 3, "cross"), PLACE, "left_semi")


@query("m13_downscale", sql("px", "select image_id, y // 3 as y, x // 3 as x, " + ", ".join(f"cast(floor(avg({c}) + 0.5) as int) as {c}" for c in "bgr") + " from px group by 1, 2, 3"))
def m13(spark, d):
    return n.downscale(fx.px(spark, d), 3)


# --- objects ---------------------------------------------------------------------------------------------------------

LINES = "ln as (select image_id, y, min(x) as first, max(x) as last, count(*) as count, max(x) - min(x) + 1 as span from mask group by 1, 2)"


@query("a23_scanlines", sql("mask", LINES + " select *, round(count::double / span, 6) as solidity from ln"))
def a23(spark, d):
    return o.scanlines(fx.mask(spark, d)).withColumn("solidity", F.round("solidity", 6))


@query("a24_scanline_relation", sql("mask", "other as (select image_id, y, x from px where r between 80 and 140), j as (select coalesce(a.image_id, b.image_id) image_id, coalesce(a.y, b.y) y, a.x as ax, b.x as bx from mask a full join other b on a.image_id = b.image_id and a.y = b.y and a.x = b.x) select image_id, y, count(*) filter (ax is not null and bx is not null) as n_and, count(*) as n_or, bool_and(ax is null or bx is not null) as inside from j group by 1, 2"))
def a24(spark, d):
    return o.scanline_relation(fx.mask(spark, d), fx.px(spark, d).filter(F.col("r").between(80, 140)))


def widths(k: int) -> str:
    return LINES + f""", en as (select image_id, min(y) a, max(y) b from ln group by 1), ro as (select image_id, unnest(generate_series(a, b)) as y from en),
ff as (select ro.image_id, ro.y, coalesce(span, 0) as span, coalesce(count, 0) as count, ntile({k}) over (partition by ro.image_id order by ro.y) as slice from ro left join ln on ln.image_id = ro.image_id and ln.y = ro.y)
select image_id, slice::int as slice, sum(count)::bigint as area, sum(span)::bigint as hull, min(span) as min_width, max(span) as max_width, round(avg(span), 6) as avg_width, round(stddev_pop(span), 6) as std_width, round(sum(count)::double / sum(span), 6) as solidity from ff group by 1, 2"""


for _k, _id in ((1, "a25_widths"), (4, "a26_width_quantiles")):

    @query(_id, sql("mask", widths(_k)))
    def a26(spark, d, k=_k):
        return o.width_stats(fx.mask(spark, d), k).withColumns({c: F.round(c, 6) for c in ("avg_width", "std_width", "solidity")})


RUNS = "rn as (select image_id, y, min(x) as l, max(x) as r, count(*) as n from (select *, x - row_number() over (partition by image_id, y order by x) as k from mask) group by image_id, y, k)"


@query("w6_runs", sql("mask", RUNS + ' select image_id, y, l as "left", r as "right", n from rn'))
def w6(spark, d):
    return o.runs(fx.mask(spark, d))


@query("m11_clean_noise", sql("mask", RUNS + ", iso as (select * from rn a where not exists (select 1 from rn b where b.image_id = a.image_id and abs(b.y - a.y) = 1 and b.l <= a.r and b.r >= a.l)) select m.* from mask m where not exists (select 1 from iso where iso.image_id = m.image_id and iso.y = m.y and m.x between iso.l and iso.r)"))
def m11(spark, d):
    return o.clean_horizontal_noise(fx.mask(spark, d), 1, 1)


REPAIR = """mk as (select image_id, y, x from px where g between 85 and 220), wd as (select image_id, max(x) - min(x) + 1 as width from px group by 1),
sl as (select px.image_id, px.y, count(mk.x) as c, coalesce(max(mk.x) - min(mk.x) + 1, 0) as sp from px left join mk on mk.image_id = px.image_id and mk.y = px.y and mk.x = px.x group by 1, 2),
fl as (select sl.*, sp > 0 and c >= 0.99 * sp and sp >= width - 4 as filled from sl join wd using (image_id)),
nb as (select f.image_id, f.y, (select max(u.y) from fl u where u.image_id = f.image_id and u.y < f.y and not u.filled) as up, (select min(u.y) from fl u where u.image_id = f.image_id and u.y > f.y and not u.filled) as down from fl f where filled)
select mk.image_id, mk.y, mk.x from mk join fl on fl.image_id = mk.image_id and fl.y = mk.y where not filled union select nb.image_id, nb.y, mk.x from nb join mk on mk.image_id = nb.image_id and (mk.y = nb.up or mk.y = nb.down)"""


@query("m11_repair_rows", sql("px", REPAIR))
def m11b(spark, d):
    px = fx.px(spark, d)
    return o.repair_full_rows(px.filter(F.col("g").between(85, 220)), px)


def labelled(name: str = "lab", of: str = "mask", reach: int = 1) -> str:
    return f"""{name}_p as (select image_id, y, x, y * 1000 + x as id from {of}),
{name}_e as (select a.image_id, a.id as a, b.id as b from {name}_p a join {name}_p b on a.image_id = b.image_id and {'abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1' if reach else 'abs(a.y - b.y) + abs(a.x - b.x) <= 1'}),
{name}_r as (select image_id, id, id as root from {name}_p union select e.image_id, e.b, r.root from {name}_r r join {name}_e e on e.image_id = r.image_id and e.a = r.id where r.root < e.b),
{name} as (select image_id, id // 1000 as y, id % 1000 as x, min(root) as root from {name}_r group by image_id, id)"""


@query("m6_label_objects", sql("mask", labelled() + ", nb as (select *, dense_rank() over (partition by image_id order by root) as k from lab) select image_id, y, x, k::int as label from nb"))
def m6(spark, d):
    return o.label_objects(fx.mask(spark, d))


@query("m6_label_objects_star", sql("mask", labelled() + ", nb as (select *, dense_rank() over (partition by image_id order by root) as k from lab) select image_id, y, x, k::int as label from nb"))
def m6b(spark, d):
    return o.label_objects(fx.mask(spark, d), method="star")


@query("a30_object_list", sql("mask", labelled() + " select image_id, dense_rank() over (partition by image_id order by root)::int as label, count(*) as area, min(lab.x) as x, min(lab.y) as y, max(lab.x) - min(lab.x) + 1 as w, max(lab.y) - min(lab.y) + 1 as h from lab group by image_id, root"))
def a30(spark, d):
    return o.object_list(o.label_objects(fx.mask(spark, d)))


@query("o6_largest_object", sql("mask", labelled() + ", c as (select image_id, dense_rank() over (partition by image_id order by root)::int as label, count(*) as area from lab group by image_id, root) select image_id, label from (select *, row_number() over (partition by image_id order by area desc, label) k from c) where k = 1"))
def o6(spark, d):
    return o.largest_object(o.label_objects(fx.mask(spark, d)))


@query("o6_largest_weighted", sql("mask", labelled() + ", c as (select image_id, dense_rank() over (partition by image_id order by root)::int as label, count(*)::double as area, sqrt((avg(y) - 40) * (avg(y) - 40) + (avg(x) - 10) * (avg(x) - 10)) as dist from lab group by image_id, root), w as (select *, round(area * (1 - dist / max(dist) over (partition by image_id)) * (1 - dist / max(dist) over (partition by image_id)), 6) as score from c) select image_id, label from (select *, row_number() over (partition by image_id order by score desc, label) k from w) where k = 1"))
def o6b(spark, d):
    return o.largest_object(o.label_objects(fx.mask(spark, d)), anchor=(40.0, 10.0))


@query("m7_filter_by_size", sql("mask", labelled() + ", c as (select image_id, root, count(*) as area from lab group by 1, 2) select image_id, y, x from lab join c using (image_id, root) where area > 5 and area < 200"))
def m7(spark, d):
    return o.filter_by_size(o.label_objects(fx.mask(spark, d)), 5, 200)


@query("m5_fill_holes", sql("mask", REST + ", " + labelled("bg", "rest", 0) + ", en as (select image_id, min(y) y0, max(y) y1, min(x) x0, max(x) x1 from px group by 1), ou as (select distinct image_id, root from bg join en using (image_id) where y = y0 or y = y1 or x = x0 or x = x1) select image_id, y, x from mask union all select bg.image_id, bg.y, bg.x from bg where not exists (select 1 from ou where ou.image_id = bg.image_id and ou.root = bg.root)"))
def m5(spark, d):
    return o.fill_holes(fx.mask(spark, d), fx.px(spark, d))


PART = "pa as (select image_id, y, x from mask where x >= 3 and x < 19 and y >= 5 and y < 40), rest as (select image_id, y, x from px except select image_id, y, x from pa), " + labelled("bg", "rest", 0) + ", en as (select image_id, min(y) y0, max(y) y1, min(x) x0, max(x) x1 from px group by 1), ou as (select distinct image_id, root from bg join en using (image_id) where y = y0 or y = y1 or x = x0 or x = x1), ho as (select bg.* from bg where not exists (select 1 from ou where ou.image_id = bg.image_id and ou.root = bg.root))"


@query("m5_fill_holes_region", sql("mask", PART + " select image_id, y, x from mask union select image_id, y, x from ho"))
def m5b(spark, d):
    return o.fill_holes(fx.mask(spark, d), fx.px(spark, d), r.region_column(r.rectangle(1, "part", 3, 5, 16, 35, "main")))


@query("m5_count_holes", sql("mask", PART + ", ct as (select image_id, count(distinct root) as holes, count(*) as hole_pixels from ho group by 1) select image_id, coalesce(holes, 0) as holes, coalesce(hole_pixels, 0) as hole_pixels from (select distinct image_id from px) left join ct using (image_id)"))
def m5c(spark, d):
    return o.count_holes(fx.mask(spark, d), fx.px(spark, d), r.region_column(r.rectangle(1, "part", 3, 5, 16, 35, "main")))


OBJ = labelled() + ", ob as (select image_id, root, count(*) as area, min(x) as x0, min(y) as y0, max(x) - min(x) + 1 as w, max(y) - min(y) + 1 as h from lab group by 1, 2), big as (select * from (select *, row_number() over (partition by image_id order by area desc, root) k from ob) where k = 1)"


def small_mask(spark, d):
    return fx.px(spark, d).filter(F.col("g").between(100, 125)).select(*PLACE)


SMALL = "small as (select image_id, y, x from px where g between 100 and 125), "


@query("m8_keep_biggest", sql("px", SMALL + OBJ.replace("from mask)", "from small)") + ", kp as (select ob.image_id, ob.root from ob join big b on b.image_id = ob.image_id and ob.x0 < b.x0 + b.w + 1 and ob.x0 + ob.w > b.x0 - 1 and ob.y0 < b.y0 + b.h + 1 and ob.y0 + ob.h > b.y0 - 1) select lab.image_id, lab.y, lab.x from lab join kp using (image_id, root)"))
def m8(spark, d):
    return o.keep_biggest(small_mask(spark, d))


DIST = ", ds as (select a.image_id, a.root as a, b.root as b, sqrt(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))::double) as distance from lab a join lab b on a.image_id = b.image_id and a.root <> b.root and (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) < 9 group by 1, 2, 3)"
NUM = ", nm as (select image_id, root, dense_rank() over (partition by image_id order by root)::int as label from (select distinct image_id, root from lab))"


@query("j14_object_distances", sql("px", SMALL + OBJ.replace("from mask)", "from small)") + DIST + NUM + " select ds.image_id, n1.label as a, n2.label as b, round(distance, 6) as distance from ds join nm n1 on n1.image_id = ds.image_id and n1.root = ds.a join nm n2 on n2.image_id = ds.image_id and n2.root = ds.b where n1.label < n2.label"))
def j14(spark, d):
    return o.object_distances(o.label_objects(small_mask(spark, d)), 3).withColumn("distance", F.round("distance", 6))


@query("j14_far_objects", sql("px", SMALL + OBJ.replace("from mask)", "from small)") + DIST.replace("< 9", "< 182.25") + NUM + " select ds.image_id, n1.label as a, n2.label as b, round(distance, 6) as distance from ds join nm n1 on n1.image_id = ds.image_id and n1.root = ds.a join nm n2 on n2.image_id = ds.image_id and n2.root = ds.b where n1.label < n2.label"))
def j14b(spark, d):
    return o.object_distances(o.label_objects(small_mask(spark, d)), 13.5).withColumn("distance", F.round("distance", 6))


REACH = ", rc as (select image_id, root from {start} union select ds.image_id, ds.b from rc join ds on ds.image_id = rc.image_id and ds.a = rc.root {ok}) select lab.image_id, lab.y, lab.x from lab join (select distinct * from rc) using (image_id, root)"


@query("m9_keep_linked", sql("px", SMALL + OBJ.replace("from mask)", "from small)") + DIST + ", gd as (select image_id, root from ob where area >= 2)" + REACH.format(start="big", ok="join gd on gd.image_id = ds.image_id and gd.root = ds.b")))
def m9(spark, d):
    return o.keep_linked(small_mask(spark, d), 3, 2)


@query("m9_keep_far_linked", sql("px", "small as (select image_id, y, x from px where g between 100 and 104), " + OBJ.replace("from mask)", "from small)") + DIST.replace("< 9", "< 30.25") + ", gd as (select image_id, root from ob)" + REACH.format(start="big", ok="join gd on gd.image_id = ds.image_id and gd.root = ds.b")))
def m9c(spark, d):
    return o.keep_linked(fx.px(spark, d).filter(F.col("g").between(100, 104)).select(*PLACE), 5.5)


OVER = OBJ.replace("from mask)", "from small)").replace("lab as (", "la0 as (").replace(", ob as (", ", sz as (select image_id, root from la0 group by 1, 2 having count(*) >= 2), lab as (select la0.* from la0 join sz using (image_id, root)), ob as (")


@query("m9_keep_linked_override", sql("px", SMALL + OVER + DIST + ", gd as (select image_id, root from ob where area >= 3), st as (select image_id, root from big union select distinct ob.image_id, ob.root from ob join lab using (image_id, root) where area > 4 and lab.x >= 3 and lab.x < 11 and lab.y >= 5 and lab.y < 17)" + REACH.format(start="st", ok="join (select * from gd union select * from st) gs on gs.image_id = ds.image_id and gs.root = ds.b")))
def m9b(spark, d):
    return o.keep_linked(small_mask(spark, d), 3, 3, override=4, safe=r.region_column(RECT), drop_below=2)


CLASSES = OBJ.replace("from mask)", "from small)") + DIST.replace("< 9", "< 16") + f""", grow(dy, dx) as (values {', '.join(map(str, n.structuring_element(3)))}), zone as (select distinct image_id, y + dy as y, x + dx as x from px, grow where x >= 3 and x < 11 and y >= 5 and y < 17),
tc as (select distinct image_id, root from lab join zone using (image_id, y, x)), kd as (select ob.image_id, ob.root, case when tc.root is null then 'unknown' when area > 2 then 'root' else 'small' end as kind from ob left join tc on tc.image_id = ob.image_id and tc.root = ob.root),
k1 as (select image_id, root from kd where kind = 'root' union select ds.image_id, ds.b from k1 join ds on ds.image_id = k1.image_id and ds.a = k1.root and distance < 2 join kd on kd.image_id = ds.image_id and kd.root = ds.b and kind = 'small'),
k2 as (select image_id, root from k1 union select ds.image_id, ds.b from k2 join ds on ds.image_id = k2.image_id and ds.a = k2.root and distance < 4 join kd on kd.image_id = ds.image_id and kd.root = ds.b and kind = 'unknown')"""


@query("m10_region_classes", sql("px", SMALL + CLASSES + NUM + """, k3 as (select image_id, root, root as plant from kd where kind = 'root' union select ds.image_id, ds.b, k3.plant from k3 join ds on ds.image_id = k3.image_id and ds.a = k3.root and distance < 3 join kd on kd.image_id = ds.image_id and kd.root = ds.b and kind = 'root'),
k4 as (select image_id, root, min(plant) as plant from k3 group by 1, 2) select kd.image_id, nm.label, kind, coalesce(np.label, 0) as plant, k2.root is not null as kept from kd join nm using (image_id, root) left join k2 on k2.image_id = kd.image_id and k2.root = kd.root left join k4 on k4.image_id = kd.image_id and k4.root = kd.root left join nm np on np.image_id = k4.image_id and np.root = k4.plant"""))
def m10b(spark, d):
    px = fx.px(spark, d)
    region = n.dilate(px.filter(r.region_column(RECT)), px, 3)
    return o.region_classes(o.label_objects(small_mask(spark, d)), region, 2, small_distance=2, unknown_distance=4, root_distance=3).fillna(0, ["plant"])


@query("m10_keep_region_classes", sql("px", SMALL + CLASSES + " select lab.image_id, lab.y, lab.x from lab join (select distinct image_id, root from k2) using (image_id, root)"))
def m10c(spark, d):
    return o.keep_region_classes(small_mask(spark, d), fx.px(spark, d), r.region_column(RECT), dilation=3, min_root=2, small_distance=2, unknown_distance=4, root_distance=3)


@query("m10_keep_near_regions", sql("px", SMALL + OBJ.replace("from mask)", "from small)") + DIST + ", gd as (select image_id, root from ob where area >= 2 union select image_id, root from lab where x >= 3 and x < 11 and y >= 5 and y < 17), st as (select distinct image_id, root from lab where x >= 3 and x < 11 and y >= 5 and y < 17)" + REACH.format(start="st", ok="join gd on gd.image_id = ds.image_id and gd.root = ds.b")))
def m10(spark, d):
    return o.keep_near_regions(small_mask(spark, d), r.region_column(RECT), 3, 2)


@query("h7_hysteresis", sql("px", convolved("sobel_h", "ka") + ", " + convolved("sobel_v", "kb") + ", ed as (select ka.image_id, ka.y, ka.x, sqrt((ka.edge * ka.edge + kb.edge * kb.edge) / 2) as edge from ka join kb on ka.image_id = kb.image_id and ka.y = kb.y and ka.x = kb.x), weak as (select image_id, y, x from ed where edge > 110), " + labelled("lab", "weak") + ", sd as (select distinct lab.image_id, root from lab join ed using (image_id, y, x) where edge > 160) select image_id, y, x from lab join sd using (image_id, root)"))
def h7(spark, d):
    edges = n.convolve3(fx.px(spark, d), "g", "sobel")
    return o.hysteresis(edges.filter("edge > 110"), edges.filter("edge > 160"))


def _across(dy: int, dx: int) -> str:
    return f"greatest(coalesce((select b.edge from gr b where b.image_id = gr.image_id and b.y = gr.y + {dy} and b.x = gr.x + {dx}), 0), coalesce((select b.edge from gr b where b.image_id = gr.image_id and b.y = gr.y - {dy} and b.x = gr.x - ({dx})), 0))"


FLAT = math.tan(math.pi / 8)
CANNY = gauss(5) + ", sm as (select image_id, y, x, round(smooth, 6) as g from g2), " + ", ".join(convolved(k, t).replace("px a", "sm a").replace("px b", "sm b") for k, t in (("sobel_h", "kh"), ("sobel_v", "kv"))) + f""",
ge as (select kh.image_id, kh.y, kh.x, round(kh.edge, 6) as gy, round(kv.edge, 6) as gx from kh join kv on kh.image_id = kv.image_id and kh.y = kv.y and kh.x = kv.x), gr as (select *, sqrt(gy * gy + gx * gx) as edge from ge),
nm as (select image_id, y, x, edge, case when abs(gy) <= abs(gx) * {FLAT}::double then {_across(0, 1)} when abs(gx) <= abs(gy) * {FLAT}::double then {_across(1, 0)} when gy * gx > 0 then {_across(1, 1)} else {_across(1, -1)} end as beside from gr),
th as (select image_id, y, x, edge from nm where edge > 0 and edge >= beside)"""


@query("e1_thin_edges", sql("px", CANNY + " select image_id, y, x, round(edge, 4) as edge from th"))
def e1(spark, d):
    return ed.thin_edges(ed.gradients(fx.px(spark, d), "g")).withColumn("edge", F.round("edge", 4))


@query("e1_canny", sql("px", CANNY + ", weak as (select image_id, y, x from th where edge > 60), " + labelled("lab", "weak") + ", sd as (select distinct lab.image_id, root from lab join th using (image_id, y, x) where edge > 150) select image_id, y, x from lab join sd using (image_id, root)"))
def e1b(spark, d):
    return ed.canny(fx.px(spark, d), "g", 60, 150)


@query("e2_skeleton")  # SQL cannot express it; tests hold it against thinning of whole images
def e2(spark, d):
    return thinning.skeleton(n.close_(fx.mask(spark, d), fx.px(spark, d), size=3, shape="rectangle"))


@query("e3_regional_maxima")  # SQL cannot express e3 and e4 in passes; tests hold them against brute force on whole images
def e3(spark, d):
    return flooding.regional_maxima(fx.px(spark, d), "g", border=5)


@query("e4_watershed")
def e4(spark, d):
    """The level falls towards dark pixels; the darkest objects are the markers."""
    px = fx.px(spark, d)
    return flooding.watershed(px, "g", o.label_objects(px.filter("g < 70"), 4))


_NEAR = {"top_left": ("cy", "cx"), "top_right": ("cy", "(w - cx)"), "bottom_right": ("(h - cy)", "(w - cx)"), "bottom_left": ("(h - cy)", "cx")}
DOTS = "dm as (select image_id, y, x from px where g between 120 and 124), " + labelled(of="dm") + """, dt as (select image_id, root, cast(floor(avg(y)) as bigint) as cy, cast(floor(avg(x)) as bigint) as cx from lab group by 1, 2 having count(*) between 2 and 3000),
sz as (select image_id, max(y) + 1 as h, max(x) + 1 as w from px group by 1),
qd as (select image_id, """ + ", ".join(f"first({c} order by {y} * {y} + {x} * {x}, cy, cx) as {k}_{c[1]}" for k, (y, x) in _NEAR.items() for c in ("cy", "cx")) + " from dt join sz using (image_id) group by 1)"
WARP = DOTS + """, q1 as (select *, (top_right_x - bottom_right_x)::double as dx1, (bottom_left_x - bottom_right_x)::double as dx2, (top_right_y - bottom_right_y)::double as dy1, (bottom_left_y - bottom_right_y)::double as dy2,
  (top_left_x - top_right_x + bottom_right_x - bottom_left_x)::double as sx, (top_left_y - top_right_y + bottom_right_y - bottom_left_y)::double as sy from qd),
q2 as (select *, dx1 * dy2 - dx2 * dy1 as den from q1), q3 as (select *, (sx * dy2 - dx2 * sy) / den as g, (dx1 * sy - sx * dy1) / den as h from q2 where den <> 0),
q4 as (select image_id, top_right_x - top_left_x + g * top_right_x as a, bottom_left_x - top_left_x + h * bottom_left_x as b, top_left_x as c, top_right_y - top_left_y + g * top_right_y as d, bottom_left_y - top_left_y + h * bottom_left_y as e, top_left_y as f, g, h from q3),
q5 as (select *, u / 15.0::double as s, v / 11.0::double as t from q4, (select unnest(range(16)) as u), (select unnest(range(12)) as v)),
q6 as (select *, g * s + h * t + 1 as w from q5), q7 as (select image_id, v, u, (a * s + b * t + c) / nullif(w, 0) as sx, (d * s + e * t + f) / nullif(w, 0) as sy from q6),
q8 as (select image_id, v, u, case when abs(sx) < 1e9 and abs(sy) < 1e9 then sx end as sx, case when abs(sx) < 1e9 and abs(sy) < 1e9 then sy end as sy from q7)"""


def marked_corners(px):
    """The outermost dots of one tone of green."""
    return perspective.corners(perspective.dots(px.filter("g between 120 and 124").select(*PLACE), 2), px)


@query("e5_corners", sql("px", DOTS + " select * from qd"))
def e5(spark, d):
    return marked_corners(fx.px(spark, d))


@query("e5_fix_perspective", sql("px", WARP + """, q9 as (select image_id, v, u, floor(sy) + i as y, floor(sx) + j as x, (case i when 1 then sy - floor(sy) else 1 - (sy - floor(sy)) end) * (case j when 1 then sx - floor(sx) else 1 - (sx - floor(sx)) end) as w from q8, (values (0), (1)) a(i), (values (0), (1)) b(j))
select q9.image_id, v::int as y, u::int as x, """ + ", ".join(f"cast(floor(round(sum(coalesce(w * px.{c}, 0)), 6) + 0.5) as int) as {c}" for c in "bgr") + " from q9 left join px on px.image_id = q9.image_id and px.y = q9.y and px.x = q9.x group by 1, 2, 3"))
def e5b(spark, d):
    px = fx.px(spark, d)
    return perspective.fix_perspective(px, marked_corners(px), 16, 12)


@query("e5_fix_perspective_nearest", sql("px", WARP + """ select q8.image_id, v::int as y, u::int as x, """ + ", ".join(f"coalesce(px.{c}, 0)::int as {c}" for c in "bgr") + " from q8 left join px on px.image_id = q8.image_id and px.y = floor(sy + 0.5) and px.x = floor(sx + 0.5)"))
def e5c(spark, d):
    px = fx.px(spark, d)
    return perspective.fix_perspective(px, marked_corners(px), 16, 12, method="nearest")


@query("a20_shape", sql("mask", "select image_id, count(*) as area, round(avg(x), 6) as centroid_x, round(avg(y), 6) as centroid_y, min(mask.x) as \"left\", min(mask.y) as top, max(x) - min(x) + 1 as width, max(y) - min(y) + 1 as height, round(count(*)::double / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1)), 6) as extent from mask group by 1"))
def a20(spark, d):
    return o.shape_features(fx.mask(spark, d)).withColumns({c: F.round(c, 6) for c in ("centroid_x", "centroid_y", "extent")})


@query("a22_perimeter", sql("mask", "select image_id, count(*) as perimeter from mask m where (select count(*) from mask k where k.image_id = m.image_id and abs(k.y - m.y) + abs(k.x - m.x) = 1) < 4 group by 1"))
def a22(spark, d):
    return o.perimeter(fx.mask(spark, d))


@query("a27_bound", sql("mask", "select image_id, max(y) - min(y) + 1 as total_height, coalesce(20 - min(case when y < 20 then y end), 0) as above_bound_height, coalesce(max(case when y >= 20 then y end) - 20 + 1, 0) as below_bound_height, count(*) filter (y < 20) as above_bound_area, count(*) filter (y >= 20) as below_bound_area, round(100.0 * count(*) filter (y < 20) / count(*), 6) as above_bound_percent_area, round(100.0 * count(*) filter (y >= 20) / count(*), 6) as below_bound_percent_area from mask group by 1"))
def a27(spark, d):
    return o.bound_features(fx.mask(spark, d), 20).withColumns({c: F.round(c, 6) for c in ("above_bound_percent_area", "below_bound_percent_area")})


@query("a21_hull")
def a21(spark, d):
    return o.hull_features(fx.mask(spark, d))


@query("a33_quality_report", sql("mask", LINES + """, no as (select distinct image_id, y from px where y % 9 = 4 and x = 0), sc as (select image_id, min(y) top, max(y) bottom, arg_min(first, y) f, arg_min(last, y) l, arg_min(span, y) sp from ln group by 1),
hit as (select no.image_id, count(*) filter (no.y between top and bottom) as hit, count(*) as noise from no join sc on sc.image_id = no.image_id group by 1),
er as (select sc.image_id, case when bottom < 110 - 60 then 3 else 0 end as plant_bottom_error, case when f <= 10 and sp < 21 / 3.0 then 2 when l >= 21 - 10 and sp < 110 / 3.0 then 2 else 0 end as leaning_error,
  case when coalesce(noise, 0) = 0 then 0 when hit = 0 then 1 else (case when (bottom - top)::double / greatest(hit, 1) > 100 then 1 when (bottom - top)::double / greatest(hit, 1) > 40 then 2 else 3 end) + case when noise > hit then 1 else 0 end end as noise_error from sc left join hit using (image_id)),
gd as (select image_id, case when avg(last_ - first_ + 1) > 6 then 1 else 0 end + case when sum(last_ - first_ + 1)::double / sum(c) > 1.1 then 1 else 0 end as guide_error from (select image_id, y, min(x) as first_, max(x) as last_, count(*) as c from mask where y < 10 and x between 8 and 16 group by 1, 2) group by 1),
tp as (select image_id, min(y) as e, min(case when x = 10 then y end) as p, max(case when x = 10 then y end) as f from mask group by 1),
al as (select er.*, coalesce(guide_error, 0) as guide_error, (case when e <> 0 and abs(p - e) > 30 then 2 else 0 end) + (case when e <> 0 and abs(f - e) > 30 then 2 else 0 end) as plant_top_error from er left join gd using (image_id) left join tp using (image_id))
select *, greatest(plant_bottom_error, leaning_error, noise_error, guide_error, plant_top_error) + greatest((plant_bottom_error >= 2)::int + (leaning_error >= 2)::int + (noise_error >= 2)::int + (guide_error >= 2)::int + (plant_top_error >= 2)::int - 1, 0) as error_level from al"""))
def a33(spark, d):
    noise = fx.px(spark, d).filter("y % 9 = 4 and x = 0").select("image_id", "y").distinct()
    mask = fx.mask(spark, d)
    at_ten = F.when(F.col("x") == 10, F.col("y"))
    tops = mask.groupBy("image_id").agg(F.min("y").alias("expected_top"), F.min(at_ten).alias("plant_top"), F.max(at_ten).alias("final_top"))
    return o.quality_report(mask, 21, 110, noise, guide=mask.filter("y < 10 and x between 8 and 16"), tops=tops)


# --- regions ---------------------------------------------------------------------------------------------------------

RECT = r.rectangle(1, "rect", 3, 5, 8, 12, "main")
CIRCLE = r.circle(2, "circle", 10, 15, 6, "main")
RING = r.circle(3, "ring", 10, 15, 8, "side", 3)
TURNED = r.rectangle(4, "turned", 4, 10, 10, 8, "side", 30)
COS, SIN = "cos(radians(30))", "sin(radians(30))"
IN = {
    1: "(x >= 3 and x < 11 and y >= 5 and y < 17)",
    2: "((x - 10) * (x - 10) + (y - 15) * (y - 15) <= 36)",
    3: "((x - 10) * (x - 10) + (y - 15) * (y - 15) between 9 and 64)",
    4: f"(abs(round((x - 9) * {COS} + (y - 14) * {SIN}, 9)) <= 5 and abs(round((y - 14) * {COS} - (x - 9) * {SIN}, 9)) <= 4)",
}


def rois(spark, *rows):
    return r.regions(spark, rows or (RECT, CIRCLE, RING, TURNED))


@query("j9_keep_regions", sql("px", f"select image_id, y, x from px where {IN[1]} or {IN[2]} or {IN[3]} or {IN[4]}"))
def j9(spark, d):
    return r.keep_regions(fx.px(spark, d), rois(spark)).select(*PLACE)


@query("j10_delete_regions", sql("px", f"select image_id, y, x from px where not ({IN[1]} or {IN[2]})"))
def j10(spark, d):
    return r.delete_regions(fx.px(spark, d), rois(spark, RECT, CIRCLE)).select(*PLACE)


@query("j11_copy_regions", sql("px", f"select image_id, y, x, case when {IN[2]} then 255 - g else g end as g from px"))
def j11(spark, d):
    px = fx.px(spark, d).select(*PLACE, "g")
    return r.copy_regions(px.withColumn("g", 255 - F.col("g")), px, rois(spark, CIRCLE))


LEVELS = (150, 170, 190, 205, 220)
BOXES = "bx as (" + " union all ".join(f"select image_id, {k} as id, min(x)::double as l, min(y)::double as t, (max(x) - min(x) + 1)::double as w, (max(y) - min(y) + 1)::double as h from px where {c} > {v} and y % 7 < {k} group by 1" for k, (c, v) in enumerate([(c, v) for c in "bgr" for v in LEVELS], 1)) + ")"


def boxes(spark, d):
    """Regions of each image: the bounds of its brighter pixels, for each channel and some levels."""
    px = fx.px(spark, d)
    parts = []
    for k, (c, v) in enumerate([(c, v) for c in "bgr" for v in LEVELS], 1):
        b = px.filter((F.col(c) > v) & (F.col("y") % 7 < k)).groupBy("image_id").agg(F.min("x").cast("double").alias("left"), F.min("y").cast("double").alias("top"), (F.max("x") - F.min("x") + 1).cast("double").alias("width"), (F.max("y") - F.min("y") + 1).cast("double").alias("height"))
        parts.append(b.withColumns({"roi_id": F.lit(k), "name": F.lit(f"{c}{v}"), "shape": F.lit("rect"), "cx": F.col("left") + F.col("width") / 2, "cy": F.col("top") + F.col("height") / 2, "radius": F.least("width", "height") / 2, "in_radius": F.lit(0.0)}))
    return functools.reduce(lambda x, y: x.unionByName(y), parts)


@query("j12_rectangle_relations", sql("px", BOXES + " select a.image_id, a.id as a_id, b.id as b_id, a.l <= b.l and a.t <= b.t and a.l + a.w >= b.l + b.w and a.t + a.h >= b.t + b.h as contains from bx a join bx b on a.image_id = b.image_id where a.id <> b.id and a.l < b.l + b.w and b.l < a.l + a.w and a.t < b.t + b.h and b.t < a.t + a.h"))
def j12(spark, d):
    some = boxes(spark, d)
    return r.rectangle_relations(some, some, ["image_id"])


@query("j12_circle_relations", sql("px", BOXES + ", ci as (select *, l + w / 2 as cx, t + h / 2 as cy, least(w, h) / 2 as rad from bx) select a.image_id, a.id as a_id, b.id as b_id, (cx - greatest(a.l, least(cx, a.l + a.w))) * (cx - greatest(a.l, least(cx, a.l + a.w))) + (cy - greatest(a.t, least(cy, a.t + a.h))) * (cy - greatest(a.t, least(cy, a.t + a.h))) <= rad * rad as touches, cx - rad >= a.l and cx + rad <= a.l + a.w and cy - rad >= a.t and cy + rad <= a.t + a.h as contains from bx a join ci b on a.image_id = b.image_id"))
def j12b(spark, d):
    some = boxes(spark, d)
    return r.region_pairs(some, some, ["image_id"])


def many_rois(spark, d):
    """A region for each embedding, on its image: small rectangles, turned ones, circles and rings."""
    at = t.table(spark, d, "embeddings").select(F.col("label").alias("image_id"), F.col("vec_id").cast("int").alias("roi_id"))
    left, top = (F.col("roi_id") * 5 % 19).cast("double"), F.floor(F.col("roi_id") / 10).cast("double")
    width, height = (F.col("roi_id") % 4 + 1).cast("double"), (F.col("roi_id") % 3 + 1).cast("double")
    shape = F.get(F.array(*map(F.lit, ("rect", "circle", "annulus", "rotated"))), F.col("roi_id") % 4)
    sized = at.select("*", F.lit("").alias("name"), F.lit("").alias("tag"), shape.alias("shape"), left.alias("left"), top.alias("top"), width.alias("width"), height.alias("height"))
    round_ = F.col("shape").isin("circle", "annulus")
    box = {c: F.when(round_, F.lit(4.0)).otherwise(F.col(c)) for c in ("width", "height")}
    middle = {"cx": F.col("left") + F.col("width") / 2, "cy": F.col("top") + F.col("height") / 2}
    return sized.withColumns(box).withColumns(middle | {"radius": F.lit(2.0), "in_radius": F.lit(1.5), "angle": F.when(F.col("shape") == "rotated", 30.0).otherwise(0.0)})


MANY = f"""mr as (select label as image_id, vec_id as roi_id, vec_id % 4 as s, (vec_id * 5 % 19)::double as l, (vec_id // 10)::double as t, case when vec_id % 4 in (1, 2) then 4.0 else (vec_id % 4 + 1)::double end as w, case when vec_id % 4 in (1, 2) then 4.0 else (vec_id % 3 + 1)::double end as h from embeddings),
mc as (select *, l + w / 2 as cx, t + h / 2 as cy from mr),
mh as (select px.image_id, y, x, roi_id from px join mc on px.image_id = mc.image_id and case s when 0 then x >= l and x < l + w and y >= t and y < t + h when 1 then (x - cx) ** 2 + (y - cy) ** 2 <= 4 when 2 then (x - cx) ** 2 + (y - cy) ** 2 between 2.25 and 4
  else abs(round((x - cx) * {COS} + (y - cy) * {SIN}, 9)) <= w / 2 and abs(round((y - cy) * {COS} - (x - cx) * {SIN}, 9)) <= h / 2 end)"""


@query("j9_keep_own_regions", sql("px", MANY + " select distinct image_id, y, x from mh"))
def j9b(spark, d):
    return r.keep_regions(fx.px(spark, d), many_rois(spark, d)).select(*PLACE)


@query("j10_delete_own_regions", sql("px", MANY + " select image_id, y, x from px except select image_id, y, x from mh"))
def j10b(spark, d):
    return r.delete_regions(fx.px(spark, d), many_rois(spark, d)).select(*PLACE)


@query("j13_own_region_hits", sql("px", MANY + " select image_id, x as label, roi_id::int as roi_id, count(*) as n from mh group by 1, 2, 3"))
def j13b(spark, d):
    return r.region_hits(fx.px(spark, d).withColumn("label", F.col("x")), many_rois(spark, d))


@query("r6_assert_own_positions", sql("px", MANY + ", h as (select image_id, count(distinct roi_id) as n from mh where x < 18 group by 1), q as (select image_id, count(*) as n from mr group by 1) select q.image_id, coalesce(h.n, 0) = q.n as passed from q left join h using (image_id)"))
def r6b(spark, d):
    px = fx.px(spark, d)
    return r.assert_mask_position(px.filter("x < 18"), many_rois(spark, d), px)


@query("j13_region_hits", sql("px", SMALL + labelled("lab", "small") + NUM + f" select lab.image_id, label, roi_id, count(*) as n from lab join nm using (image_id, root) join (values (1), (2)) as q(roi_id) on (roi_id = 1 and {IN[1]}) or (roi_id = 2 and {IN[2]}) group by 1, 2, 3"))
def j13(spark, d):
    return r.region_hits(o.label_objects(small_mask(spark, d)), rois(spark, RECT, CIRCLE))


@query("u6_compose_intersection", sql("px", f"select image_id, y, x from px where {IN[1]} and {IN[2]} and {IN[4]}"))
def u6(spark, d):
    return r.compose(fx.px(spark, d), rois(spark, RECT, CIRCLE, TURNED), "intersection").select(*PLACE)


@query("r1_rectangle_case", sql("px", "select image_id, y, x from px where image_id::varchar in ('1', '4') and x >= 2.1 and x < 2.1 + 10.5 and y >= 4 and y < 4 + 20"))
def r1(spark, d):
    region = r.relative_rectangle(1, "part", 21, 40, 10, 10, 50, 50)
    return fx.px(spark, d).filter(r.case_condition("image_id=1, 4|") & r.region_column(region)).select(*PLACE)


@query("r2_region_membership", sql("px", f"select image_id, y, x, {IN[1]} as rect, {IN[2]} as circle, {IN[3]} as ring, {IN[4]} as turned from px"))
def r2(spark, d):
    return fx.px(spark, d).select(*PLACE, *[r.region_column(x).alias(x[1]) for x in (RECT, CIRCLE, RING, TURNED)])


@query("r3_region_limited_erode", sql("mask", ERODED + f" select image_id, y, x from mask where not {IN[1]} union all select image_id, y, x from er where {IN[1]}"))
def r3(spark, d):
    mask, px = fx.mask(spark, d), fx.px(spark, d)
    one = rois(spark, RECT)
    return r.delete_regions(mask, one).unionByName(r.keep_regions(n.erode(mask, px, 3, "cross"), one))


@query("r5_tagged_regions", sql("px", f"select image_id, y, x from px where {IN[3]} or {IN[4]}"))
def r5(spark, d):
    return r.keep_regions(fx.px(spark, d), r.select_regions(rois(spark), tag="side")).select(*PLACE)


@query("r6_assert_position", sql("px", f"sm as (select image_id, y, x from px where g between 100 and 102), h as (select image_id, count(*) filter ({IN[1]}) > 0 and count(*) filter ({IN[2]}) > 0 as ok from sm group by 1) select image_id, coalesce(ok, false) as passed from (select distinct image_id from px) left join h using (image_id)"))
def r6(spark, d):
    px = fx.px(spark, d)
    return r.assert_mask_position(px.filter(F.col("g").between(100, 102)), rois(spark, RECT, CIRCLE), px)


@query("r7_check_source", sql("px", "select image_id, max(x) + 1 as width, max(y) + 1 as height, count(*) = (max(x) + 1) * (max(y) + 1) as complete from px group by 1"))
def r7(spark, d):
    return r.check_source(fx.px(spark, d))


NAMED = "nm as (select bx.*, " + "case id " + " ".join(f"when {k} then '{c}{v}'" for k, (c, v) in enumerate([(c, v) for c in "bgr" for v in LEVELS], 1)) + " end as name from bx)"


@query("a29_region_features", sql("px", BOXES + ", " + NAMED + ' select image_id, id as roi_id, name, l as "left", l + w as "right", t as top, t + h as bottom, l + w / 2 as cx, t + h / 2 as cy, w as width, h as height from nm'))
def a29(spark, d):
    return r.roi_features(boxes(spark, d), ["image_id"])


@query("x16_region_anchors", sql("px", BOXES + " select image_id, id as roi_id, l + w as bottom_right_x, t + h as bottom_right_y, l + w / 2 as top_center_x, t + h / 2 as middle_left_y, w * h as area, round(w / h, 6) as aspect_ratio, least(w, h) / 2 as as_circle_radius, round(l + w / 2 + 5 * cos(radians(40.0)), 6) as ax, round(t + h / 2 + 5 * sin(radians(40.0)), 6) as ay from bx"))
def x16(spark, d):
    a = r.anchors()
    ax, ay = r.point_at_angle(F.col("cx"), F.col("cy"), F.lit(5.0), F.lit(40.0))
    return boxes(spark, d).select("image_id", "roi_id", a["bottom_right"]["x"].alias("bottom_right_x"), a["bottom_right"]["y"].alias("bottom_right_y"), a["top_center"]["x"].alias("top_center_x"), a["middle_left"]["y"].alias("middle_left_y"), a["area"].alias("area"), F.round(a["aspect_ratio"], 6).alias("aspect_ratio"), a["as_circle_radius"].alias("as_circle_radius"), F.round(ax, 6).alias("ax"), F.round(ay, 6).alias("ay"))


SIDES = "select image_id, min(x) as l1, min(y) as t1, max(x) as r1, max(y) as b1 from px where g > 200 group by 1"


@query("u7_merge_rectangles", sql("px", f"a as ({SIDES}), b as ({SIDES.replace('g > 200', 'b > 205').replace('l1', 'l2').replace('t1', 't2').replace('r1', 'r2').replace('b1', 'b2')}) select image_id, greatest(l1, l2) as \"left\", greatest(t1, t2) as top, least(r1, r2) as \"right\", least(b1, b2) as bottom from a join b using (image_id)"))
def u7(spark, d):
    def box_of(condition: str, prefix: str):
        return fx.px(spark, d).filter(condition).groupBy("image_id").agg(F.min("x").alias(f"{prefix}_left"), F.min("y").alias(f"{prefix}_top"), F.max("x").alias(f"{prefix}_right"), F.max("y").alias(f"{prefix}_bottom"))

    return box_of("g > 200", "a").join(box_of("b > 205", "b"), "image_id").select("image_id", *r.merge_rectangles("a", "b", "intersection"))


# --- generators ------------------------------------------------------------------------------------------------------


@query("g1_crop", sql("px", "select image_id, y - 5 as y, x - 2 as x, b, g, r from px where x between 2 and 11 and y between 5 and 16"))
def g1(spark, d):
    return r.crop(fx.px(spark, d), 3, 5, 8, 12, fixed_width=10)


@query("g2_grid_split", sql("px", "s as (select *, (max(y) over (partition by image_id) + 1) // 3 as hs, (max(x) over (partition by image_id) + 1) // 2 as ws from px) select image_id, y // hs as line, x // ws as col, y % hs - 1 as y, x % ws - 2 as x, g from s where y // hs < 3 and x // ws < 2 and y % hs >= 1 and y % hs < hs - 1 and x % ws >= 2 and x % ws < ws - 2"))
def g2(spark, d):
    return r.grid_split(fx.px(spark, d), 3, 2, 1, 2).select("image_id", "line", "col", "y", "x", "g")


@query("g3_slice_tiles", sql("px", "e as (select image_id, max(x) + 1 w, max(y) + 1 h from px group by 1), t as (select image_id, unnest(generate_series(0, h - 8, 6))::int as ty, w from e), tt as (select image_id, ty, unnest(generate_series(0, w - 6, 4))::int as tx from t) select px.image_id, ty as tile_y, tx as tile_x, y - ty as y, x - tx as x, g from px join tt on tt.image_id = px.image_id and y >= ty and y < ty + 8 and x >= tx and x < tx + 6"))
def g3(spark, d):
    return r.slice_tiles(fx.px(spark, d), 6, 8, 4, 6).select("image_id", "tile_y", "tile_x", "y", "x", "g")


ENDS = "w as (select *, max(x) over (partition by image_id) + 1 as ww, max(y) over (partition by image_id) + 1 as hh from px)"


@query("g4_rotate", sql("px", ENDS + " select image_id, 90 as turn, x as y, hh - 1 - y as x, g from w union all select image_id, 270, ww - 1 - x, y, g from w"))
def g4(spark, d):
    px = fx.px(spark, d)
    parts = [r.rotate(px, k).select("image_id", F.lit(k).alias("turn"), "y", "x", "g") for k in (90, 270)]
    return parts[0].unionByName(parts[1])


GAM = "cast(floor(round(255 * pow(g / 255.0::double, 1.0::double / 2), 9)) as int)"


@query("g5_augment", sql("px", ENDS + ", v as (select 'original' as variant, image_id, y, x, g from w union all select 'r180', image_id, hh - 1 - y, ww - 1 - x, g from w union all select 'flip_h', image_id, y, ww - 1 - x, g from w union all select 'flip_v', image_id, hh - 1 - y, x, g from w) select variant, 1.0::double as gamma, image_id, y, x, g from v union all select variant, 2.0, image_id, y, x, " + GAM + " from v"))
def g5(spark, d):
    return r.augment(fx.px(spark, d), ["original", "r180", "flip_h", "flip_v"], [1.0, 2.0]).select("variant", "gamma", "image_id", "y", "x", "g")


@query("g6_copy_with_region", sql("px", "select image_id, 3 as roi_left, 5 as roi_top, 'copy_' || image_id || '.png' as name, count(*) as pixels from px group by 1"))
def g6(spark, d):
    out = fx.px(spark, d).groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"))
    return out.select("image_id", F.lit(3).alias("roi_left"), F.lit(5).alias("roi_top"), F.concat(F.lit("copy_"), F.col("image_id").cast("string"), F.lit(".png")).alias("name"), "pixels")


@query("w5_height_slices", sql("mask", "select image_id, y, ntile(4) over (partition by image_id order by y)::int as slice from (select distinct image_id, y from mask)"))
def w5(spark, d):
    return fx.mask(spark, d).select("image_id", "y").distinct().withColumn("slice", F.ntile(4).over(W.partitionBy("image_id").orderBy("y")))


@query("u4_mask_and", sql("mask", "select image_id, y, x from mask intersect select image_id, y, x from px where r > 128"))
def u4(spark, d):
    return fx.mask(spark, d).intersect(fx.px(spark, d).filter("r > 128").select(*PLACE))


@query("u5_mask_or", sql("mask", "select image_id, y, x from mask union select image_id, y, x from px where r > 128"))
def u5(spark, d):
    return fx.mask(spark, d).union(fx.px(spark, d).filter("r > 128").select(*PLACE)).distinct()


@query("u4_channel_bits", sql("px", "select image_id, y, x, b & g as low, b | g as high from px"))
def u4b(spark, d):
    return fx.px(spark, d).select(*PLACE, F.col("b").bitwiseAND(F.col("g")).alias("low"), F.col("b").bitwiseOR(F.col("g")).alias("high"))


@query("p3_region_limited_ranges", sql("px", f"select image_id, y, x from px where g between 100 and 160 and b between 0 and 130 and {IN[2]}"))
def p3b(spark, d):
    return p.multi_range_mask(fx.px(spark, d), [("g", 100, 160), ("b", 0, 130)]).filter(r.region_column(CIRCLE)).select(*PLACE)


@query("p12_region_gamma", sql("px", f"select image_id, y, x, case when {IN[1]} then {GAM} else g end as g from px"))
def p12d(spark, d):
    px = fx.px(spark, d)
    return px.select(*PLACE, F.when(r.region_column(RECT), p.gamma_lut(F.col("g"), 2.0)).otherwise(F.col("g")).alias("g"))


@query("a13_masked_quantiles", sql("mask", "q as (select image_id, least(3, cast(floor(g * 4 / 255) as int)) as bin, count(*) as n from px where g between 100 and 160 group by 1, 2) select image_id, bin, n, round(100.0 * n / sum(n) over (partition by image_id), 6) as percent from q"))
def a13b(spark, d):
    hist = h.histogram(fx.px(spark, d).filter(F.col("g").between(100, 160)), ["g"], 4)
    return hist.select("image_id", "bin", "n", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy("image_id")), 6).alias("percent"))

"""Regions of interest: membership, keeping and deleting pixels, rectangles, composites, checks.

A region is a row (roi_id, name, tag, shape, left, top, width, height, cx, cy, radius, in_radius, angle); shape is rect,
circle, annulus or rotated (a rectangle turned by angle degrees around its centre). A region table with a column image_id
holds regions of single images, one without it regions of every image.

Pixels and regions meet by an equi-join on the cells of a square grid (and the image). A region is covered by cells: those
that lie wholly within it need no further test, those on its edge leave the exact test to each pixel, others are left out.
Whether the cover is broadcast or shuffled is up to Spark, which sees its size. Rectangles meet in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florascan.operators.pixels import IMAGE

PLACE = [IMAGE, "y", "x"]
SCHEMA = "roi_id int, name string, tag string, shape string, left double, top double, width double, height double, cx double, cy double, radius double, in_radius double, angle double"
#: Side of a cell: a cover has about a row for each so many square places of its region, and for each so many of its edge.
CELL = 32


def rectangle(roi_id: int, name: str, left: float, top: float, width: float, height: float, tag: str = "", angle: float = 0.0) -> tuple:
    return (roi_id, name, tag, "rotated" if angle else "rect", float(left), float(top), float(width), float(height), left + width / 2, top + height / 2, None, None, float(angle))


def circle(roi_id: int, name: str, cx: float, cy: float, radius: float, tag: str = "", in_radius: float | None = None) -> tuple:
    return (roi_id, name, tag, "circle" if in_radius is None else "annulus", float(cx - radius), float(cy - radius), 2.0 * radius, 2.0 * radius, float(cx), float(cy), float(radius), None if in_radius is None else float(in_radius), 0.0)


def regions(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """A region table from rows of the two functions above."""
    return spark.createDataFrame(list(rows), SCHEMA)


def relative_rectangle(roi_id: int, name: str, image_width: int, image_height: int, left: float, top: float, width: float, height: float) -> tuple:
    """A rectangle in percent of the image."""
    return rectangle(roi_id, name, image_width * left / 100, image_height * top / 100, image_width * width / 100, image_height * height / 100)


def case_condition(text: str) -> Column:
    """When a region applies: "key=v1,v2|key=v" over the snapshot's columns; an empty text always applies."""
    out = F.lit(True)
    for part in filter(None, (p.strip() for p in text.split("|"))):
        key, _, values = part.partition("=")
        out = out & F.col(key.strip()).cast("string").isin([v.strip() for v in values.split(",")])
    return out


def inside(x: Column | None = None, y: Column | None = None) -> Column:
    """Whether a point (columns x, y) lies in the region of the same row; right and lower edges are outside."""
    x, y = F.col("x") if x is None else x, F.col("y") if y is None else y
    dx, dy = x - F.col("cx"), y - F.col("cy")
    in_rect = (x >= F.col("left")) & (x < F.col("left") + F.col("width")) & (y >= F.col("top")) & (y < F.col("top") + F.col("height"))
    d2 = dx * dx + dy * dy
    a = F.radians(F.col("angle"))
    u, v = F.round(dx * F.cos(a) + dy * F.sin(a), 9), F.round(dy * F.cos(a) - dx * F.sin(a), 9)
    turned = (F.abs(u) <= F.col("width") / 2) & (F.abs(v) <= F.col("height") / 2)
    in_circle = d2 <= F.col("radius") * F.col("radius")
    return F.when(F.col("shape") == "rect", in_rect).when(F.col("shape") == "circle", in_circle).when(F.col("shape") == "annulus", in_circle & (d2 >= F.col("in_radius") * F.col("in_radius"))).otherwise(turned)


def region_column(row: tuple) -> Column:
    """Membership in one known region as a column of x and y, without a join."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    v = dict(zip(names, row))
    dx, dy = F.col("x") - v["cx"], F.col("y") - v["cy"]
    d2 = dx * dx + dy * dy
    if v["shape"] == "rect":
        return (F.col("x") >= v["left"]) & (F.col("x") < v["left"] + v["width"]) & (F.col("y") >= v["top"]) & (F.col("y") < v["top"] + v["height"])
    if v["shape"] == "circle":
        return d2 <= v["radius"] ** 2
    if v["shape"] == "annulus":
        return (d2 <= v["radius"] ** 2) & (d2 >= v["in_radius"] ** 2)
    a = math.radians(v["angle"])
    u, w = F.round(dx * math.cos(a) + dy * math.sin(a), 9), F.round(dy * math.cos(a) - dx * math.sin(a), 9)
    return (F.abs(u) <= v["width"] / 2) & (F.abs(w) <= v["height"] / 2)


def select_regions(rois: DataFrame, names: Sequence[str] | None = None, tag: str | None = None) -> DataFrame:
    out = rois.filter(F.col("name").isin(list(names))) if names is not None else rois
    return out.filter(F.col("tag") == tag) if tag is not None else out


def cover(rois: DataFrame, cell: int = CELL) -> DataFrame:
    """rois once for each cell (cell_y, cell_x) that it may have places in; within: all of the cell's places are inside."""
    turn = F.radians(F.col("angle"))
    turned = F.col("shape") == "rotated"
    half_w = F.when(turned, F.abs(F.col("width") * F.cos(turn)) / 2 + F.abs(F.col("height") * F.sin(turn)) / 2).otherwise(F.col("width") / 2)
    half_h = F.when(turned, F.abs(F.col("width") * F.sin(turn)) / 2 + F.abs(F.col("height") * F.cos(turn)) / 2).otherwise(F.col("height") / 2)
    mid_x, mid_y = F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2

    def cells(mid: Column, half: Column) -> Column:
        first, last = F.floor((mid - half - 1e-6) / cell).cast("int"), F.floor((mid + half + 1e-6) / cell).cast("int")
        return F.explode(F.when(last >= first, F.sequence(first, last)))

    out = rois.withColumn("cell_y", cells(mid_y, half_h)).withColumn("cell_x", cells(mid_x, half_w))
    low_y, low_x = F.col("cell_y") * cell, F.col("cell_x") * cell
    corners = [inside(low_x + dx, low_y + dy) for dy in (0, cell - 1) for dx in (0, cell - 1)]
    # all shapes but the ring are convex: four corners inside, all places inside; a ring's hole must not reach the cell
    near_x = F.greatest(low_x - F.col("cx"), F.col("cx") - (low_x + cell - 1), F.lit(0.0))
    near_y = F.greatest(low_y - F.col("cy"), F.col("cy") - (low_y + cell - 1), F.lit(0.0))
    near = near_x * near_x + near_y * near_y
    far_x = F.greatest(F.abs(low_x - F.col("cx")), F.abs(low_x + cell - 1 - F.col("cx")))
    far_y = F.greatest(F.abs(low_y - F.col("cy")), F.abs(low_y + cell - 1 - F.col("cy")))
    round_ = F.col("shape").isin("circle", "annulus")
    hole = F.when(F.col("shape") == "annulus", F.col("in_radius")).otherwise(F.lit(0.0))
    possible = ~round_ | ((near <= F.col("radius") * F.col("radius")) & (far_x * far_x + far_y * far_y >= hole * hole))
    within = corners[0] & corners[1] & corners[2] & corners[3] & (~round_ | (near >= hole * hole))
    return out.filter(possible).withColumn("within", F.coalesce(within, F.lit(False)))


def meet(px: DataFrame, rois: DataFrame, how: str, cell: int = CELL) -> DataFrame:
    """px joined with the regions that its places lie in."""
    keys = ["__cy", "__cx"]
    covered = cover(rois, cell).withColumnsRenamed({"cell_y": "__cy", "cell_x": "__cx"})
    if IMAGE in rois.columns:
        keys = [IMAGE, *keys]
    placed = px.withColumns({"__cy": F.floor(F.col("y") / cell).cast("int"), "__cx": F.floor(F.col("x") / cell).cast("int")})
    equal = [placed[k] == covered[k] for k in keys]
    met = F.col("within") | inside(placed["x"], placed["y"])
    joined = placed.join(covered, [*equal, met], how)
    return joined.drop(*[covered[k] for k in keys] if how == "inner" else [], placed["__cy"], placed["__cx"])


def keep_regions(px: DataFrame, rois: DataFrame) -> DataFrame:
    """Pixels that lie in any region."""
    return meet(px, rois, "left_semi")


def delete_regions(px: DataFrame, rois: DataFrame) -> DataFrame:
    return meet(px, rois, "left_anti")


def copy_regions(source: DataFrame, target: DataFrame, rois: DataFrame) -> DataFrame:
    """target with the source's pixels in the regions."""
    return delete_regions(target, rois).unionByName(keep_regions(source, rois))


def _number(rois: DataFrame, alias: str) -> DataFrame:
    """How many regions there are: a row, or one for each image that has its own."""
    return rois.groupBy(*([IMAGE] if IMAGE in rois.columns else [])).agg(F.countDistinct("roi_id").alias(alias))


def compose(px: DataFrame, rois: DataFrame, op: str = "union") -> DataFrame:
    """Pixels in the union or in the intersection of the regions (of their image's, where regions have images)."""
    if op == "union":
        return keep_regions(px, rois)
    members = meet(px.select(*PLACE), rois, "inner").groupBy(*PLACE).agg(F.countDistinct("roi_id").alias("__n"))
    if IMAGE in rois.columns:
        members = members.join(_number(rois, "__all"), IMAGE).filter("__n = __all")
    else:
        members = members.filter(F.col("__n") == _number(rois, "n").first()["n"])
    return px.join(members.select(*PLACE), PLACE, "left_semi")


def _over_cells(rois: DataFrame, cell: int) -> DataFrame:
    """rois once for each cell that its bounds lie in."""
    for at, size, name in (("top", "height", "__cy"), ("left", "width", "__cx")):
        first, last = F.floor(F.col(at) / cell).cast("int"), F.floor((F.col(at) + F.col(size)) / cell).cast("int")
        rois = rois.withColumn(name, F.explode(F.when(last >= first, F.sequence(first, last))))
    return rois


def _pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], cell: int) -> DataFrame:
    """Pairs of rows of a and b with overlapping bounds, within equal keys; columns are renamed to a_ and b_.

    Both sides are listed under the cells of their bounds; a pair counts only in the cell of the upper left corner of what
    the two have in common, so it comes once.
    """

    def side(rois: DataFrame, prefix: str) -> DataFrame:
        named = _over_cells(rois, cell).select(*keys, "__cy", "__cx", F.col("roi_id").alias("__id"), *columns)
        return named.withColumnsRenamed({c: f"{prefix}_{c}" for c in columns} | {"__id": f"{prefix}_id"})

    both = side(a, "a").join(side(b, "b"), [*keys, "__cy", "__cx"])
    here = (F.expr(f"floor(greatest(a_left, b_left) / {cell})") == F.col("__cx")) & (F.expr(f"floor(greatest(a_top, b_top) / {cell})") == F.col("__cy"))
    overlap = F.expr("a_left <= b_left + b_width and b_left <= a_left + a_width and a_top <= b_top + b_height and b_top <= a_top + a_height")
    return both.filter(here & overlap).drop("__cy", "__cx")


BOUNDS = ("left", "top", "width", "height")


def rectangle_relations(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), cell: int = 4 * CELL) -> DataFrame:
    """(keys, a_id, b_id, contains) of all rectangle pairs whose bounds overlap, within equal keys."""
    overlaps = F.expr("a_left < b_left + b_width and b_left < a_left + a_width and a_top < b_top + b_height and b_top < a_top + a_height")
    contains = F.expr("a_left <= b_left and a_top <= b_top and a_left + a_width >= b_left + b_width and a_top + a_height >= b_top + b_height")
    pairs = _pairs(a, b, keys, BOUNDS, cell).filter((F.col("a_id") != F.col("b_id")) & overlaps)
    return pairs.select(*keys, "a_id", "b_id", contains.alias("contains"))


def _touches_contains() -> list[Column]:
    """Whether a rectangle a touches a circle b, by the distance from the centre to it, and whether the whole circle lies in it."""
    dx = F.expr("b_cx - greatest(a_left, least(b_cx, a_left + a_width))")
    dy = F.expr("b_cy - greatest(a_top, least(b_cy, a_top + a_height))")
    contains = F.expr("b_cx - b_radius >= a_left and b_cx + b_radius <= a_left + a_width and b_cy - b_radius >= a_top and b_cy + b_radius <= a_top + a_height")
    return [(dx * dx + dy * dy <= F.col("b_radius") * F.col("b_radius")).alias("touches"), contains.alias("contains")]


def region_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a_id, b_id, touches, contains) of every rectangle a and circle b, within equal keys, those apart, too."""
    left = a.select(*keys, F.col("roi_id").alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in BOUNDS])
    right = b.select(*keys, F.col("roi_id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in ("cx", "cy", "radius")])
    pairs = left.join(right, list(keys)) if keys else left.crossJoin(right)
    return pairs.select(*keys, "a_id", "b_id", *_touches_contains())


def region_relations(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), cell: int = 4 * CELL) -> DataFrame:
    """(keys, a_id, b_id, contains) of the pairs of region_pairs that touch, found over cells."""
    circles = b.withColumns({"left": F.col("cx") - F.col("radius"), "top": F.col("cy") - F.col("radius"), "width": 2 * F.col("radius"), "height": 2 * F.col("radius")})
    centred = [*BOUNDS, "cx", "cy", "radius"]
    pairs = _pairs(a.withColumns({"cx": F.lit(0.0), "cy": F.lit(0.0), "radius": F.lit(0.0)}), circles, keys, centred, cell)
    touches, contains = _touches_contains()
    return pairs.filter(touches).select(*keys, "a_id", "b_id", contains)


def region_hits(objects_px: DataFrame, rois: DataFrame, key: str = "label") -> DataFrame:
    """(image_id, key, roi_id, n): how many pixels of each object lie in each region."""
    return meet(objects_px.select(*PLACE, key), rois, "inner").groupBy(IMAGE, key, "roi_id").agg(F.count(F.lit(1)).alias("n"))


def assert_mask_position(mask: DataFrame, rois: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, passed): every region (of the image, where regions have images) holds at least one pixel of its mask."""
    hits = meet(mask.select(*PLACE), rois, "inner").groupBy(IMAGE).agg(F.countDistinct("roi_id").alias("__hit"))
    out = images.select(IMAGE).distinct().join(hits, IMAGE, "left")
    if IMAGE in rois.columns:
        out = out.join(_number(rois, "__all"), IMAGE, "left").withColumn("__all", F.coalesce("__all", F.lit(0)))
    else:
        out = out.withColumn("__all", F.lit(_number(rois, "n").first()["n"]))
    return out.select(IMAGE, (F.coalesce("__hit", F.lit(0)) == F.col("__all")).alias("passed"))


def check_source(px: DataFrame) -> DataFrame:
    """(image_id, width, height, complete): every place of the bounding rectangle has a pixel."""
    s = px.groupBy(IMAGE).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.count(F.lit(1)).alias("n"))
    return s.select(IMAGE, "width", "height", (F.col("n") == F.col("width") * F.col("height")).alias("complete"))


def roi_features(rois: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    left, top, width, height = (F.col(c) for c in ("left", "top", "width", "height"))
    return rois.select(*keys, "roi_id", "name", left.alias("left"), (left + width).alias("right"), top.alias("top"), (top + height).alias("bottom"), F.col("cx"), F.col("cy"), width.alias("width"), height.alias("height"))


def anchors() -> dict[str, Column]:
    """Anchor points of a region's bounds and what follows from them."""
    left, top, width, height = (F.col(c) for c in ("left", "top", "width", "height"))
    xs, ys = {"left": left, "center": left + width / 2, "right": left + width}, {"top": top, "middle": top + height / 2, "bottom": top + height}
    points = {f"{v}_{h}": F.struct(x.alias("x"), y.alias("y")) for v, y in ys.items() for h, x in xs.items()}
    area = F.when(F.col("shape") == "circle", math.pi * F.col("radius") * F.col("radius")).when(F.col("shape") == "annulus", math.pi * (F.col("radius") * F.col("radius") - F.col("in_radius") * F.col("in_radius"))).otherwise(width * height)
    return points | {"area": area, "aspect_ratio": width / height, "as_circle_radius": F.least(width, height) / 2}


def point_at_angle(cx: Column, cy: Column, radius: Column, degrees: Column) -> tuple[Column, Column]:
    return cx + radius * F.cos(F.radians(degrees)), cy + radius * F.sin(F.radians(degrees))


def rotate_about(x: Column, y: Column, cx: Column, cy: Column, degrees: Column) -> tuple[Column, Column]:
    a = F.radians(degrees)
    return cx + (x - cx) * F.cos(a) - (y - cy) * F.sin(a), cy + (x - cx) * F.sin(a) + (y - cy) * F.cos(a)


def merge_rectangles(a: str, b: str, how: str = "union") -> list[Column]:
    """left, top, right, bottom of the union or the intersection of two rectangles given by column prefixes."""
    l1, t1, r1, b1 = (F.col(f"{a}_{s}") for s in ("left", "top", "right", "bottom"))
    l2, t2, r2, b2 = (F.col(f"{b}_{s}") for s in ("left", "top", "right", "bottom"))
    low, high = (F.least, F.greatest) if how == "union" else (F.greatest, F.least)
    return [low(l1, l2).alias("left"), low(t1, t2).alias("top"), high(r1, r2).alias("right"), high(b1, b2).alias("bottom")]


def inflate(rois: DataFrame, dx: float, dy: float) -> DataFrame:
    return rois.withColumns({"left": F.col("left") - dx, "top": F.col("top") - dy, "width": F.col("width") + 2 * dx, "height": F.col("height") + 2 * dy})


# --- image generators ------------------------------------------------------------------------------------------------


def crop(px: DataFrame, left: int, top: int, width: int, height: int, fixed_width: int = 0, fixed_height: int = 0) -> DataFrame:
    """Pixels of a rectangle with places counted from its corner; a fixed size grows it evenly on both sides."""
    if fixed_width:
        left, width = left - (fixed_width - width) // 2, fixed_width
    if fixed_height:
        top, height = top - (fixed_height - height) // 2, fixed_height
    inside_ = F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1)
    return px.filter(inside_).withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def _ends(px: DataFrame) -> DataFrame:
    return px.join(px.groupBy(IMAGE).agg((F.max("x") + 1).alias("__w"), (F.max("y") + 1).alias("__h")), IMAGE)


def grid_split(px: DataFrame, rows: int, cols: int, pad_v: int = 0, pad_h: int = 0) -> DataFrame:
    """px cut into rows by cols tiles, with the tile's number, its padding taken off and places counted within it."""
    df = _ends(px).withColumns({"__hs": F.expr(f"__h div {rows}"), "__ws": F.expr(f"__w div {cols}")})
    df = df.withColumns({"line": F.expr("cast(y div __hs as int)"), "col": F.expr("cast(x div __ws as int)"), "__v": F.expr("cast(y % __hs as int)"), "__u": F.expr("cast(x % __ws as int)")})
    kept = (F.col("line") < rows) & (F.col("col") < cols) & (F.col("__v") >= pad_v) & (F.col("__v") < F.col("__hs") - pad_v) & (F.col("__u") >= pad_h) & (F.col("__u") < F.col("__ws") - pad_h)
    df = df.filter(kept).withColumns({"y": F.col("__v") - pad_v, "x": F.col("__u") - pad_h, "name": F.concat_ws("-", F.lit("t"), F.col("line").cast("string"), F.col("col").cast("string"), F.lit(f"{pad_v}"))})
    return df.drop("__w", "__h", "__hs", "__ws", "__u", "__v")


def slice_tiles(px: DataFrame, width: int = 256, height: int = 256, step_x: int = 256, step_y: int = 256) -> DataFrame:
    """px in every whole tile that holds it: (tile_y, tile_x) and places counted within; tiles that stick out are left out."""

    def tops(at: str, size: int, step: int, end: str) -> Column:
        first = F.greatest(F.lit(0), F.ceil((F.col(at) - size + 1) / step).cast("int"))
        last = F.floor(F.least(F.col(at), F.col(end) - size) / step).cast("int")
        return F.when(last >= first, F.transform(F.sequence(first, last), lambda k: k * step)).otherwise(F.array().cast("array<int>"))

    df = _ends(px)
    df = df.withColumn("tile_y", F.explode(tops("y", height, step_y, "__h"))).withColumn("tile_x", F.explode(tops("x", width, step_x, "__w")))
    return df.withColumns({"y": F.col("y") - F.col("tile_y"), "x": F.col("x") - F.col("tile_x")}).drop("__w", "__h")


def _turned(degrees: int) -> dict[str, Column]:
    """New places after a clockwise turn, in terms of __w and __h."""
    y, x, w, h = (F.col(c) for c in ("y", "x", "__w", "__h"))
    return {0: {"y": y, "x": x}, 90: {"y": x, "x": h - 1 - y}, 180: {"y": h - 1 - y, "x": w - 1 - x}, 270: {"y": w - 1 - x, "x": y}}[degrees]


def rotate(px: DataFrame, degrees: int) -> DataFrame:
    return _ends(px).withColumns(_turned(degrees)).drop("__w", "__h")


VARIANTS = ("original", "r90", "r180", "r270", "flip_h", "flip_v")


def augment(px: DataFrame, variants: Sequence[str] = VARIANTS, gammas: Sequence[float] = (1.0,)) -> DataFrame:
    """Every variant at every gamma: px with variant, gamma and new places and channels."""
    from florascan.operators.pixels import gamma_lut

    rows = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(float(g)).alias("gamma")) for v in variants for g in gammas])
    df = _ends(px).withColumn("__o", F.explode(rows)).select("*", "__o.variant", "__o.gamma").drop("__o")
    y, x = F.col("y"), F.col("x")
    for name, deg in (("r90", 90), ("r180", 180), ("r270", 270)):
        y, x = F.when(F.col("variant") == name, _turned(deg)["y"]).otherwise(y), F.when(F.col("variant") == name, _turned(deg)["x"]).otherwise(x)
    x = F.when(F.col("variant") == "flip_h", F.col("__w") - 1 - F.col("x")).otherwise(x)
    y = F.when(F.col("variant") == "flip_v", F.col("__h") - 1 - F.col("y")).otherwise(y)
    lifted = {}
    for c in "bgr":
        made = F.col(c)
        for g in gammas:
            if g != 1.0:
                made = F.when(F.col("gamma") == float(g), gamma_lut(F.col(c), g)).otherwise(made)
        lifted[c] = made
    return df.withColumns({"y": y, "x": x} | lifted).drop("__w", "__h")

"""Objects of a mask: runs, scanlines, connected objects, and what is measured or kept of them.

Objects are connected over runs of pixels, which are few, not over pixels. Within bands of ``BAND_ROWS`` rows, a task each,
runs that overlap are found by binary search and joined; objects that cross from band to band are connected by shuffles over
the runs at the bands' borders. ``label_objects`` with method="star" connects all runs by shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from florascan.operators.gaps import linked_groups, object_distances
from florascan.operators.graph import components, joined
from florascan.operators.neighbourhood import dilate
from florascan.operators.pixels import IMAGE
from florascan.sources.storage import stored

PLACE = [IMAGE, "y", "x"]
BAND_ROWS = 1024


def scanlines(mask: DataFrame) -> DataFrame:
    """(image_id, y, first, last, span, count, solidity)."""
    lines = mask.groupBy(IMAGE, "y").agg(F.min("x").alias("first"), F.max("x").alias("last"), F.count(F.lit(1)).alias("count"))
    span = F.col("last") - F.col("first") + 1
    return lines.withColumns({"span": span, "solidity": F.col("count") / span})


def scanline_relation(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, y, n_and, n_or, inside): how the rows of two masks overlap; inside: all of a lies in b."""
    both = a.select(*PLACE, F.lit(1).alias("__a")).join(b.select(*PLACE, F.lit(1).alias("__b")), PLACE, "full")
    return both.groupBy(IMAGE, "y").agg(F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("n_and"), F.count(F.lit(1)).alias("n_or"), F.bool_and(F.col("__a").isNull() | F.col("__b").isNotNull()).alias("inside"))


def width_stats(mask: DataFrame, n: int = 1) -> DataFrame:
    """(image_id, slice, area, hull, solidity, min_width, max_width, avg_width, std_width) of n slices of the height.

    Rows without pixels between the top and the bottom count with width zero.
    """
    lines = scanlines(mask).select(IMAGE, "y", "span", "count")
    ends = lines.groupBy(IMAGE).agg(F.min("y").alias("top"), F.max("y").alias("bottom"))
    rows = ends.select(IMAGE, F.explode(F.sequence("top", "bottom")).alias("y")).join(lines, [IMAGE, "y"], "left").fillna(0, ["span", "count"])
    rows = rows.withColumn("slice", F.ntile(n).over(W.partitionBy(IMAGE).orderBy("y")))
    out = rows.groupBy(IMAGE, "slice").agg(F.sum("count").alias("area"), F.sum("span").alias("hull"), F.min("span").alias("min_width"), F.max("span").alias("max_width"), F.avg("span").alias("avg_width"), F.stddev_pop("span").alias("std_width"))
    return out.withColumn("solidity", F.when(F.col("hull") > 0, F.col("area") / F.col("hull")).otherwise(0.0))


def wide_width_stats(mask: DataFrame, n: int = 1) -> DataFrame:
    """One row for each image: width_stats as columns quantile_width_{slice}_{n}_{name}."""
    names = ("area", "hull", "solidity", "min_width", "max_width", "avg_width", "std_width")
    return width_stats(mask, n).groupBy(IMAGE).agg(*[F.max(F.when(F.col("slice") == k, F.col(c))).alias(f"quantile_width_{k}_{n}_{c}") for k in range(1, n + 1) for c in names])


def runs(mask: DataFrame) -> DataFrame:
    """(image_id, y, left, right, n): horizontal runs."""
    island = F.col("x") - F.row_number().over(W.partitionBy(IMAGE, "y").orderBy("x"))
    return mask.withColumn("__k", island).groupBy(IMAGE, "y", "__k").agg(F.min("x").alias("left"), F.max("x").alias("right"), F.count(F.lit(1)).alias("n")).drop("__k")


def isolated_runs(mask: DataFrame, min_length: int = 1) -> DataFrame:
    """Runs of at least min_length that touch no run in the rows beside theirs."""
    own = runs(mask)
    near = own.select(IMAGE, F.explode(F.array(F.col("y") - 1, F.col("y") + 1)).alias("y"), F.col("left").alias("l"), F.col("right").alias("r"))
    touching = own.join(near, [IMAGE, "y"]).filter((F.col("l") <= F.col("right")) & (F.col("r") >= F.col("left"))).select(IMAGE, "y", "left").distinct()
    return own.filter(F.col("n") >= min_length).join(touching, [IMAGE, "y", "left"], "left_anti")


def clean_horizontal_noise(mask: DataFrame, min_length: int = 1, rounds: int | None = None) -> DataFrame:
    """mask without isolated runs; taking some away can isolate others, so it is repeated: rounds times, or until none is left.

    Each round is written, so that its plan does not hold those before it.
    """
    out, done = mask.select(*PLACE), 0
    while rounds is None or done < rounds:
        noise = isolated_runs(out, min_length).select(IMAGE, "y", F.explode(F.sequence("left", "right")).alias("x"))
        if rounds == 1:
            return out.join(noise, PLACE, "left_anti")
        noise = stored(noise, "noise")
        if noise.isEmpty():
            break
        out, done = stored(out.join(noise, PLACE, "left_anti"), "cleaned"), done + 1
    return out


def repair_full_rows(mask: DataFrame, px: DataFrame, margin: int = 4, solidity: float = 0.99) -> DataFrame:
    """mask with each row that noise fills from side to side replaced by what its nearest other rows above and below hold.

    A row is full if it spans the image's width but for margin and has hardly a gap. Only rows, not pixels, are ordered.
    """
    width = px.groupBy(IMAGE).agg((F.max("x") - F.min("x") + 1).alias("width"))
    full = (F.col("span") >= F.col("width") - margin) & (F.col("solidity") >= solidity)
    rows = px.select(IMAGE, "y").distinct().join(scanlines(mask), [IMAGE, "y"], "left").join(width, IMAGE).select(IMAGE, "y", F.coalesce(full, F.lit(False)).alias("full"))
    other = F.when(~F.col("full"), F.col("y"))
    before = lambda order: F.last(other, True).over(W.partitionBy(IMAGE).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    filled = rows.withColumns({"up": before(F.col("y")), "down": before(F.desc("y"))}).filter("full")
    ask = filled.select(IMAGE, F.col("y").alias("__to"), F.explode(F.array("up", "down")).alias("y"))
    borrowed = mask.select(*PLACE).join(ask, [IMAGE, "y"]).select(IMAGE, F.col("__to").alias("y"), "x").distinct()
    return mask.select(*PLACE).join(filled, [IMAGE, "y"], "left_anti").unionByName(borrowed)


def _union_runs(reach: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def label(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["y", "left"], kind="stable").reset_index(drop=True)
        y, left, right = (part[c].to_numpy(dtype=np.int64) for c in ("y", "left", "right"))
        if not len(part):
            return part.assign(root_y=y, root_x=left)
        # runs of the row above that overlap a run follow each other: the first by its end, the last by its beginning
        low = left.min() - 1
        span = right.max() - low + 3
        above = (y - 1) * span - low
        first = np.searchsorted(y * span - low + right, above + left - reach)
        after = np.searchsorted(y * span - low + left, above + right + reach, side="right")
        number = np.maximum(after - first, 0)
        own = np.repeat(np.arange(len(part)), number)
        other = np.repeat(first - np.cumsum(number) + number, number) + np.arange(number.sum())
        root = joined(len(part), own, other)
        return part.assign(root_y=y[root], root_x=left[root])

    return label


def _node(y: str, x: str) -> Column:
    return F.concat_ws("|", F.col(IMAGE).cast("string"), F.lpad(F.col(y).cast("string"), 9, "0"), F.lpad(F.col(x).cast("string"), 9, "0"))


def _banded(own: DataFrame, reach: int, band_rows: int) -> DataFrame:
    """Runs joined within bands, and the objects of bands where runs meet over a border."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    local = own.withColumn("band", F.floor(F.col("y") / band_rows)).groupBy(IMAGE, "band").applyInPandas(_union_runs(reach), f"{fields}, band long, root_y int, root_x int")
    local = stored(local.drop("band"), "object-bands")
    below = local.filter(F.pmod("y", F.lit(band_rows)) == 0).select(IMAGE, "y", F.col("left").alias("l"), F.col("right").alias("r"), F.col("root_y").alias("ry"), F.col("root_x").alias("rx"))
    above = local.filter(F.pmod("y", F.lit(band_rows)) == band_rows - 1).withColumn("y", F.col("y") + 1)
    met = above.join(below, [IMAGE, "y"]).filter((F.col("l") <= F.col("right") + reach) & (F.col("r") >= F.col("left") - reach))
    roots = components(met.select(_node("root_y", "root_x").alias("a"), _node("ry", "rx").alias("b")).distinct())
    return local.withColumn("__node", _node("root_y", "root_x")).join(roots, F.col("__node") == F.col("node"), "left").withColumn("__root", F.coalesce("root", "__node"))


def label_runs(mask: DataFrame, connectivity: int = 8, method: str = "union", band_rows: int = BAND_ROWS) -> DataFrame:
    """(image_id, y, left, right, label): labels count from 1 in reading order within each image."""
    own = runs(mask).drop("n")
    reach = 1 if connectivity == 8 else 0
    if method == "union":
        named = _banded(own, reach, band_rows)
    else:
        down = own.select(IMAGE, (F.col("y") + 1).alias("y"), F.col("left").alias("l"), F.col("right").alias("r"), F.col("y").alias("up"))
        met = own.join(down, [IMAGE, "y"]).filter((F.col("l") <= F.col("right") + reach) & (F.col("r") >= F.col("left") - reach))
        roots = components(met.select(_node("y", "left").alias("a"), _node("up", "l").alias("b")))
        named = own.withColumn("__node", _node("y", "left")).join(roots, F.col("__node") == F.col("node"), "left").withColumn("__root", F.coalesce("root", "__node"))
    numbers = named.select(IMAGE, "__root").distinct().withColumn("label", F.dense_rank().over(W.partitionBy(IMAGE).orderBy("__root")).cast("int"))
    return named.join(numbers, [IMAGE, "__root"]).select(IMAGE, "y", "left", "right", "label")


def label_objects(mask: DataFrame, connectivity: int = 8, method: str = "union", band_rows: int = BAND_ROWS) -> DataFrame:
    """(image_id, y, x, label)."""
    return label_runs(mask, connectivity, method, band_rows).select(IMAGE, "y", F.explode(F.sequence("left", "right")).alias("x"), "label")


def object_list(labels: DataFrame) -> DataFrame:
    """(image_id, label, area, x, y, w, h)."""
    return labels.groupBy(IMAGE, "label").agg(F.count(F.lit(1)).alias("area"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))


def largest_object(labels: DataFrame, anchor: tuple[float, float] | None = None) -> DataFrame:
    """(image_id, label): the greatest area, or area (1 - d / dmax)^2 by the centre's distance from an anchor (y, x)."""
    o = labels.groupBy(IMAGE, "label").agg(F.count(F.lit(1)).cast("double").alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    score = F.col("area")
    if anchor:
        d = F.sqrt((F.col("cy") - anchor[0]) * (F.col("cy") - anchor[0]) + (F.col("cx") - anchor[1]) * (F.col("cx") - anchor[1]))
        o = o.withColumn("d", d).withColumn("dmax", F.max("d").over(W.partitionBy(IMAGE)))
        closeness = F.when(F.col("dmax") > 0, 1 - F.col("d") / F.col("dmax")).otherwise(1.0)
        score = score * closeness * closeness
    return o.groupBy(IMAGE).agg(F.min_by("label", F.struct((-F.round(score, 6)).alias("s"), F.col("label"))).alias("label"))


def filter_by_size(labels: DataFrame, low: int = 0, high: int = 100_000_000, inside: Column | None = None) -> DataFrame:
    """Pixels of objects with low < area < high; with a region, only objects that lie partly in it are judged."""
    size = labels.groupBy(IMAGE, "label").agg(F.count(F.lit(1)).alias("__n"), (F.count_if(inside) if inside is not None else F.count(F.lit(1))).alias("__in"))
    good = size.filter(((F.col("__n") > low) & (F.col("__n") < high)) | (F.col("__in") == 0))
    return labels.join(good.select(IMAGE, "label"), [IMAGE, "label"], "left_semi").select(*PLACE)


def holes(mask: DataFrame, px: DataFrame) -> DataFrame:
    """(image_id, y, x, label) of background objects (4-connected) that do not touch the image's border."""
    back = px.select(*PLACE).join(mask.select(*PLACE), PLACE, "left_anti")
    ends = px.groupBy(IMAGE).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    labels = label_objects(back, 4)
    on_border = (F.col("y") == F.col("y0")) | (F.col("y") == F.col("y1")) | (F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1"))
    outer = labels.join(ends, IMAGE).filter(on_border).select(IMAGE, "label").distinct()
    return labels.join(outer, [IMAGE, "label"], "left_anti").select(*PLACE, "label")


def fill_holes(mask: DataFrame, px: DataFrame, inside: Column | None = None) -> DataFrame:
    """mask with its holes; with a region, the holes of the part of the mask that lies in it."""
    own = mask.select(*PLACE)
    if inside is None:
        return own.unionByName(holes(mask, px).select(*PLACE))
    return own.unionByName(holes(own.filter(inside), px).select(*PLACE)).distinct()


def count_holes(mask: DataFrame, px: DataFrame, inside: Column | None = None) -> DataFrame:
    """(image_id, holes, hole_pixels) of every image."""
    found = holes(mask.filter(inside) if inside is not None else mask, px).groupBy(IMAGE).agg(F.count_distinct("label").alias("holes"), F.count(F.lit(1)).alias("hole_pixels"))
    return px.select(IMAGE).distinct().join(found, IMAGE, "left").fillna(0, ["holes", "hole_pixels"])


def boundary(labels: DataFrame) -> DataFrame:
    """Pixels of a mask or of labelled objects that lack one of their four neighbours."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    beside = labels.select(IMAGE, "y", "x", F.explode(steps).alias("o")).select(IMAGE, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    full = beside.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("__n")).filter("__n = 4").select(*PLACE)
    return labels.join(full, PLACE, "left_anti")


def reachable(labels: DataFrame, tolerance: float, roots: DataFrame) -> DataFrame:
    """(image_id, label) of the objects that chains of gaps below the tolerance connect with a root, itself included."""
    groups = stored(linked_groups(labels, tolerance), "gap-groups")
    wanted = groups.join(roots.select(IMAGE, "label").distinct(), [IMAGE, "label"]).select("group").distinct()
    return groups.join(wanted, "group", "left_semi").select(IMAGE, "label")


def keep_linked(mask: DataFrame, tolerance: int = 100, min_area: int = 0, anchor: tuple[float, float] | None = None, override: int | None = None, safe: Column | None = None, drop_below: int = 0) -> DataFrame:
    """The largest object, and all that chains of gaps below tolerance lead to over objects of at least min_area pixels.

    Objects below drop_below pixels go first. Those above override pixels stay at any distance, if they have a pixel in the
    safe region where there is one, and chains start from them, too.
    """
    labels = stored(label_objects(mask), "labels")
    objects = object_list(labels)
    if drop_below:
        objects = objects.filter(F.col("area") >= drop_below)
        labels = labels.join(objects.select(IMAGE, "label"), [IMAGE, "label"], "left_semi")
    roots = largest_object(labels, anchor).select(IMAGE, "label")
    if override is not None:
        trusted = objects.filter(F.col("area") > override).select(IMAGE, "label")
        if safe is not None:
            trusted = trusted.join(labels.filter(safe), [IMAGE, "label"], "left_semi")
        roots = roots.unionByName(trusted).distinct()
    big = objects.filter(F.col("area") >= min_area).select(IMAGE, "label").unionByName(roots).distinct()
    kept = reachable(labels.join(big, [IMAGE, "label"], "left_semi"), tolerance, roots)
    return labels.join(kept, [IMAGE, "label"], "left_semi").select(*PLACE)


def keep_biggest(mask: DataFrame, anchor: tuple[float, float] | None = None, reach: int = 1) -> DataFrame:
    """The largest object and all that overlaps its bounding box, grown by reach."""
    labels = stored(label_objects(mask), "labels")
    objects = object_list(labels)
    root = objects.join(largest_object(labels, anchor), [IMAGE, "label"]).select(IMAGE, F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("w").alias("rw"), F.col("h").alias("rh"))
    touch = (F.col("x") < F.col("rx") + F.col("rw") + reach) & (F.col("x") + F.col("w") > F.col("rx") - reach) & (F.col("y") < F.col("ry") + F.col("rh") + reach) & (F.col("y") + F.col("h") > F.col("ry") - reach)
    kept = objects.join(root, IMAGE).filter(touch).select(IMAGE, "label")
    return labels.join(kept, [IMAGE, "label"], "left_semi").select(*PLACE)


def keep_near_regions(mask: DataFrame, inside: Column, tolerance: int = 100, min_size: int = 0) -> DataFrame:
    """Objects with a pixel inside the region, and larger ones that chains of gaps below tolerance connect with these."""
    labels = stored(label_objects(mask), "labels")
    roots = labels.filter(inside).select(IMAGE, "label").distinct()
    objects = object_list(labels)
    judged = objects.filter(F.col("area") >= min_size).select(IMAGE, "label").unionByName(roots).distinct()
    kept = reachable(labels.join(judged, [IMAGE, "label"], "left_semi"), tolerance, roots)
    return labels.join(kept, [IMAGE, "label"], "left_semi").select(*PLACE)


def region_classes(labels: DataFrame, region: DataFrame, min_root: int = 0, small_distance: int = 100, unknown_distance: int = 100, root_distance: int = 100) -> DataFrame:
    """(image_id, label, kind, plant, kept): how objects relate to a region, given as pixels.

    Objects with a pixel in it are roots above min_root pixels, else small; the others are unknown. Small ones are kept that
    chains of gaps below small_distance lead to from a root, then unknown ones by unknown_distance from all kept so far.
    plant: the least label of the roots that gaps below root_distance join; null for the others.
    """
    touched = labels.join(region.select(*PLACE), PLACE, "left_semi").select(IMAGE, "label").distinct().withColumn("__in", F.lit(True))
    kind = F.when(F.col("__in") & (F.col("area") > min_root), "root").when(F.col("__in"), "small").otherwise("unknown")
    objects = stored(object_list(labels).join(touched, [IMAGE, "label"], "left").select(IMAGE, "label", kind.alias("kind")), "classes")

    def kinds(*names: str) -> DataFrame:
        return objects.filter(F.col("kind").isin(*names)).select(IMAGE, "label")

    def pixels(part: DataFrame) -> DataFrame:
        return labels.join(part, [IMAGE, "label"], "left_semi")

    first = stored(reachable(pixels(kinds("root", "small")), small_distance, kinds("root")), "kept")
    second = first.unionByName(kinds("unknown"))
    kept = reachable(pixels(second), unknown_distance, first).withColumn("kept", F.lit(True))
    plants = linked_groups(pixels(kinds("root")), root_distance).withColumn("plant", F.min("label").over(W.partitionBy("group"))).select(IMAGE, "label", "plant")
    out = objects.join(plants, [IMAGE, "label"], "left").join(kept, [IMAGE, "label"], "left")
    return out.select(IMAGE, "label", "kind", "plant", F.coalesce("kept", F.lit(False)).alias("kept"))


def keep_region_classes(mask: DataFrame, px: DataFrame, inside: Column, dilation: int = 0, drop_below: int = 0, **tolerances: int) -> DataFrame:
    """Pixels of the objects that ``region_classes`` keeps; the region grows by dilation, objects below drop_below go first."""
    labels = stored(label_objects(mask), "labels")
    if drop_below:
        labels = labels.join(object_list(labels).filter(F.col("area") >= drop_below), [IMAGE, "label"], "left_semi")
    region = px.filter(inside).select(*PLACE)
    if dilation:
        region = dilate(region, px, max(dilation, 3))
    kept = region_classes(labels, region, **tolerances).filter("kept")
    return labels.join(kept, [IMAGE, "label"], "left_semi").select(*PLACE)


def hysteresis(weak: DataFrame, strong: DataFrame) -> DataFrame:
    """Pixels of weak whose object holds a pixel of strong."""
    labels = label_objects(weak)
    seeds = labels.join(strong.select(*PLACE), PLACE, "left_semi").select(IMAGE, "label").distinct()
    return labels.join(seeds, [IMAGE, "label"], "left_semi").select(*PLACE)


# --- features --------------------------------------------------------------------------------------------------------


def shape_features(mask: DataFrame) -> DataFrame:
    """(image_id, area, centroid_x, centroid_y, left, top, width, height, extent)."""
    s = mask.groupBy(IMAGE).agg(F.count(F.lit(1)).alias("area"), F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"), F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))
    return s.withColumn("extent", F.col("area") / (F.col("width") * F.col("height")))


def perimeter(mask: DataFrame) -> DataFrame:
    return boundary(mask.select(*PLACE)).groupBy(IMAGE).agg(F.count(F.lit(1)).alias("perimeter"))


def bound_features(mask: DataFrame, line: int) -> DataFrame:
    """Height, area and percent of the area above (y < line) and below a horizontal line."""
    above, y = F.col("y") < line, F.col("y")
    n = F.count(F.lit(1))
    return mask.groupBy(IMAGE).agg(
        (F.max("y") - F.min("y") + 1).alias("total_height"), F.coalesce(F.lit(line) - F.min(F.when(above, y)), F.lit(0)).alias("above_bound_height"), F.coalesce(F.max(F.when(~above, y)) - line + 1, F.lit(0)).alias("below_bound_height"),
        F.count_if(above).alias("above_bound_area"), F.count_if(~above).alias("below_bound_area"), (100 * F.count_if(above) / n).alias("above_bound_percent_area"), (100 * F.count_if(~above) / n).alias("below_bound_percent_area"),
    )


def hull_features(mask: DataFrame) -> DataFrame:
    """(image_id, hull_area, solidity, rect_width, rect_height, rect_angle, circle_x, circle_y, circle_radius).

    A row's two outermost pixels are all that a hull can need; bands of rows keep those on the hull of the band, so that
    the last step has few.
    """
    outer = mask.groupBy(IMAGE, "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count(F.lit(1)).alias("n"))
    kinds = dict(outer.dtypes)
    bands = outer.groupBy(IMAGE, F.floor(F.col("y") / BAND_ROWS).alias("band")).applyInPandas(_band_hull, f"{IMAGE} {kinds[IMAGE]}, y long, x0 long, x1 long, n long")
    return bands.groupBy(IMAGE).applyInPandas(_hull, f"{IMAGE} int, hull_area double, solidity double, rect_width double, rect_height double, rect_angle double, circle_x double, circle_y double, circle_radius double")


def _hull_points(part: pd.DataFrame) -> list[tuple[float, float]]:
    points = sorted({(float(x), float(y)) for y, a, b in zip(part["y"], part["x0"], part["x1"]) for x in (a, b)})

    def half(ps: Sequence) -> list:
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1] if len(out) > 1 else out

    return half(points) + half(points[::-1]) if len(points) > 1 else points


def _band_hull(part: pd.DataFrame) -> pd.DataFrame:
    """The hull points of a band as rows of one pixel; the first row counts all of the band's pixels."""
    points = _hull_points(part)
    counts = [int(part["n"].sum())] + [0] * (len(points) - 1)
    return pd.DataFrame({IMAGE: part[IMAGE].iloc[0], "y": [int(y) for _, y in points], "x0": [int(x) for x, _ in points], "x1": [int(x) for x, _ in points], "n": counts})


def _hull(part: pd.DataFrame) -> pd.DataFrame:
    import numpy as np

    hull = np.array(_hull_points(part))
    nxt = np.roll(hull, -1, axis=0)
    area = abs((hull[:, 0] * nxt[:, 1] - nxt[:, 0] * hull[:, 1]).sum()) / 2
    edges = nxt - hull
    angles = np.unique(np.round(np.arctan2(edges[:, 1], edges[:, 0]) % (np.pi / 2), 9))
    best = min(((*np.ptp(hull @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]), axis=0), a) for a in angles), key=lambda s: (round(s[0] * s[1], 6), s[2]))
    centre, radius = _enclosing([tuple(p) for p in hull])
    pixels = float(part["n"].sum())
    return pd.DataFrame([{IMAGE: part[IMAGE].iloc[0], "hull_area": area, "solidity": pixels / area if area else 1.0, "rect_width": best[0], "rect_height": best[1], "rect_angle": float(np.degrees(best[2])), "circle_x": centre[0], "circle_y": centre[1], "circle_radius": radius}])


def _enclosing(points: list[tuple[float, float]]) -> tuple[tuple[float, float], float]:
    """Smallest circle around hull points, grown point by point."""

    def through(*ps):
        if len(ps) == 2:
            (ax, ay), (bx, by) = ps
            return ((ax + bx) / 2, (ay + by) / 2), ((ax - bx) ** 2 + (ay - by) ** 2) ** 0.5 / 2
        (ax, ay), (bx, by), (cx, cy) = ps
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if abs(d) < 1e-12:
            return max((through(p, q) for p, q in ((ps[0], ps[1]), (ps[0], ps[2]), (ps[1], ps[2]))), key=lambda c: c[1])
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        ux, uy = (a2 * (by - cy) + b2 * (cy - ay) + c2 * (ay - by)) / d, (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / d
        return (ux, uy), ((ax - ux) ** 2 + (ay - uy) ** 2) ** 0.5

    def outside(p, c):
        return ((p[0] - c[0][0]) ** 2 + (p[1] - c[0][1]) ** 2) ** 0.5 > c[1] + 1e-9

    circle = (points[0], 0.0)
    for i, p in enumerate(points):
        if outside(p, circle):
            circle = (p, 0.0)
            for j, q in enumerate(points[:i]):
                if outside(q, circle):
                    circle = through(p, q)
                    for s in points[:j]:
                        if outside(s, circle):
                            circle = through(p, q, s)
    return circle


def quality_report(mask: DataFrame, width: int, height: int, noise_rows: DataFrame, bottom_gap: int = 60, guide: DataFrame | None = None, tops: DataFrame | None = None) -> DataFrame:
    """(image_id, plant_bottom_error, leaning_error, noise_error, guide_error, plant_top_error, error_level) of light-barrier scans.

    noise_rows: (image_id, y) of rows that were cleaned; guide: pixels of the plant's guide; tops: (image_id, expected_top,
    plant_top, final_top), estimates of the plant's top row. The level is the greatest error, and from 2 on one more for
    each further error of 2 or more.
    """
    lines = scanlines(mask)
    first = F.min_by(F.struct("first", "last", "span"), F.col("y"))
    s = lines.groupBy(IMAGE).agg(F.min("y").alias("top"), F.max("y").alias("bottom"), first.alias("line"))
    hits = noise_rows.join(s.select(IMAGE, "top", "bottom"), IMAGE).groupBy(IMAGE).agg(F.count_if(F.col("y").between(F.col("top"), F.col("bottom"))).alias("hit"), F.count(F.lit(1)).alias("noise"))
    j = s.join(hits, IMAGE, "left").fillna(0, ["hit", "noise"])
    guide_error, top_error = F.lit(0), F.lit(0)
    if guide is not None:
        j = j.join(scanlines(guide).groupBy(IMAGE).agg(F.avg("span").alias("guide_span"), (F.sum("span") / F.sum("count")).alias("guide_solidity")), IMAGE, "left")
        guide_error = F.when(F.col("guide_span") > 6, 1).otherwise(0) + F.when(F.col("guide_solidity") > 1.1, 1).otherwise(0)
    if tops is not None:
        j = j.join(tops.select(IMAGE, "expected_top", "plant_top", "final_top"), IMAGE, "left")
        off = [F.when((F.col("expected_top") != 0) & (F.abs(F.col(c) - F.col("expected_top")) > 30), 2).otherwise(0) for c in ("plant_top", "final_top")]
        top_error = off[0] + off[1]
    bottom = F.when(F.col("bottom") < height - bottom_gap, 3).otherwise(0)
    leaning = F.when((F.col("line.first") <= 10) & (F.col("line.span") < width / 3), 2).when((F.col("line.last") >= width - 10) & (F.col("line.span") < height / 3), 2).otherwise(0)
    ratio = (F.col("bottom") - F.col("top")) / F.greatest(F.col("hit"), F.lit(1))
    noise = F.when(F.col("noise") == 0, 0).when(F.col("hit") == 0, 1).otherwise(F.when(ratio > 100, 1).when(ratio > 40, 2).otherwise(3) + F.when(F.col("noise") > F.col("hit"), 1).otherwise(0))
    j = j.select(IMAGE, bottom.alias("plant_bottom_error"), leaning.alias("leaning_error"), noise.alias("noise_error"), guide_error.alias("guide_error"), top_error.alias("plant_top_error"))
    kinds = [F.col(c) for c in ("plant_bottom_error", "leaning_error", "noise_error", "guide_error", "plant_top_error")]
    grave = sum((F.when(k >= 2, 1).otherwise(0) for k in kinds), F.lit(0))
    return j.withColumn("error_level", F.greatest(*kinds) + F.greatest(grave - 1, F.lit(0)))

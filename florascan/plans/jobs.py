"""Whole jobs: feature extraction over a selection, assertions, resuming, grid search."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from florascan.functions.names import option_values
from florascan.operators import catalogue, histogram, neighbourhood, objects, pixels
from florascan.operators.pixels import IMAGE
from florascan.plans import fixtures as fx
from florascan.plans.fixtures import sql
from florascan.plans.registry import query

#: Of the grid search: tasks that the combinations are dealt to, each with every image's cumulative counts.
GRID_BLOCKS = 64


def analyse(mask_px: DataFrame, features: Sequence[str] = ("shape", "colour", "chlorophyll")) -> DataFrame:
    """One wide row for each image: the chosen groups of features of its masked pixels."""
    made: dict[str, Callable[[], DataFrame]] = {
        "shape": lambda: objects.shape_features(mask_px),
        "colour": lambda: mask_px.groupBy(IMAGE).agg(*[f(c).alias(f"rgb_{c}_{n}") for c in "bgr" for n, f in (("mean", F.avg), ("std_dev", F.stddev_pop))]),
        "chlorophyll": lambda: histogram.chlorophyll_stats(mask_px),
        "width": lambda: objects.wide_width_stats(mask_px, 1),
    }
    out = made[features[0]]()
    for name in features[1:]:
        out = out.join(made[name](), IMAGE)
    return out


def captured(px: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """(image_id, schema, error, seconds): a step in Python on each image's pixels, whose failure is a row, not the job's end.

    A failed image has one row with null results, the error's kind and text, and the time that it took. The step sees an
    image as a whole, so images have to fit in a task; steps on blocks (``blocks``) need no such bound.
    """
    kinds = StructType.fromDDL(schema)
    whole = StructType([px.schema[IMAGE], *kinds, *StructType.fromDDL("error string, seconds double")])

    def run(pixels: pd.DataFrame) -> pd.DataFrame:
        began, image = time.perf_counter(), pixels[IMAGE].iloc[0]
        try:
            out, error = step(pixels)[kinds.names].reset_index(drop=True), None
        except Exception as failed:  # whatever a user's step throws is that image's result
            out, error = pd.DataFrame([[None] * len(kinds)], columns=kinds.names), f"{type(failed).__name__}: {failed}"
        out.insert(0, IMAGE, image)
        return out.assign(error=error, seconds=time.perf_counter() - began)

    return px.groupBy(IMAGE).applyInPandas(run, whole)


def extract_features(images: DataFrame, px: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]], features: Sequence[str] = ("shape", "colour", "chlorophyll")) -> DataFrame:
    """images with features, status (ok or failed) and error; the job goes on whatever happens to an image.

    An image fails by an error that it comes with (column error: decoding, an earlier step) or without pixels left.
    """
    for step in steps:
        px = px.transform(step)
    known = F.col("error") if "error" in images.columns else F.lit(None).cast("string")
    out = images.join(analyse(px, features), IMAGE, "left")
    empty = F.when(F.col("area").isNull() if "shape" in features else F.lit(False), "no pixels in mask")
    error = F.coalesce(known, empty)
    return out.withColumns({"status": F.when(error.isNotNull(), "failed").otherwise("ok"), "error": error})


def error_level(results: DataFrame) -> DataFrame:
    """(error, n): how many images failed by which error, the most frequent first."""
    return results.filter("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error")


def passing(px: DataFrame, checks: DataFrame) -> DataFrame:
    """Pixels of the images that passed their assertion: what follows is not done for the others."""
    return px.join(checks.filter("passed").select(IMAGE), IMAGE, "left_semi")


def expand_grid(options: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every combination of the option strings' values, one row each."""
    out = options
    for n in names:
        out = out.withColumn(n, F.explode(option_values(F.col(n))))
    return out


def cumulative_counts(px: DataFrame, channel: str) -> DataFrame:
    """(image_id, upto): for each image how many pixels have a value below 0, 1, ... 256."""
    counts = histogram.value_counts(px, [channel]).groupBy(IMAGE).agg(F.map_from_entries(F.collect_list(F.struct(F.col("value").cast("int"), "n"))).alias("n"))  # 256 at most
    step = F.sequence(F.lit(0), F.lit(255))
    grown = F.aggregate(step, F.array(F.lit(0).cast("long")), lambda upto, v: F.array_append(upto, F.element_at(upto, -1) + F.coalesce(F.try_element_at("n", v), F.lit(0).cast("long"))))
    return counts.select(IMAGE, grown.alias("upto"))


def grid_search(px: DataFrame, params: DataFrame, low: Column, high: Column, keys: Sequence[str], channel: str = "g") -> DataFrame:
    """(image_id, keys, pixels) of the threshold low <= channel <= high, columns of params, for every image and combination.

    An image is one row of cumulative counts, so a combination takes two look-ups. Combinations stay where they are dealt to;
    the images' rows go to all of these places. The result, images times combinations, is what was asked for.
    """
    dealt = params.withColumn("__block", F.pmod(F.xxhash64(*keys), F.lit(GRID_BLOCKS)).cast("int"))
    images = cumulative_counts(px, channel).withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(GRID_BLOCKS - 1))))
    first, last = F.greatest(F.ceil(low.cast("double")), F.lit(0)).cast("int"), F.least(F.floor(high.cast("double")), F.lit(255)).cast("int")
    pixels = F.when(low.isNotNull() & high.isNotNull() & (last >= first), F.get("upto", last + 1) - F.get("upto", first))
    return images.join(dealt, "__block").select(IMAGE, *keys, F.coalesce(pixels, F.lit(0)).alias("pixels"))


def merge_masks(masks: Sequence[DataFrame], mode: str = "and") -> DataFrame:
    """Child masks of a group merged: and, or."""
    out = masks[0].select(IMAGE, "y", "x")
    for m in masks[1:]:
        m = m.select(IMAGE, "y", "x")
        out = out.join(m, [IMAGE, "y", "x"], "left_semi") if mode == "and" else out.unionByName(m)
    return out if mode == "and" else out.distinct()


def image_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot of each image: images are the events of job image_id % 7."""
    snap = fx.snap(spark, sf_dir)
    last = snap.groupBy("job_id").agg(F.max_by(F.struct("experiment", "plant", "date_time", "camera", "angle", "luid"), "event_id").alias("s")).select("job_id", "s.*")
    ids = fx.px(spark, sf_dir).select(IMAGE).distinct().withColumn("job_id", (F.col(IMAGE) % 7).cast("bigint"))
    return ids.join(last, "job_id").drop("job_id")


LAST = """last as (select job_id, arg_max(experiment, event_id) as experiment, arg_max(plant, event_id) as plant, arg_max(luid, event_id) as luid, max(event_id) from snap group by 1),
ids as (select distinct image_id from px), im as (select image_id, experiment, plant, luid from ids join last on job_id = image_id % 7)"""
SHAPE = """sh as (select image_id, count(*) as area, round(avg(x), 6) as centroid_x, round(avg(y), 6) as centroid_y, round(avg(g), 6) as rgb_g_mean, round(stddev_pop(g), 6) as rgb_g_std_dev from px where g between 100 and 160 and r > 120 group by 1)"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.px(spark, sf_dir)
    steps = [lambda d: pixels.range_mask(d, "g", 100, 160), lambda d: d.filter("r > 120")]
    out = extract_features(image_catalogue(spark, sf_dir), px, steps)
    columns = ["experiment", "plant", "luid", "image_id", "area", "centroid_x", "centroid_y", "rgb_g_mean", "rgb_g_std_dev", "status"]
    rounded = {c: F.round(c, 6) for c in ("centroid_x", "centroid_y", "rgb_g_mean", "rgb_g_std_dev")}
    return catalogue.merge_results([out.withColumns(rounded).select(*columns)])


@query("b1_extract_features", sql("px snap", LAST + ", " + SHAPE + " select experiment, plant, luid, image_id, area, centroid_x, centroid_y, rgb_g_mean, rgb_g_std_dev, case when area is null then 'failed' else 'ok' end as status from im left join sh using (image_id)"))
def b1(spark, d):
    return flagship(spark, d)


@query("b3_failed_images", sql("px", "m as (select image_id, count(*) as area from px where g between 250 and 255 group by 1) select image_id, area, case when area is null then 'failed' else 'ok' end as status, case when area is null then 'no pixels in mask' end as error from (select distinct image_id from px) left join m using (image_id)"))
def b3(spark, d):
    px = fx.px(spark, d)
    out = extract_features(px.select(IMAGE).distinct(), px, [lambda p: pixels.range_mask(p, "g", 250, 255)], ("shape",))
    return out.select(IMAGE, "area", "status", "error")


def _brightest(pixels: pd.DataFrame) -> pd.DataFrame:
    """A step that gives up on images without a very bright pixel."""
    bright = pixels[pixels["g"] > 228]
    if not len(bright):
        raise ValueError("no bright pixel")
    return pd.DataFrame({"bright": [len(bright)], "top": [int(bright["y"].min())]})


BRIGHT = "br as (select image_id, count(*) filter (g > 228) as bright, min(y) filter (g > 228) as top from px group by 1)"


@query("b3_captured_errors", sql("px", BRIGHT + " select image_id, nullif(bright, 0) as bright, top, case when bright = 0 then 'ValueError: no bright pixel' end as error, true as timed from br"))
def b3b(spark, d):
    return captured(fx.px(spark, d), _brightest, "bright long, top int").select(IMAGE, "bright", "top", "error", (F.col("seconds") >= 0).alias("timed"))


@query("b3_error_levels", sql("px", BRIGHT + ", m as (select image_id, count(*) as area from px where g between 215 and 255 group by 1), f as (select image_id, case when bright = 0 then 'ValueError: no bright pixel' when area is null then 'no pixels in mask' end as error from br left join m using (image_id)) select error, count(*) as n from f where error is not null group by 1"))
def b3c(spark, d):
    px = fx.px(spark, d)
    images = captured(px, _brightest, "bright long, top int").select(IMAGE, "error")
    return error_level(extract_features(images, px, [lambda p: pixels.range_mask(p, "g", 215, 255)], ("shape",)))


@query("b4_resume", sql("px", "select image_id, count(*) as area from px where g between 100 and 160 and image_id not in (select image_id from px where image_id % 2 = 0) group by 1"))
def b4(spark, d):
    px = fx.px(spark, d)
    done = px.filter("image_id % 2 = 0").select(IMAGE)
    return objects.shape_features(pixels.range_mask(catalogue.not_done(px, done, IMAGE), "g", 100, 160)).select(IMAGE, "area")


@query("b5_assertion", sql("px", "select image_id, count(*) as n from px where image_id in (select image_id from px where x between 3 and 10 and y between 5 and 16 and g > 225) group by 1"))
def b5(spark, d):
    px = fx.px(spark, d)
    checks = px.groupBy(IMAGE).agg((F.count_if(F.col("x").between(3, 10) & F.col("y").between(5, 16) & (F.col("g") > 225)) > 0).alias("passed"))
    return passing(px, checks).groupBy(IMAGE).agg(F.count(F.lit(1)).alias("n"))


@query("b6_grid_search", sql("px", """lo as (select unnest(['0', '100', '25', '50', '7', '75']) as lo), hi as (select unnest(['150', '200']) as hi), im as (select distinct image_id from px)
select image_id, lo, hi, (select count(*) from px p where p.image_id = im.image_id and p.g between lo::int and hi::int) as pixels from im, lo, hi"""))
def b6(spark, d):
    options = spark.createDataFrame([("0|100;25,7", "150,200")], "lo string, hi string")
    params = expand_grid(options, ["lo", "hi"])
    return grid_search(fx.px(spark, d), params, F.col("lo").cast("int"), F.col("hi").cast("int"), ["lo", "hi"])


@query("b7_forced_pairs", sql("px", "select image_id, count(*) as area, 'series-1' as luid, 'batch' as source from px where g between 100 and 160 group by 1"))
def b7(spark, d):
    s = objects.shape_features(pixels.range_mask(fx.px(spark, d), "g", 100, 160)).select(IMAGE, "area")
    return s.withColumns({k: F.lit(v) for k, v in {"luid": "series-1", "source": "batch"}.items()})


def _masks(px: DataFrame) -> list[DataFrame]:
    return [pixels.range_mask(px, "g", 100, 160), pixels.range_mask(px, "r", 90, 150), pixels.range_mask(px, "b", 60, 200)]


@query("u8_merge_and", sql("px", "select image_id, y, x from px where g between 100 and 160 and r between 90 and 150 and b between 60 and 200"))
def u8(spark, d):
    return merge_masks(_masks(fx.px(spark, d)))


@query("u8_merge_or", sql("px", "select image_id, y, x from px where g between 100 and 160 or r between 90 and 150 or b between 60 and 200"))
def u8b(spark, d):
    return merge_masks(_masks(fx.px(spark, d)), "or")


@query("b2_analysis", sql("px", "select image_id, count(*) as area, round(avg(b), 6) as rgb_b_mean, round(avg(exp(-0.0280 * 1.049 * r + 0.0190 * 1.049 * g - 0.0030 * 1.041 * b + 5.780)), 4) as chlorophyll_mean from px where g between 100 and 160 group by 1"))
def b2(spark, d):
    out = analyse(pixels.range_mask(fx.px(spark, d), "g", 100, 160))
    return out.select(IMAGE, "area", F.round("rgb_b_mean", 6).alias("rgb_b_mean"), F.round("chlorophyll_mean", 4).alias("chlorophyll_mean"))


CROSS = "(values (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) as cr(dy, dx)"


@query("p5_mask_builder_morphology", sql("mask", f"""rest as (select image_id, y, x from px except select image_id, y, x from mask), hit as (select distinct image_id, y + dy as y, x + dx as x from rest, {CROSS}),
thin as (select image_id, y, x from mask except select image_id, y, x from hit), wide as (select distinct image_id, y + dy as y, x + dx as x from thin, {CROSS}) select px.image_id, px.y, px.x from px join wide using (image_id, y, x) where r between 60 and 190"""))
def p5b(spark, d):
    return build_mask(fx.px(spark, d), [{"method": "range", "channel": "g", "low": 100, "high": 160, "morphology": {"op": "open", "size": 3, "shape": "cross"}}, {"method": "range", "channel": "r", "low": 60, "high": 190}])


@query("p5_mask_builder", sql("px", "select image_id, y, x from px where g between 100 and 160 and r between 90 and 150"))
def p5(spark, d):
    return build_mask(fx.px(spark, d), [{"method": "range", "channel": "g", "low": 100, "high": 160}, {"method": "range", "channel": "r", "low": 90, "high": 150}])


def build_mask(px: DataFrame, parameters: Sequence[Mapping], merge: str = "and") -> DataFrame:
    """A mask from a list of thresholds: method range (channel, low, high) or otsu (channel).

    A threshold may name a morphology step for its own mask: {"op": "open", "size": 3, "shape": "ellipse", "iterations": 1}.
    """
    masks = []
    for p in parameters:
        if p["method"] == "otsu":
            masks.append(histogram.above_threshold(px, histogram.otsu_thresholds(px, [p["channel"]]), p["channel"]))
        else:
            masks.append(pixels.range_mask(px, p["channel"], p["low"], p["high"]))
        if step := p.get("morphology"):
            masks[-1] = neighbourhood.morphology(masks[-1], px, **step)
    return merge_masks(masks, merge)

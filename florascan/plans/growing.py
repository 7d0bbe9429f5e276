"""Streaming and plug-in queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from florascan.functions import plugins
from florascan.plans import fixtures as fx
from florascan.plans.catalogue import SERIES
from florascan.plans.fixtures import sql
from florascan.plans.registry import query
from florascan.sources.storage import new_path, stored
from florascan.streaming import incremental


def _stream(spark, d, twice: bool = False):
    """The snapshot catalogue as a stream of files."""
    snap = stored((snap := fx.snap(spark, d)).unionByName(snap) if twice else fx.snap(spark, d), "snapshots")
    return incremental.read_files(spark, snap.schema, snap.inputFiles()[0].rsplit("/", 1)[0])


@query("t1_incremental_catalogue", sql("snap", "select luid, plant from snap"))
def t1(spark, d):
    out = new_path(spark, "catalogue")
    incremental.write_until_done(incremental.new_snapshots(_stream(spark, d, twice=True), "date_time").select("luid", "plant"), out, new_path(spark, "catalogue-state"))
    return spark.read.parquet(out)


@query("t2_incremental_series", sql("snap", SERIES + " select luid, series_id from w"))
def t2(spark, d):
    """Files in any order: as late as the snapshots' whole span. A closing row far ahead lets the last ones leave."""
    incremental.use_rocksdb(spark)
    path, out = new_path(spark, "arrivals"), new_path(spark, "series")
    snap = fx.snap(spark, d).select("experiment", "plant", "date_time", "luid")
    snap.write.parquet(path)
    span = snap.agg(F.min("date_time").alias("first"), F.max("date_time").alias("last")).withColumn("days", F.coalesce(F.datediff("last", "first"), F.lit(0)) + 1)
    days = span.first()["days"]
    closing = span.select(F.lit("").alias("experiment"), F.lit("closing").alias("plant"), F.timestamp_add("DAY", F.lit(days + 1), F.col("last")).alias("date_time"), F.lit("closing").alias("luid"))
    closing.write.mode("append").parquet(path)
    stream = incremental.incremental_series(incremental.read_files(spark, snap.schema, path, 4), ["experiment", "plant"], "date_time", "luid", 600, f"{days} days")
    incremental.write_until_done(stream, out, new_path(spark, "series-state"))
    return spark.read.schema("experiment string, plant string, luid string, series_id string").parquet(out).select("luid", "series_id")


@query("v3_operator_chain", sql("px", "l as (select *, least(255, cast(floor(abs(round(g * 120::double / 100 - 10, 9))) as int)) as gg from px) select image_id, count(*) as area, round(avg(x), 6) as centroid_x, round(avg(y), 6) as centroid_y from l where gg between 110 and 180 group by 1"))
def v3(spark, d):
    out = plugins.chain(fx.px(spark, d), [("linear", {"alpha": 120, "beta": -10}), ("range_mask", {"channel": "g", "low": 110, "high": 180}), ("shape_features", {})])
    return out.select("image_id", "area", F.round("centroid_x", 6).alias("centroid_x"), F.round("centroid_y", 6).alias("centroid_y"))


@query("v2_feature_choice", sql("px", "select image_id, count(*) as area, round(avg(b), 6) as rgb_b_mean, round(stddev_pop(b), 6) as rgb_b_std_dev from px where g between 100 and 160 group by 1"))
def v2(spark, d):
    out = plugins.extract(plugins.apply_operator(fx.px(spark, d), "range_mask", channel="g", low=100, high=160), ["image_id"], ["area", "colour"])
    return out.select("image_id", "area", F.round("rgb_b_mean", 6).alias("rgb_b_mean"), F.round("rgb_b_std_dev", 6).alias("rgb_b_std_dev"))

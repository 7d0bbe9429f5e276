"""Queries over the snapshot catalogue, its annotations and its feature rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from florascan.functions import names
from florascan.operators import catalogue as c
from florascan.operators import series as s
from florascan.plans import fixtures as fx
from florascan.plans.fixtures import sql
from florascan.plans.registry import query
from florascan.sources import tables as t
from florascan.sources.storage import new_path


def stamp():
    return F.date_format("date_time", "yyyy-MM-dd HH:mm:ss").alias("date_time")


TIME = "strftime(date_time, '%Y-%m-%d %H:%M:%S') as date_time"


@query("s5_catalogue_first", sql("snap", "select plant, arg_min(luid, event_id) as luid, min(event_id) as event_id from snap group by plant"))
def s5(spark, d):
    return t.keep_first(fx.snap(spark, d), ["plant"], [F.col("event_id")]).select("plant", "luid", "event_id")


@query("s6_add_new", sql("snap", "select luid, event_id from snap where event_id % 2 = 0 or plant < 'p0100'"))
def s6(spark, d):
    snap = fx.snap(spark, d).select("luid", "event_id", "plant")
    found = snap.filter("plant < 'p0100'")
    found = found.withColumn("event_id", F.col("event_id") + 1_000_000).unionByName(found)  # every key is found twice
    return t.add_new(snap.filter("event_id % 2 = 0"), found, order=[F.col("event_id")]).select("luid", "event_id")


@query("s7_relational_catalogue", "select o_orderkey, c_name, n_name, r_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def s7(spark, d):
    tabs = [t.table(spark, d, n) for n in ("orders", "customer", "nation", "region")]
    joined = t.relational_catalogue(*tabs, on=[("o_custkey", "c_custkey"), ("c_nationkey", "n_nationkey"), ("n_regionkey", "r_regionkey")])
    return joined.select("o_orderkey", "c_name", "n_name", "r_name")


@query("s8_experiments", sql("snap", "select distinct experiment from snap order by 1"))
def s8(spark, d):
    return t.list_experiments(fx.snap(spark, d), "experiment")


@query("s10_partial_union", sql("snap", """select luid, case when event_id % 3 = 2 then null else camera end as camera, case when event_id % 3 = 0 then null else angle end as angle,
  case when event_id % 3 = 1 then job_id::varchar end as job_id from snap"""))
def s10(spark, d):
    snap, folder = fx.snap(spark, d), new_path(spark, "partials")
    for k, columns in enumerate((["luid", "camera"], ["angle", "luid", "job_id", "camera"], ["angle", "luid"])):
        t.write_sheet(snap.filter(F.col("event_id") % 3 == k).select(*columns), f"{folder}/{k}")
    return t.read_partial_results(spark, [folder], "*.csv").select("luid", "camera", "angle", "job_id")


@query("s1_scan", sql("snap", "select distinct experiment, camera from snap"))
def s1(spark, d):
    """Files below folders, found by their extension; what the folders' names say of them."""
    folder = new_path(spark, "scan")
    fx.snap(spark, d).select("experiment", "camera", "luid").write.partitionBy("experiment", "camera").csv(folder)
    found = t.scan_images(spark, folder, ["csv"])
    return found.select(F.regexp_extract("path", "experiment=([^/]*)", 1).alias("experiment"), F.regexp_extract("path", "camera=([^/]*)", 1).alias("camera")).distinct()


@query("s4_image_list", sql("snap", "select filepath as path from snap"))
def s4(spark, d):
    path = new_path(spark, "image-list")
    lines = fx.snap(spark, d).select(F.explode(F.array(F.concat(F.lit("  "), "filepath", F.lit(" ")), F.lit(""))).alias("value"))
    lines.write.text(path)
    return t.read_image_list(spark, path)


@query("s9_cached_catalogue", sql("snap", "select luid, plant from snap where camera = 'view'"))
def s9(spark, d):
    """Built once, then read; the second build is never asked for."""
    path, snap = new_path(spark, "cached"), fx.snap(spark, d).select("luid", "plant", "camera")
    t.cached_catalogue(spark, path, lambda: snap.filter("camera = 'view'"))
    return t.cached_catalogue(spark, path, lambda: snap).select("luid", "plant")


def _sheet(spark, df, schema):
    path = new_path(spark, "sheet")
    t.write_sheet(t.sheet_columns(df), path)
    return spark.read.csv(path, header=True, schema=schema)


@query("s12_merged_sheet", sql("snap features", "select experiment, plant, luid, null::double as measure from snap union all select null, plant::varchar, null, measure from features"))
def s12(spark, d):
    """The sheet of the merged partial results, written and read again."""
    snap, features = fx.snap(spark, d).select("luid", "plant", "experiment"), fx.features(spark, d).select(F.col("plant").cast("string").alias("plant"), "measure")
    merged = c.merge_results([features, snap])
    return _sheet(spark, merged, "experiment string, plant string, luid string, measure double")


@query("s15_selection_sheet", sql("snap", "select luid, filepath, job_id from snap where camera = 'click'"))
def s15(spark, d):
    """A selection saved and loaded again."""
    selection = c.select_snapshots(fx.snap(spark, d), {"camera": "click"}, ["luid", "filepath", "job_id"])
    return _sheet(spark, selection, "luid string, filepath string, job_id bigint")


@query("s17_data_sheet", "select p_partkey as part_key, replace(p_type, ',', ' ') as part_type, p_size as part_size from part")
def s17(spark, d):
    """A data sheet saved, loaded and copied under another name."""
    parts = t.table(spark, d, "part").select(F.col("p_partkey").alias("part-key"), F.concat_ws("", "p_type").alias("part-type"), F.col("p_size").cast("int").alias("part-size"))
    first = _sheet(spark, parts, "part_key bigint, part_type string, part_size int")
    return _sheet(spark, first, first.schema)


@query("s11_sheet", "select p_partkey as part_key, replace(p_type, ',', ' ') as part_type, p_size as part_size from part")
def s11(spark, d):
    return t.sheet_columns(t.table(spark, d, "part").select(F.col("p_partkey").alias("part-key"), F.col("p_type").alias("part-type"), F.col("p_size").alias("part-size")))


@query("s13_annotation_sheet", sql("snap", f"select plant, {TIME}, luid, '' as disease_index from (select *, row_number() over (partition by plant, experiment order by date_time, event_id) k from snap) where k = 1"))
def s13(spark, d):
    first = c.annotation_sheet(fx.snap(spark, d).withColumn("series", F.concat_ws("|", "plant", "experiment")), "series", ["date_time", "event_id"], ["plant", "date_time", "luid"])
    return first.select("plant", stamp(), "luid", "disease_index")


@query("s18_external_catalogue", sql("snap", f"select lower(upper(experiment)) as experiment, lower(upper(plant)) as plant, {TIME}, lower(wavelength) as wavelength, 'top' as angle, substr(filepath, 6) as filepath from snap"))
def s18(spark, d):
    snap = fx.snap(spark, d).select(F.upper("experiment").alias("Experiment"), F.upper("plant").alias("PLANT"), "date_time", F.col("wavelength").alias("View_Option"), F.col("filepath").alias("FilePath"))
    return t.normalise_external(snap, "/img/").select("experiment", "plant", stamp(), "wavelength", "angle", "filepath")


@query("f1_select", sql("snap", "select distinct plant, camera from snap where experiment = 'exp1' and event_id between 100 and 5000 and camera in ('view', 'click')"))
def f1(spark, d):
    return c.select_snapshots(fx.snap(spark, d), {"Experiment": "exp1", "event_id": ("between", 100, 5000), "camera": ("in", ["view", "click"]), "angle": None}, ["Plant", "camera", "nothing"], distinct=True)


@query("f4_in_list", sql("snap", "select luid from snap where job_id in (select distinct event_id % 3 from snap)"))
def f4(spark, d):
    snap = fx.snap(spark, d)
    return c.in_list(snap, snap.select((F.col("event_id") % 3).alias("job_id")), "job_id").select("luid")


@query("f5_same_text", sql("snap", "select luid from snap where lower(camera) = lower('VIEW')"))
def f5(spark, d):
    return fx.snap(spark, d).filter(c.same_text(F.col("camera"), "VIEW")).select("luid")


@query("f8_mask_filter", sql("snap", """select luid from snap where ((((experiment = 'exp0' and camera in ('view', 'click')) or angle = 'side90') and not (plant in ('p0001', 'p0005')) and wavelength in ('sw755', 'wl_530')) or job_id = '3')
  and date_time::date <= date '2024-01-20'"""))
def f8(spark, d):
    masks = dict(include=[{"experiment": ["EXP0"], "camera": ["View", "click"], "*": ["x"]}, {"angle": ["side90"]}], exclude=[{"plant": ["p0001", "P0005"]}], post=[{"wavelength": ["sw755", "wl_530"]}], force=[{"job_id": ["3"]}])
    return c.mask_filter(fx.snap(spark, d).withColumn("job_id", F.col("job_id").cast("string")), **masks, cut_at=date(2024, 1, 20)).select("luid")


@query("f9_exclude_nulls", sql("snap", "w as (select luid, event_id, case when event_id % 4 > 0 then wavelength end as wavelength from snap) select luid from w where not coalesce(wavelength = 'sw755', false) and not coalesce(wavelength = 'wl_530' and luid > 'exp2', false)"))
def f9(spark, d):
    snap = fx.snap(spark, d).withColumn("wavelength", F.when(F.col("event_id") % 4 > 0, F.col("wavelength")))
    late = F.when(F.col("luid") > "exp2", "yes")
    return c.mask_filter(snap.withColumn("late", late), exclude=[{"wavelength": ["SW755"]}, {"wavelength": ["wl_530"], "late": ["yes"]}]).select("luid")


@query("f12_compare_times", sql("snap", """select luid, date_time::date = date '2024-01-10' as at_date, date_time::date < date '2024-01-10' as before_date,
  hour(date_time) * 3600 + minute(date_time) * 60 + second(date_time) > 43200 as after_noon, date_time > timestamp '2024-01-15 12:00:00' as after_ts from snap"""))
def f12(spark, d):
    ts = F.col("date_time")
    tests = {"at_date": c.compare_ts(ts, "date", "at", "2024-01-10"), "before_date": c.compare_ts(ts, "date", "before", "2024-01-10"), "after_noon": c.compare_ts(ts, "time", "after", 43200), "after_ts": c.compare_ts(ts, "timestamp", "after", "2024-01-15 12:00:00")}
    return fx.snap(spark, d).select("luid", *[v.alias(k) for k, v in tests.items()])


@query("f13_between_times", sql("snap", """select luid from snap where date_time::date >= date '2024-01-05' and date_time::date < date '2024-01-25'
  and hour(date_time) * 3600 + minute(date_time) * 60 + second(date_time) > 21600 and hour(date_time) * 3600 + minute(date_time) * 60 + second(date_time) <= 64800"""))
def f13(spark, d):
    ts = F.col("date_time")
    return fx.snap(spark, d).filter(c.between_dates(ts, date(2024, 1, 5), date(2024, 1, 25)) & c.between_times(ts, 21600, 64800, include_start=False, include_end=True)).select("luid")


@query("f15_camera_kind", sql("snap", "select luid, case when contains(cam, 'vis') then 'vis' when contains(cam, 'fluo') then 'fluo' when contains(cam, 'nir') then 'nir' when contains(cam, 'msp') then 'msp' when contains(cam, 'cf') then 'cf' else 'unknown' end as kind from (select luid, case job_id when 0 then 'vis' when 1 then 'fluo' when 2 then 'nir' when 3 then 'msp' when 4 then 'cf' else 'rgb' end || '_' || camera as cam from snap)"))
def f15(spark, d):
    label = F.concat(F.expr("case job_id when 0 then 'VIS' when 1 then 'Fluo' when 2 then 'nir' when 3 then 'msp' when 4 then 'cf' else 'rgb' end"), F.lit("_"), "camera")
    return fx.snap(spark, d).select("luid", c.camera_kind(label).alias("kind"))


@query("f16_condition_flags", sql("snap", """select luid, coalesce(camera = 'click' and angle = 'side90' and date_time::date > date '2024-01-06', false) as drop_roi, experiment = 'exp2' or (experiment = 'exp3' and date_time::date > date '2024-01-20') as blue_guide,
  camera = 'view' and date_time::date < date '2024-01-07' as wide_angle, case when camera <> 'view' then 1 when date_time::date < date '2024-01-07' then 1426 else 1800 end as scale_width from snap"""))
def f16(spark, d):
    ts, cam, exp = F.col("date_time"), F.col("camera"), F.col("experiment")
    after, before = (lambda day: c.compare_ts(ts, "date", "after", day)), (lambda day: c.compare_ts(ts, "date", "before", day))
    wide = (cam == "view") & before("2024-01-07")
    flags = c.condition_flags({"drop_roi": (cam == "click") & (F.col("angle") == "side90") & after("2024-01-06"), "blue_guide": (exp == "exp2") | ((exp == "exp3") & after("2024-01-20")), "wide_angle": wide})
    return fx.snap(spark, d).select("luid", *[v.alias(k) for k, v in flags.items()], F.when(cam != "view", 1).when(wide, 1426).otherwise(1800).alias("scale_width"))


@query("f17_group_filters", sql("snap", "select luid from snap where camera in ('view', 'error') and angle in ('side0')"))
def f17(spark, d):
    return fx.snap(spark, d).filter(c.filters_match({"camera": "view, error", "angle": "side0", "wavelength": ""})).select("luid")


@query("f18_not_done", sql("snap", "select luid from snap where luid not in (select luid from snap where job_id < 3)"))
def f18(spark, d):
    snap = fx.snap(spark, d)
    return c.not_done(snap, snap.filter("job_id < 3"), "luid").select("luid")


LINKS = "links as (select a.event_id, b.event_id as linked_event_id, b.wavelength as linked_wavelength from snap a join snap b on a.experiment = b.experiment and a.plant = b.plant and a.event_id <> b.event_id and abs(epoch(a.date_time) - epoch(b.date_time)) <= 3600)"


def links(spark, d):
    return s.linked_images(fx.snap(spark, d), ["experiment", "plant"], "date_time", "event_id", ["wavelength"])


@query("j1_linked_images", sql("snap", LINKS + " select * from links"))
def j1(spark, d):
    return links(spark, d)


@query("j2_channel_from_sibling", sql("snap", LINKS + " select event_id, min(linked_event_id) as linked_event_id from links where linked_wavelength = 'wl_530' group by 1"))
def j2(spark, d):
    return s.first_sibling(links(spark, d), "event_id", "linked_wavelength", "wl_530", "linked_event_id")


@query("j3_available_channels", sql("snap", LINKS + " select event_id, array_to_string(list_sort(list(distinct linked_wavelength)), ',') as channels from links group by 1"))
def j3(spark, d):
    return s.available_channels(links(spark, d), "event_id", "linked_wavelength").select("event_id", F.array_join("channels", ",").alias("channels"))


@query("j4_previous_observation", sql("snap", "select event_id, lag(event_id) over (partition by experiment, plant, camera order by date_time, event_id) as previous from snap"))
def j4(spark, d):
    return s.previous_observation(fx.snap(spark, d), ["experiment", "plant", "camera"], ["date_time", "event_id"], "event_id", "previous").select("event_id", "previous")


@query("j5_keep_selection", sql("snap", "select luid from snap where job_id = 1 and luid in (select luid from snap where camera = 'view')"))
def j5(spark, d):
    snap = fx.snap(spark, d)
    return c.edit_selection(snap.filter("job_id = 1"), snap.filter("camera = 'view'"), mode="keep").select("luid")


@query("j6_remove_selection", sql("snap", "select luid from snap where job_id = 1 and luid not in (select luid from snap where camera = 'view')"))
def j6(spark, d):
    snap = fx.snap(spark, d)
    return c.edit_selection(snap.filter("job_id = 1"), snap.filter("camera = 'view'"), mode="remove").select("luid")


@query("u1_add_selection", sql("snap", "select luid from snap where job_id = 1 union all select luid from snap where camera = 'view'"))
def u1(spark, d):
    snap = fx.snap(spark, d)
    return c.edit_selection(snap.filter("job_id = 1"), snap.filter("camera = 'view'"), mode="add").select("luid")


@query("j7_annotated", sql("snap annotations", "select s.event_id, kind, text from snap s join annotations a on s.event_id = a.event_id"))
def j7(spark, d):
    return fx.snap(spark, d).join(fx.annotations(spark, d), "event_id").select("event_id", "kind", "text")


@query("j7_keep_annotated", sql("snap annotations", "select luid from snap where event_id in (select event_id from annotations)"))
def j7b(spark, d):
    return c.edit_selection(fx.snap(spark, d), fx.annotations(spark, d), "event_id", "keep").select("luid")


@query("j8_group_median_rows", sql("features", "select plant, day::varchar as day, measure, round(median(measure) over (partition by plant), 6) as plant_median from features"))
def j8(spark, d):
    return c.with_group_median(fx.features(spark, d), ["plant"], "measure", "plant_median").withColumns({"plant_median": F.round("plant_median", 6), "day": F.col("day").cast("string")})


KEYS = ("experiment", "plant", "day", "camera", "angle", "wavelength")


@query("a1_key_counts", sql("snap", "s as (select *, date_time::date::varchar as day from snap) " + " union all ".join(f"select '{k}' as key, {k} as value, count(*) as n from s group by 2" for k in KEYS)))
def a1(spark, d):
    return c.key_counts(fx.snap(spark, d).withColumn("day", F.to_date("date_time")), KEYS)


def described(names: str, tab: str) -> list[str]:
    return [f"select '{n}' as name, count({n}) as n, count(distinct {n}) as n_distinct, null::varchar as top, null::bigint as freq, round(avg({n}), 4) as mean, round(stddev_samp({n}), 4) as std, min({n})::double as least, median({n})::double as median, max({n})::double as greatest from {tab}" for n in names.split()]


def counted(names: str, tab: str) -> list[str]:
    one = "select '{n}' as name, sum(m)::bigint as n, count(*) as n_distinct, arg_min(v, (-m, v)) as top, max(m)::bigint as freq, null::double as mean, null::double as std, null::double as least, null::double as median, null::double as greatest from (select {n} as v, count(*) as m from {tab} where {n} is not null group by 1)"
    return [one.format(n=n, tab=tab) for n in names.split()]


def rounded(df):
    return df.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("a2_describe", sql("features", " union all ".join(described("plant measure", "features"))))
def a2(spark, d):
    return rounded(c.describe(fx.features(spark, d), ["plant", "measure"]))


@query("a2_describe_all", sql("snap", "w as (select plant, camera, angle, case when event_id % 4 > 0 then wavelength end as wavelength, event_id, job_id from snap) " + " union all ".join(described("event_id job_id", "w") + counted("plant camera angle wavelength", "w"))))
def a2b(spark, d):
    """Texts, nulls among them, and numbers, whose medians are selected as those of large tables are."""
    snap = fx.snap(spark, d).withColumn("wavelength", F.when(F.col("event_id") % 4 > 0, F.col("wavelength")))
    return rounded(c.describe(snap, ["plant", "event_id", "camera", "job_id", "angle", "wavelength"], large=100))


@query("a3_annotation_stats", sql("snap annotations", "select coalesce(kind, 'none') as kind, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from snap left join annotations using (event_id) group by 1"))
def a3(spark, d):
    return c.annotation_stats(fx.snap(spark, d), fx.annotations(spark, d), "event_id").withColumn("percent", F.round("percent", 6))


SERIES = """o as (select experiment, plant, luid, date_time, row_number() over (partition by experiment, plant order by date_time, luid) as k from snap),
w as (select experiment, plant, k, luid, date_time as anchor, luid as series_id from o where k = 1
  union all select o.experiment, o.plant, o.k, o.luid, case when epoch(o.date_time) - epoch(w.anchor) < 36000 then w.anchor else o.date_time end, case when epoch(o.date_time) - epoch(w.anchor) < 36000 then w.series_id else o.luid end
  from w join o on o.experiment = w.experiment and o.plant = w.plant and o.k = w.k + 1)"""


def in_series(spark, d):
    return s.series_id(fx.snap(spark, d), ["experiment", "plant"], "date_time", "luid", 600)


@query("w1_series", sql("snap", SERIES + " select luid, series_id from w"))
def w1(spark, d):
    return in_series(spark, d).select("luid", "series_id")


@query("a4_series_sizes", sql("snap", SERIES + " select size, count(*) as n_series from (select series_id, count(*) as size from w group by 1) group by 1"))
def a4(spark, d):
    return s.series_sizes(in_series(spark, d), "series_id")


@query("a5_series_median", sql("snap", SERIES + " select series_id, median(event_id)::double as event_id, median(job_id)::double as job_id from w join snap using (luid) group by 1"))
def a5(spark, d):
    return c.aggregate_by(in_series(spark, d), ["series_id"], ["event_id", "job_id"])


@query("a6_series_mean", sql("snap", SERIES + " select series_id, round(avg(event_id), 6) as event_id from w join snap using (luid) group by 1"))
def a6(spark, d):
    return c.aggregate_by(in_series(spark, d), ["series_id"], ["event_id"], "mean").withColumn("event_id", F.round("event_id", 6))


@query("a7_by_day", sql("features", "select plant, day::varchar as day, round(median(measure), 6) as measure from features group by 1, 2"))
def a7(spark, d):
    return c.aggregate_by(fx.features(spark, d), ["plant", "day"], ["measure"]).withColumns({"measure": F.round("measure", 6), "day": F.col("day").cast("string")})


@query("a7_day_of_many", sql("features", "select day::varchar as day, round(median(measure), 6) as measure from features group by 1"))
def a7b(spark, d):
    """Days with many rows: of the large ones the median is selected."""
    large = c.median_by(fx.features(spark, d), ["day"], ["measure"], large=5)
    return large.withColumns({"measure": F.round("measure", 6), "day": F.col("day").cast("string")})


@query("a8_by_hour", sql("snap", "select plant, strftime(date_trunc('hour', date_time), '%Y-%m-%d %H') as hour, round(avg(event_id), 6) as event_id from snap group by 1, 2"))
def a8(spark, d):
    snap = fx.snap(spark, d).withColumn("hour", F.date_format(F.date_trunc("hour", "date_time"), "yyyy-MM-dd HH"))
    return c.aggregate_by(snap, ["plant", "hour"], ["event_id"], "mean").withColumn("event_id", F.round("event_id", 6))


@query("a9_drop_duplicates", sql("snap", "select distinct experiment, camera, angle from snap"))
def a9(spark, d):
    return fx.snap(spark, d).select("experiment", "camera", "angle").dropDuplicates()


@query("w2_keep_latest", sql("snap", "select plant, camera, luid from (select *, row_number() over (partition by plant, camera order by date_time desc, event_id) k from snap) where k = 1"))
def w2(spark, d):
    return s.keep_latest(fx.snap(spark, d), ["plant", "camera"], "date_time", "event_id").select("plant", "camera", "luid")


@query("o2_merged_order", sql("snap", "select experiment, plant, luid, camera, null::int as area from snap where job_id = 0 union all select experiment, plant, luid, null, job_id::int from snap where job_id = 1"))
def o2(spark, d):
    snap = fx.snap(spark, d)
    return c.merge_results([snap.filter("job_id = 0").select("camera", "luid", "plant", "experiment"), snap.filter("job_id = 1").select("plant", "experiment", "luid", F.col("job_id").cast("int").alias("area"))])


@query("o3_first_rows", sql("snap", "select luid from snap order by date_time desc, event_id limit 25"))
def o3(spark, d):
    return c.select_snapshots(fx.snap(spark, d), {}, order_by=[F.desc("date_time"), "event_id"], limit=25).select("luid")


@query("o4_random_rows", sql("snap", "select luid, plant from snap order by md5(luid || ':7'), luid limit 50"))
def o4(spark, d):
    return c.random_rows(fx.snap(spark, d).select("luid", "plant"), 50, "luid", seed=7, order_by=["luid"])


@query("o5_random_order", sql("snap", "select luid from snap order by md5(luid || ':7'), luid"))
def o5(spark, d):
    return c.shuffled(fx.snap(spark, d).select("luid"), "luid", seed=7)


@query("o7_natural_order", sql("snap", "select luid, prefix, number from (select luid, regexp_extract(luid, '^(\\D*)', 1) as prefix, regexp_extract(luid, '^\\D*(\\d{1,18})', 1)::bigint as number from snap)"))
def o7(spark, d):
    prefix, number, name = c.natural_order(F.col("luid"))
    return fx.snap(spark, d).select("luid", prefix.alias("prefix"), number.alias("number")).orderBy("prefix", "number", "luid")


@query("x1_parse_path", sql("snap", f"select luid, 'brackets' as scheme, experiment, plant, {TIME}, camera, angle, 'sw755' as wavelength from snap"))
def x1(spark, d):
    parsed = fx.snap(spark, d).select("luid", names.parse_path(F.col("filepath")).alias("p"))
    return parsed.select("luid", "p.scheme", "p.experiment", "p.plant", F.date_format("p.date_time", "yyyy-MM-dd HH:mm:ss").alias("date_time"), "p.camera", "p.angle", "p.wavelength")


@query("x3_parse_schemes", sql("snap", """select luid, case event_id % 7 when 0 then 'semicolons' when 1 then 'hashes' when 2 then 'gridsplit' when 3 then 'imean' when 4 then 'roots' when 5 then 'cam' else 'default' end as scheme,
  case event_id % 7 when 5 then 'ex' || experiment when 6 then 'folder' else experiment end as experiment,
  case event_id % 7 when 2 then plant || '-' || job_id when 6 then plant else plant end as plant from snap"""))
def x3(spark, d):
    at = F.date_format("date_time", "yyyyMMddHHmmss")
    e, p, cam, w, j = F.col("experiment"), F.col("plant"), F.col("camera"), F.col("wavelength"), F.col("job_id").cast("string")
    name = (
        F.when(F.col("event_id") % 7 == 0, F.concat_ws(";", e, p, F.concat_ws("-", cam, w), at, F.lit("1")))
        .when(F.col("event_id") % 7 == 1, F.concat_ws("#", e, at, p, cam, F.lit("side0"), w, F.lit("x"), j))
        .when(F.col("event_id") % 7 == 2, F.concat(F.lit("gridsplit_"), e, F.lit("_"), p, F.lit("-"), j))
        .when(F.col("event_id") % 7 == 3, F.concat_ws("_", F.lit("imean"), at, e, p, F.lit("0")))
        .when(F.col("event_id") % 7 == 4, F.concat_ws("#", F.lit("rr"), e, p, F.lit("x"), F.date_format("date_time", "yyyyMMdd_HHmmss")))
        .when(F.col("event_id") % 7 == 5, F.concat(F.lit("ex"), e, p, F.lit("-CAM1-"), at))
        .otherwise(p)
    )
    parsed = fx.snap(spark, d).select("luid", names.parse_path(F.concat(F.lit("/img/folder/"), name, F.lit(".png"))).alias("p"))
    return parsed.select("luid", "p.scheme", "p.experiment", "p.plant")


@query("x8_luid_and_path", sql("snap", "select event_id, experiment || '_' || plant || '_' || strftime(date_time, '%Y%m%d%H%M%S') || '_' || camera || '_' || angle || '_' || wavelength as luid, '/blob/(' || plant || ')--(' || strftime(date_time, '%Y-%m-%d %H_%M_%S') || ')--(' || experiment || ')--(' || camera || '-' || angle || ').png' as path from snap"))
def x8(spark, d):
    a = [F.col(n) for n in ("experiment", "plant", "date_time", "camera", "angle", "wavelength")]
    return fx.snap(spark, d).select("event_id", names.luid(*a).alias("luid"), names.snapshot_path(a[1], a[2], a[0], a[3], a[4], "/blob/").alias("path"))


@query("x10_utc_times", sql("snap", "select luid, upper(camera) as label, strftime(date_time - interval 2 hour, '%Y-%m-%d %H:%M:%S') as utc from snap"))
def x10(spark, d):
    local = F.concat(F.date_format("date_time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return fx.snap(spark, d).select("luid", F.upper(F.lower("camera")).alias("label"), F.date_format(F.to_timestamp(local), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("f2_equal_and_between", sql("snap", "select luid from snap where camera = 'view' and job_id between 2 and 4"))
def f2(spark, d):
    return c.select_snapshots(fx.snap(spark, d), {"camera": "view", "job_id": ("between", 2, 4)}, ["luid", "unknown"])


@query("o1_order", sql("snap", "select plant, camera, luid from snap order by plant desc, luid"))
def o1(spark, d):
    return c.select_snapshots(fx.snap(spark, d), {}, ["plant", "camera", "luid"], order_by=[F.desc("plant"), "luid"])


@query("x11_safe_name", "select p_partkey, regexp_replace(regexp_replace(p_name || ':' || p_type || '\"a\"', '[\"'']', '', 'g'), '[*/\\\\\\[\\]:;|=,<>]', '_', 'g') as safe, replace(replace(to_base64(unhex(sha1(p_name))), '+', '-'), '/', '_') as short from part")
def x11(spark, d):
    name = F.concat("p_name", F.lit(":"), "p_type", F.lit('"a"'))
    return t.table(spark, d, "part").select("p_partkey", names.safe_name(name).alias("safe"), names.short_hash(F.col("p_name")).alias("short"))


@query("x12_date_parts", sql("snap", "select event_id, strftime(date_time, '%Y') as year, strftime(date_time, '%m') as month, strftime(date_time, '%d') as day, strftime(date_time, '%H') as hour, strftime(date_time, '%M') as minute, strftime(date_time, '%S') as second, strftime(date_time, '%Y%m%d%H%M%S') as condensed from snap"))
def x12(spark, d):
    return fx.snap(spark, d).select("event_id", *[v.alias(k) for k, v in names.date_parts(F.col("date_time")).items()])


@query("x13_option_values", sql("snap", """p as (select distinct job_id, angle from snap), v as (select job_id, angle, unnest(list_transform(generate_series(0, 20, (job_id + 2)::int), lambda x: x::varchar)) as value from p union select job_id, angle, '7' from p union select job_id, angle, angle from p)
select job_id, angle, string_agg(value, ',' order by value) as options from (select distinct * from v) group by 1, 2"""))
def x13(spark, d):
    p = fx.snap(spark, d).select("job_id", "angle").distinct()
    text = F.concat(F.lit("0|20;"), (F.col("job_id") + 2).cast("string"), F.lit(", 7,"), "angle")
    return p.select("job_id", "angle", F.array_join(names.option_values(text), ",").alias("options"))


@query("x14_fill_missing", sql("snap annotations", "select coalesce(s.event_id::varchar, 'na') as event_id, coalesce(kind, 'na') as kind from snap s left join annotations using (event_id)"))
def x14(spark, d):
    return c.fill_missing(fx.snap(spark, d).join(fx.annotations(spark, d), "event_id", "left").select("event_id", "kind"))


@query("x15_elapsed", "select event_id, lpad(floor(ms / 3600000)::bigint::varchar, 2, '0') || ':' || lpad((floor(ms / 60000)::bigint % 60)::varchar, 2, '0') || ':' || lpad((floor(ms / 1000)::bigint % 60)::varchar, 2, '0') || '.' || lpad((ms % 1000)::varchar, 3, '0') as elapsed from (select event_id, (event_id * 37)::bigint as ms from events)")
def x15(spark, d):
    return t.table(spark, d, "events").select("event_id", names.elapsed(F.col("event_id") * 37 / 1000).alias("elapsed"))


@query("x17_ensure_odd", "select p_partkey, case when p_size % 2 = 0 then p_size + 1 else p_size end as size from part")
def x17(spark, d):
    return t.table(spark, d, "part").select("p_partkey", names.ensure_odd(F.col("p_size")).alias("size"))


LABELS = ("Brachy_Vis-Side225", "FLUO-Side45", "flutop-in", "Fluo-Side-In", "vis-side-R0", "GGT-Fluo-r90", "GGT-Vis-Top", "fluo-side-180", "fluo_sv", "fluo_tv", "fluoSideH1R0", "MSP1", "fluoTop", "fluo90", "topview")
SPLIT = (("vis", "side225"), ("fluo", "side45"), ("flu", "top"), ("fluo", "side0"), ("vis", "side0"), ("fluo", "side90"), ("vis", "top"), ("fluo", "side180"), ("fluo", "unk"), ("fluo", "top"), ("fluo", "side0"), ("msp", "unk"), ("fluo", "top"), ("fluo", "side90"), ("unk", "top"))
SPLIT = tuple(("fluo", v) if c_ == "flu" else (c_, v) for c_, v in SPLIT)


@query("x7_camera_label", sql("snap", "select event_id, " + ", ".join(f"case event_id % 15 {' '.join(f'when {k} then {chr(39)}{p[i]}{chr(39)}' for k, p in enumerate(SPLIT))} end as {n}" for i, n in enumerate(("camera", "view"))) + " from snap"))
def x7(spark, d):
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("event_id") % 15 + 1).cast("int"))
    return fx.snap(spark, d).select("event_id", names.camera_label(label).alias("l")).select("event_id", "l.camera", "l.view")


@query("b8_annotation_upsert", sql("annotations", """ch as (select event_id, 'edited' as kind, case when event_id % 4 = 0 then '' else 'new' end as text from annotations where event_id % 2 = 0)
select coalesce(ch.event_id, a.event_id) as event_id, case when ch.event_id is not null then ch.kind else a.kind end as kind, case when ch.event_id is not null then ch.text else a.text end as text
from annotations a full join ch using (event_id) where case when ch.event_id is not null then ch.text else a.text end <> ''"""))
def b8(spark, d):
    base = fx.annotations(spark, d)
    changes = base.filter("event_id % 2 = 0").select("event_id", F.lit("edited").alias("kind"), F.when(F.col("event_id") % 4 == 0, "").otherwise("new").alias("text"))
    return c.annotation_upsert(base, changes, "event_id")


@query("a31_observation_row", sql("snap", "select luid, split_part(luid, '_', 1) as experiment_name, split_part(luid, '_', 2) as plant_name, null::varchar as note from snap"))
def a31(spark, d):
    return c.observation_row(fx.snap(spark, d), "luid", ["experiment_name", "plant_name"], "_", ["note"]).select("luid", "experiment_name", "plant_name", "note")

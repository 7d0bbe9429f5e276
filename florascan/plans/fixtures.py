"""Image-campaign tables derived from the input tables, in Spark and as SQL of the same meaning.

px: pixels of ten images; tall: pixels without places, one image for each flag pair; snap: the snapshot catalogue; mask:
the pixels of px with medium green; features, annotations: rows of the feature and annotation tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from florascan.sources.tables import table


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, b, g, r), channels 0 to 255."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("p", "v")).filter("p < 63")
    level = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("v").cast("double") + 0.5) * 255))).cast("int")
    e = e.select("label", "vec_id", F.expr("cast(p div 3 as int)").alias("x"), (F.col("p") % 3).alias("c"), level.alias("u"))
    wide = e.groupBy("label", "vec_id", "x").agg(*[F.max(F.when(F.col("c") == k, F.col("u"))).alias(n) for k, n in enumerate("bgr")])
    y = (F.dense_rank().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("int")
    return wide.select(F.col("label").alias("image_id"), y.alias("y"), "x", "b", "g", "r")


def tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id string, b, g, r): one pixel for each line item."""

    def level(e: str):
        return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.expr(e)).cast("int")))

    return table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("image_id"), level("l_quantity * 5").alias("b"), level("l_extendedprice / 412").alias("g"), level("l_discount * 2550").alias("r"))


def snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot catalogue: one row for each event."""
    e = table(spark, sf_dir, "events").withColumn("date_time", F.date_trunc("second", F.col("ts").cast("timestamp")))
    e = e.withColumns({
        "experiment": F.concat(F.lit("exp"), (F.col("user_id") % 5).cast("string")),
        "plant": F.concat(F.lit("p"), F.lpad(F.col("user_id").cast("string"), 4, "0")),
        "angle": F.concat(F.lit("side"), (F.get_json_object("props", "$.k").cast("int") % 4 * 90).cast("string")),
        "wavelength": F.when(F.col("event_id") % 3 == 0, "sw755").otherwise(F.concat(F.lit("wl_"), (520 + 10 * (F.col("event_id") % 3)).cast("string"))),
        "job_id": F.col("event_id") % 7,
    }).withColumnRenamed("event_type", "camera")
    luid = F.concat_ws("_", "experiment", "plant", F.date_format("date_time", "yyyyMMddHHmmss"), "camera", "angle", F.col("event_id").cast("string"))
    path = F.concat(F.lit("/img/"), F.col("experiment"), F.lit("/("), F.col("plant"), F.lit(")--("), F.date_format("date_time", "yyyy-MM-dd HH_mm_ss"), F.lit(")--("), F.col("experiment"), F.lit(")--("), F.col("camera"), F.lit("-"), F.col("angle"), F.lit(").png"))
    return e.select("event_id", "experiment", "plant", "date_time", "camera", "angle", "wavelength", "job_id", luid.alias("luid"), path.alias("filepath"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).filter(F.col("g").between(100, 160)).select("image_id", "y", "x")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plant, day, measure)."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plant"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("measure"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, kind, text)."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), F.concat(F.lit("quality"), F.col("quality").cast("string")).alias("kind"), F.concat(F.lit("toxic"), F.col("toxic").cast("string")).alias("text"))


_CTE = {
    "px": """e0 as (select label, vec_id, unnest(embedding) v, generate_subscripts(embedding, 1) - 1 p from embeddings),
u0 as (select label, vec_id, p, cast(floor(greatest(0.0, least(255.0, (cast(v as double) + 0.5) * 255))) as int) u from e0 where p < 63),
px as (select label as image_id, cast(dense_rank() over (partition by label order by vec_id) - 1 as int) as y, cast(p // 3 as int) as x,
  max(case when p % 3 = 0 then u end) as b, max(case when p % 3 = 1 then u end) as g, max(case when p % 3 = 2 then u end) as r
  from u0 group by label, vec_id, p // 3)""",
    "mask": "mask as (select image_id, y, x from px where g between 100 and 160)",
    "tall": """tall as (select l_returnflag || l_linestatus as image_id, greatest(0, least(255, cast(floor(l_quantity * 5) as int))) as b,
  greatest(0, least(255, cast(floor(l_extendedprice / 412) as int))) as g, greatest(0, least(255, cast(floor(l_discount * 2550) as int))) as r from lineitem)""",
    "snap": """s0 as (select event_id, 'exp' || (user_id % 5) as experiment, 'p' || lpad(user_id::varchar, 4, '0') as plant, date_trunc('second', ts) as date_time, event_type as camera,
  'side' || ((cast(json_extract_string(props, '$.k') as int) % 4) * 90) as angle, case when event_id % 3 = 0 then 'sw755' else 'wl_' || (520 + 10 * (event_id % 3)) end as wavelength, event_id % 7 as job_id from events),
snap as (select *, experiment || '_' || plant || '_' || strftime(date_time, '%Y%m%d%H%M%S') || '_' || camera || '_' || angle || '_' || event_id as luid,
  '/img/' || experiment || '/(' || plant || ')--(' || strftime(date_time, '%Y-%m-%d %H_%M_%S') || ')--(' || experiment || ')--(' || camera || '-' || angle || ').png' as filepath from s0)""",
    "features": "features as (select o_custkey as plant, cast(o_orderdate as date) as day, o_totalprice as measure from orders)",
    "annotations": "annotations as (select doc_id as event_id, 'quality' || quality as kind, 'toxic' || toxic as text from labels)",
}
_NEEDS = {"mask": ("px", "mask")}


def sql(fixtures: str, body: str) -> str:
    """A statement over the named tables (separated by spaces); body may begin with further common tables and a comma."""
    names = list(dict.fromkeys(x for f in fixtures.split() for x in _NEEDS.get(f, (f,))))
    ctes = ",\n".join(_CTE[n] for n in names)
    body = body.strip()
    return f"with recursive {ctes}{',' if not body.lower().startswith('select') else ''}\n{body}"

"""Exact medians of groups of any size.

A group of up to ``LARGE`` rows is one task's work. Of larger groups a first pass takes the row count and a bracket of two
values from a mergeable quantile summary, whose rank error is bounded, so that the median surely lies between them. A second
pass counts, before any shuffle, the rows below the bracket and each distinct value within it, some few in ten thousand rows;
the median is the value in the bracket at which the counts reach the middle ranks. No task holds a group's values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from florascan.sources.storage import stored

LARGE = 1_000_000
#: The summary's ranks are off by one in so many rows at most; the bracket is twice as wide on either side.
ACCURACY = 10_000


def selected_medians(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, median) of the column v, by selection; nulls do not count, and keys compare with nulls."""
    ends = F.percentile_approx("v", [0.5 - 2 / ACCURACY, 0.5 + 2 / ACCURACY], ACCURACY)
    values = long.filter("v is not null").withColumn("__group", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    brackets = values.groupBy("__group").agg(*[F.any_value(k).alias(k) for k in keys], F.count(F.lit(1)).alias("n"), ends.alias("ends"))
    brackets = brackets.select("*", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high")).drop("ends")
    placed = values.select("__group", "v").join(brackets.select("__group", "low", "high"), "__group").filter("v <= high")
    counts = placed.groupBy("__group", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(W.partitionBy("__group").orderBy(F.asc_nulls_first("v")))
    ranked = counts.withColumn("upto", upto).join(brackets.select("__group", *keys, "n"), "__group").filter("v is not null")
    middle = [F.min(F.when(F.col("upto") > rank, F.col("v"))) for rank in (F.expr("(n - 1) div 2"), F.expr("n div 2"))]
    return ranked.groupBy("__group").agg(*[F.any_value(k).alias(k) for k in keys], ((middle[0] + middle[1]) / 2).alias("median")).drop("__group")


def median_by(df: DataFrame, keys: Sequence[Column | str], measures: Sequence[str], large: int = LARGE) -> DataFrame:
    """(keys, measures): the median of each measure; groups of more than ``large`` rows by selection."""
    plain = df.groupBy(*keys).agg(*[F.median(m).alias(m) for m in measures])
    names = plain.columns[: len(keys)]
    if df.limit(large + 1).count() <= large:
        return plain
    keyed = df.select(*[F.col(k) if isinstance(k, str) else k for k in keys], *[F.col(m).cast("double").alias(f"__{k}") for k, m in enumerate(measures)]).toDF(*names, *[f"__{k}" for k in range(len(measures))])
    group = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    huge = stored(keyed.groupBy(group.alias("__huge")).count().filter(F.col("count") > large).select("__huge"), "large-groups")
    if huge.isEmpty():
        return plain
    keyed = keyed.withColumn("__own", group)
    small = keyed.join(F.broadcast(huge), F.col("__own") == F.col("__huge"), "left_anti").groupBy(*names).agg(*[F.median(f"__{k}").alias(m) for k, m in enumerate(measures)])
    many = keyed.join(F.broadcast(huge), F.col("__own") == F.col("__huge"), "left_semi")  # one row for each ``large`` rows of df at most
    long = many.select(*names, F.expr(f"stack({len(measures)}, {', '.join(f'{k}, `__{k}`' for k in range(len(measures)))}) as (`__measure`, v)"))
    each = selected_medians(long, [*names, "__measure"])
    joined = each.groupBy(*names).agg(*[F.max(F.when(F.col("__measure") == k, F.col("median"))).alias(m) for k, m in enumerate(measures)])
    return small.unionByName(joined)

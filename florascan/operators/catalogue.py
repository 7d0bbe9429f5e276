"""Selecting, linking, counting and annotating snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import NumericType

from florascan.operators.medians import LARGE, median_by

# --- filters ---------------------------------------------------------------------------------------------------------


def where_clause(df: DataFrame, where: Mapping) -> Column:
    """One condition of all pairs: a value, ("between", a, b), ("in", [...]); None means no filter; names compare without case.

    An unknown column or operator is an error.
    """
    names = {c.lower(): c for c in df.columns}
    out = F.lit(True)
    for key, value in where.items():
        if value is None:
            continue
        if key.lower() not in names:
            raise ValueError(f"no column {key}")
        col = F.col(names[key.lower()])
        if isinstance(value, tuple):
            if value[0] == "between":
                out = out & col.between(value[1], value[2])
            elif value[0] == "in":
                out = out & col.isin(list(value[1]))
            else:
                raise ValueError(f"no operator {value[0]}")
        else:
            out = out & (col == value)
    return out


def select_snapshots(df: DataFrame, where: Mapping | None = None, columns: Sequence[str] | None = None, distinct: bool = False, order_by: Sequence[Column | str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows that meet every condition; columns the table lacks are left out."""
    out = df.filter(where_clause(df, where or {}))
    if columns is not None:
        names = {c.lower(): c for c in df.columns}
        out = out.select(*[names[c.lower()] for c in columns if c.lower() in names])
    out = out.distinct() if distinct else out
    out = out.orderBy(*order_by) if order_by else out
    return out.limit(limit) if limit is not None else out


def in_list(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """IN with a long list: a semi join with a table of values."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def same_text(col: Column, value: str) -> Column:
    """Equality without case."""
    return F.lower(col) == value.lower()


def any_mask(masks: Sequence[Mapping[str, Sequence[str]]]) -> Column:
    """True where a row meets every key of at least one mask; texts compare in lower case.

    A key named * and one whose values hold * are jokers, met by every row. A null meets no key, so the answer is never null.
    """

    def meets(key: str, values: Sequence[str]) -> Column:
        return F.coalesce(F.lower(F.col(key)).isin([v.lower() for v in values]), F.lit(False))

    each = [reduce(lambda a, b: a & b, [meets(k, values) for k, values in m.items() if k != "*" and "*" not in values], F.lit(True)) for m in masks]
    return reduce(lambda a, b: a | b, each, F.lit(False))


def mask_filter(df: DataFrame, include: Sequence[Mapping] = (), exclude: Sequence[Mapping] = (), post: Sequence[Mapping] = (), force: Sequence[Mapping] = (), cut_at: date | None = None, ts: str = "date_time") -> DataFrame:
    """Rows that a mask includes and none excludes, then the post masks, then forced rows, then the last date."""
    keep = any_mask(include) if include else F.lit(True)
    keep = keep & ~any_mask(exclude)
    if post:
        keep = keep & any_mask(post)
    keep = keep | any_mask(force)
    return df.filter(keep & (F.to_date(ts) <= F.lit(cut_at))) if cut_at else df.filter(keep)


def seconds_of_day(t: Column) -> Column:
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def compare_ts(t: Column, part: str, op: str, value) -> Column:
    """part: date, time (value in seconds of the day) or timestamp; op: at, before, after."""
    left = {"date": F.to_date(t), "time": seconds_of_day(t), "timestamp": t}[part]
    right = F.lit(value).cast({"date": "date", "time": "int", "timestamp": "timestamp"}[part])
    return {"at": left == right, "before": left < right, "after": left > right}[op]


def _between(value: Column, start, end, include_start: bool, include_end: bool) -> Column:
    low = value >= start if include_start else value > start
    return low & (value <= end if include_end else value < end)


def between_dates(t: Column, start: date, end: date, include_start: bool = True, include_end: bool = False) -> Column:
    return _between(F.to_date(t), F.lit(start).cast("date"), F.lit(end).cast("date"), include_start, include_end)


def between_times(t: Column, start: int, end: int, include_start: bool = True, include_end: bool = False) -> Column:
    """start and end in seconds of the day."""
    return _between(seconds_of_day(t), start, end, include_start, include_end)


def camera_kind(camera: Column, kinds: Sequence[str] = ("vis", "fluo", "nir", "msp", "cf")) -> Column:
    """The first kind that the camera's name contains, else unknown."""
    out = F.lit("unknown")
    for kind in reversed(kinds):
        out = F.when(F.lower(camera).contains(kind), kind).otherwise(out)
    return out


def condition_flags(rules: Mapping[str, Column]) -> dict[str, Column]:
    """Acquisition flags from named conditions; null counts as false."""
    return {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}


def filters_match(where: Mapping[str, str]) -> Column:
    """The execution filter of a group: "v1,v2" for each attribute; an empty one passes."""
    conditions = [F.col(k).isin([v.strip() for v in values.split(",")]) for k, values in where.items() if values.strip()]
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def not_done(df: DataFrame, done: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Rows without a stored result."""
    return df if overwrite else df.join(done.select(key).distinct(), key, "left_anti")


# --- selections ------------------------------------------------------------------------------------------------------


def edit_selection(selection: DataFrame, other: DataFrame, key: str = "luid", mode: str = "add") -> DataFrame:
    """add keeps duplicates; keep and remove go by key."""
    if mode == "add":
        return selection.unionByName(other, allowMissingColumns=True)
    return selection.join(other.select(key).distinct(), key, {"keep": "left_semi", "remove": "left_anti"}[mode])


def _draw(key: str, seed: int) -> Column:
    """A place in a seeded order that every engine with MD5 draws alike."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def random_rows(df: DataFrame, n: int, key: str, seed: int = 0, order_by: Sequence[str] = ()) -> DataFrame:
    """n rows drawn by a seeded hash of the key, which every run draws alike; sorted again."""
    drawn = df.orderBy(_draw(key, seed), key).limit(n)
    return drawn.orderBy(*order_by) if order_by else drawn


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(_draw(key, seed), key)


def natural_order(col: Column) -> list[Column]:
    """Text before the first number, the number, the text."""
    return [F.regexp_extract(col, r"^(\D*)", 1), F.regexp_extract(col, r"^\D*(\d{1,18})", 1).try_cast("bigint"), col]


# --- counts ----------------------------------------------------------------------------------------------------------


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key, value, n) for each key: one pass with grouping sets."""
    texts = df.select(*[F.col(k).cast("string").alias(k) for k in keys])
    sets = texts.groupingSets([[F.col(k)] for k in keys], *keys).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(k).alias(f"__{k}") for k in keys])
    key, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in keys:
        key, value = F.when(F.col(f"__{k}") == 0, k).otherwise(key), F.when(F.col(f"__{k}") == 0, F.col(k)).otherwise(value)
    return sets.select(key.alias("key"), value.alias("value"), "n")


def describe(df: DataFrame, columns: Sequence[str], large: int = LARGE) -> DataFrame:
    """(name, n, n_distinct, top, freq, mean, std, least, median, greatest), one row for each column.

    top and freq, the most frequent value (the least of several) and its rows, are those of columns that are not numbers; the
    others those of numbers. Values are counted before they are shuffled and dealt by column and value; medians are exact.
    """
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, NumericType)]
    texts = [c for c in columns if c not in numeric]

    def long(names: Sequence[str], kind: str) -> DataFrame:
        pairs = ", ".join(f"'{c}', cast(`{c}` as {kind})" for c in names)
        return df.select(F.expr(f"stack({len(names)}, {pairs}) as (name, v)"))

    empty = {"top": "string", "freq": "bigint", "mean": "double", "std": "double", "least": "double", "median": "double", "greatest": "double"}
    parts = []
    if numeric:
        v = long(numeric, "double")
        figures = v.groupBy("name").agg(F.count("v").alias("n"), F.countDistinct("v").alias("n_distinct"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("greatest"))
        parts.append(figures.join(median_by(v, ["name"], ["v"], large).withColumnRenamed("v", "median"), "name", "left"))
    if texts:
        values = long(texts, "string").groupBy("name", "v").agg(F.count(F.lit(1)).alias("m"))
        own = F.col("v").isNotNull()
        parts.append(values.groupBy("name").agg(F.coalesce(F.sum(F.when(own, F.col("m"))), F.lit(0)).alias("n"), F.count("v").alias("n_distinct"), F.min_by("v", F.when(own, F.struct(-F.col("m"), "v"))).alias("top"), F.max(F.when(own, F.col("m"))).alias("freq")))
    full = [p.withColumns({c: F.lit(None).cast(kind) for c, kind in empty.items() if c not in p.columns}) for p in parts]
    return reduce(lambda a, b: a.unionByName(b), full).select("name", "n", "n_distinct", *empty)


def annotation_stats(selection: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """(kind, n, percent) over the selection; rows without annotation count as none."""
    n = selection.join(annotations, key, "left").groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))


def annotation_upsert(base: DataFrame, changes: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Changes win over base; an empty text deletes."""
    names = [c for c in base.columns if c != key]
    b, c = base.select(key, F.lit(True).alias("__b"), *[F.col(n).alias(f"__b_{n}") for n in names]), changes.select(key, F.lit(True).alias("__c"), *names)
    both = b.join(c, key, "full")
    merged = both.select(key, *[F.when(F.col("__c"), F.col(n)).otherwise(F.col(f"__b_{n}")).alias(n) for n in names])
    return merged.filter(F.coalesce(F.col(text), F.lit("")) != "")


def annotation_sheet(df: DataFrame, series: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The first row of each series with an empty disease_index, nulls first."""
    first = df.groupBy(series).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__row"))
    return first.select("__row.*", F.lit("").alias("disease_index")).orderBy(*[F.asc_nulls_first(c) for c in columns])


FRONT = ("experiment", "plant", "genotype", "condition", "date_time", "camera", "angle", "wavelength", "luid", "source_path", "area")


def merge_results(parts: Sequence[DataFrame], front: Sequence[str] = FRONT) -> DataFrame:
    """All partial results, key columns first, by plant and time with nulls first."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    first = [c for c in front if c in out.columns]
    order = [F.asc_nulls_first(c) for c in ("plant", "date_time") if c in out.columns]
    return out.select(*first, *[c for c in out.columns if c not in first]).orderBy(*order)


def fill_missing(df: DataFrame, value: str = "na") -> DataFrame:
    """All columns as text, with a word for what is missing."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(value)).alias(c) for c in df.columns])


def aggregate_by(df: DataFrame, keys: Sequence[Column | str], measures: Sequence[str], how: str = "median") -> DataFrame:
    """Median or mean of the measures: by series, by day or hour (pass the truncated time as a key)."""
    if how == "median":
        return median_by(df, keys, measures)
    return df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures])


def with_group_median(df: DataFrame, keys: Sequence[str], measure: str, name: str) -> DataFrame:
    """Each row with the median of its group."""
    return df.join(median_by(df, keys, [measure]).withColumnRenamed(measure, name), list(keys))


def observation_row(df: DataFrame, plant: str, names: Sequence[str], separator: str, empty: Sequence[str] = ()) -> DataFrame:
    """The plant's name split into columns, and columns to be filled by hand."""
    parts = F.split(F.col(plant), separator)
    return df.withColumns({n: F.get(parts, F.lit(k)) for k, n in enumerate(names)} | {e: F.lit(None).cast("string") for e in empty})

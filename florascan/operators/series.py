"""Snapshots in time: anchored series, siblings within an interval, earlier observations."""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType, StructField, StructType

from florascan.sources.storage import stored


def _successors(t: np.ndarray, limit: int) -> np.ndarray:
    """For each row of ascending times the first row at least limit later; the number of rows where there is none."""
    return np.searchsorted(t, t + limit)


def _last_anchors(t: np.ndarray, limit: int) -> np.ndarray:
    """For each row, taken as an anchor, the last anchor of the chain that it begins: pointers doubled until they stand."""
    after = _successors(t, limit)
    at = np.where(after < len(t), after, np.arange(len(t)))
    while True:
        further = at[at]
        if (further == at).all():
            return at
        at = further


def _provisional(columns: Sequence[str], name: str, limit: int):
    """Series of sorted rows, each key taken as if it began in its partition; open: the partition's first key."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = anchor = label = None
        runs = 0
        for batch in batches:
            names, anchors, opened = [], [], []
            for k, t, own in zip(*(batch.column(c).to_pylist() for c in ("__key", "__t", "__luid"))):
                if k != key:
                    key, anchor, runs = k, None, runs + 1
                if anchor is None or t - anchor >= limit:
                    anchor, label = t, own
                names.append(label)
                anchors.append(anchor)
                opened.append(runs == 1)
            kept = [batch.column(c) for c in (*columns, "__key", "__t", "__luid", "__part")]
            made = [pa.array(names, pa.string()), pa.array(anchors, pa.int64()), pa.array(opened, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*columns, "__key", "__t", "__luid", "__part", name, "__anchor", "__open"])

    return assign


def _passages(limit: int):
    """What a partition's first key makes of the anchor before it, as a step function.

    From a time on (``from``, ascending) at which rows may begin a series, the last anchor and its luid; past the last step the
    anchor before it stays. An anchor before the partition reaches into it by less than limit, so later rows are no steps.
    """

    def passage(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("__t", "ascending"), ("__luid", "ascending")])
        t, luid = rows["__t"].to_numpy(), rows["__luid"].to_pylist()
        last = _last_anchors(t, limit)
        steps = np.arange(min(len(t), int(np.searchsorted(t, t[0] + limit)) + 1))
        steps = steps[np.append(t[steps[1:]] != t[steps[:-1]], True)] if len(steps) > 1 else steps
        first = np.searchsorted(t, t[steps])  # of rows of one time the first begins the series
        ends = last[first]
        kept = np.append(ends[1:] != ends[:-1], True)
        own = pa.table({"part": [rows["__part"][0].as_py()], "key": [rows["__key"][0].as_py()], "begin": [False], "from": [t[steps[kept]].tolist()], "anchors": [t[ends[kept]].tolist()], "luids": [[luid[k] for k in ends[kept]]]})
        return own.cast(pa.schema([("part", pa.int32()), ("key", pa.string()), ("begin", pa.bool_()), ("from", pa.list_(pa.int64())), ("anchors", pa.list_(pa.int64())), ("luids", pa.list_(pa.string()))]))

    return passage


PASSAGE = "part int, key string, begin boolean, from array<long>, anchors array<long>, luids array<string>"


def _carried(limit: int):
    """The anchor that each partition's first key comes with: a key's partitions are read in order, one at a time."""

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = anchor = luid = None
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if r["key"] != key:
                    key, anchor, luid = r["key"], None, None
                if anchor is not None and not r["begin"]:
                    out.append((r["part"], anchor, luid))
                at = 0 if anchor is None else bisect.bisect_left(r["from"], anchor + limit)
                if at < len(r["from"]):
                    anchor, luid = r["anchors"][at], r["luids"][at]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.string()))], names=["__part", "__came", "__came_luid"])

    return carry


def _corrected(columns: Sequence[str], name: str, limit: int):
    """The rows of a partition's first key with the series that follow from the anchor it came with."""

    def correct(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("__t", "ascending"), ("__luid", "ascending")])
        t, luid = rows["__t"].to_numpy(), rows["__luid"].to_pylist()
        after, at = _successors(t, limit), int(np.searchsorted(t, rows["__came"][0].as_py() + limit))
        anchors = []
        while at < len(t):
            anchors.append(at)
            at = int(after[at])
        own = np.searchsorted(np.array(anchors, dtype=np.int64), np.arange(len(t)), side="right") - 1
        came = rows["__came_luid"][0].as_py()
        labels = [came if k < 0 else luid[anchors[k]] for k in own]
        return pa.table([*[rows[c] for c in columns], pa.array(labels, pa.string())], names=[*columns, name])

    return correct


def series_id(df: DataFrame, keys: Sequence[str], ts: str, luid: str, delta_minutes: float, name: str = "series_id", partitions: int | None = None) -> DataFrame:
    """Each row with the id of its series: the luid of the series' first row.

    A row belongs to the series as long as it is less than delta_minutes after the series' *first* row, so that a chain
    of close rows does not grow for ever. Ties go by luid. A row without a time is a series of its own; repeated and null
    luids stay as they are.

    Rows are dealt by ranges of key and time, so a key with a third of all rows spreads over many tasks. Each task works out
    the series of its keys; only of its first key it cannot know the anchor before it. For that key it gives a step function
    from such an anchor to its last one, found by doubled successor links. These functions, one a partition, are followed in
    order, and the rows of keys that do come from an earlier partition are assigned once more.
    """
    base = df.drop(name)
    columns, limit = base.columns, int(delta_minutes * 60_000_000)
    timed = base.withColumns({"__t": F.unix_micros(F.col(ts).cast("timestamp")), "__key": F.to_json(F.struct(*keys)), "__luid": F.col(luid).cast("string")})
    untimed = timed.filter("__t is null").select(*columns, F.col("__luid").alias(name))
    order = ["__key", "__t", "__luid"]
    ranged = timed.filter("__t is not null").repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    extra = "__key string, __t long, __luid string, __part int"
    schema = StructType([*base.schema.fields, *StructType.fromDDL(extra).fields, StructField(name, StringType()), *StructType.fromDDL("__anchor long, __open boolean").fields])
    local = stored(ranged.withColumn("__part", F.spark_partition_id()).mapInArrow(_provisional(columns, name, limit), schema), "series")
    done = local.select(*columns, name)

    latest = F.max_by(F.struct("__key", F.col("__anchor").alias("anchor"), F.col(name).alias("luid"), F.col("__open").alias("open")), F.struct(*order)).alias("last")
    edges = local.groupBy("__part").agg(latest, F.min("__key").alias("first")).collect()  # a row for each partition
    often = Counter(key for e in edges for key in {e["first"], e["last"]["__key"]})
    crossing = [(key,) for key, n in often.items() if n > 1]  # a key for each border between partitions at most
    if not crossing:
        return done.unionByName(untimed)
    spark = df.sparkSession
    of_crossing = local.filter("__open").join(F.broadcast(spark.createDataFrame(crossing, "key string")), F.col("__key") == F.col("key"), "left_semi")
    functions = of_crossing.select("__part", "__key", "__t", "__luid").groupBy("__part").applyInArrow(_passages(limit), PASSAGE)
    ends = [(e["__part"], e["last"]["__key"], True, [e["last"]["anchor"]], [e["last"]["anchor"]], [e["last"]["luid"]]) for e in edges if not e["last"]["open"]]
    begins = spark.createDataFrame(ends, PASSAGE)
    path = functions.unionByName(begins).repartition("key").sortWithinPartitions("key", "part", "begin")
    came = stored(path.mapInArrow(_carried(limit), "__part int, __came long, __came_luid string"), "series-came")
    again = of_crossing.join(F.broadcast(came), "__part")  # a row for each partition at most
    fixed = again.groupBy("__part").applyInArrow(_corrected(columns, name, limit), StructType([*base.schema.fields, StructField(name, StringType())]))
    rest = local.join(F.broadcast(came.select("__part", F.lit(True).alias("__open"))), ["__part", "__open"], "left_anti").select(*columns, name)
    return rest.unionByName(fixed).unionByName(untimed)


def series_sizes(df: DataFrame, series: str) -> DataFrame:
    """(size, n_series): how many series have how many rows."""
    return df.groupBy(series).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_series"))


def linked_images(df: DataFrame, keys: Sequence[str], ts: str, id_column: str, others: Sequence[str] = (), tolerance_seconds: int = 3600) -> DataFrame:
    """Pairs of rows with equal keys at most tolerance_seconds apart: (id, linked_id, others of the linked row).

    Rows meet in buckets as wide as the tolerance, each in its own and one of the two beside it: a key with many rows
    is compared bucket by bucket.
    """
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000
    own = F.floor(seconds / tolerance_seconds)
    left = df.select(*keys, F.col(id_column), seconds.alias("__t"), F.explode(F.array(own - 1, own, own + 1)).alias("__bucket"))
    right = df.select(*keys, F.col(id_column).alias(f"linked_{id_column}"), *[F.col(c).alias(f"linked_{c}") for c in others], seconds.alias("__u"), own.alias("__bucket"))
    near = left.join(right, [*keys, "__bucket"]).filter((F.abs(F.col("__t") - F.col("__u")) <= tolerance_seconds) & (F.col(id_column) != F.col(f"linked_{id_column}")))
    return near.select(id_column, f"linked_{id_column}", *[f"linked_{c}" for c in others])


def available_channels(links: DataFrame, id_column: str, channel: str) -> DataFrame:
    return links.groupBy(id_column).agg(F.array_sort(F.collect_set(channel)).alias("channels"))


def first_sibling(links: DataFrame, id_column: str, channel_column: str, channel: str, linked: str) -> DataFrame:
    """The first linked row that has the channel."""
    return links.filter(F.col(channel_column) == channel).groupBy(id_column).agg(F.min(linked).alias(linked))


def previous_observation(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(column).over(W.partitionBy(*keys).orderBy(*order)))


def keep_latest(df: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """The latest row of each key; of ties the one that comes first by tie."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(ts), F.asc(tie)))
    return df.withColumn("__at", at).filter("__at = 1").drop("__at")

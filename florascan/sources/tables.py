"""Reading and writing campaign tables: catalogues, image lists, partial results, pixels and sheets."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.utils import AnalysisException

from florascan.sources.storage import stored

IMAGE_TYPES = ("jpg", "jpeg", "tif", "tiff", "png", "bmp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_images(spark: SparkSession, folder: str, types: Sequence[str] = IMAGE_TYPES) -> DataFrame:
    """(path, modificationTime, length) of the image files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "modificationTime", "length").filter(F.lower("path").rlike(rf"\.({'|'.join(types)})$"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, channels, data, error) of every file below a folder, decoded by Spark's image source.

    A file that cannot be decoded is a row with an error and no data; it is not lost, and the job goes on. Files without a
    byte have no row: Spark's readers, the one of ``scan_images`` too, do not list them.
    """
    image = F.col("image")
    files = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(folder)
    broken = (image["height"] <= 0) | (image["width"] <= 0) | image["data"].isNull()
    good = {c: F.when(~broken, image[f]).alias(c) for c, f in (("height", "height"), ("width", "width"), ("channels", "nChannels"), ("data", "data"))}
    return files.select(image["origin"].alias("path"), *good.values(), F.when(broken, "cannot be decoded").alias("error"))


def read_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(path, y, x, b, g, r) of all images below a folder; those that cannot be decoded have none (see read_images)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            for path, height, width, channels, data in zip(batch["path"], batch["height"], batch["width"], batch["channels"], batch["data"]):
                plane = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
                plane = np.repeat(plane, 3, axis=2) if channels == 1 else plane[:, :, :3]
                band = max(1, 200_000 // max(1, width))
                for top in range(0, height, band):  # bands bound what one batch holds
                    part = plane[top : top + band].astype("int32")
                    y, x = np.mgrid[top : top + part.shape[0], 0:width]
                    yield pd.DataFrame({"path": path, "y": y.ravel(), "x": x.ravel(), "b": part[:, :, 0].ravel(), "g": part[:, :, 1].ravel(), "r": part[:, :, 2].ravel()})

    decoded = read_images(spark, folder).filter("error is null").drop("error")
    return decoded.mapInPandas(rows, "path string, y int, x int, b int, g int, r int")


def pixels_from_arrays(df: DataFrame, image: Column, row: Column, values: Column, channels: Sequence[str] = ("b", "g", "r")) -> DataFrame:
    """(image_id, y, x, channels): each row of df is a scanline whose numbers interleave the channels."""
    n = len(channels)
    flat = df.select(image.alias("image_id"), row.alias("y"), F.posexplode(values).alias("p", "v"))
    flat = flat.withColumn("x", F.expr(f"cast(p div {n} as int)"))
    return flat.groupBy("image_id", "y", "x").agg(*[F.max(F.when(F.col("p") % n == k, F.col("v"))).alias(c) for k, c in enumerate(channels)])


def read_image_list(spark: SparkSession, path: str) -> DataFrame:
    """(path): one for each line that is not blank."""
    return spark.read.text(path).select(F.trim("value").alias("path")).filter("path <> ''")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first by order."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__first", first).filter("__first = 1").drop("__first")


def read_catalogue(spark: SparkSession, path: str, schema: str, key: str = "luid") -> DataFrame:
    """A catalogue from CSV, the first row of each key in file order."""
    rows = spark.read.csv(path, header=True, schema=schema).withColumn("__at", F.monotonically_increasing_id())
    return keep_first(rows, [key], [F.col("__at")]).drop("__at")


def add_new(catalogue: DataFrame, found: DataFrame, key: str = "luid", order: Sequence[Column] = ()) -> DataFrame:
    """The catalogue and, of the found rows, the first of each key that it lacks (by order, else as they come).

    Keys compare as the catalogue's primary key does; a null counts as a key like any other.
    """
    known = catalogue.select(F.col(key).alias("__known")).distinct()
    new = found.join(known, F.col(key).eqNullSafe(F.col("__known")), "left_anti").withColumn("__at", F.monotonically_increasing_id())
    return catalogue.unionByName(keep_first(new, [key], [*order, F.col("__at")]).drop("__at"), allowMissingColumns=True)


def relational_catalogue(parts: DataFrame, links: DataFrame, groups: DataFrame, items: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """The equi-join of a four-table store: on has the column pairs that link each table to those before it."""
    out = parts
    for other, (left, right) in zip((links, groups, items), on):
        out = out.join(other, F.col(left) == F.col(right))
    return out


def list_experiments(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).distinct().orderBy(name)


def cached_catalogue(spark: SparkSession, path: str, build, reset: bool = False) -> DataFrame:
    """The catalogue kept at path; built and written if it is not there or reset is set."""
    if not reset:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_partial_results(spark: SparkSession, folders: Sequence[str], pattern: str = "*_result.csv") -> DataFrame:
    """All partial results below the folders as text columns, each file read by the header that it carries.

    Columns are aligned by name (without case, the first spelling counts); what a file lacks is null there. Of a name that
    a header repeats the first column counts. Columns come in the order of the files' paths. Files meet their headers by a
    join on the path, so neither paths nor rows pass through the driver; the distinct headers do. Empty files count nowhere.
    """
    lines = spark.read.text(list(folders), recursiveFileLookup=True, pathGlobFilter=pattern)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = stored(lines.select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value").filter(F.trim("value") != ""), "partial-results")
    first = lines.groupBy("file").agg(F.min("place").alias("first"), F.min_by("value", "place").alias("header"))
    headers = first.groupBy("header").agg(F.min("file").alias("file")).orderBy("file", "header").collect()
    parsed = [[name.strip() for name in next(csv.reader([r.header]))] for r in headers]
    names = {name.lower(): name for own in reversed(parsed) for name in reversed(own)}
    order = list(dict.fromkeys(name.lower() for own in parsed for name in own))
    width = max(map(len, parsed), default=1)

    def fields(line: Column) -> Column:
        row = F.from_csv(line, ", ".join(f"c{k} string" for k in range(width)))
        return F.array(*[row[f"c{k}"] for k in range(width)])

    named = first.select("file", "first", F.transform(fields(F.col("header")), lambda name: F.lower(F.trim(name))).alias("names"))
    rows = lines.join(named, "file").filter(F.col("place") != F.col("first")).select("names", fields(F.col("value")).alias("values"))
    at = {name: F.array_position("names", name).cast("int") for name in order}
    return rows.select(*[F.when(at[name] > 0, F.get("values", at[name] - 1)).alias(names[name]) for name in order])


def sheet_columns(df: DataFrame) -> DataFrame:
    """Names with _ for -, text without commas: what an unquoted sheet can hold."""
    kinds = dict(df.dtypes)
    return df.select([(F.regexp_replace(c, ",", " ") if kinds[c] == "string" else F.col(c)).alias(c.replace("-", "_")) for c in df.columns])


def write_sheet(df: DataFrame, path: str, single: bool = False) -> None:
    """A CSV sheet; a single file only where the sheet is known to be small."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, quote="", emptyValue="")


def normalise_external(df: DataFrame, prefix: str = "") -> DataFrame:
    """An external catalogue under this one's names: lower-case columns and keys, wavelength and angle with fallbacks, path without prefix."""
    df = df.toDF(*[c.lower() for c in df.columns])

    def there(*names: str) -> list[Column]:
        return [F.col(n) for n in names if n in df.columns]

    out = {"wavelength": F.lower(F.coalesce(*there("wavelength", "view_option"), F.lit(None))), "angle": F.coalesce(*there("angle"), F.lit("top"))}
    out |= {c: F.lower(c) for c in ("experiment", "plant", "camera") if c in df.columns}
    if "filepath" in df.columns and prefix:
        out["filepath"] = F.when(F.col("filepath").startswith(prefix), F.expr(f"substring(filepath, {len(prefix) + 1})")).otherwise(F.col("filepath"))
    if "date_time" in df.columns:
        out["date_time"] = F.date_trunc("second", F.to_timestamp("date_time"))
    return df.withColumns(out)


def write_images(df: DataFrame, path: str, key: str = "image_id") -> None:
    """Derived pixels, one folder for each image."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).parquet(path)


#: Rows of an image that a bucket holds together: an image of any height spreads over buckets.
LAYOUT_ROWS = 256
LAYOUT_KEYS = ("image_id", "band")


def save_layout(px: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """px as a table bucketed by image and band of rows and sorted by place, read back with its column band.

    Windows and groups by image and band form without a shuffle, and so do joins of two tables of one layout (and one number of
    buckets) by image, band and place in a session that lets joins use fewer keys than they compare (``use_layouts``). A filter
    on images reaches the files' statistics, as images are sorted.
    """
    banded = px.withColumn("band", F.floor(F.col("y") / LAYOUT_ROWS).cast("int"))
    writer = banded.repartition(buckets, *LAYOUT_KEYS).write.format("parquet").option("path", path).mode("overwrite")
    writer.bucketBy(buckets, *LAYOUT_KEYS).sortBy(*LAYOUT_KEYS, "y", "x").saveAsTable(name)
    return px.sparkSession.table(name)


def use_layouts(spark: SparkSession, on: bool = True) -> None:
    """Let joins of this session rely on tables that are dealt by some of the join's keys."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", str(not on).lower())


def join_layouts(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Two tables of one layout joined by place, where they lie."""
    return left.join(right.hint("merge"), [*LAYOUT_KEYS, "y", "x"], how)


def image_path(folder: str, *parts: Column, extension: str = "png") -> Column:
    """Where a derived image goes: folder, then the parts joined by _."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.concat_ws("_", *[p.cast("string") for p in parts]), F.lit("." + extension))

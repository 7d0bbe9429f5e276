"""Perspective: four dots found in a mask become the corners of an upright image."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florascan.operators.objects import label_objects
from florascan.operators.pixels import IMAGE

CORNERS = ("top_left", "top_right", "bottom_right", "bottom_left")
#: Coordinates further out than this have no pixel.
FAR = 1e9


def dots(mask: DataFrame, low: int = 30, high: int = 3000) -> DataFrame:
    """(image_id, label, cy, cx) of objects of low to high pixels: the mean of their places, rounded down."""
    found = label_objects(mask).groupBy(IMAGE, "label").agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg("y")).alias("cy"), F.floor(F.avg("x")).alias("cx"))
    return found.filter(F.col("n").between(low, high)).drop("n")


def corners(found: DataFrame, px: DataFrame) -> DataFrame:
    """(image_id, and cy and cx of each corner): the dot nearest to each corner of its image, on ties the upper and left one.

    Images without dots have no row; a dot may be nearest to several corners.
    """
    size = px.groupBy(IMAGE).agg((F.max("y") + 1).alias("__h"), (F.max("x") + 1).alias("__w"))
    zero, dy, dx = F.lit(0), F.col("__h") - F.col("cy"), F.col("__w") - F.col("cx")
    origin = {"top_left": (zero, zero), "top_right": (zero, dx), "bottom_right": (dy, dx), "bottom_left": (dy, zero)}

    def nearest(corner: str) -> Column:
        bottom, right = origin[corner]
        y, x = F.col("cy") if bottom is zero else bottom, F.col("cx") if right is zero else right
        return F.min(F.struct((y * y + x * x).alias("d"), F.col("cy").alias("y"), F.col("cx").alias("x"))).alias(corner)

    near = found.join(size, IMAGE).groupBy(IMAGE).agg(*[nearest(c) for c in CORNERS])
    return near.select(IMAGE, *[F.col(c)[at].alias(f"{c}_{at}") for c in CORNERS for at in ("y", "x")])


def projection(quads: DataFrame) -> DataFrame:
    """(image_id, a to h) of the projection that takes the unit square to each image's quadrilateral (Heckbert, 1989).

    x = (a s + b t + c) / (g s + h t + 1), y = (d s + e t + f) / (g s + h t + 1). Quadrilaterals with three corners on a line
    at the bottom right have none; their rows are left out.
    """
    x, y = ([F.col(f"{c}_{at}").cast("double") for c in CORNERS] for at in ("x", "y"))
    sides = {"dx1": x[1] - x[2], "dx2": x[3] - x[2], "dy1": y[1] - y[2], "dy2": y[3] - y[2], "sx": x[0] - x[1] + x[2] - x[3], "sy": y[0] - y[1] + y[2] - y[3]}
    q = quads.withColumns(sides).withColumn("den", F.expr("dx1 * dy2 - dx2 * dy1")).filter("den <> 0")
    q = q.withColumns({"g": F.expr("(sx * dy2 - dx2 * sy) / den"), "h": F.expr("(dx1 * sy - sx * dy1) / den")})
    g, h = F.col("g"), F.col("h")
    return q.select(
        IMAGE, (x[1] - x[0] + g * x[1]).alias("a"), (x[3] - x[0] + h * x[3]).alias("b"), x[0].alias("c"),
        (y[1] - y[0] + g * y[1]).alias("d"), (y[3] - y[0] + h * y[3]).alias("e"), y[0].alias("f"), "g", "h",
    )


def fix_perspective(px: DataFrame, quads: DataFrame, width: int, height: int, channels: Sequence[str] = ("b", "g", "r"), method: str = "linear") -> DataFrame:
    """(image_id, y, x, channels): width x height places an image, on which the quadrilateral's corners are the corners.

    Each place looks up its source: the nearest pixel, or the weighted four around it (``linear``), rounded half up. Missing
    pixels and nulls count as 0. Images without a row in quads or without a projection are left out. A place occurs once in px.
    The places are dealt by image and row, then meet the pixels by one equi-join.
    """
    if method not in ("linear", "nearest"):
        raise ValueError("method is linear or nearest")
    rows = projection(quads).withColumn("__v", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).repartition(IMAGE, "__v")
    places = rows.withColumn("__u", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    places = places.withColumns({"s": F.col("__u") / F.lit(float(max(width - 1, 1))), "t": F.col("__v") / F.lit(float(max(height - 1, 1)))})
    places = places.withColumn("w", F.expr("g * s + h * t + 1")).withColumns({k: F.expr(f"case when w <> 0 then ({e}) / w end") for k, e in (("sx", "a * s + b * t + c"), ("sy", "d * s + e * t + f"))})
    within = (F.abs("sx") < FAR) & (F.abs("sy") < FAR)
    places = places.select(IMAGE, "__v", "__u", F.when(within, F.col("sy")).alias("sy"), F.when(within, F.col("sx")).alias("sx"))
    source = px.select(IMAGE, F.col("y").cast("bigint").alias("__y"), F.col("x").cast("bigint").alias("__x"), *channels)
    key = [IMAGE, "__y", "__x"]
    if method == "nearest":
        wanted = places.select(IMAGE, "__v", "__u", F.floor(F.col("sy") + 0.5).alias("__y"), F.floor(F.col("sx") + 0.5).alias("__x"))
        made = wanted.join(source, key, "left")
        return made.select(IMAGE, F.col("__v").alias("y"), F.col("__u").alias("x"), *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in channels])
    at = places.withColumns({"__y0": F.floor("sy"), "__x0": F.floor("sx")}).withColumns({"p": F.col("sy") - F.col("__y0"), "q": F.col("sx") - F.col("__x0")})
    four = [F.struct((F.col("__y0") + i).alias("y"), (F.col("__x0") + j).alias("x"), ((F.col("p") if i else 1 - F.col("p")) * (F.col("q") if j else 1 - F.col("q"))).alias("w")) for i in (0, 1) for j in (0, 1)]
    # sources without weight are not asked for; the weights of a place sum to 1 or are null, so that no place is lost
    asked = at.select(IMAGE, "__v", "__u", F.explode(F.filter(F.array(*four), lambda f: (f["w"] > 0) | f["w"].isNull())).alias("f"))
    asked = asked.select(IMAGE, "__v", "__u", F.col("f.y").alias("__y"), F.col("f.x").alias("__x"), F.col("f.w").alias("w"))
    made = asked.join(source, key, "left").groupBy(IMAGE, "__v", "__u").agg(*[F.floor(F.round(F.sum(F.coalesce(F.col("w") * F.col(c), F.lit(0.0))), 6) + 0.5).cast("int").alias(c) for c in channels])
    return made.select(IMAGE, F.col("__v").alias("y"), F.col("__u").alias("x"), *channels)

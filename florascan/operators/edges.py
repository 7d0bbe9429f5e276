"""Thin edges: smoothing, gradient, suppression across the gradient, and two thresholds over connected edges."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florascan.operators.blocks import KEEP, PLACE, shifted, stencil
from florascan.operators.neighbourhood import convolutions, gaussian
from florascan.operators.objects import hysteresis


def gradients(px: DataFrame, channel: str, size: int = 5) -> DataFrame:
    """(image_id, y, x, gy, gx, edge): Sobel differences of the smoothed channel and their length; inner pixels only."""
    smooth = gaussian(px, channel, size).select(*PLACE, F.round("smooth", 6).alias("smooth"))
    both = convolutions(smooth, "smooth", {"gy": "sobel_h", "gx": "sobel_v"})
    both = both.select(*PLACE, F.round("gy", 6).alias("gy"), F.round("gx", 6).alias("gx"))
    return both.withColumn("edge", F.sqrt(F.col("gy") * F.col("gy") + F.col("gx") * F.col("gx")))


def thin_edges(grads: DataFrame) -> DataFrame:
    """(image_id, y, x, edge) of places at least as strong as both neighbours across the edge, in one of four directions.

    A missing neighbour counts as zero.
    """
    flat = math.tan(math.pi / 8)

    def thin(planes, exists):
        edge, gy, gx = planes["edge"], np.abs(planes["gy"]), np.abs(planes["gx"])
        top = lambda dy, dx: np.maximum(shifted(edge, dy, dx), shifted(edge, -dy, -dx))
        across = np.where(planes["gy"] * planes["gx"] > 0, top(1, 1), top(1, -1))
        across = np.where(gy <= gx * flat, top(0, 1), np.where(gx <= gy * flat, top(1, 0), across))
        return {"thin": edge, KEEP: (edge > 0) & (edge >= across)}

    return stencil(grads, 1, ["gy", "gx", "edge"], "thin double", thin).select(*PLACE, F.col("thin").alias("edge"))


def canny(px: DataFrame, channel: str, low: float, high: float, size: int = 5) -> DataFrame:
    """(image_id, y, x) of thin edges above low that are connected with one above high."""
    thin = thin_edges(gradients(px, channel, size))
    return hysteresis(thin.filter(F.col("edge") > low), thin.filter(F.col("edge") > high))

"""User-defined operators by name, with the columns they need, and chains of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

Operation = Callable[..., DataFrame]


@dataclass(frozen=True)
class Operator:
    """run(df, **params) and the columns that df must have; kind says what comes out: image, mask, regions or features."""

    name: str
    run: Operation
    needs: tuple[str, ...] = ()
    kind: str = "image"

    def __call__(self, df: DataFrame, **params) -> DataFrame:
        missing = [c for c in self.needs if c not in df.columns]
        if missing:
            raise ValueError(f"{self.name} needs columns {missing}")
        return self.run(df, **params)


OPERATORS: dict[str, Operator] = {}
FEATURES: dict[str, Callable[[], Sequence[Column]]] = {}


def operator(name: str, needs: Sequence[str] = (), kind: str = "image") -> Callable[[Operation], Operation]:
    """Register a function under a name."""

    def add(run: Operation) -> Operation:
        OPERATORS[name] = Operator(name, run, tuple(needs), kind)
        return run

    return add


def feature(name: str) -> Callable:
    """Register a function that returns aggregate columns."""

    def add(make: Callable[[], Sequence[Column]]):
        FEATURES[name] = make
        return make

    return add


def apply_operator(df: DataFrame, name: str, **params) -> DataFrame:
    return OPERATORS[name](df, **params)


def chain(df: DataFrame, steps: Sequence[tuple[str, dict]]) -> DataFrame:
    """Named operators one after another; columns are checked as the plan is built."""
    for name, params in steps:
        df = df.transform(OPERATORS[name], **params)
    return df


def extract(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row for each key with the aggregates of the chosen features."""
    return df.groupBy(*keys).agg(*[c for name in features for c in FEATURES[name]()])


def _register_builtins() -> None:
    from pyspark.sql import functions as F

    from florascan.operators import histogram, neighbourhood, objects, pixels, regions, thinning

    for name, run, needs, kind in (
        ("channels", pixels.channels, "bgr", "image"), ("range_mask", pixels.range_mask, "", "mask"), ("multi_range_mask", pixels.multi_range_mask, "", "mask"), ("linear", pixels.linear, "bgr", "image"),
        ("gamma", pixels.gamma, "bgr", "image"), ("temperature_tint", pixels.temperature_tint, "bgr", "image"), ("white_balance", histogram.white_balance, "bgr", "image"), ("equalize", histogram.equalize, "bgr", "image"),
        ("channel_operation", pixels.channel_operation, "bgr", "image"), ("channel_subtraction", pixels.channel_subtraction, "bgr", "image"), ("distance_image", pixels.distance_image, "bgr", "image"), ("posterize", pixels.posterize, "bgr", "image"),
        ("adaptive_mask", neighbourhood.adaptive_mask, "yx", "mask"), ("niblack", neighbourhood.niblack, "yx", "mask"), ("sauvola", neighbourhood.sauvola, "yx", "mask"), ("convolve3", neighbourhood.convolve3, "yx", "image"),
        ("median_filter", neighbourhood.median_filter, "yx", "image"), ("gaussian", neighbourhood.gaussian, "yx", "image"), ("label_objects", objects.label_objects, "yx", "mask"), ("skeleton", thinning.skeleton, "yx", "mask"), ("shape_features", objects.shape_features, "yx", "features"),
        ("width_stats", objects.width_stats, "yx", "features"), ("hull_features", objects.hull_features, "yx", "features"), ("crop", regions.crop, "yx", "image"), ("rotate", regions.rotate, "yx", "image"), ("augment", regions.augment, "bgryx", "image"),
    ):
        operator(name, ("image_id", *needs), kind)(run)
    feature("area")(lambda: [F.count(F.lit(1)).alias("area")])
    feature("centroid")(lambda: [F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y")])
    feature("colour")(lambda: [f(c).alias(f"rgb_{c}_{n}") for c in "bgr" for n, f in (("mean", F.avg), ("std_dev", F.stddev_pop))])


_register_builtins()

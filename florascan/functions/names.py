"""Scalar functions on names, paths, times and option strings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ("experiment", "plant", "date_time", "camera", "angle", "wavelength", "job_id")


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)


@dataclass(frozen=True)
class Scheme:
    """A way to read a file name: a pattern that the stem must match, and the parts as columns of the stem."""

    name: str
    pattern: str
    parts: dict

    def column(self, stem: Column) -> Column:
        made = [self.parts[p](stem).cast("string" if p != "date_time" else "timestamp").alias(p) if p in self.parts else F.lit(None).cast("timestamp" if p == "date_time" else "string").alias(p) for p in PARTS]
        return F.when(stem.rlike(self.pattern), F.struct(F.lit(self.name).alias("scheme"), *made))


def _group(pattern: str, k: int):
    return lambda s: F.regexp_extract(s, pattern, k)


def _time(pattern: str, k: int, *formats: str):
    return lambda s: F.coalesce(*[F.try_to_timestamp(F.regexp_extract(s, pattern, k), F.lit(f)) for f in formats])


def _constant(value: str):
    return lambda s: F.lit(value)


_BRACKETS = r"^\(([^)]*)\)--\(([^)]*)\)--\(([^)]*)\)--\(([^)-]*)-([^)]*)\)$"
_SEMICOLONS = r"^([^;]*);([^;]*);([^;-]*)-([^;]*);([^;]*);([^;]*)$"
_HASHES = r"^([^#]*)#([^#]*)#([^#]*)#([^#]*)#([^#]*)#([^#]*)#([^#]*)#([^#]*)$"
_GRID = r"^gridsplit_(.*)_([^_]*-([^-_]*))$"
_MEAN = r"^imean_([0-9]{14})_([^_]*)_([^_]*)_([^_]*)$"
_ROOTS = r"^rr#([^#]*)#([^#]*)#[^#]*#([0-9_]*)$"
_CAM = r"^(.{6})([^-]*)-(CAM[^-]*)-(?:V-)?([0-9]{14})$"

#: Tried in this order; the first that fits reads the name.
DEFAULT_SCHEMES: tuple[Scheme, ...] = (
    Scheme("brackets", _BRACKETS, {"plant": _group(_BRACKETS, 1), "date_time": _time(_BRACKETS, 2, "yyyy-MM-dd HH_mm_ss", "yyyy-MM-dd HH_mm"), "experiment": _group(_BRACKETS, 3), "camera": _group(_BRACKETS, 4), "angle": _group(_BRACKETS, 5), "wavelength": _constant("sw755")}),
    Scheme("semicolons", _SEMICOLONS, {"experiment": _group(_SEMICOLONS, 1), "plant": _group(_SEMICOLONS, 2), "camera": _group(_SEMICOLONS, 3), "wavelength": _group(_SEMICOLONS, 4), "date_time": _time(_SEMICOLONS, 5, "yyyy-MM-dd HH_mm_ss", "yyyyMMddHHmmss"), "angle": _group(_SEMICOLONS, 6)}),
    Scheme("hashes", _HASHES, {"experiment": _group(_HASHES, 1), "date_time": _time(_HASHES, 2, "yyyyMMddHHmmss", "yyyy-MM-dd HH_mm_ss"), "plant": _group(_HASHES, 3), "camera": _group(_HASHES, 4), "angle": _group(_HASHES, 5), "wavelength": _group(_HASHES, 6), "job_id": _group(_HASHES, 8)}),
    Scheme("gridsplit", _GRID, {"experiment": _group(_GRID, 1), "plant": _group(_GRID, 2), "angle": _group(_GRID, 3), "camera": _constant("scanner"), "wavelength": _constant("sw755")}),
    Scheme("imean", _MEAN, {"date_time": _time(_MEAN, 1, "yyyyMMddHHmmss"), "experiment": _group(_MEAN, 2), "plant": _group(_MEAN, 3), "angle": _group(_MEAN, 4), "wavelength": _constant("bw")}),
    Scheme("roots", _ROOTS, {"experiment": _group(_ROOTS, 1), "plant": _group(_ROOTS, 2), "date_time": _time(_ROOTS, 3, "yyyyMMdd_HHmmss"), "camera": _constant("pi_camera")}),
    Scheme("cam", _CAM, {"experiment": _group(_CAM, 1), "plant": _group(_CAM, 2), "camera": _group(_CAM, 3), "date_time": _time(_CAM, 4, "yyyyMMddHHmmss"), "wavelength": _constant("sw755"), "angle": _constant("0")}),
)


def parse_path(path: Column, schemes: Sequence[Scheme] = DEFAULT_SCHEMES, modified: Column | None = None) -> Column:
    """Struct (scheme, experiment, plant, date_time, camera, angle, wavelength, job_id) of a path.

    A name that no scheme fits takes the folder as experiment, the stem as plant and the file's time.
    """
    stem = file_stem(path)
    default = {"experiment": F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]*$", 1), "plant": stem, "date_time": modified if modified is not None else F.lit(None), "camera": F.lit("unknown"), "angle": F.lit("unknown"), "wavelength": F.lit("unknown"), "job_id": F.lit(None)}
    fallback = F.struct(F.lit("default").alias("scheme"), *[default[p].cast("timestamp" if p == "date_time" else "string").alias(p) for p in PARTS])
    return F.coalesce(*[s.column(stem) for s in schemes], fallback)


def camera_label(label: Column) -> Column:
    """Struct (camera, view) of a camera's label as the imaging software writes it."""
    s = F.regexp_replace(F.lower(label), "h1r", "")
    dashed, n = F.split(F.when(s.contains("_") & s.contains("-"), F.element_at(F.split(s, "_"), 2)).otherwise(s), "-"), F.size(F.split(F.when(s.contains("_") & s.contains("-"), F.element_at(F.split(s, "_"), 2)).otherwise(s), "-"))
    a, b, c = (F.get(dashed, F.lit(k)) for k in range(3))

    def pair(camera: Column, view: Column) -> Column:
        return F.struct(camera.alias("camera"), view.alias("view"))

    plain = F.when(s.contains("fluo"), "fluo").when(s.contains("nir"), "nir").otherwise(F.lit("vis"))
    rest = F.regexp_replace(s, "^(fluo|nir|vis)", "")
    out = (
        F.when(s.contains("-") & (n == 2) & (a == "in") | s.contains("-") & (n == 2) & (b == "in"), pair(F.substring(a, 1, 3), F.substring(a, 4, 100)))
        .when(s.contains("-") & (n == 2), pair(a, b))
        .when((n == 3) & (c == "in"), pair(a, b))
        .when((n == 3) & c.contains("r") & (b == "side"), pair(a, F.concat(b, F.substring(c, 2, 100))))
        .when((n == 3) & c.contains("r"), pair(b, F.concat(F.lit("side"), F.substring(c, 2, 100))))
        .when((n == 3) & c.contains("top"), pair(b, c))
        .when(n == 3, pair(a, F.concat(b, c)))
        .when(s.endswith("_sv"), pair(F.element_at(F.split(s, "_"), 1), F.lit("unk")))
        .when(s.endswith("_tv"), pair(F.element_at(F.split(s, "_"), 1), F.lit("top")))
        .when(s.contains("msp"), pair(F.lit("msp"), F.lit("unk")))
        .when(s.rlike("fluo|nir|vis") & s.contains("top"), pair(plain, F.lit("top")))
        .when(s.rlike("fluo|nir|vis"), pair(plain, F.when(rest.contains("side"), rest).otherwise(F.concat(F.lit("side"), rest))))
        .when(s.contains("topview"), pair(F.lit("unk"), F.lit("top")))
    )
    camera = F.when(out.getField("camera") == "flu", "fluo").otherwise(out.getField("camera"))
    view = F.when(out.getField("view") == "side", "side0").otherwise(out.getField("view"))
    return F.when(out.isNotNull(), F.struct(camera.alias("camera"), view.alias("view")))


def luid(experiment: Column, plant: Column, date_time: Column, camera: Column, angle: Column, wavelength: Column) -> Column:
    return F.concat_ws("_", experiment, plant, F.date_format(date_time, "yyyyMMddHHmmss"), camera, angle, wavelength)


def snapshot_path(plant: Column, date_time: Column, experiment: Column, camera: Column, angle: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(f"{prefix}("), plant, F.lit(")--("), F.date_format(date_time, "yyyy-MM-dd HH_mm_ss"), F.lit(")--("), experiment, F.lit(")--("), camera, F.lit("-"), angle, F.lit(").png"))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "[\"']", ""), r"[*/\\\[\]:;|=,<>]", "_")


def short_hash(text: Column) -> Column:
    """SHA-1 in URL-safe base 64."""
    return F.translate(F.base64(F.unhex(F.sha1(text.cast("binary")))), "+/", "-_")


def date_parts(t: Column) -> dict[str, Column]:
    formats = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH", "minute": "mm", "second": "ss", "condensed": "yyyyMMddHHmmss"}
    return {k: F.date_format(t, f) for k, f in formats.items()}


def option_values(options: Column) -> Column:
    """Values of a grid-search option string: items between commas, "lo|hi;step" ranges with both ends; distinct, sorted as text."""

    def values(item: Column) -> Column:
        ends, step = F.split(F.split(item, ";")[0], r"\|"), F.coalesce(F.get(F.split(item, ";"), F.lit(1)).cast("int"), F.lit(1))
        run = F.transform(F.sequence(ends[0].cast("int"), F.get(ends, F.lit(1)).cast("int"), step), lambda v: v.cast("string"))
        return F.when(item.contains("|"), run).otherwise(F.array(item))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.regexp_replace(options, " ", ""), ","), values))))


def elapsed(seconds: Column) -> Column:
    """hh:mm:ss.fff"""
    ms = F.round(seconds * 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def ensure_odd(n: Column) -> Column:
    return F.when(n % 2 == 0, n + 1).otherwise(n)

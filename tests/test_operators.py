"""Small hand-made images, files and catalogues."""

from __future__ import annotations

import struct
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from florascan.functions import names, plugins
from florascan.operators import catalogue, histogram, neighbourhood, objects, regions, series
from florascan.plans import fixtures as fx
from florascan.plans import jobs
from florascan.sources import tables
from florascan.streaming import incremental

RING = ["#####", "#...#", "#.#.#", "#...#", "#####"]
BLOBS = ["##...", "##...", "...#.", "....#", "#...."]


def grid(spark, rows, image=1):
    px = spark.createDataFrame([(image, y, x, 0, 0, 0) for y, r in enumerate(rows) for x in range(len(r))], "image_id int, y int, x int, b int, g int, r int")
    mask = spark.createDataFrame([(image, y, x) for y, r in enumerate(rows) for x, c in enumerate(r) if c == "#"], "image_id int, y int, x int")
    return px, mask


def places(df):
    return {(r.y, r.x) for r in df.select("y", "x").collect()}


def drawn(rows):
    return {(y, x) for y, r in enumerate(rows) for x, c in enumerate(r) if c == "#"}


@pytest.mark.parametrize("method", ["union", "star"])
def test_labels(spark, method):
    _, mask = grid(spark, BLOBS)
    eight = {(r.y, r.x): r.label for r in objects.label_objects(mask, 8, method).collect()}
    assert eight[(2, 3)] == eight[(3, 4)] and len(set(eight.values())) == 3
    four = {(r.y, r.x): r.label for r in objects.label_objects(mask, 4, method).collect()}
    assert four[(2, 3)] != four[(3, 4)] and len(set(four.values())) == 4


def test_holes(spark):
    px, mask = grid(spark, RING)
    assert places(objects.fill_holes(mask, px)) == {(y, x) for y in range(5) for x in range(5)}
    assert objects.holes(mask, px).select("label").distinct().count() == 1


def test_morphology_contains(spark):
    px, mask = grid(spark, BLOBS)
    for shape in ("rectangle", "cross", "ellipse"):
        grown, shrunk = places(neighbourhood.dilate(mask, px, 3, shape)), places(neighbourhood.erode(mask, px, 3, shape))
        assert shrunk <= drawn(BLOBS) <= grown
        opened = neighbourhood.open_(mask, px, size=3, shape=shape)
        assert places(neighbourhood.open_(opened, px, size=3, shape=shape)) == places(opened)


def test_rotation_has_order_four(spark):
    px, mask = grid(spark, ["##.", "...", "..#", "#.."])
    coloured = px.withColumn("g", F.col("y") * 10 + F.col("x"))
    out = coloured
    for _ in range(4):
        out = regions.rotate(out, 90)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, coloured.collect()))
    del mask


def test_hull_of_a_square(spark):
    _, mask = grid(spark, ["####"] * 4)
    h = objects.hull_features(mask).first()
    assert h.hull_area == 9 and h.rect_width == 3 and h.rect_height == 3 and abs(h.circle_radius - 3 * 2**0.5 / 2) < 1e-9


def test_histogram_counts_all_pixels(spark, sf):
    px = fx.px(spark, sf)
    assert histogram.histogram(px, include_max=True).agg(F.sum("n")).first()[0] == 3 * px.count()
    assert histogram.clahe(px, "g").count() == px.count()
    clustered = histogram.kmeans_colours(px, 3)
    assert clustered.count() == px.count() and clustered.agg(F.max("cluster")).first()[0] <= 2


def test_width_slices_cover_the_height(spark):
    _, mask = grid(spark, ["##", "..", "##", "#.", "##", "##", "#."])
    rows = objects.width_stats(mask, 3).orderBy("slice").collect()
    assert [r.slice for r in rows] == [1, 2, 3] and sum(r.area for r in rows) == 10 and rows[0].min_width == 0


def test_unknown_filters_are_errors(spark, sf):
    snap = fx.snap(spark, sf)
    with pytest.raises(ValueError):
        catalogue.select_snapshots(snap, {"nothing": 1})
    with pytest.raises(ValueError):
        catalogue.select_snapshots(snap, {"plant": ("like", "p")})
    with pytest.raises(ValueError):
        plugins.apply_operator(snap, "range_mask", channel="g")


def test_series_is_anchored(spark):
    rows = [("p", datetime(2024, 1, 1, 0, m), f"l{m:02d}") for m in (0, 6, 12, 18, 24)]
    df = spark.createDataFrame(rows, "plant string, t timestamp, luid string")
    got = {r.luid: r.series_id for r in series.series_id(df, ["plant"], "t", "luid", 10).collect()}
    assert got == {"l00": "l00", "l06": "l00", "l12": "l12", "l18": "l12", "l24": "l24"}


def test_camera_labels(spark):
    df = spark.createDataFrame([("x",), (None,), ("",)], "label string").select(names.camera_label(F.col("label")).alias("l"))
    assert [r.l for r in df.collect()] == [None, None, None]


def png(path, rows):
    """An RGB image of the given (r, g, b) pixels."""
    raw = b"".join(b"\0" + b"".join(bytes(p) for p in row) for row in rows)

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_images_from_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    png(tmp_path / "a" / "one.png", [[(1, 2, 3), (4, 5, 6)]])
    (tmp_path / "a" / "note.txt").write_text("x")
    found = tables.scan_images(spark, str(tmp_path)).collect()
    assert len(found) == 1 and found[0].path.endswith("one.png")
    px = tables.read_pixels(spark, str(tmp_path)).orderBy("x").collect()
    assert [(r.y, r.x, r.b, r.g, r.r) for r in px] == [(0, 0, 3, 2, 1), (0, 1, 6, 5, 4)]


def test_lists_catalogues_and_sheets(spark, tmp_path):
    (tmp_path / "list.txt").write_text("/a.png\n\n  /b.png \n")
    assert {r.path for r in tables.read_image_list(spark, str(tmp_path / "list.txt")).collect()} == {"/a.png", "/b.png"}
    (tmp_path / "cat.csv").write_text("luid,plant\nl1,p1\nl2,p2\nl1,p3\n")
    assert {tuple(r) for r in tables.read_catalogue(spark, str(tmp_path / "cat.csv"), "luid string, plant string").collect()} == {("l1", "p1"), ("l2", "p2")}
    for k, text in (("x", "luid,area\nl1,5\n"), ("y", "luid,width\nl2,7\n")):
        (tmp_path / k).mkdir()
        (tmp_path / k / "img_result.csv").write_text(text)
    partial = tables.read_partial_results(spark, [str(tmp_path / "x"), str(tmp_path / "y")])
    assert partial.columns == ["luid", "area", "width"] and partial.count() == 2
    tables.write_sheet(tables.sheet_columns(partial.withColumn("a-b", F.lit("1,2"))), str(tmp_path / "out"), single=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True).select("a_b").first()[0] == "1 2"
    calls = []

    def build():
        calls.append(1)
        return partial

    for reset in (False, False, True):
        assert tables.cached_catalogue(spark, str(tmp_path / "cache"), build, reset).count() == 2
    assert len(calls) == 2
    tables.write_images(spark.range(4).withColumnRenamed("id", "image_id").withColumn("y", F.lit(0)), str(tmp_path / "images"))
    assert spark.read.parquet(str(tmp_path / "images")).count() == 4


def test_series_of_rows_in_any_order(spark, tmp_path):
    """Rows of many files and two runs, shuffled within the watermark, get the series that the batch form gives."""
    import random

    incremental.use_rocksdb(spark)
    rng = random.Random(2)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "plant string, t timestamp, luid string"
    rows = [(f"p{rng.randrange(3)}", rng.randrange(400), f"l{k:03d}") for k in range(150)]
    arrival = sorted(rows, key=lambda r: r[1] + rng.randrange(60))  # up to an hour late
    at = lambda m: datetime(2024, 1, 1 + m // 1440, m % 1440 // 60, m % 60)

    def arrive(part):
        spark.createDataFrame([(p, None if m is None else at(m), luid) for p, m, luid in part], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = incremental.read_files(spark, spark.createDataFrame([], schema).schema, source, 1)
        incremental.write_until_done(incremental.incremental_series(stream, ["plant"], "t", "luid", 10, "1 hour"), out, state)

    for k in range(0, 100, 25):
        arrive(arrival[k : k + 25])
    run()
    assert 0 < spark.read.parquet(out).count() < 100
    arrive(arrival[100:])
    arrive([("p0", None, "untimed"), ("closing", 2000, "closing")])
    run()
    got = sorted(((r.plant, r.luid, r.series_id) for r in spark.read.parquet(out).collect()), key=str)
    assert got == sorted([*anchored(rows, 10), ("p0", "untimed", "untimed")], key=str)


def test_failed_images_do_not_stop_the_job(spark, sf):
    px = fx.px(spark, sf)
    out = jobs.extract_features(px.select("image_id").distinct(), px, [lambda d: d.filter("image_id <> 3 and g > 10")], ("shape", "width"))
    assert {r.status for r in out.filter("image_id = 3").collect()} == {"failed"}
    assert out.filter("status = 'ok'").count() == out.count() - 1


def test_empty_tables(spark):
    px, mask = grid(spark, ["#"])
    empty, nothing = px.filter("image_id < 0"), mask.filter("image_id < 0")
    assert objects.label_objects(nothing).count() == 0 and objects.hull_features(nothing).count() == 0
    assert histogram.otsu_thresholds(empty).count() == 0 and neighbourhood.dilate(nothing, px).count() == 0
    assert objects.keep_linked(nothing, 3).count() == 0


def test_bands_label_as_whole_images_do(spark):
    import random

    rng = random.Random(1)
    mask = spark.createDataFrame([(i, y, x) for i in range(2) for y in range(40) for x in range(15) if rng.random() < 0.5], "image_id int, y int, x int")
    whole = sorted(map(tuple, objects.label_objects(mask).select("image_id", "y", "x", "label").collect()))
    for rows in (3, 7, 40):
        assert sorted(map(tuple, objects.label_objects(mask, band_rows=rows).select("image_id", "y", "x", "label").collect())) == whole
    four = sorted(map(tuple, objects.label_objects(mask, 4).select("image_id", "y", "x", "label").collect()))
    assert sorted(map(tuple, objects.label_objects(mask, 4, band_rows=5).select("image_id", "y", "x", "label").collect())) == four


def test_series_of_repeated_null_and_untimed_rows(spark):
    from florascan.operators import series

    rows = [("p", "2020-01-01 00:00:00", "a"), ("p", "2020-01-01 00:05:00", "b"), ("p", "2020-01-01 00:05:00", "b"), ("p", "2020-01-01 00:10:00", None), ("p", None, "n"), (None, "2020-01-01 00:01:00", "z")]
    df = spark.createDataFrame(rows, "plant string, at string, luid string").withColumn("at", F.to_timestamp("at"))
    got = sorted(((r.plant, r.luid, r.series_id) for r in series.series_id(df, ["plant"], "at", "luid", 10).collect()), key=str)
    assert got == sorted([("p", "a", "a"), ("p", "b", "a"), ("p", "b", "a"), ("p", None, None), ("p", "n", "n"), (None, "z", "z")], key=str)
    assert series.series_id(df.limit(0), ["plant"], "at", "luid", 10).count() == 0


def test_noise_is_cleaned_until_none_is_left(spark):
    mask = spark.createDataFrame([(0, y, x) for y, x in ((0, 0), (0, 1), (1, 1), (5, 3), (7, 3), (7, 4))], "image_id int, y int, x int")
    assert {(r.y, r.x) for r in objects.clean_horizontal_noise(mask).collect()} == {(0, 0), (0, 1), (1, 1)}


def test_partial_results_are_read_by_their_own_headers(spark, tmp_path):
    files = {
        "a_result.csv": "luid,area,height\na,1,2\n", "b_result.csv": "luid,hull,Area\nb,9,5\n\nb2,8\n", "c/c_result.csv": 'height,luid,area,luid\n"7,5",c,,other\n',
        "d_result.csv": "", "e_result.csv": "luid,only_header\n", "f.csv": "luid,area\nno,1\n", "g_result.csv": "luid,area,height\ng,3,4\n",
    }
    (tmp_path / "c").mkdir()
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    out = tables.read_partial_results(spark, [str(tmp_path)])
    assert out.columns == ["luid", "area", "height", "hull", "only_header"]
    expected = {("a", "1", "2", None, None), ("b", "5", None, "9", None), ("b2", None, None, "8", None), ("c", None, "7,5", None, None), ("g", "3", "4", None, None)}
    assert {tuple(r) for r in out.collect()} == expected


def test_new_rows_come_once(spark):
    known = spark.createDataFrame([("a", 1), (None, 2)], "luid string, n int")
    found = spark.createDataFrame([("b", 9), ("b", 3), ("a", 4), (None, 5)], "luid string, n int")
    assert {tuple(r) for r in tables.add_new(known, found, order=[F.col("n")]).collect()} == {("a", 1), (None, 2), ("b", 3)}
    assert tables.add_new(known, found.limit(0)).count() == 2 and tables.add_new(known.limit(0), found).count() == 3


def test_masks_meet_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", "SW755"), ("c", "x")], "luid string, wavelength string")
    luids = lambda **masks: {r.luid for r in catalogue.mask_filter(df, **masks).collect()}
    assert luids(exclude=[{"wavelength": ["sw755"]}]) == {"a", "c"}
    assert luids(include=[{"wavelength": ["sw755", "x"]}], exclude=[{"wavelength": ["X"]}]) == {"b"}
    assert luids(include=[{"wavelength": ["*"], "luid": ["A", "b"]}]) == {"a", "b"} and luids(post=[{"wavelength": ["x"]}], force=[{"luid": ["a"]}]) == {"a", "c"}


def test_stencils_do_not_depend_on_the_blocks(spark, monkeypatch):
    """Blocks of a few places and one block for the whole image, holes included, give the same rows."""
    import random

    from florascan.operators import blocks, edges

    rng = random.Random(3)
    px = spark.createDataFrame([(i, y, x, rng.randrange(256), "kept") for i in range(2) for y in range(23) for x in range(19) if rng.random() < 0.95], "image_id int, y int, x int, g int, note string")
    mask = px.filter("g > 120")
    n = neighbourhood
    work = {
        "box": lambda: n.box_stats(px, "g", 2), "gauss": lambda: n.gaussian(px, "g", 5).withColumn("smooth", F.round("smooth", 9)), "median": lambda: n.median_filter(px, "g", 9),
        "small median": lambda: n.median_filter(px, "g", 3), "max": lambda: n.local_max(px, "g", 2), "flat": lambda: n.de_vignette(px, "g", 3, 5), "sobel": lambda: n.convolve3(px, "g", "sobel"),
        "pattern": lambda: n.local_binary_pattern(px, "g"), "circle": lambda: n.circular_pattern(px, "g"), "glcm": lambda: n.glcm(px, "g", (1, 5)).select("distance", "angle", F.round("contrast", 6)),
        "open": lambda: n.open_(mask, px, size=3, shape="cross", iterations=2), "close": lambda: n.close_(mask, px, size=5), "edge": lambda: n.gradient(mask, px, shape="rectangle"), "thin": lambda: edges.thin_edges(edges.gradients(px, "g")),
    }
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    whole = {name: rows(f()) for name, f in work.items()}
    assert all(whole.values()) and len(whole["box"]) == px.count() and "note" in work["max"]().columns
    monkeypatch.setattr(blocks, "BLOCK", 4)
    for name, f in work.items():
        assert rows(f()) == whole[name], name


def test_plane_arithmetic():
    import numpy as np

    from florascan.operators import blocks

    rng = np.random.default_rng(4)
    for _ in range(30):
        h, w = rng.integers(1, 15, 2)
        r, v, e = int(rng.integers(0, 7)), rng.integers(0, 9, (h, w)).astype(float), rng.random((h, w)) < 0.8
        median, most, total = blocks.windowed_median(v, e, r), blocks.windowed_max(v, e, r), blocks.box_sum(np.where(e, v, 0), r)
        offsets = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if rng.random() < 0.5]
        reached = {(y + dy, x + dx) for y, x in zip(*e.nonzero()) for dy, dx in offsets}
        assert {(y, x) for y, x in zip(*blocks.spread(e, offsets).nonzero())} == {(y, x) for y, x in reached if 0 <= y < h and 0 <= x < w}
        for y in range(h):
            for x in range(w):
                near = (slice(max(0, y - r), y + r + 1), slice(max(0, x - r), x + r + 1))
                own = v[near][e[near]]
                assert total[y, x] == own.sum() and (not len(own) or (median[y, x] == np.median(own) and most[y, x] == own.max()))


def test_regions_meet_pixels_over_cells(spark):
    """Covers of any cell size give the pixels of the exact test, and no plan compares all with all."""
    import random

    rng = random.Random(5)
    rows = []
    for k in range(60):
        x, y = rng.uniform(-5, 45), rng.uniform(-5, 45)
        kinds = (lambda: regions.rectangle(k, "r", x, y, rng.choice([0, rng.uniform(0, 20)]), rng.uniform(0, 20)), lambda: regions.rectangle(k, "t", x, y, rng.uniform(0, 20), rng.uniform(0, 9), angle=rng.uniform(1, 359)), lambda: regions.circle(k, "c", round(x), y, rng.uniform(0, 15)), lambda: regions.circle(k, "a", x, y, 12, in_radius=rng.uniform(0, 12)))
        rows.append(rng.choice(kinds)())
    px = spark.createDataFrame([(0, y, x) for y in range(40) for x in range(40)], "image_id int, y int, x int")
    rois = regions.regions(spark, rows)
    exact = sorted(tuple(r) for r in px.select("*", F.explode(F.array(*[F.when(regions.region_column(r), F.lit(r[0])) for r in rows])).alias("roi")).filter("roi is not null").collect())
    for cell in (1, 3, 8, 64):
        met = regions.meet(px, rois, "inner", cell)
        assert sorted((r.image_id, r.y, r.x, r.roi_id) for r in met.collect()) == exact
        assert regions.meet(px, rois, "left_anti", cell).count() == 1600 - len({e[:3] for e in exact})
    plan = regions.keep_regions(px, rois)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert regions.keep_regions(px, rois.limit(0)).count() == 0 and regions.delete_regions(px, rois.limit(0)).count() == 1600


def test_rectangles_meet_over_cells(spark):
    import random

    rng = random.Random(6)
    boxes = [(k, k % 3, float(rng.randrange(-20, 60)), float(rng.randrange(60)), float(rng.randrange(1, 30)), float(rng.randrange(1, 30))) for k in range(80)]
    df = spark.createDataFrame(boxes, "roi_id int, image_id int, left double, top double, width double, height double")
    df = df.withColumns({"cx": F.col("left") + 3, "cy": F.col("top") + 4, "radius": F.lit(5.0)})
    expected = set()
    for a, i, l1, t1, w1, h1 in boxes:
        for b, j, l2, t2, w2, h2 in boxes:
            if i == j and a != b and l1 < l2 + w2 and l2 < l1 + w1 and t1 < t2 + h2 and t2 < t1 + h1:
                expected.add((i, a, b, l1 <= l2 and t1 <= t2 and l1 + w1 >= l2 + w2 and t1 + h1 >= t2 + h2))
    touching = {(i, a, b) for a, i, l1, t1, w1, h1 in boxes for b, j, l2, t2, *_ in boxes if i == j and (l2 + 3 - max(l1, min(l2 + 3, l1 + w1))) ** 2 + (t2 + 4 - max(t1, min(t2 + 4, t1 + h1))) ** 2 <= 25}
    for cell in (2, 16, 500):
        got = regions.rectangle_relations(df, df, ["image_id"], cell).collect()
        assert len(got) == len(expected) and {tuple(r) for r in got} == expected
        circles = regions.region_relations(df, df, ["image_id"], cell).collect()
        assert len(circles) == len(touching) and {tuple(r)[:3] for r in circles} == touching


def test_circle_relations_hold_every_pair(spark):
    """Rectangles and circles apart are rows, too; those that touch are the ones found over cells."""
    import random

    rng = random.Random(7)
    rows = [(k, k % 3 if k % 10 else None, float(rng.randrange(-20, 60)), float(rng.randrange(60)), float(rng.randrange(1, 30)), float(rng.randrange(1, 30)), float(rng.randrange(7))) for k in range(60)]
    df = spark.createDataFrame(rows, "roi_id int, image_id int, left double, top double, width double, height double, radius double")
    df = df.withColumns({"cx": F.col("left") + 3, "cy": F.col("top") + 4})
    expected = {}
    for a, i, l, t, w, h, _ in rows:
        for b, j, x, y, _, _, rad in rows:
            cx, cy = x + 3, y + 4
            touches = (cx - max(l, min(cx, l + w))) ** 2 + (cy - max(t, min(cy, t + h))) ** 2 <= rad * rad
            expected[i, j, a, b] = touches, cx - rad >= l and cx + rad <= l + w and cy - rad >= t and cy + rad <= t + h
    of_images = {(i, a, b, *v) for (i, j, a, b), v in expected.items() if i is not None and i == j}
    got = [tuple(r) for r in regions.region_pairs(df, df, ["image_id"]).collect()]
    assert len(got) == len(of_images) and set(got) == of_images and {v[3:] for v in of_images} == {(False, False), (True, False), (True, True)}
    anywhere = [tuple(r) for r in regions.region_pairs(df, df).collect()]
    assert len(anywhere) == 3600 and set(anywhere) == {(a, b, *v) for (_, _, a, b), v in expected.items()}
    touching = regions.region_relations(df, df, ["image_id"]).collect()
    assert len(touching) == len({tuple(r) for r in touching}) and {tuple(r) for r in touching} == {(i, a, b, c) for i, a, b, t, c in of_images if t}


def test_circle_relations_query_has_every_pair(spark, sf):
    """Each pair of an image's regions is a row, touching or not."""
    from florascan.plans import QUERIES, shapes

    each = [r["count"] for r in shapes.boxes(spark, sf).groupBy("image_id").count().collect()]
    rows = QUERIES["j12_circle_relations"](spark, sf).collect()
    assert len(rows) == len({(r.image_id, r.a_id, r.b_id) for r in rows}) == sum(n * n for n in each)
    assert set(rows[0].asDict()) == {"image_id", "a_id", "b_id", "touches", "contains"}


def scattered(spark, seed, share, size=60, images=2):
    import random

    rng = random.Random(seed)
    return spark.createDataFrame([(i, y, x) for i in range(images) for y in range(size) for x in range(size) if rng.random() < share], "image_id int, y int, x int")


def test_gaps_equal_all_pairs(spark, monkeypatch):
    from florascan.operators import blocks, gaps
    from florascan.sources.storage import stored

    labels = stored(objects.label_objects(scattered(spark, 7, 0.04)), "test-labels")
    points = {}
    for r in labels.collect():
        points.setdefault((r.image_id, r.label), []).append((r.y, r.x))
    least = {}
    for (i, a), mine in points.items():
        for (j, b), theirs in points.items():
            if i == j and a < b:
                least[i, a, b] = min((y - v) ** 2 + (x - u) ** 2 for y, x in mine for v, u in theirs)
    for block in (8, 256):
        monkeypatch.setattr(blocks, "BLOCK", block)
        for tolerance in (1, 2, 3.5, 9, 40):
            near = {k for k, d2 in least.items() if d2 < tolerance * tolerance}
            if tolerance != 40:
                got = {(r.image_id, r.a, r.b): r.distance for r in gaps.object_distances(labels, tolerance).collect()}
                assert set(got) == near and all(abs(d * d - least[k]) < 1e-6 for k, d in got.items())
            root = {k: k for k in points}

            def find(k, root=root):
                while root[k] != k:
                    k = root[k]
                return k

            for i, a, b in near:
                root[find((i, b))] = find((i, a))
            expected, groups = {}, {}
            for k in points:
                expected.setdefault(find(k), set()).add(k)
            for r in gaps.linked_groups(labels, tolerance).collect():
                groups.setdefault(r.group, set()).add((r.image_id, r.label))
            assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values())), (block, tolerance)


def test_least_distance_of_large_sets():
    import numpy as np

    from florascan.operators.gaps import _least_distance

    rng = np.random.default_rng(8)
    for _ in range(20):
        a, b = rng.integers(0, 90, (700, 2)), rng.integers(0, 90, (500, 2)) + [int(rng.integers(0, 100)), int(rng.integers(0, 100))]
        exact = int(((a[:, None] - b[None]) ** 2).sum(2).min())
        for tolerance in (2, 5):
            got = _least_distance(a, b, tolerance)
            assert got == exact if exact < tolerance**2 else got >= tolerance**2


def test_components_of_either_size(spark):
    import random

    from florascan.operators import graph

    rng = random.Random(9)
    edges = spark.createDataFrame([(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(260)], "a string, b string")
    alone, spread = (sorted(map(tuple, graph.components(edges, small).collect())) for small in (1 << 20, 10))
    assert alone and alone == spread
    assert graph.components(edges.limit(0)).count() == 0


def test_noisy_rows_are_labelled_fast():
    import time

    import pandas as pd

    rows = 64
    part = pd.DataFrame({"image_id": 1, "y": [y for y in range(rows) for _ in range(4000)], "left": [2 * k + y % 2 for y in range(rows) for k in range(4000)], "right": [2 * k + y % 2 for y in range(rows) for k in range(4000)], "band": 0})
    began = time.time()
    assert objects._union_runs(1)(part)["root_y"].max() == 0 and len(objects._union_runs(0)(part)) == len(part)
    assert time.time() - began < 5


def anchored(rows, minutes):
    """(key, luid, series) of (key, time in minutes, luid) by the definition."""
    out, seen = [], {}
    for key, t, luid in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if key not in seen or t - seen[key][0] >= minutes:
            seen[key] = (t, luid)
        out.append((key, luid, seen[key][1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, minutes, partitions", [(1, 10, 7), (2, 300, 12), (3, 2, 3), (4, 10_000, 9), (5, 1, 40)])
def test_a_hot_key_spreads_over_partitions(spark, seed, minutes, partitions):
    import random

    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.6 else f"p{rng.randrange(6)}", rng.randrange(800), f"l{k:04d}") for k in range(900)]
    rows += [(None, k, f"n{k}") for k in range(20)] + [("tie", 5, f"t{k}") for k in range(30)]
    df = spark.createDataFrame(rows, "plant string, minute int, luid string").withColumn("at", F.timestamp_seconds(F.col("minute") * 60))
    got = series.series_id(df, ["plant"], "at", "luid", minutes, partitions=partitions)
    assert sorted(((r.plant, r.luid, r.series_id) for r in got.collect()), key=str) == anchored(rows, minutes)
    assert got.columns == ["plant", "minute", "luid", "at", "series_id"]


def test_broken_files_are_failed_rows(spark, tmp_path):
    png(tmp_path / "good.png", [[(1, 2, 3), (4, 5, 6)]])
    (tmp_path / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nrubbish")
    images = tables.read_images(spark, str(tmp_path)).withColumn("image_id", F.element_at(F.split("path", "/"), -1))
    px = tables.read_pixels(spark, str(tmp_path)).withColumn("image_id", F.element_at(F.split("path", "/"), -1))
    out = jobs.extract_features(images.select("image_id", "error"), px, [], ("shape",))
    got = {r.image_id: (r.status, r.error, r.area) for r in out.collect()}
    assert got == {"good.png": ("ok", None, 2), "broken.png": ("failed", "cannot be decoded", None)}
    assert [tuple(r) for r in jobs.error_level(out).collect()] == [("cannot be decoded", 1)]


def test_selected_medians_are_exact(spark):
    import random
    import statistics

    from florascan.operators import medians

    rng = random.Random(10)
    rows = [(k, rng.choice((rng.gauss(0, 1), float(rng.randrange(4)))), rng.randrange(1000)) for k in ("a", "b", None) for _ in range(rng.randrange(300, 900))]
    rows += [("few", 1.0, 5), ("few", 2.0, None), ("none", None, 1), ("same", 7.0, 7)] + [("same", 7.0, 7)] * 500
    df = spark.createDataFrame(rows, "k string, v double, w int")
    expected = {}
    for name in {r[0] for r in rows}:
        expected[name] = tuple(statistics.median(x) if (x := [r[c] for r in rows if r[0] == name and r[c] is not None]) else None for c in (1, 2))
    for large in (100, 10_000):
        got = {r.k: (r.v, r.w) for r in medians.median_by(df, ["k"], ["v", "w"], large).collect()}
        assert got == expected


def test_grid_of_many_combinations(spark):
    px = spark.createDataFrame([(i, 0, x, (x * 37 + i) % 256) for i in range(2) for x in range(100)], "image_id int, y int, x int, g int")
    params = spark.range(120_000).select(F.col("id").alias("k"), (F.col("id") % 300 - 20).cast("int").alias("lo"), F.when(F.col("id") % 7 > 0, (F.col("id") % 311).cast("int")).alias("hi"))
    out = jobs.grid_search(px, params, F.col("lo"), F.col("hi"), ["k", "lo", "hi"])
    assert out.count() == 240_000
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.filter("k % 1009 = 0").collect():
        assert r.pixels == (0 if r.hi is None else sum(r.lo <= (x * 37 + r.image_id) % 256 <= r.hi for x in range(100)))
    assert jobs.grid_search(px, params.limit(0), F.col("lo"), F.col("hi"), ["k"]).count() == 0


def test_operators_say_what_they_make():
    for name, made in plugins.OPERATORS.items():
        assert made.kind in ("image", "mask", "regions", "features") and made.name == name and callable(made.run)
    assert plugins.OPERATORS["range_mask"].kind == "mask" and plugins.OPERATORS["crop"].needs == ("image_id", "y", "x")


def test_hulls_of_random_masks(spark):
    import math
    import random

    rng = random.Random(11)
    points = {i: [(rng.randrange(30), rng.randrange(25)) for _ in range(3 + 9 * i)] for i in range(4)}
    mask = spark.createDataFrame([(i, y, x) for i, own in points.items() for y, x in set(own)], "image_id int, y int, x int")
    for r in objects.hull_features(mask).collect():
        own = [(x, y) for y, x in set(points[r.image_id])]
        lines = [(p, q) for p in own for q in own if p != q and all((q[0] - p[0]) * (s[1] - p[1]) - (q[1] - p[1]) * (s[0] - p[0]) >= 0 for s in own)]
        ends = {p: max((q for a, q in lines if a == p), key=lambda q: (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2) for p, _ in lines}
        corners = [min(own)]
        while (after := ends[corners[-1]]) != corners[0]:
            corners.append(after)
        area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(corners, corners[1:] + corners[:1]))) / 2
        assert abs(r.hull_area - area) < 1e-6
        assert max(math.dist((r.circle_x, r.circle_y), p) for p in own) <= r.circle_radius + 1e-6
        circles = [((p[0] + q[0]) / 2, (p[1] + q[1]) / 2, math.dist(p, q) / 2) for p in own for q in own if p != q]
        assert all(c[2] >= r.circle_radius - 1e-6 for c in circles if all(math.dist(c[:2], p) <= c[2] + 1e-9 for p in own))
        boxes = [math.prod(max(x * math.cos(t) + y * math.sin(t) for x, y in own) - min(x * math.cos(t) + y * math.sin(t) for x, y in own) for t in (math.atan2(q[1] - p[1], q[0] - p[0]), math.atan2(q[1] - p[1], q[0] - p[0]) + math.pi / 2)) for p, q in lines]
        assert not boxes or abs(r.rect_width * r.rect_height - min(boxes)) < 1e-4


def test_stored_layouts_join_without_a_shuffle(spark, sf):
    """Join by place, window by row and group by row over two stored tables: no exchange in the plan."""
    from pyspark.sql import Window as W

    from florascan.plans import pixels as pixel_plans

    tables.use_layouts(spark)
    left, right = pixel_plans.layouts(spark, sf)
    joined = tables.join_layouts(left, right)
    wide = joined.withColumn("before", F.lag("g").over(W.partitionBy("image_id", "band", "y").orderBy("x")))
    out = wide.groupBy("image_id", "band", "y").agg(F.count(F.lit(1)).alias("n"), F.count("before").alias("m"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    tables.use_layouts(spark, False)
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert out.agg(F.sum("n")).first()[0] == right.count()
    pruned = left.filter("image_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(image_id), EqualTo(image_id,3)]" in pruned


def thinned_by_pixels(mask):
    """Zhang and Suen's thinning, pixel by pixel."""
    around = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    mask, changed = set(mask), True
    while changed:
        changed = False
        for last in ((2, 4, 0), (4, 6, 2)), ((0, 2, 6), (0, 4, 6)):
            gone = set()
            for y, x in mask:
                p = [(y + dy, x + dx) in mask for dy, dx in around]
                if 2 <= sum(p) <= 6 and sum(not p[k] and p[(k + 1) % 8] for k in range(8)) == 1:
                    groups = ((0, 2, 4), (2, 4, 6)) if last == ((2, 4, 0), (4, 6, 2)) else ((0, 2, 6), (0, 4, 6))
                    if all(not all(p[k] for k in g) for g in groups):
                        gone.add((y, x))
            mask -= gone
            changed = changed or bool(gone)
    return mask


def test_skeletons_equal_whole_images(spark, sf, monkeypatch):
    import random

    from florascan.operators import blocks, thinning
    from florascan.plans import QUERIES

    rng = random.Random(13)
    drawn_ = {i: {(y + dy, x + dx) for y, x in [(rng.randrange(40), rng.randrange(40)) for _ in range(14)] for dy in range(rng.randrange(1, 12)) for dx in range(rng.randrange(1, 12))} for i in range(2)}
    mask = spark.createDataFrame([(i, y, x) for i, own in drawn_.items() for y, x in own], "image_id int, y int, x int")
    expected = {(i, y, x) for i, own in drawn_.items() for y, x in thinned_by_pixels(own)}
    for block, rounds in ((256, 16), (8, 1), (8, 3)):
        monkeypatch.setattr(blocks, "BLOCK", block)
        assert {tuple(r) for r in thinning.skeleton(mask, rounds).collect()} == expected, (block, rounds)
    assert thinning.skeleton(mask.limit(0)).count() == 0
    assert 0 < QUERIES["e2_skeleton"](spark, sf).count() < fx.px(spark, sf).count()


def reconstructed(seed, limit):
    """Grey reconstruction of one image by repeated steps over all of its pixels."""
    level = {p: min(seed[p], limit[p]) for p in seed}
    while True:
        new = {(y, x): min(limit[y, x], max(level.get((y + dy, x + dx), level[y, x]) for dy in (-1, 0, 1) for dx in (-1, 0, 1))) for y, x in level}
        if new == level:
            return level
        level = new


def flooded(level, markers, four=False):
    """Marker watershed of one image with a queue over all of its pixels: cost and steps first, then labels in their order."""
    import heapq

    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and not (four and dy and dx)]
    cost, queue = {}, [((level[p], 0), p) for p in markers if p in level]
    while queue:
        heapq.heapify(queue)
        c, p = heapq.heappop(queue)
        if p in cost:
            continue
        cost[p] = c
        for dy, dx in near:
            q = (p[0] + dy, p[1] + dx)
            if q in level and q not in cost:
                heapq.heappush(queue, ((level[q], 0) if level[q] > c[0] else (c[0], c[1] + 1), q))
    label = {}
    for p in sorted(cost, key=cost.get):
        came = [q for q in ((p[0] + dy, p[1] + dx) for dy, dx in near) if q in label and cost[p] == ((level[p], 0) if level[p] > cost[q][0] else (cost[q][0], cost[q][1] + 1))]
        label[p] = markers[p] if p in markers else min(label[q] for q in came)
    return label


def winding(size):
    """A corridor of one pixel's width that runs through all rows of a square."""
    return {(y, x) for y in range(size) for x in range(size) if y % 2 == 0 or x == (size - 1 if y % 4 == 1 else 0)}


def random_levels(seed, size=21):
    import random

    rng = random.Random(seed)
    return {(y, x): rng.randrange(6) for y in range(size) for x in range(size) if rng.random() < 0.9}


def test_reconstruction_equals_whole_images(spark, monkeypatch):
    import random

    from florascan.operators import blocks, flooding

    rng = random.Random(5)
    limits = {0: random_levels(1), 1: random_levels(2), 2: {p: 9 for p in winding(9)}}
    seeds = {i: {p: rng.randrange(-2, 4) for p in own} for i, own in limits.items()}
    seeds[2] = {p: 7 if p == (0, 0) else 0 for p in limits[2]}
    rows = [(i, y, x, seeds[i][y, x], v) for i, own in limits.items() for (y, x), v in own.items()]
    expected = {(i, y, x): v for i in limits for (y, x), v in reconstructed(seeds[i], limits[i]).items()}
    px = spark.createDataFrame(rows, "image_id int, y int, x int, s int, m int")
    for block in (256, 8):
        monkeypatch.setattr(blocks, "BLOCK", block)
        out = flooding.reconstruct(px, "s", "m")
        assert out.columns == [*px.columns, "level"]
        assert {(r.image_id, r.y, r.x): r.level for r in out.collect()} == expected, block
    assert {v for (i, _, _), v in expected.items() if i == 2} == {7}
    odd = spark.createDataFrame([(None, 0, 0, 1.5, 2.0), (None, 0, 1, 0.0, 1.0), (None, 0, 2, None, 5.0), (None, 0, 3, 4.0, float("nan")), (None, 0, 4, 0.5, 0.7)], "image_id int, y int, x int, s double, m double")
    assert {(r.x, r.level) for r in flooding.reconstruct(odd, "s", "m").collect()} == {(0, 1.5), (1, 1.0), (4, 0.5)}
    assert flooding.reconstruct(px.limit(0), "s", "m").count() == 0
    with pytest.raises(ValueError):
        flooding.reconstruct(px, "s", "m", connectivity=6)


def test_regional_maxima_equal_whole_images(spark, sf):
    from florascan.plans import QUERIES

    rows = QUERIES["e3_regional_maxima"](spark, sf).collect()
    assert len(rows) == fx.px(spark, sf).count()
    for image in {r.image_id for r in rows}:
        own = {(r.y, r.x): r for r in rows if r.image_id == image}
        smooth = {p: r.smooth for p, r in own.items()}
        ends = [f(p[k] for p in own) for k in (0, 1) for f in (min, max)]
        seed = {(y, x): v - 5 if y in ends[:2] or x in ends[2:] else min(smooth.values()) for (y, x), v in smooth.items()}
        expected = reconstructed(seed, smooth)
        assert all(abs(own[p].background - v) < 1e-9 and abs(own[p].peak - (smooth[p] - v)) < 1e-5 for p, v in expected.items())


def test_watersheds_equal_whole_images(spark, sf, monkeypatch):
    import random

    from florascan.operators import blocks, flooding
    from florascan.plans import QUERIES

    rng = random.Random(8)
    levels = {0: random_levels(3), 1: random_levels(4), 2: {p: 3 for p in winding(9)}, 3: {(0, 0): 1}}
    markers = {i: {p: rng.randrange(9) for p in rng.sample(sorted(own), 5)} for i, own in levels.items() if i < 2} | {2: {(0, 0): 4, (8, 0): -3}}
    px = spark.createDataFrame([(i, y, x, v) for i, own in levels.items() for (y, x), v in own.items()], "image_id int, y int, x int, v int")
    seeds = spark.createDataFrame([(i, y, x, m) for i, own in markers.items() for (y, x), m in own.items()], "image_id int, y int, x int, label int")
    for block, four in ((256, False), (8, True)):
        monkeypatch.setattr(blocks, "BLOCK", block)
        expected = {(i, *p, m) for i in markers for p, m in flooded(levels[i], markers[i], four).items()}
        got = flooding.watershed(px, "v", seeds, 4 if four else 8)
        assert {tuple(r) for r in got.collect()} == expected, (block, four)
    monkeypatch.setattr(blocks, "BLOCK", 256)
    kept = {tuple(r) for r in flooding.watershed(px, "v", seeds, lines=True).collect()}
    whole = {(i, y, x): m for i in markers for (y, x), m in flooded(levels[i], markers[i]).items()}
    assert kept == {(i, y, x, m) for (i, y, x), m in whole.items() if all(whole.get((i, y + dy, x + dx), m) >= m for dy in (-1, 0, 1) for dx in (-1, 0, 1))}
    # repeated places, markers outside, null levels and labels, no markers, no pixels
    odd = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 0, 2), (1, 0, 1, None), (1, 0, 2, 1), (None, 0, 0, 1)], "image_id int, y int, x int, v int")
    at = spark.createDataFrame([(1, 0, 0, 7), (1, 0, 0, 6), (1, 9, 9, 1), (1, 0, 2, None), (None, 0, 0, 2)], "image_id int, y int, x int, label int")
    assert {tuple(r) for r in flooding.watershed(odd, "v", at).collect()} == {(1, 0, 0, 6), (None, 0, 0, 2)}
    assert flooding.watershed(px, "v", seeds.limit(0)).count() == 0 == flooding.watershed(px.limit(0), "v", seeds).count()
    pixels, got = fx.px(spark, sf).collect(), {}
    for r in QUERIES["e4_watershed"](spark, sf).collect():
        got.setdefault(r.image_id, {})[r.y, r.x] = r.label
    dark = {(r.image_id, r.y, r.x): r.label for r in objects.label_objects(fx.px(spark, sf).filter("g < 70"), 4).collect()}
    assert got
    for image in {r.image_id for r in pixels}:
        level = {(r.y, r.x): r.g for r in pixels if r.image_id == image}
        assert got.get(image, {}) == flooded(level, {(y, x): m for (i, y, x), m in dark.items() if i == image})


def test_perspective_of_known_quadrilaterals(spark):
    from florascan.operators import perspective

    px = spark.createDataFrame([(1, y, x, 10 * y + x, y, x) for y in range(10) for x in range(10)], "image_id int, y int, x int, b int, g int, r int")
    names = [f"{c}_{at}" for c in perspective.CORNERS for at in ("y", "x")]

    def quad(*places):
        return spark.createDataFrame([(1, *[v for p in places for v in p])], "image_id int, " + ", ".join(f"{n} int" for n in names))

    whole = quad((0, 0), (0, 9), (9, 9), (9, 0))
    for method in ("linear", "nearest"):
        assert sorted(perspective.fix_perspective(px, whole, 10, 10, method=method).collect()) == sorted(px.collect())
    # corners of any quadrilateral land on the corners; a turned one turns the image
    slanted = ((1, 2), (0, 8), (9, 7), (7, 0))
    out = {(r.y, r.x): (r.g, r.r) for r in perspective.fix_perspective(px, quad(*slanted), 5, 4).collect()}
    assert len(out) == 20 and [out[c] for c in ((0, 0), (0, 4), (3, 4), (3, 0))] == list(slanted)
    turned = {(r.y, r.x): r.b for r in perspective.fix_perspective(px, quad((0, 9), (9, 9), (9, 0), (0, 0)), 10, 10).collect()}
    assert all(turned[y, x] == 10 * x + 9 - y for y in range(10) for x in range(10))
    # outside is 0, a line has no projection, images without corners are left out
    outside = {(r.y, r.x): r.b for r in perspective.fix_perspective(px, quad((-5, -5), (-5, 9), (9, 9), (9, -5)), 15, 15).collect()}
    assert outside[0, 0] == 0 and outside[14, 14] == 99 and len(outside) == 225
    assert perspective.fix_perspective(px, quad((0, 0), (3, 3), (6, 6), (9, 9)), 5, 5).count() == 0
    assert perspective.fix_perspective(px, whole.limit(0), 5, 5).count() == 0
    assert perspective.fix_perspective(px, whole, 1, 1).collect()[0].b == 0
    with pytest.raises(ValueError):
        perspective.fix_perspective(px, whole, 5, 5, method="cubic")


def test_dots_become_corners(spark):
    from florascan.operators import perspective

    own = [(cy + dy, cx + dx) for cy, cx in ((3, 4), (5, 30), (26, 33), (28, 3), (15, 15)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)] + [(0, 0), (0, 38)]
    mask = spark.createDataFrame([(1, y, x) for y, x in own], "image_id int, y int, x int")
    px = spark.createDataFrame([(i, y, x) for i in (1, 2) for y in range(30) for x in range(40)], "image_id int, y int, x int")
    found = perspective.dots(mask, 4, 100)
    assert {(r.cy, r.cx) for r in found.collect()} == {(3, 4), (5, 30), (26, 33), (28, 3), (15, 15)}
    assert [tuple(r) for r in perspective.corners(found, px).collect()] == [(1, 3, 4, 5, 30, 26, 33, 28, 3)]
    assert perspective.corners(perspective.dots(mask.limit(0)), px).count() == 0

import math
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from meridion.operators.kernels.projection import RingOptions
from meridion.operators.projection import project_rings, round_ladder, world_summary
from meridion.operators.scene import build_scene, drag, graticule, label_candidates, place_labels, scene_bounds, unfold_frames, unfold_guides, with_presentation, write_svg, zoomed

SHAPES = [("a", "left", [(-10, -20), (30, -20), (30, 25), (-10, 25)]), ("b", "left", [(170, -20), (-170, -20), (-170, 20), (170, 20)]), ("c", "right", [(-180, -80), (-90, -80), (0, -80), (90, -80)])]


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [(i, 0, "exterior", side, [tuple(math.radians(v) for v in p) for p in pts]) for i, side, pts in SHAPES]
    return spark.createDataFrame(rows, "stable_id string, ring_index int, role string, side string, points array<struct<lon: double, lat: double>>")


def test_projection_table(spark, shapes):
    bad = shapes.limit(1).withColumn("points", F.slice("points", 1, 2)).withColumn("stable_id", F.lit("d"))
    out = project_rings(shapes.union(bad))
    got = {r.stable_id: (r.n_pieces, r.error, r.within_budget) for r in out.collect()}
    assert got == {"a": (1, "none", True), "b": (2, "none", True), "c": (1, "none", True), "d": (0, "ring_invalid", False)}
    whole = world_summary(out.where("error = 'none'")).first()
    assert (whole.rings, whole.pieces, whole.split_rings, whole.within_budget) == (3, 4, 1, True)
    ladder = round_ladder(shapes.where("stable_id = 'a'"), RingOptions(), (1, 12)).collect()
    assert {r.limit: r.error for r in ladder} == {1: "piece_projection_failed", 12: "none"}
    assert project_rings(shapes.limit(0)).count() == 0


@pytest.mark.parametrize(("kind", "fills"), [("globe_preview", 0), ("globe", 1), ("sinusoidal", 4), ("mollweide", 4)])
def test_scene(shapes, tmp_path, kind, fills):
    options = RingOptions(relative_error=1e-5, geometric_tolerance=2000.0, area_tolerance=1e8)
    scene = build_scene(shapes, kind, (0.3, 0.2) if "globe" in kind else (0.0, 0.0), options).persist()
    bounds = scene_bounds(scene).first().asDict()
    assert bounds["error"] == "none" and bounds["failed"] == 0 and bounds["fill_rings"] == fills
    write_svg(tmp_path / "s.svg", [(scene, bounds)])
    root = ET.parse(tmp_path / "s.svg").getroot()
    land = [p for p in root.iter() if p.get("class") == "land"]
    assert len(land) == scene.where(F.size("fills") > 0).count() and all("Z" in p.get("d") for p in land)


def test_presentation(spark, shapes):
    props = spark.createDataFrame([(i, [("name", "text", None, None, None, n), ("adm0_a3", "text", None, None, None, n[:3])]) for i, n in (("a", "Alpha"), ("b", "Beta"))], "stable_id string, properties array<struct<key: string, type_id: string, b: boolean, i: long, d: double, s: string>>")
    scene = build_scene(shapes, "sinusoidal", (0.0, 0.0), RingOptions(relative_error=1e-5, geometric_tolerance=2000.0, area_tolerance=1e8))
    shown = with_presentation(scene, props).persist()
    assert {r.stable_id: (r.label, r.style_key) for r in shown.collect()} == {"a": ("Alpha", "Alp"), "b": ("Beta", "Bet"), "c": (None, "c")} and not shown.first().political
    bounds = scene_bounds(scene).first().asDict()
    assert label_candidates(shown, bounds).count() == 0  # not all features have a name and a code
    named = shown.where("label is not null").withColumn("political", F.lit(True))
    assert [r.label for r in place_labels(label_candidates(named, bounds)).orderBy("rank").collect()] == ["Alpha", "Beta"]


BOUNDS = {"min_x": 0.0, "max_x": 856.0, "min_y": 0.0, "max_y": 436.0}  # one metre a pixel in the default viewport


def plane(spark, boxes):
    rows = [(i, label, [[(float(p), float(q)) for p, q in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]], True) for i, label, x, y, w, h in boxes]
    return spark.createDataFrame(rows, "stable_id string, label string, fills array<array<struct<x: double, y: double>>>, political boolean")


def test_label_rules(spark):
    boxes = [("ok", "ok", 100, 100, 42, 18), ("narrow", "n", 300, 100, 41.9, 50), ("low", "l", 400, 100, 60, 17.9), ("edge", "e", -120, 100, 90, 60), ("empty", "", 500, 100, 60, 60), ("in", "i", 600, 300, 80, 80)]
    got = {r.stable_id: r for r in label_candidates(plane(spark, boxes), BOUNDS).collect()}
    assert set(got) == {"ok", "in"}
    assert got["in"].size == pytest.approx(6400) and got["in"].width == 15 and got["in"].height == 18 and got["in"].left == pytest.approx(got["in"].x - 7.5)
    assert label_candidates(plane(spark, boxes).withColumn("political", F.lit(False)), BOUNDS).count() == 0


def test_thirty_of_sixty_crowded_labels_are_drawn(spark):
    """Two shapes share each place; the larger one's label is drawn, and the search goes on until there are thirty."""
    boxes = [(f"{side}{k:02d}", "xx", 80 * (k % 10) + 10, 60 * (k // 10) + 10 , 50 + (20 if side == "b" else 0) + k / 10, 30 + k / 10) for k in range(40) for side in "ab"]
    placed = place_labels(label_candidates(plane(spark, boxes), BOUNDS)).orderBy("rank").collect()
    assert len(placed) == 30 and [r.stable_id for r in placed] == [f"b{k:02d}" for k in range(39, 9, -1)]
    near = [("a", "xx", 100, 100, 60, 40), ("b", "xx", 100, 100 + 19, 60, 40.001), ("c", "xx", 100, 100 + 38, 60, 40.002)]
    assert [r.stable_id for r in place_labels(label_candidates(plane(spark, near), BOUNDS)).orderBy("rank").collect()] == ["c", "a"]


def test_unfold(spark):
    assert graticule(spark).select("line_id").distinct().count() == 24
    frames = unfold_frames(unfold_guides(spark), [0.0, 0.5, 1.0])
    ends = frames.groupBy("progress").agg(F.max("guide_opacity").alias("g"), F.max("globe_opacity").alias("a"), F.max("flat_opacity").alias("b")).orderBy("progress").collect()
    assert [(round(r.g, 9), r.a, r.b) for r in ends] == [(0.0, 1.0, 0.0), (1.0, 0.5, 0.5), (0.0, 0.0, 1.0)]
    assert drag((179.9, 89), -10, 10, 1.0) == pytest.approx((-177.6, 89.5)) and zoomed(1, 100) == 8 and zoomed(1, -100) == 0.55

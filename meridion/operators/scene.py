"""Scenes of features: fills, outlines, labels, graticules, the unfold transition, and SVG sinks.

Feature rows are (stable_id, ring_index, role, side, points) with radians; a scene is one row a feature.
"""

from __future__ import annotations

import math
from dataclasses import replace
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.functions.constants import PI
from meridion.functions.geodesy import globe_point, lit, mix, project_point, smoothstep
from meridion.functions.text import FNV_BASIS, FNV_PRIME, PALETTE, property_value

from .kernels.globe import CurveOptions, PolygonOptions, VerifiedOptions
from .kernels.projection import RingOptions
from .kernels.sphere import R, camera
from .projection import globe_curves, globe_fill, project_rings
from .rings import centroid, planar_area

PREVIEW = CurveOptions(tolerance=25_000.0, horizon_tolerance=0.01, max_depth=24)
GLOBE = VerifiedOptions(PolygonOptions(CurveOptions(tolerance=5000.0, horizon_tolerance=0.01), arc_tolerance=500.0), max_rounds=18)
FLAT = RingOptions(relative_error=1e-7, absolute_error=1e4, geometric_tolerance=2000.0, area_tolerance=1e8, max_rounds=18)
LABELS = 30


def _gathered(df: DataFrame, fills: str, outlines: str, error: Column) -> DataFrame:
    """One row a feature: all rings' parts in the order of their index."""
    own = df.select("stable_id", "ring_index", F.col(fills).alias("f") if fills else F.array().alias("f"), F.col(outlines).alias("o"), error.alias("e"))
    parts = F.array_sort(F.collect_list(F.struct("ring_index", "f", "o")))
    out = own.groupBy("stable_id").agg(parts.alias("p"), F.max(F.when(F.col("e") != "none", F.col("e"))).alias("error"))
    return out.select(
        "stable_id", F.flatten(F.transform("p", lambda x: x["f"])).alias("fills"), F.flatten(F.transform("p", lambda x: x["o"])).alias("outlines"), F.coalesce("error", F.lit("none")).alias("error")
    )


def globe_preview(rings: DataFrame, view: tuple[float, float], options: CurveOptions = PREVIEW) -> DataFrame:
    """Outlines only, coarse."""
    seen = globe_curves(rings, view, options).withColumn("f", F.slice("parts", 1, 0))
    return _gathered(seen, "f", "parts", F.col("error"))


def globe_scene(rings: DataFrame, view: tuple[float, float], options: VerifiedOptions = GLOBE) -> DataFrame:
    """Verified fills, and coastlines computed on their own; a ring whose crossings differ between the two is an error."""
    fill = globe_fill(rings, view, options).select("stable_id", "ring_index", "rings", F.col("crossings").alias("fill_crossings"), F.col("error").alias("fill_error"))
    coast = globe_curves(rings, view, options.polygon.curve).select("stable_id", "ring_index", "parts", "crossings", "error")
    both = coast.join(fill, ["stable_id", "ring_index"], "full_outer")
    error = (
        F.when(F.coalesce("fill_error", F.lit("fill_missing")) != "none", F.coalesce("fill_error", F.lit("fill_missing"))).when(F.coalesce("error", F.lit("coast_missing")) != "none", F.coalesce("error", F.lit("coast_missing")))
        .when(F.col("crossings") != F.col("fill_crossings"), "crossings_differ").otherwise("none")
    )
    return _gathered(both, "rings", "parts", error)


def flat_scene(rings: DataFrame, options: RingOptions = FLAT) -> DataFrame:
    """Verified pieces on the plane, as fills and outlines."""
    out = project_rings(rings, options)
    return _gathered(out, "pieces", "pieces", out["error"])


def build_scene(rings: DataFrame, kind: str, view: tuple[float, float] = (0.0, 0.0), options: RingOptions = FLAT) -> DataFrame:
    if kind == "globe_preview":
        return globe_preview(rings, view)
    if kind == "globe":
        return globe_scene(rings, view)
    if kind in ("sinusoidal", "mollweide"):
        return flat_scene(rings, replace(options, primitive=kind, central_meridian=view[0]))
    raise ValueError(f"unknown scene {kind}")


def scene_bounds(scene: DataFrame) -> DataFrame:
    """One row: bounds over all outline points, counters, and an error if there is no extent."""
    xs = F.transform(F.flatten("outlines"), lambda p: p["x"])
    ys = F.transform(F.flatten("outlines"), lambda p: p["y"])
    out = scene.agg(
        F.min(F.array_min(xs)).alias("min_x"), F.max(F.array_max(xs)).alias("max_x"), F.min(F.array_min(ys)).alias("min_y"), F.max(F.array_max(ys)).alias("max_y"),
        F.sum(F.size("fills")).alias("fill_rings"), F.sum(F.size("outlines")).alias("outline_parts"), F.sum(F.size(F.flatten("fills"))).alias("fill_vertices"), F.sum(F.size(F.flatten("outlines"))).alias("outline_vertices"),
        F.count_if(F.col("error") != "none").alias("failed"),
    )
    good = F.coalesce((F.col("max_x") > F.col("min_x")) & (F.col("max_y") > F.col("min_y")), F.lit(False))
    return out.withColumn("error", F.when(good, "none").otherwise("invalid_bounds"))


def with_presentation(scene: DataFrame, features: DataFrame) -> DataFrame:
    """Adds label, style_key and palette from feature properties, and whether all features have both."""
    own = features.select("stable_id", property_value(F.col("properties"), "name", "text").alias("label"), property_value(F.col("properties"), "adm0_a3", "text").alias("code"))
    out = scene.join(own, "stable_id", "left").withColumn("style_key", F.coalesce("code", "stable_id"))
    whole = out.agg((F.count_if(F.col("label").isNull() | F.col("code").isNull()) == 0).alias("political"))
    return out.drop("code").withColumn("palette", palette("style_key")).crossJoin(F.broadcast(whole))  # one row


def palette(key: str) -> Column:
    """The palette index of a key: a 64-bit multiplicative hash, in decimals so that nothing overflows."""
    wide = "decimal(38,0)"
    turn = F.lit(str(1 << 64)).cast(wide)
    low, high = FNV_PRIME & 0xFFFFFF, FNV_PRIME >> 24  # the product is taken in two parts that fit

    def step(h: Column, byte: Column) -> Column:
        last = (h % F.lit(256).cast(wide)).cast("long")
        x = (h - last.cast(wide) + last.bitwiseXOR(byte).cast(wide)).cast(wide)
        part = ((x * F.lit(low).cast("decimal(8,0)")).cast(wide)) % turn
        upper = (((x % F.lit(1 << 40).cast(wide)).cast("decimal(14,0)") * F.lit(high).cast("decimal(6,0)")).cast(wide) * F.lit(1 << 24).cast("decimal(8,0)")).cast(wide) % turn
        return ((part + upper).cast(wide) % turn).cast(wide)

    data = F.encode(F.col(key), "UTF-8")
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    codes = F.when(F.octet_length(data) > 0, codes).otherwise(F.array().cast("array<bigint>"))
    return (F.aggregate(codes, F.lit(FNV_BASIS).cast(wide), step) % F.lit(PALETTE).cast(wide)).cast("int")


def label_candidates(
    scene: DataFrame, bounds: dict, width: float = 960.0, height: float = 540.0, char_width: float = 7.0, line_height: float = 14.0, margin: float = 52.0,
) -> DataFrame:
    """Labels that may be drawn in a viewport, at the centroid of their largest ring: (stable_id, label, size, x, y, left, top, width, height).

    Only political scenes have any. A ring must be 42 x 18 pixels at least, its centroid 8 pixels inside the
    viewport. The box is the text's, with 4 pixels beside and 2 above and below; size is the ring's box on screen.
    """
    largest = F.element_at(F.array_sort(F.transform("fills", lambda r, i: F.struct(F.abs(planar_area(r)).alias("a"), (-i).alias("i"), r.alias("r")))), -1)

    def once(df: DataFrame, name: str, value: Column) -> DataFrame:
        """A column that is computed once a row, however often what follows mentions it: the optimizer doesn't write out what is exploded."""
        return df.select("*", F.explode(F.array(value)).alias(name))

    own = once(scene.where(F.col("political") & (F.length("label") > 0) & (F.size("fills") > 0)).select("stable_id", "label", "fills"), "l", largest).where(F.col("l.a") > 0)
    ring = F.transform(to_screen(F.array("l.r"), bounds, width, height, margin)[0], lambda p: F.struct(p["sx"].alias("x"), p["sy"].alias("y")))
    own = once(own.select("stable_id", "label", "l"), "plane", ring)
    xs, ys = F.transform("plane", lambda p: p["x"]), F.transform("plane", lambda p: p["y"])
    own = once(own, "box", F.struct((F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))).where((F.col("box.w") >= 42) & (F.col("box.h") >= 18))
    own = once(own, "c", centroid(F.col("plane"))).select("stable_id", "label", F.col("box.w").alias("w"), F.col("box.h").alias("h"), "c")
    x, y = F.col("c.x"), F.col("c.y")
    box_width, box_height = F.length("label") * lit(char_width) + lit(8), lit(line_height + 4)
    own = own.where(x.between(8, width - 8) & y.between(8, height - 8))
    out = own.select("stable_id", "label", (F.col("w") * F.col("h")).alias("size"), x.alias("x"), y.alias("y"), (x - box_width / lit(2)).alias("left"), (y - box_height / lit(2)).alias("top"), box_width.alias("width"), box_height.alias("height"))
    return out.where((F.col("left") < width) & (F.col("left") + F.col("width") > 0) & (F.col("top") < height) & (F.col("top") + F.col("height") > 0))


def place_labels(candidates: DataFrame, most: int = LABELS) -> DataFrame:
    """Greedy placement, larger shapes first, then by id, until ``most`` labels are drawn: (stable_id, label, x, y, rank).

    A label may not come within 3 pixels beside or 2 above and below a drawn one's box. Candidates come to the
    driver in order, a partition at a time, and only as many as it takes.
    """
    taken: list[tuple] = []
    placed = []
    for r in candidates.orderBy(F.desc("size"), "stable_id").toLocalIterator():
        if len(placed) >= most:
            break
        box = (r.left, r.left + r.width, r.top, r.top + r.height)
        if not any(box[0] < b[1] + 3 and b[0] - 3 < box[1] and box[2] < b[3] + 2 and b[2] - 2 < box[3] for b in taken):
            taken.append(box)
            placed.append((r.stable_id, r.label, r.x, r.y, len(placed) + 1))
    return candidates.sparkSession.createDataFrame(placed, "stable_id string, label string, x double, y double, rank int")


def graticule(spark: SparkSession) -> DataFrame:
    """(line_id, kind, idx, lon, lat): 11 meridians, 11 parallels and both seams, every 5 degrees."""
    deg = lit(PI / 180)
    meridians = spark.range(-150, 151, 30).select(F.concat(F.lit("m"), "id").alias("line_id"), F.lit("meridian").alias("kind"), F.col("id").alias("lon"), F.explode(F.sequence(F.lit(-90), F.lit(90), F.lit(5))).alias("lat"))
    parallels = spark.range(-75, 76, 15).select(F.concat(F.lit("p"), "id").alias("line_id"), F.lit("parallel").alias("kind"), F.explode(F.sequence(F.lit(-180), F.lit(180), F.lit(5))).alias("lon"), F.col("id").alias("lat"))
    seams = spark.range(-180, 181, 360).select(F.concat(F.lit("s"), "id").alias("line_id"), F.lit("seam").alias("kind"), F.col("id").alias("lon"), F.explode(F.sequence(F.lit(-90), F.lit(90), F.lit(5))).alias("lat"))
    all_ = meridians.union(parallels.select("line_id", "kind", "lon", "lat")).union(seams)
    idx = F.when(F.col("kind") == "parallel", (F.col("lon") + 180) / 5).otherwise((F.col("lat") + 90) / 5).cast("int")
    return all_.select("line_id", "kind", idx.alias("idx"), (F.col("lon") * deg).alias("lon"), (F.col("lat") * deg).alias("lat"))


def unfold_guides(spark: SparkSession, view: tuple[float, float] = (0.0, 0.0), primitive: str = "sinusoidal") -> DataFrame:
    """Graticule points on the globe (gx, gy, depth) and on the map (fx, fy)."""
    g = graticule(spark)
    lon = F.col("lon") + lit(view[0])
    seen = globe_point(lon, F.col("lat"), camera(*view).tolist())
    flat = project_point(F.col("lon"), F.col("lat"), primitive)
    return g.select("line_id", "kind", "idx", seen.alias("g"), flat.alias("f")).select("line_id", "kind", "idx", F.col("g.x").alias("gx"), F.col("g.y").alias("gy"), F.col("g.depth").alias("depth"), F.col("f.x").alias("fx"), F.col("f.y").alias("fy"))


def unfold_frames(guides: DataFrame, progress: list[float]) -> DataFrame:
    """Guide points at each step of the transition: positions move by the smoothstep, hidden ones fade in."""
    p = F.explode(F.array(*[lit(x) for x in progress]))
    out = guides.withColumn("progress", p).withColumn("s", smoothstep(F.col("progress")))
    seen = F.when(F.col("depth") >= lit(0), lit(1)).otherwise(F.col("s"))
    return out.select(
        "progress", "line_id", "idx", mix(F.col("gx"), F.col("fx"), F.col("s")).alias("x"), mix(F.col("gy"), F.col("fy"), F.col("s")).alias("y"),
        (F.sin(lit(PI) * F.col("s")) * seen).alias("guide_opacity"), (lit(1) - F.col("s")).alias("globe_opacity"), F.col("s").alias("flat_opacity"),
    )


def frame_bounds(globe: dict, flat: dict, progress: float) -> dict:
    s = progress**3 * (progress * (progress * 6 - 15) + 10)
    return {k: globe[k] + (flat[k] - globe[k]) * s for k in ("min_x", "max_x", "min_y", "max_y")}


def path_data(rings: Column, closed: bool = True) -> Column:
    """The SVG path of plane rings, y downwards, two decimals."""

    def one(ring: Column) -> Column:
        points = F.transform(ring, lambda p: F.format_string("%.2f %.2f", p["sx"], p["sy"]))
        return F.concat(F.lit("M"), F.array_join(points, "L"), F.lit("Z" if closed else ""))

    return F.array_join(F.transform(F.filter(rings, lambda r: F.size(r) > 1), one), "")


def to_screen(rings: Column, bounds: dict, width: float, height: float, margin: float = 52.0) -> Column:
    scale = min((width - 2 * margin) / (bounds["max_x"] - bounds["min_x"]), (height - 2 * margin) / (bounds["max_y"] - bounds["min_y"]))
    cx, cy = (bounds["min_x"] + bounds["max_x"]) / 2, (bounds["min_y"] + bounds["max_y"]) / 2
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct((lit(width / 2) + (p["x"] - lit(cx)) * lit(scale)).alias("sx"), (lit(height / 2) - (p["y"] - lit(cy)) * lit(scale)).alias("sy"))))


def write_svg(path: str | Path, panels: list[tuple[DataFrame, dict]], width: float = 960.0, height: float = 540.0, fill: bool = True, graticule_lines: DataFrame | None = None) -> int:
    """Panels of scenes below one another, features in the order of their ids, streamed row by row; returns the paths written."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} {height * len(panels):g}">\n')
        for k, (scene, bounds) in enumerate(panels):
            f.write(f'<g transform="translate(0 {k * height:g})">\n')
            if graticule_lines is not None:
                lines = graticule_lines.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y"))).alias("l")).select("line_id", F.array("l").alias("l"))
                for r in lines.select("line_id", path_data(to_screen(F.col("l"), bounds, width, height), False).alias("d")).orderBy("line_id").toLocalIterator():
                    f.write(f'<path class="guide" d="{r.d}" fill="none" stroke="#bbb" stroke-width="0.4"/>\n')
            rows = scene.select("stable_id", path_data(to_screen(F.col("fills"), bounds, width, height)).alias("fill"), path_data(to_screen(F.col("outlines"), bounds, width, height), False).alias("line"))
            for r in rows.orderBy("stable_id").toLocalIterator():
                if fill and r.fill:
                    f.write(f'<path class="land" d="{r.fill}" fill="#d9d2c0" fill-rule="evenodd"/>\n')
                    n += 1
                if r.line:
                    f.write(f'<path class="coast" d="{r.line}" fill="none" stroke="#333" stroke-width="0.6"/>\n')
                    n += 1
            f.write("</g>\n")
        f.write("</svg>\n")
    return n


GLOBE_BOUNDS = {"min_x": -R, "max_x": R, "min_y": -R, "max_y": R}


def drag(view: tuple[float, float], dx: float, dy: float, zoom: float, per_pixel: float = 0.25) -> tuple[float, float]:
    """A camera in degrees after a drag: longitude wraps into [-180, 180), latitude stops at 89.5."""
    lon = (view[0] - dx * per_pixel / zoom + 180) % 360 - 180
    return lon, float(np.clip(view[1] + dy * per_pixel / zoom, -89.5, 89.5))


def zoomed(zoom: float, steps: float) -> float:
    return float(np.clip(zoom * math.pow(1.12, steps), 0.55, 8))

"""Queries of the globe, the subdivision and the checks on rings, against closed forms in SQL.

A camera over the north pole sees a cell between two parallels as a sector of a ring, whose area is known.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridion.functions import geodesy as g
from meridion.functions.constants import PI, RADIANS, SEMI_MAJOR, TWO_PI
from meridion.operators import ordered
from meridion.operators.kernels.curves import chord_distance, subdivide_groups
from meridion.operators.kernels.globe import CurveOptions, PolygonOptions, VerifiedOptions, arc_segments, limb_arc, visible_curve
from meridion.operators.kernels.projection import RingOptions
from meridion.operators.kernels.rings import canonicalise
from meridion.operators.kernels.sphere import camera, is_rotation
from meridion.operators.projection import globe_curves, globe_fill, project_rings, round_ladder, split_rings, spread
from meridion.operators.rings import canonical_ring, centroid, rectangle, stored_ring_error, unwrapped, without_repeated_end
from meridion.operators.scene import build_scene, graticule, label_candidates, path_data, place_labels, scene_bounds, to_screen, unfold_frames, unfold_guides, with_presentation

from .catalogue import _GRAT, R, _c_area, _concave, beta_sql, d, q_sql, query, r_sql, rounded, table

POLE = (0.0, PI / 2)


def _sector_parts(key: Column) -> tuple[Column, Column, Column, Column]:
    """West, width, south and north in degrees; one of seven cells in the south is out of sight and others lie over the limb."""
    south = (key * 104729 % 14000).cast("double") / g.lit(100) - g.lit(70.5)
    return (key * 7919 % 36000).cast("double") / g.lit(100) - g.lit(180), (10 + key % 30).cast("double"), south, F.least(south + (5 + key % 15).cast("double"), g.lit(85))


def _sectors(df: DataFrame, key: str) -> DataFrame:
    west, width, south, north = _sector_parts(F.col(key))
    return df.select(key, rectangle(*[g.radians(x) for x in (west, south, west + width, north)]).alias("points"), F.lit("left").alias("side"))


def _sector_sql(key: str, name: str) -> str:
    return f"(SELECT {key}, south, least(south + CAST(5 + {key} % 15 AS DOUBLE), 85e0) AS north, CAST(10 + {key} % 30 AS DOUBLE) AS width FROM (SELECT {key}, CAST({key} * 104729 % 14000 AS DOUBLE) / 1e2 - 70.5e0 AS south FROM {name}))"


def _cos2(x: str) -> str:
    return f"pow(cos({beta_sql(f'({x} * {d(RADIANS)})')}), 2e0)"


_AREA = f"({d(R * R / 2 * RADIANS)} * width * greatest(0e0, {_cos2('greatest(south, 0e0)')} - {_cos2('greatest(north, 0e0)')}))"


@query(f"""SELECT s_suppkey, CASE WHEN north > 0 THEN 1 ELSE 0 END AS parts, CASE WHEN south < 0 AND north > 0 THEN 2 ELSE 0 END AS crossings, south > 0 AS closed, 'none' AS error FROM {_sector_sql('s_suppkey', 'supplier')}""")
def globe_curve_parts(spark, sf_dir):
    out = globe_curves(spread(_sectors(table(spark, sf_dir, "supplier"), "s_suppkey"), "s_suppkey"), POLE)
    return out.select("s_suppkey", F.size("parts").alias("parts"), "crossings", "closed", "error")


@query(f"""SELECT s_suppkey, CASE WHEN north > 0 THEN 1 ELSE 0 END AS rings, CASE WHEN south < 0 AND north > 0 THEN 2 ELSE 0 END AS crossings, {r_sql(f'{_AREA} / 1e9', 0)} AS area_1000km2, CASE WHEN north > 0 THEN 1 ELSE 0 END AS significant, 0 AS negligible,
CASE WHEN south < 0 AND north > 0 THEN 'none' ELSE 'minor' END AS coverage, south < 0 AND north > 0 AS limb_arcs, true AS settled, 'none' AS error FROM {_sector_sql('s_suppkey', 'supplier')}""")
def globe_fill_verified(spark, sf_dir):
    options = VerifiedOptions(PolygonOptions(CurveOptions(tolerance=200.0), arc_tolerance=200.0), relative_change=1e-6, max_rounds=18)
    out = globe_fill(spread(_sectors(table(spark, sf_dir, "supplier"), "s_suppkey"), "s_suppkey"), POLE, options)
    return out.select(
        "s_suppkey", F.size("rings").alias("rings"), "crossings", rounded(F.col("region_area") / g.lit(1e9), 0).alias("area_1000km2"), "significant", "negligible", "coverage", (F.col("arc_segments") > 0).alias("limb_arcs"),
        F.col("rounds").between(2, 18).alias("settled"), "error",
    )


@query(f"""SELECT kind, count(*) AS features, count(*) FILTER (shown) AS fill_rings, count(*) FILTER (drawn) AS outline_parts, 0 AS failed, 'none' AS error FROM (
SELECT kind, CASE kind WHEN 'globe_preview' THEN false ELSE north > 0 END AS shown, north > 0 AS drawn FROM {_sector_sql('n_nationkey', 'nation')}, (SELECT unnest(['globe_preview', 'globe']) AS kind)) GROUP BY 1""")
def scene_counters(spark, sf_dir):
    """Preview and verified scenes of one table of features: what is drawn, and that fills and coastlines agree."""
    t = _sectors(table(spark, sf_dir, "nation"), "n_nationkey").select(F.col("n_nationkey").cast("string").alias("stable_id"), F.lit(0).alias("ring_index"), F.lit("exterior").alias("role"), "side", "points")
    out = None
    for kind in ("globe_preview", "globe"):
        scene = build_scene(t, kind, POLE)
        part = scene_bounds(scene).select(F.lit(kind).alias("kind"), F.col("fill_rings"), F.col("outline_parts"), "failed", "error")
        part = part.join(scene.agg(F.count("*").alias("features")), how="cross")  # one row each
        out = part if out is None else out.unionByName(part)
    return out.select("kind", "features", "fill_rings", "outline_parts", "failed", "error")


@query(f"""SELECT limit_, count(*) AS rings, count(*) FILTER (limit_ = 1) AS unmet, {r_sql(f'sum({_c_area("n_nationkey")}) / 1e6', 0)} AS source_km2 FROM nation, (SELECT unnest([1, 18]) AS limit_) GROUP BY 1""")
def refinement_ladder(spark, sf_dir):
    """Each ring with one round and with eighteen: the first is not enough for a tight budget."""
    options = RingOptions("sinusoidal", relative_error=1e-7, geometric_tolerance=50_000.0, area_tolerance=1e12)
    out = round_ladder(_concave(table(spark, sf_dir, "nation"), "n_nationkey"), options, (1, 18))
    return out.groupBy(F.col("limit").alias("limit_")).agg(F.count("*").alias("rings"), F.count_if(F.col("error") == "piece_projection_failed").alias("unmet"), rounded(F.sum("source_area") / g.lit(1e6), 0).alias("source_km2"))


@query(f"""SELECT p_partkey, (SELECT min(k) FROM (SELECT unnest(range(0, 24)) AS k) WHERE r * (1e0 - cos(theta / pow(2e0, k + 1))) <= tol) AS depth, CAST(pow(2e0, (SELECT min(k) FROM (SELECT unnest(range(0, 24)) AS k) WHERE r * (1e0 - cos(theta / pow(2e0, k + 1))) <= tol)) AS BIGINT) + 1 AS points
FROM (SELECT p_partkey, CAST(1000 + p_partkey % 9000 AS DOUBLE) AS r, CAST(10 + p_partkey % 150 AS DOUBLE) * {d(RADIANS)} AS theta, CAST(1 + p_partkey % 37 AS DOUBLE) / 1e1 AS tol FROM part)""")
def subdivided_arcs(spark, sf_dir):
    """Arcs of circles: halves are equal, so the sagitta says how deep the subdivision goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1024):  # arcs that are subdivided together
                batch = whole.slice(at, 1024)
                depth, points = arc_depths(*(batch.column(n).to_numpy() for n in ("r", "theta", "tol")))
                yield pa.RecordBatch.from_arrays([batch.column("p_partkey"), pa.array(depth), pa.array(points)], ["p_partkey", "depth", "points"])

    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select(k, (1000 + k % 9000).cast("double").alias("r"), g.radians((10 + k % 150).cast("double")).alias("theta"), ((1 + k % 37).cast("double") / g.lit(10)).alias("tol"))
    return spread(t, "p_partkey").mapInArrow(run, "p_partkey long, depth long, points long")


def arc_depths(r: np.ndarray, theta: np.ndarray, tol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How deep the arcs of circles are subdivided, all together, and their points."""

    def sample(e: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.stack([r[e] * np.cos(theta[e] * t), r[e] * np.sin(theta[e] * t)], axis=-1)

    curves, _ = subdivide_groups(sample, np.arange(len(r)), lambda e, five: _sagitta(five) <= tol[e], 32, 1 << 20)
    first = np.flatnonzero(np.append(True, curves.edge[1:] != curves.edge[:-1]))
    # The step to the next arc's start is negative.
    step = np.append(np.diff(curves.t), -1.0)
    least = np.minimum.reduceat(np.where(step > 0, step, 1.0), first)
    return np.rint(-np.log2(least)).astype(np.int64), np.diff(np.append(first, len(step)))


def _sagitta(five: np.ndarray) -> np.ndarray:
    return chord_distance(five[:, 1:4], five[:, :1], five[:, 4:]).max(axis=1)


@query(f"""SELECT p_partkey, n, {r_sql('cos(a0 + sweep)', 9)} AS end_x, {r_sql('sin(a0 + sweep)', 9)} AS end_y, n + 1 AS points, {r_sql('CASE WHEN a0 + sweep >= ' + d(TWO_PI) + ' THEN a0 + sweep - ' + d(TWO_PI) + ' ELSE a0 + sweep END', 8)} AS angle FROM (SELECT *, CAST(greatest(1, ceil(sweep / (2e0 * acos(1e0 - tol / {d(R)})))) AS BIGINT) AS n
FROM (SELECT p_partkey, CAST(p_partkey % 628 AS DOUBLE) / 1e2 AS a0, CAST(1 + p_partkey % 300 AS DOUBLE) / 1e2 AS sweep, CAST(50 + p_partkey % 5000 AS DOUBLE) AS tol FROM part))""")
def limb_arcs(spark, sf_dir):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, a0, sweep, tol in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = arc_segments(sweep, tol)
                arc = limb_arc(a0, sweep, n) / R
                rows.append((key, n, float(arc[-1, 0]), float(arc[-1, 1]), len(arc)))
            columns = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], ["p_partkey", "n", "x", "y", "points"])

    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select(k, ((k % 628).cast("double") / g.lit(100)).alias("a0"), ((1 + k % 300).cast("double") / g.lit(100)).alias("sweep"), (50 + k % 5000).cast("double").alias("tol"))
    out = t.mapInArrow(run, "p_partkey long, n long, x double, y double, points long")
    return out.select("p_partkey", "n", rounded(F.col("x"), 9).alias("end_x"), rounded(F.col("y"), 9).alias("end_y"), "points", rounded(g.limb_angle(F.col("x"), F.col("y")), 8).alias("angle"))


def _flawed(key: Column) -> Column:
    """A cell with another flaw for each remainder of seven."""
    a = lambda lon, lat: g.point(g.lit(lon * RADIANS), g.lit(lat * RADIANS))
    cell = [a(10, 10), a(20, 10), a(20, 20), a(10, 20)]
    kinds = [
        F.array(*cell), F.array(*cell[:2]), F.array(a(10, 10), a(190, 10), a(100, 50)), F.array(a(10, 10), a(20, 95), a(20, 20)), F.array(a(10, 10), g.point(g.lit("nan"), g.lit(0.1)), a(20, 20)), F.array(*cell, cell[0]),
        F.array(*cell, a(370, 10)),
    ]
    out = kinds[0]
    for k in range(1, 7):
        out = F.when(key % 7 == k, kinds[k]).otherwise(out)
    return out


@query("""SELECT CASE c_custkey % 7 WHEN 1 THEN 'too_few_vertices' WHEN 2 THEN 'ambiguous_half_turn' WHEN 3 THEN 'latitude_out_of_range' WHEN 4 THEN 'non_finite_coordinate' ELSE 'none' END AS error, count(*) AS rings,
CAST(sum(CASE WHEN c_custkey % 7 IN (0, 5, 6) THEN 4 ELSE 0 END) AS BIGINT) AS vertices FROM customer GROUP BY 1""")
def canonical_ring_errors(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(canonical_ring(_flawed(F.col("c_custkey"))).alias("r"))
    return t.groupBy(F.col("r.error").alias("error")).agg(F.count("*").alias("rings"), F.sum(F.coalesce(F.size("r.value.vertices"), F.lit(0))).alias("vertices"))


@query("SELECT c_custkey % 3 = 0 AS closed, count(*) AS rings, CAST(sum(3 + c_custkey % 5) AS BIGINT) AS vertices FROM customer GROUP BY 1")
def repeated_ends(spark, sf_dir):
    """A repeated first point at the end of a ring goes, also a whole turn away."""
    k = F.col("c_custkey")
    base = F.transform(F.sequence(F.lit(0).cast("long"), 2 + k % 5), lambda i: g.point(g.radians((i * 7 + k % 11).cast("double")), g.radians((i * i % 5).cast("double"))))
    end = g.point(base[0]["lon"] + g.lit(TWO_PI) * (k % 2).cast("double"), base[0]["lat"])
    t = table(spark, sf_dir, "customer").select((k % 3 == 0).alias("closed"), F.size(without_repeated_end(F.when(k % 3 == 0, F.concat(base, F.array(end))).otherwise(base))).alias("n"))
    return t.groupBy("closed").agg(F.count("*").alias("rings"), F.sum("n").alias("vertices"))


@query("""SELECT CASE c_custkey % 6 WHEN 1 THEN 'latitude_out_of_range' WHEN 2 THEN 'longitude_not_canonical' WHEN 3 THEN 'longitude_step_too_long' WHEN 4 THEN 'winding_mismatch' WHEN 5 THEN 'missing_interior_side' ELSE 'none' END AS error, count(*) AS rings FROM customer GROUP BY 1""")
def stored_ring_rules(spark, sf_dir):
    k, r = F.col("c_custkey") % 6, g.lit(RADIANS)
    point = lambda lon, lat: g.point(lon * r, lat * r)
    first, high, far = F.when(k == 2, g.lit(190)).otherwise(g.lit(10)), F.when(k == 1, g.lit(91)).otherwise(g.lit(20)), F.when(k == 3, g.lit(195)).otherwise(g.lit(20))
    winds = F.when(k.isin(4, 5), F.lit(1)).otherwise(F.lit(0))
    # A ring around the pole for the last kind, whose closing longitude is a turn further.
    around = F.array(*[point(g.lit(x), g.lit(80)) for x in (10, 130, 250)])
    plain = F.array(point(first, g.lit(10)), point(F.when(k == 2, g.lit(200)).otherwise(far), g.lit(10)), point(F.when(k == 2, g.lit(200)).otherwise(g.lit(20)), high))
    ring = F.struct(F.when(k == 5, around).otherwise(plain).alias("vertices"), F.when(k == 5, g.lit(370) * r).otherwise(first * r).alias("closing_lon"), winds.alias("winding"), F.lit("unspecified").alias("interior_side"))
    return table(spark, sf_dir, "customer").select(stored_ring_error(ring).alias("error")).groupBy("error").agg(F.count("*").alias("rings"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'seam_coincident_edge' WHEN 2 THEN 'missing_interior_side' ELSE 'nonzero_winding_unsupported' END AS error, CASE WHEN n_nationkey % 4 = 0 THEN 2 ELSE 0 END AS pieces FROM nation""")
def seam_errors(spark, sf_dir):
    """Rings that the seam can't cut: an edge on it, no side, a winding one."""
    k, r = F.col("n_nationkey") % 4, g.lit(RADIANS)
    west = F.when(k == 1, g.lit(180)).otherwise(g.lit(170))
    box = rectangle(g.lit(170) * r, g.lit(-5) * r, g.lit(190) * r, g.lit(5) * r)
    on_seam = F.array(*[g.point(x * r, g.lit(y) * r) for x, y in ((g.lit(170), -5), (west, -5), (g.lit(180), 5), (g.lit(190), 10), (g.lit(170), 10))])
    around = F.array(*[g.point(g.lit(x) * r, g.lit(70) * r) for x in (-170, -60, 60, 170)])
    points = F.when(k == 1, on_seam).when(k == 3, around).otherwise(box)
    out = split_rings(table(spark, sf_dir, "nation").select("n_nationkey", points.alias("points"), F.when(k == 2, "unspecified").otherwise("left").alias("side")))
    return out.select("n_nationkey", "error", F.coalesce(F.size("pieces"), F.lit(0)).alias("pieces"))


_BAD = {"good": {}, "distance": {"geometric_tolerance": 0.0}, "area": {"area_tolerance": float("inf")}, "rounds": {"max_rounds": 0}, "budget": {"relative_error": 0.0, "absolute_error": 0.0}, "primitive": {"primitive": "equal"}, "depth": {"max_depth": 65}}


@query("SELECT variant, CASE WHEN variant = 'good' THEN 'none' ELSE 'invalid_options' END AS error, count(*) AS rings FROM nation, (SELECT unnest([" + ", ".join(f"'{k}'" for k in _BAD) + "]) AS variant) GROUP BY 1, 2")
def option_checks(spark, sf_dir):
    """Options that make no sense are an error of every row, no exception."""
    t, out = _concave(table(spark, sf_dir, "nation"), "n_nationkey"), None
    for name, change in _BAD.items():
        part = project_rings(t, replace(RingOptions(relative_error=1e-4, geometric_tolerance=5000.0, area_tolerance=1e9), **change)).select(F.lit(name).alias("variant"), "error")
        out = part if out is None else out.union(part)
    return out.groupBy("variant", "error").agg(F.count("*").alias("rings"))


@query(f"SELECT c_custkey, {r_sql('x', 6)} AS x, {r_sql('y', 6)} AS y FROM (SELECT c_custkey, CAST(c_custkey % 1000 AS DOUBLE) + CASE WHEN c_custkey % 4 = 0 THEN 5e0 ELSE 0e0 END AS x, CAST(c_custkey % 77 AS DOUBLE) AS y FROM customer)")
def ring_centroids(spark, sf_dir):
    """Regular polygons have their centroid in the middle; a flat ring has the middle of its bounds."""
    k = F.col("c_custkey")
    cx, cy, n = (k % 1000).cast("double"), (k % 77).cast("double"), 3 + k % 6
    angle = lambda i: g.lit(TWO_PI) * i.cast("double") / n.cast("double")
    regular = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: g.planar(cx + g.lit(9) * F.cos(angle(i)), cy + g.lit(9) * F.sin(angle(i))))
    flat = F.array(g.planar(cx, cy), g.planar(cx + g.lit(10), cy), g.planar(cx + g.lit(3), cy))
    t = table(spark, sf_dir, "customer").select("c_custkey", centroid(F.when(k % 4 == 0, flat).otherwise(regular)).alias("c"))
    return t.select("c_custkey", rounded(F.col("c.x"), 6).alias("x"), rounded(F.col("c.y"), 6).alias("y"))


@query("""SELECT grp, seq, CASE WHEN c = last_c AND last_c > 0 AND last_a = first_a THEN 0 ELSE c END AS chain FROM (SELECT *, last(c) OVER w AS last_c, last(a) OVER w AS last_a, first(a) OVER w AS first_a FROM (
SELECT grp, seq, a, CAST(sum(CASE WHEN prev = a THEN 0 ELSE 1 END) OVER (PARTITION BY grp ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS c FROM (SELECT *, lag(a) OVER (PARTITION BY grp ORDER BY seq) AS prev FROM (
SELECT DISTINCT l_suppkey AS grp, l_orderkey AS seq, CAST(floor(l_orderkey / 5) AS BIGINT) % 3 AS a FROM lineitem))) WINDOW w AS (PARTITION BY grp ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""")
def closed_chains(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_orderkey").alias("seq"), (F.floor(F.col("l_orderkey") / 5) % 3).alias("a")).distinct().withColumn("b", F.col("a"))
    chains = ordered.close_chains(ordered.chain_ids(t, "grp", "seq", "a", "b"), "grp", "seq", "a", "b")
    return chains.select("grp", "seq", F.col("chain").cast("long").alias("chain"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS was FROM orders) WHERE was >= o_totalprice")
def increasing_keys(spark, sf_dir):
    return ordered.not_increasing(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey", "o_totalprice")


@query(f"""SELECT c_custkey, {r_sql('sqrt(pow(px - ax - t * (bx - ax), 2e0) + pow(py - ay - t * (by_ - ay), 2e0))', 6)} AS distance, {r_sql('5e-1 * (abs(x1 * y2 - x2 * y1) + abs(x2 * y3 - x3 * y2) + abs(x3 * y4 - x4 * y3))', 4)} AS envelope,
{r_sql('48e1 + (px - 5e2) * s', 6)} AS screen_x, {r_sql('27e1 - (py - 5e2) * s', 6)} AS screen_y FROM (SELECT *, CASE WHEN l > 0 THEN greatest(0e0, least(1e0, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / l)) ELSE 0e0 END AS t, least(856e0 / 1e3, 436e0 / 1e3) AS s,
ax - px AS x1, ay - py AS y1, bx - px AS x2, by_ - py AS y2, ax + bx - px AS x3, ay - by_ - py AS y3, bx - ax - px AS x4, by_ + ay - py AS y4 FROM (SELECT *, pow(bx - ax, 2e0) + pow(by_ - ay, 2e0) AS l FROM (
SELECT c_custkey, CAST(c_custkey * 31 % 997 AS DOUBLE) AS px, CAST(c_custkey * 17 % 991 AS DOUBLE) AS py, CAST(c_custkey % 13 AS DOUBLE) AS ax, CAST(c_custkey % 7 AS DOUBLE) AS ay, CAST(c_custkey % 13 + c_custkey % 5 AS DOUBLE) AS bx, CAST(c_custkey % 7 + c_custkey % 3 AS DOUBLE) AS by_ FROM customer)))""")
def plane_measures(spark, sf_dir):
    """Distances to segments (some of them points), envelopes of five samples, places in a viewport."""
    k = F.col("c_custkey")
    px, py, ax, ay = ((x).cast("double") for x in (k * 31 % 997, k * 17 % 991, k % 13, k % 7))
    bx, by = (k % 13 + k % 5).cast("double"), (k % 7 + k % 3).cast("double")
    view = g.fit_viewport(px, py, {"min_x": 0.0, "max_x": 1000.0, "min_y": 0.0, "max_y": 1000.0}, 960.0, 540.0)
    t = table(spark, sf_dir, "customer").select(
        "c_custkey", rounded(g.segment_distance(px, py, ax, ay, bx, by), 6).alias("distance"), rounded(g.area_envelope([px, ax, bx, ax + bx, bx - ax], [py, ay, by, ay - by, by + ay]), 4).alias("envelope"), view.alias("v"),
    )
    return t.select("c_custkey", "distance", "envelope", rounded(F.col("v.x"), 6).alias("screen_x"), rounded(F.col("v.y"), 6).alias("screen_y"))


@query(f"SELECT c_custkey, {r_sql('lon', 9)} AS lon, {r_sql('lat', 9)} AS lat, n FROM (SELECT c_custkey, (1e1 + CAST(c_custkey % 5 AS DOUBLE) * 25e-1) * {d(RADIANS)} AS lon, (CAST(c_custkey % 5 AS DOUBLE) * 25e-1) * {d(RADIANS)} AS lat, 70 + c_custkey % 100 AS n FROM customer)")
def edge_points(spark, sf_dir):
    """Points of straight edges, and the unwrapping of rings long enough to be summed by blocks."""
    k, r = F.col("c_custkey"), g.lit(RADIANS)
    p = g.edge_point(g.point(g.lit(10) * r, g.lit(0) * r), g.point(g.lit(20) * r, g.lit(10) * r), (k % 5).cast("double") / g.lit(4))
    long = F.transform(F.sequence(F.lit(1).cast("long"), 70 + k % 100), lambda i: g.point(g.lit(0.25) * i.cast("double"), g.lit(0)))
    t = table(spark, sf_dir, "customer").select("c_custkey", p.alias("p"), unwrapped(long).alias("u"))
    # Steps of a quarter: the last longitude tells how many there were.
    return t.select("c_custkey", rounded(F.col("p.lon"), 9).alias("lon"), rounded(F.col("p.lat"), 9).alias("lat"), F.rint(F.element_at("u", -1)["lon"] * g.lit(4)).cast("long").alias("n"))


def _boxes(df: DataFrame, key: str, name: str) -> DataFrame:
    """Two shapes at each place of a grid of forty, the later one larger: (stable_id, label, fills, outlines, political)."""
    k = F.col(key)
    x, y, w, h = ((v).cast("double") for v in (80 * (k % 10) + 10, 60 * (F.floor(k / 10) % 4) + 10, 50 + F.floor(k / 40) % 9, 30 + k % 40))
    ring = F.array(*[g.planar(a, b) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))])
    return df.select(F.lpad(k.cast("string"), 9, "0").alias("stable_id"), F.col(name).alias("label"), F.array(ring).alias("fills"), F.array(ring).alias("outlines"))


_BOX = """SELECT lpad(CAST({0} AS VARCHAR), 9, '0') AS stable_id, {1} AS label, CAST(80 * ({0} % 10) + 10 AS DOUBLE) AS x, CAST(60 * (CAST(floor({0} / 10) AS BIGINT) % 4) + 10 AS DOUBLE) AS y, CAST(50 + CAST(floor({0} / 40) AS BIGINT) % 9 AS DOUBLE) AS w, CAST(30 + {0} % 40 AS DOUBLE) AS h, {0} % 40 AS place FROM {2}"""
_VIEW = {"min_x": 0.0, "max_x": 856.0, "min_y": 0.0, "max_y": 436.0}


@query(f"""SELECT stable_id, label, CAST(rank AS INTEGER) AS rank, {r_sql('52e0 + x + w / 2e0', 6)} AS x, {r_sql('488e0 - y - h / 2e0', 6)} AS y FROM (SELECT *, row_number() OVER (ORDER BY w * h DESC, stable_id) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY place ORDER BY w * h DESC, stable_id) AS nth FROM ({_BOX.format('s_suppkey', "'sup'", 'supplier')})) WHERE nth = 1) WHERE rank <= 30""")
def placed_labels(spark, sf_dir):
    """Labels of crowded shapes: at each place of the grid only the largest one's fits, and thirty are drawn."""
    t = _boxes(table(spark, sf_dir, "supplier").withColumn("label", F.lit("sup")), "s_suppkey", "label").withColumn("political", F.lit(True))
    return place_labels(label_candidates(t, _VIEW)).select("stable_id", "label", "rank", rounded(F.col("x"), 6).alias("x"), rounded(F.col("y"), 6).alias("y"))


@query(f"""SELECT stable_id, printf('M%.2f %.2fL%.2f %.2fL%.2f %.2fL%.2f %.2fZ', 52e0 + x, 488e0 - y, 52e0 + x + w, 488e0 - y, 52e0 + x + w, 488e0 - y - h, 52e0 + x, 488e0 - y - h) AS fill FROM ({_BOX.format('s_suppkey', 's_name', 'supplier')})""")
def svg_paths(spark, sf_dir):
    """The path data of every feature as the SVG writer gives it."""
    t = _boxes(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name")
    return t.select("stable_id", path_data(to_screen(F.col("fills"), _VIEW, 960.0, 540.0)).alias("fill"))


_FNV = """(list_reduce(list_concat([1469598103934665603::HUGEINT], list_transform(string_split({0}, ''), lambda c: ord(c)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) % 10)"""


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS stable_id, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS label, CASE WHEN c_custkey % 5 = 1 THEN CAST(c_custkey AS VARCHAR) ELSE c_mktsegment END AS style_key,
CAST({_FNV.format("CASE WHEN c_custkey % 5 = 1 THEN CAST(c_custkey AS VARCHAR) ELSE c_mktsegment END")} AS INTEGER) AS palette, false AS political FROM customer""")
def scene_presentation(spark, sf_dir):
    """Labels and style keys from typed properties; a property of another type doesn't count."""
    t, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    entry = lambda key, kind, s: F.struct(F.lit(key).alias("key"), kind.alias("type_id"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("double").alias("d"), s.alias("s"))
    name = entry("name", F.when(k % 5 == 0, "int64").otherwise("text"), F.col("c_name"))
    code = entry("adm0_a3", F.lit("text"), F.col("c_mktsegment"))
    features = t.select(k.cast("string").alias("stable_id"), F.when(k % 5 == 1, F.array(name)).otherwise(F.array(name, code)).alias("properties"))
    scene = t.select(k.cast("string").alias("stable_id"))
    return with_presentation(scene, features).select("stable_id", "label", "style_key", "palette", "political")


@query("""SELECT p_partkey, p_partkey % 4 = 0 AS valid FROM part""")
def rotation_checks(spark, sf_dir):
    """Cameras of all directions are rotations; scaled, mirrored and skewed ones are not, which an operator tells as an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for key in keys:
                m = camera(key % 628 / 100 - 3.14, key % 314 / 100 - 1.57).copy()
                if key % 4 == 1:
                    m *= 1 + 1e-6
                elif key % 4 == 2:
                    m[0] = -m[0]
                elif key % 4 == 3:
                    m[1] = m[1] + 1e-5 * m[2]
                ring, _ = canonicalise([0.0, 0.1, 0.1], [0.0, 0.0, 0.1], "left")
                out.append(is_rotation(m) and visible_curve(ring, m).error != "invalid_rotation")
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.bool_())], ["p_partkey", "valid"])

    return table(spark, sf_dir, "part").select("p_partkey").mapInArrow(run, "p_partkey long, valid boolean")


_DEG = f"* {d(RADIANS)}"
_GLOBE = f"({d(R)} * cos({beta_sql('lat')}) * sin(lon))", f"({d(R)} * sin({beta_sql('lat')}))", f"({d(R)} * cos({beta_sql('lat')}) * cos(lon))"


@query(f"""SELECT progress, line_id, idx, {r_sql(f'({_GLOBE[0]} + ({d(R)} * lon * cos({beta_sql("lat")}) - {_GLOBE[0]}) * s) / 1e3', 2)} AS x_km, {r_sql(f'({_GLOBE[1]} + ({d(R)} * {beta_sql("lat")} - {_GLOBE[1]}) * s) / 1e3', 2)} AS y_km,
{r_sql(f'sin({d(PI)} * s) * CASE WHEN {_GLOBE[2]} >= 0 THEN 1e0 ELSE s END', 6)} AS guide_opacity FROM (SELECT *, progress * progress * progress * (progress * (progress * 6e0 - 15e0) + 10e0) AS s FROM (SELECT unnest([0.125e0, 0.5e0, 0.875e0]) AS progress), (
SELECT line_id, idx, CAST(lon_deg AS DOUBLE) {_DEG} AS lon, CAST(lat_deg AS DOUBLE) {_DEG} AS lat FROM ({_GRAT}) WHERE abs(lon_deg) <> 90 AND lat_deg NOT IN (-90, 90)))""")
def unfold_positions(spark, sf_dir):
    """Where the guides are on the way from the globe to the map; points on the limb itself are left out, as a rounding decides on which side they are."""
    guides = unfold_guides(spark).join(graticule(spark).select("line_id", "idx", F.rint(F.degrees("lon")).alias("lon_deg"), F.rint(F.degrees("lat")).alias("lat_deg")), ["line_id", "idx"])
    frames = unfold_frames(guides.where("abs(lon_deg) <> 90 and abs(lat_deg) <> 90"), [0.125, 0.5, 0.875])
    return frames.select("progress", "line_id", "idx", rounded(F.col("x") / g.lit(1000), 2).alias("x_km"), rounded(F.col("y") / g.lit(1000), 2).alias("y_km"), rounded(F.col("guide_opacity"), 6).alias("guide_opacity"))


@query(f"""SELECT c_custkey, {r_sql(f'{d(SEMI_MAJOR**2 / 2)} * w * (' + q_sql('n') + ' - ' + q_sql('s') + ') / 1e6', 2)} AS area_km2, {r_sql('(CAST(c_custkey * 37 % 2000 AS DOUBLE) - 1e3 + 18e1) - 36e1 * floor((CAST(c_custkey * 37 % 2000 AS DOUBLE) - 1e3 + 18e1) / 36e1) - 18e1', 6)} AS view_lon
FROM (SELECT c_custkey, CAST(1 + c_custkey % 90 AS DOUBLE) {_DEG} AS w, CAST(c_custkey % 150 - 80 AS DOUBLE) {_DEG} AS s, CAST(c_custkey % 150 - 80 + 1 + c_custkey % 15 AS DOUBLE) {_DEG} AS n FROM customer)""")
def cell_areas(spark, sf_dir):
    """Areas between parallels in closed form, and a viewer's longitudes in [-180, 180)."""
    k = F.col("c_custkey")
    south = k % 150 - 80
    w, s, n = (g.radians(x.cast("double")) for x in (1 + k % 90, south, south + 1 + k % 15))
    lon = g.view_longitude_degrees((k * 37 % 2000).cast("double") - g.lit(1000))
    return table(spark, sf_dir, "customer").select("c_custkey", rounded(g.cell_area(w, s, n) / g.lit(1e6), 2).alias("area_km2"), rounded(lon, 6).alias("view_lon"))

"""Queries of the geometry engine over the test tables, and their SQL.

The tables hold no places, so keys give them: integer arithmetic that is the same in any engine.
Results are rounded where they leave a query, never inside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridion.functions import geodesy as g
from meridion.functions.constants import E2, PI, Q_POLE, RADIANS, SEMI_MAJOR, SURFACE, TWO_PI, E
from meridion.functions.text import bounded_text, is_utc_time
from meridion.operators import ordered
from meridion.operators.kernels.projection import RingOptions
from meridion.operators.kernels.sphere import camera
from meridion.operators.projection import outline_areas, project_rings, ring_areas, split_rings, spread, world_summary
from meridion.operators.rings import branch_shift, canonical_ring, planar_area, rectangle, ring_area, ring_edges, strips
from meridion.operators.scene import graticule, unfold_frames, unfold_guides
from meridion.sources.snapshots import DOMAIN, content_identities
from meridion.streaming.generations import latest_requests

from .session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
VIEW = (0.3, 0.2)
R = g.R


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def degrees_of(key: Column) -> tuple[Column, Column]:
    lon = ((key * 7919) % 36000).cast("double") / g.lit(100) - g.lit(180)
    lat = ((key * 104729) % 17801).cast("double") / g.lit(100) - g.lit(89)
    return lon, lat


def placed(df: DataFrame, key: str) -> DataFrame:
    lon, lat = degrees_of(F.col(key))
    return df.withColumn("lon", g.radians(lon)).withColumn("lat", g.radians(lat))


def rounded(c: Column, digits: int) -> Column:
    return F.round(c, digits) + g.lit(0)


# Pieces of SQL.


def d(x: float) -> str:
    r = repr(float(x))
    return r if "e" in r else r + "e0"


def lon_sql(k: str) -> str:
    return f"((CAST(({k} * 7919) % 36000 AS DOUBLE) / 1e2 - 1.8e2) * {d(RADIANS)})"


def lat_sql(k: str) -> str:
    return f"((CAST(({k} * 104729) % 17801 AS DOUBLE) / 1e2 - 8.9e1) * {d(RADIANS)})"


def geo_sql(name: str, key: str) -> str:
    return f"(SELECT *, {lon_sql(key)} AS lon, {lat_sql(key)} AS lat FROM {name})"


def q_sql(x: str) -> str:
    return f"({d(1 - E2)} * (sin({x}) / (1e0 - {d(E2)} * sin({x}) * sin({x})) + atanh({d(E)} * sin({x})) / {d(E)}))"


def beta_sql(x: str) -> str:
    return f"asin(greatest(-1e0, least(1e0, {q_sql(x)} / {d(Q_POLE)})))"


def principal_sql(x: str) -> str:
    r = f"({x} - {d(TWO_PI)} * round_even(({x}) / {d(TWO_PI)}, 0))"
    return f"(CASE WHEN {r} <= {d(-PI)} THEN {r} + {d(TWO_PI)} WHEN {r} > {d(PI)} THEN {r} - {d(TWO_PI)} ELSE {r} END)"


def r_sql(x: str, digits: int) -> str:
    return f"round({x}, {digits}) + 0e0"


def mollweide_sql(source: str, columns: str) -> str:
    """CTEs t0..t10 with the auxiliary angle th of column b."""
    parts = [f"t0 AS (SELECT *, abs(sin(b)) AS s, {d(PI / 2)} - pow({d(0.75 * PI)} * (1e0 - abs(sin(b))), {d(1 / 3)}) AS th FROM ({source}))"]
    for k in range(10):
        slope = "(2e0 + 2e0 * cos(2e0 * th))"
        nxt = f"greatest(0e0, least({d(PI / 2)}, th - (2e0 * th + sin(2e0 * th) - {d(PI)} * s) / {slope}))"
        parts.append(f"t{k + 1} AS (SELECT {columns}, b, s, CASE WHEN {slope} < 1e-12 THEN th ELSE {nxt} END AS th FROM t{k})")
    parts.append("m AS (SELECT *, CASE WHEN b < 0 THEN -th ELSE th END AS theta FROM t10)")
    return "WITH " + ", ".join(parts)


CUSTOMER, ORDERS, SUPPLIER = geo_sql("customer", "c_custkey"), geo_sql("orders", "o_orderkey"), geo_sql("supplier", "s_suppkey")


@query(f"SELECT c_custkey, {r_sql(q_sql('lat'), 7)} AS q, {r_sql(beta_sql('lat'), 7)} AS beta, 'none' AS error FROM {CUSTOMER}")
def authalic_latitude(spark, sf_dir):
    t = placed(table(spark, sf_dir, "customer"), "c_custkey").withColumn("r", g.authalic_latitude_checked(F.col("lat")))
    return t.select("c_custkey", rounded(g.authalic_q(F.col("lat")), 7).alias("q"), rounded(F.col("r.value"), 7).alias("beta"), F.col("r.error").alias("error"))


@query(f"""WITH RECURSIVE s AS (SELECT s_suppkey, lat, {d(Q_POLE)} * sin({beta_sql('lat')}) AS target FROM {SUPPLIER}),
b(s_suppkey, target, i, lo, hi) AS (SELECT s_suppkey, target, 0, {d(-PI / 2)}, {d(PI / 2)} FROM s UNION ALL
 SELECT s_suppkey, target, i + 1, CASE WHEN {q_sql('((lo + hi) / 2e0)')} < target THEN (lo + hi) / 2e0 ELSE lo END, CASE WHEN {q_sql('((lo + hi) / 2e0)')} < target THEN hi ELSE (lo + hi) / 2e0 END FROM b WHERE i < 60)
SELECT b.s_suppkey, {r_sql('(lo + hi) / 2e0', 7)} AS lat, abs((lo + hi) / 2e0 - lat) < 1e-11 AS close FROM b JOIN s ON s.s_suppkey = b.s_suppkey WHERE i = 60""")
def authalic_inverse(spark, sf_dir):
    t = placed(table(spark, sf_dir, "supplier"), "s_suppkey").withColumn("back", g.geodetic_latitude(g.authalic_latitude(F.col("lat"))))
    return t.select("s_suppkey", rounded(F.col("back"), 7).alias("lat"), (F.abs(F.col("back") - F.col("lat")) < 1e-11).alias("close"))


@query(f"SELECT c_custkey, {r_sql(f'{d(R)} * lon * cos({beta_sql('lat')})', 0)} AS x, {r_sql(f'{d(R)} * {beta_sql('lat')}', 0)} AS y FROM {CUSTOMER}")
def sinusoidal_forward(spark, sf_dir):
    t = placed(table(spark, sf_dir, "customer"), "c_custkey").withColumn("p", g.project_point(F.col("lon"), F.col("lat"), "sinusoidal"))
    return t.select("c_custkey", rounded(F.col("p.x"), 0).alias("x"), rounded(F.col("p.y"), 0).alias("y"))


def _roundtrip(spark, sf_dir, primitive: str, name: str, key: str) -> DataFrame:
    t = placed(table(spark, sf_dir, name), key).withColumn("b", g.authalic_latitude(F.col("lat"))).withColumn("p", g.FORWARD[primitive](F.col("lon"), F.col("b")))
    t = t.withColumn("r", g.INVERSE[primitive](F.col("p.x"), F.col("p.y")))
    return t.select(key, rounded(F.col("r.value.lon"), 6).alias("lon"), rounded(F.col("r.value.lat"), 6).alias("beta"), F.col("r.error").alias("error"))


@query(f"SELECT c_custkey, {r_sql('lon', 6)} AS lon, {r_sql(beta_sql('lat'), 6)} AS beta, 'none' AS error FROM {CUSTOMER}")
def sinusoidal_roundtrip(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "sinusoidal", "customer", "c_custkey")


@query(f"SELECT c_custkey, {r_sql('lon', 6)} AS lon, {r_sql(beta_sql('lat'), 6)} AS beta, 'none' AS error FROM {CUSTOMER}")
def mollweide_roundtrip(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "mollweide", "customer", "c_custkey")


_M = mollweide_sql(f"SELECT o_orderkey, lon, {beta_sql('lat')} AS b FROM {ORDERS}", "o_orderkey, lon")


@query(f"{_M} SELECT o_orderkey, {r_sql('theta', 7)} AS theta, abs(2e0 * theta + sin(2e0 * theta) - {d(PI)} * sin(b)) < 2e-14 AS solved FROM m")
def mollweide_theta(spark, sf_dir):
    t = placed(table(spark, sf_dir, "orders"), "o_orderkey").withColumn("b", g.authalic_latitude(F.col("lat"))).withColumn("theta", g.mollweide_theta(F.col("b")))
    residual = F.abs(g.lit(2) * F.col("theta") + F.sin(g.lit(2) * F.col("theta")) - g.lit(PI) * F.sin("b"))
    return t.select("o_orderkey", rounded(F.col("theta"), 7).alias("theta"), (residual < 2e-14).alias("solved"))


@query(f"{_M} SELECT o_orderkey, {r_sql(f'{d(R * 2 * 2**0.5 / PI)} * lon * cos(theta)', 0)} AS x, {r_sql(f'{d(R * 2**0.5)} * sin(theta)', 0)} AS y FROM m")
def mollweide_forward(spark, sf_dir):
    t = placed(table(spark, sf_dir, "orders"), "o_orderkey").withColumn("p", g.project_point(F.col("lon"), F.col("lat"), "mollweide"))
    return t.select("o_orderkey", rounded(F.col("p.x"), 0).alias("x"), rounded(F.col("p.y"), 0).alias("y"))


@query("""SELECT primitive, lat_deg, lon_rad, 1e0 AS ratio, true AS equal_area FROM (SELECT unnest(['sinusoidal', 'mollweide']) AS primitive),
 (SELECT unnest([-80, -60, -30, 0, 30, 60, 80]) AS lat_deg), (SELECT unnest([-2.1e0, -0.73e0, 0e0, 0.73e0, 2.1e0]) AS lon_rad)""")
def jacobian_check(spark, sf_dir):
    lats, lons = F.array(*[F.lit(x) for x in (-80, -60, -30, 0, 30, 60, 80)]), F.array(*[g.lit(x) for x in (-2.1, -0.73, 0, 0.73, 2.1)])
    grid = spark.range(1).select(F.explode(lats).alias("lat_deg"), F.lit(1).alias("one")).select("lat_deg", F.explode(lons).alias("lon_rad"))
    beta, lon, h = g.radians(F.col("lat_deg").cast("double")), F.col("lon_rad"), 1e-4
    parts = []
    for name, f in g.FORWARD.items():
        def slope(axis: str, by: str, f=f) -> Column:  # noqa: ANN202  fourth-order central differences
            at = lambda k: f(lon + g.lit(k * h if by == "lon" else 0), beta + g.lit(k * h if by == "lat" else 0))[axis]
            return (g.lit(8) * (at(1) - at(-1)) - (at(2) - at(-2))) / g.lit(12 * h)

        ratio = (slope("x", "lon") * slope("y", "lat") - slope("x", "lat") * slope("y", "lon")) / (g.lit(R * R) * F.cos(beta))
        parts.append(grid.select(F.lit(name).alias("primitive"), "lat_deg", "lon_rad", rounded(ratio, 6).alias("ratio"), (F.abs(ratio - g.lit(1)) < 1e-8).alias("equal_area")))
    return parts[0].union(parts[1])


@query(f"SELECT c_custkey, {r_sql('cos(lat) * cos(lon)', 7)} AS x, {r_sql('cos(lat) * sin(lon)', 7)} AS y, {r_sql('sin(lat)', 7)} AS z, {r_sql('lon', 7)} AS lon, {r_sql('lat', 7)} AS lat FROM {CUSTOMER}")
def unit_vector(spark, sf_dir):
    t = placed(table(spark, sf_dir, "customer"), "c_custkey").withColumn("v", g.unit_vector(F.col("lon"), F.col("lat"))).withColumn("b", g.from_vector(F.col("v")))
    return t.select("c_custkey", *[rounded(F.col(f"v.{n}"), 7).alias(n) for n in "xyz"], rounded(F.col("b.value.lon"), 7).alias("lon"), rounded(F.col("b.value.lat"), 7).alias("lat"))


_C = camera(*VIEW).tolist()
_ROT = [" + ".join(f"{d(m)} * {v}" for m, v in zip(row, ("(cos(b) * cos(lon))", "(cos(b) * sin(lon))", "sin(b)"), strict=True)) for row in _C]
_SEEN = f"(SELECT *, {d(R)} * ({_ROT[1]}) AS sx, {d(R)} * ({_ROT[2]}) AS sy, {d(R)} * ({_ROT[0]}) AS depth FROM (SELECT *, {beta_sql('lat')} AS b FROM {{}}))"


@query(f"SELECT c_custkey, {r_sql('sx', 0)} AS x, {r_sql('sy', 0)} AS y, {r_sql('depth', 0)} AS depth, depth >= 0 AS visible FROM {_SEEN.format(CUSTOMER)}")
def ortho_globe(spark, sf_dir):
    t = placed(table(spark, sf_dir, "customer"), "c_custkey").withColumn("p", g.globe_point(F.col("lon"), F.col("lat"), _C))
    return t.select("c_custkey", *[rounded(F.col(f"p.{n}"), 0).alias(n) for n in ("x", "y", "depth")], F.col("p.visible").alias("visible"))


@query(f"SELECT c_custkey, {r_sql(_ROT[0].replace('(b)', '(lat)'), 7)} AS x, {r_sql(_ROT[1].replace('(b)', '(lat)'), 7)} AS y, {r_sql(_ROT[2].replace('(b)', '(lat)'), 7)} AS z FROM {CUSTOMER}")
def rotate_camera(spark, sf_dir):
    t = placed(table(spark, sf_dir, "customer"), "c_custkey").withColumn("v", g.rotate(_C, g.unit_vector(F.col("lon"), F.col("lat"))))
    return t.select("c_custkey", *[rounded(F.col(f"v.{n}"), 7).alias(n) for n in "xyz"])


@query(f"SELECT o_orderpriority, count(*) AS points, count(*) FILTER (depth >= 0) AS visible FROM {_SEEN.format(ORDERS)} GROUP BY 1")
def horizon_filter(spark, sf_dir):
    t = placed(table(spark, sf_dir, "orders"), "o_orderkey").withColumn("p", g.globe_point(F.col("lon"), F.col("lat"), _C))
    return t.groupBy("o_orderpriority").agg(F.count("*").alias("points"), F.count_if("p.visible").alias("visible"))


@query(f"""SELECT l_linenumber, count(*) AS n, {r_sql(f'sum({principal_sql("raw")})', 3)} AS total, count(*) FILTER (abs({principal_sql('raw')}) > {d(PI)}) AS outside
FROM (SELECT l_linenumber, {lon_sql('l_orderkey')} + {d(TWO_PI)} * CAST(l_linenumber - 2 AS DOUBLE) / 2e0 AS raw FROM lineitem) GROUP BY 1""")
def principal_longitude(spark, sf_dir):
    lon, _ = degrees_of(F.col("l_orderkey"))
    raw = g.radians(lon) + g.lit(TWO_PI) * (F.col("l_linenumber") - 2).cast("double") / g.lit(2)
    t = table(spark, sf_dir, "lineitem").select("l_linenumber", g.principal(raw).alias("p"))
    return t.groupBy("l_linenumber").agg(F.count("*").alias("n"), rounded(F.sum("p"), 3).alias("total"), F.count_if(F.abs("p") > PI).alias("outside"))


def _wide(key: Column) -> tuple[Column, Column]:
    lon, _ = degrees_of(key)
    west = g.radians(lon) + g.lit(TWO_PI) * (key % 5 - 2).cast("double")
    return west, west + g.radians((key % 300).cast("double") + g.lit(1.5))


_WIDE = f"SELECT *, w + (CAST(o_orderkey % 300 AS DOUBLE) + 1.5e0) * {d(RADIANS)} AS e FROM (SELECT *, {lon_sql('o_orderkey')} + {d(TWO_PI)} * CAST(o_orderkey % 5 - 2 AS DOUBLE) AS w FROM orders)"


@query(f"""SELECT turns, fits, count(*) AS rings FROM (SELECT turns, w + turns * {d(TWO_PI)} >= {d(-PI - 1e-12)} AND e + turns * {d(TWO_PI)} <= {d(PI + 1e-12)} AS fits
FROM (SELECT *, CAST(round((0e0 - (w + e) / 2e0) / {d(TWO_PI)}) AS INTEGER) AS turns FROM ({_WIDE}))) GROUP BY ALL""")
def branch_shift_counts(spark, sf_dir):
    west, east = _wide(F.col("o_orderkey"))
    s = table(spark, sf_dir, "orders").select(branch_shift(rectangle(west, g.lit(-0.2), east, g.lit(0.2))).alias("s"))
    return s.groupBy(F.col("s.turns").alias("turns"), F.col("s.fits").alias("fits")).agg(F.count("*").alias("rings"))


@query(f"""SELECT strip, count(*) AS rings FROM (SELECT unnest(range(CAST(floor((w + {d(PI)}) / {d(TWO_PI)}) AS BIGINT), CAST(greatest(floor((w + {d(PI)}) / {d(TWO_PI)}) + 1, ceil((e + {d(PI)}) / {d(TWO_PI)})) AS BIGINT))) AS strip
FROM ({_WIDE})) GROUP BY 1""")
def strip_explode(spark, sf_dir):
    west, east = _wide(F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.explode(strips(west, east)).alias("strip")).groupBy("strip").agg(F.count("*").alias("rings"))


_UNWRAP = f"""(SELECT *, coalesce({principal_sql('(lon - lag(lon) OVER (PARTITION BY o_custkey ORDER BY o_orderkey))')}, {principal_sql('lon')}) AS step FROM {ORDERS})"""


@query(f"SELECT o_custkey, o_orderkey, {r_sql('sum(step) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)', 5)} AS unwrapped FROM {_UNWRAP}")
def unwrap_longitude(spark, sf_dir):
    t = placed(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_orderkey")
    return ordered.unwrap(t, "o_custkey", "o_orderkey", "lon").select("o_custkey", "o_orderkey", rounded(F.col("unwrapped"), 5).alias("unwrapped"))


@query(f"""SELECT o_custkey, count(*) AS n, CAST(round_even(sum(step) / {d(TWO_PI)}, 0) AS INTEGER) AS winding FROM (SELECT o_custkey,
{principal_sql('(coalesce(lead(lon) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), first(lon) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) - lon)')} AS step FROM {ORDERS}) GROUP BY 1""")
def winding_number(spark, sf_dir):
    t = placed(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_orderkey")
    return ordered.winding_numbers(t, "o_custkey", "o_orderkey", "lon")


def cells(df: DataFrame, key: str) -> DataFrame:
    """A cell of 2 x 2 degrees around each key's place, latitudes held inside the poles."""
    t = placed(df, key)
    h, top = g.lit(RADIANS), g.lit(89.5 * RADIANS)
    return t.withColumn("points", rectangle(F.col("lon") - h, F.greatest(-top, F.col("lat") - h), F.col("lon") + h, F.least(top, F.col("lat") + h)))


_S, _N = f"greatest({d(-89.5 * RADIANS)}, lat - {d(RADIANS)})", f"least({d(89.5 * RADIANS)}, lat + {d(RADIANS)})"


@query(f"""SELECT c_custkey, e, {r_sql(principal_sql(f'(lon - {d(RADIANS)})') + f' + CASE WHEN e IN (1, 2) THEN {d(2 * RADIANS)} ELSE 0e0 END', 6)} AS lon_a, {r_sql(f'CASE WHEN e IN (0, 1) THEN {_S} ELSE {_N} END', 6)} AS lat_a,
{r_sql(principal_sql(f'(lon - {d(RADIANS)})') + f' + CASE WHEN e IN (0, 1) THEN {d(2 * RADIANS)} ELSE 0e0 END', 6)} AS lon_b, {r_sql(f'CASE WHEN e IN (1, 2) THEN {_N} ELSE {_S} END', 6)} AS lat_b
FROM {CUSTOMER}, (SELECT unnest([0, 1, 2, 3]) AS e)""")
def ring_edge_table(spark, sf_dir):
    t = cells(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", F.posexplode(ring_edges(canonical_ring(F.col("points"))["value"])).alias("e", "s"))
    return t.select("c_custkey", "e", *[rounded(F.col(f"s.{p}.{n}"), 6).alias(f"{n}_{p}") for p in "ab" for n in ("lon", "lat")])


@query(f"""SELECT n_name, count(*) AS cells, {r_sql('sum(area) / 1e6', 1)} AS area_km2, true AS conserved FROM (SELECT n_name, {d(SEMI_MAJOR**2 / 2)} * {d(2 * RADIANS)} * ({q_sql(_N)} - {q_sql(_S)}) AS area
FROM {CUSTOMER} JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1""")
def rect_area_by_nation(spark, sf_dir):
    """The flagship: cells to canonical rings, exact areas, projected outlines, areas held against each other by nation."""
    t = cells(spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey"), "c_custkey").withColumn("r", canonical_ring(F.col("points"))["value"])
    t = t.select("c_nationkey", ring_area(F.col("r"))["value"]["area"].alias("area"), F.col("r.vertices").alias("vertices"))
    t = outline_areas(t, "vertices", "plane")
    by = t.groupBy("c_nationkey").agg(F.count("*").alias("cells"), F.sum("area").alias("area"), F.max(F.abs(F.col("plane") - F.col("area")) / F.col("area")).alias("off"))
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return by.join(names, by.c_nationkey == names.n_nationkey).select("n_name", "cells", rounded(F.col("area") / g.lit(1e6), 1).alias("area_km2"), (F.col("off") < 1e-3).alias("conserved"))


@query(f"SELECT id AS lat_deg, {r_sql(f'{d(SEMI_MAJOR**2 * PI)} * ({d(Q_POLE)} - {q_sql(f'(CAST(id AS DOUBLE) * {d(RADIANS)})')}) / 1e6', 0)} AS cap_km2, 1 AS winding FROM (SELECT unnest(range(-89, 90)) AS id)")
def polar_cap_area(spark, sf_dir):
    lat = g.radians(F.col("id").cast("double"))
    points = F.array(*[g.point(g.lit(k * PI / 2), lat) for k in range(4)])
    t = spark.range(-89, 90).withColumn("r", canonical_ring(points, "left")["value"])
    return t.select(F.col("id").alias("lat_deg"), rounded(ring_area(F.col("r"))["value"]["area"] / g.lit(1e6), 0).alias("cap_km2"), F.col("r.winding").alias("winding"))


_POLY = "SELECT p_partkey, 3 + p_partkey % 6 AS n, CAST(100 + p_partkey % 900 AS DOUBLE) AS r FROM part"


@query(f"SELECT p_partkey, {r_sql(f'5e-1 * CAST(n AS DOUBLE) * r * r * sin({d(TWO_PI)} / CAST(n AS DOUBLE))', 4)} AS area FROM ({_POLY})")
def planar_polygon_area(spark, sf_dir):
    n, r = 3 + F.col("p_partkey") % 6, (100 + F.col("p_partkey") % 900).cast("double")
    angle = lambda k: g.lit(TWO_PI) * k.cast("double") / n.cast("double")
    points = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: g.planar(r * F.cos(angle(k)), r * F.sin(angle(k))))
    return table(spark, sf_dir, "part").select("p_partkey", rounded(planar_area(points), 4).alias("area"))


_BAND = f"SELECT p_partkey, CAST(1 + p_partkey % 178 AS DOUBLE) * {d(RADIANS)} AS half, CAST(1 + p_partkey % 89 AS DOUBLE) * {d(RADIANS)} AS top FROM part"


@query(f"""SELECT class, count(*) AS rings, {r_sql('sum(area) / 1e12', 3)} AS area FROM (SELECT area, CASE WHEN area + 1e0 < {d(SURFACE / 2)} THEN 'minor' WHEN area - 1e0 > {d(SURFACE / 2)} THEN 'major' ELSE 'ambiguous' END AS class
FROM (SELECT {d(SEMI_MAJOR**2)} * half * ({q_sql('top')} - {q_sql('(-top)')}) AS area FROM ({_BAND}))) GROUP BY 1""")
def coverage_class(spark, sf_dir):
    half, top = g.radians((1 + F.col("p_partkey") % 178).cast("double")), g.radians((1 + F.col("p_partkey") % 89).cast("double"))
    # Twelve vertices, so that no edge spans half a turn.
    along = [g.lit(k / 5) for k in range(6)]
    points = F.array(*[g.point(g.mix(-half, half, k), -top) for k in along], *[g.point(g.mix(half, -half, k), top) for k in along])
    t = table(spark, sf_dir, "part").select(ring_area(canonical_ring(points, "left")["value"])["value"]["area"].alias("area"))
    t = t.withColumn("class", g.coverage(F.col("area"), g.lit(1)))
    return t.groupBy("class").agg(F.count("*").alias("rings"), rounded(F.sum("area") / g.lit(1e12), 3).alias("area"))


def _crossing(df: DataFrame, key: str, side: str = "left") -> DataFrame:
    """Rectangles over the antimeridian: 1 to 20 degrees on each side."""
    west, east = g.radians(g.lit(180) - (1 + F.col(key) % 20).cast("double")), g.radians(g.lit(-180) + (1 + F.col(key) % 13).cast("double"))
    top = g.radians((1 + F.col(key) % 60).cast("double"))
    points = rectangle(west, -top, east, top)
    return df.select(key, (points if side == "left" else F.reverse(points)).alias("points"), F.lit(side).alias("side"))


_TOP = f"(CAST(1 + s_suppkey % 60 AS DOUBLE) * {d(RADIANS)})"
_BANDS = f"{d(SEMI_MAJOR**2 / 2 * RADIANS)} * CAST(1 + s_suppkey % {{}} AS DOUBLE) * ({q_sql(_TOP)} - {q_sql(f'(-{_TOP})')}) / 1e6"


@query(f"SELECT s_suppkey, 2 AS pieces, 2 AS crossings, {r_sql(_BANDS.format(20), 0)} AS west_km2, {r_sql(_BANDS.format(13), 0)} AS east_km2 FROM supplier")
def seam_split_rect(spark, sf_dir):
    s = split_rings(spread(_crossing(table(spark, sf_dir, "supplier"), "s_suppkey"), "s_suppkey"))
    west = F.filter(F.arrays_zip("pieces", "areas"), lambda p: p["pieces"][0]["lon"] > 0)[0]["areas"]
    east = F.filter(F.arrays_zip("pieces", "areas"), lambda p: p["pieces"][0]["lon"] <= 0)[0]["areas"]
    return s.select("s_suppkey", F.size("pieces").alias("pieces"), "crossings", rounded(west / g.lit(1e6), 0).alias("west_km2"), rounded(east / g.lit(1e6), 0).alias("east_km2"))


def _concave(df: DataFrame, key: str) -> DataFrame:
    """A C over the antimeridian, of heights and a place that differ by key: three pieces, four crossings."""
    k = F.col(key)
    shift, tall, notch = k % 9, 40 + k % 30, 5 + k % 25
    xy = [(160, -1, tall), (-160, -1, tall), (-160, -1, notch), (170, -1, notch), (170, 1, notch), (-160, 1, notch), (-160, 1, tall), (160, 1, tall)]
    return df.select(key, F.array(*[g.point(g.radians((F.lit(x) - shift).cast("double")), g.radians((F.lit(sign) * y).cast("double"))) for x, sign, y in xy]).alias("points"), F.lit("left").alias("side"))


def _c_area(key: str) -> str:
    """Its area: a band of 40 degrees without a band of 30."""
    tall, notch = (f"(CAST({low} + {key} % {n} AS DOUBLE) * {d(RADIANS)})" for low, n in ((40, 30), (5, 25)))
    return f"({d(SEMI_MAJOR**2 / 2 * RADIANS)} * (4e1 * 2e0 * {q_sql(tall)} - 3e1 * 2e0 * {q_sql(notch)}))"


def _verified(spark, sf_dir, primitive: str) -> DataFrame:
    options = RingOptions(primitive, relative_error=1e-6, geometric_tolerance=500.0, area_tolerance=1e7)
    out = project_rings(spread(_concave(table(spark, sf_dir, "supplier"), "s_suppkey"), "s_suppkey"), options)
    return out.select(
        "s_suppkey", "n_pieces", "crossings", rounded(F.col("source_area") / g.lit(1e6), 0).alias("source_km2"), rounded(F.col("planar_area") / g.lit(1e11), 0).alias("plane_100000km2"),
        rounded(F.col("allowed_error"), 0).alias("allowed_m2"), (F.col("area_error") <= F.col("allowed_error")).alias("within_budget"), F.col("n_vertices").between(24, 1_000_000).alias("refined"), "error",
    )


_VERIFIED = f"""SELECT s_suppkey, 3 AS n_pieces, 4 AS crossings, {r_sql(f'{_c_area("s_suppkey")} / 1e6', 0)} AS source_km2, {r_sql(f'{_c_area("s_suppkey")} / 1e11', 0)} AS plane_100000km2,
{r_sql(f'{_c_area("s_suppkey")} * 1e-6', 0)} AS allowed_m2, true AS within_budget, true AS refined, 'none' AS error FROM supplier"""


@query(_VERIFIED)
def verified_projection_sinusoidal(spark, sf_dir):
    return _verified(spark, sf_dir, "sinusoidal")


@query(_VERIFIED)
def verified_projection_mollweide(spark, sf_dir):
    return _verified(spark, sf_dir, "mollweide")


@query(f"""SELECT n_nationkey, 1 AS n_pieces, {r_sql(f'-{d(SEMI_MAJOR**2 * PI)} * ({d(Q_POLE)} - {q_sql(f'(CAST(60 + n_nationkey AS DOUBLE) * {d(RADIANS)})')}) / 1e6', 0)} AS area_km2, true AS within_budget, 'none' AS error FROM nation""")
def polar_closure(spark, sf_dir):
    lat = g.radians(-(60 + F.col("n_nationkey")).cast("double"))
    points = F.array(*[g.point(g.lit(-PI + k * PI / 2), lat) for k in range(4)])
    t = table(spark, sf_dir, "nation").select("n_nationkey", points.alias("points"), F.lit("right").alias("side"))
    out = project_rings(t, RingOptions("sinusoidal", central_meridian=0.4, relative_error=1e-6, geometric_tolerance=500.0, area_tolerance=1e7))
    return out.select("n_nationkey", "n_pieces", rounded(F.col("source_area") / g.lit(1e6), 0).alias("area_km2"), "within_budget", "error")


@query(f"SELECT s_suppkey, {r_sql(f'{d(SEMI_MAJOR**2 / 2)} * {d(2 * RADIANS)} * ({q_sql(_N)} - {q_sql(_S)}) / 1e6', 1)} AS area_km2, true AS bounded, 'none' AS error FROM {SUPPLIER}")
def exact_ring_area(spark, sf_dir):
    t = cells(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select("s_suppkey", "points", F.lit("unspecified").alias("side"))
    return ring_areas(t).select("s_suppkey", rounded(F.col("area") / g.lit(1e6), 1).alias("area_km2"), (F.col("bound") < 1.0).alias("bounded"), "error")


_PAIR = "SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS id, min(CAST((l_orderkey * 8 + l_linenumber) * 104729 % 17801 AS BIGINT)) AS v FROM lineitem GROUP BY 1, 2"


@query(f"""SELECT l_suppkey, v, CAST(place AS INTEGER) AS place, CAST(floor(place / 2) AS INTEGER) AS pair, CASE WHEN n % 2 <> 0 OR max(CASE WHEN gap <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey) = 1 THEN 'ambiguous_seam_touch' ELSE 'none' END AS error
FROM (SELECT *, row_number() OVER w - 1 AS place, v - lag(v) OVER w AS gap, count(*) OVER (PARTITION BY l_suppkey) AS n FROM ({_PAIR}) WINDOW w AS (PARTITION BY l_suppkey ORDER BY v, id))""")
def endpoint_pairing(spark, sf_dir):
    ident = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")
    t = table(spark, sf_dir, "lineitem").select("l_suppkey", ident).distinct().withColumn("v", F.col("id") * 104729 % 17801)
    return ordered.pair_sorted(t, "l_suppkey", "v", "id", 0.0).select("l_suppkey", "v", "place", "pair", "error")


_SEG = "SELECT DISTINCT l_partkey % 50 AS grp, l_orderkey AS seq, CAST(floor(l_orderkey / 3) AS BIGINT) % 4 AS a FROM lineitem"


@query(f"""SELECT grp, count(*) AS segments, max(c) + 1 AS chains FROM (SELECT grp, sum(CASE WHEN prev = a THEN 0 ELSE 1 END) OVER (PARTITION BY grp ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS c
FROM (SELECT *, lag(a) OVER (PARTITION BY grp ORDER BY seq) AS prev FROM ({_SEG}))) GROUP BY 1""")
def chain_islands(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("grp"), F.col("l_orderkey").alias("seq"), (F.floor(F.col("l_orderkey") / 3) % 4).alias("a")).distinct().withColumn("b", F.col("a"))
    c = ordered.chain_ids(t, "grp", "seq", "a", "b")
    return c.groupBy("grp").agg(F.count("*").alias("segments"), (F.max("chain") + 1).alias("chains"))


@query("""SELECT o_custkey, o_orderkey, coalesce(lead(o_orderkey) OVER w, first(o_orderkey) OVER w) AS next_id, coalesce(lag(o_orderkey) OVER w, last(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_id
FROM (SELECT *, CAST(o_orderkey * 7919 % 36000 AS DOUBLE) / 1e2 * 0.017453292519943295e0 AS a FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY a, o_orderkey)""")
def limb_neighbours(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", g.radians((F.col("o_orderkey") * 7919 % 36000).cast("double") / g.lit(100)).alias("a"))
    return ordered.circular_neighbours(t, "o_custkey", "a", "o_orderkey").select("o_custkey", "o_orderkey", "next_id", "previous_id")


_GRAT = """SELECT 'm' || l AS line_id, 'meridian' AS kind, CAST((p + 90) / 5 AS INTEGER) AS idx, l AS lon_deg, p AS lat_deg FROM (SELECT unnest(range(-150, 151, 30)) AS l), (SELECT unnest(range(-90, 91, 5)) AS p)
UNION ALL SELECT 'p' || p, 'parallel', CAST((l + 180) / 5 AS INTEGER), l, p FROM (SELECT unnest(range(-75, 76, 15)) AS p), (SELECT unnest(range(-180, 181, 5)) AS l)
UNION ALL SELECT 's' || l, 'seam', CAST((p + 90) / 5 AS INTEGER), l, p FROM (SELECT unnest([-180, 180]) AS l), (SELECT unnest(range(-90, 91, 5)) AS p)"""


@query(f"SELECT line_id, kind, idx, {r_sql(f'CAST(lon_deg AS DOUBLE) * {d(RADIANS)}', 9)} AS lon, {r_sql(f'CAST(lat_deg AS DOUBLE) * {d(RADIANS)}', 9)} AS lat FROM ({_GRAT})")
def graticule_lines(spark, sf_dir):
    return graticule(spark).select("line_id", "kind", "idx", rounded(F.col("lon"), 9).alias("lon"), rounded(F.col("lat"), 9).alias("lat"))


@query("""SELECT p AS progress, line_id, count(*) AS points, round(p * p * p * (p * (p * 6e0 - 15e0) + 10e0), 9) AS flat_opacity FROM (SELECT unnest([0e0, 0.25e0, 0.5e0, 1e0]) AS p), (""" + _GRAT + ") GROUP BY 1, 2")
def smoothstep_guides(spark, sf_dir):
    f = unfold_frames(unfold_guides(spark), [0.0, 0.25, 0.5, 1.0])
    return f.groupBy("progress", "line_id").agg(F.count("*").alias("points"), F.round(F.max("flat_opacity"), 9).alias("flat_opacity"))


@query("SELECT d.doc_id, count(l.doc_id) AS properties FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def feature_property_counts(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").groupBy("doc_id").agg(F.count("quality").alias("properties"))


@query("SELECT lang, count(*) AS unlabelled FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY 1")
def orphan_properties(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("unlabelled"))


@query("SELECT o_orderstatus, count(*) AS orders, count(*) FILTER (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS bound FROM orders GROUP BY 1")
def binding_exists(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("bound", F.lit(True))
    return orders.join(lines, "o_orderkey", "left").groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.count("bound").alias("bound"))


@query("""SELECT only_left, only_right, only_left = 0 AND only_right = 0 AS equal FROM (SELECT count(*) FILTER (o IS NULL) AS only_left, count(*) FILTER (c IS NULL) AS only_right
FROM (SELECT DISTINCT c_custkey AS c FROM customer) FULL JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON c = o)""")
def key_set_equality(spark, sf_dir):
    return ordered.same_keys(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""SELECT error, count(*) AS keys FROM (SELECT CASE WHEN a.k IS NULL THEN 'left_missing' WHEN b.k IS NULL THEN 'right_missing' WHEN a.n > 1 OR b.n > 1 THEN 'not_unique' ELSE 'none' END AS error
FROM (SELECT doc_id AS k, count(*) AS n FROM documents GROUP BY 1) a FULL JOIN (SELECT doc_id AS k, count(*) AS n FROM labels GROUP BY 1) b ON a.k = b.k) GROUP BY 1""")
def positional_join_proof(spark, sf_dir):
    out = ordered.one_to_one(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return out.groupBy("error").agg(F.count("*").alias("keys"))


_SIZE = f"({d(SEMI_MAJOR**2 * RADIANS)} * ({q_sql(_N)} - {q_sql(_S)}))"


@query(f"SELECT c_nationkey, c_custkey AS largest FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY round({_SIZE} / 1e6, 1) DESC, c_custkey) AS rn FROM {CUSTOMER}) WHERE rn = 1")
def largest_ring(spark, sf_dir):
    t = cells(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    area = F.round(ring_area(canonical_ring(F.col("points"))["value"])["value"]["area"] / g.lit(1e6), 1)
    return t.groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct(area, -F.col("c_custkey"))).alias("largest"))


@query(f"SELECT c_custkey, c_name, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY round({_SIZE} / 1e6, 1) DESC, c_name) AS rank FROM {CUSTOMER}) WHERE rank <= 30")
def topk_labels(spark, sf_dir):
    """The 30 largest shapes, ties by name; the window runs over the 30 rows that the heaps of the tasks leave."""
    t = cells(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    area = F.round(ring_area(canonical_ring(F.col("points"))["value"])["value"]["area"] / g.lit(1e6), 1)
    top = t.select("c_custkey", "c_name", area.alias("a")).orderBy(F.desc("a"), "c_name").limit(30)
    return top.select("c_custkey", "c_name", F.row_number().over(Window.orderBy(F.desc("a"), "c_name")).cast("int").alias("rank"))


@query("SELECT n_name, CAST(row_number() OVER (ORDER BY n_name DESC) - 1 AS INTEGER) AS ordinal, 'none' AS error FROM nation")
def layer_reorder(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("ordinal"))
    wanted = sorted((r.n_name for r in nations.select("n_name").collect()), key=str.encode, reverse=True)  # one small table of layers
    return ordered.reorder(nations, "n_name", wanted).select("n_name", F.col("ordinal").cast("int").alias("ordinal"), "error")


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN CAST(floor(p_partkey / 2) AS BIGINT) END AS parent FROM part),
w(node, up, steps) AS (SELECT node, parent, 0 FROM p UNION ALL SELECT w.node, p.parent, w.steps + 1 FROM w JOIN p ON w.up = p.node)
SELECT node, max(steps) AS ancestors, bool_or(up IS NULL) AS rooted, 'none' AS error FROM w GROUP BY 1""")
def style_ancestry(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent"))
    return ordered.ancestry(t, "node", "parent")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256_identity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


_BYTES = "(printf('%016X', octet_length(encode({0}))) || hex(encode({0})))"


@query(f"""SELECT source, sha256(unhex(hex(encode('{DOMAIN}')) || printf('%016X', count(*)) || string_agg({_BYTES.format('name')} || {_BYTES.format('path')} || {_BYTES.format('sha')} || printf('%016X', octet_length(encode(text))), '' ORDER BY name))) AS content_sha256
FROM (SELECT source, text, 'doc-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS name, source || '/' || doc_id AS path, sha256(text) AS sha FROM documents) GROUP BY 1""")
def aggregate_identity(spark, sf_dir):
    """A content identity for each source: documents as resources, in the order of their names."""
    docs = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("logical_name"), F.concat("source", F.lit("/"), "doc_id").alias("relative_path"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))
    return content_identities(docs, "source")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (octet_length(encode(event_type)) BETWEEN 1 AND 255) AS good_text, count(*) FILTER (event_id % 3 <> 0) AS good_time FROM events GROUP BY 1""")
def utf8_timestamp_validation(spark, sf_dir):
    # Every third time gets a day that its month lacks.
    day = F.when(F.col("event_id") % 3 == 0, F.lit("2024-02-30T00:00:00Z")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    t = table(spark, sf_dir, "events").select("event_type", bounded_text(F.col("event_type")).alias("a"), is_utc_time(day).alias("b"))
    return t.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("a").alias("good_text"), F.count_if("b").alias("good_time"))


@query("""SELECT (SELECT count(*) FROM lineitem WHERE NOT coalesce(l_quantity > 0, false)) AS quantity, (SELECT count(*) FROM lineitem WHERE NOT coalesce(l_discount BETWEEN 0 AND 1, false)) AS discount,
(SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphans, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS duplicate_orders""")
def violations_audit(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount"), table(spark, sf_dir, "orders").select("o_orderkey")
    rows = ordered.count_violations(lines, quantity=F.col("l_quantity") > 0, discount=F.col("l_discount").between(0, 1))
    orphans = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left_anti").agg(F.count("*").alias("orphans"))
    return rows.crossJoin(orphans).crossJoin(ordered.duplicates(orders, "o_orderkey").agg(F.count("*").alias("duplicate_orders")))  # one row each


@query(f"""SELECT o_orderstatus, {r_sql('min(x)', 0)} AS min_x, {r_sql('max(x)', 0)} AS max_x, {r_sql('min(y)', 0)} AS min_y, {r_sql('max(y)', 0)} AS max_y, count(*) AS vertices FROM (SELECT o_orderstatus, {d(R)} * lon * cos({beta_sql('lat')}) AS x, {d(R)} * {beta_sql('lat')} AS y FROM {ORDERS}) GROUP BY 1""")
def scene_bounds(spark, sf_dir):
    t = placed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey").withColumn("p", g.project_point(F.col("lon"), F.col("lat")))
    return t.groupBy("o_orderstatus").agg(rounded(F.min("p.x"), 0).alias("min_x"), rounded(F.max("p.x"), 0).alias("max_x"), rounded(F.min("p.y"), 0).alias("min_y"), rounded(F.max("p.y"), 0).alias("max_y"), F.count("*").alias("vertices"))


@query("SELECT user_id, max(event_id) AS generation, arg_max(event_type, event_id) AS request FROM events GROUP BY 1")
def latest_generation_wins(spark, sf_dir):
    return latest_requests(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING NOT (min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*))")
def contiguity_audit(spark, sf_dir):
    return ordered.not_contiguous(table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("i")), ["l_orderkey"], "i")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def distinctness_proof(spark, sf_dir):
    return ordered.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(f"""SELECT o_custkey, o_orderkey, visible FROM (SELECT *, lag(visible) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS was FROM (SELECT o_custkey, o_orderkey, depth >= 0 AS visible FROM {_SEEN.format(ORDERS)})) WHERE was <> visible""")
def horizon_transitions(spark, sf_dir):
    t = placed(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_orderkey").select("o_custkey", "o_orderkey", g.globe_point(F.col("lon"), F.col("lat"), _C)["visible"].alias("visible"))
    return ordered.horizon_transitions(t, "o_custkey", "o_orderkey", "visible")


@query("""SELECT node, root FROM (SELECT c_custkey AS node, (c_custkey - 1) % 250 + 1 AS root FROM customer)""")
def cycle_assembly(spark, sf_dir):
    """Cycles of the permutation k -> k + 250 within the customers, from each one's least member."""
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    least = keys.withColumn("root", (F.col("c_custkey") - 1) % 250 + 1)
    w = Window.partitionBy("root").orderBy("c_custkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = least.select(F.col("c_custkey").alias("node"), F.coalesce(F.lead("c_custkey").over(w), F.first("c_custkey").over(whole)).alias("follow"))
    return ordered.cycle_roots(step, "node", "follow")


@query(f"""SELECT primitive, count(*) AS rings, 3 * count(*) AS pieces, count(*) AS split_rings, 4 * count(*) AS crossings, {r_sql('sum(area) / 1e6', 0)} AS semantic_km2, {r_sql('sum(area) / 1e11', 0)} AS plane_100000km2,
{r_sql('sum(area) * 1e-6', 0)} AS allowed_m2, true AS ring_error_within, 0 AS failed, true AS within_budget FROM (SELECT {_c_area('n_nationkey')} AS area FROM nation), (SELECT unnest(['mollweide', 'sinusoidal']) AS primitive) GROUP BY 1""")
def world_summary_by_primitive(spark, sf_dir):
    """The whole-world ledger: rings of every nation, projected both ways in one job, summed and held against the budget."""
    parts = []
    for name in ("mollweide", "sinusoidal"):
        options = RingOptions(name, relative_error=1e-6, geometric_tolerance=500.0, area_tolerance=1e7)
        rings = spread(_concave(table(spark, sf_dir, "nation"), "n_nationkey"), "n_nationkey")
        parts.append(project_rings(rings, options).withColumn("primitive", F.lit(name)))
    out = world_summary(parts[0].unionByName(parts[1]), "primitive")
    return out.select(
        "primitive", "rings", "pieces", "split_rings", "crossings", rounded(F.col("semantic_area") / g.lit(1e6), 0).alias("semantic_km2"), rounded(F.col("semantic_planar_area") / g.lit(1e11), 0).alias("plane_100000km2"),
        rounded(F.col("allowed_error"), 0).alias("allowed_m2"), (F.col("sum_ring_error") <= F.col("allowed_error")).alias("ring_error_within"), "failed", "within_budget",
    )

import math

import pytest
from pyspark.sql import functions as F

from meridion.functions import geodesy as g
from meridion.functions import text
from meridion.operators import ordered, rings
from meridion.operators.kernels import rings as exact
from meridion.operators.scene import palette

POINTS = "id int, points array<struct<lon: double, lat: double>>"
CASES = [
    [(-10, -20), (30, -20), (30, 25), (-10, 25)], [(170, -20), (-170, -20), (-170, 20), (170, 20)], [(0, 80), (90, 80), (180, 80), (-90, 80)], [(0, 0), (180, 0), (90, 50)], [(0, 0), (1, 1)],
    [(0, 0), (1, 91), (2, 0)], [(0, 0), (math.nan, 0), (2, 95)], [(0, 0), (10, 0), (5, 5), (360, 0)], [(350, 10), (-5, 12), (8, 30), (-7, 20)],
]


def test_rings_like_the_kernel(spark):
    rows = [(k, [tuple(math.radians(v) for v in p) for p in c]) for k, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, POINTS).withColumn("r", rings.canonical_ring(F.col("points"), "left")).withColumn("a", rings.ring_area(F.col("r.value")))
    for r, (_, points) in zip(df.orderBy("id").collect(), rows, strict=True):
        own, error = exact.canonicalise([p[0] for p in points], [p[1] for p in points], "left")
        assert r.r.error == error
        if own:
            assert [p.lon for p in r.r.value.vertices] == own.lon.tolist() and r.r.value.winding == own.winding
            assert math.isclose(r.a.value.area, exact.ring_area(own)[0], rel_tol=1e-9)
            assert not spark.createDataFrame([(r.r.value,)], df.select("r.value").schema).where(rings.stored_ring_error(F.col("value")) != "none").count()


def test_checked_scalars(spark):
    df = spark.createDataFrame([(0.5,), (2.0,), (math.nan,), (math.pi / 2,)], "x double")
    got = [(r.v.error, r.v.value) for r in df.select(g.authalic_latitude_checked(F.col("x")).alias("v")).collect()]
    assert [e for e, _ in got] == ["none", "latitude_out_of_range", "non_finite_input", "none"] and got[3][1] == math.pi / 2
    lon = spark.createDataFrame([(3 * math.pi,), (-math.pi,), (math.pi,), (0.1,)], "x double").select(g.stored_longitude(F.col("x")).alias("s")).collect()
    assert [r.s for r in lon] == [math.pi, math.pi, math.pi, 0.1]
    pole = spark.range(1).select(g.sinusoidal_inverse(F.lit(5.0), F.lit(g.R * math.pi / 2)).alias("p"), g.from_vector(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))).alias("v")).first()
    assert pole.p.error == pole.v.error == "indeterminate_coordinate"


def test_text(spark):
    df = spark.createDataFrame([("ok",), ("",), ("a\0b",), ("x" * 256,), (None,)], "s string")
    assert [r.b for r in df.select(text.bounded_text(F.col("s")).alias("b")).collect()] == [True, False, False, False, False]
    times = ["2024-02-29T00:00:00Z", "2024-02-30T00:00:00Z", "2023-02-29T00:00:00Z", "2024-01-01 00:00:00", "2024-01-01T24:00:00Z"]
    got = spark.createDataFrame([(t,) for t in times], "t string").select(text.is_utc_time(F.col("t")).alias("b")).collect()
    assert [r.b for r in got] == [text.valid_utc(t) for t in times] == [True, False, False, False, False]
    keys = ["abc", "DEU", "", "Übung", "zz" * 40]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", palette("k").alias("p")).collect()
    assert {r.k: r.p for r in got} == {k: text.palette_index(k) for k in keys}
    for kind, value in (("bool", True), ("int64", -5), ("double", 1.5), ("text", "é")):
        assert text.decode_property(kind, text.encode_property(kind, value)) == value


def test_dbf_cells(spark):
    df = spark.createDataFrame([(bytearray(b"  Ab c \x00"), bytearray(b" 042 ")), (bytearray(b"a\x00b"), bytearray(b"-1")), (bytearray(b"\xff"), bytearray(b"4x"))], "t binary, n binary")
    assert [(r.t, r.n) for r in df.select(text.dbf_text(F.col("t")).alias("t"), text.dbf_positive(F.col("n")).alias("n")).collect()] == [("Ab c", 42), (None, None), (None, None)]


def test_ordered(spark):
    segments = spark.createDataFrame([("k", 1, "a", "b"), ("k", 2, "b", "c"), ("k", 3, "x", "y"), ("k", 4, "y", "a")], "key string, o int, s string, e string")
    chains = ordered.close_chains(ordered.chain_ids(segments, "key", "o", "s", "e"), "key", "o", "s", "e")
    assert [r.chain for r in chains.orderBy("o").collect()] == [0, 0, 0, 0]
    odd = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2), ("a", 3.0, 3), ("b", 1.0, 1), ("b", 1.0, 2), ("c", 1.0, 1), ("c", 2.0, 2)], "k string, v double, t int")
    assert {r.k: r.error for r in ordered.pair_sorted(odd, "k", "v", "t").collect()} == {"a": "ambiguous_seam_touch", "b": "ambiguous_seam_touch", "c": "none"}
    layers = spark.createDataFrame([("x", 0), ("y", 1)], "id string, ordinal int")
    assert {(r.id, r.ordinal, r.error) for r in ordered.reorder(layers, "id", ["y", "x"]).collect()} == {("x", 1, "none"), ("y", 0, "none")}
    for wrong in (["y"], ["y", "x", "z"], ["y", "y"]):
        assert {(r.id, r.ordinal, r.error) for r in ordered.reorder(layers, "id", wrong).collect()} == {("x", 0, "not_a_permutation"), ("y", 1, "not_a_permutation")}
    forest = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("p", "q"), ("q", "p")], "n string, p string")
    assert {r.node: (r.ancestors if r.error == "none" else r.error) for r in ordered.ancestry(forest, "n", "p").collect()} == {"a": 0, "b": 1, "c": 2, "p": "cycle", "q": "cycle"}
    assert [r.o for r in ordered.not_increasing(segments, "key", "s", "o").collect()] == []


def test_sql_names(spark):
    from meridion.functions.sql import register

    register(spark)
    rows = [(k, [tuple(math.radians(v) for v in p) for p in c]) for k, c in enumerate(CASES)]
    spark.createDataFrame(rows, POINTS).createOrReplaceTempView("shapes")
    pieces = spark.sql("SELECT id, p.piece, p.error FROM shapes, LATERAL seam_pieces(points, 'left', 0D) p").collect()
    assert [(r.piece, r.error) for r in pieces if r.id == 1] == [(0, "none"), (1, "none")]
    assert [r.error for r in pieces if r.id == 4] == ["too_few_vertices"]
    areas = {r.id: r for r in spark.sql("SELECT id, a.* FROM shapes, LATERAL wgs84_ring_area(points, 'left') a").collect()}
    assert areas[0].error == "none" and areas[0].area > 0 and areas[3].error == "ambiguous_half_turn"
    flat = spark.sql("SELECT p.piece, p.error FROM shapes, LATERAL projected_pieces(points, 'left', 'sinusoidal', 0D) p WHERE id = 1").collect()
    assert [(r.piece, r.error) for r in flat] == [(0, "none"), (1, "none")]


def test_long_rings_unwrap_as_the_kernel_does(spark):
    import random
    import time

    from meridion.operators.kernels.rings import unwrap_all
    from meridion.operators.rings import LONG, unwrapped

    rng = random.Random(2)
    for n in (1, 2, LONG - 1, LONG, LONG + 1, 1000, 16_000):
        lon, here = [], 0.0
        for k in range(n):
            here += rng.uniform(-1, 1) if k % 7 else 0.0
            lon.append((here + 3.141592653589793) % 6.283185307179586 - 3.141592653589793)
        df = spark.createDataFrame([([(x, k / n) for k, x in enumerate(lon)],)], "points array<struct<lon: double, lat: double>>")
        began = time.time()
        got = df.select(unwrapped(F.col("points")).alias("p")).first().p
        assert time.time() - began < 20
        assert [p.lat for p in got] == [k / n for k in range(n)] and max(abs(a.lon - b) for a, b in zip(got, unwrap_all(lon))) < 1e-9
        assert all((a.lon == b.lon) == (x == y) for a, b, x, y in zip(got, got[1:], lon, lon[1:]))


@pytest.mark.parametrize("n", [10_000, 200_000])
def test_ancestry_of_deep_chains(spark, n):
    from meridion.operators.ordered import ancestry

    chain = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    more = spark.createDataFrame([(n + 1, n + 2), (n + 2, n + 3), (n + 3, n + 2), (n + 4, -5), (n + 5, n + 4), (n + 6, n + 6)], "node long, parent long")
    got = ancestry(chain.union(more), "node", "parent")
    assert got.where(F.col("node") < n).agg(F.count_if((F.col("ancestors") == F.col("node")) & F.col("rooted") & (F.col("error") == "none"))).first()[0] == n
    assert {tuple(r) for r in got.where(F.col("node") >= n).collect()} == {
        (n + 1, None, False, "cycle"), (n + 2, None, False, "cycle"), (n + 3, None, False, "cycle"), (n + 4, 0, False, "none"), (n + 5, 1, False, "none"), (n + 6, None, False, "cycle")
    }


def test_superseded_work_is_cancelled(spark):
    import time
    from concurrent.futures import CancelledError

    from meridion.streaming.generations import Generations

    def slow(wanted):
        return spark.range(0, 64, 1, 64).mapInPandas(lambda parts: ((time.sleep(2), p)[1] for p in parts), "id long").count()

    requests = Generations(spark, "view")
    first = requests.request(slow)
    time.sleep(1)
    second = requests.request(lambda wanted: (spark.range(5).count(), wanted()))
    assert second.result(30) == (5, True)
    began = time.time()
    with pytest.raises(CancelledError):
        first.result(30)
    assert time.time() - began < 15
    third = requests.request(lambda wanted: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        third.result(30)


def test_sql_names(spark):
    from meridion.functions import sql

    sql.register(spark)
    spark.sql("select array(named_struct('lon', -0.1D, 'lat', -0.1D), named_struct('lon', 0.1D, 'lat', -0.1D), named_struct('lon', 0.1D, 'lat', 0.1D), named_struct('lon', -0.1D, 'lat', 0.1D)) as points, 'left' as side").createOrReplaceTempView("rings")
    one = lambda call: spark.sql(f"select t.* from rings, lateral {call} t").collect()
    assert [(r.winding, len(r.vertices), r.error) for r in one("canonical_ring(points, side)")] == [(0, 4, "none")]
    (r,) = one("subdivided_ring(points, side, 'sinusoidal', 100D, 1e6D)")
    assert r.error == "none" and len(r.points) > 8
    assert [(r.part, r.error) for r in one("globe_curve_parts(points, side, 0D, 0D)")] == [(0, "none")]
    (fill,), (area,) = one("globe_fill_rings(points, side, 0D, 0D)"), one("wgs84_ring_area(points, side)")
    assert fill.error == "none" and 0.98 * area.area < fill.area < area.area
    assert one("globe_curve_parts(points, side, 3.14159D, 0D)") == [] and one("canonical_ring(slice(points, 1, 2), side)")[0].error == "too_few_vertices"

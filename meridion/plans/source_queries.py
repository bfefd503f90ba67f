"""Queries of the sources and the store: rows of the test tables go out as files or projects and are read back.

Files of many rows are made and parsed in executors. What the driver writes comes from the tables ``nation``
and ``region``, which do not grow.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.functions import geodesy as g
from meridion.functions import text
from meridion.functions.constants import PI, RADIANS
from meridion.operators.scene import drag, zoomed
from meridion.sources import shapefile, snapshots
from meridion.sources.adapters import ADMIN0, COUNTRY_FIELDS, LAND, CountryAdapter, LandAdapter, Registry, SourceError, load_pinned, violations
from meridion.sources.store import CHUNK, Project

from .catalogue import d, principal_sql, query, r_sql, rounded, table
from .fixtures import WKT, box, dbase_file, local_folder, polygon_file

# Shapefiles --------------------------------------------------------------------------------------------------


def _place(key: int) -> tuple[float, float]:
    return (key * 7919 % 34000) / 100 - 170, (key * 104729 % 16001) / 100 - 80


def _place_sql(key: str) -> tuple[str, str]:
    return f"(CAST({key} * 7919 % 34000 AS DOUBLE) / 1e2 - 17e1)", f"(CAST({key} * 104729 % 16001 AS DOUBLE) / 1e2 - 8e1)"


def _files(df: DataFrame, make) -> DataFrame:
    """(path, content) of a file for each row, named by its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in keys]), pa.array([make(k) for k in keys], pa.binary())], ["path", "content"])

    return df.mapInArrow(run, "path string, content binary")


_X, _Y = _place_sql("s_suppkey")


@query(f"""SELECT nation, record_number, ring_index, CASE ring_index WHEN 0 THEN 'exterior' ELSE 'interior' END AS role, CASE ring_index WHEN 0 THEN 'right' ELSE 'left' END AS side, 4 AS vertices, 0 AS winding,
{r_sql('x - h', 6)} AS lon, {r_sql('y - h', 6)} AS lat FROM (SELECT s_nationkey AS nation, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS record_number, s_suppkey, {_X} AS x, {_Y} AS y FROM supplier),
(SELECT unnest([0, 1]) AS ring_index, unnest([1e0, 5e-1]) AS h) WHERE s_suppkey % 10 <> 0""")
def shapefile_scan(spark, sf_dir):
    """A shapefile for each nation, with a square and its hole for each supplier and null shapes between, parsed where it was made."""

    def make(rows: pa.Table) -> pa.Table:
        keys = sorted(rows["s_suppkey"].to_pylist())
        records = [None if k % 10 == 0 else [box(*_place(k), 1.0), box(*_place(k), 0.5, False)] for k in keys]
        return pa.table({"path": [str(rows["s_nationkey"][0].as_py())], "content": [polygon_file(records)]})

    files = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey").groupBy("s_nationkey").applyInArrow(make, "path string, content binary")
    rings = shapefile.parse_polygon_files(files).select(F.col("path").cast("int").alias("nation"), "record_number", F.posexplode("rings").alias("ring_index", "r"))
    first = F.col("r.points")[0]
    return rings.select(
        "nation", "record_number", "ring_index", "r.role", "r.side", F.size("r.points").alias("vertices"), "r.winding",
        rounded(first["lon"] / g.lit(RADIANS), 6).alias("lon"), rounded(first["lat"] / g.lit(RADIANS), 6).alias("lat"),
    )


def _beyond(value: float, steps: int) -> float:
    for _ in range(steps):
        value = float(np.nextafter(value, np.inf))
    return value


def _broken(key: int) -> bytes:
    x, y = _place(key)
    good, far = box(x, y, 1.0), _beyond(180.0, 16)
    return [
        lambda: polygon_file([[good]]), lambda: polygon_file([[good]], code=9993), lambda: polygon_file([[good]], extra=b"xx"), lambda: polygon_file([[good]], kind=3), lambda: polygon_file([[good]])[:50],
        lambda: polygon_file([[good[:4]]]), lambda: polygon_file([[[(170, 0), (170, 2), (far, 2), (far, 0), (170, 0)]]]), lambda: polygon_file([[good]], first=2),
    ][key % 8]()


@query("""SELECT error, count(*) AS files, CAST(sum(good) AS BIGINT) AS shapes FROM (SELECT CASE c_custkey % 8 WHEN 0 THEN 'none' WHEN 1 THEN 'invalid_header' WHEN 2 THEN 'length_mismatch' WHEN 3 THEN 'unsupported_shape_type' WHEN 4 THEN 'truncated'
WHEN 5 THEN 'ring_not_closed' WHEN 6 THEN 'invalid_coordinate' ELSE 'record_number_mismatch' END AS error, CASE WHEN c_custkey % 8 = 0 THEN 1 ELSE 0 END AS good FROM customer) GROUP BY 1""")
def shapefile_errors(spark, sf_dir):
    out = shapefile.parse_polygon_files(_files(table(spark, sf_dir, "customer").select("c_custkey"), _broken))
    return out.groupBy("error").agg(F.count("*").alias("files"), F.count("record_number").alias("shapes"))


@query("""SELECT steps, CASE WHEN steps <= 8 THEN 'none' ELSE 'invalid_coordinate' END AS error, count(*) AS files, CAST(sum(CASE WHEN steps BETWEEN 1 AND 8 THEN 2 ELSE 0 END) AS BIGINT) AS normalised FROM (SELECT c_custkey % 12 AS steps FROM customer) GROUP BY 1, 2""")
def boundary_roundoff(spark, sf_dir):
    """Longitudes of up to eight floats beyond 180 degrees are set to it and counted; more break the file."""
    make = lambda k: polygon_file([[[(170, 0), (170, 2), (_beyond(180.0, k % 12), 2), (_beyond(180.0, k % 12), 0), (170, 0)]]])
    out = shapefile.parse_polygon_files(_files(table(spark, sf_dir, "customer").select("c_custkey"), make))
    return out.groupBy((F.col("path").cast("long") % 12).alias("steps"), "error").agg(F.count("*").alias("files"), F.sum("normalised").alias("normalised"))


# dBASE tables ------------------------------------------------------------------------------------------------


def _nations(spark: SparkSession, sf_dir: str) -> list:
    return table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows, whatever the scale


@query("""SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS record_number, n_nationkey % 6 = 5 AS deleted, CASE WHEN n_nationkey % 7 <> 3 THEN n_name END AS name, CASE WHEN n_nationkey > 0 THEN CAST(n_nationkey AS BIGINT) END AS key,
CASE WHEN n_nationkey % 4 = 1 THEN NULL WHEN n_regionkey > 0 THEN CAST(n_regionkey AS BIGINT) END AS region FROM nation""")
def dbase_scan(spark, sf_dir):
    """A dBASE table, read by ranges of seven rows; its cells decoded: blanks cut, names with a NUL and numbers that are none or not positive are null."""
    rows = _nations(spark, sf_dir)
    cells = [[b"A\0B" if r.n_nationkey % 7 == 3 else f" {r.n_name}".encode(), f"{r.n_nationkey:6d}".encode(), b"1x" if r.n_nationkey % 4 == 1 else str(r.n_regionkey).encode()] for r in rows]
    path = local_folder(spark, "dbase") / "nation.dbf"
    path.write_bytes(dbase_file([("NAME", "C", 26), ("KEY", "N", 6), ("REGION", "N", 4)], cells, [r.n_nationkey % 6 == 5 for r in rows]))
    shapefile.register(spark)
    t = spark.read.format("dbase").option("rows", 7).load(str(path))
    return t.select("record_number", "deleted", text.dbf_text(F.col("NAME")).alias("name"), text.dbf_positive(F.col("KEY")).alias("key"), text.dbf_positive(F.col("REGION")).alias("region"))


@query("SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'unsupported_version' WHEN 1 THEN 'duplicate_field' WHEN 2 THEN 'truncated' WHEN 3 THEN 'trailing_data' ELSE 'invalid_terminator' END AS error FROM region")
def dbase_errors(spark, sf_dir):
    rows, out = table(spark, sf_dir, "region").collect(), []  # 5 rows
    cells = [[r.r_name.encode()] for r in rows]
    own = [("NAME", "C", 20)]
    kinds = [
        dbase_file(own, cells, version=4), dbase_file([*own, *own], [c * 2 for c in cells]), dbase_file(own, cells)[:-30], dbase_file(own, cells, end=b"\x1axx"), dbase_file(own, cells, terminator=b"\n"),
    ]
    folder = local_folder(spark, "dbase")
    for r in rows:
        path = folder / f"{r.r_regionkey}.dbf"
        path.write_bytes(kinds[r.r_regionkey % 5])
        try:
            shapefile.read_dbf(path)
            out.append((r.r_regionkey, "none"))
        except shapefile.FormatError as e:
            out.append((r.r_regionkey, str(e)))
    return spark.createDataFrame(out, "r_regionkey int, error string")


# Snapshots, adapters -----------------------------------------------------------------------------------------


def _manifest(resources, dataset: str = "regions", **more) -> snapshots.Manifest:
    return snapshots.Manifest(dataset, "v1", "Natural Earth", "public domain", tuple(resources), "5.1.2", retrieved_utc="2024-01-01T00:00:00Z", retrieval_uri="https://example.org/x", **more)


def _written(folder, name: str, data: bytes, logical: str) -> snapshots.Resource:
    (folder / name).write_bytes(data)
    return snapshots.Resource(logical, name, hashlib.sha256(data).hexdigest(), len(data))


@query("""SELECT 'region:' || r_regionkey AS logical_name, r_regionkey || '.txt' AS relative_path, sha256(r_name) AS sha256, CAST(octet_length(encode(r_name)) AS BIGINT) AS size_bytes, true AS verified, r_name AS content FROM region""")
def snapshot_files(spark, sf_dir):
    """A manifest of files, its pins read back as a table, all verified and found by their logical names."""
    folder = local_folder(spark, "snapshot")
    rows = table(spark, sf_dir, "region").collect()  # 5 rows
    own = [_written(folder, f"{r.r_regionkey}.txt", r.r_name.encode(), f"region:{r.r_regionkey}") for r in rows]
    (folder / "pins.tsv").write_text("# logical\trelative\tsha\tsize\n" + "".join(f"{r.logical_name}\t{r.relative_path}\t{r.sha256}\t{r.size_bytes}\n" for r in own))
    found, error, _ = snapshots.verify(folder, _manifest(snapshots.read_pins(folder / "pins.tsv")))
    texts = [(n, found.path(n).read_text(), error == "none" and found.sizes[n] == found.path(n).stat().st_size) for n in found.paths] if found else []
    read = spark.createDataFrame(texts, "logical_name string, content string, verified boolean")
    return snapshots.pins_frame(spark, str(folder / "pins.tsv")).join(read, "logical_name").select("logical_name", "relative_path", "sha256", "size_bytes", "verified", "content")


@query("""SELECT n_nationkey, CASE n_nationkey % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'hash_mismatch' WHEN 2 THEN 'size_mismatch' WHEN 3 THEN 'missing_resource' WHEN 4 THEN 'unsafe_path' WHEN 5 THEN 'duplicate_resource' ELSE 'invalid_manifest' END AS error,
CASE WHEN n_nationkey % 7 = 0 THEN sha256(unhex(hex(encode('meridion-snapshot-content-v1')) || printf('%016X', 1) || printf('%016X', octet_length(encode('n'))) || hex(encode('n')) || printf('%016X', octet_length(encode(n_nationkey || '.txt'))) || hex(encode(n_nationkey || '.txt'))
|| printf('%016X', 64) || hex(encode(sha256(n_name))) || printf('%016X', octet_length(encode(n_name))))) ELSE '' END AS content_sha256 FROM nation""")
def snapshot_errors(spark, sf_dir):
    folder, out = local_folder(spark, "snapshot"), []
    for r in _nations(spark, sf_dir):
        own, k = _written(folder, f"{r.n_nationkey}.txt", r.n_name.encode(), "n"), r.n_nationkey % 7
        resources = {
            1: [snapshots.Resource("n", own.relative_path, "0" * 64)], 2: [snapshots.Resource("n", own.relative_path, own.sha256, own.size_bytes + 1)], 3: [snapshots.Resource("n", "nowhere", own.sha256)],
            4: [snapshots.Resource("n", f"../{own.relative_path}", own.sha256)], 5: [own, own], 6: [snapshots.Resource("n", own.relative_path, "short")],
        }.get(k, [own])
        found, error, _ = snapshots.verify(folder, _manifest(resources))
        out.append((r.n_nationkey, error, found.content_sha256 if found else ""))
    return spark.createDataFrame(out, "n_nationkey int, error string, content_sha256 string")


def _land(spark: SparkSession, sf_dir: str) -> snapshots.Snapshot:
    folder = local_folder(spark, "land")
    records = [[box(*_place(r.n_nationkey), 1.0)] + [box(*_place(r.n_nationkey), 0.5, False)] * (r.n_nationkey % 3 == 0) for r in _nations(spark, sf_dir)]
    own = [_written(folder, n, data, logical) for n, data, logical in (("l.shp", polygon_file(records), "geometry.shp"), ("l.prj", WKT.encode(), "crs.prj"), ("v.txt", b"5.1.2\n", "dataset.version"))]
    return snapshots.verify(folder, _manifest(own, "ne_110m_land"))[0]


def _countries(spark: SparkSession, sf_dir: str, **more) -> snapshots.Snapshot:
    folder, rows = local_folder(spark, "countries"), _nations(spark, sf_dir)
    fields = [(n, k, 26) for n, k in COUNTRY_FIELDS.items()]
    cells = [[str(900 + r.n_nationkey).encode() if kind == "N" else f"C{r.n_nationkey:02d}".encode() if name == "ADM0_A3" else f"{r.n_name}".encode() if name.startswith("NAME") else f"{name[:6]} {r.n_regionkey}".encode() for name, kind in COUNTRY_FIELDS.items()] for r in rows]
    files = (("c.shp", polygon_file([[box(*_place(r.n_nationkey), 1.0)] for r in rows]), "geometry.shp"), ("c.prj", WKT.encode(), "crs.prj"), ("v.txt", b"5.1.2", "dataset.version"), ("c.cpg", b"UTF-8", "encoding.cpg"), ("c.dbf", dbase_file(fields, cells), "attributes.dbf"))
    own = [_written(folder, n, data, logical) for n, data, logical in files]
    return snapshots.verify(folder, _manifest(own, "ne_110m_admin_0_countries", worldview="de facto", **more))[0]


def _registry() -> Registry:
    registry = Registry()
    registry.add(LandAdapter())
    registry.add(CountryAdapter())
    return registry


LAND_ID, COUNTRY_ID = LandAdapter().descriptor.adapter_id, CountryAdapter().descriptor.adapter_id


@query("""SELECT 'ne_110m_land:v1:record:' || (row_number() OVER (ORDER BY n_nationkey)) AS stable_id, 'record:' || (row_number() OVER (ORDER BY n_nationkey)) AS source_id, CAST(1 + CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS rings,
CAST(CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS holes, CASE WHEN n_nationkey % 3 = 0 THEN 'left,right' ELSE 'right' END AS sides FROM nation""")
def land_dataset(spark, sf_dir):
    """Land polygons through the registry, pinned by identity and number of features."""
    snap = _land(spark, sf_dir)
    data = load_pinned(spark, _registry(), LAND_ID, snap, snap.content_sha256, 25)
    return data.features.groupBy("stable_id", "source_id").agg(F.count("*").alias("rings"), F.count_if(F.col("role") == "interior").alias("holes"), F.array_join(F.array_sort(F.collect_set("side")), ",").alias("sides"))


_FIELD = " UNION ALL ".join(
    f"SELECT 900 + n_nationkey AS id, '{n.lower()}' AS key, '{'text' if k == 'C' else 'int64'}' AS type_id, {'CAST(900 + n_nationkey AS BIGINT)' if k == 'N' else 'CAST(NULL AS BIGINT)'} AS i, "
    + ("CAST(NULL AS VARCHAR)" if k == "N" else "'C' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')" if n == "ADM0_A3" else "n_name" if n.startswith("NAME") else f"'{n[:6]} ' || n_regionkey") + " AS s FROM nation"
    for n, k in COUNTRY_FIELDS.items()
)


@query(f"SELECT 'ne_110m_admin_0_countries:ne_id:' || id AS stable_id, key, type_id, i, s FROM ({_FIELD})")
def country_properties(spark, sf_dir):
    """Shapes joined with attribute rows by record number, thirteen texts and a number each."""
    return _registry().load(spark, COUNTRY_ID, _countries(spark, sf_dir), ADMIN0).properties.select("stable_id", "key", "type_id", "i", "s")


@query("SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'adapter_not_found' WHEN 1 THEN 'capability_missing' WHEN 2 THEN 'content_mismatch' WHEN 3 THEN 'identity_mismatch' ELSE 'none' END AS error FROM region")
def registry_errors(spark, sf_dir):
    registry, snap, out = _registry(), _land(spark, sf_dir), []
    tries = [("nobody", 0, ""), (LAND_ID, ADMIN0, ""), (LAND_ID, LAND, "0" * 64), (COUNTRY_ID, 0, ""), (LAND_ID, LAND, snap.content_sha256)]
    for r in table(spark, sf_dir, "region").collect():  # 5 rows
        adapter, bits, pin = tries[r.r_regionkey % 5]
        try:
            registry.load(spark, adapter, snap, bits, pin)
            out.append((r.r_regionkey, "none"))
        except SourceError as e:
            out.append((r.r_regionkey, e.args[0]))
    return spark.createDataFrame(out, "r_regionkey int, error string")


@query("""SELECT n_flaw AS flaw, CAST(bad_stable_id AS BIGINT) AS bad_stable_id, CAST(short_rings AS BIGINT) AS short_rings, CAST(bad_role AS BIGINT) AS bad_role, CAST(orphans AS BIGINT) AS orphan_properties FROM (
SELECT 'none' AS n_flaw, 0 AS bad_stable_id, 0 AS short_rings, 0 AS bad_role, 0 AS orphans UNION ALL SELECT 'id', count(*), 0, 0, count(*) FROM nation UNION ALL SELECT 'points', 0, count(*), 0, 0 FROM nation UNION ALL SELECT 'role', 0, 0, count(*), 0 FROM nation)""")
def dataset_violations(spark, sf_dir):
    """The validator's counts for a good dataset and for three with a flaw in every feature."""
    data = _registry().load(spark, COUNTRY_ID, _countries(spark, sf_dir))
    from dataclasses import replace

    flaws = {"none": data.features, "id": data.features.withColumn("stable_id", F.lit("")), "points": data.features.withColumn("points", F.slice("points", 1, 2)), "role": data.features.withColumn("role", F.lit("x"))}
    out = None
    for name, features in flaws.items():
        part = violations(replace(data, features=features)).select(F.lit(name).alias("flaw"), *[F.col(c).cast("long").alias(c) for c in ("bad_stable_id", "short_rings", "bad_role", "orphan_properties")])
        out = part if out is None else out.unionByName(part)
    return out


# The store ---------------------------------------------------------------------------------------------------


def _project(spark: SparkSession, sf_dir: str, land: bool = False, countries: bool = False) -> Project:
    project, _ = Project.create(spark, local_folder(spark, "project") / "p")
    for want, source, adapter, snap in ((land, "land", LandAdapter(), _land), (countries, "countries", CountryAdapter(), _countries)):
        if want:
            own = snap(spark, sf_dir)
            project.store_snapshot(_registry().load(spark, adapter.descriptor.adapter_id, own), source, adapter, own)
    return project


_NX, _NY = _place_sql("n_nationkey")


@query(f"""SELECT 'ne_110m_admin_0_countries:ne_id:' || (900 + n_nationkey) AS stable_id, CAST(1 AS BIGINT) AS ring_count, CAST(14 AS BIGINT) AS property_count, n_name AS name, 4 AS vertices, {r_sql(f'{_NX} - 1e0', 6)} AS lon, {r_sql(f'{_NY} - 1e0', 6)} AS lat FROM nation""")
def stored_dataset(spark, sf_dir):
    """Geometry and properties as a project gives them back, and both indexes."""
    project = _project(spark, sf_dir, countries=True)
    back = project.load_dataset("countries")
    names = back.properties.where("key = 'name'").select("stable_id", F.col("s").alias("name"))
    first = F.col("points")[0]
    rows = back.features.select("stable_id", F.size("points").alias("vertices"), rounded(first["lon"] / g.lit(RADIANS), 6).alias("lon"), rounded(first["lat"] / g.lit(RADIANS), 6).alias("lat"))
    return rows.join(project.geometry_index("countries").select("stable_id", "ring_count"), "stable_id").join(project.property_index("countries"), "stable_id").join(names, "stable_id")


@query("""SELECT step, status, changed, CAST(revision AS INTEGER) AS revision FROM (VALUES ('1 worldview', 'none', true, 2), ('2 worldview again', 'none', false, 2), ('3 geometry', 'none', true, 3), ('4 geometry again', 'none', false, 3), ('5 other snapshot', 'provenance_mismatch', false, 0),
('6 other content', 'record_exists', false, 3), ('7 properties', 'none', true, 4), ('8 properties again', 'none', false, 4), ('9 geometry only', 'none', false, 4)) AS t(step, status, changed, revision)""")
def store_revisions(spark, sf_dir):
    """One revision a change, none for exact retries and refused ones; properties come later and are never taken back."""
    project = _project(spark, sf_dir)
    adapter, snap, land = CountryAdapter(), _countries(spark, sf_dir), _land(spark, sf_dir)
    whole, other = _registry().load(spark, COUNTRY_ID, snap), _registry().load(spark, LAND_ID, land)
    from dataclasses import replace

    bare = replace(whole, properties=None)
    steps = [
        ("1 worldview", lambda: project.set_worldview("de facto")), ("2 worldview again", lambda: project.set_worldview("de facto")), ("3 geometry", lambda: project.store_snapshot(bare, "countries", adapter, snap)),
        ("4 geometry again", lambda: project.store_snapshot(bare, "countries", adapter, snap)), ("5 other snapshot", lambda: project.store_snapshot(whole, "countries", adapter, land)),
        ("6 other content", lambda: project.store_snapshot(other, "countries", LandAdapter(), land)), ("7 properties", lambda: project.store_snapshot(whole, "countries", adapter, snap)),
        ("8 properties again", lambda: project.store_snapshot(whole, "countries", adapter, snap)), ("9 geometry only", lambda: project.store_snapshot(bare, "countries", adapter, snap)),
    ]
    return spark.createDataFrame([(name, (o := call()).status, o.changed, o.revision) for name, call in steps], "step string, status string, changed boolean, revision int")


@query("""SELECT source_id, adapter_id, CAST(bits AS INTEGER) AS capability_bits, temporal_class, worldview, CAST((SELECT count(*) FROM nation) AS BIGINT) AS features FROM (VALUES ('countries', 'ne_110m_admin_0_countries.admin0.v1', 2, 'slow_change', 'de facto'),
('land', 'ne_110m_land.land.v1', 1, 'timeless_or_structural', '')) AS t(source_id, adapter_id, bits, temporal_class, worldview)""")
def stored_provenance(spark, sf_dir):
    project = _project(spark, sf_dir, land=True, countries=True)
    counts = [(k, v["geometry"]["feature_count"]) for k, v in project.state()["sources"].items()]
    return project.provenance().select("source_id", "adapter_id", "capability_bits", "temporal_class", "worldview").join(spark.createDataFrame(counts, "source_id string, features long"), "source_id")


def _layer(r, **more) -> dict:
    return {"layer_id": f"nation.{r.n_nationkey}", "role_id": "meridion.layer.label.country.v1", "name": r.n_name, "visible": r.n_nationkey % 2 == 0, **more}


@query("""SELECT CAST(row_number() OVER (ORDER BY n_name DESC) - 1 AS INTEGER) AS ordinal, 'nation.' || n_nationkey AS layer_id, n_name AS name, n_nationkey % 2 = 0 AS visible, CAST(2 + n_nationkey AS INTEGER) AS revision, false AS again, CASE WHEN n_nationkey % 3 = 0 THEN 'land' END AS source_id,
CASE WHEN n_nationkey % 3 = 0 THEN true END AS bound FROM nation WHERE n_nationkey % 5 <> 4""")
def layer_stack(spark, sf_dir):
    """Layers appended in the order of keys, each twice, some removed, then put into the order of names."""
    project, out = _project(spark, sf_dir, land=True), {}
    rows = _nations(spark, sf_dir)
    for r in rows:
        own = _layer(r, sources=[{"slot_id": "geometry", "source_id": "land"}] if r.n_nationkey % 3 == 0 else [])
        first, second = project.append_layer(own), project.append_layer(own)
        out[own["layer_id"]] = (first.revision - 1, second.changed)
    for r in rows:
        if r.n_nationkey % 5 == 4:
            project.remove_layer(f"nation.{r.n_nationkey}")
    left = sorted((r for r in rows if r.n_nationkey % 5 != 4), key=lambda r: r.n_name, reverse=True)
    project.order_layers([f"nation.{r.n_nationkey}" for r in left])
    told = spark.createDataFrame([(k, *v) for k, v in out.items()], "layer_id string, revision int, again boolean")
    return project.layers().join(told, "layer_id").select("ordinal", "layer_id", "name", "visible", "revision", "again", "source_id", F.when(F.col("source_id").isNotNull(), F.col("bound")).alias("bound"))


@query("""SELECT 'nation.' || n_nationkey AS layer_id, 'icon' AS slot_id, 'region.' || n_regionkey AS resource_id, CASE WHEN n_regionkey % 2 = 0 THEN 'embedded' ELSE 'external' END AS mode, true AS required, n_regionkey % 2 = 1 AS thaws FROM nation""")
def resource_bindings(spark, sf_dir):
    """Layers bind resources, which makes them required; a required external one takes back a freeze."""
    project, folder, thaws = _project(spark, sf_dir), local_folder(spark, "resources"), []
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():  # 5 rows
        if r.r_regionkey % 2 == 0:
            (folder / str(r.r_regionkey)).write_text(r.r_name)
            project.embed(f"region.{r.r_regionkey}", folder / str(r.r_regionkey))
    for r in _nations(spark, sf_dir):
        name = f"region.{r.n_regionkey}"
        if r.n_regionkey % 2:
            project.store_external(f"spare.{r.n_nationkey}", "https://example.org/s", "0" * 64, 1)
    frozen = project.freeze()
    assert frozen.ok
    for r in _nations(spark, sf_dir):
        name = f"region.{r.n_regionkey}"
        if r.n_regionkey % 2 and name not in project.state()["resources"]:
            project.store_external(name, f"https://example.org/{r.n_regionkey}", "0" * 64, 5)
        project.append_layer(_layer(r, resources=[{"slot_id": "icon", "resource_id": name}]))
        again = project.freeze()
        own = next(x for x in project.state()["resources"].items() if x[0] == name)[1]
        thaws.append((f"nation.{r.n_nationkey}", own["mode"] == "external" and not again.ok))
    told = spark.createDataFrame(thaws, "layer_id string, thaws boolean")
    return project.resource_bindings().join(told, "layer_id").select("layer_id", "slot_id", "resource_id", "mode", "required", "thaws")


@query(f"""SELECT r_regionkey, CAST(k AS INTEGER) AS chunk_index, CAST(least({CHUNK}, size - k * {CHUNK}) AS BIGINT) AS size, true AS ok, sha256(repeat(r_name, 100000 * (1 + CAST(r_regionkey AS BIGINT)))) AS whole FROM (SELECT *, octet_length(encode(r_name)) * 100000 * (1 + r_regionkey) AS size,
unnest(range(0, CAST(ceil(octet_length(encode(r_name)) * 100000 * (1 + r_regionkey) / CAST({CHUNK} AS DOUBLE)) AS BIGINT))) AS k FROM region)""")
def embedded_resources(spark, sf_dir):
    """Files in chunks of a mebibyte, hashed by Spark, and streamed whole to a consumer that hashes them."""
    project, folder, out = _project(spark, sf_dir), local_folder(spark, "resources"), None
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():  # 5 rows
        path = folder / str(r.r_regionkey)
        path.write_text(r.r_name * 100_000 * (1 + r.r_regionkey))
        project.embed(path.name, path)
        whole = hashlib.sha256()
        for part in project.stream(path.name):
            whole.update(part)
        own = project.chunk_table(path.name).select(F.lit(r.r_regionkey).alias("r_regionkey"), "chunk_index", "size", "ok", F.lit(whole.hexdigest()).alias("whole"))
        out = own if out is None else out.unionByName(own)
    return out


@query("""SELECT 'n' || n_nationkey AS style_id, 'r' || n_regionkey AS parent, CAST(1 + n_nationkey % 3 AS INTEGER) AS properties, CASE WHEN n_nationkey % 4 = 0 THEN 'style_in_use' ELSE 'none' END AS removal, 'style_cycle' AS turned, CASE WHEN n_nationkey % 2 = 0 THEN 'invalid_value' ELSE 'none' END AS colour FROM nation""")
def style_store(spark, sf_dir):
    """Styles with parents: bound ones stay, a parent that would follow its child is refused, so is a colour of three bytes."""
    project, out = _project(spark, sf_dir), []
    rows = _nations(spark, sf_dir)
    for k in sorted({r.n_regionkey for r in rows}):
        project.set_style(f"r{k}", {})
    project.append_layer({"layer_id": "all", "role_id": "r", "name": "All"})
    for r in rows:
        name = f"n{r.n_nationkey}"
        project.set_style(name, {f"w{i}": ("meridion.style.value.f64le.v1", struct.pack("<d", i)) for i in range(1 + r.n_nationkey % 3)}, f"r{r.n_regionkey}")
        if r.n_nationkey % 4 == 0:
            project.bind_style("all", name, name)
    for r in rows:
        name, own = f"n{r.n_nationkey}", dict(project.styles())[f"n{r.n_nationkey}"]
        turned = project.set_style(f"r{r.n_regionkey}", {}, name).status
        colour = project.set_style("tint", {"fill": ("meridion.style.value.rgba8.v1", bytes(3 + r.n_nationkey % 2))}).status
        out.append((name, own["parent"], len(own["properties"]), project.remove_style(name).status, turned, colour))
    return spark.createDataFrame(out, "style_id string, parent string, properties int, removal string, turned string, colour string")


_TURN = "(CAST(n_nationkey AS DOUBLE) * 7e-1 - 8e0)"


@query(f"""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'sinusoidal' ELSE 'mollweide' END AS model, {r_sql(principal_sql(_TURN), 9)} AS meridian, 'none' AS status, 'unsupported_cut' AS other_cut, CAST(2 + n_nationkey AS INTEGER) AS revision FROM nation""")
def projection_state(spark, sf_dir):
    """The projection as it is stored: central meridians in (-pi, pi], one way to cut."""
    project, out = _project(spark, sf_dir), []
    for r in _nations(spark, sf_dir):
        model = ("sinusoidal", "mollweide")[r.n_nationkey % 2]
        done = project.set_projection(model, r.n_nationkey * 0.7 - 8.0)
        project.set_projection(model, r.n_nationkey * 0.7 - 8.0 + 4 * PI)  # the same to a rounding
        state = project.projection()
        out.append((r.n_nationkey, state[0], round(state[1], 9) + 0.0, done.status, project.set_projection(model, 0.0, "two-cuts").status, r.n_nationkey + 2))
    return spark.createDataFrame(out, "n_nationkey int, model string, meridian double, status string, other_cut string, revision int")


@query("SELECT r_regionkey, r_name AS view, true AS foreign_is_none FROM region")
def session_views(spark, sf_dir):
    """The last written view is read back; another project's is not."""
    project, other, out = _project(spark, sf_dir), _project(spark, sf_dir), []
    for r in table(spark, sf_dir, "region").collect():  # 5 rows
        project.write_session({"name": r.r_name})
        other.root.joinpath("session.json").write_bytes(project.root.joinpath("session.json").read_bytes())
        out.append((r.r_regionkey, project.read_session()["name"], other.read_session() is None))
    return spark.createDataFrame(out, "r_regionkey int, view string, foreign_is_none boolean")


@query("""SELECT 'region.' || r_regionkey || '.chunks' AS rule, CAST(r_regionkey % 2 AS INTEGER) AS violations FROM region UNION ALL SELECT unnest(['land.geometry_content', 'land.geometry_model', 'land.feature_count', 'land.rings', 'land.latitude', 'land.side', 'layer_sources', 'layer_styles', 'style_parents']), 0""")
def store_audit(spark, sf_dir):
    """The deep audit of a project in which every other embedded file was damaged."""
    project, folder = _project(spark, sf_dir, land=True), local_folder(spark, "resources")
    for r in table(spark, sf_dir, "region").collect():  # 5 rows
        path = folder / f"region.{r.r_regionkey}"
        path.write_text(r.r_name)
        project.embed(path.name, path)
        if r.r_regionkey % 2:
            sha = project.state()["resources"][path.name]["sha256"]
            (project.root / "data" / "chunks" / sha / f"{0:08d}").write_text("damaged")
    return spark.createDataFrame(list(project.audit().items()), "rule string, violations int")


@query("""SELECT CAST(ordinal AS INTEGER) AS ordinal, layer_id, slot_id, source_id, true AS bound FROM (VALUES (0, 'world.labels', 'properties', 'countries'), (1, 'world.borders', 'geometry', 'countries'), (2, 'world.countries', 'geometry', 'countries'),
(2, 'world.countries', 'properties', 'countries'), (3, 'world.coastline', 'geometry', 'land'), (4, 'world.land', 'geometry', 'land')) AS t(ordinal, layer_id, slot_id, source_id)""")
def world_stack(spark, sf_dir):
    """The five layers of a world map, made once and once more to no effect; two sources of one kind are refused."""
    project = _project(spark, sf_dir, land=True, countries=True)
    assert project.initialise_world("land", "land").status == "invalid_request" and project.initialise_world("countries", "land").status == "contract_mismatch"
    assert project.initialise_world("land", "countries").changed and not project.initialise_world("land", "countries").changed
    return project.layers().select("ordinal", "layer_id", "slot_id", "source_id", "bound")


# Texts and values --------------------------------------------------------------------------------------------


@query("""SELECT k, count(*) AS n, count(*) FILTER (k IN (0, 3)) AS uris, count(*) FILTER (k = 1) AS uuids, count(*) FILTER (k = 2) AS hashes, count(*) FILTER (c_custkey % 8 >= 4) AS bit_four, CAST(sum(length(c_name)) AS BIGINT) AS trimmed FROM (SELECT *, c_custkey % 6 AS k FROM customer) GROUP BY 1""")
def text_forms(spark, sf_dir):
    """Retrieval URIs, identifiers, digests, capability bits and ASCII blanks."""
    t, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 6
    forms = F.when(k == 0, F.concat(F.lit("https://example.org/"), "c_custkey")).when(k == 1, F.uuid()).when(k == 2, F.sha2("c_name", 256)).when(k == 3, F.lit("s3+x://bucket/key")).when(k == 4, F.lit("file:///etc/x")).otherwise(F.lit("c:drive"))
    t = t.select("c_custkey", k.alias("k"), forms.alias("s"), text.trim_ascii(F.concat(F.lit(" \t\n"), "c_name", F.lit("\r\x0b "))).alias("name"))
    return t.groupBy("k").agg(
        F.count("*").alias("n"), F.count_if(text.is_retrieval_uri(F.col("s"))).alias("uris"), F.count_if(text.is_uuid(F.col("s"))).alias("uuids"), F.count_if(text.is_sha256(F.col("s"))).alias("hashes"),
        F.count_if(text.has_capability(F.col("c_custkey"), 4)).alias("bit_four"), F.sum(F.length("name")).alias("trimmed"),
    )


@query("""SELECT c_custkey, array_to_string(list_reverse(list_transform(range(0, 8), lambda i: substr(printf('%016x', c_custkey), i * 2 + 1, 2))), '') AS int64, lower(hex(encode(c_mktsegment))) AS text, CASE WHEN c_custkey % 2 = 0 THEN '01' ELSE '00' END AS bool, c_acctbal AS double_back, true AS refused FROM customer""")
def property_payloads(spark, sf_dir):
    """Typed values as bytes and back; payloads of another length or kind are refused."""

    def refused(kind: str, payload: bytes) -> bool:
        try:
            text.decode_property(kind, payload)
        except ValueError:
            return True
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                back = text.decode_property("double", text.encode_property("double", value))
                wrong = refused("bool", b"\x02") and refused("int64", b"\0" * 7) and refused("double", struct.pack("<d", float("inf"))) and refused("other", b"") and refused("text", b"\xff")
                rows.append((key, text.encode_property("int64", key).hex(), text.encode_property("text", name).hex(), text.encode_property("bool", key % 2 == 0).hex(), back, wrong))
            columns = zip(*rows, strict=True) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_()), strict=True)], ["c_custkey", "int64", "text", "bool", "double_back", "refused"])

    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").mapInArrow(run, "c_custkey long, int64 string, text string, bool string, double_back double, refused boolean")


@query(f"""SELECT n_nationkey, {r_sql('((10e0 - CAST(n_nationkey * 40 AS DOUBLE) * 25e-2 + 18e1) - 36e1 * floor((10e0 - CAST(n_nationkey * 40 AS DOUBLE) * 25e-2 + 18e1) / 36e1)) - 18e1', 9)} AS lon, {r_sql('greatest(-895e-1, least(895e-1, CAST(n_nationkey * 17 AS DOUBLE) * 25e-2))', 9)} AS lat,
{r_sql('greatest(55e-2, least(8e0, pow(112e-2, CAST(n_nationkey - 12 AS DOUBLE))))', 9)} AS zoom FROM nation""")
def camera_drags(spark, sf_dir):
    """Cameras after a drag and turns of the wheel: longitudes wrap, latitudes and zooms stop."""
    out = [(r.n_nationkey, *(round(x, 9) + 0.0 for x in drag((10.0, 0.0), r.n_nationkey * 40, r.n_nationkey * 17, 1.0)), round(zoomed(1.0, r.n_nationkey - 12), 9)) for r in _nations(spark, sf_dir)]
    return spark.createDataFrame(out, "n_nationkey int, lon double, lat double, zoom double")


@query("""SELECT CASE k WHEN 0 THEN 'Globe' WHEN 1 THEN 'Sinusoidal' WHEN 2 THEN 'Mollweide' ELSE 'Unknown' END AS mode, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Political' ELSE 'Physical' END AS content, count(*) AS views FROM (SELECT *, c_custkey % 4 AS k FROM customer) GROUP BY 1, 2""")
def view_names(spark, sf_dir):
    k = F.col("c_custkey") % 4
    mode = F.when(k == 0, "globe").when(k == 1, "sinusoidal").when(k == 2, "mollweide")
    t = table(spark, sf_dir, "customer").select(text.mode_name(mode).alias("mode"), text.content_name(F.when(F.col("c_mktsegment") == "BUILDING", "political").otherwise("other")).alias("content"))
    return t.groupBy("mode", "content").agg(F.count("*").alias("views"))

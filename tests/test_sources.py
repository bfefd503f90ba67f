import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from meridion.sources import adapters, shapefile, snapshots
from meridion.sources.adapters import COUNTRY_FIELDS, CountryAdapter, LandAdapter, Registry, SourceError, violations
from meridion.sources.store import Project

WKT = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]'
SQUARE = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
HOLE = [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5), (0.5, 0.5)]


def shp(records, code=9994, kind=5, extra=b""):
    body = b""
    for k, parts in enumerate(records):
        points = [p for part in parts for p in part]
        starts, n = [], 0
        for part in parts:
            starts.append(n)
            n += len(part)
        content = struct.pack("<i4dii", 5, 0, 0, 0, 0, len(parts), n) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">ii", k + 1, len(content) // 2) + content
    size = (100 + len(body) + len(extra)) // 2
    return struct.pack(">i20xi", code, size) + struct.pack("<ii8d", 1000, kind, *[0.0] * 8) + body + extra


def dbf(fields, rows, version=3, end=b"\x1a", flag=b" "):
    head = b"".join(name.encode().ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([width, 0]) + b"\0" * 14 for name, kind, width in fields)
    width = 1 + sum(w for _, _, w in fields)
    data = b"".join(flag + b"".join(v.encode().ljust(w) for v, (_, _, w) in zip(r, fields, strict=True)) for r in rows)
    return struct.pack("<B3xIHH20x", version, len(rows), 33 + len(head), width) + head + b"\r" + data + end


def test_shapefile(spark, tmp_path):
    (tmp_path / "a.shp").write_bytes(shp([[SQUARE, HOLE]]))
    (tmp_path / "b.shp").write_bytes(shp([[SQUARE]])[:-8])
    rows = {r.path.rsplit("/", 1)[1]: r for r in shapefile.read_polygon_shapefiles(spark, str(tmp_path / "*.shp")).collect()}
    assert [(r.role, r.side, len(r.points)) for r in rows["a.shp"].rings] == [("exterior", "right", 4), ("interior", "left", 4)]
    assert rows["b.shp"].error == "length_mismatch"
    shapefile.register(spark)
    assert spark.read.format("polygon_shapefile").load(str(tmp_path / "a.shp")).count() == 1


def step(value, n):
    import numpy as np

    for _ in range(n):
        value = float(np.nextafter(value, np.inf))
    return value


@pytest.mark.parametrize(
    ("data", "reason"),
    [(shp([[SQUARE]], code=9993), "invalid_header"), (shp([[SQUARE]], kind=3), "unsupported_shape_type"), (b"x", "truncated"), (shp([[SQUARE[:4]]]), "ring_not_closed"), (shp([[SQUARE[:3]]]), "truncated"),
     (shp([[[(170, 0), (170, 2), (step(180.0, 16), 2), (step(180.0, 16), 0), (170, 0)]]]), "invalid_coordinate")],
)
def test_shapefile_errors(data, reason):
    with pytest.raises(shapefile.FormatError, match=reason if reason != "truncated" else ""):
        list(shapefile.parse_polygons(data))


def test_roundoff_is_snapped():
    east = step(180.0, 5)
    ((_, rings, n),) = shapefile.parse_polygons(shp([[[(170, 0), (170, 2), (east, 2), (east, 0), (170, 0)]]]))
    assert n == 2 and len(rings) == 1


def test_dbf(spark, tmp_path):
    fields, rows = [("NAME", "C", 6), ("N", "N", 4)], [("ab", "1"), ("cd", "22"), ("ef", "3")]
    path = tmp_path / "t.dbf"
    path.write_bytes(dbf(fields, rows))
    header, got = shapefile.read_dbf(path)
    assert header.records == 3 and got[1] == (2, False, b"cd    ", b"22  ")
    shapefile.register(spark)
    t = spark.read.format("dbase").option("rows", 2).load(str(path))
    assert [(r.record_number, bytes(r.NAME).strip()) for r in t.orderBy("record_number").collect()] == [(1, b"ab"), (2, b"cd"), (3, b"ef")]
    path.write_bytes(dbf(fields, rows, end=b""))
    assert len(shapefile.read_dbf(path)[1]) == 3
    for data, reason in (
        (dbf(fields, rows, version=4), "unsupported_version"), (dbf([("A", "C", 2), ("A", "C", 2)], []), "duplicate_field"), (dbf(fields, rows, flag=b"?"), "invalid_deletion_flag"),
        (dbf(fields, rows, end=b"\x1axx"), "trailing_data"), (dbf([("A", "Q", 2)], []), "invalid_field"), (dbf(fields, rows)[:-20], "truncated"),
    ):
        path.write_bytes(data)
        with pytest.raises(shapefile.FormatError, match=reason):
            shapefile.read_dbf(path)


def files(tmp_path, contents):
    out = []
    for name, (path, data) in contents.items():
        (tmp_path / path).write_bytes(data)
        out.append(snapshots.Resource(name, path, hashlib.sha256(data).hexdigest(), len(data)))
    return tuple(out)


def manifest(resources, dataset="ne_110m_land", **more):
    return snapshots.Manifest(dataset, "v1", "Natural Earth", "public domain", resources, "5.1.2", retrieved_utc="2024-01-01T00:00:00Z", retrieval_uri="https://example.org/x", **more)


def land(tmp_path):
    own = {"geometry.shp": ("l.shp", shp([[SQUARE, HOLE], [[(x + 10, y) for x, y in SQUARE]]])), "crs.prj": ("l.prj", WKT.encode()), "dataset.version": ("v.txt", b"5.1.2\n")}
    return snapshots.verify(tmp_path, manifest(files(tmp_path, own)))[0]


def countries(tmp_path, ids=("11", "12")):
    fields = [(n, k, 12) for n, k in COUNTRY_FIELDS.items()]
    rows = [[f"{n[:4]}{k}" if kind == "C" else ids[k] for n, kind in COUNTRY_FIELDS.items()] for k in range(2)]
    own = {
        "geometry.shp": ("c.shp", shp([[SQUARE], [[(x + 10, y) for x, y in SQUARE]]])), "crs.prj": ("c.prj", WKT.encode()), "dataset.version": ("w.txt", b"5.1.2"), "encoding.cpg": ("c.cpg", b"UTF-8"),
        "attributes.dbf": ("c.dbf", dbf(fields, rows)),
    }
    return snapshots.verify(tmp_path, manifest(files(tmp_path, own), "ne_110m_admin_0_countries", worldview="de facto"))[0]


def test_snapshot_verification(spark, tmp_path):
    good = files(tmp_path, {"a": ("a.txt", b"alpha"), "b": ("b.txt", b"beta")})
    found, error, _ = snapshots.verify(tmp_path, manifest(good))
    assert error == "none" and found.path("a").name == "a.txt" and found.path("z") is None
    entries = [(r.logical_name, r.relative_path, r.sha256, r.size_bytes) for r in good]
    assert found.content_sha256 == snapshots.content_identity(entries[::-1])
    df = spark.createDataFrame([("k", *e) for e in entries], "key string, logical_name string, relative_path string, sha256 string, size_bytes long")
    assert snapshots.content_identities(df, "key").first().content_sha256 == found.content_sha256
    (tmp_path / "link").symlink_to("/etc/hostname")
    a = good[0]
    for resources, word in (
        ((a, a), "duplicate_resource"), ((snapshots.Resource("x", "../x", a.sha256),), "unsafe_path"), ((snapshots.Resource("x", "none", a.sha256),), "missing_resource"), ((snapshots.Resource("x", "link", a.sha256),), "unsafe_path"),
        ((snapshots.Resource("x", "a.txt", a.sha256, 9),), "size_mismatch"), ((snapshots.Resource("x", "a.txt", "0" * 64),), "hash_mismatch"), ((snapshots.Resource("x", "a.txt", "0"),), "invalid_manifest"), ((), "invalid_manifest"),
    ):
        assert snapshots.verify(tmp_path, manifest(resources))[1] == word
    assert snapshots.verify(tmp_path / "nowhere", manifest(good))[1] == "root_missing"
    pins = tmp_path / "pins.tsv"
    pins.write_text("# c\n" + "".join(f"{r.logical_name}\t{r.relative_path}\t{r.sha256}\t{r.size_bytes}\n" for r in good))
    assert snapshots.read_pins(pins) == good and snapshots.pins_frame(spark, str(pins)).count() == 2


def test_adapters_and_registry(spark, tmp_path):
    registry, own = Registry(), LandAdapter()
    assert [registry.add(x) for x in (own, own, None)] == ["none", "duplicate_adapter", "null_adapter"]
    assert registry.add(CountryAdapter()) == "none"
    snap = land(tmp_path)
    data = adapters.load_pinned(spark, registry, own.descriptor.adapter_id, snap, snap.content_sha256, 2)
    assert data.properties is None and data.features.where("role = 'interior'").count() == 1
    assert data.features.select("stable_id").distinct().count() == 2
    for args, word in ((("nothing", snap), "adapter_not_found"), ((own.descriptor.adapter_id, snap, adapters.ADMIN0), "capability_missing"), ((own.descriptor.adapter_id, snap, 0, "0" * 64), "content_mismatch")):
        with pytest.raises(SourceError, match=word):
            registry.load(spark, *args)
    second = registry.load(spark, CountryAdapter().descriptor.adapter_id, countries(tmp_path))
    assert second.properties.count() == 28 and second.properties.where("key = 'ne_id'").agg(F.sum("i")).first()[0] == 23
    with pytest.raises(SourceError, match="identity_not_unique"):
        registry.load(spark, CountryAdapter().descriptor.adapter_id, countries(tmp_path, ("11", "11")))
    with pytest.raises(SourceError, match="malformed_attribute"):
        registry.load(spark, CountryAdapter().descriptor.adapter_id, countries(tmp_path, ("11", "-3")))
    broken = adapters.Dataset(second.provenance, second.features.withColumn("stable_id", F.lit("")), second.properties)
    assert violations(broken).first().bad_stable_id == 2 and violations(broken).first().orphan_properties == 2


def test_store(spark, tmp_path):
    registry = Registry()
    registry.add(LandAdapter())
    registry.add(CountryAdapter())
    root = tmp_path / "project"
    project, made = Project.create(spark, root)
    assert made.committed and Project.create(spark, root)[1].status == "already_exists" and Project.open(spark, tmp_path / "no")[1].status == "not_a_project"
    snap, csnap = land(tmp_path), countries(tmp_path)
    one, two = (registry.load(spark, a().descriptor.adapter_id, s) for a, s in ((LandAdapter, snap), (CountryAdapter, csnap)))
    assert project.store_snapshot(one, "land", LandAdapter(), csnap).status == "provenance_mismatch"
    first = project.store_snapshot(one, "land", LandAdapter(), snap)
    again = project.store_snapshot(one, "land", LandAdapter(), snap)
    assert first.changed and not again.changed and again.ok and project.revision() == first.revision == 2
    bare = adapters.Dataset(two.provenance, two.features)
    assert project.store_snapshot(bare, "countries", CountryAdapter(), csnap).changed and project.properties("countries") is None
    assert project.initialise_world("land", "countries").status == "contract_mismatch"
    assert project.store_snapshot(two, "countries", CountryAdapter(), csnap).changed
    assert not project.store_snapshot(bare, "countries", CountryAdapter(), csnap).changed and project.properties("countries").count() == 28
    assert project.store_snapshot(one, "countries", LandAdapter(), snap).status == "record_exists"
    assert {r.property_count for r in project.property_index("countries").collect()} == {14} and project.geometry_index("land").count() == 2
    back = project.load_dataset("countries")
    assert back.provenance == two.provenance and back.features.exceptAll(two.features).count() == 0 and back.properties.exceptAll(two.properties).count() == 0
    assert project.initialise_world("land", "countries").changed and not project.initialise_world("land", "countries").changed
    ids = [x["layer_id"] for x in project.state()["layers"]]
    assert project.order_layers(ids[1:]).status == "not_a_permutation" and project.order_layers(ids[::-1]).changed
    assert project.layers().where("not bound").count() == 0 and project.remove_layer("world.land").changed and project.remove_layer("world.land").status == "record_not_found"
    data = tmp_path / "big.bin"
    data.write_bytes(b"ab" * (1 << 20))
    assert project.embed("font", data).changed and not project.embed("font", data).changed and b"".join(project.stream("font")) == data.read_bytes()
    assert project.chunk_table("font").where("ok").count() == 2
    assert project.store_external("tile", "https://example.org/t", "0" * 64, 5).changed and project.freeze().changed
    layer = {"layer_id": "extra", "role_id": "r", "name": "Extra", "resources": [{"slot_id": "s", "resource_id": "tile"}]}
    assert project.append_layer(layer).changed and not project.state()["frozen"] and project.freeze().status == "required_resource_external"
    assert project.set_style("base", {"w": ("meridion.style.value.f64le.v1", b"\0" * 8)}).changed
    assert project.set_style("bad", {"w": ("meridion.style.value.rgba8.v1", b"\0")}).status == "invalid_value"
    assert project.set_style("child", {}, "base").changed and project.set_style("base", {}, "child").status == "style_cycle"
    assert project.bind_style("extra", "s", "child").changed and project.remove_style("child").status == "style_in_use" and project.remove_style("none").ok
    assert project.set_projection("sinusoidal", 3 * 3.141592653589793).changed and abs(project.projection()[1] - 3.141592653589793) < 1e-12
    assert project.set_projection("sinusoidal", 0.0, "other").status == "unsupported_cut"
    project.write_session({"zoom": 2})
    assert project.read_session() == {"zoom": 2} and not any(project.audit().values())
    stale = project.state()
    stale["revision"] += 1
    assert project._publish(stale) and not project._publish(stale)  # of two equal writers one is first


def test_latest_generation_stream(spark, tmp_path):
    from meridion.streaming.generations import accepted, latest_requests, start_latest

    rows = [("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "w")]
    df = spark.createDataFrame(rows, "session string, generation int, request string")
    df.write.parquet(str(tmp_path / "in"))
    latest = latest_requests(df)
    assert {(r.session, r.generation, r.request) for r in latest.collect()} == {("a", 3, "z"), ("b", 1, "w")}
    assert {tuple(r) for r in accepted(df, latest).collect()} == {("a", 3, "z"), ("b", 1, "w")}
    q = start_latest(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "latest", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert {(r.session, r.generation) for r in spark.sql("SELECT * FROM latest").collect()} == {("a", 3), ("b", 1)}

"""Source adapters: from verified snapshots to validated tables of features.

A dataset is features (stable_id, source_id, ring_index, role, side, points, closing_lon, winding), optional
properties (stable_id, key, type_id, b, i, d, s), one provenance, and whether the properties are complete.
Absent properties and verified-empty ones are different things.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.functions.text import bounded_text, dbf_positive, dbf_text

from .shapefile import register
from .snapshots import Manifest, Snapshot

LAND, ADMIN0, ADMIN1, DISPUTED, RELIEF, HYDROGRAPHY, IMAGERY = (1 << k for k in range(7))
TEMPORAL = ("timeless_or_structural", "slow_change", "periodic", "fast_change")
PROPERTY = "stable_id string, key string, type_id string, b boolean, i long, d double, s string"
MAX_PROPERTIES, MAX_TEXT = 4096, 1 << 20

# The fields that the country table must have, with their types.
COUNTRY_FIELDS = {
    "NAME": "C", "NAME_LONG": "C", "ADMIN": "C", "SOVEREIGNT": "C", "TYPE": "C", "ADM0_A3": "C", "SOV_A3": "C", "ISO_A2": "C", "ISO_A3": "C", "UN_A3": "C", "CONTINENT": "C",
    "REGION_UN": "C", "SUBREGION": "C", "NE_ID": "N",
}


class SourceError(ValueError):
    """A source that breaks its contract; the argument is an error word, then the detail."""


@dataclass(frozen=True)
class Descriptor:
    adapter_id: str
    provider: str
    dataset: str
    capability_bits: int
    temporal_class: str = "timeless_or_structural"


@dataclass(frozen=True)
class Provenance:
    provider: str
    dataset: str
    snapshot: str
    license: str
    retrieved_utc: str
    retrieval_uri: str
    content_sha256: str
    dataset_version: str = ""
    worldview: str = ""

    def complete(self) -> bool:
        """Version and worldview may be empty."""
        return all((self.provider, self.dataset, self.snapshot, self.license, self.retrieved_utc, self.retrieval_uri, self.content_sha256))


@dataclass(frozen=True)
class Dataset:
    provenance: Provenance
    features: DataFrame
    properties: DataFrame | None = None

    @property
    def properties_complete(self) -> bool:
        return self.properties is not None


class Adapter(ABC):
    """The extension point: a descriptor and a way from a snapshot to a dataset."""

    descriptor: Descriptor

    @abstractmethod
    def load(self, spark: SparkSession, snapshot: Snapshot) -> Dataset: ...


def provenance_of(snapshot: Snapshot) -> Provenance:
    m: Manifest = snapshot.manifest
    return Provenance(m.provider, m.dataset, m.snapshot, m.license, m.retrieved_utc, m.retrieval_uri, snapshot.content_sha256, m.version, m.worldview)


def _require(ok: bool, word: str, detail: str = "") -> None:
    if not ok:
        raise SourceError(word, detail)


def _text(snapshot: Snapshot, name: str) -> str:
    path = snapshot.path(name)
    _require(path is not None, "missing_resource", name)
    return path.read_text(encoding="utf-8").strip()


def _shapes(spark: SparkSession, snapshot: Snapshot) -> DataFrame:
    wkt = _text(snapshot, "crs.prj")
    _require(("GEOGCS" in wkt or "GEOGCRS" in wkt) and ("WGS_1984" in wkt or "WGS 84" in wkt), "unsupported_crs")
    version = _text(snapshot, "dataset.version")
    _require(not snapshot.manifest.version or version == snapshot.manifest.version, "version_mismatch", version)
    _require(snapshot.path("geometry.shp") is not None, "missing_resource", "geometry.shp")
    register(spark)
    return spark.read.format("polygon_shapefile").load(str(snapshot.path("geometry.shp")))


def _features(shapes: DataFrame, stable_id) -> DataFrame:
    out = shapes.select(stable_id.alias("stable_id"), F.concat(F.lit("record:"), "record_number").alias("source_id"), F.posexplode("rings").alias("ring_index", "r"))
    return out.select("stable_id", "source_id", "ring_index", "r.role", "r.side", "r.points", "r.closing_lon", "r.winding")


class LandAdapter(Adapter):
    """Land polygons: one feature a record, without properties."""

    def __init__(self, dataset: str = "ne_110m_land", provider: str = "Natural Earth"):
        self.descriptor = Descriptor(f"{dataset}.land.v1", provider, dataset, LAND)

    def load(self, spark: SparkSession, snapshot: Snapshot) -> Dataset:
        _require(snapshot.manifest.dataset == self.descriptor.dataset, "identity_mismatch", snapshot.manifest.dataset)
        shapes = _shapes(spark, snapshot)
        prefix = f"{snapshot.manifest.dataset}:{snapshot.manifest.snapshot}:record:"
        return Dataset(provenance_of(snapshot), _features(shapes, F.concat(F.lit(prefix), "record_number")))


class CountryAdapter(Adapter):
    """Countries: shapes joined one to one with their attribute rows by record number, with typed properties."""

    def __init__(self, dataset: str = "ne_110m_admin_0_countries", provider: str = "Natural Earth"):
        self.descriptor = Descriptor(f"{dataset}.admin0.v1", provider, dataset, ADMIN0, "slow_change")

    def load(self, spark: SparkSession, snapshot: Snapshot) -> Dataset:
        _require(snapshot.manifest.dataset == self.descriptor.dataset, "identity_mismatch", snapshot.manifest.dataset)
        _require(bool(snapshot.manifest.worldview), "worldview_missing")
        _require(_text(snapshot, "encoding.cpg") == "UTF-8", "unsupported_encoding")
        _require(snapshot.path("attributes.dbf") is not None, "missing_resource", "attributes.dbf")
        shapes = _shapes(spark, snapshot)
        rows = spark.read.format("dbase").load(str(snapshot.path("attributes.dbf")))
        missing = [f for f in COUNTRY_FIELDS if f not in rows.columns]
        _require(not missing, "missing_field", ",".join(missing))
        texts = [dbf_text(F.col(f)).alias(f.lower()) for f, kind in COUNTRY_FIELDS.items() if kind == "C"]
        rows = rows.select(F.col("record_number").alias("row_number"), "deleted", *texts, dbf_positive(F.col("NE_ID")).alias("ne_id"))
        both = shapes.join(rows, shapes.record_number == rows.row_number, "full_outer").persist()
        broken = [f.lower() for f in COUNTRY_FIELDS]
        check = both.agg(
            F.count("*").alias("n"), F.count_if(F.col("record_number").isNull() | F.col("row_number").isNull()).alias("unmatched"), F.count_if("deleted").alias("deleted"),
            F.count_if(F.greatest(*[F.col(f).isNull() for f in broken])).alias("malformed"), F.countDistinct("adm0_a3").alias("codes"), F.countDistinct("ne_id").alias("ids"),
            F.count_if(F.col("adm0_a3") == "").alias("empty_codes"),
        ).first()
        _require(not (check.unmatched or check.deleted), "record_alignment", f"{check.unmatched} unmatched, {check.deleted} deleted")
        _require(not check.malformed, "malformed_attribute", str(check.malformed))
        _require(check.codes == check.n and check.ids == check.n and not check.empty_codes, "identity_not_unique")
        stable = F.concat(F.lit(f"{snapshot.manifest.dataset}:ne_id:"), "ne_id")
        entries = [F.struct(F.lit(f.lower()).alias("key"), F.lit("text").alias("type_id"), F.lit(None).cast("long").alias("i"), F.col(f.lower()).alias("s")) for f, kind in COUNTRY_FIELDS.items() if kind == "C"]
        entries.append(F.struct(F.lit("ne_id").alias("key"), F.lit("int64").alias("type_id"), F.col("ne_id").alias("i"), F.lit(None).cast("string").alias("s")))
        properties = both.select(stable.alias("stable_id"), F.explode(F.array(*entries)).alias("p")).select(
            "stable_id", "p.key", "p.type_id", F.lit(None).cast("boolean").alias("b"), "p.i", F.lit(None).cast("double").alias("d"), "p.s"
        )
        return Dataset(provenance_of(snapshot), _features(both, stable), properties)


def violations(dataset: Dataset) -> DataFrame:
    """One row of counts, all zero for a valid dataset."""
    f = dataset.features
    counts = f.agg(
        F.count_if(~bounded_text(F.col("stable_id"))).alias("bad_stable_id"), F.count_if(~bounded_text(F.col("source_id"))).alias("bad_source_id"),
        F.count_if(F.size("points") < 3).alias("short_rings"), F.count_if(~F.col("role").isin("exterior", "interior")).alias("bad_role"), (F.count("*") == 0).cast("long").alias("empty"),
    )
    order = f.groupBy("stable_id").agg(((F.min("ring_index") == 0) & (F.max("ring_index") == F.count("*") - 1) & (F.countDistinct("ring_index") == F.count("*"))).alias("ok"))
    counts = counts.crossJoin(order.agg(F.count_if(~F.col("ok")).alias("bad_ring_order")))
    if dataset.properties is not None:
        p = dataset.properties
        value = F.when(F.col("type_id") == "bool", F.col("b").isNotNull()).when(F.col("type_id") == "int64", F.col("i").isNotNull()).when(F.col("type_id") == "double", F.col("d").isNotNull() & ~F.isnan("d") & (F.abs("d") < float("inf")))
        value = value.when(F.col("type_id") == "text", F.col("s").isNotNull() & (F.octet_length("s") <= MAX_TEXT) & F.is_valid_utf8("s")).otherwise(False)
        own = p.agg(F.count_if(~bounded_text(F.col("key"))).alias("bad_key"), F.count_if(~F.coalesce(value, F.lit(False))).alias("bad_value"))
        keys = p.groupBy("stable_id").agg(F.count("*").alias("n"), F.countDistinct("key").alias("k"))
        counts = counts.crossJoin(own).crossJoin(keys.agg(F.count_if(F.col("n") != F.col("k")).alias("duplicate_key"), F.count_if(F.col("n") > MAX_PROPERTIES).alias("too_many_properties")))
        orphans = p.select("stable_id").distinct().join(f.select("stable_id").distinct(), "stable_id", "left_anti")
        counts = counts.crossJoin(orphans.agg(F.count("*").alias("orphan_properties")))
    return counts


class Registry:
    """Adapters by id; loading checks capability, pinned identity, provenance and the dataset itself."""

    def __init__(self) -> None:
        self.adapters: dict[str, Adapter] = {}

    def add(self, adapter: Adapter | None) -> str:
        if adapter is None:
            return "null_adapter"
        d = adapter.descriptor
        if not (d.adapter_id and d.provider and d.dataset and d.capability_bits and d.temporal_class in TEMPORAL):
            return "incomplete_descriptor"
        if d.adapter_id in self.adapters:
            return "duplicate_adapter"
        self.adapters[d.adapter_id] = adapter
        return "none"

    def find(self, adapter_id: str) -> Adapter | None:
        return self.adapters.get(adapter_id)

    def load(self, spark: SparkSession, adapter_id: str, snapshot: Snapshot, capability: int = 0, pinned_sha256: str = "") -> Dataset:
        adapter = self.find(adapter_id)
        _require(adapter is not None, "adapter_not_found", adapter_id)
        d = adapter.descriptor
        _require(not capability or bool(d.capability_bits & capability), "capability_missing")
        _require(not pinned_sha256 or snapshot.content_sha256 == pinned_sha256, "content_mismatch", snapshot.content_sha256)
        dataset = adapter.load(spark, snapshot)
        p = dataset.provenance
        _require(p.provider == d.provider and p == replace(provenance_of(snapshot), worldview=p.worldview) and p.complete(), "provenance_mismatch")
        counts = violations(dataset).first().asDict()
        broken = {k: v for k, v in counts.items() if v}
        _require(not broken, "invalid_result", str(broken))
        return dataset


def load_pinned(spark: SparkSession, registry: Registry, adapter_id: str, snapshot: Snapshot, pinned_sha256: str, features: int) -> Dataset:
    """A dataset whose identity and number of features are pinned."""
    dataset = registry.load(spark, adapter_id, snapshot, pinned_sha256=pinned_sha256)
    n = dataset.features.select("stable_id").distinct().count()
    _require(n == features, "cardinality_mismatch", str(n))
    return dataset

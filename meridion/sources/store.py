"""A durable project: immutable Parquet tables and a chain of commit files that nothing overwrites.

Each commit is one JSON file named by its revision. A writer makes the next file by linking a finished
temporary file to its name, which fails if another writer was first; it then tries again on the new state.
Readers trust only commit files, so a lost executor or writer leaves no half of a change. Calls give an
Outcome: a status word, whether anything changed, whether the change is durable.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.functions.text import decode_property, file_sha256, valid_text, valid_utc
from meridion.operators.ordered import count_violations

from .adapters import ADMIN0, LAND, Dataset, Provenance, violations
from .snapshots import Snapshot

FORMAT = (1, 0)
GEOMETRY_MODEL, PROPERTY_MODEL = "meridion.geometry.wgs84-linear-ring.v1", "meridion.properties.v1"
CHUNK = 1 << 20
MAX_FEATURES, MAX_RINGS, MAX_VERTICES = 1_000_000, 65_535, 4_194_304
MAX_LAYERS, MAX_BINDINGS, MAX_STYLES, MAX_STYLE_PROPERTIES, MAX_STYLE_BYTES = 65_535, 256, 65_535, 1024, 1 << 20
ROLES = {f"meridion.layer.{k}.v1" for k in ("physical.land-fill", "physical.coastline", "political.country-fill", "political.boundary", "label.country")}
STYLE_TYPES = {"bool": "bool", "i64le": "int64", "f64le": "double", "utf8": "text"}
CUTS = {"sinusoidal": "single-antimeridian", "mollweide": "single-antimeridian"}


@dataclass(frozen=True)
class Outcome:
    status: str = "none"
    changed: bool = False
    committed: bool = False
    revision: int = 0
    detail: str = ""

    @property
    def ok(self) -> bool:
        return self.status == "none"


class Refused(Exception):
    """A mutation that may not happen: an error word and a detail."""


def _refuse(bad: bool, word: str, detail: str = "") -> None:
    if bad:
        raise Refused(word, detail)


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def digest(df: DataFrame) -> str:
    """A digest of a table as a multiset of rows: a count and sums of two hashes, by partial aggregation."""
    columns = sorted(df.columns)
    text = F.to_json(F.struct(*columns))
    sha = F.sha2(text, 256)
    parts = [F.sum(F.conv(F.substring(sha, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    row = df.agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256(json.dumps([columns, *map(str, row)]).encode()).hexdigest()


class Project:
    """One project under a root that the driver and executors share."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root)

    # Commits

    @classmethod
    def create(cls, spark: SparkSession, root: str | Path, producer: str = "meridion", worldview: str = "") -> tuple[Project | None, Outcome]:
        """A new project; an existing one is never touched."""
        base = Path(root)
        (base / "commits").mkdir(parents=True, exist_ok=True)
        state = {
            "format": FORMAT, "uuid": str(uuid.uuid4()), "revision": 1, "created": _now(), "modified": _now(), "producer": producer, "worldview": worldview, "frozen": False,
            "projection": None, "sources": {}, "resources": {}, "styles": {}, "layers": [],
        }
        project = cls(spark, base)
        return (project, Outcome(changed=True, committed=True, revision=1)) if project._publish(state) else (None, Outcome("already_exists"))

    @classmethod
    def open(cls, spark: SparkSession, root: str | Path) -> tuple[Project | None, Outcome]:
        project = cls(spark, root)
        try:
            state = project.state()
        except (OSError, ValueError, IndexError):
            return None, Outcome("not_a_project")
        if state.get("format") != list(FORMAT):
            return None, Outcome("unsupported_format", detail=str(state.get("format")))
        if state["frozen"] and any(r["required"] and r["mode"] != "embedded" for r in state["resources"].values()):
            return None, Outcome("frozen_claim_broken")
        return project, Outcome(revision=state["revision"])

    def revision(self) -> int:
        return max(int(p.stem) for p in (self.root / "commits").glob("*.json"))

    def state(self) -> dict:
        path = max((self.root / "commits").glob("*.json"), default=None)
        if path is None:
            raise IndexError("no commit")
        body = json.loads(path.read_text())
        if hashlib.sha256(body["state"].encode()).hexdigest() != body["sha256"]:
            raise ValueError("damaged commit")
        return json.loads(body["state"])

    def _publish(self, state: dict) -> bool:
        text = json.dumps(state, sort_keys=True)
        folder = self.root / "commits"
        with tempfile.NamedTemporaryFile("w", dir=folder, suffix=".tmp", delete=False) as f:
            f.write(json.dumps({"state": text, "sha256": hashlib.sha256(text.encode()).hexdigest()}))
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(f.name, folder / f"{state['revision']:012d}.json")
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(f.name)

    def mutate(self, change: Callable[[dict], bool], modified: str = "") -> Outcome:
        """Applies a change to the newest state and publishes it as the next revision; a change that says False changes nothing."""
        if modified and not valid_utc(modified):
            return Outcome("invalid_timestamp")
        while True:
            state = self.state()
            before = state["revision"]
            try:
                changed = change(state)
            except Refused as e:
                return Outcome(e.args[0], revision=before, detail=e.args[1])
            if not changed:
                return Outcome(revision=before)
            state["revision"], state["modified"] = before + 1, modified or _now()
            if self._publish(state):
                return Outcome(changed=True, committed=True, revision=before + 1)

    def set_worldview(self, worldview: str) -> Outcome:
        def change(state: dict) -> bool:
            if state["worldview"] == worldview:
                return False
            state["worldview"] = worldview
            return True

        return self.mutate(change)

    # Datasets

    def _write(self, df: DataFrame, kind: str, content: str) -> str:
        path = self.root / "data" / kind / content
        if not (path / "_SUCCESS").exists():
            staging = self.root / "data" / kind / f".{content}-{uuid.uuid4().hex}"
            df.write.parquet(str(staging))
            try:
                os.rename(staging, path)
            except OSError:  # another writer of the same content was first
                pass
        return str(path.relative_to(self.root))

    def store_dataset(self, dataset: Dataset, source_id: str, adapter_id: str, capability_bits: int, temporal_class: str, resources: list[dict] | None = None, modified: str = "") -> Outcome:
        """Provenance, geometry and optional properties in one revision.

        The same content again changes nothing; other content under the id is refused; properties may be
        added later to the same geometry, and a retry without them never takes them away.
        """
        if not (valid_text(source_id) and valid_text(adapter_id) and dataset.provenance.complete()):
            return Outcome("invalid_argument")
        counts = {k: v for k, v in violations(dataset).first().asDict().items() if v}
        sizes = dataset.features.groupBy("stable_id").agg(F.count("*").alias("rings"), F.max(F.size("points")).alias("vertices")).agg(F.count("*").alias("n"), F.max("rings").alias("r"), F.max("vertices").alias("v")).first()
        if counts or sizes.n > MAX_FEATURES or (sizes.r or 0) > MAX_RINGS or (sizes.v or 0) > MAX_VERTICES:
            return Outcome("invalid_dataset", detail=str(counts or sizes))
        zero = F.lit(0.0)
        geometry = dataset.features.withColumn("points", F.transform("points", lambda p: F.struct((p["lon"] + zero).alias("lon"), (p["lat"] + zero).alias("lat")))).withColumn("closing_lon", F.col("closing_lon") + zero)
        record = {
            "adapter_id": adapter_id, "capability_bits": capability_bits, "temporal_class": temporal_class, "provenance": dataset.provenance.__dict__, "resources": resources or [],
            "geometry": {"model": GEOMETRY_MODEL, "feature_count": sizes.n, "content": digest(geometry)}, "properties": None,
        }
        record["geometry"]["path"] = self._write(geometry, "geometry", record["geometry"]["content"])
        if dataset.properties is not None:
            content = digest(dataset.properties)
            record["properties"] = {"model": PROPERTY_MODEL, "content": content, "path": self._write(dataset.properties, "properties", content)}

        def change(state: dict) -> bool:
            old = state["sources"].get(source_id)
            if old is None:
                state["sources"][source_id] = record
                return True
            same = {k: v for k, v in old.items() if k != "properties"} == {k: v for k, v in record.items() if k != "properties"}
            _refuse(not same, "record_exists", source_id)
            if record["properties"] is None or old["properties"] == record["properties"]:
                return False
            _refuse(old["properties"] is not None, "record_exists", source_id)
            old["properties"] = record["properties"]
            return True

        return self.mutate(change, modified)

    def store_snapshot(self, dataset: Dataset, source_id: str, adapter, snapshot: Snapshot) -> Outcome:
        """The bridge from a verified snapshot: its provenance must be the dataset's."""
        if dataset.provenance.content_sha256 != snapshot.content_sha256:
            return Outcome("provenance_mismatch")
        resources = [{"logical_name": r.logical_name, "sha256": r.sha256, "size_bytes": snapshot.sizes[r.logical_name]} for r in snapshot.manifest.resources]
        d = adapter.descriptor
        return self.store_dataset(dataset, source_id, d.adapter_id, d.capability_bits, d.temporal_class, sorted(resources, key=lambda r: r["logical_name"]))

    def provenance(self) -> DataFrame:
        rows = [(k, v["adapter_id"], v["capability_bits"], v["temporal_class"], *[v["provenance"][f] for f in Provenance.__dataclass_fields__]) for k, v in sorted(self.state()["sources"].items())]
        texts = ", ".join(f"{f} string" for f in Provenance.__dataclass_fields__)
        return self.spark.createDataFrame(rows, f"source_id string, adapter_id string, capability_bits int, temporal_class string, {texts}")

    def _source(self, source_id: str) -> dict:
        return self.state()["sources"][source_id]

    def geometry(self, source_id: str) -> DataFrame:
        return self.spark.read.parquet(str(self.root / self._source(source_id)["geometry"]["path"]))

    def geometry_index(self, source_id: str) -> DataFrame:
        """Ids and counts; no coordinates are read."""
        return self.geometry(source_id).groupBy("stable_id", "source_id").agg(F.count("*").alias("ring_count"))

    def properties(self, source_id: str) -> DataFrame | None:
        """None if absent, which is not the same as a table without rows."""
        own = self._source(source_id)["properties"]
        return None if own is None else self.spark.read.parquet(str(self.root / own["path"]))

    def property_index(self, source_id: str) -> DataFrame | None:
        """Features with their numbers of properties, none included."""
        own = self.properties(source_id)
        if own is None:
            return None
        return self.geometry(source_id).select("stable_id").distinct().join(own, "stable_id", "left").groupBy("stable_id").agg(F.count("key").alias("property_count"))

    def load_dataset(self, source_id: str) -> Dataset:
        """A dataset as it was stored, rings and properties in order, without adapters or snapshots."""
        own = self._source(source_id)
        return Dataset(Provenance(**own["provenance"]), self.geometry(source_id), self.properties(source_id))

    # Resources

    def store_external(self, resource_id: str, uri: str, sha256: str, size: int, required: bool = False) -> Outcome:
        def change(state: dict) -> bool:
            own = {"mode": "external", "uri": uri, "sha256": sha256, "size": size, "required": required}
            _refuse(not valid_text(resource_id) or uri.lower().startswith("file:") or ":" not in uri[2:], "invalid_argument", resource_id)
            return self._put_resource(state, resource_id, own)

        return self.mutate(change)

    @staticmethod
    def _put_resource(state: dict, resource_id: str, own: dict) -> bool:
        old = state["resources"].get(resource_id)
        _refuse(old is not None and {k: old[k] for k in ("mode", "sha256", "size")} != {k: own[k] for k in ("mode", "sha256", "size")}, "record_exists", resource_id)
        own["required"] = own["required"] or bool(old and old["required"])  # a promise is never taken back
        if old == own:
            return False
        state["resources"][resource_id] = own
        if own["required"] and own["mode"] == "external":
            state["frozen"] = False
        return True

    def embed(self, resource_id: str, file: str | Path, required: bool = False) -> Outcome:
        """The file in chunks of 1 MiB, each with its own hash, and a hash of the whole."""
        sha, size = file_sha256(file), Path(file).stat().st_size
        folder = self.root / "data" / "chunks" / sha
        folder.mkdir(parents=True, exist_ok=True)
        hashes = []
        with open(file, "rb") as f:
            while part := f.read(CHUNK):
                hashes.append(hashlib.sha256(part).hexdigest())
                target = folder / f"{len(hashes) - 1:08d}"
                if not target.exists():
                    staging = folder / f".{uuid.uuid4().hex}"
                    staging.write_bytes(part)
                    os.rename(staging, target)

        def change(state: dict) -> bool:
            _refuse(not valid_text(resource_id), "invalid_argument", resource_id)
            return self._put_resource(state, resource_id, {"mode": "embedded", "uri": "", "sha256": sha, "size": size, "chunks": hashes, "required": required})

        return self.mutate(change)

    def chunk_table(self, resource_id: str) -> DataFrame:
        """(chunk_index, content, size, ok) of an embedded resource, hashed by Spark."""
        own = self.state()["resources"][resource_id]
        files = self.spark.read.format("binaryFile").load(str(self.root / "data" / "chunks" / own["sha256"]))
        table = files.select(F.element_at(F.split("path", "/"), -1).cast("int").alias("chunk_index"), "content", F.col("length").alias("size"))
        expected = self.spark.createDataFrame(list(enumerate(own["chunks"])), "chunk_index int, sha256 string")
        return expected.join(table, "chunk_index", "left").select("chunk_index", "content", "size", F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False)).alias("ok"))

    def stream(self, resource_id: str) -> Iterator[bytes]:
        """Chunks in order, each checked, the whole checked at the end."""
        own = self.state()["resources"][resource_id]
        whole = hashlib.sha256()
        for k, sha in enumerate(own["chunks"]):
            part = (self.root / "data" / "chunks" / own["sha256"] / f"{k:08d}").read_bytes()
            if hashlib.sha256(part).hexdigest() != sha:
                raise ValueError("chunk_mismatch")
            whole.update(part)
            yield part
        if whole.hexdigest() != own["sha256"]:
            raise ValueError("resource_mismatch")

    def resources(self) -> list[tuple[str, dict]]:
        return sorted(self.state()["resources"].items())

    def freeze(self) -> Outcome:
        """Allowed once all required resources are embedded and whole."""

        def change(state: dict) -> bool:
            for name, own in state["resources"].items():
                if own["required"]:
                    _refuse(own["mode"] != "embedded", "required_resource_external", name)
                    try:
                        for _ in self.stream(name):
                            pass
                    except (OSError, ValueError) as e:
                        raise Refused("resource_damaged", f"{name}: {e}") from e
            done = state["frozen"]
            state["frozen"] = True
            return not done

        return self.mutate(change)

    @staticmethod
    def _require_bound(state: dict, slots: list[dict]) -> None:
        for slot in slots:
            own = state["resources"].get(slot["resource_id"])
            _refuse(own is None, "resource_not_found", slot["resource_id"])
            own["required"] = True
            if own["mode"] == "external":
                state["frozen"] = False

    # Layers

    @staticmethod
    def _layer(layer: dict) -> dict:
        own = {"layer_id": layer["layer_id"], "role_id": layer["role_id"], "name": layer["name"], "visible": bool(layer.get("visible", True))}
        for kind in ("sources", "resources", "styles"):
            own[kind] = sorted(layer.get(kind, []), key=lambda s: s["slot_id"].encode())
            slots = [s["slot_id"] for s in own[kind]]
            _refuse(len(set(slots)) != len(slots) or len(slots) > MAX_BINDINGS, "invalid_binding", own["layer_id"])
        _refuse(not (valid_text(own["layer_id"]) and valid_text(own["role_id"]) and valid_text(own["name"])), "invalid_argument", own["layer_id"])
        return own

    def _check_layer(self, state: dict, own: dict) -> None:
        for s in own["sources"]:
            _refuse(s["source_id"] not in state["sources"], "source_not_found", s["source_id"])
        for s in own["styles"]:
            _refuse(s["style_id"] not in state["styles"], "style_not_found", s["style_id"])
        self._require_bound(state, own["resources"])

    def append_layer(self, layer: dict) -> Outcome:
        def change(state: dict) -> bool:
            own = self._layer(layer)
            old = next((x for x in state["layers"] if x["layer_id"] == own["layer_id"]), None)
            if old is not None:
                _refuse(old != own, "record_exists", own["layer_id"])
                return False
            _refuse(len(state["layers"]) >= MAX_LAYERS, "limit_exceeded")
            self._check_layer(state, own)
            state["layers"].append(own)
            return True

        return self.mutate(change)

    def initialise_layers(self, layers: list[dict]) -> Outcome:
        """A whole stack, into an empty project or as an exact retry."""

        def change(state: dict) -> bool:
            own = [self._layer(x) for x in layers]
            _refuse(len({x["layer_id"] for x in own}) != len(own), "duplicate_layer")
            if state["layers"]:
                _refuse(state["layers"] != own, "stack_exists")
                return False
            for x in own:
                self._check_layer(state, x)
            state["layers"] = own
            return bool(own)

        return self.mutate(change)

    def update_layer(self, layer: dict) -> Outcome:
        def change(state: dict) -> bool:
            own = self._layer(layer)
            at = next((k for k, x in enumerate(state["layers"]) if x["layer_id"] == own["layer_id"]), None)
            _refuse(at is None, "record_not_found", own["layer_id"])
            if state["layers"][at] == own:
                return False
            self._check_layer(state, own)
            state["layers"][at] = own
            return True

        return self.mutate(change)

    def remove_layer(self, layer_id: str) -> Outcome:
        """Ordinals close up; resources stay."""

        def change(state: dict) -> bool:
            _refuse(all(x["layer_id"] != layer_id for x in state["layers"]), "record_not_found", layer_id)
            state["layers"] = [x for x in state["layers"] if x["layer_id"] != layer_id]
            return True

        return self.mutate(change)

    def order_layers(self, ids: list[str]) -> Outcome:
        """An exact permutation of the layers, or nothing."""

        def change(state: dict) -> bool:
            by = {x["layer_id"]: x for x in state["layers"]}
            _refuse(sorted(ids) != sorted(by), "not_a_permutation")
            new = [by[k] for k in ids]
            changed = new != state["layers"]
            state["layers"] = new
            return changed

        return self.mutate(change)

    def resource_bindings(self) -> DataFrame:
        """(layer_id, slot_id, resource_id, mode, required): each binding of a layer, left joined with its resource."""
        state = self.state()
        bindings = [(x["layer_id"], s["slot_id"], s["resource_id"]) for x in state["layers"] for s in x["resources"]]
        resources = [(k, r["mode"], r["required"]) for k, r in state["resources"].items()]
        own = self.spark.createDataFrame(bindings, "layer_id string, slot_id string, resource_id string")
        return own.join(self.spark.createDataFrame(resources, "resource_id string, mode string, required boolean"), "resource_id", "left").select("layer_id", "slot_id", "resource_id", "mode", "required")

    def layers(self) -> DataFrame:
        """(ordinal, layer_id, role_id, name, visible, slot_id, source_id, bound): bindings with whether their source exists."""
        state = self.state()
        rows = [(k, x["layer_id"], x["role_id"], x["name"], x["visible"], s["slot_id"], s["source_id"], s["source_id"] in state["sources"]) for k, x in enumerate(state["layers"]) for s in x["sources"] or [{"slot_id": None, "source_id": None}]]
        return self.spark.createDataFrame(rows, "ordinal int, layer_id string, role_id string, name string, visible boolean, slot_id string, source_id string, bound boolean")

    def initialise_world(self, physical: str, political: str) -> Outcome:
        """The five layers of a world map, from a land source and a country source that fit their roles."""
        state = self.state()
        one, two = state["sources"].get(physical), state["sources"].get(political)
        if not physical or not political or physical == political:
            return Outcome("invalid_request")
        if one is None or two is None or not one["capability_bits"] & LAND or not two["capability_bits"] & ADMIN0 or not two["provenance"]["worldview"] or two["properties"] is None:
            return Outcome("contract_mismatch")
        keys = self.geometry(political).select("stable_id").distinct(), self.properties(political).select("stable_id").distinct()
        if keys[0].exceptAll(keys[1]).limit(1).count() or keys[1].exceptAll(keys[0]).limit(1).count():
            return Outcome("contract_mismatch", detail="keys")

        def layer(name: str, role: str, title: str, *slots: tuple[str, str]) -> dict:
            return {"layer_id": f"world.{name}", "role_id": f"meridion.layer.{role}.v1", "name": title, "sources": [{"slot_id": a, "source_id": b} for a, b in slots]}

        return self.initialise_layers([
            layer("labels", "label.country", "Country labels", ("properties", political)),
            layer("borders", "political.boundary", "Borders", ("geometry", political)),
            layer("countries", "political.country-fill", "Countries", ("geometry", political), ("properties", political)),
            layer("coastline", "physical.coastline", "Coastline", ("geometry", physical)),
            layer("land", "physical.land-fill", "Land", ("geometry", physical)),
        ])

    # Styles

    @staticmethod
    def _style_value(type_id: str, payload: bytes) -> bool:
        name = type_id.removeprefix("meridion.style.value.").removesuffix(".v1")
        if name == "rgba8":
            return len(payload) == 4
        if name in STYLE_TYPES:
            try:
                decode_property(STYLE_TYPES[name], payload)
            except (ValueError, UnicodeError):
                return False
        return len(payload) <= MAX_STYLE_BYTES  # other types are kept as they are

    def set_style(self, style_id: str, properties: dict[str, tuple[str, bytes]], parent: str | None = None, resources: list[dict] | None = None) -> Outcome:
        """Replaces a style as a whole. Parents must exist and not lead back."""

        def change(state: dict) -> bool:
            own = {"parent": parent, "properties": {k: [t, v.hex()] for k, (t, v) in sorted(properties.items())}, "resources": sorted(resources or [], key=lambda s: s["slot_id"].encode())}
            _refuse(not valid_text(style_id) or len(properties) > MAX_STYLE_PROPERTIES or any(not valid_text(k) or not valid_text(t) for k, (t, _) in properties.items()), "invalid_argument", style_id)
            _refuse(any(not self._style_value(t, v) for t, v in properties.values()), "invalid_value", style_id)
            at, seen = parent, {style_id}
            while at is not None:
                _refuse(at in seen, "style_cycle", at)
                _refuse(at not in state["styles"], "parent_not_found", at)
                seen.add(at)
                at = state["styles"][at]["parent"]
            if state["styles"].get(style_id) == own:
                return False
            _refuse(style_id not in state["styles"] and len(state["styles"]) >= MAX_STYLES, "limit_exceeded")
            self._require_bound(state, own["resources"])
            state["styles"][style_id] = own
            return True

        return self.mutate(change)

    def remove_style(self, style_id: str) -> Outcome:
        """A missing style is gone already; one that a child or a layer uses stays."""

        def change(state: dict) -> bool:
            if style_id not in state["styles"]:
                return False
            used = any(s["parent"] == style_id for s in state["styles"].values()) or any(b["style_id"] == style_id for x in state["layers"] for b in x["styles"])
            _refuse(used, "style_in_use", style_id)
            del state["styles"][style_id]
            return True

        return self.mutate(change)

    def bind_style(self, layer_id: str, slot_id: str, style_id: str) -> Outcome:
        def change(state: dict) -> bool:
            layer = next((x for x in state["layers"] if x["layer_id"] == layer_id), None)
            _refuse(layer is None, "record_not_found", layer_id)
            _refuse(style_id not in state["styles"], "style_not_found", style_id)
            others = [s for s in layer["styles"] if s["slot_id"] != slot_id]
            new = sorted([*others, {"slot_id": slot_id, "style_id": style_id}], key=lambda s: s["slot_id"].encode())
            changed = new != layer["styles"]
            layer["styles"] = new
            return changed

        return self.mutate(change)

    def styles(self) -> list[tuple[str, dict]]:
        return sorted(self.state()["styles"].items())

    # Projection and session

    def set_projection(self, model: str, central_meridian: float, cut: str = "single-antimeridian") -> Outcome:
        def change(state: dict) -> bool:
            _refuse(model not in CUTS or CUTS[model] != cut, "unsupported_cut", f"{model} {cut}")
            _refuse(not abs(central_meridian) < float("inf"), "invalid_argument")
            turn = 6.283185307179586
            lon = central_meridian % turn
            lon = lon - turn if lon > turn / 2 else lon
            own = {"model": model, "central_meridian": (lon + 0.0).hex(), "cut": cut}
            if state["projection"] == own:
                return False
            state["projection"] = own
            return True

        return self.mutate(change)

    def projection(self) -> tuple[str, float, str] | None:
        own = self.state()["projection"]
        return None if own is None else (own["model"], float.fromhex(own["central_meridian"]), own["cut"])

    def write_session(self, view: dict) -> None:
        """The view beside the project, bound to its uuid; the last writer wins."""
        path = self.root / "session.json"
        with tempfile.NamedTemporaryFile("w", dir=self.root, delete=False) as f:
            json.dump({"project": self.state()["uuid"], "view": view}, f)
        os.replace(f.name, path)

    def read_session(self) -> dict | None:
        """None if there is none, or if it belongs to another project."""
        try:
            own = json.loads((self.root / "session.json").read_text())
        except (OSError, ValueError):
            return None
        return own["view"] if own.get("project") == self.state()["uuid"] else None

    # Audits

    def audit(self) -> dict[str, int]:
        """Violations by rule; all zero if the project is whole. Every stored table is read and hashed again."""
        state, out = self.state(), {}
        for source_id, own in state["sources"].items():
            geometry = self.geometry(source_id)
            out[f"{source_id}.geometry_content"] = int(digest(geometry) != own["geometry"]["content"])
            out[f"{source_id}.geometry_model"] = int(own["geometry"]["model"] != GEOMETRY_MODEL)
            out[f"{source_id}.feature_count"] = int(geometry.select("stable_id").distinct().count() != own["geometry"]["feature_count"])
            rows = count_violations(geometry, rings=F.size("points") >= 3, latitude=~F.exists("points", lambda p: F.abs(p["lat"]) > 1.5707963267948966), side=(F.col("winding") == 0) | (F.col("side") != "unspecified"))
            out |= {f"{source_id}.{k}": v for k, v in rows.first().asDict().items()}
            if own["properties"]:
                out[f"{source_id}.property_content"] = int(digest(self.properties(source_id)) != own["properties"]["content"])
        for name, own in state["resources"].items():
            if own["mode"] == "embedded":
                out[f"{name}.chunks"] = self.chunk_table(name).where("not ok").count()
        out["layer_sources"] = sum(s["source_id"] not in state["sources"] for x in state["layers"] for s in x["sources"])
        out["layer_styles"] = sum(s["style_id"] not in state["styles"] for x in state["layers"] for s in x["styles"])
        out["style_parents"] = sum(s["parent"] is not None and s["parent"] not in state["styles"] for s in state["styles"].values())
        return out

"""Local snapshots: manifests, verification, and content identities."""

from __future__ import annotations

import csv
import hashlib
import struct
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.functions.text import file_sha256, valid_text

DOMAIN = "meridion-snapshot-content-v1"


@dataclass(frozen=True)
class Resource:
    logical_name: str
    relative_path: str
    sha256: str
    size_bytes: int | None = None


@dataclass(frozen=True)
class Manifest:
    """What a snapshot must hold. ``domain`` is the tag that content identities start with."""

    dataset: str
    snapshot: str
    provider: str
    license: str
    resources: tuple[Resource, ...]
    version: str = ""
    worldview: str = ""
    retrieved_utc: str = ""
    retrieval_uri: str = ""
    domain: str = DOMAIN


@dataclass(frozen=True)
class Snapshot:
    """Verified files of a manifest; only ``verify`` makes one."""

    manifest: Manifest
    paths: dict[str, Path] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    content_sha256: str = ""

    def path(self, logical_name: str) -> Path | None:
        return self.paths.get(logical_name)


def _hex64(s: str) -> bool:
    return len(s) == 64 and all(c in "0123456789abcdef" for c in s)


def safe_relative(path: str) -> bool:
    pure = PurePosixPath(path)
    return valid_text(path, 4096) and not pure.is_absolute() and "\\" not in path and ":" not in path and all(p not in ("", ".", "..") for p in path.split("/"))


def content_identity(resources: list[tuple[str, str, str, int]], domain: str = DOMAIN) -> str:
    """The digest of (logical name, path, sha256, size) in the order of names; lengths go before texts, so nothing runs together."""
    digest = hashlib.sha256(domain.encode() + struct.pack(">Q", len(resources)))
    for name, path, sha, size in sorted(resources):
        for text in (name, path, sha):
            data = text.encode()
            digest.update(struct.pack(">Q", len(data)) + data)
        digest.update(struct.pack(">Q", size))
    return digest.hexdigest()


def content_identities(df: DataFrame, key: str, domain: str = DOMAIN) -> DataFrame:
    """The same digest for each key of a table of (key, logical_name, relative_path, sha256, size_bytes), without leaving the JVM."""

    def u64(c):
        return F.unhex(F.lpad(F.hex(c), 16, "0"))

    def text(name):
        data = F.encode(F.col(name), "UTF-8")
        return F.concat(u64(F.octet_length(data).cast("long")), data)

    entry = F.concat(text("logical_name"), text("relative_path"), text("sha256"), u64(F.col("size_bytes").cast("long")))
    rows = df.select(key, F.struct(F.encode("logical_name", "UTF-8").alias("name"), entry.alias("entry")).alias("e")).groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("es"))
    joined = F.aggregate("es", F.concat(F.encode(F.lit(domain), "UTF-8"), u64(F.size("es").cast("long"))), lambda s, e: F.concat(s, e["entry"]))
    return rows.select(key, F.sha2(joined, 256).alias("content_sha256"))


def verify(root: str | Path, manifest: Manifest) -> tuple[Snapshot | None, str, str]:
    """The verified snapshot, or an error word and what it is about. Files are hashed in bounded pieces."""
    base = Path(root)
    if not base.is_dir():
        return None, "root_missing", str(root)
    base = base.resolve()
    if not (manifest.dataset and manifest.snapshot and manifest.provider and manifest.resources):
        return None, "invalid_manifest", "identity"
    names, places = set(), set()
    paths, sizes, entries = {}, {}, []
    for r in manifest.resources:
        if not (valid_text(r.logical_name) and _hex64(r.sha256) and (r.size_bytes is None or r.size_bytes >= 0)):
            return None, "invalid_manifest", r.logical_name
        if not safe_relative(r.relative_path):
            return None, "unsafe_path", r.relative_path
        if r.logical_name in names or r.relative_path in places:
            return None, "duplicate_resource", r.logical_name
        names.add(r.logical_name)
        places.add(r.relative_path)
        path = base / r.relative_path
        if not path.exists():
            return None, "missing_resource", r.relative_path
        real = path.resolve()
        if not real.is_relative_to(base):
            return None, "unsafe_path", r.relative_path
        if not real.is_file():
            return None, "not_a_file", r.relative_path
        size = real.stat().st_size
        if r.size_bytes is not None and size != r.size_bytes:
            return None, "size_mismatch", r.relative_path
        if file_sha256(real) != r.sha256:
            return None, "hash_mismatch", r.relative_path
        paths[r.logical_name], sizes[r.logical_name] = real, size
        entries.append((r.logical_name, r.relative_path, r.sha256, size))
    return Snapshot(manifest, paths, sizes, content_identity(entries, manifest.domain)), "none", ""


def read_pins(path: str | Path) -> tuple[Resource, ...]:
    """Resources of a tab-separated pin file; lines with # are comments."""
    out = []
    with open(path, encoding="utf-8", newline="") as f:
        for row in csv.reader((x for x in f if x.strip() and not x.startswith("#")), delimiter="\t", quoting=csv.QUOTE_NONE):
            if len(row) not in (3, 4):
                raise ValueError("malformed_pin")
            out.append(Resource(row[0], row[1], row[2], int(row[3]) if len(row) == 4 and row[3] else None))
    return tuple(out)


def pins_frame(spark: SparkSession, path: str) -> DataFrame:
    schema = "logical_name string, relative_path string, sha256 string, size_bytes long"
    return spark.read.csv(path, sep="\t", comment="#", schema=schema, quote="")

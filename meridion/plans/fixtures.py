"""Files in the formats that the sources read, made from rows: what the queries of the sources need."""

from __future__ import annotations

import struct
from pathlib import Path

from pyspark.sql import SparkSession

from .session import shared_dir

WKT = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]'
Part = list[tuple[float, float]]


def local_folder(spark: SparkSession, name: str) -> Path:
    """A new folder below the shared one, which the store and the snapshots use as a POSIX path."""
    import uuid

    path = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:")) / f"{name}-{uuid.uuid4().hex}"
    path.mkdir(parents=True)
    return path


def box(x: float, y: float, h: float, clockwise: bool = True) -> Part:
    ring = [(x - h, y - h), (x - h, y + h), (x + h, y + h), (x + h, y - h), (x - h, y - h)]
    return ring if clockwise else ring[::-1]


def polygon_file(records: list[list[Part] | None], code: int = 9994, kind: int = 5, first: int = 1, extra: bytes = b"") -> bytes:
    """A polygon shapefile; None is a null shape."""
    body = b""
    for k, parts in enumerate(records):
        content = struct.pack("<i", 0)
        if parts is not None:
            points = [p for part in parts for p in part]
            starts = [sum(len(p) for p in parts[:i]) for i in range(len(parts))]
            content = struct.pack("<i4dii", 5, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">ii", k + first, len(content) // 2) + content
    return struct.pack(">i20xi", code, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, kind, *[0.0] * 8) + body + extra


def dbase_file(fields: list[tuple[str, str, int]], rows: list[list[bytes]], deleted: list[bool] | None = None, version: int = 3, terminator: bytes = b"\r", end: bytes = b"\x1a") -> bytes:
    head = b"".join(name.encode().ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([width, 0]) + b"\0" * 14 for name, kind, width in fields)
    flags = deleted or [False] * len(rows)
    data = b"".join((b"*" if gone else b" ") + b"".join(v.ljust(w) for v, (_, _, w) in zip(r, fields, strict=True)) for r, gone in zip(rows, flags, strict=True))
    return struct.pack("<B3xIHH20x", version, len(rows), 33 + len(head), 1 + sum(w for _, _, w in fields)) + head + terminator + data + end

"""Polygon shapefiles and dBASE III tables, read strictly.

Both are parsed from whole files inside Arrow batches, from any store Spark can list (binaryFile), or as
Python data sources named ``polygon_shapefile`` and ``dbase`` (the latter by ranges of rows).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from meridion.functions.constants import RADIANS
from meridion.operators.kernels.rings import canonicalise

FILE_CODE, VERSION, POLYGON, NULL_SHAPE = 9994, 1000, 5, 0
ROUNDOFF_STEPS = 8
MAX_RECORDS, MAX_FIELDS = 1_000_000, 4096
RING = "struct<role: string, side: string, points: array<struct<lon: double, lat: double>>, closing_lon: double, winding: int>"
SHAPES = f"path string, record_number int, rings array<{RING}>, normalised int, error string"


class FormatError(ValueError):
    """A file that breaks its format; the argument is the reason."""


def snap(value: float, limit: float) -> tuple[float, int]:
    """A coordinate within its limits: up to eight floats beyond one are set to it and counted."""
    if abs(value) <= limit:
        return value, 0
    edge = np.copysign(limit, value)
    for _ in range(ROUNDOFF_STEPS):
        edge = np.nextafter(edge, np.inf * np.sign(value))
        if edge == value:
            return float(np.copysign(limit, value)), 1
    raise FormatError("invalid_coordinate")


def parse_polygons(data: bytes) -> Iterator[tuple[int, list[dict], int]]:
    """(record number, rings, coordinates that were snapped) of each record with a shape."""
    if len(data) < 100:
        raise FormatError("truncated")
    code, words = struct.unpack(">i20xi", data[:28])
    version, kind = struct.unpack("<ii", data[28:36])
    if code != FILE_CODE or version != VERSION:
        raise FormatError("invalid_header")
    if words * 2 != len(data):
        raise FormatError("length_mismatch")
    if kind != POLYGON:
        raise FormatError("unsupported_shape_type")
    at, number = 100, 0
    while at < len(data):
        number += 1
        if at + 12 > len(data):
            raise FormatError("truncated")
        own, length = struct.unpack(">ii", data[at : at + 8])
        body = data[at + 8 : at + 8 + 2 * length]
        if own != number:
            raise FormatError("record_number_mismatch")
        if length < 2 or len(body) != 2 * length:
            raise FormatError("truncated")
        at += 8 + 2 * length
        (kind,) = struct.unpack("<i", body[:4])
        if kind == NULL_SHAPE:
            continue
        if kind != POLYGON or len(body) < 44:
            raise FormatError("unsupported_shape_type" if kind != POLYGON else "truncated")
        parts, points = struct.unpack("<ii", body[36:44])
        if parts < 1 or points < 4 or len(body) != 44 + 4 * parts + 16 * points:
            raise FormatError("invalid_part_table")
        starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
        if starts[0] != 0 or any(b - a < 4 for a, b in zip(starts, starts[1:], strict=False)):
            raise FormatError("invalid_part_table")
        xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
        if not np.isfinite(xy).all():
            raise FormatError("invalid_coordinate")
        rings, snapped = [], 0
        for a, b in zip(starts, starts[1:], strict=False):
            ring = []
            for x, y in xy[a:b].tolist():
                x, n = snap(x, 180.0)
                y, m = snap(y, 90.0)
                snapped += n + m
                ring.append((x, y))
            if ring[0] != ring[-1]:
                raise FormatError("ring_not_closed")
            p = np.array(ring)
            d = p - p[0]
            exterior = float((d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1]).sum()) < 0  # clockwise
            canonical, error = canonicalise(p[:, 0] * RADIANS, p[:, 1] * RADIANS, "right" if exterior else "left")
            if canonical is None:
                raise FormatError(error)
            vertices = [{"lon": x, "lat": y} for x, y in zip(canonical.lon.tolist(), canonical.lat.tolist(), strict=True)]
            rings.append({"role": "exterior" if exterior else "interior", "side": canonical.side, "points": vertices, "closing_lon": canonical.closing_lon, "winding": canonical.winding})
        yield number, rings, snapped


def read_polygon_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """The shapes of all files of a path, on any store that Spark can list."""
    return parse_polygon_files(spark.read.format("binaryFile").load(path).select("path", "content"))


def parse_polygon_files(files: DataFrame) -> DataFrame:
    """(path, record_number, rings, normalised, error) of all shapes of a table of (path, content); a file that breaks its format gives one error row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(files.sparkSession.createDataFrame([], SHAPES).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [{"path": name, "record_number": n, "rings": r, "normalised": k, "error": "none"} for n, r, k in parse_polygons(data)]
                except FormatError as e:
                    rows = [{"path": name, "record_number": None, "rings": None, "normalised": 0, "error": str(e)}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("path", "content").mapInArrow(run, SHAPES)


def open_bytes(path: str):
    """A file for reading, with seek: a local path, or a URI of any file system that Arrow knows."""
    if "://" not in str(path):
        return open(path, "rb")
    from pyarrow.fs import FileSystem

    system, name = FileSystem.from_uri(str(path))
    return system.open_input_file(name)


def size_of(path: str) -> int:
    with open_bytes(path) as f:
        return f.seek(0, 2)


@dataclass(frozen=True)
class DbfField:
    name: str
    kind: str
    width: int
    decimals: int
    offset: int


@dataclass(frozen=True)
class DbfHeader:
    records: int
    start: int
    width: int
    fields: tuple[DbfField, ...]


def parse_dbf_header(data: bytes, size: int | None = None) -> DbfHeader:
    """Fields and layout of a table of ``size`` bytes, of which ``data`` holds the header at least."""
    size = len(data) if size is None else size
    if len(data) < 33:
        raise FormatError("truncated")
    version, records, start, width = struct.unpack("<B3xIHH", data[:12])
    if version != 0x03:
        raise FormatError("unsupported_version")
    if records > MAX_RECORDS:
        raise FormatError("record_limit_exceeded")
    n, left = divmod(start - 33, 32)
    if left or not 1 <= n <= MAX_FIELDS or len(data) < start:
        raise FormatError("invalid_header")
    if data[start - 1] != 0x0D:
        raise FormatError("invalid_terminator")
    fields, offset = [], 1
    for k in range(n):
        raw = data[32 + 32 * k : 64 + 32 * k]
        name, _, padding = raw[:11].partition(b"\0")
        if not name or padding.strip(b"\0") or not all(c == 0x5F or chr(c).isalnum() and c < 128 for c in name):
            raise FormatError("invalid_field_name")
        kind, length, decimals = chr(raw[11]), raw[16], raw[17]
        if kind not in "CNFDL" or length == 0 or (decimals and kind not in "NF") or (kind == "D" and length != 8) or (kind == "L" and length != 1):
            raise FormatError("invalid_field")
        fields.append(DbfField(name.decode(), kind, length, decimals, offset))
        offset += length
    if len({f.name for f in fields}) != n:
        raise FormatError("duplicate_field")
    if offset != width:
        raise FormatError("record_length_mismatch")
    rest = size - start - records * width
    if rest < 0:
        raise FormatError("truncated")
    if rest > 1:
        raise FormatError("trailing_data")
    return DbfHeader(records, start, width, tuple(fields))


def parse_dbf_rows(data: bytes, header: DbfHeader, first: int = 0) -> Iterator[tuple]:
    """(record number, deleted, cells...) of whole rows; cells keep their fixed width."""
    for k in range(len(data) // header.width):
        row = data[k * header.width : (k + 1) * header.width]
        if row[:1] not in (b" ", b"*"):
            raise FormatError("invalid_deletion_flag")
        yield (first + k + 1, row[:1] == b"*", *(row[f.offset : f.offset + f.width] for f in header.fields))


def read_dbf(path: str | Path) -> tuple[DbfHeader, list[tuple]]:
    data = Path(path).read_bytes()
    header = parse_dbf_header(data)
    end = header.start + header.records * header.width
    if len(data) > end and data[end] != 0x1A:
        raise FormatError("trailing_data")
    return header, list(parse_dbf_rows(data[header.start : end], header))


class _Range(InputPartition):
    def __init__(self, first: int, n: int):
        self.first, self.n = first, n


class _DbfReader(DataSourceReader):
    def __init__(self, path: str, header: DbfHeader, rows: int):
        self.path, self.header, self.rows = path, header, rows

    def partitions(self) -> list[InputPartition]:
        return [_Range(k, min(self.rows, self.header.records - k)) for k in range(0, self.header.records, self.rows)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open_bytes(self.path) as f:
            f.seek(self.header.start + partition.first * self.header.width)
            yield from parse_dbf_rows(f.read(partition.n * self.header.width), self.header, partition.first)


class DbfSource(DataSource):
    """``spark.read.format("dbase").load(path)``: cells as binary columns, by ranges of ``rows`` records."""

    @classmethod
    def name(cls) -> str:
        return "dbase"

    def _header(self) -> DbfHeader:
        path = self.options["path"]
        with open_bytes(path) as f:
            return parse_dbf_header(f.read(32 * (MAX_FIELDS + 1) + 1), size_of(path))

    def schema(self) -> str:
        return ", ".join(["record_number int", "deleted boolean", *(f"`{f.name}` binary" for f in self._header().fields)])

    def reader(self, schema) -> DataSourceReader:
        return _DbfReader(self.options["path"], self._header(), int(self.options.get("rows", 100_000)))


class _ShapeReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition) -> Iterator[tuple]:
        with open_bytes(self.path) as f:
            data = f.read()
        for number, rings, snapped in parse_polygons(data):
            yield number, [(r["role"], r["side"], [(p["lon"], p["lat"]) for p in r["points"]], r["closing_lon"], r["winding"]) for r in rings], snapped


class ShapefileSource(DataSource):
    """``spark.read.format("polygon_shapefile").load(path)``: records of one file, which is read in one task as its records have no index."""

    @classmethod
    def name(cls) -> str:
        return "polygon_shapefile"

    def schema(self) -> str:
        return f"record_number int, rings array<{RING}>, normalised int"

    def reader(self, schema) -> DataSourceReader:
        return _ShapeReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DbfSource)
    spark.dataSource.register(ShapefileSource)

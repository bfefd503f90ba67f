"""Text, bytes, hashes and identifiers as Column expressions, with exact Python twins where code needs them."""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_SPACE = " \t\n\x0b\x0c\r"
SHA256 = "^[0-9a-f]{64}$"
UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
URI = "^[A-Za-z][A-Za-z0-9+.-]+:.+$"
FNV_BASIS = 1469598103934665603  # fixed value: the palette's start, one digit short of the usual one
FNV_PRIME = 1099511628211
PALETTE = 10


def trim_ascii(c: Column) -> Column:
    return F.btrim(c, F.lit(ASCII_SPACE))


def bounded_text(c: Column, most: int = 255) -> Column:
    """Valid UTF-8 without NUL, of 1 to ``most`` bytes."""
    return F.coalesce((F.octet_length(c) > 0) & (F.octet_length(c) <= most) & F.is_valid_utf8(c) & ~F.contains(c, F.lit("\0")), F.lit(False))


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike(SHA256), F.lit(False))


def is_utc_time(c: Column) -> Column:
    """Exactly YYYY-MM-DDTHH:MM:SSZ, and a day that the calendar has."""
    parsed = F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return F.coalesce(c.rlike(UTC), F.lit(False)) & parsed.isNotNull()


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID), F.lit(False))


def is_retrieval_uri(c: Column) -> Column:
    """A scheme of two characters or more that is not file."""
    return F.coalesce(c.rlike(URI) & ~F.lower(c).startswith("file:"), F.lit(False))


def is_wgs84_wkt(c: Column) -> Column:
    return (F.contains(c, F.lit("GEOGCS")) | F.contains(c, F.lit("GEOGCRS"))) & (F.contains(c, F.lit("WGS_1984")) | F.contains(c, F.lit("WGS 84")))


def has_capability(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(bit)) != 0


def dbf_text(cell: Column) -> Column:
    """A character cell: trailing blanks and NULs and leading blanks go; null if a NUL is left or the bytes are no UTF-8."""
    t = F.ltrim(F.rtrim(F.regexp_replace(cell.cast("string"), "[\\x00 ]+$", "")))
    return F.when(F.is_valid_utf8(cell.cast("string")) & ~F.contains(t, F.lit("\0")), t)


def dbf_positive(cell: Column) -> Column:
    """A positive integer cell, null for anything else."""
    t = trim_ascii(cell.cast("string"))
    n = F.when(t.rlike("^-?[0-9]+$"), t.try_cast("long"))
    return F.when(n > 0, n)


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def property_value(properties: Column, key: str, kind: str) -> Column:
    """The value of one key of ARRAY<STRUCT<key, type_id, b, i, d, s>>, null if absent or of another kind."""
    field = {"bool": "b", "int64": "i", "double": "d", "text": "s"}[kind]
    found = F.get(F.filter(properties, lambda p: (p["key"] == key) & (p["type_id"] == kind)), F.lit(0))
    return found[field]


# What views and maps are called.
MODE_NAMES = {"globe": "Globe", "sinusoidal": "Sinusoidal", "mollweide": "Mollweide"}
CONTENT_NAMES = {"political": "Political", "physical": "Physical"}


def mode_name(mode: Column) -> Column:
    """The name of a view's mode."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in MODE_NAMES.items() for x in pair]), mode), F.lit("Unknown"))


def content_name(content: Column) -> Column:
    """The name of a map's content: what is not political is physical."""
    return F.when(content == "political", CONTENT_NAMES["political"]).otherwise(CONTENT_NAMES["physical"])


# Twins for code that holds single values.


def valid_text(value: str | bytes, most: int = 255) -> bool:
    try:
        data = value.encode() if isinstance(value, str) else value
        data.decode()
    except UnicodeError:
        return False
    return 0 < len(data) <= most and b"\0" not in data


def valid_utc(value: str) -> bool:
    try:
        return len(value) == 20 and value[10] == "T" and datetime.strptime(value, "%Y-%m-%dT%H:%M:%SZ") is not None
    except ValueError:
        return False


def new_uuid() -> str:
    return str(uuid.uuid4())


def palette_index(key: str) -> int:
    h = FNV_BASIS
    for byte in key.encode():
        h = ((h ^ byte) * FNV_PRIME) % (1 << 64)
    return h % PALETTE


def file_sha256(path, chunk: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(chunk):
            digest.update(part)
    return digest.hexdigest()


#: Property payloads: kind to (encode, decode).
def encode_property(kind: str, value) -> bytes:
    if kind == "bool":
        return b"\x01" if value else b"\x00"
    if kind == "int64":
        return struct.pack("<q", value)
    if kind == "double":
        if not math.isfinite(value):
            raise ValueError("non_finite_value")
        return struct.pack("<d", value + 0.0)
    if kind == "text":
        return value.encode()
    raise ValueError("unknown_type")


def decode_property(kind: str, payload: bytes):
    if kind == "bool" and payload in (b"\x00", b"\x01"):
        return payload == b"\x01"
    if kind == "int64" and len(payload) == 8:
        return struct.unpack("<q", payload)[0]
    if kind == "double" and len(payload) == 8:
        value = struct.unpack("<d", payload)[0]
        if math.isfinite(value):
            return value
    if kind == "text":
        return payload.decode()
    raise ValueError("invalid_payload")

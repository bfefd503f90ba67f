"""Format-preserving pseudonyms by keyed Feistel permutations.

Numbers and dates that validate (card numbers by Luhn, IBANs by mod 97, social security, phone numbers,
IPv4 and IPv6 addresses, calendar dates), e-mail addresses and secret tokens are replaced by others of
the same format. Each replacement is a keyed permutation of the format's value space, so equal values
get equal pseudonyms in every document and different ones different pseudonyms; the key gives the
values back. Numbers that don't validate are no personal data and stay.

There is no key in the source. Queries take it from the session's setting KEY_SETTING; without the setting
they make a random one for the application, so pseudonyms agree in one run and nobody can reverse them.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import secrets
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType

from .tables import packed, unpacked
from .words import pieces
from .worker import cache

KEY_SETTING = "spark.meridion.pseudonym.key"
ROUNDS = 8
CACHE = 1 << 16
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_HEX = "0123456789abcdef"


_own_keys: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names, else a random one of this application."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else _own_keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def _round(key: bytes, tweak: bytes, k: int, value: int, size: int) -> int:
    data = tweak + b"|%d|%d|%d" % (k, size, value)
    wide = (size.bit_length() + 7) // 8 + 8
    out, n = b"", 0
    while len(out) < wide:
        out += hashlib.blake2b(data + b"|%d" % n, key=key if len(key) <= 64 else hashlib.sha512(key).digest(), digest_size=64).digest()
        n += 1
    return int.from_bytes(out[:wide], "big") % size


def permute(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size): an unbalanced Feistel network on a rectangle, walked until inside the range."""
    if size < 2:
        return value
    a = int(size**0.5) if size < 1 << 50 else 1 << (size.bit_length() // 2)
    a = max(2, a)
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)  # left < a, right < b
        for k in range(ROUNDS) if not back else reversed(range(ROUNDS)):
            sign = -1 if back else 1
            if k % 2 == 0:
                left = (left + sign * _round(key, tweak, k, right, a)) % a
            else:
                right = (right + sign * _round(key, tweak, k, left, b)) % b
        value = left * b + right
        if value < size:
            return value


def luhn_digit(body: str) -> str:
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 - k % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _digits_as(form: str, digits: str) -> str:
    """``form`` with its digits replaced in turn."""
    new = iter(digits)
    return "".join(next(new) if c in DIGITS else c for c in form)


def _only_digits(s: str) -> str:
    return "".join(c for c in s if c in DIGITS)


def _card(s: str, key: bytes, back: bool) -> str | None:
    d = _only_digits(s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    size = 10 ** (len(d) - 1)
    tweak = b"card%d" % len(d)
    new = permute(int(d[:-1]), size, key, tweak, back)
    while len(set((new_d := f"{new:0{len(d) - 1}d}") + luhn_digit(new_d))) == 1:
        new = permute(new, size, key, tweak, back)
    return _digits_as(s, new_d + luhn_digit(new_d))


def _phone(s: str, key: bytes, back: bool) -> str | None:
    """The country code and the length stay. Ten digits after +1 keep whether area code and exchange start with 0 or 1."""
    m = re.match(r"(\+1[ .-]?)(\(?\d[\d ().-]*\d)$", s) or re.match(r"(1[ .-])?(\(?[2-9]\d\d\)?[ .-]?\d{3}[ .-]?\d{4})$", s)
    d = _only_digits(m[2]) if m else ""
    if m and len(d) == 10:
        low, lead = d[0] in "01", d[3] in "01"
        first, size, tweak = (0, 2 * 10**9, b"phone10low") if low else (2 * 10**9, 8 * 10**9, b"phone10")
        new = int(d) - first
        while True:
            new = permute(new, size, key, tweak, back)
            out = f"{new + first:010d}"
            if (out[3] in "01") == lead:
                break
        return (m[1] or "") + _digits_as(m[2], out)
    m = re.match(r"(\+[2-9]\d{0,2})([ .-]?\(?\d[\d ().-]*\d)$", s)
    if not m:
        return None
    d = _only_digits(m[2])
    if not 6 <= len(d) <= 13:
        return None
    new = permute(int(d), 10 ** len(d), key, b"phone" + m[1].encode() + b"%d" % len(d), back)
    return m[1] + _digits_as(m[2], f"{new:0{len(d)}d}")


def _ssn(s: str, key: bytes, back: bool) -> str | None:
    a, b, c = s[:3], s[4:6], s[7:]
    if a in ("000", "666") or a[0] == "9" or b == "00" or c == "0000":
        return None
    areas = [n for n in range(1, 900) if n != 666]
    value = (areas.index(int(a)) * 99 + int(b) - 1) * 9999 + int(c) - 1
    new, last = divmod(permute(value, 898 * 99 * 9999, key, b"ssn", back), 9999)
    return f"{areas[new // 99]:03d}{s[3]}{new % 99 + 1:02d}{s[6]}{last + 1:04d}"


def _ipv4(s: str, key: bytes, back: bool) -> str | None:
    """Loopback, broadcast and unspecified addresses stay."""
    parts = s.split(".")
    if any(len(p) > 3 or int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = int(ipaddress.IPv4Address(s))
    kept = lambda v: v >> 24 in (0, 127) or v == 0xFFFFFFFF
    if kept(value):
        return None
    value = permute(value, 1 << 32, key, b"ipv4", back)
    while kept(value):
        value = permute(value, 1 << 32, key, b"ipv4", back)
    return str(ipaddress.IPv4Address(value))


def _ipv6(s: str, key: bytes, back: bool) -> str | None:
    """Each group keeps its number of digits and zero stays zero, so that every way of writing an address has its own back."""
    try:
        address = ipaddress.IPv6Address(s)
    except ValueError:
        return None
    groups = [int(g, 16) for g in address.exploded.split(":")]
    if int(address) <= 1:
        return None
    least = [1 << 4 * (len(f"{g:x}") - 1) if g else 0 for g in groups]
    shape = b"ipv6" + bytes(len(f"{g:x}") if g else 0 for g in groups)
    value, size = 0, 1
    for g, low in zip(groups, least, strict=True):
        if g:
            value, size = value * 15 * low + g - low, size * 15 * low
    while True:
        value, rest, new = permute(value, size, key, shape, back), 0, [0] * 8
        rest = value
        for k in range(7, -1, -1):
            if groups[k]:
                rest, own = divmod(rest, 15 * least[k])
                new[k] = own + least[k]
        if any(new[:7]) or new[7] > 1:
            break
    upper = s.upper() == s and s.lower() != s
    head, gap, tail = s.partition("::")
    written = [x for x in head.split(":") if x], [x for x in tail.split(":") if x]
    places = [range(len(written[0])), range(8 - len(written[1]), 8)]
    texts = [":".join(f"{new[k]:x}".zfill(len(w)) for k, w in zip(p, own, strict=True)) for p, own in zip(places, written, strict=True)]
    out = texts[0] + gap + texts[1]
    return out.upper() if upper else out


def _iban(s: str, key: bytes, back: bool) -> str | None:
    plain = s.replace(" ", "").upper()
    as_number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(plain) <= 34 or as_number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _classes(plain[4:], key, b"iban" + plain[:2].encode(), back)
    new = plain[:2] + f"{98 - as_number(body + plain[:2] + '00') % 97:02d}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in s)


def _classes(s: str, key: bytes, tweak: bytes, back: bool) -> str:
    """Digits, lower and upper case letters are permuted together, each within its class; the rest stays."""
    value, size, shape = 0, 1, []
    for c in s:
        for alphabet in (DIGITS, LOWER, UPPER):
            if c in alphabet:
                value, size = value * len(alphabet) + alphabet.index(c), size * len(alphabet)
                shape.append(alphabet)
                break
        else:
            shape.append(c)
    form = "".join(x if len(x) == 1 else x[0] for x in shape)
    value = permute(value, size, key, tweak + form.encode(), back)
    out = []
    for x in reversed(shape):
        if len(x) == 1:
            out.append(x)
        else:
            value, d = divmod(value, len(x))
            out.append(x[d])
    return "".join(reversed(out))


def _email(s: str, key: bytes, back: bool) -> str | None:
    local, _, domain = s.rpartition("@")
    host, _, top = domain.rpartition(".")
    return f"{_classes(local, key, b'local', back)}@{_classes(host, key, b'host', back)}.{top}"


def _secret(s: str, key: bytes, back: bool) -> str | None:
    """Hexadecimal runs keep their length and case."""
    value = permute(int(s, 16), 16 ** len(s), key, b"hex%d" % len(s), back)
    out = f"{value:0{len(s)}x}"
    return out.upper() if s.upper() == s and s.lower() != s else out


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(s: str, key: bytes, back: bool) -> str | None:
    """Dates from 1900 to 2099 are permuted among those of equally long months and days, in whatever order they are written.

    Year first; else month first with slashes and day first with other marks. Where that is no date but the
    other order is, the other order holds; days past the twelfth are permuted among themselves.
    """
    m = re.match(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$", s)
    if m:
        orders, sep, parts = ["ymd"], m[2], (m[1], m[3], m[4])
    else:
        m = re.match(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})$", s)
        if not m:
            return None
        orders, sep, parts = (["mdy", "dmy"] if m[2] == "/" else ["dmy", "mdy"]), m[2], (m[1], m[3], m[4])
    for order in orders:
        named = dict(zip(order, map(int, parts), strict=True))
        try:
            then = datetime.date(named["y"], named["m"], named["d"])
        except ValueError:
            continue
        day = then.toordinal()
        if not _FIRST <= day <= _LAST:
            return None
        kind = lambda x: (x.month > 9, (x.day > 9) + (x.day > 12))
        new, own = day - _FIRST, kind(then)
        while True:
            new = permute(new, _LAST - _FIRST + 1, key, b"date", back)
            then = datetime.date.fromordinal(_FIRST + new)
            if kind(then) == own:
                break
        values = {"y": then.year, "m": then.month, "d": then.day}
        return sep.join(str(values[o]).zfill(len(p)) for o, p in zip(order, parts, strict=True))
    return None


_LOCAL = frozenset(LOWER + UPPER + DIGITS + "._%+-")
_LOCAL_MOST = 64  # characters that may stand before an @
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}")


def _emails(text: str) -> Iterator[tuple[int, str]]:
    """Start and text of e-mail addresses, looked for around each @."""
    at = text.find("@")
    while at >= 0:
        first = at
        while first and at - first <= _LOCAL_MOST and text[first - 1] in _LOCAL:
            first -= 1
        while first < at and text[first] in "._%+-":
            first += 1
        domain = _DOMAIN.match(text, at + 1)
        if domain and 0 < at - first <= _LOCAL_MOST and text[at - 1] != ".":
            yield first, text[first : domain.end()]
        at = text.find("@", at + 1)


# Kind, pattern, replacement. A span belongs to the first kind that validates there.
KINDS: list[tuple[str, str, Callable[[str, bytes, bool], str | None]]] = [
    ("email", "", _email),  # by _emails
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", _iban),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    ("date", r"(?<![\d./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d/-])(?!\.\d)", _date),
    ("ipv4", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", _ipv4),
    ("ipv6", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}|:)(?:[:0-9A-Fa-f]*)(?![0-9A-Za-z:])", _ipv6),
    ("phone", r"(?<![\d+A-Za-z])(?:\+\d{1,3}[ .-]?\(?\d[\d ().-]{4,16}\d|(?:1[ .-])?\([2-9]\d\d\)[ .-]?\d{3}[ .-]\d{4}|(?:1[ .-])?[2-9]\d\d(?:([.-])\d{3}\3| [2-9]\d\d )\d{4})(?![\d])", _phone),
    ("card", r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-])", _card),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])", _secret),
]
NAMES = [k for k, _, _ in KINDS]
#: A text without any of these has no span: an at sign, a digit, or a long run of hexadecimal letters.
_MAYBE = re.compile(r"[@0-9]|[A-Fa-f]{32}")


class Pseudonyms:
    """Replaces validated values in texts with one key; remembers some of them."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back, self.cache = key, back, {}
        self.patterns = []
        for name, pattern, change in KINDS:
            self.patterns.append((name, re.compile(_local_groups(pattern)), change))

    def value(self, kind: int, s: str) -> str | None:
        if (kind, s) not in self.cache:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[kind, s] = self.patterns[kind][2](s, self.key, self.back)
        return self.cache[kind, s]

    def spans(self, text: str) -> list[tuple[int, int, int, str]]:
        """(start, end, kind, replacement) in order, without overlaps; earlier kinds come first."""
        taken: list[tuple[int, int, int, str]] = []
        if not _MAYBE.search(text):
            return taken
        for k, (name, pattern, _) in enumerate(self.patterns):
            if (name == "ipv6" and text.count(":") < 2) or (name == "ssn" and "-" not in text):
                continue
            for start, found in _emails(text) if name == "email" else ((m.start(), m[0]) for m in pattern.finditer(text)):
                for s in _shorter(found) if name in ("card", "phone") else (found,):
                    at = bisect_left(taken, (start,))
                    if (at < len(taken) and taken[at][0] < start + len(s)) or (at and taken[at - 1][1] > start):
                        continue
                    new = self.value(k, s)
                    if new is not None:
                        insort(taken, (start, start + len(s), k, new))
                        break
        return taken

    def replace(self, text: str | None) -> tuple[str | None, list[int]]:
        """The text with pseudonyms, and how many of each kind."""
        counts = [0] * len(KINDS)
        if not text:
            return text, counts
        out, at = [], 0
        for a, b, kind, new in self.spans(text):
            out += [text[at:a], new]
            at = b
            counts[kind] += 1
        return ("".join(out) + text[at:] if at else text), counts


def _shorter(s: str) -> Iterator[str]:
    """The match and its heads up to a gap: two numbers side by side look like one."""
    yield s
    for k in range(len(s) - 1, 0, -1):
        if s[k] in " .-" and s[k - 1] not in " .-(":
            yield s[:k]


def _local_groups(pattern: str) -> str:
    """Back references of KINDS count groups through its own pattern; the phone pattern has one group only."""
    return pattern.replace(r"\3", r"\1")


_ready: dict = cache()


def _worker(key: bytes) -> Pseudonyms:
    if key not in _ready:
        _ready[key] = Pseudonyms(key)
    return _ready[key]


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, the other columns as a struct _rest, and a map _pii from kind to count.

    Null texts stay null with an empty map. Rows are changed one by one, whatever their ids; empty tables give
    none. Texts may be of any length: what is looked for is bounded, and found in one pass for each kind.
    """
    if not key:
        raise ValueError("a key is needed")
    slim = packed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _worker(key)
        for batch in pieces(batches):
            where = batch.schema.names.index("text")
            new, counts = [], []
            for text in batch.column(where).to_pylist():
                t, n = own.replace(text)
                new.append(t)
                counts.append([(NAMES[k], c) for k, c in enumerate(n) if c])
            columns = list(batch.columns)
            columns[where] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.map_(pa.string(), pa.int32()))], [*batch.schema.names, "_pii"])

    fields = [*slim.schema.fields, StructField("_pii", MapType(StringType(), IntegerType()))]
    return slim.mapInArrow(run, StructType(fields))


def pseudonym_report(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, n_replaced and kinds (a map from kind to count) of each row."""
    out = pseudonymise(docs.select(F.col("doc_id").cast("long"), "text"), key)
    total = F.aggregate(F.map_values("_pii"), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", "text", total.alias("n_replaced"), F.col("_pii").alias("kinds"))


def pseudonym_stage(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with pseudonyms in their texts; same columns."""
    return unpacked(pseudonymise(docs, key), docs)

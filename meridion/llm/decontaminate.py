"""Benchmark decontamination on canonical templates.

Words become template symbols: numbers, units after numbers, and capitalised names turn into typed
placeholders, everything else is its lower-case form without edge punctuation. Windows of template
symbols of the benchmark are hash-joined with those of the documents. A matched window counts only if
its slots are consistent: along one alignment of document and item, equal slot values of the item meet
equal values in the document and different ones different values, whatever the values are.

Beside its templates an item has plain windows, of lower-case words without placeholders: they find items
whose windows are mostly placeholders (names, numbers, title case) and copies in another case. Items of
fewer words than a window have one plain window of all their words, if those are MIN_FILLED or more.
Templates and plain windows are counted apart. Items of equal text are one item, the one with the least id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import durable, packed, unpacked
from .words import U64, Chunk, chunks, mix, pieces

WINDOW = 8
MIN_FILLED = 4  # words of a window that are no placeholders
COVERED = 0.5  # of an item's windows found in one document: contaminated
LONG = 6  # so many windows, 13 words of an item in a row, are enough for any item
BROADCAST_BYTES = 64 << 20
# Units of measure, in lower case.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec secs ms min mins h hr hrs day days week weeks month months year years second seconds "
    "minute minutes hour hours meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards "
    "gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres dollar dollars euro euros cent cents usd eur "
    "percent % degree degrees kmh mph w kw v a hz khz mhz ghz b kb mb gb tb"
).split()
NUMBER, UNIT, NAME = U64(0x1111111111111111), U64(0x2222222222222222), U64(0x3333333333333333)
_EDGE = np.ones(256, bool)  # bytes that are no letter, digit or part of a longer character
_EDGE[48:58] = _EDGE[65:91] = _EDGE[97:123] = _EDGE[128:] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _trimmed(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words without edge marks; of a word of marks only the first byte stays."""
    starts, ends = chunk.starts, chunk.ends
    inner = np.flatnonzero(~_EDGE[chunk.data])
    if not len(starts) or not len(inner):
        return starts.copy(), starts + 1
    after = np.searchsorted(inner, starts)
    first = inner[np.minimum(after, len(inner) - 1)]
    some = (after < len(inner)) & (first < ends)
    last = inner[np.maximum(np.searchsorted(inner, ends) - 1, 0)] + 1
    return np.where(some, first, starts), np.where(some, last, starts + 1)


def _unit_hashes() -> np.ndarray:
    (chunk,) = chunks(pa.array([" ".join(UNITS)]))
    return np.sort(Templates(chunk, units=np.zeros(0, U64)).core)


class Templates:
    """Template symbols of a chunk's words, and the words' own hashes for the slots."""

    def __init__(self, chunk: Chunk, units: np.ndarray | None = None):
        data, n = chunk.data, len(chunk.starts)
        text = pa.Array.from_buffers(pa.large_string(), len(chunk), [None, pa.py_buffer(chunk.rows), pa.py_buffer(np.ascontiguousarray(data))])
        (low,) = chunks(pc.utf8_lower(text), 1 << 62)  # the same words, in lower case
        low_starts, low_ends = _trimmed(low)
        self.core = Chunk(0, low.data, low.rows, low_starts, low_ends, low.words).hashes()
        self.slot, self.symbol = np.zeros(n, bool), self.core
        if not n:
            return
        starts, ends = _trimmed(chunk)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        number = digits[ends] > digits[starts]

        def raised(offset: int) -> np.ndarray:
            """Whether the byte at an offset into a word changes in lower case."""
            return data[np.minimum(starts + offset, ends - 1)] != low.data[np.minimum(low_starts + offset, low_ends - 1)]

        wide = data[starts] >= 0xC0  # the first letter has two bytes or more
        capital = raised(0) | (wide & raised(1))
        alone = ends - starts <= 1 + wide  # a single letter names nothing
        second = data[np.minimum(starts + 1, ends - 1)] >= 0xC0  # the second letter has two bytes or more
        shout = alone | np.where(wide, raised(2) | raised(3), raised(1) | (second & raised(2)))
        first = np.zeros(n, bool)  # of a sentence or line: its capital says nothing
        first[1:] = np.isin(data[chunk.ends[:-1] - 1], np.frombuffer(b".!?:", np.uint8))
        first[chunk.words[:-1][chunk.words[:-1] < n]] = True
        newline = np.concatenate([[0], np.cumsum(data == 10)])
        first[1:] |= newline[chunk.starts[1:]] > newline[chunk.ends[:-1]]
        name = capital & ~first & ~shout & ~number
        units = _UNITS if units is None else units
        unit = np.zeros(n, bool)
        if len(units):
            at = np.minimum(np.searchsorted(units, self.core), len(units) - 1)
            unit[1:] = (units[at[1:]] == self.core[1:]) & number[:-1]
        self.slot = number | unit | name
        self.symbol = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, self.core)))

    def windows(self, chunk: Chunk, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each template window with enough words that are no placeholders."""
        keys, at = chunk.windows(self.symbol, width)
        filled = np.concatenate([[0], np.cumsum(~self.slot)])
        good = filled[at + width] - filled[at] >= min(MIN_FILLED, width)
        return keys[good], at[good]


_UNITS = np.zeros(0, U64)
_UNITS = _unit_hashes()


TEMPLATE, PLAIN = 0, 1


def _plain_windows(t: Templates, chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window of lower-case words; windows of other widths have other hashes."""
    keys, at = chunk.windows(t.core, width)
    return mix(keys ^ U64(width)), at


def distinct_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, text) for each different text: a number of it, and the least id it has."""
    return benchmark.where("text is not null").groupBy("text").agg(F.min(F.col("item_id").cast("long")).alias("item_id")).select(F.xxhash64("text").alias("item"), "item_id", "text")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(key, item, item_id, kind, pos, slots, n, width) of each window of each different text.

    slots are the values at a template's placeholders (0 elsewhere), n is the item's number of windows of the kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, ids = batch.column(0).to_numpy(), batch.column(1)
            for chunk in chunks(batch.column(2), 1 << 18):
                t = Templates(chunk)
                values = np.where(t.slot, t.core, U64(0)).view(np.int64)
                n_words = np.diff(chunk.words)
                found = [(TEMPLATE, WINDOW, *t.windows(chunk))]
                for width in range(MIN_FILLED, WINDOW + 1):
                    keys, at = _plain_windows(t, chunk, width)
                    # Shorter windows are those of items that have no more words.
                    whole = n_words[np.searchsorted(chunk.words, at, "right") - 1] == width
                    found.append((PLAIN, width, *((keys, at) if width == WINDOW else (keys[whole], at[whole]))))
                for kind, width, keys, at in found:
                    row = np.searchsorted(chunk.words, at, "right") - 1
                    slots = [values[a : a + WINDOW].tolist() if kind == TEMPLATE else [] for a in at.tolist()]
                    count = np.bincount(row, minlength=len(chunk))
                    columns = [
                        pa.array(keys.view(np.int64)), pa.array(items[chunk.first + row]), ids.take(pa.array(chunk.first + row)), pa.array(np.full(len(at), kind, np.int32)),
                        pa.array((at - chunk.words[row]).astype(np.int32)), pa.array(slots, pa.list_(pa.int64())), pa.array(count[row].astype(np.int32)), pa.array(np.full(len(at), width, np.int32)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "item", "item_id", "kind", "pos", "slots", "n", "width"])

    return distinct_items(benchmark).mapInArrow(run, "key long, item long, item_id long, kind int, pos int, slots array<long>, n int, width int")


def _document_windows(chunk: Chunk, widths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first word of all windows of a chunk that an item may have, and the words' own hashes."""
    t = Templates(chunk)
    found = [t.windows(chunk), *(_plain_windows(t, chunk, w) for w in widths)]
    keys, at = (np.concatenate(x) for x in zip(*found, strict=True))
    return keys, at, t.core


def _consistent(pairs: dict, item: np.ndarray, doc: np.ndarray, back: dict) -> bool:
    """Whether the slot values of a window fit the bindings of its alignment; adds new ones if so."""
    new, new_back = {}, {}
    for a, b in zip(item.tolist(), doc.tolist(), strict=True):
        if a == 0:
            continue
        if pairs.get(a, new.get(a, b)) != b or back.get(b, new_back.get(b, a)) != a:
            return False
        new[a], new_back[b] = b, a
    pairs.update(new)
    back.update(new_back)
    return True


def _needed(n: np.ndarray) -> np.ndarray:
    """Of n windows, how many make a document contaminated."""
    return np.minimum(LONG, COVERED * n)


class Index:
    """Benchmark windows by key, small enough to be broadcast."""

    def __init__(self, rows: pa.Table):
        key = rows["key"].to_numpy().astype(np.int64).view(U64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        item, kind, pos, n, width = (rows[c].to_numpy().astype(np.int64)[order] for c in ("item", "kind", "pos", "n", "width"))
        # Each item's templates and plain windows are counted for themselves, under numbers of their own.
        own, first, self.own = np.unique(np.stack([item, kind], axis=1), axis=0, return_index=True, return_inverse=True) if len(rows) else (np.zeros((0, 2), np.int64), order, order)
        self.own, self.pos, self.kinds, self.sizes = self.own.reshape(-1), pos, own[:, 1], n[first]
        self.ids = rows["item_id"].combine_chunks().take(pa.array(order[first])).to_pylist() if len(rows) else []
        self.widths = sorted({int(w) for w in np.unique(width[kind == PLAIN])})
        slots = rows["slots"].combine_chunks()
        flat, offsets = slots.flatten().to_numpy(), slots.value_lengths().to_numpy()
        self.slots = np.zeros((len(rows), WINDOW), np.int64)
        self.slots[offsets == WINDOW] = flat.reshape(-1, WINDOW)
        self.slots = self.slots[order]
        self.keys, self.first = np.unique(self.key, return_index=True)
        self.last = np.append(self.first[1:], len(self.key))
        # Most document windows miss: one bit for each value of 20 bits of the key says so at once.
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.keys >> U64(44)).astype(np.int64)] = True

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``keys`` that are present, and their place among the distinct keys."""
        maybe = np.flatnonzero(self.some[(keys >> U64(44)).astype(np.int64)])
        at = np.searchsorted(self.keys, keys[maybe])
        at = np.minimum(at, max(0, len(self.keys) - 1))
        good = self.keys[at] == keys[maybe] if len(self.keys) else np.zeros(len(maybe), bool)
        return maybe[good], at[good]


def _score(found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> int:
    """How many windows of one item's template are found consistently; found holds (pos, document word, item slots, document values)."""
    bound: dict[int, tuple[dict, dict]] = {}
    out = set()
    for pos, word, a, b in sorted(found, key=lambda x: x[:2]):
        pairs, back = bound.setdefault(word - pos, ({}, {}))
        if _consistent(pairs, a, b, back):
            out.add(pos)
    return len(out)


MATCH = "doc_id long, item_id long, n_matched long, n_windows long"
EXPANDED = 1 << 20  # pairs of a document's window and an item's that are held at a time, unless one row has more


def _found(index: Index, texts: pa.Array, enough: bool) -> Iterator[tuple[int, int, int, int]]:
    """(row, own number of item and kind, matched windows, all its windows) of rows and items that share a window.

    With ``enough`` only those that make a row contaminated; what can't is dropped before its slots are looked at.
    """
    for chunk in chunks(texts):
        keys, at, core = _document_windows(chunk, index.widths)
        hit, place = index.hits(keys)
        word = at[hit]
        order = np.argsort(word, kind="stable")
        word, place = word[order], place[order]
        row = np.searchsorted(chunk.words, word, "right") - 1
        size = (index.last - index.first)[place]
        ahead = np.cumsum(size)
        core, begin = core.view(np.int64), 0
        while begin < len(row):
            # Whole rows, as many as their pairs allow.
            end = max(int(np.searchsorted(ahead, (ahead[begin - 1] if begin else 0) + EXPANDED)), begin + 1)
            end = int(np.searchsorted(row, row[end - 1], "right"))
            own = size[begin:end]
            entry = np.repeat(index.first[place[begin:end]] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(int(own.sum()))
            r, w = np.repeat(row[begin:end], own), np.repeat(word[begin:end], own)
            begin = end
            number, pos = index.own[entry], index.pos[entry]
            order = np.lexsort((pos, number, r))
            r, w, number, pos, entry = r[order], w[order], number[order], pos[order], entry[order]
            new = np.append(True, (r[1:] != r[:-1]) | (number[1:] != number[:-1]))
            start = np.flatnonzero(new)
            step = (new | np.append(True, pos[1:] != pos[:-1])).astype(np.int64)
            different = np.add.reduceat(step, start)
            ends = np.append(start[1:], len(r))
            need = _needed(index.sizes[number[start]]) if enough else np.ones(len(start))
            for k in np.flatnonzero(different >= need).tolist():
                a, b, x = start[k], ends[k], int(number[start[k]])
                n = int(different[k])
                if index.kinds[x] == TEMPLATE:
                    n = _score([(int(pos[j]), int(w[j]), index.slots[entry[j]], core[w[j] : w[j] + WINDOW]) for j in range(a, b)])
                if n >= need[k]:
                    yield chunk.first + int(r[a]), x, n, int(index.sizes[x])


def _small(index: DataFrame, broadcast_bytes: int):
    """The benchmark's windows as a broadcast, or None if their counted size is too large."""
    if index.count() * (72 + 8 * WINDOW) > broadcast_bytes:
        return None
    return index.sparkSession.sparkContext.broadcast(Index(index.toArrow()))


def matches(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, enough: bool = False) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows) of each row, item and kind of windows with a consistent window in common.

    The benchmark's windows are broadcast if their counted size allows it; else windows of both sides meet
    in a shuffled join on their hashes. Both ways give the same rows; each row of docs is judged for itself.
    With ``enough``, only matches that make a row contaminated.
    """
    index = durable(benchmark_windows(benchmark), "windows")
    slim = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = _small(index, broadcast_bytes)
    if shared is None:
        numbered = slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        return _joined(numbered, index, enough).select("doc_id", "item_id", "n_matched", "n_windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = [(ids[r], shared.value.ids[x], n, size) for r, x, n, size in _found(shared.value, batch.column(1), enough)]
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_matched", "n_windows"])

    return slim.mapInArrow(run, MATCH)


def _joined(rows: DataFrame, index: DataFrame, enough: bool) -> DataFrame:
    """(row, doc_id, item_id, n_matched, n_windows) by a shuffled join of windows; ``rows`` is (row, doc_id, text)."""
    widths = sorted(r.width for r in index.where(F.col("kind") == PLAIN).select("width").distinct().collect())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                keys, at, core = _document_windows(chunk, widths)
                core = np.append(core.view(np.int64), np.zeros(WINDOW, np.int64))
                for k in range(0, len(at), 1 << 16):
                    some = at[k : k + (1 << 16)]
                    row = pa.array(chunk.first + np.searchsorted(chunk.words, some, "right") - 1)
                    own = core[some[:, None] + np.arange(WINDOW)].ravel()
                    values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(own) + 1, WINDOW), pa.int32()), pa.array(own))
                    columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(keys[k : k + (1 << 16)].view(np.int64)), pa.array(some.astype(np.int32)), values]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "key", "word", "values"])

    def score(key, table):  # not annotated: Spark would try to read a meaning from it
        rows = table.select(["kind", "pos", "word", "slots", "values", "n"]).to_pylist()
        n = len({r["pos"] for r in rows})
        need = float(_needed(np.array(rows[0]["n"]))) if enough else 1
        if n >= need and rows[0]["kind"] == TEMPLATE:
            n = _score([(r["pos"], r["word"], np.array(r["slots"]), np.array(r["values"])) for r in rows])
        first = table.slice(0, int(n >= need))
        return first.select(["row", "doc_id", "item_id"]).append_column("n_matched", pa.array([n] * len(first), pa.int64())).append_column("n_windows", first["n"].cast(pa.int64()))

    found = rows.mapInArrow(spread, "row long, doc_id long, key long, word int, values array<long>").join(index, "key")
    if enough:  # before slots are looked at, what has too few windows goes
        counts = found.groupBy("row", "item", "kind").agg(F.count_distinct("pos").alias("d"), F.max("n").alias("n_all"))
        some = counts.where(F.col("d") >= F.least(F.lit(float(LONG)), COVERED * F.col("n_all"))).select("row", "item", "kind")
        found = found.join(some, ["row", "item", "kind"], "left_semi")
    return found.groupBy("row", "item", "kind").applyInArrow(score, "row long, " + MATCH)


def _contaminated() -> Column:
    return F.col("n_matched") >= F.least(F.lit(float(LONG)), COVERED * F.col("n_windows"))


def contamination(docs: DataFrame, benchmark: DataFrame, enough: bool = False) -> DataFrame:
    """One row for each (doc_id, item_id) with n_matched, n_windows, coverage, contaminated; with ``enough`` only contaminated ones.

    Rows without a doc_id are not judged. Null texts have no windows; items of fewer than MIN_FILLED words have none and never match.
    Each row is judged for itself; of rows, items and kinds of windows with equal ids the best coverage stays,
    and contaminated is true if it is for any. Items of equal text are told under the least item_id. Texts may be of any length.
    """
    found = matches(docs, benchmark, enough=enough).withColumn("coverage", F.col("n_matched") / F.col("n_windows")).withColumn("contaminated", _contaminated())
    best = F.max(F.struct("contaminated", "coverage", "n_matched", "n_windows")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_matched", "best.n_windows", "best.coverage", "best.contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows that hold no benchmark item; same columns.

    Each row is judged by its own text, rows without a doc_id too. With a broadcast benchmark texts are
    judged where they are read, without a shuffle.
    """
    index = durable(benchmark_windows(benchmark), "windows")
    shared = _small(index, broadcast_bytes)
    slim = packed(docs)
    if shared is None:
        key = F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b"))
        texts = docs.where("text is not null").select("text").dropDuplicates(["text"]).select(F.monotonically_increasing_id().alias("row"), F.lit(0).cast("long").alias("doc_id"), "text")
        texts = durable(texts, "texts")  # rows are numbered once
        bad = texts.join(_joined(texts, index, True).select("row").distinct().hint("shuffle_hash"), "row", "left_semi").select(key.alias("_key")).distinct()
        return unpacked(slim.withColumn("_key", key).join(bad.hint("shuffle_hash"), "_key", "left_anti"), docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keep = np.ones(len(batch), bool)
            for r, *_ in _found(shared.value, batch.column(batch.schema.names.index("text")), True):
                keep[r] = False
            yield batch.filter(pa.array(keep))

    return unpacked(slim.mapInArrow(run, slim.schema), docs)

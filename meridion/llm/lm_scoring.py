"""Scoring with a log-bilinear model trained by noise-contrastive estimation.

All training words are counted, without bound. The model's vocabulary is an <end>, the most frequent words,
and classes for all others, by their last two bytes. A token's probability is the model's, times, inside a
class, the smoothed share of its word in the class. The model predicts a target vector from two context
vectors, each through a matrix of its own.

Training does not depend on how the input is partitioned: documents are dealt by hash to shards of
SHARD_TOKENS tokens on average, and lie in a shard in the order of their hashes. In each round every shard
trains a copy of the model in numpy on all its tokens; the copies' mean, summed exactly in whole numbers, is
the next round's start. For scoring, products of vocabulary-sized matrices give the sum over all targets for
every pair of context words, so that each token's log-probability is normalised exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import discard, durable, durable_at, shuffle_width
from .words import TO_LOWER, U64, Chunk, chunks

VOCABULARY = 2048  # <end> 0, then the classes, then words
CLASSES = 512
DIM = 32
NOISE = 10  # noise words for each token
SHARED_NOISE = 64  # noise words drawn for a whole minibatch
BATCH = 4096
GATHERED = 1 << 17  # tokens of whole rows that are cut into minibatches together, at least
RATE = 0.15
TABLE_WORDS = 1 << 18  # the most words whose counts are broadcast, 12 bytes each
SLICES = 64
SHARD_TOKENS = 1 << 19
ROUNDS = 2
MANY = 4096  # equal rows that are spread over shards by their number
SCALE = 1 << 24  # of parameters as whole numbers, so that sums over all shards are exact
SEED = 20240229
F32 = np.float32


def held_out() -> Column:
    return F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1"), F.lit(False))


def classes(chunk: Chunk) -> np.ndarray:
    """The class of each word, were it not frequent: of its last two bytes."""
    data = TO_LOWER[chunk.data]
    last = data[chunk.ends - 1].astype(np.int64)
    before = np.where(chunk.ends - chunk.starts > 1, data[np.maximum(chunk.ends - 2, 0)], 0)
    return 1 + ((last << 8 | before) * 40503 >> 5) % CLASSES


class Words:
    """Counts of frequent words by hash, and the totals of all.

    ``words`` are (hash, count, class) of the frequent ones, ``totals`` (class, count, distinct words) of all.
    """

    def __init__(self, words: tuple[np.ndarray, np.ndarray, np.ndarray], n_ends: int, totals: np.ndarray):
        keys, counts, own = words
        order = np.argsort(keys)
        self.keys, self.counts = np.append(keys[order], ~U64(0)), np.append(counts[order], 0)
        self.n_ends, self.total = n_ends, int(totals[:, 1].sum()) + n_ends
        self.distinct = int(totals[:, 2].sum()) + (n_ends > 0)
        top = np.lexsort((self.keys[:-1], -self.counts[:-1]))[: VOCABULARY - 1 - CLASSES]
        self.ids = np.append(own[order].astype(np.int32), 0)
        self.ids[top] = np.arange(len(top)) + 1 + CLASSES
        self.size = 1 + CLASSES + len(top)
        inside = np.zeros((self.size, 2), np.int64)
        np.add.at(inside, totals[:, 0], totals[:, 1:])
        np.subtract.at(inside, own[order][top], np.stack([self.counts[top], np.ones(len(top), np.int64)], axis=1))
        # In a class there is room for one word that was never seen.
        self.log_class = np.log10(inside[:, 0] + 0.5 * (inside[:, 1] + 1))
        self.log_class[[0, *range(1 + CLASSES, self.size)]] = 0
        count = inside[:, 0]
        count[0], count[1 + CLASSES :] = n_ends, self.counts[top]
        self.unigram = (count + 0.5) / (count.sum() + 0.5 * self.size)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's place in the table, and whether it is there."""
        at = np.searchsorted(self.keys[:-1], hashes)
        return at, (self.keys[at] == hashes) & (at < len(self.keys) - 1)


def count_words(train: DataFrame) -> DataFrame:
    """(h, k, c): hash, class and count of every word of the training rows; a task adds up what it reads before it sends anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, own, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, own, counts = keys[order], own[order], counts[order]
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            return keys[start], own[start], np.add.reduceat(counts, start) if len(start) else counts

        def sent() -> pa.RecordBatch:
            keys, own, counts = parts[0]
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(own, pa.int32()), pa.array(counts)], ["h", "k", "c"])

        held = 0
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                keys, first, counts = np.unique(chunk.hashes(lower=True), return_index=True, return_counts=True)
                parts.append((keys, classes(chunk)[first], counts))
                held += len(keys)
                if held > 1 << 22:
                    parts = [merged()]
                    held = len(parts[0][0])
                    if held > 1 << 21:
                        yield sent()
                        parts, held = [], 0
        if parts:
            parts = [merged()]
            yield sent()

    return train.select("text").mapInArrow(run, "h long, k int, c long").groupBy("h").agg(F.min("k").alias("k"), F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, n_ends: int, table_words: int = TABLE_WORDS) -> tuple[Words, int]:
    """The words counted at least as often as the returned threshold, which at most ``table_words`` are."""
    totals = counts.groupBy("k").agg(F.sum("c"), F.count("*")).collect()  # CLASSES rows at most
    # At most 512 bins: eight for each doubling of the count.
    bins = {r.b: (r.n, r.least) for r in counts.groupBy(F.floor(F.log2("c") * 8).alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()}
    threshold, held = 1 << 62, 0
    for b in sorted(bins, reverse=True):
        held += bins[b][0]
        if held > table_words:
            break
        threshold = bins[b][1]
    rows = counts.where(F.col("c") >= threshold).toArrow()
    keys, own, n = (rows[c].to_numpy().astype(np.int64) for c in ("h", "k", "c"))
    return Words((keys.view(U64), n, own), n_ends, np.array(totals, np.int64).reshape(-1, 3)), threshold


def token_ids(chunk: Chunk, hashes: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Model ids of all tokens, ends included, and each row's first token."""
    at, known = words.find(hashes)
    own = np.where(known, words.ids[at], classes(chunk))
    return np.insert(own, chunk.words[1:], 0), chunk.words[:-1] + np.arange(len(chunk))


def contexts(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids before each token and the ones before those; <end> stands before a row."""
    one, two = np.zeros_like(ids), np.zeros_like(ids)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    one[first] = two[first] = 0
    second = first[first + 1 < len(ids)] + 1
    two[second] = 0
    return one, two


class LogBilinear:
    """Vectors R of words, a matrix for each of the two context places, and biases b."""

    def __init__(self, unigram: np.ndarray):
        rng = np.random.default_rng(SEED)
        n = len(unigram)
        self.r = rng.normal(0, 0.1, (n, DIM)).astype(F32)
        self.c = np.stack([np.eye(DIM, dtype=F32) * 0.1 for _ in range(2)])
        self.b = np.log(unigram).astype(F32)
        self.noise = unigram
        self.sums = [np.full(p.shape, 1e-3, F32) for p in self.parameters()]  # of squared gradients, which go on from round to round

    def parameters(self) -> list[np.ndarray]:
        return [self.r, self.c, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (*self.parameters(), *self.sums)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in (*self.parameters(), *self.sums):
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def trainer(self, *seed: int) -> Trainer:
        return Trainer(self, seed)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores of targets after each first and second context word, biases, and log normalisers of all pairs."""
        one, two = (self.r @ c @ self.r.T for c in self.c)
        top1, top2 = one.max(axis=1), (two + self.b).max(axis=1)
        left, right = one - top1[:, None], two + self.b
        right -= top2[:, None]
        z = np.exp(left, out=left) @ np.exp(right, out=right).T
        del left, right
        np.log(np.maximum(z, 1e-37, out=z), out=z)
        z += top1[:, None]
        z += top2[None, :]
        return one, two, self.b, z


class Trainer:
    """Noise-contrastive estimation with Adagrad steps on minibatches."""

    def __init__(self, model: LogBilinear, seed: tuple[int, ...]):
        self.m = model
        self.rng = np.random.default_rng([SEED, *seed])  # other noise in each round and shard
        self.cumulative = np.cumsum(model.noise)
        self.log_noise = np.log(model.noise * NOISE).astype(F32)
        self.rest: list[np.ndarray] = []
        self.n = 0

    def add_row(self, ids: np.ndarray) -> None:
        """A row's ids, with its end; whole rows are gathered and cut into minibatches."""
        self.rest.append(ids)
        self.n += len(ids)
        if self.n >= GATHERED:
            self.finish()

    def finish(self) -> None:
        if self.n:
            ids = np.concatenate(self.rest)
            one, two = contexts(ids, np.append(0, np.flatnonzero(ids[:-1] == 0) + 1))
            for k in range(0, self.n, BATCH):
                part = slice(k, k + BATCH)
                self.step(ids[part], one[part], two[part])
        self.rest, self.n = [], 0

    def step(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m = self.m
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(SHARED_NOISE)), len(m.b) - 1)
        r1, r2, rw, rn = m.r[one], m.r[two], m.r[w], m.r[noise]
        q = r1 @ m.c[0] + r2 @ m.c[1]
        good = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, rw) + m.b[w] - self.log_noise[w]))  # 1 - sigmoid
        bad = (NOISE / SHARED_NOISE) / (1 + np.exp(self.log_noise[noise] - q @ rn.T - m.b[noise]))
        dq = good[:, None] * rw - bad @ rn
        gc = np.stack([r1.T @ dq, r2.T @ dq])
        n = len(w)
        index = np.concatenate([w, one, two, noise]).astype(np.uint16)
        value = np.empty((len(index), DIM), F32)
        np.multiply(good[:, None], q, out=value[:n])
        np.matmul(dq, m.c[0].T, out=value[n : 2 * n])
        np.matmul(dq, m.c[1].T, out=value[2 * n : 3 * n])
        np.matmul(bad.T, -q, out=value[3 * n :])
        # Sums of the rows of each word; words without any keep their parameters and sums.
        order = np.argsort(index, kind="stable")
        index = index[order]
        start = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
        gb = np.bincount(w, weights=good, minlength=len(m.b)) - np.bincount(noise, weights=bad.sum(axis=0), minlength=len(m.b))
        for k, own, g in ((0, index[start], np.add.reduceat(value[order], start, axis=0)), (1, slice(None), gc), (2, slice(None), gb.astype(F32))):
            p, s = m.parameters()[k], m.sums[k]
            g /= F32(n**0.5)
            total = s[own] + g * g
            s[own] = total
            p[own] += RATE * g / np.sqrt(total)


def row_tokens(rows: DataFrame, words) -> DataFrame:
    """(key, ids) of each training row: a hash of it, and its model ids in two bytes each. ``words`` is a broadcast Words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                ids, first = token_ids(chunk, chunk.hashes(lower=True), words.value)
                ids = ids.astype(np.uint16)
                own = [x.tobytes() for x in np.split(ids, first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), pa.array(own, pa.binary())], ["key", "ids"])

    return rows.select(F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(run, "key long, ids binary")


def dealt_tokens(tokens: DataFrame, n_shards: int, many: int = MANY) -> DataFrame:
    """(shard, key, ids, n) of a table of (key, ids): each row once, or in place of very many equal rows their number in each shard.

    Equal rows have equal keys, so a key says the shard; those of keys with more than ``many`` rows are spread over all shards evenly.
    """
    cold = tokens.select(F.pmod("key", F.lit(n_shards)).cast("int").alias("shard"), "key", "ids", F.lit(1).cast("long").alias("n"))
    hot = tokens.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > many)
    if not hot.limit(1).count():
        return cold
    # The hints keep what grows with the input from being broadcast at any size.
    cold = cold.join(hot.select("key").hint("shuffle_hash"), "key", "left_anti").select("shard", "key", "ids", "n")
    once = tokens.join(hot.hint("shuffle_hash"), "key").groupBy("key").agg(F.min("ids").alias("ids"), F.max("rows").alias("rows"))
    each = once.select("key", "ids", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("rows"), F.lit(n_shards)) - 1)).alias("i"))
    share = F.floor(F.col("rows") / n_shards) + F.when(F.col("i") < F.col("rows") % n_shards, 1).otherwise(0)
    spread = each.select(F.pmod(F.pmod("key", F.lit(n_shards)) + F.col("i"), F.lit(n_shards)).cast("int").alias("shard"), "key", "ids", share.cast("long").alias("n"))
    return cold.union(spread)


def train(rows: DataFrame, words, n_tokens: int) -> LogBilinear:
    """The model of ROUNDS rounds over all training rows; ``words`` is a broadcast Words, ``n_tokens`` counts the tokens."""
    spark = rows.sparkSession
    model = LogBilinear(words.value.unigram)
    if not n_tokens:
        return model
    n_shards = -(-n_tokens // SHARD_TOKENS)
    tokens, path = durable_at(row_tokens(rows, words), "tokens")
    # Equal rows have equal keys and ids, so their order says nothing.
    ordered = dealt_tokens(tokens, n_shards).repartition(max(1, min(n_shards, shuffle_width(spark))), "shard").sortWithinPartitions("shard", "key", "ids").select("shard", "ids", "n")
    schema = "slice int, n long, sums binary"

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for k, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = total.setdefault(k, [0, np.zeros(len(blob) // 8, np.int64)])
                own[0] += n
                own[1] += np.frombuffer(blob, np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([x[0] for x in total.values()], pa.int64()), pa.array([x[1].tobytes() for x in total.values()], pa.binary())], ["slice", "n", "sums"])

    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model.flat())  # one model

        def run(batches: Iterator[pa.RecordBatch], number=number, shared=shared) -> Iterator[pa.RecordBatch]:
            # A task adds up the models of its shards before it sends them.
            total, done, shard, trainer = None, 0, None, None

            def ended(trainer: Trainer, total: np.ndarray | None) -> np.ndarray:
                trainer.finish()
                own = np.round(trainer.m.flat().astype(np.float64) * SCALE).astype(np.int64)
                return own if total is None else total + own

            for batch in batches:
                for k, blob, copies in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    if k != shard:
                        if trainer is not None:
                            total, done = ended(trainer, total), done + 1
                        fresh = LogBilinear(words.value.unigram)
                        fresh.load(shared.value)
                        shard, trainer = k, fresh.trainer(number, k)
                    own = np.frombuffer(blob.as_buffer(), np.uint16).astype(np.int64)
                    for _ in range(copies):
                        trainer.add_row(own)
            if trainer is not None:
                total, done = ended(trainer, total), done + 1
                parts = np.array_split(total, SLICES)
                yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([done] * SLICES, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "n", "sums"])

        sums = ordered.mapInArrow(run, schema).repartition(min(SLICES, shuffle_width(spark)), "slice").mapInArrow(mean, schema)
        found = {r.slice: np.frombuffer(r.sums, np.int64) / (r.n * SCALE) for r in sums.collect()}  # SLICES rows, one model in all
        model.load(np.concatenate([found[k] for k in range(SLICES)]))
    discard(spark, path)
    return model


_ready: dict = {}


def _tables(shared) -> tuple:
    """The normalised tables of a broadcast model, made once in each worker."""
    model, key = shared.value
    if key not in _ready:
        _ready.clear()
        _ready[key] = model.tables()
    return _ready[key]


def _lists(chunk: Chunk, hashes: np.ndarray, of: np.ndarray) -> list[pa.Array]:
    """For each row the different words among some, and how often each comes."""
    some = np.flatnonzero(of)
    row, h = np.searchsorted(chunk.words, some, "right") - 1, hashes[some]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    start = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))[: len(h)])
    cuts = pa.array(np.searchsorted(row[start], np.arange(len(chunk) + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (h[start].view(np.int64), np.diff(np.append(start, len(h))))]


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Texts may be of any length and other columns are ignored. Null texts are empty: one token, the end. Rows without a doc_id are never held out. Each row is
    scored for itself, repeated rows too. Without training rows every count is 0 and the model is uniform.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("held_out", held_out())
    learned = slim.where("not held_out")
    counts = durable(count_words(learned), "counts")
    words, threshold = frequent_words(counts, learned.count())
    shared_words = spark.sparkContext.broadcast(words)
    model = train(learned, shared_words, words.total)
    key = f"{spark.sparkContext.applicationId} {id(model)} {model.flat().sum()}"
    shared_model = spark.sparkContext.broadcast((model, key))
    row_key = F.xxhash64("doc_id", "text").alias("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared_words.value
        one_table, two_table, bias, norm = _tables(shared_model)
        logs = np.log10(own.counts + 0.5)
        log_end = np.log10(own.n_ends + 0.5)
        for batch in batches:
            out, rare = [], []
            for chunk in chunks(batch.column(2)):
                hashes = chunk.hashes(lower=True)
                at, known = own.find(hashes)
                ids, first = token_ids(chunk, hashes, own)
                one, two = contexts(ids, first)
                lp = one_table[one, ids] + two_table[two, ids] + bias[ids] - norm[one, two]
                logprob = np.add.reduceat(lp.astype(np.float64), first) / np.log(10)

                def per_row(x: np.ndarray, cuts: np.ndarray = chunk.words) -> np.ndarray:
                    return np.diff(np.concatenate([[0], np.cumsum(x)])[cuts])

                symbol = np.delete(ids, first + np.diff(chunk.words))
                in_class = known & (symbol <= CLASSES)
                frequent = np.where(known, logs[at], 0.0)
                share = np.where(in_class, logs[at], 0.0) - own.log_class[symbol]
                out.append((np.diff(chunk.words), per_row(known.astype(np.int64)), per_row(frequent) + log_end, logprob + per_row(share)))
                rare.append(_lists(chunk, hashes, ~known))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, float, float)]
            lists = [pa.concat_arrays(x) for x in zip(*rare, strict=True)] if rare else [pa.array([], pa.list_(pa.int64()))] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *map(pa.array, columns), *lists], ["key", "doc_id", "held_out", "n_words", "n_frequent", "logs", "model", "h", "tf"])

    # Written out, as the rows and their rare words are both read from it.
    schema = "key long, doc_id long, held_out boolean, n_words long, n_frequent long, logs double, model double, h array<long>, tf array<long>"
    scored = durable(slim.select(row_key, "doc_id", "text", "held_out").mapInArrow(run, schema), "scored")

    # Words outside the table are looked up in all counts by a shuffled join: a word of the training rows
    # is rare there, and one that only held-out rows hold comes once a row, so that the skew join splits it.
    rare_words = scored.select("key", F.explode(F.arrays_zip("h", "tf")).alias("x")).select("key", "x.h", "x.tf")
    looked_up = rare_words.join(counts.where(F.col("c") < threshold), "h", "left")
    c = F.coalesce("c", F.lit(0))
    sums = looked_up.groupBy("key").agg(F.sum(F.col("tf") * F.log10(c + F.lit(0.5))).alias("rare_logs"), F.sum("tf").alias("rare"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("rare_known"))
    # Equal rows share a key and add up; each gets its own part back, as they hold equally many rare words.
    part = F.when(F.col("rare") > 0, (F.col("n_words") - F.col("n_frequent")) / F.col("rare")).otherwise(F.lit(0.0))
    n_tokens = F.col("n_words") + 1
    rare_logs = F.coalesce(F.col("rare_logs") * part, F.lit(0.0))
    base_norm = float(np.log10(words.total + 0.5 * (words.distinct + 1)))
    return scored.drop("h", "tf").join(sums, "key", "left").select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"),
        (F.col("n_frequent") + F.coalesce(F.round(F.col("rare_known") * part).cast("long"), F.lit(0)) + F.lit(int(words.n_ends > 0))).alias("n_known"),
        F.lit(int(words.total)).cast("long").alias("train_tokens"),
        (F.col("logs") + rare_logs - n_tokens * F.lit(base_norm)).alias("base_score"),
        (F.col("model") + rare_logs).alias("score"),
    )

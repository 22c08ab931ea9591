"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

Every word of the trusted texts is in the model, as a 64-bit hash; nothing is cut. Counts of trigrams, contexts and continuations, discounts (three for each order, from the counts of
counts of that order) and probabilities are tables made by group-bys and joins. The log probability of a text is a sum over its n-grams of one number for each: with lower(x) what
shorter n-grams give, a seen n-gram adds log p(x) - log lower(x), and a context its log back-off weight. So the model is one table (key, value) over n-grams of all orders, dealt into
shards by key, and a text's score is the sum of what the shards return for its n-grams: every block of texts sends its distinct (key, text) pairs, sorted and packed, to the shards,
and a shard streams them past its keys.

Two bounded broadcasts spare traffic and change no result: the values of the CACHE most frequent n-grams, and a Bloom filter of all keys, of FILTER_BYTES at most; an n-gram that
it does not know is in no shard and is not sent.

Disk: the files of a shuffle go as soon as the table that it is for is written, and a table goes with its last reader. The joins that make the model run in passes by the hash of the middle word,
of about PASS_ROWS trigrams up to PASSES of them, as contexts, bigrams and trigrams meet by that word; so the shuffles of one pass are on disk at a time.

A text is kept if its perplexity is at most a quantile of its language's trusted texts, times a slack. The quantile is taken over the trusted texts
that the model has not seen, one in HELD_OUT by the hash of the doc_id: seen texts look better than they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import join_counted, lookup, materialize

#: Quantile of the trusted texts of a language, and slack of the limit. A language with fewer such texts takes the limit of all together.
QUANTILE, SLACK, MIN_TRUSTED, HELD_OUT = 0.995, 1.1, 50, 5
#: Keys in a shard; bytes of texts whose packed pairs one copy of a shard takes (of all its pairs, a shard gets its part); trusted ids that are broadcast.
SHARD_KEYS, COPY_BYTES, BROADCAST_IDS = 1_000_000, 8 << 30, 2_000_000
#: N-grams in the cache; bytes of the filter at most, and its bits for a key.
CACHE, FILTER_BYTES, FILTER_BITS = 500_000, 32 << 20, 8
SEGMENTS = 64
#: Trigrams in a pass of the joins that make the model, and passes at most.
PASS_ROWS, PASSES = 2_000_000, 4
BLOCK_TEXTS, BLOCK_CHARS, MEMO, HELD = 4096, 4_000_000, 200_000, 1_500_000
#: The token that stands twice before a text and once after it.
EDGE = 1

_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
#: The primes of xxHash64, and the seed that Spark's xxhash64 starts from.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = np.uint64(42)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashed(value: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """xxhash64 of 64-bit values, as Spark chains it over columns: the hash so far is the seed of the next."""
    h = (seed + _P5 + np.uint64(8)) ^ (_turned(value * _P2, 31) * _P1)
    h = _turned(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


class Words(dict):
    """word -> 64-bit hash, remembered up to MEMO words; one to a task."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def runs(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one run of tokens, each as EDGE, EDGE, its words, EDGE; and the number of each token's text. A text without words has none."""
    parts = [_SPLIT.findall(t) if t else [] for t in texts]
    n = np.array([len(p) for p in parts], np.int64)
    size = np.where(n > 0, n + 3, 0)
    own = np.repeat(np.arange(len(texts)), size)
    tokens = np.full(len(own), EDGE, np.uint64)
    first = np.cumsum(size) - size
    inside = np.arange(len(own)) - first[own]
    tokens[(inside >= 2) & (inside < size[own] - 1)] = np.fromiter(map(words.__getitem__, (w for p in parts for w in p)), np.uint64, int(n.sum()))
    return tokens, own


def keys(tokens: np.ndarray, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the orders 1 to 3 the keys whose values make up the score of each text, and their texts. Of order 2 there is one more than is predicted, the context of the first word."""
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    inside = np.arange(len(own)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(own)]])))
    one = hashed(tokens, SEED)
    two = hashed(tokens[1:], one[:-1])
    three = hashed(tokens[2:], two[:-1])
    at = np.flatnonzero(inside >= 2)
    pairs = np.flatnonzero(inside >= 1)
    return [(one[at], own[at]), (two[pairs - 1], own[pairs]), (three[at - 2], own[at])]


@contextmanager
def short_lived(spark: SparkSession) -> Iterator[None]:
    """Queries that are made inside leave no shuffle files behind when they end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop(*tables: DataFrame) -> None:
    """Delete what materialize has written, once nothing reads it any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= BLOCK_CHARS or i + 1 - start >= BLOCK_TEXTS:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def trigram_counts(trusted: DataFrame) -> DataFrame:
    """(a, b, c, n) over all trusted texts, written. A task sends its distinct trigrams, and does so whenever it holds many."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, rows = Words(), [], 0

        def out() -> pa.RecordBatch:
            a, b, c = (np.concatenate([x[i] for x in held]) for i in range(3))
            n = np.concatenate([x[3] for x in held])
            key = hashed(c, hashed(b, hashed(a, SEED)))
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
            total = np.add.reduceat(n[order], first)
            return pa.RecordBatch.from_arrays([*[pa.array(x[order[first]].view(np.int64)) for x in (a, b, c)], pa.array(total)], ["a", "b", "c", "n"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in slices(texts):
                t, own = runs(texts[i:j], words)
                at = np.flatnonzero(own[2:] == own[:-2]) if len(own) > 2 else np.zeros(0, np.int64)
                held.append((t[at], t[at + 1], t[at + 2], np.ones(len(at), np.int64)))
                rows += len(at)
                if rows > HELD:
                    yield out()
                    held, rows = [], 0
        if rows:
            yield out()

    found = trusted.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "a bigint, b bigint, c bigint, n bigint")
    return materialize(found.groupBy("a", "b", "c").agg(F.sum("n").alias("n")), "trigrams")


def discounts(counts: DataFrame) -> list[float]:
    """What modified Kneser-Ney takes from counts of 1, 2 and more, from the counts of counts (clipped where a table is too small to tell)."""
    of = {r["n"]: r["k"] for r in counts.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    plain = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.4)
    return [min(max(d, 0.1), top) for d, top in zip(plain, (0.95, 1.95, 2.95), strict=True)]


def _less(n: Column, d: list[float]) -> Column:
    return F.greatest(F.lit(0.0), n - F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2]))


def _contexts(counts: DataFrame, by: list[str], d: list[float]) -> DataFrame:
    """by, kinds (rows of counts with that context), total and gamma, the weight that its discounts leave for the shorter context."""
    n = F.col("n")
    left = sum(F.count_if(c) * x for c, x in zip((n == 1, n == 2, n > 2), d, strict=True))
    return counts.groupBy(*by).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total"), (left / F.sum("n")).alias("gamma"))


def train(trusted: DataFrame) -> tuple[DataFrame, float]:
    """(key, value, n) for all n-grams of trusted texts (text), written, and the log probability of an unknown word."""
    with short_lived(trusted.sparkSession):
        return _train(trusted)


def _train(trusted: DataFrame) -> tuple[DataFrame, float]:
    tri = trigram_counts(trusted)
    n_tri = tri.count()
    if not n_tri:
        return tri.select(F.col("a").alias("key"), F.lit(0.0).alias("value"), "n"), 0.0
    d3 = discounts(tri)
    passes = range(min(PASSES, -(-n_tri // PASS_ROWS)))
    part = lambda table, word, i: table.where(F.pmod(F.xxhash64(word), F.lit(len(passes))) == i) if len(passes) > 1 else table
    whole_of = lambda tables: reduce(DataFrame.unionByName, tables)

    over3 = [materialize(_contexts(part(tri, "b", i), ["a", "b"], d3), "contexts-3") for i in passes]
    bi = [materialize(part(tri, "b", i).groupBy("b", "c").agg(F.count(F.lit(1)).alias("n")), "bigrams") for i in passes]
    n_bi, d2 = whole_of(bi).count(), discounts(whole_of(bi))
    over2 = materialize(_contexts(whole_of(bi), ["b"], d2), "contexts-2")
    uni = materialize(whole_of(bi).groupBy("c").agg(F.count(F.lit(1)).alias("n")), "words")
    d1 = discounts(uni)
    whole = _contexts(uni.withColumn("all", F.lit(0)), ["all"], d1).first()
    rest = whole["gamma"] / (whole["kinds"] + 1)  # an unknown word has the share of one
    unknown = math.log(rest)
    words = uni.withColumn("p1", _less(F.col("n"), d1) / whole["total"] + rest)

    pairs, model = [], []
    for i in passes:
        half = materialize(join_counted(bi[i], part(over2, "b", i).select("b", "kinds", "total", "gamma"), ["b"], "kinds", n_bi), "pairs")
        drop(bi[i])
        both = join_counted(half, words.select("c", "p1", F.col("n").alias("kinds")), ["c"], "kinds", n_bi)
        lower = F.col("gamma") * F.col("p1")
        pairs.append(materialize(both.select("b", "c", "n", (_less(F.col("n"), d2) / F.col("total") + lower).alias("p2"), lower.alias("lower")), "pairs"))
        drop(half)
    for i in passes:
        half = materialize(join_counted(part(tri, "b", i), over3[i], ["a", "b"], "kinds", n_tri), "triples")
        three = join_counted(half, pairs[i].select("b", "c", "p2", F.col("n").alias("kinds")), ["b", "c"], "kinds", n_tri)
        of3 = three.select(F.xxhash64("a", "b", "c").alias("key"), F.log1p(_less(F.col("n"), d3) / F.col("total") / (F.col("gamma") * F.col("p2"))).alias("value"), "n")
        model.append(materialize(of3, "model"))
        drop(half)
    drop(tri)
    for i in passes:  # a context's second word is the middle one of its trigrams
        seen = over3[i].select(F.col("a").alias("b"), F.col("b").alias("c"), F.log("gamma").alias("weight"), F.col("total").alias("times"))
        gains = part(whole_of(pairs), "c", i).select("b", "c", F.log(F.col("p2") / F.col("lower")).alias("gain"))
        of2 = gains.join(seen, ["b", "c"], "full")
        of2 = of2.select(F.xxhash64("b", "c").alias("key"), (F.coalesce("gain", F.lit(0.0)) + F.coalesce("weight", F.lit(0.0))).alias("value"), F.coalesce("times", F.lit(1)).alias("n"))
        model.append(materialize(of2, "model"))
        drop(over3[i])
    of1 = words.join(over2.select(F.col("b").alias("c"), F.log("gamma").alias("weight"), F.col("total").alias("times")), "c", "left")
    of1 = of1.select(F.xxhash64("c").alias("key"), (F.log("p1") + F.coalesce("weight", F.lit(0.0)) - unknown).alias("value"), F.coalesce("times", F.lit(1)).alias("n"))
    model.append(materialize(of1, "model"))
    drop(over2, uni, *pairs)
    return whole_of(model), unknown


class Known:
    """What tasks have of the model: the most frequent n-grams with their values, and a filter of all keys."""

    def __init__(self, key: np.ndarray, value: np.ndarray, filter_: np.ndarray):
        order = np.argsort(key)
        self.key, self.value, self.filter = key[order], value[order], filter_

    def find(self, k: np.ndarray) -> np.ndarray:
        """Places in the cache, or -1."""
        if not len(self.key):
            return np.full(len(k), -1)
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, at, -1)

    def may(self, k: np.ndarray) -> np.ndarray:
        ok = np.ones(len(k), bool)
        for p in places(k, len(self.filter)):
            ok &= (self.filter[p >> 3] >> (p & 7).astype(np.uint8)) & np.uint8(1) == 1
        return ok


def places(k: np.ndarray, n_bytes: int) -> list[np.ndarray]:
    """The two bits of each key, both in the segment that its lowest bits name."""
    bits = np.uint64(n_bytes * 8 // SEGMENTS)
    segment = (k % np.uint64(SEGMENTS)) * bits
    return [(segment + ((k >> np.uint64(s)) * _P1 >> np.uint64(20)) % bits).astype(np.int64) for s in (7, 29)]


def known(model: DataFrame, n_keys: int) -> Known:
    """The cache and the filter; the filter is made in segments, each in a task, and comes to the driver as a row for each.

    The cache takes the n-grams from a count on, and of the count below as many as fit, by ranges of key: no sort of the whole model."""
    times = F.least("n", F.lit(CACHE))
    below, room = None, CACHE
    for n, rows in sorted(model.groupBy(times.alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True):
        if rows > room:
            below = n, rows
            break
        room -= rows
    chosen = model
    if below:
        share = F.pmod("key", F.lit(1 << 30)) < int((1 << 30) * room / below[1])
        chosen = model.where((times > below[0]) | ((times == below[0]) & share))
    top = chosen.select("key", "value").limit(CACHE).toArrow()
    n_bytes = min(FILTER_BYTES, max(1, -(-n_keys * FILTER_BITS // (8 * SEGMENTS))) * SEGMENTS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> pa.RecordBatch:
            k = np.sort(np.concatenate(held))
            segment = (k % np.uint64(SEGMENTS)).astype(np.int64)
            use = np.unique(segment)
            return pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), pa.array([_pack(k[segment == s], (), ()) for s in use], pa.binary())], ["segment", "keys"])

        for b in batches:
            held.append(b.column(0).to_numpy().copy().view(np.uint64))
            rows += b.num_rows
            if rows > HELD:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        size = n_bytes // SEGMENTS
        for k in (_unpack(x.as_py(), ())[0] for b in batches for x in b.column(1)):
            for p in places(k, n_bytes):
                for s in np.unique(p // (8 * size)).tolist():
                    bits = own.setdefault(s, np.zeros(size, np.uint8))
                    q = p[p // (8 * size) == s] - 8 * size * s
                    np.bitwise_or.at(bits, q >> 3, np.left_shift(np.uint8(1), (q & 7).astype(np.uint8)))
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([x.tobytes() for x in own.values()], pa.binary())], ["segment", "bits"])

    rows = model.select("key").mapInArrow(pack, "segment int, keys binary").repartitionById(min(SEGMENTS, max(1, n_keys)), F.pmod("segment", F.lit(min(SEGMENTS, max(1, n_keys)))))
    filter_ = np.zeros(n_bytes, np.uint8)
    for r in rows.mapInArrow(fill, "segment int, bits binary").collect():
        at = r["segment"] * (n_bytes // SEGMENTS)
        filter_[at : at + n_bytes // SEGMENTS] |= np.frombuffer(r["bits"], np.uint8)
    return Known(top["key"].to_numpy().view(np.uint64), top["value"].to_numpy(), filter_)


def _shard(k: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of keys, so that what is sorted by key is sorted by shard."""
    return ((k >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


#: Kinds of the numbers that go with a key: a text and a count, or a value.
_PAIRS, _VALUES = ("<u2", "<u4"), ("<f8",)


def _pack(k: np.ndarray, others: tuple[np.ndarray, ...], kinds: tuple[str, ...]) -> bytes:
    """What is sorted by key: differences of keys and the other numbers as planes of bytes."""
    plane = lambda a, kind: a.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(plane(np.diff(k, prepend=np.uint64(0)), "<u8") + b"".join(map(plane, others, kinds)))


def _unpack(data: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    ends = np.cumsum([8, *(np.dtype(x).itemsize for x in kinds)])
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(int(ends[-1]), -1)
    k, *others = (np.ascontiguousarray(a.T).view(kind).ravel() for a, kind in zip(np.split(raw, ends[:-1]), ("<u8", *kinds), strict=True))
    return [np.cumsum(k, dtype=np.uint64), *others]


def row_key() -> Column:
    """Names a row by its doc_id (of any type) and text."""
    whole = (F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.col("text"))
    return F.struct(F.xxhash64(F.lit(1), *whole).alias("x"), F.xxhash64(F.lit(2), *whole).alias("y"))


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(key, rows, n, log_p) for every distinct row of docs (doc_id, text): repeats, events and log probability, both over all repeats."""
    spark = docs.sparkSession
    model, unknown = train(trusted)
    with short_lived(spark):
        n_keys = model.count()
        own_known = known(model, n_keys)
    shards = max(1, -(-n_keys // SHARD_KEYS))
    held = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    copies = 1 + held // (COPY_BYTES * shards)
    shared = spark.sparkContext.broadcast(own_known)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, words = shared.value, Words()
        for b in batches:
            texts, names = b.column(2).to_pylist(), np.stack([b.column(i).to_numpy(False) for i in (0, 1)])
            for i, j in slices(texts):
                tokens, own = runs(texts[i:j], words)
                size, ks, ts = j - i, [], []
                orders = keys(tokens, own)
                n = np.bincount(orders[0][1], minlength=size)
                base = unknown * n
                for k, t in orders:
                    at = have.find(k)
                    hit = at >= 0
                    base += np.bincount(t[hit], have.value[at[hit]], size)
                    k, t = k[~hit], t[~hit]
                    may = have.may(k) if len(k) else np.zeros(0, bool)
                    ks.append(k[may])
                    ts.append(t[may])
                k, t = np.concatenate(ks), np.concatenate(ts)
                order = np.lexsort((t, k))
                k, t = k[order], t[order]
                first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])])) if len(k) else np.zeros(0, np.int64)
                times = np.diff(np.concatenate([first, [len(k)]]))
                k, t = k[first], t[first]
                bounds = np.searchsorted(_shard(k, shards), np.arange(shards + 1))
                block = names[:, i:j].astype("<i8").tobytes()
                copy = int(names[0, i]) % copies
                # the first shard also carries what does not depend on the others
                use = [s for s in range(shards) if s == 0 or bounds[s] < bounds[s + 1]]
                blobs = [_pack(k[x], (t[x], times[x]), _PAIRS) for s in use for x in [slice(bounds[s], bounds[s + 1])]]
                heads = [block + (n.astype("<i8").tobytes() + base.astype("<f8").tobytes() if s == 0 else b"") for s in use]
                m = len(use)
                yield pa.RecordBatch.from_arrays([
                    pa.array([s * copies + copy for s in use], pa.int32()), pa.array([1] * m, pa.int32()), pa.array([size] * m, pa.int64()), pa.array(heads, pa.binary()), pa.array(blobs, pa.binary()),
                ], ["part", "kind", "size", "head", "blob"])

    plain = docs.select(row_key().alias("k"), F.col("text").cast("string").alias("text")).select("k.x", "k.y", "text")
    packed = "part int, kind int, size bigint, head binary, blob binary"
    sent = plain.mapInArrow(send, packed)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            k, v = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(k)
            k, v = k[order], v[order]
            bounds = np.searchsorted(_shard(k, shards), np.arange(shards + 1))
            use = np.flatnonzero(np.diff(bounds))
            blobs = pa.array([_pack(k[x], (v[x],), _VALUES) for s in use for x in [slice(bounds[s], bounds[s + 1])]], pa.binary())
            for c in range(copies):
                yield pa.RecordBatch.from_arrays([pa.array(use * copies + c, pa.int32()), pa.array(np.zeros(len(use), np.int32)), pa.array(np.diff(bounds)[use], pa.int64()), pa.array([b""] * len(use), pa.binary()), blobs], ["part", "kind", "size", "head", "blob"])

        for b in batches:
            held.append((b.column(0).to_numpy().copy().view(np.uint64), b.column(1).to_numpy().copy()))
            rows += b.num_rows
            if rows > HELD:
                yield from out()
                held, rows = [], 0
        if rows:
            yield from out()

    dealt = model.select("key", "value").mapInArrow(split, packed)
    both = dealt.unionByName(sent).repartitionById(shards * copies, "part").sortWithinPartitions("part", "kind")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, seen, value = [], np.zeros(0, np.uint64), np.zeros(0)
        for b in batches:
            kind = b.column(1).to_numpy()
            for r in range(len(kind)):
                if kind[r] == 0:
                    parts.append(_unpack(b.column(4)[r].as_py(), _VALUES))
                    continue
                if parts:
                    seen, value = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.argsort(seen)
                    seen, value, parts = seen[order], value[order], []
                head, size = b.column(3)[r].as_py(), b.column(2)[r].as_py()
                x, y = np.frombuffer(head, "<i8", size), np.frombuffer(head, "<i8", size, 8 * size)
                k, t, times = _unpack(b.column(4)[r].as_py(), _PAIRS)
                p = np.zeros(size)
                if len(seen) and len(k):
                    place = np.minimum(np.searchsorted(seen, k), len(seen) - 1)
                    hit = seen[place] == k
                    p += np.bincount(t[hit], value[place[hit]] * times[hit], size)
                events, repeats = np.zeros(size, np.int64), np.zeros(size, np.int64)
                if len(head) > 16 * size:
                    events, repeats = np.frombuffer(head, "<i8", size, 16 * size), np.ones(size, np.int64)
                    p = p + np.frombuffer(head, "<f8", size, 24 * size)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(repeats), pa.array(events), pa.array(p)], ["x", "y", "rows", "n", "log_p"])

    found = both.mapInArrow(join, "x bigint, y bigint, rows bigint, n bigint, log_p double")
    return found.groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in ("rows", "n", "log_p")]).select(F.struct("x", "y").alias("key"), "rows", "n", "log_p")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """doc_id, n_events, perplexity, kept for every row of docs (doc_id, text, lang; other columns are ignored).

    Trusted are the texts whose label has quality 1 and toxic 0. A text that is null or has no word has no perplexity and is not kept; with no trusted
    text at all everything that has words is kept. A null language, or one with fewer than MIN_TRUSTED held-out trusted texts, takes the limit of all languages together. doc_id may be
    of any type and null. Repeated rows are judged alike; a very long text is scored whole; an empty table gives no rows.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    with short_lived(docs.sparkSession):
        good = materialize(labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").alias("good")).distinct(), "trusted")
        few = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
        trusted = docs.join(few, F.col("doc_id") == F.col("good"), "left_semi").where("text is not null")
        unseen = F.pmod(F.xxhash64(F.lit("held out"), F.col("doc_id").cast("string")), F.lit(HELD_OUT)) == 0
        found = materialize(perplexities(docs.select("doc_id", "text"), trusted.where(~unseen).select("text")), "perplexities")
        found = found.select("key", F.when(F.col("n") > 0, F.exp(-F.col("log_p") / F.col("n"))).alias("perplexity"), (F.col("n") / F.col("rows")).cast("long").alias("n_events"))
        rows = materialize(docs.select("doc_id", "lang", row_key().alias("key")), "perplexity-rows")
        scored = materialize(lookup(rows, found, "key", "perplexity").select("doc_id", "lang", "n_events", "perplexity"), "scored")
        of_trusted = scored.join(few, F.col("doc_id") == F.col("good"), "left_semi").where(F.col("perplexity").isNotNull() & unseen)
        q = F.percentile_approx("perplexity", quantile, 10_000)
        limits = materialize(of_trusted.groupBy("lang").agg(q.alias("q"), F.count(F.lit(1)).alias("k")), "limits").where(f"lang is not null and k >= {MIN_TRUSTED}").select(F.col("lang").alias("l"), "q")
        every = materialize(of_trusted.agg(q.alias("every")), "limits")
    out = scored.join(limits, F.col("lang") == F.col("l"), "left").join(F.broadcast(every), F.lit(True), "left")
    limit = F.coalesce("q", "every", F.lit(math.inf)) * slack
    return out.select("doc_id", "n_events", "perplexity", F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("kept"))

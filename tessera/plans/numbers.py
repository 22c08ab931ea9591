"""Queries over single numbers and over sequences: bit operations, octahedral helpers, run lengths, trackers and bit coders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import attributes as A
from tessera.operators import bitcoding
from tessera.operators import sequences as Q
from tessera.plans import rules as R
from tessera.plans.catalogue import BITS, BLOCK, KEYS, OCT, ORDER, QUANT, RES, SEQ, _coded, octahedral_encode, query, residuals, sequence, table, values

CENTER = 511
POINT = OCT + ", d AS (SELECT vec_id, s - 511 AS s, t - 511 AS t FROM st)"
INVERT = """CASE WHEN {s} >= 0 AND {t} >= 0 THEN 1 WHEN {s} <= 0 AND {t} <= 0 THEN -1 WHEN {s} > 0 THEN 1 ELSE -1 END AS a, CASE WHEN {s} >= 0 AND {t} >= 0 THEN 1 WHEN {s} <= 0 AND {t} <= 0 THEN -1 WHEN {t} > 0 THEN 1 ELSE -1 END AS b"""


@query(f"WITH {QUANT} SELECT vec_id, c, CAST(CAST(CAST(q AS FLOAT) * CAST(span / CAST(2047 AS FLOAT) AS FLOAT) AS FLOAT) + low AS FLOAT) AS value FROM q")
def dequantize_attr(spark, d):
    q = A.quantized(values(spark, d), BITS)
    return q.select("vec_id", F.col("c").cast("long").alias("c"), S.dequantize(F.col("q"), F.col("low"), F.col("span"), BITS).alias("value"))


@query("""WITH w AS (SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS v FROM events) SELECT event_id, CAST(((v % 256 + 256) % 256 + 128) % 256 - 128 AS BIGINT) AS i8, CAST((v % 256 + 256) % 256 AS BIGINT) AS u8,
CAST(((v % 65536 + 65536) % 65536 + 32768) % 65536 - 32768 AS BIGINT) AS i16, CAST((v % 65536 + 65536) % 65536 AS BIGINT) AS u16 FROM w""")
def narrow_integers(spark, d):
    v = F.floor(F.col("value") * 1000).cast("long")
    return table(spark, d, "events").select("event_id", *[S.narrowed(v, bits, signed).cast("long").alias(f"{'i' if signed else 'u'}{bits}") for bits in (8, 16) for signed in (True, False)])


@query("SELECT o_orderkey, CAST(('0b' || reverse(lpad(bin(o_custkey), 32, '0'))) AS BIGINT) AS reversed, CAST(bit_count(o_custkey) AS BIGINT) AS ones, (o_orderkey + 1) % 3 AS axis FROM orders")
def bit_reversal(spark, d):
    k = F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", S.reverse_bits32(k).alias("reversed"), F.bit_count(k).cast("long").alias("ones"), S.increment_mod(F.col("o_orderkey"), 3).alias("axis"))


@query("""WITH w AS (SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) * o_custkey * 1000003 AS v FROM orders), r AS (SELECT *, CAST(floor(sqrt(CAST(v AS DOUBLE))) AS HUGEINT) AS r FROM w)
SELECT o_orderkey, CAST(CASE WHEN r * r > v THEN r - 1 WHEN (r + 1) * (r + 1) <= v THEN r + 1 ELSE r END AS BIGINT) AS root FROM r""")
def integer_root(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.int_sqrt(F.col("o_orderkey").cast("long") * F.col("o_custkey") * 1000003).alias("root"))


@query(f"""WITH {POINT}, q AS (SELECT *, {INVERT.format(s='s', t='t')} FROM d), xx AS (SELECT *, CASE WHEN a * b > 0 THEN -(2 * t - b * 511) ELSE 2 * t - b * 511 END AS x, CASE WHEN a * b > 0 THEN -(2 * s - a * 511) ELSE 2 * s - a * 511 END AS y FROM q)
SELECT vec_id, abs(s) + abs(t) <= 511 AS inside, (s = 0 AND t = 0) OR (s < 0 AND t <= 0) AS bottom_left, CAST(trunc((x + a * 511) / 2.0) AS BIGINT) AS s, CAST(trunc((y + b * 511) / 2.0) AS BIGINT) AS t FROM xx""")
def diamond(spark, d):
    e = octahedral_encode(spark, d)
    s, t = F.col("s") - CENTER, F.col("t") - CENTER
    x, y = S.inverted_diamond(s, t, CENTER)
    return e.select("vec_id", S.in_diamond(s, t, CENTER).alias("inside"), S.in_bottom_left(s, t).alias("bottom_left"), x.cast("long").alias("s"), y.cast("long").alias("t"))


@query("""WITH v AS (SELECT vec_id, CAST(floor(embedding[1] * 1000) AS BIGINT) AS x, CAST(floor(embedding[2] * 1000) AS BIGINT) AS y, CAST(floor(embedding[3] * 1000) AS BIGINT) AS z FROM embeddings), w AS (SELECT *, abs(x) + abs(y) + abs(z) AS l FROM v),
u AS (SELECT *, CASE WHEN l = 0 THEN 511 ELSE sign(x) * (abs(x) * 511 // l) END AS a, CASE WHEN l = 0 THEN 0 ELSE sign(y) * (abs(y) * 511 // l) END AS b FROM w)
SELECT vec_id, CAST(a AS BIGINT) AS x, CAST(b AS BIGINT) AS y, CAST(CASE WHEN l = 0 THEN 0 WHEN z < 0 THEN -(511 - abs(a) - abs(b)) ELSE 511 - abs(a) - abs(b) END AS BIGINT) AS z FROM u""")
def canonical_vectors(spark, d):
    """Components are scaled in single precision, as they are given."""
    v = [F.floor(S.f32(F.get("embedding", F.lit(i))) * F.lit(1000.0).cast("float")).cast("long") for i in range(3)]
    return table(spark, d, "embeddings").select("vec_id", *[c.cast("long").alias(n) for c, n in zip(S.canonical_vector(*v, CENTER), "xyz", strict=True)])


@query(f"""WITH {POINT}, p AS (SELECT vec_id, s, t, lag(s, 1, -511) OVER w AS ps, lag(t, 1, -511) OVER w AS pt FROM d WINDOW w AS (PARTITION BY vec_id % 16 ORDER BY vec_id)), o AS (SELECT *, abs(ps) + abs(pt) > 511 AS out, {INVERT.format(s='s', t='t')}, {INVERT.format(s='ps', t='pt').replace('AS a', 'AS pa').replace('AS b', 'AS pb')} FROM p),
i AS (SELECT vec_id, CASE WHEN out THEN CAST(trunc((CASE WHEN a * b > 0 THEN -(2 * t - b * 511) ELSE 2 * t - b * 511 END + a * 511) / 2.0) AS BIGINT) ELSE s END AS s, CASE WHEN out THEN CAST(trunc((CASE WHEN a * b > 0 THEN -(2 * s - a * 511) ELSE 2 * s - a * 511 END + b * 511) / 2.0) AS BIGINT) ELSE t END AS t,
CASE WHEN out THEN CAST(trunc((CASE WHEN pa * pb > 0 THEN -(2 * pt - pb * 511) ELSE 2 * pt - pb * 511 END + pa * 511) / 2.0) AS BIGINT) ELSE ps END AS ps, CASE WHEN out THEN CAST(trunc((CASE WHEN pa * pb > 0 THEN -(2 * ps - pa * 511) ELSE 2 * ps - pa * 511 END + pb * 511) / 2.0) AS BIGINT) ELSE pt END AS pt FROM o),
n AS (SELECT *, CASE WHEN (ps = 0 AND pt = 0) OR (ps < 0 AND pt <= 0) THEN 0 WHEN ps = 0 THEN CASE WHEN pt > 0 THEN 3 ELSE 1 END WHEN ps > 0 THEN CASE WHEN pt >= 0 THEN 2 ELSE 1 END ELSE 3 END AS n FROM i),
r AS (SELECT vec_id, CASE n WHEN 1 THEN t WHEN 2 THEN -s WHEN 3 THEN -t ELSE s END - CASE n WHEN 1 THEN pt WHEN 2 THEN -ps WHEN 3 THEN -pt ELSE ps END AS x, CASE n WHEN 1 THEN -s WHEN 2 THEN -t WHEN 3 THEN s ELSE t END - CASE n WHEN 1 THEN -ps WHEN 2 THEN -pt WHEN 3 THEN ps ELSE pt END AS y FROM n)
SELECT vec_id, CAST(CASE WHEN x < 0 THEN x + 1023 ELSE x END AS BIGINT) AS x, CAST(CASE WHEN y < 0 THEN y + 1023 ELSE y END AS BIGINT) AS y FROM r""")
def octahedral_residuals(spark, d):
    """Every sixteenth vector is of one sequence; a normal is predicted by the one before it, the first by (0, 0)."""
    w = Window.partitionBy(F.col("vec_id") % 16).orderBy("vec_id")
    e = octahedral_encode(spark, d).withColumns({"ps": F.lag("s", 1, 0).over(w), "pt": F.lag("t", 1, 0).over(w)})
    return A.octahedral_residuals(e, 10).select("vec_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query("SELECT event_type AS c, CAST(min(floor(value * 100)) AS BIGINT) AS low, CAST(max(floor(value * 100)) - min(floor(value * 100)) AS BIGINT) AS most FROM events GROUP BY event_type")
def signed_minimum(spark, d):
    return A.signed_low(table(spark, d, "events").select(F.col("event_type").alias("c"), F.floor(F.col("value") * 100).alias("v")))


@query("""WITH w AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS k FROM events GROUP BY event_type)
SELECT event_type, CAST(floor(CASE WHEN k = 0 OR k = n THEN 0 ELSE round(-(k / n::DOUBLE) * log2(k / n::DOUBLE) - (1 - k / n::DOUBLE) * log2(1 - k / n::DOUBLE), 9) END * 1000000) AS BIGINT) AS micro FROM w""")
def binary_entropy(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_id") % 3 == 0).alias("k"))
    return n.select("event_type", F.floor(F.round(S.binary_entropy(F.col("k"), F.col("n")), 9) * 1000000).alias("micro"))


@query(f"""WITH {RES}, k AS (SELECT user_id, ts, event_id, u % 16 AS u, (row_number() OVER (PARTITION BY user_id, u % 16 ORDER BY ts, event_id) - 1)::DOUBLE AS k, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::DOUBLE AS n FROM z),
g AS (SELECT *, CAST(round((k + 1) * log2(k + 1) - CASE WHEN k > 0 THEN k * log2(k) ELSE 0 END, 9) AS DECIMAL(30, 9)) AS gain FROM k)
SELECT event_id, CAST(ceil(round(n * log2(n) - CAST(sum(gain) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE), 5)) AS BIGINT) AS bits FROM g""")
def tracker_bits(spark, d):
    u = residuals(spark, d).withColumn("symbol", F.col("u") % 16)
    return Q.tracker(u, KEYS, ORDER, "symbol").select("event_id", "bits")


@query(f"""WITH {SEQ}, b AS (SELECT user_id, v % 3 AS z, CAST(sum(CASE WHEN v % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM s)
SELECT user_id, run, count(*) AS zeros, CAST(ceil(count(*) / 64.0) AS BIGINT) AS tokens FROM b WHERE z = 0 GROUP BY ALL""")
def zero_runs(spark, d):
    return Q.zero_runs(sequence(spark, d), KEYS, ORDER, F.col("v") % 3)


@query(f"WITH {SEQ} SELECT event_id, (v % 2 = 0) = coalesce(lag(v % 2 = 0) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS same FROM s")
def orientation_runs(spark, d):
    return Q.same_as_last(sequence(spark, d), KEYS, ORDER, F.col("v") % 2 == 0).select("event_id", "same")


@query(f"WITH {SEQ} SELECT event_id, v AS back FROM s WHERE v >= 0")
def index_delta_decode(spark, d):
    r = Q.delta(sequence(spark, d).where("v >= 0"), KEYS, ORDER)
    u = r.withColumn("u", F.when(F.col("r") < 0, -2 * F.col("r") + 1).otherwise(2 * F.col("r")))
    return Q.signed_index_decode(u, KEYS, ORDER).select("event_id", F.col("back").cast("long").alias("back"))


@query("SELECT event_type, median(value) AS median FROM events GROUP BY event_type")
def batch_medians(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.median("value").alias("median"))


@query(f"WITH {RES}, h AS (SELECT user_id, u % 64 AS symbol, count(*) AS n FROM z GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n, symbol) AS place FROM h")
def symbols_by_probability(spark, d):
    n = residuals(spark, d).groupBy("user_id", (F.col("u") % 64).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("n", "symbol")).cast("long"))


@query(f"WITH {QUANT}, k AS (SELECT vec_id, c // 3 AS chunk, max(q) AS most FROM q GROUP BY ALL) SELECT vec_id, chunk, CASE WHEN most = 0 THEN 1 ELSE length(bin(most)) END AS bits FROM k")
def chunk_bit_lengths(spark, d):
    q = A.quantized_arrays(table(spark, d, "embeddings"), "embedding", BITS)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("q") - 1) / 3).cast("int")), lambda i: F.struct(i.cast("long").alias("chunk"), F.array_max(F.slice("q", i * 3 + 1, 3)).alias("most")))
    return q.select("vec_id", F.inline(chunks)).select("vec_id", "chunk", F.greatest(F.lit(1), S.bit_length(F.col("most"))).cast("long").alias("bits"))


@query("""SELECT i // 10 AS major, i % 10 AS minor, (i // 10, i % 10) >= (2, 0) AS varint_counts, (i // 10, i % 10) >= (1, 3) AS varint_ids, (i // 10, i % 10) >= (1, 3) AS flags, (i // 10, i % 10) >= (2, 2) AS varint_sizes, i IN (22, 23, 13) AS written FROM range(10, 24) t(i)""")
def version_rules(spark, d):
    major, minor = F.floor(F.col("id") / 10), F.col("id") % 10
    return spark.range(10, 24).select(major.alias("major"), minor.alias("minor"), *[R.at_least(major, minor, *v).alias(n) for n, v in (("varint_counts", (2, 0)), ("varint_ids", (1, 3)), ("flags", (1, 3)), ("varint_sizes", (2, 2)))], F.col("id").isin(22, 23, 13).alias("written"))


@query(f"WITH b AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // {BLOCK} AS block FROM events) SELECT user_id, block, count(*) AS n, true AS same FROM b GROUP BY ALL")
def bit_coders_roundtrip(spark, d):
    """Bits under one probability, plain, and folded by place, each back as they were."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    blocks = residuals(spark, d).withColumn("block", F.floor((F.row_number().over(own) - 1) / BLOCK))
    rows = blocks.groupBy(F.struct("user_id", "block").alias("at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "u"))), lambda x: x["u"]).alias("symbols"))

    def same(x: list) -> bool:
        bits, low = [v & 1 for v in x], [v & 1023 for v in x]
        one, plain, folded = bitcoding.BitReader(bitcoding.Reader(bitcoding.encode_bits(bits))), bitcoding.DirectReader(bitcoding.Reader(bitcoding.direct_bytes(bits))), bitcoding.FoldedWriter()
        for v in low:
            folded.put(v, 10)
        back = bitcoding.FoldedReader(bitcoding.Reader(folded.bytes((2, 2))))
        return [one.bit() for _ in bits] == bits and [plain.bit() for _ in bits] == bits and [back.bits(10) for _ in low] == low

    return _coded(rows, "symbols", "at", same).select("at.user_id", "at.block", "n", "same")


@query(f"WITH {RES}, h AS (SELECT user_id, u % 300 AS symbol, count(*) AS n FROM z GROUP BY ALL) SELECT user_id, count(*) AS n, true AS same FROM h GROUP BY user_id")
def normalised_shares(spark, d):
    """Counts scaled to fill a table, nothing below 1; with few and with many symbols for the table, so that rounding leaves too little and takes too much."""
    n = residuals(spark, d).groupBy("user_id", (F.col("u") % 300).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    rows = n.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("symbol", "n"))), lambda x: x["n"]).alias("counts"))

    def same(x: list) -> bool:
        return all(sum(p) == 1 << k and min(p) >= 1 for k in (9, 12) for p in [bitcoding.shares(x, k)])

    return _coded(rows, "counts", "user_id", same)

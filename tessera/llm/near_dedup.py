"""Near-duplicate components by an inverted join over MinHash signature coordinates.

1. A text's set is its distinct shingles of five words (lower-cased A-Z); texts with equal sets form one class, represented by its digest,
   set size and a signature of K coordinates.
2. A class is posted under its (coordinate, value) tokens. Two classes that agree in M of K coordinates or more share a token
   among the K - M + 1 rarest of each (rarest over the whole table: tokens of one class only come first). A class with fewer than M shared tokens is
   left out at once; the others post their rarest alone. Passages that many documents share are frequent tokens, and frequent tokens end
   outside the prefix: that is what keeps lists of unrelated classes short.
3. Collisions are counted on the signatures; pairs below M, or of sizes that rule out the threshold, end there.
4. What is left is confirmed on the full sets, recomputed from the texts. First every class meets the head of each of its lists only: the class with the longest lists, which
   is the one that most copies resemble. Components are taken, and in ROUNDS further rounds every list that still has several meets a head from outside its main
   component. Then all pairs of a list that still lie in different components are compared, each at the first token that they share, by sketches of BITS bits (one of
   each of as many further coordinates), which tell a similarity of 0.7 from one of 0.75; those at most MAX_BITS_APART apart are confirmed. A list within one component has
   nothing more to say about components, so no pair that could join two components is left out, and a large group of copies is not expanded into its pairs.

A pair at the threshold of 0.75 agrees in fewer than M = 13 of K = 32 coordinates with a probability of about 2e-5, and differs in more than 324 of 2048 bits with one of about 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.llm.common import join_counted, lookup, materialize
from tessera.llm.components import components

SHINGLE = 5
K, M = 32, 13
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Rows compared with one head in one task.
SALT_ROWS = 2_000
#: Words whose hashes a task remembers.
MEMO = 200_000
#: Characters of texts that are held as Python objects at a time; members of a list that are compared in one block.
SLICE, BLOCK = 4_000_000, 500
BITS, MAX_BITS_APART, MAX_BITS_APART_FIRST, ROUNDS = 2048, 324, 58, 1

BRIEF = K // 8
_BRIEF = [f"b{i}" for i in range(BRIEF)]
_ODD = np.random.RandomState(5).randint(0, 2**63, SHINGLE + 2 * K + BITS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(text: str | None, memo: _Hashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; empty without words. memo remembers words for the length of a task."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map((_Hashes() if memo is None else memo).__getitem__, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    s = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        s += h[k : k + n] * _ODD[k]
    return np.unique(_mixed(s))


def signature(hashes: np.ndarray) -> list[int] | None:
    if not len(hashes):
        return None
    return [int(((hashes ^ _ODD[SHINGLE + k]) * _ODD[SHINGLE + K + k]).min() & np.uint64(0x7FFFFFFF)) for k in range(K)]


def sketch(hashes: np.ndarray) -> list[int] | None:
    """One bit of the least of each of BITS further hashes, as longs."""
    if not len(hashes):
        return None
    least = np.full(BITS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 64):
        least = np.minimum(least, (hashes[i : i + 64, None] * _ODD[None, SHINGLE + 2 * K :]).min(0))
    return np.packbits(((least >> np.uint64(21)) & np.uint64(1)).astype(np.uint8)).view("<i8").tolist()


def brief(sig: list[int]) -> list[int]:
    """The lowest eight bits of each coordinate, as longs: what agreement is counted on."""
    return np.array(sig, np.int64).astype(np.uint8).view("<i8").tolist()


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """batch in parts of about SLICE characters of its text column, so that few texts are Python objects at a time."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE, "right")))
        yield batch.slice(start, end - start)
        start = end


def digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), node (digest; null for an empty set), sig and its brief b0 to b3 of every row of docs (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for whole in batches:
            for b in slices(whole, 1):
                n, node, sig = [], [], []
                for t in b.column(1):
                    h = shingle_hashes(t.as_py(), memo)
                    n.append(len(h))
                    node.append(digest(h) if len(h) else None)
                    sig.append(signature(h))
                short = zip(*((None,) * BRIEF if x is None else brief(x) for x in sig), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.list_(pa.int32())), *[pa.array(x, pa.int64()) for x in short]], ["doc_id", "n", "node", "sig", *_BRIEF])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, node binary, sig array<int>, {', '.join(f'{c} bigint' for c in _BRIEF)}")


def lists(classes: DataFrame) -> DataFrame:
    """(token, node, rank) for the prefix of each class, tokens of at least two classes, and as rank a struct that is greatest for the class with the
    longest lists and then the smallest doc_id; with order, what places the token in a prefix."""
    posts = classes.select("node", "first", F.posexplode("sig").alias("k", "value")).select("node", "first", F.col("k").cast("long").bitwiseOR(F.shiftleft(F.col("value").cast("long"), 8)).alias("token"))
    shared = materialize(posts.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "tokens")
    found = join_counted(posts, shared.withColumn("rows", F.col("size")), ["token"], "rows", K * classes.count())
    own = Window.partitionBy("node")
    found = found.withColumns({"q": F.count(F.lit(1)).over(own), "weight": F.sum("size").over(own)})
    found = found.where(F.col("q") >= M).withColumn("place", F.row_number().over(own.orderBy("size", "token"))).where(F.col("place") <= F.col("q") - (M - 1))
    return found.select("token", "node", F.struct("weight", (-F.col("first")).alias("first"), "node").alias("rank"), F.struct("size", "token").alias("order"))


def sketches(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, bits) for nodes (node, first), from the texts of docs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for b in (x for whole in batches for x in slices(whole, 1)):
            found = [(node, sketch(h)) for node, text in zip(*(c.to_pylist() for c in b.columns), strict=True) if digest(h := shingle_hashes(text, memo)) == node]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["node", "bits"])

    texts = docs.join(nodes.withColumnRenamed("first", "doc_id"), "doc_id").select("node", "text")
    return texts.mapInArrow(run, "node binary, bits array<bigint>").dropDuplicates(["node"])


def _sizes(a: str, b: str):
    return 100 * F.least(f"{a}_n", f"{b}_n") >= PERCENT * F.greatest(f"{a}_n", f"{b}_n")


def _agree(a: str, b: str):
    """Equal bytes of the briefs, a few more than coordinates agree: in each byte of a difference all bits are folded into the lowest."""
    def unequal(x):
        for by in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return sum(unequal(F.col(f"{a}_{c}").bitwiseXOR(F.col(f"{b}_{c}"))) for c in _BRIEF) <= K - M


def _close(a: str, b: str):
    """Few enough bits apart; an eighth of them, with a wider margin, ends most comparisons early."""
    apart = [F.bit_count(F.get(f"{a}_bits", F.lit(i)).bitwiseXOR(F.get(f"{b}_bits", F.lit(i)))) for i in range(BITS // 64)]
    return (sum(apart[: BITS // 512]) <= MAX_BITS_APART_FIRST) & (sum(apart) <= MAX_BITS_APART)


def _named(classes: DataFrame, a: str) -> DataFrame:
    return classes.select(F.col("node").alias(a), F.col("n").alias(f"{a}_n"), F.col("first").alias(f"{a}_first"), *[F.col(c).alias(f"{a}_{c}") for c in _BRIEF])


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The (u, v) of pairs whose full sets meet the threshold. Rows with a common v are compared with v's set in
    slices of about SALT_ROWS, the text of v being sent to each slice."""
    near = pairs.join(_named(classes, "u"), "u").join(_named(classes, "v"), "v").where(_sizes("u", "v") & _agree("u", "v"))
    near = materialize(near.select("u", "u_first", "v", "v_first"), "candidates")
    heads = near.groupBy("v", "v_first").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("slices"))
    salt = F.pmod(F.xxhash64("u"), F.col("slices")).cast("int")
    rows = near.join(heads.select("v", "slices"), "v").select(F.col("u_first").alias("doc_id"), "v", salt.alias("slice"), F.col("u").alias("node"), F.lit(False).alias("head"))
    rows = rows.unionByName(heads.select(F.col("v_first").alias("doc_id"), "v", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("v").alias("node"), F.lit(True).alias("head")))
    rows = rows.join(docs.select("doc_id", "text"), "doc_id").select("v", "slice", "head", "node", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "v", "slice").sortWithinPartitions("v", "slice", F.desc("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, memo = None, np.zeros(0, np.uint64), _Hashes()
        for b in (x for whole in batches for x in slices(whole, 4)):
            us, vs = [], []
            for v, piece, head, node, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (v, piece) == at and head:
                    continue
                h = shingle_hashes(text, memo)
                if digest(h) != node:  # another row with the same doc_id
                    continue
                if head:
                    at, own = (v, piece), h
                elif (v, piece) == at:
                    both = np.intersect1d(own, h, True).size
                    if 100 * both >= PERCENT * (len(own) + len(h) - both):
                        us.append(node)
                        vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])

    return rows.mapInArrow(run, "u binary, v binary")


def _open(links: DataFrame, posts: DataFrame) -> DataFrame:
    """posts of the lists that hold several components so far, with root and main (whether root is the largest of the list)."""
    tied = posts.join(components(links).withColumnRenamed("root", "r"), "node", "left").withColumn("root", F.coalesce("r", "node")).drop("r")
    tied = materialize(tied, "tied")
    main = tied.groupBy("token", "root").count().groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.count(F.lit(1)).alias("roots"), F.sum("count").alias("rows"))
    main = materialize(main.where("roots > 1").drop("roots"), "main")
    return materialize(join_counted(tied, main, ["token"], "rows", tied.count()).select(*posts.columns, "root", (F.col("root") == F.col("largest")).alias("main")), "open")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id that can be reached over links. A text that is null or has no word has an empty set and is its
    own component. A row without a doc_id counts in no component: component_id is null and kept true. Rows that repeat a doc_id are judged each by their own text. An empty table gives no rows.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    written = materialize(signatures(docs), "signatures")
    rows = written.select("doc_id", "n", "node")
    full = written.where("node is not null and doc_id is not null")
    classes = materialize(full.groupBy("node").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "sig", *_BRIEF)]), "classes")
    posts = materialize(lists(classes), "lists")
    heads = posts.groupBy("token").agg(F.max("rank").alias("h"), F.count(F.lit(1)).alias("size")).where("size > 1")
    stars = join_counted(posts, materialize(heads, "heads"), ["token"], "size", posts.count()).where("node <> h.node").select(F.col("node").alias("u"), F.col("h.node").alias("v")).distinct()
    links = materialize(confirm(stars, classes, docs), "links")
    for _ in range(ROUNDS):
        tied = _open(links, posts)
        heads = tied.groupBy("token").agg(F.max_by(F.struct("node", "root"), F.when(~F.col("main"), F.col("rank"))).alias("h"), F.count(F.lit(1)).alias("size")).where("h is not null")
        stars = join_counted(tied, materialize(heads, "heads"), ["token"], "size", tied.count()).where("root <> h.root").select(F.col("node").alias("u"), F.col("h.node").alias("v")).distinct()
        links = materialize(links.unionByName(confirm(stars, classes, docs)), "links")

    tied = _open(links, posts)
    prefixes = tied.select("node").distinct().join(posts, "node").groupBy("node").agg(F.transform(F.array_sort(F.collect_list("order")), lambda o: o["token"]).alias("prefix"))
    facts = prefixes.join(classes.select("node", "first", "n"), "node")
    facts = materialize(facts.join(sketches(facts.select("node", "first"), docs), "node").drop("first"), "facts")
    def side(rows: DataFrame, a: str) -> DataFrame:
        return rows.join(facts, "node").select(F.col("token").alias(f"{a}_token"), *[F.col(c).alias(f"{a}_{c}") for c in ("node", "root", "main", "prefix", "n", "bits")])

    apart = (F.col("u_root") != F.col("v_root")) & (F.col("v_main") | (F.col("u_node") < F.col("v_node")))
    # a long list is cut into blocks, and every pair of blocks is a key of its own
    sizes = tied.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("size"))
    dealt = join_counted(tied, materialize(sizes, "sizes"), ["token"], "size", tied.count()).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    us = side(dealt.where("not main").withColumn("token", F.explode(F.transform(every, lambda j: F.struct("token", F.col("own").alias("i"), j.alias("j"))))), "u")
    vs = side(dealt.withColumn("token", F.explode(F.transform(every, lambda i: F.struct("token", i.alias("i"), F.col("own").alias("j"))))), "v")
    once = F.get(F.array_intersect("u_prefix", "v_prefix"), F.lit(0)) == F.col("u_token.token")
    across = us.join(vs, (F.col("u_token") == F.col("v_token")) & apart & _sizes("u", "v") & _close("u", "v") & once)
    more = confirm(across.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")).distinct(), classes, docs)
    links = materialize(links.unionByName(more), "links")

    comps = components(links).join(classes.select("node", "first"), "node")
    least = comps.groupBy("root").agg(F.min("first").alias("least"))
    of_class = classes.select("node", "first").join(comps.select("node", "root"), "node", "left").join(least, "root", "left").select("node", F.coalesce("least", "first").alias("component"))
    out = lookup(rows, materialize(of_class, "components"), "node", "rows")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with the columns of docs. Where rows repeat a doc_id, one row of it
    stays if any is kept (the one whose text has the least hash); rows without a doc_id stay. Columns may have any name."""
    found = materialize(near_duplicates(docs), "near-duplicates")
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    kept = ids.where("kept and rows = 1").select("doc_id")
    out = docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    several = materialize(ids.where("kept and rows > 1").select("doc_id"), "repeated")
    if several.isEmpty():
        return out
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("id", F.col("row.doc_id")).join(several.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    first = own.groupBy("id").agg(F.min_by("row", F.xxhash64("row.text")).alias("row"))
    return out.unionByName(first.select(*[F.col(f"row.`{c}`") for c in docs.columns]))

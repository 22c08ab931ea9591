"""Mixing of sources to target weights by hash-random keys and distributed prefix sums.

Every row gets a key that is a hash of its doc_id, size and text, so that rows with one doc_id (or none) have keys of their own. Within a source, rows in the order of that key are dealt to
range buckets (key ranges of equal width, as the keys are uniform), bucket totals are summed, and the prefix of a row is
the total of the buckets before it plus a running sum inside its own bucket; the totals themselves are summed in two levels, runs of buckets first. A source of any size is therefore
spread over as many tasks as it has buckets. Each source is cut at its exact budget: whole epochs of every document,
then the documents at the front of the order, the last of them in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, n_words

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source gives more than this many times its own size.
MAX_EPOCHS = 3
#: Documents aimed at in one range bucket.
BUCKET_ROWS = 2_000
#: Buckets in a run.
RUN = 4_096


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, source_rows) -> the same with target.

    All targets add up to the total size. A source is held to max_epochs times its size and what exceeds that is shared
    again by weight until no source is above: with the sources in the order of cap / weight, the level is
    (total - caps of the first k) / (weights of the others) for the least k whose next source stays within its cap.
    One row per source goes through the window, never a document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ranked.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(from_here))
    level = level.withColumn("k", F.row_number().over(by_ratio))
    level = level.withColumn("level", F.min_by("level", F.when(F.col("ratio") >= F.col("level"), F.col("k"))).over(everything))
    return level.select("source", "source_size", "source_rows", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, bucket_rows: int = BUCKET_ROWS, size: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs (doc_id, text, source; more columns are ignored).

    A null or empty text has size 0 and takes 0; a null source is a source of its own, the last in order; a null
    doc_id is ordered like any other value; rows that are equal in doc_id are ordered by their key and then by size and text, and equal rows stand side by side, so that
    reruns agree. Texts of any length are counted whole. Columns of any name may follow, as only three are read. An empty table gives no rows.
    """
    sized = materialize(docs.select("doc_id", "source", (n_words(F.col("text")) if size is None else size).alias("size"), F.xxhash64(F.lit("mix"), "text").alias("of_text")), "mix-sizes")
    sized = sized.withColumn("key", F.xxhash64(F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), "size", "of_text"))
    totals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")), weights, max_epochs)
    totals = materialize(totals, "mix-targets").withColumnRenamed("source", "s")
    rows = sized.join(totals, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    n_buckets = F.ceil(F.col("source_rows") / F.lit(float(bucket_rows)))
    unit = (F.shiftrightunsigned(F.col("key"), 11).cast("double")) / F.lit(float(2**53))
    rows = rows.withColumn("bucket", F.least(F.floor(unit * n_buckets), n_buckets - 1)).withColumn("unit", unit)
    source = F.struct(F.col("source"))
    sums = rows.groupBy(source.alias("s"), F.col("bucket").alias("b")).agg(F.sum("size").alias("in_bucket"))
    sums = materialize(sums.withColumn("run", F.floor(F.col("b") / RUN)), "mix-buckets")
    before = lambda *keys: F.coalesce(F.sum("in_bucket").over(Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sums.groupBy("s", F.col("run").alias("b")).agg(F.sum("in_bucket").alias("in_bucket"))
    runs = runs.select(F.col("s").alias("of"), F.col("b").alias("run_"), before("s").alias("run_base"))
    sums = sums.withColumn("inner_base", before("s", "run")).join(runs, F.col("s").eqNullSafe(F.col("of")) & (F.col("run") == F.col("run_")))
    sums = sums.select("s", "b", (F.col("run_base") + F.col("inner_base")).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("unit", "doc_id", "size", "of_text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, source.eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    budget = F.floor(F.col("target") + F.lit(1e-6))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size") - F.col("base") - F.col("inner")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))

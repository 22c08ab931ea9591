"""Ordered integer sequences: differences, their inverse, symbol statistics. A sequence is (keys, order, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S


def delta(df: DataFrame, keys: list[str], order: list[str], v: str = "v") -> DataFrame:
    """df with r, the difference to the value before (0 before the first)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("r", F.col(v) - F.coalesce(F.lag(v).over(w), F.lit(0)))


def undelta(df: DataFrame, keys: list[str], order: list[str], r: str = "r") -> DataFrame:
    """df with back, the values that the differences came from."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("back", F.sum(r).over(w))


def wrapped_delta(df: DataFrame, keys: list[str], order: list[str], v: str = "v") -> DataFrame:
    """df with low, high (by sequence) and r, differences brought into the values' width; the first is taken to a clamped 0."""
    whole = Window.partitionBy(*keys)
    d = df.withColumns({"low": F.min(v).over(whole), "high": F.max(v).over(whole)})
    before = F.lag(v).over(Window.partitionBy(*keys).orderBy(*order))
    start = F.least(F.greatest(F.lit(0), F.col("low")), F.col("high"))
    return d.withColumn("r", S.wrapped(F.col(v) - F.coalesce(before, start), F.col("low"), F.col("high")))


def unwrapped_delta(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The inverse in closed form: the running sum, modulo the width."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.least(F.greatest(F.lit(0), F.col("low")), F.col("high"))
    return df.withColumn("back", F.col("low") + F.pmod(start + F.sum("r").over(w) - F.col("low"), 1 + F.col("high") - F.col("low")))


def frequencies(df: DataFrame, symbol: Column) -> DataFrame:
    return df.groupBy(symbol.cast("long").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


def entropy(freq: DataFrame) -> DataFrame:
    """Symbols, distinct symbols, and the bits of an ideal coder: floor and ceiling of the sum, rounded before to six places."""
    total = freq.agg(F.sum("n").alias("total"))
    t = freq.crossJoin(F.broadcast(total))
    n, all_ = F.col("n").cast("double"), F.col("total").cast("double")
    bits = F.round(F.sum(n * (F.log2(all_) - F.log2(n))), 6)
    return t.groupBy("total").agg(F.count(F.lit(1)).alias("distinct_symbols"), F.floor(bits).alias("bits_floor"), F.ceil(bits).alias("bits_ceil"))


def coder_table(freq: DataFrame, precision: int, run: int = 1024) -> DataFrame:
    """Probabilities of a coder table by rounding (1 at least) and where each symbol begins. Prefix sums in two levels, runs of run symbols first, so that no task sees all symbols."""
    total = F.broadcast(freq.agg(F.sum("n").cast("double").alias("t")))
    p = F.greatest(F.lit(1), F.floor(F.col("n").cast("double") / F.col("t") * (1 << precision) + 0.5)).cast("long")
    d = freq.crossJoin(total).select("symbol", "n", p.alias("p"), F.floor(F.col("symbol") / run).alias("run"))
    runs = d.groupBy("run").agg(F.sum("p").alias("sum"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"base": F.coalesce(F.sum("sum").over(before(Window.orderBy("run"))), F.lit(0)), "all": F.sum("sum").over(Window.partitionBy())})
    inner = F.coalesce(F.sum("p").over(before(Window.partitionBy("run").orderBy("symbol"))), F.lit(0))
    return d.withColumn("inner", inner).join(runs, "run").select("symbol", "n", "p", (F.col("base") + F.col("inner")).alias("starts"), (F.col("all") - (1 << precision)).alias("surplus"))


def zero_runs(df: DataFrame, keys: list[str], order: list[str], v: Column, most: int = 64) -> DataFrame:
    """(keys, run, zeros, tokens): maximal runs of zeros, and the tokens of at most most zeros that they take."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.select(*keys, *order, (v != 0).cast("int").alias("break"))
    d = d.withColumn("run", F.sum("break").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("break") == 0)
    return d.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("zeros")).withColumn("tokens", F.ceil(F.col("zeros") / most).cast("long"))


def same_as_last(df: DataFrame, keys: list[str], order: list[str], bit: Column) -> DataFrame:
    """df with same: whether a bit equals the one before it (true before the first)."""
    d = df.withColumn("bit", bit)
    return d.withColumn("same", F.col("bit") == F.coalesce(F.lag("bit").over(Window.partitionBy(*keys).orderBy(*order)), F.lit(True)))


def signed_index_decode(df: DataFrame, keys: list[str], order: list[str], u: str = "u") -> DataFrame:
    """df with back: the running sum of differences whose sign is the lowest bit; a sum below 0 is an error."""
    step = F.when(F.col(u) % 2 == 1, -F.floor(F.col(u) / 2)).otherwise(F.floor(F.col(u) / 2))
    total = F.sum(step).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("back", total).withColumn("back", F.when(F.col("back") < 0, F.raise_error(F.lit("an index below 0")).cast("long")).otherwise(F.col("back")))


def tracker(df: DataFrame, keys: list[str], order: list[str], symbol: str) -> DataFrame:
    """df with bits: after each symbol, what an ideal coder of all symbols so far of its key takes. A symbol that has come k times before adds (k + 1) log2(k + 1) - k log2 k to the sum."""
    own = Window.partitionBy(*keys, symbol).orderBy(*order)
    all_ = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    xlog = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    k = (F.row_number().over(own) - 1).cast("double")
    d = df.withColumn("gain", F.round(xlog(k + 1) - xlog(k), 9).cast("decimal(30,9)"))
    n = F.count(F.lit(1)).over(all_).cast("double")
    return d.withColumn("bits", F.ceil(F.round(xlog(n) - F.sum("gain").over(all_).cast("double"), 5))).drop("gain")


def coding_choice(df: DataFrame, keys: list[str], symbol: Column) -> DataFrame:
    """By chunk size one: bits of the tagged scheme (each length coded, then raw bits) and of the raw one (symbols coded), and the choice."""
    u = df.select(symbol.alias("u")).withColumn("len", F.greatest(F.lit(1), S.bit_length(F.col("u"))))
    by_value, by_length = u.groupBy("u").count(), u.groupBy("len").count()

    def of(freq: DataFrame, what: str) -> DataFrame:
        total = F.broadcast(freq.agg(F.sum("count").alias("t")))
        n, t = F.col("count").cast("double"), F.col("t").cast("double")
        d = freq.crossJoin(total)
        return d.agg(F.floor(F.round(F.sum(n * (F.log2(t) - F.log2(n))), 6)).alias("entropy"), F.count(F.lit(1)).alias("unique"), F.max(what).alias("most"), F.sum(F.col("count") * F.col(what)).alias("sum"))

    lengths = of(by_length, "len").select((F.col("sum") + F.col("entropy") + S.table_bits(F.col("unique"), F.col("unique"))).alias("tagged_bits"), F.col("most").alias("most_bits"))
    values = of(by_value, "u").select((F.col("entropy") + S.table_bits(F.col("most"), F.col("unique"))).alias("raw_bits"))
    both = lengths.crossJoin(values)
    return both.withColumn("scheme", F.when((F.col("most_bits") > 18) | (F.col("tagged_bits") < F.col("raw_bits")), "tagged").otherwise("raw"))

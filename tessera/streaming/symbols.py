"""Symbol statistics over a stream: counts by event-time window, from which a tracker's bits follow at any time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_frequencies(stream: DataFrame, ts: str, symbol: Column, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, symbol, n). Rows later than late are left out, and the state of a window goes when it is that old."""
    w = F.window("ts", window)
    d = stream.withColumnRenamed(ts, "ts") if ts != "ts" else stream
    return d.withWatermark("ts", late).groupBy(w.alias("w"), symbol.alias("symbol")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "symbol", "n")


def tracker_bits(frequencies: DataFrame) -> DataFrame:
    """(start, bits): ceil(N log2 N - sum n log2 n) of each window of a table of such counts."""
    total = F.sum("n").cast("double")
    own = F.col("n").cast("double")
    bits = F.round(total * F.log2(total) - F.sum(own * F.log2(own)), 6)
    return frequencies.groupBy("start").agg(F.ceil(bits).alias("bits"))

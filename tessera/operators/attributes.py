"""Attribute columns in long form: (mesh, point, component, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S


def components(df: DataFrame, key: str, array: str) -> DataFrame:
    """(key, c, v): one row for each component of an array column."""
    return df.select(key, F.posexplode(array).alias("c", "v"))


def bounds(values: DataFrame) -> DataFrame:
    """c, low, high, span of (c, v)."""
    return values.groupBy("c").agg(F.min("v").alias("low"), F.max("v").alias("high")).withColumn("span", F.col("high") - F.col("low"))


def common_range(values: DataFrame) -> DataFrame:
    """c, low and the one span that all components share (the widest; 1 if that is 0). One row a component, so one window. A value that is not finite is refused with an error."""
    odd = F.bool_or(F.isnan("v") | (F.abs("v") == F.lit(float("inf"))))
    b = values.groupBy("c").agg(F.min("v").alias("low"), F.max("v").alias("high"), odd.alias("odd"))
    low = F.when(F.col("odd"), F.raise_error(F.lit("a value that is not finite")).cast("float")).otherwise(F.col("low"))
    b = b.select("c", low.alias("low"), (F.col("high") - F.col("low")).alias("span"))
    span = F.max("span").over(Window.partitionBy())
    return b.select("c", "low", F.when(span == 0, F.lit(1.0).cast("float")).otherwise(span).alias("span"))


def nonfinite(values: DataFrame) -> DataFrame:
    """Whether any value is NaN or infinite, by component: such an attribute is refused."""
    return values.groupBy("c").agg(F.bool_or(F.isnan("v") | (F.abs("v") == F.lit(float("inf")))).alias("refused"), F.count(F.lit(1)).alias("n"))


def quantized(values: DataFrame, bits: int) -> DataFrame:
    """values with q. The parameters are one row a component and are broadcast."""
    params = F.broadcast(common_range(values))
    return values.join(params, "c").withColumn("q", S.quantize(F.col("v"), F.col("low"), F.col("span"), bits))


def round_trip_error(values: DataFrame, bits: int) -> DataFrame:
    """By component, whether no value moved by more than half a step and the rounding of single precision."""
    back = quantized(values, bits).withColumn("r", S.dequantize(F.col("q"), F.col("low"), F.col("span"), bits))
    worst = F.max(F.abs(F.col("v").cast("double") - F.col("r").cast("double")) / F.col("span").cast("double"))
    return back.groupBy("c").agg((worst <= 0.51 / ((1 << bits) - 1)).alias("within"))


def cells(df: DataFrame, array: str, bits: int, levels: int, axes: int) -> DataFrame:
    """Points in each cell of a regular tree after so many levels: a cell is the upper bits of the first axes components. Each row's array is quantized where it is: only counts are shuffled."""
    at = lambda i: F.get(array, F.lit(i))
    b = df.agg(*[f(at(i)).alias(f"{n}_{i}") for i in range(axes) for n, f in (("low", F.min), ("high", F.max))])
    span = F.greatest(*[F.col(f"high_{i}") - F.col(f"low_{i}") for i in range(axes)])
    b = b.select(*[F.col(f"low_{i}") for i in range(axes)], F.when(span == 0, F.lit(1.0).cast("float")).otherwise(span).alias("span"))
    cell = F.lit(0).cast("long")
    for i in range(axes):
        cell = cell * (1 << levels) + F.shiftright(S.quantize(at(i), F.col(f"low_{i}"), F.col("span"), bits), bits - levels)
    return df.crossJoin(F.broadcast(b)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("points"))


def quantized_arrays(df: DataFrame, array: str, bits: int) -> DataFrame:
    """df with q, the array's components quantized with the least value of each and one range for all. The parameters are one row, which is broadcast. Arrays of one length."""
    values = df.select(F.posexplode(array).alias("c", "v"))
    params = F.broadcast(common_range(values).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "low"))), lambda x: x["low"]).alias("lows"), F.max("span").alias("span")))
    q = F.transform(array, lambda v, i: S.quantize(v, F.get("lows", i), F.col("span"), bits))
    return df.crossJoin(params).withColumn("q", q).drop("lows", "span")


def signed_low(values: DataFrame) -> DataFrame:
    """(c, low, shifted): the least of each component's integers, and the largest natural number that is left above it."""
    return values.groupBy("c").agg(F.min("v").alias("low"), (F.max("v") - F.min("v")).alias("most"))


def octahedral_residuals(df: DataFrame, bits: int) -> DataFrame:
    """df (s, t and their prediction ps, pt) with x and y, the residual: both brought into the diamond if the prediction is outside, turned until it is in the bottom left, subtracted, and made
    natural numbers. Each step is computed once for a row: a generator of one row stands between them, as projections would be merged."""
    center = (1 << (bits - 1)) - 1
    step = lambda d, **c: d.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in c.items()]))))
    col = F.col
    d = step(df, _s=col("s") - center, _t=col("t") - center, _ps=col("ps") - center, _pt=col("pt") - center)
    (s, t), (ps, pt) = S.inverted_diamond(col("_s"), col("_t"), center), S.inverted_diamond(col("_ps"), col("_pt"), center)
    inside = S.in_diamond(col("_ps"), col("_pt"), center)
    d = step(d, _s1=F.when(inside, col("_s")).otherwise(s), _t1=F.when(inside, col("_t")).otherwise(t), _ps1=F.when(inside, col("_ps")).otherwise(ps), _pt1=F.when(inside, col("_pt")).otherwise(pt))
    a, b = col("_ps1"), col("_pt1")
    d = step(d, _n=F.when(S.in_bottom_left(a, b), 0).when(a == 0, F.when(b > 0, 3).otherwise(1)).when(a > 0, F.when(b >= 0, 2).otherwise(1)).otherwise(3))
    n = col("_n")
    turn = lambda x, y: (F.when(n == 1, y).when(n == 2, -x).when(n == 3, -y).otherwise(x), F.when(n == 1, -x).when(n == 2, -y).when(n == 3, x).otherwise(y))
    (s, t), (ps, pt) = turn(col("_s1"), col("_t1")), turn(a, b)
    d = step(d, _x=s - ps, _y=t - pt)
    positive = lambda v: F.when(v < 0, v + (1 << bits) - 1).otherwise(v)
    return d.select(*df.columns, positive(col("_x")).alias("x"), positive(col("_y")).alias("y"))

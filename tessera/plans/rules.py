"""The choices of an encoder as plain functions of its settings, and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def connectivity(speed: Column) -> Column:
    return F.when(speed == 10, "sequential").otherwise("edge_walk")


def traversal(speed: Column) -> Column:
    return F.when(speed == 0, "max_degree").otherwise("depth_first")


def vertex_space(speed: Column) -> Column:
    return F.when(speed >= 6, "points").otherwise("positions")


def contexts(speed: Column, faces: Column) -> Column:
    return F.when((speed < 5) & (faces >= 1000), "valence").otherwise("plain")


def predictor(speed: Column, attribute: Column, points: Column, position_bits: Column, uv_bits: Column) -> Column:
    """The predictor selected for a quantized attribute of a mesh."""
    portable = (attribute == "texcoord") & (speed < 4) & position_bits.between(1, 21) & (2 * position_bits + uv_bits < 64)
    return (
        F.when(speed >= 10, "difference").when(portable, "texcoord_portable")
        .when((attribute == "normal") & (speed < 4) & (position_bits > 0), "geometric_normal").when(attribute == "normal", "difference")
        .when(speed >= 8, "difference").when((speed >= 2) | (points < 40), "parallelogram").otherwise("constrained_multi_parallelogram")
    )


def effective_predictor(speed: Column, attribute: Column, points: Column, position_bits: Column, uv_bits: Column) -> Column:
    """What is installed: quantized normals are coded by differences whatever was selected."""
    return F.when(attribute == "normal", "difference").otherwise(predictor(speed, attribute, points, position_bits, uv_bits))


def tree_level(speed: Column, components: Column) -> Column:
    level = F.least(10 - speed, F.lit(6))
    return F.when((level == 6) & (components > 15), F.lit(5)).otherwise(level)


def tree_number_coder(level: Column) -> Column:
    return F.when(level <= 1, "direct").when(level <= 3, "entropy").otherwise("folded")


def at_least(major: Column, minor: Column, a: int, b: int) -> Column:
    """Whether a stream's version is a.b or later."""
    return (major > a) | ((major == a) & (minor >= b))

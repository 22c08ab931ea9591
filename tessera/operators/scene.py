"""Scene graphs as adjacency lists, and transforms as arrays of 16 numbers by rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten(nodes: DataFrame, most: int = 1000) -> DataFrame:
    """nodes (node, parent, name) -> (node, level, path, key): from the roots (parent null) down until a level is empty; key orders depth first, children by name and node.

    One equi-join a level. A node that is reached on two ways, or is its own ancestor, is an error of the scene, and so is one with more than most levels. Levels beyond the fourth are
    checkpointed, so that plans do not grow with the depth.
    """
    own = nodes.withColumn("own", F.struct(F.coalesce("name", F.lit("")).alias("name"), F.col("node").cast("string").alias("node")))
    level = own.where("parent is null").select("node", F.lit(0).alias("level"), F.col("name").alias("path"), F.array("own").alias("key"))
    out = level
    for k in range(1, most):
        above = level.select(F.col("node").alias("parent"), F.col("path").alias("above"), F.col("key").alias("outer"))
        level = own.join(above, "parent").select("node", F.lit(k).alias("level"), F.concat_ws("/", "above", "name").alias("path"), F.concat("outer", F.array("own")).alias("key"))
        if k > 3:
            level = level.checkpoint()
        if level.isEmpty():
            break
        if not level.join(out.select("node"), "node", "left_semi").isEmpty():
            raise ValueError("a node is reached twice")
        out = out.unionByName(level)
    else:
        raise ValueError(f"the scene has more than {most} levels")
    if not shared(out).isEmpty():
        raise ValueError("a node is reached twice")
    return out


def shared(flat: DataFrame) -> DataFrame:
    """Nodes reached more than once."""
    return flat.groupBy("node").count().where("count > 1").select("node")


def rotation(degrees: tuple[Column, Column, Column]) -> list[Column]:
    """Rz * Ry * Rx, nine numbers by rows."""
    x, y, z = (F.radians(d) for d in degrees)
    cx, sx, cy, sy, cz, sz = F.cos(x), F.sin(x), F.cos(y), F.sin(y), F.cos(z), F.sin(z)
    return [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, -sy, cy * sx, cy * cx]


def column_major(matrix: Column) -> Column:
    """Sixteen numbers by columns to the same by rows, and back."""
    return F.array(*[F.get(matrix, F.lit(4 * (k % 4) + k // 4)) for k in range(16)])


def times(a: Column, b: Column) -> Column:
    """Product of two matrices by rows."""
    at = lambda m, i, j: F.get(m, F.lit(4 * i + j))
    return F.array(*[sum((at(a, i, k) * at(b, k, j) for k in range(1, 4)), at(a, i, 0) * at(b, 0, j)) for i in range(4) for j in range(4)])


def quaternion_rotation(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    return [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]


def compose(translation: tuple[Column, Column, Column], rotated: list[Column], scale: tuple[Column, Column, Column]) -> Column:
    """Translation, rotation and scale as a matrix with the translation in the last column."""
    rows = [[rotated[3 * i + j] * scale[j] for j in range(3)] + [translation[i]] for i in range(3)]
    return F.array(*[c.cast("double") for row in rows for c in row], *[F.lit(float(v)) for v in (0, 0, 0, 1)])

"""What the findings of round 3 are about: results at size, and large meshes that no task holds whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import corner_table as K
from tessera.operators import topology as G
from tessera.plans import queries as catalogue
from tessera.sources import stream_batches, streams
from tessera.sources.session import checkpoint_folder


def test_canonical_vectors_in_single_precision(spark, tmp_path):
    # 0.033 times 1000 is 33 in single precision, and 32.9999998 in double
    spark.createDataFrame([(1, [0.033, 0.905, -0.537])], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    total, x, y = 33 + 905 + 537, 33 * 511, 905 * 511
    want = (x // total, y // total)
    assert [(r.x, r.y, r.z) for r in catalogue.QUERIES["canonical_vectors"](spark, str(tmp_path)).collect()] == [(*want, want[0] + want[1] - 511)]


def index_bytes_by_hand(faces):
    new = {}
    for p in (p for f in faces for p in f):
        new.setdefault(p, len(new))
    n = len(new)
    width = lambda i: 1 if n < 256 else 2 if n < 65536 else (1 if i < 128 else 2 if i < 16384 else 3) if n < 1 << 21 else 4
    return n, sum(width(new[p]) for f in faces for p in f)


@pytest.mark.parametrize("n", [3, 255, 300, 70000])
def test_index_bytes_of_rings_as_rows(spark, n):
    """No plan collects a ring, and points are numbered over the runs as over the whole."""
    ring = [i * i % n if i % 3 else i for i in range(n)] if n < 70000 else [i if i % 50 else i // 2 for i in range(n)]
    faces = [(ring[0], ring[j], ring[j + 1]) for j in range(1, n - 1)]
    rows = spark.range(n).select(F.lit(7).cast("long").alias("m"), F.get(F.lit(ring), F.col("id").cast("int")).cast("long").alias("point"), (F.col("id") * 3).alias("at")) if n < 70000 else \
        spark.range(n).select(F.lit(7).cast("long").alias("m"), F.when(F.col("id") % 50 == 0, F.floor(F.col("id") / 2)).otherwise(F.col("id")).alias("point"), (F.col("id") * 3).alias("at"))
    got = G.index_bytes(G.fan_uses(G.ring_places(rows, ["at"])))
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert [tuple(r) for r in got.collect()] == [(7, *index_bytes_by_hand(faces))]
    fan = spark.createDataFrame([(7, i, *f) for i, f in enumerate(faces)], "m bigint, f int, p0 bigint, p1 bigint, p2 bigint")
    assert [tuple(r) for r in G.plain_index_bytes(fan).collect()] == [(7, *index_bytes_by_hand(faces))]


def test_settled_columns_are_evaluated_once_a_row(spark):
    """The lambdas of mesh lists refer to columns, and not to the expressions that make them."""
    rings = spark.createDataFrame([(1, [7, 8, 9, 7, 10]), (2, [5, 6])], "m bigint, ring array<bigint>")
    got = K.fan_lists(rings.withColumn("ring", F.transform("ring", lambda x: x + 1)))
    assert [(r.m, r.faces, r.points) for r in got.collect()] == [(1, [[0, 1, 2], [0, 2, 0], [0, 0, 3]], [8, 9, 10, 11])]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("array_distinct") == 1


def test_small_meshes_are_walked_once_and_coded_without_arrays(spark):
    """Equal connectivities are walked once; numbers of small meshes come back, those at the ends of their type as well."""
    streams._kept_walk.cache_clear(), streams._kept_back.cache_clear()
    fan = [[0, j, j + 1] for j in range(1, 6)]
    rows = [(i, fan, [[(i * 7919 + j * j * 31) % 2**31 * (-1) ** j, i - j] for j in range(7)]) for i in range(40)]
    shapes = spark.createDataFrame(rows, "m bigint, faces array<array<int>>, points array<array<int>>")
    for speed in (5, 10):
        back = {r.m: r for r in streams.decoded(streams.coded(shapes, b"SHAPE", speed=speed), b"SHAPE").collect()}
        for m, faces, points in rows:
            corner = lambda f, p: sorted(sorted(p[i] for i in x) for x in f)
            assert back[m].error is None and corner(back[m].faces, back[m].points) == corner(faces, points)
    for _, f, p in rows:
        streams.read_stream(streams.write_stream(streams.Shape(np.array(f), [streams.Attribute(streams.GENERIC, np.array(p, "i4"))]), b"SHAPE", speed=5))
    assert streams._kept_walk.cache_info().misses == 1 and streams._kept_back.cache_info().misses == 1


def test_tasks_grow_in_number(spark, tmp_path):
    """What is keyed by mesh runs in tasks of a bounded part of the table, and by edge without a further shuffle."""
    spark.range(400_000).selectExpr("id div 4 l_orderkey", "id * 7919 % 100003 l_partkey", "id * id % 1009 l_suppkey", "cast(id % 4 as int) l_linenumber", "rand(3) l_extendedprice").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    e = G.edges(catalogue.catalogue.faces(spark, str(tmp_path)))
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    assert catalogue.catalogue.rings(spark, str(tmp_path)).rdd.getNumPartitions() >= 2


def components_by_hand(links):
    least = {}
    for m, a, b in links:
        for v in (a, b):
            least.setdefault((m, v), v)
    while True:
        new = dict(least)
        for m, a, b in links:
            new[m, a] = new[m, b] = min(new[m, a], new[m, b])
        if new == least:
            return least
        least = new


def test_components_where_the_links_are_and_beyond(spark):
    """Small meshes are joined in one pass; those with more links than a task holds in parts, which then find each other. The same components, and no round is written for small ones."""
    checkpoint_folder(spark)
    rng = random.Random(4)
    links = [(m, rng.randrange(60), rng.randrange(60)) for m in range(5) for _ in range(30)] + [(7, i, i + 1) for i in range(300)] + [(8, 3, 3), (9, -4, 5)]
    d = spark.createDataFrame(links, "m bigint, a bigint, b bigint").repartition(3)
    want = components_by_hand(links)
    for limit in (1, 20, 64, 1000):
        rows = G.connected(d, limit=limit).collect()
        assert {(r.m, r.v): r.component for r in rows} == want and len(rows) == len(want)
    assert "ExistingRDD" not in G.connected(spark.range(9).selectExpr("id div 3 m", "id a", "id + 1 b"))._jdf.queryExecution().toString()


def test_values_go_with_the_corners(spark, tmp_path):
    """Residuals, opposites' answers and fans need the one shuffle by mesh, and that of the lines by part."""
    spark.createDataFrame([(m, m * 3 + j * j % 5, 7, j, 1.0) for m in range(40) for j in range(6)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, p % 11) for p in range(200)], "p_partkey bigint, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    checkpoint_folder(spark)
    for name, most in (("parallelogram_residual", 2), ("split_vertices", 1), ("mesh_components", 1), ("boundary_loops", 1), ("vertex_valence", 1), ("boundary_vertices", 1)):
        d = catalogue.QUERIES[name](spark, str(tmp_path))
        d.collect()
        assert d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") <= most, name


def test_points_by_seams_are_counted_in_the_mesh(spark):
    """Two faces with another value each leave two points at both ends of their edge; a corner without a value counts at none. Equal connectivities have one table."""
    K._kept.cache_clear()
    d = spark.createDataFrame([(1, [[0, 1, 2], [0, 2, 3]], [5, 5, 5, 6, 6, 6]), (2, [[0, 1, 2], [0, 2, 3]], [5, 5, 5, 5, 5, None])], "m bigint, faces array<array<int>>, values array<int>")
    got = sorted((r.m, r.corners, r.kinds) for r in K.point_rows(d).collect())
    assert got == [(1, 1, 1)] * 6 + [(2, 1, 1), (2, 2, 1), (2, 2, 1)]
    assert K.table_of([[0, 1, 2]]) is K.table_of([[0, 1, 2]])


def test_streams_of_many_meshes_are_those_of_one(monkeypatch):
    """Small meshes are coded together as arrays: the same bytes, values and errors as one by one, also of streams that are broken."""
    rng = random.Random(6)
    faces, points = [], []
    for _ in range(300):
        n, k, most = rng.choice([3, 4, 5, 9, 30, 66]), rng.choice([1, 2]), rng.choice([1, 50, 3000, 2**31 - 1])
        faces.append(np.array([[0, j, j + 1] for j in range(1, n - 1)] if rng.random() < 0.7 else [[0, 1, 2], [2, 1, 0], [0, 2, 1]]))
        points.append(np.array([[rng.randint(-most, most) for _ in range(k)] for _ in range(n)], "i4"))
    same = lambda x, y: x[2] == y[2] and (x[0] is None or (np.array_equal(x[0], y[0]) and np.array_equal(x[1], y[1])))
    for company in (1, 8):
        monkeypatch.setattr(stream_batches, "COMPANY", company)
        for speed in (0, 5, 9, 10):
            alone = [streams.write_stream(streams.Shape(f, [streams.Attribute(streams.GENERIC, p)]), b"SHAPE", speed=speed) for f, p in zip(faces, points, strict=True)]
            assert stream_batches.write_meshes(faces, points, b"SHAPE", speed) == alone
            broken = [bytes([*x[:i], rng.randrange(256), *x[i + 1 :]])[: len(x) - rng.choice([0, 0, 2])] for x in alone for i in [rng.randrange(len(x))]]
            for data in (alone, broken, [None, b"", *alone[:20]]):
                assert all(map(same, stream_batches.read_meshes(data, b"SHAPE"), [stream_batches._one(x, b"SHAPE") for x in data]))


def test_small_meshes_are_not_coded_one_by_one(monkeypatch):
    fan = np.array([[0, 1, 2], [0, 2, 3]])
    points = [np.array([[7 * i, 900 + i], [i, 910], [40 - i, 905], [3, 1000 - i]], "i4") for i in range(50)]
    data = stream_batches.write_meshes([fan] * 50, points, b"SHAPE", 5)
    monkeypatch.setattr(streams, "read_stream", None)
    assert [x[2] for x in stream_batches.read_meshes(data, b"SHAPE")] == [None] * 50

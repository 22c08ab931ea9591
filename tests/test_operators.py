"""Topology of known shapes, inverses of transforms, coders and formats."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import scene
from tessera.operators import sequences as Q
from tessera.operators import topology as G
from tessera.sources import fbx, formats, meshes
from tessera.sources.session import checkpoint_folder
from tessera.streaming import symbols


def faces_of(spark, triangles, m=1):
    return spark.createDataFrame([(m, i, *t) for i, t in enumerate(triangles)], "m bigint, f int, p0 bigint, p1 bigint, p2 bigint")


def torus(n=5):
    at = lambda i, j: (i % n) * n + j % n
    return [t for i in range(n) for j in range(n) for t in ((at(i, j), at(i + 1, j), at(i, j + 1)), (at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)))]


def grid(r, c):
    return [t for i in range(r - 1) for j in range(c - 1) for t in ((i * c + j, i * c + j + 1, (i + 1) * c + j), (i * c + j + 1, (i + 1) * c + j + 1, (i + 1) * c + j))]


def test_torus(spark):
    f = faces_of(spark, torus())
    assert G.corners(f).count() == 150 and G.opposites(f).count() == 150
    assert G.boundary_vertices(f).count() == 0
    assert {r.valence for r in G.valence(f).collect()} == {6}
    e = G.euler(f).first()
    assert (e.vertices, e.edges, e.faces, e.euler) == (25, 75, 50, 0)


def test_grid_has_one_border(spark):
    f = faces_of(spark, grid(4, 6))
    assert G.euler(f).first().euler == 1
    assert G.boundary_vertices(f).count() == 2 * (4 + 6) - 4
    back = G.opposites(f)
    assert back.join(back.select("m", F.col("opposite").alias("corner"), F.col("corner").alias("opposite")), ["m", "corner", "opposite"], "left_anti").count() == 0


def test_components(spark):
    checkpoint_folder(spark)
    strip = [(i, i + 1, i + 2) for i in range(40)]
    f = faces_of(spark, strip + [(100, 101, 102), (7, 7, 8)])
    got = {r.v: r.component for r in G.components(f).collect()}
    assert {got[v] for v in range(42)} == {0} and {got[v] for v in (100, 101, 102)} == {100}


def test_fans_and_loops(spark):
    checkpoint_folder(spark)
    bow = [(0, 1, 2), (0, 3, 4)]  # two triangles that share a point alone
    assert [tuple(r) for r in G.split_vertices(faces_of(spark, bow)).collect()] == [(1, 0, 2)]
    assert G.split_vertices(faces_of(spark, torus())).count() == 0
    assert G.vertex_fans(faces_of(spark, torus())).select("fan").distinct().count() == 25
    hole = [t for i, t in enumerate(grid(6, 6)) if i // 2 != 12]
    assert G.boundary_loops(faces_of(spark, hole)).first().loops == 2
    assert G.boundary_loops(faces_of(spark, torus())).count() == 0


def test_fan_and_renumber(spark):
    p = spark.createDataFrame([(1, [5, 6, 7, 8]), (2, [1, 2]), (3, []), (4, [9, 9, 9])], "m bigint, ring array<bigint>")
    f = G.fan(p)
    assert sorted(map(tuple, f.collect())) == [(1, 0, 5, 6, 7), (1, 1, 5, 7, 8), (4, 0, 9, 9, 9)]
    assert f.where(G.degenerate()).count() == 1
    assert {(r.point, r.new) for r in G.renumbered(f.where("m = 1")).collect()} == {(5, 0), (6, 1), (7, 2), (8, 3)}


def test_face_hash_knows_no_order(spark):
    a, b = torus(), [(t[1], t[2], t[0]) for t in reversed(torus())]
    turned = [(t[1], t[0], t[2]) for t in torus()]
    one = lambda t: G.face_hash(faces_of(spark, t)).first().hash
    assert one(a) == one(b) != one(turned)


def test_sequences_round_trip(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(k, i, rng.choice([rng.randint(-9, 9), rng.randint(-10**6, 10**6)])) for k in range(6) for i in range(rng.randint(1, 60))], "k int, i int, v bigint")
    d = Q.undelta(Q.delta(df, ["k"], ["i"]), ["k"], ["i"])
    assert d.where("back <> v").count() == 0
    w = Q.wrapped_delta(df, ["k"], ["i"])
    assert w.where("abs(r) > (1 + high - low) / 2").count() == 0
    assert Q.unwrapped_delta(w, ["k"], ["i"]).where("back <> v").count() == 0
    assert df.where(S.unzigzag(S.zigzag(F.col("v"))) != F.col("v")).count() == 0


def test_octahedral_is_near(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(500):
        v = [rng.gauss(0, 1) for _ in range(3)]
        n = math.sqrt(sum(x * x for x in v))
        rows.append([x / n for x in v])
    df = spark.createDataFrame(rows + [[0.0, 0.0, 0.0], [-1.0, 0.0, 0.0]], "x double, y double, z double")
    s, t = S.octahedral(F.col("x"), F.col("y"), F.col("z"), 12)
    df = df.withColumns({"s": s, "t": t})
    s, t = S.canonical_octahedral(F.col("s"), F.col("t"), 12)
    u, v, w = S.octahedral_vector(s, t, 12)
    worst = df.where("x <> 0 or y <> 0").select((u * F.col("x") + v * F.col("y") + w * F.col("z")).alias("c")).agg(F.min("c")).first()[0]
    assert worst > 0.99999
    with pytest.raises(ValueError):
        S.octahedral(F.col("x"), F.col("y"), F.col("z"), 1)


def test_scenes_of_any_depth(spark):
    checkpoint_folder(spark)
    nodes = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(12)], "node int, parent int, name string")
    rows = scene.flatten(nodes).orderBy("key").collect()
    assert [r.level for r in rows] == list(range(12)) and rows[-1].path.endswith("n10/n11")
    with pytest.raises(ValueError):
        scene.flatten(nodes, most=5)


def test_scene(spark):
    checkpoint_folder(spark)
    nodes = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 1, "d"), (5, 4, "c")], "node int, parent int, name string")
    assert [r.path for r in scene.flatten(nodes).orderBy("key").collect()] == ["a", "a/b", "a/b/c", "a/d", "a/d/c"]
    with pytest.raises(ValueError):
        scene.flatten(nodes.union(spark.createDataFrame([(5, 2, "c")], nodes.schema)))
    row = spark.range(1).select(F.array(*[F.lit(float(i)) for i in range(16)]).alias("m"))
    assert row.select(scene.column_major(scene.column_major(F.col("m"))) == F.col("m")).first()[0]
    assert row.select(F.get(scene.times(F.col("m"), F.col("m")), F.lit(1))).first()[0] == 0 * 1 + 1 * 5 + 2 * 9 + 3 * 13


SHAPE = formats.mesh([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0.5)], [(0, 1, 2), (0, 2, 3)], [(0, 0, 1)] * 4, [(1, 2, 3, 4)] * 4, [], "s")


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply(form):
    assert formats.read_ply(formats.write_ply(SHAPE, form), "s") == SHAPE


def test_ply_by_hand():
    text = b"ply\nformat ascii 1.0\ncomment c\nelement vertex 4\nproperty  float32\tx\nproperty float y\nproperty double z\nelement face 1\nproperty list uint8 float texcoord\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n2 0.5 0.5 4 0 1 2 3\n"
    assert formats.read_ply(text)["faces"] == [(0, 1, 2), (0, 2, 3)]
    for broken in (text[:-8], text.replace(b" x\n", b" q\n").replace(b"\tx", b"\tq"), text.replace(b"4 0 1 2 3", b"4 0 1 2 9"), b"no", text.replace(b"float32", b"float99")):
        with pytest.raises(formats.FormatError):
            formats.read_ply(broken)


def test_obj():
    text = b"v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nvt 0 1\nvn 0 0 1\nbad\nv 1\nf 1/1/1 2//1 3 4\nf -4 -3 -2\nf 1 2 99\n"
    assert formats.read_obj(text)["faces"] == [(0, 1, 2), (0, 2, 3), (0, 1, 2)]
    assert formats.read_obj(text, whole_polygons=False)["faces"] == [(0, 1, 2), (0, 1, 2)]
    whole = formats.read_obj(text, expand=True)
    assert len(whole["positions"]) == 9 and whole["uvs"][0] == (0, 1) and whole["normals"][0] == (0, 0, 1)
    back = formats.read_obj(formats.write_obj([SHAPE, SHAPE]))
    assert back["faces"] == SHAPE["faces"] + [tuple(i + 4 for i in f) for f in SHAPE["faces"]]


def test_options_of_writers():
    assert b"v 0.00 1.00 0.50\n" in formats.write_obj([SHAPE], precision=2)
    assert formats.read_obj_positions(formats.write_obj([SHAPE])) == SHAPE["positions"]
    info = formats.ply_info(formats.write_ply(SHAPE, precision=1))
    assert info["form"] == "ascii" and [(e["name"], e["count"]) for e in info["elements"]] == [("vertex", 4), ("face", 2)] and info["elements"][0]["properties"][0] == {"name": "x", "type": "float"}


def test_glb():
    other = {**SHAPE, "uvs": [(0.5, 0.25)] * 4, "name": "t", "colors": []}
    cloud = {**SHAPE, "faces": [], "normals": [], "colors": [], "name": "c"}
    data = formats.write_glb([SHAPE, other, cloud])
    assert formats.read_gltf(data) == [SHAPE, other, cloud]
    for cut in (4, 30, len(data) - 4):
        with pytest.raises((ValueError, Exception)):
            formats.read_gltf(data[:cut])
    doc, binary = formats.split_glb(data)
    import base64
    import json

    doc["buffers"][0]["uri"] = "data:application/octet-stream;base64," + base64.b64encode(binary).decode()
    assert formats.read_gltf(json.dumps(doc).encode()) == [SHAPE, other, cloud]
    doc["meshes"][0]["primitives"][0]["extensions"] = {"X_packed": {"bufferView": 0, "attributes": {"POSITION": 0}}}
    with pytest.raises(formats.FormatError):
        formats.read_gltf(json.dumps(doc).encode())
    assert formats.compressed_primitives(json.dumps(doc).encode()) == [{"mesh": 0, "primitive": 0, "extension": "X_packed", "view": 0, "attributes": {"POSITION": 0}}]


def test_gltf_forms_and_scenes(tmp_path):
    text, binary = formats.write_gltf([SHAPE], "separate")
    (tmp_path / "data.bin").write_bytes(binary)
    assert meshes.parse(f"{tmp_path}/s.gltf", text) == [SHAPE] == formats.read_gltf(formats.write_gltf([SHAPE], "embedded"))
    with pytest.raises(formats.FormatError):
        formats.read_gltf(text)
    tree = [{"node": 0, "parent": None, "name": "r", "mesh": None, "matrix": [float(i) for i in range(16)]}, {"node": 1, "parent": 0, "name": "x", "mesh": 0, "matrix": [1.0 * (i % 5 == 0) for i in range(16)]}, {"node": 2, "parent": 0, "name": "y", "mesh": 1, "matrix": [1.0 * (i % 5 == 0) for i in range(16)]}]
    data = formats.write_gltf([SHAPE, SHAPE], scene=tree)
    assert formats.read_gltf_scene(data) == tree
    doc, _ = formats.split_glb(data)
    doc["nodes"][1]["children"] = [2]
    import json

    with pytest.raises(formats.FormatError):
        formats.read_gltf_scene(json.dumps(doc).encode())
    turned = formats.node_matrix({"rotation": [0, 0, math.sin(math.pi / 4), math.cos(math.pi / 4)], "translation": [1, 2, 3], "scale": [2, 2, 2]})
    assert turned == pytest.approx([0, -2, 0, 1, 2, 0, 0, 2, 0, 0, 2, 3, 0, 0, 0, 1])
    for speed in (5, 10):
        packed = formats.write_gltf([SHAPE], extension="X_packed", encode=meshes.stream_encoder(b"SHAPE", speed=speed))
        back = formats.read_gltf(packed, extension="X_packed", decode=meshes.stream_decoder(b"SHAPE"))[0]
        assert len(back["faces"]) == 2 and sorted(back["colors"]) == sorted(SHAPE["colors"])
        assert sorted(back["positions"])[0] == pytest.approx(sorted(SHAPE["positions"])[0], abs=1e-3)


def test_fbx_scene():
    number = lambda name, *v: fbx.Record("P", [name, name, "", "A", *v])
    model = lambda i, *p: fbx.Record("Model", [i, f"m{i}\0\1Model", "Mesh"], [fbx.Record("Properties70", [], list(p))])
    objects = fbx.Record("Objects", [], [model(1, number("Lcl Translation", 1.0, 2.0, 3.0)), model(2, number("Lcl Rotation", 0.0, 0.0, 90.0), number("Lcl Scaling", 2.0, 2.0, 2.0))])
    links = fbx.Record("Connections", [], [fbx.Record("C", ["OO", 1, 0]), fbx.Record("C", ["OO", 2, 1])])
    data = fbx.MAGIC + (7500).to_bytes(4, "little")
    for r in (objects, links):
        data += fbx._written(r, len(data), False)
    a, b = fbx.read_fbx_scene(data + b"\0" * 25)
    assert (a["node"], a["parent"], a["name"], b["node"], b["parent"]) == (1, None, "m1", 2, 1)
    assert a["matrix"][12:15] == [1, 2, 3] and b["matrix"][:2] == pytest.approx([0, 2])


def test_data_source(spark, tmp_path):
    from tessera.sources import datasource

    datasource.register(spark)
    rows = [("a", 0, "one", *[SHAPE[k] for k in ("positions", "normals", "colors", "uvs", "faces")], None)]
    spark.createDataFrame(rows, meshes.MESH).write.format("shapes").option("form", "ply").mode("append").save(f"{tmp_path}/out")
    back = spark.read.format("shapes").load(f"{tmp_path}/out").collect()
    assert len(back) == 1 and [tuple(f) for f in back[0].faces] == SHAPE["faces"] and back[0].error is None


def test_fbx():
    many = formats.mesh([(i, i * i, 0.5) for i in range(60)], [(i, i + 1, i + 2) for i in range(58)], name="many")
    plain = {**SHAPE, "normals": [], "colors": []}
    for compress in (True, False):
        data = fbx.write_fbx([plain, many], compress)
        assert fbx.read_fbx(data) == [plain, many]
        assert fbx.connections(fbx.parse(data)[1]) == [(1000, 1001), (1001, 0), (1002, 1003), (1003, 0)]
    assert fbx.polygons([0, 1, -3, 4, 5, 6, -8]) == [[0, 1, 2], [4, 5, 6, 7]]
    rng = random.Random(6)
    for _ in range(300):
        broken = bytearray(data[: rng.randint(0, len(data))])
        for _ in range(3):
            if broken:
                broken[rng.randrange(len(broken))] = rng.randrange(256)
        try:
            fbx.read_fbx(bytes(broken))
        except (ValueError, TypeError, MemoryError, OverflowError):
            pass


def test_files(spark, tmp_path):
    rows = [("a", 0, "one", *[SHAPE[k] for k in ("positions", "normals", "colors", "uvs", "faces")], None)]
    df = spark.createDataFrame(rows, meshes.MESH)
    for form in meshes.WRITERS:
        folder = f"{tmp_path}/{form}"
        meshes.write(meshes.encoded(df, form), folder).collect()
        back = meshes.read(spark, folder)
        assert meshes.points(back).count() == 4 and [tuple(r)[3:] for r in meshes.faces(back).orderBy("f").collect()] == SHAPE["faces"]
    (tmp_path / "bad.ply").write_bytes(b"ply\nnothing")
    assert meshes.read(spark, f"{tmp_path}/bad.ply").first().error.startswith("FormatError")


def test_stream(spark, tmp_path):
    df = spark.range(200).selectExpr("timestamp_seconds(id * 30) as ts", "id % 3 as symbol")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = symbols.windowed_frequencies(stream, "ts", F.col("symbol")).writeStream.outputMode("complete").format("memory").queryName("freq").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("freq").agg(F.sum("n")).first()[0] == 200
    assert symbols.tracker_bits(spark.table("freq")).count() == 10

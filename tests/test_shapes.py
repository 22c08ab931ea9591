"""Byte coders, corner tables, the edge walk and streams: known shapes, round trips, broken input."""

import glob
import math
import os
import random

import numpy as np
import pytest
from tessera.operators import bitcoding as B
from tessera.operators import edge_walk as W
from tessera.operators import predictors as P
from tessera.operators.corner_table import NONE, CornerTable, corner_rows, is_flat, points_by_seams, split_by_seams
from tessera.sources import streams as T


def torus(n=5):
    at = lambda i, j: (i % n) * n + j % n
    return [t for i in range(n) for j in range(n) for t in ((at(i, j), at(i + 1, j), at(i, j + 1)), (at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)))]


def grid(n, holes=()):
    at = lambda i, j: i * (n + 1) + j
    return [t for i in range(n) for j in range(n) if (i, j) not in holes for t in ((at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i + 1, j + 1), at(i, j + 1)))]


ANNULUS = [t for i in range(6) for t in ((i, (i + 1) % 6, 6 + (i + 1) % 6), (i, 6 + (i + 1) % 6, 6 + i))]
BOW_TIE, TETRAHEDRON = [(0, 1, 2), (0, 3, 4)], [(0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3)]


@pytest.mark.parametrize("version", [(1, 3), (2, 2)])
def test_symbols(version):
    rng = random.Random(1)
    for _ in range(200):
        n, c, most = rng.choice([1, 2, 5, 50, 400]), rng.choice([1, 2, 3]), rng.choice([0, 1, 5, 300, 70000, (1 << 32) - 1])
        s = [rng.randint(0, most) if rng.random() < 0.3 else min(most, int(rng.expovariate(0.3))) for _ in range(n * c)]
        data = B.encode_symbols(s, c, rng.randint(0, 10), version)
        r = B.Reader(data, version)
        assert B.decode_symbols(r, len(s), c) == s and r.at == len(data)
    assert B.encode_symbols([]) == b"" and B.decode_symbols(B.Reader(b""), 0) == []


def test_symbols_are_near_the_entropy():
    rng = random.Random(4)
    s = [min(9, int(rng.expovariate(1))) for _ in range(20_000)]
    bits = sum(-math.log2(s.count(x) / len(s)) * s.count(x) for x in set(s))
    assert len(B.encode_symbols(s)) * 8 < 1.02 * bits + 200


def test_golden_bytes():
    """Worked out by hand: one symbol fills the table; a state of nothing is one byte; a run of unused symbols is one byte."""
    assert B.table_bytes([0, 0, 0, 4096], (2, 2)) == bytes([4, 2 << 2 | 3, (4096 << 2 & 255) | 1, 4096 >> 6])
    assert B.closed(4096, 4096) == b"\0" and B.closed(4096 + 64, 4096) == bytes([64, 64])
    assert B.direct_bytes([1, 0, 1]) == bytes([4, 0, 0, 0, 0, 0, 0, 0b10100000])
    assert B.varint(300) == bytes([172, 2]) and B.signed_varint(-1) == b"\1"
    assert B.shares([1, 1, 2], 12) == [1024, 1024, 2048] and sum(B.shares([1] * 300 + [10**6], 9)) == 512


def test_bits():
    rng = random.Random(2)
    for p in (0.0, 0.01, 0.5, 1.0):
        for n in (0, 1, 31, 32, 1000):
            bits = [int(rng.random() < p) for _ in range(n)]
            for data, reader in ((B.encode_bits(bits), B.BitReader), (B.direct_bytes(bits), B.DirectReader)):
                r = reader(B.Reader(data))
                assert [r.bit() for _ in bits] == bits


@pytest.mark.parametrize("level", range(7))
def test_points(level):
    rng = random.Random(level)
    for _ in range(25):
        n, axes, most = rng.choice([0, 1, 2, 3, 50, 300]), rng.choice([1, 2, 3, 5]), rng.choice([0, 1, 200, 1 << 14])
        p = np.array([[rng.randint(0, most) for _ in range(axes)] for _ in range(n)], np.uint32).reshape(n, axes)
        p[: n // 8] = p[:1]
        data = B.encode_points(p, level)
        r = B.Reader(data, (2, 3))
        assert sorted(map(tuple, B.decode_points(r, axes, level).tolist())) == sorted(map(tuple, p.tolist())) and r.at == len(data)


def test_known_corner_tables():
    t = CornerTable(torus())
    assert (t.n_vertices, t.n_corners, t.opposite.count(NONE), {t.valence(v) for v in range(25)}, t.loops()) == (25, 150, 0, {6}, [])
    assert [len(x) for x in CornerTable(ANNULUS).loops()] == [6, 6]
    bow = CornerTable(BOW_TIE)
    assert bow.n_vertices == 6 and bow.parent == [0, 1, 2, 3, 4, 0] and len(bow.loops()) == 2
    # an edge of three faces: the first two that go in opposite directions are matched
    three = CornerTable([(0, 1, 2), (1, 0, 3), (0, 1, 4)])
    assert three.opposite == [NONE, NONE, 5, NONE, NONE, 2, NONE, NONE, NONE] and three.n_vertices == 7
    # mirrored faces are not matched, flat ones take no part
    assert CornerTable([(0, 1, 2), (1, 0, 2)]).opposite == [NONE] * 6
    flat = CornerTable([(0, 1, 2), (3, 3, 4)])
    assert flat.isolated() == [3, 4] and flat.on_border(3)
    # a ring around vertex 0 that meets vertex 1 twice is cut there
    fold = CornerTable([(0, 1, 2), (0, 2, 3), (0, 3, 1), (0, 1, 4), (0, 4, 5), (0, 5, 1)])
    assert not any(fold.faults().values()) and fold.n_vertices > 6


def test_corner_tables_of_anything_hold():
    rng = random.Random(0)
    for _ in range(1500):
        t = CornerTable([tuple(rng.randrange(7) for _ in range(3)) for _ in range(rng.randrange(1, 14))])
        assert not any(t.faults().values())
        t.loops()


def test_seams():
    two = CornerTable([(0, 1, 2), (2, 1, 3)])
    assert two.seams([0, 1, 2, 2, 1, 3])[0].count(True) == 4 and not two.seams([0, 1, 2, 2, 1, 3])[1]
    seams, inner = two.seams([0, 1, 2, 9, 1, 3])
    assert seams.count(True) == 6 and inner
    assert len(set(points_by_seams(two, [seams]))) == 6 and len(set(points_by_seams(two, [two.seams([0, 1, 2, 2, 1, 3])[0]]))) == 4
    own = split_by_seams(two, seams)
    assert own.opposite == [NONE] * 6 and own.n_vertices == 6 and not any(own.faults().values())
    t = CornerTable(torus())
    assert len(set(points_by_seams(t, [[False] * 150]))) == 25 and split_by_seams(t, [False] * 150).n_vertices == 25
    # a cut once around the torus: its five vertices are met twice
    cut = [o // 3 != c // 3 and {t.vertex[c - c % 3 + (c + 1) % 3], t.vertex[c - c % 3 + (c + 2) % 3]} <= set(range(5)) for c, o in enumerate(t.opposite)]
    assert split_by_seams(t, cut).n_vertices == 30 and len(split_by_seams(t, cut).loops()) == 2 and len(set(points_by_seams(t, [cut]))) == 30


def test_corner_rows(spark):
    df = spark.createDataFrame([(1, torus()), (2, BOW_TIE), (3, [])], "m bigint, faces array<array<int>>")
    rows = corner_rows(df).collect()
    assert sum(r.m == 1 for r in rows) == 150 and {r.vertex for r in rows if r.m == 2} == {0, 1, 2, 3, 4, 5} and not any(r.m == 3 for r in rows)


def walked(faces):
    t = CornerTable(faces)
    data = W.walk_bytes(t, w := W.walk(t))
    r = B.Reader(data)
    u = W.Unwalked(r)
    assert r.at == len(data)
    (a, pa), (b, pb) = W.visits(t, w.order()), W.visits(u, u.order())
    turned = lambda rows: sorted(min(f[i:] + f[:i] for i in range(3)) for f in rows)
    assert len(a) == len(b) == u.n_vertices
    assert turned([tuple(pa[t.vertex[3 * i + k]] for k in range(3)) for i in range(len(faces)) if not is_flat(faces[i])]) == turned([tuple(pb[u.vertex[3 * i + k]] for k in range(3)) for i in range(u.n_faces)])
    return w


def test_edge_walk():
    for faces in (torus(), ANNULUS, BOW_TIE, TETRAHEDRON, [(0, 1, 2)], torus() + [tuple(v + 30 for v in f) for f in ANNULUS]):
        walked(faces)
    assert W.walk(CornerTable(TETRAHEDRON)).inner_starts == [True] and W.walk(CornerTable(ANNULUS)).inner_starts == [False]
    assert W.walk(CornerTable(torus())).events
    rng = random.Random(0)
    for _ in range(80):
        n = rng.randrange(1, 9)
        faces = grid(n, {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(6))})
        rng.shuffle(faces)
        if faces:
            walked(faces)
    for _ in range(800):
        walked([tuple(rng.randrange(8) for _ in range(3)) for _ in range(rng.randrange(1, 16))])


def test_octahedral_residuals():
    o = P.Octahedron(6)
    for s in range(1, 62, 3):
        for t in range(1, 62, 2):
            for p in ((0, 0), (31, 31), (5, 60), (62, 1), (40, 33), (31, 7)):
                r = o.encode((s, t), p)
                assert min(r) >= 0 and o.decode(r, p) == (s, t)
    assert all(o.inverted(*o.inverted(s, t)) == (s, t) for s in range(-30, 31) for t in range(-30, 31) if s and t)
    v = np.random.RandomState(0).randn(500, 3)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert (P.octahedral_vectors(P.octahedral(v, 12), 12) * v).sum(1).min() > 0.99999


@pytest.mark.parametrize("method", [P.NO_PREDICTOR, P.DIFFERENCE, P.PARALLELOGRAM, P.MULTI_PARALLELOGRAM])
def test_residuals(method):
    t = CornerTable(grid(6))
    corners, place = W.visits(t, W.walk(t).order())
    order = P.MeshOrder(t.vertex, t.opposite, corners, place)
    v = np.random.RandomState(1).randint(-300, 300, (len(corners), 2))
    wrap = P.Wrap.of(v)
    r = P.residuals(v, method, wrap, order)
    assert (P.restored(r, method, wrap, order) == v).all()
    plane = np.array([[7 * (t.faces[c // 3][c % 3] % 7) + 3 * (t.faces[c // 3][c % 3] // 7)] for c in corners])
    if method in (P.PARALLELOGRAM, P.MULTI_PARALLELOGRAM):  # on a plane they are exact, but for the first face and where a part begins
        assert (P.residuals(plane, method, P.Wrap.of(plane), order) != 0).sum() <= 4


def surface(n=6, seed=3):
    """A bumpy grid: its order, positions, texture coordinates and normals by place."""
    t = CornerTable(grid(n))
    corners, place = W.visits(t, W.walk(t).order())
    points = [t.faces[c // 3][c % 3] for c in corners]
    rng = np.random.RandomState(seed)
    positions = np.array([(40 * (p % (n + 1)), 40 * (p // (n + 1)), rng.randint(0, 9)) for p in points], np.int64)
    return P.MeshOrder(t.vertex, t.opposite, corners, place), positions, positions[:, :2] * 3 + rng.randint(0, 3, (len(points), 2)), P.octahedral(rng.randn(len(points), 3), 10)


def test_texcoords_and_normals_by_shape():
    order, positions, uv, st = surface()
    r, sides = P.texcoord_residuals(uv, positions, order)
    assert (P.texcoords_restored(r, positions, order, P.Wrap.of(uv), sides) == uv).all()
    flat = positions * np.array([1, 1, 0])
    exact, _ = P.texcoord_residuals(flat[:, :2] * 2, flat, order)  # a plane keeps its shape, but for its first edge
    assert (np.abs(exact).max(1) > 1).sum() <= 3
    r, flips = P.geometric_normal_residuals(st, positions, order, 10)
    assert (P.geometric_normals_restored(r, positions, order, 10, flips) == st).all()
    up = P.octahedral(np.array([(0, 0, 1.0)] * len(st)), 10)
    assert P.geometric_normal_residuals(up, flat, order, 10)[0].max() == 0
    assert P.int_sqrt(10**30 - 1) == 10**15 - 1 and P.canonical_vector(0, 0, 0, 511) == (511, 0, 0)


def test_constrained_parallelograms():
    order, positions, uv, _ = surface()
    for v in (uv, positions):
        r, flags = P.constrained_residuals(v, order)
        assert (P.constrained_restored(r, order, P.Wrap.of(v), flags) == v).all()
    tracker = P.Tracker()
    tracker.push([1, 1, 2, 2])
    assert tracker.bits() == 4 and tracker.bits([1, 1, 2, 2]) == 8


def test_orders_meet_every_vertex():
    for faces in (torus(), ANNULUS, grid(5, {(2, 2)}), BOW_TIE):
        t = CornerTable(faces)
        for order in (W.visits, W.visits_by_degree):
            corners, place = order(t, W.walk(t).order())
            assert sorted(place) == list(range(t.n_vertices)) and [t.vertex[c] for c in corners] == sorted(range(t.n_vertices), key=place.__getitem__)


WORD = b"SHAPE"


def shape(n=6, seed=0):
    rng = np.random.RandomState(seed)
    size = (n + 1) ** 2
    normal = rng.randn(size, 3)
    normal /= np.linalg.norm(normal, axis=1, keepdims=True)
    values = [(T.POSITION, rng.rand(size, 3).astype("f4")), (T.NORMAL, normal.astype("f4")), (T.GENERIC, rng.randint(-500, 500, (size, 2)).astype("i4")), (T.COLOR, rng.randint(0, 255, (size, 4)).astype("u1"))]
    return T.Shape(np.array(grid(n)), [T.Attribute(k, v) for k, v in values])


@pytest.mark.parametrize("speed", [0, 1, 4, 5, 7, 8, 9, 10])
def test_mesh_streams(speed):
    a = shape()
    b = T.read_stream(T.write_stream(a, WORD, {T.POSITION: 14, T.NORMAL: 10}, speed), WORD)
    by = lambda s: {tuple(g): [x.values[i].tolist() for x in s.attributes] for i, g in enumerate(s.attributes[2].values.tolist())}
    x, y = by(a), by(b)
    assert x.keys() == y.keys() and len(b.faces) == 72
    for k in x:
        assert x[k][0] == pytest.approx(y[k][0], abs=1e-4) and x[k][1] == pytest.approx(y[k][1], abs=1e-2) and x[k][3] == y[k][3]
    assert T.stats(T.write_stream(a, WORD, {T.POSITION: 14, T.NORMAL: 10}, speed))["method"] == ("sequential" if speed == 10 else "edge_walk")
    exact = T.read_stream(T.write_stream(a, WORD, {}, 10))
    assert (exact.attributes[0].values == a.attributes[0].values).all() and (exact.faces == a.faces).all()


@pytest.mark.parametrize("tree", [False, True])
def test_cloud_streams(tree):
    a = T.Shape(None, [x for x in shape().attributes if x.kind != T.NORMAL])
    for speed in range(11):
        b = T.read_stream(T.write_stream(a, WORD, {T.POSITION: 12}, speed, tree), WORD)
        assert b.faces is None and sorted(map(tuple, b.attributes[1].values.tolist())) == sorted(map(tuple, a.attributes[1].values.tolist()))
        assert sorted(map(tuple, b.attributes[2].values.tolist())) == sorted(map(tuple, a.attributes[2].values.tolist()))


def test_refused():
    a = shape()
    with pytest.raises(T.StreamError):
        T.read_stream(T.write_stream(a, WORD), b"OTHER")
    a.attributes[0].values[3, 1] = np.inf
    with pytest.raises(T.StreamError):
        T.write_stream(a, WORD, {T.POSITION: 11})
    with pytest.raises(T.StreamError):
        T.write_stream(T.Shape(np.zeros((0, 3))), WORD)
    for bad in (b"", b"SHAPE", b"SHAPE" + bytes(6), b"SHAPE\x02\x02\x01\x01\x00\x00"):
        with pytest.raises(T.StreamError):
            T.read_stream(bad, WORD)


@pytest.mark.parametrize("speed", [5, 10])
def test_broken_streams_are_errors(speed):
    base = T.write_stream(shape(3), WORD, {T.POSITION: 14, T.NORMAL: 10}, speed)
    rng = random.Random(speed)
    for i in range(300):
        b = bytearray(base[: rng.randrange(len(base))] if i % 3 == 0 else base)
        for _ in range(rng.randrange(1, 4)):
            if len(b) > 11:
                b[rng.randrange(11, len(b))] = rng.randrange(256)
        try:
            T.read_stream(bytes(b), WORD)
        except T.StreamError:
            pass


@pytest.mark.skipif(not os.environ.get("TEST_STREAMS"), reason="no folder of streams is named")
def test_streams_of_others():
    for path in glob.glob(f"{os.environ.get('TEST_STREAMS')}/**/*", recursive=True):
        if os.path.isfile(path):
            with open(path, "rb") as f:
                T.read_stream(f.read())

"""Corner tables of whole meshes: opposites by first match, edges that are no manifold ones cut, vertices split, seams, points by seams.

These depend on the order of faces, so each mesh is built in one call; meshes come as rows of a face list and are built where they are, many to an Arrow batch. The set-oriented forms
in topology.py need no order and no call, and agree with these on manifold meshes.

Corner 3f + k is the k-th of face f. It looks at the edge from the next corner's vertex (source) to the previous corner's (sink).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.topology import settled

NONE = -1


def after(c: int) -> int:
    return c + 1 if c % 3 < 2 else c - 2


def before(c: int) -> int:
    return c - 1 if c % 3 else c + 2


def is_flat(face) -> bool:
    return len(set(face)) < 3


class CornerTable:
    """vertex (of each corner), opposite (or NONE), leftmost (corner of each vertex, NONE for one without faces)."""

    def __init__(self, faces: list, cut=frozenset()):
        """cut: corners whose edge counts as a border, on both sides."""
        self.faces = [tuple(f) for f in faces]
        self.vertex = [v for f in self.faces for v in f]
        self.n_corners = len(self.vertex)
        self.n_original = max(self.vertex, default=-1) + 1
        self.opposite = self._matched()
        for c in cut:
            o = self.opposite[c]
            self.opposite[c] = NONE
            if o != NONE:
                self.opposite[o] = NONE
        self._cut_folds()
        self._split()

    # -- steps

    def left(self, c: int) -> int:
        """The corner at the same vertex in the face on the left, or NONE."""
        o = self.opposite[after(c)]
        return NONE if o == NONE else after(o)

    def right(self, c: int) -> int:
        o = self.opposite[before(c)]
        return NONE if o == NONE else before(o)

    def around(self, v: int) -> Iterator[int]:
        """Corners at a vertex from the leftmost on."""
        first = c = self.leftmost[v]
        while c != NONE:
            yield c
            c = self.right(c)
            if c == first:
                return

    # -- building

    def _matched(self) -> list[int]:
        """Each half-edge takes the first waiting one of the other direction whose face is not its mirror image; else it waits itself."""
        opposite = [NONE] * self.n_corners
        waiting: dict[tuple[int, int], list[int]] = {}
        for c in range(self.n_corners):
            if is_flat(self.faces[c // 3]):
                continue
            source, sink = self.vertex[after(c)], self.vertex[before(c)]
            line = waiting.get((sink, source), [])
            other = next((x for x in line if self.vertex[x] != self.vertex[c]), None)
            if other is None:
                waiting.setdefault((source, sink), []).append(c)
            else:
                line.remove(other)
                opposite[c], opposite[other] = other, c
        return opposite

    def _cut_folds(self) -> None:
        """Around a vertex each neighbour may be met once: where the ring meets one again, both edges are cut on both sides. Until nothing changes."""
        seen = [False] * self.n_corners
        changed = True
        while changed:
            changed = False
            for start in range(self.n_corners):
                if seen[start]:
                    continue
                c = start
                while (x := self.left(c)) not in (start, NONE) and not seen[x]:
                    c = x
                first, edges = c, {}
                while c != NONE:
                    seen[c] = True
                    edge, neighbour = before(c), self.vertex[after(c)]
                    # the same neighbour over another edge than the one that closes the ring
                    other = next((e for e in edges.get(neighbour, ()) if e != self.opposite[edge]), None)
                    if other is not None:
                        for e in (edge, other):
                            if self.opposite[e] != NONE:
                                self.opposite[self.opposite[e]] = NONE
                            self.opposite[e] = NONE
                        changed = True
                        break
                    edges.setdefault(self.vertex[before(c)], []).append(after(c))
                    c = self.right(c)
                    if c == first:
                        break

    def _split(self) -> None:
        """Every further run of corners at a vertex becomes a vertex of its own, numbered on; each vertex gets its leftmost corner."""
        self.leftmost = [NONE] * self.n_original
        self.parent = list(range(self.n_original))
        done, used = [False] * self.n_corners, [False] * self.n_original
        for start in range(self.n_corners):
            if done[start] or is_flat(self.faces[start // 3]):
                continue
            v = self.vertex[start]
            if used[v]:
                self.parent.append(v)
                v = len(self.leftmost)
                self.leftmost.append(NONE)
                used.append(False)
            used[v] = True
            c = start
            while c != NONE:
                done[c], self.vertex[c], self.leftmost[v] = True, v, c
                c = self.left(c)
                if c == start:
                    break
            if c == NONE:
                c = self.right(start)
                while c != NONE:
                    done[c], self.vertex[c] = True, v
                    c = self.right(c)

    # -- what is asked of it

    @property
    def n_vertices(self) -> int:
        return len(self.leftmost)

    def isolated(self) -> list[int]:
        return [v for v, c in enumerate(self.leftmost) if c == NONE]

    def on_border(self, v: int) -> bool:
        """Vertices without faces count as such, too."""
        return self.leftmost[v] == NONE or self.left(self.leftmost[v]) == NONE

    def valence(self, v: int) -> int:
        return sum(1 for _ in self.around(v)) + self.on_border(v) if self.leftmost[v] != NONE else 0

    def loops(self) -> list[list[int]]:
        """Border loops, each as the corners that look at its edges, in order."""
        out, seen = [], set()
        for start in range(self.n_corners):
            if self.opposite[start] != NONE or start in seen or is_flat(self.faces[start // 3]):
                continue
            loop, c = [], start
            while c not in seen:
                seen.add(c)
                loop.append(c)
                c = after(c)  # turn around the edge's source until the next border edge
                while self.opposite[c] != NONE:
                    c = after(self.opposite[c])
            out.append(loop)
        return out

    def faults(self) -> dict[str, int]:
        """Breaches of what must hold: opposites that are not mutual, opposites whose edges differ, and leftmost corners of another vertex."""
        mutual = sum(o != NONE and self.opposite[o] != c for c, o in enumerate(self.opposite))
        edges = sum(o != NONE and (self.vertex[after(c)], self.vertex[before(c)]) != (self.vertex[before(o)], self.vertex[after(o)]) for c, o in enumerate(self.opposite))
        left = sum(c != NONE and self.vertex[c] != v for v, c in enumerate(self.leftmost))
        return {"not_mutual": mutual, "other_edge": edges, "other_vertex": left}

    def seams(self, value: list) -> tuple[list[bool], bool]:
        """For each corner whether its edge is a seam of an attribute, whose value at each corner is given: a border, or an edge where the two faces differ at either end. And
        whether there is a seam inside the mesh."""
        out, inner = [False] * self.n_corners, False
        for c, o in enumerate(self.opposite):
            if is_flat(self.faces[c // 3]):
                continue
            if o == NONE:
                out[c] = True
            elif c < o and (value[after(c)] != value[before(o)] or value[before(c)] != value[after(o)]):
                out[c] = out[o] = inner = True
        return out, inner


def split_by_seams(table: CornerTable, seams: list[bool]) -> CornerTable:
    """The corner table of an attribute: the same faces with every seam a border, so that vertices are split where values are."""
    faces = [tuple(table.vertex[3 * f : 3 * f + 3]) for f in range(len(table.faces))]
    return CornerTable(faces, {c for c, x in enumerate(seams) if x})


def points_by_seams(table: CornerTable, seams: list[list[bool]]) -> list[int]:
    """A point for each corner: around a vertex a new point begins wherever any attribute has a seam. Numbered by vertex, from the leftmost corner on."""
    cut = [any(s[c] for s in seams) for c in range(table.n_corners)]
    point, n = [NONE] * table.n_corners, 0
    for v in range(table.n_vertices):
        ring = list(table.around(v))
        if not ring:
            continue
        # in a closed ring begin behind a seam, if there is one
        turn = 0 if table.on_border(v) else next((i for i, c in enumerate(ring) if cut[after(c)]), 0)
        ring = ring[turn:] + ring[:turn]
        for i, c in enumerate(ring):
            if i and cut[after(c)]:
                n += 1
            point[c] = n
        n += 1
    return point


# --- over tables

#: Corner tables of meshes of up to so many faces are kept, the last KEPT of them: small meshes have few connectivities.
SMALL_MESH, KEPT = 64, 2048


@lru_cache(KEPT)
def _kept(faces: tuple) -> CornerTable:
    return CornerTable(faces)


def table_of(faces: list) -> CornerTable:
    """The corner table of faces, to be read only."""
    return _kept(tuple(map(tuple, faces))) if len(faces) <= SMALL_MESH else CornerTable(faces)


def _per_mesh(meshes: DataFrame, schema: str, rows: Callable[[CornerTable, object], Iterator[tuple]], cut_column: str | None = None) -> DataFrame:
    """meshes (m, faces array<array<int>>, more) -> rows of each mesh's corner table, with m first. Rows leave in batches of about ROWS."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[x.strip().split(" ")[1]] for x in schema.split(",")]
    more = [c for c in meshes.columns if c not in ("m", "faces")]
    m_type = meshes.schema["m"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m_arrow, held = None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], m_arrow), *[pa.array(c, t) for c, t in zip(columns[1:], types, strict=True)]], ["m", *names])

        for b in batches:
            m_arrow = b.schema.field("m").type
            for m, faces, *rest in zip(*(b.column(c).to_pylist() for c in ("m", "faces", *more)), strict=True):
                for row in rows(table_of(faces or []), rest):
                    held.append((m, *row))
                if len(held) >= ROWS:
                    yield out()
                    held = []
        if held:
            yield out()

    return meshes.select("m", "faces", *more).mapInArrow(run, f"m {m_type}, {schema}")


ROWS = 20_000


def face_lists(faces: DataFrame) -> DataFrame:
    """(m, f, p0, p1, p2) -> (m, faces): the faces of a mesh in order, points numbered by first use."""
    listed = faces.groupBy("m").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "p0", "p1", "p2"))), lambda x: F.array(x["p0"], x["p1"], x["p2"])).alias("rings"))
    first = F.array_distinct(F.flatten("rings"))
    local = F.transform("rings", lambda r: F.transform(r, lambda p: (F.array_position("points", p) - 1).cast("int")))
    return listed.withColumn("points", first).select("m", local.alias("faces"), "points")


def fan_lists(rings: DataFrame) -> DataFrame:
    """(m, ring, more) -> (m, faces, points, ring, more): face_lists of the fans of rings, without a row for each face. Rings of fewer than three points give none."""
    own = settled(rings.where(F.size("ring") >= 3), points=F.array_distinct("ring"))
    own = settled(own, local=F.transform("ring", lambda p: (F.array_position("points", p) - 1).cast("int")))
    return settled(own, faces=F.zip_with(F.slice("local", 2, F.size("local") - 2), F.slice("local", 3, F.size("local") - 2), lambda a, b: F.array(F.lit(0), a, b))).drop("local")


def corner_rows(meshes: DataFrame) -> DataFrame:
    """(m, corner, vertex, opposite): opposite null on borders; vertices of flat faces keep their numbers."""
    return _per_mesh(meshes.select("m", "faces"), "corner int, vertex int, opposite int", lambda t, _: ((c, t.vertex[c], None if t.opposite[c] == NONE else t.opposite[c]) for c in range(t.n_corners)))


def vertex_rows(meshes: DataFrame) -> DataFrame:
    """(m, vertex, parent, valence, border): parent is the vertex that a new one was split from, or itself."""
    return _per_mesh(meshes.select("m", "faces"), "vertex int, parent int, valence int, border boolean", lambda t, _: ((v, t.parent[v], t.valence(v), t.on_border(v)) for v in range(t.n_vertices)))


def fact_rows(meshes: DataFrame) -> DataFrame:
    """(m, vertices, split, isolated, flat, border, loops, not_mutual, other_edge, other_vertex): one row a mesh."""
    def facts(t: CornerTable, _) -> Iterator[tuple]:
        flat = sum(map(is_flat, t.faces))
        border = sum(t.opposite[c] == NONE for c in range(t.n_corners) if not is_flat(t.faces[c // 3]))
        yield (t.n_vertices, t.n_vertices - t.n_original, len(t.isolated()), flat, border, len(t.loops()), *t.faults().values())

    return _per_mesh(meshes.select("m", "faces"), "vertices int, split int, isolated int, flat int, border int, loops int, not_mutual int, other_edge int, other_vertex int", facts)


def seam_rows(meshes: DataFrame) -> DataFrame:
    """meshes (m, faces, values: one for each corner) -> (m, corner, seam, point): whether the corner's edge is a seam, and the point that seams leave it."""
    def rows(t: CornerTable, rest) -> Iterator[tuple]:
        seams, _ = t.seams(rest[0])
        point = points_by_seams(t, [seams])
        return ((c, seams[c], None if point[c] == NONE else point[c]) for c in range(t.n_corners))

    return _per_mesh(meshes.select("m", "faces", "values"), "corner int, seam boolean, point int", rows)


def point_rows(meshes: DataFrame) -> DataFrame:
    """meshes (m, faces, values: one for each corner, null where there is none) -> (m, corners, kinds): for each point that seams leave its corners with a value, and their different values."""
    def rows(t: CornerTable, rest) -> Iterator[tuple]:
        values, at = rest[0], {}
        for c, point in enumerate(points_by_seams(t, [t.seams(values)[0]])):
            if point != NONE and values[c] is not None:
                at.setdefault(point, []).append(values[c])
        return ((len(x), len(set(x))) for x in at.values())

    return _per_mesh(meshes.select("m", "faces", "values"), "corners int, kinds int", rows)

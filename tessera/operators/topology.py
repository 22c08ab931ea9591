"""Mesh topology over tables. faces: (m, f, p0, p1, p2), m the mesh. Everything is keyed by m and needs no order but the ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S


def settled(d: DataFrame, **columns) -> DataFrame:
    """d with more columns that are evaluated here, once a row. Without this the optimizer writes them into the lambdas that use them, where they are evaluated for every element."""
    return d.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def fan(polygons: DataFrame) -> DataFrame:
    """(m, ring) -> faces: ring (a0, a1, ...) as (a0, aj, aj+1); rings of fewer than three points give none."""
    faces = F.transform(F.sequence(F.lit(1), F.size("ring") - 2), lambda j: F.struct((j - 1).alias("f"), F.get("ring", F.lit(0)).alias("p0"), F.get("ring", j).alias("p1"), F.get("ring", j + 1).alias("p2")))
    return polygons.where(F.size("ring") >= 3).select("m", F.inline(faces))


def degenerate(p0="p0", p1="p1", p2="p2"):
    p0, p1, p2 = F.col(p0), F.col(p1), F.col(p2)
    return (p0 == p1) | (p0 == p2) | (p1 == p2)


def corners(faces: DataFrame) -> DataFrame:
    """(m, corner, f, tip, src, snk): corner 3f + k has tip p_k and looks at the edge from src to snk."""
    three = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("tip"), F.col(f"p{(k + 1) % 3}").alias("src"), F.col(f"p{(k + 2) % 3}").alias("snk")) for k in range(3)])
    return faces.select("m", "f", F.inline(three)).select("m", (3 * F.col("f") + F.col("k")).alias("corner"), "f", "tip", "src", "snk")


def _matched(half: F.Column, kind: str) -> F.Column:
    """Pairs of the half-edges of one edge (an array of structs of that kind in the order of their corners): each takes the first waiting one of the other direction with another tip, or waits itself. Nearly
    all edges have one or two, which need no walk over the list."""
    none = F.array().cast(f"array<struct<x:{kind},y:{kind}>>")
    start = F.struct(F.array().cast(f"array<{kind}>").alias("waiting"), none.alias("pairs"))

    def step(state, h):
        fits = F.filter(state["waiting"], lambda x: (x["forward"] != h["forward"]) & (x["tip"] != h["tip"]))
        other = F.get(fits, F.lit(0))
        waits = F.size(fits) == 0
        return F.struct(
            F.when(waits, F.concat(state["waiting"], F.array(h))).otherwise(F.filter(state["waiting"], lambda x: x["corner"] != other["corner"])).alias("waiting"),
            F.when(waits, state["pairs"]).otherwise(F.concat(state["pairs"], F.array(F.struct(h.alias("x"), other.alias("y"))))).alias("pairs"),
        )

    first, second = F.get(half, F.lit(0)), F.get(half, F.lit(1))
    two = F.when((first["forward"] != second["forward"]) & (first["tip"] != second["tip"]), F.array(F.struct(second.alias("x"), first.alias("y")))).otherwise(none)
    return F.when(F.size(half) == 2, two).otherwise(F.aggregate(half, start, step, lambda state: state["pairs"]))


def edge_pairs(c: DataFrame) -> DataFrame:
    """c (m, corner, tip, src, snk, and maybe further values) -> (m, x, y, a, b): the two half-edges of every edge from a to b that two faces share, with the values of their corners. One shuffle, by edge."""
    more = [x for x in c.columns if x not in ("m", "corner", "f", "tip", "src", "snk")]
    half = F.struct(F.col("corner").cast("int").alias("corner"), F.col("tip").cast("long").alias("tip"), (F.col("src") < F.col("snk")).alias("forward"), *more)
    by_edge = c.groupBy("m", F.least("src", "snk").alias("a"), F.greatest("src", "snk").alias("b")).agg(F.array_sort(F.collect_list(half)).alias("half")).where(F.size("half") > 1)
    kind = by_edge.schema["half"].dataType.elementType.simpleString()
    return by_edge.select("m", F.inline(_matched(F.col("half"), kind)), "a", "b")


def opposites(faces: DataFrame) -> DataFrame:
    """(m, corner, opposite) by first match in the order of corners; faces without area take no part. Edges that fold around a vertex are not cut here (see corner_table)."""
    both = F.array(F.struct(F.col("x.corner").alias("corner"), F.col("y.corner").alias("opposite")), F.struct(F.col("y.corner").alias("corner"), F.col("x.corner").alias("opposite")))
    return edge_pairs(corners(faces.where(~degenerate()))).select("m", F.inline(both))


def unanswered(o: DataFrame) -> DataFrame:
    """(matched, broken) of opposites, in one row: their number, and that of those whose opposite has another one. Counted by pair within the mesh."""
    pair = o.groupBy("m", F.least("corner", "opposite").alias("low"), F.greatest("corner", "opposite").alias("high"))
    sides = pair.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.expr("corner <= opposite")).alias("up"), F.count_if(F.expr("corner >= opposite")).alias("down"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return sides.agg(zero("all").alias("matched"), zero(F.when((F.col("up") == 0) | (F.col("down") == 0), F.col("all")).otherwise(0)).alias("broken"))


def edges(faces: DataFrame) -> DataFrame:
    """(m, a, b, times), a < b: undirected edges with the number of faces at each."""
    c = corners(faces.where(~degenerate()))
    return c.groupBy("m", F.least("src", "snk").alias("a"), F.greatest("src", "snk").alias("b")).agg(F.count(F.lit(1)).alias("times"))


def edge_multiplicity(faces: DataFrame) -> DataFrame:
    return edges(faces).groupBy("times").agg(F.count(F.lit(1)).alias("edges"))


def boundary_vertices(faces: DataFrame) -> DataFrame:
    e = edges(faces).where("times = 1")
    return e.select("m", F.explode(F.array("a", "b")).alias("v")).distinct()


def valence(faces: DataFrame) -> DataFrame:
    """(m, v, valence): faces around a vertex, one more if it is on the boundary (the edges that meet there, on a manifold)."""
    ends = edges(faces).select("m", F.explode(F.array("a", "b")).alias("v"), "times")  # a face has two edges at each of its vertices
    return ends.groupBy("m", "v").agg((F.sum("times") / 2 + F.max((F.col("times") == 1).cast("int"))).cast("long").alias("valence"))


def euler(faces: DataFrame) -> DataFrame:
    """(m, vertices, edges, faces, euler) of the faces with area: one shuffle of the distinct vertices and edges, and one of the counts by mesh."""
    p = [F.col(f"p{i}").cast("long") for i in range(3)]
    none, side = F.lit(None).cast("long"), lambda x, y: F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    parts = F.array(*[F.struct(x.alias("x"), none.alias("y")) for x in p], *[side(p[i], p[(i + 1) % 3]) for i in range(3)])
    sound = faces.where(~degenerate())
    counted = sound.select("m", F.inline(parts)).distinct().groupBy("m").agg(F.count_if(F.col("y").isNull()).alias("vertices"), F.count("y").alias("edges"))
    return counted.join(sound.groupBy("m").agg(F.count(F.lit(1)).alias("faces")), "m").withColumn("euler", F.col("vertices") - F.col("edges") + F.col("faces"))


def renumbered(faces: DataFrame) -> DataFrame:
    """(m, point, new): the points that faces use, numbered in the order of their first corner."""
    seen = corners(faces).groupBy("m", F.col("tip").alias("point")).agg(F.min("corner").alias("first"))
    return seen.select("m", "point", (F.row_number().over(Window.partitionBy("m").orderBy("first")) - 1).alias("new"))


def face_hash(faces: DataFrame) -> DataFrame:
    """(m, hash): a sum over faces, so no order counts; each face by 60 bits of a digest of its points from the least on, so rotation does not count either."""
    low = F.least("p0", "p1", "p2")
    a, b, c = F.col("p0"), F.col("p1"), F.col("p2")
    turned = F.when(a == low, F.array(a, b, c)).when(b == low, F.array(b, c, a)).otherwise(F.array(c, a, b))
    each = F.conv(F.substring(F.md5(F.array_join(turned.cast("array<string>"), ",")), 1, 15), 16, 10).cast("decimal(38,0)")
    return faces.groupBy("m").agg((F.sum(each) % F.lit(2**61 - 1).cast("decimal(38,0)")).cast("long").alias("hash"))


def ordered_hash(faces: DataFrame) -> DataFrame:
    """(m, hash): a digest of the faces as they stand, in order."""
    listed = faces.groupBy("m").agg(F.array_sort(F.collect_list(F.struct("f", "p0", "p1", "p2"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat_ws(",", x["p0"], x["p1"], x["p2"])), ";")
    return listed.select("m", F.md5(text).alias("hash"))


def seams(c: DataFrame) -> DataFrame:
    """c (m, corner, tip, src, snk, at_src, at_snk: an attribute's value in this face at both ends of the edge) -> (m, borders, inner): edges of one face, and edges at either end of which
    the two faces differ. Both kinds are seams. Null values are equal to each other."""
    differ = ~F.col("x.at_src").eqNullSafe(F.col("y.at_snk")) | ~F.col("x.at_snk").eqNullSafe(F.col("y.at_src"))
    shared = edge_pairs(c).groupBy("m").agg(F.count(F.lit(1)).alias("shared"), F.count_if(differ).alias("inner"))
    corners_ = c.groupBy("m").agg(F.count(F.lit(1)).alias("corners")).join(shared, "m", "left")
    zero = lambda n: F.coalesce(n, F.lit(0).cast("long"))
    return corners_.select("m", (F.col("corners") - 2 * zero("shared")).alias("borders"), zero("inner").alias("inner"))


def parallelogram(faces: DataFrame, values: DataFrame) -> DataFrame:
    """valued_parallelogram of faces and of values (tip, value) of their points."""
    for k in range(3):
        faces = faces.join(values.select(F.col("tip").alias(f"p{k}"), F.struct("value").alias(f"v{k}")), f"p{k}", "left")
    return valued_parallelogram(faces)


def valued_parallelogram(faces: DataFrame) -> DataFrame:
    """faces (m, f, p0, p1, p2, v0, v1, v2: structs with the value of each point, null where it has none) -> (m, corner, residual): value at a tip minus (src + snk - tip across the edge), for edges
    with an opposite where all four points have values. Values go with the corners, so that nothing is joined."""
    at = lambda k: F.col(f"v{k % 3}")["value"].cast("long")
    known = lambda k: F.col(f"v{k % 3}").isNotNull()
    three = F.array(*[F.struct((3 * F.col("f") + k).alias("corner"), F.col(f"p{k}").alias("tip"), F.col(f"p{(k + 1) % 3}").alias("src"), F.col(f"p{(k + 2) % 3}").alias("snk"), at(k).alias("value"), (at(k) - at(k + 1) - at(k + 2)).alias("own"), known(k).alias("known"), (known(k) & known(k + 1) & known(k + 2)).alias("whole")) for k in range(3)])
    pairs = edge_pairs(faces.where(~degenerate()).select("m", F.inline(three)))
    side = lambda x, y: F.struct(F.col(f"{x}.corner").alias("corner"), (F.col(f"{x}.own") + F.col(f"{y}.value")).alias("residual"))
    return pairs.where(F.col("x.whole") & F.col("y.known")).select("m", F.inline(F.array(side("x", "y"), side("y", "x"))))


#: Links of a mesh that are joined where they are; larger meshes are joined in parts first, and the parts by rounds over all tasks.
LOCAL_LINKS = 1 << 16


def _roots(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (group, node) of links and the least node that each is connected to within its group."""
    n = len(a)
    groups, nodes = np.concatenate([group, group]), np.concatenate([a, b])
    order = np.lexsort((nodes, groups))
    g, v = groups[order], nodes[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
    at = np.empty(2 * n, np.int64)
    at[order] = np.cumsum(new) - 1
    x, y, label = at[:n], at[n:], np.arange(int(new.sum()))
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label != (up := label[label])).any():
            label = up
    return g[new], v[new], v[new][label]


def contracted(links: DataFrame, keys: list[str], limit: int = LOCAL_LINKS) -> DataFrame:
    """links (keys, a, b) -> (keys, v, component, whole): components of a mesh where all its links are at hand (whole); of a larger one those of its parts, each with nodes of its own."""
    kept = [(k, links.schema[k].dataType.simpleString()) for k in keys]
    rows = links.select(*keys, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.row_number().over(Window.partitionBy(*keys).orderBy("a", "b")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table, whole: bool) -> pa.RecordBatch:
            at = t["at"].to_numpy()
            group = np.cumsum(at == 1)
            first = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
            g, v, c = _roots(group - group[0], t["a"].to_numpy(), t["b"].to_numpy())
            own = t.select(keys).combine_chunks().take(pa.array(first[g]))
            return pa.RecordBatch.from_arrays([*[own[k].combine_chunks() if own[k].num_chunks != 1 else own[k].chunk(0) for k in keys], pa.array(v), pa.array(c), pa.array(np.full(len(v), whole))], [*keys, "v", "component", "whole"])

        held, large = None, False  # the last mesh so far, and whether a part of it has left
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            starts = np.flatnonzero(t["at"].to_numpy() == 1)
            if large:  # up to the next mesh, all is of the large one
                end = int(starts[0]) if len(starts) else len(t)
                if end and (len(starts) or end > limit):
                    yield out(t.slice(0, end), False)
                    t, starts = t.slice(end), starts - end
                    large = not len(starts)
            last = int(starts[-1]) if len(starts) else 0
            if last and not large:
                yield out(t.slice(0, last), True)
                t = t.slice(last)
            if len(t) > limit:
                yield out(t, False)
                t, large = t.slice(len(t)), True
            held = t if len(t) else None
        if held is not None:
            yield out(held, not large)

    return rows.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in kept) + ", v bigint, component bigint, whole boolean")


def connected(links: DataFrame, rounds: int = 64, keys: list[str] | None = None, limit: int = LOCAL_LINKS) -> DataFrame:
    """links (m, a, b), in either direction -> (m, v, component): each node with the least it is connected to within its mesh (or within what keys name, of which m is the first).

    Meshes of up to limit links are joined in one pass where their links are. Where there are larger ones, the components of their parts are linked to each other by connected_by_rounds.
    """
    keys = keys or ["m"]
    own = contracted(links, keys, limit)
    most = links.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (most or 0) <= limit:
        return own.drop("whole")
    parts = own.where(~F.col("whole")).select(F.struct(*keys).alias("m"), F.col("v").alias("a"), F.col("component").alias("b"))
    whole = connected_by_rounds(_both(parts), rounds)
    return own.where("whole").drop("whole").unionByName(whole.select("m.*", "v", "component"))


def connected_by_rounds(links: DataFrame, rounds: int = 64) -> DataFrame:
    """links (m, a, b), in both directions -> (m, v, component), also where a mesh is larger than a task can hold.

    Labels fall to the least of the neighbours' labels; with each round the label of the label is taken, too, so that the
    number of rounds grows with the logarithm of the longest path. Every round is written to the checkpoint folder.
    """
    both = links.checkpoint()
    labels = both.select("m", F.col("a").alias("v")).distinct().withColumn("label", F.col("v"))
    for _ in range(rounds):
        near = both.join(labels.select("m", F.col("v").alias("b"), "label"), ["m", "b"]).groupBy("m", F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(near, ["m", "v"]).select("m", "v", "label", F.least("label", "near").alias("next"))
        jump = step.select("m", F.col("v").alias("next"), F.col("next").alias("far"))
        new = step.join(jump, ["m", "next"], "left").select("m", "v", "label", F.least("next", F.coalesce("far", "next")).alias("next")).checkpoint()
        done = new.where("label <> next").isEmpty()
        labels = new.select("m", "v", F.col("next").alias("label"))
        if done:
            return labels.select("m", "v", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _both(edges_: DataFrame) -> DataFrame:
    e = edges_.select("m", "a", "b")
    return e.unionByName(e.select("m", F.col("b").alias("a"), F.col("a").alias("b")))


def components(faces: DataFrame) -> DataFrame:
    """(m, v, component): each vertex with the least vertex it is connected to within its mesh."""
    return connected(edges(faces).select("m", "a", "b"))


def boundary_loops(faces: DataFrame) -> DataFrame:
    """(m, loops): connected runs of border edges; meshes without a border are left out."""
    return connected(edges(faces).where("times = 1").select("m", "a", "b")).groupBy("m").agg(F.count_if(F.col("v") == F.col("component")).alias("loops"))


def vertex_fans(faces: DataFrame) -> DataFrame:
    """(m, corner, tip, fan): corners at a vertex that follow from each other over shared edges, by the least of them. A vertex with
    several fans is one that a mesh of manifold vertices has to split."""
    c = corners(faces.where(~degenerate()))
    step = lambda x, k: F.col(x) - F.col(x) % 3 + (F.col(x) + k) % 3
    end = lambda x: F.when(F.col(f"{x}.forward"), F.col("b")).otherwise(F.col("a"))  # the vertex that a half-edge leads to
    # a corner n and the one across: the corner before n has the same tip as the one after that across
    link = lambda x, y: F.struct(end(x).alias("tip"), step(f"{x}.corner", 2).alias("a"), step(f"{y}.corner", 1).alias("b"))
    links = edge_pairs(c).select("m", F.inline(F.array(link("x", "y"), link("y", "x"))))
    own = c.select("m", "tip", F.col("corner").alias("a"), F.col("corner").alias("b"))
    found = connected(links.unionByName(own), keys=["m", "tip"])
    return found.select("m", F.col("v").cast("int").alias("corner"), "tip", F.col("component").cast("int").alias("fan"))


def split_vertices(faces: DataFrame) -> DataFrame:
    """(m, v, fans) of the vertices with more than one fan."""
    return vertex_fans(faces).groupBy("m", F.col("tip").alias("v")).agg(F.count_if(F.col("corner") == F.col("fan")).alias("fans")).where("fans > 1")


def vertex_normals(faces: DataFrame, positions: DataFrame) -> DataFrame:
    """(m, v, x, y, z): sums of the cross products of the faces around each vertex, so larger faces weigh more. positions: (v, x, y, z), integers."""
    d = faces
    for i in range(3):
        d = d.join(positions.select(F.col("v").alias(f"p{i}"), *[F.col(c).alias(f"{c}{i}") for c in "xyz"]), f"p{i}")
    u, w = ({c: F.col(f"{c}{k}") - F.col(f"{c}0") for c in "xyz"} for k in (1, 2))
    cross = {"x": u["y"] * w["z"] - u["z"] * w["y"], "y": u["z"] * w["x"] - u["x"] * w["z"], "z": u["x"] * w["y"] - u["y"] * w["x"]}
    each = d.select("m", F.explode(F.array_distinct(F.array("p0", "p1", "p2"))).alias("v"), *[v.alias(c) for c, v in cross.items()])
    return each.groupBy("m", "v").agg(*[F.sum(c).alias(c) for c in "xyz"])


#: Keys and corners are counted in runs of so many (a power of two), so that no task counts all of a large mesh.
RUN = 12


def ring_places(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (m, point, and the columns of order, the first an integer) -> (m, i, n, point): each row's place in its mesh's ring, and the ring's length, nulls last. Rings are not collected: places are
    counted within runs of the first column and the runs before are added."""
    cut = rows.withColumn("run", F.coalesce(F.shiftright(F.col(order[0]).cast("long"), RUN), F.lit((1 << 62) - 1)))
    runs = cut.groupBy("m", "run").agg(F.count(F.lit(1)).alias("own"))
    whole = Window.partitionBy("m")
    before = F.sum("own").over(whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("m", "run", F.coalesce(before, F.lit(0)).alias("outer"), F.sum("own").over(whole).alias("n"))
    inner = F.row_number().over(Window.partitionBy("m", "run").orderBy(*[F.col(c).asc_nulls_last() for c in order])) - 1
    return cut.select("m", "run", inner.alias("inner"), "point").join(runs, ["m", "run"]).select("m", (F.col("outer") + F.col("inner")).alias("i"), "n", "point")


def fan_uses(places: DataFrame) -> DataFrame:
    """places (m, i, n, point) of rings -> point_uses of their fans."""
    i, n = F.col("i"), F.col("n")
    uses = F.when(i == 0, n - 2).when((i == 1) | (i == n - 1), 1).otherwise(2)
    return places.where("n >= 3").groupBy("m", "point").agg(F.sum(uses).alias("uses"), F.min(F.when(i < 2, i).otherwise(3 * i - 4)).alias("first"))


def point_uses(faces: DataFrame) -> DataFrame:
    """(m, point, uses, first): the number of corners at each point of a mesh, and the first of them."""
    return corners(faces).groupBy("m", F.col("tip").alias("point")).agg(F.count(F.lit(1)).alias("uses"), F.min("corner").cast("long").alias("first"))


def index_bytes(uses: DataFrame) -> DataFrame:
    """point_uses -> (m, points, bytes): size of face indices as they stand, by the number of points one byte each, two, a varint, or four. Points are numbered by first use; only those of
    the runs that begin below 2^14 are numbered one by one, as all later ones have three bytes."""
    own = uses.where("m is not null").withColumn("run", F.shiftright("first", RUN))
    whole = Window.partitionBy("m")
    counts = own.groupBy("m", "run").agg(F.count(F.lit(1)).alias("points_"), F.sum(F.when(F.col("point").isNotNull(), F.col("uses"))).alias("uses_"))
    outer = F.coalesce(F.sum("points_").over(whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.col("points")
    varints = (n >= 65536) & (n < 2**21)
    runs = counts.select("m", "run", "uses_", outer.alias("outer"), F.sum("points_").over(whole).alias("points"))
    width = F.when(n < 256, 1).when(n < 65536, 2).when(n < 2**21, 3).otherwise(4)
    total = runs.groupBy("m", "points").agg(F.sum(F.col("uses_") * width).alias("all"))
    early = runs.where(varints & (F.col("outer") < 1 << 14)).select("m", "run", "outer")
    new = F.col("outer") + F.row_number().over(Window.partitionBy("m", "run").orderBy("first")) - 1
    short = own.join(early, ["m", "run"]).select("m", "point", "uses", new.alias("new")).where("point is not null")
    saved = short.groupBy("m").agg(F.sum(F.col("uses") * (3 - S.varint_length(F.col("new")))).alias("saved"))
    return total.where("all is not null").join(saved, "m", "left").select("m", "points", (F.col("all") - F.coalesce("saved", F.lit(0))).alias("bytes"))


def plain_index_bytes(faces: DataFrame) -> DataFrame:
    """(m, points, bytes) of faces."""
    return index_bytes(point_uses(faces))

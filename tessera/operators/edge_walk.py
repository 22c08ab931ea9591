"""Connectivity by an edge walk: a corner table as a string of five symbols, and back; and the order in which a walk meets the vertices, in which their values are coded.

The walk eats faces one after another through the edge that the face before left open. The symbol of a face tells which of its other neighbours are still there: C both and a new inner vertex,
L and R one of them, E none, S both with an old vertex, so that the walk forks. Where a later face meets one that forked, an event remembers it for the way back, which replays the symbols from the last on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from tessera.operators.bitcoding import BitReader, Reader, StreamError, encode_bits, varint
from tessera.operators.corner_table import NONE, CornerTable, after, before, is_flat

#: The symbols, and their bits, the lowest first.
C, S, L, R, E = range(5)
PATTERNS = {C: (0, 1), S: (1, 3), L: (3, 3), R: (5, 3), E: (7, 3)}
LEFT_EDGE, RIGHT_EDGE = 0, 1


@dataclass
class Walk:
    symbols: list[int] = field(default_factory=list)
    inner_starts: list[bool] = field(default_factory=list)  # of each component, whether it began at an inner face, which has no symbol
    events: list[tuple[int, int, int]] = field(default_factory=list)  # (source symbol, forking symbol, edge)
    corners: list[int] = field(default_factory=list)  # entry corner of each symbol's face
    start_corners: list[int] = field(default_factory=list)  # of inner start faces

    def order(self) -> list[int]:
        """Corners from which values are visited: those of the way back, then those of inner start faces."""
        return self.corners[::-1] + self.start_corners


def walk(t: CornerTable) -> Walk:
    out = Walk()
    hole_of, holes = _holes(t)
    face_done, vertex_done, hole_done = [False] * len(t.faces), [False] * t.n_vertices, [False] * holes
    fork_of: dict[int, int] = {}

    def there(c: int) -> bool:
        return c != NONE and not face_done[c // 3]

    def round_hole(start: int, first_too: bool) -> None:
        """Mark the vertices of the hole at a corner's vertex, from that corner on."""
        v = t.vertex[start]
        c = before(start)
        while t.opposite[c] != NONE:
            c = after(t.opposite[c])
        if first_too:
            vertex_done[v] = True
        hole_done[hole_of[v]] = True
        while (x := t.vertex[before(c)]) != v:
            vertex_done[x] = True
            c = after(c)
            while t.opposite[c] != NONE:
                c = after(t.opposite[c])

    def eat(start: int) -> None:
        stack = [start]
        while stack:
            c = stack.pop()
            while there(c):
                face_done[c // 3] = True
                out.corners.append(c)
                me, v = len(out.symbols), t.vertex[c]
                right, left = t.opposite[after(c)], t.opposite[before(c)]
                new, vertex_done[v] = not vertex_done[v], True
                if new and hole_of[v] == NONE and there(right):
                    out.symbols.append(C)
                    c = right
                    continue
                for side, x in ((RIGHT_EDGE, right), (LEFT_EDGE, left)):
                    if x != NONE and not there(x) and x // 3 in fork_of:
                        out.events.append((me, fork_of[x // 3], side))
                if there(right) and there(left):
                    out.symbols.append(S)
                    if hole_of[v] != NONE and not hole_done[hole_of[v]]:
                        round_hole(c, False)
                    fork_of[c // 3] = me
                    stack += [left, right]
                    break
                if not there(right) and not there(left):
                    out.symbols.append(E)
                    break
                out.symbols.append(R if not there(right) else L)
                c = left if not there(right) else right

    for face in range(len(t.faces)):
        if face_done[face] or is_flat(t.faces[face]):
            continue
        c, inner = _start(t, face, hole_of)
        out.inner_starts.append(inner)
        if inner:
            face_done[face] = True
            for x in (c, after(c), before(c)):
                vertex_done[t.vertex[x]] = True
            out.start_corners.append(after(c))
            if there(t.opposite[after(c)]):
                eat(t.opposite[after(c)])
        else:
            round_hole(after(c), True)
            eat(c)
    out.events.sort(key=lambda e: e[0])
    return out


def _start(t: CornerTable, face: int, hole_of: list[int]) -> tuple[int, bool]:
    """The corner that looks at a border edge at or next to a face, or the face's first one where it is inside."""
    for c in range(3 * face, 3 * face + 3):
        if t.opposite[c] == NONE:
            return c, False
        if hole_of[t.vertex[c]] != NONE:
            while (x := t.right(c)) != NONE:
                c = x
            return before(c), False
    return 3 * face, True


def _holes(t: CornerTable) -> tuple[list[int], int]:
    """For each vertex the number of its hole, or NONE; and the number of holes."""
    hole_of, n = [NONE] * t.n_vertices, 0
    for start in range(t.n_corners):
        if t.opposite[start] != NONE or is_flat(t.faces[start // 3]) or hole_of[t.vertex[after(start)]] != NONE:
            continue
        c = start
        while hole_of[t.vertex[after(c)]] == NONE:
            hole_of[t.vertex[after(c)]] = n
            c = after(c)
            while t.opposite[c] != NONE:
                c = after(t.opposite[c])
        n += 1
    return hole_of, n


def walk_bytes(t: CornerTable, w: Walk) -> bytes:
    """Traversal kind, counts, events, symbols from the last on, and start faces; without attributes of their own connectivity."""
    sound = sum(not is_flat(f) for f in t.faces)
    head = bytes([0]) + varint(t.n_vertices - len(t.isolated())) + varint(sound) + bytes([0]) + varint(len(w.symbols)) + varint(w.symbols.count(S)) + varint(len(w.events))
    last = 0
    for source, fork, _ in w.events:
        head += varint(source - last) + varint(source - fork)
        last = source
    head += _bits([(edge, 1) for _, _, edge in w.events])
    symbols = _bits([PATTERNS[s] for s in reversed(w.symbols)])
    return head + varint(len(symbols)) + symbols + encode_bits([int(x) for x in w.inner_starts])


def _bits(values: list[tuple[int, int]]) -> bytes:
    held = n = 0
    out = bytearray()
    for v, size in values:
        held |= v << n
        n += size
        while n >= 8:
            out.append(held & 255)
            held, n = held >> 8, n - 8
    return bytes(out) + (bytes([held]) if n else b"")


class Unwalked:
    """A corner table as the way back makes it: vertex, opposite and leftmost; faces are numbered as they are made."""

    def __init__(self, r: Reader):
        kind = r.take(1)[0]
        if kind:
            raise StreamError(f"traversal {kind} of an edge walk")
        n_vertices, n_faces, attributes, n_symbols, n_forks, n_events = r.varint(), r.varint(), r.take(1)[0], r.varint(), r.varint(), r.varint()
        if attributes:
            raise StreamError("attributes with a connectivity of their own")
        if n_faces > 8 * len(r.data) or n_symbols > n_faces or n_events > n_forks > n_symbols or n_vertices > 3 * n_faces:
            raise StreamError("counts that the bytes cannot hold")
        events, source = [], 0
        for _ in range(n_events):
            source += r.varint()
            events.append([source, source - r.varint()])
        edges = r.take(-(-n_events // 8))
        events = [(*e, edges[i // 8] >> i % 8 & 1) for i, e in enumerate(events)]
        symbols = self._symbols(r.take(r.varint()), n_symbols)
        self.vertex, self.opposite = [NONE] * (3 * n_faces), [NONE] * (3 * n_faces)
        self.leftmost: list[int] = []
        self.n_faces = n_faces
        dead = self._replay(symbols, events, BitReader(r), n_vertices + n_forks)
        self._compact(dead)
        if len(self.leftmost) != n_vertices:
            raise StreamError("another number of vertices than the stream says")

    @staticmethod
    def _symbols(data: bytes, n: int) -> list[int]:
        of = {v: s for s, (v, _) in PATTERNS.items()}
        out, held, have, at = [], 0, 0, 0
        for _ in range(n):
            while have < 3 and at < len(data):
                held |= data[at] << have
                at, have = at + 1, have + 8
            size = 1 if not held & 1 else 3
            if have < size:
                raise StreamError("symbols beyond the end")
            out.append(of[held & ((1 << size) - 1)])
            held, have = held >> size, have - size
        return out

    def left(self, c: int) -> int:
        o = self.opposite[after(c)]
        return NONE if o == NONE else after(o)

    def right(self, c: int) -> int:
        o = self.opposite[before(c)]
        return NONE if o == NONE else before(o)

    @property
    def n_vertices(self) -> int:
        return len(self.leftmost)

    def on_border(self, v: int) -> bool:
        return self.leftmost[v] == NONE or self.left(self.leftmost[v]) == NONE

    def _glue(self, a: int, b: int) -> None:
        if a == b or self.opposite[a] != NONE or self.opposite[b] != NONE:
            raise StreamError("an edge with a third face")
        self.opposite[a], self.opposite[b] = b, a

    def _new(self, *corners: int) -> None:
        for c in corners:
            self.vertex[c] = len(self.leftmost)
            self.leftmost.append(c)

    def _replay(self, symbols: list[int], events: list, starts: BitReader, most: int) -> list[int]:
        vertex, n, face, open_, waiting, dead = self.vertex, len(symbols), 0, [], {}, []

        def top() -> int:
            if not open_:
                raise StreamError("no open edge")
            return open_[-1]

        for i, s in enumerate(symbols):
            c = 3 * face
            face += 1
            if s == E:
                self._new(c, c + 1, c + 2)
                open_.append(c)
            elif s in (L, R):
                a = top()
                tip, keep, turn = (c + 2, c + 1, c) if s == R else (c + 1, c, c + 2)
                self._glue(tip, a)
                self._new(tip)
                vertex[turn], vertex[keep] = vertex[before(a)], vertex[after(a)]
                self.leftmost[vertex[turn]] = turn
                open_[-1] = c
            elif s == C:
                a = top()
                v = vertex[after(a)]
                b = after(self.leftmost[v])
                self._glue(a, c + 1)
                self._glue(b, c + 2)
                vertex[c], vertex[c + 1], vertex[c + 2] = v, vertex[after(b)], vertex[before(a)]
                if v in (vertex[c + 1], vertex[c + 2]):
                    raise StreamError("a flat face")
                self.leftmost[vertex[c + 2]] = c + 2
                open_[-1] = c
            else:
                b = top()
                open_.pop()
                if i in waiting:
                    open_.append(waiting[i])
                a = top()
                self._glue(a, c + 2)
                self._glue(b, c + 1)
                v, gone = vertex[before(a)], vertex[after(b)]
                vertex[c], vertex[c + 1], vertex[c + 2] = v, vertex[after(a)], vertex[before(b)]
                self.leftmost[vertex[c + 2]] = c + 2
                if gone != v:
                    self.leftmost[v] = self.leftmost[gone]
                    x = first = after(b)
                    while x != NONE:
                        vertex[x] = v
                        x = self.left(x)
                        if x == first:
                            raise StreamError("a ring around a vertex that should be open")
                    self.leftmost[gone] = NONE
                    dead.append(gone)
                open_[-1] = c
            if len(self.leftmost) > most:
                raise StreamError("more vertices than the stream says")
            if s in (L, R, E):
                while events and events[-1][0] == n - 1 - i:
                    _, fork, edge = events.pop()
                    waiting[n - 1 - fork] = after(top()) if edge == RIGHT_EDGE else before(top())
        while open_:
            a = open_.pop()
            if not starts.bit():
                continue
            if face == self.n_faces:
                raise StreamError("more faces than the stream says")
            c = 3 * face
            face += 1
            b = after(self._leftmost_of(vertex[after(a)]))
            d = after(self._leftmost_of(vertex[after(b)]))
            for x, y in ((c, a), (c + 1, b), (c + 2, d)):
                self._glue(x, y)
            vertex[c], vertex[c + 1], vertex[c + 2] = vertex[after(b)], vertex[after(d)], vertex[after(a)]
        if face != self.n_faces:
            raise StreamError("fewer faces than the stream says")
        return dead

    def _leftmost_of(self, v: int) -> int:
        if self.leftmost[v] == NONE:
            raise StreamError("a vertex without faces")
        return self.leftmost[v]

    def _compact(self, dead: list[int]) -> None:
        """Vertices that a fork merged away take the place of the last ones."""
        n = len(self.leftmost)
        for gone in dead:
            while n and self.leftmost[n - 1] == NONE:
                n -= 1
            last = n - 1
            if last < gone:
                continue
            c = first = self.leftmost[last]
            while c != NONE:
                self.vertex[c] = gone
                c = self.right(c)
                if c == first:
                    break
            self.leftmost[gone], self.leftmost[last] = first, NONE
            n -= 1
        while n and self.leftmost[n - 1] == NONE:
            n -= 1
        del self.leftmost[n:]

    def order(self) -> list[int]:
        return list(range(0, 3 * self.n_faces, 3))


def visits(t, order: list[int]) -> tuple[list[int], list[int]]:
    """Depth-first over the faces from each corner of order in turn: the corner at which each vertex is met first, in that order, and for each vertex its place (NONE if never met).
    t has vertex, opposite, n_vertices and on_border."""
    seen_face = [False] * (len(t.vertex) // 3)
    place, corners = [NONE] * t.n_vertices, []

    def meet(c: int) -> bool:
        v = t.vertex[c]
        new = place[v] == NONE
        if new:
            place[v] = len(corners)
            corners.append(c)
        return new

    there = lambda c: c != NONE and not seen_face[c // 3]
    for start in order:
        if seen_face[start // 3]:
            continue
        meet(after(start))
        meet(before(start))
        stack = [start]
        while stack:
            c = stack.pop()
            while there(c):
                seen_face[c // 3] = True
                right, left = t.opposite[after(c)], t.opposite[before(c)]
                if meet(c) and not t.on_border(t.vertex[c]):
                    c = right
                elif there(right) and there(left):
                    stack += [left, right]
                    break
                else:
                    c = right if there(right) else left
    return corners, place


def visits_by_degree(t, order: list[int]) -> tuple[list[int], list[int]]:
    """As visits, but faces whose new vertex more faces predict come first: three stacks, for a vertex that is known, one that has been seen from several faces, and one seen from a single face."""
    seen_face, seen_from = [False] * (len(t.vertex) // 3), [0] * t.n_vertices
    place, corners = [NONE] * t.n_vertices, []
    there = lambda c: c != NONE and not seen_face[c // 3]

    def meet(c: int) -> None:
        if place[t.vertex[c]] == NONE:
            place[t.vertex[c]] = len(corners)
            corners.append(c)

    def rank(c: int) -> int:
        v = t.vertex[c]
        if place[v] != NONE:
            return 0
        seen_from[v] += 1
        return 1 if seen_from[v] > 1 else 2

    for start in order:
        if seen_face[start // 3]:
            continue
        stacks, best = [[start], [], []], 0
        for c in (after(start), before(start), start):
            meet(c)
        while True:
            best = next((k for k in range(3) if stacks[k]), None)
            if best is None:
                break
            c = stacks[best].pop()
            while there(c):
                seen_face[c // 3] = True
                meet(c)
                right, left = t.opposite[after(c)], t.opposite[before(c)]
                go = NONE
                if there(left):
                    k = rank(left)
                    if not there(right) and k <= best:
                        go = left
                    else:
                        stacks[k].append(left)
                        best = min(best, k)
                if go == NONE and there(right):
                    k = rank(right)
                    if k <= best:
                        go = right
                    else:
                        stacks[k].append(right)
                        best = min(best, k)
                c = go
    return corners, place
